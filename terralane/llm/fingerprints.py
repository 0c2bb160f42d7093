"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec

from .common import text_key

#: Hashes in a sketch. The standard error of a likeness J is about sqrt(J (1 - J) / K), 0.03 at most.
K = 256
#: Words in a shingle.
SHINGLE = 5
#: Bytes of text that one partition of the ordered documents is planned for, and blocks of consecutive ids in it.
PARTITION_BYTES = 64 << 20
BLOCKS = 16
SPACE = 4294967296.0


def with_sketch(rows: DataFrame, text: str, name: str, k: int = K, width: int = SHINGLE) -> DataFrame:
    """Add `name`: the k smallest distinct 32-bit hashes of the word shingles of `text`, ascending.

    Fewer words than `width` make one shingle; none make none. The word hashes are a column of their own, since a
    lambda that held their expression would split the text again for each shingle.
    """
    low = lambda h: h.bitwiseAND(F.lit(4294967295).cast("long"))
    words = F.transform(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w))
    h = F.col("__words")
    long = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: low(F.xxhash64(*(F.get(h, i + j) for j in range(width)))))
    none = F.array().cast("array<bigint>")
    hashes = F.when(F.size(h) >= width, long).when(F.size(h) > 0, F.array(low(F.xxhash64(h)))).otherwise(none)
    rows = rows.withColumn("__words", words).withColumn(name, hashes).drop("__words")
    return rows.withColumn(name, F.slice(F.sort_array(F.array_distinct(name)), 1, k))


def union_kept(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(kept: Column, k: int = K) -> Column:
    """Distinct shingles by the sketch alone: exact below k, else (k - 1) / the k-th smallest hash as a share of the hash space."""
    return F.when(F.size(kept) < k, F.size(kept).cast("double")).otherwise((k - 1) * SPACE / F.element_at(kept, -1))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two sketches; two empty ones are alike."""
    both = union_kept(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; an empty a is contained."""
    union = distinct_count(union_kept(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_count(a, k)))


def merge_sketches(parts: DataFrame, key: str, kept: str = "kept", k: int = K, fan_in: int = 64) -> DataFrame:
    """The sketch of each key's whole from the sketches of its parts.

    Merged in rounds of at most about fan_in sketches at a time, so a key with very many parts never meets in one
    group. A null key is a key like others; parts without shingles add nothing. No rows give no rows.
    """
    from math import ceil, log

    rows = parts.select(key, kept)
    levels = max(0, ceil(log(max(rows.count(), 1), fan_in)) - 1)
    for level in range(levels, -1, -1):
        salt = F.pmod(F.xxhash64(F.rand(7)), F.lit(fan_in**level)) if level else F.lit(0)
        rows = rows.groupBy(key, salt.alias("__salt")).agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(kept)))), 1, k).alias(kept)).drop("__salt")
    return rows


def block_of(cut: list[int]) -> Column:
    """The number of bounds up to the column `low`: coarse bounds first, then those between two of them."""
    width = max(1, int(len(cut) ** 0.5))
    groups = [cut[i : i + width] for i in range(0, len(cut), width)]
    if not groups:
        return F.lit(0)
    below = lambda bounds: F.size(F.filter(bounds, lambda c: c <= F.col("low")))
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    coarse = F.greatest(below(longs(g[0] for g in groups)) - 1, F.lit(0))
    return coarse * width + below(F.get(F.array(*(longs(g) for g in groups)), coarse))


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, text, the order's columns, and next_text: the text of the next document in descending doc_id order; after the last comes the first. guest 1: a copy that only serves as a next document.

    Documents are dealt into blocks of consecutive ids at quantiles, more of them the more bytes there are, and each block also gets
    the first document of the block below, so that no window crosses a partition. Only one id per block reaches the
    driver. Rows of one id stand in the order of their text keys, which no other scan changes.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("*", text_key(F.col("text")).alias("t"))
    rows = rows.withColumn("low", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("at", F.struct("low", "t.t1", "t.t2"))
    if partitions is None:
        n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_bytes // PARTITION_BYTES)
    blocks = partitions * BLOCKS
    cut = sorted(set(rows.select(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], max(10_000, 4 * blocks)).alias("p")).first()["p"] or []))
    rows = rows.withColumn("block", block_of(cut))
    # the first document of each block is a guest in the block above it; of rows that repeat id and text any one is
    firsts = sorted((r["block"], r["top"]) for r in rows.groupBy("block").agg(F.max("at").alias("top")).collect())
    visits = [(firsts[(i + 1) % len(firsts)][0], *firsts[i][1]) for i in range(len(firsts))]
    guests = docs.sparkSession.createDataFrame(visits, "block int, low long, t1 long, t2 long")
    same = [F.col("x.low") == F.col("y.low"), F.col("x.t.t1") == F.col("y.t1"), F.col("x.t.t2") == F.col("y.t2")]
    visiting = rows.alias("x").join(F.broadcast(guests).alias("y"), same).select("y.block", "x.doc_id", "x.text", "x.t", "x.low").dropDuplicates(["block"])
    rows = rows.select(F.lit(0).alias("guest"), "block", "doc_id", "text", "t", "low").unionByName(visiting.withColumn("guest", F.lit(1)))
    return rows.repartition(partitions, "block").withColumn("next_text", F.lead("text").over(following()))


def following() -> WindowSpec:
    """Descending doc_id order within a block, its guest last."""
    return Window.partitionBy("block").orderBy("guest", F.col("low").desc(), F.col("t").desc())


def fingerprints(docs: DataFrame, k: int = K, width: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones of the next document
    in descending doc_id order (all of them where it is shorter; after the last document comes the first).
    Result, one row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hashes, the smallest
    first), near_edited, near_next, n_shingles, edited_containment. A null text counts as empty; an empty text has an empty
    fingerprint, and two empty ones are alike (1.0). A null doc_id comes last; rows that repeat a doc_id stand in the
    descending order of their texts' 128-bit keys. A lone document is its own next one. No rows give no rows. Only doc_id and text are read.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = with_sketch(with_sketch(rows, "text", "a", k, width), "edited", "e", k, width)
    rows = rows.select("doc_id", "low", "t", "guest", "block", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "a", "e")
    rows = rows.withColumn("b", F.lead("a").over(following())).where("guest = 0")
    a, e, b = F.col("a"), F.col("e"), F.col("b")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(a).alias("fingerprint"),
        printed(e).alias("edited_fingerprint"),
        resemblance(a, e, k).alias("near_edited"),
        resemblance(a, b, k).alias("near_next"),
        distinct_count(a, k).alias("n_shingles"),
        containment(a, e, k).alias("edited_containment"),
    )


def printed(kept: Column) -> Column:
    return F.array_join(kept.cast("array<string>"), " ")
