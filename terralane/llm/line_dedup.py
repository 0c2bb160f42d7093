"""Line dedup by distinct-site spread: boilerplate lines are those that stand on many sites."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import lookup, lower_ascii, stored, text_key, tidy

#: A line is boilerplate when at least so many distinct sites have it.
MIN_SITES = 10
#: log2 of the HyperLogLog registers; the standard error is about 0.8 / 2 ** (LG_K / 2).
LG_K = 11
#: Lines whose estimate lies within this share of the limit are counted exactly: over 5 standard errors.
MARGIN = 0.15
#: So many boilerplate lines at most are sent to every task; more of them are joined instead.
SENT_LINES = 100_000
SPACES = b" \t\n\x0b\x0c\r"


def line_key(line):
    """128 bits of the line without the white space around it."""
    return F.unhex(F.substring(F.sha2(trimmed(line), 256), 1, 32))


def trimmed(line):
    return F.regexp_replace(line, r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """(line_key, sites, uses): the keys whose estimated sites may reach min_sites, with their number of uses."""
    return stored(lines.groupBy("line_key").agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.concat(F.lit("s"), "site"), F.lit(LG_K))).alias("sites"), F.count(F.lit(1)).alias("uses")).where(F.col("sites") >= min_sites * (1 - margin)), "spread")


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """The keys on at least min_sites sites, of (line_key, site) rows, with their number of uses.

    Sketches of each key's sites merge by aggregation. Keys whose estimate is near the limit are counted exactly,
    by distinct (key, site) pairs; the others' estimates decide.
    """
    spread = spread_lines(lines, min_sites, margin)
    clear = spread.where(F.col("sites") > min_sites * (1 + margin)).select("line_key", "uses")
    near = spread.where(F.col("sites") <= min_sites * (1 + margin)).select("line_key", "uses")
    total = near.agg(F.sum("uses").alias("n")).first()["n"] or 0
    exact = lookup(lines, near, "line_key", "uses", total).select("line_key", "site", "uses").distinct().groupBy("line_key").agg(F.count(F.lit(1)).alias("sites"), F.first("uses").alias("uses"))
    return clear.unionByName(exact.where(F.col("sites") >= min_sites).select("line_key", "uses"))


def copy_key(text):
    """128 bits of the text's words, without ASCII case and with one blank between words."""
    return F.unhex(F.substring(F.sha2(F.trim(F.regexp_replace(lower_ascii(text), r"[\x20\x09-\x0D]+", " ")), 256), 1, 32))


def boilerplate_of_distinct(lines: DataFrame, min_sites: int = MIN_SITES, groups: DataFrame | None = None) -> DataFrame:
    """boilerplate_lines of (line_key, site, copy, id) rows, where the rows of one copy key vote once, by the site of the least id.

    groups (copy, group) puts several copy keys into one vote; keys without a row there are their own. Votes never outnumber sites, so only the lines that all rows put near the limit are counted again.
    """
    spread = spread_lines(lines.select("line_key", "site"), min_sites)
    if spread.count() <= SENT_LINES:
        found = lines.join(F.broadcast(spread.select("line_key")), "line_key")
    else:
        found = lookup(lines, spread.select("line_key", "uses"), "line_key", "uses", spread.agg(F.sum("uses").alias("n")).first()["n"])
    votes = found.groupBy("line_key", "copy").agg(F.min(F.struct("id", "site")).alias("vote"))
    if groups is not None:
        votes = votes.join(groups, "copy", "left").groupBy("line_key", F.coalesce("group", "copy")).agg(F.min("vote").alias("vote"))
    votes = stored(votes.select("line_key", F.col("vote.site").alias("site")), "votes")
    return boilerplate_lines(votes, min_sites).select("line_key").join(spread.select("line_key", "uses"), "line_key")


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, once: str | None = None, near: DataFrame | None = None) -> DataFrame:
    """Remove lines that stand on many sites.

    Lines are what newlines separate, compared without the white space around them; empty lines always stay. All
    uses of a line on at least min_sites distinct sites go. A null site counts as a site named by an empty text. Result:
    the columns of docs (n_chars, where there is one, is that of the new text), n_lines and n_removed (columns of these names are
    replaced); each row gives one row. A null text stays null with no lines. No rows give no rows.

    With `once`, a column of ids, copies of one text (equal words but for ASCII case) count as one document on the
    site of the least id: a copied article is no boilerplate, however many sites its copies stand on. near (t1, t2, class), the
    text keys of documents with the class of their near copies, lets near copies of one class count as one document too.
    """
    own = [i for i, c in enumerate(docs.columns) if c.lower() not in ("n_lines", "n_removed")]
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).select(*(names[i] for i in own))
    at = {c: names[docs.columns.index(c)] for c in ("text", site, *([once] if once else []))}
    size = names[docs.columns.index("n_chars")] if "n_chars" in docs.columns else None
    text = F.col(at["text"])
    copy = [] if once is None else [copy_key(text).alias("copy"), F.col(at[once]).alias("id")]
    groups = None
    if copy and near is not None:
        # a class is named by the least copy key in it, so that copies of its texts beyond ASCII case and white space are in it too
        texts = rows.where(text.isNotNull()).select(text_key(text).alias("t"), copy_key(text).alias("copy")).distinct()
        groups = texts.join(near.where("class is not null").select(F.struct("t1", "t2").alias("t"), "class").distinct(), "t").groupBy("copy").agg(F.min("class").alias("group"))
    lines = rows.select(F.coalesce(F.col(at[site]), F.lit("")).alias("site"), *copy, F.explode(F.split(text, "\n")).alias("line"))
    lines = lines.where(trimmed(F.col("line")) != "").select("site", *(["copy", "id"] if copy else []), line_key(F.col("line")).alias("line_key"))
    found = boilerplate_of_distinct(lines, min_sites, groups) if copy else boilerplate_lines(lines, min_sites)
    bad = stored(found, "boilerplate")
    if bad.count() <= SENT_LINES:
        out = without(rows, at["text"], size, {bytes(r["line_key"]) for r in bad.select("line_key").collect()})
    else:
        out = without_joined(rows, at["text"], size, bad)
    return out.toDF(*(docs.columns[i] for i in own), "n_lines", "n_removed")


def without_joined(rows: DataFrame, text: str, size: str | None, bad: DataFrame) -> DataFrame:
    """The rows without the lines of `bad`, by joins: places of such lines come back to their texts, by the texts' keys."""
    keyed = rows.withColumn("t", text_key(F.col(text)))
    sizes = keyed.groupBy("t").agg(F.count(F.lit(1)).alias("size"))
    once = keyed.select("t", text).dropDuplicates(["t"])
    lines = once.select("t", F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(trimmed(F.col("line")) != "").select("t", "pos", line_key(F.col("line")).alias("line_key"))
    uses = bad.agg(F.sum("uses").alias("n")).first()["n"] or 0
    gone = lookup(lines, bad, "line_key", "uses", uses).groupBy("t").agg(F.collect_list("pos").alias("gone"))
    out = lookup(keyed, sizes.join(gone, "t", "left"), "t", "size", rows.count())
    parts = F.split(text, "\n")
    stay = F.filter(parts, lambda _, i: ~F.array_contains("gone", i))
    left = F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(stay, "\n"))
    cols = [left.alias(c) if c == text else F.length(left).cast(rows.schema[c].dataType).alias(c) if c == size else F.col(c) for c in rows.columns]
    return out.select(*cols, F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"), F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_removed"))


def without(rows: DataFrame, text: str, size: str | None, bad: set[bytes]) -> DataFrame:
    """The rows without the lines whose keys are in `bad`, by one pass over the texts."""
    kept = rows.columns
    at = kept.index(text)
    schema = T.StructType([*rows.schema, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    shared = rows.sparkSession.sparkContext.broadcast(bad)

    def run(batches):
        bad = shared.value
        for batch in batches:
            texts, n, gone = [], [], []
            for t in batch.column(at).to_pylist():
                lines = t.split("\n") if t is not None else []
                stay = [x for x in lines if not (y := x.encode().strip(SPACES)) or hashlib.sha256(y).digest()[:16] not in bad]
                texts.append(None if t is None else "\n".join(stay))
                n.append(len(lines))
                gone.append(len(lines) - len(stay))
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            if size is not None:
                i = kept.index(size)
                columns[i] = pa.array([None if t is None else len(t) for t in texts], columns[i].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*kept, "n_lines", "n_removed"])

    return rows.mapInArrow(tidy(run), schema)


ORACLE_SQL = """
WITH r AS (SELECT row_number() OVER () AS r, * FROM documents),
l AS (SELECT r, coalesce(source, '') AS site, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM r),
k AS (SELECT *, regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', '') AS key FROM l),
b AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= 10),
g AS (SELECT r, count(*) AS n_lines, count(b.key) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (b.key IS NULL), '') AS kept FROM k LEFT JOIN b USING (key) GROUP BY r)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN length(kept) END AS n_chars, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM r LEFT JOIN g USING (r)
"""
