"""Manifest tables: filters, hash samples and splits, guards and audits (one row per image)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


class TableError(ValueError):
    """A table breaks a rule that its operator relies on."""


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table itself, if it has all the columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise TableError(f"missing columns: {', '.join(missing)}")
    return df


def is_true(flag: Column) -> Column:
    """A flag given as boolean or as text in any spelling of true."""
    return F.coalesce(F.lower(F.trim(flag.cast("string"))) == "true", F.lit(False))


def allowed(manifest: DataFrame, flag: str = "ssl_allowed") -> DataFrame:
    """Rows whose flag is true; all rows where the manifest has no flag."""
    return manifest.where(is_true(F.col(flag))) if flag in manifest.columns else manifest


def resolve_path(path: Column, root: str) -> Column:
    """The path under `root`, without a leading data/."""
    return F.concat_ws("/", F.lit(root), F.regexp_replace(path, "^data/", ""))


def hash_key(*parts: Column | str) -> Column:
    """sha256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(p) for p in parts)), 256)


def hash_sample(df: DataFrame, strata: Sequence[str], n: int | DataFrame, seed: int | str, id: str = "id", prefix: str = "m1a_") -> DataFrame:
    """The n rows of each stratum whose hash of seed, stratum and id is least, numbered in stratum and hash order.

    n is one number or a table (stratum, n); a stratum with fewer rows is an error.
    """
    stratum = F.concat_ws("/", *strata)
    rows = df.withColumn("stratum", stratum).withColumn("hash", hash_key(str(seed), F.col("stratum"), F.col(id).cast("string")))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("stratum").orderBy("hash", id)))
    if isinstance(n, int):
        rows = rows.withColumn("n", F.lit(n))
    else:
        rows = rows.join(n.select("stratum", "n"), "stratum")
    short = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("have"), F.first("n").alias("n")).where("have < n")
    if rest := [r["stratum"] for r in short.select("stratum").limit(20).collect()]:
        raise TableError(f"strata with too few rows: {', '.join(sorted(rest))}")
    picked = rows.where("rank <= n")
    # a stratum's first number is the sum of the sizes before it: one row per stratum is numbered, not every row
    sizes = picked.groupBy("stratum").agg(F.first("n").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picked = picked.join(sizes.select("stratum", before.alias("before")), "stratum")
    return picked.withColumn("sample_id", F.concat(F.lit(prefix), F.lpad((F.col("before") + F.col("rank")).cast("string"), 3, "0"))).drop("n", "before")


def hash_split(df: DataFrame, by: str, fraction: float, seed: int | str, id: str = "id") -> DataFrame:
    """Add split: per group the first round(n * fraction) rows by hash are dev, half to even, the others train."""
    group = Window.partitionBy(by)
    rank = F.row_number().over(group.orderBy(hash_key(str(seed), F.col(by), F.col(id).cast("string")), id))
    most = F.bround(F.count(F.lit(1)).over(group) * fraction)
    return df.withColumn("split", F.when(rank <= most, "dev").otherwise("train"))


def hash_pick(df: DataFrame, by: str, n: int, salt: str, id: str = "id") -> DataFrame:
    """The n rows of each group with the least hash under a salt, at most."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(hash_key(salt, F.col(id).cast("string")), id))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def seeded_pick(df: DataFrame, n: int, seed: int | str, id: str = "id") -> DataFrame:
    """n rows by hash order: the same ones on every run."""
    return df.orderBy(hash_key(str(seed), F.col(id).cast("string")), id).limit(n)


def group_split(df: DataFrame, group: str, ratios: Sequence[tuple[str, float]], seed: int | str) -> DataFrame:
    """Add split by whole groups: groups in hash order are cut at the floors of the cumulated ratios; the last takes the rest."""
    groups = df.select(group).distinct().withColumn("hash", hash_key(str(seed), F.col(group).cast("string")))
    n = groups.count()
    # groups are ranked by counting in hash buckets first, so that no window spans all of them
    groups = groups.withColumn("bucket", F.substring("hash", 1, 2))
    before = groups.groupBy("bucket").count().select("bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("hash")) + F.col("before")
    groups = groups.join(F.broadcast(before), "bucket").withColumn("rank", rank)
    split, total = F.lit(ratios[-1][0]), 0.0
    cuts = []
    for name, share in ratios[:-1]:
        total += share
        cuts.append((name, int(n * total + 1e-9)))
    for name, cut in reversed(cuts):
        split = F.when(F.col("rank") <= cut, name).otherwise(split)
    return df.join(groups.select(group, split.alias("split")), group)


def balanced_draw(df: DataFrame, by: str, n: int, seed: int, epoch: int, id: str = "id") -> DataFrame:
    """n draws with replacement, equally many from each source, in a seeded order; n must divide by the number of sources."""
    dense = df.select(F.col(by), F.col(id), (F.row_number().over(Window.partitionBy(by).orderBy(id)) - 1).alias("k"))
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("size"))
    sources = sizes.count()
    if not sources or n % sources:
        raise TableError(f"{n} draws don't divide by {sources} sources")
    draws = sizes.select(by, "size", F.explode(F.sequence(F.lit(0), F.lit(n // sources - 1))).alias("draw"))
    number = lambda tag: F.conv(F.substring(hash_key(tag, str(seed), str(epoch), F.col(by), F.col("draw").cast("string")), 1, 8), 16, 10).cast("long")
    draws = draws.withColumn("k", F.pmod(number("draw"), F.col("size")).cast("int")).withColumn("place", number("place"))
    return draws.join(dense, [by, "k"]).select(by, id, "draw", "place")


def build_pairs(df: DataFrame, split: str, expected: str, root: str) -> DataFrame:
    """Image and mask paths of the rows of one split; another split or a repeated id is an error."""
    if not df.where(F.col("split") != expected).isEmpty():
        raise TableError(f"rows outside split {expected}")
    repeated(df, "id")
    folder = F.concat_ws("/", F.lit(root), F.when(F.lit(split == "train"), "Train").otherwise("Val"), F.initcap("domain"))
    return df.withColumn("image_rel", F.concat_ws("/", folder, F.lit("images_png"), F.concat(F.col("id"), F.lit(".png")))).withColumn("mask_rel", F.concat_ws("/", folder, F.lit("masks_png"), F.concat(F.col("id"), F.lit(".png"))))


def repeated(df: DataFrame, key: str) -> DataFrame:
    """The table itself, unless a key repeats."""
    if twice := [str(r[0]) for r in df.groupBy(key).count().where("count > 1").select(key).limit(5).collect()]:
        raise TableError(f"repeated {key}: {', '.join(twice)}")
    return df


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The distinct keys of a that occur in b."""
    return a.select(key).join(b.select(key), key, "left_semi").distinct()


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    if found := [str(r[0]) for r in overlap(a, b, key).limit(5).collect()]:
        raise TableError(f"{key} in both tables: {', '.join(found)}")


def population_report(df: DataFrame, by: str, expected: DataFrame, forbidden: str, columns: Sequence[str]) -> DataFrame:
    """Per source the rows, the expected number, rows with a forbidden pattern in any of the columns, and whether all is well."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).cast("string").rlike(f"(?i){forbidden}"), F.lit(False))
    have = df.groupBy(by).agg(F.count(F.lit(1)).alias("have"), F.count_if(hit).alias("forbidden"))
    out = have.join(expected, by, "full_outer").select(by, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("have", "forbidden", "expected")))
    return out.withColumn("ok", (F.col("have") == F.col("expected")) & (F.col("forbidden") == 0))


def check_population(df: DataFrame, by: str, expected: DataFrame, forbidden: str, columns: Sequence[str]) -> None:
    if bad := [str(r[0]) for r in population_report(df, by, expected, forbidden, columns).where("not ok").limit(5).collect()]:
        raise TableError(f"population differs for {', '.join(bad)}")


def spatial_leakage(regions: DataFrame, buffer: float = 512.0) -> DataFrame:
    """Pairs of regions of different splits in one frame whose boxes are nearer than the buffer (512 at least).

    Boxes, widened by half the buffer, are dealt to square cells, so only boxes that share a cell meet; a pair counts in its first common cell,
    so pairs are not shuffled.
    """
    from ..functions.spatial import box_cells, first_cell

    buffer = max(buffer, 512.0)
    side, margin = buffer * 2, buffer / 2 + 1
    r = regions.select("frame", "id", "split", "x0", "y0", "x1", "y1").distinct().withColumn("cell", box_cells("x0", "y0", "x1", "y1", side, margin))
    a, b = r.alias("a"), r.alias("b")
    once = F.col("a.cell") == first_cell({"x": ("a.x0", "b.x0"), "y": ("a.y0", "b.y0")}, side, margin)
    near = a.join(b, (F.col("a.frame") == F.col("b.frame")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.split") != F.col("b.split")) & once)
    gap = lambda lo, hi: F.greatest(F.col(f"a.{lo}") - F.col(f"b.{hi}"), F.col(f"b.{lo}") - F.col(f"a.{hi}"), F.lit(0.0))
    d = F.sqrt(gap("x0", "x1") * gap("x0", "x1") + gap("y0", "y1") * gap("y0", "y1"))
    return near.select(F.col("a.frame").alias("frame"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), d.alias("distance")).where(F.col("distance") < buffer)


def audit_hashes(manifest: DataFrame, files: DataFrame, path: str = "path", sha: str = "sha256") -> DataFrame:
    """Rows whose file is missing or whose content has another sha256; files is a binaryFile scan (path, content)."""
    actual = files.select(F.col("path").alias(path), F.sha2("content", 256).alias("actual"))
    joined = manifest.join(actual, path, "left")
    return joined.withColumn("error", F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col(sha), "changed")).where("error is not null")


def audit_pairs(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Add error: missing image or mask, unequal sizes, or a mode that isn't allowed. files has (path, width, height, mode)."""
    image = files.select(F.col("path").alias("image_rel"), F.col("width").alias("iw"), F.col("height").alias("ih"), F.col("mode").alias("imode"))
    mask = files.select(F.col("path").alias("mask_rel"), F.col("width").alias("mw"), F.col("height").alias("mh"), F.col("mode").alias("mmode"))
    error = (
        F.when(F.col("iw").isNull(), "missing image")
        .when(F.col("mw").isNull(), "missing mask")
        .when((F.col("iw") != F.col("mw")) | (F.col("ih") != F.col("mh")), "sizes differ")
        .when(F.col("imode") != "RGB", "image mode")
        .when(~F.col("mmode").isin("L", "P"), "mask mode")
    )
    return pairs.join(image, "image_rel", "left").join(mask, "mask_rel", "left").withColumn("error", error)


def stale_rows(work: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the work list without a cached output under the same keys."""
    return work.join(cache.select(*keys).distinct(), list(keys), "left_anti")


def reuse_counts(work: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(state, n): how many rows are reused and how many must be generated."""
    known = cache.select(*keys).distinct().withColumn("known", F.lit(True))
    return work.join(known, list(keys), "left").groupBy(F.when(F.col("known"), "reused").otherwise("generated").alias("state")).agg(F.count(F.lit(1)).alias("n"))


def fingerprint(columns: Sequence[str]) -> Column:
    """sha256 of the columns as compact JSON with sorted keys; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def differing_keys(a: DataFrame, b: DataFrame, run: str, keys: Sequence[str]) -> DataFrame:
    """(run, key) for each key of the list in which the two rows of a run disagree."""
    pairs = a.alias("a").join(b.alias("b"), run)
    found = F.array_compact(F.array(*(F.when(~F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")), k) for k in keys)))
    return pairs.select(run, F.explode(found).alias("key"))


def assert_same(a: DataFrame, b: DataFrame, run: str, keys: Sequence[str]) -> None:
    if found := differing_keys(a, b, run, keys).limit(5).collect():
        raise TableError("runs differ: " + ", ".join(f"{r[0]}.{r[1]}" for r in found))


def table_diff(a: DataFrame, b: DataFrame, key: Sequence[str], value: str, within: float = 0.0) -> DataFrame:
    """(category, n, worst): rows equal, changed and missing on a side, with the largest difference of the value."""
    x = a.select(*key, F.col(value).alias("va"), F.lit(1).alias("ina"))
    y = b.select(*key, F.col(value).alias("vb"), F.lit(1).alias("inb"))
    d = F.abs(F.col("va") - F.col("vb"))
    category = F.when(F.col("inb").isNull(), "only a").when(F.col("ina").isNull(), "only b").when(F.coalesce(d <= within, F.col("va").eqNullSafe(F.col("vb"))), "equal").otherwise("changed")
    return x.join(y, list(key), "full_outer").groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"), F.max(d).alias("worst"))


def verify_frames(graphs: DataFrame, images: DataFrame, key: str = "scene_id") -> DataFrame:
    """Add frame: verified, mismatch, or unknown where the graph carries no size. Both have (key, width, height)."""
    g = graphs.select(key, F.col("width").alias("gw"), F.col("height").alias("gh"))
    i = images.select(key, F.col("width").alias("iw"), F.col("height").alias("ih"))
    state = F.when(F.col("gw").isNull() | F.col("gh").isNull(), "unknown").when((F.col("gw") == F.col("iw")) & (F.col("gh") == F.col("ih")), "verified").otherwise("mismatch")
    return g.join(i, key, "left").withColumn("frame", state)


def missing_files(sample: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Rows of the sample whose file isn't listed."""
    return sample.join(files.select(F.col("path").alias(path)), path, "left_anti")


def provenance(inputs: DataFrame, config: Sequence[str]) -> DataFrame:
    """One row per run: hash over its inputs' hashes in name order, and the fingerprint of its configuration.

    inputs has (run, name, sha256) and the configuration columns, equal within a run.
    """
    listed = F.array_sort(F.collect_list(F.struct("name", "sha256")))
    one = inputs.groupBy("run").agg(listed.alias("inputs"), *(F.first(c).alias(c) for c in config))
    return one.select("run", F.size("inputs").alias("n_inputs"), F.sha2(F.array_join(F.transform("inputs", lambda x: x["sha256"]), ":"), 256).alias("inputs_sha256"), fingerprint(config).alias("config_sha256"))


def route_pair_errors(pairs: DataFrame, width: str = "width", height: str = "height", splits: Sequence[str] = ("dev", "test")) -> DataFrame:
    """Add errors, an array of what is wrong with a route pair, and valid."""
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    inside = lambda p: (F.col(p)["x"] >= 0) & (F.col(p)["y"] >= 0) & (F.col(p)["x"] < F.col(width)) & (F.col(p)["y"] < F.col(height))
    finite = lambda p: ~(F.isnan(F.col(p)["x"]) | F.isnan(F.col(p)["y"]) | (F.abs(F.col(p)["x"]) == float("inf")) | (F.abs(F.col(p)["y"]) == float("inf")))
    rules = [
        (F.col("id").isNull(), "id missing"),
        ((n > 1) & F.col("id").isNotNull(), "id repeated"),
        (~F.col("split").isin(*splits), "split"),
        (F.col("expected_reachable").isNull(), "expected_reachable missing"),
        *((~finite(p), f"{p} not finite") for p in ("start", "goal")),
        *((~inside(p), f"{p} out of bounds") for p in ("start", "goal")),
    ]
    rows = pairs.withColumn("errors", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), name) for c, name in rules))))
    return rows.withColumn("valid", F.size("errors") == 0)


def read_manifest(spark: SparkSession, path: str, required: Sequence[str] = ("id", "dataset", "domain_or_scene", "path")) -> DataFrame:
    """Allowed rows of a CSV manifest; a missing required column is an error."""
    return allowed(require(spark.read.csv(path, header=True), required))
