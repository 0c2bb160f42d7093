"""Manifest queries over documents (source = dataset, lang = domain)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import manifest as op
from .inputs import MANIFEST, manifest

W = "WITH " + MANIFEST


@query("a1_allowed_rows", "SELECT doc_id, source, CASE WHEN n_chars % 3 = 0 THEN ' TRUE ' WHEN n_chars % 3 = 1 THEN 'False' ELSE 'true' END AS ssl_allowed FROM documents WHERE n_chars % 3 <> 1")
def _(t):
    flag = F.when(F.col("n_chars") % 3 == 0, " TRUE ").when(F.col("n_chars") % 3 == 1, "False").otherwise("true")
    return op.allowed(op.require(t.documents.withColumn("ssl_allowed", flag), ["doc_id", "source"])).select("doc_id", "source", "ssl_allowed")


@query("a2_resolve_path", "SELECT doc_id, '/mnt/raw/' || regexp_replace(CASE WHEN doc_id % 2 = 0 THEN 'data/' ELSE '' END || source || '/' || doc_id, '^data/', '') AS path FROM documents")
def _(t):
    raw = F.concat(F.when(F.col("doc_id") % 2 == 0, "data/").otherwise(""), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", op.resolve_path(raw, "/mnt/raw").alias("path"))


@query("b1_hash_sample", W + """, s AS (SELECT dataset AS stratum, id, sha256('20260831:' || dataset || ':' || id) AS hash FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY hash, id) AS rank FROM s)
SELECT stratum, id, hash, rank, 'm1a_' || lpad(CAST(row_number() OVER (ORDER BY stratum, rank) AS VARCHAR), 3, '0') AS sample_id FROM r WHERE rank <= 8""")
def _(t):
    return op.hash_sample(manifest(t), ["dataset"], 8, 20260831).select("stratum", "id", "hash", "rank", "sample_id")


@query("b2_hash_split", W + """, r AS (SELECT id, domain, row_number() OVER (PARTITION BY domain ORDER BY sha256('7:' || domain || ':' || id), id) AS k, count(*) OVER (PARTITION BY domain) AS n FROM m)
SELECT id, domain, CASE WHEN k <= round_even(n * 0.15, 0) THEN 'dev' ELSE 'train' END AS split FROM r""")
def _(t):
    return op.hash_split(manifest(t), "domain", 0.15, 7).select("id", "domain", "split")


@query("b3_domain_pick", W + """, r AS (SELECT id, domain, row_number() OVER (PARTITION BY domain ORDER BY sha256('figures:' || id), id) AS rank FROM m) SELECT * FROM r WHERE rank <= 10""")
def _(t):
    return op.hash_pick(manifest(t), "domain", 10, "figures").select("id", "domain", "rank")


@query("b4_seeded_pick", W + " SELECT id FROM m ORDER BY sha256('42:' || id), id LIMIT 12")
def _(t):
    return op.seeded_pick(manifest(t), 12, 42).select("id")


@query("b5_group_split", W + """, g AS (SELECT stratum, row_number() OVER (ORDER BY sha256('5:' || stratum)) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT stratum FROM m))
SELECT stratum, CASE WHEN k <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN k <= floor(n * 0.85 + 1e-9) THEN 'dev' ELSE 'test' END AS split, count(*) AS n FROM g JOIN m USING (stratum) GROUP BY ALL""".replace("count(*) AS n FROM g", "count(*) AS rows FROM g"))
def _(t):
    return op.group_split(manifest(t), "stratum", [("train", 0.7), ("dev", 0.15), ("test", 0.15)], 5).groupBy("stratum", "split").agg(F.count(F.lit(1)).alias("rows"))


@query("b6_balanced_draw", W + """, d AS (SELECT dataset, id, row_number() OVER (PARTITION BY dataset ORDER BY id) - 1 AS k FROM m),
s AS (SELECT dataset, count(*) AS size FROM m GROUP BY 1), r AS (SELECT dataset, size, unnest(range(0, 50)) AS draw FROM s),
q AS (SELECT dataset, draw, ('0x' || substr(sha256('draw:3:1:' || dataset || ':' || draw), 1, 8))::BIGINT % size AS k, ('0x' || substr(sha256('place:3:1:' || dataset || ':' || draw), 1, 8))::BIGINT AS place FROM r)
SELECT dataset, id, draw, place FROM q JOIN d USING (dataset, k)""")
def _(t):
    m = manifest(t)
    return op.balanced_draw(m, "dataset", 50 * m.select("dataset").distinct().count(), 3, 1)


@query("b7_build_pairs", W + """ SELECT id, 'root/Val/' || upper(domain[1]) || domain[2:] || '/images_png/' || id || '.png' AS image_rel, 'root/Val/' || upper(domain[1]) || domain[2:] || '/masks_png/' || id || '.png' AS mask_rel FROM m""")
def _(t):
    return op.build_pairs(manifest(t).withColumn("split", F.lit("val")), "val", "val", "root").select("id", "image_rel", "mask_rel")


@query("b9_overlap", "SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t):
    return op.overlap(t.documents, t.labels.where("toxic = 1"), "doc_id")


@query("b10_population", """WITH e AS (SELECT source, count(*) AS expected FROM documents WHERE doc_id % 97 <> 0 GROUP BY 1)
SELECT source, count(*) AS have, count(*) FILTER (regexp_matches(text, '(?i)licensed under')) AS forbidden, coalesce(any_value(expected), 0) AS expected,
 count(*) = coalesce(any_value(expected), 0) AND count(*) FILTER (regexp_matches(text, '(?i)licensed under')) = 0 AS ok FROM documents LEFT JOIN e USING (source) GROUP BY source""")
def _(t):
    expected = t.documents.where("doc_id % 97 <> 0").groupBy("source").agg(F.count(F.lit(1)).alias("expected"))
    return op.population_report(t.documents, "source", expected, "licensed under", ["text"])


@query("b11_spatial_leakage", """WITH r AS (SELECT o_custkey % 40 AS frame, o_orderkey AS id, o_orderstatus AS split, o_custkey * 137.0 % 40000 AS x0, o_orderkey * 71.0 % 40000 AS y0 FROM orders),
b AS (SELECT *, x0 + 300 AS x1, y0 + 300 AS y1 FROM r),
d AS (SELECT a.frame, a.id AS id_a, b.id AS id_b, sqrt(greatest(a.x0-b.x1, b.x0-a.x1, 0)**2 + greatest(a.y0-b.y1, b.y0-a.y1, 0)**2) AS distance FROM b a JOIN b ON a.frame = b.frame AND a.id < b.id AND a.split <> b.split)
SELECT frame, id_a, id_b, round(distance, 6) AS distance FROM d WHERE distance < 512""")
def _(t):
    r = t.orders.select((F.col("o_custkey") % 40).alias("frame"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("split"), (F.col("o_custkey") * 137.0 % 40000).alias("x0"), (F.col("o_orderkey") * 71.0 % 40000).alias("y0"))
    return op.spatial_leakage(r.withColumn("x1", F.col("x0") + 300).withColumn("y1", F.col("y0") + 300)).withColumn("distance", F.round("distance", 6))


@query("b12_hash_audit", W + """ SELECT id, CASE WHEN doc_id % 11 = 0 THEN 'missing' ELSE 'changed' END AS error FROM m WHERE doc_id % 11 = 0 OR doc_id % 13 = 0""")
def _(t):
    m = manifest(t).withColumn("sha256", F.when(F.col("doc_id") % 13 == 0, F.lit("0")).otherwise(F.col("sha"))).withColumn("path", F.col("id"))
    files = t.documents.where("doc_id % 11 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return op.audit_hashes(m, files).select("id", "error")


@query("b8_pair_audit", """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing image' WHEN doc_id % 5 = 0 THEN 'missing mask' WHEN doc_id % 3 = 0 THEN 'sizes differ' WHEN doc_id % 11 = 0 THEN 'image mode' END AS error FROM documents) SELECT * FROM p""")
def _(t):
    d = t.documents
    pairs = d.select("doc_id", F.concat(F.lit("i"), "doc_id").alias("image_rel"), F.concat(F.lit("m"), "doc_id").alias("mask_rel"))
    image = d.where("doc_id % 7 <> 0").select(F.concat(F.lit("i"), "doc_id").alias("path"), F.lit(1024).alias("width"), F.lit(1024).alias("height"), F.when(F.col("doc_id") % 11 == 0, "RGBA").otherwise("RGB").alias("mode"))
    mask = d.where("doc_id % 5 <> 0").select(F.concat(F.lit("m"), "doc_id").alias("path"), F.when(F.col("doc_id") % 3 == 0, 512).otherwise(1024).alias("width"), F.lit(1024).alias("height"), F.lit("L").alias("mode"))
    return op.audit_pairs(pairs, image.unionByName(mask)).select("doc_id", "error")


@query("b13_stale_rows", "SELECT doc_id, n_chars FROM documents WHERE NOT (doc_id % 4 = 0 AND n_chars % 2 = 0)")
def _(t):
    cache = t.documents.where("doc_id % 4 = 0").select("doc_id", F.when(F.col("n_chars") % 2 == 0, F.col("n_chars")).otherwise(-1).alias("n_chars"))
    return op.stale_rows(t.documents.select("doc_id", "n_chars"), cache, ["doc_id", "n_chars"])


@query("b13_reuse_counts", "SELECT CASE WHEN doc_id % 4 = 0 THEN 'reused' ELSE 'generated' END AS state, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return op.reuse_counts(t.documents, t.documents.where("doc_id % 4 = 0"), ["doc_id", "n_chars"])


@query("b14_fingerprint", """SELECT doc_id, sha256('{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS fingerprint FROM documents""")
def _(t):
    return t.documents.select("doc_id", op.fingerprint(["source", "n_chars", "lang"]).alias("fingerprint"))


@query("b15_route_pair_errors", """WITH p AS (SELECT o_orderkey % 14900 AS id, o_orderstatus AS split, o_totalprice % 5000 AS sx, o_custkey * 3.0 AS gy, o_orderkey % 9 = 0 AS none FROM orders),
e AS (SELECT *, list_filter([CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'id repeated' END, CASE WHEN split NOT IN ('F', 'O') THEN 'split' END, CASE WHEN none THEN 'expected_reachable missing' END,
 CASE WHEN sx >= 4096 THEN 'start out of bounds' END, CASE WHEN gy >= 2821 THEN 'goal out of bounds' END], lambda x: x IS NOT NULL) AS errors FROM p)
SELECT id, array_to_string(errors, ', ') AS errors, len(errors) = 0 AS valid FROM e""")
def _(t):
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    p = t.orders.select(
        (F.col("o_orderkey") % 14900).alias("id"), F.col("o_orderstatus").alias("split"), F.when(F.col("o_orderkey") % 9 != 0, True).alias("expected_reachable"),
        point(F.col("o_totalprice") % 5000, F.lit(1)).alias("start"), point(F.lit(1), F.col("o_custkey") * 3.0).alias("goal"), F.lit(4096).alias("width"), F.lit(2821).alias("height"),
    )
    return op.route_pair_errors(p, splits=("F", "O")).select("id", F.array_join("errors", ", ").alias("errors"), "valid")


@query("b16_controlled_comparison", """WITH a AS (SELECT o_custkey AS run, min(o_orderstatus) AS s, count(*) AS n, min(o_orderpriority) AS p FROM orders GROUP BY 1), b AS (SELECT o_custkey AS run, max(o_orderstatus) AS s, count(*) AS n, max(o_orderpriority) AS p FROM orders GROUP BY 1)
SELECT run, key FROM (SELECT run, unnest(list_filter([CASE WHEN a.s IS DISTINCT FROM b.s THEN 's' END, CASE WHEN a.n IS DISTINCT FROM b.n THEN 'n' END, CASE WHEN a.p IS DISTINCT FROM b.p THEN 'p' END], lambda x: x IS NOT NULL)) AS key FROM a JOIN b USING (run))""")
def _(t):
    g = t.orders.groupBy(F.col("o_custkey").alias("run"))
    row = lambda f: g.agg(f("o_orderstatus").alias("s"), F.count(F.lit(1)).alias("n"), f("o_orderpriority").alias("p"))
    return op.differing_keys(row(F.min), row(F.max), "run", ["s", "n", "p"])


@query("b17_table_diff", """WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity AS v FROM lineitem WHERE l_orderkey % 10 <> 3), b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN l_quantity + l_tax ELSE l_quantity END AS v FROM lineitem WHERE l_orderkey % 10 <> 4)
SELECT CASE WHEN b.v IS NULL THEN 'only a' WHEN a.v IS NULL THEN 'only b' WHEN abs(a.v - b.v) <= 1e-6 THEN 'equal' ELSE 'changed' END AS category, count(*) AS n, round(max(abs(a.v - b.v)), 6) AS worst
FROM a FULL JOIN b USING (l_orderkey, l_linenumber) GROUP BY 1""")
def _(t):
    a = t.lineitem.where("l_orderkey % 10 <> 3").withColumn("v", F.col("l_quantity"))
    b = t.lineitem.where("l_orderkey % 10 <> 4").withColumn("v", F.when(F.col("l_partkey") % 5 == 0, F.col("l_quantity") + F.col("l_tax")).otherwise(F.col("l_quantity")))
    return op.table_diff(a, b, ["l_orderkey", "l_linenumber"], "v", 1e-6).withColumn("worst", F.round("worst", 6))


@query("b18_verify_frames", "SELECT doc_id AS scene_id, CASE WHEN doc_id % 6 = 0 THEN 'unknown' WHEN doc_id % 5 = 0 THEN 'mismatch' ELSE 'verified' END AS frame FROM documents")
def _(t):
    images = t.documents.select(F.col("doc_id").alias("scene_id"), F.lit(4096).alias("width"), F.lit(2821).alias("height"))
    graphs = images.withColumn("width", F.when(F.col("scene_id") % 6 != 0, F.col("width"))).withColumn("height", F.when(F.col("scene_id") % 5 == 0, 1).otherwise(F.col("height")))
    return op.verify_frames(graphs, images).select("scene_id", "frame")


@query("b19_missing_files", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def _(t):
    return op.missing_files(t.documents.select("doc_id").withColumn("path", F.col("doc_id").cast("string")), t.labels.select(F.col("doc_id").cast("string").alias("path"))).select("doc_id")


@query("b20_provenance", W + """ SELECT dataset AS run, count(*) AS n_inputs, sha256(string_agg(sha, ':' ORDER BY id)) AS inputs_sha256, sha256('{"dataset":"' || dataset || '","seed":7}') AS config_sha256 FROM m GROUP BY dataset""")
def _(t):
    rows = manifest(t).select(F.col("dataset").alias("run"), F.col("id").alias("name"), F.col("sha").alias("sha256"), "dataset", F.lit(7).alias("seed"))
    return op.provenance(rows, ["dataset", "seed"])
