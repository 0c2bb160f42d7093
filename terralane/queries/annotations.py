"""Annotation queries: conversations are sources, their turns endpoints; documents give proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import annotations as op

AN = """an AS (SELECT conv_id AS source_id, turn AS endpoint, CASE conv_id % 5 WHEN 0 THEN 'FALSE' WHEN 1 THEN 'UNCERTAIN' WHEN 2 THEN 'odd' ELSE 'REAL' END AS validity, CASE length(text) % 6 WHEN 0 THEN 'NO_CONNECT' WHEN 1 THEN 'UNCERTAIN' WHEN 2 THEN 'NO_CORRECT_CANDIDATE' WHEN 3 THEN 'x_candidate_' || turn WHEN 4 THEN 'candidate' END AS selection, length(text) AS n FROM conversations),
ac AS (SELECT *, CAST(nullif(regexp_extract(selection, 'candidate_(\\d+)$', 1), '') AS INT) AS rank FROM an),
aa AS (SELECT *, CASE WHEN validity = 'FALSE' THEN 'REMOVE' WHEN validity = 'UNCERTAIN' THEN 'REVIEW' WHEN validity = 'REAL' THEN CASE WHEN selection = 'NO_CONNECT' THEN 'NO_CONNECT' WHEN selection = 'UNCERTAIN' THEN 'REVIEW' WHEN selection = 'NO_CORRECT_CANDIDATE' THEN 'MANUAL_CONNECT' WHEN rank IS NOT NULL THEN 'CONNECT' END END AS action FROM ac)"""
PR = "pp AS (SELECT doc_id AS proposal_id, doc_id % 60 AS source_id, doc_id % 4 AS endpoint, n_chars % 997 AS score FROM documents)"


def annotations(t):
    pick = lambda c, values: F.element_at(F.array(*(F.lit(v) for v in values)), (c + 1).cast("int"))
    n = F.length("text")
    s = F.when(n % 6 == 3, F.concat(F.lit("x_candidate_"), F.col("turn").cast("string"))).otherwise(pick(n % 6, ["NO_CONNECT", "UNCERTAIN", "NO_CORRECT_CANDIDATE", None, "candidate", None]))
    return t.conversations.select(F.col("conv_id").alias("source_id"), F.col("turn").alias("endpoint"), pick(F.col("conv_id") % 5, ["FALSE", "UNCERTAIN", "odd", "REAL", "REAL"]).alias("validity"), s.alias("selection"), n.alias("n"))


def proposals(t):
    return t.documents.select(F.col("doc_id").alias("proposal_id"), (F.col("doc_id") % 60).alias("source_id"), (F.col("doc_id") % 4).alias("endpoint"), (F.col("n_chars") % 997).alias("score"))


@query("k1_candidate_rank", f"WITH {AN} SELECT source_id, endpoint, rank FROM ac")
def _(t):
    return annotations(t).select("source_id", "endpoint", op.candidate_rank(F.col("selection")).alias("rank"))


@query("k2_derive_action", f"WITH {AN} SELECT source_id, endpoint, action, CASE WHEN validity = 'odd' THEN 'validity' WHEN action IS NULL THEN 'selection' END AS error FROM aa")
def _(t):
    return op.with_actions(annotations(t)).select("source_id", "endpoint", "action", "error")


@query("k3_case_completed", f"WITH {AN} SELECT source_id, endpoint, n % 3 <> 0 AND (validity IN ('FALSE', 'UNCERTAIN') OR selection IS NOT NULL) AS completed FROM an")
def _(t):
    a = annotations(t)
    return op.case_completed(a.select("source_id", "endpoint"), a.where("n % 3 <> 0")).select("source_id", "endpoint", "completed")


@query("k4_apply_updates", f"""WITH {AN}, u AS (SELECT source_id, endpoint, CASE n % 4 WHEN 0 THEN 'REAL' WHEN 1 THEN 'FALSE' WHEN 2 THEN 'bad' END AS validity, CASE n % 3 WHEN 0 THEN 'candidate_2' WHEN 1 THEN 'nothing' END AS selection, n AS updated_at FROM an), v AS (SELECT * FROM u WHERE (validity IS NULL OR validity <> 'bad') AND (selection IS NULL OR selection <> 'nothing')),
lv AS (SELECT source_id, arg_max(validity, (updated_at, validity)) AS nv FROM v WHERE validity IS NOT NULL GROUP BY 1), ls AS (SELECT source_id, endpoint, arg_max(selection, (updated_at, selection)) AS ns FROM v WHERE selection IS NOT NULL GROUP BY 1, 2),
r AS (SELECT source_id, endpoint, coalesce(nv, validity) AS validity, coalesce(ns, selection) AS selection FROM an LEFT JOIN lv USING (source_id) LEFT JOIN ls USING (source_id, endpoint))
SELECT source_id, endpoint, validity, selection, CASE WHEN validity = 'FALSE' THEN 'REMOVE' WHEN validity = 'UNCERTAIN' THEN 'REVIEW' WHEN validity = 'REAL' THEN CASE WHEN selection = 'NO_CONNECT' THEN 'NO_CONNECT' WHEN selection = 'UNCERTAIN' THEN 'REVIEW' WHEN selection = 'NO_CORRECT_CANDIDATE' THEN 'MANUAL_CONNECT' WHEN regexp_matches(selection, 'candidate_\\d+$') THEN 'CONNECT' END END AS action FROM r""")
def _(t):
    a = annotations(t)
    u = a.select("source_id", "endpoint", F.when(F.col("n") % 4 == 0, "REAL").when(F.col("n") % 4 == 1, "FALSE").when(F.col("n") % 4 == 2, "bad").alias("validity"), F.when(F.col("n") % 3 == 0, "candidate_2").when(F.col("n") % 3 == 1, "nothing").alias("selection"), F.col("n").alias("updated_at"))
    return op.apply_updates(a.select("source_id", "endpoint", "validity", "selection"), u).drop("error")


@query("k5_summary", f"WITH {AN} SELECT what, value, count(*) AS n FROM (SELECT 'validity' AS what, validity AS value FROM aa UNION ALL SELECT 'selection', selection FROM aa UNION ALL SELECT 'rank', CAST(rank AS VARCHAR) FROM aa UNION ALL SELECT 'action', action FROM aa) WHERE value IS NOT NULL GROUP BY 1, 2")
def _(t):
    return op.summarize(op.with_actions(annotations(t)).withColumn("rank", op.candidate_rank(F.col("selection"))))


@query("k6_build_cases", f"""WITH {PR}, s AS (SELECT DISTINCT conv_id AS source_id FROM conversations), c AS (SELECT source_id, e AS endpoint FROM s LEFT JOIN (SELECT unnest([0, 1, 2]) AS e) ON source_id % 4 <> 0)
SELECT c.source_id, c.endpoint, coalesce(string_agg(CAST(proposal_id AS VARCHAR), ',' ORDER BY -score, proposal_id), '') AS proposals FROM c LEFT JOIN pp USING (source_id, endpoint) GROUP BY 1, 2""")
def _(t):
    s = t.conversations.select(F.col("conv_id").alias("source_id")).distinct().withColumn("endpoints", F.when(F.col("source_id") % 4 != 0, F.array(*(F.lit(i).cast("long") for i in range(3)))))
    return op.build_cases(s, proposals(t)).select("source_id", "endpoint", F.array_join(F.col("proposals").cast("array<string>"), ",").alias("proposals"))


@query("k7_training_records", f"""WITH {AN}, {PR}, k AS (SELECT *, row_number() OVER (PARTITION BY source_id, endpoint ORDER BY score DESC, proposal_id) AS r FROM pp)
SELECT proposal_id, k.source_id, k.endpoint, CASE WHEN validity = 'REAL' THEN CASE WHEN rank = r THEN 1 ELSE 0 END END AS connect, action FROM k JOIN aa ON aa.source_id = k.source_id AND aa.endpoint = k.endpoint""")
def _(t):
    return op.make_records(proposals(t), annotations(t).drop("n")).select("proposal_id", "source_id", "endpoint", "connect", "action")
