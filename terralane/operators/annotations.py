"""Annotation tables: parsing, derived actions, updates, summaries and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

# Fixed values of the annotation schema.
VALIDITIES = ["REAL", "FALSE", "UNCERTAIN"]
FIXED_SELECTIONS = {"NO_CONNECT": "NO_CONNECT", "UNCERTAIN": "REVIEW", "NO_CORRECT_CANDIDATE": "MANUAL_CONNECT"}


def candidate_rank(selection: Column) -> Column:
    """The number behind a trailing candidate_, else null."""
    n = F.regexp_extract(selection, r"candidate_(\d+)$", 1)
    return F.when(n != "", n.cast("int"))


def derive_action(validity: Column, selection: Column) -> Column:
    """False segments are removed and uncertain ones reviewed; otherwise the selection decides. Null where a value is unknown."""
    action = F.when(validity == "FALSE", "REMOVE").when(validity == "UNCERTAIN", "REVIEW")
    for s, a in FIXED_SELECTIONS.items():
        action = action.when((validity == "REAL") & (selection == s), a)
    return action.when((validity == "REAL") & candidate_rank(selection).isNotNull(), "CONNECT")


def with_actions(labels: DataFrame) -> DataFrame:
    """Add action and error (an unknown validity or selection)."""
    out = labels.withColumn("action", derive_action(F.col("validity"), F.col("selection")))
    error = F.when(~F.coalesce(F.col("validity").isin(VALIDITIES), F.lit(False)), "validity").when(F.col("action").isNull(), "selection")
    return out.withColumn("error", error)


def case_completed(cases: DataFrame, annotations: DataFrame) -> DataFrame:
    """Add completed: false and uncertain sources are done with their validity, real ones when each endpoint has a selection."""
    a = annotations.select("source_id", "endpoint", "validity", "selection")
    out = cases.join(a, ["source_id", "endpoint"], "left")
    return out.withColumn("completed", F.coalesce(F.when(F.col("validity").isin("FALSE", "UNCERTAIN"), True).otherwise(F.col("validity").isNotNull() & F.col("selection").isNotNull()), F.lit(False)))


def apply_updates(labels: DataFrame, updates: DataFrame) -> DataFrame:
    """Labels (source_id, endpoint, validity, selection) after updates (source_id, endpoint, validity, selection, updated_at).

    The latest validity of a source holds for all its endpoints, and the latest selection of an endpoint for it; updates
    with values that aren't allowed are left out. Actions are derived anew.
    """
    ok = F.col("validity").isNull() | F.col("validity").isin(VALIDITIES)
    sel = F.col("selection").isNull() | F.col("selection").isin(*FIXED_SELECTIONS) | candidate_rank(F.col("selection")).isNotNull()
    u = updates.where(ok & sel)
    latest = lambda keys, c: u.where(F.col(c).isNotNull()).groupBy(*keys).agg(F.max_by(c, F.struct("updated_at", c)).alias(f"new_{c}"))
    out = labels.join(latest(["source_id"], "validity"), "source_id", "left").join(latest(["source_id", "endpoint"], "selection"), ["source_id", "endpoint"], "left")
    out = out.select("source_id", "endpoint", F.coalesce("new_validity", "validity").alias("validity"), F.coalesce("new_selection", "selection").alias("selection"))
    return with_actions(out)


def summarize(annotations: DataFrame) -> DataFrame:
    """(what, value, n): counts by validity, selection, rank and action from one pass."""
    rows = annotations.select(F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")) for c in ("validity", "selection", "rank", "action")))).alias("r"))
    return rows.select("r.*").where("value is not null").groupBy("what", "value").agg(F.count(F.lit(1)).alias("n"))


def build_cases(sources: DataFrame, proposals: DataFrame) -> DataFrame:
    """One row per source and endpoint, or per source without any, with its proposals by rank.

    sources: (source_id, endpoints array); proposals: (source_id, endpoint, proposal_id, score).
    """
    s = sources.select("source_id", F.explode_outer("endpoints").alias("endpoint"))
    p = proposals.groupBy("source_id", "endpoint").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "proposal_id"))).alias("p"))
    return s.join(p, ["source_id", "endpoint"], "left").select("source_id", "endpoint", F.coalesce(F.transform("p", lambda x: x["proposal_id"]), F.array().cast("array<bigint>")).alias("proposals"))


def make_records(proposals: DataFrame, labels: DataFrame) -> DataFrame:
    """Training records: a proposal is connected where its endpoint's selection names its rank (by score, best first)."""
    w = Window.partitionBy("source_id", "endpoint").orderBy(F.desc("score"), "proposal_id")
    p = proposals.withColumn("rank", F.row_number().over(w))
    out = p.join(labels, ["source_id", "endpoint"])
    connect = F.when(F.col("validity") == "REAL", F.coalesce((candidate_rank(F.col("selection")) == F.col("rank")).cast("int"), F.lit(0)))
    return out.withColumn("connect", connect).withColumn("action", derive_action(F.col("validity"), F.col("selection")))
