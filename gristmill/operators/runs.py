"""Runs that follow each other: incremental merge, history, coverage, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signature(parts: list[Column]) -> Column:
    """A-14: text that is equal for equal multisets of evidence, as an aggregate: their number and two sums of hashes, so a unit with any amount of evidence is never gathered."""
    h = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 40)))
    return F.concat_ws(":", F.count("*"), h(1), h(2))


def incremental_merge(prior: DataFrame, fresh: DataFrame) -> DataFrame:
    """U-03: (id, outcome, from_status, to_status) over ``prior`` and ``fresh`` (id, status, sig).

    outcome is new, disappeared, unaffected, flagged (reviewed before, and its evidence changed) or changed. What is unaffected keeps its status; what is flagged requires review.
    """
    p = prior.select("id", F.col("status").alias("from_status"), F.col("sig").alias("_ps"), F.lit(True).alias("_p"))
    f = fresh.select("id", F.col("status").alias("_fs"), F.col("sig").alias("_fsig"), F.lit(True).alias("_f"))
    j = p.join(f, "id", "full_outer")
    same = F.col("_ps").eqNullSafe(F.col("_fsig"))
    reviewed = F.col("from_status") == "reviewed"
    outcome = F.when(F.col("_p").isNull(), "new").when(F.col("_f").isNull(), "disappeared").when(same, "unaffected").when(reviewed, "flagged").otherwise("changed")
    to = F.when(F.col("_f").isNull(), "disappeared").when(F.col("_p").isNull(), F.col("_fs")).when(same, F.coalesce("from_status", "_fs")).when(reviewed, "requires-review").otherwise(F.col("_fs"))
    return j.select("id", outcome.alias("outcome"), F.when(F.col("_p").isNull(), "new").otherwise(F.col("from_status")).alias("from_status"), to.alias("to_status"))


def history(merged: DataFrame, at: Column) -> DataFrame:
    """K-03: the history rows of a merge: all that is new, disappeared or flagged, and what changed to another status."""
    moved = F.col("outcome").isin("new", "disappeared", "flagged") | ((F.col("outcome") == "changed") & ~F.col("from_status").eqNullSafe(F.col("to_status")))
    return merged.where(moved).select("id", at.alias("at"), "from_status", "to_status", "outcome")


def append_history(rows: DataFrame, path: str, run: str) -> bool:
    """K-03: add the rows of a run to the history, and write nothing if there is nothing. Each run has its own part, so writing it again changes nothing."""
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").parquet(f"{path}/run={run}")
    return True


def ratio(part: Column, whole: Column, empty: float | None = None) -> Column:
    """A share in three decimals; ``empty`` where there is no whole."""
    return F.when(whole > 0, F.round(part / whole, 3)).otherwise(F.lit(empty).cast("double"))


def precision_recall(pairs: DataFrame) -> DataFrame:
    """A-15: one row (tp, fp, fn, precision, recall, f1) of ``pairs`` (predicted, expected: boolean); a measure without cases is 1."""
    n = lambda c: F.count_if(c).cast("bigint")
    p, e = F.col("predicted"), F.col("expected")
    c = pairs.agg(n(p & e).alias("tp"), n(p & ~e).alias("fp"), n(~p & e).alias("fn"))
    pr, rc = ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    return c.withColumn("precision", pr).withColumn("recall", rc).withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), 1.0))
