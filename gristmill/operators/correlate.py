"""Correlations between tables that share no key: ranked tiers, contained names, shared secrets, contradictions, division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import normal_name


def ranked_tier_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: list[tuple[Column, Column]]) -> DataFrame:
    """J-20: pairs that agree in some tier, each at its first: (left_id, right_id, tier). ``tiers`` are pairs of key columns, best first; every tier is an equi-join."""
    out = None
    for i, (a, b) in enumerate(tiers, 1):
        one = left.select(left_id, a.alias("_k")).where("_k is not null").join(right.select(right_id, b.alias("_k")).where("_k is not null"), "_k").select(left_id, right_id, F.lit(i).alias("tier"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(left_id, right_id).agg(F.min("tier").alias("tier"))


def tier_counts(left: DataFrame, right: DataFrame, levels: list[tuple[str, list[Column], list[Column]]]) -> DataFrame:
    """J-20 where only numbers are asked: pairs by first tier, (tier, n_pairs), from group sizes alone, so no pair is made.

    ``levels`` are (name, left keys, right keys), best first; the pairs of a tier that also agree in better ones are taken off by inclusion and exclusion.
    """
    from itertools import combinations

    def pairs(some: tuple[int, ...]) -> DataFrame:
        a = [k for i in some for k in levels[i][1]]
        b = [k for i in some for k in levels[i][2]]
        names = [f"k{j}" for j in range(len(a))]
        la = left.select(*(x.alias(n) for x, n in zip(a, names, strict=True))).na.drop().groupBy(*names).agg(F.count("*").alias("_a"))
        rb = right.select(*(x.alias(n) for x, n in zip(b, names, strict=True))).na.drop().groupBy(*names).agg(F.count("*").alias("_b"))
        return la.join(rb, names).agg(F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).cast("bigint").alias("n"))

    out = None
    for i, (name, _, _) in enumerate(levels):
        for size in range(i + 1):
            for better in combinations(range(i), size):
                part = pairs((*better, i)).select(F.lit(name).alias("tier"), (F.col("n") * (-1) ** size).alias("n"))
                out = part if out is None else out.unionByName(part)
    return out.groupBy("tier").agg(F.sum("n").cast("bigint").alias("n_pairs"))


def contained_name(rows: DataFrame, row_name: str, names: DataFrame, name: str, order: str, least: int = 3) -> DataFrame:
    """J-15: ``rows`` with the first of ``names`` that correlates: an equal name before one that holds the other or is held by it, in normal form, from ``least`` letters on.

    A form that is held by another begins with ``least`` letters that stand in it somewhere, so forms meet by the letters that one begins with, in equi-joins of distinct forms, and what meets is then compared; any number of names will do.
    """
    n = names.select(F.col(name).alias("match"), normal_name(F.col(name)).alias("_n"), F.col(order).alias("_o")).where(F.length("_n") >= least)
    n = n.groupBy("_n").agg(F.min(F.struct(F.col("_o"), F.col("match"))).alias("_b")).select("_n", "_b._o", "_b.match")
    forms = rows.select(normal_name(F.col(row_name)).alias("_f")).where(F.length("_f") >= least).distinct()
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - least + 1), lambda i: F.substring(F.col(c), i, F.lit(least))))).alias("_g")
    begins = lambda c: F.substring(F.col(c), F.lit(1), F.lit(least)).alias("_g")
    holds = forms.select("_f", grams("_f")).join(n.select("*", begins("_n")), "_g").where(F.contains("_f", "_n"))
    held = forms.select("_f", begins("_f")).join(n.select("*", grams("_n")), "_g").where(F.contains("_n", "_f"))
    both = holds.unionByName(held).select("_f", F.struct((F.col("_n") != F.col("_f")).alias("far"), "_o", "match").alias("_b"))
    best = both.groupBy("_f").agg(F.min("_b").alias("_b")).select("_f", "_b.match")
    return rows.withColumn("_f", normal_name(F.col(row_name))).join(best, "_f", "left").drop("_f")


def shared_secret_edges(mounts: DataFrame) -> DataFrame:
    """J-16: (secret, issuer, verifier) of ``mounts`` (secret, member, is_issuer): groups of two or more members of which exactly one issues; each other member points to it.

    The one issuer is joined to the members, so a group of n makes n - 1 edges and not n x n.
    """
    g = mounts.groupBy("secret", "member").agg(F.bool_or("is_issuer").alias("is_issuer"))
    one = g.groupBy("secret").agg(F.count("*").alias("n"), F.count_if("is_issuer").alias("ni"), F.min(F.when(F.col("is_issuer"), F.col("member"))).alias("issuer")).where("n >= 2 and ni = 1")
    return g.where("not is_issuer").join(one.select("secret", "issuer"), "secret").select("secret", "issuer", F.col("member").alias("verifier"))


def contradictions(claims: DataFrame, observations: DataFrame) -> DataFrame:
    """J-19: (key, claim, outcome) of ``claims`` (key, claim) against ``observations`` (key, value): agree if some value is the claim, contradiction if none is and there is
    just one distinct other, ambiguous if more, no-signal if none at all."""
    j = claims.join(observations, "key", "left").groupBy("key", "claim").agg(F.coalesce(F.bool_or(F.col("value") == F.col("claim")), F.lit(False)).alias("agrees"), F.count_distinct("value").alias("n"))
    return j.select("key", "claim", F.when(F.col("agrees"), "agree").when(F.col("n") == 1, "contradiction").when(F.col("n") > 1, "ambiguous").otherwise("no-signal").alias("outcome"))


def divide(rows: DataFrame, key: str, value: str, needed: DataFrame) -> DataFrame:
    """J-24: the keys that have every value of ``needed`` (value): counted after a semi-join, so nothing is paired."""
    n = needed.select(value).distinct().agg(F.count("*").alias("_need"))
    have = rows.join(needed.select(value).distinct(), value, "left_semi").groupBy(key).agg(F.count_distinct(value).alias("_have"))
    return have.join(n, have["_have"] == n["_need"]).select(key)
