"""References to records that do not exist: direct orphans by an interval test, inherited ones by a fixpoint cascade."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.scan import segmented_sum
from gristmill.session import checkpointed, norm_id


@dataclass(frozen=True)
class Reference:
    """One foreign key. ``rows`` refer by ``field``; ``key`` identifies the referring row, ``at`` is its arrival.

    ``where`` says which rows are checked; ``own_id`` is the id under which others may refer to these rows, if any.
    """

    table: str
    field: str
    rows: DataFrame
    key: str
    target: str
    at: str = "loaded_at"
    where: Column | None = None
    own_id: str | None = None


#: Rounds of single steps down the key graph before the rest is covered in steps that double.
SINGLE_STEPS = 16


def _with_live(refs: DataFrame, lifetimes: DataFrame) -> DataFrame:
    """``refs`` (space, id, t, ...) with ``live``: whether some row of ``lifetimes`` (space, id, born, died) is live at t.

    A row is live from ``born`` on and until before ``died``, for ever where that is null; one without ``born`` never
    lives. Births count +1 and deaths -1 in one order with the references, so neither repeated rows nor a hot id make pairs, nothing is joined, and the
    running sum at a reference is the number of live rows. A reference without t has no live row.
    """
    lives = lifetimes.where(F.col("id").isNotNull() & F.col("born").isNotNull() & (F.col("died").isNull() | (F.col("died") > F.col("born"))))
    ends = F.explode(F.array(F.struct(F.col("born").alias("t"), F.lit(1).alias("d")), F.struct(F.col("died").alias("t"), F.lit(-1).alias("d"))))
    events = lives.select("space", "id", ends.alias("e")).select("space", "id", "e.t", "e.d", F.lit(0).alias("asks")).where(F.col("t").isNotNull())
    asked = refs.where(F.col("t").isNotNull()).withColumn("d", F.lit(0)).withColumn("asks", F.lit(1))
    scanned = segmented_sum(asked.unionByName(events, allowMissingColumns=True), ["space", "id"], ["t", "asks"], "d", "n_live")
    told = scanned.where("asks = 1").select(*refs.columns, (F.col("n_live") > 0).alias("live"))
    return told.unionByName(refs.where(F.col("t").isNull()).withColumn("live", F.lit(False)))


def _judged(references: list[Reference], lifetimes: DataFrame) -> DataFrame:
    """Every reference with whether it is live: (ref, ref_key, space, id, t, own, live), ref the place in ``references``. Repeated rows stay."""
    all_refs = None
    for i, r in enumerate(references):
        part = (r.rows.where(r.where) if r.where is not None else r.rows).select(
            F.lit(i).alias("ref"), F.col(r.key).cast("string").alias("ref_key"), F.lit(r.target).alias("space"),
            norm_id(F.col(r.field)).alias("id"), F.col(r.at).alias("t"), (norm_id(F.col(r.own_id)) if r.own_id else F.lit(None).cast("string")).alias("own"),
        ).where(F.col("id").isNotNull())
        all_refs = part if all_refs is None else all_refs.unionByName(part)
    return _with_live(all_refs, lifetimes)


def _report(references: list[Reference], orphans: DataFrame) -> DataFrame:
    """``orphans`` (ref, ref_key, t, depth) as result rows, each once, at its least depth."""
    pick = lambda name: F.element_at(F.array(*(F.lit(getattr(r, name)) for r in references)), F.col("ref") + 1)
    least = orphans.groupBy("ref", F.date_format("t", "yyyy-MM").alias("period"), "ref_key").agg(F.min("depth").alias("depth"))
    return least.select(pick("table").alias("ref_table"), pick("field").alias("ref_field"), "period", "ref_key", F.when(F.col("depth") == 0, "direct").otherwise("inherited").alias("orphan_kind"), "depth")


def direct_orphans(references: list[Reference], lifetimes: DataFrame) -> DataFrame:
    """The orphans of depth 0 of ``orphan_cascade``, which is where the cascade begins; as they depend on no other, its rounds are left out."""
    return _report(references, _judged(references, lifetimes).where(~F.col("live")).withColumn("depth", F.lit(0)))


def orphan_cascade(references: list[Reference], lifetimes: DataFrame) -> DataFrame:
    """Orphaned references: (ref_table, ref_field, period, ref_key, orphan_kind, depth), distinct.

    A reference is a direct orphan (depth 0) if no row of its target space with that id was live when it arrived.
    Rows with an ``own_id`` that are orphaned taint that id; a resolved reference to a tainted id is an inherited orphan,
    one deeper, and may taint its own id in turn. Each round semi-joins the references with the ids tainted in the
    round before, until none is new, so cycles end; what is more than ``SINGLE_STEPS`` deep is reached in steps that double, so a chain of n takes log n more rounds.
    Ids compare without outer spaces and case; null or blank ids refer to nothing and are no cases. A row without arrival time has no live record and comes out with a null period. Repeated
    rows give one result row. Empty tables give an empty result; other columns of the inputs are ignored.
    """
    judged = checkpointed(_judged(references, lifetimes))
    direct = judged.where(~F.col("live")).withColumn("depth", F.lit(0))
    resolved = judged.where("live")
    own_space = {r.target for r in references if r.own_id}
    if not own_space:
        return _report(references, direct)
    inside = resolved.where(F.col("space").isin(*own_space))
    edges = inside.where(F.col("own").isNotNull() & (F.col("own") != F.col("id"))).select("own", "id").distinct()
    frontier = checkpointed(direct.where(F.col("own").isNotNull()).select(F.col("own").alias("id")).distinct().withColumn("depth", F.lit(0)))
    tainted = frontier
    for depth in count(1):
        if frontier.isEmpty():
            break
        if depth > SINGLE_STEPS:
            tainted = tainted.unionByName(_far(edges.join(tainted.select(F.col("id").alias("own")), "own", "left_anti"), frontier))
            break
        new = edges.join(frontier.select("id"), "id", "left_semi").select(F.col("own").alias("id")).distinct().join(tainted.select("id"), "id", "left_anti")
        frontier = checkpointed(new.withColumn("depth", F.lit(depth)))
        tainted = tainted.unionByName(frontier)
    inherited = inside.join(tainted.withColumnRenamed("depth", "parent_depth"), "id").withColumn("depth", F.col("parent_depth") + 1).drop("parent_depth")
    return _report(references, direct.unionByName(inherited))


def _far(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """(id, depth) of the ids that ``frontier`` (id, depth) taints, at any distance, over ``edges`` (own, id).

    ``jumps`` lead 2^k edges up, and ``known`` has the least depth of what is at most 2^k - 1 edges away from the frontier; each round doubles both. A walk
    with as many edges as there are ids must repeat one, so the rounds end with cycles too.
    """
    jumps = checkpointed(edges.select(F.col("own").alias("a"), F.col("id").alias("b")))
    known, size = frontier, 1
    ids = jumps.select("a").distinct().count() + 1
    while size <= ids and not jumps.isEmpty():
        reached = jumps.join(known.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), (F.col("depth") + size).alias("depth"))
        known = checkpointed(known.unionByName(reached).groupBy("id").agg(F.min("depth").alias("depth")))
        jumps = checkpointed(jumps.join(jumps.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct())
        size *= 2
    return known.join(frontier.select("id"), "id", "left_anti")


def review_references(overrides: DataFrame, decisions: DataFrame) -> list[Reference]:
    """The three foreign keys of the review tables."""
    adds = F.coalesce(F.lower(F.trim("override_type")).isin("node_add", "relationship_add"), F.lit(False))
    return [
        Reference("overrides", "decision_record_ref", overrides, "override_id", "decision"),
        Reference("decisions", "supersedes", decisions, "decision_id", "decision", own_id="decision_id"),
        Reference("overrides", "target_ref", overrides, "override_id", "element", where=~adds),
    ]


def review_lifetimes(decisions: DataFrame, elements: DataFrame) -> DataFrame:
    """Lifetimes of decision records and architecture elements in one id space each."""
    one = lambda df, space, key: df.select(F.lit(space).alias("space"), norm_id(key).alias("id"), F.col("loaded_at").alias("born"), F.col("deleted_at").alias("died"))
    return one(decisions, "decision", "decision_id").unionByName(one(elements, "element", "element_id"))
