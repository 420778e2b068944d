"""Change feeds as associative patches: ordered operations become functions that compose, so hot keys reduce as a tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.session import norm_id

#: A patch is a function of a node's state. d_*: the state it makes of a missing node; a_*: what it makes of a present
#: one, where null keeps the value it had.
PATCH = "d_alive boolean, d_type string, d_name string, d_container string, a_alive boolean, a_type string, a_name string, a_container string"
FIELDS = [x.split()[0] for x in PATCH.split(", ")]
FAN_IN = 64


def latest_deliveries(feed: DataFrame, id_col: str = "override_id", at: str = "loaded_at") -> DataFrame:
    """One row for each id: the delivery with the latest ``at`` (then the greatest content, so ties are settled alike everywhere)."""
    rest = [F.col(c) for c in feed.columns]
    return feed.withColumn("_id", norm_id(id_col)).where(F.col("_id").isNotNull()).groupBy("_id").agg(F.max(F.struct(F.col(at).alias("_at"), F.struct(*rest).alias("_row"))).alias("_m")).select("_id", "_m._row.*")


def node_operations(overrides: DataFrame) -> DataFrame:
    """The feed as operations (k, at, oid, op, node_type, node_name, container) on nodes; see ``rebuild_nodes``."""
    cols = ["override_id", "target_ref", "override_type", "new_value", "status", "created_at", "loaded_at"]
    last = latest_deliveries(overrides.select(*cols)).where(F.lower(F.trim("status")) == "active")
    value = F.try_parse_json("new_value")
    kind = F.schema_of_variant("v")
    field = lambda path: F.coalesce(F.try_variant_get("v", f"$['{path}']", "string"), F.lit(""))
    op = F.lower(F.trim("override_type"))
    text = F.when(kind == "STRING", F.try_variant_get("v", "$", "string"))
    is_object = kind.startswith("OBJECT")
    ops = last.withColumn("op", op).withColumn("v", value).where(op.isin("node_add", "node_remove", "type_change", "node_rename", "boundary_change"))
    ops = ops.select(
        norm_id("target_ref").alias("k"), parse_instant("created_at").alias("at"), F.col("_id").alias("oid"), "op",
        F.when(op == "node_add", F.when(is_object, field("node-type")).otherwise("")).when(op == "type_change", text).alias("node_type"),
        F.when(op == "node_add", F.when(is_object, field("name")).otherwise("")).when(op == "node_rename", text).alias("node_name"),
        F.when(op == "boundary_change", F.when(is_object, field("container")).otherwise("")).alias("container"),
    )
    usable = ~(((F.col("op") == "type_change") & F.col("node_type").isNull()) | ((F.col("op") == "node_rename") & F.col("node_name").isNull()))
    return ops.where(F.col("k").isNotNull() & usable)


def parse_instant(c: str) -> Column:
    """ISO-8601 text as an instant: date and time apart by T or a blank, any fraction, Z or an offset with or without colon; else null."""
    tidy = F.regexp_replace(F.upper(F.trim(F.col(c))), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.coalesce(F.try_to_timestamp(tidy), F.try_to_timestamp(F.regexp_replace(tidy, r"[ T]", "T")))


def _compose_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One patch for each key of a sorted partition; ``part`` is the partition's number."""
    key, part, patch, out = None, 0, None, []

    def flush(rows: list) -> pa.RecordBatch:
        names = ["k", "part", *FIELDS]
        kinds = [pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names=names)

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("k", "op", "node_type", "node_name", "container", "part")]
        for k, op, t, n, c, p in zip(*cols, strict=True):
            if k != key:
                if patch is not None:
                    out.append((key, part, *patch))
                key, part, patch = k, p, [False, None, None, None, True, None, None, None]
            if op == "node_add":
                if not patch[0]:
                    patch[0:4] = [True, t, n, ""]
                if not patch[4]:
                    patch[4:8] = [True, t, n, ""]
            elif op == "node_remove":
                patch[:] = [False, None, None, None, False, None, None, None]
            else:
                i, value = (1, t) if op == "type_change" else (2, n) if op == "node_rename" else (3, c)
                if patch[0]:
                    patch[i] = value
                if patch[4]:
                    patch[4 + i] = value
            if len(out) >= 20_000:
                yield flush(out)
                out = []
    if patch is not None:
        out.append((key, part, *patch))
    if out:
        yield flush(out)


def compose(f: Column, g: Column) -> Column:
    """The patch that does ``f``, then ``g``. It is associative, which is what allows any bracketing."""
    value = lambda x: F.coalesce(g[f"a_{x}"], f[f"d_{x}"])
    dead = lambda x: F.when(f["d_alive"], F.when(g["a_alive"], value(x))).otherwise(g[f"d_{x}"])
    live = lambda x: F.when(f["a_alive"], F.when(g["a_alive"], F.coalesce(g[f"a_{x}"], f[f"a_{x}"]))).otherwise(g[f"d_{x}"])
    return F.struct(
        F.when(f["d_alive"], g["a_alive"]).otherwise(g["d_alive"]).alias("d_alive"), *(dead(x).alias(f"d_{x}") for x in ("type", "name", "container")),
        F.when(f["a_alive"], g["a_alive"]).otherwise(g["d_alive"]).alias("a_alive"), *(live(x).alias(f"a_{x}") for x in ("type", "name", "container")),
    )


def compose_feed(ops: DataFrame) -> DataFrame:
    """One patch for each key: ranges of (k, at, oid) fold in parallel, even inside one key, then their patches compose, 64 at a time."""
    parts = int(ops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ops.repartitionByRange(parts, "k", F.col("at").asc_nulls_first(), "oid").sortWithinPartitions("k", F.col("at").asc_nulls_first(), "oid")
    patches = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_compose_chunk, f"k string, part int, {PATCH}")
    patches = patches.select("k", "part", F.struct(*FIELDS).alias("p"))
    for _ in range(max(1, math.ceil(math.log(max(parts, 2), FAN_IN)))):
        grouped = patches.groupBy("k", F.floor(F.col("part") / FAN_IN).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("part", "p"))).alias("ps"))
        rest = F.slice("ps", F.lit(2), F.greatest(F.size("ps") - 1, F.lit(0)))
        patches = grouped.select("k", "part", F.aggregate(rest, F.element_at("ps", 1)["p"], lambda a, x: compose(a, x["p"])).alias("p"))
    return patches.select("k", "p")


def rebuild_nodes(overrides: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The nodes alive after all changes: (target_ref, node_type, node_name, container).

    ``overrides`` is the feed; ``base`` has nodes (target_ref, node_type, node_name, container) that exist before it, none
    if not given. Of several deliveries of one override the latest counts, and only if active. Changes act in order of the
    instant in ``created_at``, then of the override id; instants that can't be read come first. A blank or null override id
    or target names nothing and is left out. node_add on a node that is alive, and other changes on one that is not, do
    nothing, nor do type_change and node_rename without a JSON string. Missing values become ''. Repeated rows change
    nothing; an empty feed gives the base; other columns are ignored.
    """
    patches = compose_feed(node_operations(overrides))
    if base is None:
        p = lambda x: F.col("p")[x]
        return patches.where(p("d_alive")).select(F.col("k").alias("target_ref"), p("d_type").alias("node_type"), p("d_name").alias("node_name"), p("d_container").alias("container"))
    old = base.select(norm_id("target_ref").alias("k"), F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in ("node_type", "node_name", "container"))).alias("old")).where(F.col("k").isNotNull()).groupBy("k").agg(F.max("old").alias("old"))
    j = old.join(patches, "k", "full_outer")
    alive = F.when(F.col("p").isNull(), True).when(F.col("old").isNull(), F.col("p")["d_alive"]).otherwise(F.col("p")["a_alive"])
    pick = lambda old_c, x: F.when(F.col("p").isNull(), F.col("old")[old_c]).when(F.col("old").isNull(), F.col("p")[f"d_{x}"]).otherwise(F.coalesce(F.col("p")[f"a_{x}"], F.col("old")[old_c]))
    return j.where(alive).select(F.col("k").alias("target_ref"), pick("node_type", "type").alias("node_type"), pick("node_name", "name").alias("node_name"), pick("container", "container").alias("container"))
