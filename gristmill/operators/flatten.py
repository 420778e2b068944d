"""Deeply nested documents as flat tables: Arrow list offsets and parent-index kernels emit the child arrays."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of an architecture document after ``parse_architectures``.
EVIDENCE = "array<string>"
REQUIREMENT = f"struct<`requirement-url`:string,config:struct<mechanism:string,signal:string,evidence:struct<`unique-id`:string,`evidence-paths`:{EVIDENCE}>>>"


def _listed(text: Column) -> Column:
    """JSON text of a value as that of a list: a single value is a list of one, null and absent are empty."""
    t = F.trim(text)
    return F.when(text.isNull() | (t == "null"), "[]").when(t.startswith("["), t).otherwise(F.concat(F.lit("["), t, F.lit("]")))


def _strings(text: Column) -> Column:
    """JSON text of a list of strings, or one bare string, as a list. A string came out of the JSON without its quotes."""
    t = F.trim(text)
    return F.when(text.isNull(), F.array().cast("array<string>")).when(t.startswith("["), F.from_json(t, "array<string>")).otherwise(F.array(text))


def parse_architectures(docs: DataFrame, text: str = "calm", key: str = "arch_id") -> DataFrame:
    """(arch_id, nodes): each document that parses, in canonical nested types, parsed in the JVM.

    Levels that may be a list, a single value, null or absent are read as text first and become lists.
    """
    whole = docs.select(F.col(key).cast("string").alias("arch_id"), F.col(text).alias("doc")).where(F.col("doc").isNotNull() & F.col("arch_id").isNotNull())
    valid = whole.where(F.is_variant_null(F.try_parse_json("doc")).isNotNull())
    top = valid.select("arch_id", F.from_json("doc", "struct<nodes:string>").alias("t"))
    raw_node = "array<struct<`unique-id`:string,`node-type`:string,name:string,description:string,interfaces:string,controls:map<string,string>>>"
    nodes = top.select("arch_id", F.from_json(_listed(F.col("t.nodes")), raw_node).alias("nodes"))
    raw_interface = "array<struct<`unique-id`:string,type:string,path:string,`definition-url`:string>>"
    raw_control = "struct<description:string,requirements:string>"
    raw_requirement = "array<struct<`requirement-url`:string,config:struct<mechanism:string,signal:string,evidence:struct<`unique-id`:string,`evidence-paths`:string>>>>"

    def requirement(r: Column) -> Column:
        ev = r["config"]["evidence"]
        return F.struct(r["requirement-url"].alias("url"), r["config"]["mechanism"].alias("mechanism"), r["config"]["signal"].alias("signal"), ev["unique-id"].alias("evidence_id"), F.coalesce(_strings(ev["evidence-paths"]), F.array().cast("array<string>")).alias("paths"))

    def control(e: Column) -> Column:
        c = F.from_json(e["value"], raw_control)
        return F.struct(e["key"].alias("control_id"), c["description"].alias("description"), F.transform(F.coalesce(F.from_json(_listed(c["requirements"]), raw_requirement), F.from_json(F.lit("[]"), raw_requirement)), requirement).alias("requirements"))

    def node(n: Column) -> Column:
        return F.struct(
            n["unique-id"].alias("node_id"), n["node-type"].alias("node_type"), n["name"].alias("node_name"), n["description"].alias("description"),
            F.transform(F.coalesce(F.from_json(_listed(n["interfaces"]), raw_interface), F.from_json(F.lit("[]"), raw_interface)), lambda i: F.struct(i["unique-id"].alias("interface_id"), i["type"].alias("type"), i["path"].alias("path"), i["definition-url"].alias("definition_url"))).alias("interfaces"),
            F.transform(F.map_entries(F.coalesce(n["controls"], F.from_json(F.lit("{}"), "map<string,string>"))), control).alias("controls"),
        )

    # no filter on null lists here: it would be evaluated, with all parsing in it, once more than the lists themselves; they flatten to nothing
    return nodes.select("arch_id", F.transform("nodes", node).alias("nodes"))


def _flat(parent_keys: pa.Array, lists: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Children of a list array: their parents' keys by a vectorised take, their positions from the offsets, their values."""
    if not len(lists):
        return parent_keys.slice(0, 0), pa.array([], pa.int64()), pa.array([], lists.type.value_type)
    parents = pc.list_parent_indices(lists)
    values = pc.list_flatten(lists)
    # list_flatten drops what lies behind null lists, so positions count from the first child of each parent
    lengths = pc.fill_null(pc.list_value_length(lists), 0)
    ends = pc.cumulative_sum(pc.cast(lengths, pa.int64()))
    starts = pc.subtract(ends, pc.cast(lengths, pa.int64()))
    positions = pc.subtract(pa.array(range(len(values)), pa.int64()), pc.take(starts, parents))
    return pc.take(parent_keys, parents), positions, values


def _ids(ids: pa.Array, positions: pa.Array) -> pa.Array:
    return pc.coalesce(ids, pc.binary_join_element_wise(pa.scalar("#"), pc.cast(positions, pa.string()), ""))


def _join(*parts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "/")


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(arch_id, level, parent_path, child_id, path, position, type, name, detail) of all levels."""
    for b in batches:
        if not b.num_rows:
            continue
        out = []

        def emit(level: str, arch: pa.Array, parent: pa.Array, child: pa.Array, position: pa.Array, kind: pa.Array | None, name: pa.Array | None, detail: pa.Array | None, present: pa.Array, out: list = out) -> None:
            none = pa.nulls(len(child), pa.string())
            rows = pa.table([arch, pa.array([level] * len(child), pa.string()), parent, child, position, kind if kind is not None else none, name if name is not None else none, detail if detail is not None else none], names=["arch_id", "child_kind", "parent_path", "child_id", "position", "type", "name", "detail"])
            out.append(rows.filter(present))

        arch, pos, nodes = _flat(b.column("arch_id"), b.column("nodes"))
        ids = _ids(nodes.field("node_id"), pos)
        emit("node", arch, arch, ids, pos, nodes.field("node_type"), nodes.field("node_name"), nodes.field("description"), nodes.is_valid())

        rows = pa.array(range(len(nodes)), pa.int64())
        at, pos, items = _flat(rows, nodes.field("interfaces"))
        emit("interface", arch.take(at), ids.take(at), _ids(items.field("interface_id"), pos), pos, items.field("type"), items.field("path"), items.field("definition_url"), items.is_valid())

        at, pos, controls = _flat(rows, nodes.field("controls"))
        c_arch, c_node = arch.take(at), ids.take(at)
        emit("control", c_arch, c_node, controls.field("control_id"), pos, None, None, controls.field("description"), controls.is_valid())

        c_path = _join(c_node, controls.field("control_id"))
        at, pos, reqs = _flat(pa.array(range(len(controls)), pa.int64()), controls.field("requirements"))
        r_arch, r_parent, r_id = c_arch.take(at), c_path.take(at), pc.cast(pos, pa.string())
        emit("requirement", r_arch, r_parent, r_id, pos, reqs.field("mechanism"), reqs.field("signal"), reqs.field("url"), reqs.is_valid())

        at, pos, paths = _flat(pa.array(range(len(reqs)), pa.int64()), reqs.field("paths"))
        emit("evidence-path", r_arch.take(at), _join(r_parent, r_id).take(at), paths, pos, None, None, reqs.field("evidence_id").take(at), paths.is_valid())
        yield from pa.concat_tables(out).combine_chunks().to_batches()


def flatten_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``flatten_architectures`` before equal ones are put together. There is no shuffle, and documents never move; what is wanted of the rows should be selected first and made distinct then."""
    schema = "arch_id string, child_kind string, parent_path string, child_id string, position long, type string, name string, detail string"
    return parse_architectures(docs).mapInArrow(_flatten, schema)


def flatten_architectures(docs: DataFrame) -> DataFrame:
    """All children of all documents: (arch_id, child_kind, parent_path, child_id, position, type, name, detail), distinct.

    Text that does not parse is no document; null, absent and empty lists have no children, a single value stands for a list of
    one, a null in a list takes its position but is no child. A missing unique-id is '#' and the position. Repeated documents give their
    rows once, differing documents of one arch_id both give theirs. A document without arch_id is left out; other columns are
    ignored; an empty table gives an empty result.
    """
    return flatten_rows(docs).distinct()


def level_tables(flat: DataFrame) -> dict[str, DataFrame]:
    """The flat table of each level, keyed by (arch_id, parent_path, child_id)."""
    return {k: flat.where(F.col("child_kind") == k).drop("child_kind") for k in ("node", "interface", "control", "requirement", "evidence-path")}
