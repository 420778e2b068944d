"""Schemas that drift between files: tree edit distance between nested schemas gives scripts, scripts give projections."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.scan import segmented_lag, segmented_last, segmented_sum
from gristmill.session import checkpointed, small

#: Cost of an edit, for each field it concerns. A field that is found again elsewhere costs less than removing and adding it.
DELETE, INSERT, RETYPE, RENAME, MOVE = 10, 10, 4, 6, 8
FILE_KEY = ["root", "file_name"]
#: Step of a path into the elements of an array; all other steps are names.
ELEMENT = 0
Path = tuple[str | int, ...]


# ---------------------------------------------------------------- schema trees


@dataclass(frozen=True)
class Node:
    """A field of a schema: the types seen, and evidence of its values over the records that both files hold: (their number, sums of hashes), none if not looked at."""

    types: frozenset[str] = frozenset()
    evidence: tuple[int, str] | None = None


def shown(path: Path) -> str:
    """A path as people read it: names with dots between them, [] for the elements of an array."""
    out = ""
    for step in path:
        out += "[]" if step == ELEMENT else ("." if out else "") + str(step)
    return out


def edit_script(old: dict[Path, Node], new: dict[Path, Node]) -> tuple[int, list[tuple]]:
    """Cost and script of the cheapest edit of the schema ``old`` into ``new``, each given by the paths of its fields.

    Siblings have different names and no order, so equal paths match. Of the rest, fields may match whose values agree (equal evidence; below the top, and for moves,
    that of one value at least): as a rename if they have one parent, else as a move. What matches in one class of equal evidence costs the same whatever the pairs, but renames
    are cheaper, so the cheapest assignment has as many renames as possible, then moves, and is found by taking classes apart, in time that grows with the fields and not with their cube.
    Fields inside a renamed or moved one are carried along. A script row is (op, path, to_path, old_types, new_types), op one of retype, rename, move, carry, delete, add;
    a deleted or added field stands for all inside it.
    """
    cost, script = 0, []
    show = lambda t: "|".join(sorted(t)) or None
    order = lambda p: (len(p), [str(x) for x in p])
    gone = sorted((p for p in old if p not in new), key=order)
    come = dict.fromkeys(sorted((p for p in new if p not in old), key=order))
    match: dict[Path, Path] = {}

    def retype(a: Path, b: Path) -> None:
        nonlocal cost
        if old[a].types and new[b].types and old[a].types != new[b].types:
            cost += RETYPE
            script.append(("retype", a, b, show(old[a].types), show(new[b].types)))

    def take(a: Path, b: Path, op: str, price: int) -> None:
        nonlocal cost
        match[a] = b
        del come[b]
        cost += price
        script.append((op, a, b, show(old[a].types), show(new[b].types)))
        if op == "carry":
            retype(a, b)

    def carry(paths: list[Path]) -> None:
        for a in paths:
            if a not in match and (up := match.get(a[:-1])) is not None and (*up, a[-1]) in come:
                take(a, (*up, a[-1]), "carry", 0)

    for p in sorted((p for p in old if p in new), key=order):
        retype(p, p)
    levels: dict[int, list[Path]] = defaultdict(list)
    for p in gone:
        levels[len(p)].append(p)
    for depth in sorted(levels):
        carry(levels[depth])
        waiting: dict[tuple, list[Path]] = defaultdict(list)
        for b in come:
            e = new[b].evidence
            if e is not None and len(b) == depth and b[-1] != ELEMENT and (depth == 1 or e[0]):
                waiting[(b[:-1], e)].append(b)
        for a in levels[depth]:
            e = old[a].evidence
            places = waiting.get((match.get(a[:-1], a[:-1]), e)) if e is not None and a not in match and a[-1] != ELEMENT else None
            if places:
                take(a, places.pop(0), "rename", RENAME)
    found: dict[tuple, list[Path]] = defaultdict(list)
    for b in come:
        e = new[b].evidence
        if e is not None and e[0]:
            found[e].append(b)
    for depth in sorted(levels):
        carry(levels[depth])
        for a in levels[depth]:
            e = old[a].evidence
            if a in match or e is None or not e[0]:
                continue
            places = found.get(e, [])
            while places and places[0] not in come:
                places.pop(0)
            if places:
                take(a, places.pop(0), "move", MOVE)
    left = {p for p in gone if p not in match}
    for p in gone:
        if p in left:
            cost += DELETE
            if p[:-1] not in left:
                script.append(("delete", p, None, show(old[p].types), None))
    for p in come:
        cost += INSERT
        if p[:-1] not in come:
            script.append(("add", p, p, None, show(new[p].types)))
    return cost, script


def _path(text: str) -> Path:
    return tuple(json.loads(text))


_SCRIPT = "root string, file_name string, op string, path string, to_path string, old_type string, new_type string, depth int, to_depth int, raw string, to_raw string"


def _scripts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCRIPT.split(", ")]
    for b in batches:
        out = []
        for root, file_name, fields in zip(*(b.column(c).to_pylist() for c in ("root", "file_name", "fields")), strict=True):
            old, new = {}, {}
            for f in fields:
                evidence = None if f["n"] is None else (f["n"], f["sig"])
                for side, types in ((old, f["old_types"]), (new, f["new_types"])):
                    if types is not None:
                        side[_path(f["path"])] = Node(frozenset(types), evidence)
            for op, a, z, was, now in edit_script(old, new)[1]:
                out.append((root, file_name, op, shown(a), None if z is None else shown(z), was, now, len(a) - 1, None if z is None else len(z) - 1, _text(a), None if z is None else _text(z)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=pa.int32() if n.endswith("depth") else pa.string()) for i, n in enumerate(names)], names=names)


# ---------------------------------------------------------------- records and files


def _text(path: Path) -> str:
    return json.dumps(path, ensure_ascii=False, separators=(",", ":"))


#: Types as bits, so that sets of them are numbers.
TYPES = ("array", "boolean", "number", "object", "string")
ARRAY, BOOLEAN, NUMBER, OBJECT, STRING = (1 << i for i in range(5))
_NAMES = [[t for i, t in enumerate(TYPES) if bits >> i & 1] for bits in range(32)]
_BITS = {str: STRING, bool: BOOLEAN, int: NUMBER, float: NUMBER, list: ARRAY, dict: OBJECT, type(None): 0}


def _canonical(v: object) -> str:
    """Text that is equal for equal values: numbers by value, objects with their keys in order and without nulls."""
    if isinstance(v, str):
        return "s" + v
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, int | float):
        return "n" + (repr(float(v)) if abs(v) <= 1 << 53 or isinstance(v, float) else str(v))
    if isinstance(v, list):
        return json.dumps([_canonical(x) for x in v])
    return json.dumps({k: _canonical(x) for k, x in sorted(v.items()) if x is not None})


def _distinct(pairs: list[tuple[str, object]]) -> dict[str, object]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key comes twice")
    return out


def _no_constant(name: str) -> None:
    raise ValueError(name)


_STRICT = json.JSONDecoder(object_pairs_hook=_distinct, parse_constant=_no_constant).decode
_PLAIN = json.JSONDecoder(parse_constant=_no_constant).decode
_KEYS = re.compile(r'"\s*:')


def _n_keys(v: object) -> int:
    """Number of keys in all objects of a value."""
    n, stack = 0, [v]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            n += len(x)
            stack += [y for y in x.values() if isinstance(y, dict | list)]
        elif isinstance(x, list):
            stack += [y for y in x if isinstance(y, dict | list)]
    return n


def record_of(payload: str | None) -> dict | None:
    """The record that a payload holds; none if it is no JSON object, or one in which a key comes twice."""
    try:
        r = _PLAIN(payload) if payload else None
        if isinstance(r, dict):
            # no more quotes with a colon behind them than keys: then no key came twice, else a slower look tells
            return r if len(_KEYS.findall(payload)) == _n_keys(r) else _STRICT(payload)
    except (ValueError, RecursionError):
        pass
    return None


def _hash(text: str) -> int:
    """Spark's xxhash64 of a text, unsigned."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)


def path_code(path: Column) -> Column:
    """What stands for a path in records."""
    return F.xxhash64(path)


class _Walk:
    """Paths, types and value hashes of records. What depends on a path or a text alone is remembered."""

    def __init__(self) -> None:
        self.paths: dict[Path, tuple[str, int]] = {}
        self.tops: dict[str, tuple[str, int]] = {}
        self.texts: dict[str, int] = {}

    def path(self, p: Path) -> tuple[str, int]:
        known = self.paths.get(p)
        if known is None:
            if len(self.paths) > 100_000:
                self.paths.clear()
                self.tops.clear()
            text = _text(p)
            known = self.paths[p] = (text, _hash(text))
            if len(p) == 1:
                self.tops[p[0]] = known
        return known

    def text(self, v: str) -> int:
        """Hash of a string's canonical form."""
        known = self.texts.get(v)
        if known is None:
            if len(self.texts) > 200_000:
                self.texts.clear()
            known = _hash("s" + v)
            if len(v) <= 64:
                self.texts[v] = known
        return known

    def inner(self, path: Path, values: list, single: bool, out: list[tuple[str, int, int, int | None]]) -> None:
        """Adds (path, its code, types, hash of the value or none for null) of a field and all inside it; the values of a field in all elements of an array count as one list."""
        stack = [(path, values, single)]
        while stack:
            path, values, single = stack.pop()
            bits = 0
            for v in values:
                bits |= _BITS[type(v)]
            h = None if not bits else _hash(_canonical(values[0])) if single else _hash("l" + json.dumps([_canonical(x) for x in values]))
            out.append((*self.path(path), bits, h))
            if bits & OBJECT:
                inside: dict[str, list] = {}
                for v in values:
                    if type(v) is dict:
                        for k, x in v.items():
                            inside.setdefault(k, []).append(x)
                stack += [((*path, k), xs, single) for k, xs in inside.items()]
            if bits & ARRAY and (items := [x for v in values if type(v) is list for x in v]):
                stack.append(((*path, ELEMENT), items, False))

    def fields(self, record: dict, id_field: str) -> list[tuple[str, int, int, int | None]]:
        out: list[tuple[str, int, int, int | None]] = []
        for k, v in record.items():
            if k == id_field:
                continue
            kind = type(v)
            if kind is dict or kind is list:
                self.inner((k,), [v], True, out)
            else:
                at = self.tops.get(k) or self.path((k,))
                out.append((at[0], at[1], _BITS[kind], self.text(v) if kind is str else None if v is None else _hash(_canonical(v))))
        return out


_PARSED = "fid bigint, rid bigint, at array<bigint>, val array<bigint>, path string, types array<string>"


def _parse(id_field: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each record with an id (fid, rid, at, val), and for each batch one for each field of a file (fid, path, types)."""
        walk = _Walk()
        for b in batches:
            fids, rids, sizes, at, val = [], [], [], [], []
            seen: dict[int, dict[str, int]] = {}
            for fid, payload in zip(b.column("fid").to_pylist(), b.column("payload").to_pylist(), strict=True):
                r = record_of(payload)
                if r is None:
                    continue
                try:
                    found = walk.fields(r, id_field)
                except RecursionError:
                    continue
                known = seen.setdefault(fid, {})
                for text, _, bits, _ in found:
                    known[text] = known.get(text, 0) | bits
                rid = r.get(id_field)
                if rid is not None:
                    there = [(code, h) for _, code, _, h in found if h is not None]
                    at += [code for code, _ in there]
                    val += [h for _, h in there]
                    sizes.append(len(there))
                    fids.append(fid)
                    rids.append(walk.text(rid) if type(rid) is str else _hash(_canonical(rid)))
            signed = lambda xs: pa.array(np.array(xs, np.uint64).view(np.int64))
            offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
            of_file = [(fid, path, bits) for fid, paths in seen.items() for path, bits in paths.items()]
            none, m, k = pa.nulls, len(fids), len(of_file)
            listed = pa.list_(pa.int64())
            rows = [
                pa.concat_arrays([pa.array(fids, pa.int64()), pa.array([x[0] for x in of_file], pa.int64())]), pa.concat_arrays([signed(rids), none(k, pa.int64())]),
                pa.concat_arrays([pa.ListArray.from_arrays(offsets, signed(at)), none(k, listed)]), pa.concat_arrays([pa.ListArray.from_arrays(offsets, signed(val)), none(k, listed)]),
                pa.concat_arrays([none(m, pa.string()), pa.array([x[1] for x in of_file], pa.string())]), pa.concat_arrays([none(m, pa.list_(pa.string())), pa.array([_NAMES[x[2]] for x in of_file], pa.list_(pa.string()))]),
            ]
            yield pa.RecordBatch.from_arrays(rows, names=[x.split()[0] for x in _PARSED.split(", ")])

    return run


def file_id() -> Column:
    """Hash of (root, file_name), which stands for the file wherever many rows are moved."""
    return F.xxhash64(*FILE_KEY)


def parsed_records(files: DataFrame, id_field: str = "evidenceId") -> tuple[DataFrame, DataFrame]:
    """(records, fields) of all payloads, each parsed once: records (fid, rid, at, val) with hashes of the paths and values of their fields that are not null, fields (fid, path, types) of each file.

    Nesting has no bound, hence Python over Arrow batches. Text that is no JSON object is no record, nor is one in which a key comes twice or that is nested deeper than the parser goes.
    """
    some = files.where(F.col("payload").isNotNull() & F.col("root").isNotNull() & F.col("file_name").isNotNull()).select(file_id().alias("fid"), "payload")
    parsed = checkpointed(some.mapInArrow(_parse(id_field), _PARSED))
    fields = parsed.where("path is not null").select("fid", "path", F.explode_outer("types").alias("t")).groupBy("fid", "path").agg(F.array_sort(F.collect_set("t")).alias("types"))
    return parsed.where("rid is not null").select("fid", "rid", "at", "val"), fields


def file_order(files: DataFrame) -> DataFrame:
    """(root, file_name, at, prev_file): each file with the one before it in its root, by time and then name."""
    one = files.where(F.col("root").isNotNull() & F.col("file_name").isNotNull()).groupBy(*FILE_KEY).agg(F.min("generated_at").alias("at"))
    return segmented_lag(one, ["root"], ["at", "file_name"], F.col("file_name"), "prev_file")


def schema_scripts(files: DataFrame, carried: bool = False) -> DataFrame:
    """Edit scripts between each file and the one before in its root: (root, file_name, op, path, to_path, old_type, new_type, depth, to_depth, raw, to_raw).

    op is add, delete, rename, move or retype; paths have dots between nested names and [] for the elements of arrays, raw ones are JSON lists of their steps; depth is 0 at the top. With ``carried``
    there is also a row carry for each field inside a renamed or moved one. A removed field counts as renamed to an added one of the same parent, and as moved to one elsewhere, if their
    values agree in every record that both files hold, null and absent being equal. This is tested by sums of hashes
    of (record, value) over the common records, added up before they are shuffled, so a file of any size is compared without
    being gathered. Only schema trees, whose size does not grow with the rows, meet in one task. Repeated rows count once; unparsable payloads are
    no records, though their file still has its place in time; null roots and file names are left out. An empty table gives an empty result.
    """
    order = checkpointed(file_order(files).withColumn("fid", file_id()).withColumn("prev", F.when(F.col("prev_file").isNotNull(), F.xxhash64("root", "prev_file"))))
    scripts = _scripts_of(order, *parsed_records(files))
    return scripts if carried else scripts.where("op <> 'carry'")


def _scripts_of(order: DataFrame, records: DataFrame, fields: DataFrame) -> DataFrame:
    pairs = order.where(F.col("prev").isNotNull()).select(F.col("fid").alias("pair"), F.explode(F.array(F.struct("fid", F.lit(True).alias("later")), F.struct(F.col("prev").alias("fid"), F.lit(False).alias("later")))).alias("s")).select("pair", "s.fid", "s.later")
    new, old = F.max(F.when(F.col("later"), F.col("types"))), F.max(F.when(~F.col("later"), F.col("types")))
    sides = checkpointed(pairs.join(fields, "fid").groupBy("pair", "path").agg(old.alias("old_types"), new.alias("new_types"), F.max("fid").alias("fid")))
    is_new, is_gone = F.col("old_types").isNull(), F.col("new_types").isNull()
    both = sides.where(is_new | is_gone).groupBy("pair").agg(F.bool_or(is_new).alias("a"), F.bool_or(is_gone).alias("b")).where("a and b").select("pair")
    # what a file is asked for: the fields that only it has of a pair in which the other has such fields too
    lone = sides.where(is_new | is_gone).join(both, "pair", "left_semi").select("pair", "fid", is_new.alias("later"), "path")
    asked = lone.groupBy("fid", "pair", "later").agg(F.collect_set(F.col("path")).alias("paths"))
    # a file of such a pair may have no field of its own to be asked for, but which records it holds counts all the same
    wanted = pairs.join(both, "pair", "left_semi").join(asked, ["fid", "pair", "later"], "left")
    hit = records.join(small(checkpointed(wanted.withColumn("codes", F.transform(F.coalesce("paths", F.array().cast("array<string>")), lambda p: path_code(p))).drop("paths"))), "fid")
    entries = F.filter(F.arrays_zip("at", "val"), lambda e: F.array_contains("codes", e["at"]))
    met = hit.select("pair", "rid", "later", entries.alias("e")).repartition("pair", "rid")
    whole = Window.partitionBy("pair", "rid")
    common = met.withColumn("both", F.max("later").over(whole) != F.min("later").over(whole)).where("both")
    values = common.select("pair", "rid", F.explode("e").alias("e")).select("pair", "rid", F.col("e.at").alias("code"), F.col("e.val").alias("val")).groupBy("pair", "rid", "code", "val").agg(F.lit(1).alias("one"))
    # no overflow: hashes are folded to 40 bits before they are summed, twice with different seeds
    h = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), "rid", "val"), F.lit(1 << 40)))
    sums = values.groupBy("pair", "code").agg(F.count("*").alias("n"), h(1).alias("s1"), h(2).alias("s2"))
    told = lone.select("pair", "path").withColumn("code", path_code(F.col("path"))).join(sums, ["pair", "code"], "left")
    evidence = told.select("pair", "path", F.coalesce("n", F.lit(0)).alias("n"), F.concat_ws(":", F.coalesce("s1", F.lit(0)), F.coalesce("s2", F.lit(0))).alias("sig"))
    trees = sides.join(evidence, ["pair", "path"], "left").groupBy("pair").agg(F.collect_list(F.struct("path", "old_types", "new_types", "n", "sig")).alias("fields"))
    named = trees.join(order.select(F.col("fid").alias("pair"), *FILE_KEY), "pair").select(*FILE_KEY, "fields")
    return named.mapInArrow(_scripts, _SCRIPT)


def field_changes(scripts: DataFrame) -> DataFrame:
    """Changes of top-level fields: (file_name, field, change), change one of renamed, removed, added, retyped; distinct. A field that moved from or to a place inside another is removed from or added to the top."""
    op, top, to_top = F.col("op"), F.col("depth") == 0, F.col("to_depth") == 0
    gone = F.when(top & op.isin("delete", "move"), F.struct(F.col("path").alias("field"), F.lit("removed").alias("change")))
    name = F.when(op == "rename", "renamed").when(op == "retype", "retyped").when(op.isin("add", "move"), "added")
    come = F.when(to_top & name.isNotNull() & ((op != "rename") | top), F.struct(F.col("to_path").alias("field"), name.alias("change")))
    return scripts.select("file_name", F.explode(F.array_compact(F.array(gone, come))).alias("c")).select("file_name", "c.field", "c.change").distinct()


# ---------------------------------------------------------------- one table


def canonical_names(order: DataFrame, fields: DataFrame, scripts: DataFrame) -> DataFrame:
    """(fid, path, name): the path at the end of the chain of renames and moves that each file's field begins; ``order`` (root, file_name, fid, seq), ``scripts`` with carried fields.

    A change leads to the next one of its new path (a later rename or move, or a removal, which ends the chain). What comes next is one scan over fields and changes of a path against time, and
    chains are followed by pointer doubling, so a chain of n changes takes log n joins.
    """
    placed = order.select("root", "file_name", "fid", "seq")
    events = scripts.where(F.col("op").isin("rename", "move", "carry", "delete")).join(placed, FILE_KEY).select("root", "seq", F.col("raw").alias("path"), F.when(F.col("op") != "delete", F.col("to_raw")).alias("to"))
    none = F.lit(None)
    parts = [
        fields.join(placed, "fid").select("root", "path", "seq", F.lit(0).alias("kind"), "fid", none.cast("string").alias("to")),
        events.where("to is not null").select("root", F.col("to").alias("path"), "seq", F.lit(1).alias("kind"), none.cast("bigint").alias("fid"), none.cast("string").alias("to")),
        events.select("root", "path", "seq", F.lit(2).alias("kind"), none.cast("bigint").alias("fid"), "to"),
    ]
    told = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("back", -F.col("seq"))
    scanned = checkpointed(segmented_last(told, ["root", "path"], ["back", "kind"], F.when(F.col("kind") == 2, F.struct("seq", "to")), "next").where("kind < 2"))
    step = scanned.select("kind", "root", "path", "seq", "fid", F.col("next.to").alias("nto"), F.when(F.col("next.to").isNotNull(), F.col("next.seq")).alias("nseq"))
    nodes = step.where("kind = 1").select("root", "path", "seq", F.col("path").alias("name"), "nto", "nseq").distinct()
    for _ in count():
        if nodes.where("nto is not null").isEmpty():
            break
        ahead = nodes.select("root", F.col("path").alias("nto"), F.col("seq").alias("nseq"), F.col("name").alias("name2"), F.col("nto").alias("nto2"), F.col("nseq").alias("nseq2"))
        nodes = checkpointed(nodes.join(ahead, ["root", "nto", "nseq"], "left").select("root", "path", "seq", F.coalesce("name2", "name").alias("name"), F.col("nto2").alias("nto"), F.col("nseq2").alias("nseq")))
    ends = nodes.select("root", F.col("path").alias("nto"), F.col("seq").alias("nseq"), F.col("name").alias("end"))
    return step.where("kind = 0").join(ends, ["root", "nto", "nseq"], "left").select("fid", "path", F.coalesce("end", "path").alias("name"))


def projections(order: DataFrame, fields: DataFrame, scripts: DataFrame) -> DataFrame:
    """(fid, path, column): what each file's fields are called in the one table: the scripts compiled into a projection of every file.

    Fields at the top have a column, and so have fields that were there before they moved into another or came from one. If two of a file end in one column, the one that was
    renamed has it and the other is kept as column@file@field.
    """
    names = canonical_names(order, fields, scripts).where((F.json_array_length("path") == 1) | (F.json_array_length("name") == 1))
    dotted = lambda c: F.concat_ws(".", F.from_json(c, "array<string>"))
    among = Window.partitionBy("fid", "column").orderBy(F.col("path") == F.col("name"), "path")
    ranked = names.withColumn("column", dotted("name")).withColumn("n", F.row_number().over(among)).join(order.select("fid", "file_name"), "fid")
    return ranked.select("fid", "path", F.when(F.col("n") == 1, F.col("column")).otherwise(F.concat_ws("@", "column", "file_name", dotted("path"))).alias("column"))


COLUMN_TYPES = {frozenset({"number"}): "double", frozenset({"boolean"}): "boolean"}


def unified_table(files: DataFrame, id_field: str = "evidenceId", max_columns: int = 500) -> DataFrame:
    """All records in one table: (root, file_name, line_no, evidence_id, one column for each field, others).

    Each file's projection follows from the scripts, see ``projections``. A column is double or boolean if its field never had another type, else it is text, where objects and arrays
    are JSON. The ``max_columns`` fields of most files have a column, all others are in the map ``others``, so nothing is lost where keys are data. Columns that differ in case alone, or have the name of
    another column, get ~2, ~3 and so on. A null or absent value is null. Records without fields have a row. Distinct rows; other cases as for ``schema_scripts``.
    """
    order = file_order(files).withColumn("fid", file_id()).withColumn("prev", F.when(F.col("prev_file").isNotNull(), F.xxhash64("root", "prev_file"))).withColumn("one", F.lit(1))
    order = checkpointed(segmented_sum(order, ["root"], ["at", "file_name"], "one", "seq"))
    records, fields = parsed_records(files, id_field)
    fields = checkpointed(fields)
    scripts = checkpointed(_scripts_of(order, records, fields))
    plan = checkpointed(projections(order, fields, scripts))
    kinds = plan.join(fields, ["fid", "path"]).groupBy("column").agg(F.count_distinct("fid").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"))
    most = kinds.orderBy(F.desc("n"), "column").limit(max_columns).collect()  # as many as the table has columns
    taken = {"root", "file_name", "line_no", "evidence_id", "others"}
    columns = []
    for r in sorted(most, key=lambda r: r["column"]):
        label, k = r["column"], 1
        while label.lower() in taken:
            k += 1
            label = f"{r['column']}~{k}"
        taken.add(label.lower())
        columns.append((r["column"], label, COLUMN_TYPES.get(frozenset(r["types"]), "string")))
    steps = F.from_json("path", "array<string>")
    quoted = F.concat(F.lit("$"), F.concat_ws("", F.transform(steps, lambda x: F.concat(F.lit("['"), x, F.lit("']")))))
    at_top = F.json_array_length("path") == 1
    of_file = plan.groupBy("fid").agg(
        F.map_from_entries(F.collect_list(F.when(at_top, F.struct(steps[0].alias("k"), F.col("column").alias("v"))))).alias("tops"), F.collect_list(F.when(~at_top, F.struct("column", quoted.alias("at")))).alias("inner")
    )
    rows = files.where(F.col("payload").isNotNull() & F.col("root").isNotNull() & F.col("file_name").isNotNull()).select(*FILE_KEY, "line_no", "payload").distinct()
    rows = rows.withColumn("v", F.try_parse_json("payload")).where(F.schema_of_variant("v").startswith("OBJECT")).withColumn("fid", file_id()).join(small(of_file), "fid", "left")
    text = lambda v: F.try_variant_get(v, "$", "string")
    whole = F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))
    tops = F.filter(F.transform(whole, lambda e: F.struct(F.col("tops")[e["key"]].alias("k"), text(e["value"]).alias("v"))), lambda e: e["k"].isNotNull() & e["v"].isNotNull())
    inner = F.filter(F.transform(F.coalesce("inner", F.array().cast("array<struct<column:string,at:string>>")), lambda x: F.struct(x["column"].alias("k"), F.call_function("get_json_object", F.col("payload"), x["at"]).alias("v"))), lambda e: e["v"].isNotNull())
    held = rows.select(*FILE_KEY, "line_no", F.try_variant_get("v", f"$.{id_field}", "string").alias("evidence_id"), F.map_from_entries(F.concat(tops, inner)).alias("held"))
    typed = [F.col("held")[F.lit(c)].try_cast(t).alias(label) for c, label, t in columns]
    known = F.array(*(F.lit(c) for c, _, _ in columns)) if columns else F.array().cast("array<string>")
    return held.select(*FILE_KEY, "line_no", "evidence_id", *typed, F.map_filter("held", lambda k, _: ~F.array_contains(known, k)).alias("others"))
