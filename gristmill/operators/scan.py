"""Ordered scans that survive hot keys.

A window over a key puts all rows of that key into one task. These operators cut the rows into range partitions of
(key, order) instead, so one key may spread over many of them. Each partition is scanned in order by itself, over Arrow batches, and what a
key's earlier rows in the partitions before come to is carried in. Only the first key of a partition can have such rows, so one value for each
partition is carried, however many keys there are, and the rows are shuffled once.

The partitions are only stable once they are written, hence the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, IntegerType, LongType, StructField, StructType

from gristmill.session import checkpointed

PID, VALUE = "_chunk", "_v"


def range_chunks(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``df`` cut by ranges of (key, order) and sorted by them within; column ``_chunk`` grows with the order. Rows equal in both stay together."""
    return checkpointed(df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).withColumn(PID, F.spark_partition_id()))


def _key_starts(b: pa.RecordBatch, key: list[str], last: list | None) -> np.ndarray:
    """Whether a row's key differs from that of the row before; ``last`` is the key before the batch, None if there is none. Nulls are equal."""
    n = b.num_rows
    out = np.zeros(n, bool)
    for c in key:
        col = b.column(c)
        a, z = col.slice(1), col.slice(0, n - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, z), False), pc.and_(pc.is_null(a), pc.is_null(z)))
        out[1:] |= ~same.to_numpy(zero_copy_only=False)
    out[0] = last is None or [b.column(c)[0].as_py() for c in key] != last
    return out


class _Sum:
    """Running sum, the row itself included; nulls count as 0."""

    kind: Callable[[DataType], DataType] = staticmethod(lambda _: LongType())

    @staticmethod
    def fold(acc: int | None, values: pa.Array) -> int:
        return (acc or 0) + (pc.sum(values).as_py() or 0)

    @staticmethod
    def merge(before: int | None, acc: int | None) -> int:
        return (before or 0) + (acc or 0)

    @staticmethod
    def scan(values: pa.Array, starts: np.ndarray, acc: int | None) -> pa.Array:
        v = pc.fill_null(pc.cast(values, pa.int64()), 0).to_numpy(zero_copy_only=False)
        run = np.cumsum(v)
        first = np.maximum.accumulate(np.where(starts, np.arange(len(v)), -1))
        return pa.array(run - np.where(first >= 0, run[first] - v[first], -(acc or 0)))


class _Last:
    """The last value that is not null of a row strictly before."""

    kind: Callable[[DataType], DataType] = staticmethod(lambda t: t)

    @staticmethod
    def fold(acc: Any, values: pa.Array) -> Any:
        kept = values.drop_null()
        return kept[-1].as_py() if len(kept) else acc

    @staticmethod
    def merge(before: Any, acc: Any) -> Any:
        return before if acc is None else acc

    @staticmethod
    def before(values: pa.Array, starts: np.ndarray) -> np.ndarray:
        there = np.where(values.is_valid().to_numpy(zero_copy_only=False), np.arange(len(values)), -1)
        return np.append(-1, np.maximum.accumulate(there)[:-1])

    @classmethod
    def scan(cls, values: pa.Array, starts: np.ndarray, acc: Any) -> pa.Array:
        n = len(values)
        at = cls.before(values, starts)
        first = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
        at = np.where((at < first) | (at < 0), np.where(first < 0, n, -1), at)  # n is what was carried in
        pool = pa.concat_arrays([values, pa.array([acc], values.type)])
        return pool.take(pa.array(at, mask=at < 0))


class _Lag(_Last):
    """The value of the row before, null or not."""

    @staticmethod
    def fold(acc: Any, values: pa.Array) -> Any:
        return values[-1].as_py() if len(values) else acc

    @staticmethod
    def merge(before: Any, acc: Any) -> Any:
        return acc

    @staticmethod
    def before(values: pa.Array, starts: np.ndarray) -> np.ndarray:
        return np.arange(-1, len(values) - 1)


def _flat(col: pa.ChunkedArray | pa.Array) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def _summary(key: list[str], how: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each partition: its number, first and last key, whether they are the same throughout, and what the rows of the last key come to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = acc = pid = schema = None
        single = True
        for b in batches:
            if not b.num_rows:
                continue
            starts = _key_starts(b, key, last)
            at = np.flatnonzero(starts)
            if first is None:
                first, pid, schema = [b.column(c)[0].as_py() for c in key], b.column(PID)[0].as_py(), b.schema
                single = len(at) == 1
            elif len(at):
                single = False
            values = _flat(b.column(VALUE))
            acc = how.fold(None, values.slice(int(at[-1]))) if len(at) else how.fold(acc, values)
            last = [b.column(c)[-1].as_py() for c in key]
        if first is not None:
            kinds = [schema.field(c).type for c in key]
            value = pa.int64() if how is _Sum else schema.field(VALUE).type
            row = [pa.array([pid], pa.int32()), pa.array([single]), pa.array([acc], value), *(pa.array([x], t) for x, t in zip(first + last, kinds + kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(row, names=[PID, "single", VALUE, *(f"f{i}" for i in range(len(key))), *(f"l{i}" for i in range(len(key)))])

    return run


def _scanned(key: list[str], how: type, carried: dict[int, Any], out: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, acc = None, None
        for b in batches:
            if not b.num_rows:
                continue
            starts = _key_starts(b, key, last)
            if last is None and (pid := b.column(PID)[0].as_py()) in carried:
                starts[0], acc = False, carried[pid]
            values = _flat(b.column(VALUE))
            result = how.scan(values, starts, acc)
            at = np.flatnonzero(starts)
            acc = how.fold(None, values.slice(int(at[-1]))) if len(at) else how.fold(acc, values)
            last = [b.column(c)[-1].as_py() for c in key]
            names = [c for c in b.schema.names if c not in (PID, VALUE)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), result], names=[*names, out])

    return run


def _ordered_scan(df: DataFrame, key: list[str], order: list[str], value: Column, out: str, how: type) -> DataFrame:
    d = range_chunks(df.withColumn(VALUE, value), key, order)
    fields = {f.name: f.dataType for f in d.schema}
    kinds = [StructField(PID, IntegerType()), StructField("single", BooleanType()), StructField(VALUE, how.kind(fields[VALUE]))]
    kinds += [StructField(f"{side}{i}", fields[c]) for side in "fl" for i, c in enumerate(key)]
    carried: dict[int, Any] = {}
    last = acc = None
    # one row for each partition comes to the driver, whatever the number of keys and rows
    for r in sorted(d.mapInArrow(_summary(key, how), StructType(kinds)).toArrow().to_pylist(), key=lambda r: r[PID]):
        first = [r[f"f{i}"] for i in range(len(key))]
        if last is not None and first == last:
            carried[r[PID]] = acc
            acc = how.merge(acc, r[VALUE]) if r["single"] else r[VALUE]
        else:
            acc = r[VALUE]
        last = [r[f"l{i}"] for i in range(len(key))]
    schema = StructType([*(StructField(f.name, f.dataType) for f in d.schema if f.name not in (PID, VALUE)), StructField(out, how.kind(fields[VALUE]))])
    return d.mapInArrow(_scanned(key, how, carried, out), schema)


def segmented_sum(df: DataFrame, key: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Running sum of ``value`` within ``key`` along ``order``, the row itself included.

    Rows equal in (key, order) come in any order. A null ``value`` counts as 0. An empty input gives an empty result.
    """
    return _ordered_scan(df, key, order, F.col(value).cast("bigint"), out, _Sum)


def segmented_lag(df: DataFrame, key: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """``value`` of the row before within ``key`` along ``order``; null in the first row of a key.

    Equal (key, order) rows must not occur. An empty input gives an empty result.
    """
    return _ordered_scan(df, key, order, value, out, _Lag)


def segmented_last(df: DataFrame, key: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """The last non-null ``value`` of a row strictly before, within ``key`` along ``order``; null where there is none.

    ``order`` should be unique within a key, else equal rows come in any order. An empty input gives an empty result.
    """
    return _ordered_scan(df, key, order, value, out, _Last)
