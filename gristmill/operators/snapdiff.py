"""What changed between full snapshots: invertible Bloom lookup tables, subtracted and peeled bucket by bucket."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.scan import segmented_sum
from gristmill.session import checkpointed, is_small, norm_text, small

#: Rows of a snapshot that share a bucket, about, and cells of a bucket's table in each of its parts; the table grows if more rows differ.
BUCKET_ROWS, WIDTH = 256, 32
GROWTH = 2
SUBTABLES = 3
#: Runs of a group that meet in one place, which bounds what a bucket holds however many runs there are.
BLOCK_RUNS = 64
PLACE = ["g", "bucket", "block"]


def content_digest(texts: list[str], lists: list[str], numbers: list[str]) -> Column:
    """Digest of a row's content: texts without outer spaces and null as empty, lists as sets without blank items, numbers with null apart. Every part is hashed on top of the one before, lists with their size, so no two contents run together."""
    as_set = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), norm_text), lambda x: x != "")))
    parts = [norm_text(c) for c in texts]
    for c in lists:
        parts += [as_set(c), F.size(as_set(c))]
    return F.xxhash64(*parts, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in numbers))


def _h(value: int, seed: int) -> int:
    """Spark's xxhash64 of one long with a seed, unsigned."""
    return xxhash.xxh64_intdigest(struct.pack("<q", value), seed)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _element(k: int, v: int) -> int:
    """xxhash64(k, v) as Spark has it: the first one's hash is the second one's seed."""
    return _signed(_h(v, _h(k, 42)))


def _place(e: int, j: int, width: int) -> int:
    return j * width + _signed(_h(j, _h(e, 42))) % width


def _peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Peel each bucket's difference; a bucket that leaves something over is reported with ok = false and no pairs."""
    for b in batches:
        out: list[tuple] = []
        for g, bucket, block, pair, width, cells in zip(*(b.column(c).to_pylist() for c in (*PLACE, "pair", "width", "cells")), strict=True):
            tab = {c["cell"]: [c["n"], c["xk"], c["xv"], c["xc"]] for c in cells}
            todo, found, ok = list(tab), [], True
            while todo:
                cell = todo.pop()
                n, k, v, check = tab[cell]
                if n not in (1, -1):
                    continue
                e = _element(k, v)
                if _signed(_h(99, _h(e, 42))) != check:
                    continue
                found.append((k, v, n))
                for j in range(SUBTABLES):
                    at = _place(e, j, width)
                    c = tab.setdefault(at, [0, 0, 0, 0])
                    c[0] -= n
                    c[1] ^= k
                    c[2] ^= v
                    c[3] ^= check
                    todo.append(at)
                if len(found) > SUBTABLES * width + 8:
                    ok, todo = False, []
            if ok and all(not any(c) for c in tab.values()):
                out += [(g, bucket, block, pair, True, *f) for f in found]
            else:
                out.append((g, bucket, block, pair, False, 0, 0, 0))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=t) for i, t in enumerate(kinds)], names=[*PLACE, "pair", "ok", "k", "v", "sign"])


def run_order(snapshots: DataFrame, runs: DataFrame, run: str, group: str, order: str) -> DataFrame:
    """(name, run, g, seq, n_runs, buckets): each run with its place among the runs of its group, and into how many buckets the group's snapshots are cut: enough for its largest run.

    ``run`` and ``g`` are hashes. Runs of a group at the same instant follow each other by run id.
    """
    once = runs.where(F.col(group).isNotNull() & F.col(order).isNotNull() & F.col(run).isNotNull()).groupBy(F.col(run).alias("name")).agg(F.min(F.struct(F.col(order).alias("o"), F.col(group).alias("g"))).alias("m"))
    once = once.select("name", F.xxhash64("name").alias("run"), F.xxhash64("m.g").alias("g"), F.col("m.o").alias("o"), F.lit(1).alias("one"))
    sizes = snapshots.where(F.col(run).isNotNull()).groupBy(F.xxhash64(F.col(run)).alias("run")).agg(F.count("*").alias("n"))
    placed = segmented_sum(once, ["g"], ["o", "name"], "one", "seq").join(sizes, "run", "left")
    shape = placed.groupBy("g").agg(F.max("seq").alias("n_runs"), F.greatest(F.lit(1), F.ceil(F.max(F.coalesce("n", F.lit(0))) / BUCKET_ROWS)).cast("bigint").alias("buckets"))
    return checkpointed(placed.join(shape, "g").select("name", "run", "g", "seq", "n_runs", "buckets"))


def placed_rows(snapshots: DataFrame, order: DataFrame, run: str, key: str, digest: Column, at: str = "loaded_at") -> DataFrame:
    """(g, bucket, block, seq, later, earlier, k, key, v): one row for each key of a run, where all runs of its group that are near in time meet.

    ``later`` and ``earlier`` say whether the row takes part, in this block, in the difference from the run before and to the run behind. Deliveries of one run add up; of several contents of a key in a run the last loaded counts. The only shuffle
    of the rows is by (group, bucket of the key, block of runs): a bucket has about 256 rows of a run and a block 64 runs, so no place grows with the data, however large a group or often a key.
    """
    hashed = snapshots.where(F.col(run).isNotNull() & F.col(key).isNotNull()).select(F.xxhash64(F.col(run)).alias("run"), F.xxhash64(F.col(key).cast("string")).alias("k"), F.col(key).cast("string").alias("key"), digest.alias("v"), F.col(at).alias("at"))
    places_of = order.select("run", "g", "seq", "n_runs", "buckets")
    j = hashed.join(F.broadcast(places_of), "run") if is_small(places_of) else checkpointed(hashed.join(places_of, "run"))
    block = F.floor(F.col("seq") / BLOCK_RUNS)
    behind = F.floor((F.col("seq") + 1) / BLOCK_RUNS)
    # the last run of a block is also the earlier side of the first of the next
    places = F.when((behind != block) & (F.col("seq") < F.col("n_runs")), F.array(block, behind)).otherwise(F.array(block))
    j = j.withColumn("bucket", F.pmod("k", "buckets")).withColumn("block", F.explode(places))
    later = (F.col("seq") > 1) & (F.floor(F.col("seq") / BLOCK_RUNS) == F.col("block"))
    earlier = (F.col("seq") < F.col("n_runs")) & (F.floor((F.col("seq") + 1) / BLOCK_RUNS) == F.col("block"))
    met = j.select(*PLACE, "seq", later.alias("later"), earlier.alias("earlier"), "k", "key", "v", "at").repartition(*PLACE)
    last = met.groupBy(*PLACE, "seq", "later", "earlier", "k", "key").agg(F.max(F.struct("at", "v")).alias("m"))
    return checkpointed(last.select(*PLACE, "seq", "later", "earlier", "k", "key", F.col("m.v").alias("v")), keep_partitioning=True)


def subtract_tables(rows: DataFrame) -> DataFrame:
    """Recovered differences (g, bucket, block, pair, k, v, sign) of each run from the one before; pair is the later run's place, sign 1 for its rows and -1 for those of the earlier.

    Each bucket's table has three parts of ``width`` cells; a cell adds up signs and xors hashes of both runs, so equal rows cancel while they are aggregated, where they are: ``rows`` meet by bucket,
    so cells are not shuffled, and those that cancel are gone before tables are put together. Peeling recovers the rest. A bucket
    whose table does not empty is built again twice as wide, until all are empty, so the result is exact whatever part changed.
    """
    sides = F.array_compact(F.array(F.when(F.col("later"), F.struct(F.col("seq").alias("pair"), F.lit(1).alias("sign"))), F.when(F.col("earlier"), F.struct((F.col("seq") + 1).alias("pair"), F.lit(-1).alias("sign")))))
    sided = rows.select(*PLACE, "k", "v", F.explode(sides).alias("s")).select(*PLACE, "k", "v", "s.pair", "s.sign")
    done, failed = None, None
    for attempt in range(48):
        width = F.lit(WIDTH * GROWTH**attempt).cast("bigint")
        now = sided if failed is None else sided.join(failed, [*PLACE, "pair"], "left_semi")
        now = now.withColumn("e", F.xxhash64("k", "v")).withColumn("check", F.xxhash64("e", F.lit(99).cast("long")))
        spots = F.array(*(F.lit(j).cast("bigint") * width + F.pmod(F.xxhash64("e", F.lit(j).cast("long")), width) for j in range(SUBTABLES)))
        cells = now.withColumn("cell", F.explode(spots)).groupBy(*PLACE, "pair", "cell").agg(
            F.sum("sign").alias("n"), F.bit_xor("k").alias("xk"), F.bit_xor("v").alias("xv"), F.bit_xor("check").alias("xc")
        ).where("n <> 0 or xk <> 0 or xv <> 0 or xc <> 0")
        tables = cells.groupBy(*PLACE, "pair").agg(F.collect_list(F.struct("cell", "n", "xk", "xv", "xc")).alias("cells")).withColumn("width", width)
        peeled = checkpointed(tables.mapInArrow(_peel, "g long, bucket long, block long, pair long, ok boolean, k long, v long, sign int"))
        good = peeled.where("ok").drop("ok")
        done = good if done is None else done.unionByName(good)
        failed = peeled.where("not ok").select(*PLACE, "pair")
        if failed.isEmpty():
            return done
    raise RuntimeError("lookup tables did not empty; the digests of some rows collide")


def snapshot_changes(snapshots: DataFrame, runs: DataFrame, digest: Column, key: str = "unique_id", run: str = "run_id", group: str = "root", order: str = "generated_at") -> DataFrame:
    """Keys added, removed or changed between consecutive runs of a group: (run_id, unique_id, change).

    ``runs`` lists the runs in time; one without rows in ``snapshots`` is an empty snapshot, and each group's first run has no
    changes. Repeated and late deliveries add up. Rows without run or key are ignored, as are runs without group or time;
    runs of a group at the same instant follow each other by run id. Recovered keys are looked up in the hashed rows, and a key counts
    only with the digest that was recovered. Empty tables give an empty result.
    """
    ordered = run_order(snapshots, runs, run, group, order)
    rows = placed_rows(snapshots, ordered, run, key, digest)
    diff = subtract_tables(rows).withColumn("seq", F.when(F.col("sign") == 1, F.col("pair")).otherwise(F.col("pair") - 1))
    named = rows.join(small(diff), [*PLACE, "seq", "k", "v"]).groupBy(*PLACE, "pair", "key").agg(F.max(F.col("sign") == 1).alias("now"), F.max(F.col("sign") == -1).alias("then"))
    change = F.when(F.col("now") & F.col("then"), "changed").when(F.col("now"), "added").otherwise("removed")
    names = small(ordered.select("g", F.col("seq").alias("pair"), "name"))
    return named.join(names, ["g", "pair"]).select(F.col("name").alias(run), F.col("key").alias(key), change.alias("change"))


def node_digest() -> Column:
    """Digest of an architecture node."""
    return content_digest(["node_type", "node_name", "description"], ["interfaces"], ["confidence"])
