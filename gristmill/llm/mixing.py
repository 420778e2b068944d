"""Mixing sources to target weights: the cube method chooses which documents get one copy more, balanced on tokens and documents."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.bpe import RANKS_PATH, count_tokens
from gristmill.session import checkpointed

#: Documents of a block in the flight phase, about, and blocks whose leftovers meet in the next.
BLOCK_DOCS, FAN_IN = 4096, 512
EPS = 1e-9


def plan_mix(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Copies of each source's documents, on average, so that the mix has ``total`` tokens in the target shares as far as caps allow.

    ``sizes`` has the tokens of each source, ``targets`` (share, most repeats). A source that cannot fill its share gives all it may, and the rest goes to the
    others in proportion to their shares, until the total is full or every source is at its cap. Without ``total`` it is the tokens of all targeted sources.
    """
    caps = {s: sizes.get(s, 0) * max(0, r) for s, (_, r) in targets.items()}
    whole = float(sum(sizes.get(s, 0) for s in targets) if total is None else total)
    given: dict[str, float] = dict.fromkeys(targets, 0.0)
    free = {s for s, (share, _) in targets.items() if share > 0 and caps[s] > 0}
    left = whole
    while free and left > EPS:
        weight = sum(targets[s][0] for s in free)
        full = {s for s in free if left * targets[s][0] / weight >= caps[s]}
        if not full:
            given |= {s: left * targets[s][0] / weight for s in free}
            break
        for s in full:
            given[s] = float(caps[s])
        left -= sum(caps[s] for s in full)
        free -= full
    return {s: given[s] / sizes[s] if sizes.get(s) else 0.0 for s in targets}


def _direction(tokens: list[float]) -> list[float]:
    """A vector of the null space of the constraints: its parts sum to 0, and so do they times the tokens."""
    if len(tokens) == 3:
        a, b, c = tokens
        u = [c - b, a - c, b - a]
        if any(abs(x) > EPS for x in u):
            return u
        return [1.0, -1.0, 0.0]
    return [1.0, -1.0]


def _step(active: list[list], rng: random.Random) -> None:
    """Move the probabilities of ``active`` [key, tokens, p] along the null space until one is 0 or 1, up or down at random so that expectations stay."""
    u = _direction([a[1] for a in active])
    up = min((1 - a[2]) / x if x > 0 else a[2] / -x for a, x in zip(active, u, strict=True) if abs(x) > EPS)
    down = min(a[2] / x if x > 0 else (1 - a[2]) / -x for a, x in zip(active, u, strict=True) if abs(x) > EPS)
    go = up if rng.random() * (up + down) < down else -down
    for a, x in zip(active, u, strict=True):
        a[2] = min(1.0, max(0.0, a[2] + go * x))
        if a[2] < EPS:
            a[2] = 0.0
        elif a[2] > 1 - EPS:
            a[2] = 1.0


def fly(units: Iterator[list], rng: random.Random, last: bool = False) -> Iterator[list]:
    """Flight phase over units [key, tokens, p] in order, at most three at a time; at its end two may be left with 0 < p < 1.

    ``last`` also does the landing: the token constraint is dropped, then that of the number of documents.
    """
    active: list[list] = []
    for unit in units:
        if EPS < unit[2] < 1 - EPS:
            active.append(unit)
        else:
            unit[2] = round(unit[2])
            yield unit
        while len(active) == 3:
            _step(active, rng)
            yield from (a for a in active if a[2] in (0.0, 1.0))
            active = [a for a in active if a[2] not in (0.0, 1.0)]
    if last:
        while len(active) == 2:
            _step(active, rng)
            yield from (a for a in active if a[2] in (0.0, 1.0))
            active = [a for a in active if a[2] not in (0.0, 1.0)]
        for a in active:
            a[2] = 1.0 if rng.random() < a[2] else 0.0
    yield from active


def _flight(seed: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("source", "block", "key", "n_tokens", "p", "base")), strict=True)

        pending: list[tuple] = []
        stream = rows()
        row = next(stream, None)
        while row is not None:
            source, block = row[0], row[1]

            def group(source: str = source, block: int = block) -> Iterator[list]:
                nonlocal row
                while row is not None and row[0] == source and row[1] == block:
                    unit = [(row[2], row[5]), float(row[3]), float(row[4])]
                    row = next(stream, None)
                    yield unit

            for (key, base), tokens, p in fly(group(), random.Random(f"{seed}:{source}:{block}:{last}"), last):
                pending.append((source, block, key, int(tokens), p, base))
                if len(pending) >= 50_000:
                    yield _batch(pending)
                    pending = []
        if pending:
            yield _batch(pending)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names=["source", "block", "key", "n_tokens", "p", "base"])


_SCHEMA = "source string, block bigint, key bigint, n_tokens bigint, p double, base int"


def balanced_copies(units: DataFrame, seed: int = 7) -> DataFrame:
    """(source, key, n_tokens, copies) of units (source, key, n_tokens, rate): floor(rate) copies, and one more with probability the fraction.

    Within each source the extra copies are balanced on documents and tokens by the cube method. Blocks of documents fly in parallel, however large their source, and leave two
    undecided documents at most; those of 512 blocks fly together again, until one block of a source is left, which lands.
    """
    counts = units.groupBy("source").agg(F.count("*").alias("n"))
    n_max = counts.agg(F.max("n")).first()[0] or 0
    levels, blocks = 0, -(-n_max // BLOCK_DOCS)
    while blocks > 1:
        blocks, levels = -(-blocks // FAN_IN), levels + 1
    spread = F.pmod(F.xxhash64(F.lit(seed), "key"), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_DOCS)))
    todo = units.join(counts, "source").select("source", spread.cast("bigint").alias("block"), "key", "n_tokens", (F.col("rate") - F.floor("rate")).alias("p"), F.floor("rate").cast("int").alias("base"))
    done = None
    for level in range(levels + 1):
        last = level == levels
        order = F.xxhash64(F.lit(seed + 1), "key", "n_tokens")
        flown = todo.repartition("source", "block").sortWithinPartitions("source", "block", order, "key", "n_tokens").mapInArrow(_flight(seed + level, last), _SCHEMA)
        if last and done is None:
            done = flown
            break
        flown = checkpointed(flown)
        settled = flown if last else flown.where("p = 0 or p = 1")
        done = settled if done is None else done.unionByName(settled)
        todo = flown.where("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / FAN_IN).cast("bigint"))
    return done.select("source", "key", "n_tokens", (F.col("base") + F.col("p").cast("int")).alias("copies"))


def mix_sources(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7, ranks_path: str = RANKS_PATH, key: str = "doc_id") -> DataFrame:
    """The mix: (doc_id, source, n_tokens, copies), copies >= 1 and at most the source's ``max_repeats``.

    ``targets`` has (source, target_share, max_repeats), a bounded list of settings; of repeated sources the first in order counts, and null sources, shares and repeats mix nothing. Sizes are tokens of byte_bpe_50k of whole texts. Documents of
    other sources or without any token (null and empty texts) are not in the mix. See ``plan_mix`` for the total. Each row is a document, so a repeated row may come twice. Empty
    tables give an empty mix; columns of other names are ignored.
    """
    want = targets.where("source is not null and target_share is not null and max_repeats is not null").groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t"))
    sized = count_tokens(docs.join(want.select("source"), "source", "left_semi"), keep=(key, "source"), ranks_path=ranks_path).where("n_tokens > 0")
    sized = checkpointed(sized.select(F.col(key).cast("bigint").alias("key"), "source", "n_tokens"))
    # one row for each target: bounded by the settings, not by the data
    rules = {r["source"]: (r["t"]["target_share"], r["t"]["max_repeats"]) for r in want.collect()}
    sizes = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    rates = plan_mix(sizes, rules, total_tokens)
    pairs = [x for s, r in rates.items() if r > 0 for x in (F.lit(s), F.lit(float(r)))]
    if not pairs:
        return sized.where("false").select(F.col("key").alias(key), "source", "n_tokens", F.lit(0).alias("copies"))
    units = sized.withColumn("rate", F.create_map(*pairs)[F.col("source")]).where(F.col("rate").isNotNull())
    return balanced_copies(units, seed).where("copies > 0").select(F.col("key").alias(key), "source", "n_tokens", "copies")


def mix_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source of ``targets`` got: (source, target_share, max_repeats, n_docs, n_copies, tokens, actual_share)."""
    per = mix.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    whole = per.agg(F.sum("tokens").alias("whole"))
    joined = targets.select("source", "target_share", "max_repeats").join(per, "source", "left").join(whole, F.lit(True), "left")
    return joined.select("source", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_docs", "n_copies", "tokens")), F.round(F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)), 6).alias("actual_share"))
