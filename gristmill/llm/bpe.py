"""Byte-pair encoding of a corpus with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the public vocabulary lies on every machine; pass another path to the operators if it lies elsewhere.
RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte_bpe_50k cuts a text into pre-tokens.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens up to this many characters are remembered, at most so many at a time. This bounds memory and changes no result.
MEMO_CHARS, MEMO_WORDS = 48, 200_000
#: Ids in one output batch, about, and characters of one slice handed to the pre-tokenizer.
BATCH_IDS = 2_000_000


class RankQueue:
    """Positions by merge rank. Three levels of 64-bit words say which ranks have positions, so the least is found by three find-first-sets.

    Entries are not removed when they go out of date; ``Encoder`` skips them as they come out.
    """

    def __init__(self, ranks: int) -> None:
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        """Add a position; one rank's positions come out in ascending order."""
        b = self.buckets.get(rank)
        if b is None:
            self.buckets[rank] = [position]
            i = rank >> 6
            self.low[i] |= 1 << (rank & 63)
            self.mid[i >> 6] |= 1 << (i & 63)
            self.top |= 1 << (i >> 6)
        else:
            heappush(b, position)

    def pop(self) -> tuple[int, int] | None:
        """(rank, position) of the least rank, then the least position; None when empty."""
        top = self.top
        if not top:
            return None
        k = (top & -top).bit_length() - 1
        mid = self.mid[k]
        i = (k << 6) + (mid & -mid).bit_length() - 1
        low = self.low[i]
        rank = (i << 6) + (low & -low).bit_length() - 1
        b = self.buckets[rank]
        position = heappop(b)
        if not b:
            del self.buckets[rank]
            low &= low - 1
            self.low[i] = low
            if not low:
                mid &= mid - 1
                self.mid[k] = mid
                if not mid:
                    self.top = top & (top - 1)
        return rank, position


class _Memo(dict):
    """Ids by pre-token; what is not there yet is encoded, and kept if it is short."""

    def __init__(self, merge) -> None:
        super().__init__()
        self.merge = merge

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.merge(word.encode("utf-8", "surrogatepass")))
        if len(word) <= MEMO_CHARS:
            self[word] = ids
        return ids


class Encoder:
    """Encodes texts by a table of merge ranks, which are also the ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.memo = _Memo(self.merge)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: always the least rank merges first, then the leftmost; n bytes take about n steps, however long the piece."""
        ranks, longest = self.ranks, self.longest
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        pair = [-1] * (n + 1)
        push, pop = self.queue.push, self.queue.pop
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                push(r, i)
        while (least := pop()) is not None:
            rank, i = least
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            end = after[i] = after[j]
            pair[j] = -1
            if end <= n:
                before[end if end < n else n] = i
            pair[i] = -1
            if end < n and (stop := after[end]) - i <= longest:
                r = ranks.get(piece[i:stop])
                if r is not None:
                    pair[i] = r
                    push(r, i)
            h = before[i]
            if h >= 0:
                pair[h] = -1
                if end - h <= longest:
                    r = ranks.get(piece[h:end])
                    if r is not None:
                        pair[h] = r
                        push(r, h)
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(ranks[piece[i:j]])
            i = j
        return out

    def encode(self, text: str) -> array:
        """Ids of a text; strings that look like special tokens are ordinary text."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        return array("i", chain.from_iterable(map(self.memo.__getitem__, self.split(text))))


@lru_cache(maxsize=2)
def encoder(path: str = RANKS_PATH) -> Encoder:
    """The encoder of a vocabulary file, loaded once in each worker."""
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def _encode_batches(path: str, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            keep = [b.column(i) for i in range(b.num_columns - 1)]
            names = b.schema.names[:-1]
            ids, offsets, start = array("i"), [0], 0
            total = 0
            for row in range(len(texts)):
                text = texts[row].as_py()
                found = enc.encode(text) if text else ()
                total += len(found)
                if not count_only:
                    ids.extend(found)
                offsets.append(total)
                if len(ids) >= BATCH_IDS or row == len(texts) - 1:
                    size = row + 1 - start
                    if count_only:
                        data = pa.array([offsets[k + 1] - offsets[k] for k in range(size)], pa.int64())
                    else:
                        data = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)]))
                    yield pa.RecordBatch.from_arrays([c.slice(start, size) for c in keep] + [data], names=[*names, "n_tokens" if count_only else "ids"])
                    ids, offsets, start, total = array("i"), [0], row + 1, 0

    return run


def encode_documents(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks_path: str = RANKS_PATH) -> DataFrame:
    """(*keep, ids): the token ids of each row's text, without special tokens.

    Null and empty texts give an empty list, a blank text is encoded like any other, a text of any length is encoded whole. Rows are neither dropped nor
    merged, so repeated rows come out repeated. Only ``keep`` and ``text`` are read; an empty table gives an empty result. No shuffle.
    """
    narrow = docs.select(*keep, docs[text].alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(_encode_batches(ranks_path, False), f"{kinds}, ids array<int>")


def count_tokens(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks_path: str = RANKS_PATH) -> DataFrame:
    """(*keep, n_tokens): the number of token ids of each row's text, cases as for ``encode_documents``."""
    narrow = docs.select(*keep, docs[text].alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(_encode_batches(ranks_path, True), f"{kinds}, n_tokens bigint")
