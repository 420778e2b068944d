"""Trigram index over file chunks: regexes say which trigrams they need, postings are intersected, few chunks are left to read."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np

try:
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as sre_parser

#: A query over trigrams: True (anything may match), a trigram, ("and", parts) or ("or", parts).
Query = bool | str | tuple


def _all(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list[Query]) -> Query:
    if any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


#: A part of a regex that matches at most so many strings is spelled out.
EXACT = 64


def _exact(items) -> set[str] | None:
    """The strings that consecutive items match, in lower case, if they are few; else None."""
    out = {""}
    for op, arg in items:
        if op is sre.LITERAL:
            part = {chr(arg).lower()}
        elif op is sre.SUBPATTERN:
            part = _exact(arg[-1])
        elif op is sre.BRANCH:
            parts = [_exact(b) for b in arg[1]]
            part = None if any(x is None for x in parts) else set().union(*parts)
        elif op is sre.IN and all(o is sre.LITERAL or (o is sre.RANGE and a[1] - a[0] < EXACT) for o, a in arg):
            part = {chr(x).lower() for o, a in arg for x in ([a] if o is sre.LITERAL else range(a[0], a[1] + 1))}
        else:
            part = None
        if part is None or len(out) * len(part) > EXACT:
            return None
        out = {a + b for a in out for b in part}
    return out


def _needs(strings: set[str]) -> Query:
    """The trigrams of whichever of some strings is there; True if one of them is too short to have any."""
    return _any([_all([x[i : i + 3] for i in range(len(x) - 2)]) for x in sorted(strings)])


def _sequence(items) -> Query:
    """Trigrams needed by consecutive items: those of each run that is spelled out, and of each branch or repeated group."""
    parts: list[Query] = []
    runs = {""}

    def close() -> None:
        nonlocal runs
        parts.append(_needs(runs))
        runs = {""}

    for op, arg in items:
        few = _exact([(op, arg)])
        if few is not None and len(runs) * len(few) <= EXACT:
            runs = {a + b for a in runs for b in few}
            continue
        if op is sre.ASSERT and arg[0] == 1 and (ahead := _exact(arg[1])) is not None and len(runs) * len(ahead) <= EXACT:
            parts.append(_needs({a + b for a in runs for b in ahead}))
        close()
        if op is sre.SUBPATTERN:
            parts.append(_sequence(arg[-1]))
        elif op is sre.BRANCH:
            parts.append(_any([_sequence(b) for b in arg[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] >= 1:
            parts.append(_sequence(arg[2]))
        elif op is sre.ATOMIC_GROUP:
            parts.append(_sequence(arg))
    close()
    return _all(parts)


def required_trigrams(pattern: str, flags: int = 0) -> Query:
    """The trigrams, in lower case, without which ``pattern`` cannot match; True if it needs none."""
    return _sequence(sre_parser.parse(pattern, flags))


def trigrams_of(query: Query) -> set[str]:
    """All trigrams that a query asks for."""
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


# Bytes fold to 6 bits: letters without case, digits, and signs by their low bits. Strangers may share a class, which lets
# more chunks through to the regexes but loses none.
_FOLD = np.array([(b | 0x20) & 0x3F if chr(b).isalpha() and b < 128 else b & 0x3F for b in range(256)], dtype=np.uint8)


def _code(trigram: str) -> int | None:
    raw = trigram.encode("utf-8")
    return None if len(raw) != 3 else int(_FOLD[raw[0]]) << 12 | int(_FOLD[raw[1]]) << 6 | int(_FOLD[raw[2]])


@dataclass
class Segment:
    """Postings of one block of chunks: for each indexed trigram a bitmap of the chunks that have it."""

    size: int
    postings: np.ndarray
    place: dict[str, int]

    def lookup(self, query: Query) -> np.ndarray:
        """Bitmap of the chunks that may match, by intersecting and uniting postings."""
        if query is True:
            return np.full(self.postings.shape[1], 255, np.uint8)
        if isinstance(query, str):
            return self.postings[self.place[query]]
        parts = [self.lookup(q) for q in query[1]]
        return reduce(np.bitwise_and if query[0] == "and" else np.bitwise_or, parts)

    def candidates(self, query: Query) -> np.ndarray:
        """Numbers of the chunks that may match."""
        return np.flatnonzero(np.unpackbits(self.lookup(query), count=self.size, bitorder="little"))


class Indexer:
    """Builds segments over the trigrams that some queries ask for; no other trigram is ever looked up, so no other is posted."""

    def __init__(self, queries: list[Query]) -> None:
        wanted = sorted(set().union(*map(trigrams_of, queries)))
        codes = {t: c for t in wanted if (c := _code(t)) is not None}
        self.order = sorted(set(codes.values()))
        rank = {c: i for i, c in enumerate(self.order)}
        self.place = {t: rank[c] for t, c in codes.items()}
        self.table = np.full(1 << 18, -1, np.int16)
        self.table[self.order] = np.arange(len(self.order), dtype=np.int16)

    def segment(self, chunks: list[bytes]) -> Segment:
        """Index a block of chunks in one pass over their bytes."""
        n = len(chunks)
        bits = np.zeros((len(self.order), n), dtype=bool)
        joined = np.frombuffer(b"\0\0".join(chunks), np.uint8)
        folded = _FOLD[joined].astype(np.int32)
        if len(folded) > 2:
            hit = self.table[folded[:-2] << 12 | folded[1:-1] << 6 | folded[2:]]
            at = np.flatnonzero(hit >= 0)
            starts = np.cumsum([0] + [len(c) + 2 for c in chunks[:-1]]) if n else np.zeros(0)
            bits[hit[at], np.searchsorted(starts, at, side="right") - 1] = True
        return Segment(n, np.packbits(bits, axis=1, bitorder="little"), self.place)


def check_needs_trigrams(name: str, pattern: str, flags: int = 0) -> Query:
    """The query of a detection regex; an index is no use to one without, so that is an error."""
    q = required_trigrams(pattern, flags)
    if q is True:
        raise ValueError(f"{name} needs no trigram")
    re.compile(pattern, flags)
    return q
