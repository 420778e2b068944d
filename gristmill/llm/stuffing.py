"""Keyword-stuffed and link-list pages: recurrence gaps, positional autocorrelation over lag windows, lists without function words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Lags of the autocorrelation, tokens of a window, and the shares that make a window one of keywords.
LAGS, WINDOW = 24, 17
MOST_FUNCTION, LEAST_RECURRENT, LEAST_REGULAR, LEAST_LIST = 0.10, 0.35, 0.25, 12
#: Share of words that a list sign or the end of a line follows, from which words without function words are a list of items; prose in a language without listed function words stays below it.
LEAST_APART = 0.2
#: Greatest usual distance between a slogan's phrases, in tokens.
SLOGAN_GAP = 8
#: Share of a page's characters beyond which it is spam.
THRESHOLD = 0.5

FEATURES = ("keyword", "link", "tag", "product", "spam", "peak", "function")

# Function words of the languages that are told from keywords by them.
FUNCTION_WORDS = frozenset(
    "a an the this that these those it its he she they we you i me my our your his her their them us of to in on at by for from with without into onto over under after before until since during between about as and or but nor so if then than because while when where who whom whose which what why how is are was were be been being am do does did done has have had having will would can could may might must shall should not no nobody nothing each every all any both some such only never always again once twice more most less least very too also just there here "
    "der die das den dem des ein eine einer eines einem einen und oder aber doch sondern ist sind war waren wird werden wurde wurden hat haben nicht kein keine keiner es er sie wir ihr man sich aus bei mit nach seit von zu zum zur vom im in am an auf für über unter ohne durch um bis als wie wenn weil dass daß ob noch nie nur auch so also deshalb sobald "
    "le la les l un une des du de d et ou mais donc or ni car est sont était étaient a ont avait sera seront ne pas plus jamais sans que qui quoi dont où ce cet cette ces il elle ils elles on nous vous je tu son sa ses leur leurs au aux dans sur sous par pour avec entre après avant dès y en se s n c qu lui "
    "el la los las lo un una unos unas y e o u pero sino que quien cual cuyo de del al a en con sin por para sobre entre tras desde hasta es son era eran fue fueron ser está están ha han había no ni se su sus le les me te nos más muy ya así cuando donde como si porque dos nunca "
    "il lo gli i un uno una e o ma che di da in con su per tra fra è sono era non si del della dei delle al alla nel nella più mai "
    "o a os as um uma e ou mas que de do da dos das em no na nos nas com sem por para é são foi foram não se ao à mais nunca "
    "de het een en of maar dat die is zijn was waren niet geen van voor met op in aan bij uit naar te door om als ook nog nooit "
    "i a w z na do od po za nie się jest są był była to że jak ale oraz lub dla przez przy "
    "ο η το οι τα του της των τον την τους τις στο στη στον στην στα στις και δεν μη από με για που να θα είναι ήταν αλλά σε ως οπότε μετά πριν ποτέ αν ότι όπως ένα μια ένας "
    "и в на не с по из за от до для что это как но или если он она они мы вы был была было были будет без при под над же бы ".split()
)
_LINK = re.compile(r"https?://[^\s<>()\[\]'\"]+|www\.[^\s<>()\[\]'\"]+", re.I)
_MARKUP = re.compile(r"</?[a-z][^<>]*>|&[a-z]+;", re.I)
_BULLET = re.compile(r"^[\s>]*(?:[-*•+]|\d+[.)]|\[\d+\])?\s*")
# a word with its combining marks, the end of a sentence (in Latin, Greek, Han, Arabic, Indic, Armenian and Ethiopic writing), or a sign between the items of a list
_MARKS = r"\u0300-\u036f\u0483-\u0489\u0591-\u05c7\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed\u0900-\u0903\u093a-\u094f\u0951-\u0963\u0981-\u0dff\u0e31-\u0e4e\u0eb1-\u0ecd\u0f18-\u0fbc\u102b-\u109d\u17b4-\u17d3"
_TOKEN = re.compile(rf"[^\W_]+(?:['’{_MARKS}]+[^\W_]+)*[{_MARKS}]*|" + r"[.!?…:؟۔।॥։።](?=[\"'”»)\]]*(?:\s|$))|[。！？]|[,;|/·•、，،؛]|(?<=\s)[-–—>](?=\s)")
_ENDS = frozenset(".!?…:؟۔।॥։።。！？")
_SIGNS = frozenset(",;|/·•、，،؛-–—>")
_PUNCT = _ENDS | _SIGNS
_CLOSED = tuple(_ENDS - {":"})
_TAG = re.compile(r"(?<![\w&/])#[^\W\d_]\w*")
_LOG = re.compile(r"^\s*\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d")
_RULER = frozenset(" \t|:+-=")
_PRICE = re.compile(r"[$€£¥₹]\s?\d|\d\s?[$€£¥₹]|(?<![\d.,])\d+[.,]\d\d(?![\d.,])")
_CODE = re.compile(
    r"[{};]\s*$|^\s*[}\])]+[,;]?\s*$|^\s*(?:@\w|import\s|from\s+[\w.]+\s+import|package\s|def\s|class\s|return\b|public\s|private\s|const\s|let\s|var\s|if\s*\(|for\s*\(|export\s|async\s|func\s|#include|//|/\*|\*/|```|\$\s)|^\s*\"[^\"]+\"\s*:|=>|->|\w\(.*\)\s*[:;{]?\s*$|^\s*[\w.\-]+\s*=\s*\S+\s*$|^\s*-?\s*[\w.\-]+:(?:\s+[^\s]+)?\s*$|^\s*#\s*\S+\s*$"
)
_BRACES = re.compile(r"[{}\])]+[,;]?$")
_ENTRY = re.compile(r"^\s*(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+/|^\s*\d+\.\d+(?:\.\d+)?\s+-\s+\w+:", re.I)
_SPACELESS = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")


def _is_ruler(line: str) -> bool:
    """Whether a line rules off a table's head; some of its cells may have been spoilt."""
    if "---" not in line:
        return False
    if _RULER.issuperset(line.strip()):
        return True
    cells = [c.strip() for c in line.strip().strip("|").split("|")]
    return len(cells) > 1 and 2 * sum(bool(c) and _RULER.issuperset(c) for c in cells) >= len(cells)


def _is_statement(line: str) -> bool:
    """Whether a line without outer space ends like a statement or block of code."""
    return (line[-1] in "{};" and any(c in line[:-1] for c in "({=[")) or (len(line) < 80 and bool(_BRACES.match(line)))


@dataclass(slots=True)
class Line:
    """A line that holds something: its kind (neutral for code, configuration, logs, tables and entry lists, else text or a candidate: link, tag, product), size, tokens and marks."""

    kind: str
    size: int
    tokens: list[str] = ()
    marks: int = 0


def read_lines(text: str) -> list[Line]:
    """The lines of a text that are not blank. A candidate is only one: whether it counts follows from how its marks recur in the whole text."""
    lines = re.split(r"\r\n|\r|\n", text)
    out = []
    fenced = False
    columns = 0  # of the table that is open
    for i, raw in enumerate(lines):
        line = raw.strip()
        if not line:
            continue
        if line.startswith("```"):
            fenced, columns = not fenced, 0
            out.append(Line("neutral", len(line)))
            continue
        pipes = line.count("|")
        if pipes and not columns:
            if _is_ruler(line) or (i + 1 < len(lines) and "|" in lines[i + 1] and _is_ruler(lines[i + 1])):
                columns = pipes
        elif columns and not pipes:
            # a table goes on over blank lines, and over a cell that was broken off its row
            after = next((x for x in lines[i + 1 : i + 8] if x.strip()), "")
            if after.count("|") not in (columns, columns - 1):
                columns = 0
        if fenced or columns or (line[0] in "[0123456789" and _LOG.match(line)):
            out.append(Line("neutral", len(line)))
            continue
        rest = low = line.lower()
        links = _LINK.findall(line) if "://" in low or "www." in low else []
        if links:
            rest = _LINK.sub(" ", _BULLET.sub("", low, count=1))
        if "<" in rest or "&" in rest:
            rest = _MARKUP.sub(" ", rest)
        tokens = _TOKEN.findall(rest)
        many = len(tokens) - sum(map(_PUNCT.__contains__, tokens))
        function = sum(map(FUNCTION_WORDS.__contains__, tokens))
        tags = len(_TAG.findall(line)) if "#" in line else 0
        if links and ((many <= 2 and len(rest.strip()) < 25) or (many <= 6 * len(links) and function <= 0.1 * many and not rest.rstrip().endswith(_CLOSED))):
            out.append(Line("link", len(line), tokens, len(links)))
        elif tags and tags >= (0.6 if tags >= 3 else 0.9) * many:
            out.append(Line("tag", len(line), tokens, tags))
        elif pipes >= 2 and function <= 0.2 * max(1, many) and (prices := len(_PRICE.findall(line))):
            out.append(Line("product", len(line), tokens, prices))
        elif _ENTRY.match(raw) or _is_statement(line) or (not tags and function <= 0.34 * max(1, many) and _CODE.search(raw)):
            out.append(Line("neutral", len(line)))
        else:
            out.append(Line("text", len(line), tokens))
    return out


def recurrence_gaps(terms: np.ndarray) -> np.ndarray:
    """For each position the distance to the nearest position of the same term, before or behind; a large number if it is the only one."""
    n = len(terms)
    far = np.full(n, 1 << 30, np.int64)
    if n < 2:
        return far
    order = np.argsort(terms, kind="stable")
    same = terms[order][1:] == terms[order][:-1]
    step = np.where(same, order[1:] - order[:-1], 1 << 30)
    gaps = far.copy()
    gaps[order[1:]] = np.minimum(gaps[order[1:]], step)
    gaps[order[:-1]] = np.minimum(gaps[order[:-1]], step)
    return gaps


def _bounds(n: int, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First position, end and size of the window around each position, cut at the ends."""
    at = np.arange(n)
    lo, hi = np.maximum(0, at - width // 2), np.minimum(n, at + width // 2 + 1)
    return lo, hi, hi - lo


def _window(values: np.ndarray, bounds: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Mean of ``values``, along the last axis, over the window around each position."""
    sums = np.zeros((*values.shape[:-1], values.shape[-1] + 1), np.int32)
    np.cumsum(values, axis=-1, out=sums[..., 1:])
    lo, hi, size = bounds
    return (sums[..., hi] - sums[..., lo]) / size


def autocorrelation(terms: np.ndarray, content: np.ndarray, bounds: tuple[np.ndarray, np.ndarray, np.ndarray], lags: int = LAGS) -> tuple[float, np.ndarray]:
    """Positional autocorrelation: how often a term comes again just so many positions later.

    Gives the greatest value of any lag over the whole text, and for each position the greatest of its window, where content terms alone count.
    """
    n = len(terms)
    peak, best = 0.0, np.zeros(n)
    step = lags if n < 20_000 else 1  # all lags at once, but for texts whose matrix would be large
    for first in range(1, min(lags, n - 1) + 1, step):
        some = range(first, min(first + step, lags + 1, n))
        hits = np.zeros((len(some), n), bool)
        for row, lag in enumerate(some):
            np.equal(terms[lag:], terms[:-lag], out=hits[row, lag:])
        peak = max(peak, float((hits.sum(axis=1) / (n - np.array(some))).max()))
        hits &= content
        np.maximum(best, _window(hits, bounds).max(axis=0), out=best)
    return peak, best


def _slogans(terms: np.ndarray, content: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Which tokens stand in sentences built around a phrase that comes again and again in changing surroundings.

    A sentence that is merely repeated keeps the surroundings of its phrases, so repeated prose is none.
    """
    n, kinds = len(terms), int(terms.max()) + 1
    best = np.zeros(n, bool)
    least = 0.1 * min(n, 200)
    pairs = np.sort(terms[:-1] * kinds + terms[1:])
    need = math.ceil(max(4, least / 4))
    if len(pairs) < need or not (pairs[need - 1 :] == pairs[: len(pairs) - need + 1]).any():
        return best  # no phrase of any size comes often enough if no two words do
    words, told = terms.tolist(), content.tolist()
    for size in (4, 3, 2):
        grams = list(zip(*(words[k:] for k in range(size)), strict=False))
        often = {g for g, c in Counter(grams).items() if c >= 4 and c * size >= least}
        if not often:
            continue
        where: dict[tuple, list[int]] = {}
        for i, g in enumerate(grams):
            if g in often and told[i] and told[i + size - 1]:
                where.setdefault(g, []).append(i)
        for places in where.values():
            before = {words[i - 1] if i else -1 for i in places}
            behind = {words[i + size] if i + size < n else -1 for i in places}
            if len(places) < 4 or min(len(before), len(behind)) < 3 or np.median(np.diff(places)) > SLOGAN_GAP:
                continue
            inside = np.zeros(n, bool)
            for i in places:
                inside[i : i + size] = True
            per = np.bincount(sentence, weights=inside) / np.maximum(1, np.bincount(sentence))
            best |= per[sentence] >= 0.3
    return best


def recurring(lines: list[Line]) -> list[bool]:
    """For each line whether it is a candidate whose marks (links, tags or prices) come again and again: at least half of them have another of their kind within ``LAGS`` tokens."""
    at = 0
    places: dict[str, list[int]] = {}
    owners: dict[str, list[int]] = {}
    for n, line in enumerate(lines):
        if line.kind == "neutral":
            continue
        at += len(line.tokens)
        if line.marks:
            places.setdefault(line.kind, []).extend(range(at, at + line.marks))
            owners.setdefault(line.kind, []).extend([n] * line.marks)
            at += line.marks
    out = [False] * len(lines)
    for kind, spots in places.items():
        steps = np.diff(np.array(spots))
        near = np.zeros(len(spots), bool)
        near[1:] |= steps <= LAGS
        near[:-1] |= steps <= LAGS
        hits = np.bincount(owners[kind], weights=near, minlength=len(lines))
        for n in set(owners[kind]):
            out[n] = bool(hits[n] * 2 >= lines[n].marks)
    return out


def analyse(text: str | None, full: bool = True) -> dict[str, float]:
    """Features of a text: share of its characters in keywords, links, tags and products, their sum ``spam``, greatest autocorrelation, function-word share.

    Without ``full`` only what decides is worked out: whether ``spam`` is beyond the threshold is the same, but a value that cannot change
    that any more, and the last two features, may be left at 0.
    """
    out = dict.fromkeys(FEATURES, 0.0)
    if not text or not text.strip():
        return out
    lines = read_lines(text)
    total = sum(x.size for x in lines) or 1
    if any(x.marks for x in lines):
        for line, yes in zip(lines, recurring(lines), strict=True):
            if yes:
                out[line.kind] += line.size
            elif line.marks:
                line.kind = "text"
        for kind in ("link", "tag", "product"):
            out[kind] /= total
    out["spam"] = out["link"] + out["tag"] + out["product"]
    plain = [x for x in lines if x.kind == "text" and x.tokens]
    room = sum(x.size for x in plain) / total
    if not plain or (not full and (out["spam"] > THRESHOLD or out["spam"] + room <= THRESHOLD)):
        return out
    tokens = [t for x in plain for t in x.tokens]
    owner = np.repeat(np.arange(len(plain)), [len(x.tokens) for x in plain])
    punct = np.fromiter(map(_PUNCT.__contains__, tokens), bool, len(tokens))
    words = [t for t in tokens if t not in _PUNCT]
    n = len(words)
    if not n:
        return out
    line = owner[~punct]
    last = np.append(line[1:] != line[:-1], True)  # of its line
    at = np.cumsum(~punct) - 1  # the word that a sign stands behind
    behind = punct & (at >= 0)
    behind[behind] = line[at[behind]] == owner[behind]
    end = behind & np.fromiter(map(_ENDS.__contains__, tokens), bool, len(tokens))
    breaks, apart = np.zeros(n, bool), last.copy()  # whether a sentence ends, and whether a list sign or the end of a line follows
    breaks[at[end]] = True
    apart[at[behind & ~end]] = True
    sentence = np.append(0, np.cumsum(breaks | last)[:-1])
    chars = np.fromiter(map(len, words), np.int64, n) + 1
    chars[last] += (np.array([x.size for x in plain]) - np.bincount(line, weights=chars, minlength=len(plain)).astype(np.int64))[line[last]]
    ids: dict[str, int] = {}
    terms = np.array([ids.setdefault(w, len(ids)) for w in words])
    function = np.array([w in FUNCTION_WORDS for w in ids])[terms]
    bounds = _bounds(n)
    shares = _window(np.stack([function, breaks]), bounds)
    few = (shares[0] <= MOST_FUNCTION) & (shares[1] <= 0.04)
    spam = np.zeros(n, bool)
    spaceless = np.array([not w.isascii() and bool(_SPACELESS.search(w)) for w in ids])[terms]
    content = ~(function | np.array(list(map(str.isdigit, ids)))[terms])
    # where words are not set apart by spaces, a run between signs is a clause and no word of a slogan
    slogans = _slogans(terms, content & ~spaceless, sentence)
    if not full and out["spam"] + float(chars[few | slogans].sum() / total) <= THRESHOLD:
        return out  # even if every place that can be keywords were
    if full or few.any():
        recurrent = content & (recurrence_gaps(terms) <= LAGS)
        more = _window(np.stack([spaceless, recurrent, apart]), bounds)
        out["peak"], local = autocorrelation(terms, content, bounds)
        # keywords that come again soon or at regular distances, or short items one after the other without function word or end of a sentence far and wide
        listed = (shares[0] <= 0.02) & (more[2] >= LEAST_APART) & (more[0] < 0.2) & (n >= LEAST_LIST)
        spam = few & ((more[1] >= LEAST_RECURRENT) | (local >= LEAST_REGULAR) | listed)
    spam |= slogans
    out["keyword"] = float(chars[spam].sum() / total)
    out["function"] = float(function.mean())
    out["spam"] += out["keyword"]
    return out


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [analyse(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[c] for f in found], pa.float64()) for c in FEATURES)], names=[b.schema.names[0], *FEATURES])


def _decide(threshold: float):
    full = threshold != THRESHOLD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], names=b.schema.names[:1]).filter(pa.array([analyse(t.as_py(), full)["spam"] > threshold for t in b.column(1)], pa.bool_()))

    return run


def score_stuffing(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, keyword, link, tag, product, spam, peak, function) of each row; null, empty and blank texts score 0.

    Rows are judged one by one and whole, whatever their length, so there is no shuffle and no state; repeated rows come out repeated, other columns are not
    read, an empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, docs[text].alias("_text")).mapInArrow(_score, f"`{key}` {kind}, " + ", ".join(f"{c} double" for c in FEATURES))


def find_stuffed(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key) of the pages of which more than ``threshold`` is keywords, links or product tags, distinct."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, docs[text].alias("_text")).mapInArrow(_decide(threshold), f"`{key}` {kind}").distinct()
