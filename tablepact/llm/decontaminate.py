"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are normalised to lower-case words with single blanks.  The windows of a benchmark item are
all its stretches of ``window`` characters (a shorter item is one window); a document is
contaminated if one of its substrings is within the edit budget of a window, ``error_percent``
of the window's length.  So a verbatim excerpt of ``window`` characters less the budget is found
wherever in the item it begins.

**Filter.**  A substring within e edits of a window of m characters shares at least
m + 1 - q(e + 1) of its q-grams, all on diagonals (place in the document less place in the
item) that differ by at most e.  The tasks look up every q-gram of every document, count the
shared ones of each window in overlapping bands of diagonals, sliding along the item, and retain
the windows that reach the bound: no match is lost.  **Verification.**  A retained window is aligned by the
edit-distance recurrence restricted to the band's diagonals, all of some documents at a time.

The items, long ones in pieces that share no window, are dealt into parts of about ``part_chars`` characters by a hash; one part at a
time is sent to the executors, so what is broadcast has a fixed bound however large the
benchmark, and documents are mapped without a shuffle.  Only matches are grouped.

Defined cases: items of fewer than ``min_chars`` normalised characters match as a whole, without edits
and not within a word (scripts that set no blanks aside); an item without a word matches nothing; of
several texts under one id the larger number of windows counts; a null id is a document or item of its own; null or empty text has no
match; repeated rows of a document give one row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.llm.common import materialise, texts_of

WINDOW = 96
Q = 8
ERROR_PERCENT = 10
MIN_CHARS = 24
PART_CHARS = 400_000
#: Windows that begin in one piece of an item.
PIECE = 4096
#: Diagonals of a band, besides the edit budget that neighbouring bands share.
BAND = 16

WORD = re.compile(r"\w+")
#: Letters of scripts that set no blanks between words.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
BASE = np.uint64(0x9E3779B97F4A7C15)
PAD = 0  # between documents; no word character


def normalise(text: str | None) -> str:
    return " ".join(WORD.findall((text or "").lower()))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgram_keys(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit key for the q-gram at each place."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64)
    keys = wide[:n].copy()
    for k in range(1, q):
        keys *= BASE
        keys += wide[k : n + k]
    return keys * BASE


def budget(length: int, q: int, error_percent: int) -> int:
    """Edits allowed in a window: the percentage, but few enough for the bound to be one q-gram at least."""
    return max(0, min(length * error_percent // 100, length // q - 1))


def cut_windows(text: str, window: int) -> list[tuple[int, str]]:
    """(start, window) at every start; what is searched for, though the search never lists them."""
    return [(s, text[s : s + window]) for s in range(max(1, len(text) - window + 1))]


def cut_pieces(text: str, window: int, piece: int = PIECE) -> list[tuple[int, str]]:
    """(start, piece): each window of the text lies in one piece."""
    return [(s, text[s : s + piece + window - 1]) for s in range(0, max(1, len(text) - window + 1), piece)]


@dataclass
class Windows:
    """A part of the benchmark's pieces with their q-grams in key order."""

    texts: list[str]
    q: int
    error_percent: int
    window: int = WINDOW
    min_chars: int = MIN_CHARS

    def __post_init__(self):
        self.lengths = np.array([min(len(t), self.window) for t in self.texts], np.int64)  # of a window
        self.starts = np.array([len(t) for t in self.texts], np.int64) - self.lengths  # the last of a piece
        short = [len(t) < max(self.min_chars, self.q) for t in self.texts]
        self.edits = np.array([0 if s else budget(n, self.q, self.error_percent) for s, n in zip(short, self.lengths.tolist())], np.int64)
        self.bound = self.lengths + 1 - self.q * (self.edits + 1)
        self.longest = max(map(len, self.texts), default=0)
        keys = [np.zeros(0, np.uint64) if s else qgram_keys(points(t), self.q) for s, t in zip(short, self.texts)]
        every = np.concatenate([*keys, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        place = np.concatenate([np.arange(len(k)) for k in keys] + [np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order].astype(np.int32), place[order].astype(np.int32)
        self.keys, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every)).astype(np.int64)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.keys >> np.uint64(42)] = True
        #: Short texts by the length of the start that is looked up, and by its key.
        self.short: dict[int, dict[int, list[int]]] = {}
        for k in np.flatnonzero(short).tolist():
            n = min(len(self.texts[k]), self.q)
            if n:
                self.short.setdefault(n, {}).setdefault(int(qgram_keys(points(self.texts[k][:n]), n)[0]), []).append(k)

    def bands(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, start in it, first diagonal of the window) of the windows that share enough q-grams with a band of ``codes``."""
        none = np.zeros(0, np.int64)
        keys = qgram_keys(codes, self.q)
        at = np.flatnonzero(self.maybe[keys >> np.uint64(42)])
        key = keys[at]
        found = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        real = self.keys[found] == key
        at, found = at[real], found[real]
        counts = self.first[found + 1] - self.first[found]
        ends = np.cumsum(counts)
        if not len(ends) or not ends[-1]:
            return none, none, none
        entry = np.arange(ends[-1]) - np.repeat(ends - counts - self.first[found], counts)
        owner, place = self.owner[entry].astype(np.int64), self.place[entry].astype(np.int64)
        diagonal = np.repeat(at, counts) - place + self.longest  # not negative
        band = diagonal // BAND
        low = band * BAND
        span = (len(codes) + self.longest) // BAND + 2
        hits = [(owner * span + band) * self.longest + place]
        # a band holds BAND + edits diagonals, so a diagonal is in the bands before too, as far as the budget goes
        for back in range(1, -(-int(self.edits.max()) // BAND) + 1):
            also = (diagonal - low + (back - 1) * BAND < self.edits[owner]) & (band >= back)
            hits.append(((owner * span + band - back) * self.longest + place)[also])
        hit = np.concatenate(hits)
        hit.sort()  # np.unique hashes, which takes several times as long
        hit = hit[np.concatenate(([True], hit[1:] != hit[:-1]))]
        pair, place = hit // self.longest, hit % self.longest
        owner = pair // span
        # the hits that reach the bound from each one, and the starts of windows that hold them all
        last = np.arange(len(hit)) + self.bound[owner] - 1
        whole = last < len(hit)
        last[~whole] = 0
        whole &= pair[last] == pair
        reach = (self.lengths - self.q)[owner]
        whole &= place[last] - place <= reach
        pair, owner = pair[whole], owner[whole]
        begin, end = np.maximum(place[last[whole]] - reach[whole], 0), np.minimum(place[whole], self.starts[owner])
        again = np.flatnonzero(pair[1:] == pair[:-1]) + 1
        begin[again] = np.maximum(begin[again], end[again - 1] + 1)  # both grow within a pair
        counts = np.maximum(end - begin + 1, 0)
        start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - begin, counts)
        return np.repeat(owner, counts), start, np.repeat(pair % span * BAND - self.longest, counts) + start

    def align(self, codes: np.ndarray, piece: np.ndarray, start: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least edits, end in ``codes``) of each window: against any substring, on the band's diagonals."""
        edits, end = np.zeros(len(piece), np.int64), np.zeros(len(piece), np.int64)
        for length in np.unique(self.lengths[piece]).tolist():
            mine = np.flatnonzero(self.lengths[piece] == length)
            e = budget(length, self.q, self.error_percent)
            width = BAND + 3 * e  # the band, and a budget's drift on both sides
            pattern = np.stack([points(self.texts[w][s : s + length]) for w, s in zip(piece[mine].tolist(), start[mine].tolist())])
            origin = low[mine] - e
            places = origin[:, None] + np.arange(length + width)
            inside = (places >= 0) & (places < len(codes))
            text = np.where(inside, codes[np.clip(places, 0, len(codes) - 1)], PAD)
            small = np.int16 if 2 * (length + width) < 1 << 15 else np.int64
            step = np.arange(width, dtype=small)
            now = np.zeros((len(mine), width), small)
            for i in range(length):
                best = now + (text[:, i : i + width] != pattern[:, i : i + 1])
                np.minimum(best[:, :-1], now[:, 1:] + small(1), out=best[:, :-1])
                best -= step
                now = np.minimum.accumulate(best, axis=1)
                now += step
            edits[mine] = now.min(axis=1)
            end[mine] = origin + now.argmin(axis=1) + length
        return edits, end

    def short_matches(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(piece, end in ``codes``) of the short texts."""
        if not self.short:
            return
        joined = codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        free = lambda i: not 0 < i < len(joined) or any(c in " \0" or UNSPACED.match(c) for c in joined[i - 1 : i + 1])
        for n, texts in self.short.items():
            keys = qgram_keys(codes, n)
            for at in np.flatnonzero(np.isin(keys, np.array(list(texts), np.uint64))).tolist():
                for k in texts[int(keys[at])]:
                    end = at + len(self.texts[k])
                    if joined.startswith(self.texts[k], at) and free(at) and free(end):
                        yield k, end

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text number, piece number, edits, end in the normalised text) of every window that matches, the best for each window and text."""
        gap = np.full(int(self.edits.max(initial=0)) + 1, PAD, np.uint32)
        pieces = [piece for t in texts for piece in (points(normalise(t)), gap)]
        starts = np.cumsum([0, *map(len, pieces)])[:-1][::2]
        codes = np.concatenate(pieces)
        best: dict[tuple[int, int, int], tuple[int, int]] = {}
        for piece, end in self.short_matches(codes):
            text = int(np.searchsorted(starts, end - 1, side="right")) - 1
            best.setdefault((text, piece, 0), (0, int(end - starts[text])))
        piece, start, low = self.bands(codes) if len(self.keys) else (np.zeros(0, np.int64),) * 3
        for at in range(0, len(piece), 1000):
            some = slice(at, at + 1000)
            edits, end = self.align(codes, piece[some], start[some], low[some])
            good = np.flatnonzero(edits <= self.edits[piece[some]])
            text = np.searchsorted(starts, end[good] - 1, side="right") - 1
            for t, w, s, e, z in zip(text.tolist(), piece[some][good].tolist(), start[some][good].tolist(), edits[good].tolist(), (end[good] - starts[text]).tolist()):
                if (t, w, s) not in best or best[t, w, s] > (e, z):
                    best[t, w, s] = e, z
        for (t, w, _), (e, z) in best.items():
            yield t, w, e, z

    def stretches(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """(text number, piece number, windows that match, least edits, first and last character) for each text and piece."""
        out: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for t, w, e, end in self.matches(texts):
            first = max(0, end - int(self.lengths[w]))
            n, least, low, high = out.get((t, w), (0, e, first, end))
            out[t, w] = n + 1, min(least, e), min(low, first), max(high, end)
        return [(*k, *v) for k, v in out.items()]


def groups_of(texts: list[str], chars: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first, texts) of about ``chars`` characters each."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield first, texts[first : i + 1]
            first, total = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def benchmark_parts(benchmark: DataFrame, window: int, q: int, error_percent: int, min_chars: int, part_chars: int) -> Iterator[tuple[list[tuple], Windows]]:
    """Parts of the benchmark: ((item_id, start) of each piece, the pieces)."""
    out = pa.schema([("item_id", pa.int64()), ("start", pa.int64()), ("text", pa.string())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, s, w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                    if (n := normalise(t)) for s, w in cut_pieces(n, window)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    cuts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(cut, "item_id long, start long, text string")
    pieces = materialise(cuts.distinct(), "benchmark-windows")
    total = pieces.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // part_chars)
    part = F.pmod(F.xxhash64("item_id", "start", "text"), F.lit(max(1, parts)))
    for p in range(parts):
        rows = pieces.where(part == p).orderBy("item_id", "start", "text").collect()  # about part_chars characters
        if rows:
            yield [(r[0], r[1]) for r in rows], Windows([r[2] for r in rows], q, error_percent, window, min_chars)


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, q: int = Q, error_percent: int = ERROR_PERCENT,
          min_chars: int = MIN_CHARS, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, item_id, n_windows, edits, first_char, last_char): a row for each document and item that match.

    ``n_windows`` matched windows of the item, ``edits`` the fewest of one, and the stretch of the normalised
    text that the matches cover.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start long, n_windows long, edits int, first_char long, last_char long"
    arrow = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("n_windows", pa.int64()), ("edits", pa.int32()),
                       ("first_char", pa.int64()), ("last_char", pa.int64())])
    found = None
    for names, windows in benchmark_parts(benchmark, window, q, error_percent, min_chars, part_chars):

        def search(batches: Iterable[pa.RecordBatch], names=names, windows=windows) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, done = b.column(0).to_pylist(), 0
                for texts in texts_of(b.column(1)):
                    rows = [(ids[done + first + t], *names[w], *found)
                            for first, some in groups_of(texts) for t, w, *found in windows.stretches(some)]
                    done += len(texts)
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    covered = [F.min("edits").alias("edits"), F.min("first_char").alias("first_char"), F.max("last_char").alias("last_char")]
    return (found.groupBy("doc_id", "item_id", "start").agg(F.max("n_windows").alias("n_windows"), *covered)
                 .groupBy("doc_id", "item_id").agg(F.sum("n_windows").alias("n_windows"), *covered))


def contaminated_column(text: Column, windows: Windows) -> Column:
    """Whether a text matches one of the windows."""

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            hit, done = np.zeros(len(column), bool), 0
            for texts in texts_of(column):
                for first, some in groups_of(texts):
                    for t, *_ in windows.matches(some):
                        hit[done + first + t] = True
                done += len(texts)
            yield pa.array(hit)

    return F.arrow_udf(search, "boolean")(text)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, q: int = Q, error_percent: int = ERROR_PERCENT,
                      min_chars: int = MIN_CHARS, part_chars: int = PART_CHARS) -> DataFrame:
    """The rows of ``docs`` that match no window of ``benchmark``."""
    for _, windows in benchmark_parts(benchmark, window, q, error_percent, min_chars, part_chars):
        docs = docs.where(~contaminated_column(F.col("text"), windows))
    return docs
