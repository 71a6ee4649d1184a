"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the workers.

**Counting.**  Two passes over the training texts.  In each, a task counts what it reads, sorts
it and sends it on in packed runs by bucket; the bucket's runs are merged to one sorted
array.  The first pass counts words by their 64-bit hash: a word's rank in the sorted hash arrays is
its number.  The second counts bigrams as pairs of numbers, bucketed by the first word; the
bigrams of a word as frequent as a bucket is large are spread by both words.  Discounts come from
the counts of counts, lower-order probabilities from the number of different words before a word.

**Store.**  Each bucket's task writes its arrays (sorted keys, counts, the contexts' totals)
to the shared folder under a name of its own and moves them into place, so a repeated task writes
the same file.  Workers memory-map them: from a folder that is mounted, in place; from another
store, by a local copy that is unlinked once it is mapped.

**Scoring.**  A map over all texts: a group of texts asks for its distinct words and bigrams, bucket
by bucket, by binary search.

The model is of order 2: half of all bigrams are met once, and a third order would double the
stored arrays (figures in the README).

Defined cases: null text is empty text, whose only token is the end; without training texts all
words are unknown, N and V are 0, and every token has probability 1 by the model and by the base;
rows with equal ids are scored each by itself; repeated rows count each time; other columns are ignored.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.llm.common import in_worker, materialise, new_folder, open_shared, per_worker
from tablepact.llm.token_orc import Numbered

SEED = 42
#: Hash key of the end of a text; no word holds a line feed.
END = b"\n"
#: About so many training bytes for each bucket of words (a power of two of buckets).
BUCKET_BYTES = 20_000_000
#: About so many training tokens for each bucket of bigrams.
BUCKET_TOKENS = 2_000_000
#: Tokens that a task counts at once, and words that a worker keeps at once.
RUN_TOKENS = 2_000_000
WORD_STORE = 250_000

BEGIN = np.uint64(0xFFFFFFFF)  # the context before the first word
LOW = np.uint64(0xFFFFFFFF)
SHIFT = np.uint64(32)


def tokens(text: str) -> list[bytes]:
    """Words in lower case (A-Z only), and the end."""
    words = text.encode().lower().split()
    words.append(END)
    return words


def spread(values: np.ndarray) -> np.ndarray:
    mixed = values * np.uint64(0x9E3779B97F4A7C15)
    return (mixed ^ mixed >> SHIFT) * np.uint64(0xD6E8FEB86659FD93) >> SHIFT


def narrow(values: np.ndarray) -> np.ndarray:
    """As 32-bit numbers; an error if one has no place there, so that no count or number ever wraps."""
    if len(values) and int(values.max()) > int(LOW):
        raise OverflowError(f"{int(values.max())} exceeds 32 bits: a bigram or word was met too often, or there are too many words")
    return values.astype(np.uint32)


# --- sorted runs through Spark ----------------------------------------------------

RUN = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
RUN_DDL = "bucket int, keys binary, counts binary"


def runs(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """Sorted keys and their counts as one packed row a bucket."""
    order = np.argsort(bucket, kind="stable")
    keys, counts, bucket = keys[order], narrow(counts[order]), bucket[order]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(bucket[first].astype(np.int32)),
        pa.array([k.tobytes() for k in np.split(keys, first[1:])] if len(first) else [], pa.binary()),
        pa.array([c.tobytes() for c in np.split(counts, first[1:])] if len(first) else [], pa.binary())], schema=RUN)


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The runs of one bucket as sorted keys with summed counts."""
    keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64)
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint32)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays one behind the other; the file appears whole, under its own name, by a move."""
    fs, path = open_shared(folder)
    fs.create_dir(path, recursive=True)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes())
            out.write(b"\0" * (-a.nbytes % 8))
    fs.move(draft, f"{path}/{name}")


def map_file(folder: str, name: str, scratch: str | None = None) -> np.ndarray | mmap.mmap:
    """The bytes of a shared file as a read-only memory map."""
    from pyarrow import fs as pafs

    fs, path = open_shared(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(f"{path}/{name}", "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    handle, copy = tempfile.mkstemp(dir=scratch)
    try:
        with os.fdopen(handle, "wb") as out, fs.open_input_stream(f"{path}/{name}") as data:
            while block := data.read(1 << 24):
                out.write(block)
        with open(copy, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    finally:
        os.unlink(copy)


class MappedArrays:
    """The arrays of one file, mapped when first asked for."""

    def __init__(self, folder: str, name: str, layout: list[tuple[str, str, int]]):
        self.folder, self.name, self.layout, self.arrays = folder, name, layout, None

    def __getitem__(self, key: str) -> np.ndarray:
        if self.arrays is None:
            data, at, self.arrays = map_file(self.folder, self.name), 0, {}
            for name, kind, n in self.layout:
                self.arrays[name] = np.frombuffer(data, kind, n, at)
                at += -(-self.arrays[name].nbytes // 8) * 8
        return self.arrays[key]


# --- vocabulary -------------------------------------------------------------------


def word_shift(buckets: int) -> np.uint64:
    """The shift that leaves of a hash the number of its bucket."""
    return np.uint64(65 - buckets.bit_length())


class Vocabulary:
    """Words by hash: number = rank among all hashes, which the buckets hold in order."""

    def __init__(self, folder: str, sizes: list[int]):
        self.base = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.shift = word_shift(len(sizes))
        self.files = [MappedArrays(folder, f"words-{b:04d}", [("keys", "<u8", n), ("counts", "<u8", n)]) for b, n in enumerate(sizes)]

    @property
    def size(self) -> int:
        return int(self.base[-1])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of each hash."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.uint64)
        bucket = (hashes >> self.shift).astype(np.int64)
        for b in np.unique(bucket).tolist():
            if self.base[b + 1] > self.base[b]:
                mine = np.flatnonzero(bucket == b)
                keys = self.files[b]["keys"]
                at = np.minimum(np.searchsorted(keys, hashes[mine]), len(keys) - 1)
                real = keys[at] == hashes[mine]
                number[mine[real]] = self.base[b] + at[real]
                count[mine[real]] = self.files[b]["counts"][at[real]]
        return number, count


class Numberer:
    """Turns texts into vocabulary numbers, asking once for each distinct word."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.words = Numbered()
        self.number, self.count = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each token or -1, count of each token, tokens of each text)."""
        from xxhash import xxh64_intdigest

        if len(self.words) > WORD_STORE:
            self.clear()
        split = [tokens(t) for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        places = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
        new, self.words.keys_new = self.words.keys_new, []
        if new:
            number, count = self.vocabulary.find(np.fromiter((xxh64_intdigest(w, SEED) for w in new), np.uint64, len(new)))
            self.number, self.count = np.concatenate([self.number, number]), np.concatenate([self.count, count])
        return self.number[places], self.count[places], lengths


def text_groups(column: pa.Array, chars: int = 2 << 20) -> Iterator[list[str]]:
    """The texts of a column, null as empty, in lists of about ``chars`` characters."""
    some, total = [], 0
    for i in range(0, len(column), 256):
        for t in column.slice(i, 256).to_pylist():
            some.append(t or "")
            total += len(some[-1])
            if total >= chars:
                in_worker()
                yield some
                some, total = [], 0
    if some:
        yield some


def count_words(texts: DataFrame, folder: str) -> tuple[list[int], int]:
    """Write the vocabulary; (size of each bucket, number of tokens)."""
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    buckets = 1 << min(16, max(4, (size // BUCKET_BYTES).bit_length()))
    shift = word_shift(buckets)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        words, counts = Numbered(), np.zeros(0, np.int64)

        def send() -> pa.RecordBatch:
            keys = np.fromiter((xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
            order = np.argsort(keys)
            return runs(keys[order], counts[order], (keys[order] >> shift).astype(np.int32))

        for batch in batches:
            for some in text_groups(batch.column(0)):
                found = np.fromiter(map(words.__getitem__, chain.from_iterable(map(tokens, some))), np.int64)
                words.keys_new = []
                counts = np.concatenate([counts, np.zeros(len(words) - len(counts), np.int64)]) + np.bincount(found, minlength=len(words))
                if len(words) > WORD_STORE:
                    yield send()
                    words, counts = Numbered(), np.zeros(0, np.int64)
        if words:
            yield send()

    def store(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = merged(table)
        write_arrays(folder, f"words-{key[0].as_py():04d}", {"keys": keys, "counts": counts})
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "size": pa.array([len(keys)]), "tokens": pa.array([int(counts.sum())])})

    done = materialise(texts.mapInArrow(count, RUN_DDL).groupBy("bucket").applyInArrow(store, "bucket int, size long, tokens long"), "lm-words")
    rows = {r["bucket"]: r for r in done.collect()}  # one row a bucket
    return [rows[b]["size"] if b in rows else 0 for b in range(buckets)], sum(r["tokens"] for r in rows.values())


# --- bigrams ----------------------------------------------------------------------


def bigram_keys(numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Number of the word before and of the word, packed; unknown words pack as BEGIN - 1."""
    now = np.where(numbers < 0, int(BEGIN) - 1, numbers).astype(np.uint64)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[np.cumsum(lengths) - lengths] = BEGIN
    return before << SHIFT | now


def bigram_bucket(keys: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """By the first word; by both where the first word is one of ``hot`` (sorted)."""
    first = keys >> SHIFT
    at = np.minimum(np.searchsorted(hot, first), len(hot) - 1)
    return (spread(np.where(hot[at] == first, keys, first)) % np.uint64(buckets)).astype(np.int32)


def by_first(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first words, their total and number of bigrams met once, twice, more often) of sorted bigrams."""
    first = keys >> SHIFT
    at = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
    parts = [counts, counts == 1, counts == 2, counts > 2]
    return first[at].astype(np.uint32), np.stack([np.add.reduceat(p.astype(np.uint64), at) for p in parts], axis=1)


def discounts(met: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from how many were met 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = met
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]


def hot_words(vocabulary: Vocabulary, least: int) -> np.ndarray:
    """Numbers of the words met at least ``least`` times, and BEGIN; at most tokens / least of them."""
    found = [vocabulary.base[b] + np.flatnonzero(f["counts"] >= least) for b, f in enumerate(vocabulary.files) if vocabulary.base[b + 1] > vocabulary.base[b]]
    return np.append(np.concatenate([np.zeros(0, np.int64), *found]).astype(np.uint64), BEGIN)


def train(texts: DataFrame, folder: str | None = None) -> dict:
    """Count ``texts`` (one column) and write the model; returns its description, which is also stored."""
    spark = texts.sparkSession
    folder = folder or new_folder(spark, "kneser-ney")
    sizes, total = count_words(texts, folder)
    model = {"folder": folder, "words": sizes, "tokens": total, "buckets": 0}
    if total:
        model |= count_bigrams(texts, folder, sizes, total)
    fs, path = open_shared(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/model.json") as out:
        out.write(json.dumps(model).encode())
    return model


def count_bigrams(texts: DataFrame, folder: str, sizes: list[int], total: int) -> dict:
    if sum(sizes) >= int(BEGIN) - 1:
        raise OverflowError(f"{sum(sizes)} different words exceed 32-bit word numbers")
    buckets = max(16, -(-total // BUCKET_TOKENS))
    least = max(1000, total // buckets // 4)

    def vocabulary() -> tuple[Numberer, np.ndarray]:
        words = Vocabulary(folder, sizes)
        return Numberer(words), hot_words(words, least)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, hot = per_worker("lm words", folder, vocabulary)
        held, size = [], 0

        def send() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return runs(keys, counts, bigram_bucket(keys, hot, buckets))

        for batch in batches:
            for some in text_groups(batch.column(0)):
                numbers, _, lengths = number(some)
                held.append(bigram_keys(numbers, lengths))
                size += len(numbers)
                if size > RUN_TOKENS:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    base = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    out = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("numbers", pa.list_(pa.int64()))])

    def store(key: tuple, table: pa.Table) -> pa.Table:
        """One bucket: its file; how often words follow (kind 1, by word bucket); totals of spread contexts (kind 2); figures (kind 0)."""
        bucket = key[0].as_py()
        keys, counts = merged(table)
        first, figures = by_first(keys, counts)
        _, hot = per_worker("lm words", folder, vocabulary)
        spread_over = np.isin(first, hot.astype(np.uint32))
        own = ~spread_over
        write_arrays(folder, f"pairs-{bucket:06d}", {"keys": keys, "counts": narrow(counts), "contexts": first[own], "figures": figures[own]})
        after, times = np.unique(keys & LOW, return_counts=True)
        follow = runs(after, times, np.searchsorted(base, after.astype(np.int64), side="right").astype(np.int32) - 1)
        n = follow.num_rows
        met = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        return pa.table([
            pa.array([0, 2] + [1] * n, pa.int32()), pa.array([bucket, bucket, *follow.column(0).to_pylist()], pa.int32()),
            pa.array([None, first[spread_over].tobytes(), *follow.column(1).to_pylist()], pa.binary()),
            pa.array([None, figures[spread_over].tobytes(), *follow.column(2).to_pylist()], pa.binary()),
            pa.array([[len(keys), int(own.sum()), *met]] + [None] * (n + 1), pa.list_(pa.int64()))], schema=out)

    done = materialise(texts.mapInArrow(count, RUN_DDL).groupBy("bucket")
                       .applyInArrow(store, "kind int, bucket int, keys binary, counts binary, numbers array<long>"), "lm-pairs")

    def store_follow(key: tuple, table: pa.Table) -> pa.Table:
        """How many different words come before each word of a vocabulary bucket, in the order of the vocabulary."""
        bucket = key[0].as_py()
        words, times = merged(table)
        before = np.zeros(sizes[bucket], np.uint32)
        before[words.astype(np.int64) - base[bucket]] = times
        write_arrays(folder, f"before-{bucket:04d}", {"before": before})
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "pairs": pa.array([int(times.sum())]),
                         "met": pa.array([[int((times == k).sum()) for k in (1, 2, 3, 4)]], pa.list_(pa.int64()))})

    follow = materialise(done.where(F.col("kind") == 1).select("bucket", "keys", "counts").groupBy("bucket")
                         .applyInArrow(store_follow, "bucket int, pairs long, met array<long>"), "lm-before")

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "total", "once", "twice", "more"]
        for b in batches:
            for k, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                figures = np.frombuffer(f, np.uint64).reshape(-1, 4).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, np.uint32).astype(np.int64)), *map(pa.array, figures.T)], names=names)

    # one row for each word as frequent as a bucket is large: at most a few times the number of buckets
    spread_contexts = (done.where(F.col("kind") == 2).select("keys", "counts").mapInArrow(unpack, "word long, total long, once long, twice long, more long")
                       .groupBy("word").agg(*[F.sum(c).alias(c) for c in ("total", "once", "twice", "more")]).orderBy("word").toPandas())
    figures = [r for r in done.where(F.col("kind") == 0).select("bucket", "numbers").collect()]  # one row a bucket
    by_bucket = {r["bucket"]: r["numbers"] for r in figures}
    lower = follow.collect()  # one row a vocabulary bucket
    return {
        "buckets": buckets,
        "pairs": [by_bucket.get(b, [0, 0])[:2] for b in range(buckets)],
        "discounts": discounts([sum(n[2 + k] for n in by_bucket.values()) for k in range(4)]),
        "lower_pairs": sum(r["pairs"] for r in lower),
        "lower_discounts": discounts([sum(r["met"][k] for r in lower) for k in range(4)]),
        "lower_met": lower_met(lower, sizes),
        "spread": spread_contexts.to_numpy().tolist(),
    }


def lower_met(rows: list, sizes: list[int]) -> list[int]:
    """How many words follow one, two, and three or more different words."""
    once, twice = (sum(r["met"][k] for r in rows) for k in (0, 1))
    return [once, twice, sum(sizes) - once - twice]


# --- scoring ----------------------------------------------------------------------


class KneserNey:
    """A stored model: probabilities of packed bigrams."""

    def __init__(self, model: dict):
        self.model, folder = model, model["folder"]
        self.vocabulary = Vocabulary(folder, model["words"])
        self.numberer = Numberer(self.vocabulary)
        self.total = model["tokens"]
        if self.total:
            self.before = [MappedArrays(folder, f"before-{b:04d}", [("before", "<u4", n)]) for b, n in enumerate(model["words"])]
            self.pairs = [MappedArrays(folder, f"pairs-{b:06d}", [("keys", "<u8", n), ("counts", "<u4", n), ("contexts", "<u4", m), ("figures", "<u8", 4 * m)])
                          for b, (n, m) in enumerate(model["pairs"])]
            spread_over = np.array(model["spread"], np.int64).reshape(-1, 5)
            self.spread_words, self.spread_figures = spread_over[:, 0].astype(np.uint64), spread_over[:, 1:]
            self.d, self.lower_d = np.array([0, *model["discounts"]]), np.array([0, *model["lower_discounts"]])

    def lower(self, words: np.ndarray) -> np.ndarray:
        """Probability of each word number without its context; unknown words share what is left over with the others evenly."""
        times = np.zeros(len(words), np.float64)
        known = words < np.uint64(self.vocabulary.size)
        bucket = np.searchsorted(self.vocabulary.base, words.astype(np.int64), side="right") - 1
        for b in np.unique(bucket[known]).tolist():
            mine = np.flatnonzero(known & (bucket == b))
            times[mine] = self.before[b]["before"][words[mine].astype(np.int64) - self.vocabulary.base[b]]
        pairs = self.model["lower_pairs"]
        left = float(self.lower_d[1:] @ np.array(self.model["lower_met"])) / pairs
        cut = self.lower_d[np.minimum(times, 3).astype(np.int64)]
        return (times - cut) / pairs + left / (self.vocabulary.size + 1)

    def probability(self, keys: np.ndarray) -> np.ndarray:
        """Probability of the second word after the first, for sorted distinct packed bigrams."""
        first = keys >> SHIFT
        count, figures = np.zeros(len(keys)), np.zeros((len(keys), 4))
        bucket = bigram_bucket(keys, self.spread_words, len(self.pairs))
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1]))) if len(order) else []
        for mine in np.split(order, cuts[1:]) if len(order) else []:
            n, m = self.model["pairs"][bucket[mine[0]]]
            if not n:
                continue
            file = self.pairs[bucket[mine[0]]]
            at = np.minimum(np.searchsorted(file["keys"], keys[mine]), n - 1)
            count[mine] = np.where(file["keys"][at] == keys[mine], file["counts"][at], 0)
            if m:
                at = np.minimum(np.searchsorted(file["contexts"], first[mine].astype(np.uint32)), m - 1)
                real = file["contexts"][at] == first[mine]
                figures[mine[real]] = file["figures"].reshape(-1, 4)[at[real]]
        at = np.minimum(np.searchsorted(self.spread_words, first), len(self.spread_words) - 1)
        spread_over = self.spread_words[at] == first
        figures[spread_over] = self.spread_figures[at[spread_over]]
        total = np.maximum(figures[:, 0], 1)
        lower = self.lower(keys & LOW)
        cut = self.d[np.minimum(count, 3).astype(np.int64)]
        seen = (np.maximum(count - cut, 0) + (figures[:, 1:] @ self.d[1:]) * lower) / total
        return np.where(figures[:, 0] > 0, seen, lower)

    def score(self, texts: list[str]) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score and score of each text."""
        numbers, counts, lengths = self.numberer(texts)
        starts = np.cumsum(lengths) - lengths
        size = self.vocabulary.size
        if not self.total:
            zero = np.zeros(len(texts))
            return {"n_tokens": lengths, "n_known": zero.astype(np.int64), "base_score": zero, "score": zero}
        base = np.log10((counts + 0.5) / (self.total + 0.5 * (size + 1)))
        keys, where = np.unique(bigram_keys(numbers, lengths), return_inverse=True)
        logs = np.log10(self.probability(keys))[where]
        return {"n_tokens": lengths, "n_known": np.add.reduceat((numbers >= 0).astype(np.int64), starts),
                "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(logs, starts)}


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every document; perplexity is 10^(-score / n_tokens)."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                     ("base_score", pa.float64()), ("score", pa.float64())])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = per_worker("lm", model["folder"], lambda: KneserNey(model))
        for batch in batches:
            done = 0
            for some in text_groups(batch.column(1)):
                got = lm.score(some)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(done, len(some)), pa.array(got["n_tokens"]), pa.array(got["n_known"]),
                    pa.array(np.full(len(some), model["tokens"])), pa.array(got["base_score"]), pa.array(got["score"])], schema=out)
                done += len(some)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                .mapInArrow(score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def load(spark: SparkSession, folder: str) -> dict:
    """The description of a stored model."""
    fs, path = open_shared(folder)
    with fs.open_input_stream(f"{path}/model.json") as data:
        return json.loads(data.read())
