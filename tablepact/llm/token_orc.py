"""Token ids in ORC: range-partitioned shards in document order, read stripe by stripe.

``write_token_orc`` range-partitions the documents by id, sorts each
partition, tokenises it and writes one ORC file per partition: integer
run-length encoded ids, row indexes, and a Bloom filter on ``doc_id``, so that
a lookup by id skips stripes by their metadata.  Every row keeps its shard's
number and the number of ids before it in the shard.  ``read_token_orc`` adds
the global start: the totals of the shards (one row per file) are summed up and
joined back.

Defined cases: null or empty text is just the end id; null ids sort first; rows
with equal ids are ordered by a hash of their text and each keeps its own range;
an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablepact.llm.common import in_worker, new_folder, per_worker, quiet_threads

#: Words that a worker keeps with their ids; beyond the larger number it goes back to the smaller,
#: the first it met, which hold the frequent ones.  Memory (about 0.25 KB a word) against time, not results.
WORD_STORE = (250_000, 500_000)
VOCABULARY = "word_bpe_49k.json"
END_ID = 1

STORED = "doc_id long, shard int, shard_start long, n_tokens int, ids array<int>"
DIGEST = "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long"


class Numbered(dict):
    """Numbers its keys as they are first asked for; ``keys_new`` lists those since the last clearing."""

    def __init__(self):
        super().__init__()
        self.keys_new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.keys_new.append(key)
        number = self[key] = len(self)
        return number

    def first(self, n: int) -> "Numbered":
        kept = Numbered()
        kept.update(zip(islice(self, n), range(n)))
        return kept


class WordEncoder:
    """Encodes texts with the tokenizer, each distinct word once.

    The tokenizer drops white space and never joins what ASCII white space
    separates, so the ids of a text are those of its words.  It also cuts between a
    letter and punctuation and ignores case, so a plain Latin word is looked up as
    its lower-case stem and its closing marks; any other word as it is.  Arrow splits
    the texts and finds the distinct words; Python sees only those.
    """

    MARKS = ".,!%&$*#"
    APART = "\x01"
    #: The signs by which byte-level vocabularies write the bytes that are not printable.
    BYTE_SIGNS = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}

    def __init__(self, path: str, end_id: int, word_store: tuple[int, int] = WORD_STORE):
        from tokenizers import Tokenizer

        quiet_threads()
        self.tokenizer = Tokenizer.from_file(path)
        (self.apart,) = self.tokenizer.encode(self.APART, add_special_tokens=False).ids
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # every unit comes once
        self.end_id, self.word_store = end_id, word_store
        self.words, self.units = Numbered(), Numbered()
        self.units_of_word = np.zeros((0, 2), np.int32)
        self.unit_ids, self.unit_start = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.word_ids, self.word_start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def shrink(self) -> None:
        """Forget all words but the first met."""
        self.words = self.words.first(self.word_store[0])
        self.units_of_word = self.units_of_word[: len(self.words)].copy()
        self.word_start = self.word_start[: len(self.words) + 1].copy()
        self.word_ids = self.word_ids[: self.word_start[-1]].copy()
        self.units = self.units.first(int(self.units_of_word.max()) + 1)
        self.unit_start = self.unit_start[: len(self.units) + 1].copy()
        self.unit_ids = self.unit_ids[: self.unit_start[-1]].copy()

    def parts(self, word: str) -> tuple[str, str]:
        if word.isascii():
            if word.isalpha():
                return word.lower(), ""
            if "<" in word:
                return word, ""
        elif max(word) >= "\u0250" or "\u0130" in word or "<" in word:
            return word, ""
        stem = word.rstrip(self.MARKS)
        if stem and stem[-1].isalpha():
            return stem.lower(), word[len(stem):]
        return word, ""

    def encode_apart(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit; many at once, set apart by a character that none of them holds."""
        if any(self.APART in u for u in units):
            return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        found: list[list[int]] = [[]]
        for i in self.tokenizer.encode(f" {self.APART} ".join(units), add_special_tokens=False).ids:
            if i == self.apart:
                found.append([])
            else:
                found[-1].append(i)
        return found

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Lower-case Latin letters alone are one piece to the tokenizer's model; the rest goes through its normaliser and splitter."""
        tokenize = self.tokenizer.model.tokenize
        found: list[list[int]] = []
        rest: list[int] = []
        for u in units:
            if u.isalpha() and u.islower() and (u.isascii() or max(u) < "\u0250"):
                signs = u if u.isascii() else u.encode().decode("latin-1").translate(self.BYTE_SIGNS)
                found.append([t.id for t in tokenize(signs)])
            else:
                rest.append(len(found))
                found.append([])
        for i in range(0, len(rest), 500):
            some = rest[i : i + 500]
            for k, ids in zip(some, self.encode_apart([units[k] for k in some])):
                found[k] = ids
        return found

    def learn(self) -> None:
        """Take in the words met since the last call."""
        if not self.words.keys_new:
            return
        pairs = np.fromiter(map(self.units.__getitem__, chain.from_iterable(map(self.parts, self.words.keys_new))), np.int32).reshape(-1, 2)
        found = self.encode_units(self.units.keys_new)
        self.words.keys_new, self.units.keys_new = [], []
        self.units_of_word = np.concatenate([self.units_of_word, pairs])
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.unit_start = np.concatenate([self.unit_start, self.unit_start[-1] + np.cumsum(lengths)])
        self.unit_ids = np.concatenate([self.unit_ids, np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))])
        ids, lengths = strung(self.unit_ids, self.unit_start, pairs.ravel())
        lengths = lengths.reshape(-1, 2).sum(axis=1)
        self.word_start = np.concatenate([self.word_start, self.word_start[-1] + np.cumsum(lengths)])
        self.word_ids = np.concatenate([self.word_ids, ids])

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each), the end id after every text; null is empty text."""
        if len(self.words) > self.word_store[1]:
            self.shrink()
        texts = pc.fill_null(texts, "")
        # a special token must not appear by lowering
        lower = pc.if_else(pc.match_substring(texts, "<"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(lower)
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.words.__getitem__, distinct), np.int32, len(distinct))
        self.learn()
        ids, lengths = strung(self.word_ids, self.word_start, number[coded.indices.to_numpy()])
        ends = np.concatenate(([0], np.cumsum(lengths)))[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]
        return np.insert(ids, ends, self.end_id), np.diff(ends, prepend=0) + 1


def strung(ids: np.ndarray, starts: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of all ``items`` one behind the other, how many each has); item k has ids starts[k] … starts[k + 1] - 1."""
    first = starts[items]
    lengths = starts[items + 1] - first
    after = np.cumsum(lengths)
    total = int(after[-1]) if len(after) else 0
    return ids[np.repeat(first - after + lengths, lengths) + np.arange(total)], lengths


def slices(texts: pa.StringArray, size: int = 4 << 20) -> Iterator[pa.StringArray]:
    """Runs of texts of about ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield texts.slice(first, last - first)
        first = last


def vocabulary_path(name_or_path: str) -> str:
    """A file name means one of the public vocabularies; anything with a slash is a path."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def write_token_orc(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID,
                    stripe_bytes: int = 16 << 20, row_index_stride: int = 1000, word_store: tuple[int, int] = WORD_STORE) -> None:
    """Write ``docs`` (doc_id, text) as token-id shards under ``path``."""
    stored = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("shard_start", pa.int64()),
                        ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker("token ids", f"{vocabulary} {end_id}", lambda: WordEncoder(vocabulary_path(vocabulary), end_id, word_store))
        shard, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            done = 0
            for texts in slices(batch.column(1)):
                in_worker()
                ids, n = encoder.encode(texts)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(done, len(texts)),
                    pa.array(np.full(len(texts), shard, np.int32)),
                    pa.array(before + ends - n),
                    pa.array(n.astype(np.int32)),
                    pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(ids)),
                ], schema=stored)
                before += int(ends[-1])
                done += len(texts)

    by_id = F.col("doc_id").asc_nulls_first()
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
         .repartitionByRange(by_id).sortWithinPartitions(by_id, F.xxhash64("text"))
         .mapInArrow(encode, STORED)
         .write.option("compression", "none").option("orc.create.index", "true")
         .option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", row_index_stride)
         .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path))


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows, as written."""
    return spark.read.schema(STORED).orc(path)


def with_start(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """``rows`` (shard, shard_start, …) with ``start``: ids of all documents before.

    The shards' totals are one row per file, so the running sum and the
    broadcast are bounded by the number of files.
    """
    totals = stored.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    base = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    return rows.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("shard_start"))


def digests(stored: DataFrame) -> DataFrame:
    """Per stored document the crc32 of its ids as little-endian unsigned 32-bit integers."""
    out = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("shard_start", pa.int64()),
                     ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            in_worker()
            ids = batch.column(4)
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], schema=out)

    return stored.mapInArrow(check, DIGEST)


def token_digests(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``docs``, read the files back and return (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = path or new_folder(spark, "token-orc")
    write_token_orc(docs, path, **options)
    stored = read_token_orc(spark, path)
    return with_start(digests(stored), stored).select("doc_id", "start", "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of the given ids; min/max statistics and the Bloom filter skip the other stripes."""
    return read_token_orc(spark, path).where(F.col("doc_id").isin(doc_ids))
