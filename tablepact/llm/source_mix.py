"""Mixing sources to target weights by blocks.

A source's words, its documents in id order, form one stream that is cut into
blocks of ``block_words`` (the last one may be short).  The target weights give each source
a number of blocks to take; the output is dealt into shards, and each shard draws how
many of its slots go to which source: multinomial draws down a binary tree of shards,
every node splitting what its parent was given, so each task finds its own shard's counts
from the root and the totals come out exactly.  A source's slots, numbered through all shards, are mapped
to its blocks by a keyed permutation of the block indexes (a Feistel network with cycle
walking), a new one for each pass over the source; slots and blocks meet in a join on
(source, block index).

Per-source figures are one row a source; texts are not moved to find the mix.

Defined cases: null or wordless texts take no slot; null is a source of its own, ranked
last; repeated rows are documents of their own, equal ids are ordered by their text's
hash; a source without words has target 0; an empty table gives an empty mix; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepact.llm.common import materialise, texts_of

BLOCK_WORDS = 128
SHARD_BLOCKS = 4096
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SEED = 20


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""

    def count(column: pa.Array) -> pa.Array:
        return pa.array([len(t.encode().split()) for texts in texts_of(column) for t in texts], pa.int64())

    return F.arrow_udf(count, "long")(text)


# --- targets ----------------------------------------------------------------------


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(sid, source, source_size, target) from (source, size) rows.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all
    sizes; a target stops at ``most`` times its source, the excess goes to the others by weight.
    One narrow row a source goes through the ranking and the fill level's rounds.
    """
    ranked = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
                   .withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights) + 1)
    ranked = materialise(ranked.withColumn("weight", weight), "mix-sources")
    cap = F.col("source_size") * float(most)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # target = min(cap, level * weight); each round fixes the sources the last level filled
        filled = cap <= F.col("weight") * level
        row = ranked.agg(F.sum(F.when(filled, cap).otherwise(0.0)).alias("used"), F.count(F.when(filled, 1)).alias("full"),
                         F.sum(F.when(~filled, F.col("weight")).otherwise(0.0)).alias("open")).first()
        if not row["open"] or row["full"] == full:
            break
        level, full = (share * total - row["used"]) / row["open"], row["full"]
    return ranked.select("sid", "source", "source_size", F.least(cap, F.col("weight") * level).alias("target"))


# --- streams ----------------------------------------------------------------------


def streams(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, text_hash, start): where each document's words begin in its source's stream.

    Narrow rows only: they are range-partitioned by (source, id), summed up within each partition, and
    the partitions' totals (one row for each partition and source in it) give the rest.
    """
    order = [F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_first(), F.col("text_hash")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    schema = "doc_id long, source string, size long, text_hash long, part int, before long"
    arrow = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("text_hash", pa.int64()),
                       ("part", pa.int32()), ("before", pa.int64())])

    def running(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, source, total = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            before = []
            for s, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if s != source:
                    source, total = s, 0
                before.append(total)
                total += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(before), part, np.int32)), pa.array(before, pa.int64())], schema=arrow)

    summed = materialise(materialise(rows, "mix-sizes").repartitionByRange(*order).sortWithinPartitions(*order)
                         .mapInArrow(running, schema), "mix-streams")
    parts = summed.groupBy("source", "part").agg(F.sum("size").alias("n"))
    base = parts.select(F.col("source").alias("s"), F.col("part").alias("p"),
                        (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("base"))
    joined = summed.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return joined.select("doc_id", "source", "size", "text_hash", (F.col("base") + F.col("before")).alias("start"))


# --- slots ------------------------------------------------------------------------


def draw(rng: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """Multinomial draw of ``take`` slots from ``counts``; what a source cannot give is drawn again from the others."""
    drawn = np.zeros_like(counts)
    while (short := take - int(drawn.sum())) > 0:
        room = counts - drawn
        drawn += np.minimum(rng.multinomial(short, room / room.sum()), room)
    return drawn


def shard_counts(quotas: np.ndarray, shard: int, shards: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first slot number, number of slots) of each source in one shard of ``size`` slots."""
    lo, hi, before, here = 0, shards, np.zeros_like(quotas), quotas.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = draw(np.random.default_rng([seed, lo, hi]), here, (mid - lo) * size)
        if shard < mid:
            hi, here = mid, left
        else:
            lo, before, here = mid, before + left, here - left
    return before, here


def permuted(index: np.ndarray, n: int, key: list[int]) -> np.ndarray:
    """A keyed permutation of 0 … n-1 at ``index``: four Feistel rounds, walked until the value is below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(1, 1 << 62, 4, np.uint64) | np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= k
            left, right = right, left ^ (mixed >> np.uint64(31) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def slots(plan: DataFrame, block_words: int, shard_blocks: int, seed: int) -> DataFrame:
    """(shard, slot, sid, block, round): which block of which source fills each slot.

    ``plan``: (sid, source_size, target).  Every task descends the shard tree by itself; the
    plan it needs has one row of two numbers a source.
    """
    spark = plan.sparkSession
    rows = plan.where(F.col("target") > 0).orderBy("sid").select("sid", "source_size", "target").collect()
    sid = np.array([r[0] for r in rows], np.int64)
    size = np.array([r[1] for r in rows], np.int64)
    blocks = -(-size // block_words)
    mean = size / np.maximum(blocks, 1)  # words of a block on average
    quotas = np.minimum(np.rint(np.array([r[2] for r in rows]) / np.maximum(mean, 1e-9)).astype(np.int64), 2 * blocks)
    shards = int(-(-quotas.sum() // shard_blocks)) if len(rows) else 0
    schema = pa.schema([("shard", pa.int64()), ("slot", pa.int32()), ("sid", pa.int32()), ("block", pa.int64()), ("round", pa.int32())])

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                before, here = shard_counts(quotas, shard, shards, shard_blocks, seed)
                which, number = [], []
                for s in np.flatnonzero(here).tolist():
                    number.append(before[s] + np.arange(here[s]))
                    which.append(np.full(here[s], s))
                which, number = np.concatenate(which), np.concatenate(number)
                turn, block = number // blocks[which], number % blocks[which]
                for s in np.flatnonzero(here).tolist():
                    for t in np.unique(turn[which == s]).tolist():
                        mine = (which == s) & (turn == t)
                        block[mine] = permuted(block[mine], int(blocks[s]), [seed, int(sid[s]), t])
                mixed = np.random.default_rng([seed, shards, shard]).permutation(len(which))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(which), shard, np.int64)), pa.array(np.arange(len(which), dtype=np.int32)),
                     pa.array(sid[which[mixed]].astype(np.int32)), pa.array(block[mixed]), pa.array(turn[mixed].astype(np.int32))], schema=schema)

    return spark.range(shards).mapInArrow(fill, "shard long, slot int, sid int, block long, round int")


def segments(placed: DataFrame, block_words: int) -> DataFrame:
    """One row for each block that a document's words fall in: the words ``from_word`` … ``to_word`` - 1 of the document."""
    end = F.col("start") + F.col("size")
    blocks = F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))
    cut = placed.where(F.col("size") > 0).withColumn("block", F.explode(blocks))
    first = F.greatest(F.col("start"), F.col("block") * block_words) - F.col("start")
    last = F.least(end, (F.col("block") + 1) * block_words) - F.col("start")
    return cut.withColumn("from_word", first).withColumn("to_word", last)


class Mix:
    """The mix of ``docs`` (doc_id, text, source), all parts of it lazy DataFrames over stored narrow tables."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
                 block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED):
        placed = streams(docs)
        self.docs = docs
        self.plan = materialise(targets(placed.select("source", "size"), weights, share, most), "mix-plan")
        plan = self.plan.withColumnRenamed("source", "s")
        self.placed = placed.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        self.slots = slots(self.plan, block_words, shard_blocks, seed)
        self.segments = segments(self.placed, block_words)

    def blocks(self) -> DataFrame:
        """The output blocks: (shard, slot, sid, block, round, doc_id, text_hash, from_word, to_word), a row for each piece of a block."""
        return self.slots.hint("merge").join(self.segments.select("sid", "block", "doc_id", "text_hash", "start", "from_word", "to_word"), ["sid", "block"])

    def takes(self) -> DataFrame:
        """The segments with ``times``, how often their block is taken."""
        # Spark can't know how many rows the slots will be and would take them for a few
        times = self.slots.groupBy("sid", "block").agg(F.count("*").alias("times")).hint("merge")
        return self.segments.join(times, ["sid", "block"])

    def report(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken), one row a document."""
        columns = ["doc_id", "size", "source_size", "target", "start", "sid"]
        none = self.placed.select(*columns, F.lit(0).cast("long").alias("words"))
        words = (F.col("to_word") - F.col("from_word")) * F.col("times")
        taken = (self.takes().select(*columns, words.alias("words")).unionByName(none.where(F.col("size") > 0))
                     .groupBy(*columns).agg(F.sum("words").alias("words")))  # a start tells documents with words apart
        return (taken.unionByName(none.where(F.col("size") == 0))
                     .select("doc_id", "size", "source_size", "target", F.col("words").alias("taken")))

    def documents(self) -> DataFrame:
        """The mix as documents: for each pass over a source, the words of a document that the pass takes.

        A document wholly taken keeps its text as it is; of another, runs of taken words stay as
        they stand in the text, one below the other.
        """
        passes = (self.takes().select("doc_id", "source", "text_hash", "start", "size", "from_word", "to_word", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("pass"))
                      .groupBy("doc_id", "source", "text_hash", "start", "size", "pass")
                      .agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("runs")))
        key = ["doc_id", "source", "text_hash"]
        runs = passes.groupBy(*key).agg(F.collect_list(F.struct("size", "runs")).alias("wanted"))
        names = {c: f"__mix_{c}" for c in key}
        runs = runs.select(*[F.col(c).alias(n) for c, n in names.items()], "wanted")
        text_hash = "__mix_hash"
        docs = self.docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias(text_hash)).dropDuplicates(["doc_id", "source", text_hash])
        joined = docs.join(runs, F.col("doc_id").eqNullSafe(F.col(names["doc_id"])) & F.col("source").eqNullSafe(F.col(names["source"]))
                           & (F.col(text_hash) == F.col(names["text_hash"])))
        cut = joined.select("doc_id", "lang", "source", "text", F.explode("wanted").alias("w")).select("doc_id", "lang", "source", "text", "w.size", "w.runs")
        text = cut_words(F.col("text"), F.col("size"), F.col("runs"))
        return cut.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(
            "doc_id", "text", "lang", "source", "n_chars")


def cut_words(text: Column, size: Column, runs: Column) -> Column:
    """The given runs of words of a text, as they stand in it."""
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")

    def cut(column: pa.Array, sizes: pa.Array, wanted: pa.Array) -> pa.Array:
        out = []
        for t, n, pieces in zip(chain.from_iterable(texts_of(column)), sizes.to_pylist(), wanted.to_pylist()):
            if sum(p["to_word"] - p["from_word"] for p in pieces) == n:
                out.append(t)
                continue
            spans = [m.span() for m in word.finditer(t)]
            joined: list[list[int]] = []
            for p in pieces:
                if joined and joined[-1][1] == p["from_word"]:
                    joined[-1][1] = p["to_word"]
                else:
                    joined.append([p["from_word"], p["to_word"]])
            out.append("\n".join(t[spans[a][0] : spans[b - 1][1]] for a, b in joined))
        return pa.array(out, pa.string())

    return F.arrow_udf(cut, "string")(text, size, runs)
