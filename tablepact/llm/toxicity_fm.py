"""Toxicity by a factorization machine over hashed terms.

A text's features are its distinct lower-case letter runs, hashed to a fixed
number of buckets.  The model adds, to a bias and a weight for each bucket, the
inner products of the buckets' factor vectors for every pair that occurs together:
an insult beside a group's name may weigh more than the two apart.

Training takes a bounded sample: the labelled rows outside the hold-out whose id
hashes lowest, ``max_train`` of them at most.  Their ids (a few hundred KB) are
broadcast to the scan, which hashes the sampled texts in the tasks.  Buckets in
fewer than ``min_docs`` sampled texts are left out; the driver trains a weight and factors for each of
the others by Adagrad, in two rounds.  The first holds the buckets whose own label rate
is ``CLEAR_Z`` standard errors or more from the average; the second starts there and holds all,
so that terms that say something only together are learned too.  Its smaller
steps and its penalty keep the many terms that say nothing from fitting single texts.  Scoring maps over all documents with the model (its size fixed by the
number of buckets).

Defined cases: null or wordless text scores the bias alone; labels without a
document, documents without a label and null labels don't train; of repeated
labels of an id the larger counts; without any usable label every score is 0;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.llm.common import texts_of

BUCKETS = 1 << 18
FACTORS = 6
MAX_TRAIN = 20_000
MIN_DOCS = 3
#: Standard errors from which a term takes part in the first round already.
CLEAR_Z = 4.0
EPOCHS = 30
#: Of the round over all terms: its steps, the absolute penalty on weights and the decay of factors.
ALL_RATE, ALL_PENALTY, ALL_DECAY = 0.1, 3e-4, 3e-4
THRESHOLD = 0.3
#: Words whose feature a worker keeps at once (memory only).
WORD_STORE = 300_000

WORD = re.compile(r"[^\W\d_]+")


def bucket(word: str, buckets: int) -> int:
    return crc32(word.encode()) % buckets


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


@dataclass
class FactorizationMachine:
    """``place`` maps a bucket to its row in ``weights`` and ``factors``, -1 for none."""

    place: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, rows: np.ndarray) -> float:
        v = self.factors[rows]
        total = v.sum(axis=0)
        return float(self.bias + self.weights[rows].sum() + 0.5 * (total @ total - (v * v).sum()))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def fit(docs: list[np.ndarray], labels: np.ndarray, features: int, factors: int = FACTORS, epochs: int = EPOCHS,
        rate: float = 0.3, decay: float = 1e-4, batch: int = 64, seed: int = 7, penalty: float | None = None,
        start: tuple[float, np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Adagrad on the logistic loss; ``docs`` are arrays of feature numbers without repeats.

    ``start`` has a bias, and feature numbers with weights and factors to begin at; ``penalty`` is an
    absolute penalty on weights in place of their decay.
    """
    rng = np.random.default_rng(seed)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(features), rng.normal(0, 0.01, (features, factors))
    if start is not None:
        bias, w[start[1]], v[start[1]] = start[0], start[2], start[3]
    gb, gw, gv = 1e-6, np.full(features, 1e-6), np.full((features, factors), 1e-4)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            lengths = np.array([len(docs[i]) for i in some])
            idx = np.concatenate([docs[i] for i in some]) if lengths.sum() else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(some)), lengths)
            vi = v[idx]
            total = np.stack([np.bincount(row, vi[:, f], len(some)) for f in range(factors)], axis=1)
            squares = np.bincount(row, (vi * vi).sum(axis=1), len(some))
            margin = bias + np.bincount(row, w[idx], len(some)) + 0.5 * ((total * total).sum(axis=1) - squares)
            error = (sigmoid(margin) - labels[some]) / len(some)
            used, where = np.unique(idx, return_inverse=True)
            dw = np.bincount(where, error[row], len(used)) + (decay * w[used] if penalty is None else 0.0)
            step = error[row][:, None] * (total[row] - vi)
            dv = np.stack([np.bincount(where, step[:, f], len(used)) for f in range(factors)], axis=1) + decay * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= rate * dw / np.sqrt(gw[used])
            if penalty is not None:
                w[used] = np.sign(w[used]) * np.maximum(np.abs(w[used]) - rate * penalty / np.sqrt(gw[used]), 0.0)
            v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            db = error.sum()
            gb += db * db
            bias -= rate * db / np.sqrt(gb)
    return bias, w, v


def fit_all(docs: list[np.ndarray], labels: np.ndarray, clear: np.ndarray, factors: int = FACTORS) -> tuple[float, np.ndarray, np.ndarray]:
    """Fit the ``clear`` features first, then all from there."""
    place, some = np.where(clear, np.cumsum(clear) - 1, -1), np.flatnonzero(clear)
    bias, w, v = fit([(p := place[d])[p >= 0] for d in docs], labels, len(some), factors)
    return fit(docs, labels, len(clear), factors, rate=ALL_RATE, decay=ALL_DECAY, penalty=ALL_PENALTY, start=(bias, some, w, v))


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", keep: Column | None = None, buckets: int = BUCKETS,
          factors: int = FACTORS, max_train: int = MAX_TRAIN, min_docs: int = MIN_DOCS) -> FactorizationMachine | None:
    """Fit on the rows of ``labels`` (doc_id, ``target``) for which ``keep`` holds; None without rows."""
    known = (labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).where(F.lit(True) if keep is None else keep)
                   .groupBy("doc_id").agg(F.max(target).cast("int").alias("y")))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    out = pa.schema([("y", pa.int32()), ("buckets", pa.list_(pa.int32()))])

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for texts in texts_of(b.column(0)):
                found = [sorted({bucket(w, buckets) for w in words_of(t)}) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(done, len(texts)), pa.array(found, pa.list_(pa.int32()))], schema=out)
                done += len(texts)

    rows = sample.select("text", "y").mapInArrow(hashed, "y int, buckets array<int>").persist()
    try:
        share = rows.agg(F.avg("y")).first()[0]
        if share is None:
            return None
        seen = (rows.select("y", F.explode("buckets").alias("b")).groupBy("b").agg(F.count("y").alias("n"), F.sum("y").alias("ones"))
                    .where(F.col("n") >= min_docs).toPandas().sort_values("b"))  # at most ``buckets`` rows
        place = np.full(buckets, -1, np.int32)
        place[seen["b"].to_numpy()] = np.arange(len(seen), dtype=np.int32)

        def narrowed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kept = [(p := place[x])[p >= 0].astype(np.int32) for x in b.column(1).to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.list_(pa.int32()))], schema=out)

        got = rows.mapInArrow(narrowed, "y int, buckets array<int>").toArrow()
    finally:
        rows.unpersist()
    order = sorted(range(got.num_rows), key=lambda i: crc32(got["buckets"][i].values.to_numpy().tobytes()))  # reruns agree
    arrays = [got["buckets"][i].values.to_numpy() for i in order]
    y = got["y"].to_numpy()[order].astype(float)
    n, ones = seen["n"].to_numpy(), seen["ones"].to_numpy()
    clear = np.abs(ones - n * share) >= CLEAR_Z * np.sqrt(n * share * (1 - share))
    return FactorizationMachine(place, *fit_all(arrays, y, clear, factors))


def score_column(text: Column, model: FactorizationMachine | None) -> Column:
    """Probability of label 1 for each text."""
    if model is None:
        return F.lit(0.0)

    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {}
        buckets = len(model.place)
        for column in batches:
            margins = []
            for t in chain.from_iterable(texts_of(column)):
                if len(known) > WORD_STORE:
                    known.clear()
                rows = set()
                for w in words_of(t):
                    r = known.get(w)
                    if r is None:
                        r = known[w] = int(model.place[bucket(w, buckets)])
                    rows.add(r)
                rows.discard(-1)
                margins.append(model.margin(np.fromiter(rows, np.int64, len(rows))))
            yield pa.array(sigmoid(np.array(margins, float)))

    return F.arrow_udf(toxicity, "double")(text)


def toxicity_scores(docs: DataFrame, labels: DataFrame, target: str = "toxic", keep: Column | None = None, **options) -> DataFrame:
    """(doc_id, score) for every document."""
    model = train(docs, labels, target, keep, **options)
    return docs.select("doc_id", score_column(F.col("text"), model).alias("score"))
