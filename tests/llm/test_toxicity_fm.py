from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablepact.llm import toxicity_fm as T


def test_margin_is_bias_weights_and_all_pairs():
    rng = np.random.default_rng(0)
    m = T.FactorizationMachine(np.arange(9, dtype=np.int32), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    rows = np.array([1, 4, 7, 8])
    want = 0.3 + m.weights[rows].sum() + sum(m.factors[a] @ m.factors[b] for i, a in enumerate(rows) for b in rows[i + 1 :])
    assert m.margin(rows) == pytest.approx(want)
    assert m.margin(np.zeros(0, np.int64)) == pytest.approx(0.3)


def test_fit_learns_a_pair_that_weights_alone_cannot():
    rng = np.random.default_rng(1)
    docs = [np.flatnonzero(rng.random(4) < 0.5) for _ in range(800)]
    labels = np.array([float((0 in d) == (1 in d)) for d in docs])  # both or neither
    bias, w, v = T.fit(docs, labels, 4, decay=1e-5)
    m = T.FactorizationMachine(np.arange(4, dtype=np.int32), bias, w, v)
    right = np.mean([(m.margin(d) > 0) == y for d, y in zip(docs, labels)])
    assert right > 0.95


def corpus(n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = rng.choices([f"w{c}{d}" for c in "abcdefgh" for d in "ijklmnop"], k=40)
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["Foo!", "BAR", "baz,"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_scores(spark, docs_of):
    rows, labels = corpus()
    odd = [(9000, None), (9001, ""), (9002, "12 !!"), (9003, "foo " + "wai " * 20_000), (None, "foo")]
    labels_df = spark.createDataFrame(labels + [(5, 1, None), (None, 0, 1), (77777, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows + odd, score=1, toxic=5, y=2)
    got = T.toxicity_scores(docs, labels_df, keep=F.col("doc_id") % 5 != 1).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    held = [(score[i], y) for i, _, y in labels if i % 5 == 1]
    assert min(s for s, y in held if y) > 0.3 > max(s for s, y in held if not y)
    assert score[9000] == score[9001] == score[9002] and score[9003] > score[9000]
    again = {r.doc_id: r.score for r in T.toxicity_scores(docs.repartition(7), labels_df, keep=F.col("doc_id") % 5 != 1).collect()}
    assert again == pytest.approx(score)


def test_training_is_bounded_and_nothing_to_learn(spark, docs_of):
    rows, labels = corpus(60)
    labels_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert T.train(docs_of(rows), labels_df, max_train=20) is not None
    for docs, lab in ((docs_of(rows), labels_df.limit(0)), (docs_of([]), labels_df), (docs_of(rows), labels_df.withColumn("toxic", F.lit(None).cast("int")))):
        assert {r.score for r in T.toxicity_scores(docs, lab).collect()} <= {0.0}


def test_train_learns_a_pair_of_terms_that_say_nothing_alone(spark, docs_of):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join([*rng.choices([f"w{c}{d}" for c in "abcdefgh" for d in "ijklmnop"], k=40), *["silly"] * insult, *["northerners"] * group])))
        labels.append((i, 1, int(insult == group)))
    docs, labels_df = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.train(docs, labels_df, keep=F.col("doc_id") < 1200)
    assert all(model.place[T.bucket(w, T.BUCKETS)] >= 0 for w in ("silly", "northerners"))
    score = {r.doc_id: r.score for r in docs.select("doc_id", T.score_column(F.col("text"), model).alias("score")).collect()}
    assert sum((score[i] > 0.5) == bool(y) for i, _, y in labels if i >= 1200) > 380
