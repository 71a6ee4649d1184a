from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablepact.llm import kneser_ney as K


def words(text):
    return [w.decode() for w in K.tokens(text or "")]


class Brute:
    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            w = words(t)
            self.uni.update(w)
            self.bi.update(zip(["<s>", *w], w))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.before = Counter(b for _, b in self.bi)
        self.contexts = defaultdict(Counter)
        for (a, b), c in self.bi.items():
            self.contexts[a][b] = c
        self.d = [0, *K.discounts([sum(c == k for c in self.bi.values()) for k in (1, 2, 3, 4)])]
        self.ld = [0, *K.discounts([sum(c == k for c in self.before.values()) for k in (1, 2, 3, 4)])]

    def lower(self, w):
        pairs = sum(self.before.values())
        left = sum(self.ld[min(c, 3)] for c in self.before.values()) / pairs
        c = self.before[w]
        return (c - self.ld[min(c, 3)]) / pairs + left / (self.v + 1)

    def p(self, a, b):
        row = self.contexts.get(a)
        if not row:
            return self.lower(b)
        c, total = row[b], sum(row.values())
        return (max(c - self.d[min(c, 3)], 0) + sum(self.d[min(k, 3)] for k in row.values()) * self.lower(b)) / total

    def score(self, text):
        w = words(text)
        return (len(w), sum(x in self.uni for x in w), self.n,
                sum(math.log10((self.uni[x] + 0.5) / (self.n + 0.5 * (self.v + 1))) for x in w),
                sum(math.log10(self.p(a, b)) for a, b in zip(["<s>", *w], w)))


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    return [" ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(40)], k=rng.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("bucket_tokens", [K.BUCKET_TOKENS, 30])
def test_matches_brute_force(spark, docs_of, monkeypatch, bucket_tokens):
    monkeypatch.setattr(K, "BUCKET_TOKENS", bucket_tokens)
    monkeypatch.setattr(K, "RUN_TOKENS", 200)
    texts = [*corpus(80), "The the THE É é", "", None, "W1\tw2\nw3\x0bw4", "w0 " * 3000]
    docs = docs_of(list(enumerate(texts)), score=1, n_tokens="x")
    brute = Brute(texts)
    model = K.train(docs.select("text"))
    unseen = [*texts, "unknown words w1 w0", "w1 zzz w1", "zzz"]
    got = K.scores(docs_of(list(enumerate(unseen))), model).collect()
    assert len(got) == len(unseen)
    for r in got:
        want = brute.score(unseen[r.doc_id])
        assert tuple(r[1:4]) == want[:3]
        assert r.base_score == pytest.approx(want[3]) and r.score == pytest.approx(want[4])


def test_frequent_words_spread_over_buckets(spark, docs_of, monkeypatch):
    monkeypatch.setattr(K, "BUCKET_TOKENS", 100)
    texts = ["the " + " the ".join(f"x{i * 50 + k}" for k in range(50)) for i in range(60)]
    brute = Brute(texts)
    model = K.train(docs_of(list(enumerate(texts))).select("text"))
    assert model["buckets"] > 16 and len(model["spread"]) >= 2  # "the" and the beginning
    for r in K.scores(docs_of(list(enumerate(texts))), model).collect():
        assert r.score == pytest.approx(brute.score(texts[r.doc_id])[4])


def test_probabilities_sum_to_one():
    brute = Brute(corpus(50))
    for context in ["<s>", "w0", "w39", "never"]:
        total = sum(brute.p(context, w) for w in brute.uni) + brute.p(context, "unknown word")
        assert total == pytest.approx(1)


def test_model_can_be_loaded(spark, docs_of):
    model = K.train(docs_of([(1, "a b c a b")]).select("text"))
    assert K.load(spark, model["folder"]) == model


def test_nothing_to_learn_and_empty_table(spark, docs_of):
    model = K.train(docs_of([]).select("text"))
    (row,) = K.scores(docs_of([(3, "a b")]), model).collect()
    assert tuple(row) == (3, 3, 0, 0, 0.0, 0.0)
    assert K.scores(docs_of([]), model).collect() == []


def test_counts_and_word_numbers_beyond_32_bits_are_errors():
    most = (1 << 32) - 1
    assert K.narrow(np.array([0, most], np.uint64)).tolist() == [0, most] and K.narrow(np.zeros(0, np.int64)).dtype == np.uint32
    with pytest.raises(OverflowError):
        K.runs(np.array([1, 2], np.uint64), np.array([1, most + 1]), np.zeros(2, np.int32))
    with pytest.raises(OverflowError):
        K.count_bigrams(None, "", [most - 1], 1)
