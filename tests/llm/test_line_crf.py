from __future__ import annotations

import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tablepact.llm import line_crf as C

TEXTS = ["", None, " \n\t\n", "one", "a b c a b c", "a b c d a b c d\n\n a b", "x\n x\nx\r\nx\nx", "é ü%%% |\x0bq\x0cr\x1cs " * 30, "a a a a", "a b a b a b\nz", "# * $ % & | < >",
         "w " * 40_000, " ".join(f"u{i}" for i in range(3000)) + " u1 u2 u3"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:]))
    times, marked = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            marked |= {i, i + 1, i + 2}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked))


@pytest.mark.parametrize("text", TEXTS)
def test_base_measures(text):
    assert C.measure(text or "", None)[:5] == brute(text)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 8):
        unary, trans = rng.normal(size=n), rng.normal(size=(2, 2)).tolist()
        value = lambda p: sum(u * s for u, s in zip(unary, p)) + sum(trans[a][b] for a, b in zip(p, p[1:]))  # noqa: E731,B023
        assert value(C.viterbi(unary, trans)) == pytest.approx(max(value(p) for p in product((0, 1), repeat=n)))


def test_fit_climbs_the_likelihood():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 60)
    texts = [np.stack([np.ones(n), rng.random(n) < (0.8 if k else 0.2)], axis=1).astype(np.int8) for k, n in zip(y, rng.integers(1, 9, 60))]

    def likelihood(w, trans):
        total = 0.0
        for t, k in zip(texts, y):
            scores = [sum((t[i] @ w) * s for i, s in enumerate(p)) + sum(trans[a][b] for a, b in zip(p, p[1:])) for p in product((0, 1), repeat=len(t))]
            gold = sum((t[i] @ w) * k for i in range(len(t))) + trans[k][k] * (len(t) - 1)
            total += gold - np.logaddexp.reduce(scores)
        return total / sum(map(len, texts))

    w, trans = C.fit(texts, y, decay=1e-4)
    best = likelihood(w, trans)
    assert best > likelihood(np.zeros(2), np.zeros((2, 2)))
    for i in range(2):  # near the top every direction falls, but for the small decay
        for step in (-0.3, 0.3):
            moved = w.copy()
            moved[i] += step
            assert likelihood(moved, trans) < best + 2e-3


def corpus(n=80):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    clean = lambda: "\n".join(" ".join([word().title(), *(word() for _ in range(14))]) + "." for _ in range(6))
    junk = lambda: "\n".join(" | ".join(word() for _ in range(10)) + " |%%%" for _ in range(8))
    rows = [(i, clean() if i % 3 else junk()) for i in range(n)]
    return rows, [(i, int(i % 3 > 0), 0) for i in range(n)], clean, junk


def test_quality(spark, docs_of):
    rows, labels, clean, junk = corpus()
    odd = list(enumerate(TEXTS, 1000)) + [(2000, clean()), (2001, junk()), (2002, clean() + "\n" + "a | b |%%%\n" * 3), (None, clean()), (2003, clean()), (2003, clean())]
    labels_df = spark.createDataFrame(labels + [(1, None, 1), (None, 0, 0), (9999, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = C.quality(docs_of(rows + odd, kept=1, m=2, quality=0, y=3), labels_df).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in got}
    for i, t in [*rows, *odd[: len(TEXTS)]]:
        r = by_id[i]
        assert tuple(r[1:6]) == brute(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert all(by_id[i].kept == bool(i % 3) for i, _ in rows)
    assert by_id[2000].kept and not by_id[2001].kept and by_id[2002].kept


def test_nothing_to_learn(spark, docs_of):
    rows, labels, clean, _ = corpus(6)
    one_kind = spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    for lab in (one_kind, one_kind.limit(0)):
        assert all(r.kept and r.content_share == 1 for r in C.quality(docs_of([(1, clean())]), lab).collect())
    assert C.quality(docs_of([]), one_kind).collect() == []


def test_training_takes_whole_documents(spark, docs_of, monkeypatch):
    long = "\n".join([f"line {i} of the text" for i in range(500)] + ["line 3 of the text", "the end | | |"])
    rows = [(1, long), (2, "a short one\nof two lines"), (3, long + "\nmore"), (4, "another"), (5, "a | b |\n" * 300)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (4, 0, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(C, "fit", lambda texts, y: seen.append(sorted(t.tobytes() for t in texts)) or (np.zeros(len(C.FEATURES)), np.zeros((2, 2))))
    whole = {i: C.text_features(C.lines_of(t)).tobytes() for i, t in rows}
    assert C.train(docs_of(rows), labels) is not None and seen[-1] == sorted(whole.values())
    assert C.train(docs_of(rows), labels, max_train_lines=2) is not None
    assert len(seen[-1]) in (2, 3) and set(seen[-1]) <= set(whole.values())
