from __future__ import annotations

import math
import random
from fractions import Fraction
from itertools import product

import numpy as np
import pytest

from tablepact.llm import language_id as L
from tablepact.llm.token_orc import vocabulary_path


@pytest.fixture(scope="module")
def pieces():
    return L.Pieces(vocabulary_path(L.VOCABULARY))


def vocabulary_texts():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(L.VOCABULARY))
    return sorted({model.id_to_piece(i) for i in range(model.get_piece_size())
                   if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})


def segmentations(word):
    for cuts in product((0, 1), repeat=len(word) - 1):
        out, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                out.append(word[at:i])
                at = i
        yield [*out, word[at:]]


@pytest.mark.parametrize("word", ["▁the", "▁ersten", "▁añ中\U0001f600x", "z"])
def test_forward_and_expected_counts_sum_all_segmentations(pieces, word):
    number = {t: i for i, t in enumerate(vocabulary_texts())}
    rng = np.random.default_rng(3)
    table = rng.random(pieces.size + 1)
    total, counts = 0.0, np.zeros(len(table))
    for parts in segmentations(word):
        ids = [number.get(p, pieces.size if len(p) == 1 else None) for p in parts]
        if None not in ids:
            p = np.prod(table[ids])
            total += p
            np.add.at(counts, ids, p)
    assert np.exp(L.forward(pieces, [word], table[:, None])[0, 0]) == pytest.approx(total)
    got = L.expected_counts(pieces, [word], table, np.array([2.0]))
    assert np.allclose(got, 2 * counts / total)


def exact(word, table, number, size):
    """(log of the sum over all segmentations, expected counts) in exact fractions of the doubles."""
    p = lambda i, j: Fraction(table[at]) if (at := number.get(word[i:j], size if j - i == 1 else None)) is not None else None
    n, longest = len(word), max(map(len, number))
    alpha, beta = [Fraction(1)] + [Fraction(0)] * n, [Fraction(0)] * n + [Fraction(1)]
    edges = [(i, j, q) for i in range(n) for j in range(i + 1, min(n, i + longest) + 1) if (q := p(i, j)) is not None]
    for i, j, q in edges:
        alpha[j] += alpha[i] * q
    for i, j, q in reversed(edges):
        beta[i] += q * beta[j]
    counts = np.zeros(size + 1)
    for i, j, q in edges:
        counts[number.get(word[i:j], size)] += float(alpha[i] * q * beta[j] / alpha[n])
    return math.log(alpha[n].numerator) - math.log(alpha[n].denominator), counts


@pytest.mark.parametrize("word", ["▁" + "international" * 12, "▁" + "the中😀" * 30, "▁" + "a" * 131, "▁donau" + "dampfschiff" * 9, "▁" + "q" * 30, "▁" + "q" * 31])
def test_long_words_are_not_cut(pieces, word):
    number = {t: i for i, t in enumerate(vocabulary_texts())}
    rng = np.random.default_rng(5)
    table = rng.random((pieces.size + 1, 2)) * 1e-6  # a plain product over such a word leaves the range of doubles
    words = [word, word[:-1] + "é"]
    logs = L.forward(pieces, words, table)
    for w, row in zip(words, logs):
        for k in range(2):
            log, counts = exact(w, table[:, k], number, pieces.size)
            assert row[k] == pytest.approx(log, rel=1e-12)
            assert np.allclose(L.expected_counts(pieces, [w], table[:, k], np.array([3.0])), 3 * counts, atol=1e-9)
            parts = pieces.independent(w)
            assert "".join(parts) == w and sum(L.forward(pieces, [p], table)[0, k] for p in parts) == pytest.approx(log, rel=1e-12)


def test_long_words_divide_where_no_piece_reaches_across(pieces, monkeypatch):
    words = ["▁" + "語中文字" * 3000, "▁" + "international" * 700, "▁" + "\U0001f600the" * 2000]
    whole = [pieces.independent(w) for w in words]
    assert [max(map(len, p)) for p in whole][0] < 8 and len(whole[2]) >= 4000
    monkeypatch.setattr(L, "LOOKUP", 50)
    assert [pieces.independent(w) for w in words] == whole


def test_words_are_divided_alike_in_training_and_scoring(spark, docs_of):
    text = "one\u00a0two\u3000three\tfour\n five"
    _, words = L.word_counts(docs_of([(1, text, "xx")]), 10)
    scorer = L.TextScorer(L.LanguageModel(["xx"], np.full((40_000, 1), 0.5), L.VOCABULARY), L.Pieces(vocabulary_path(L.VOCABULARY)))
    scorer.score([text])
    assert sorted(r["word"] for r in words.collect()) == sorted(scorer.words) == ["five", "four", "one\u00a0two\u3000three"]


def sample(n):
    rng = random.Random(4)
    stems = {"xx": ["the", "and", "tion", "ing", "er"], "yy": ["die", "und", "heit", "sch", "ä"]}
    return [(i, " ".join("".join(rng.choices(stems[lang], k=2)) for _ in range(30)), lang) for i in range(n) for lang in [("xx", "yy")[i % 2]]]


def test_learns_and_defines_odd_texts(spark, docs_of):
    rows = sample(60) + [(100, None), (101, ""), (102, "123 !!"), (103, "und " * 30_000, None), (104, "the" * 5000, None)]
    got = {r.doc_id: r for r in L.language_predictions(docs_of([(r[0], r[1], r[2] if len(r) > 2 else None) for r in rows], score=1, lang_pred=2)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in sample(60))
    assert [(got[i].lang_pred, got[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert (got[103].lang_pred, got[104].lang_pred) == ("yy", "xx")
    assert all(0 <= r.score <= 1 for r in got.values())


def test_score_is_the_posterior_whatever_the_batches(spark, docs_of):
    docs = docs_of(sample(40))
    model = L.train(docs)
    assert np.allclose(model.table.sum(axis=0), 1)
    scorer = L.TextScorer(model, L.Pieces(vocabulary_path(L.VOCABULARY)))
    texts = [t for _, t, _ in sample(6)]
    assert np.allclose(scorer.score(texts), [scorer.score([t])[0] for t in texts])
    assert scorer.score(["", "the", ""])[[0, 2]].tolist() == [[0, 0], [0, 0]]


def test_no_training_rows_and_empty_table(spark, docs_of):
    (row,) = L.language_predictions(docs_of([(1, "some text", None)])).collect()
    assert (row.lang_pred, row.score) == ("und", 0.0)
    assert L.language_predictions(docs_of([])).collect() == []


def test_keep_identified_drops_only_unrecognised(spark, docs_of):
    docs = docs_of(sample(30) + [(90, "42", "xx"), (91, None, "yy")])
    model = L.train(docs)
    kept = L.keep_identified(docs, model)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30)) and kept.columns == docs.columns
