from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from tablepact.llm import source_mix as M


def brute_targets(sizes: dict, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if each * weight[s] >= most * sizes[s]}
        if not over:
            target |= {s: each * weight[s] for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 1000, "c": 50}, {"a": 1, "é": 5, "z": 0, None: 7}, {"a": 10}, {None: 3, "": 4}, {f"s{i}": (i * 37) % 91 for i in range(40)}])
def test_targets(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    got = {r.source: r.target for r in M.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permuted_is_a_permutation(n):
    out = M.permuted(np.arange(n), n, [1, 2, 3])
    assert sorted(out.tolist()) == list(range(n))
    assert (out[n // 2 :] == M.permuted(np.arange(n // 2, n), n, [1, 2, 3])).all()


def test_shards_share_out_the_quotas_exactly():
    quotas = np.array([1000, 0, 17, 333, 5])
    shards = -(-quotas.sum() // 64)
    before = np.zeros_like(quotas)
    for s in range(shards):
        first, here = M.shard_counts(quotas, s, shards, 64, 9)
        assert (first == before).all() and here.min() >= 0
        assert here.sum() == min(64, quotas.sum() - 64 * s)
        before += here
    assert (before == quotas).all()


def rows_of(n=60):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(int(rng.integers(0, 300)))), "en", ["a", "b", "c", None][int(rng.integers(0, 4)) if i % 3 else 0]) for i in range(n)]
    return rows + [(500, None, "en", "a"), (501, "", "en", "d"), (502, " \n\t", "en", None), (507, "again and again", "en", "a"), (507, "again and again", "en", "a"), (None, "no id", "en", "b")]


def test_report_and_documents(spark, docs_of):
    rows = rows_of()
    docs = docs_of(rows, target=1, taken=2, size=3, start=4)
    mix = M.Mix(docs, block_words=16, shard_blocks=32)
    report = mix.report().collect()
    assert len(report) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    assert sorted(r.size for r in report) == sorted(len((t or "").split()) for _, t, _, _ in rows)
    source = {r.doc_id: r for r in report}
    for s in want:
        mine = [i for i, _, _, src in rows if src == s and i not in (507, None)]
        assert all(source[i].target == pytest.approx(want[s]) and source[i].source_size == sizes[s] for i in mine)
    assert all(0 <= r.taken <= 2 * r.size for r in report)
    taken, owner = defaultdict(int), {i: s for i, _, _, s in rows}
    for r in report:
        taken[owner[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 16 for s in want)
    again = M.Mix(docs, block_words=16, shard_blocks=32).report().collect()
    assert sorted(map(str, again)) == sorted(map(str, report))
    # the mix as documents holds just these words
    out = mix.documents()
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    words = defaultdict(int)
    texts = {i: t for i, t, _, _ in rows}
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text) and set(r.text.split()) <= set(texts[r.doc_id].split())
        if len(r.text.split()) == len(texts[r.doc_id].split()):
            assert r.text == texts[r.doc_id]
    want_words = defaultdict(int)
    for r in report:
        want_words[r.doc_id] += r.taken
    assert {i: n for i, n in want_words.items() if n} == dict(words)
    # blocks: full slots numbered through the shards, each piece within its document
    blocks = mix.blocks().collect()
    assert sum(b.to_word - b.from_word for b in blocks) == sum(words.values())


def test_one_source_of_most_rows(spark, docs_of):
    docs = docs_of([(i, "a b c d e f g h " * 20, "en", "hot" if i % 3 else "other") for i in range(90)])
    got = M.Mix(docs, block_words=32, shard_blocks=16).report().collect()
    assert len(got) == 90 and sum(r.taken for r in got) == pytest.approx(1.5 * 90 * 160, abs=64)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (2, " ")]])
def test_nothing_to_mix(spark, docs_of, rows):
    mix = M.Mix(docs_of(rows))
    assert [(r.size, r.taken, r.target) for r in mix.report().collect()] == [(0, 0, 0.0)] * len(rows)
    assert mix.documents().collect() == []
