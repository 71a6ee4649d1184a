from __future__ import annotations

import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tablepact.llm import simhash_anchor as S


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks, distance=3):
    """Label of each mark: the smallest mark reachable."""
    distinct = sorted(set(marks))
    label = {m: m for m in distinct}
    changed = True
    while changed:
        changed = False
        for a in distinct:
            for b in distinct:
                if (a ^ b).bit_count() <= distance and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def cloud(rng, centres, members, flips):
    out = []
    for _ in range(centres):
        at = int(rng.integers(0, 1 << 63)) << 1 | int(rng.integers(0, 2))
        for _ in range(members):
            out.append(at)
            for b in rng.choice(64, flips, replace=False):
                at ^= 1 << int(b)
    return out


TEXTS = ["", None, " \t\n", "One", "one two", "ÀB cd ef", "a b c d e f g h", "A B  C d\te F g h", "word " * 2000, "x\x1cy z w"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert S.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("width", [7, 8, 16, 31, 32, 33])
def test_every_point_is_near_its_anchor_and_neighbours_meet(width):
    rng = np.random.default_rng(1)
    points = rng.integers(0, 1 << width, 300, np.uint64)
    home = S.home(points, width)
    assert np.bitwise_count(home ^ points).max() <= 1
    assert (S.home(home, width) == home).all()
    for flip in range(width):
        other = points ^ np.uint64(1 << flip)
        i, a = S.anchors(other, 0, width, 1)
        met = {(int(k), int(v)) for k, v in zip(i, a)}
        assert all((k, int(h)) in met for k, h in enumerate(home))


@pytest.mark.parametrize(("segments", "hot"), [(2, 2000), (2, 3), (1, 2000), (4, 5)])
def test_links_connect_as_brute_force(spark, segments, hot):
    rng = np.random.default_rng(segments)
    marks = cloud(rng, 4, 5, 2) + cloud(rng, 3, 4, 4) + [0, 7] if segments > 1 else cloud(rng, 1, 4, 3)
    signed = np.array(marks, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(m,) for m in sorted(set(signed))], "fingerprint long")
    if segments == 4:  # threshold 0 in a part: equal parts meet
        assert S.MAX_DISTANCE // segments == 0
    edges = [(r.a, r.b) for r in S.links(df, 3, segments, hot).collect()]
    as_unsigned = lambda x: x & (1 << 64) - 1
    assert all((as_unsigned(a) ^ as_unsigned(b)).bit_count() <= 3 for a, b in edges)
    want = brute_components([as_unsigned(m) for m in signed])
    got = {m: m for m in want}
    for _ in got:
        for a, b in edges:
            a, b = as_unsigned(a), as_unsigned(b)
            got[a] = got[b] = min(got[a], got[b])
    assert got == want


def test_forest_spans_a_crowd_with_few_edges():
    marks = np.arange(512, dtype=np.uint64)
    edges = S.forest(marks, 3)
    assert len(edges) == 511


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.label for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_near_duplicates(spark, docs_of):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(9, base), (4, base), (6, base.replace("word7 ", "other ")), (2, "quite another text of some words here"), (1, ""), (8, None), (3, "\n"), (5, base)]
    got = {r.doc_id: r for r in S.near_duplicates(docs_of(rows, fingerprint="x", component_id=1)).collect()}
    marks = {i: brute_fingerprint(t) for i, t in rows}
    label = brute_components(list(marks.values()))
    for i, _ in rows:
        assert got[i].fingerprint == f"{marks[i]:016x}"
        assert got[i].component_id == min(j for j in marks if label[marks[j]] == label[marks[i]])
    assert S.near_duplicates(docs_of([])).collect() == []


def test_keep_one_and_repeated_or_missing_ids(spark, docs_of):
    rows = [(3, "a b c d e"), (3, "a b c d e"), (7, "a b c d e"), (None, "p q r s t"), (None, "p q r s t"), (None, "a b c d e"), (4, "u v w x y")]
    kept = S.keep_one(docs_of(rows, root=1))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(3, "a b c d e"), (4, "u v w x y"), (None, "p q r s t")]
    assert "root" in kept.columns
    assert S.keep_one(docs_of([])).collect() == []
