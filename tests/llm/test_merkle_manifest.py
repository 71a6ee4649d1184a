"""The manifest against a plain tree; versions share what they do not copy."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tablepact.llm import merkle_manifest as M


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def climb(levels, i, node, siblings):
    for level in levels[:-1]:
        run, k = level[i // 3 * 3 : i // 3 * 3 + 3], i % 3
        siblings += run[:k] + run[k + 1 :]
        node = H(*run[:k], node, *run[k + 1 :])
        i //= 3
    return node


def expected(rows):
    """REPORT without ``source`` of (doc_id, text, lang, source) rows."""
    by = {}
    for i, text, lang, source in rows:
        by.setdefault(source, []).append((i, source, lang, None if text is None else len(text), text))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = tree([leaf(*r) for r in by[s]])
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for rank, s in enumerate(sources):
        for place, r in enumerate(by[s]):
            odd = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 2
            other = r if odd or r[4] is None else (*r[:4], r[4].replace("\n", ""))
            siblings = []
            node = climb(top, rank, climb(trees[s], place, leaf(*other), siblings), siblings)
            root = top[-1][0]
            out.append((r[0], leaf(*r), trees[s][-1][0], root, H(*siblings), node, node == root))
    return sorted(out, key=repr)


def reported(docs):
    return sorted(map(tuple, M.Manifest(docs, M.tampered_text()).report().drop("source").collect()), key=repr)


def sample(n, seed=1):
    rng = random.Random(seed)
    rows = [(i, f"line {i}\nnext" if i % 3 else f"line {i}", "en", rng.choice(["hot", "hot", "b", "é", "Z", "", None])) for i in range(n)]
    return rows + [(3, "twice\n", "en", "hot"), (3, "twice\n", "en", "hot"), (3, "other\n", None, "hot"), (None, "no id\n", "en", "b"),
                   (None, None, None, None), (7, "", "en", "lone"), (8, "long \U0001f600 " * 40_000 + "\n", "en", "lone2")]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_report_is_that_of_a_plain_tree_at_any_block_size(docs_of, monkeypatch, levels):
    monkeypatch.setattr(M, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(M, "BLOCK", 3**levels)
    rows = sample(120)
    assert reported(docs_of(rows, index=1, part="x", leaf=2, root=None).repartition(5)) == expected(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_full_and_ragged_trees(docs_of, monkeypatch, n):
    monkeypatch.setattr(M, "BLOCK_LEVELS", 2)
    monkeypatch.setattr(M, "BLOCK", 9)
    rows = [(i, "a\nb", "en", "s") for i in range(n)]
    assert reported(docs_of(rows)) == expected(rows)


def test_versions_copy_their_ancestors_only(docs_of, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_LEVELS", 2)
    monkeypatch.setattr(M, "BLOCK", 9)
    docs = docs_of(sample(60))
    m = M.Manifest(docs, M.tampered_text())
    nodes = {(r["source"], r["on_top"], r["level"], r["index"]): r["digest"] for r in m.nodes().collect()}
    assert len(nodes) == m.nodes().count()
    for (source, on_top, level, index), digest in nodes.items():
        below = [nodes[source, on_top, level - 1, i] for i in range(3 * index, 3 * index + 3) if (source, on_top, level - 1, i) in nodes]
        assert level == 0 or digest == H(*below)
    top = max(k[2] for k in nodes if k[1])
    assert nodes[None, True, top, 0] == m.root
    tampered = m.report().where("not verified")
    copied = m.versions()
    assert copied.where("level = 0 and not on_top").count() == tampered.count() > 10
    # each version: one node a level, each the hash of the copied child among shared siblings, the last its own root
    roots = {r["digest"] for r in copied.where((F.col("level") == top) & F.col("on_top")).collect()}
    assert roots == {r["folded_root"] for r in tampered.collect()} and m.root not in roots
    height = {s: max(k[2] for k in nodes if k[0] == s and not k[1]) for s in {k[0] for k in nodes if not k[1]}}
    counts = copied.groupBy("source", "on_top", "level").count().collect()
    for r in counts:
        assert r["level"] <= (top if r["on_top"] else height[r["source"]])
    per_level = {(r["source"], r["on_top"], r["level"]): r["count"] for r in counts}
    assert all(per_level[s, on_top, lv] == per_level[s, False, 0] for s, on_top, lv in per_level)


def test_untampered_rows_verify_and_a_changed_field_does_not(docs_of):
    docs = docs_of([(i, f"t{i}\n", "en", "s") for i in range(30)])
    assert M.Manifest(docs).report().where("not verified").count() == 0
    other = M.Manifest(docs, F.when(F.col("doc_id") == 4, F.lit("forged")).otherwise(F.col("text")))
    assert [r["doc_id"] for r in other.report().where("not verified").collect()] == [4]


def test_empty_table(docs_of):
    m = M.Manifest(docs_of([]))
    assert m.root is None and m.report().count() == 0 and m.versions().count() == 0 and m.nodes().count() == 0
