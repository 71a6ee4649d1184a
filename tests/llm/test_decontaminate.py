from __future__ import annotations

import random

import numpy as np
import pytest

from tablepact.llm import decontaminate as D

ITEM = " ".join(f"{w}{i}" for i, w in enumerate(["alpha", "bravo", "char", "delta", "echo", "fox", "golf", "hotel"] * 4))


def sellers(pattern: str, text: str) -> int:
    """Least edits between the pattern and any substring."""
    now = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        last, now = now, [i + 1]
        for j, c in enumerate(text):
            now.append(min(last[j] + (p != c), last[j + 1] + 1, now[j] + 1))
    return min(now)


def brute(docs, items):
    out = set()
    for d, text in docs:
        for k, item in items:
            n = D.normalise(item)
            if len(n) >= D.MIN_CHARS and any(sellers(w, D.normalise(text)) <= D.budget(len(w), D.Q, D.ERROR_PERCENT) for _, w in D.cut_windows(n, D.WINDOW)):
                out.add((d, k))
    return out


def edited(text: str, edits: int, rng: random.Random) -> str:
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        match rng.randrange(3):
            case 0:
                chars[at] = "z"
            case 1:
                del chars[at]
            case _:
                chars.insert(at, "q")
    return "".join(chars)


def test_matches_brute_force(spark, docs_of):
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice(["alpha", "the", "of", "bravo7", "golf", "some", "words"]) for _ in range(n))
    items = [(1, ITEM), (2, ITEM[40:110].upper()), (3, "short one"), (4, filler(30)), (5, None), (6, "twenty-four characters or so")]
    docs = [(i, f"{filler(20)} {edited(ITEM[s : s + n], e, rng)} {filler(15)}")
            for i, (s, n, e) in enumerate([(0, 200, 0), (0, 200, 4), (10, 120, 8), (10, 120, 14), (50, 96, 9), (50, 96, 20), (0, 60, 0), (100, 100, 2)])]
    docs += [(20, ITEM.replace(" ", "\n, ").upper()), (21, ""), (22, None), (23, items[3][1]), (24, "Twenty-four characters, or so!"), (25, ITEM[:90] + "\n" + filler(400) + ITEM)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 10
    for part_chars in (D.PART_CHARS, 300):
        got = D.leaks(docs_of(docs, item_id=1, start=2), bench, part_chars=part_chars).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    dirty = {d for d, _ in want}
    kept = D.drop_contaminated(docs_of(docs), bench).collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, _ in docs if d not in dirty)


def test_edge_alignments_at_the_ends_of_texts():
    w = D.Windows([ITEM[:96]], D.Q, D.ERROR_PERCENT)
    e = D.budget(96, D.Q, D.ERROR_PERCENT)
    texts = [ITEM[e:96], ITEM[: 96 - e], ITEM[e + 1 : 96], "x", ITEM[:96]]
    found = {t: (edits, end) for t, _, edits, end in w.matches(texts)}
    want = {t: sellers(ITEM[:96], D.normalise(x)) for t, x in enumerate(texts)}
    assert {t: v[0] for t, v in found.items()} == {t: d for t, d in want.items() if d <= e}
    assert found[4] == (0, 96) and found[0][0] == e


def test_bound_is_never_zero():
    for n in range(D.MIN_CHARS, 200):
        e = D.budget(n, D.Q, D.ERROR_PERCENT)
        assert n + 1 - D.Q * (e + 1) >= 1


def test_qgram_keys_tell_qgrams_apart():
    codes = np.frombuffer("abcabcabd".encode("utf-32-le"), np.uint32)
    keys = D.qgram_keys(codes, 3)
    assert keys[0] == keys[3] and len(set(keys.tolist())) == 4


@pytest.mark.parametrize("rows", [[], [(1, None), (1, ""), (2, "no leak here at all, only plain words")]])
def test_nothing_to_find(spark, docs_of, rows):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert D.leaks(docs_of(rows), bench).collect() == []
    assert D.drop_contaminated(docs_of(rows), bench).count() == len(rows)
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(docs_of(rows), none).collect() == []


def test_repeated_rows_give_one_row(spark, docs_of):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM)], "item_id long, text string")
    (row,) = D.leaks(docs_of([(5, ITEM)] * 3), bench).collect()
    assert (row.doc_id, row.item_id, row.edits, row.first_char, row.last_char) == (5, 1, 0, 0, len(ITEM))


def test_excerpts_are_found_wherever_they_begin():
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(n))
    items = [words(60)[:300].strip() for _ in range(3)] + [words(2000)]
    texts, want = [], []
    for n in (87, 90, 96, 104, 115):
        for k, item in enumerate(items):
            for at in [*(rng.randrange(len(item) - n) for _ in range(6)), 0, len(item) - n, *([4096 - n // 2, 4095, 4096, 4010] if k == 3 else [])]:
                texts.append(f"{words(9)} zz{item[at : at + n]}zz {words(9)}")
                want.append(k)
    pieces = [(k, s, t) for k, item in enumerate(items) for s, t in D.cut_pieces(item, D.WINDOW)]
    found = D.Windows([t for *_, t in pieces], D.Q, D.ERROR_PERCENT).stretches(texts)
    assert len(pieces) > len(items) and {(t, pieces[w][0]) for t, w, *_ in found} == set(enumerate(want))
    rows = {(t, pieces[w][0]): r for t, w, *r in found}
    (n, edits, _, _), text = rows[6, 0], D.normalise(texts[6])
    distances = [sellers(w, text) for _, w in D.cut_windows(items[0], D.WINDOW)]
    assert (n, edits) == (sum(d <= 9 for d in distances), min(distances))


@pytest.mark.parametrize("window, error_percent", [(200, 11), (400, 12)])
def test_budgets_beyond_a_band(window, error_percent):
    rng = random.Random(9)
    item = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=window))
    e = D.budget(window, D.Q, error_percent)
    assert e > D.BAND
    texts = ["x" * k + item[: window // 2] + "q" * e + item[window // 2 :] for k in range(2 * D.BAND)]
    assert {t: d for t, _, d, _ in D.Windows([item], D.Q, error_percent, window).matches(texts)} == {t: sellers(item, x) for t, x in enumerate(texts)}


def test_short_items_match_whole(spark, docs_of):
    items = [(1, "Who is Zorro?"), (2, "中国的首都是哪里"), (3, "42"), (4, "?!"), (5, "twelve long words q"), (6, "")]
    docs = [(1, "Q: who is zorro... a fox"), (2, "who is zorros"), (3, "问题中国的首都是哪里呢"), (4, "it is 42"), (5, "it is 421 or 142"), (6, "Twelve, long words Q"), (7, "twelve long word q"), (8, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.leaks(docs_of(docs), bench).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in got} == {(1, 1, 0), (3, 2, 0), (4, 3, 0), (6, 5, 0)}
    assert [r.doc_id for r in D.drop_contaminated(docs_of(docs), bench).orderBy("doc_id").collect()] == [2, 5, 7, 8]
