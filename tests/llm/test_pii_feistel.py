from __future__ import annotations

import random
import re

import pytest

from tablepact.llm import pii_feistel as P

TEXT = ("Mail Anna.B-7@mail3.example.com or anna.b-7@mail3.example.com, call +1 (017) 555-7713 or 212-555-0199, +49 30 1234 5678; card 4111 1111 1111 1111 "
        "or 4845168114407329, not 4845168114407328; 97.51.17.173 not 300.1.1.1; born 1987-02-28 and 31.12.1999, not 2023-02-30; SSN 123-45-6789 not 000-12-3456; "
        'IBAN DE89 3704 0044 0532 0130 00 not DE88370400440532013000; token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" version 3.0.1.2')


@pytest.mark.parametrize("size", [1, 2, 10, 97, 256, 1000])
def test_permutation_is_one_to_one_and_inverted(size):
    p = P.Permutation("k", "t", size)
    image = [p(i) for i in range(size)]
    assert sorted(image) == list(range(size))
    assert [p(v, back=True) for v in image] == list(range(size))
    if size > 90:
        assert image != [P.Permutation("other", "t", size)(i) for i in range(size)]


def test_large_domains_round_trip():
    p = P.Permutation("k", "t", 36**30)
    assert all(p(p(v), back=True) == v and p(v) < p.size for v in (0, 1, 36**30 - 1, 123456789**3))


def test_formats_and_checks_are_kept():
    new, counts = P.Pseudonymiser("k")(TEXT)
    assert counts == {"email": 2, "secret": 1, "iban": 1, "card": 2, "date": 2, "ssn": 1, "ipv4": 2, "phone": 3}
    layout = lambda t: re.sub(r"[0-9]", "9", re.sub(r"[A-Za-z]", "a", re.sub(r"(\d+\.){3}\d+", "ip", re.sub(r"[0-9a-f]{40}", "hex", t))))
    assert layout(new) == layout(TEXT)
    for gone in ("Anna.B-7", "anna.b-7", "555-7713", "212-555-0199", "4111 1111", "4845168114407329", "97.51.17.173", "1987-02-28", "31.12.1999", "123-45-6789", "3704 0044", "04dbebab"):
        assert gone not in new
    for kept in ("4845168114407328", "300.1.1.1", "2023-02-30", "000-12-3456", "DE88370400440532013000"):
        assert kept in new
    again, counts_again = P.Pseudonymiser("k")(new)
    assert counts_again == counts and again != new
    assert P.Pseudonymiser("k")(new, back=True)[0] == TEXT
    assert P.Pseudonymiser("other")(TEXT)[0] != new


def test_equal_values_stay_linked_across_documents(spark, docs_of):
    rows = [(i, f"note {i}: card 4845168114407329 of mail x{i % 2}@a.example.org") for i in range(20)] + [(50, None), (51, ""), (52, "nothing " * 40_000)]
    docs = docs_of(rows, n_email=1, p="x")
    got = {r.doc_id: r for r in P.pseudonymise(docs).collect()}
    cards = {re.search(r"\d{16}", got[i].text).group() for i in range(20)}
    mails = {i % 2: re.search(r"\S+@\S+", got[i].text).group() for i in range(20)}
    assert len(cards) == 1 and P.luhn(next(iter(cards))[:-1]) == int(next(iter(cards))[-1]) and mails[0] != mails[1]
    assert (got[50].text, got[50].n_card, got[51].text, got[52].text) == (None, 0, "", rows[-1][1])
    back = {r.doc_id: r.text for r in P.restore(P.pseudonymise(docs)).collect()}
    assert back == dict(rows)
    assert P.pseudonymise(docs_of([])).collect() == []


CARD, IBAN = "4111 1111 1111 1111", "AT61 1904 3002 3457 3201"


@pytest.mark.parametrize("text, value, kind", [
    ("pay 4111 1111 1111 1111 12/25", CARD, "card"), ("card 4111 1111 1111 1111 123", CARD, "card"), ("order 12 4111111111111111", "4111111111111111", "card"),
    ("4111-1111-1111-1111 9 left", "4111-1111-1111-1111", "card"), ("7 12 4111 1111 1111 1111 12 25 123 x", CARD, "card"), ("a 4111111111111111 20b", "4111111111111111", "card"),
    (f"{IBAN} BIC X", IBAN, "iban"), (f"AB12 {IBAN} EUR 100", IBAN, "iban"), (f"to {IBAN} EURo", IBAN, "iban")])
def test_values_beside_other_groups(text, value, kind):
    p = P.Pseudonymiser("k")
    new, counts = p(text)
    assert counts == dict.fromkeys(P.NAMES, 0) | {kind: 1}
    assert value not in new and new == text.replace(value, p(value)[0])
    assert p(new, back=True)[0] == text


def test_any_stretch_is_restored_and_keeps_no_valid_value():
    rng = random.Random(3)
    number = lambda: "".join(rng.choices("0123456789", k=rng.choice([1, 2, 3, 4, 4, 4, 5, 16])))
    p = P.Pseudonymiser("k")
    n = 0
    for _ in range(300):
        body = "".join(rng.choices("0123456789", k=15))
        full = body + str(P.luhn(body))
        text = rng.choice(" -").join([*(number() for _ in range(rng.randrange(4))), rng.choice([full, *[" ".join(full[i : i + 4] for i in range(0, 16, 4))] * 2]), *(number() for _ in range(rng.randrange(4)))])
        new, counts = p(text)
        n += counts["card"]
        assert sum(counts.values()) and len(new) == len(text) and p(new)[1] == counts and p(new, back=True)[0] == text
    assert n >= 290
    table = " ".join(number() for _ in range(3000))
    new, counts = p(table)
    assert counts["card"] > 100 and p(new, back=True)[0] == table


@pytest.mark.parametrize("text", ["03/14/1985", "3/14/1985", "3/4/1985", "14-03-1985", "3-4-1985", "12/3/1985", "14.3.1985", "1985-3-14", "1985/3/4", "2021-03-04", "12-31-2099"])
@pytest.mark.parametrize("around", ["born {}", "({}),", "on {}."])
def test_dates_in_many_layouts(text, around):
    p = P.Pseudonymiser("k")
    new, counts = p(around.format(text))
    assert counts["date"] == 1 and text not in new and p(new, back=True)[0] == around.format(text)
    assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", around.format(text)) and p(new)[1] == counts


def test_dates_before_a_time_and_no_dates():
    p = P.Pseudonymiser("k")
    for text in ("2021-03-04T10:00:00Z", "at 2021-03-04T10:00:00+01:00", "14/03/2021T1000"):
        new, counts = p(text)
        assert counts["date"] == 1 and new.split("T")[1] == text.split("T")[1] and new != text and p(new, back=True)[0] == text
    for text in ("31/13/1985", "13/32/1985", "0/4/1985", "1985-13-1", "2/30/1985", "3/4/1885", "1/2/3", "2021-03-04Tx", "a2021-03-04", "1985-03-145"):
        assert p(text) == (text, dict.fromkeys(P.NAMES, 0))


@pytest.mark.parametrize("layout", ["{m}/{d}/{y}", "{d}/{m}/{y}", "{m:02d}/{d:02d}/{y}", "{m:02d}-{d}-{y}", "{d:02d}-{m}-{y}"])
def test_date_map_is_one_to_one(layout):
    p = P.Pseudonymiser("k")
    texts = {layout.format(m=m, d=d, y=y) for y in (1985, 2004) for m in range(1, 13) for d in range(1, 29)}
    images = {t: p(t)[0] for t in texts}
    assert len(set(images.values())) == len(texts) and all(p(v, back=True)[0] == t for t, v in images.items())
