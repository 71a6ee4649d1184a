from __future__ import annotations

import hashlib

import pytest

from tablepact.llm import warc_index as W

BIG = "<p>" + "same page " * 40 + "</p>"


def rows_of():
    rows = [(i, f"http://h{i % 5}.example.com/p/{i}?q={i % 3}", f"<html>page {i} {'x' * (i * 7 % 200)}</html>") for i in range(40)]
    rows += [(100 + i, "https://copy.example.org/", BIG) for i in range(30)] + [(90, "http://first.example/ü?a=b c#f", BIG)]
    rows += [(200, None, None), (201, "", ""), (202, "not a url\r\nX: y", "é" * 60), (203, "http://[bad", "é" * 60), (204, "mailto:a@b", BIG + "\r\n\r\n")]
    return rows + [(90, "http://first.example/again", BIG), (None, "http://noid.example/", BIG), (None, "u", "y" * 500)]


def brute(rows):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        f = first.get(data)
        revisit = f is not None and f != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return out


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("block_lines", [W.BLOCK_LINES, 3])
def test_reads_back_what_was_written(spark, block_lines):
    rows = rows_of()
    got = W.captures(pages_of(spark, rows), block_lines=block_lines).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_lookup_by_url(spark):
    rows = rows_of()
    folder, directory = W.archive(pages_of(spark, rows), block_lines=4)
    index = W.CaptureIndex(directory, folder)
    for page_id, url, html in rows[::5]:
        found = [r for r in index.lookup(url or "") if r["page_id"] == page_id]
        assert found and all(r["payload"] in (None, (html or "").encode()) for r in found)
    assert len(index.lookup("https://copy.example.org/")) == 30
    assert index.lookup("http://absent.example/") == [] and index.lookup("zzz") == [] and index.lookup("") != []


def test_keys_reverse_the_host():
    assert W.url_key("http://a.b.example.com:81/x?y=1#z") == "com,example,b,a:81)/x?y=1"
    assert W.url_key("HTTP://EXAMPLE.com") == "com,example)/"


def test_a_damaged_record_is_not_returned():
    data = W.record(1, "http://x/", b"payload", hashlib.sha256(b"other").hexdigest(), None)
    with pytest.raises(ValueError):
        W.parse(data)


def test_no_pages(spark):
    assert W.captures(pages_of(spark, [])).collect() == []
    assert W.CaptureIndex(W.archive(pages_of(spark, []))[1], "/nowhere").lookup("http://x/") == []
