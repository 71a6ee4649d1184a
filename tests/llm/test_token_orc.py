from __future__ import annotations

import zlib
from array import array

from tablepact.llm import token_orc
from tablepact.llm.common import new_folder

ODD = ["", None, "a", "Hello,  World's \t END\x1c\x85 of 12 lines\n\n<|endoftext|> x", "É́a ﬁ ①", "word " * 30_000, "it's we'll 'RE"]


def brute(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_orc.vocabulary_path(token_orc.VOCABULARY))
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    return out


def test_matches_whole_text_encoding(spark, docs_of):
    rows = [(37 * i % 101, ODD[i % len(ODD)]) for i in range(60)]
    got = token_orc.token_digests(docs_of(rows, start=7, ids="x", shard="y")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_repeated_rows_null_ids_and_empty_table(spark, docs_of):
    rows = [(3, "same text")] * 4 + [(None, "no id"), (1, "one")]
    got = token_orc.token_digests(docs_of(rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)
    assert token_orc.token_digests(docs_of([])).collect() == []


def test_lookup_reads_ids_back(spark, docs_of):
    path = new_folder(spark, "token-orc-test")
    token_orc.write_token_orc(docs_of([(i, f"text number {i}") for i in range(50)]), path)
    (row,) = token_orc.lookup(spark, path, [17]).collect()
    assert row.doc_id == 17 and row.ids[-1] == token_orc.END_ID and row.n_tokens == len(row.ids)
