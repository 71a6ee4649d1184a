from __future__ import annotations

import random
import zlib
from array import array

import pytest

import corpus_pipeline
from tablepact.llm import queries, simhash_anchor, token_orc

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, benchmark and labels with planted cases, documents with an extra column."""
    rng = random.Random(6)
    path = str(tmp_path_factory.mktemp("sf"))
    text = lambda n: " ".join("".join(rng.choices(["the", "and", "ing", "er", "tion", "ou", "st"], k=rng.randrange(1, 4))) for _ in range(n))
    passage = text(40)
    rows = [(i, text(120), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, rows[5][1], "en", "s1") for i in range(10)]  # exact copies
    rows += [(120, rows[6][1].replace("and", "And"), "en", "s2"), (3, rows[3][1], "en", "s0")]  # letter case, a repeated row
    rows += [(130 + i, f"{text(30)} {passage.upper()} {text(20)}", "en", "s0") for i in range(3)]  # benchmark passages
    rows += [(140, "12 34 !!", "en", "s1"), (141, None, None, None), (142, "", "en", None), (143, text(80), None, None)]
    documents = spark.createDataFrame([(*r, len(r[1] or ""), "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, root string")
    documents.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, text(40))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def staged(spark, folder):
    path, _ = folder
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stage(spark, docs, path).cache()
    return out


def test_stages_decide_as_brute_force(spark, folder):
    out = staged(spark, folder)
    _, rows = folder
    for name, df in list(out.items())[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    known = sorted(r.doc_id for r in out["language_id"].collect())
    assert known == sorted(r[0] for r in rows if r[0] not in (140, 141, 142))
    marks = {}
    for i, t, *_ in rows:
        if i in known:
            marks.setdefault(simhash_anchor.fingerprint(t), set()).add(i)
    label = {m: m for m in marks}
    for _ in marks:
        for a in marks:
            for b in marks:
                if (a ^ b).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    groups: dict[int, set[int]] = {}
    for m, ids in marks.items():
        groups.setdefault(label[m], set()).update(ids)
    kept = sorted(r.doc_id for r in out["simhash_near_dedup"].collect())
    assert kept == sorted(min(g) for g in groups.values()) and 5 in kept and 100 not in kept
    clean = sorted(r.doc_id for r in out["benchmark_decontamination"].collect())
    assert clean == [i for i in kept if i not in (130, 131, 132)]
    mixed = out["source_mix"].collect()
    size = {r.doc_id: len(r.text.split()) for r in out["benchmark_decontamination"].collect()}
    taken: dict[int, int] = {}
    for r in mixed:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    assert all(n <= 2 * size[i] for i, n in taken.items())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.1)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_orc.vocabulary_path(token_orc.VOCABULARY))
    want = []
    for r in mixed:
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids + [1]
        want.append((r.doc_id, len(ids), zlib.crc32(array("I", ids).tobytes())))
    got = sorted(out["token_orc"].collect(), key=lambda r: r.start)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)


def test_run_is_all_stages(spark, folder):
    path, _ = folder
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) == sorted(map(tuple, staged(spark, folder)["token_orc"].collect()))


def test_stages_on_an_empty_table(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.collect() == []


COLUMNS = {
    "op1_toxicity_fm": ["doc_id", "held_out", "score", "predicted"],
    "op2_pii_feistel": ["doc_id", "text", "n_email"],
    "op3_token_orc": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_source_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op6_line_crf": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7_simhash_anchor": ["doc_id", "fingerprint", "component_id"],
    "op8_kneser_ney": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op9_warc_index": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op10_decontaminate": ["doc_id", "item_id"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query_over_its_whole_table(spark, name):
    df = queries.QUERIES[name](spark, TINY)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = df.count()
    if name == "op10_decontaminate":
        assert rows > 0
    else:
        assert rows == spark.read.parquet(f"{TINY}/{'pages' if name.startswith('op9') else 'documents'}.parquet").count()


def test_warc_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{TINY}/pages.parquet'")
    want = con.sql(queries.OP9_SQL).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in queries.QUERIES["op9_warc_index"](spark, TINY).collect())
