"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.llm import (decontaminate, html_mincut, kneser_ney, language_id, line_crf, merkle_manifest, periodic_runs, pii_feistel, simhash_anchor, source_mix, token_orc,
                           toxicity_fm, warc_index)
from tablepact.llm.common import id_remainder, table


def op1_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity_fm.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                         keep=id_remainder(F.col("doc_id"), 4) != 2)
    return scores.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= toxicity_fm.THRESHOLD).cast("int").alias("predicted"))


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.token_digests(table(spark, sf_dir, "documents"))


def op7_simhash_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_anchor.near_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.language_predictions(table(spark, sf_dir, "documents"), keep=id_remainder(F.col("doc_id"), 3) != 1)
    return out.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.Mix(table(spark, sf_dir, "documents")).report()


def op2_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_feistel.pseudonymise(table(spark, sf_dir, "documents"))


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 5) == 1
    scores = kneser_ney.scores(docs, kneser_ney.train(docs.where(~held_out).select("text")))
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.captures(table(spark, sf_dir, "pages"))


def op11_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract(table(spark, sf_dir, "pages"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True).drop("n_words")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = merkle_manifest.Manifest(table(spark, sf_dir, "documents"), merkle_manifest.tampered_text())
    return manifest.report().drop("source")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_fm": op1_toxicity_fm,
    "op2_pii_feistel": op2_pii_feistel,
    "op3_token_orc": op3_token_orc,
    "op4_language_id": op4_language_id,
    "op5_source_mix": op5_source_mix,
    "op6_line_crf": op6_line_crf,
    "op7_simhash_anchor": op7_simhash_anchor,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_warc_index": op9_warc_index,
    "op10_decontaminate": op10_decontaminate,
    "op11_html_mincut": op11_html_mincut,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": pipeline,
}

OP9_SQL = """
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), sized AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM payloads
), firsts AS (
  SELECT payload_digest AS d, min(page_id) AS first FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM sized LEFT JOIN firsts ON payload_digest = d AND payload_bytes >= 100
"""

OP13_SQL = """
WITH RECURSIVE marked AS (  -- crc32 of the decimal id, bit by bit
  SELECT row_number() OVER () AS rid, *, list_reduce(list_prepend(4294967295, flatten(list_transform(
           str_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda d: list_transform(range(8), lambda k: (ascii(d) >> k) & 1)))),
           lambda c, b: xor(c >> 1, CASE WHEN (c & 1) <> b THEN 3988292384 ELSE 0 END)) AS crc
  FROM documents
), texts AS (
  SELECT *, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered FROM marked
), fields AS (
  SELECT *, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head FROM texts
), leaves AS (
  SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(tampered) || ':' || tampered, '-')) AS changed FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src FROM leaves
), tree AS (
  SELECT src, 0 AS level, place, leaf AS node FROM placed
  UNION ALL
  SELECT src, level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER (PARTITION BY src) AS n FROM tree) WHERE n > 1 GROUP BY src, level, place // 3
), subroots AS (
  SELECT src, max(level) AS height, arg_max(node, level) AS subroot FROM tree GROUP BY src
), forest AS (
  SELECT 0 AS level, src AS place, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER () AS n FROM forest) WHERE n > 1 GROUP BY level, place // 3
), tops AS (
  SELECT max(level) AS height, arg_max(node, level) AS root FROM forest
), fold AS (
  SELECT rid, src, 0 AS level, place, changed AS node, '' AS siblings FROM placed
  UNION ALL
  SELECT f.rid, f.src, f.level + 1, f.place // 3, sha256(string_agg(CASE WHEN t.place = f.place THEN f.node ELSE t.node END, '' ORDER BY t.place)),
         f.siblings || coalesce(string_agg(CASE WHEN t.place <> f.place THEN t.node END, '' ORDER BY t.place), '')
  FROM fold f JOIN tree t ON t.src = f.src AND t.level = f.level AND t.place // 3 = f.place // 3 JOIN subroots s ON s.src = f.src
  WHERE f.level < s.height GROUP BY f.rid, f.src, f.level, f.place, f.siblings
), climbed AS (
  SELECT f.rid, f.src, f.node, f.siblings FROM fold f JOIN subroots s ON s.src = f.src AND s.height = f.level
), fold_top AS (
  SELECT rid, 0 AS level, src AS place, node, siblings FROM climbed
  UNION ALL
  SELECT f.rid, f.level + 1, f.place // 3, sha256(string_agg(CASE WHEN t.place = f.place THEN f.node ELSE t.node END, '' ORDER BY t.place)),
         f.siblings || coalesce(string_agg(CASE WHEN t.place <> f.place THEN t.node END, '' ORDER BY t.place), '')
  FROM fold_top f JOIN forest t ON t.level = f.level AND t.place // 3 = f.place // 3, tops
  WHERE f.level < tops.height GROUP BY f.rid, f.level, f.place, f.siblings
)
SELECT p.doc_id, p.leaf, s.subroot, tops.root, sha256(f.siblings) AS proof_sha256, f.node AS folded_root, f.node = tops.root AS verified
FROM placed p JOIN subroots s ON s.src = p.src JOIN tops ON true JOIN fold_top f ON f.rid = p.rid AND f.level = tops.height
"""

ORACLE: dict[str, str] = {"op9_warc_index": OP9_SQL, "op13_merkle_manifest": OP13_SQL}
