"""Counts and bounded summaries over findings, classes and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepact.operators.triage import K

DIMENSIONS = ("severity", "status", "rule_type", "compatibility", "priority", "review_category")


def finding_counts(classified: DataFrame) -> DataFrame:
    """Counts per key by each dimension, present values only, in one pass:
    (K, dimension, value, count)."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS])
    return classified.select(*K, F.inline(pairs)).groupBy(*K, "dimension", "value").agg(
        F.count(F.lit(1)).alias("count"))


def suggestion_counts(suggestions: DataFrame) -> DataFrame:
    return suggestions.groupBy(*K, "suggestion_type").agg(F.count(F.lit(1)).alias("count"))


def run_summary(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows, columns, total findings, errors, warnings, skipped per key."""
    agg = findings.groupBy(*K).agg(
        F.count(F.lit(1)).alias("total_findings"),
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("infos"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
    )
    j = runs.join(agg, K, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return j.select(*K, "contract_name", "row_count", "column_count", zero("total_findings"), zero("errors"),
                    zero("warnings"), zero("infos"), zero("skipped"))


def high_priority(classified: DataFrame) -> DataFrame:
    """High-priority findings with their message and recommended action."""
    return classified.where(F.col("priority") == "high").select(
        *K, "seq", "finding_id", "rule_type", "column", "message", "recommended_human_action")


def _sorted_counts(col: str):
    entries = F.array_sort(F.collect_list(F.struct(F.col("value"), F.col("count"))))
    return F.map_from_entries(entries).alias(col)


def redacted_summary(classified: DataFrame, suggestions: DataFrame, recommendations: DataFrame,
                     runs: DataFrame) -> DataFrame:
    """Bounded per-key summary: counts, suggestion metadata, recommendations;
    no evidence and no sample values."""
    counts = finding_counts(classified)
    by_dim = counts.groupBy(*K).agg(
        *[F.map_from_entries(F.array_sort(F.collect_list(
            F.when(F.col("dimension") == d, F.struct(F.col("value"), F.col("count")))))).alias(f"counts_by_{d}")
          for d in ("severity", "rule_type", "compatibility", "priority")],
        F.sum(F.when(F.col("dimension") == "severity", F.col("count"))).alias("total_findings"),
    )
    sugg = suggestions.groupBy(*K).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "suggestion_id", "suggestion_type", "target_path",
                                             "confidence", "reason"))),
        lambda e: F.struct(e["suggestion_id"].alias("suggestion_id"), e["suggestion_type"].alias("suggestion_type"),
                           e["target_path"].alias("target_path"), e["confidence"].alias("confidence"),
                           e["reason"].alias("reason"))).alias("suggested_updates"))
    recs = recommendations.groupBy(*K).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rec_order", "recommendation_id", "priority", "category",
                                             "recommendation", "linked_finding_ids"))),
        lambda e: F.struct(e["recommendation_id"].alias("recommendation_id"), e["priority"].alias("priority"),
                           e["category"].alias("category"), e["recommendation"].alias("recommendation"),
                           e["linked_finding_ids"].alias("linked_finding_ids"))).alias("review_recommendations"))
    out = runs.join(by_dim, K, "left").join(sugg, K, "left").join(recs, K, "left")
    return out.select(*K, "contract_name", "row_count", "column_count",
                      F.coalesce("total_findings", F.lit(0)).cast("bigint").alias("total_findings"),
                      "counts_by_severity", "counts_by_rule_type", "counts_by_compatibility", "counts_by_priority",
                      "suggested_updates", "review_recommendations")
