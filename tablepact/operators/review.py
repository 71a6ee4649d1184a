"""Review over classified findings: grouped recommendations, statuses, gate.

All keyed by ``K``; ``runs`` (one row per validated key, from ``validate``)
is the driving side so clean runs appear as Passed / no-findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.operators.triage import K
from tablepact.plans.vocabulary import GOVERNANCE_REC, NO_FINDINGS_REC, RECOMMENDATIONS

REC_SCHEMA_COLS = ["recommendation_id", "priority", "category", "recommendation", "rationale",
                   "linked_finding_ids", "rec_order"]


def _group_of(rule_type: Column) -> Column:
    chain = None
    for order, rec in enumerate(RECOMMENDATIONS):
        hit = rule_type.isin(*rec[5])
        chain = F.when(hit, F.lit(order)) if chain is None else chain.when(hit, F.lit(order))
    return chain


def _lit_rec(rec: tuple, order: int) -> list[Column]:
    return [F.lit(rec[0]).alias("recommendation_id"), F.lit(rec[1]).alias("priority"),
            F.lit(rec[2]).alias("category"), F.lit(rec[3]).alias("recommendation"),
            F.lit(rec[4]).alias("rationale"), F.array().cast("array<string>").alias("linked_finding_ids"),
            F.lit(order).alias("rec_order")]


def recommendations(classified: DataFrame, suggestions: DataFrame, runs: DataFrame) -> DataFrame:
    """Grouped next steps per key, linked to finding ids (rule type name order,
    then finding order)."""
    grouped = classified.select(*K, "seq", "finding_id", "rule_type", "status", "severity",
                                _group_of(F.col("rule_type")).alias("g")).where(F.col("g").isNotNull())
    per_group = grouped.groupBy(*K, "g").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rule_type", "seq", "finding_id"))),
                    lambda e: e["finding_id"]).alias("linked_finding_ids"),
        F.max((F.col("status") == "failed") & (F.col("severity") == "error")).alias("has_error"),
    )
    rid = pri = cat = txt = why = None
    for order, rec in enumerate(RECOMMENDATIONS):
        hit = F.col("g") == order
        prio = F.when(F.col("has_error"), F.lit("high")).otherwise(F.lit("medium")) \
            if rec[0] == "rec_data_quality" else F.lit(rec[1])
        parts = [F.lit(rec[0]), prio, F.lit(rec[2]), F.lit(rec[3]), F.lit(rec[4])]
        if rid is None:
            rid, pri, cat, txt, why = [F.when(hit, p) for p in parts]
        else:
            rid, pri, cat, txt, why = [acc.when(hit, p) for acc, p in zip((rid, pri, cat, txt, why), parts)]
    linked = per_group.select(*K, rid.alias("recommendation_id"), pri.alias("priority"), cat.alias("category"),
                              txt.alias("recommendation"), why.alias("rationale"), "linked_finding_ids",
                              F.col("g").alias("rec_order"))
    keys = runs.select(*K).distinct()
    governance = keys.join(suggestions.select(*K).distinct(), K, "left_semi").select(
        *K, *_lit_rec(GOVERNANCE_REC, len(RECOMMENDATIONS)))
    clean = keys.join(classified.select(*K).distinct(), K, "left_anti").select(
        *K, *_lit_rec(NO_FINDINGS_REC, len(RECOMMENDATIONS) + 1))
    return linked.unionByName(governance).unionByName(clean)


def _per_key(classified: DataFrame) -> DataFrame:
    failed_error = (F.col("status") == "failed") & (F.col("severity") == "error")
    review = (F.col("severity") == "warning") | F.col("status").isin("skipped", "review_needed")
    return classified.groupBy(*K).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(failed_error).alias("failed_error"),
        F.max(review).alias("review"),
        F.max((F.col("status") == "failed") & F.col("severity").isin("error", "warning")).alias("failed_warn"),
    )


def overall_status(classified: DataFrame, runs: DataFrame) -> DataFrame:
    """Failed if any failed error finding; else Review needed if any finding; else Passed."""
    j = runs.select(*K).distinct().join(_per_key(classified), K, "left")
    return j.select(*K, F.when(F.coalesce("failed_error", F.lit(False)), F.lit("Failed"))
                    .when(F.coalesce("n", F.lit(0)) > 0, F.lit("Review needed"))
                    .otherwise(F.lit("Passed")).alias("overall_status"))


def report_status(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """The report's own status: Review needed only for warning severity or
    skipped / review_needed status (so info-only runs pass)."""
    j = runs.select(*K).distinct().join(_per_key(findings), K, "left")
    return j.select(*K, F.when(F.coalesce("failed_error", F.lit(False)), F.lit("Failed"))
                    .when(F.coalesce("review", F.lit(False)), F.lit("Review needed"))
                    .otherwise(F.lit("Passed")).alias("report_status"))


def gate(classified: DataFrame, runs: DataFrame, fail_on: str = "error") -> DataFrame:
    """Pass/fail per key.  Only status 'failed' counts, so warning-status
    findings never trip even ``fail_on='warning'``."""
    if fail_on not in ("error", "warning", "never"):
        raise ValueError("fail_on must be one of: error, warning, never")
    j = runs.select(*K).distinct().join(_per_key(classified), K, "left")
    if fail_on == "never":
        cond = F.lit(False)
    elif fail_on == "error":
        cond = F.coalesce(F.col("failed_error"), F.lit(False))
    else:
        cond = F.coalesce(F.col("failed_warn"), F.lit(False))
    return j.select(*K, F.lit(fail_on).alias("fail_on"), cond.alias("should_fail"))
