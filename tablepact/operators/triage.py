"""Triage over a findings table of any size: classes, failure rows, suggestions.

Every operator is keyed by ``K = (run_id, dataset_name, slice)``; one
validation run is the one-key case.  Lookups are ``when`` chains and classified
findings keep the finding's columns, so the only join is findings x profile on
(K, column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepact.plans.vocabulary import (
    CLASSES,
    DEFAULT_HUMAN_ACTION,
    NULLABILITY_NOTE,
    RATIONALE,
    SKIPPED_ACTION,
    SKIPPED_RATIONALE,
    SUGGESTED_DESCRIPTION,
    SUGGESTIONS,
    UNKNOWN_CLASS,
)

K = ["run_id", "dataset_name", "slice"]
_JSON = {"ignoreNullFields": "false"}


def _class_of(part: int) -> Column:
    """One part (compatibility, priority, category) of a finding's class: the first row of the table that applies."""
    chain = None
    for rule, condition, row in CLASSES:
        hit = F.lit(True) if rule is None else F.col("rule_type") == rule
        if condition is not None:
            column, value = condition
            hit = hit & (F.col(column) == value)
        chain = F.when(hit, F.lit(row[part])) if chain is None else chain.when(hit, F.lit(row[part]))
    return chain.otherwise(F.lit(UNKNOWN_CLASS[part]))


def classify(findings: DataFrame) -> DataFrame:
    """The findings with compatibility, priority, review category, rationale and
    human action (one projection; no lookup join)."""
    compat, prio, cat = (_class_of(part) for part in range(3))
    skipped = F.col("status") == "skipped"
    action = F.when(F.coalesce(F.col("suggested_action"), F.lit("")) != "", F.col("suggested_action")) \
        .otherwise(F.lit(DEFAULT_HUMAN_ACTION))
    return findings.select(
        "*", compat.alias("compatibility"), prio.alias("priority"), cat.alias("review_category"),
        F.when(skipped, F.lit(SKIPPED_RATIONALE)).otherwise(
            F.format_string(RATIONALE, F.col("rule_type"), compat, prio)).alias("rationale"),
        F.when(skipped, F.lit(SKIPPED_ACTION)).otherwise(action).alias("recommended_human_action"),
    )


def failures_table(classified: DataFrame) -> DataFrame:
    """Flat finding-level rows (12 review columns); missing text becomes ''."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return classified.select(
        *K, "seq", "finding_id", "rule_type", blank("column"), F.array_join(F.col("columns"), "|").alias("columns"),
        "severity", "status", "compatibility", "priority", "review_category", "message",
        blank("suggested_action"), blank("recommended_human_action"),
    )


def _evidence_plus(evidence: Column, key: str, value: Column) -> Column:
    """Append one field to a JSON object held as text."""
    return F.concat(F.regexp_replace(evidence, r"\}$", ""),
                    F.when(evidence == "{}", F.lit("")).otherwise(F.lit(",")),
                    F.lit(f'"{key}":'), F.to_json(F.struct(value.alias("v")), _JSON).substr(F.lit(6), F.lit(1 << 30)))


def suggestions(findings: DataFrame, column_profile: DataFrame, max_suggestions: int = 20) -> DataFrame:
    """Advisory contract edits for eligible findings; the first
    ``max_suggestions`` per key in finding order (the cap is the feature)."""
    f = findings
    rt = F.col("rule_type")
    col = F.col("column")
    ev = F.col("evidence")

    # unexpected column: needs the column's profile (inner join: no profile, no suggestion)
    prof = column_profile.select(
        *K, "column", F.col("observed_type").alias("p_observed"), F.col("null_count").alias("p_nulls"),
        F.col("non_null_count").alias("p_nonnull"), F.col("sample_values").alias("p_samples"),
        F.col("top_values").alias("p_top"))
    unexpected = f.where((rt == "unexpected_column") & col.isNotNull()).join(prof, K + ["column"], "inner").select(
        *K, "seq", "rule_type", "column",
        F.to_json(F.struct(F.lit(False).alias("required"), F.col("p_observed").alias("type"),
                           (F.col("p_nulls") > 0).alias("nullable"),
                           F.lit(SUGGESTED_DESCRIPTION).alias("description")), _JSON).alias("proposed_change"),
        F.to_json(F.struct(F.col("p_observed").alias("observed_type"), F.col("p_nulls").alias("null_count"),
                           F.col("p_nonnull").alias("non_null_count"), F.col("p_samples").alias("sample_values"),
                           F.col("p_top").alias("top_values")), _JSON).alias("s_evidence"),
    )

    candidates = F.map_keys(F.from_json(F.get_json_object(ev, "$.unexpected_values"), "map<string,bigint>"))
    others = f.where(rt.isin("allowed_values_violation", "nullability_violation", "type_mismatch",
                             "freshness_violation", "row_count_violation")
                     & (col.isNotNull() | (rt == "row_count_violation"))).select(
        *K, "seq", "rule_type", "column",
        F.when(rt == "allowed_values_violation",
               F.to_json(F.struct(F.coalesce(candidates, F.array().cast("array<string>")).alias("candidate_values"))))
        .when(rt == "nullability_violation", F.lit('{"nullable":true}'))
        .when(rt == "type_mismatch",
              F.to_json(F.struct(F.get_json_object(ev, "$.observed_type").alias("observed_type")), _JSON))
        .when(rt == "freshness_violation", F.lit("{}"))
        .otherwise(F.to_json(F.struct(F.get_json_object(ev, "$.row_count").cast("bigint").alias("observed_row_count")), _JSON))
        .alias("proposed_change"),
        F.when(rt == "nullability_violation", _evidence_plus(ev, "note", F.lit(NULLABILITY_NOTE)))
        .otherwise(ev).alias("s_evidence"),
    )
    both = unexpected.unionByName(others)
    stype = F.lit(None).cast("string")
    target = F.lit(None).cast("string")
    conf = F.lit(None).cast("string")
    reason = F.lit(None).cast("string")
    for rule, (kind, path, confidence, why) in SUGGESTIONS.items():
        hit = rt == rule
        stype = F.when(hit, F.lit(kind)).otherwise(stype)
        before, _, after = path.partition("{column}")
        target = F.when(hit, F.concat(F.lit(before), col, F.lit(after)) if "{column}" in path else F.lit(path)).otherwise(target)
        conf = F.when(hit, F.lit(confidence)).otherwise(conf)
        reason = F.when(hit, F.lit(why)).otherwise(reason)
    w = Window.partitionBy(*K).orderBy("seq")
    out = both.select(
        *K, "seq",
        F.concat(rt, F.lit(":"), F.coalesce(col, F.lit("dataset"))).alias("suggestion_id"),
        stype.alias("suggestion_type"), target.alias("target_path"), col.alias("column"),
        F.col("proposed_change"), conf.alias("confidence"), reason.alias("reason"),
        F.col("s_evidence").alias("evidence"), F.lit(True).alias("human_decision_required"),
    )
    return out.withColumn("suggestion_rank", F.row_number().over(w)).where(F.col("suggestion_rank") <= max_suggestions)
