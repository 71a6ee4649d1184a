"""Classification, failures table, suggestions, recommendations, statuses, gate."""

from core_helpers import contract, run

from tablepact.operators import review, summaries, triage
from tablepact.operators.profile import profile


def _setup(spark):
    df = spark.createDataFrame([(1.0, "ok", "x", "2024-01-01"), (None, "bad", "y", "2024-01-02"),
                                (3.0, "ok", "z", "2024-01-03")], "id double, status string, extra string, d string")
    doc = contract({"id": {"nullable": False, "type": "integer"}, "status": {"allowed_values": ["ok"]},
                    "d": {"freshness": {"max_age_days": 1}}, "missing": {}, "p": {"required": False}},
                   row_count={"min": 5})
    v = run(spark, df, doc)
    return df, v, triage.classify(v.findings)


def test_classification(spark):
    _, v, c = _setup(spark)
    got = {r["finding_id"]: (r["compatibility"], r["priority"], r["review_category"]) for r in c.collect()}
    assert got["missing_required_column:missing"] == ("breaking", "high", "schema_drift")
    assert got["type_mismatch:id"] == ("breaking", "high", "schema_drift")
    assert got["nullability_violation:id"] == ("breaking", "high", "data_quality")
    assert got["allowed_values_violation:status"] == ("review_needed", "high", "domain_values")
    assert got["unexpected_column:extra"] == ("review_needed", "medium", "schema_drift")
    assert got["freshness_violation:d"] == ("review_needed", "medium", "timeliness")
    assert got["row_count_violation:dataset"] == ("review_needed", "medium", "volume")


def test_failures_table_columns(spark):
    _, v, c = _setup(spark)
    t = triage.failures_table(c)
    assert t.columns[4:] == ["finding_id", "rule_type", "column", "columns", "severity", "status", "compatibility",
                             "priority", "review_category", "message", "suggested_action", "recommended_human_action"]
    row = t.where("rule_type = 'row_count_violation'").collect()[0]
    assert row["column"] == "" and row["columns"] == ""


def test_suggestions_all_types(spark):
    df, v, _ = _setup(spark)
    s = triage.suggestions(v.findings, profile(df)).collect()
    assert sorted(r["suggestion_type"] for r in s) == sorted([
        "add_unexpected_column", "review_nullability", "review_type", "review_allowed_values",
        "review_refresh_process", "review_row_count_bounds"])
    assert all(r["human_decision_required"] for r in s)
    add = [r for r in s if r["suggestion_type"] == "add_unexpected_column"][0]
    assert add["proposed_change"].startswith('{"required":false,"type":"string","nullable":false')
    capped = triage.suggestions(v.findings, profile(df), max_suggestions=2).collect()
    assert len(capped) == 2


def test_pattern_gives_no_suggestion(spark):
    df = spark.createDataFrame([("a",)], "s string")
    v = run(spark, df, contract({"s": {"pattern": "[0-9]"}}))
    assert triage.suggestions(v.findings, profile(df)).collect() == []


def test_recommendations_and_statuses(spark):
    df, v, c = _setup(spark)
    s = triage.suggestions(v.findings, profile(df))
    recs = {r["recommendation_id"]: r for r in review.recommendations(c, s, v.runs).collect()}
    assert set(recs) == {"rec_schema_drift", "rec_data_quality", "rec_contract_review", "rec_operational_review",
                         "rec_contract_governance"}
    assert recs["rec_schema_drift"]["linked_finding_ids"] == ["missing_required_column:missing", "type_mismatch:id"]
    assert recs["rec_data_quality"]["priority"] == "high"
    assert review.overall_status(c, v.runs).collect()[0]["overall_status"] == "Failed"
    assert review.gate(c, v.runs, "error").collect()[0]["should_fail"] is True


def test_clean_run(spark):
    df = spark.createDataFrame([(1,)], "id int")
    v = run(spark, df, contract({"id": {}}))
    c = triage.classify(v.findings)
    recs = review.recommendations(c, triage.suggestions(v.findings, profile(df)), v.runs).collect()
    assert [(r["recommendation_id"], r["priority"]) for r in recs] == [("rec_no_findings", "low")]
    assert review.overall_status(c, v.runs).collect()[0]["overall_status"] == "Passed"
    assert review.gate(c, v.runs, "warning").collect()[0]["should_fail"] is False


def test_warning_status_never_trips_gate_but_reviews(spark):
    df = spark.createDataFrame([("a",)], "s string")
    v = run(spark, df, contract({"s": {"pattern": "[0-9]", "severity": "error"}}))
    c = triage.classify(v.findings)
    assert review.gate(c, v.runs, "warning").collect()[0]["should_fail"] is False
    assert review.overall_status(c, v.runs).collect()[0]["overall_status"] == "Review needed"
    # the report's own status only looks at warning severity / skipped status
    assert review.report_status(v.findings, v.runs).collect()[0]["report_status"] == "Passed"


def test_counts_and_redaction(spark):
    df, v, c = _setup(spark)
    counts = {(r["dimension"], r["value"]): r["count"] for r in summaries.finding_counts(c).collect()}
    assert counts[("severity", "error")] == 4 and counts[("severity", "warning")] == 3
    s = triage.suggestions(v.findings, profile(df))
    r = review.recommendations(c, s, v.runs)
    red = summaries.redacted_summary(c, s, r, v.runs)
    text = str(red.collect())
    assert "bad" not in text and "2024-01-03" not in text   # no sample values or evidence
    assert "evidence" not in red.columns
    summary = summaries.run_summary(v.findings, v.runs).collect()[0]
    assert (summary["total_findings"], summary["errors"], summary["warnings"]) == (7, 4, 3)
