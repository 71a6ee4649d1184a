"""Rule micro-tables: one case per validator (shapes of the original tests)."""

import datetime as dt

import pytest
from core_helpers import contract, findings, run


def by_rule(fs, rule):
    return [f for f in fs if f["rule_type"] == rule]


def test_missing_required(spark):
    df = spark.createDataFrame([(1,)], "id int")
    fs = findings(spark, df, contract({"id": {}, "email": {}}))
    assert [f["finding_id"] for f in fs] == ["missing_required_column:email"]
    assert fs[0]["severity"] == "error" and fs[0]["status"] == "failed"
    assert fs[0]["ev"]["available_columns"] == ["id"]


def test_unexpected_column_and_allowed(spark):
    df = spark.createDataFrame([(1, "x")], "id int, extra string")
    fs = findings(spark, df, contract({"id": {}}))
    assert [(f["finding_id"], f["status"], f["severity"]) for f in fs] == [
        ("unexpected_column:extra", "warning", "warning")]
    assert fs[0]["ev"]["declared_columns"] == ["id"]
    fs = findings(spark, df, contract({"id": {}}, schema={"allow_unexpected_columns": True}))
    assert fs == []


def test_type_mismatch(spark):
    df = spark.createDataFrame([(30, "a")], "age int, name string")
    fs = findings(spark, df, contract({"age": {"type": "string"}, "name": {}}))
    assert [f["finding_id"] for f in fs] == ["type_mismatch:age"]
    assert fs[0]["ev"] == {"expected_type": "string", "observed_type": "integer"}
    assert fs[0]["message"] == "Column 'age' has observed type 'integer', expected 'string'."
    assert findings(spark, df, contract({"age": {"type": "number"}, "name": {}})) == []


def test_nullability_counts_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "id double")
    fs = findings(spark, df, contract({"id": {"nullable": False}}))
    assert len(fs) == 1
    assert fs[0]["ev"] == {"null_count": 2, "row_count": 3, "null_percentage": 66.67}


def test_uniqueness_single_composite_skipped(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (2, "y", 2)], "id int, a string, b int")
    doc = contract({"id": {"unique": True}, "a": {}, "b": {}},
                   uniqueness=[{"name": "ab", "columns": ["a", "b"]}, {"name": "cd", "columns": ["c", "d"]}])
    fs = by_rule(findings(spark, df, doc), "uniqueness_violation")
    assert [(f["finding_id"], f["status"]) for f in fs] == [
        ("uniqueness_violation:id", "failed"), ("uniqueness_violation:a_b", "failed"),
        ("uniqueness_violation:c_d", "skipped")]
    assert fs[0]["ev"]["duplicate_key_count"] == 1 and fs[0]["ev"]["duplicate_row_count"] == 2
    assert fs[0]["ev"]["sample_duplicate_keys"] == [{"id": 1}]
    assert fs[1]["ev"]["sample_duplicate_keys"] == [{"a": "x", "b": 1}]
    assert fs[2]["ev"]["missing_columns"] == ["c", "d"]


def test_uniqueness_nulls_are_equal(spark):
    df = spark.createDataFrame([(None,), (None,), (1,)], "id int")
    fs = findings(spark, df, contract({"id": {"unique": True}}))
    assert fs[0]["ev"]["duplicate_key_count"] == 1 and fs[0]["ev"]["duplicate_row_count"] == 2


def test_allowed_values(spark):
    df = spark.createDataFrame([("ok",), ("bad",), ("ok",), (None,)], "status string")
    fs = findings(spark, df, contract({"status": {"allowed_values": ["ok", "pending"]}}))
    assert len(fs) == 1
    assert fs[0]["ev"]["failed_row_count"] == 1
    assert fs[0]["ev"]["unexpected_values"] == {"bad": 1}


def test_allowed_values_are_type_strict(spark):
    df = spark.createDataFrame([("1",), ("2",)], "code string")
    fs = findings(spark, df, contract({"code": {"allowed_values": [1, 2]}}))
    assert fs[0]["ev"]["failed_row_count"] == 2
    nums = spark.createDataFrame([(1,), (2,), (3,)], "code int")
    fs = findings(spark, nums, contract({"code": {"allowed_values": [1, 2.0]}}))
    assert fs[0]["ev"]["unexpected_values"] == {"3": 1}


def test_unexpected_values_order_and_cap(spark):
    rows = [("a",)] * 3 + [("b",)] * 3 + [("c",)] * 5 + [("ok",)]
    df = spark.createDataFrame(rows, "s string")
    fs = findings(spark, df, contract({"s": {"allowed_values": ["ok"]}}), max_examples=2)
    assert list(fs[0]["ev"]["unexpected_values"].items()) == [("c", 5), ("a", 3)]
    assert fs[0]["ev"]["failed_row_count"] == 11


def test_range(spark):
    df = spark.createDataFrame([(0,), (50,), (120,)], "score int")
    fs = findings(spark, df, contract({"score": {"min": 1, "max": 100}}))
    ev = fs[0]["ev"]
    assert (ev["below_min_count"], ev["above_max_count"], ev["observed_min"], ev["observed_max"]) == (1, 1, 0.0, 120.0)


def test_range_on_text_ignores_unparseable(spark):
    df = spark.createDataFrame([("5",), ("abc",), ("-3",), (" 7 ",)], "v string")
    fs = findings(spark, df, contract({"v": {"min": 0}}))
    assert fs[0]["ev"]["below_min_count"] == 1 and fs[0]["ev"]["observed_max"] == 7.0


def test_pattern_and_invalid_pattern(spark):
    df = spark.createDataFrame([("12345",), ("ABCDE",), ("12345\n",)], "zip string")
    fs = findings(spark, df, contract({"zip": {"pattern": "^[0-9]{5}$"}}))
    assert fs[0]["status"] == "warning" and fs[0]["severity"] == "warning"
    assert fs[0]["ev"]["failed_row_count"] == 2
    assert fs[0]["ev"]["sample_failed_values"] == ["12345\n", "ABCDE"]
    fs = findings(spark, df, contract({"zip": {"pattern": "["}}))
    assert fs[0]["status"] == "skipped" and "error" in fs[0]["ev"]


def test_pattern_is_unicode_aware(spark):
    df = spark.createDataFrame([("café",)], "w string")
    assert findings(spark, df, contract({"w": {"pattern": r"\w+"}})) == []


def test_pattern_sample_keeps_repeats(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), ("1",)], "s string")
    fs = findings(spark, df, contract({"s": {"pattern": "[0-9]"}}))
    assert fs[0]["ev"]["sample_failed_values"] == ["x", "x", "y"]


def test_length(spark):
    df = spark.createDataFrame([("A",), ("ABCDE",), ("AB",)], "code string")
    fs = findings(spark, df, contract({"code": {"min_length": 2, "max_length": 4}}))
    ev = fs[0]["ev"]
    assert (ev["too_short_count"], ev["too_long_count"], ev["observed_min_length"], ev["observed_max_length"]) == (1, 1, 1, 5)


def test_freshness(spark):
    df = spark.createDataFrame([("2025-01-01",), ("2025-01-15",)], "event_date string")
    fs = findings(spark, df, contract({"event_date": {"freshness": {"max_age_days": 30}}}))
    assert fs[0]["status"] == "warning"
    assert fs[0]["ev"] == {"latest_value": "2025-01-15T00:00:00", "reference_date": "2025-03-01",
                           "max_age_days": 30, "observed_age_days": 45}
    assert findings(spark, df, contract({"event_date": {"freshness": {"max_age_days": 60}}})) == []


def test_freshness_skipped_when_unparseable(spark):
    df = spark.createDataFrame([("soon",)], "d string")
    fs = findings(spark, df, contract({"d": {"freshness": {"max_age_days": 3}}}))
    assert fs[0]["status"] == "skipped" and fs[0]["ev"]["latest_value"] is None


def test_row_count(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    fs = findings(spark, df, contract({"id": {}}, row_count={"min": 4, "max": 10}))
    assert [(f["finding_id"], f["status"]) for f in fs] == [("row_count_violation:dataset", "warning")]
    assert fs[0]["ev"] == {"row_count": 3, "min_allowed": 4, "max_allowed": 10}


def test_combined_order(spark):
    df = spark.createDataFrame([(1, "ok"), (1, "bad")], "id int, status string")
    doc = contract({"id": {"unique": True}, "status": {"allowed_values": ["ok"]}}, row_count={"min": 3})
    fs = findings(spark, df, doc)
    assert [f["rule_type"] for f in fs] == ["uniqueness_violation", "allowed_values_violation",
                                            "row_count_violation"]


def test_absent_columns_are_skipped_silently(spark):
    df = spark.createDataFrame([(1,)], "id int")
    doc = contract({"id": {}, "x": {"required": False, "min": 1, "pattern": "a", "allowed_values": ["a"]}})
    assert findings(spark, df, doc) == []


def test_uniqueness_on_long_text_keys(spark):
    doc_a, doc_b = "lorem ipsum " * 20, "dolor sit " * 20
    df = spark.createDataFrame([(doc_a,), (doc_a,), (doc_b,), ("x",), ("x",)], "text string")
    fs = findings(spark, df, contract({"text": {"unique": True}}))
    ev = fs[0]["ev"]
    assert (ev["duplicate_key_count"], ev["duplicate_row_count"]) == (2, 4)
    assert sorted(k["text"] for k in ev["sample_duplicate_keys"]) == sorted([doc_a, "x"])


def test_awkward_column_names(spark):
    df = spark.createDataFrame([(1, "x y", 5.0), (1, None, -1.0)], "`a.b` int, `c d` string, `e``f` double")
    doc = contract({"a.b": {"unique": True, "type": "integer"}, "c d": {"nullable": False, "pattern": "[a-z]+",
                    "allowed_values": ["x y"], "min_length": 4}, "e`f": {"min": 0}})
    got = {f["finding_id"]: f for f in findings(spark, df, doc)}
    assert set(got) == {"uniqueness_violation:a.b", "nullability_violation:c d", "pattern_violation:c d",
                        "length_violation:c d", "range_violation:e`f"}
    assert got["uniqueness_violation:a.b"]["ev"]["sample_duplicate_keys"] == [{"a.b": 1}]
    from tablepact.operators.profile import profile
    names = {r["column"] for r in profile(df).collect()}
    assert names == {"a.b", "c d", "e`f"}


def test_slices_with_null_key_and_many_contracts(spark):
    from tablepact import contract_rules, contracts_frame, validate

    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 5), (None, 6)], "g string, v int")
    docs = [contract({"v": {"unique": True, "max": 4}}), {"contract": {"name": "other"}, "columns": {"v": {}}}]
    rules = contract_rules(spark, contracts_frame(spark, docs))
    v = validate(rules=rules, df=df, by=["g"], contract_name="t")
    got = sorted((r["slice"], r["finding_id"]) for r in v.findings.collect())
    assert got == [("", "unexpected_column:g"), ("g=\\N", "range_violation:v"), ("g=a", "uniqueness_violation:v")]
    runs = sorted((r["slice"], r["row_count"]) for r in v.runs.collect())
    assert runs == [("", 4), ("g=\\N", 2), ("g=a", 2)]
    with pytest.raises(ValueError):
        validate(df, rules)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, s string")
    doc = contract({"id": {"unique": True, "nullable": False}, "s": {"allowed_values": ["a"], "pattern": "a"}},
                   row_count={"min": 1})
    fs = findings(spark, df, doc)
    assert [f["finding_id"] for f in fs] == ["row_count_violation:dataset"]
    sliced = run(spark, df, doc, by=["s"])
    assert sliced.findings.collect() == []
    assert [(r["slice"], r["row_count"]) for r in sliced.runs.collect()] == [("", 0)]


def test_slice_labels_never_collide(spark):
    from tablepact.operators import triage

    values = [None, "null", "\\N", "a|k=b", "a", "a=1|b", ""]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "k string, v int")
    v = run(spark, df, contract({"v": {"min": 100}}, schema={"allow_unexpected_columns": True}), by=["k"])
    rows = v.findings.collect()
    assert len(rows) == len(values) == len({r["slice"] for r in rows})
    assert triage.failures_table(triage.classify(v.findings)).count() == len(values)
    assert {r["slice"] for r in v.runs.collect()} == {r["slice"] for r in rows} | {""}


def test_slice_and_mapping_names_may_be_internal_or_data_names(spark):
    df = spark.createDataFrame([(1, "x", 5), (1, "y", 7), (2, "x", 9)], "rows int, nulls_0 string, v int")
    doc = contract({"v": {"max": 6, "nullable": False}}, schema={"allow_unexpected_columns": True})
    assert sorted(r["slice"] for r in run(spark, df, doc, by=["rows"]).findings.collect()) == ["rows=1", "rows=2"]
    assert sorted(r["slice"] for r in run(spark, df, doc, by=["nulls_0"]).findings.collect()) == ["nulls_0=x", "nulls_0=y"]
    from pyspark.sql import functions as F

    got = findings(spark, df, doc, by={"v": F.col("v") % 2})  # the rule still sees the data column
    assert [(r["slice"], r["ev"]["above_max_count"], r["ev"]["observed_max"]) for r in got] == [("v=1", 2, 9)]


@pytest.mark.parametrize(("pattern", "good", "bad"), [
    ("a{,3}", ["", "a", "aaa"], ["aaaa", "a{,3}"]), ("(?P<a_b>a)+(?P=a_b)", ["aa"], ["a", "b"]), ("[a[]+", ["a[", "[["], ["b", ""]),
    ("a.b", ["a\rb", "a\u2028b"], ["a\nb"]), ("[]&x-]+", ["]&", "x-"], ["y"]), (r"a\Z", ["a"], ["a\n"]), (r"\\Z", ["\\Z"], ["a"]),
    (r"[\b]", ["\b"], ["b"]), (r"a\vb", ["a\x0bb"], ["a\nb"]), ("[a&&b]", ["&", "a", "b"], ["c"]), (r"\0", ["\0"], ["0"]),
    (r"\U0001F600", ["\U0001F600"], ["U"]), ("[^]a]", ["b"], ["]", "a"]), (r"\d", ["1", "\u0663"], ["a"])])
def test_patterns_mean_what_python_means(spark, pattern, good, bad):
    import re

    assert all(re.fullmatch(pattern, x) for x in good) and not any(re.fullmatch(pattern, x) for x in bad)
    df = spark.createDataFrame([(x,) for x in good + bad], "s string")
    (f,) = findings(spark, df, contract({"s": {"pattern": pattern}}))
    assert f["status"] == "warning" and f["ev"]["sample_failed_values"] == sorted(bad)


def test_patterns_that_cannot_run_are_skipped_beside_those_that_can(spark):
    df = spark.createDataFrame([("a", "a", "b")], "x string, y string, z string")
    got = findings(spark, df, contract({"x": {"pattern": "("}, "y": {"pattern": "(a)?(?(1)b|c)"}, "z": {"pattern": "a"}}))
    assert [(f["column"], f["status"]) for f in got] == [("x", "skipped"), ("y", "skipped"), ("z", "warning")]
    assert all(f["ev"]["error"] for f in got[:2])


def test_exact_integers_and_decimals(spark):
    from decimal import Decimal

    big = 9007199254740993
    df = spark.createDataFrame([(big, Decimal(f"{big}.5"))], "i bigint, d decimal(20,1)")
    doc = contract({"i": {"max": big - 1, "allowed_values": [big - 1]}, "d": {"max": big, "allowed_values": [big]}})
    got = {f["finding_id"]: f["ev"] for f in findings(spark, df, doc)}
    assert got["range_violation:i"]["observed_max"] == big and got["range_violation:d"]["above_max_count"] == 1
    assert set(got) == {"range_violation:i", "range_violation:d", "allowed_values_violation:i", "allowed_values_violation:d"}
    assert findings(spark, df, contract({"i": {"max": big, "allowed_values": [big]}, "d": {"max": big + 1}})) == []


def test_dates_among_allowed_values(spark):
    df = spark.sql("SELECT DATE'2024-01-01' AS d, TIMESTAMP_NTZ'2024-01-01 10:00:00' AS t UNION ALL SELECT DATE'2024-01-02', NULL")
    got = findings(spark, df, contract({"d": {"allowed_values": ["2024-01-01", "x"]}, "t": {"allowed_values": ["2024-01-01T10:00"]}}))
    assert [(f["finding_id"], f["ev"]["unexpected_values"]) for f in got] == [("allowed_values_violation:d", {"2024-01-02T00:00:00": 1})]


def test_nan_and_null_are_one_key(spark):
    df = spark.createDataFrame([(float("nan"), 1), (None, 1), (2.0, 1)], "x double, y int")
    (f,) = findings(spark, df, contract({"x": {"unique": True}, "y": {}}))
    assert (f["ev"]["duplicate_key_count"], f["ev"]["duplicate_row_count"], f["ev"]["sample_duplicate_keys"]) == (1, 2, [{"x": None}])


def test_times_with_a_zone(spark):
    df = spark.createDataFrame([("2025-02-27T10:00:00Z", "2025-02-27T00:00:00+01:00"), ("2025-02-27 23:30:00.25-0200", "2025-02-26T00:00:00z")], "t string, d string")
    doc = contract({"t": {"type": "datetime", "freshness": {"max_age_days": 1}}, "d": {"type": "date"}})
    (f,) = findings(spark, df, doc, reference_date=dt.date(2025, 3, 10))
    assert (f["finding_id"], f["status"], f["ev"]["latest_value"]) == ("freshness_violation:t", "warning", "2025-02-28T01:30:00.250000")


def test_choice_by_value_at_any_length(spark):
    texts = [f"{'x' * n}{i}" for n in (10, 300, 5000) for i in (2, 0, 1)] * 2 + ["z", "z"]
    df = spark.createDataFrame([(t, 1) for t in texts], "s string, n int")
    doc = contract({"s": {"unique": True, "allowed_values": ["none"], "pattern": "[a-w]*"}, "n": {}})
    got = {f["rule_type"]: f["ev"] for f in findings(spark, df, doc, max_examples=4)}
    ordered = sorted(set(texts))
    assert [k["s"] for k in got["uniqueness_violation"]["sample_duplicate_keys"]] == ordered[:4]
    assert list(got["allowed_values_violation"]["unexpected_values"]) == ordered[:4]
    assert got["pattern_violation"]["sample_failed_values"] == sorted(texts)[:4]


def test_composite_keys_are_ordered_by_their_first_long_part(spark):
    long = "p" * 400
    rows = [(long + "b", 1), (long + "a", 9), (long + "a", 2), ("q", 0)]
    df = spark.createDataFrame(rows * 2, "s string, n int")
    doc = contract({"s": {}, "n": {}}, uniqueness=[{"name": "k", "columns": ["s", "n"]}])
    (f,) = findings(spark, df, doc, max_examples=3)
    assert [(k["s"], k["n"]) for k in f["ev"]["sample_duplicate_keys"]] == sorted(rows)[:3]


def test_long_keys_looked_up_in_several_passes(spark, monkeypatch):
    from tablepact.plans import ordered

    monkeypatch.setattr(ordered, "BROADCAST_BYTES", ordered.ROW_BYTES * 3)
    texts = [f"{'y' * 500}{i:02d}" for i in range(20)]
    df = spark.createDataFrame([(t, 1) for t in texts * 2], "s string, n int")
    (f,) = findings(spark, df, contract({"s": {"unique": True}, "n": {}}), max_examples=15)
    assert [k["s"] for k in f["ev"]["sample_duplicate_keys"]] == texts[:15]


def test_wide_contracts(spark):
    """3,000 columns: no cap on rules, findings in document order."""
    n = 3000
    df = spark.range(1).selectExpr(*[f"CAST({i % 7} AS INT) AS c{i}" for i in range(n)])
    doc = contract({f"c{i}": {"max": 5} for i in range(n)})
    got = run(spark, df, doc).findings.orderBy("seq").select("column").collect()
    assert [r["column"] for r in got] == [f"c{i}" for i in range(n) if i % 7 == 6]
