"""Profile micro-tables (null model, observed types, top values, ranges)."""

from tablepact.operators.profile import profile, profile_summary


def prof(df, **kw):
    return {r["column"]: r for r in profile(df, **kw).collect()}


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None), (None, None)], "value double, all_null string")
    p = prof(df)
    assert p["value"]["null_count"] == 2 and p["value"]["null_percentage"] == 50.0
    assert p["value"]["non_null_count"] == 2
    assert p["all_null"]["observed_type"] == "empty"


def test_observed_types(spark):
    rows = [(1, 1.5, True, "2024-01-01", "2024-01-01T10:00:00"),
            (2, 2.5, False, "2024-01-02", "2024-01-02 11:30:00"),
            (3, 3.5, True, "2024/01/03", "2024-01-03T00:00:00")]
    df = spark.createDataFrame(rows, "integer_col int, number_col double, bool_col boolean, date_col string, datetime_col string")
    p = prof(df)
    assert {c: r["observed_type"] for c, r in p.items()} == {
        "integer_col": "integer", "number_col": "number", "bool_col": "boolean", "date_col": "date",
        "datetime_col": "datetime"}


def test_text_ladder(spark):
    df = spark.createDataFrame([(" 12 ", "1.5e3", "True", "123"), ("-7", "inf", "false", "abc"),
                                ("+3", "4", "TRUE", "2024-01-01")], "i string, f string, b string, mixed string")
    p = prof(df)
    assert [p[c]["observed_type"] for c in ("i", "f", "b", "mixed")] == ["integer", "number", "boolean", "string"]


def test_top_values_and_samples(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "b", "c", "a", "b", None]], "category string")
    p = prof(df)["category"]
    assert [(t["value"], t["count"]) for t in p["top_values"]][:2] == [("b", 3), ("a", 2)]
    assert p["sample_values"] == ["a", "b", "c"]
    assert p["distinct_count"] == 3


def test_ranges(spark):
    rows = [(5, "ab", "2024-01-01T10:00:00"), (20, "abcd", "2024-03-01T00:00:00"), (10, "abc", "2024-02-01T12:00:00")]
    p = prof(spark.createDataFrame(rows, "numbers int, strings string, datetimes string"))
    assert (p["numbers"]["numeric_min"], p["numbers"]["numeric_max"]) == (5.0, 20.0)
    assert (p["strings"]["string_min_length"], p["strings"]["string_max_length"]) == (2, 4)
    assert (p["datetimes"]["datetime_min"], p["datetimes"]["datetime_max"]) == ("2024-01-01T10:00:00", "2024-03-01T00:00:00")
    assert p["strings"]["numeric_min"] is None and p["numbers"]["string_min_length"] is None


def test_profile_by_slice(spark):
    df = spark.createDataFrame([("x", 1), ("x", None), ("y", 3)], "g string, v int")
    rows = profile(df, by=["g"], columns=["v"]).collect()
    got = {r["slice"]: (r["row_count"], r["null_count"]) for r in rows}
    assert got == {"g=x": (2, 1), "g=y": (1, 0)}


def test_summary_sorted(spark):
    df = spark.createDataFrame([(1, "a")], "z int, a string")
    assert [r["column"] for r in profile_summary(profile(df)).collect()] == ["a", "z"]


def test_long_values_counted_on_digest_keep_text(spark):
    long_a, long_b = "a" * 100, "b" * 50
    df = spark.createDataFrame([(long_a,), (long_a,), (long_b,), ("short",), (None,)], "t string")
    p = prof(df)["t"]
    assert p["distinct_count"] == 3
    assert p["top_values"][0]["value"] == long_a and p["top_values"][0]["count"] == 2
    assert set(p["sample_values"]) == {long_a, long_b, "short"}


def test_approx_distinct_and_uncounted_columns(spark):
    df = spark.range(2000).selectExpr("id", "id % 7 AS m", "CAST(NULL AS STRING) AS z")
    p = prof(df, distinct="approx", frequency_columns=["m"])
    assert abs(p["id"]["distinct_count"] - 2000) <= 60
    assert p["m"]["distinct_count"] == 7 and len(p["m"]["top_values"]) == 5
    assert p["z"]["distinct_count"] == 0 and p["id"]["top_values"] == []
    q = prof(df, frequency_columns=["m"])
    assert q["id"]["distinct_count"] is None and q["m"]["distinct_count"] == 7


def test_results_do_not_depend_on_session_time_zone(spark):
    from core_helpers import contract, findings

    df = spark.createDataFrame([("2025-01-15T23:30:00",), ("2025-01-01",)], "d string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        out = {}
        for tz in ("UTC", "Pacific/Kiritimati", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            p = prof(df)["d"]
            fs = findings(spark, df, contract({"d": {"freshness": {"max_age_days": 30}}}))
            out[tz] = (p["observed_type"], p["datetime_max"], fs[0]["ev"]["observed_age_days"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert set(out.values()) == {("datetime", "2025-01-15T23:30:00", 45)}


def test_ties_and_samples_by_value_at_any_length(spark):
    texts = [f"x{'0' * 40}{i}" for i in range(6)] + ["zz"] + [f"{'w' * 2000}{i}" for i in (1, 0)]
    df = spark.createDataFrame([(t,) for t in reversed(texts)], "s string")
    (r,) = profile(df).collect()
    ordered = sorted(texts)
    assert [t["value"] for t in r["top_values"]] == ordered[:5] and r["sample_values"] == ordered[:5]
    assert r["distinct_count"] == len(texts)


def test_samples_in_row_order(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (4, None), (5, "c")], "i int, category string")
    rows = {r["column"]: r for r in profile(df, order_by=["i"], sample_values=3).collect()}
    assert rows["category"]["sample_values"] == ["b", "a", "a"] and rows["i"]["sample_values"] == ["1", "2", "3"]
    assert rows["category"]["distinct_count"] == 3


def test_exact_numeric_bounds(spark):
    df = spark.createDataFrame([(9007199254740993,), (7,)], "i bigint")
    (r,) = profile(df).collect()
    assert (r["numeric_min_text"], r["numeric_max_text"]) == ("7", "9007199254740993") and r["numeric_max"] == float(2**53)


def test_sliced_profile_with_long_text_and_odd_names(spark):
    df = spark.createDataFrame([(None, "t" * 600 + "1"), ("column", "t" * 600 + "0"), (None, "t" * 600 + "0")], "rows string, s string")
    got = {(r["slice"], r["column"]): r for r in profile(df, by=["rows"], columns=["s"]).collect()}
    assert got[("rows=\\N", "s")]["sample_values"] == ["t" * 600 + "0", "t" * 600 + "1"]
    assert got[("rows=column", "s")]["sample_values"] == ["t" * 600 + "0"]
