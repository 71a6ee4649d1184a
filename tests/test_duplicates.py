"""Uniqueness: hashes of all keys in one scan, exact counts, and what enters the exact selection."""

import json

from core_helpers import contract, findings
from pyspark.sql import functions as F

from tablepact.plans import duplicates as D
from tablepact.plans import ordered
from tablepact.plans.frames import ALL


def unique_keys(df, *columns):
    df = df.withColumn(ALL, F.lit(0))
    return [D.UniqueKey(j, df, (ALL,), c) for j, c in enumerate(columns)]


def exchanged_keys(monkeypatch):
    """Row counts of what the exact selection was given."""
    seen = []
    original = ordered.first_keys
    monkeypatch.setattr(ordered, "first_keys", lambda raw, *a, **kw: seen.append(raw.count()) or original(raw, *a, **kw))
    return seen


def test_unique_keys_never_enter_the_exact_selection(spark, monkeypatch):
    seen = exchanged_keys(monkeypatch)
    df = spark.range(600_000).selectExpr("id", "id % 599990 AS nearly", "concat(repeat('x', 300), id % 599990) AS text", "id % 7 AS few")
    found = D.duplicates(unique_keys(df, ("id",), ("nearly",), ("text",), ("id", "few")), 3)
    assert sorted(found) == [1, 2] and seen == [20, 20]
    (row,) = found[1].collect()
    assert (row["dup_keys"], row["dup_rows"], json.loads(row["dup_sample"])) == (10, 20, [{"nearly": i} for i in range(3)])


def test_one_scan_for_all_keys(spark, monkeypatch):
    plans = []
    original = ordered.kept
    monkeypatch.setattr(ordered, "kept", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or original(df))
    df = spark.range(100).selectExpr("id AS a", "id AS b", "id AS c")
    assert D.duplicates(unique_keys(df, ("a",), ("b",), ("a", "c")), 3) == {}
    assert len(plans) == 1 and plans[0].count("Range (") == 1


def test_mostly_duplicates_give_the_same_with_and_without_the_filter(spark, monkeypatch):
    rows = [(i % 3, None if i % 5 == 0 else float("nan") if i % 5 == 1 else -0.0 if i % 5 == 2 else float(i % 5), "p" * 300 + str(i % 4)) for i in range(240)]
    df = spark.createDataFrame(rows, "g int, x double, t string")
    columns = [("g",), ("x",), ("t",), ("g", "x", "t")]
    whole = {j: t.collect() for j, t in D.duplicates(unique_keys(df, *columns), 9).items()}
    monkeypatch.setattr(D, "MOST_HASHES", 0)
    assert {j: t.collect() for j, t in D.duplicates(unique_keys(df, *columns), 9).items()} == whole
    assert [whole[j][0]["dup_keys"] for j in range(3)] == [3, 4, 4]


def test_same_values_in_other_places_or_slices_are_no_duplicates(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("b", "c"), ("c", "b"), ("d", None), ("d", None)], "x string, y string")
    doc = contract({"x": {}, "y": {}}, uniqueness=[{"name": "pair", "columns": ["x", "y"]}])
    (f,) = findings(spark, df, doc)
    assert (f["ev"]["duplicate_key_count"], f["ev"]["duplicate_row_count"]) == (1, 2)
    assert f["ev"]["sample_duplicate_keys"] == [{"x": "d", "y": None}]
    assert findings(spark, df, doc, by={"s": F.monotonically_increasing_id()}) == []


def test_columns_named_like_internal_ones(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, 2, 4)], "hash int, rule int, __hash int")
    doc = contract({"hash": {"unique": True}, "rule": {"unique": True}, "__hash": {"unique": True}})
    assert sorted(f["columns"][0] for f in findings(spark, df, doc)) == ["hash", "rule"]
