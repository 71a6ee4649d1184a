"""Plan shape and metamorphic checks: one scan per job, no Python, no cross
joins, partial top-k limits; row order and partitioning never change results."""

import pytest
from core_helpers import SF, rules_of

from tablepact import validate
from tablepact.catalog import inputs as I
from tablepact.operators.profile import profile
from tablepact.plans.frames import per_slice_agg


def _plan(df) -> str:
    df.collect()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


def test_findings_plan_has_no_python_and_no_cross_join(spark, lineitem):
    v = validate(lineitem, rules_of(spark, I.LINEITEM_CONTRACT), reference_date=I.ORDERS_REFERENCE_DATE)
    plan = _plan(v.findings)
    for bad in ("BatchEvalPython", "ArrowEvalPython", "BroadcastNestedLoopJoin", "CartesianProduct"):
        assert bad not in plan, bad
    assert "WindowGroupLimit" in plan or "TakeOrderedAndProject" in plan


def test_fused_aggregate_is_one_scan(spark, lineitem):
    from tablepact.plans import ordered

    plans = []
    original = ordered.kept
    try:
        ordered.kept = lambda df: plans.append(_optimized(df)) or original(df)
        validate(lineitem, rules_of(spark, I.LINEITEM_CONTRACT), reference_date=I.ORDERS_REFERENCE_DATE)
    finally:
        ordered.kept = original
    assert plans[0].count("Relation ") == 1


def test_profile_top_k_limits_before_exchange(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").select("p_size", "p_partkey")
    plan = _plan(profile(part))
    assert "WindowGroupLimit" in plan


def test_sliced_plan_uses_no_cross_join(spark):
    v = I.orders_monthly(spark, SF)
    plan = _plan(v.findings)
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_results_independent_of_row_order_and_partitioning(spark, lineitem):
    rules = rules_of(spark, I.LINEITEM_CONTRACT)
    cols = ["finding_id", "status", "evidence"]
    base = sorted(tuple(r) for r in validate(lineitem, rules, reference_date=I.ORDERS_REFERENCE_DATE)
                  .findings.select(*cols).collect())
    shuffled = lineitem.repartition(7).orderBy("l_partkey", "l_suppkey")
    other = sorted(tuple(r) for r in validate(shuffled, rules, reference_date=I.ORDERS_REFERENCE_DATE)
                   .findings.select(*cols).collect())
    assert base == other


def test_wide_rule_sets_are_one_aggregate(spark):
    df = spark.range(10).selectExpr(*[f"id + {i} AS c{i}" for i in range(3)])
    aggs = {f"m{i}": f"count_if(c{i % 3} > {i % 10})" for i in range(600)}
    from tablepact.plans.frames import ALL

    row = per_slice_agg(df.selectExpr("*", f"0 AS {ALL}"), [ALL], aggs).collect()[0]
    expected = {f"m{i}": sum(1 for x in range(10) if x + i % 3 > i % 10) for i in range(600)}
    assert {k: row[k] for k in expected} == expected


def test_wide_profile_reads_each_column_once(spark, tmp_path):
    """One scan for text columns, one for the others, none of a column of the other's."""
    spark.range(20).selectExpr(*[f"CAST(id * {i} AS {'STRING' if i % 5 == 0 else 'DOUBLE'}) AS c{i}" for i in range(200)]).write.parquet(str(tmp_path / "w"))
    df = spark.read.parquet(str(tmp_path / "w"))
    plan = _plan(profile(df, frequency_columns=[])).split("Initial Plan")[0]
    schemas = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "Scan parquet" in line]
    assert len(schemas) == 2 and sorted("string" in s for s in schemas) == [False, True] and sorted("double" in s for s in schemas) == [False, True]
    for kind in ("string", "double"):
        only = df.select([c for c, t in df.dtypes if t == kind])
        assert _optimized(profile(only, frequency_columns=[])).count("Relation ") == 1


def test_exact_profile_scans_twice(spark, lineitem):
    p = profile(lineitem.select("l_linenumber", "l_quantity"))
    assert _plan(p).split("Initial Plan")[0].count("Scan parquet") <= 2


def test_findings_and_runs_read_job_a_from_its_store(spark, lineitem):
    rules = [r for r in rules_of(spark, I.LINEITEM_CONTRACT).collect() if r["rule_type"] not in ("uniqueness_violation", "allowed_values_violation")]
    v = validate(lineitem, rules, reference_date=I.ORDERS_REFERENCE_DATE)
    for df in (v.findings, v.runs):
        assert _optimized(df).count("Relation ") == 0  # job A is kept, nothing else is left to scan


def test_no_text_is_an_exchange_key(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    doc = {"contract": {"name": "d"}, "columns": {"text": {"pattern": "[^|]*", "unique": True, "allowed_values": ["x"]}}}
    plan = _plan(validate(docs, rules_of(spark, doc)).findings)
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert keys and not any("text#" in k.split("ENSURE")[0] or "value#" in k.split("ENSURE")[0] for k in keys)


def test_clean_table_gets_no_sample_pass(spark, monkeypatch):
    from tablepact.plans import ordered

    plans = []
    original = ordered.kept
    monkeypatch.setattr(ordered, "kept", lambda df: plans.append(_optimized(df)) or original(df))
    df = spark.createDataFrame([("ok",), ("ok",)], "s string")
    doc = {"contract": {"name": "c"}, "columns": {"s": {"allowed_values": ["ok"], "pattern": "o."}}}
    v = validate(df, rules_of(spark, doc))
    assert v.findings.collect() == []
    assert len(plans) == 1 and "Window" not in _plan(v.findings)  # job A alone
    dirty = spark.createDataFrame([("ok",), ("no",)], "s string")
    validate(dirty, rules_of(spark, doc))
    assert "Window" not in plans[1] and "Window" in plans[2]  # job A, then the selection


def test_profile_independent_of_row_order_and_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = sorted(tuple(r) for r in profile(docs).drop("position").collect())
    b = sorted(tuple(r) for r in profile(docs.repartition(5).orderBy("n_chars")).drop("position").collect())
    assert a == b
