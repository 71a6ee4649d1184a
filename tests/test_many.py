"""Many contracts over many tables against one validation each."""

import datetime as dt

from core_helpers import REF, SF
from pyspark.sql import functions as F

from tablepact import contract_rules, contracts_frame, validate
from tablepact.catalog import inputs as I
from tablepact.plans import many, ordered

ODD = {
    "contract": {"name": "odd", "version": "1"},
    "columns": {
        "i": {"type": "number", "min": 2.5, "max": 1e3, "allowed_values": [1, 2.0, "3", True]},
        "d": {"type": "integer", "min": -0.5, "max": "7", "allowed_values": [1.5, 2]},
        "m": {"min": "00.50", "max": 3, "allowed_values": [1.25]},
        "b": {"type": "boolean", "allowed_values": [True], "max": False},
        "t": {"type": "date", "pattern": "[0-9-]+", "min_length": 3, "max_length": 10, "min": 5, "freshness": {"max_age_days": 2}, "unique": True, "nullable": False},
        "day": {"type": "string", "allowed_values": ["2025-01-02", "x"], "freshness": {"max_age_days": 2}, "min": 1},
        "n": {"type": "string", "nullable": False, "pattern": "(", "freshness": {"max_age_days": 1}},
        "gone": {"pattern": "x", "min": 3, "unique": True},
    },
    "uniqueness": [{"name": "pair", "columns": ["i", "t"]}, {"name": "lost", "columns": ["i", "nowhere"], "severity": "info"}],
    "row_count": {"min": 100},
}
LOOSE = {"contract": {"name": "loose", "version": "1"}, "schema": {"allow_unexpected_columns": True}, "columns": {"i": {"min": 3}, "t": {"pattern": "[a-z]+"}}}


def odd_table(spark):
    long = "v" * 300
    return spark.sql(f"""SELECT * FROM VALUES
      (1, 1.0D, 1.25BD, true, '2025-01-02', DATE'2025-01-02', null, 'x'), (2, double('NaN'), 0.30BD, false, 'abc', null, null, 'x'),
      (2, 9.5D, 99.99BD, null, 'abc', DATE'2024-12-31', null, 'y'), (1000000, -0.0D, null, true, ' 12 ', DATE'2025-02-28', null, null),
      (null, 2.0D, 3.00BD, true, null, DATE'2025-01-02', null, 'y'), (3, null, -1.00BD, true, '{long}b', null, null, 'x'), (3, 1.5D, 0.50BD, false, '{long}a', null, null, 'x')
      AS t(i, d, m, b, t, day, n, extra)""")


def rows_of(df):
    return sorted(map(tuple, df.drop("seq").collect()), key=repr)


def compare(spark, tables, docs, pairs, by=None, ref=REF):
    """``pairs`` of (contract, dataset); both ways of validating them."""
    rules = contract_rules(spark, contracts_frame(spark, docs))
    bindings = spark.createDataFrame([(f"r_{c}_{d}", c, d) for c, d in pairs], "run_id string, contract_name string, dataset_name string")
    got = many.validate_many(tables, rules, bindings, by=by, reference_date=ref, max_examples=4)
    findings, runs = [], []
    for c, d in pairs:
        one = validate(tables[d], rules, contract_name=c, dataset_name=d, run_id=f"r_{c}_{d}", by=(by or {}).get(d), reference_date=ref, max_examples=4)
        findings += rows_of(one.findings)
        runs += rows_of(one.runs)
    assert rows_of(got.findings) == sorted(findings, key=repr)
    assert rows_of(got.runs) == sorted(runs, key=repr)
    return got


def test_every_kind_of_rule_and_value(spark):
    odd = odd_table(spark)
    tables = {"odd": odd, "none": odd.limit(0), "sliced": odd, "sliced_none": odd.limit(0)}
    by = {"sliced": ["extra"], "sliced_none": ["extra"]}
    got = compare(spark, tables, [ODD, LOOSE], [(c, d) for c in ("odd", "loose") for d in tables], by)
    kinds = {r["rule_type"] for r in got.findings.select("rule_type").distinct().collect()}
    assert len(kinds) == 11


def test_contracts_of_the_test_tables(spark):
    tables = {"orders": I.table(spark, SF, "orders"), "lineitem": I.table(spark, SF, "lineitem"), "people": I.people(spark, SF)}
    docs = [I.ORDERS_CONTRACT, I.ORDERS_MONTHLY_CONTRACT, I.LINEITEM_CONTRACT, I.PEOPLE_CONTRACT]
    pairs = [("orders_contract", "orders"), ("orders_monthly", "orders"), ("lineitem_contract", "lineitem"), ("people_contract", "people")]
    compare(spark, tables, docs, pairs, {"orders": {"month": F.date_trunc("month", "o_orderdate")}}, dt.date(2001, 12, 31))


def test_predicates_are_shared_and_sent_in_parts(spark, monkeypatch):
    docs = [{"contract": {"name": f"c{i}", "version": "1"}, "schema": {"allow_unexpected_columns": True},
             "columns": {"id": {"min": i % 3, "max": 50, "allowed_values": [i % 2]}}} for i in range(30)]
    rules = contract_rules(spark, contracts_frame(spark, docs))
    bindings = spark.createDataFrame([("r", f"c{i}", "t") for i in range(30)], "run_id string, contract_name string, dataset_name string")
    table = {"t": spark.range(100)}
    bound = many._bound(table, rules, bindings)
    assert many._predicates(bound).count() == 3 + 2
    whole = rows_of(many.validate_many(table, rules, bindings).findings)
    assert len(whole) == 60
    monkeypatch.setattr(ordered, "BROADCAST_BYTES", 600)
    assert rows_of(many.validate_many(table, rules, bindings).findings) == whole


def test_many_predicates_of_a_column_are_not_tried_on_every_cell(spark, monkeypatch):
    long = "v" * 300
    docs = [{"contract": {"name": f"c{j}", "version": "1"}, "schema": {"allow_unexpected_columns": True}, "columns": {
        "i": {"min": j + 1, "max": 3 * j + 0.5, "allowed_values": [j, 2, 2.0, "3"]}, "d": {"min": j / 2, "max": 9.5 - j, "allowed_values": [j / 2, -0.0]},
        "m": {"min": f"{j}.25", "max": f"{j}.50", "allowed_values": [1.25, j]}, "b": {"max": j % 2, "allowed_values": [j % 2 == 0]},
        "t": {"pattern": f"[a-z]+{{{j + 1},}}|{j}", "min_length": j, "max_length": 290 + j, "min": 17 - j, "allowed_values": ["abc", f"{long}{'ab'[j % 2]}", str(j)]},
        "day": {"allowed_values": ["2025-01-02", str(j)]}}} for j in range(many.MANY + 3)]
    rules = contract_rules(spark, contracts_frame(spark, docs))
    odd = odd_table(spark)
    tables, by = {"odd": odd.repartition(3), "sliced": odd, "none": odd.limit(0)}, {"sliced": ["extra"]}
    bindings = spark.createDataFrame([("r", f"c{j}", d) for j in range(len(docs)) for d in tables], "run_id string, contract_name string, dataset_name string")
    tried = []
    checked = many._checked

    def watched(cells, predicates, columns):
        tried.append(predicates.groupBy("dataset_name", "__c", "rule").count().agg(F.max("count")).first()[0] or 0)
        # texts of more than 256 characters alone are tried one by one against many patterns
        assert tried[-1] <= many.MANY or cells.where("char_length(text) <= 256").isEmpty()
        return checked(cells, predicates, columns)

    monkeypatch.setattr(many, "_checked", watched)
    got = many.validate_many(tables, rules, bindings, by=by, reference_date=REF, max_examples=2).findings
    assert tried
    for name, dataset in (("c0", "odd"), ("c1", "sliced"), ("c5", "odd"), ("c10", "sliced"), ("c3", "none")):
        one = validate(tables[dataset], rules, contract_name=name, dataset_name=dataset, run_id="r", by=by.get(dataset), reference_date=REF, max_examples=2)
        assert rows_of(got.where((F.col("contract_name") == name) & (F.col("dataset_name") == dataset))) == rows_of(one.findings)


def test_ranks_across_parts(spark):
    """Bounds that equal values, repeat or lie outside, counted by brute force."""
    rows = [(float(v % 97) - 40, v % 50) for v in range(1500)] + [(-0.0, 1), (0.0, 2), (float("nan"), 3), (None, 4)]
    data = spark.createDataFrame(rows, "d double, i int").repartition(5)
    docs = [{"contract": {"name": f"c{j}", "version": "1"}, "columns": {"d": {"min": lo, "max": hi}, "i": {"min": lo, "max": hi}}}
            for j, (lo, hi) in enumerate((lo, lo + w) for lo in range(-45, 60, 5) for w in (0, 3.5))]
    rules = contract_rules(spark, contracts_frame(spark, docs))
    bindings = spark.createDataFrame([("r", f"c{j}", "t") for j in range(len(docs))], "run_id string, contract_name string, dataset_name string")
    found = many.validate_many({"t": data}, rules, bindings).findings.where("rule_type = 'range_violation'")
    got = {(r[0], r[1]): (r[2], r[3]) for r in found.select("contract_name", "column", F.get_json_object("evidence", "$.below_min_count").cast("int"),
                                                            F.get_json_object("evidence", "$.above_max_count").cast("int")).collect()}
    want = {}
    for doc in docs:
        for at, c in enumerate("di"):
            lo, hi = doc["columns"][c]["min"], doc["columns"][c]["max"]
            both = tuple(sum(1 for r in rows if r[at] is not None and test(r[at])) for test in (lambda v: v < lo, lambda v: v > hi))
            if any(both):
                want[doc["contract"]["name"], c] = both
    assert got == want


def test_bindings_given_twice_are_computed_once(spark):
    """Findings come once for each binding and version of a contract, numbered without a gap."""
    rules = contract_rules(spark, contracts_frame(spark, [ODD, ODD | {"row_count": {"min": 50}}]))
    one = spark.createDataFrame([("r", "odd", "t")], "run_id string, contract_name string, dataset_name string")
    tables = {"t": odd_table(spark)}
    assert many._bound(tables, rules, one.union(one).union(one)).count() == many._bound(tables, rules, one).count()
    single = many.validate_many(tables, rules, one, reference_date=REF).findings
    got = many.validate_many(tables, rules, one.union(one).union(one), reference_date=REF)
    assert rows_of(got.findings) == sorted([r for r in rows_of(single) for _ in range(3)], key=repr)
    places = [r["seq"] for r in got.findings.select("seq").collect()]
    assert len(set(places)) == len(places) and got.runs.count() == 1


def test_no_contract_and_no_binding(spark):
    none = spark.createDataFrame([], "run_id string, contract_name string, dataset_name string")
    got = many.validate_many({"t": spark.range(3)}, contract_rules(spark, contracts_frame(spark, [LOOSE])), none)
    assert got.findings.count() == got.runs.count() == 0
