"""Contract documents -> rules table, header and lint problems."""

from core_helpers import contract, findings, rules_of

from tablepact import contract_header, contract_lint, contract_rules, contracts_frame

GOOD = {
    "contract": {"name": "c", "version": "2", "owner": "o"},
    "dataset": {"severity_defaults": {"range_violation": "warning"}},
    "columns": {"b": {"type": "integer", "min": 0, "severity": "info"},
                "a": {"allowed_values": ["x", 1, True], "nullable": False}},
    "uniqueness": [{"name": "k", "columns": ["a", "b"], "severity": "warning"}],
    "row_count": {"min": 1},
}


def test_rules_defaults_order_and_severity(spark):
    rows = contract_rules(spark, contracts_frame(spark, [GOOD])).collect()
    by = {(r["rule_type"], tuple(r["columns"])): r for r in rows}
    assert by[("range_violation", ("b",))]["severity"] == "info"          # column beats dataset default
    assert by[("nullability_violation", ("a",))]["severity"] == "error"   # global default
    assert by[("uniqueness_violation", ("a", "b"))]["severity"] == "warning"
    assert by[("unexpected_column", ())]["declared_columns"] == ["a", "b"]
    assert by[("row_count_violation", ())]["min_rows"] == 1
    assert by[("missing_required_column", ("b",))]["position"] == 0          # document order kept
    assert by[("missing_required_column", ("a",))]["position"] == 1
    kinds = [(v["value"], v["kind"]) for v in by[("allowed_values_violation", ("a",))]["allowed_values"]]
    assert kinds == [("x", "text"), ("1", "number"), ("true", "boolean")]


def test_dataset_default_severity(spark):
    doc = {"contract": {"name": "c"}, "dataset": {"severity_defaults": {"range_violation": "warning"}},
           "columns": {"v": {"min": 0}}}
    rows = contract_rules(spark, contracts_frame(spark, [doc])).where("rule_type = 'range_violation'").collect()
    assert rows[0]["severity"] == "warning"


def test_header(spark):
    h = contract_header(spark, contracts_frame(spark, [GOOD])).collect()[0]
    assert (h["contract_name"], h["contract_version"], h["owner"]) == ("c", "2", "o")


BAD = [
    ("[1, 2]", "$"),
    ("{not json", "$"),
    ('{"columns": {"a": {}}}', "$.contract"),
    ('{"contract": {"name": ""}, "columns": {"a": {}}}', "$.contract.name"),
    ('{"contract": {"name": "c"}}', "$.columns"),
    ('{"contract": {"name": "c"}, "columns": {"a": {"type": "text"}}}', "$.columns.a.type"),
    ('{"contract": {"name": "c"}, "columns": {"a": {"severity": "fatal"}}}', "$.columns.a.severity"),
    ('{"contract": {"name": "c"}, "columns": {"a": {"freshness": {"max_age_days": 0}}}}',
     "$.columns.a.freshness.max_age_days"),
    ('{"contract": {"name": "c"}, "columns": {"a": {}}, "row_count": {"min": 5, "max": 1}}', "$.row_count"),
    ('{"contract": {"name": "c"}, "columns": {"a": {}}, "uniqueness": [{"name": "u", "columns": []}]}',
     "$.uniqueness[0].columns"),
]


def test_lint_good_documents_are_clean(spark):
    docs = contracts_frame(spark, [GOOD, {"contract": {"name": "m"}, "columns": {"x": {}}}])
    assert contract_lint(spark, docs).collect() == []


def test_lint_reports_each_bad_document(spark):
    docs = spark.createDataFrame([(d,) for d, _ in BAD], "doc string")
    paths = sorted(r["path"] for r in contract_lint(spark, docs).collect())
    assert paths == sorted(p for _, p in BAD)


MORE_BAD = [
    ('{"contract": {"name": "c"}, "dataset": 3, "columns": {"a": {}}}', "$.dataset"),
    ('{"contract": {"name": "c"}, "dataset": {"severity_defaults": []}, "columns": {"a": {}}}',
     "$.dataset.severity_defaults"),
    ('{"contract": {"name": "c"}, "dataset": {"severity_defaults": {"x": "loud"}}, "columns": {"a": {}}}',
     "$.dataset.severity_defaults.x"),
    ('{"contract": {"name": "c"}, "schema": "open", "columns": {"a": {}}}', "$.schema"),
    ('{"contract": {"name": "c"}, "columns": {"a": 5}}', "$.columns.a"),
    ('{"contract": {"name": "c"}, "columns": {"a": {"freshness": 30}}}', "$.columns.a.freshness"),
    ('{"contract": {"name": "c"}, "columns": {"a": {"freshness": {"max_age_days": 3, "reference": "now"}}}}',
     "$.columns.a.freshness.reference"),
    ('{"contract": {"name": "c"}, "columns": {"a": {}}, "row_count": 5}', "$.row_count"),
    ('{"contract": {"name": "c"}, "columns": {"a": {}}, "row_count": {"min": -1}}', "$.row_count.min"),
    ('{"contract": {"name": "c"}, "columns": {"a": {}}, "uniqueness": {"name": "u"}}', "$.uniqueness"),
    ('{"contract": {"name": "c"}, "columns": {"a": {}}, "uniqueness": ["a"]}', "$.uniqueness[0]"),
    ('{"contract": {"name": "c"}, "columns": {"a": {}}, "uniqueness": [{"columns": ["a"]}]}', "$.uniqueness[0].name"),
]


def test_lint_more_structural_problems(spark):
    docs = spark.createDataFrame([(d,) for d, _ in MORE_BAD], "doc string")
    paths = sorted(r["path"] for r in contract_lint(spark, docs).collect())
    assert paths == sorted(p for _, p in MORE_BAD)


BOUNDS = [("5", "5"), ("-2.5", "-2.5"), ("true", "1"), ("false", "0"), ('"7"', "7"), ('" 8 "', "8"), ("9007199254740993", "9007199254740993"), ('"x"', None),
          ('"NaN"', None), ('"inf"', None), ('"1d"', None), ('"1_0"', None), ("[1]", None), ('{"a": 1}', None), ('""', None)]


def test_bounds_are_numbers_or_linted(spark):
    docs = [f'{{"contract": {{"name": "c{i}"}}, "columns": {{"a": {{"min": {text}, "max": null}}}}}}' for i, (text, _) in enumerate(BOUNDS)]
    frame = spark.createDataFrame([(d,) for d in docs], "doc string")
    rules = {r["contract_name"]: r["min_text"] for r in contract_rules(spark, frame).where("rule_type = 'range_violation'").collect()}
    assert rules == {f"c{i}": want for i, (_, want) in enumerate(BOUNDS) if want is not None}
    lint = {(r["contract_name"], r["path"], r["problem"]) for r in contract_lint(spark, frame).collect()}
    assert lint == {(f"c{i}", "$.columns.a.min", "min must be a number") for i, (_, want) in enumerate(BOUNDS) if want is None}


def test_bounds_that_are_no_numbers_do_not_end_a_run(spark):
    df = spark.createDataFrame([(0, 0), (3, 9)], "a int, b int")
    got = findings(spark, df, contract({"a": {"min": True}, "b": {"min": "x", "max": 5}}))
    assert [(f["finding_id"], f["ev"]["below_min_count"], f["ev"]["above_max_count"]) for f in got] == [
        ("range_violation:a", 1, 0), ("range_violation:b", 0, 1)]


def test_lint_accepts_boolean_true_max_age(spark):
    doc = '{"contract": {"name": "c"}, "columns": {"a": {"freshness": {"max_age_days": true}}}}'
    assert contract_lint(spark, spark.createDataFrame([(doc,)], "doc string")).collect() == []


def test_flags_follow_truthiness(spark):
    flags = {"null": (None, False), "zero": (0, False), "empty": ("", False), "list": ([], False), "object": ({}, False), "one": (1, True),
             "text": ("no", True), "true": (True, True), "false": (False, False), "items": ([0], True)}
    doc = contract({name: {"nullable": v, "required": v, "unique": v} for name, (v, _) in flags.items()} | {"absent": {}})
    kinds: dict[str, set[str]] = {}
    for r in rules_of(spark, doc).collect():
        for c in r["columns"]:
            kinds.setdefault(c, set()).add(r["rule_type"])
    for name, (_, on) in flags.items():
        assert kinds[name] == ({"missing_required_column", "uniqueness_violation"} if on else {"nullability_violation"}), name
    assert kinds["absent"] == {"missing_required_column"}
