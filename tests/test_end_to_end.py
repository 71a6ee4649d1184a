"""A sample of river levels end to end: read CSV, validate, triage, gate."""

import pytest
from core_helpers import REF

from tablepact import contract_rules, contracts_frame, validate
from tablepact.operators import review, triage
from tablepact.sources.tables import dataset_facts, read_table, require_non_empty

HEADER = "probe,station,contact,read_on,grade,level_cm"
VALID = [
    "PR-0101,Harbour,desk@harbour.example,2023-05-02,fine,12.5",
    "PR-0102,Old Mill,ops@mill.example,2023-05-02,fair,0",
    "PR-0103,Weir,team@weir.example,2023-05-03,poor,88.25",
]
FAILING = [
    "PR-0101,Harbour,desk@harbour.example,2023-05-02,fine,12.5,yes",
    "PR-0102,Old Mill,,2023-05-02,fair,-3,no",
    "PR-0102,Weir,team@weir.example,2023-05-03,unknown,88.25,yes",
    "P7,,nobody at weir,2023-05-04,unknown,41,no",
    "PR-0104,Lock 3,lock@canal.example,2023-05-05,poor,17.75,no",
]
CONTRACT = {
    "contract": {"name": "river_levels", "version": "3"},
    "dataset": {"severity_defaults": {"pattern_violation": "warning"}},
    "columns": {
        "probe": {"type": "string", "nullable": False, "unique": True, "pattern": "PR-[0-9]{4}"},
        "station": {"type": "string", "nullable": False},
        "contact": {"type": "string", "nullable": False, "pattern": "[^@ ]+@[^@ ]+"},
        "read_on": {"type": "date", "nullable": False},
        "grade": {"type": "string", "nullable": False, "allowed_values": ["fine", "fair", "poor"]},
        "level_cm": {"type": "number", "nullable": False, "min": 0},
    },
    "row_count": {"min": 2, "max": 5000, "severity": "warning"},
}


def _csv(tmp_path, name, header, lines):
    p = tmp_path / name
    p.write_text("\n".join([header] + lines) + "\n")
    return str(p)


def _validate(spark, path):
    df = require_non_empty(read_table(spark, path))
    rules = contract_rules(spark, contracts_frame(spark, [CONTRACT]))
    return df, validate(df, rules, reference_date=REF, dataset_name="levels")


def test_failing_sample_has_eight_findings(spark, tmp_path):
    df, v = _validate(spark, _csv(tmp_path, "f.csv", HEADER + ",checked", FAILING))
    rows = v.findings.orderBy("seq").collect()
    assert len(rows) == 8
    assert sum(r["severity"] == "error" for r in rows) == 5
    assert sum(r["severity"] == "warning" for r in rows) == 3
    assert sum(r["rule_type"] == "uniqueness_violation" for r in rows) == 1
    assert [r["finding_id"] for r in rows] == [
        "unexpected_column:checked", "nullability_violation:station", "nullability_violation:contact", "uniqueness_violation:probe",
        "allowed_values_violation:grade", "range_violation:level_cm", "pattern_violation:probe", "pattern_violation:contact"]
    c = triage.classify(v.findings)
    assert review.overall_status(c, v.runs).collect()[0]["overall_status"] == "Failed"
    assert review.gate(c, v.runs, "error").collect()[0]["should_fail"] is True
    assert dict(zip(df.columns, [t for _, t in df.dtypes]))["checked"] == "string"


def test_valid_sample_passes(spark, tmp_path):
    _, v = _validate(spark, _csv(tmp_path, "v.csv", HEADER, VALID))
    assert v.findings.collect() == []
    c = triage.classify(v.findings)
    assert review.overall_status(c, v.runs).collect()[0]["overall_status"] == "Passed"


def test_csv_na_tokens_become_null(spark, tmp_path):
    path = _csv(tmp_path, "na.csv", "a,b", ["NA,1", "null,2", "#N/A,3", ",4", "x,5"])
    df = read_table(spark, path)
    assert df.where("a IS NULL").count() == 4
    assert dict(df.dtypes)["b"] == "bigint"


def test_dataset_facts_and_errors(spark, tmp_path):
    path = _csv(tmp_path, "v.csv", HEADER, VALID)
    f = dataset_facts(read_table(spark, path), "levels").collect()[0]
    assert (f["row_count"], f["column_count"]) == (3, 6)
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "data.xls"))
    with pytest.raises(Exception):
        read_table(spark, str(tmp_path / "missing.csv")).collect()
    empty = _csv(tmp_path, "e.csv", HEADER, [])
    with pytest.raises(ValueError, match="zero rows"):
        require_non_empty(read_table(spark, empty))


def test_parquet_and_json_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, s string")
    df.write.parquet(str(tmp_path / "t.parquet"))
    df.write.json(str(tmp_path / "t.json"))
    for path in (str(tmp_path / "t.parquet"), str(tmp_path / "t.json")):
        back = read_table(spark, path)
        f = dataset_facts(back, "t").collect()[0]
        assert (f["row_count"], f["column_count"]) == (2, 2)
        assert back.where("s IS NULL").count() == 1


def test_quotes_commas_and_line_feeds_stay_in_their_cell(spark, tmp_path):
    path = _csv(tmp_path, "q.csv", "a,b", ['"say ""hi"", ok",1', '"two\nlines",2'])
    assert [tuple(r) for r in read_table(spark, path, multi_line=True).orderBy("b").collect()] == [('say "hi", ok', 1), ("two\nlines", 2)]
