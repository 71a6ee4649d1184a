"""Findings and failures writers."""

import csv
import glob
import json
import os

from core_helpers import contract, run

from tablepact.operators import triage
from tablepact.sources.sinks import write_failures, write_findings


def test_findings_json_and_failures_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "id int, s string")
    doc = contract({"id": {"unique": True}, "s": {}}, uniqueness=[{"name": "k", "columns": ["id", "s"]}])
    v = run(spark, df, doc)
    path = str(tmp_path / "findings")
    write_findings(v.findings, path)
    rows = [json.loads(line) for f in glob.glob(f"{path}/run_id=run/*.json") for line in open(f)]
    assert [r["finding_id"] for r in rows] == ["uniqueness_violation:id"]
    assert rows[0]["evidence"]["duplicate_row_count"] == 2 and rows[0]["evidence"]["sample_duplicate_keys"] == [{"id": 1}]

    write_findings(run(spark, df, doc, run_id="second").findings, path)
    write_findings(run(spark, df, doc, run_id="second").findings, path)
    assert sorted(os.listdir(path))[-2:] == ["run_id=run", "run_id=second"]
    assert spark.read.json(path).count() == 2

    failures = triage.failures_table(triage.classify(v.findings)).drop("dataset_name", "slice", "seq")
    write_failures(failures, str(tmp_path / "failures"))
    files = glob.glob(str(tmp_path / "failures" / "run_id=run" / "*.csv"))
    lines = [r for f in files for r in csv.DictReader(open(f))]
    # The names of the review columns.
    assert list(lines[0].keys()) == ["finding_id", "rule_type", "column", "columns", "severity", "status",
                                     "compatibility", "priority", "review_category", "message",
                                     "suggested_action", "recommended_human_action"]
    assert lines[0]["columns"] == "id" and lines[0]["priority"] == "high"
