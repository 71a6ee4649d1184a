"""Micro-batch validation of a file stream."""

import shutil

from core_helpers import SF, rules_of

from tablepact.catalog import inputs as I
from tablepact.streaming import validate_stream


def test_stream_findings_per_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    shutil.copy(f"{SF}/orders.parquet", src / "part-0.parquet")
    schema = spark.read.parquet(str(src)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = tmp_path / "out"
    q = validate_stream(stream, rules_of(spark, I.ORDERS_CONTRACT), str(out),
                        checkpoint_location=str(tmp_path / "ckpt"), reference_date=I.ORDERS_REFERENCE_DATE,
                        dataset_name="orders", available_now=True)
    q.awaitTermination(300)
    findings = spark.read.parquet(str(out / "findings"))
    got = sorted(r["finding_id"] for r in findings.collect())
    assert got == sorted(["type_mismatch:o_orderdate", "allowed_values_violation:o_orderstatus",
                          "range_violation:o_totalprice", "freshness_violation:o_orderdate"])
    runs = spark.read.parquet(str(out / "runs")).collect()
    assert [r["row_count"] for r in runs] == [spark.read.parquet(f"{SF}/orders.parquet").count()]


def test_replayed_batch_replaces_its_partition(spark, tmp_path):
    from tablepact.streaming.micro_batch import _write

    df = spark.createDataFrame([("batch-0", 1), ("batch-0", 2)], "run_id string, x int")
    path = str(tmp_path / "findings")
    _write(df, path)
    _write(df, path)  # the same micro-batch delivered again after a failure
    _write(spark.createDataFrame([("batch-1", 3)], "run_id string, x int"), path)
    got = sorted((r["run_id"], r["x"]) for r in spark.read.parquet(path).collect())
    assert got == [("batch-0", 1), ("batch-0", 2), ("batch-1", 3)]
