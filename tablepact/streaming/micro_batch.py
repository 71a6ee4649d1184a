"""Validate a streaming DataFrame micro-batch by micro-batch.

Each micro-batch is one validation run (``run_id = <prefix>-<batch id>``):
the same fused aggregate and grouped jobs as a batch ``validate``, so every
rule, slice and evidence field behaves identically.  Findings and runs are
written with dynamic partition overwrite on ``run_id``: a batch replayed
after a failure replaces its own partition instead of appending twice, and
the streaming checkpoint records which batches are done.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablepact.plans.validation import collect_rules, validate


def _write(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id").parquet(path))


def validate_stream(
    stream: DataFrame,
    rules: DataFrame | Sequence[Row],
    output_path: str,
    *,
    checkpoint_location: str,
    reference_date: _dt.date | None = None,
    by: Sequence[str] | Mapping[str, Column] | None = None,
    max_examples: int = 20,
    dataset_name: str = "stream",
    run_prefix: str = "batch",
    available_now: bool = False,
) -> StreamingQuery:
    """Start a query that writes ``findings`` and ``runs`` for every micro-batch
    under ``output_path`` (parquet, partitioned by ``run_id``).

    The rules are collected once on the driver (a contract is metadata).
    ``checkpoint_location`` holds the stream's progress: a folder of its own for each stream, on
    storage that outlives the cluster.  A batch is read from its source once and kept while its
    jobs run.
    """
    rows = collect_rules(rules)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            v = validate(batch, rows, reference_date=reference_date, by=by, max_examples=max_examples,
                         run_id=f"{run_prefix}-{batch_id}", dataset_name=dataset_name)
            _write(v.findings.withColumn("batch_id", F.lit(batch_id)), f"{output_path}/findings")
            _write(v.runs.withColumn("batch_id", F.lit(batch_id)), f"{output_path}/runs")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_location)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
