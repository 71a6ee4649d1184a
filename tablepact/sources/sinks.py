"""Sinks for findings and derived tables (distributed writers, no coalesce(1))."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _flat(df: DataFrame) -> DataFrame:
    """CSV-safe projection: arrays joined with '|', maps and structs as JSON."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            out.append(F.array_join(c, "|").alias(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out.append(F.to_json(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write any result table; ``csv`` flattens nested columns (string arrays joined with '|').

    With ``partition_by``, ``overwrite`` replaces only the partitions that ``df`` has.
    """
    if fmt == "csv":
        df = _flat(df)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported sink format '{fmt}'")


def write_findings(findings: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Full findings; one partition a run, so earlier runs in a history stay and a repeated run replaces itself.

    JSON output holds the evidence as a nested object; Parquet keeps its JSON text.
    """
    if fmt == "json":
        findings = findings.withColumn("evidence", F.parse_json("evidence"))
    write_table(findings, path, fmt, mode, ["run_id"])


def write_failures(failures: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The flat finding-level review table as CSV with a header, one partition a run."""
    write_table(failures, path, "csv", mode, ["run_id"])
