"""Dataset intake: readers, dataset facts, the non-empty guard."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.functions import values

# Text a CSV cell may hold that counts as a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# CSV text read as a boolean.
BOOL_TOKENS = ("True", "False", "TRUE", "FALSE", "true", "false")

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json"}


def read_table(spark: SparkSession, path: str, fmt: str | None = None, infer_types: bool = True,
               multi_line: bool = False) -> DataFrame:
    """Read a dataset.  CSV: header row, NA tokens become null, and (by default)
    columns whose every value is boolean / integer / number text are cast to
    that type, the way a dataframe library reads CSV.  The inference is one
    aggregate pass over the file; no per-row Python.  Quotes within a quoted cell are
    doubled.  A file is split over tasks at its line feeds; set ``multi_line`` for files whose
    quoted cells hold line feeds, which keeps each file in one task.
    """
    if fmt is None:
        ext = os.path.splitext(path.rstrip("/"))[1].lower()
        if ext not in FORMATS:
            raise ValueError(f"unsupported dataset extension '{ext}'; supported: {', '.join(sorted(FORMATS))}")
        fmt = FORMATS[ext]
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "json":
        return spark.read.json(path)
    if fmt != "csv":
        raise ValueError(f"unsupported format '{fmt}'")
    raw = spark.read.option("header", True).option("inferSchema", False).option("escape", '"') \
        .option("multiLine", multi_line).csv(path)
    na = values.lits(list(NA_TOKENS))
    cleaned = raw.selectExpr(
        *[f"CASE WHEN {values.ident(c)} IN ({na}) THEN NULL ELSE {values.ident(c)} END AS {values.ident(c)}"
          for c in raw.columns]
    )
    if not infer_types or not raw.columns:
        return cleaned
    return _cast_inferred(cleaned)


def _cast_inferred(df: DataFrame) -> DataFrame:
    counters = []
    for i, c in enumerate(df.columns):
        x = values.ident(c)
        counters += [
            f"count({x}) AS n{i}",
            f"count_if({x} IN ({values.lits(list(BOOL_TOKENS))})) AS b{i}",
            f"count_if({values.is_int_text(x)}) AS i{i}",
            f"count_if({values.is_num_text(x)}) AS f{i}",
            f"count(try_cast({values.trimmed(x)} AS BIGINT)) AS l{i}",
        ]
    stats = df.agg(*[F.expr(e) for e in counters]).first()
    out = []
    for i, c in enumerate(df.columns):
        n, b, it, f, fits = (stats[f"{p}{i}"] for p in "nbifl")
        x = values.ident(c)
        if n > 0 and b == n:
            out.append(f"lower({x}) = 'true' AS {x}")
        elif n > 0 and it == n and fits == n:
            out.append(f"try_cast({values.trimmed(x)} AS BIGINT) AS {x}")
        elif n > 0 and f == n:
            out.append(f"{values.num_from_text(x)} AS {x}")
        elif n == 0:
            out.append(f"CAST({x} AS DOUBLE) AS {x}")
        else:
            out.append(x)
    return df.selectExpr(*out)


def dataset_facts(df: DataFrame, dataset_name: str = "dataset") -> DataFrame:
    """One row: dataset name, row count, column count, ordered column names."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(dataset_name).alias("dataset_name"),
        F.col("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).cast("array<string>").alias("columns"),
    )


def require_non_empty(df: DataFrame, name: str = "dataset") -> DataFrame:
    """Zero columns or zero rows is an input error, not a finding."""
    if not df.columns:
        raise ValueError(f"Dataset '{name}' is empty (zero columns).")
    if df.isEmpty():
        raise ValueError(f"Dataset '{name}' is empty (zero rows).")
    return df
