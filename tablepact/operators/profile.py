"""Column profile: one row per (slice, column).

* Decomposable metrics (counts, min/max, lengths) come from one fused aggregate
  per slice, reshaped by ``inline`` to one row per column; those of text columns, with
  the type-ladder counters, from one aggregate of unpivoted (column, value) rows.
* Frequency metrics (distinct count, top values, samples) come from one
  unpivoted ``(slice, column, key) -> count`` table: a single Expand and a
  map-side-combined hash aggregate on keys of bounded size (see
  ``plans.ordered``).  Top-k windows filter on ``row_number``, so Spark inserts a
  partial window-group limit before their exchange.  If a string column is
  among the counted ones, this table's selection is computed when ``profile`` is
  called, to know which long strings are to be told apart and fetched.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.functions import values
from tablepact.functions.values import ident, lit
from tablepact.plans import ordered
from tablepact.plans.frames import ALL, combine_slices, per_slice_agg, qcol, with_slices

PROFILE_STRUCT = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("physical_type", T.StringType()),
        T.StructField("observed_type", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("null_count", T.LongType()),
        T.StructField("null_percentage", T.DoubleType()),
        T.StructField("non_null_count", T.LongType()),
        T.StructField("numeric_min", T.DoubleType()),
        T.StructField("numeric_max", T.DoubleType()),
        T.StructField("numeric_min_text", T.StringType()),
        T.StructField("numeric_max_text", T.StringType()),
        T.StructField("datetime_min", T.StringType()),
        T.StructField("datetime_max", T.StringType()),
        T.StructField("string_min_length", T.IntegerType()),
        T.StructField("string_max_length", T.IntegerType()),
    ]
)


def _struct(column: str, position: str, physical: str, observed: str, n: str, numeric: tuple, exact: tuple, temporal: tuple, lengths: tuple) -> str:
    """SQL text of a column's PROFILE_STRUCT, from SQL texts."""
    rows = ident("rows")
    return (
        f"CAST(named_struct('column', {column}, 'position', {position}, 'physical_type', {physical}, "
        f"'observed_type', {observed}, 'row_count', {rows}, 'null_count', {rows} - {n}, "
        f"'null_percentage', CASE WHEN {rows} > 0 THEN bround(({rows} - {n}) * 100.0D / {rows}, 2) ELSE 0.0D END, "
        f"'non_null_count', {n}, 'numeric_min', {numeric[0]}, 'numeric_max', {numeric[1]}, "
        f"'numeric_min_text', {exact[0]}, 'numeric_max_text', {exact[1]}, "
        f"'datetime_min', {temporal[0]}, 'datetime_max', {temporal[1]}, "
        f"'string_min_length', {lengths[0]}, 'string_max_length', {lengths[1]}) AS {PROFILE_STRUCT.simpleString()})")


def _none(sql_type: str) -> tuple[str, str]:
    return (f"CAST(NULL AS {sql_type})",) * 2


def _column_metrics(c: str, i: int, dtype: T.DataType) -> tuple[dict[str, str], dict[str, str], str]:
    """Per-row features, aggregates and the struct reading them back of a column that is not text, all as SQL text."""
    x = ident(c)
    fam = values.family(dtype)
    features = {f"v_{i}": values.nullified(x, dtype)}
    n = ident(f"nn_{i}")
    aggs = {f"nn_{i}": f"count({ident(f'v_{i}')})"}

    def ends(name: str, sql: str) -> tuple[str, str]:
        features[f"{name}_{i}"] = sql
        aggs.update({f"{name}min_{i}": f"min({ident(f'{name}_{i}')})", f"{name}max_{i}": f"max({ident(f'{name}_{i}')})"})
        return ident(f"{name}min_{i}"), ident(f"{name}max_{i}")

    numeric, exact, temporal, lengths = _none("DOUBLE"), _none("STRING"), _none("STRING"), _none("INT")
    if fam in ("integer", "number"):
        lo_hi = ends("num", values.own_number(x, dtype))
        numeric, exact = (tuple(f"CAST({e} AS {t})" for e in lo_hi) for t in ("DOUBLE", "STRING"))
    elif fam in ("date", "datetime"):
        temporal = tuple(values.iso_text(e) for e in ends("ts", values.as_timestamp(x, dtype)))
    elif fam == "other":
        lengths = ends("len", f"char_length({values.string_form(x, dtype)})")
    observed = f"(CASE WHEN {n} = 0 THEN '{values.EMPTY}' ELSE '{values.native_observed_type(dtype)}' END)"
    return features, aggs, _struct(lit(c), str(i), lit(dtype.simpleString()), observed, n, numeric, exact, temporal, lengths)


def _text_metrics(data: DataFrame, keys: Sequence[str], columns: Sequence[str], position: Mapping[str, int], types: Mapping[str, T.DataType]) -> DataFrame:
    """(slice keys, PROFILE_STRUCT) of text columns.

    Values are unpivoted to (column, value), so that the ladder and its parsers are compiled once, however many
    columns there are, into code small enough for the JVM's compiler.
    """
    group = [qcol(k) for k in keys]
    entries = ", ".join(f"named_struct('__c', {position[c]}, 'v', CAST({ident(c)} AS STRING))" for c in columns)
    quoted = [ident(k) for k in keys]
    long = data.select(*group, F.expr(f"inline(array({entries}))"))
    long = long.selectExpr(*quoted, "__c", "v", f"{values.trimmed('v')} AS t", f"{values.shape(values.trimmed('v'))} AS r")
    long = long.selectExpr(*quoted, "__c", "v", "t", "r", f"{values.num_from('t', 'r')} AS num", f"{values.ts_from('t', 'r')} AS ts")
    long = long.selectExpr(*quoted, "__c", "char_length(v) AS len", "num", "ts", f"{values.text_code('v', 't', 'r', 'num', 'ts')} AS code")
    counters = [F.expr(sql).alias(f"n_{k}") for k, sql in values.code_counters("code").items()]
    ends = [f(F.col(c)).alias(f"{c}_{name}") for c in ("num", "ts", "len") for name, f in (("min", F.min), ("max", F.max))]
    found = long.groupBy(*group, "__c").agg(F.count(F.lit(1)).alias("rows"), *counters, *ends)
    heads = ", ".join(f"named_struct('__c', {position[c]}, 'name', {lit(c)}, 'physical', {lit(types[c].simpleString())})" for c in columns)
    listed = data.sparkSession.range(1).select(F.expr(f"inline(array({heads}))"))
    if list(keys) == [ALL]:  # every column is listed, if the table has rows or not
        whole = listed.join(found, "__c", "left").withColumn(ALL, F.lit(0))
    else:
        whole = found.join(F.broadcast(listed), "__c")
    whole = whole.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ["rows", *[f"n_{k}" for k in "nbifdt"]]})
    observed = values.observed_type_expr(*[f"n_{k}" for k in "nbifdt"])
    whole = whole.withColumn("observed", F.expr(observed))
    numeric, exact = (tuple(f"CASE WHEN observed IN ('integer', 'number') THEN CAST(num_{m} AS {t}) END" for m in ("min", "max")) for t in ("DOUBLE", "STRING"))
    temporal = tuple(f"CASE WHEN observed IN ('date', 'datetime') THEN {values.iso_text(f'ts_{m}')} END" for m in ("min", "max"))
    lengths = tuple(f"CASE WHEN observed = 'string' THEN len_{m} END" for m in ("min", "max"))
    return whole.select(*group, F.expr(f"inline(array({_struct('name', '__c', 'physical', 'observed', 'n_n', numeric, exact, temporal, lengths)}))"))


def _long(data: DataFrame, keys: Sequence[str], columns: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """(slice keys, extra, column, value) over the non-null canonical values: one Expand."""
    types = {f.name: f.dataType for f in data.schema.fields}
    pairs = [f"named_struct('column', {lit(c)}, 'value', {values.value_text(ident(c), types[c])})" for c in columns]
    out = data.select(*[qcol(k) for k in keys], *[qcol(c) for c in extra], F.expr(f"inline(array({', '.join(pairs)}))"))
    return out.where("value IS NOT NULL")


def _lists(data: DataFrame, keys: Sequence[str], columns: Sequence[str], top: int, samples: int, distinct: bool) -> DataFrame:
    """Per (slice, column): distinct_count, top_values, sample_values, all from one frequency table.

    The table is one Expand over the columns and a map-side-combined count, on keys of bounded size: the
    shuffle never carries whole documents.
    """
    by = [*keys, "column"]
    types = {f.name: f.dataType for f in data.schema.fields}
    may_be_long = any(ordered.is_text(types[c]) for c in columns)
    limits = {name: n for name, n in (("top", top), ("sample", samples)) if n > 0} or {"sample": 0}
    chosen, sizes = ordered.first_keys(_long(data, keys, columns), by, [("value", may_be_long)], limits, lead="CASE WHEN __list = 'top' THEN -__n ELSE 0L END")
    tagged = chosen.select(*[qcol(c) for c in by], "__list", F.col("__n").alias("count"), "value", "__rn")
    if distinct:
        tagged = tagged.unionByName(sizes.select(*[qcol(c) for c in by], F.lit("distinct").alias("__list"), F.col("__keys").alias("count")),
                                    allowMissingColumns=True)
    return tagged.groupBy(*[qcol(c) for c in by]).agg(
        F.max(F.when(F.col("__list") == "distinct", F.col("count"))).alias("distinct_count"),
        F.expr("transform(array_sort(collect_list(CASE WHEN __list = 'top' THEN struct(__rn, "
               "named_struct('value', value, 'count', count) AS p) END)), e -> e.p)").alias("top_values"),
        F.expr("transform(array_sort(collect_list(CASE WHEN __list = 'sample' THEN struct(__rn, value AS p) "
               "END)), e -> e.p)").alias("sample_values"))


def _first_rows(data: DataFrame, keys: Sequence[str], columns: Sequence[str], order_by: Sequence[str], samples: int) -> DataFrame:
    """Per (slice, column) the first non-null values by ``order_by`` (then value): every task sends on at most ``samples`` rows each."""
    names = [f"__order_{i}" for i in range(len(order_by))]
    rows = _long(data.withColumns({n: qcol(c) for n, c in zip(names, order_by)}), keys, columns, extra=names)
    w = Window.partitionBy(*[qcol(k) for k in keys], "column").orderBy(*[F.col(n) for n in names], F.col("value"))
    first = rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= samples)
    return first.groupBy(*[qcol(k) for k in keys], "column").agg(
        F.expr("transform(array_sort(collect_list(struct(__rn, value))), e -> e.value)").alias("sample_values"))


def profile(
    df: DataFrame,
    *,
    by: Sequence[str] | Mapping[str, Column] | None = None,
    columns: Sequence[str] | None = None,
    frequency_columns: Sequence[str] | None = None,
    top_values: int = 5,
    sample_values: int = 5,
    run_id: str = "run",
    dataset_name: str = "dataset",
    distinct: str = "exact",
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Profile every column (or ``columns``) of ``df``, per slice.

    ``frequency_columns`` limits the exact distinct / top-value / sample pass
    (its Expand multiplies rows by the column count); ``[]`` skips it, and
    columns outside it report a null distinct count.  ``distinct="approx"``
    takes every distinct count from the fused aggregate instead
    (``approx_count_distinct``, HyperLogLog++, about 1% relative error): no
    extra pass, for wide high-cardinality tables where only top values of a
    few columns are wanted.

    Samples are the smallest distinct values; with ``order_by`` (columns that
    order the rows) they are the first non-null values in that order, repeats included.
    ``numeric_min`` and ``numeric_max`` are doubles; the ``_text`` columns hold them exactly.
    """
    if distinct not in ("exact", "approx"):
        raise ValueError("distinct must be 'exact' or 'approx'")
    cols = list(columns) if columns is not None else list(df.columns)
    freq_cols = cols if frequency_columns is None else [c for c in frequency_columns if c in cols]
    data, slices = with_slices(df, by)
    keys = list(slices.keys)
    types = {f.name: f.dataType for f in df.schema.fields}
    position = {c: i for i, c in enumerate(df.columns)}
    aggs: dict[str, str] = {"rows": "count(1)"}
    features: dict[str, str] = {}
    structs = []
    text = [c for c in cols if values.family(types[c]) == "text"]
    for c in cols:
        if c not in text:
            f, a, st = _column_metrics(c, position[c], types[c])
            features |= f
            aggs |= a
            structs.append(st)
        if distinct == "approx":
            features[f"v_{position[c]}"] = values.nullified(ident(c), types[c])
            aggs[f"ad_{position[c]}"] = f"approx_count_distinct({ident(f'v_{position[c]}')}, 0.01)"
    metrics = per_slice_agg(data, keys, aggs, [features])
    parts = [metrics.select(*[qcol(k) for k in keys], F.expr("inline(array(" + ", ".join(structs) + "))"))] if structs else []
    if text:
        parts.append(_text_metrics(data, keys, text, position, types))
    if parts:
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    else:
        out = metrics.select(*[qcol(k) for k in keys], F.expr(f"inline(CAST(array() AS ARRAY<{PROFILE_STRUCT.simpleString()}>))"))
    counted = list(cols) if distinct == "approx" else list(freq_cols)
    by_column = [*keys, "column"]
    if distinct == "approx":
        pairs = ", ".join(f"named_struct('column', {lit(c)}, 'distinct_count', {ident(f'ad_{position[c]}')})" for c in cols)
        out = combine_slices([out, metrics.select(*[qcol(k) for k in keys], F.expr(f"inline(array({pairs}))"))], by_column)
    if freq_cols:
        lists = _lists(data, keys, freq_cols, top_values, sample_values, distinct == "exact")
        if distinct == "approx":
            lists = lists.drop("distinct_count")
        parts = [out, lists]
        if order_by:
            parts = [out, lists.drop("sample_values"), _first_rows(data, keys, freq_cols, order_by, sample_values)]
        out = combine_slices(parts, by_column)
    else:
        out = out.withColumn("top_values", F.lit(None).cast("array<struct<value:string,count:bigint>>")) \
                 .withColumn("sample_values", F.lit(None).cast("array<string>"))
    if "distinct_count" not in out.columns:
        out = out.withColumn("distinct_count", F.lit(None).cast("bigint"))
    # computed counts of all-null columns are 0; columns not counted stay null
    out = out.withColumn("distinct_count", F.when(F.col("column").isin(*counted) if counted else F.lit(False),
                                                  F.coalesce(F.col("distinct_count"), F.lit(0))).cast("bigint"))
    out = out.withColumn("top_values", F.coalesce(F.col("top_values"), F.array().cast("array<struct<value:string,count:bigint>>")))
    out = out.withColumn("sample_values", F.coalesce(F.col("sample_values"), F.array().cast("array<string>")))
    head = [F.lit(run_id).alias("run_id"), F.lit(dataset_name).alias("dataset_name"), slices.label().alias("slice")]
    body = [f.name for f in PROFILE_STRUCT.fields] + ["distinct_count", "top_values", "sample_values"]
    taken = {"run_id", "dataset_name", "slice", *body}
    slice_cols = [] if slices.whole else [qcol(k).alias(f"slice_{n}" if n in taken else n) for k, n in zip(keys, slices.names)]
    return out.select(*head, *slice_cols, *[F.col(b) for b in body])


def profile_summary(prof: DataFrame) -> DataFrame:
    """Name, observed type, nulls and distinct count, sorted by column name."""
    return prof.select("run_id", "dataset_name", "slice", "column", "observed_type", "null_count",
                       "distinct_count").orderBy("run_id", "dataset_name", "slice", "column")
