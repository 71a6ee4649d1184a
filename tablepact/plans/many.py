"""Many contracts over many tables in one plan.

Rules stay a table.  ``bindings`` says which contract holds for which dataset; nothing loops over contracts, and
what loops over datasets is the reading of their schemas and the union of their scans.

* **Cells.**  The columns that any rule reads are unpivoted to (dataset, slice, column, value) rows, all datasets
  in one union, so that parsers and aggregates are compiled once.
* **Metrics.**  One aggregate gives each (dataset, slice, column) its row: nulls, ladder counters, ends, lengths.
* **Predicates.**  Rules that look at single values (allowed values, range, pattern, length) are made distinct over
  all contracts.  Allowed values are looked up by the cells.  A column with few other predicates is joined to them, and
  one aggregate counts the failing rows of each; one with more than ``MANY`` is counted by value first: a range or
  length then has its place among the sorted values, a pattern is tried once on each text of up to
  ``ordered.SEGMENTS[0]`` characters.  What goes out by broadcast does so in parts of checked size.
* **Samples** of failing values and duplicate keys come from ``plans.ordered``, as for a single contract.
* **Findings** are the rules joined to these tables, which hold at most a row for each (dataset, slice, column or
  predicate).

Findings are those of ``validate`` for each contract by itself.  Decimals with over 18 places behind the point or
20 before it are compared as doubles.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.functions import patterns, values
from tablepact.functions.values import ident, lit, lits
from tablepact.plans import ordered
from tablepact.plans.duplicates import UniqueKey, duplicates
from tablepact.plans.frames import Slices, combine_slices, with_slices
from tablepact.plans.validation import _NO_NULL_DROP, FINDINGS_SCHEMA, RUNS_SCHEMA, Validation
from tablepact.plans.vocabulary import COMPATIBLE_TYPES, MESSAGES

#: Exact numbers of integer and decimal columns are compared in this type.
EXACT = "DECIMAL(38,18)"
#: Beyond every exact value.
FAR = "CAST('99999999999999999999' AS DECIMAL(38,18))"
ROW_RULES = ("allowed_values_violation", "range_violation", "pattern_violation", "length_violation")
#: Pseudo column of the cells that stand for whole rows, and of rules on them.
ROW = -1
#: Most predicates of a column (ranges and lengths, or patterns) that are tried on its cells one by one.
MANY = 8


def _exact(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.DecimalType):
        return dtype.scale <= 18 and dtype.precision - dtype.scale <= 20
    return values.family(dtype) == "integer"


def _kind(dtype: T.DataType) -> str:
    """How values of a type are compared: exact, double, boolean, moment or text."""
    if _exact(dtype):
        return "exact"
    return {"number": "double", "boolean": "boolean", "date": "moment", "datetime": "moment"}.get(values.family(dtype), "text")


#: Fields of a cell and what they are where no rule reads them.
CELL = {"__c": str(ROW), "known": "true", "parsed": "CAST(NULL AS STRING)", "text": "CAST(NULL AS STRING)", "shown": "CAST(NULL AS STRING)",
        "word": "CAST(NULL AS STRING)", "x": f"CAST(NULL AS {EXACT})", "d": "CAST(NULL AS DOUBLE)", "moment": "CAST(NULL AS TIMESTAMP_NTZ)"}


def _cell(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in (CELL | fields).items()) + ")"


def _column_cell(i: int, c: str, dtype: T.DataType, rules: set[str]) -> str:
    """SQL text of a column's cell, with the fields that its rules read."""
    x, kind = ident(c), _kind(dtype)
    fields = {"__c": str(i), "known": f"{values.nullified(x, dtype)} IS NOT NULL"}
    if values.family(dtype) == "text" and rules & _LADDER:
        fields["parsed"] = values.trimmed(x)
    if rules & {"pattern_violation", "length_violation"}:
        fields["text"] = values.string_form(x, dtype)
    if "allowed_values_violation" in rules:
        fields["shown"] = values.value_text(x, dtype)
        if kind == "text":
            fields["word"] = fields["shown"]
    if kind in ("exact", "double", "boolean") and rules & {"range_violation", "allowed_values_violation"}:
        fields |= {"x": f"CAST({x} AS {EXACT})"} if kind == "exact" else {"d": f"CAST({values.own_number(x, dtype)} AS DOUBLE)"}
    if kind == "moment":
        fields["moment"] = values.as_timestamp(x, dtype)
    return _cell(**fields)


def _schema_rows(tables: Mapping[str, DataFrame]) -> list[tuple]:
    """(dataset, columns, number, kind, native observed type, decimal places) of every table, from its schema alone."""
    return [(name, list(df.columns), i, f.name, _kind(f.dataType), values.native_observed_type(f.dataType),
             f.dataType.scale if isinstance(f.dataType, T.DecimalType) else 0) for name, df in tables.items() for i, f in enumerate(df.schema.fields)]


def _bound(tables: Mapping[str, DataFrame], rules: DataFrame, bindings: DataFrame) -> DataFrame:
    """Every rule of every binding, stored: in report order (``seq``), with its column's place and kind and its predicate's key."""
    spark = rules.sparkSession
    columns = spark.createDataFrame(_schema_rows(tables), "dataset_name string, dataset_columns array<string>, __c int, __name string, kind string, native string, places int")
    datasets = spark.createDataFrame([(n, list(df.columns)) for n, df in tables.items()], "dataset_name string, dataset_columns array<string>")
    # a binding that is given several times is computed once; its findings are copied at the end
    once = bindings.groupBy("run_id", "contract_name", "dataset_name").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    bound = ordered.kept(rules.join(once, "contract_name"))
    texts = [r["pattern"] for r in bound.where("rule_type = 'pattern_violation'").select("pattern").distinct().collect()]
    errors = patterns.pattern_errors(spark, texts)
    known = spark.createDataFrame([(p, patterns.to_java(p) if e is None else None, e) for p, e in errors.items()], "pattern string, java string, error string")
    bound = bound.join(F.broadcast(datasets), "dataset_name").join(F.broadcast(known), "pattern", "left")
    # a column's fields are on all its rules; only the pattern's own rule minds its error
    bound = bound.withColumn("error", F.expr("CASE WHEN rule_type = 'pattern_violation' THEN error END"))
    bound = bound.withColumn("extra", F.when(F.col("rule_type") == "unexpected_column", F.expr("filter(dataset_columns, c -> NOT array_contains(declared_columns, c))"))
                             .otherwise(F.array().cast("array<string>")))
    bound = bound.withColumn("__name", F.expr("CASE WHEN size(columns) > 0 THEN columns[0] END"))
    bound = bound.join(F.broadcast(columns.drop("dataset_columns")), ["dataset_name", "__name"], "left")
    order = "PARTITION BY run_id, contract_name, dataset_name ORDER BY rule_order, position, rule_name"
    seq = f"row_number() OVER ({order}) + coalesce(sum(size(extra)) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    own = {"allowed_values": "allowed_values", "min_text": "range", "max_text": "range", "pattern": "pattern", "min_length": "length", "max_length": "length"}
    own = ", ".join(f"CASE WHEN rule_type = '{r}_violation' THEN {f} END AS {f}" for f, r in own.items())
    params = f"to_json(struct(dataset_name, __c, rule_type, {own}))"
    unique = "CASE WHEN rule_type = 'uniqueness_violation' THEN to_json(struct(dataset_name, columns)) END"
    bound = bound.withColumn("seq", F.expr(f"CAST(({seq} - 1) * copies + 1 AS INT)")).withColumn("step", F.expr("1 + size(extra)")).withColumn("params", F.expr(
        f"CASE WHEN rule_type IN ({lits(list(ROW_RULES))}) AND __c IS NOT NULL AND error IS NULL THEN {params} ELSE {unique} END"))
    return ordered.kept(bound.withColumn("key", F.expr("sha2(params, 256)")))


_LADDER = {"type_mismatch", "range_violation", "freshness_violation"}


def _cells(sliced: Mapping[str, tuple[DataFrame, Slices]], needed: Mapping[str, Mapping[str, set[str]]]) -> list[DataFrame]:
    """The cells of the needed columns of all datasets; a dataset listed without columns has one cell a row.

    Text that is parsed comes apart from the other cells, whose code then stays small.
    """
    kinds: dict[bool, dict[str, list[str]]] = {False: {}, True: {}}
    for name, columns in needed.items():
        data, _ = sliced[name]
        fields = {f.name: (i, f.dataType) for i, f in enumerate(data.schema.fields)}
        if not columns:
            kinds[False][name] = [_cell()]
        for c, rules in sorted(columns.items()):
            i, dtype = fields[c]
            kinds[values.family(dtype) == "text" and bool(rules & _LADDER)].setdefault(name, []).append(_column_cell(i, c, dtype, rules))
    out = []
    for parsed, datasets in kinds.items():
        cells = None
        for name, columns in datasets.items():
            data, slices = sliced[name]
            part = data.select(F.lit(name).alias("dataset_name"), slices.label().alias("slice"), F.expr(f"inline(array({', '.join(columns)}))"))
            cells = part if cells is None else cells.unionByName(part)
        if cells is not None and parsed:
            cells = cells.selectExpr("*", f"{values.shape('parsed')} AS shape")
            out.append(cells.selectExpr("*", f"{values.num_from('parsed', 'shape')} AS num", f"{values.ts_from('parsed', 'shape')} AS ts"))
        elif cells is not None:
            out.append(cells.selectExpr("*", "CAST(NULL AS STRING) AS shape", "CAST(NULL AS DOUBLE) AS num", "CAST(NULL AS TIMESTAMP_NTZ) AS ts").withColumn(
                "parsed", F.lit(None).cast("string")))
    return out


def _together(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _metrics(cells: DataFrame) -> DataFrame:
    """One row a (dataset, slice, column)."""
    coded = cells.selectExpr("dataset_name", "slice", "__c", "known", "char_length(text) AS len", "x", "coalesce(d, num) AS d", "coalesce(moment, ts) AS moment",
                             f"{values.text_code('parsed', 'parsed', 'shape', 'num', 'ts')} AS code")
    counters = [F.expr(sql).alias(f"n_{k}") for k, sql in values.code_counters("code").items() if k != "n"]
    ends = [f(F.col(c)).alias(f"{c}_{n}") for c in ("x", "d", "len") for n, f in (("min", F.min), ("max", F.max))]
    return coded.groupBy("dataset_name", "slice", "__c").agg(F.count(F.lit(1)).alias("rows"), F.count_if("known").alias("known"), *counters, *ends,
                                                             F.max("moment").alias("latest"))


def _predicates(bound: DataFrame) -> DataFrame:
    """The distinct predicates on single values, with parameters in the type of their column."""
    def bound_of(text: str, sign: str) -> list[str]:
        far = f"CASE WHEN {text} IS NOT NULL THEN CASE WHEN CAST({text} AS DOUBLE) < 0 THEN -{FAR} ELSE {FAR} END END"
        return [f"coalesce(try_cast({text} AS {EXACT}), {far}) AS {sign}_x", f"CAST({text} AS DOUBLE) AS {sign}_d"]

    def pick(kind: str, sql: str) -> str:
        return f"transform(filter(allowed_values, a -> a.kind = '{kind}'), a -> {sql})"

    flag = "CASE WHEN lower(a.value) = 'true' THEN 1.0D ELSE 0.0D END"
    one = bound.where(f"key IS NOT NULL AND rule_type IN ({lits(list(ROW_RULES))})").dropDuplicates(["key"])
    return one.selectExpr(
        "dataset_name", "__c", "key", "rule_type AS rule", "kind", "java", "min_length", "max_length", "length(params) AS bytes",
        *bound_of("min_text", "lo"), *bound_of("max_text", "hi"), f"{pick('number', f'try_cast(a.value AS {EXACT})')} AS in_x",
        f"{pick('number', 'try_cast(a.value AS DOUBLE)')} AS in_d", f"{pick('boolean', flag)} AS in_b",
        f"{pick('text', 'a.value')} AS in_text", f"{pick('text', values.ts_from_text('a.value'))} AS in_moment")


#: SQL: how the rows that fail a predicate are counted, told by its rule and the number of the column's predicates of that rule.
_WAY = f"""CASE WHEN rule = 'allowed_values_violation' THEN 'listed' WHEN same <= {MANY} THEN 'one by one'
  WHEN rule = 'pattern_violation' THEN 'spelled' ELSE 'ranked' END"""
#: SQL: whether a cell fails its predicate, on the low side (or at all) and on the high side.
_LOW = """CASE rule WHEN 'range_violation' THEN CASE WHEN kind = 'exact' THEN x < lo_x ELSE coalesce(d, num) < lo_d END
  WHEN 'length_violation' THEN char_length(text) < min_length
  WHEN 'pattern_violation' THEN known AND NOT (text RLIKE java)
  ELSE known AND NOT coalesce(CASE kind WHEN 'exact' THEN array_contains(in_x, x) WHEN 'double' THEN array_contains(in_d, d)
    WHEN 'boolean' THEN array_contains(in_b, d) WHEN 'moment' THEN array_contains(in_moment, moment) ELSE array_contains(in_text, shown) END, false) END"""
_HIGH = """CASE rule WHEN 'range_violation' THEN CASE WHEN kind = 'exact' THEN x > hi_x ELSE coalesce(d, num) > hi_d END
  WHEN 'length_violation' THEN char_length(text) > max_length END"""


def _in_parts(predicates: DataFrame, by: Sequence[str], use) -> DataFrame:
    """The union of ``use(part)`` over parts of ``predicates`` that are small enough to broadcast."""
    total = predicates.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    passes = max(1, -(-total * 4 // ordered.BROADCAST_BYTES))
    return _together([use(predicates if passes == 1 else predicates.where(F.pmod(F.xxhash64(*by), F.lit(passes)) == i)) for i in range(passes)])


def _checked(cells: DataFrame, predicates: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells joined to the predicates of their column; predicates go out in parts of checked size."""
    return _in_parts(predicates, ["key"], lambda part: cells.join(F.broadcast(part), ["dataset_name", "__c"]).selectExpr(*columns))


def _failing(checked: DataFrame) -> DataFrame:
    return checked.groupBy("dataset_name", "slice", "key").agg(F.count_if("low").alias("low"), F.count_if("high").alias("high"))


def _ranked(cells: DataFrame, predicates: DataFrame) -> DataFrame:
    """Failing rows of ranges and lengths: each bound has its place among the sorted values of its column.

    Values, counted, and bounds are dealt out by range; a bound's count is the running sum in its part and the sums of the
    parts before, so that neither a column nor its bounds lie in one task.
    """
    group = ["dataset_name", "slice", "__c", "rule"]
    read = (f"inline(array(named_struct('rule', 'range_violation', 'x', x, 'd', coalesce(d, num) + 0.0D), "
            f"named_struct('rule', 'length_violation', 'x', CAST(char_length(text) AS {EXACT}), 'd', CAST(NULL AS DOUBLE))))")
    found = cells.selectExpr("dataset_name", "slice", "__c", read).where("x IS NOT NULL OR d IS NOT NULL")
    found = ordered.kept(found.groupBy(*group, "x", "d").agg(F.count(F.lit(1)).alias("n")))

    def end(tag: int, sign: str, length: str) -> str:
        x = f"CASE WHEN rule = 'length_violation' THEN CAST({length} AS {EXACT}) WHEN kind = 'exact' THEN {sign}_x END"
        return f"named_struct('tag', {tag}, 'x', {x}, 'd', CASE WHEN rule = 'range_violation' AND kind <> 'exact' THEN {sign}_d + 0.0D END)"

    # among equal values a lower bound comes first and an upper bound last
    ends = predicates.selectExpr("dataset_name", "__c", "rule", "key", f"inline(array({end(0, 'lo', 'min_length')}, {end(2, 'hi', 'max_length')}))")
    ends = ends.where("x IS NOT NULL OR d IS NOT NULL").join(found.select(*group).distinct(), ["dataset_name", "__c", "rule"])
    events = found.selectExpr(*group, "1 AS tag", "x", "d", "n", "CAST(NULL AS STRING) AS key").unionByName(ends.withColumn("n", F.lit(0).cast("bigint")))
    events = ordered.kept(events.repartitionByRange(*group, "x", "d", "tag", "key").withColumn("__part", F.spark_partition_id()))
    here = Window.partitionBy(*group, "__part").orderBy("x", "d", "tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = events.withColumn("__upto", F.sum("n").over(here)).where("key IS NOT NULL")
    every = Window.partitionBy(*group)
    earlier = every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = events.groupBy(*group, "__part").agg(F.sum("n").alias("n"))
    sums = sums.select(*group, "__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"), F.sum("n").over(every).alias("__all"))
    placed = placed.join(sums, [*group, "__part"]).withColumn("__upto", F.col("__before") + F.col("__upto"))
    return placed.groupBy("dataset_name", "slice", "key").agg(
        F.coalesce(F.max(F.expr("CASE WHEN tag = 0 THEN __upto END")), F.lit(0)).alias("low"),
        F.coalesce(F.max(F.expr("CASE WHEN tag = 2 THEN __all - __upto END")), F.lit(0)).alias("high"))


_SHORT = f"char_length(text) <= {ordered.SEGMENTS[0]}"


def _texts(cells: DataFrame) -> DataFrame:
    """The short texts of cells, counted and stored."""
    return ordered.kept(cells.where(f"known AND {_SHORT}").groupBy("dataset_name", "slice", "__c", "text").agg(F.count(F.lit(1)).alias("n")))


def _unmatched(texts: DataFrame, predicates: DataFrame) -> DataFrame:
    """(dataset, slice, key, text, n) of the counted texts that do not match a pattern."""
    return _in_parts(predicates, ["key"], lambda part: texts.join(F.broadcast(part), ["dataset_name", "__c"]).where("NOT (text RLIKE java)").select(
        "dataset_name", "slice", "key", "text", "n"))


#: A value of an ``allowed_values`` rule as the field of a cell that it is compared with; the others are null.
_WORDS = {"word": "STRING", "x": EXACT, "d": "DOUBLE", "moment": "TIMESTAMP_NTZ"}


def _listed(cells: DataFrame, predicates: DataFrame) -> DataFrame:
    """Rows whose value is not allowed: known rows less those that are found among the allowed values."""
    def word(name: str, sql: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {sql if k == name else f'CAST(NULL AS {t})'}" for k, t in _WORDS.items()) + ")"

    own = {"exact": ("in_x", "x", "v"), "double": ("in_d", "d", "v + 0.0D"), "boolean": ("in_b", "d", "v"), "moment": ("in_moment", "moment", "v"), "text": ("in_text", "word", "v")}
    words = "CASE kind " + " ".join(f"WHEN '{kind}' THEN transform(array_distinct({of}), v -> {word(name, sql)})" for kind, (of, name, sql) in own.items()) + " END"
    some = " OR ".join(f"{w} IS NOT NULL" for w in _WORDS)
    entries = ordered.kept(predicates.selectExpr("dataset_name", "__c", "key", f"inline({words})").where(some).distinct())
    place = ["dataset_name", "__c", *_WORDS]

    same = F.expr(" AND ".join([f"a.{c} = b.{c}" for c in ("dataset_name", "__c")] + [f"a.{w} <=> b.{w}" for w in _WORDS]))
    known = cells.where("known").select("slice", *place)
    wanted = entries.select(*place).distinct().withColumn("bytes", F.expr("100 + coalesce(octet_length(word), 0)"))
    hits = _in_parts(wanted, place, lambda part: known.alias("a").join(F.broadcast(part.alias("b")), same, "left_semi"))
    nothing = known.select("slice", "dataset_name", "__c", *[F.lit(None).cast(t).alias(w) for w, t in _WORDS.items()])
    counted = ordered.kept(hits.unionByName(nothing).groupBy("slice", *place).agg(F.count(F.lit(1)).alias("n")))
    found = entries.alias("a").join(counted.where(some).alias("b"), same).groupBy("a.dataset_name", "b.slice", "a.key").agg(F.sum("b.n").alias("ok"))
    all_known = predicates.select("dataset_name", "__c", "key").join(counted.where(f"NOT ({some})").select("dataset_name", "__c", "slice", "n"), ["dataset_name", "__c"])
    return all_known.join(found, ["dataset_name", "slice", "key"], "left").selectExpr(
        "dataset_name", "slice", "key", "n - coalesce(ok, 0L) AS low", "0L AS high")


def _duplicates(sliced: Mapping[str, tuple], wanted: Sequence[tuple[str, list[str], str]], k: int) -> DataFrame | None:
    """(dataset, slice, key) with duplicate counts and samples; hashes of all keys of all datasets are counted together."""
    unique = [UniqueKey(j, sliced[name][0], tuple(sliced[name][1].keys), tuple(cols)) for j, (name, cols, _) in enumerate(wanted)]
    out = None
    for j, table in duplicates(unique, k).items():
        name, _, key = wanted[j]
        labelled = table.select(F.lit(name).alias("dataset_name"), sliced[name][1].label().alias("slice"), F.lit(key).alias("key"),
                                "dup_keys", "dup_rows", "dup_sample")
        out = labelled if out is None else out.unionByName(labelled)
    return out


def _json(**fields: str) -> str:
    return f"to_json(named_struct({', '.join(f'{lit(k)}, {v}' for k, v in fields.items())}), {_NO_NULL_DROP})"


def _number_json(exact: str, double: str) -> str:
    """A number in JSON: integers and decimals with the places of their column, doubles as Spark writes them."""
    cut = f"CAST({exact} AS STRING)"
    whole = f"left({cut}, length({cut}) - CASE WHEN places = 0 THEN 19 ELSE 18 - places END)"
    return f"coalesce(CASE WHEN kind = 'exact' THEN {whole} ELSE CAST({double} AS STRING) END, 'null')"


def _bound_json(text: str) -> str:
    """A range's bound in JSON: exact beside exact values if it is written out, else a double."""
    plain = f"regexp_replace({text}, '^[+]', '')"
    for pattern, by in (("^(-?)0*([0-9])", "$1$2"), ("([.][0-9]*?)0+$", "$1"), ("[.]$", ""), ("^(-?)[.]", "$10.")):
        plain = f"regexp_replace({plain}, {lit(pattern)}, {lit(by)})"
    return (f"coalesce(CASE WHEN kind = 'exact' AND NOT {text} RLIKE '[eE]' AND length({text}) <= 38 THEN {plain} "
            f"ELSE CAST(CAST({text} AS DOUBLE) AS STRING) END, 'null')")


def _reports(ref: _dt.date, k: int) -> list[tuple[str, str, str, str]]:
    """(rule, status, condition, evidence) of the findings that data decide, as SQL over a rule joined to its tables."""
    observed = values.observed_type_expr("known", *[f"n_{c}" for c in "bifdt"])
    observed = f"(CASE WHEN native IS NOT NULL THEN CASE WHEN known = 0 THEN '{values.EMPTY}' ELSE native END ELSE {observed} END)"
    fits = " OR ".join(f"expected_type = {lit(t)} AND {observed} IN ({lits(list(ok))})" for t, ok in COMPATIBLE_TYPES.items() if ok)
    nulls = "(rows - known)"
    day = f"DATE {lit(ref.isoformat())}"
    age = f"datediff({day}, to_date(latest))"
    fresh = _json(latest_value=values.iso_text("latest"), reference_date=lit(ref.isoformat()), max_age_days="max_age_days", observed_age_days=age)
    repeated = (f"coalesce(slice(flatten(transform(samples, e -> array_repeat(e.value, CAST(least(e.n, {k}) AS INT)))), 1, {k}), "
                "CAST(array() AS ARRAY<STRING>))")
    head = _json(rule_name="rule_name", checked_columns="columns", duplicate_key_count="dup_keys", duplicate_row_count="dup_rows")
    return [
        ("type_mismatch", "failed", f"{observed} <> '{values.EMPTY}' AND NOT ({fits})", _json(expected_type="expected_type", observed_type=observed)),
        ("nullability_violation", "failed", f"{nulls} > 0",
         _json(null_count=nulls, row_count="rows", null_percentage=f"CASE WHEN rows > 0 THEN bround({nulls} * 100.0D / rows, 2) ELSE 0.0D END")),
        ("uniqueness_violation", "failed", "dup_keys > 0",
         f"concat(regexp_replace({head}, '\\\\}}$', ''), ',\"sample_duplicate_keys\":', coalesce(dup_sample, '[]'), '}}')"),
        ("allowed_values_violation", "failed", "low > 0",
         _json(allowed_values="transform(allowed_values, a -> a.value)", unexpected_values="map_from_entries(transform(samples, e -> struct(e.value, e.n)))",
               failed_row_count="low")),
        ("range_violation", "failed", "low > 0 OR high > 0",
         f"concat('{{\"min_allowed\":', {_bound_json('min_text')}, ',\"max_allowed\":', {_bound_json('max_text')}, ',\"observed_min\":', "
         f"{_number_json('x_min', 'd_min')}, ',\"observed_max\":', {_number_json('x_max', 'd_max')}, ',\"below_min_count\":', CAST(coalesce(low, 0L) AS STRING), "
         f"',\"above_max_count\":', CAST(coalesce(high, 0L) AS STRING), '}}')"),
        ("pattern_violation", "warning", "low > 0", _json(pattern="pattern", failed_row_count="low", sample_failed_values=repeated)),
        ("length_violation", "failed", "low > 0 OR high > 0",
         _json(min_length="min_length", max_length="max_length", observed_min_length="len_min", observed_max_length="len_max",
               too_short_count="coalesce(low, 0L)", too_long_count="coalesce(high, 0L)")),
        ("freshness_violation", "skipped", "latest IS NULL", fresh),
        ("freshness_violation", "warning", f"latest IS NOT NULL AND {age} > max_age_days", fresh),
        ("row_count_violation", "warning", "coalesce(rows < min_rows, false) OR coalesce(rows > max_rows, false)",
         _json(row_count="rows", min_allowed="min_rows", max_allowed="max_rows")),
    ]


def _told(rule: str, status: str, observed: str = "observed") -> tuple[str, str]:
    """SQL text of a finding's message and suggested action."""
    marks = {"uniqueness_violation": {"name": "rule_name"}, "type_mismatch": {"observed": observed, "expected": "expected_type", "column": "`column`"}}
    out = []
    for template in MESSAGES[rule, status]:
        text = lit(template)
        for mark, value in marks.get(rule, {"column": "`column`"}).items():
            if f"{{{mark}}}" in template:
                text = f"replace({text}, {lit(f'{{{mark}}}')}, {value})"
        out.append(text)
    return out[0], out[1]


def _finding(rows: DataFrame, rule: str, status: str, evidence: str, columns: str = "columns") -> DataFrame:
    """FINDINGS_SCHEMA of rows of one rule and status; their ``columns`` may be given by another SQL text."""
    rows = rows.withColumn("columns", F.expr(columns))
    one = "CASE WHEN size(columns) = 1 THEN columns[0] END" if rule != "row_count_violation" else "CAST(NULL AS STRING)"
    message, action = _told(rule, status, "get_json_object(evidence, '$.observed_type')")
    rows = rows.withColumn("column", F.expr(one)).withColumn("evidence", F.expr(evidence))
    rows = rows.selectExpr("run_id", "contract_name", "dataset_name", "slice", "seq",
                           f"concat({lit(rule)}, ':', CASE WHEN size(columns) = 0 THEN 'dataset' ELSE array_join(columns, '_') END) AS finding_id",
                           f"{lit(rule)} AS rule_type", "`column`", "columns", "severity", f"{lit(status)} AS status", f"{message} AS message", "evidence",
                           f"{action} AS suggested_action", "step", "copies")
    rows = rows.select("*", F.explode(F.expr("sequence(0, copies - 1)")).alias("__copy"))
    return rows.withColumn("seq", F.expr("seq + __copy * step")).drop("step", "copies", "__copy")


def _static(bound: DataFrame) -> DataFrame:
    """Findings that schema and rules decide: missing and unexpected columns, skipped rules."""
    rows = bound.withColumn("slice", F.lit(""))
    absent = "filter(columns, c -> NOT array_contains(dataset_columns, c))"
    missing = _finding(rows.where("rule_type = 'missing_required_column' AND __c IS NULL"), "missing_required_column", "failed",
                       _json(expected_column="columns[0]", available_columns="dataset_columns"))
    spread = rows.where("rule_type = 'unexpected_column'").select("*", F.posexplode("extra").alias("__at", "__extra")).withColumn("seq", F.col("seq") + F.col("__at"))
    unexpected = _finding(spread, "unexpected_column", "warning", _json(unexpected_column="`column`", declared_columns="declared_columns"), "array(__extra)")
    unchecked = _finding(rows.where(f"rule_type = 'uniqueness_violation' AND size({absent}) > 0"), "uniqueness_violation", "skipped",
                         _json(rule_name="rule_name", checked_columns="columns", missing_columns=absent))
    invalid = _finding(rows.where("rule_type = 'pattern_violation' AND __c IS NOT NULL AND error IS NOT NULL"), "pattern_violation", "skipped",
                       _json(pattern="pattern", error="error"))
    return missing.unionByName(unexpected).unionByName(unchecked).unionByName(invalid)


def _samples(tables: Mapping[str, DataFrame], sliced: Mapping[str, tuple[DataFrame, Slices]], failing: DataFrame, spelled: DataFrame | None, k: int) -> DataFrame | None:
    """(dataset, slice, key) with the first ``k`` failing values: of patterns by value, of allowed values the most frequent."""
    again: dict[str, dict[str, dict[str, set[str]]]] = {}
    for r in failing.select("dataset_name", "__c", "rule", "way").distinct().collect():  # of the size of the schemas
        again.setdefault(r["way"], {}).setdefault(r["dataset_name"], {}).setdefault(tables[r["dataset_name"]].columns[r["__c"]], set()).add(r["rule"])
    by = ["dataset_name", "slice", "key"]
    found = []
    rows = []
    for way in set(again) - {"listed"}:
        own = failing.where(F.col("way") == way)
        for cells in _cells(sliced, again[way]):
            if way == "spelled":
                w = Window.partitionBy("key", "slice").orderBy("text")
                first = _unmatched(spelled, own).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k + 1)
                rows.append(ordered.kept(first.select(*by, F.col("text").alias("value"), "n")))
                cells = cells.where(f"NOT {_SHORT}")
            rows.append(_checked(cells, own, [*by, "text AS value", "1L AS n", f"{_LOW} AS low"]).where("low").drop("low"))
    if rows:
        top, _ = ordered.first_keys(_together(rows), by, [("value", True)], {"sample": k}, weight="n")
        found.append(top.select(*by, F.col("__rn").alias("rn"), "value", F.col("__n").alias("n")))
    if "listed" in again:
        own = failing.where("way = 'listed'").withColumn("listed", F.expr("greatest(0, size(in_x), size(in_d), size(in_b), size(in_text), size(in_moment))"))
        most = k + own.agg(F.max("listed")).first()[0]
        raw = _together([cells.where("known").selectExpr("dataset_name", "slice", "__c", "shown", "x", "d", "moment") for cells in _cells(sliced, again["listed"])])
        # at most ``listed`` of a column's most frequent values are allowed
        parts = [("shown", True), ("x", False), ("d", False), ("moment", False)]
        top, _ = ordered.first_keys(raw, ["dataset_name", "slice", "__c"], parts, {"value": most}, lead="-__n")
        top = ordered.kept(top.selectExpr("dataset_name", "slice", "__c", "shown", "x", "d", "moment", "__n AS n", "__rn AS __at"))
        tested = top.selectExpr("*", "true AS known", "CAST(NULL AS STRING) AS text", "CAST(NULL AS DOUBLE) AS num")
        bad = _in_parts(own, ["key"], lambda part: tested.join(F.broadcast(part), ["dataset_name", "__c"]).where(f"__at <= {k} + listed").where(_LOW))
        w = Window.partitionBy(*by).orderBy("__at")
        found.append(bad.select(*by, F.row_number().over(w).alias("rn"), F.col("shown").alias("value"), "n").where(F.col("rn") <= k))
    if not found:
        return None
    return _together(found).groupBy(*by).agg(F.expr("array_sort(collect_list(struct(rn, value, n)))").alias("samples"))


def validate_many(tables: Mapping[str, DataFrame], rules: DataFrame, bindings: DataFrame, *,
                  by: Mapping[str, Sequence[str] | Mapping[str, Column]] | None = None, reference_date: _dt.date | None = None,
                  max_examples: int = 20) -> Validation:
    """Validate ``tables`` (by dataset name) against every contract that ``bindings`` (run_id, contract_name, dataset_name) names for them.

    ``rules`` is the table of ``contract_rules`` for any number of contracts; ``by`` gives the slices of those datasets that
    have some.  The aggregates run now; findings and runs read their stored results.
    """
    spark = rules.sparkSession
    ref = reference_date or _dt.date.today()
    bound = _bound(tables, rules, bindings)
    # a row for each (dataset, column, kind of rule) and for each distinct unique key: of the size of the schemas
    needed: dict[str, dict[str, set[str]]] = {}
    for r in bound.where("__c IS NOT NULL AND rule_type NOT IN ('uniqueness_violation', 'missing_required_column')").select("dataset_name", "__name", "rule_type").distinct().collect():
        needed.setdefault(r["dataset_name"], {}).setdefault(r["__name"], set()).add(r["rule_type"])
    unique = bound.where("rule_type = 'uniqueness_violation' AND size(filter(columns, c -> NOT array_contains(dataset_columns, c))) = 0")
    wanted = [(r["dataset_name"], list(r["columns"]), r["key"]) for r in unique.select("dataset_name", "columns", "key").distinct().collect()]

    sliced = {name: with_slices(df, (by or {}).get(name)) for name, df in tables.items()}
    whole = {name: slices.whole for name, (_, slices) in sliced.items()}
    measured = {n: {c: kinds for c, kinds in needed.get(n, {}).items() if kinds - {"allowed_values_violation", "pattern_violation"}} for n in tables}
    predicates = _predicates(bound)
    same = predicates.groupBy("dataset_name", "__c", "rule").agg(F.count(F.lit(1)).alias("same"))
    predicates = ordered.kept(predicates.join(same, ["dataset_name", "__c", "rule"]).withColumn("way", F.expr(_WAY)).drop("same"))
    # by way, dataset and column: its rules
    ways: dict[str, dict[str, dict[str, set[str]]]] = {}
    for r in predicates.select("dataset_name", "__c", "rule", "way").distinct().collect():  # of the size of the schemas
        ways.setdefault(r["way"], {}).setdefault(r["dataset_name"], {}).setdefault(tables[r["dataset_name"]].columns[r["__c"]], set()).add(r["rule"])
    columns = ["dataset_name", "slice", "key", "rule"]
    stored = _together([_metrics(cells) for cells in _cells(sliced, measured)]).withColumns({"key": F.lit(None).cast("string"), **{c: F.lit(None).cast("bigint") for c in ("low", "high")}})
    spelled = None
    for way, tested in ways.items():
        own = predicates.where(F.col("way") == way)
        for cells in _cells(sliced, tested):
            if way == "ranked":
                stored = stored.unionByName(_ranked(cells, own), allowMissingColumns=True)
            elif way == "listed":
                stored = stored.unionByName(_listed(cells, own), allowMissingColumns=True)
            elif way == "spelled":
                spelled = _texts(cells)
                some = _unmatched(spelled, own).groupBy("dataset_name", "slice", "key").agg(F.sum("n").alias("low"))
                long = _failing(_checked(cells.where(f"NOT {_SHORT}"), own, [*columns, f"{_LOW} AS low", "false AS high"]))
                both = some.withColumn("high", F.lit(0).cast("bigint")).unionByName(long).groupBy("dataset_name", "slice", "key").agg(
                    F.sum("low").alias("low"), F.sum("high").alias("high"))
                stored = stored.unionByName(both, allowMissingColumns=True)
            else:
                stored = stored.unionByName(_failing(_checked(cells, own, [*columns, f"{_LOW} AS low", f"{_HIGH} AS high"])), allowMissingColumns=True)
    stored = ordered.kept(stored)  # one job for all aggregates
    metrics, counts = stored.where("key IS NULL").drop("key", "low", "high"), stored.where("key IS NOT NULL").select("dataset_name", "slice", "key", "low", "high")

    failing = predicates.where("rule IN ('allowed_values_violation', 'pattern_violation')").join(
        counts.where("low > 0").select("key").distinct(), "key", "left_semi")
    samples = _samples(tables, sliced, failing, spelled, max_examples)
    duplicates = _duplicates(sliced, wanted, max_examples)

    # every (dataset, slice): what has rows, and unsliced datasets without any
    seeds = spark.createDataFrame([(n,) for n, w in whole.items() if w], "dataset_name string").withColumn("slice", F.lit(""))
    slices = metrics.select("dataset_name", "slice", "rows").unionByName(seeds.withColumn("rows", F.lit(0).cast("bigint")))
    slices = slices.groupBy("dataset_name", "slice").agg(F.max("rows").alias("rows"))
    per_column = metrics.drop("rows").withColumn("__at", F.col("__c")).drop("__c")
    data_rules = bound.where("(__c IS NOT NULL AND error IS NULL) OR rule_type IN ('uniqueness_violation', 'row_count_violation')")
    joined = data_rules.withColumn("__at", F.coalesce("__c", F.lit(ROW))).join(slices, "dataset_name")
    joined = joined.join(per_column, ["dataset_name", "slice", "__at"], "left").join(counts, ["dataset_name", "slice", "key"], "left")
    for side, empty in ((samples, "samples array<struct<rn:int,value:string,n:bigint>>"), (duplicates, "dup_keys bigint, dup_rows bigint, dup_sample string")):
        side = side if side is not None else spark.createDataFrame([], f"dataset_name string, slice string, key string, {empty}")
        joined = joined.join(side, ["dataset_name", "slice", "key"], "left")
    zero = ["known", "n_b", "n_i", "n_f", "n_d", "n_t"]
    reports = _reports(ref, max_examples)
    joined = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in zero})
    # what gives a finding; each report reads all of it
    reported = " OR ".join(f"rule_type = {lit(rule)} AND ({condition})" for rule, _, condition, _ in reports)
    joined = ordered.kept(joined.where(reported).drop("params", "dataset_columns", "declared_columns", "extra"))
    findings = _static(bound)
    for rule, status, condition, evidence in reports:
        findings = findings.unionByName(_finding(joined.where(f"rule_type = {lit(rule)} AND ({condition})"), rule, status, evidence))
    findings = findings.select([f.name for f in T.StructType.fromDDL(FINDINGS_SCHEMA)])

    sizes = spark.createDataFrame([(n, len(df.columns), whole[n]) for n, df in tables.items()], "dataset_name string, column_count int, whole boolean")
    totals = slices.groupBy("dataset_name").agg(F.sum("rows").alias("rows")).join(F.broadcast(sizes.where("NOT whole").select("dataset_name")), "dataset_name")
    keyed = slices.unionByName(totals.withColumn("slice", F.lit("")))
    empty = sizes.where("NOT whole").join(F.broadcast(totals.select("dataset_name")), "dataset_name", "left_anti")  # sliced, without rows
    keyed = keyed.unionByName(empty.select("dataset_name", F.lit("").alias("slice"), F.lit(0).cast("bigint").alias("rows")))
    pairs = bindings.select("run_id", "contract_name", "dataset_name").distinct()
    runs = pairs.join(keyed, "dataset_name").join(F.broadcast(sizes), "dataset_name")
    runs = runs.select("run_id", "contract_name", "dataset_name", "slice", F.col("rows").alias("row_count"), "column_count")
    return Validation(findings=findings, runs=runs.select([f.name for f in T.StructType.fromDDL(RUNS_SCHEMA)]), metrics=metrics)
