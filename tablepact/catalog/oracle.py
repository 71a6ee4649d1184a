"""Independent DuckDB SQL for every registered query (same column names).

Each statement recomputes its answer from the tables; literals are only
contract parameters and the fixed finding vocabulary.
"""

from __future__ import annotations

# Message and suggested action of a finding, written out here anew so that a
# wrong text in the engine shows.
TEXTS = {
    ("missing_required_column", "failed"): ("Required column '{column}' is missing from the dataset.",
                                            "Add column '{column}' to the dataset or mark it as not required."),
    ("unexpected_column", "warning"): ("Column '{column}' is not declared in the contract.",
                                       "Declare the column in the contract or allow unexpected columns."),
    ("type_mismatch", "failed"): ("Column '{column}' has observed type '{observed}', expected '{expected}'.",
                                  "Align the dataset values with the expected type or update the contract type."),
    ("nullability_violation", "failed"): ("Column '{column}' is non-nullable but contains null values.",
                                          "Backfill null values or mark the column as nullable."),
    ("uniqueness_violation", "skipped"): ("Uniqueness check '{name}' skipped because required columns are missing.",
                                          "Ensure all uniqueness rule columns are present in the dataset."),
    ("uniqueness_violation", "failed"): ("Uniqueness rule '{name}' failed with duplicate keys.",
                                         "Deduplicate rows or update uniqueness expectations."),
    ("allowed_values_violation", "failed"): ("Column '{column}' contains values outside the allowed set.",
                                             "Update the data values or expand allowed_values in the contract."),
    ("range_violation", "failed"): ("Column '{column}' violates numeric range constraints.",
                                    "Clamp, clean, or correct out-of-range values in the dataset."),
    ("pattern_violation", "skipped"): ("Pattern check skipped for column '{column}' because regex is invalid.",
                                       "Fix the contract regex pattern."),
    ("pattern_violation", "warning"): ("Column '{column}' contains values that do not match the required pattern.",
                                       "Correct source values or adjust the contract regex."),
    ("length_violation", "failed"): ("Column '{column}' violates string length constraints.",
                                     "Trim, pad, or validate values to meet length constraints."),
    ("freshness_violation", "skipped"): ("Freshness check skipped for column '{column}' because no parseable datetime values were found.",
                                         "Provide parseable date/datetime values for freshness checks."),
    ("freshness_violation", "warning"): ("Column '{column}' is older than the allowed freshness window.",
                                         "Refresh the dataset with newer records."),
    ("row_count_violation", "warning"): ("Dataset row count is outside configured bounds.",
                                         "Adjust extraction volume or update row_count bounds in the contract."),
}

# Schemas of the test tables, as DuckDB sees them.
SCHEMAS = {
    "customer": [("c_custkey", "BIGINT"), ("c_name", "VARCHAR"), ("c_nationkey", "INTEGER"),
                 ("c_acctbal", "DOUBLE"), ("c_mktsegment", "VARCHAR")],
}
SPARK_TYPE = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string"}
NATIVE_OBSERVED = {"BIGINT": "integer", "INTEGER": "integer", "DOUBLE": "number"}

INT_RE = "[+-]?[0-9]+"
NUM_RE = "[+-]?(([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)"
ISO_RE = "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]{1,9})?)?)?"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def iso(x: str) -> str:
    return (f"CASE WHEN {x} IS NOT NULL THEN strftime({x}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({x}) % 1000000 <> 0 "
            f"THEN '.' || lpad(CAST(microsecond({x}) % 1000000 AS VARCHAR), 6, '0') ELSE '' END END")


def ladder(v: str) -> str:
    """Observed-type expression over text column ``v`` (aggregate context)."""
    clock = f"regexp_replace(trim({v}), '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$', '')"  # a zoned time's own clock
    ts = f"CASE WHEN regexp_full_match({clock}, '{ISO_RE}') THEN try_cast({clock} AS TIMESTAMP) END"
    return f"""CASE WHEN count({v}) = 0 THEN 'empty'
      WHEN count(*) FILTER (lower(trim({v})) IN ('true', 'false')) = count({v}) THEN 'boolean'
      WHEN count(*) FILTER (regexp_full_match(trim({v}), '{INT_RE}')) = count({v}) THEN 'integer'
      WHEN count(*) FILTER (regexp_full_match(trim({v}), '{NUM_RE}')) = count({v}) THEN 'number'
      WHEN count({ts}) = count({v}) THEN
        CASE WHEN count(*) FILTER ({ts} <> CAST(CAST({ts} AS DATE) AS TIMESTAMP)) > 0 THEN 'datetime' ELSE 'date' END
      ELSE 'string' END"""


ZONED = "CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 10 HOUR ELSE o_orderdate - INTERVAL 1800 SECOND + INTERVAL 500 MILLISECOND END"


def native(c: str) -> str:
    """Observed type of a natively typed column (aggregate context)."""
    t = f"any_value(typeof({c}))"
    return f"""(CASE WHEN count({c}) = 0 THEN 'empty'
      WHEN {t} IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT') THEN 'integer'
      WHEN {t} IN ('FLOAT', 'DOUBLE') OR {t} LIKE 'DECIMAL%' THEN 'number'
      WHEN {t} = 'BOOLEAN' THEN 'boolean' WHEN {t} = 'DATE' THEN 'date'
      WHEN {t} LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'string' END)"""


def msg(rule: str, status: str, **kw) -> tuple[str, str]:
    m, a = TEXTS[(rule, status)]
    return q(m.format(**kw)), q(a.format(**kw))


TEXT_ORDERS = """(SELECT CAST(o_orderkey AS VARCHAR) int_txt, CAST(o_totalprice AS VARCHAR) num_txt,
  CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'false' END bool_txt,
  strftime(o_orderdate, '%Y-%m-%d') date_txt, strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00' dt_txt,
  o_orderpriority str_txt, CAST(NULL AS VARCHAR) empty_txt,
  CASE WHEN o_orderkey % 2 = 0 THEN '12' ELSE 'abc' END mixed_txt,
  strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN 'T10:00:00Z' ELSE 'T00:30:00.5+01:00' END zoned_txt FROM orders)"""
TEXT_COLS = ["int_txt", "num_txt", "bool_txt", "date_txt", "dt_txt", "str_txt", "empty_txt", "mixed_txt", "zoned_txt"]
DIRTY = """(SELECT c_custkey, c_name, c_nationkey, c_acctbal,
  CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer)"""


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _nulls() -> str:
    parts = []
    for c, _ in SCHEMAS["customer"]:
        parts.append(f"""SELECT {q(c)} AS "column", count(*) AS row_count, count(*) - count({c}) AS null_count,
          count({c}) AS non_null_count,
          CASE WHEN count(*) > 0 THEN round_even(100.0 * (count(*) - count({c})) / count(*), 2) ELSE 0.0 END
            AS null_percentage FROM {DIRTY}""")
    return _union(parts)


def _observed() -> str:
    return _union([f'SELECT {q(c)} AS "column", {ladder(c)} AS observed_type FROM {TEXT_ORDERS}' for c in TEXT_COLS])


def _part_freq() -> str:
    return """WITH long AS (SELECT 'p_brand' AS "column", p_brand AS value FROM part
      UNION ALL SELECT 'p_type', p_type FROM part
      UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part),
    freq AS (SELECT "column", value, count(*) AS cnt FROM long WHERE value IS NOT NULL GROUP BY 1, 2)"""


def _full(table: str) -> str:
    parts = []
    for pos, (c, t) in enumerate(SCHEMAS[table]):
        v = f"CAST({c} AS VARCHAR)"
        observed = q(NATIVE_OBSERVED[t]) if t in NATIVE_OBSERVED else f"({ladder(c)})"
        numeric = f"CAST(min({c}) AS DOUBLE)" if t in NATIVE_OBSERVED else "CAST(NULL AS DOUBLE)"
        numeric_max = f"CAST(max({c}) AS DOUBLE)" if t in NATIVE_OBSERVED else "CAST(NULL AS DOUBLE)"
        smin = f"CASE WHEN {observed} = 'string' THEN CAST(min(length({c})) AS INTEGER) END" if t == "VARCHAR" else "CAST(NULL AS INTEGER)"
        smax = f"CASE WHEN {observed} = 'string' THEN CAST(max(length({c})) AS INTEGER) END" if t == "VARCHAR" else "CAST(NULL AS INTEGER)"
        parts.append(f"""SELECT {q(c)} AS "column", {pos} AS position, {q(SPARK_TYPE[t])} AS physical_type,
          {observed} AS observed_type, count(*) AS row_count, count(*) - count({c}) AS null_count,
          CASE WHEN count(*) > 0 THEN round_even(100.0 * (count(*) - count({c})) / count(*), 2) ELSE 0.0 END AS null_percentage,
          count({c}) AS non_null_count, count(DISTINCT {c}) AS distinct_count,
          {numeric} AS numeric_min, {numeric_max} AS numeric_max,
          CAST(NULL AS VARCHAR) AS datetime_min, CAST(NULL AS VARCHAR) AS datetime_max,
          {smin} AS string_min_length, {smax} AS string_max_length,
          (SELECT string_agg(value || ':' || cnt, '|' ORDER BY cnt DESC, value) FROM
            (SELECT {v} AS value, count(*) AS cnt FROM {table} WHERE {c} IS NOT NULL GROUP BY 1
             ORDER BY cnt DESC, value LIMIT 5)) AS top_values,
          (SELECT string_agg(value, '|' ORDER BY value) FROM
            (SELECT DISTINCT {v} AS value FROM {table} WHERE {c} IS NOT NULL ORDER BY value LIMIT 5)) AS sample_values
        FROM {table}""")
    return _union(parts)


def _summary(table: str) -> str:
    return f"""SELECT "column", observed_type, null_count, distinct_count FROM ({_full(table)})"""


def _head(dataset: str, rule: str, cols: str, severity: str, status: str) -> str:
    return (f"{q(dataset)} AS dataset_name, {q(rule + ':' + cols)} AS finding_id, {q(rule)} AS rule_type, "
            f"{q(severity)} AS severity, {q(status)} AS status")


def _type_mismatch() -> str:
    orders_native = {"o_orderdate": ("date", native("o_orderdate")), "o_totalprice": ("number", native("o_totalprice")),
                     "o_orderkey": ("number", native("o_orderkey")),
                     "o_orderstatus": ("integer", f"({ladder('o_orderstatus')})")}
    compat = {"date": ("date",), "datetime": ("datetime", "date"), "number": ("integer", "number"),
              "integer": ("integer",), "string": ("string",), "boolean": ("boolean",)}
    parts = []
    for c, (expected, observed) in orders_native.items():
        ok = ", ".join(q(x) for x in compat[expected])
        parts.append(f"""SELECT * FROM (SELECT {_head('orders', 'type_mismatch', c, 'error', 'failed')},
          {q(expected)} AS expected_type, {observed} AS observed_type FROM orders)
          WHERE observed_type <> 'empty' AND observed_type NOT IN ({ok})""")
    text_expected = {"int_txt": "integer", "num_txt": "integer", "bool_txt": "boolean", "date_txt": "datetime",
                     "dt_txt": "date", "str_txt": "string", "empty_txt": "integer", "mixed_txt": "integer",
                     "zoned_txt": "date"}
    for c, expected in text_expected.items():
        ok = ", ".join(q(x) for x in compat[expected])
        parts.append(f"""SELECT * FROM (SELECT {_head('text_orders', 'type_mismatch', c, 'error', 'failed')},
          {q(expected)} AS expected_type, {ladder(c)} AS observed_type FROM {TEXT_ORDERS})
          WHERE observed_type <> 'empty' AND observed_type NOT IN ({ok})""")
    return _union(parts)


# customer by a segment that is null, the text null, or holds the label's own marks.
SEGMENTS_CTE = """(SELECT CASE WHEN k = 0 THEN 'seg=\\N' WHEN k = 1 THEN 'seg=null' WHEN k = 2 THEN 'seg=a\\|b\\=c' ELSE 'seg=' || c_mktsegment END AS label,
    count(*) AS n, count(*) FILTER (c_acctbal < 0) AS lo
  FROM (SELECT *, c_custkey % 10 AS k FROM customer) GROUP BY 1)"""
SEGMENTS = ["AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY"]


def _allowed(dataset: str, table: str, col: str, allowed: list[str]) -> str:
    lst = ", ".join(q(a) for a in allowed)
    return f"""SELECT {_head(dataset, 'allowed_values_violation', col, 'error', 'failed')},
      (SELECT count(*) FROM {table} WHERE {col} IS NOT NULL AND {col} NOT IN ({lst})) AS failed_row_count,
      (SELECT '{{' || string_agg('"' || v || '":' || n, ',' ORDER BY n DESC, v) || '}}' FROM
        (SELECT {col} AS v, count(*) AS n FROM {table} WHERE {col} IS NOT NULL AND {col} NOT IN ({lst})
         GROUP BY 1 ORDER BY n DESC, v LIMIT 20)) AS unexpected_values
    WHERE (SELECT count(*) FROM {table} WHERE {col} IS NOT NULL AND {col} NOT IN ({lst})) > 0"""


def _range(dataset: str, col: str, lo: float | None, hi: float | None) -> str:
    below = f"count(*) FILTER ({col} < {lo})" if lo is not None else "0"
    above = f"count(*) FILTER ({col} > {hi})" if hi is not None else "0"
    return f"""SELECT * FROM (SELECT {_head(dataset, 'range_violation', col, 'error', 'failed')},
      CAST({below} AS BIGINT) AS below_min_count, CAST({above} AS BIGINT) AS above_max_count,
      CAST(min({col}) AS DOUBLE) AS observed_min, CAST(max({col}) AS DOUBLE) AS observed_max FROM {dataset})
      WHERE below_min_count > 0 OR above_max_count > 0"""


def _pattern(dataset: str, col: str, pattern: str) -> str:
    bad = f"{col} IS NOT NULL AND NOT regexp_full_match({col}, {q(pattern)})"
    return f"""SELECT * FROM (SELECT {_head(dataset, 'pattern_violation', col, 'warning', 'warning')},
      (SELECT count(*) FROM {dataset} WHERE {bad}) AS failed_row_count,
      (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT {col} AS v FROM {dataset} WHERE {bad} ORDER BY v LIMIT 20))
        AS sample_failed_values) WHERE failed_row_count > 0"""


def _length(dataset: str, col: str, lo: int, hi: int) -> str:
    return f"""SELECT * FROM (SELECT {_head(dataset, 'length_violation', col, 'error', 'failed')},
      count(*) FILTER (length({col}) < {lo}) AS too_short_count, count(*) FILTER (length({col}) > {hi}) AS too_long_count,
      CAST(min(length({col})) AS BIGINT) AS observed_min_length, CAST(max(length({col})) AS BIGINT) AS observed_max_length
      FROM {dataset}) WHERE too_short_count > 0 OR too_long_count > 0"""


def _unique(dataset: str, cols: list[str], extra_samples: bool = False) -> str:
    keys = ", ".join(cols)
    sample = ""
    if extra_samples:
        obj = " || ',' || ".join(f"'\"{c}\":' || {c}" for c in cols)
        sample = f""", (SELECT '[' || string_agg('{{' || {obj} || '}}', ',' ORDER BY {keys}) || ']' FROM
          (SELECT {keys} FROM {dataset} GROUP BY {keys} HAVING count(*) > 1 ORDER BY {keys} LIMIT 20))
          AS sample_duplicate_keys"""
    return f"""SELECT * FROM (SELECT {_head(dataset, 'uniqueness_violation', '_'.join(cols), 'error', 'failed')},
      count(*) AS duplicate_key_count, CAST(sum(n) AS BIGINT) AS duplicate_row_count {sample}
      FROM (SELECT {keys}, count(*) AS n FROM {dataset} GROUP BY {keys} HAVING count(*) > 1))
      WHERE duplicate_key_count > 0"""


def _freshness(dataset: str, table: str, col: str, ref: str, max_age: int, ts: str | None = None) -> str:
    t = ts or col
    return f"""SELECT * FROM (SELECT {_head(dataset, 'freshness_violation', col, 'warning', 'warning')},
      {iso(f'max({t})')} AS latest_value, {q(ref)} AS reference_date,
      CAST(date_diff('day', CAST(max({t}) AS DATE), DATE {q(ref)}) AS BIGINT) AS observed_age_days FROM {table})
      WHERE latest_value IS NOT NULL AND observed_age_days > {max_age}"""


BIG = """(SELECT o_orderkey + 9007199254740992 AS big, CAST(o_orderdate AS DATE) AS day, o_orderdate AS moment,
  CASE WHEN o_orderkey % 1000 IN (1, 2) THEN NULL ELSE o_orderkey END AS part_nan FROM orders)"""


def _all(dataset: str, rule: str, cols: str, severity: str, status: str, evidence: str, src: str, **fmt) -> str:
    """One whole finding with its evidence as JSON text."""
    m, a = msg(rule, status, column=cols, **fmt)
    return f"SELECT {_head(dataset, rule, cols or 'dataset', severity, status)}, {m} AS message, {evidence} AS evidence, {a} AS suggested_action FROM {src}"


def _names(table: str) -> str:
    return f"(SELECT '[' || string_agg('\"' || name || '\"', ',' ORDER BY cid) || ']' FROM pragma_table_info('{table}'))"


def _text_lists(col: str, value: str | None = None) -> str:
    """Top values, samples and the distinct count of a text column, texts by their md5."""
    freq = f"(SELECT {value or col} AS v, count(*) AS n FROM documents WHERE {col} IS NOT NULL GROUP BY 1)"
    return _union([
        f"""SELECT {q(col)} AS "column", 'top' AS list, CAST(row_number() OVER (ORDER BY n DESC, v) - 1 AS INTEGER) AS pos, md5(v) AS value_md5, n AS count
            FROM (SELECT * FROM {freq} ORDER BY n DESC, v LIMIT 5)""",
        f"""SELECT {q(col)}, 'sample', CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER), md5(v), NULL FROM (SELECT * FROM {freq} ORDER BY v LIMIT 5)""",
        f"SELECT {q(col)}, 'distinct', 0, NULL, count(*) FROM {freq}"])


def _many() -> str:
    """Findings of one contract a supplier over customer and supplier."""
    tables = """accounts AS (SELECT 'customer' AS ds, c_acctbal AS balance, c_nationkey AS nation, c_name AS name FROM customer
      UNION ALL SELECT 'supplier', s_acctbal, s_nationkey, s_name FROM supplier),
    dups AS (SELECT ds, count(*) AS keys, sum(n) AS rows FROM (SELECT ds, name, count(*) AS n FROM accounts GROUP BY 1, 2 HAVING n > 1) GROUP BY 1),
    counts AS (SELECT s_name, s_nationkey, s_suppkey, ds, count(*) AS n, count(*) FILTER (balance < s_acctbal) AS lo, count(*) FILTER (balance > s_acctbal + 5000) AS hi,
      count(*) FILTER (nation NOT IN (s_nationkey, (s_nationkey + 7) % 25)) AS av, count(*) FILTER (length(name) > 18) AS long,
      count(*) FILTER (NOT regexp_full_match(name, '[A-Z][a-z]+#[0-9]*' || CAST(s_suppkey % 10 AS VARCHAR))) AS pat
      FROM supplier, accounts GROUP BY 1, 2, 3, 4)"""

    def rows(finding: str, severity: str, status: str, low: str, high: str, src: str) -> str:
        return (f"SELECT 'r_many' AS run_id, s_name AS contract_name, ds AS dataset_name, '' AS slice, {q(finding)} AS finding_id, {severity} AS severity, "
                f"{q(status)} AS status, CAST({low} AS BIGINT) AS low, CAST({high} AS BIGINT) AS high FROM {src}")

    return f"WITH {tables} " + _union([
        rows("range_violation:balance", "CASE WHEN s_nationkey % 3 = 0 THEN 'info' ELSE 'error' END", "failed", "lo", "hi", "counts WHERE lo > 0 OR hi > 0"),
        rows("allowed_values_violation:nation", "'error'", "failed", "av", "NULL", "counts WHERE av > 0"),
        rows("pattern_violation:name", "'warning'", "warning", "pat", "NULL", "counts WHERE pat > 0"),
        rows("length_violation:name", "'error'", "failed", "0", "long", "counts WHERE long > 0"),
        rows("uniqueness_violation:name", "'error'", "failed", "keys", "rows", "counts JOIN dups USING (ds)"),
        rows("row_count_violation:dataset", "'warning'", "warning", "n", "NULL", "counts WHERE n < s_suppkey * 10"),
        rows("unexpected_column:s_suppkey", "'warning'", "warning", "NULL", "NULL", "counts WHERE ds = 'supplier'")])


def _first_values(col: str) -> str:
    return f"""SELECT {q(col)} AS "column", string_agg({col}, '|' ORDER BY o_orderkey) AS sample_values
      FROM (SELECT o_orderkey, {col} FROM orders WHERE {col} IS NOT NULL ORDER BY o_orderkey, {col} LIMIT 7)"""


# Structural problems of the contract documents, by their place in the list of documents.
PROBLEMS = {
    2: [("$", "document is not parseable JSON")],
    3: [("$", "top level must be an object")],
    4: [("$.contract", "missing required contract object")],
    5: [("$.contract.name", "missing required field contract.name")],
    6: [("$.dataset", "dataset must be an object"), ("$.schema", "schema must be an object")],
    7: [("$.dataset.severity_defaults", "severity_defaults must be an object")],
    8: [("$.dataset.severity_defaults.range_violation", "invalid severity"), ("$.dataset.severity_defaults.type_mismatch", "invalid severity")],
    9: [("$.columns", "missing required columns section with at least one column")],
    10: [("$.columns", "missing required columns section with at least one column")],
    11: [("$.row_count", "row_count must be an object")],
    12: [("$.row_count.min", "row_count.min must not be negative"), ("$.row_count.max", "row_count.max must not be negative"),
         ("$.row_count", "row_count.min must not be greater than row_count.max"), ("$.row_count.severity", "invalid severity")],
    13: [("$.row_count", "row_count.min must not be greater than row_count.max"), ("$.uniqueness", "uniqueness must be a list")],
    14: [("$.columns.a", "column definition must be an object"), ("$.columns.b.type", "unsupported logical type"),
         ("$.columns.b.severity", "invalid severity"), ("$.columns.c.freshness", "freshness rule must be an object"),
         ("$.columns.c.allowed_values", "allowed_values must be a list"),
         ("$.columns.d.freshness.max_age_days", "max_age_days must be a positive integer"),
         ("$.columns.e.freshness.reference", "freshness reference must be max_value"),
         ("$.columns.f.freshness.max_age_days", "max_age_days must be a positive integer"),
         ("$.columns.g.max", "max must be a number"), ("$.columns.h.min", "min must be a number"), ("$.columns.h.max", "max must be a number")],
    15: [("$.uniqueness[0]", "uniqueness item must be an object"), ("$.uniqueness[1].name", "uniqueness name is required"),
         ("$.uniqueness[2].columns", "columns must be a non-empty list of column names"),
         ("$.uniqueness[3].columns", "columns must be a non-empty list of column names"),
         ("$.uniqueness[4].severity", "invalid severity"), ("$.uniqueness[5].columns", "columns must be a non-empty list of column names")],
}
NAMELESS = "(2, 3, 4, 5)"


def _duplicate_samples(dataset: str, col: str) -> str:
    return f"""(SELECT string_agg(md5(CAST(v AS VARCHAR)), ',' ORDER BY v) FROM (SELECT {col} AS v FROM {dataset} GROUP BY {col}
      HAVING count(*) > 1 ORDER BY v LIMIT 20))"""


ORACLE: dict[str, str] = {}


def _build() -> None:
    o = ORACLE
    o["dataset_facts"] = """SELECT 'customer' AS dataset_name, (SELECT count(*) FROM customer) AS row_count,
      (SELECT CAST(count(*) AS INTEGER) FROM pragma_table_info('customer')) AS column_count,
      (SELECT string_agg(name, ',' ORDER BY cid) FROM pragma_table_info('customer')) AS columns"""
    o["profile_nulls"] = _nulls()
    o["profile_observed_type"] = _observed()
    freq = _part_freq()
    o["profile_distinct"] = f'{freq} SELECT "column", count(*) AS distinct_count FROM freq GROUP BY 1'
    o["profile_top_values"] = f"""{freq} SELECT "column", CAST(rank AS INTEGER) AS rank, value, cnt AS count FROM
      (SELECT "column", value, cnt, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value) AS rank FROM freq)
      WHERE rank <= 5"""
    o["profile_samples"] = f"""{freq} SELECT "column", CAST(rank AS INTEGER) AS rank, value FROM
      (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) AS rank FROM freq)
      WHERE rank <= 5"""
    o["profile_numeric_range"] = _union([
        f'SELECT {q(c)} AS "column", CAST(min({c}) AS DOUBLE) AS numeric_min, CAST(max({c}) AS DOUBLE) AS numeric_max, '
        f'{"NULL" if c == "o_totalprice" else f"CAST(min({c}) AS VARCHAR)"} AS min_exact, '
        f'{"NULL" if c == "o_totalprice" else f"CAST(max({c}) AS VARCHAR)"} AS max_exact FROM {BIG if c == "big" else "orders"}'
        for c in ("o_orderkey", "o_custkey", "big", "o_totalprice")])
    o["profile_top_values_text"] = _union([_text_lists(c) for c in ("text", "lang")])
    o["profile_samples_shared_prefix"] = _text_lists("text", "repeat('<head/>', 43) || text")
    o["profile_samples_ordered"] = _union([_first_values(c) for c in ("o_orderstatus", "o_orderpriority")])
    o["profile_datetime_range"] = _union([
        f"SELECT 'events' AS dataset_name, 'ts' AS \"column\", {iso('min(ts)')} AS datetime_min, {iso('max(ts)')} AS datetime_max FROM events",
        f"SELECT 'orders', 'o_orderdate', {iso('min(o_orderdate)')}, {iso('max(o_orderdate)')} FROM orders"])
    o["profile_string_length"] = _union([
        f'SELECT {q(c)} AS "column", CAST(min(length({c})) AS INTEGER) AS string_min_length, '
        f'CAST(max(length({c})) AS INTEGER) AS string_max_length FROM documents' for c in ("text", "lang", "source")])
    o["profile_full"] = _full("customer")
    o["profile_summary"] = _summary("customer")

    o["v_nullability"] = f"""SELECT * FROM (SELECT {_head('customer', 'nullability_violation', 'c_mktsegment', 'error', 'failed')},
      count(*) - count(c_mktsegment) AS null_count, count(*) AS row_count,
      round_even(100.0 * (count(*) - count(c_mktsegment)) / count(*), 2) AS null_percentage FROM {DIRTY})
      WHERE null_count > 0"""
    o["v_type_mismatch"] = _type_mismatch()
    names = _names("customer")
    o["v_missing_required"] = _union([
        _all("customer", "missing_required_column", c, sev, "failed", f"""'{{"expected_column":"{c}","available_columns":' || {names} || '}}'""",
             f"(SELECT 1) WHERE {q(c)} NOT IN (SELECT name FROM pragma_table_info('customer'))")
        for c, sev in (("c_custkey", "error"), ("c_email", "error"), ("c_fax", "warning"))] + [
        _all("customer", "row_count_violation", "", "warning", "warning",
             """'{"row_count":' || count(*) || ',"min_allowed":1000000000,"max_allowed":null}'""", "customer HAVING count(*) < 1000000000")])
    o["v_unexpected"] = _union([
        """SELECT 'part' AS dataset_name, 'unexpected_column:' || name AS finding_id, 'unexpected_column' AS rule_type, 'warning' AS severity,
          'warning' AS status, 'Column ''' || name || ''' is not declared in the contract.' AS message,
          '{"unexpected_column":"' || name || '","declared_columns":["p_partkey","p_size"]}' AS evidence,
          'Declare the column in the contract or allow unexpected columns.' AS suggested_action
          FROM pragma_table_info('part') WHERE name NOT IN ('p_partkey', 'p_size')""",
        _all("part", "range_violation", "p_size", "error", "failed",
             """'{"min_allowed":null,"max_allowed":10,"observed_min":' || min(p_size) || ',"observed_max":' || max(p_size) ||
             ',"below_min_count":0,"above_max_count":' || count(*) FILTER (p_size > 10) || '}'""", "part HAVING count(*) FILTER (p_size > 10) > 0")])
    o["v_row_count"] = f"""SELECT {_head('customer', 'row_count_violation', 'dataset', 'warning', 'warning')},
      count(*) AS row_count, CAST(NULL AS BIGINT) AS min_allowed, CAST(1000 AS BIGINT) AS max_allowed
      FROM customer HAVING count(*) > 1000"""
    o["v_allowed_values"] = _union([_allowed("orders", "orders", "o_orderstatus", ["O", "F"]),
                                    _allowed("customer", "customer", "c_mktsegment", SEGMENTS)])
    o["v_range"] = _union([_range("customer", "c_acctbal", 0, None), _range("orders", "o_totalprice", None, 400000),
                           _range("events", "value", None, 40)])
    o["v_pattern"] = _union([_pattern("pages", "url", "https://.*"), _pattern("events", "props", '\\{"k": [0-9]\\}'),
                             _pattern("customer", "c_name", "Customer#[0-9]{9}")])
    o["v_pattern_text"] = f"""SELECT * FROM (SELECT {_head('documents', 'pattern_violation', 'text', 'warning', 'warning')},
      (SELECT count(*) FROM documents WHERE contains(text, '|')) AS failed_row_count,
      (SELECT string_agg(md5(v), ',' ORDER BY v) FROM (SELECT text AS v FROM documents WHERE contains(text, '|') ORDER BY v LIMIT 20))
        AS samples_md5) WHERE failed_row_count > 0"""
    o["v_pattern_skipped"] = _union([
        _all("customer", "pattern_violation", "c_name", "warning", "skipped",
             """'{"pattern":"[","error":"unterminated character set at position 0"}'""",
             "pragma_table_info('customer') WHERE name = 'c_name'"),
        _all("customer", "pattern_violation", "c_mktsegment", "warning", "warning",
             """'{"pattern":"[A-Z]{,8}","failed_row_count":' || count(*) || ',"sample_failed_values":["' ||
             (SELECT string_agg(c_mktsegment, '","' ORDER BY c_mktsegment) FROM (SELECT c_mktsegment FROM customer WHERE length(c_mktsegment) > 8
              ORDER BY 1 LIMIT 20)) || '"]}'""", "customer WHERE length(c_mktsegment) > 8 HAVING count(*) > 0")])
    o["v_length"] = _union([_length("part", "p_name", 9, 11), _length("documents", "text", 20, 20000)])
    o["v_unique_column"] = _union([f"SELECT *, {_duplicate_samples(t, c)} AS samples_md5 FROM ({_unique(t, [c])})"
                                   for t, c in (("documents", "text"), ("customer", "c_nationkey"), ("customer", "c_custkey"))])
    o["v_unique_nan"] = f"""SELECT * FROM (SELECT {_head('big_keys', 'uniqueness_violation', 'part_nan', 'error', 'failed')},
      count(*) AS duplicate_key_count, CAST(sum(n) AS BIGINT) AS duplicate_row_count
      FROM (SELECT part_nan, count(*) AS n FROM {BIG} GROUP BY 1 HAVING count(*) > 1)) WHERE duplicate_key_count > 0"""
    o["v_allowed_dates"] = _union([f"""SELECT * FROM (SELECT {_head('big_keys', 'allowed_values_violation', c, 'error', 'failed')},
      (SELECT count(*) FROM {BIG} WHERE {c} NOT IN ({days})) AS failed_row_count,
      (SELECT '{{' || string_agg('"' || v || '":' || n, ',' ORDER BY n DESC, v) || '}}' FROM
        (SELECT {iso(f'CAST({c} AS TIMESTAMP)')} AS v, count(*) AS n FROM {BIG} WHERE {c} NOT IN ({days}) GROUP BY 1 ORDER BY n DESC, v LIMIT 20))
        AS unexpected_values) WHERE failed_row_count > 0"""
                                   for c, days in (("day", "DATE '1995-01-01', DATE '1996-05-05', DATE '1997-02-03'"),
                                                   ("moment", "TIMESTAMP '1995-01-01', TIMESTAMP '1996-05-05', TIMESTAMP '1997-02-03'"))])
    lo, hi = 2**53 + 5, 2**53 + 1001
    o["v_range_bigint"] = _union([
        f"""SELECT * FROM (SELECT {_head('big_keys', 'range_violation', c, 'error', 'failed')}, CAST({below} AS BIGINT) AS below_min_count,
          count(*) FILTER (big > {hi}) AS above_max_count, min(big) AS observed_min, max(big) AS observed_max,
          CAST(NULL AS BIGINT) AS failed_row_count FROM {BIG}) WHERE below_min_count > 0 OR above_max_count > 0"""
        for c, below in (("big", f"count(*) FILTER (big < {lo})"), ("dec", "0"))] + [
        f"""SELECT {_head('big_keys', 'allowed_values_violation', 'big', 'error', 'failed')}, NULL, NULL, NULL, NULL, count(*)
          FROM {BIG} WHERE big NOT IN ({2**53 + 1}, {2**53 + 2}, 7) HAVING count(*) > 0"""])
    o["v_unique_composite"] = _union([_unique("lineitem", ["l_orderkey", "l_linenumber"], True),
                                      _unique("conversations", ["conv_id", "turn"], True)])
    o["v_unique_skipped"] = _union([
        _all("lineitem", "uniqueness_violation", "l_orderkey_l_missing", "error", "skipped",
             """'{"rule_name":"bad_key","checked_columns":["l_orderkey","l_missing"],"missing_columns":["' || string_agg(col, '","' ORDER BY pos) || '"]}'""",
             "(VALUES (1, 'l_orderkey'), (2, 'l_missing')) k(pos, col) WHERE col NOT IN (SELECT name FROM pragma_table_info('lineitem')) HAVING count(*) > 0",
             name="bad_key"),
        _all("lineitem", "uniqueness_violation", "l_linenumber", "info", "failed",
             """'{"rule_name":"line","checked_columns":["l_linenumber"],"duplicate_key_count":' || count(*) || ',"duplicate_row_count":' || CAST(sum(n) AS BIGINT)
             || ',"sample_duplicate_keys":[{"l_linenumber":' || string_agg(l_linenumber, '},{"l_linenumber":' ORDER BY l_linenumber) || '}]}'""",
             "(SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0", name="line"),
        _all("lineitem", "range_violation", "l_linenumber", "error", "failed",
             """'{"min_allowed":null,"max_allowed":3,"observed_min":' || min(l_linenumber) || ',"observed_max":' || max(l_linenumber) ||
             ',"below_min_count":0,"above_max_count":' || count(*) FILTER (l_linenumber > 3) || '}'""",
             "lineitem HAVING count(*) FILTER (l_linenumber > 3) > 0")])
    text_ts = f"CASE WHEN regexp_full_match(date_txt, '{ISO_RE}') THEN try_cast(date_txt AS TIMESTAMP) END"
    o["v_freshness"] = _union([
        _freshness("orders", "orders", "o_orderdate", "2001-12-31", 30),
        _freshness("events", "events", "ts", "2024-03-01", 30),
        _freshness("text_orders", TEXT_ORDERS, "date_txt", "2001-12-31", 30, ts=text_ts),
        _freshness("text_orders", "orders", "zoned_txt", "2001-12-31", 30, ts=ZONED)])
    name_ts = f"CASE WHEN regexp_full_match(trim(c_name), '{ISO_RE}') THEN try_cast(trim(c_name) AS TIMESTAMP) END"
    o["v_freshness_skipped"] = f"""SELECT {_head('customer', 'freshness_violation', 'c_name', 'warning', 'skipped')},
      CAST(NULL AS BIGINT) AS observed_age_days FROM customer HAVING max({name_ts}) IS NULL"""
    o["severity_resolution"] = """
      SELECT 'unexpected_column:' || name AS finding_id, 'unexpected_column' AS rule_type, 'info' AS severity,
        'warning' AS status FROM pragma_table_info('customer')
        WHERE name NOT IN ('c_custkey', 'c_name', 'c_acctbal', 'c_mktsegment')
      UNION ALL SELECT 'uniqueness_violation:c_custkey', 'uniqueness_violation', 'error', 'failed'
        FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
      UNION ALL SELECT 'uniqueness_violation:c_nationkey_c_mktsegment', 'uniqueness_violation', 'info', 'failed'
        FROM (SELECT c_nationkey, c_mktsegment FROM customer GROUP BY 1, 2 HAVING count(*) > 1) HAVING count(*) > 0
      UNION ALL SELECT 'allowed_values_violation:c_mktsegment', 'allowed_values_violation', 'error', 'failed'
        FROM customer WHERE c_mktsegment <> 'BUILDING' HAVING count(*) > 0
      UNION ALL SELECT 'range_violation:c_acctbal', 'range_violation', 'warning', 'failed'
        FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0
      UNION ALL SELECT 'pattern_violation:c_name', 'pattern_violation', 'info', 'warning'
        FROM customer WHERE NOT regexp_full_match(c_name, 'Customer#[0-9]{3}') HAVING count(*) > 0
      UNION ALL SELECT 'row_count_violation:dataset', 'row_count_violation', 'error', 'warning'
        FROM customer HAVING count(*) > 10"""
    o["findings_all"] = """WITH m AS (SELECT count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) av,
        count(*) FILTER (o_totalprice > 400000) hi,
        date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-12-31') age,
        typeof(min(o_orderdate)) ty FROM orders)
      SELECT 'type_mismatch:o_orderdate' finding_id, 'type_mismatch' rule_type, 'error' severity, 'failed' status
        FROM m WHERE ty LIKE 'TIMESTAMP%'
      UNION ALL SELECT 'allowed_values_violation:o_orderstatus', 'allowed_values_violation', 'error', 'failed' FROM m WHERE av > 0
      UNION ALL SELECT 'range_violation:o_totalprice', 'range_violation', 'error', 'failed' FROM m WHERE hi > 0
      UNION ALL SELECT 'freshness_violation:o_orderdate', 'freshness_violation', 'warning', 'warning' FROM m WHERE age > 30"""
    o["findings_lineitem"] = """WITH m AS (SELECT count(*) n, count(*) - count(l_orderkey) ok_nulls,
        count(*) - count(l_shipdate) sd_nulls,
        count(*) FILTER (l_linenumber < 1 OR l_linenumber > 7) ln_bad,
        count(*) FILTER (l_quantity < 1 OR l_quantity > 50) q_bad, count(*) FILTER (l_extendedprice < 1000) ep_bad,
        count(*) FILTER (l_discount < 0 OR l_discount > 0.08) d_bad, count(*) FILTER (l_tax < 0 OR l_tax > 0.08) t_bad,
        count(*) FILTER (l_returnflag NOT IN ('A', 'N')) rf_bad, count(*) FILTER (l_linestatus NOT IN ('O', 'F')) ls_bad,
        count(*) FILTER (NOT regexp_full_match(l_linestatus, '[OF]')) ls_pat,
        count(*) FILTER (length(l_linestatus) <> 1) ls_len,
        date_diff('day', CAST(max(l_shipdate) AS DATE), DATE '2001-12-31') age, typeof(min(l_shipdate)) ty,
        (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)) dups
        FROM lineitem)
      SELECT 'type_mismatch:l_shipdate' finding_id, 'type_mismatch' rule_type, 'error' severity, 'failed' status
        FROM m WHERE ty LIKE 'TIMESTAMP%'
      UNION ALL SELECT 'nullability_violation:l_orderkey', 'nullability_violation', 'error', 'failed' FROM m WHERE ok_nulls > 0
      UNION ALL SELECT 'nullability_violation:l_shipdate', 'nullability_violation', 'error', 'failed' FROM m WHERE sd_nulls > 0
      UNION ALL SELECT 'uniqueness_violation:l_orderkey_l_linenumber', 'uniqueness_violation', 'error', 'failed' FROM m WHERE dups > 0
      UNION ALL SELECT 'allowed_values_violation:l_returnflag', 'allowed_values_violation', 'error', 'failed' FROM m WHERE rf_bad > 0
      UNION ALL SELECT 'allowed_values_violation:l_linestatus', 'allowed_values_violation', 'error', 'failed' FROM m WHERE ls_bad > 0
      UNION ALL SELECT 'range_violation:l_linenumber', 'range_violation', 'error', 'failed' FROM m WHERE ln_bad > 0
      UNION ALL SELECT 'range_violation:l_quantity', 'range_violation', 'error', 'failed' FROM m WHERE q_bad > 0
      UNION ALL SELECT 'range_violation:l_extendedprice', 'range_violation', 'error', 'failed' FROM m WHERE ep_bad > 0
      UNION ALL SELECT 'range_violation:l_discount', 'range_violation', 'error', 'failed' FROM m WHERE d_bad > 0
      UNION ALL SELECT 'range_violation:l_tax', 'range_violation', 'error', 'failed' FROM m WHERE t_bad > 0
      UNION ALL SELECT 'pattern_violation:l_linestatus', 'pattern_violation', 'warning', 'warning' FROM m WHERE ls_pat > 0
      UNION ALL SELECT 'length_violation:l_linestatus', 'length_violation', 'error', 'failed' FROM m WHERE ls_len > 0
      UNION ALL SELECT 'freshness_violation:l_shipdate', 'freshness_violation', 'warning', 'warning' FROM m WHERE age > 30
      UNION ALL SELECT 'row_count_violation:dataset', 'row_count_violation', 'warning', 'warning' FROM m WHERE n < 1000"""
    o["findings_by_slice"] = """
      SELECT 'orders' AS dataset_name, 'month=' || CAST(m AS VARCHAR) AS slice,
        'range_violation:o_totalprice' AS finding_id, 'range_violation' AS rule_type, 'failed' AS status,
        hi AS above_max_count, CAST(NULL AS BIGINT) AS row_count, CAST(NULL AS BIGINT) AS duplicate_key_count,
        CAST(NULL AS BIGINT) AS duplicate_row_count, CAST(0 AS BIGINT) AS below_min_count
      FROM (SELECT date_trunc('month', o_orderdate) m, count(*) FILTER (o_totalprice > 499000) hi FROM orders GROUP BY 1)
      WHERE hi > 0
      UNION ALL
      SELECT 'orders', 'month=' || CAST(m AS VARCHAR), 'row_count_violation:dataset', 'row_count_violation', 'warning',
        NULL, n, NULL, NULL, NULL
      FROM (SELECT date_trunc('month', o_orderdate) m, count(*) n FROM orders GROUP BY 1) WHERE n < 180
      UNION ALL
      SELECT 'lineitem', 'l_returnflag=' || l_returnflag, 'uniqueness_violation:l_orderkey_l_linenumber',
        'uniqueness_violation', 'failed', NULL, NULL, count(*), CAST(sum(n) AS BIGINT), NULL
      FROM (SELECT l_returnflag, l_orderkey, l_linenumber, count(*) n FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1)
      GROUP BY l_returnflag
      UNION ALL
      SELECT 'segments', label, 'range_violation:c_acctbal', 'range_violation', 'failed', 0, NULL, NULL, NULL, lo FROM """ + SEGMENTS_CTE + """ WHERE lo > 0
      UNION ALL
      SELECT 'segments', label, 'row_count_violation:dataset', 'row_count_violation', 'warning', NULL, n, NULL, NULL, NULL FROM """ + SEGMENTS_CTE
    remark = """'say "' || c_name || '", then' || chr(10) || '"' || c_mktsegment || '", ' || c_nationkey"""
    o["src_csv_na_tokens"] = f"""
      SELECT 'c_custkey' AS "column", 'bigint' AS physical_type, 'integer' AS observed_type, count(*) AS row_count,
        count(*) - count(c_custkey) AS null_count, CAST(NULL AS BIGINT) AS distinct_count, CAST(NULL AS INTEGER) AS string_max_length, '' AS samples FROM customer
      UNION ALL SELECT 'seg', 'string', 'string', count(*), count(*) FILTER (c_custkey % 3 = 0), NULL,
        CAST(max(length(c_mktsegment)) FILTER (c_custkey % 3 <> 0) AS INTEGER), '' FROM customer
      UNION ALL SELECT 'c_acctbal', 'double', 'number', count(*), count(*) - count(c_acctbal), NULL, NULL, '' FROM customer
      UNION ALL SELECT 'remark', 'string', 'string', count(*), 0, count(DISTINCT {remark}), CAST(max(length({remark})) AS INTEGER),
        (SELECT string_agg(v, '~' ORDER BY v) FROM (SELECT DISTINCT {remark} AS v FROM customer ORDER BY v LIMIT 3)) FROM customer"""
    o["findings_many"] = _many()
    o["contract_header"] = f"""SELECT c_name AS contract_name, CAST(c_custkey AS VARCHAR) AS contract_version,
      c_mktsegment AS owner, false AS allow_unexpected_columns FROM customer
      UNION ALL SELECT CASE WHEN k NOT IN {NAMELESS} THEN c_name END, CASE WHEN k < 2 THEN CAST(c_custkey AS VARCHAR) WHEN k = 5 THEN '1' END,
        CASE WHEN k < 2 THEN c_mktsegment END, k = 1 FROM (SELECT *, c_custkey % 16 AS k FROM customer)"""
    sev = "CASE WHEN c_nationkey % 5 = 0 THEN 'fatal' ELSE 'error' END"
    rng = "CASE WHEN c_nationkey % 5 = 0 THEN 'fatal' WHEN c_nationkey % 3 = 0 THEN 'warning' ELSE 'error' END"
    head = "c_name AS contract_name, CAST(c_custkey AS VARCHAR) AS contract_version"
    fields = {"rule_name": "VARCHAR", "expected_type": "VARCHAR", "min_value": "DOUBLE", "max_text": "VARCHAR", "allowed_values": "VARCHAR",
              "pattern": "VARCHAR", "min_length": "INTEGER", "max_length": "INTEGER", "max_age_days": "INTEGER", "min_rows": "BIGINT",
              "max_rows": "BIGINT", "declared_columns": "VARCHAR"}

    def rule(kind: str, cols: str, severity: str, where: str = "true", **given: str) -> str:
        rest = ", ".join(f"CAST({given.get(f, 'NULL')} AS {t}) AS {f}" for f, t in fields.items())
        return f"SELECT {head}, {q(kind)} AS rule_type, {q(cols)} AS columns, {severity} AS severity, {rest} FROM customer WHERE {where}"

    first, second = "c_custkey % 16 = 0", "c_custkey % 16 = 1"
    number, error, warning, info = ("'number'", "'error'", "'warning'", "'info'")
    # the type of a column is carried by all rules of that column
    o["contract_rules"] = _union([
        rule("missing_required_column", "balance", sev, expected_type=number),
        rule("type_mismatch", "balance", sev, expected_type=number),
        rule("range_violation", "balance", rng, expected_type=number, min_value="c_acctbal"),
        rule("missing_required_column", "segment", error),
        rule("nullability_violation", "segment", error),
        rule("allowed_values_violation", "segment", error, allowed_values="c_mktsegment"),
        rule("uniqueness_violation", "balance,segment", error, rule_name="'k'"),
        rule("unexpected_column", "", warning, declared_columns="'balance,segment'"),
        *[rule(kind, "a", severity, first, expected_type="'integer'", **given) for kind, severity, given in (
            ("missing_required_column", error, {}), ("type_mismatch", error, {}), ("nullability_violation", error, {}),
            ("uniqueness_violation", error, {"rule_name": "'column_unique:a'"}),
            ("range_violation", info, {"min_value": "1", "max_text": "'9007199254740993'"}))],
        rule("allowed_values_violation", "b", warning, first, allowed_values="'x,1,true'"),
        rule("missing_required_column", "c", error, first),
        rule("pattern_violation", "c", warning, first, pattern="'[a-z]+'"),
        rule("length_violation", "c", error, first, min_length="2", max_length="4"),
        *[rule(kind, "d", severity, first, expected_type="'date'", **given) for kind, severity, given in (
            ("missing_required_column", error, {}), ("type_mismatch", error, {}), ("freshness_violation", warning, {"max_age_days": "30"}))],
        rule("uniqueness_violation", "a,b", info, first, rule_name="'ab'"),
        rule("row_count_violation", "", error, first, min_rows="1", max_rows="5"),
        rule("unexpected_column", "", warning, first, declared_columns="'a,b,c,d'"),
        rule("nullability_violation", "a", error, second),
        rule("uniqueness_violation", "a", error, second, rule_name="'column_unique:a'"),
        rule("missing_required_column", "b", error, second),
        rule("nullability_violation", "b", error, second),
    ])
    o["contract_diff"] = """
      WITH rules(rule_type, columns, rule_name) AS (VALUES
        ('missing_required_column', 'balance', NULL), ('missing_required_column', 'nation', NULL), ('missing_required_column', 'name', NULL),
        ('type_mismatch', 'balance', NULL), ('type_mismatch', 'nation', NULL), ('range_violation', 'balance', NULL),
        ('allowed_values_violation', 'nation', NULL), ('pattern_violation', 'name', NULL), ('length_violation', 'name', NULL),
        ('uniqueness_violation', 'name', 'column_unique:name'), ('row_count_violation', '', NULL), ('unexpected_column', '', NULL)),
      told AS (
        SELECT s_name, s_suppkey AS k, r.*, k % 11 <> 0 AS in_old, k % 7 <> 3 AND NOT (r.rule_type = 'pattern_violation' AND k % 4 = 1) AS in_new,
          CASE WHEN r.rule_type = 'range_violation' AND k % 4 = 0 THEN 'max_text' WHEN r.rule_type = 'allowed_values_violation' AND k % 5 = 0 THEN 'allowed_values'
               WHEN r.rule_type = 'length_violation' AND k % 4 = 2 THEN 'max_length' WHEN r.rule_type = 'row_count_violation' AND k % 6 = 0 THEN 'max_rows' END AS field
        FROM supplier, rules r)
      SELECT s_name AS contract_name, rule_type, columns, rule_name,
        CASE WHEN NOT in_old THEN 'added' WHEN NOT in_new THEN 'removed' ELSE 'changed' END AS change,
        CASE WHEN in_old AND in_new THEN field ELSE '' END AS fields,
        CASE WHEN in_old THEN CAST(k AS VARCHAR) END AS old_version, CASE WHEN in_new THEN CAST(k + 1 AS VARCHAR) END AS new_version,
        CASE WHEN in_new AND rule_type = 'length_violation' THEN CASE WHEN k % 4 = 2 THEN '20' ELSE '18' END END AS new_max_length
      FROM told WHERE in_old <> in_new OR (in_old AND in_new AND field IS NOT NULL)"""
    o["contract_lint"] = _union(["""SELECT c_name AS contract_name, '$.columns.balance.severity' AS path,
      'invalid severity' AS problem FROM customer WHERE c_nationkey % 5 = 0"""] + [
        f"SELECT CASE WHEN {k} NOT IN {NAMELESS} THEN c_name END, {q(path)}, {q(problem)} FROM customer WHERE c_custkey % 16 = {k}"
        for k, problems in PROBLEMS.items() for path, problem in problems])
    _build_triage(o)


def _finding(run: str, ds: str, slice_expr: str, seq: str, rule: str, col: str | None, cols: str, sev: str,
             status: str, src: str, extra_cols: str = "NULL", evidence: str = "NULL", **fmt) -> str:
    m, a = msg(rule, status, column=col or "", **fmt)
    fid = f"{rule}:{cols.replace('|', '_') or 'dataset'}"
    return (f"SELECT {q(run)} AS run_id, {q(ds)} AS dataset_name, {slice_expr} AS slice, {seq} AS seq, "
            f"{q(fid)} AS finding_id, {q(rule)} AS rule_type, {q(col) if col else 'NULL'} AS col, {q(cols)} AS cols, "
            f"{q(sev)} AS severity, {q(status)} AS status, {m} AS message, {a} AS suggested_action, "
            f"{extra_cols} AS extra, {evidence} AS ev FROM {src}")


def _seen(column: str, table: str) -> str:
    """Profile evidence of an integer column as JSON text."""
    freq = f"(SELECT CAST({column} AS VARCHAR) v, count(*) n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1)"
    return f"""(SELECT '{{"observed_type":"integer","null_count":' || (count(*) - count({column})) || ',"non_null_count":' || count({column}) ||
      ',"sample_values":["' || (SELECT string_agg(v, '","' ORDER BY v) FROM (SELECT v FROM {freq} ORDER BY v LIMIT 5)) ||
      '"],"top_values":[' || (SELECT string_agg('{{"value":"' || v || '","count":' || n || '}}', ',' ORDER BY n DESC, v)
        FROM (SELECT * FROM {freq} ORDER BY n DESC, v LIMIT 5)) || ']}}' FROM {table})"""


TRIAGE_CTE = ""


def _build_triage(o: dict[str, str]) -> None:
    global TRIAGE_CTE
    seg = ", ".join(q(s) for s in SEGMENTS)
    month = "'month=' || CAST(m AS VARCHAR)"
    findings = _union([
        _finding("r_orders", "orders", month, 7, "range_violation", "o_totalprice", "o_totalprice", "error", "failed",
                 "om WHERE hi > 0"),
        _finding("r_orders", "orders", month, 11, "row_count_violation", None, "", "warning", "warning",
                 "om WHERE n < 180", extra_cols="CAST(n AS VARCHAR)",
                 evidence="""'{"row_count":' || n || ',"min_allowed":180,"max_allowed":null}'"""),
        _finding("r_lineitem", "lineitem", "'l_returnflag=' || l_returnflag", 5, "uniqueness_violation", None,
                 "l_orderkey|l_linenumber", "error", "failed", "lf", name="line_key"),
        _finding("r_customer", "customer", "''", 1, "missing_required_column", "c_email", "c_email", "error", "failed",
                 "(SELECT 1) WHERE 'c_email' NOT IN (SELECT name FROM pragma_table_info('customer'))"),
        _finding("r_customer", "customer", "''", 2, "unexpected_column", "c_nationkey", "c_nationkey", "warning",
                 "warning", "(SELECT 1) WHERE 'c_nationkey' IN (SELECT name FROM pragma_table_info('customer'))",
                 evidence=_seen("c_nationkey", "customer")),
        _finding("r_customer", "customer", "''", 6, "allowed_values_violation", "c_mktsegment", "c_mktsegment",
                 "error", "failed", "cu WHERE av > 0", extra_cols="cand",
                 evidence="""'{"allowed_values":["AUTOMOBILE","BUILDING","HOUSEHOLD","MACHINERY"],"unexpected_values":' || hist ||
                 ',"failed_row_count":' || av || '}'"""),
        _finding("r_customer", "customer", "''", 7, "range_violation", "c_acctbal", "c_acctbal", "error", "failed",
                 "cu WHERE lo > 0"),
        _finding("r_customer", "customer", "''", 8, "pattern_violation", "c_name", "c_name", "warning", "warning",
                 "cu WHERE pat > 0"),
        _finding("r_customer", "customer", "''", 5, "uniqueness_violation", "c_custkey", "c_custkey", "error",
                 "failed", "cu WHERE dup > 0", name="column_unique:c_custkey"),
        _finding("r_customer", "customer", "''", 11, "row_count_violation", None, "", "warning", "warning",
                 "cu WHERE n > 1000", extra_cols="CAST(n AS VARCHAR)",
                 evidence="""'{"row_count":' || n || ',"min_allowed":null,"max_allowed":1000}'"""),
        _finding("r_nation", "nation", "''", 4, "nullability_violation", "n_nationkey", "n_nationkey", "error",
                 "failed", "na WHERE nk_nulls > 0"),
        _finding("r_nation", "nation", "''", 4, "nullability_violation", "n_name", "n_name", "error",
                 "failed", "na WHERE nm_nulls > 0"),
        _finding("r_nation", "nation", "''", 5, "uniqueness_violation", "n_nationkey", "n_nationkey", "error",
                 "failed", "na WHERE dup > 0", name="column_unique:n_nationkey"),
        _finding("r_nation", "nation", "''", 7, "range_violation", "n_regionkey", "n_regionkey", "error", "failed",
                 "na WHERE out_of_range > 0"),
        _finding("r_people", "people", "''", 10, "missing_required_column", "zip", "zip", "info", "failed", "pe"),
        _finding("r_people", "people", "''", 20, "unexpected_column", "extra", "extra", "info", "warning", "pe", evidence=_seen("c_nationkey % 5", "customer")),
        _finding("r_people", "people", "''", 30, "type_mismatch", "c_custkey", "c_custkey", "error", "failed", "pe", observed="integer", expected="string",
                 evidence="""'{"expected_type":"string","observed_type":"integer"}'"""),
        _finding("r_people", "people", "''", 40, "nullability_violation", "seg", "seg", "warning", "failed", "pe WHERE seg_nulls > 0",
                 evidence="""'{"null_count":' || seg_nulls || ',"row_count":' || n || ',"null_percentage":' || round_even(100.0 * seg_nulls / n, 2) || '}'"""),
        _finding("r_people", "people", "''", 50, "uniqueness_violation", "nation", "nation", "warning", "failed", "pe WHERE nk_dup > 0", name="nk"),
        _finding("r_people", "people", "''", 51, "uniqueness_violation", None, "name|zzz", "info", "skipped", "pe", name="bad"),
        _finding("r_people", "people", "''", 60, "allowed_values_violation", "nation", "nation", "info", "failed", "pe WHERE av > 0", extra_cols="cand",
                 evidence="""'{"allowed_values":["0","1","2"],"unexpected_values":' || hist || ',"failed_row_count":' || av || '}'"""),
        _finding("r_people", "people", "''", 70, "range_violation", "balance", "balance", "warning", "failed", "pe WHERE lo > 0"),
        _finding("r_people", "people", "''", 80, "pattern_violation", "name", "name", "warning", "skipped", "pe"),
        _finding("r_people", "people", "''", 90, "length_violation", "name", "name", "error", "failed", "pe WHERE short > 0"),
        _finding("r_people", "people", "''", 100, "freshness_violation", "name", "name", "warning", "skipped", "pe",
                 evidence="""'{"latest_value":null,"reference_date":"2001-12-31","max_age_days":30,"observed_age_days":null}'"""),
        _finding("r_people", "people", "''", 101, "freshness_violation", "day", "day", "warning", "warning", "pe WHERE age > 30",
                 evidence="""'{"latest_value":"' || strftime(latest, '%Y-%m-%dT00:00:00') ||
                 '","reference_date":"2001-12-31","max_age_days":30,"observed_age_days":' || age || '}'"""),
        _finding("r_people", "people", "''", 110, "row_count_violation", None, "", "info", "warning", "pe WHERE n > 10", extra_cols="CAST(n AS VARCHAR)",
                 evidence="""'{"row_count":' || n || ',"min_allowed":null,"max_allowed":10}'"""),
        _finding("r_supplier", "supplier", "''", 110, "row_count_violation", None, "", "info", "warning", "su WHERE n > 1", extra_cols="CAST(n AS VARCHAR)",
                 evidence="""'{"row_count":' || n || ',"min_allowed":null,"max_allowed":1}'"""),
        _finding("r_part", "part", "''", 70, "range_violation", "p_size", "p_size", "warning", "failed", "pt WHERE hi > 0"),
        _finding("r_segments", "segments", "label", 70, "range_violation", "c_acctbal", "c_acctbal", "error", "failed", "sg_ WHERE lo > 0"),
        _finding("r_segments", "segments", "label", 110, "row_count_violation", None, "", "warning", "warning", "sg_", extra_cols="CAST(n AS VARCHAR)",
                 evidence="""'{"row_count":' || n || ',"min_allowed":1000000000,"max_allowed":null}'"""),
    ])
    TRIAGE_CTE = f"""WITH om AS (SELECT date_trunc('month', o_orderdate) m, count(*) n,
        count(*) FILTER (o_totalprice > 499000) hi FROM orders GROUP BY 1),
      lf AS (SELECT l_returnflag, count(*) dk FROM (SELECT l_returnflag, l_orderkey, l_linenumber FROM lineitem
        GROUP BY 1, 2, 3 HAVING count(*) > 1) GROUP BY 1),
      cu AS (SELECT count(*) n, count(*) FILTER (c_mktsegment NOT IN ({seg})) av, count(*) FILTER (c_acctbal < 0) lo,
        count(*) FILTER (NOT regexp_full_match(c_name, 'Customer#[0-9]{{9}}')) pat,
        count(*) - count(DISTINCT c_custkey) dup,
        (SELECT '["' || string_agg(v, '","' ORDER BY n DESC, v) || '"]' FROM (SELECT c_mktsegment v, count(*) n
          FROM customer WHERE c_mktsegment NOT IN ({seg}) GROUP BY 1 ORDER BY n DESC, v LIMIT 20)) cand,
        (SELECT '{{' || string_agg('"' || v || '":' || n, ',' ORDER BY n DESC, v) || '}}' FROM (SELECT c_mktsegment v, count(*) n
          FROM customer WHERE c_mktsegment NOT IN ({seg}) GROUP BY 1 ORDER BY n DESC, v LIMIT 20)) hist FROM customer),
      pe AS (SELECT count(*) n, count(*) FILTER (c_custkey % 7 = 0) seg_nulls, count(*) FILTER (c_nationkey NOT IN (0, 1, 2)) av,
        count(*) FILTER (c_acctbal < 0) lo, count(*) FILTER (length(c_name) < 19) short, count(*) - count(DISTINCT c_nationkey) nk_dup,
        max(DATE '2001-01-01' + CAST(c_custkey % 300 AS INTEGER)) latest,
        date_diff('day', max(DATE '2001-01-01' + CAST(c_custkey % 300 AS INTEGER)), DATE '2001-12-31') age,
        (SELECT '["' || string_agg(v, '","' ORDER BY n DESC, v) || '"]' FROM (SELECT CAST(c_nationkey AS VARCHAR) v, count(*) n
          FROM customer WHERE c_nationkey NOT IN (0, 1, 2) GROUP BY 1 ORDER BY n DESC, v LIMIT 20)) cand,
        (SELECT '{{' || string_agg('"' || v || '":' || n, ',' ORDER BY n DESC, v) || '}}' FROM (SELECT CAST(c_nationkey AS VARCHAR) v, count(*) n
          FROM customer WHERE c_nationkey NOT IN (0, 1, 2) GROUP BY 1 ORDER BY n DESC, v LIMIT 20)) hist FROM customer),
      su AS (SELECT count(*) n FROM supplier),
      pt AS (SELECT count(*) n, count(*) FILTER (p_size > 10) hi FROM part),
      sg_ AS (SELECT * FROM {SEGMENTS_CTE}),
      na AS (SELECT count(*) - count(n_nationkey) nk_nulls, count(*) - count(n_name) nm_nulls,
        count(*) - count(DISTINCT n_nationkey) dup, count(*) FILTER (n_regionkey < 0 OR n_regionkey > 4) out_of_range
        FROM nation),
      runs AS (
        SELECT 'r_orders' run_id, 'orders' dataset_name, {month} slice, n row_count FROM om
        UNION ALL SELECT 'r_orders', 'orders', '', count(*) FROM orders
        UNION ALL SELECT 'r_lineitem', 'lineitem', 'l_returnflag=' || l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag
        UNION ALL SELECT 'r_lineitem', 'lineitem', '', count(*) FROM lineitem
        UNION ALL SELECT 'r_customer', 'customer', '', count(*) FROM customer
        UNION ALL SELECT 'r_nation', 'nation', '', count(*) FROM nation
        UNION ALL SELECT 'r_people', 'people', '', count(*) FROM customer
        UNION ALL SELECT 'r_supplier', 'supplier', '', count(*) FROM supplier
        UNION ALL SELECT 'r_part', 'part', '', count(*) FROM part
        UNION ALL SELECT 'r_segments', 'segments', label, n FROM sg_
        UNION ALL SELECT 'r_segments', 'segments', '', count(*) FROM customer),
      cc AS (SELECT 'orders' ds, count(*) ncol FROM pragma_table_info('orders')
        UNION ALL SELECT 'lineitem', count(*) FROM pragma_table_info('lineitem')
        UNION ALL SELECT 'customer', count(*) FROM pragma_table_info('customer')
        UNION ALL SELECT 'nation', count(*) FROM pragma_table_info('nation')
        UNION ALL SELECT 'people', 7 UNION ALL SELECT 'supplier', count(*) FROM pragma_table_info('supplier')
        UNION ALL SELECT 'part', count(*) FROM pragma_table_info('part')
        UNION ALL SELECT 'segments', count(*) + 1 FROM pragma_table_info('customer')),
      f AS ({findings}),
      c AS (SELECT *,
        CASE WHEN status = 'skipped' THEN 'not_applicable'
          WHEN rule_type IN ('nullability_violation', 'range_violation') THEN CASE WHEN severity = 'error' THEN 'breaking' ELSE 'review_needed' END
          WHEN rule_type = 'uniqueness_violation' THEN CASE WHEN status = 'failed' THEN 'breaking' ELSE 'review_needed' END
          WHEN rule_type = 'allowed_values_violation' THEN 'review_needed'
          WHEN rule_type IN ('missing_required_column', 'type_mismatch') THEN 'breaking'
          WHEN rule_type IN ('unexpected_column', 'pattern_violation', 'length_violation', 'freshness_violation',
            'row_count_violation') THEN 'review_needed'
          ELSE 'review_needed' END AS compatibility,
        CASE WHEN status = 'skipped' THEN 'medium'
          WHEN rule_type IN ('nullability_violation', 'range_violation', 'allowed_values_violation') THEN CASE WHEN severity = 'error' THEN 'high' ELSE 'medium' END
          WHEN rule_type = 'uniqueness_violation' THEN CASE WHEN status = 'failed' THEN 'high' ELSE 'medium' END
          WHEN rule_type IN ('missing_required_column', 'type_mismatch') THEN 'high'
          WHEN rule_type IN ('unexpected_column', 'pattern_violation', 'length_violation', 'freshness_violation',
            'row_count_violation') THEN 'medium'
          ELSE 'low' END AS priority,
        CASE WHEN status = 'skipped' THEN 'validation_setup'
          WHEN rule_type IN ('nullability_violation', 'range_violation', 'uniqueness_violation') THEN 'data_quality'
          WHEN rule_type = 'allowed_values_violation' THEN 'domain_values'
          WHEN rule_type IN ('missing_required_column', 'type_mismatch', 'unexpected_column') THEN 'schema_drift'
          WHEN rule_type IN ('pattern_violation', 'length_violation') THEN 'format'
          WHEN rule_type = 'freshness_violation' THEN 'timeliness'
          WHEN rule_type = 'row_count_violation' THEN 'volume'
          ELSE 'validation_setup' END AS review_category
        FROM f),
      s AS (
        SELECT run_id, dataset_name, slice, seq, rule_type || ':' || coalesce(col, 'dataset') AS suggestion_id,
          CASE rule_type WHEN 'unexpected_column' THEN 'add_unexpected_column'
            WHEN 'allowed_values_violation' THEN 'review_allowed_values'
            WHEN 'nullability_violation' THEN 'review_nullability' WHEN 'type_mismatch' THEN 'review_type'
            WHEN 'freshness_violation' THEN 'review_refresh_process' ELSE 'review_row_count_bounds' END AS suggestion_type,
          CASE rule_type WHEN 'unexpected_column' THEN 'columns.' || col
            WHEN 'allowed_values_violation' THEN 'columns.' || col || '.allowed_values'
            WHEN 'nullability_violation' THEN 'columns.' || col || '.nullable' WHEN 'type_mismatch' THEN 'columns.' || col || '.type'
            WHEN 'freshness_violation' THEN 'columns.' || col || '.freshness' ELSE 'row_count' END AS target_path,
          CASE WHEN rule_type IN ('unexpected_column', 'allowed_values_violation', 'freshness_violation') THEN 'medium'
            ELSE 'low' END AS confidence,
          CASE rule_type
            WHEN 'unexpected_column' THEN '{{"required":false,"type":"' ||
              (SELECT CASE WHEN typeof(any_value(c_nationkey)) IN ('INTEGER', 'BIGINT') THEN 'integer' ELSE 'string' END FROM customer)
              || '","nullable":' || (SELECT CASE WHEN count(*) > count(c_nationkey) THEN 'true' ELSE 'false' END FROM customer)
              || ',"description":"Suggested from observed dataset column. Review before accepting."}}'
            WHEN 'allowed_values_violation' THEN '{{"candidate_values":' || extra || '}}'
            WHEN 'nullability_violation' THEN '{{"nullable":true}}'
            WHEN 'row_count_violation' THEN '{{"observed_row_count":' || extra || '}}'
            WHEN 'type_mismatch' THEN '{{"observed_type":"integer"}}'
            ELSE '{{}}' END AS proposed_change,
          CASE rule_type WHEN 'unexpected_column' THEN 'Column appeared in the dataset but is not declared in the contract.'
            WHEN 'allowed_values_violation' THEN 'Dataset contains values outside the declared allowed_values.'
            WHEN 'nullability_violation' THEN 'Nulls were observed in a column declared as non-nullable. Confirm data quality before loosening contract constraints.'
            WHEN 'type_mismatch' THEN 'Observed type differs from declared type.'
            WHEN 'freshness_violation' THEN 'Latest observed value is older than the allowed freshness window.'
            ELSE 'Observed row volume is outside declared bounds; review extraction behavior or row_count expectations.' END AS reason,
          CASE WHEN rule_type = 'nullability_violation' THEN replace(ev, '}}', ',"note":"Not an automatic recommendation to relax the contract."}}')
            ELSE ev END AS evidence
        FROM f WHERE rule_type IN ('unexpected_column', 'allowed_values_violation', 'nullability_violation',
          'type_mismatch', 'freshness_violation', 'row_count_violation')),
      rec AS (
        SELECT run_id, dataset_name, slice,
          CASE WHEN rule_type IN ('missing_required_column', 'type_mismatch') THEN 0
            WHEN rule_type IN ('nullability_violation', 'uniqueness_violation', 'range_violation', 'pattern_violation',
              'length_violation', 'allowed_values_violation') THEN 1
            WHEN rule_type = 'unexpected_column' THEN 2
            WHEN rule_type IN ('freshness_violation', 'row_count_violation') THEN 3 END AS g,
          finding_id, rule_type, seq, status, severity FROM c),
      recs AS (
        SELECT run_id, dataset_name, slice, g AS rec_order,
          CASE g WHEN 0 THEN 'rec_schema_drift' WHEN 1 THEN 'rec_data_quality' WHEN 2 THEN 'rec_contract_review'
            ELSE 'rec_operational_review' END AS recommendation_id,
          CASE g WHEN 0 THEN 'high' WHEN 1 THEN CASE WHEN bool_or(status = 'failed' AND severity = 'error') THEN 'high'
            ELSE 'medium' END ELSE 'medium' END AS priority,
          CASE g WHEN 0 THEN 'schema_drift' WHEN 1 THEN 'data_quality' WHEN 2 THEN 'contract_review'
            ELSE 'operational_review' END AS category,
          string_agg(finding_id, ',' ORDER BY rule_type, seq) AS linked_finding_ids
        FROM rec WHERE g IS NOT NULL GROUP BY run_id, dataset_name, slice, g
        UNION ALL
        SELECT DISTINCT run_id, dataset_name, slice, 4, 'rec_contract_governance', 'medium', 'contract_governance', ''
        FROM s
        UNION ALL
        SELECT run_id, dataset_name, slice, 5, 'rec_no_findings', 'low', 'validation_result', ''
        FROM runs r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.run_id = r.run_id AND f.dataset_name = r.dataset_name
          AND f.slice = r.slice)),
      pk AS (SELECT run_id, dataset_name, slice, count(*) n, bool_or(status = 'failed' AND severity = 'error') fe,
        bool_or(severity = 'warning' OR status IN ('skipped', 'review_needed')) rv,
        bool_or(status = 'failed' AND severity IN ('error', 'warning')) fw FROM f GROUP BY 1, 2, 3)
    """
    k = "run_id, dataset_name, slice"
    o["classify"] = f"""{TRIAGE_CTE} SELECT {k}, finding_id, compatibility, priority, review_category,
      CASE WHEN status = 'skipped' THEN 'Validation was skipped and needs setup or prerequisite fixes before interpretation.'
        ELSE 'Rule ''' || rule_type || ''' was classified as ' || compatibility || ' with ' || priority || ' priority.' END
        AS rationale,
      CASE WHEN status = 'skipped' THEN 'Resolve setup prerequisites, then rerun validation.' ELSE suggested_action END
        AS recommended_human_action FROM c"""
    o["failures_table"] = f"""{TRIAGE_CTE} SELECT {k}, finding_id, rule_type, coalesce(col, '') AS "column",
      cols AS columns, severity, status, compatibility, priority, review_category, message, suggested_action,
      CASE WHEN status = 'skipped' THEN 'Resolve setup prerequisites, then rerun validation.' ELSE suggested_action END
        AS recommended_human_action FROM c"""
    o["suggestions"] = f"""{TRIAGE_CTE} SELECT {k}, suggestion_id, suggestion_type, target_path, confidence,
      proposed_change, reason, evidence FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY seq) rn FROM s) WHERE rn <= 20"""
    o["suggestions_capped"] = f"""{TRIAGE_CTE} SELECT {k}, suggestion_id, CAST(rn AS INTEGER) AS suggestion_rank
      FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY seq) rn FROM s) WHERE rn <= 2"""
    o["recommendations"] = f"""{TRIAGE_CTE} SELECT {k}, recommendation_id, priority, category, linked_finding_ids FROM recs"""
    o["recommendations_clean"] = f"""{TRIAGE_CTE} SELECT {k}, recommendation_id, priority, category,
      CAST(CASE WHEN linked_finding_ids = '' THEN 0 ELSE length(linked_finding_ids) - length(replace(linked_finding_ids, ',', '')) + 1 END AS INTEGER) AS linked_count
      FROM recs WHERE run_id = 'r_nation'"""
    o["overall_status"] = f"""{TRIAGE_CTE} SELECT r.run_id, r.dataset_name, r.slice,
      CASE WHEN coalesce(pk.fe, false) THEN 'Failed' WHEN coalesce(pk.n, 0) > 0 THEN 'Review needed' ELSE 'Passed' END
        AS overall_status FROM runs r LEFT JOIN pk USING (run_id, dataset_name, slice)"""
    o["report_status"] = f"""{TRIAGE_CTE} SELECT r.run_id, r.dataset_name, r.slice,
      CASE WHEN coalesce(pk.fe, false) THEN 'Failed' WHEN coalesce(pk.rv, false) THEN 'Review needed' ELSE 'Passed' END
        AS report_status FROM runs r LEFT JOIN pk USING (run_id, dataset_name, slice)"""
    o["gate"] = f"""{TRIAGE_CTE} SELECT r.run_id, r.dataset_name, r.slice, p.fail_on,
      CASE p.fail_on WHEN 'error' THEN coalesce(pk.fe, false) WHEN 'warning' THEN coalesce(pk.fw, false) ELSE false END
        AS should_fail
      FROM runs r LEFT JOIN pk USING (run_id, dataset_name, slice), (VALUES ('error'), ('warning'), ('never')) p(fail_on)"""
    o["finding_counts"] = f"""{TRIAGE_CTE} SELECT {k}, dimension, value, count(*) AS count FROM (
        SELECT {k}, 'severity' AS dimension, severity AS value FROM c
        UNION ALL SELECT {k}, 'status', status FROM c UNION ALL SELECT {k}, 'rule_type', rule_type FROM c
        UNION ALL SELECT {k}, 'compatibility', compatibility FROM c UNION ALL SELECT {k}, 'priority', priority FROM c
        UNION ALL SELECT {k}, 'review_category', review_category FROM c) GROUP BY ALL"""
    o["suggestion_counts"] = f"""{TRIAGE_CTE} SELECT {k}, suggestion_type, count(*) AS count FROM s GROUP BY ALL"""
    o["run_summary"] = f"""{TRIAGE_CTE} SELECT r.run_id, r.dataset_name, r.slice, r.row_count,
      CAST(cc.ncol AS INTEGER) AS column_count,
      count(f.finding_id) AS total_findings, count(*) FILTER (f.severity = 'error') AS errors,
      count(*) FILTER (f.severity = 'warning') AS warnings, count(*) FILTER (f.severity = 'info') AS infos,
      count(*) FILTER (f.status = 'skipped') AS skipped
      FROM runs r JOIN cc ON cc.ds = r.dataset_name LEFT JOIN f USING (run_id, dataset_name, slice)
      GROUP BY r.run_id, r.dataset_name, r.slice, r.row_count, cc.ncol"""
    o["high_priority"] = f"""{TRIAGE_CTE} SELECT {k}, finding_id, rule_type, col AS "column", message,
      CASE WHEN status = 'skipped' THEN 'Resolve setup prerequisites, then rerun validation.' ELSE suggested_action END
        AS recommended_human_action FROM c WHERE priority = 'high'"""
    o["redacted_summary"] = f"""{TRIAGE_CTE},
      dims AS (SELECT {k}, dimension, value, count(*) n FROM (
        SELECT {k}, 'severity' dimension, severity value FROM c UNION ALL SELECT {k}, 'rule_type', rule_type FROM c
        UNION ALL SELECT {k}, 'priority', priority FROM c) GROUP BY ALL),
      agg AS (SELECT {k},
        string_agg(value || '=' || n, ',' ORDER BY value) FILTER (dimension = 'severity') AS counts_by_severity,
        string_agg(value || '=' || n, ',' ORDER BY value) FILTER (dimension = 'rule_type') AS counts_by_rule_type,
        string_agg(value || '=' || n, ',' ORDER BY value) FILTER (dimension = 'priority') AS counts_by_priority,
        sum(n) FILTER (dimension = 'severity') AS total
        FROM dims GROUP BY ALL),
      sg AS (SELECT {k}, string_agg(suggestion_id, ',' ORDER BY seq) AS suggestion_ids FROM s GROUP BY ALL),
      rc AS (SELECT {k}, string_agg(recommendation_id, ',' ORDER BY rec_order) AS recommendation_ids FROM recs GROUP BY ALL)
      SELECT r.run_id, r.dataset_name, r.slice, CAST(coalesce(agg.total, 0) AS BIGINT) AS total_findings,
        agg.counts_by_severity, agg.counts_by_rule_type, agg.counts_by_priority, sg.suggestion_ids, rc.recommendation_ids
      FROM runs r LEFT JOIN agg USING (run_id, dataset_name, slice) LEFT JOIN sg USING (run_id, dataset_name, slice)
        LEFT JOIN rc USING (run_id, dataset_name, slice)"""


_build()
