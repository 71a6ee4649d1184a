"""Contract documents -> ``contract_rules`` / ``contract_header`` / lint rows.

Contracts arrive as JSON text rows (column ``doc``), any number of them.
Parsing is Spark's own: ``try_parse_json`` to VARIANT, ``try_variant_get`` for
fields, ``variant_explode`` for the column map and the uniqueness list.
VARIANT sorts object keys, so a column's position in the document comes from
``json_object_keys`` over the raw text, which keeps document order.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tablepact.functions.values import FINITE_RE, lit

# Default severity of each rule type when neither the column,
# the rule nor the contract's dataset section sets one.
DEFAULT_SEVERITY = {
    "missing_required_column": "error",
    "unexpected_column": "warning",
    "type_mismatch": "error",
    "nullability_violation": "error",
    "uniqueness_violation": "error",
    "allowed_values_violation": "error",
    "range_violation": "error",
    "pattern_violation": "warning",
    "length_violation": "error",
    "freshness_violation": "warning",
    "row_count_violation": "warning",
}

# Order in which rule families are evaluated and reported (1-based).
RULE_ORDER = {rule: i + 1 for i, rule in enumerate(DEFAULT_SEVERITY)}

# Accepted severities and logical types.
SEVERITIES = ("error", "warning", "info")
TYPES = ("string", "integer", "number", "boolean", "date", "datetime")

RULES_SCHEMA = (
    "contract_name string, contract_version string, rule_type string, rule_order int, "
    "position int, rule_name string, columns array<string>, column_severity string, "
    "rule_severity string, dataset_severity string, severity string, expected_type string, "
    "allowed_values array<struct<value:string,kind:string>>, min_value double, max_value double, "
    "min_text string, max_text string, "
    "pattern string, min_length int, max_length int, max_age_days int, min_rows bigint, "
    "max_rows bigint, declared_columns array<string>"
)


def contracts_frame(spark: SparkSession, docs: list[str] | list[dict]) -> DataFrame:
    """Small helper: contract documents (JSON text or dicts) as a ``doc`` column."""
    rows = [(d if isinstance(d, str) else json.dumps(d),) for d in docs]
    return spark.createDataFrame(rows, "doc string")


def _sql_map(d: dict[str, str]) -> str:
    return "map(" + ", ".join(f"'{k}', '{v}'" for k, v in d.items()) + ")"


def _truthy(variant: str, default: str) -> str:
    """A flag as the document's language reads it: absent gives the default; null, zero and empty are false."""
    kind = f"schema_of_variant({variant})"
    return f"""(CASE WHEN {variant} IS NULL THEN {default}
        WHEN {kind} IN ('VOID', 'OBJECT<>') OR {kind} LIKE 'ARRAY<VOID>' THEN false
        WHEN {kind} = 'BOOLEAN' THEN try_variant_get({variant}, '$', 'boolean')
        WHEN {kind} = 'STRING' THEN try_variant_get({variant}, '$', 'string') <> ''
        WHEN {kind} LIKE 'ARRAY%' OR {kind} LIKE 'OBJECT%' THEN true
        ELSE coalesce(try_variant_get({variant}, '$', 'double') <> 0, true) END)"""


def _flag(of: str, path: str, default: str) -> str:
    return _truthy(f"try_variant_get({of}, '{path}', 'variant')", default)


def _bound(of: str, path: str) -> str:
    """A range bound as a number's text: a number, a number's text, or a flag (1 or 0); null for anything else."""
    variant, text = f"try_variant_get({of}, '{path}', 'variant')", f"try_variant_get({of}, '{path}', 'string')"
    return f"""(CASE WHEN schema_of_variant({variant}) = 'BOOLEAN' THEN CASE WHEN {text} = 'true' THEN '1' ELSE '0' END
        WHEN btrim({text}) RLIKE {lit(FINITE_RE)} THEN btrim({text}) END)"""


def _parsed(spark: SparkSession, contracts: DataFrame) -> DataFrame:
    return spark.sql(
        f"""
        SELECT doc, v,
          try_variant_get(v, '$.contract.name', 'string') AS contract_name,
          try_variant_get(v, '$.contract.version', 'string') AS contract_version,
          try_variant_get(v, '$.dataset.severity_defaults', 'map<string,string>') AS sev_defaults,
          {_flag('v', '$.schema.allow_unexpected_columns', 'false')} AS allow_unexpected,
          json_object_keys(get_json_object(doc, '$.columns')) AS column_order
        FROM (SELECT doc, try_parse_json(doc) AS v FROM {{contracts}})
        """,
        contracts=contracts,
    )


def contract_rules(spark: SparkSession, contracts: DataFrame) -> DataFrame:
    """One row per declared rule of every contract document (schema ``RULES_SCHEMA``).

    Documents that fail lint still produce whatever rules parse; gate on
    ``contract_lint`` first when that matters.
    """
    parsed = _parsed(spark, contracts)
    cols = spark.sql(
        f"""
        SELECT p.contract_name, p.contract_version, p.sev_defaults, p.allow_unexpected,
          c.key AS column, CAST(array_position(p.column_order, c.key) AS int) - 1 AS position,
          c.value AS cv,
          {_flag('c.value', '$.required', 'true')} AS required,
          {_flag('c.value', '$.nullable', 'true')} AS nullable,
          {_flag('c.value', '$.unique', 'false')} AS is_unique,
          try_variant_get(c.value, '$.type', 'string') AS expected_type,
          try_variant_get(c.value, '$.severity', 'string') AS column_severity,
          transform(try_variant_get(c.value, '$.allowed_values', 'array<variant>'),
            x -> named_struct('value', try_variant_get(x, '$', 'string'),
                 'kind', CASE WHEN schema_of_variant(x) = 'STRING' THEN 'text'
                              WHEN schema_of_variant(x) = 'BOOLEAN' THEN 'boolean'
                              WHEN schema_of_variant(x) IN ('BIGINT', 'INT', 'SMALLINT', 'TINYINT',
                                   'DOUBLE', 'FLOAT') OR schema_of_variant(x) LIKE 'DECIMAL%'
                                THEN 'number'
                              ELSE 'other' END)) AS allowed_values,
          try_cast({_bound('c.value', '$.min')} AS double) AS min_value,
          try_cast({_bound('c.value', '$.max')} AS double) AS max_value,
          {_bound('c.value', '$.min')} AS min_text,
          {_bound('c.value', '$.max')} AS max_text,
          try_variant_get(c.value, '$.pattern', 'string') AS pattern,
          try_variant_get(c.value, '$.min_length', 'int') AS min_length,
          try_variant_get(c.value, '$.max_length', 'int') AS max_length,
          try_variant_get(c.value, '$.freshness.max_age_days', 'int') AS max_age_days
        FROM {{parsed}} p, LATERAL variant_explode(try_variant_get(p.v, '$.columns', 'variant')) c
        WHERE p.contract_name IS NOT NULL
        """,
        parsed=parsed,
    )
    col_rules = spark.sql(
        """
        SELECT contract_name, contract_version, sev_defaults, rule_type, position,
          CASE WHEN rule_type = 'uniqueness_violation' THEN concat('column_unique:', column) END AS rule_name,
          array(column) AS columns, column_severity, CAST(NULL AS string) AS rule_severity, expected_type,
          allowed_values, min_value, max_value, min_text, max_text, pattern, min_length, max_length, max_age_days
        FROM {cols} LATERAL VIEW explode(filter(array(
          CASE WHEN required THEN 'missing_required_column' END,
          CASE WHEN expected_type IS NOT NULL AND expected_type <> '' THEN 'type_mismatch' END,
          CASE WHEN NOT nullable THEN 'nullability_violation' END,
          CASE WHEN is_unique THEN 'uniqueness_violation' END,
          CASE WHEN coalesce(size(allowed_values), 0) > 0 THEN 'allowed_values_violation' END,
          CASE WHEN min_value IS NOT NULL OR max_value IS NOT NULL THEN 'range_violation' END,
          CASE WHEN pattern IS NOT NULL AND pattern <> '' THEN 'pattern_violation' END,
          CASE WHEN min_length IS NOT NULL OR max_length IS NOT NULL THEN 'length_violation' END,
          CASE WHEN max_age_days IS NOT NULL THEN 'freshness_violation' END
        ), x -> x IS NOT NULL)) r AS rule_type
        """,
        cols=cols,
    )

    list_rules = spark.sql(
        """
        SELECT p.contract_name, p.contract_version, p.sev_defaults,
          'uniqueness_violation' AS rule_type, size(p.column_order) + CAST(u.pos AS int) AS position,
          try_variant_get(u.value, '$.name', 'string') AS rule_name,
          try_variant_get(u.value, '$.columns', 'array<string>') AS columns,
          CAST(NULL AS string) AS column_severity,
          try_variant_get(u.value, '$.severity', 'string') AS rule_severity
        FROM {parsed} p,
          LATERAL variant_explode_outer(try_variant_get(p.v, '$.uniqueness', 'variant')) u
        WHERE p.contract_name IS NOT NULL AND u.value IS NOT NULL
        """,
        parsed=parsed,
    )
    table_rules = spark.sql(
        """
        SELECT contract_name, contract_version, sev_defaults, 'unexpected_column' AS rule_type,
          0 AS position, array_sort(column_order) AS declared_columns,
          CAST(NULL AS bigint) AS min_rows, CAST(NULL AS bigint) AS max_rows,
          CAST(NULL AS string) AS rule_severity
        FROM {parsed} WHERE contract_name IS NOT NULL AND NOT allow_unexpected
        UNION ALL
        SELECT contract_name, contract_version, sev_defaults, 'row_count_violation', 0,
          CAST(NULL AS array<string>),
          try_variant_get(v, '$.row_count.min', 'bigint'), try_variant_get(v, '$.row_count.max', 'bigint'),
          try_variant_get(v, '$.row_count.severity', 'string')
        FROM {parsed}
        WHERE contract_name IS NOT NULL AND (try_variant_get(v, '$.row_count.min', 'bigint') IS NOT NULL
          OR try_variant_get(v, '$.row_count.max', 'bigint') IS NOT NULL)
        """,
        parsed=parsed,
    )
    every = col_rules.unionByName(list_rules, allowMissingColumns=True).unionByName(
        table_rules, allowMissingColumns=True
    )
    rule_order = _sql_map({k: str(v) for k, v in RULE_ORDER.items()})
    defaults = _sql_map(DEFAULT_SEVERITY)
    return spark.sql(
        f"""
        SELECT contract_name, contract_version, rule_type,
          CAST({rule_order}[rule_type] AS int) AS rule_order, position,
          CASE WHEN rule_type = 'uniqueness_violation' THEN rule_name END AS rule_name,
          coalesce(columns, array()) AS columns, column_severity, rule_severity,
          sev_defaults[rule_type] AS dataset_severity,
          coalesce(column_severity, rule_severity, sev_defaults[rule_type], {defaults}[rule_type]) AS severity,
          expected_type, allowed_values, min_value, max_value, min_text, max_text, pattern, min_length, max_length,
          max_age_days, min_rows, max_rows, declared_columns
        FROM {{every}}
        """,
        every=every,
    )


def contract_header(spark: SparkSession, contracts: DataFrame) -> DataFrame:
    """Contract identity fields; dataset fields are carried but read by no rule."""
    return spark.sql(
        f"""
        SELECT try_variant_get(v, '$.contract.name', 'string') AS contract_name,
          try_variant_get(v, '$.contract.version', 'string') AS contract_version,
          try_variant_get(v, '$.contract.owner', 'string') AS owner,
          try_variant_get(v, '$.contract.description', 'string') AS description,
          try_variant_get(v, '$.dataset.expected_name', 'string') AS expected_name,
          try_variant_get(v, '$.dataset.format', 'string') AS format,
          try_variant_get(v, '$.dataset.grain', 'string') AS grain,
          {_flag('v', '$.schema.allow_unexpected_columns', 'false')} AS allow_unexpected_columns
        FROM (SELECT try_parse_json(doc) AS v FROM {{contracts}})
        """,
        contracts=contracts,
    )


def contract_lint(spark: SparkSession, contracts: DataFrame) -> DataFrame:
    """Every structural problem of every document: (contract_name, path, problem).

    The checks are the load-time checks of a contract document; where the
    original stops at the first problem this lists all of them.
    """
    sev = "(" + ", ".join(f"'{s}'" for s in SEVERITIES) + ")"
    types = "(" + ", ".join(f"'{t}'" for t in TYPES) + ")"
    base = spark.sql(
        """
        SELECT doc, v, try_variant_get(v, '$.contract.name', 'string') AS contract_name,
          schema_of_variant(v) AS t_doc,
          schema_of_variant(try_variant_get(v, '$.contract', 'variant')) AS t_contract,
          schema_of_variant(try_variant_get(v, '$.dataset', 'variant')) AS t_dataset,
          schema_of_variant(try_variant_get(v, '$.dataset.severity_defaults', 'variant')) AS t_sevdef,
          schema_of_variant(try_variant_get(v, '$.schema', 'variant')) AS t_schema,
          schema_of_variant(try_variant_get(v, '$.columns', 'variant')) AS t_columns,
          schema_of_variant(try_variant_get(v, '$.row_count', 'variant')) AS t_rowcount,
          schema_of_variant(try_variant_get(v, '$.uniqueness', 'variant')) AS t_uniq
        FROM (SELECT doc, try_parse_json(doc) AS v FROM {contracts})
        """,
        contracts=contracts,
    )
    doc_level = spark.sql(
        """
        SELECT contract_name, p.path, p.problem FROM {base} LATERAL VIEW inline(array(
          named_struct('bad', v IS NULL, 'path', '$', 'problem', 'document is not parseable JSON'),
          named_struct('bad', v IS NOT NULL AND t_doc NOT LIKE 'OBJECT%', 'path', '$',
            'problem', 'top level must be an object'),
          named_struct('bad', v IS NOT NULL AND t_doc LIKE 'OBJECT%' AND coalesce(t_contract, 'VOID') NOT LIKE 'OBJECT%',
            'path', '$.contract', 'problem', 'missing required contract object'),
          named_struct('bad', t_contract LIKE 'OBJECT%' AND coalesce(contract_name, '') = '',
            'path', '$.contract.name', 'problem', 'missing required field contract.name'),
          named_struct('bad', coalesce(t_dataset, 'VOID') NOT IN ('VOID') AND t_dataset NOT LIKE 'OBJECT%',
            'path', '$.dataset', 'problem', 'dataset must be an object'),
          named_struct('bad', coalesce(t_sevdef, 'VOID') NOT IN ('VOID') AND t_sevdef NOT LIKE 'OBJECT%',
            'path', '$.dataset.severity_defaults', 'problem', 'severity_defaults must be an object'),
          named_struct('bad', coalesce(t_schema, 'VOID') NOT IN ('VOID') AND t_schema NOT LIKE 'OBJECT%',
            'path', '$.schema', 'problem', 'schema must be an object'),
          named_struct('bad', v IS NOT NULL AND t_doc LIKE 'OBJECT%' AND (coalesce(t_columns, 'VOID') NOT LIKE 'OBJECT%'
              OR t_columns = 'OBJECT<>'),
            'path', '$.columns', 'problem', 'missing required columns section with at least one column'),
          named_struct('bad', coalesce(t_rowcount, 'VOID') NOT IN ('VOID') AND t_rowcount NOT LIKE 'OBJECT%',
            'path', '$.row_count', 'problem', 'row_count must be an object'),
          named_struct('bad', t_rowcount LIKE 'OBJECT%' AND try_variant_get(v, '$.row_count.min', 'double') < 0,
            'path', '$.row_count.min', 'problem', 'row_count.min must not be negative'),
          named_struct('bad', t_rowcount LIKE 'OBJECT%' AND try_variant_get(v, '$.row_count.max', 'double') < 0,
            'path', '$.row_count.max', 'problem', 'row_count.max must not be negative'),
          named_struct('bad', t_rowcount LIKE 'OBJECT%'
              AND try_variant_get(v, '$.row_count.min', 'double') > try_variant_get(v, '$.row_count.max', 'double'),
            'path', '$.row_count', 'problem', 'row_count.min must not be greater than row_count.max'),
          named_struct('bad', t_rowcount LIKE 'OBJECT%'
              AND try_variant_get(v, '$.row_count.severity', 'string') NOT IN """ + sev + """,
            'path', '$.row_count.severity', 'problem', 'invalid severity'),
          named_struct('bad', coalesce(t_uniq, 'VOID') NOT IN ('VOID') AND t_uniq NOT LIKE 'ARRAY%',
            'path', '$.uniqueness', 'problem', 'uniqueness must be a list')
        )) p WHERE p.bad
        """,
        base=base,
    )
    sev_level = spark.sql(
        """
        SELECT b.contract_name, concat('$.dataset.severity_defaults.', s.key) AS path,
          'invalid severity' AS problem
        FROM {base} b, LATERAL variant_explode(try_variant_get(b.v, '$.dataset.severity_defaults', 'variant')) s
        WHERE b.t_sevdef LIKE 'OBJECT%' AND schema_of_variant(s.value) <> 'VOID'
          AND coalesce(try_variant_get(s.value, '$', 'string'), '') NOT IN """ + sev,
        base=base,
    )
    col_level = spark.sql(
        """
        SELECT contract_name, concat('$.columns.', column, p.suffix) AS path, p.problem
        FROM (
          SELECT b.contract_name, c.key AS column, c.value AS cv, schema_of_variant(c.value) AS t_col,
            schema_of_variant(try_variant_get(c.value, '$.freshness', 'variant')) AS t_fresh,
            schema_of_variant(try_variant_get(c.value, '$.freshness.max_age_days', 'variant')) AS t_age
          FROM {base} b, LATERAL variant_explode(try_variant_get(b.v, '$.columns', 'variant')) c
          WHERE b.t_columns LIKE 'OBJECT%'
        ) LATERAL VIEW inline(array(
          named_struct('bad', t_col NOT LIKE 'OBJECT%', 'suffix', '', 'problem', 'column definition must be an object'),
          named_struct('bad', t_col LIKE 'OBJECT%' AND schema_of_variant(try_variant_get(cv, '$.type', 'variant')) <> 'VOID'
              AND coalesce(try_variant_get(cv, '$.type', 'string'), '') NOT IN """ + types + """,
            'suffix', '.type', 'problem', 'unsupported logical type'),
          named_struct('bad', t_col LIKE 'OBJECT%' AND schema_of_variant(try_variant_get(cv, '$.severity', 'variant')) <> 'VOID'
              AND coalesce(try_variant_get(cv, '$.severity', 'string'), '') NOT IN """ + sev + """,
            'suffix', '.severity', 'problem', 'invalid severity'),
          named_struct('bad', t_col LIKE 'OBJECT%' AND coalesce(t_fresh, 'VOID') <> 'VOID' AND t_fresh NOT LIKE 'OBJECT%',
            'suffix', '.freshness', 'problem', 'freshness rule must be an object'),
          named_struct('bad', t_fresh LIKE 'OBJECT%' AND NOT (
              (coalesce(t_age, 'VOID') IN ('BIGINT', 'INT', 'SMALLINT', 'TINYINT')
                AND try_variant_get(cv, '$.freshness.max_age_days', 'bigint') > 0)
              OR (t_age = 'BOOLEAN' AND try_variant_get(cv, '$.freshness.max_age_days', 'boolean'))),
            'suffix', '.freshness.max_age_days', 'problem', 'max_age_days must be a positive integer'),
          named_struct('bad', t_fresh LIKE 'OBJECT%'
              AND coalesce(try_variant_get(cv, '$.freshness.reference', 'string'), 'max_value') <> 'max_value',
            'suffix', '.freshness.reference', 'problem', 'freshness reference must be max_value'),
          named_struct('bad', t_col LIKE 'OBJECT%'
              AND schema_of_variant(try_variant_get(cv, '$.allowed_values', 'variant')) NOT IN ('VOID')
              AND schema_of_variant(try_variant_get(cv, '$.allowed_values', 'variant')) NOT LIKE 'ARRAY%',
            'suffix', '.allowed_values', 'problem', 'allowed_values must be a list'),
          """ + ",\n          ".join(f"""named_struct('bad', t_col LIKE 'OBJECT%'
              AND schema_of_variant(try_variant_get(cv, '$.{b}', 'variant')) <> 'VOID' AND {_bound('cv', f'$.{b}')} IS NULL,
            'suffix', '.{b}', 'problem', '{b} must be a number')""" for b in ("min", "max")) + """
        )) p WHERE p.bad
        """,
        base=base,
    )
    uniq_level = spark.sql(
        """
        SELECT contract_name, concat('$.uniqueness[', pos, ']', p.suffix) AS path, p.problem
        FROM (
          SELECT b.contract_name, u.pos, u.value AS uv, schema_of_variant(u.value) AS t_item,
            try_variant_get(u.value, '$.columns', 'array<variant>') AS cols
          FROM {base} b, LATERAL variant_explode(try_variant_get(b.v, '$.uniqueness', 'variant')) u
          WHERE b.t_uniq LIKE 'ARRAY%'
        ) LATERAL VIEW inline(array(
          named_struct('bad', t_item NOT LIKE 'OBJECT%', 'suffix', '', 'problem', 'uniqueness item must be an object'),
          named_struct('bad', t_item LIKE 'OBJECT%' AND coalesce(try_variant_get(uv, '$.name', 'string'), '') = '',
            'suffix', '.name', 'problem', 'uniqueness name is required'),
          named_struct('bad', t_item LIKE 'OBJECT%' AND NOT coalesce(size(cols) > 0 AND forall(cols,
              x -> schema_of_variant(x) = 'STRING' AND try_variant_get(x, '$', 'string') <> ''), false),
            'suffix', '.columns', 'problem', 'columns must be a non-empty list of column names'),
          named_struct('bad', t_item LIKE 'OBJECT%'
              AND schema_of_variant(try_variant_get(uv, '$.severity', 'variant')) <> 'VOID'
              AND coalesce(try_variant_get(uv, '$.severity', 'string'), '') NOT IN """ + sev + """,
            'suffix', '.severity', 'problem', 'invalid severity')
        )) p WHERE p.bad
        """,
        base=base,
    )
    return doc_level.unionByName(sev_level).unionByName(col_level).unionByName(uniq_level)
