"""What changed between two versions of contracts: rules added, removed or changed.

Both versions are tables of ``contract_rules`` of any number of contracts; they meet in one full outer join on
(contract, rule type, columns, rule name), nulls equal.  Contracts of one name are one contract, whatever version they
state.  A rule that a version holds several times is matched in the order of its values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["contract_name", "rule_type", "columns", "rule_name"]
#: What a rule of each type says beside its severity; other fields of the row belong to its column's other rules.
FIELDS = {
    "type_mismatch": ["expected_type"],
    "allowed_values_violation": ["allowed_values"],
    "range_violation": ["min_text", "max_text"],
    "pattern_violation": ["pattern"],
    "length_violation": ["min_length", "max_length"],
    "freshness_violation": ["max_age_days"],
    "row_count_violation": ["min_rows", "max_rows"],
    "unexpected_column": ["declared_columns"],
}


def _said(rules: DataFrame, version: str) -> DataFrame:
    """Key, place among equal keys, version and what each rule says: field -> JSON text, fields without a value left out."""
    pairs = ["struct('severity' AS field, severity AS value)"]
    for rule, fields in FIELDS.items():
        for f in fields:
            nested = f in ("allowed_values", "declared_columns")
            value = f"to_json({f})" if nested else f"CAST({f} AS STRING)"
            pairs.append(f"struct('{f}' AS field, CASE WHEN rule_type = '{rule}' THEN {value} END AS value)")
    said = F.expr(f"map_from_entries(filter(array({', '.join(pairs)}), p -> p.value IS NOT NULL))")
    rows = rules.select(*KEY, F.col("contract_version").alias(f"{version}_version"), said.alias(version))
    place = Window.partitionBy(*KEY).orderBy(F.to_json(version))
    return rows.withColumn("place", F.row_number().over(place))


def contract_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(KEY, change, fields, old_version, new_version, old, new) for every rule that is not the same in both versions.

    ``change`` is ``added``, ``removed`` or ``changed``; ``fields`` are the names of what differs, sorted (empty unless
    changed); ``old`` and ``new`` map field to value.  Bounds are compared as written, so 1 and 1.0 differ; the order of
    columns and rules within a document says nothing.
    """
    a, b = _said(old, "old").alias("a"), _said(new, "new").alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*KEY, "place"]]
    both = a.join(b, on, "full_outer").select(
        *[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in KEY], "old_version", "new_version", "old", "new")
    names = "array_union(map_keys(old), map_keys(new))"
    differs = f"array_sort(filter({names}, f -> NOT (old[f] <=> new[f])))"
    both = both.withColumn("fields", F.expr(f"CASE WHEN old IS NULL OR new IS NULL THEN CAST(array() AS ARRAY<STRING>) ELSE {differs} END"))
    both = both.withColumn("change", F.expr("CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN size(fields) > 0 THEN 'changed' END"))
    return both.where("change IS NOT NULL").select(*KEY, "change", "fields", "old_version", "new_version", "old", "new")
