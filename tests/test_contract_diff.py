"""Differences of two contract versions."""

from core_helpers import contract, rules_of

from tablepact.operators.contract_diff import contract_diff


def changes(spark, old, new):
    rows = contract_diff(rules_of(spark, old), rules_of(spark, new)).collect()
    return {(r["rule_type"], ",".join(r["columns"]), r["change"], ",".join(r["fields"])) for r in rows}


def test_added_removed_changed_and_equal(spark):
    old = contract({"a": {"type": "integer", "min": 1, "max": 9}, "b": {"pattern": "x+"}, "c": {"allowed_values": ["p"]}})
    new = contract({"c": {"allowed_values": ["p", "q"]}, "a": {"type": "number", "min": 1, "max": 10, "severity": "info"}, "b": {"nullable": False}})
    assert changes(spark, old, old) == set()
    got = changes(spark, old, new)
    assert {("range_violation", "a", "changed", "max_text,severity"), ("type_mismatch", "a", "changed", "expected_type,severity"),
            ("pattern_violation", "b", "removed", ""), ("nullability_violation", "b", "added", ""),
            ("allowed_values_violation", "c", "changed", "allowed_values")} <= got
    # the order of declared columns is part of what an unexpected column is told against
    assert got - {("unexpected_column", "", "changed", "declared_columns"), ("missing_required_column", "a", "changed", "severity")} == {
        g for g in got if g[0] in ("range_violation", "type_mismatch", "pattern_violation", "nullability_violation", "allowed_values_violation")}


def test_repeated_rules_and_empty_versions(spark):
    twice = [{"name": "k", "columns": ["a"], "severity": "info"}, {"name": "k", "columns": ["a"], "severity": "error"}]
    old, new = contract({"a": {}}, uniqueness=twice), contract({"a": {}}, uniqueness=twice[::-1] + [{"name": "k", "columns": ["a"], "severity": "warning"}])
    rows = contract_diff(rules_of(spark, old), rules_of(spark, new)).collect()
    assert [(r["rule_type"], r["change"], r["new"]["severity"]) for r in rows] == [("uniqueness_violation", "added", "warning")]
    none = rules_of(spark, old).limit(0)
    assert {r["change"] for r in contract_diff(none, rules_of(spark, new)).collect()} == {"added"}
    assert contract_diff(none, none).collect() == []
