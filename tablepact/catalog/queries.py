"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Outputs are flat, typed, aliased columns so an independent SQL engine can
reproduce them (see ``catalog.oracle``).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.catalog import inputs as I
from tablepact.operators import review, summaries, triage
from tablepact.operators.profile import profile, profile_summary
from tablepact.session import ensure_checkpoint_dir
from tablepact.sources.tables import dataset_facts, read_table

Query = Callable[[SparkSession, str], DataFrame]


def _ev(name: str, typ: str = "bigint") -> Column:
    return F.get_json_object(F.col("evidence"), f"$.{name}").cast(typ).alias(name)


def _head(df: DataFrame) -> list[Column]:
    return [F.col("dataset_name"), F.col("finding_id"), F.col("rule_type"), F.col("severity"), F.col("status")]


def _findings(spark, df, name, contract, **kw) -> DataFrame:
    """All findings of a contract, whole, with their evidence."""
    v = I.run(spark, df, contract, dataset_name=name, reference_date=I.ORDERS_REFERENCE_DATE, **kw)
    return v.findings.select("dataset_name", "finding_id", "rule_type", "severity", "status", "message", "evidence", "suggested_action")


def _rule(spark, df, name, contract, rule_type, extra, **kw) -> DataFrame:
    kw.setdefault("reference_date", I.ORDERS_REFERENCE_DATE)
    v = I.run(spark, df, contract, dataset_name=name, rule_types=[rule_type], **kw)
    f = v.findings.where(F.col("rule_type") == rule_type)
    return f.select(*_head(f), *extra)


def _contract(name: str, columns: dict, **top) -> dict:
    doc = {"contract": {"name": name, "version": "1"}, "schema": {"allow_unexpected_columns": True},
           "columns": columns}
    doc.update(top)
    return doc


# -- dataset facts, profile ------------------------------------------------------

def q_dataset_facts(spark, sf):
    f = dataset_facts(I.table(spark, sf, "customer"), "customer")
    return f.select("dataset_name", "row_count", "column_count", F.array_join("columns", ",").alias("columns"))


def q_profile_nulls(spark, sf):
    p = profile(I.dirty_customer(spark, sf), frequency_columns=[])
    return p.select("column", "row_count", "null_count", "non_null_count", "null_percentage")


def q_profile_observed_type(spark, sf):
    p = profile(I.text_orders(spark, sf), frequency_columns=[])
    return p.select("column", "observed_type")


def _part_profile(spark, sf):
    part = I.table(spark, sf, "part").select("p_brand", "p_type", "p_size")
    return profile(part)


def q_profile_distinct(spark, sf):
    return _part_profile(spark, sf).select("column", "distinct_count")


def q_profile_top_values(spark, sf):
    p = _part_profile(spark, sf)
    return p.select("column", F.posexplode("top_values").alias("pos", "tv")).select(
        "column", (F.col("pos") + 1).alias("rank"), F.col("tv.value").alias("value"),
        F.col("tv.count").alias("count"))


def q_profile_top_values_text(spark, sf):
    """Top values and samples of long text and of a flag; texts by their md5."""
    return _text_lists(profile(I.table(spark, sf, "documents").select("text", "lang")))


def q_profile_samples_shared_prefix(spark, sf):
    """The same for texts with one start of 301 characters, as pages have."""
    return _text_lists(profile(I.table(spark, sf, "documents").selectExpr("repeat('<head/>', 43) || text AS text")))


def _text_lists(p: DataFrame) -> DataFrame:
    top = p.select("column", F.lit("top").alias("list"), F.posexplode("top_values").alias("pos", "e")).select(
        "column", "list", "pos", F.md5("e.value").alias("value_md5"), F.col("e.count").alias("count"))
    sample = p.select("column", F.lit("sample").alias("list"), F.posexplode("sample_values").alias("pos", "v")).select(
        "column", "list", "pos", F.md5("v").alias("value_md5"), F.lit(None).cast("bigint").alias("count"))
    sizes = p.select("column", F.lit("distinct").alias("list"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("value_md5"),
                     F.col("distinct_count").alias("count"))
    return top.unionByName(sample).unionByName(sizes)


def q_profile_samples_ordered(spark, sf):
    """The first values in row order."""
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    p = profile(o, frequency_columns=["o_orderstatus", "o_orderpriority"], order_by=["o_orderkey"], sample_values=7)
    return p.where(F.col("column") != "o_orderkey").select("column", F.array_join("sample_values", "|").alias("sample_values"))


def q_profile_samples(spark, sf):
    p = _part_profile(spark, sf)
    return p.select("column", F.posexplode("sample_values").alias("pos", "value")).select(
        "column", (F.col("pos") + 1).alias("rank"), "value")


def q_profile_numeric_range(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    big = profile(I.big_keys(spark, sf).select("big"), frequency_columns=[])
    both = profile(o, frequency_columns=[]).unionByName(big)
    exact = [F.when(F.col("physical_type") == "bigint", F.col(f"numeric_{m}_text")).alias(f"{m}_exact") for m in ("min", "max")]
    return both.select("column", "numeric_min", "numeric_max", *exact)


def q_profile_datetime_range(spark, sf):
    e = I.table(spark, sf, "events").select("ts")
    o = I.table(spark, sf, "orders").select("o_orderdate")
    a = profile(e, frequency_columns=[], dataset_name="events")
    b = profile(o, frequency_columns=[], dataset_name="orders")
    return a.unionByName(b).select("dataset_name", "column", "datetime_min", "datetime_max")


def q_profile_string_length(spark, sf):
    d = I.table(spark, sf, "documents").select("text", "lang", "source")
    return profile(d, frequency_columns=[]).select("column", "string_min_length", "string_max_length")


def _text_list(col: str, render: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(col, render), "|")


def q_profile_full(spark, sf):
    p = profile(I.table(spark, sf, "customer"))
    return p.select(
        "column", "position", "physical_type", "observed_type", "row_count", "null_count", "null_percentage",
        "non_null_count", "distinct_count", "numeric_min", "numeric_max", "datetime_min", "datetime_max",
        "string_min_length", "string_max_length",
        _text_list("top_values", lambda e: F.concat(e["value"], F.lit(":"), e["count"].cast("string"))).alias("top_values"),
        F.array_join("sample_values", "|").alias("sample_values"),
    )


def q_profile_summary(spark, sf):
    return profile_summary(profile(I.table(spark, sf, "customer"))).select(
        "column", "observed_type", "null_count", "distinct_count")


# -- rules ---------------------------------------------------------------------------

def q_v_nullability(spark, sf):
    c = _contract("dirty", {"c_mktsegment": {"nullable": False}})
    return _rule(spark, I.dirty_customer(spark, sf), "customer", c, "nullability_violation",
                 [_ev("null_count"), _ev("row_count"), _ev("null_percentage", "double")])


def q_v_type_mismatch(spark, sf):
    orders = _rule(spark, I.table(spark, sf, "orders"), "orders",
                   _contract("o", {"o_orderdate": {"type": "date"}, "o_totalprice": {"type": "number"},
                                   "o_orderkey": {"type": "number"}, "o_orderstatus": {"type": "integer"}}),
                   "type_mismatch", [_ev("expected_type", "string"), _ev("observed_type", "string")])
    text = _rule(spark, I.text_orders(spark, sf), "text_orders",
                 _contract("t", {"int_txt": {"type": "integer"}, "num_txt": {"type": "integer"},
                                 "bool_txt": {"type": "boolean"}, "date_txt": {"type": "datetime"},
                                 "dt_txt": {"type": "date"}, "zoned_txt": {"type": "date"}, "str_txt": {"type": "string"},
                                 "empty_txt": {"type": "integer"}, "mixed_txt": {"type": "integer"}}),
                 "type_mismatch", [_ev("expected_type", "string"), _ev("observed_type", "string")])
    return orders.unionByName(text)


def q_v_missing_required(spark, sf):
    c = {"contract": {"name": "contacts", "version": "1"}, "schema": {"allow_unexpected_columns": True},
         "columns": {"c_custkey": {}, "c_email": {}, "c_fax": {"severity": "warning"}, "c_pager": {"required": False}},
         "row_count": {"min": 1000000000}}
    return _findings(spark, I.table(spark, sf, "customer"), "customer", c)


def q_v_unexpected(spark, sf):
    c = {"contract": {"name": "parts", "version": "1"}, "columns": {"p_partkey": {}, "p_size": {"max": 10}}}
    return _findings(spark, I.table(spark, sf, "part"), "part", c)


def q_v_row_count(spark, sf):
    v = I.customer_run(spark, sf)
    f = v.findings.where(F.col("rule_type") == "row_count_violation")
    return f.select(*_head(f), _ev("row_count"), _ev("min_allowed"), _ev("max_allowed"))


def q_v_allowed_values(spark, sf):
    extra = [_ev("failed_row_count"),
             F.get_json_object("evidence", "$.unexpected_values").alias("unexpected_values")]
    o = _rule(spark, I.table(spark, sf, "orders"), "orders",
              _contract("o", {"o_orderstatus": {"allowed_values": ["O", "F"]}}), "allowed_values_violation", extra)
    c = _rule(spark, I.table(spark, sf, "customer"), "customer", I.CUSTOMER_CONTRACT, "allowed_values_violation", extra)
    return o.unionByName(c)


def q_v_range(spark, sf):
    extra = [_ev("below_min_count"), _ev("above_max_count"), _ev("observed_min", "double"),
             _ev("observed_max", "double")]
    c = _rule(spark, I.table(spark, sf, "customer"), "customer",
              _contract("c", {"c_acctbal": {"min": 0}}), "range_violation", extra)
    o = _rule(spark, I.table(spark, sf, "orders"), "orders",
              _contract("o", {"o_totalprice": {"max": 400000}}), "range_violation", extra)
    e = _rule(spark, I.table(spark, sf, "events"), "events",
              _contract("e", {"value": {"max": 40}}), "range_violation", extra)
    return c.unionByName(o).unionByName(e)


def q_v_pattern(spark, sf):
    extra = [_ev("failed_row_count"),
             F.array_join(F.from_json(F.get_json_object("evidence", "$.sample_failed_values"), "array<string>"),
                          "|").alias("sample_failed_values")]
    p = _rule(spark, I.table(spark, sf, "pages"), "pages",
              _contract("p", {"url": {"pattern": "https://.*"}}), "pattern_violation", extra)
    e = _rule(spark, I.table(spark, sf, "events"), "events",
              _contract("e", {"props": {"pattern": '\\{"k": [0-9]\\}'}}), "pattern_violation", extra)
    c = _rule(spark, I.table(spark, sf, "customer"), "customer",
              _contract("c", {"c_name": {"pattern": "Customer#[0-9]{9}"}}), "pattern_violation", extra)
    return p.unionByName(e).unionByName(c)


def q_v_pattern_text(spark, sf):
    """Long texts that fail a pattern: their number and, by md5, the smallest of them."""
    samples = F.from_json(F.get_json_object("evidence", "$.sample_failed_values"), "array<string>")
    return _rule(spark, I.table(spark, sf, "documents"), "documents",
                 _contract("d", {"text": {"pattern": "[^|]*"}}), "pattern_violation",
                 [_ev("failed_row_count"), F.array_join(F.transform(samples, F.md5), ",").alias("samples_md5")])


def q_v_pattern_skipped(spark, sf):
    """Patterns that are invalid, that hold and that fail, side by side."""
    c = _contract("c", {"c_name": {"pattern": "["}, "c_mktsegment": {"pattern": "[A-Z]{,8}"},
                        "c_nationkey": {"pattern": "(?P<a_b>[0-9])+"}})
    return _findings(spark, I.table(spark, sf, "customer"), "customer", c)


def q_v_length(spark, sf):
    extra = [_ev("too_short_count"), _ev("too_long_count"), _ev("observed_min_length"), _ev("observed_max_length")]
    p = _rule(spark, I.table(spark, sf, "part"), "part",
              _contract("p", {"p_name": {"min_length": 9, "max_length": 11}}), "length_violation", extra)
    d = _rule(spark, I.table(spark, sf, "documents"), "documents",
              _contract("d", {"text": {"min_length": 20, "max_length": 20000}}), "length_violation", extra)
    return p.unionByName(d)


def _unique_extra() -> list[Column]:
    return [_ev("duplicate_key_count"), _ev("duplicate_row_count")]


def q_v_unique_column(spark, sf):
    """Duplicates of long text and of a number; sample keys by the md5 of their values."""
    def extra(c):
        keys = F.from_json(F.get_json_object("evidence", "$.sample_duplicate_keys"), "array<map<string,string>>")
        return [*_unique_extra(), F.array_join(F.transform(keys, lambda k: F.md5(k[c])), ",").alias("samples_md5")]

    d = _rule(spark, I.table(spark, sf, "documents"), "documents",
              _contract("d", {"text": {"unique": True}}), "uniqueness_violation", extra("text"))
    c = _rule(spark, I.table(spark, sf, "customer"), "customer",
              _contract("c", {"c_nationkey": {"unique": True}, "c_custkey": {"unique": True}}),
              "uniqueness_violation", extra("c_nationkey"))
    return d.unionByName(c)


def q_v_unique_nan(spark, sf):
    """NaN and null are one key."""
    return _rule(spark, I.big_keys(spark, sf), "big_keys", _contract("n", {"part_nan": {"unique": True}}), "uniqueness_violation",
                 _unique_extra())


def q_v_allowed_dates(spark, sf):
    extra = [_ev("failed_row_count"), F.get_json_object("evidence", "$.unexpected_values").alias("unexpected_values")]
    days = ["1995-01-01", "1996/05/05", "1997-02-03T00:00:00", "no date"]
    return _rule(spark, I.big_keys(spark, sf), "big_keys",
                 _contract("d", {"day": {"allowed_values": days}, "moment": {"allowed_values": days}}), "allowed_values_violation", extra)


def q_v_range_bigint(spark, sf):
    """Bounds and allowed values beyond 2^53, compared exactly."""
    base = 1 << 53
    c = _contract("b", {"big": {"min": base + 5, "max": base + 1001}, "dec": {"max": base + 1001}})
    r = _rule(spark, I.big_keys(spark, sf), "big_keys", c, "range_violation",
              [_ev("below_min_count"), _ev("above_max_count"), _ev("observed_min"), _ev("observed_max"), F.lit(None).cast("bigint").alias("failed_row_count")])
    a = _rule(spark, I.big_keys(spark, sf), "big_keys", _contract("b", {"big": {"allowed_values": [base + 1, base + 2, 7]}}),
              "allowed_values_violation", [*[F.lit(None).cast("bigint").alias(n) for n in
                                             ("below_min_count", "above_max_count", "observed_min", "observed_max")], _ev("failed_row_count")])
    return r.unionByName(a)


def q_v_unique_composite(spark, sf):
    extra = _unique_extra() + [F.get_json_object("evidence", "$.sample_duplicate_keys").alias("sample_duplicate_keys")]
    li = _rule(spark, I.table(spark, sf, "lineitem"), "lineitem", I.LINEITEM_KEY_CONTRACT, "uniqueness_violation", extra)
    cv = _rule(spark, I.table(spark, sf, "conversations"), "conversations",
               _contract("cv", {"conv_id": {}}, uniqueness=[{"name": "turn_key", "columns": ["conv_id", "turn"]}]),
               "uniqueness_violation", extra)
    return li.unionByName(cv)


def q_v_unique_skipped(spark, sf):
    """A uniqueness rule that cannot run beside rules that do."""
    c = _contract("l", {"l_orderkey": {}, "l_linenumber": {"max": 3}},
                  uniqueness=[{"name": "bad_key", "columns": ["l_orderkey", "l_missing"]},
                              {"name": "line", "columns": ["l_linenumber"], "severity": "info"}])
    return _findings(spark, I.table(spark, sf, "lineitem"), "lineitem", c)


def q_v_freshness(spark, sf):
    extra = [_ev("latest_value", "string"), _ev("reference_date", "string"), _ev("observed_age_days")]
    o = _rule(spark, I.table(spark, sf, "orders"), "orders",
              _contract("o", {"o_orderdate": {"freshness": {"max_age_days": 30}}}), "freshness_violation", extra,
              reference_date=dt.date(2001, 12, 31))
    e = _rule(spark, I.table(spark, sf, "events"), "events",
              _contract("e", {"ts": {"freshness": {"max_age_days": 30}}}), "freshness_violation", extra,
              reference_date=dt.date(2024, 3, 1))
    t = _rule(spark, I.text_orders(spark, sf), "text_orders",
              _contract("t", {"date_txt": {"freshness": {"max_age_days": 30}}}), "freshness_violation", extra,
              reference_date=dt.date(2001, 12, 31))
    z = _rule(spark, I.text_orders(spark, sf), "text_orders",
              _contract("t", {"zoned_txt": {"freshness": {"max_age_days": 30}}}), "freshness_violation", extra,
              reference_date=dt.date(2001, 12, 31))
    return o.unionByName(e).unionByName(t).unionByName(z)


def q_v_freshness_skipped(spark, sf):
    return _rule(spark, I.table(spark, sf, "customer"), "customer",
                 _contract("c", {"c_name": {"freshness": {"max_age_days": 30}}}), "freshness_violation",
                 [_ev("observed_age_days")], reference_date=dt.date(2001, 12, 31))


def q_severity_resolution(spark, sf):
    c = {
        "contract": {"name": "severity_levels", "version": "1"},
        "dataset": {"severity_defaults": {"range_violation": "warning", "unexpected_column": "info"}},
        "columns": {
            "c_custkey": {"unique": True},
            "c_name": {"pattern": "Customer#[0-9]{3}", "severity": "info"},
            "c_acctbal": {"min": 0},
            "c_mktsegment": {"allowed_values": ["BUILDING"]},
        },
        "uniqueness": [{"name": "nation_seg", "columns": ["c_nationkey", "c_mktsegment"], "severity": "info"}],
        "row_count": {"max": 10, "severity": "error"},
    }
    v = I.run(spark, I.table(spark, sf, "customer"), c, dataset_name="customer",
              reference_date=I.ORDERS_REFERENCE_DATE)
    return v.findings.select("finding_id", "rule_type", "severity", "status")


def q_findings_all(spark, sf):
    v = I.run(spark, I.table(spark, sf, "orders"), I.ORDERS_CONTRACT, dataset_name="orders",
              reference_date=I.ORDERS_REFERENCE_DATE)
    return v.findings.select("finding_id", "rule_type", "severity", "status")


def q_findings_lineitem(spark, sf):
    v = I.run(spark, I.table(spark, sf, "lineitem"), I.LINEITEM_CONTRACT, dataset_name="lineitem",
              reference_date=I.ORDERS_REFERENCE_DATE)
    return v.findings.select("finding_id", "rule_type", "severity", "status")


def q_findings_by_slice(spark, sf):
    a = I.orders_monthly(spark, sf).findings
    b = I.lineitem_by_flag(spark, sf).findings
    f = a.unionByName(b).unionByName(I.sliced_segments(spark, sf).findings)
    return f.select("dataset_name", "slice", "finding_id", "rule_type", "status", _ev("above_max_count"),
                    _ev("row_count"), _ev("duplicate_key_count"), _ev("duplicate_row_count"), _ev("below_min_count"))


def q_src_csv_na_tokens(spark, sf):
    """CSV round trip under the shared checkpoint folder: NA tokens become null; quotes, commas and line feeds stay in their cells."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/csv-{uuid.uuid4().hex}"
    c = I.table(spark, sf, "customer")
    tokens = F.element_at(F.array(F.lit("NA"), F.lit("null"), F.lit("#N/A"), F.lit(""), F.lit("nan")),
                          (F.col("c_custkey") % 5 + 1).cast("int"))
    out = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, tokens).otherwise(F.col("c_mktsegment")).alias("seg"),
                   F.col("c_acctbal"),
                   F.format_string('say "%s", then\n"%s", %d', "c_name", "c_mktsegment", "c_nationkey").alias("remark"))
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    back = read_table(spark, path, fmt="csv", multi_line=True)  # remarks hold line feeds
    p = profile(back, frequency_columns=["remark"], top_values=0, sample_values=3)
    return p.select("column", "physical_type", "observed_type", "row_count", "null_count", "distinct_count", "string_max_length",
                    F.array_join("sample_values", "~").alias("samples"))


# -- contract documents (one per customer row) ------------------------------------

def q_contract_header(spark, sf):
    from tablepact.sources.contracts import contract_header
    h = contract_header(spark, I.customer_contracts(spark, sf).unionByName(I.lint_contracts(spark, sf)))
    return h.select("contract_name", "contract_version", "owner", "allow_unexpected_columns")


def q_contract_rules(spark, sf):
    from tablepact.sources.contracts import contract_rules
    docs = I.customer_contracts(spark, sf).unionByName(I.lint_contracts(spark, sf).where("doc LIKE '%\"owner\"%'"))
    r = contract_rules(spark, docs)
    return r.selectExpr(
        "contract_name", "contract_version", "rule_type", "array_join(columns, ',') AS columns", "severity", "rule_name", "expected_type",
        "CASE WHEN rule_type = 'range_violation' THEN min_value END AS min_value",
        "CASE WHEN rule_type = 'range_violation' THEN max_text END AS max_text",
        "CASE WHEN rule_type = 'allowed_values_violation' THEN array_join(transform(allowed_values, "
        "x -> x.value), ',') END AS allowed_values",
        "CASE WHEN rule_type = 'pattern_violation' THEN pattern END AS pattern",
        "CASE WHEN rule_type = 'length_violation' THEN min_length END AS min_length",
        "CASE WHEN rule_type = 'length_violation' THEN max_length END AS max_length",
        "CASE WHEN rule_type = 'freshness_violation' THEN max_age_days END AS max_age_days", "min_rows", "max_rows",
        "array_join(declared_columns, ',') AS declared_columns")


def q_contract_lint(spark, sf):
    from tablepact.sources.contracts import contract_lint
    return contract_lint(spark, I.customer_contracts(spark, sf).unionByName(I.lint_contracts(spark, sf)))


def q_contract_diff(spark, sf):
    """Two versions of a contract a supplier; every 11th is new in the second one."""
    from tablepact.operators.contract_diff import contract_diff
    from tablepact.sources.contracts import contract_rules
    old = contract_rules(spark, I.supplier_contracts(spark, sf)).where("CAST(contract_version AS INT) % 11 <> 0")
    new = contract_rules(spark, I.supplier_contracts_revised(spark, sf))
    return contract_diff(old, new).selectExpr("contract_name", "rule_type", "array_join(columns, ',') AS columns", "rule_name", "change",
                                              "array_join(fields, ',') AS fields", "old_version", "new_version", "new['max_length'] AS new_max_length")


# -- many contracts over many tables -----------------------------------------------

def q_findings_many(spark, sf):
    """One contract a supplier, each over customer and over supplier, in one plan."""
    from tablepact.plans.many import validate_many
    from tablepact.sources.contracts import contract_rules
    tables = I.accounts(spark, sf)
    names = I.table(spark, sf, "supplier").select(F.col("s_name").alias("contract_name"))
    bindings = names.select("contract_name", F.explode(F.array(*[F.lit(t) for t in tables])).alias("dataset_name")).withColumn("run_id", F.lit("r_many"))
    v = validate_many(tables, contract_rules(spark, I.supplier_contracts(spark, sf)), bindings, reference_date=I.ORDERS_REFERENCE_DATE)
    low, high = (F.coalesce(*[F.get_json_object("evidence", f"$.{n}") for n in names]).cast("bigint") for names in (
        ("below_min_count", "failed_row_count", "too_short_count", "duplicate_key_count", "row_count"),
        ("above_max_count", "too_long_count", "duplicate_row_count")))
    return v.findings.select("run_id", "contract_name", "dataset_name", "slice", "finding_id", "severity", "status", low.alias("low"), high.alias("high"))


# -- triage over many keys ------------------------------------------------------------

def _triaged(spark, sf):
    findings, runs = I.triage_input(spark, sf)
    return findings, runs, triage.classify(findings)


def q_classify(spark, sf):
    _, _, c = _triaged(spark, sf)
    return c.select("run_id", "dataset_name", "slice", "finding_id", "compatibility", "priority",
                    "review_category", "rationale", "recommended_human_action")


def q_failures_table(spark, sf):
    _, _, c = _triaged(spark, sf)
    return triage.failures_table(c).drop("seq")


def q_suggestions(spark, sf):
    findings, runs, _ = _triaged(spark, sf)
    s = triage.suggestions(findings, I.triage_profiles(spark, sf))
    return s.select("run_id", "dataset_name", "slice", "suggestion_id", "suggestion_type", "target_path",
                    "confidence", "proposed_change", "reason", "evidence")


def q_suggestions_capped(spark, sf):
    findings, _, _ = _triaged(spark, sf)
    p = I.triage_profiles(spark, sf)
    s = triage.suggestions(findings, p, max_suggestions=2)
    return s.select("run_id", "dataset_name", "slice", "suggestion_id", "suggestion_rank")


def _recs(spark, sf):
    findings, runs, c = _triaged(spark, sf)
    p = I.triage_profiles(spark, sf)
    s = triage.suggestions(findings, p)
    return review.recommendations(c, s, runs)


def q_recommendations(spark, sf):
    r = _recs(spark, sf)
    return r.select("run_id", "dataset_name", "slice", "recommendation_id", "priority", "category",
                    F.array_join("linked_finding_ids", ",").alias("linked_finding_ids"))


def q_recommendations_clean(spark, sf):
    v = I.nation_run(spark, sf)
    c = triage.classify(v.findings)
    p = profile(I.table(spark, sf, "nation"), run_id="r_nation", dataset_name="nation")
    s = triage.suggestions(v.findings, p)
    r = review.recommendations(c, s, v.runs)
    return r.select("run_id", "dataset_name", "slice", "recommendation_id", "priority", "category",
                    F.size("linked_finding_ids").alias("linked_count"))


def q_overall_status(spark, sf):
    _, runs, c = _triaged(spark, sf)
    return review.overall_status(c, runs)


def q_report_status(spark, sf):
    f, runs, _ = _triaged(spark, sf)
    return review.report_status(f, runs)


def q_gate(spark, sf):
    _, runs, c = _triaged(spark, sf)
    return review.gate(c, runs, "error").unionByName(review.gate(c, runs, "warning")).unionByName(
        review.gate(c, runs, "never"))


def q_finding_counts(spark, sf):
    _, _, c = _triaged(spark, sf)
    return summaries.finding_counts(c)


def q_suggestion_counts(spark, sf):
    findings, _, _ = _triaged(spark, sf)
    p = I.triage_profiles(spark, sf)
    return summaries.suggestion_counts(triage.suggestions(findings, p))


def q_run_summary(spark, sf):
    f, runs, _ = _triaged(spark, sf)
    return summaries.run_summary(f, runs).drop("contract_name")


def q_high_priority(spark, sf):
    _, _, c = _triaged(spark, sf)
    return summaries.high_priority(c).select("run_id", "dataset_name", "slice", "finding_id", "rule_type",
                                                "column", "message", "recommended_human_action")


def q_redacted_summary(spark, sf):
    findings, runs, c = _triaged(spark, sf)
    p = I.triage_profiles(spark, sf)
    s = triage.suggestions(findings, p)
    r = review.recommendations(c, s, runs)
    out = summaries.redacted_summary(c, s, r, runs)

    def render(m: str) -> Column:
        return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")

    return out.select(
        "run_id", "dataset_name", "slice", "total_findings",
        render("counts_by_severity").alias("counts_by_severity"),
        render("counts_by_rule_type").alias("counts_by_rule_type"),
        render("counts_by_priority").alias("counts_by_priority"),
        F.array_join(F.transform("suggested_updates", lambda e: e["suggestion_id"]), ",").alias("suggestion_ids"),
        F.array_join(F.transform("review_recommendations", lambda e: e["recommendation_id"]), ",").alias("recommendation_ids"),
    )


QUERIES: dict[str, Query] = {
    "dataset_facts": q_dataset_facts,
    "profile_nulls": q_profile_nulls,
    "profile_observed_type": q_profile_observed_type,
    "profile_distinct": q_profile_distinct,
    "profile_top_values": q_profile_top_values,
    "profile_samples": q_profile_samples,
    "profile_top_values_text": q_profile_top_values_text,
    "profile_samples_shared_prefix": q_profile_samples_shared_prefix,
    "profile_samples_ordered": q_profile_samples_ordered,
    "profile_numeric_range": q_profile_numeric_range,
    "profile_datetime_range": q_profile_datetime_range,
    "profile_string_length": q_profile_string_length,
    "profile_full": q_profile_full,
    "profile_summary": q_profile_summary,
    "v_nullability": q_v_nullability,
    "v_type_mismatch": q_v_type_mismatch,
    "v_missing_required": q_v_missing_required,
    "v_unexpected": q_v_unexpected,
    "v_row_count": q_v_row_count,
    "v_allowed_values": q_v_allowed_values,
    "v_range": q_v_range,
    "v_pattern": q_v_pattern,
    "v_pattern_text": q_v_pattern_text,
    "v_pattern_skipped": q_v_pattern_skipped,
    "v_allowed_dates": q_v_allowed_dates,
    "v_range_bigint": q_v_range_bigint,
    "v_unique_nan": q_v_unique_nan,
    "v_length": q_v_length,
    "v_unique_column": q_v_unique_column,
    "v_unique_composite": q_v_unique_composite,
    "v_unique_skipped": q_v_unique_skipped,
    "v_freshness": q_v_freshness,
    "v_freshness_skipped": q_v_freshness_skipped,
    "severity_resolution": q_severity_resolution,
    "findings_many": q_findings_many,
    "findings_all": q_findings_all,
    "findings_lineitem": q_findings_lineitem,
    "findings_by_slice": q_findings_by_slice,
    "src_csv_na_tokens": q_src_csv_na_tokens,
    "contract_header": q_contract_header,
    "contract_rules": q_contract_rules,
    "contract_lint": q_contract_lint,
    "contract_diff": q_contract_diff,
    "classify": q_classify,
    "failures_table": q_failures_table,
    "suggestions": q_suggestions,
    "suggestions_capped": q_suggestions_capped,
    "recommendations": q_recommendations,
    "recommendations_clean": q_recommendations_clean,
    "overall_status": q_overall_status,
    "report_status": q_report_status,
    "gate": q_gate,
    "finding_counts": q_finding_counts,
    "suggestion_counts": q_suggestion_counts,
    "run_summary": q_run_summary,
    "high_priority": q_high_priority,
    "redacted_summary": q_redacted_summary,
}
