"""Inputs of the registered queries: tables, derived tables, test contracts.

The contracts are query parameters (what a user would declare for these
tables); every query reads the full tables under ``sf_dir``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.plans.many import validate_many
from tablepact.plans.validation import Validation, validate
from tablepact.session import ensure_checkpoint_dir
from tablepact.sources.contracts import contract_rules, contracts_frame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with c_mktsegment null on every 7th key (test tables hold no nulls)."""
    c = table(spark, sf_dir, "customer")
    return c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")))


def text_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders rendered as text columns, one per observed-type rung."""
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        F.col("o_orderkey").cast("string").alias("int_txt"),
        F.col("o_totalprice").cast("string").alias("num_txt"),
        F.when(F.col("o_orderstatus") == "F", F.lit("True")).otherwise(F.lit("false")).alias("bool_txt"),
        day.alias("date_txt"),
        F.concat(day, F.lit("T10:00:00")).alias("dt_txt"),
        F.concat(day, F.when(F.col("o_orderkey") % 2 == 0, "T10:00:00Z").otherwise("T00:30:00.5+01:00")).alias("zoned_txt"),
        F.col("o_orderpriority").alias("str_txt"),
        F.lit(None).cast("string").alias("empty_txt"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("12")).otherwise(F.lit("abc")).alias("mixed_txt"),
    )


def big_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with keys beyond 2^53 (bigint and decimal), dates as DATE and timestamp, and a double that is NaN, null or the key."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey + 9007199254740992 AS big", "CAST(o_orderkey + 9007199254740992 AS DECIMAL(20,0)) AS dec",
        "CAST(o_orderdate AS DATE) AS day", "o_orderdate AS moment",
        "CASE o_orderkey % 1000 WHEN 1 THEN double('NaN') WHEN 2 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) END AS part_nan")


# Fixed parameters: contracts declared for the test tables.
ORDERS_CONTRACT = {
    "contract": {"name": "orders_contract", "version": "1"},
    "schema": {"allow_unexpected_columns": True},
    "columns": {
        "o_orderkey": {"type": "integer", "nullable": False},
        "o_orderstatus": {"type": "string", "allowed_values": ["O", "F"]},
        "o_totalprice": {"type": "number", "max": 400000},
        "o_orderdate": {"type": "date", "freshness": {"max_age_days": 30}},
    },
}
ORDERS_REFERENCE_DATE = dt.date(2001, 12, 31)

CUSTOMER_CONTRACT = {
    "contract": {"name": "customer_contract", "version": "1"},
    "columns": {
        "c_custkey": {"type": "integer", "nullable": False, "unique": True},
        "c_name": {"type": "string", "pattern": "Customer#[0-9]{9}"},
        "c_acctbal": {"type": "number", "min": 0},
        "c_mktsegment": {"type": "string", "allowed_values": ["AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY"]},
        "c_email": {"type": "string"},
    },
    "row_count": {"max": 1000},
}

ORDERS_MONTHLY_CONTRACT = {
    "contract": {"name": "orders_monthly", "version": "1"},
    "schema": {"allow_unexpected_columns": True},
    "columns": {"o_totalprice": {"type": "number", "max": 499000}},
    "row_count": {"min": 180},
}

LINEITEM_KEY_CONTRACT = {
    "contract": {"name": "lineitem_key", "version": "1"},
    "schema": {"allow_unexpected_columns": True},
    "columns": {"l_orderkey": {"type": "integer"}},
    "uniqueness": [{"name": "line_key", "columns": ["l_orderkey", "l_linenumber"]}],
}

LINEITEM_CONTRACT = {
    "contract": {"name": "lineitem_contract", "version": "1"},
    "columns": {
        "l_orderkey": {"type": "integer", "nullable": False},
        "l_partkey": {"type": "integer"},
        "l_suppkey": {"type": "integer"},
        "l_linenumber": {"type": "integer", "min": 1, "max": 7},
        "l_quantity": {"type": "number", "min": 1, "max": 50},
        "l_extendedprice": {"type": "number", "min": 1000},
        "l_discount": {"type": "number", "min": 0, "max": 0.08},
        "l_tax": {"type": "number", "min": 0, "max": 0.08},
        "l_returnflag": {"type": "string", "allowed_values": ["A", "N"]},
        "l_linestatus": {"type": "string", "allowed_values": ["O", "F"], "pattern": "[OF]",
                         "min_length": 1, "max_length": 1},
        "l_shipdate": {"type": "date", "nullable": False, "freshness": {"max_age_days": 30}},
    },
    "uniqueness": [{"name": "line_key", "columns": ["l_orderkey", "l_linenumber"]}],
    "row_count": {"min": 1000},
}

NATION_CONTRACT = {
    "contract": {"name": "nation_contract", "version": "1"},
    "columns": {
        "n_nationkey": {"type": "integer", "nullable": False, "unique": True},
        "n_name": {"type": "string", "nullable": False},
        "n_regionkey": {"type": "integer", "min": 0, "max": 4},
    },
}


PEOPLE_CONTRACT = {
    "contract": {"name": "people_contract", "version": "1"},
    "dataset": {"severity_defaults": {"unexpected_column": "info"}},
    "columns": {
        "c_custkey": {"type": "string"},
        "name": {"pattern": "[", "min_length": 19, "freshness": {"max_age_days": 30}},
        "nation": {"allowed_values": [0, 1, 2], "severity": "info"},
        "balance": {"min": 0, "severity": "warning"},
        "seg": {"nullable": False, "severity": "warning"},
        "day": {"freshness": {"max_age_days": 30}},
        "zip": {"severity": "info"},
    },
    "uniqueness": [{"name": "nk", "columns": ["nation"], "severity": "warning"},
                   {"name": "bad", "columns": ["name", "zzz"], "severity": "info"}],
    "row_count": {"max": 10, "severity": "info"},
}

SUPPLIER_CONTRACT = {
    "contract": {"name": "supplier_contract", "version": "1"},
    "schema": {"allow_unexpected_columns": True},
    "columns": {"s_suppkey": {}},
    "row_count": {"max": 1, "severity": "info"},
}

PART_CONTRACT = {
    "contract": {"name": "part_contract", "version": "1"},
    "schema": {"allow_unexpected_columns": True},
    "columns": {"p_size": {"max": 10, "severity": "warning"}},
}


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with other names, nulls and a date text: breaks a rule of every kind."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_name AS name", "c_nationkey AS nation", "c_acctbal AS balance",
        "CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS seg",
        "date_format(date_add(DATE'2001-01-01', CAST(c_custkey % 300 AS INT)), 'yyyy-MM-dd') AS day",
        "c_nationkey % 5 AS extra")


# Contract documents of every kind of structural problem; ``{n}`` is the contract's name, ``{k}`` the customer's key.
GOOD_COLUMNS = '"columns":{"a":{"type":"number"}}'
DOCUMENTS = [
    '{"contract":{"name":"{n}","version":"{k}","owner":"{s}"},"dataset":{"severity_defaults":{"range_violation":"info"}},"columns":{'
    '"a":{"type":"integer","nullable":false,"unique":true,"min":1,"max":9007199254740993},'
    '"b":{"required":false,"allowed_values":["x",1,true],"severity":"warning"},'
    '"c":{"pattern":"[a-z]+","min_length":2,"max_length":4},"d":{"type":"date","freshness":{"max_age_days":30}}},'
    '"uniqueness":[{"name":"ab","columns":["a","b"],"severity":"info"}],"row_count":{"min":1,"max":5,"severity":"error"}}',
    '{"contract":{"name":"{n}","version":"{k}","owner":"{s}"},"schema":{"allow_unexpected_columns":1},"columns":{'
    '"a":{"nullable":null,"required":0,"unique":"yes"},"b":{"nullable":"","unique":0}}}',
    '{"contract": not json',
    '["a list"]',
    '{' + GOOD_COLUMNS + '}',
    '{"contract":{"version":"1"},' + GOOD_COLUMNS + '}',
    '{"contract":{"name":"{n}"},"dataset":[1],"schema":7,' + GOOD_COLUMNS + '}',
    '{"contract":{"name":"{n}"},"dataset":{"severity_defaults":"high"},' + GOOD_COLUMNS + '}',
    '{"contract":{"name":"{n}"},"dataset":{"severity_defaults":{"range_violation":"fatal","type_mismatch":3}},' + GOOD_COLUMNS + '}',
    '{"contract":{"name":"{n}"}}',
    '{"contract":{"name":"{n}"},"columns":{}}',
    '{"contract":{"name":"{n}"},"row_count":3,' + GOOD_COLUMNS + '}',
    '{"contract":{"name":"{n}"},"row_count":{"min":-1,"max":-2,"severity":"loud"},' + GOOD_COLUMNS + '}',
    '{"contract":{"name":"{n}"},"row_count":{"min":5,"max":2},"uniqueness":{"name":"k"},' + GOOD_COLUMNS + '}',
    '{"contract":{"name":"{n}"},"columns":{"a":5,"b":{"type":"money","severity":"high"},"c":{"freshness":3,"allowed_values":"x"},'
    '"d":{"freshness":{"max_age_days":0}},"e":{"freshness":{"max_age_days":3,"reference":"today"}},"f":{"freshness":{"max_age_days":"7"}},'
    '"g":{"min":true,"max":"x"},"h":{"min":[1],"max":"NaN"},"i":{"min":"5","max":1e3}}}',
    '{"contract":{"name":"{n}"},"uniqueness":["k",{"columns":["a"]},{"name":"x","columns":[]},{"name":"y","columns":["a",1]},'
    '{"name":"z","columns":["a"],"severity":"bad"},{"name":"w","columns":"a"}],' + GOOD_COLUMNS + '}',
]


def lint_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contract document a customer, in turn of every kind above."""
    c = table(spark, sf_dir, "customer")
    template = F.element_at(F.array(*[F.lit(d) for d in DOCUMENTS]), (F.col("c_custkey") % len(DOCUMENTS) + 1).cast("int"))
    filled = template
    for mark, value in (("{n}", F.col("c_name")), ("{k}", F.col("c_custkey").cast("string")), ("{s}", F.col("c_mktsegment"))):
        filled = F.replace(filled, F.lit(mark), value)
    return c.select(filled.alias("doc"))


def customer_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contract document per customer (a contracts table that grows with
    the data): balance floor and segment domain from the row, a dataset
    severity default, a composite key; every 5th nation key carries an
    invalid column severity for lint to find."""
    c = table(spark, sf_dir, "customer")
    return c.selectExpr("""to_json(named_struct(
        'contract', named_struct('name', c_name, 'version', CAST(c_custkey AS STRING), 'owner', c_mktsegment),
        'dataset', named_struct('severity_defaults', named_struct('range_violation',
            CASE WHEN c_nationkey % 3 = 0 THEN 'warning' ELSE 'error' END)),
        'columns', named_struct(
            'balance', named_struct('type', 'number', 'min', c_acctbal,
                                    'severity', CASE WHEN c_nationkey % 5 = 0 THEN 'fatal' END),
            'segment', named_struct('nullable', false, 'allowed_values', array(c_mktsegment))),
        'uniqueness', array(named_struct('name', 'k', 'columns', array('balance', 'segment'))))) AS doc""")


def run(spark: SparkSession, df: DataFrame, contract: dict | list, **kw) -> Validation:
    """Validate against one contract document (or its already-parsed rule rows)."""
    rules = contract if isinstance(contract, list) else contract_rules(spark, contracts_frame(spark, [contract]))
    return validate(df, rules, **kw)


def rules_by_contract(spark: SparkSession, docs: list[dict]) -> dict[str, list]:
    """Parse many contract documents in one job; rule rows per contract name."""
    out: dict[str, list] = {}
    for r in contract_rules(spark, contracts_frame(spark, docs)).collect():
        out.setdefault(r["contract_name"], []).append(r)
    return out


def orders_monthly(spark: SparkSession, sf_dir: str, rules: list | None = None) -> Validation:
    o = table(spark, sf_dir, "orders")
    return run(spark, o, rules or ORDERS_MONTHLY_CONTRACT, by={"month": F.date_trunc("month", "o_orderdate")},
               run_id="r_orders", dataset_name="orders", reference_date=ORDERS_REFERENCE_DATE)


def lineitem_by_flag(spark: SparkSession, sf_dir: str, rules: list | None = None) -> Validation:
    li = table(spark, sf_dir, "lineitem")
    return run(spark, li, rules or LINEITEM_KEY_CONTRACT, by=["l_returnflag"], run_id="r_lineitem",
               dataset_name="lineitem", reference_date=ORDERS_REFERENCE_DATE)


def customer_run(spark: SparkSession, sf_dir: str, rules: list | None = None) -> Validation:
    c = table(spark, sf_dir, "customer")
    return run(spark, c, rules or CUSTOMER_CONTRACT, run_id="r_customer", dataset_name="customer",
               reference_date=ORDERS_REFERENCE_DATE)


def nation_run(spark: SparkSession, sf_dir: str, rules: list | None = None) -> Validation:
    n = table(spark, sf_dir, "nation")
    return run(spark, n, rules or NATION_CONTRACT, run_id="r_nation", dataset_name="nation",
               reference_date=ORDERS_REFERENCE_DATE)


# Fixed parameters: a floor for balances, and a row count that no slice reaches.
SEGMENTS_CONTRACT = {"contract": {"name": "segments", "version": "1"}, "schema": {"allow_unexpected_columns": True},
                     "columns": {"c_acctbal": {"min": 0}}, "row_count": {"min": 1000000000}}


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with a slice column that holds null, the text ``null`` and text with ``|`` and ``=``."""
    return table(spark, sf_dir, "customer").withColumn("seg", F.expr(
        "CASE WHEN c_custkey % 10 = 1 THEN 'null' WHEN c_custkey % 10 = 2 THEN 'a|b=c' WHEN c_custkey % 10 <> 0 THEN c_mktsegment END"))


def sliced_segments(spark: SparkSession, sf_dir: str) -> Validation:
    return run(spark, segments(spark, sf_dir), SEGMENTS_CONTRACT, by=["seg"], run_id="r_segments", dataset_name="segments",
               reference_date=ORDERS_REFERENCE_DATE)


def triage_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings and runs of eight contracts over eight datasets, validated together: many keys, every rule
    type, skipped findings, all severities, clean keys."""
    contracts = {"orders": ORDERS_MONTHLY_CONTRACT, "lineitem": LINEITEM_KEY_CONTRACT, "customer": CUSTOMER_CONTRACT, "nation": NATION_CONTRACT,
                 "people": PEOPLE_CONTRACT, "supplier": SUPPLIER_CONTRACT, "part": PART_CONTRACT, "segments": SEGMENTS_CONTRACT}
    tables = {name: table(spark, sf_dir, name) for name in contracts if name not in ("people", "segments")}
    tables |= {"people": people(spark, sf_dir), "segments": segments(spark, sf_dir)}
    by = {"orders": {"month": F.date_trunc("month", "o_orderdate")}, "lineitem": ["l_returnflag"], "segments": ["seg"]}
    rules = contract_rules(spark, contracts_frame(spark, list(contracts.values())))
    bindings = spark.createDataFrame([(f"r_{name}", doc["contract"]["name"], name) for name, doc in contracts.items()],
                                     "run_id string, contract_name string, dataset_name string")
    v = validate_many(tables, rules, bindings, by=by, reference_date=ORDERS_REFERENCE_DATE)
    # The findings of a run are small and read by every triage operator:
    # materialize them once (reliable checkpoint in spark.checkpoint.dir),
    # as a findings history table would be.
    ensure_checkpoint_dir(spark)
    return v.findings.checkpoint(), v.runs.checkpoint()


def supplier_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contract document a supplier: bounds, nations and a name rule from its row, over the columns of ``accounts``.

    Documents are much longer than the rows they come from, so they are dealt out before they are parsed.
    """
    return table(spark, sf_dir, "supplier").selectExpr("""to_json(named_struct(
        'contract', named_struct('name', s_name, 'version', CAST(s_suppkey AS STRING)),
        'columns', named_struct(
            'balance', named_struct('type', 'number', 'min', s_acctbal, 'max', s_acctbal + 5000, 'severity', CASE WHEN s_nationkey % 3 = 0 THEN 'info' END),
            'nation', named_struct('type', 'integer', 'allowed_values', array(s_nationkey, (s_nationkey + 7) % 25)),
            'name', named_struct('pattern', concat('[A-Z][a-z]+#[0-9]*', CAST(s_suppkey % 10 AS STRING)), 'max_length', 18, 'unique', true)),
        'row_count', named_struct('min', s_suppkey * 10))) AS doc""").repartition("doc")


def supplier_contracts_revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contracts of ``supplier_contracts`` after a revision: other bounds, nations, lengths and row counts, patterns given up."""
    return table(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 3").selectExpr("""to_json(named_struct(
        'contract', named_struct('name', s_name, 'version', CAST(s_suppkey + 1 AS STRING)),
        'columns', named_struct(
            'balance', named_struct('type', 'number', 'min', s_acctbal, 'max', s_acctbal + CASE WHEN s_suppkey % 4 = 0 THEN 6000 ELSE 5000 END,
                                    'severity', CASE WHEN s_nationkey % 3 = 0 THEN 'info' END),
            'nation', named_struct('type', 'integer', 'allowed_values',
                                   CASE WHEN s_suppkey % 5 = 0 THEN array(s_nationkey) ELSE array(s_nationkey, (s_nationkey + 7) % 25) END),
            'name', named_struct('pattern', CASE WHEN s_suppkey % 4 <> 1 THEN concat('[A-Z][a-z]+#[0-9]*', CAST(s_suppkey % 10 AS STRING)) END,
                                 'max_length', CASE WHEN s_suppkey % 4 = 2 THEN 20 ELSE 18 END, 'unique', true)),
        'row_count', named_struct('min', s_suppkey * 10, 'max', CASE WHEN s_suppkey % 6 = 0 THEN s_suppkey * 100 END))) AS doc""")


def accounts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """customer and supplier under the column names that ``supplier_contracts`` declare."""
    return {"customer": table(spark, sf_dir, "customer").selectExpr("c_acctbal AS balance", "c_nationkey AS nation", "c_name AS name"),
            "supplier": table(spark, sf_dir, "supplier").selectExpr("s_acctbal AS balance", "s_nationkey AS nation", "s_name AS name", "s_suppkey")}


def triage_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the datasets whose contracts forbid unexpected columns."""
    from tablepact.operators.profile import profile

    parts = [profile(df, run_id=f"r_{name}", dataset_name=name)
             for name, df in (("customer", table(spark, sf_dir, "customer")), ("nation", table(spark, sf_dir, "nation")),
                              ("people", people(spark, sf_dir)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
