"""Helpers of the core tests (a module name of its own; several folders have a conftest)."""

from __future__ import annotations

import datetime as dt

from tablepact import contract_rules, contracts_frame, validate

REF = dt.date(2025, 3, 1)
SF = "/root/testdata/sf0.001"


def rules_of(spark, doc: dict):
    return contract_rules(spark, contracts_frame(spark, [doc]))


def contract(columns: dict, **top) -> dict:
    doc = {"contract": {"name": "t", "version": "1"}, "columns": columns}
    doc.update(top)
    return doc


def run(spark, df, doc, **kw):
    kw.setdefault("reference_date", REF)
    return validate(df, rules_of(spark, doc), **kw)


def findings(spark, df, doc, **kw):
    import json

    rows = run(spark, df, doc, **kw).findings.orderBy("seq").collect()
    return [dict(r.asDict(), ev=json.loads(r["evidence"])) for r in rows]
