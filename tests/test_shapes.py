"""Parsers chosen by a text's shape against the patterns that define the layouts."""

import random
import re

from tablepact.functions import values

LAYOUTS = ["9999-99-99", "9999-9-9", "9999-99-99T99:99", "9999-99-99 99:99:99", "9999-99-99T99:99:99.999", "9999-99-99T99:99:99Z", "9999-99-99 99:99+99:99",
           "9999-99-99T9:99:99.9 -9999", "9999/99/99", "99/99/9999", "9/9/9999", "99 Jan 9999", "9 feb 9999", "99", "+99", "-9.9", ".9", "9.", "9e9", "-9.9E-99", "inf", "-Infinity",
           "NaN", "1-URGENT", "99-99-9999", "9999-999-9", "9999--99", "99/9999/99", "9+", "+", ".", "-.", "9.9.9", "e9", "9 9", "", "9999-99", "9T9", "--", "99:99", "99 Janu 9999"]


def full(pattern, text):
    return re.search(pattern.replace(r"\z", r"\Z"), text) is not None


def odd_text(rng):
    text = "".join(rng.choice("0123456789") if c == "9" else c for c in rng.choice(LAYOUTS))
    if rng.random() < 0.5:
        at = rng.randint(0, len(text))
        text = text[:at] + rng.choice("0-/ .:+eTZn") + text[at + rng.randint(0, 1) :]
    return text


def test_shapes_choose_what_the_patterns_accept(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, odd_text(rng)) for i in range(6000)], "i int, x string")
    slow = "coalesce(" + ", ".join([
        f"CASE WHEN t RLIKE {values.lit(values.ISO_RE)} THEN try_cast(t AS TIMESTAMP_NTZ) END",
        f"CASE WHEN t RLIKE {values.lit(values.ZONED_RE)} THEN {values._utc('t')} END",
        *[values._parse("t", guard, fmt, arg) for guard, fmt, arg in ((values.SLASH_YMD_RE, "yyyy/M/d", None), (values.SLASH_MDY_RE, "M/d/yyyy", None),
                                                                      (values.SLASH_MDY_RE, "d/M/yyyy", None), (values.DMONY_RE, "d MMM yyyy", "initcap(t)"))]]) + ")"
    rows = df.selectExpr("*", f"{values.trimmed('x')} AS t").selectExpr(
        "i", "t", f"{values.is_int_text('x')} AS is_int", f"{values.is_num_text('x')} AS is_num", f"{values.ts_from_text('x')} <=> {slow} AS same", f"{slow} IS NOT NULL AS dated").collect()
    assert sum(r["dated"] for r in rows) > 200
    for r in rows:
        assert r["same"], r["t"]
        assert r["is_int"] == full(values.INT_RE, r["t"]), r["t"]
        assert r["is_num"] == full(values.NUM_RE, r["t"]), r["t"]
