"""SQL expression text for the null model, text parsers and the observed-type ladder.

Every helper takes and returns Spark SQL expression *text*; callers parse a
finished expression once with ``F.expr``.  A rule set compiles to a few
hundred expressions, and building them as text costs one JVM round-trip
each instead of one per operator node.  Everything is a built-in
expression, so it runs inside whole-stage codegen; no Python per row.
All text parsers are regex-guarded ``try_*`` casts (ANSI mode is on).
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Characters Python's str.strip() removes in the ASCII range.
WHITESPACE = " \t\n\r\f\v"

# The six contract (logical) types and the extra observed type.
LOGICAL_TYPES = ("string", "integer", "number", "boolean", "date", "datetime")
EMPTY = "empty"

INT_RE = r"\A[+-]?[0-9]+\z"
NUM_RE = (r"\A[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
          r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\z")
# A finite number's text, as contract bounds have it.
FINITE_RE = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9][0-9]?[0-9]?)?\z"
# First characters a number (or inf / nan) can start with.
NUM_LEADS = ("0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "+", "-", ".", "i", "I", "n", "N")
# Date-time text accepted by the ladder (fixed list of layouts).
ISO_RE = r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?)?\z"
# The same with a time zone: Z or an offset from UTC.
ZONED_RE = r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)? ?([Zz]|[+-][0-9]{2}:?[0-9]{2})\z"
# A clock at midnight, whatever its zone: such a text counts as a bare date.
MIDNIGHT_RE = r"[T ]0?0:00(:00(\.0*)?)?( ?([Zz]|[+-][0-9]{2}:?[0-9]{2}))?\z"
SLASH_YMD_RE = r"\A[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}\z"
SLASH_MDY_RE = r"\A[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z"
DMONY_RE = r"\A[0-9]{1,2} [A-Za-z]{3} [0-9]{4}\z"

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def ident(name: str) -> str:
    """A column name as SQL text (dots, spaces and backticks are not syntax)."""
    return "`" + name.replace("`", "``") + "`"


def lit(value: object) -> str:
    """A Python value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}L" if abs(value) > 2**31 - 1 else str(value)
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return f"CAST('{value}' AS DOUBLE)"
        return f"CAST({value!r} AS DOUBLE)"
    s = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{s}'"


def lits(values: list) -> str:
    return ", ".join(lit(v) for v in values)


def family(dtype: T.DataType) -> str:
    """Coarse family of a Spark type: the observed type for non-text columns."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "number"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, T.StringType):
        return "text"
    return "other"


def nullified(x: str, dtype: T.DataType) -> str:
    """pandas null model: NaN is null for floating columns."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return f"(CASE WHEN isnan({x}) THEN NULL ELSE {x} END)"
    return x


def trimmed(x: str) -> str:
    return f"btrim({x}, {lit(WHITESPACE)})"


def shape(t: str) -> str:
    """What is left of a trimmed text without its digits: it tells the one parser that can read the text."""
    return f"translate({t}, '0123456789', '')"


def is_int(t: str, r: str) -> str:
    """Whether a trimmed text of shape ``r`` is an integer."""
    return f"(({r} = '' AND {t} <> '') OR ({r} IN ('+', '-') AND left({t}, 1) = {r} AND {t} <> {r}))"


def is_num(t: str, r: str) -> str:
    """Whether a trimmed text of shape ``r`` is a number; a pattern is asked only where there is an exponent, inf or nan."""
    return (f"({is_int(t, r)} OR ({r} = '.' AND {t} <> '.') OR ({r} IN ('+.', '-.') AND left({t}, 1) IN ('+', '-') AND {t} <> {r}) "
            f"OR (translate({r}, 'eEnN', '') <> {r} AND length({r}) <= 9 AND left({t}, 1) IN ({lits(list(NUM_LEADS))}) AND {t} RLIKE {lit(NUM_RE)}))")


def is_int_text(x: str) -> str:
    return is_int(trimmed(x), shape(trimmed(x)))


def is_num_text(x: str) -> str:
    return is_num(trimmed(x), shape(trimmed(x)))


def num_from(t: str, r: str) -> str:
    """Python ``float()`` semantics on trimmed text of shape ``r``; NaN becomes null."""
    return f"nanvl(CASE WHEN {is_num(t, r)} THEN try_cast({t} AS DOUBLE) END, CAST(NULL AS DOUBLE))"


def num_from_text(x: str) -> str:
    return num_from(trimmed(x), shape(trimmed(x)))


def _parse(t: str, guard: str, fmt: str, arg: str | None = None) -> str:
    return (f"CASE WHEN {t} RLIKE {lit(guard)} THEN "
            f"CAST(try_to_timestamp({arg or t}, {lit(fmt)}) AS TIMESTAMP_NTZ) END")


def _utc(t: str) -> str:
    """UTC time of ISO text with a zone (Spark's cast wants a colon in offsets and an upper-case Z)."""
    plain = f"regexp_replace(upper({t}), '([+-][0-9]{{2}})([0-9]{{2}})$', '$1:$2')"
    return f"timestampadd(MICROSECOND, unix_micros(try_cast({plain} AS TIMESTAMP)), TIMESTAMP_NTZ'1970-01-01 00:00:00')"


def ts_from(t: str, r: str) -> str:
    """Timestamp (NTZ) from a fixed list of layouts, the parser told by the trimmed text's shape ``r``.

    Text with a zone gives its time in UTC.  Full-width ISO text is told by the places of its signs alone.
    """
    day = f"substring({t}, 5, 1) = '-' AND substring({t}, 8, 1) = '-'"
    time = f"substring({t}, 11, 1) IN ('T', ' ') AND substring({t}, 14, 1) = ':' AND substring({t}, 17, 1) = ':'"
    cast = f"try_cast({t} AS TIMESTAMP_NTZ)"
    return (f"(CASE WHEN NOT (left({t}, 1) BETWEEN '0' AND '9') THEN NULL "
            f"WHEN {r} = '--' AND length({t}) = 10 AND {day} THEN {cast} "
            f"WHEN {r} IN ('--T::', '-- ::') AND length({t}) = 19 AND {day} AND {time} THEN {cast} "
            f"WHEN {r} IN ('--', '--T:', '--T::', '--T::.', '-- :', '-- ::', '-- ::.') THEN (CASE WHEN {t} RLIKE {lit(ISO_RE)} THEN {cast} END) "
            f"WHEN left({r}, 2) = '--' THEN (CASE WHEN {t} RLIKE {lit(ZONED_RE)} THEN {_utc(t)} END) "
            f"WHEN {r} = '//' THEN coalesce({_parse(t, SLASH_YMD_RE, 'yyyy/M/d')}, {_parse(t, SLASH_MDY_RE, 'M/d/yyyy')}, {_parse(t, SLASH_MDY_RE, 'd/M/yyyy')}) "
            f"WHEN left({r}, 1) = ' ' AND length({r}) = 5 THEN ({_parse(t, DMONY_RE, 'd MMM yyyy', f'initcap({t})')}) END)")


def ts_from_text(x: str) -> str:
    return ts_from(trimmed(x), shape(trimmed(x)))


def as_number(x: str, dtype: T.DataType) -> str:
    """Numeric coercion used by range checks and numeric min/max."""
    fam = family(dtype)
    if fam in ("integer", "number"):
        return f"CAST({nullified(x, dtype)} AS DOUBLE)"
    if fam == "boolean":
        return f"CAST({x} AS DOUBLE)"
    if fam == "text":
        return num_from_text(x)
    return "CAST(NULL AS DOUBLE)"


def own_number(x: str, dtype: T.DataType) -> str:
    """Numeric value in the column's own type where that is exact (integers, decimals), else double."""
    if isinstance(dtype, T.DecimalType) or family(dtype) == "integer":
        return x
    return as_number(x, dtype)


def exact_number(text: str) -> str | None:
    """A number's text as an exact decimal literal, None if it has no such form."""
    plain = re.fullmatch(r"([+-]?)0*([0-9]*)(?:\.([0-9]*))?", text.strip())
    if not plain or not (plain[2] or plain[3]):
        return None
    whole, fraction = plain[2] or "0", (plain[3] or "").rstrip("0")
    if len(whole) + len(fraction) > 38:
        return None
    sign = "-" if plain[1] == "-" else ""
    return f"{sign}{whole}{'.' + fraction if fraction else ''}BD"


def number_literal(text: str, dtype: T.DataType) -> str:
    """A contract number as SQL text to compare with ``own_number`` of a column."""
    exact = exact_number(text) if isinstance(dtype, T.DecimalType) or family(dtype) == "integer" else None
    return exact or lit(float(text))


def as_timestamp(x: str, dtype: T.DataType) -> str:
    """Timestamp coercion used by freshness and datetime min/max."""
    fam = family(dtype)
    if fam in ("datetime", "date"):
        return f"CAST({x} AS TIMESTAMP_NTZ)"
    if fam == "text":
        return ts_from_text(x)
    return "CAST(NULL AS TIMESTAMP_NTZ)"


def iso_text(ts: str) -> str:
    """``Timestamp.isoformat()``: seconds, plus microseconds only when non-zero."""
    frac = f"date_format({ts}, 'SSSSSS')"
    return (f"(CASE WHEN {ts} IS NOT NULL THEN concat(date_format({ts}, {lit(ISO_SECONDS)}), "
            f"CASE WHEN {frac} <> '000000' THEN concat('.', {frac}) ELSE '' END) END)")


def string_form(x: str, dtype: T.DataType) -> str:
    """Text a rule sees for pattern and length checks (Spark's cast)."""
    if isinstance(dtype, T.StringType):
        return x
    return f"CAST({nullified(x, dtype)} AS STRING)"


def value_text(x: str, dtype: T.DataType) -> str:
    """Canonical text of a value for frequency tables (top values, samples)."""
    fam = family(dtype)
    if fam in ("datetime", "date"):
        return iso_text(f"CAST({x} AS TIMESTAMP_NTZ)")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        v = nullified(x, dtype)
        return f"CAST(CASE WHEN {v} = 0 THEN 0.0D ELSE {v} END AS STRING)"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return f"to_json({x})"
    return f"CAST({x} AS STRING)"


def observed_type_expr(n: str, b: str, i: str, f: str, d: str, t: str) -> str:
    """The ladder over text counters: every non-null value must parse."""
    return (f"(CASE WHEN {n} = 0 THEN '{EMPTY}' WHEN {b} = {n} THEN 'boolean' "
            f"WHEN {i} = {n} THEN 'integer' WHEN {f} = {n} THEN 'number' "
            f"WHEN {d} = {n} THEN (CASE WHEN {t} > 0 THEN 'datetime' ELSE 'date' END) ELSE 'string' END)")


def native_observed_type(dtype: T.DataType) -> str | None:
    """Observed type decided by the storage type alone (None: use the ladder)."""
    fam = family(dtype)
    if fam == "text":
        return None
    if fam == "other":
        return "string"
    return fam


def text_code(v: str, t: str, r: str, num: str, ts: str) -> str:
    """Most specific ladder rung one text value satisfies, as a one-letter code:
    b(oolean) i(nteger) f(loat) d(ate) t(ime-of-day datetime) s(tring).

    The rungs are disjoint except integer within number, so counting codes
    gives every ladder counter from one per-row evaluation.  The trimmed text ``t``, its
    shape ``r``, its number ``num`` and its timestamp ``ts`` are computed once by earlier projections.
    """
    return (f"(CASE WHEN {v} IS NULL THEN NULL "
            f"WHEN {r} = {t} AND lower({t}) IN ('true', 'false') THEN 'b' "
            f"WHEN {is_int(t, r)} THEN 'i' "
            f"WHEN {num} IS NOT NULL OR lower({r}) IN ('nan', '+nan', '-nan') AND {r} = {t} THEN 'f' "
            f"WHEN {ts} IS NULL THEN 's' "
            f"WHEN instr({r}, ':') = 0 OR {t} RLIKE {lit(MIDNIGHT_RE)} THEN 'd' ELSE 't' END)")


def code_counters(code: str) -> dict[str, str]:
    """Aggregates over a ``text_code`` column, keyed by ladder counter."""
    return {
        "n": f"count({code})",
        "b": f"count_if({code} = 'b')",
        "i": f"count_if({code} = 'i')",
        "f": f"count_if({code} IN ('i', 'f'))",
        "d": f"count_if({code} IN ('d', 't'))",
        "t": f"count_if({code} = 't')",
    }
