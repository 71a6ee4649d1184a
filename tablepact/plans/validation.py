"""Compile contract rules into Spark jobs and assemble the ``findings`` table.

Plan of one ``validate`` call (every job reads only the columns it needs):

* job A - one fused aggregate per slice over a projection of per-row
  features (parsed numbers, timestamps, lengths, type codes, failure flags,
  each computed once per row): null counts, type-ladder counters, failed
  counts of allowed-value / pattern / length / range rules, max timestamps
  for freshness, the row count.  Partial aggregation on every task, one
  tiny shuffle.  It runs when ``validate`` is called and its result (one row
  per slice) is kept in ``spark.checkpoint.dir``: findings and runs read it, and
  only rules that failed get a sample pass.
* job B - samples of the rows that fail a rule: ``(slice, rule, key) -> count``,
  map-side combined on short keys, then the first k by a ``row_number`` filter that
  becomes a partial window-group limit before the exchange; patterns by value, allowed
  values by count and value.
* job C - one ``groupBy(slice + key)`` per uniqueness rule; duplicate stats by
  aggregation, sample keys by the same top-k pattern.

Jobs B and C group strings by keys of bounded size and choose by value (see
``plans.ordered``); the whole strings of the few chosen keys are fetched by one more
scan, for which their selection is computed when ``validate`` is called.

Each side table has at most one row per slice.  They are merged with the
metrics row by a union and one grouped ``first`` (no join), and every
finding is emitted by a single ``inline`` of an array of structs, filtered
on its firing condition.  Schema-level findings (missing / unexpected
columns, skipped rules) need no data: they come from the rules and the
schema alone.

Expressions are assembled as SQL text and parsed once each (``F.expr``):
a rule set is a few hundred expressions, and text keeps plan construction
to one JVM round-trip per expression.
"""

from __future__ import annotations

import datetime as _dt
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.functions import patterns, values
from tablepact.functions.values import ident, lit
from tablepact.plans import ordered
from tablepact.plans.duplicates import UniqueKey, duplicates
from tablepact.plans.frames import combine_slices, per_slice_agg, qcol, with_slices
from tablepact.plans.vocabulary import COMPATIBLE_TYPES, MESSAGES

FINDINGS_SCHEMA = (
    "run_id string, contract_name string, dataset_name string, slice string, seq int, "
    "finding_id string, rule_type string, column string, columns array<string>, severity string, "
    "status string, message string, evidence string, suggested_action string"
)
RUNS_SCHEMA = (
    "run_id string, contract_name string, dataset_name string, slice string, row_count bigint, "
    "column_count int"
)
_EMIT_TYPE = ("struct<seq:int,finding_id:string,rule_type:string,column:string,columns:array<string>,"
              "severity:string,status:string,message:string,evidence:string,suggested_action:string,"
              "fires:boolean>")
_NO_NULL_DROP = "map('ignoreNullFields', 'false')"
_SAMPLE_TYPE = "array<struct<rn:int,value:string,n:bigint>>"


@dataclass
class Validation:
    """Result of ``validate``: findings and one ``runs`` row per key, lazy over the kept ``metrics`` (one row per slice)."""

    findings: DataFrame
    runs: DataFrame
    metrics: DataFrame


def finding_id(rule_type: str, columns: Sequence[str]) -> str:
    return f"{rule_type}:{'_'.join(columns) if columns else 'dataset'}"


def _texts(rule_type: str, status: str, **kw) -> tuple[str, str]:
    msg, action = MESSAGES[(rule_type, status)]
    return msg.format(**kw), action.format(**kw)


def _evidence(**fields: str) -> str:
    """JSON text of an evidence object (key order kept, nulls kept)."""
    body = ", ".join(f"{lit(k)}, {v}" for k, v in fields.items())
    return f"to_json(named_struct({body}), {_NO_NULL_DROP})"


def _str_array(items: Sequence[str]) -> str:
    return f"CAST(array({values.lits(list(items))}) AS ARRAY<STRING>)"


class _Compiler:
    """Collects aggregates, per-row features, side jobs and emitted structs."""

    def __init__(self, data: DataFrame, keys: list[str], dataset_columns: list[str], schema: T.StructType,
                 reference_date: _dt.date, max_examples: int, pattern_errors: dict[str, str | None]):
        self.data = data
        self.keys = keys
        self.columns = dataset_columns
        self.positions = {c: i for i, c in enumerate(dataset_columns)}
        self.pattern_errors = pattern_errors
        self.seq = 0
        self.types = {f.name: f.dataType for f in schema.fields}
        self.ref = reference_date
        self.k = max_examples
        self.aggs: dict[str, str] = {"rows": "count(1)"}
        # per-row columns computed once below the aggregate, in stages (a stage may read earlier ones)
        self.features: list[dict[str, str]] = [{}, {}, {}]
        self.structs: list[str] = []
        self.static: list[dict] = []
        # key, fails, text, ordered by count?, name of the failed-row metric, may its text be long?
        self.sample_rules: list[tuple[int, str, str, bool, str, bool]] = []
        self.uniq_rules: list[tuple[int, list[str]]] = []

    # -- shared metrics and features ---------------------------------------------
    def _idx(self, c: str) -> int:
        return self.positions[c]

    def metric(self, name: str, sql: str) -> str:
        self.aggs.setdefault(name, sql)
        return ident(name)

    def feature(self, name: str, sql: str, stage: int = 1) -> str:
        self.features[stage - 1].setdefault(name, sql)
        return ident(name)

    def value(self, c: str) -> str:
        """The column's value under the null model (NaN is null)."""
        return self.feature(f"v_{self._idx(c)}", values.nullified(ident(c), self.types[c]))

    def text(self, c: str) -> tuple[str, str]:
        """A text column trimmed, and its shape."""
        t = values.trimmed(ident(c))
        return self.feature(f"t_{self._idx(c)}", t), self.feature(f"r_{self._idx(c)}", values.shape(t))

    def timestamp(self, c: str) -> str:
        if values.family(self.types[c]) == "text":
            return self.feature(f"ts_{self._idx(c)}", values.ts_from(*self.text(c)), stage=2)
        return self.feature(f"ts_{self._idx(c)}", values.as_timestamp(ident(c), self.types[c]))

    def number(self, c: str) -> str:
        if values.family(self.types[c]) == "text":
            return self.feature(f"num_{self._idx(c)}", values.num_from(*self.text(c)), stage=2)
        return self.feature(f"num_{self._idx(c)}", values.own_number(ident(c), self.types[c]))

    def nulls(self, c: str) -> str:
        return self.metric(f"nulls_{self._idx(c)}", f"count_if({self.value(c)} IS NULL)")

    def observed(self, c: str) -> str:
        dtype = self.types[c]
        i = self._idx(c)
        n = self.metric(f"nonnull_{i}", f"count({self.value(c)})")
        native = values.native_observed_type(dtype)
        if native is not None:
            return f"(CASE WHEN {n} = 0 THEN '{values.EMPTY}' ELSE '{native}' END)"
        code = self.feature(f"code_{i}", values.text_code(self.value(c), *self.text(c), self.number(c), self.timestamp(c)), stage=3)
        counters = {k: self.metric(f"type{k}_{i}", agg) for k, agg in values.code_counters(code).items()}
        return values.observed_type_expr(*[counters[k] for k in "nbifdt"])

    # -- emission -----------------------------------------------------------------
    def emit(self, seq: int, rule_type: str, columns: Sequence[str], column: str | None, severity: str,
             status: str, message: str, evidence: str, action: str, fires: str) -> None:
        """``message``, ``evidence`` and ``fires`` are SQL text."""
        self.structs.append(
            f"CAST(named_struct('seq', {seq}, 'finding_id', {lit(finding_id(rule_type, columns))}, "
            f"'rule_type', {lit(rule_type)}, 'column', CAST({lit(column)} AS STRING), "
            f"'columns', {_str_array(columns)}, 'severity', {lit(severity)}, 'status', {lit(status)}, "
            f"'message', {message}, 'evidence', {evidence}, 'suggested_action', {lit(action)}, "
            f"'fires', coalesce({fires}, false)) AS {_EMIT_TYPE})"
        )

    def static_finding(self, seq: int, rule_type: str, columns: Sequence[str], column: str | None,
                       severity: str, status: str, message: str, evidence: dict, action: str) -> None:
        self.static.append(
            dict(seq=seq, finding_id=finding_id(rule_type, columns), rule_type=rule_type, column=column,
                 columns=list(columns), severity=severity, status=status, message=message,
                 evidence=json.dumps(evidence, separators=(",", ":")), suggested_action=action)
        )

    # -- rules ----------------------------------------------------------------------
    def compile(self, rule: Row) -> None:
        rt = rule["rule_type"]
        cols = list(rule["columns"] or [])
        c = cols[0] if cols else None
        self.seq += 1  # rules come in report order, so this is the order of findings
        seq = self.seq
        sev = rule["severity"]
        present = c in self.positions

        if rt == "missing_required_column":
            if not present:
                msg, act = _texts(rt, "failed", column=c)
                self.static_finding(seq, rt, cols, c, sev, "failed", msg,
                                    {"expected_column": c, "available_columns": self.columns}, act)
        elif rt == "unexpected_column":
            declared = list(rule["declared_columns"] or [])
            known = set(declared)
            for name in self.columns:
                if name not in known:
                    msg, act = _texts(rt, "warning", column=name)
                    self.static_finding(self.seq, rt, [name], name, sev, "warning",
                                        msg, {"unexpected_column": name, "declared_columns": declared}, act)
                    self.seq += 1
        elif rt == "uniqueness_violation":
            self._uniqueness(rule, seq, cols, sev)
        elif not present:
            return
        elif rt == "type_mismatch":
            self._type(rule, seq, c, sev)
        elif rt == "nullability_violation":
            nulls = self.nulls(c)
            rows = ident("rows")
            pct = f"(CASE WHEN {rows} > 0 THEN bround({nulls} * 100.0D / {rows}, 2) ELSE 0.0D END)"
            msg, act = _texts(rt, "failed", column=c)
            self.emit(seq, rt, cols, c, sev, "failed", lit(msg),
                      _evidence(null_count=nulls, row_count=rows, null_percentage=pct), act, f"{nulls} > 0")
        elif rt == "allowed_values_violation":
            self._allowed(rule, seq, c, sev)
        elif rt == "range_violation":
            self._range(rule, seq, c, sev)
        elif rt == "pattern_violation":
            self._pattern(rule, seq, c, sev)
        elif rt == "length_violation":
            self._length(rule, seq, c, sev)
        elif rt == "freshness_violation":
            self._freshness(rule, seq, c, sev)

    def compile_row_count(self, rule: Row) -> None:
        rt = "row_count_violation"
        self.seq += 1
        seq = self.seq
        lo, hi = rule["min_rows"], rule["max_rows"]
        rows = ident("rows")
        low = f"{rows} < {lit(lo)}" if lo is not None else "false"
        high = f"{rows} > {lit(hi)}" if hi is not None else "false"
        msg, act = _texts(rt, "warning")
        self.emit(seq, rt, [], None, rule["severity"], "warning", lit(msg),
                  _evidence(row_count=rows, min_allowed=f"CAST({lit(lo)} AS BIGINT)",
                            max_allowed=f"CAST({lit(hi)} AS BIGINT)"),
                  act, f"({low}) OR ({high})")

    def _type(self, rule: Row, seq: int, c: str, sev: str) -> None:
        rt = "type_mismatch"
        expected = rule["expected_type"]
        observed = self.observed(c)
        ok = list(COMPATIBLE_TYPES.get(expected, ()))
        fires = f"{observed} <> '{values.EMPTY}'" + (f" AND NOT {observed} IN ({values.lits(ok)})" if ok else "")
        msg_t, act = MESSAGES[(rt, "failed")]
        before, after = msg_t.split("{observed}")
        message = f"concat({lit(before.format(column=c))}, {observed}, {lit(after.format(expected=expected))})"
        self.emit(seq, rt, [c], c, sev, "failed", message,
                  _evidence(expected_type=lit(expected), observed_type=observed), act, fires)

    def _matches_allowed(self, c: str, allowed: list) -> str:
        dtype = self.types[c]
        fam = values.family(dtype)
        x = values.nullified(ident(c), dtype)
        by_kind: dict[str, list[str]] = {}
        for item in allowed:
            by_kind.setdefault(item["kind"], []).append(item["value"])
        if fam in ("integer", "number"):
            nums = [values.number_literal(v, dtype) for v in by_kind.get("number", [])]
            return f"{values.own_number(ident(c), dtype)} IN ({', '.join(nums)})" if nums else "false"
        if fam == "boolean":
            bools = [v.lower() == "true" for v in by_kind.get("boolean", [])]
            return f"{x} IN ({values.lits(bools)})" if bools else "false"
        texts = by_kind.get("text", [])
        if not texts:
            return "false"
        if fam in ("date", "datetime"):
            moments = ", ".join(values.ts_from_text(lit(t)) for t in texts)  # constants; null for what is no date
            return f"coalesce(CAST({x} AS TIMESTAMP_NTZ) IN ({moments}), false)"
        return f"{values.string_form(x, dtype)} IN ({values.lits(texts)})"

    def _allowed(self, rule: Row, seq: int, c: str, sev: str) -> None:
        rt = "allowed_values_violation"
        dtype = self.types[c]
        x = values.nullified(ident(c), dtype)
        allowed = list(rule["allowed_values"] or [])
        fails = f"({x} IS NOT NULL AND NOT ({self._matches_allowed(c, allowed)}))"
        failed = self.metric(f"allowed_failed_{seq}", f"count_if({self.feature(f'af_{seq}', fails)})")
        key = len(self.sample_rules)
        self.sample_rules.append((key, fails, values.value_text(x, dtype), True, f"allowed_failed_{seq}", ordered.is_text(dtype)))
        hist = f"map_from_entries(transform({ident(f'samples_{key}')}, e -> struct(e.value, e.n)))"
        msg, act = _texts(rt, "failed", column=c)
        self.emit(seq, rt, [c], c, sev, "failed", lit(msg),
                  _evidence(allowed_values=_str_array([a["value"] for a in allowed]), unexpected_values=hist,
                            failed_row_count=failed),
                  act, f"{failed} > 0")

    def _range(self, rule: Row, seq: int, c: str, sev: str) -> None:
        rt = "range_violation"
        i = self._idx(c)
        dtype = self.types[c]
        num = self.number(c)
        lo, hi = rule["min_text"], rule["max_text"]
        below = self.metric(f"below_{seq}", f"count_if({num} < {values.number_literal(lo, dtype)})") if lo is not None else "0L"
        above = self.metric(f"above_{seq}", f"count_if({num} > {values.number_literal(hi, dtype)})") if hi is not None else "0L"
        omin = self.metric(f"nummin_{i}", f"min({num})")
        omax = self.metric(f"nummax_{i}", f"max({num})")
        msg, act = _texts(rt, "failed", column=c)
        self.emit(seq, rt, [c], c, sev, "failed", lit(msg),
                  _evidence(min_allowed=self._bound(lo, dtype), max_allowed=self._bound(hi, dtype),
                            observed_min=omin, observed_max=omax, below_min_count=f"CAST({below} AS BIGINT)",
                            above_max_count=f"CAST({above} AS BIGINT)"),
                  act, f"{below} > 0 OR {above} > 0")

    @staticmethod
    def _bound(text: str | None, dtype: T.DataType) -> str:
        return "CAST(NULL AS DOUBLE)" if text is None else values.number_literal(text, dtype)

    def _pattern(self, rule: Row, seq: int, c: str, sev: str) -> None:
        rt = "pattern_violation"
        pattern = rule["pattern"]
        err = self.pattern_errors[pattern]
        if err is not None:
            msg, act = _texts(rt, "skipped", column=c)
            self.static_finding(seq, rt, [c], c, sev, "skipped", msg, {"pattern": pattern, "error": err}, act)
            return
        dtype = self.types[c]
        x = values.nullified(ident(c), dtype)
        text = values.string_form(ident(c), dtype)
        fails = f"({x} IS NOT NULL AND NOT {patterns.full_match(text, pattern)})"
        failed = self.metric(f"pattern_failed_{seq}", f"count_if({self.feature(f'pf_{seq}', fails)})")
        key = len(self.sample_rules)
        self.sample_rules.append((key, fails, text, False, f"pattern_failed_{seq}", ordered.is_text(dtype)))
        k = self.k
        sample = (f"coalesce(slice(flatten(transform({ident(f'samples_{key}')}, "
                  f"e -> array_repeat(e.value, CAST(least(e.n, {k}) AS INT)))), 1, {k}), CAST(array() AS ARRAY<STRING>))")
        msg, act = _texts(rt, "warning", column=c)
        self.emit(seq, rt, [c], c, sev, "warning", lit(msg),
                  _evidence(pattern=lit(pattern), failed_row_count=failed, sample_failed_values=sample),
                  act, f"{failed} > 0")

    def _length(self, rule: Row, seq: int, c: str, sev: str) -> None:
        rt = "length_violation"
        i = self._idx(c)
        length = self.feature(f"len_{i}", f"char_length({values.string_form(ident(c), self.types[c])})")
        lo, hi = rule["min_length"], rule["max_length"]
        short = self.metric(f"short_{seq}", f"count_if({length} < {lit(lo)})") if lo is not None else "0L"
        long_ = self.metric(f"long_{seq}", f"count_if({length} > {lit(hi)})") if hi is not None else "0L"
        omin = self.metric(f"lenmin_{i}", f"min({length})")
        omax = self.metric(f"lenmax_{i}", f"max({length})")
        msg, act = _texts(rt, "failed", column=c)
        self.emit(seq, rt, [c], c, sev, "failed", lit(msg),
                  _evidence(min_length=f"CAST({lit(lo)} AS INT)", max_length=f"CAST({lit(hi)} AS INT)",
                            observed_min_length=omin, observed_max_length=omax,
                            too_short_count=f"CAST({short} AS BIGINT)", too_long_count=f"CAST({long_} AS BIGINT)"),
                  act, f"{short} > 0 OR {long_} > 0")

    def _freshness(self, rule: Row, seq: int, c: str, sev: str) -> None:
        rt = "freshness_violation"
        i = self._idx(c)
        latest = self.metric(f"tsmax_{i}", f"max({self.timestamp(c)})")
        max_age = rule["max_age_days"]
        ref = f"DATE {lit(self.ref.isoformat())}"
        age = f"datediff({ref}, to_date({latest}))"
        ev = _evidence(latest_value=values.iso_text(latest), reference_date=lit(self.ref.isoformat()),
                       max_age_days=f"CAST({lit(max_age)} AS INT)", observed_age_days=age)
        msg, act = _texts(rt, "skipped", column=c)
        self.emit(seq, rt, [c], c, sev, "skipped", lit(msg), ev, act, f"{latest} IS NULL")
        msg, act = _texts(rt, "warning", column=c)
        self.emit(seq, rt, [c], c, sev, "warning", lit(msg), ev, act,
                  f"{latest} IS NOT NULL AND {age} > {lit(max_age)}")

    def _uniqueness(self, rule: Row, seq: int, cols: list[str], sev: str) -> None:
        rt = "uniqueness_violation"
        name = rule["rule_name"]
        column = cols[0] if len(cols) == 1 else None
        missing = [c for c in cols if c not in self.columns]
        if missing:
            msg, act = _texts(rt, "skipped", name=name)
            self.static_finding(seq, rt, cols, column, sev, "skipped", msg,
                                {"rule_name": name, "checked_columns": cols, "missing_columns": missing}, act)
            return
        j = len(self.uniq_rules)
        self.uniq_rules.append((j, cols))
        dk, dr, sj = ident(f"dupkeys_{j}"), ident(f"duprows_{j}"), ident(f"dupsample_{j}")
        head = _evidence(rule_name=lit(name), checked_columns=_str_array(cols), duplicate_key_count=dk,
                         duplicate_row_count=dr)
        evidence = (f"concat(regexp_replace({head}, '\\\\}}$', ''), ',\"sample_duplicate_keys\":', "
                    f"coalesce({sj}, '[]'), '}}')")
        msg, act = _texts(rt, "failed", name=name)
        self.emit(seq, rt, cols, column, sev, "failed", lit(msg), evidence, act, f"{dk} > 0")

    # -- side jobs ------------------------------------------------------------------
    def _failing(self, rules: Sequence[tuple]) -> DataFrame:
        """(slice, rule, value) of the rows that fail ``rules``."""
        entries = ", ".join(f"CASE WHEN {fails} THEN named_struct('rule', {key}, 'value', {text}) END" for key, fails, text, *_ in rules)
        return self.data.select(*[qcol(k) for k in self.keys], F.expr(f"inline(filter(array({entries}), e -> e IS NOT NULL))"))

    def sample_table(self) -> DataFrame | None:
        """Job B: per slice one column of (rn, value, n) samples for each rule, the first failing values with their counts.

        Rules that want the most frequent values order by count first.
        """
        if not self.sample_rules:
            return None
        counted = [r[0] for r in self.sample_rules if r[3]]
        lead = f"CASE WHEN rule IN ({', '.join(map(str, counted))}) THEN -__n ELSE 0L END" if counted else "0L"
        top, _ = ordered.first_keys(self._failing(self.sample_rules), [*self.keys, "rule"], [("value", any(r[5] for r in self.sample_rules))],
                                    {"sample": self.k}, lead=lead)
        top = top.withColumnsRenamed({"__rn": "rn", "__n": "n"})
        return top.groupBy(*[qcol(k) for k in self.keys]).agg(*[
            F.expr(f"array_sort(collect_list(CASE WHEN rule = {r[0]} THEN struct(rn, value, n) END))").alias(f"samples_{r[0]}")
            for r in self.sample_rules])

    def uniqueness_tables(self) -> list[DataFrame]:
        """Job C: duplicate keys per uniqueness rule and slice (NaN and null are one null); none for rules without any."""
        found = duplicates([UniqueKey(j, self.data, tuple(self.keys), tuple(cols)) for j, cols in self.uniq_rules], self.k)
        return [t.withColumnsRenamed({"dup_keys": f"dupkeys_{j}", "dup_rows": f"duprows_{j}", "dup_sample": f"dupsample_{j}"})
                for j, t in found.items()]


def collect_rules(rules: DataFrame | Sequence[Row], contract_name: str | None = None) -> list[Row]:
    """Rules of one contract, on the driver (bounded: a contract is metadata)."""
    if isinstance(rules, DataFrame):
        if contract_name is not None:
            rules = rules.where(F.col("contract_name") == contract_name)
        rows = rules.collect()
    else:
        rows = list(rules)
        if contract_name is not None:
            rows = [r for r in rows if r["contract_name"] == contract_name]
    names = {r["contract_name"] for r in rows}
    if len(names) > 1:
        raise ValueError(f"rules of several contracts given ({sorted(names)}); pass contract_name")
    return sorted(rows, key=lambda r: (r["rule_order"], r["position"]))


def validate(
    df: DataFrame,
    rules: DataFrame | Sequence[Row],
    *,
    reference_date: _dt.date | None = None,
    by: Sequence[str] | Mapping[str, Column] | None = None,
    max_examples: int = 20,
    run_id: str = "run",
    dataset_name: str = "dataset",
    contract_name: str | None = None,
    rule_types: Sequence[str] | None = None,
) -> Validation:
    """Validate ``df`` against one contract's rules.

    ``by`` slices every data rule (one metrics row per slice); schema-level
    findings belong to the whole dataset (slice '').  ``by=None`` is the
    single-dataset run.  ``rule_types`` restricts the run to those kinds of rules.

    Job A runs now; its result, one row per slice, is kept and read by findings and
    runs alike, and value samples are collected only for rules that failed.
    """
    spark = df.sparkSession
    rows = collect_rules(rules, contract_name)
    if rule_types is not None:
        rows = [r for r in rows if r["rule_type"] in rule_types]
    name = rows[0]["contract_name"] if rows else (contract_name or "")
    ref = reference_date or _dt.date.today()
    dataset_columns = list(df.columns)
    data, slices = with_slices(df, by)
    keys = list(slices.keys)
    errors = patterns.pattern_errors(spark, [r["pattern"] for r in rows if r["rule_type"] == "pattern_violation"])
    comp = _Compiler(data, keys, dataset_columns, df.schema, ref, max_examples, errors)
    for rule in rows:
        if rule["rule_type"] == "row_count_violation":
            comp.compile_row_count(rule)
        else:
            comp.compile(rule)

    metrics = ordered.kept(per_slice_agg(data, keys, comp.aggs, comp.features))
    all_sample_keys = [r[0] for r in comp.sample_rules]
    if comp.sample_rules:
        failed = metrics.agg(*[F.max(F.col(r[4])).alias(r[4]) for r in comp.sample_rules]).first()
        comp.sample_rules = [r for r in comp.sample_rules if (failed[r[4]] or 0) > 0]
    side = comp.sample_table()
    wide = combine_slices([metrics] + ([side] if side is not None else []) + comp.uniqueness_tables(), keys)
    missing = [k for k in all_sample_keys if f"samples_{k}" not in wide.columns]
    if missing:
        wide = wide.withColumns({f"samples_{k}": F.lit(None).cast(_SAMPLE_TYPE) for k in missing})
    unique = [j for j, _ in comp.uniq_rules if f"dupkeys_{j}" not in wide.columns]  # no duplicates
    if unique:
        wide = wide.withColumns({f"{name}_{j}": F.lit(None).cast(t) for j in unique
                                 for name, t in (("dupkeys", "bigint"), ("duprows", "bigint"), ("dupsample", "string"))})

    header = [F.lit(run_id).alias("run_id"), F.lit(name).alias("contract_name"),
              F.lit(dataset_name).alias("dataset_name")]
    if comp.structs:
        emitted = wide.select(*header, slices.label().alias("slice"),
                              F.expr("inline(array(" + ", ".join(comp.structs) + "))"))
        emitted = emitted.where("fires").drop("fires")
    else:
        emitted = spark.createDataFrame([], FINDINGS_SCHEMA)
    static = spark.createDataFrame(
        [dict(run_id=run_id, contract_name=name, dataset_name=dataset_name, slice="", **f) for f in comp.static],
        FINDINGS_SCHEMA,
    )
    findings = emitted.select(*static.columns).unionByName(static)

    per_slice = metrics.select(*header, slices.label().alias("slice"), F.col("rows").alias("row_count"),
                               F.lit(len(dataset_columns)).alias("column_count"))
    if not slices.whole:
        total = metrics.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count")).select(
            *header, F.lit("").alias("slice"), F.col("row_count").cast("bigint"),
            F.lit(len(dataset_columns)).alias("column_count"))
        per_slice = per_slice.unionByName(total)
    return Validation(findings=findings, runs=per_slice, metrics=metrics)
