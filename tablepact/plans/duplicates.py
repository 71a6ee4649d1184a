"""Duplicates of many unique keys: one scan of hashes for all of them, whole keys only where a hash repeats.

Every row gives one 64-bit hash for each unique key, over the slice and the key's values.  One aggregate
counts them for all keys of all datasets; what crosses the network is (rule, hash), never a key, however
wide the key or long its text.  A key met twice has a hash met twice, so rows with other hashes can't be
duplicates; of the rest the exact selection (``plans.ordered``) is made on the keys themselves.  A rule
without a repeated hash needs no further pass.

The repeated hashes of a rule go out by broadcast while they are at most ``MOST_HASHES``.  A rule with more is
mostly duplicates, which a filter would not thin out: all its rows enter the exact selection, whose
result is the same.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.functions import values
from tablepact.functions.values import ident
from tablepact.plans import ordered
from tablepact.plans.frames import combine_slices, qcol

#: Bytes of a hash in a broadcast table, by which the largest broadcast set is bounded.
HASH_BYTES = 32
_WITH_NULLS = "map('ignoreNullFields', 'false')"
MOST_HASHES = ordered.BROADCAST_BYTES // HASH_BYTES


@dataclass(frozen=True)
class UniqueKey:
    """One unique key: ``rule`` names it, ``data`` has the slice columns ``keys`` and the key's ``columns``."""

    rule: int
    data: DataFrame
    keys: tuple[str, ...]
    columns: tuple[str, ...]

    @property
    def text(self) -> list[bool]:
        return [ordered.is_text(self.data.schema[c].dataType) for c in self.columns]

    @property
    def parts(self) -> list[str]:
        """SQL text of the values as they are compared: NaN and null are one null, nested values are JSON."""
        out = []
        for c, text in zip(self.columns, self.text):
            dtype = self.data.schema[c].dataType
            if not text:
                out.append(values.nullified(ident(c), dtype))
            elif isinstance(dtype, (T.StringType, T.BinaryType)):
                out.append(values.string_form(ident(c), dtype))
            else:
                out.append(f"to_json({ident(c)})")
        return out

    @property
    def hash(self) -> str:
        # a null leaves a hash as it was, so its place is told beside it
        items = [*map(ident, self.keys), *self.parts]
        return f"xxhash64({', '.join(f'{x}, isnull({x})' for x in items)})"


def repeated_hashes(unique: Sequence[UniqueKey]) -> tuple[DataFrame, dict[int, int]]:
    """((rule, hash) met more than once, how many of them each rule has); one scan of each dataset."""
    by_data: dict[int, list[UniqueKey]] = {}
    for u in unique:
        by_data.setdefault(id(u.data), []).append(u)
    rows = None
    for same in by_data.values():
        pairs = ", ".join(f"named_struct('rule', {u.rule}, 'hash', {u.hash})" for u in same)
        part = same[0].data.select(F.expr(f"inline(array({pairs}))"))
        rows = part if rows is None else rows.unionByName(part)
    counted = rows.groupBy("rule", "hash").agg(F.count(F.lit(1)).alias("n"))
    repeated = ordered.kept(counted.where("n > 1").select("rule", "hash"))
    return repeated, {r["rule"]: r["count"] for r in repeated.groupBy("rule").count().collect()}


def duplicates(unique: Sequence[UniqueKey], k: int) -> dict[int, DataFrame]:
    """For each rule with a repeated hash: (slice columns, dup_keys, dup_rows, dup_sample), a row a slice.

    ``dup_sample`` is a JSON array of the first ``k`` duplicate keys.
    """
    if not unique:
        return {}
    repeated, sizes = repeated_hashes(unique)
    out = {}
    for u in unique:
        n = sizes.get(u.rule, 0)
        if not n:
            continue
        group = [qcol(c) for c in u.keys]
        parts = [f"__v{i}" for i in range(len(u.columns))]
        data = u.data
        if n <= MOST_HASHES:
            wanted = repeated.where(F.col("rule") == u.rule).select(F.col("hash").alias("__hash"))
            data = data.withColumn("__hash", F.expr(u.hash)).join(F.broadcast(wanted), "__hash", "left_semi")
        raw = data.select(*group, *[F.expr(f"{x} AS {v}") for x, v in zip(u.parts, parts)])
        first, counts = ordered.first_keys(raw, list(u.keys), list(zip(parts, u.text)), {"key": k}, having="__n > 1")
        shown = "struct(" + ", ".join(f"{v} AS {ident(c)}" for v, c in zip(parts, u.columns)) + ")"
        samples = first.groupBy(*group).agg(F.expr(
            f"to_json(transform(array_sort(collect_list(struct(__rn, {shown} AS key))), e -> e.key), {_WITH_NULLS})").alias("dup_sample"))
        out[u.rule] = combine_slices([counts.withColumnsRenamed({"__keys": "dup_keys", "__rows": "dup_rows"}), samples], u.keys)
    return out
