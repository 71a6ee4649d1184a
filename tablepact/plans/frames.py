"""Small shared plan helpers: quoting, slices, fused per-slice aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Internal slice columns; no metric, feature or data column has such a name.
SLICE = "__tablepact_slice_"
# Constant slice key used when a run is not sliced, so per-slice side
# tables always combine on a key.
ALL = SLICE + "all__"


def as_column(c: Column | str) -> Column:
    """A Column, or SQL expression text parsed once."""
    return F.expr(c) if isinstance(c, str) else c


def qcol(name: str) -> Column:
    """Column by exact name (dots, spaces and backticks are not syntax)."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Slices:
    """Slice columns of a run: internal column names and the names they are reported by."""

    keys: tuple[str, ...]
    names: tuple[str, ...]

    @property
    def whole(self) -> bool:
        return self.keys == (ALL,)

    def label(self) -> Column:
        """'' for the whole dataset, else ``name=value|name=value``.

        ``\\``, ``|`` and ``=`` in names and values are escaped by a backslash and a
        null value is ``\\N``, so different slices never share a label.
        """
        if self.whole:
            return F.lit("")
        parts = [F.concat(F.lit(_escaped(n) + "="), F.coalesce(_escape(qcol(k).cast("string")), F.lit("\\N")))
                 for k, n in zip(self.keys, self.names)]
        return F.concat_ws("|", *parts)


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("|", "\\|").replace("=", "\\=")


def _escape(c: Column) -> Column:
    return F.when(F.translate(c, "\\|=", "") == c, c).otherwise(F.regexp_replace(c, r"([\\|=])", r"\\$1"))


def with_slices(df: DataFrame, by: Sequence[str] | Mapping[str, Column] | None) -> tuple[DataFrame, Slices]:
    """Attach internal slice columns; the data's own columns stay as they are.

    ``by`` is a list of existing column names or a mapping name -> Column
    (e.g. ``{"month": F.date_trunc("month", "o_orderdate")}``).  Without a
    slice the constant key ``ALL`` is added.
    """
    if not by:
        return df.withColumn(ALL, F.lit(0)), Slices((ALL,), ("",))
    columns = dict(by) if isinstance(by, Mapping) else {name: qcol(name) for name in by}
    keys = tuple(f"{SLICE}{i}__" for i in range(len(columns)))
    return df.withColumns(dict(zip(keys, columns.values()))), Slices(keys, tuple(columns))


def per_slice_agg(data: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column | str],
                  features: Sequence[Mapping[str, Column | str]] = ()) -> DataFrame:
    """One fused aggregate pass per slice (global aggregate when unsliced), however many columns.

    ``features`` are stages of per-row columns (parsed numbers, timestamps,
    lengths, type codes, failure flags) computed in projections below the
    aggregate; a stage may read the names of earlier stages.  Aggregates
    refer to them by name, so an expensive parse runs once per row however
    many aggregates read it.  Unsliced runs use a global aggregate so an
    empty table still yields one row.
    """
    done: list[str] = []
    for stage in features:
        if not stage:
            continue
        data = data.select(*[qcol(k) for k in keys], *[qcol(n) for n in done],
                           *[as_column(c).alias(n) for n, c in stage.items()])
        done += list(stage)
    named = [as_column(c).alias(n) for n, c in aggs.items()] or [F.count(F.lit(1)).alias("__rows")]
    if list(keys) == [ALL]:
        return data.agg(*named).withColumn(ALL, F.lit(0))
    return data.groupBy(*[qcol(k) for k in keys]).agg(*named)


def combine_slices(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Merge per-key tables (at most one row per key each) into one row per key.

    A union plus one grouped ``first(ignorenulls)`` instead of a chain of
    joins: no join condition to get wrong (null slice values group
    together), no nested-loop join for the unsliced constant key, and a
    single small shuffle whatever the number of side tables.
    """
    if len(parts) == 1:
        return parts[0]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p, allowMissingColumns=True)
    quoted = ["`" + c.replace("`", "``") + "`" for c in merged.columns if c not in keys]
    return merged.groupBy(*[qcol(k) for k in keys]).agg(
        *[F.expr(f"first({q}, true) AS {q}") for q in quoted])
