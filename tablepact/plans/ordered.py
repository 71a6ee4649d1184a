"""The first k keys by value over long text, without moving the text.

A key is one or several parts.  Rows are grouped on the first ``SEGMENTS[0]`` characters of
each text part and, if one goes on, a SHA-256 digest of all texts.  Such short keys sort as
the whole ones do, except that keys with one long start are tied (a *class*).  Per group a
window-group limit keeps k + 1 keys of each task; if the k-th and the next one are of one
class, only that class is undecided.  The next, longer segment of its texts decides, in one more
scan of the rows of that class, and so on: a radix selection from the left.  At the end one scan fetches
the whole strings of the chosen keys.

What is broadcast has a row of at most ``ROW_BYTES`` for each undecided group or chosen key, hashes
instead of texts, and goes out in parts of ``BROADCAST_BYTES``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.functions.values import ident, lit
from tablepact.plans.frames import qcol
from tablepact.session import ensure_checkpoint_dir

# Characters that each round looks at; the last size repeats.
SEGMENTS = (256, 2048, 16384)
# Largest set of rows sent to the executors at once; more go in several passes.
BROADCAST_BYTES = 32 << 20
# Upper bound of a row's bytes in that set: two digests, two hashes, counts and an offset for each of up to 40 parts.
ROW_BYTES = 512
# Offset of a part that is decided: nothing is left behind it.
_DONE = 1 << 30


def is_text(dtype: T.DataType) -> bool:
    """Whether values of the type are strings (or become JSON text) and so may be long."""
    return isinstance(dtype, (T.StringType, T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


class _Parts:
    """SQL text over the parts of a key: segments, flags, digests and the order of classes."""

    def __init__(self, parts: Sequence[tuple[str, bool]]):
        self.names = [c for c, _ in parts]
        self.text = [t for _, t in parts]
        n = range(len(parts))
        self.segments, self.more, self.offsets = [f"__s{i}" for i in n], [f"__m{i}" for i in n], [f"__o{i}" for i in n]
        texts = [ident(c) for c, t in parts if t]
        self.any_long = " OR ".join(f"coalesce(char_length({x}) > {SEGMENTS[0]}, false)" for x in texts) or "false"
        self.digest = f"unhex(sha2({self._json(texts)}, 256))"

    @staticmethod
    def _json(items: Sequence[str]) -> str:
        fields = ", ".join(f"'{i}', {x}" for i, x in enumerate(items))
        return f"to_json(named_struct({fields}), map('ignoreNullFields', 'false'))"

    @staticmethod
    def _undecided(flags: Sequence[str]) -> list[str]:
        """Per part whether an earlier part goes on, so that this one must not decide."""
        return [" OR ".join(flags[:i]) or "false" for i in range(len(flags))]

    def keyed(self, length: int, by: Sequence[str], first_round: bool) -> list[str]:
        """Columns of a key at the offsets ``__o``: segments, flags, digest and the digest of its class."""
        seg, more, starts = [], [], []
        for c, text, o in zip(self.names, self.text, self.offsets):
            x = ident(c)
            seg.append(f"substring({x}, {o} + 1, {length})" if text else x)
            more.append(f"coalesce(char_length({x}) > {o} + {length}, false)" if text else "false")
            starts.append(f"left({x}, {o} + {length})" if text else x)
        goes_on = " OR ".join(more)
        start = [f"CASE WHEN NOT ({u}) THEN {s} END" for u, s in zip(self._undecided(more), starts)]
        klass = f"unhex(sha2({self._json([ident(b) for b in by] + start)}, 256))"
        return [*(f"{s} AS {n}" for s, n in zip(seg, self.segments)), *(f"{m} AS {n}" for m, n in zip(more, self.more)),
                f"CASE WHEN {self.any_long if first_round else 'true'} THEN {self.digest} END AS __h",
                f"CASE WHEN {goes_on} THEN {klass} END AS __class"]

    def order(self) -> list[str]:
        """The order of classes: after a part that goes on, later parts count as equal."""
        return [f"CASE WHEN NOT ({u}) THEN {x} END" for s, m, u in zip(self.segments, self.more, self._undecided(self.more)) for x in (s, m)]

    def next_offsets(self, length: int) -> list[str]:
        """Offsets for the class's next round: parts before the first that goes on are done, that one moves on."""
        return [f"CASE WHEN {m} AND NOT ({u}) THEN {o} + {length} WHEN NOT {m} AND NOT ({u}) THEN {_DONE} ELSE {o} END AS __to{i}"
                for i, (m, u, o) in enumerate(zip(self.more, self._undecided(self.more), self.offsets))]


def _by_hash(by: Sequence[str]) -> str:
    return f"xxhash64({', '.join(['0', *map(ident, by)])})"


def _passes(n: int) -> int:
    return max(1, -(-n * ROW_BYTES // BROADCAST_BYTES))


def _in_parts(table: DataFrame, rows: int, use) -> DataFrame:
    """The union of ``use(part)`` over parts of ``table`` that are small enough to broadcast."""
    passes = _passes(rows)
    out = None
    for i in range(passes):
        part = table if passes == 1 else table.where(F.pmod(F.xxhash64("__by", "__class"), F.lit(passes)) == i)
        got = use(part)
        out = got if out is None else out.unionByName(got)
    return out


def first_keys(raw: DataFrame, by: Sequence[str], parts: Sequence[tuple[str, bool]], limits: Mapping[str, int], *, lead: str = "0L",
               having: str = "true", weight: str = "1L") -> tuple[DataFrame, DataFrame]:
    """(the first keys of every group and list, the size of every group).

    ``raw`` has the columns ``by`` and the ``parts`` (name, may it be long text?), a row for ``weight`` (SQL) occurrences.  A key met
    ``__n`` times counts if ``having`` (SQL over ``__n``).  ``limits`` gives for each list its number of keys; they are
    ordered by ``lead`` (SQL over ``__n``, ``__list`` and ``by``), then by the parts, nulls first.  Keys have ``by``,
    ``__list``, ``__n``, the parts (whole) and their place ``__rn``; sizes have ``by``, ``__keys`` and ``__rows``.
    """
    p = _Parts(parts)
    group = [qcol(c) for c in by]
    most = max(limits.values())
    by_sql = [ident(c) for c in by]
    key_columns = [*p.segments, *p.more, "__h", "__class"]
    length = SEGMENTS[0]

    met = F.sum("__w").alias("__n")
    base = raw.selectExpr(*by_sql, *[ident(c) for c in p.names], f"{weight} AS __w", *[f"0 AS {o}" for o in p.offsets])
    counts = base.selectExpr(*by_sql, *p.keyed(length, by, True), "__w").groupBy(*group, *key_columns).agg(met).where(having)
    # reads ``__n`` for both, so that this branch needs the very aggregate of the other one, whichever of them is used
    sizes = counts.groupBy(*group).agg(F.count_if(F.col("__n") > 0).alias("__keys"), F.sum("__n").alias("__rows"))
    need = "element_at(map(" + ", ".join(f"{lit(k)}, {n}" for k, n in limits.items()) + "), __list)"
    lists = "explode(array(" + ", ".join(map(lit, limits)) + "))" if len(limits) > 1 else lit(next(iter(limits)))
    first = counts.withColumn("__list", F.expr(lists)).withColumns({"__need": F.expr(need), **{o: F.lit(0) for o in p.offsets}})

    def limited(df: DataFrame) -> DataFrame:
        """The first ``__need`` + 1 keys of each group and list, classes together."""
        w = Window.partitionBy(*group, "__list").orderBy(F.expr(lead), *[F.expr(x).asc_nulls_first() for x in p.order()], F.col("__h"))
        return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most + 1).where("__rn <= __need + 1")

    columns = [*by, "__list", "__n", "__need", "__rn", *p.offsets, *key_columns]
    picked = limited(first).select(*[qcol(c) for c in columns])
    if not any(p.text):  # every key is whole, no class has two
        chosen = picked.where("__rn <= __need")
        return chosen.select(*group, "__list", "__n", *[F.col(s).alias(c) for s, c in zip(p.segments, p.names)], "__rn"), sizes

    stored = kept(picked.unionByName(sizes.select(*group, F.lit(None).cast("string").alias("__list"), F.col("__keys").alias("__n"),
                                                  F.col("__rows").alias("__total")), allowMissingColumns=True))
    sizes = stored.where("__list IS NULL").select(*group, F.col("__n").alias("__keys"), F.col("__total").alias("__rows"))
    picked = stored.where("__list IS NOT NULL").drop("__total")
    if not stored.where("__h IS NOT NULL").limit(1).count():  # short keys are whole
        chosen = picked.where("__rn <= __need")
        return chosen.select(*group, "__list", "__n", *[F.col(s).alias(c) for s, c in zip(p.segments, p.names)], "__rn"), sizes
    chosen = None
    later = 0
    while True:
        # the class of the last wanted key is undecided if the key after it is of the same class
        w = Window.partitionBy(*group, "__list")
        tagged = picked.withColumn("__same", F.expr(f"concat(__class, encode(CAST({lead} AS STRING), 'UTF-8'))"))
        at = [F.max(F.when(F.col("__rn") == F.col("__need") + d, F.col("__same"))).over(w) for d in (0, 1)]
        tagged = tagged.withColumn("__open", F.when(at[0] == at[1], at[0]))
        tagged = tagged.withColumn("__tied", F.coalesce(F.col("__same") == F.col("__open"), F.lit(False)))
        sure = tagged.where("__rn <= __need AND NOT __tied")
        found = sure.select(*group, "__list", "__n", "__h", *p.segments)
        chosen = found if chosen is None else chosen.unionByName(found)
        inside = F.count_if(F.expr("__rn <= __need AND __tied")).over(w)
        undecided = tagged.withColumn("__inside", inside).where("__rn = __need AND __tied")
        undecided = undecided.selectExpr(f"{_by_hash(by)} AS __by", "__list AS __l", "__class", "CAST(__inside AS INT) AS __need", "__n AS __count",
                                         *[f"{o} AS __was{i}" for i, o in enumerate(p.offsets)], *p.next_offsets(length))
        undecided = kept(undecided)
        n_open = undecided.count()
        if not n_open:
            break
        seen, length = length, SEGMENTS[min(later + 1, len(SEGMENTS) - 1)]
        later += 1
        rows = _in_parts(undecided, n_open, lambda part: _members(raw, by, p, part, seen, weight))
        keyed = rows.selectExpr(*by_sql, "__list", "__need", "__count", "__w", *p.offsets, *p.keyed(length, by, False))
        again = keyed.groupBy(*group, "__list", "__need", "__count", *p.offsets, *key_columns).agg(met).where(having)
        if "__n" in lead:
            again = again.where("__n = __count OR NOT (" + _leads(lead) + ")")
        picked = kept(limited(again).select(*[qcol(c) for c in columns]))
    texts = [(c, s) for c, s, t in zip(p.names, p.segments, p.text) if t]
    fetched = _fetched(chosen, raw, by, p, texts)
    rn = Window.partitionBy(*group, "__list").orderBy(F.expr(lead), *[qcol(c).asc_nulls_first() for c in p.names])
    return fetched.select(*group, "__list", "__n", *[qcol(c) for c in p.names]).withColumn("__rn", F.row_number().over(rn)), sizes


def _leads(lead: str) -> str:
    """SQL: whether the count decides in this list (the lead differs for counts 1 and 2)."""
    return f"({lead.replace('__n', '1L')}) <> ({lead.replace('__n', '2L')})"


def _members(raw: DataFrame, by: Sequence[str], p: _Parts, undecided: DataFrame, seen: int, weight: str) -> DataFrame:
    """The rows of ``raw`` in undecided classes, with their list, what is needed of it, and the next offsets."""
    by_sql = [ident(b) for b in by]
    rows = raw.selectExpr(*by_sql, *[ident(c) for c in p.names], f"{weight} AS __w", f"{_by_hash(by)} AS __rowby").where(p.any_long)
    there = _Parts(list(zip(p.names, p.text)))
    there.offsets = [f"__was{i}" for i in range(len(p.offsets))]
    klass = there.keyed(seen, by, False)[-1].removesuffix(" AS __class")
    joined = rows.join(F.broadcast(undecided), (F.col("__rowby") == F.col("__by")) & (F.expr(klass) == F.col("__class")))
    return joined.selectExpr(*by_sql, *[ident(c) for c in p.names], "__l AS __list", "__need", "__count", "__w", *[f"__to{i} AS {o}" for i, o in enumerate(p.offsets)])


def _fetched(chosen: DataFrame, raw: DataFrame, by: Sequence[str], p: _Parts, texts: Sequence[tuple[str, str]]) -> DataFrame:
    """``chosen`` with whole texts: short keys have them, long ones are looked up by group and digest in one scan."""
    by_hash = f"{_by_hash(by)} AS __by"
    wanted = kept(chosen.where("__h IS NOT NULL").selectExpr(by_hash, "__h AS __class").distinct())
    n = wanted.count()
    plain = chosen.withColumns({c: F.col(s) for c, s in zip(p.names, p.segments)})
    if not n:
        return plain
    rows = raw.where(p.any_long).selectExpr(by_hash, f"{p.digest} AS __class", *[f"{ident(c)} AS __w{i}" for i, (c, _) in enumerate(texts)])
    hits = _in_parts(wanted, n, lambda part: rows.join(F.broadcast(part), ["__by", "__class"], "left_semi"))
    whole = hits.groupBy("__by", "__class").agg(F.first(F.struct(*[f"__w{i}" for i in range(len(texts))])).alias("__whole"))
    joined = plain.withColumn("__by", F.expr(_by_hash(by))).join(
        whole.withColumnRenamed("__class", "__h2").withColumnRenamed("__by", "__by2"), (F.col("__h") == F.col("__h2")) & (F.col("__by") == F.col("__by2")), "left")
    return joined.withColumns({c: F.when(F.col("__h").isNull(), F.col(s)).otherwise(F.col(f"__whole.__w{i}")) for i, (c, s) in enumerate(texts)})
