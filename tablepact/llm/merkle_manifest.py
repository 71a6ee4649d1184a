"""Merkle manifest of a documents table as a persistent, path-copying tree.

**Tree.**  Each source has a tree over its documents' leaf hashes; the sources' roots (subroots) have one
on top.  Every three consecutive nodes become the hash of their digests, until one is left.

**Blocks.**  The tree is cut into aligned blocks of seven levels: 2,187 leaves or lower blocks.  A block
is one stored row, so a task holds one block, whatever the size of a source.  Documents are
range-partitioned by (source, id), numbered within their source by the counts of the partitions before, and
gathered by block; block roots are the leaves of the next storey of blocks, two or three storeys in all.
A hot source is thus many blocks in many tasks.

**Versions.**  A tampered leaf makes a version of the tree: its ancestors are copied, every other node is
shared with the original.  Inside the leaf's block the copies are made from the block's nodes.  Above it all
versions of a block share the siblings on the way to the root, stored once a block (``path``), and each
version goes on with its copies in the task that holds its block; no upper block gathers its versions.

``Manifest.report`` gives proofs and the roots that they lead to, ``Manifest.nodes`` the original nodes,
``Manifest.versions`` the copied nodes alone.

Defined cases: a null field is hashed as ``-``; documents of one source order by id, null ids first, equal
ids by leaf hash (rows equal in all five fields get the same leaf, each in a place of its own); null text
is untouched by tampering; a null id counts as empty text for ``tampered_text``; a lone leaf is its
subroot and a lone subroot the root, with empty proofs (the hash of nothing); an empty table gives empty
results; long texts are hashed in the JVM, whole; columns besides the five are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablepact.llm.common import id_remainder, in_worker, long_texts, materialise

ARITY = 3
#: Levels of a block; a block has up to ARITY ** BLOCK_LEVELS members, about 200 KB of digests and ids.
BLOCK_LEVELS = 7
BLOCK = ARITY ** BLOCK_LEVELS

#: Columns that tell sources apart without nulls; their order is that of the subroots.
KEY = ["named", "source"]
REPORT = ("doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
NODE = "source string, on_top boolean, level int, index long, digest string"
VERSION = "doc_id long, source string, on_top boolean, level int, index long, digest string"


# --- leaves -------------------------------------------------------------------------


def leaf_hash(text: Column) -> Column:
    """Hex SHA-256 of the five fields, each with its length in bytes, with ``text`` as the text."""
    fields = [F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), F.col("n_chars").cast("string"), text]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]), 256)


def tampered_text() -> Column:
    """The text without its line ends, for one id in two."""
    return F.when(id_remainder(F.col("doc_id"), 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(named, source, doc_id, leaf, changed): ``changed`` is the leaf of the tampered row if it differs."""
    changed = ~tampered.eqNullSafe(F.col("text"))
    return docs.select(F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("source"),
                       F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf_hash(F.col("text"))).alias("leaf"),
                       F.when(changed, F.unhex(leaf_hash(tampered))).alias("changed"))


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``index``, the place (from 0) among the rows of equal ``key`` in the order of ``order``; stored.

    Rows are range-partitioned and sorted by key and order, numbered within their partition, and moved on by what
    the partitions before hold of their key.  Only a partition's first key can have begun before it, so there is
    at most one such offset a partition.  Rows equal in all these columns are dealt by their first place.
    """
    tie = F.monotonically_increasing_id()
    ranged = rows.withColumn("tie", tie).repartitionByRange(*key, *order, "tie").sortWithinPartitions(*key, *order, "tie").drop("tie")
    schema = T.StructType([*ranged.schema, T.StructField("index", T.LongType())])

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for b in batches:
            in_worker()
            places = []
            for k in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in key)) if key else ((),) * b.num_rows:
                at = at + 1 if k == last else 0
                last = k
                places.append(at)
            yield b.append_column("index", pa.array(places, pa.int64()))

    within = materialise(ranged.mapInArrow(number, schema).withColumn("part", F.spark_partition_id()), name)
    parts = within.groupBy("part", *key).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.withColumn("before", before).where(F.col("before") > 0).drop("n")
    moved = within.join(F.broadcast(offsets), ["part", *key], "left")
    return moved.withColumn("index", F.col("index") + F.coalesce("before", F.lit(0))).drop("part", "before")


# --- blocks -------------------------------------------------------------------------


def combined(digests: list[bytes]) -> bytes:
    """The parent of consecutive nodes: the hash of their digests' hex text."""
    return sha256(b"".join(d.hex().encode() for d in digests)).digest()


def levels_of(digests: list[bytes], block: int) -> list[list[bytes]]:
    """All levels of a block, from its members to its root.

    A block that is not the only one of its tree has all its levels, even where it has few members.
    """
    levels = [digests]
    while len(levels[-1]) > 1 or (block > 0 and len(levels) <= BLOCK_LEVELS):
        below = levels[-1]
        levels.append([combined(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels


def path_of(levels: list[list[bytes]], i: int) -> bytes:
    """The way from member ``i`` to the block's root: for each level its place, the number of siblings and their digests."""
    out = []
    for level in levels[:-1]:
        first = i - i % ARITY
        run = level[first : first + ARITY]
        out.append(bytes((i - first, len(run) - 1)))
        out += run[: i - first] + run[i - first + 1 :]
        i //= ARITY
    return b"".join(out)


def steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place, siblings) of each level of a path."""
    at = 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        yield place, [path[at + 2 + 32 * j : at + 34 + 32 * j] for j in range(n)]
        at += 2 + 32 * n


def copies(digest: bytes, path: bytes) -> list[bytes]:
    """The ancestors that a version with ``digest`` at the start of ``path`` copies; the last is its root."""
    out = []
    for place, siblings in steps(path):
        digest = combined([*siblings[:place], digest, *siblings[place:]])
        out.append(digest)
    return out


def folded(digest: bytes, path: bytes) -> bytes:
    return (copies(digest, path) or [digest])[-1]


def siblings_hex(path: bytes) -> bytes:
    return b"".join(s.hex().encode() for _, siblings in steps(path) for s in siblings)


def by_row(df: DataFrame, make, schema: str) -> DataFrame:
    """mapInArrow of ``make``, which gives the rows (tuples) of one row (a dict)."""
    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                in_worker()
                rows = list(make(b.slice(at, 1).to_pylist()[0]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema))


def in_blocks(nodes: DataFrame, key: list[str], members: str, name: str) -> DataFrame:
    """One stored row a block: (key…, block, members in order)."""
    block = F.floor(F.col("index") / BLOCK).alias("block")
    held = F.sort_array(F.collect_list(F.expr(f"struct(index, {members})")))
    return materialise(nodes.groupBy(*key, block).agg(held.alias("members")), name)


def roots_of(blocks: DataFrame, key: list[str], digest: str) -> DataFrame:
    """(key…, block, root) of each block whose members carry ``digest``."""
    held = blocks.select(*key, "block", F.expr(f"transform(members, m -> m.{digest})").alias("digests"))
    types = ", ".join(f"{c} {dict(blocks.dtypes)[c]}" for c in key)
    return by_row(held, lambda r: [(*[r[c] for c in key], r["block"], levels_of(r["digests"], r["block"])[-1][0])],
                  f"{types}{', ' if types else ''}block long, root binary")


def climb(nodes: DataFrame, key: list[str], name: str, stored: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """From nodes (key…, index, digest): (their paths (key…, index, path), the roots (key…, root)).

    One storey of blocks a call, appended to ``stored``; block roots are the nodes of the next storey.
    """
    blocks = in_blocks(nodes, key, "digest", f"{name}-blocks")
    stored.append(blocks)
    types = "".join(f"{c} {dict(nodes.dtypes)[c]}, " for c in key)

    def paths(r: dict):
        members = r["members"]
        levels = levels_of([m["digest"] for m in members], r["block"])
        for i, m in enumerate(members):
            yield (*[r[c] for c in key], m["index"], r["block"], path_of(levels, i), levels[-1][0])

    within = materialise(by_row(blocks, paths, f"{types}index long, block long, path binary, root binary"), f"{name}-paths")
    if not within.where("block > 0").limit(1).count():
        return within.drop("block", "root"), within.where("index = 0").select(*key, "root")
    tops = within.where(F.col("index") == F.col("block") * BLOCK).select(*key, F.col("block").alias("index"), F.col("root").alias("digest"))
    upper, roots = climb(tops, key, name, stored)
    upper = upper.select(*key, F.col("index").alias("block"), F.col("path").alias("above"))
    return within.join(upper, [*key, "block"]).select(*key, "index", F.concat("path", "above").alias("path")), roots


class Manifest:
    """The manifest of ``docs``; ``tampered`` is the text that the rows are checked with (default: their own)."""

    def __init__(self, docs: DataFrame, tampered: Column | None = None):
        long_texts(docs.sparkSession)
        rows = materialise(leaves(docs, F.col("text") if tampered is None else tampered), "merkle-leaves")
        placed = numbered(rows, KEY, ["doc_id", "leaf"], "merkle-numbered")
        blocks = in_blocks(placed, KEY, "doc_id, leaf, changed", "merkle-leaf-blocks")
        tops = roots_of(blocks, KEY, "leaf").select(*KEY, F.col("block").alias("index"), F.col("root").alias("digest"))
        self.upper: list[DataFrame] = []
        self.top: list[DataFrame] = []
        to_subroot, subroots = climb(tops, KEY, "merkle-source", self.upper)
        subroots = materialise(numbered(subroots, [], KEY, "merkle-sources"), "merkle-subroots")
        to_root, root = climb(subroots.select("index", F.col("root").alias("digest")), [], "merkle-top", self.top)
        top = root.first()
        #: The root's hex digest; None for an empty table.
        self.root: str | None = top["root"].hex() if top else None
        above = subroots.withColumnRenamed("root", "subroot").join(to_root.withColumnRenamed("path", "to_root"), "index").withColumnRenamed("index", "rank")
        paths = to_subroot.select(*KEY, F.col("index").alias("block"), F.col("path").alias("to_subroot")).join(above, KEY)
        #: One row a leaf block: its members and the shared ways up from its root.
        self.blocks = materialise(blocks.join(paths, [*KEY, "block"]), "merkle-manifest")

    def report(self) -> DataFrame:
        """REPORT, a row a document: its leaf and proof, and the root that the tampered (else the own) leaf leads to."""
        root = self.root

        def rows(r: dict):
            levels = levels_of([m["leaf"] for m in r["members"]], r["block"])
            above = r["to_subroot"] + r["to_root"]
            above_hex = siblings_hex(above)
            for i, m in enumerate(r["members"]):
                local = path_of(levels, i)
                version = folded(folded(m["changed"] or m["leaf"], local), above).hex()
                yield (m["doc_id"], r["source"] if r["named"] else None, m["leaf"].hex(), r["subroot"].hex(), root,
                       sha256(siblings_hex(local) + above_hex).hexdigest(), version, version == root)

        return by_row(self.blocks, rows, REPORT)

    def versions(self) -> DataFrame:
        """VERSION: the nodes that each tampered leaf's version copies, and no others.

        ``level`` and ``index`` count within the source's tree, or (``on_top``) within the one over the subroots.
        """

        def rows(r: dict):
            levels = levels_of([m["leaf"] for m in r["members"]], r["block"])
            for i, m in enumerate(r["members"]):
                if m["changed"] is None:
                    continue
                digest = m["changed"]
                for on_top, index, path in ((False, r["block"] * BLOCK + i, path_of(levels, i) + r["to_subroot"]), (True, r["rank"], r["to_root"])):
                    made = [digest, *copies(digest, path)]
                    for level, node in enumerate(made):
                        yield m["doc_id"], r["source"] if r["named"] else None, on_top, level, index // ARITY ** level, node.hex()
                    digest = made[-1]

        return by_row(self.blocks, rows, VERSION)

    def nodes(self) -> DataFrame:
        """NODE: every node of the original tree once; places as in ``versions`` (a subroot is also a leaf on top)."""

        def emit(storey: int, on_top: bool, member: str, above: bool):
            base = storey * BLOCK_LEVELS

            def rows(r: dict):
                for level, digests in enumerate(levels_of([m[member] for m in r["members"]], r["block"])):
                    if level == 0 and above:
                        continue  # the roots of the blocks below
                    for i, d in enumerate(digests, r["block"] * BLOCK // ARITY ** level):
                        yield r["source"] if r.get("named") else None, on_top, base + level, i, d.hex()

            return rows

        out = by_row(self.blocks.select(*KEY, "block", "members"), emit(0, False, "leaf", False), NODE)
        for n, blocks in enumerate(self.upper, 1):
            out = out.unionByName(by_row(blocks, emit(n, False, "digest", True), NODE))
        for n, blocks in enumerate(self.top):
            out = out.unionByName(by_row(blocks, emit(n, True, "digest", n > 0), NODE))
        return out
