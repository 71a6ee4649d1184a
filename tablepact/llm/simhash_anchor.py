"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is the majority of the XXH64 bits of a text's word
shingles.  Fingerprints link at ``distance`` or fewer differing bits.

**Anchors.**  The fingerprint is cut into ``segments`` equal parts; two linked
fingerprints differ by at most t = distance // segments bits in one of them.
Per part the anchors are the words of a covering code: the longest Hamming code
that fits (covering radius 1), its spare bits kept as they are.  A fingerprint
goes to every anchor that is the home of a point within t bits of it, all of which
lie within the covering radius plus t; so linked fingerprints meet at the home of
either.  With two segments of 32 bits and 3 bits of distance that is at most 34
anchors out of 2 x 2^27.  (``segments=1`` is the same code over all 64 bits: about
10,000 anchors for each fingerprint.)

**Comparing.**  Distinct fingerprints only are compared, so exact copies never
meet.  An anchor's members are compared by their bits; of its links a spanning
forest is kept, at most one edge a member.  An anchor with more than ``hot``
members is dealt out once more, by the same covering over the halves of the
remaining bits, so that no task gets a crowd of fingerprints that share one part.
Edges are contracted to components by alternating large-star and small-star rounds.

Defined cases: null or wordless text has fingerprint zero and is linked like any
other; fewer words than a shingle: the whole sequence; repeated rows share their
component; ``component_id`` ignores null ids and is null if the whole component has
none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepact.llm.common import in_worker, materialise, texts_of

BITS = 64
SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEED = 42
SEGMENTS = 2
#: Members from which an anchor is dealt out once more.
HOT_ANCHOR = 2000


# --- fingerprints -----------------------------------------------------------------


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle_words, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, len(first))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprint_column(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint of a text column as a (signed) long."""

    def simhash(column: pa.Array) -> pa.Array:
        marks = np.array([fingerprint(t, shingle_words) for texts in texts_of(column) for t in texts], np.uint64)
        return pa.array(marks.view(np.int64))

    return F.arrow_udf(simhash, "long")(text)


def as_hex(mark: Column) -> Column:
    return F.lower(F.lpad(F.hex(mark), 16, "0"))


# --- covering code ----------------------------------------------------------------


def home(part: np.ndarray, width: int) -> np.ndarray:
    """Nearest anchor of each ``width``-bit value: its Hamming word, spare high bits unchanged."""
    checks = (width + 1).bit_length() - 1  # 2**checks - 1 <= width
    columns = np.arange(1, 1 << checks, dtype=np.uint64)
    syndrome = np.zeros(part.shape, np.uint64)
    for c in range(checks):
        mask = np.bitwise_or.reduce(np.where(columns >> np.uint64(c) & np.uint64(1), np.uint64(1) << (columns - np.uint64(1)), np.uint64(0)))
        syndrome |= (np.bitwise_count(part & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(c)
    flip = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1)), np.uint64(0))
    return part ^ flip


def flips(width: int, most: int) -> np.ndarray:
    """All ``width``-bit masks with at most ``most`` ones."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(width), k)], np.uint64)


def anchors(marks: np.ndarray, low: int, width: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the mark, anchor) for the anchors of bits low … low+width-1, each once a mark."""
    part = marks >> np.uint64(low) & np.uint64((1 << width) - 1)
    found = np.sort(home(part[:, None] ^ flips(width, threshold)[None, :], width), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(new)[0], found[new]


def spans(segments: int) -> list[tuple[int, int]]:
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def replicate(marks: DataFrame, distance: int, segments: int) -> DataFrame:
    """(segment, anchor, fingerprint) for each distinct fingerprint."""
    schema = pa.schema([("segment", pa.int32()), ("anchor", pa.int64()), ("fingerprint", pa.int64())])

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(values), 2000):
                in_worker()
                some = values[at : at + 2000]
                for s, (low, width) in enumerate(spans(segments)):
                    i, a = anchors(some, low, width, distance // segments)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(i), s, np.int32)), pa.array(a.view(np.int64)), pa.array(some[i].view(np.int64))], schema=schema)

    return marks.select("fingerprint").mapInArrow(deal, "segment int, anchor long, fingerprint long")


def refine(hot: DataFrame, distance: int, segments: int) -> DataFrame:
    """Members of hot anchors, dealt out by halves of the bits outside their segment."""
    schema = pa.schema([("segment", pa.int32()), ("anchor", pa.int64()), ("part", pa.int32()), ("sub", pa.int64()), ("fingerprint", pa.int64())])

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segment, anchor, marks = (c.to_numpy() for c in batch.columns)
            for s, (low, width) in enumerate(spans(segments)):
                mine = np.flatnonzero(segment == s)
                rest = BITS - width
                for at in range(0, len(mine), 2000):
                    k = mine[at : at + 2000]
                    values = marks[k].view(np.uint64)
                    below = values & np.uint64((1 << low) - 1)
                    above = values >> np.uint64(low + width) if low + width < BITS else np.zeros_like(values)
                    others = below | above << np.uint64(low)
                    for part, (lo, w) in enumerate(((0, rest // 2), (rest // 2, rest - rest // 2))):
                        i, a = anchors(others, lo, w, distance // 2)
                        n = len(i)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, s, np.int32)), pa.array(anchor[k][i]), pa.array(np.full(n, part, np.int32)),
                             pa.array(a.view(np.int64)), pa.array(marks[k][i])], schema=schema)

    return (hot.select("segment", "anchor", "fingerprint")
               .mapInArrow(deal, "segment int, anchor long, part int, sub long, fingerprint long"))


# --- comparing --------------------------------------------------------------------


def forest(marks: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct unsigned marks: pairs of indexes.

    A found mark leaves the pool at once, so a crowd in which all are linked takes
    one step for each few members instead of all pairs.
    """
    edges, pool = [], np.arange(len(marks))
    while len(pool) > 1:
        queue, pool = [int(pool[0])], pool[1:]
        while queue and len(pool):
            at = queue.pop()
            near = np.bitwise_count(marks[pool] ^ marks[at]) <= distance
            if near.any():
                found = pool[near].tolist()
                edges += [(at, j) for j in found]
                queue += found
                pool = pool[~near]
    return edges


def links_per_anchor(members: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """Edges (a, b) between fingerprints that meet at an anchor, a spanning forest of each."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def groups() -> Iterator[np.ndarray]:
            """Sorted rows, cut where a key changes; the last key of a batch waits for the next."""
            nonlocal held
            for batch in batches:
                in_worker()
                rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
                if not len(rows):
                    continue
                rows = np.concatenate([*held, rows])
                change = np.flatnonzero((rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)) + 1
                cuts = np.concatenate(([0], change))
                wide = np.flatnonzero(np.diff(np.append(cuts, len(rows))) > 1)
                for w in wide.tolist():
                    if w + 1 < len(cuts):
                        yield rows[cuts[w] : cuts[w + 1], -1]
                held = [rows[cuts[-1] :]]
            if held and len(held[0]) > 1:
                yield held[0][:, -1]

        out: list[tuple[int, int]] = []
        for group in groups():
            marks = group.view(np.uint64)
            if len(marks) == 2:
                if int(marks[0] ^ marks[1]).bit_count() <= distance:
                    out.append((int(group[0]), int(group[1])))
            else:
                out += [(int(group[i]), int(group[j])) for i, j in forest(marks, distance)]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return (members.select(*keys, "fingerprint").repartition(*keys).sortWithinPartitions(*keys)
                   .mapInArrow(compare, "a long, b long"))


def links(marks: DataFrame, distance: int = MAX_DISTANCE, segments: int = SEGMENTS, hot: int = HOT_ANCHOR) -> DataFrame:
    """Edges that connect every two distinct fingerprints within ``distance`` bits."""
    members = materialise(replicate(marks, distance, segments), "simhash-members")
    key = ["segment", "anchor"]
    crowds = materialise(members.groupBy(*key).count().where(F.col("count") > hot).select(*key), "simhash-crowds")
    if crowds.isEmpty():
        return links_per_anchor(members, key, distance)
    calm = members.join(crowds, key, "left_anti")
    dealt = refine(members.join(crowds, key, "left_semi"), distance, segments)
    return links_per_anchor(calm, key, distance).union(links_per_anchor(dealt, [*key, "part", "sub"], distance))


# --- components -------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its component, for every node but the smallest itself; by alternating stars.

    Large-star hangs a node's larger neighbours on its smallest; small-star its smaller ones.
    Both keep the components; the rounds end when neither changes the edges.
    """
    a, b = F.col("a"), F.col("b")
    now = materialise(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a != b).distinct(), "stars")
    while True:
        both = now.union(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), a).alias("m"))
        large = (both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).distinct())
        large = materialise(large, "stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = materialise(joined.where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
                            .union(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        before = now.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        after = small.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = small
        if before == after:
            return now.select(a.alias("node"), b.alias("label"))


def fingerprinted(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(F.col("text"), shingle_words).alias("fingerprint"))


def fingerprint_components(marks: DataFrame, distance: int = MAX_DISTANCE, segments: int = SEGMENTS, hot: int = HOT_ANCHOR) -> DataFrame:
    """(fingerprint, root, component_id) for a stored (doc_id, fingerprint) table.

    ``root`` names the component by its smallest fingerprint, ``component_id`` by its smallest doc_id.
    """
    distinct = marks.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    labels = components(links(distinct, distance, segments, hot))
    rooted = (distinct.join(labels, distinct.fingerprint == labels.node, "left")
                      .select("fingerprint", "first", F.coalesce("label", "fingerprint").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.select("fingerprint", "root").join(smallest, "root")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE,
                    segments: int = SEGMENTS, hot: int = HOT_ANCHOR) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row a document."""
    marks = materialise(fingerprinted(docs, shingle_words), "simhash-marks")
    groups = fingerprint_components(marks, distance, segments, hot)
    return marks.join(groups, "fingerprint").select("doc_id", as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """The rows of ``docs`` with one document left of each component: that of the smallest id.

    Rows that repeat that id are told apart by their text's hash; whole repeats leave one.
    """
    mark, root, chosen, rank = (f"__simhash_{n}" for n in ("mark", "root", "chosen", "rank"))
    marked = docs.withColumn(mark, fingerprint_column(F.col("text"), shingle_words))
    marks = materialise(marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(mark).alias("fingerprint")), "simhash-marks")
    groups = fingerprint_components(marks, distance, segments).select(
        F.col("fingerprint").alias(mark), F.col("root").alias(root), F.col("component_id").alias(chosen))
    first = marked.join(groups, mark).where(F.col("doc_id").eqNullSafe(F.col(chosen)))
    one = Window.partitionBy(root).orderBy(F.xxhash64("text"))
    return first.withColumn(rank, F.row_number().over(one)).where(F.col(rank) == 1).select(*[docs[c] for c in docs.columns])
