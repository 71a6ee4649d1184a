"""Document quality by labelling lines with a linear-chain conditional random field.

Every line with a word gets shape features (symbols, case, digits, length, repeats, place in
the text).  A two-state chain, content or boilerplate, is decoded by Viterbi; the share of a
text's word characters in content lines decides whether it is kept, after the plain rules on
word count and repeated word windows.

The chain is trained on a bounded sample of whole labelled documents, the ``max_train`` whose id
hashes lowest, of each label as long as those before have less than half of ``max_train_lines`` lines: lines of low-quality documents count as boilerplate, the others as content, and
the chain learns which shapes and neighbours tell them apart.  Their ids are broadcast to the
scan, the tasks send back line counts and then the features of the documents chosen, and the
log-likelihood is climbed on the driver.  Decoding maps over all documents, whole texts.

Defined cases: null or wordless text has all counts zero and fails the base rules; only
line feeds end lines; without usable labels, or with labels of one kind only, no line is boilerplate;
repeated labels of an id count by the largest; repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.llm.common import texts_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CONTENT_SHARE = 0.5
MAX_TRAIN = 4000
#: Lines of the whole sample.
MAX_TRAIN_LINES = 800_000
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\v\f\r"

#: Words of notices and page furniture.
NOTICE = re.compile(r"copyright|licen[sc]e|all rights reserved|cookie|privacy|subscribe|log ?in|click|terms of", re.I)
FEATURES = ("bias", "symbols > 3 %", "symbols > 10 %", "table bars", "exclaiming", "all capitals", "digits > 20 %",
            "repeats another line", "notice", "one or two words", "three to five words", "over 12 words", "over 40 words",
            "ends a sentence", "starts upper case", "short words", "long words", "half its words repeat", "first line", "last line")


def line_features(line: str, words: list[bytes], repeated: bool, first: bool, last: bool) -> list[int]:
    n, chars = len(words), max(1, sum(map(len, words)))
    symbols = sum(map(line.count, SYMBOLS))
    capitals = line.upper() == line and line.lower() != line
    digits = sum(map(line.count, "0123456789")) if not line.isalpha() else 0
    mean = chars / max(1, n)
    end = line.rstrip()[-1:]
    start = line.lstrip()[:1]
    return [1, symbols > 0.03 * chars, symbols > 0.1 * chars, line.count("|") > 0.2 * n, line.count("!") > 0.2 * n, capitals, digits > 0.2 * chars,
            repeated, NOTICE.search(line) is not None, n <= 2, 3 <= n <= 5, n > 12, n > 40,
            end in ".!?", start.isupper(), mean < 3, mean > 9, n > 5 and len(set(words)) <= 0.5 * n, first, last]


def lines_of(text: str) -> list[tuple[str, list[bytes]]]:
    """The lines that have a word, each with its words."""
    return [(line, words) for line in text.split("\n") if (words := line.encode().split())]


def text_features(lines: list[tuple[str, list[bytes]]]) -> np.ndarray:
    seen: dict[str, int] = {}
    for line, _ in lines:
        seen[line] = seen.get(line, 0) + 1
    last = len(lines) - 1
    return np.array([line_features(line, words, seen[line] > 1, i == 0, i == last) for i, (line, words) in enumerate(lines)],
                    np.int8).reshape(len(lines), len(FEATURES))


# --- the chain --------------------------------------------------------------------


def fit(texts: list[np.ndarray], labels: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature,) of state 1 against 0 and a 2 x 2 transition score, by Adam on the mean log-likelihood."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    lengths = np.array([len(texts[i]) for i in order])
    y = labels[order]
    longest, n, features = int(lengths.max()), len(order), texts[0].shape[1]
    # line t of all texts that have one stands in a row of its own: texts are sorted, so these are the first ones
    steps = np.searchsorted(-lengths, -np.arange(longest), side="left")
    at = np.concatenate(([0], np.cumsum(steps)))
    total = int(at[-1])
    owner = np.arange(total) - np.repeat(at[:-1], steps)
    before = owner[n:] + np.repeat(at[:-2], steps[1:])  # row of the line before
    x = np.zeros((total, features), np.float32)
    for k, i in enumerate(order):
        x[at[: lengths[k]] + k] = texts[i]
    params = np.zeros(features + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    pair_gold = np.zeros((2, 2))
    pair_gold[0, 0], pair_gold[1, 1] = (lengths[y == 0] - 1).clip(0).sum(), (lengths[y == 1] - 1).clip(0).sum()
    for step in range(1, rounds + 1):
        w, trans = params[:features], params[features:].reshape(2, 2)
        unary = np.zeros((total, 2))
        unary[:, 1] = x @ w.astype(np.float32)
        alpha, beta = unary.copy(), np.zeros_like(unary)
        for t in range(1, longest):
            last = alpha[at[t - 1] : at[t - 1] + steps[t]]
            alpha[at[t] : at[t + 1]] += np.logaddexp(last[:, 0, None] + trans[0], last[:, 1, None] + trans[1])
        for t in range(longest - 2, -1, -1):
            after = unary[at[t + 1] : at[t + 2]] + beta[at[t + 1] : at[t + 2]]
            beta[at[t] : at[t] + steps[t + 1]] = np.logaddexp(after[:, 0, None] + trans[:, 0], after[:, 1, None] + trans[:, 1])
        z = np.logaddexp(*(alpha[:n] + beta[:n]).T)
        error = y[owner] - np.exp(alpha[:, 1] + beta[:, 1] - z[owner])
        grad_w = sum(x[k : k + 65536].T @ error[k : k + 65536] for k in range(0, total, 65536))
        joint = alpha[before][:, :, None] + trans + (unary[n:] + beta[n:])[:, None, :] - z[owner[n:], None, None]
        pair = np.exp(joint).sum(axis=0)
        grad = np.concatenate([grad_w, (pair_gold - pair).ravel()]) / total - decay * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:features], params[features:].reshape(2, 2)


def viterbi(unary: np.ndarray, trans: list[list[float]]) -> list[int]:
    """Best states of a line sequence; state 1 scores ``unary``, state 0 scores 0; ties go to state 1 (content)."""
    (t00, t01), (t10, t11) = trans
    back, zero, one = [], 0.0, float(unary[0])
    for u in unary[1:].tolist():
        from_one0, from_one1 = one + t10 >= zero + t00, one + t11 >= zero + t01
        back.append((from_one0, from_one1))
        zero, one = (one + t10 if from_one0 else zero + t00), (one + t11 if from_one1 else zero + t01) + u
    states = [int(one >= zero)]
    for from_one in reversed(back):
        states.append(int(from_one[states[-1]]))
    return states[::-1]


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_train: int = MAX_TRAIN,
          max_train_lines: int = MAX_TRAIN_LINES) -> tuple[np.ndarray, list[list[float]]] | None:
    known = (labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
                   .groupBy("doc_id").agg(F.max(target).cast("int").alias("y")))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    out = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("n", pa.int64()), ("features", pa.binary())])

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [text_features(lines_of(t)) for texts in texts_of(b.column(0)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([len(f) for f in found], pa.int64()),
                                              pa.array([f.tobytes() for f in found], pa.binary())], schema=out)

    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").select("text", "doc_id", "y")
    lines = sample.mapInArrow(features, "doc_id long, y int, n long, features binary").persist()
    try:
        counts = lines.groupBy("doc_id", "y").agg(F.sum("n").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # max_train at most
        chosen, taken = [], {}
        for r in counts:
            if 2 * taken.get(r.y, 0) < max_train_lines:
                chosen.append(r.doc_id)
                taken[r.y] = taken.get(r.y, 0) + r.n
        got = (lines if len(chosen) == len(counts) else lines.where(F.col("doc_id").isin(chosen))).select("y", "features").toArrow()
    finally:
        lines.unpersist()
    rows = sorted((f, y) for y, f in zip(got["y"].to_pylist(), got["features"].to_pylist()) if f)  # reruns agree
    if len({y for _, y in rows}) < 2:
        return None
    texts = [np.frombuffer(f, np.int8).reshape(-1, len(FEATURES)) for f, _ in rows]
    w, trans = fit(texts, np.array([y for _, y in rows]))
    return w, trans.tolist()


# --- measures of a text -----------------------------------------------------------


def repeated_window_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words which the text has twice or more."""
    n = len(words)
    if n <= size:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    keys = ids[: n - size + 1]
    for k in range(1, size):
        if len(number) >= 1 << 20:  # keep the combined key within 64 bits
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * (len(number) + 1) + ids[k : n - size + 1 + k]
        if k + 1 < size and len(number) >= 1 << 20:
            keys = np.unique(keys, return_inverse=True)[1]
    _, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[where] > 1)
    marked = np.zeros(n, bool)
    for k in range(size):
        marked[starts + k] = True
    return int(marked.sum())


def measure(text: str, model) -> tuple[int, int, int, int, int, float]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_share)."""
    lines = lines_of(text)
    words = list(chain.from_iterable(w for _, w in lines))
    word_chars = len(text) - sum(map(text.count, SPACE))
    share = 1.0
    if model is not None and lines:
        states = viterbi(text_features(lines) @ model[0], model[1])
        chars = [len(line) - sum(map(line.count, SPACE)) for line, _ in lines]
        share = sum(c for c, s in zip(chars, states) if s) / word_chars
    return (len(words), word_chars, sum(map(text.count, SYMBOLS)), len(lines) - len({line for line, _ in lines}),
            repeated_window_words(words), share)


def quality(docs: DataFrame, labels: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
            min_content_share: float = MIN_CONTENT_SHARE, **options) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share)."""
    model = train(docs, labels, **options)
    measured = docs.select("doc_id", measure_column(F.col("text"), model).alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (measured.withColumn("base_failed", failed)
                    .withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= min_content_share))
                    .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"))


def measure_column(text: Column, model) -> Column:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            rows = [measure(t, model) for t in chain.from_iterable(texts_of(column))]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
            yield pa.StructArray.from_arrays([*columns, pa.array([r[-1] for r in rows], pa.float64())], [*names, "content_share"])

    schema = ", ".join(f"{n} long" for n in names) + ", content_share double"
    return F.arrow_udf(measures, schema)(text)
