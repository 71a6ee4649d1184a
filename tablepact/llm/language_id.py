"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary
(a sentencepiece model's pieces; characters outside it share one more).  A word's
probability is the sum over all its segmentations into pieces, by the forward
algorithm; a text's is the product over its words.  The piece probabilities are
fitted by expectation maximisation: words with their counts stay in a stored Spark
table, each round's tasks run forward and backward over their words, and the
expected piece counts are summed by Spark.  What returns to the driver is one number for
each language and piece.

Training takes about ``max_train`` labelled texts a language, those whose id hashes
lowest (whole texts).  Scoring maps over all documents; a worker computes each
distinct word once.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is
every text when no language could be learned; a word of any length counts whole (a
text without blanks, tabs or line breaks is one word); equal scores
go to the language that sorts first; other columns are ignored.  ``score`` is the posterior of the predicted language under equal priors.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.llm.common import in_worker, materialise, per_worker, texts_of
from tablepact.llm.token_orc import Numbered, vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
MAX_TRAIN = 1500
ROUNDS = 4
#: Share of every piece probability that is spread evenly.
EVEN = 0.01
#: Characters of a word that are looked up at once, and after which sums are scaled (memory and range of doubles only).
STRETCH = 32
#: Characters of a long word that are looked up at once to find its independent parts.
LOOKUP = 4096
#: Cells of (word, position) worked on at once.
CELLS = 160_000
#: Words whose scores a worker keeps at once (memory only).
WORD_STORE = 150_000
UNKNOWN = "und"

START = "▁"
#: What divides words, in training as in scoring.
BLANKS = re.compile(r"[ \t\n\x0B\f\r]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary, looked up by a hash of the substring; ``size`` is the number given to unknown characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = sorted({model.id_to_piece(i) for i in range(model.get_piece_size())
                        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})
        self.size, self.longest = len(texts), max(map(len, texts))
        keys = np.array([self.hash_text(t) for t in texts], np.uint64)
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.keys >> np.uint64(42)] = True

    @staticmethod
    def hash_text(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, words: list[str], n: int) -> dict[int, np.ndarray]:
        """For words of ``n`` characters: by piece length, a (word, start) matrix of piece numbers, -1 for none."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((len(words), n + 1), np.uint64)
        for i in range(n):
            prefix[:, i + 1] = prefix[:, i] * BASE + points[:, i]
        found, power = {}, np.uint64(1)
        for length in range(1, min(n, self.longest) + 1):
            power = np.uint64(int(power) * int(BASE) & 0xFFFFFFFFFFFFFFFF)
            keys = prefix[:, length:] - prefix[:, :-length] * power
            pieces = np.full(keys.shape, self.size if length == 1 else -1, np.int32)
            hits = np.nonzero(self.maybe[keys >> np.uint64(42)])
            if len(hits[0]):
                k = keys[hits]
                at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
                real = self.keys[at] == k
                pieces[hits[0][real], hits[1][real]] = self.order[at[real]]
            found[length] = pieces
        return found

    def independent(self, word: str) -> list[str]:
        """A long word's parts between positions that no piece reaches across; its sum is the product of theirs, exactly."""
        n = len(word)
        if n <= STRETCH:
            return [word]
        ends = np.zeros(n + 1, np.int64)
        for a in range(0, n, LOOKUP):
            some = word[a : a + LOOKUP + self.longest - 1]
            for length, pieces in self.find([some], len(some)).items():
                starts = a + np.flatnonzero(pieces[0, :LOOKUP] >= 0)
                if length > 1:
                    ends[starts + 1] += 1
                    ends[starts + length] -= 1
        cuts = [0, *(np.flatnonzero(np.cumsum(ends)[1:n] == 0) + 1).tolist(), n]
        return [word[i:j] for i, j in zip(cuts, cuts[1:])]


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths).tolist():
        yield n, np.flatnonzero(lengths == n)


def in_cells(rows: np.ndarray, length: int) -> Iterator[np.ndarray]:
    most = max(1, CELLS // length)
    for at in range(0, len(rows), most):
        yield rows[at : at + most]


def stretches(n: int) -> list[tuple[int, int]]:
    return [(a, min(a + STRETCH, n)) for a in range(0, n, STRETCH)]


def step(alpha: Callable[[int], np.ndarray], found: dict[int, np.ndarray], j: int, origin: int, table: np.ndarray) -> np.ndarray:
    """The sum up to position ``j`` from the sums before it; ``found`` starts at ``origin``, ``table`` is (piece, language)."""
    now = alpha(j - 1) * table[found[1][:, j - 1 - origin]]
    for length in range(2, min(j, len(found)) + 1):
        piece = found[length][:, j - length - origin]
        hit = np.flatnonzero(piece >= 0)
        if len(hit):
            now[hit] += alpha(j - length)[hit] * table[piece[hit]]
    return now


def forward(pieces: Pieces, words: list[str], table: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations of each word (all of one length), per language.

    A word goes through in stretches.  After each, the sums that later positions can reach are divided by the
    last one, whose log is kept, so that no word is too long for a double and none is cut.
    """
    n, reach = len(words[0]), pieces.longest
    logs = np.zeros((len(words), table.shape[1]))
    kept = [np.ones_like(logs)]  # of the last positions, the first of them ``origin``
    origin = 0
    for start, stop in stretches(n):
        found = pieces.find([w[origin:stop] for w in words], stop - origin)
        for j in range(start + 1, stop + 1):
            kept.append(step(lambda i: kept[i - origin], found, j, origin, table))
        scale = kept[-1]
        logs += np.log(scale)
        first = max(stop - reach + 1, origin)
        kept = [k / scale for k in kept[first - origin :]]
        origin = first
    return logs


def expected_counts(pieces: Pieces, words: list[str], table: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected piece counts of words of one length with ``weights`` under one language's probabilities (piece,).

    Sums from the left and from the right are scaled stretch by stretch, each position's scale known by its log.
    """
    n, reach, column = len(words[0]), pieces.longest, table[:, None]
    alpha, left = np.empty((n + 1, len(words))), np.zeros((n + 1, len(words)))
    alpha[0], logs, origin = 1.0, np.zeros(len(words)), 0
    kept = [np.ones((len(words), 1))]
    for start, stop in stretches(n):
        found = pieces.find([w[origin:stop] for w in words], stop - origin)
        for j in range(start + 1, stop + 1):
            kept.append(step(lambda i: kept[i - origin], found, j, origin, column))
            alpha[j], left[j] = kept[-1][:, 0], logs
        scale = kept[-1]
        logs = logs + np.log(scale[:, 0])
        first = max(stop - reach + 1, origin)
        kept = [k / scale for k in kept[first - origin :]]
        origin = first
    total = left[n] + np.log(alpha[n])

    counts = np.zeros(len(table))
    beta, right = {n: np.ones(len(words))}, np.zeros(len(words))  # sums from the right, all over exp(right)
    for start, stop in reversed(stretches(n)):
        end = min(stop + reach, n)
        found = pieces.find([w[start:end] for w in words], end - start)
        for i in range(stop - 1, start - 1, -1):
            share = weights * alpha[i] * np.exp(left[i] + right - total)
            summed = np.zeros(len(words))
            for length in range(1, min(n - i, len(found)) + 1):
                piece = found[length][:, i - start]
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    after = table[piece[hit]] * beta[i + length][hit]
                    summed[hit] += after
                    counts += np.bincount(piece[hit], share[hit] * after, len(table))
            beta[i] = summed
        scale = beta[start]
        right = right + np.log(scale)
        beta = {i: b / scale for i, b in beta.items() if i < start + reach}
    return counts


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (piece, language) probabilities
    vocabulary: str


def word_counts(docs: DataFrame, max_train: int) -> tuple[list[str], DataFrame]:
    """(languages, (lang number, word, n)) of the training sample."""
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = usable.groupBy("lang").count().orderBy("lang").collect()  # one row a language
    languages = [r["lang"] for r in sizes]
    share = [min(1.0, max_train / r["count"]) for r in sizes]
    bound = docs.sparkSession.createDataFrame([(r, i, int(s * (1 << 30))) for i, (r, s) in enumerate(zip(languages, share))],
                                              "lang string, number int, bound long")
    sample = usable.join(F.broadcast(bound), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("bound"))
    words = (sample.select("number", F.explode(F.split(F.lower("text"), BLANKS.pattern)).alias("word"))
                   .where(F.col("word") != "").groupBy("number", "word").agg(F.count("*").alias("n")))
    return languages, materialise(words, "language-words")


def train(docs: DataFrame, vocabulary: str = VOCABULARY, max_train: int = MAX_TRAIN, rounds: int = ROUNDS) -> LanguageModel:
    """Fit piece probabilities for every language of ``docs`` (doc_id, text, lang)."""
    languages, words = word_counts(docs, max_train)
    size = Pieces(vocabulary_path(vocabulary)).size + 1
    table = np.full((size, max(len(languages), 1)), 1.0 / size)
    out = pa.schema([("number", pa.int32()), ("piece", pa.int32()), ("n", pa.float64())])

    for _ in range(rounds if languages else 0):

        def expect(batches: Iterable[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            pieces = per_worker("pieces", vocabulary, lambda: Pieces(vocabulary_path(vocabulary)))
            total = np.zeros(table.T.shape)
            for batch in batches:
                in_worker()
                number, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                parts = [(i, p) for i, w in enumerate(batch.column(1).to_pylist()) for p in pieces.independent(START + w)]
                row, texts = np.array([i for i, _ in parts]), [p for _, p in parts]
                for length, some in by_length(texts):
                    for k in range(len(total)):
                        mine = some[number[row[some]] == k]
                        for piece in in_cells(mine, length):
                            total[k] += expected_counts(pieces, [texts[i] for i in piece], table[:, k], n[row[piece]].astype(float))
            k, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[k, piece])], schema=out)

        got = words.mapInArrow(expect, "number int, piece int, n double").groupBy("number", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(table.shape)
        counts[got["piece"], got["number"]] = got["n"]
        table = (1 - EVEN) * counts / np.maximum(counts.sum(axis=0), 1e-300) + EVEN / size
    return LanguageModel(languages, table, vocabulary)


class TextScorer:
    """Log probabilities of texts under every language, each distinct word computed once."""

    def __init__(self, model: LanguageModel, pieces: Pieces):
        self.model, self.pieces = model, pieces
        self.words, self.logs = Numbered(), np.zeros((0, len(model.languages)))

    def learn(self) -> None:
        new = self.words.keys_new
        if not new:
            return
        self.words.keys_new = []
        parts = [(i, p) for i, w in enumerate(new) for p in self.pieces.independent(START + w)]
        row, texts = np.array([i for i, _ in parts]), [p for _, p in parts]
        logs = np.zeros((len(new), len(self.model.languages)))
        for length, some in by_length(texts):
            for piece in in_cells(some, length):
                np.add.at(logs, row[piece], forward(self.pieces, [texts[i] for i in piece], self.model.table))
        self.logs = np.concatenate([self.logs, logs])

    def score(self, texts: list[str]) -> np.ndarray:
        if len(self.words) > WORD_STORE:
            self.words, self.logs = Numbered(), self.logs[:0]
        split = [list(filter(None, BLANKS.split(t.lower()))) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        words = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        self.learn()
        totals = np.zeros((len(texts), self.logs.shape[1]))
        some = np.flatnonzero(counts)
        if len(some):
            totals[some] = np.add.reduceat(self.logs[words], np.concatenate(([0], np.cumsum(counts)[:-1]))[some])
        return totals


def predict_column(text: Column, model: LanguageModel) -> Column:
    """struct(lang_pred, score) for each text."""
    if not model.languages:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = TextScorer(model, per_worker("pieces", model.vocabulary, lambda: Pieces(vocabulary_path(model.vocabulary))))
        names = np.array([*model.languages, UNKNOWN], object)
        for column in batches:
            best, score, at = np.empty(len(column), np.int64), np.empty(len(column)), 0
            for texts in texts_of(column):
                totals = scorer.score(texts)
                odds = np.exp(totals - totals.max(axis=1, keepdims=True))
                known = np.array([any(map(str.isalpha, t)) for t in texts])
                here = slice(at, at := at + len(texts))
                best[here] = np.where(known, odds.argmax(axis=1), len(model.languages))
                score[here] = np.where(known, odds.max(axis=1) / odds.sum(axis=1), 0.0)
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], ["lang_pred", "score"])

    return F.arrow_udf(predict, "lang_pred string, score double")(text)


def language_predictions(docs: DataFrame, keep: Column | None = None, **options) -> DataFrame:
    """(doc_id, lang_pred, score) for every document; rows for which ``keep`` holds may train."""
    model = train(docs if keep is None else docs.where(keep), **options)
    return docs.select("doc_id", predict_column(F.col("text"), model).alias("p")).select("doc_id", "p.*")


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with at least ``min_score``."""
    found = "__language_found"
    return (docs.withColumn(found, predict_column(F.col("text"), model))
                .where((F.col(found)["lang_pred"] != UNKNOWN) & (F.col(found)["score"] >= min_score)).drop(found))
