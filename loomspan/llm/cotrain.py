"""Quality classifier by co-training on two views of a document.

One logistic classifier sees the text (words, their stems and style), the other what is known about the
page without reading it (source, language, length).  Both start from labelled documents.  In
each round they score all documents, and those that one view is sure of are counted, with the
label it gives them, among the features of the other: the other learns the log odds of its
features by these counts and is fitted again with them.  Both are then
calibrated on labelled documents held back, and a third, also fitted there, combines the
calibrated views.  Scoring is one pass without a shuffle.

Only labelled documents are sampled: at most ``SAMPLE_DOCS`` distinct texts, those of least
hash, of ``SAMPLE_BYTES`` together.  Pseudo-labels come from all documents; their counts have a row a
feature, and features are ``VOCABULARY`` words and ``META`` places for hashed metadata.  The fit
is one task of an executor, and the order of rows changes nothing.

Defined results: a null text is scored as an empty one; unseen or null metadata counts as
unknown; repeated rows get the same score; without labels of both kinds every document is
kept with score one; an empty table gives an empty result; other columns pass through
``kept`` unchanged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .langid import letters
from .shared import ACTION, Workspace, fitted, least_hashes, setting, ship

SAMPLE_DOCS = 8_000
SAMPLE_BYTES = 16 << 20
VOCABULARY = 5_000
META = 1 << 15
LEAST_DOCS = 5
STEM = 5  # bytes
ROUNDS = 2  # exchanges of pseudo-labels
SURE = 0.98
THRESHOLD = 0.5

U = np.uint64
FOLDED = textscan.BYTE_VALUES.copy()
FOLDED[65:91] = FOLDED[97:123]


@dataclass
class Rows:
    """Sparse rows (feature numbers, one document after another) and dense columns."""

    ids: np.ndarray
    count: np.ndarray
    dense: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        begin = np.cumsum(self.count) - self.count
        count = self.count[rows]
        at = np.repeat(begin[rows] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return Rows(self.ids[at], count, self.dense[rows])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Logistic:
    """Logistic regression by AdaGrad on sparse and standardised dense features."""

    def __init__(self, n: int):
        self.sparse = np.zeros(n)

    def fit(self, x: Rows, y: np.ndarray, epochs: int = 12, batch: int = 256, penalty: float = 1e-4, seed: int = 3) -> Logistic:
        self.mean, self.scale = x.dense.mean(axis=0), x.dense.std(axis=0) + 1e-6
        self.sparse[:] = 0
        self.dense, self.bias = np.zeros(x.dense.shape[1]), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        squares, squares_dense, rng = np.full_like(self.sparse, 1e-2), np.full_like(self.dense, 1e-2), np.random.default_rng(seed)
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(y)), -(-len(y) // batch)):
                part = x.take(rows)
                slope = (sigmoid(self.logit(part)) - y[rows]) / len(rows)
                step = np.bincount(part.ids, np.repeat(slope, part.count), len(self.sparse)) + penalty * self.sparse
                squares += step * step
                self.sparse -= 0.3 * step / np.sqrt(squares)
                step = ((part.dense - self.mean) / self.scale * slope[:, None]).sum(axis=0) + penalty * self.dense
                squares_dense += step * step
                self.dense -= 0.3 * step / np.sqrt(squares_dense)
                self.bias -= 0.3 * slope.sum()
        return self

    def logit(self, x: Rows) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.sparse[x.ids])])
        ends = np.cumsum(x.count)
        return total[ends] - total[ends - x.count] + ((x.dense - self.mean) / self.scale) @ self.dense + self.bias


def style(part: textscan.Slice) -> np.ndarray:
    """Eight dense features of each document's surface."""
    text, at = part.text, part.bounds()

    def counted(marked: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(marked))[part.offsets])

    words = np.diff(at)
    per_word = np.maximum(words, 1)
    upper, symbol = counted((text >= 65) & (text <= 90)), counted(np.isin(text, np.frombuffer(b"#*$%&|<>!", np.uint8)))
    digit, line = counted((text >= 48) & (text <= 57)), counted(text == 10)
    length = np.diff(np.append(0, np.cumsum(part.end - part.start))[at])
    same = np.zeros(len(part.hash) + 1)
    same[2:] = np.cumsum((part.hash[1:] == part.hash[:-1]) & (part.row[1:] == part.row[:-1])) if len(part.hash) else 0
    again = same[at[1:]] - same[at[:-1]]
    distinct = np.array([len(np.unique(part.hash[a:b])) for a, b in zip(at[:-1], at[1:])])
    columns = [upper, symbol, digit, line, length, again, distinct]
    return np.stack([c / per_word for c in columns] + [np.log1p(words)], axis=1)


def tokens(part: textscan.Slice) -> np.ndarray:
    """(words, 2): each word's hash and that of its stem, its first bytes; 0 where it is no longer than that."""
    longer = part.end - part.start > STEM
    stem = np.zeros(len(part.hash), U)
    for k in range(STEM):
        stem[longer] = textscan.mix(stem[longer] + FOLDED[part.text[part.start[longer] + k]])
    return np.stack([part.hash, stem], axis=1)


def text_rows(part: textscan.Slice, vocabulary: np.ndarray) -> Rows:
    """Which words and stems of the vocabulary a document has, and its style."""
    dense = style(part)
    if not len(vocabulary) or not len(part.hash):
        return Rows(np.zeros(0, np.int64), np.zeros(part.n, np.int64), dense)
    own, row = tokens(part).ravel(), np.repeat(part.row, 2)
    spot = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
    known = vocabulary[spot] == own
    pairs = np.unique(row[known] * len(vocabulary) + spot[known])
    return Rows(pairs % len(vocabulary), np.bincount(pairs // len(vocabulary), minlength=part.n), dense)


def meta_rows(table: dict[str, list]) -> Rows:
    """Source, language and size class as hashed features."""
    ids = []
    for source, lang, n_chars in zip(table["source"], table["lang"], table["n_chars"]):
        size = int(np.log2(max(n_chars or 0, 0) + 1))
        ids += [zlib.crc32(k.encode()) % META for k in (f"source={source}", f"lang={lang}", f"size={size}", f"{lang}/{size}")]
    n_chars = np.array([max(x or 0, 0) for x in table["n_chars"]], float)
    return Rows(np.array(ids, np.int64), np.full(len(n_chars), 4, np.int64), np.log1p(n_chars)[:, None])


@dataclass
class View:
    """One view's classifier, and the log odds of its features by what the other view handed over."""

    learner: Logistic
    odds: np.ndarray

    def rows(self, x: Rows) -> Rows:
        """``x`` with the mean log odds of its features as one more column."""
        total = np.concatenate([[0], np.cumsum(self.odds[x.ids])])
        ends = np.cumsum(x.count)
        mean = (total[ends] - total[ends - x.count]) / np.maximum(x.count, 1)
        return Rows(x.ids, x.count, np.column_stack([x.dense, mean]))

    def logit(self, x: Rows) -> np.ndarray:
        return self.learner.logit(self.rows(x))


def log_odds(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Of each feature, from how often it stood in good and in bad documents; none where either kind is unknown."""
    if not good.sum() or not bad.sum():
        return np.zeros(len(good))
    return np.log((good + 1) / (good.sum() + len(good))) - np.log((bad + 1) / (bad.sum() + len(bad)))


@dataclass
class Model:
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    text: View | None = None
    meta: View | None = None
    calibration: list[tuple[float, float]] = field(default_factory=list)
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def views(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated logit of a good document by either view."""
        (a, b), (c, d) = self.calibration
        return a * self.text.logit(text) + b, c * self.meta.logit(meta) + d

    def scores(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of a good document by either view and by both."""
        u, v = self.views(text, meta)
        return sigmoid(u), sigmoid(v), sigmoid(self.weights[0] * u + self.weights[1] * v + self.weights[2])


def _line(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights and intercept of a small logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, x.T @ (p - y) + penalty * w), -1, 1)
    return w


def _columns(table: pa.Table) -> dict[str, list]:
    return {c: table.column(c).to_pylist() for c in ("source", "lang", "n_chars")}


def _slices(texts: pa.ChunkedArray) -> Iterator[textscan.Slice]:
    return textscan.slices(texts.combine_chunks(), letters())


def _vocabulary(texts: pa.ChunkedArray, good: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Words of several documents whose share of bad ones is least like chance; counts are merged slice by slice."""
    words, counts, bad_in = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in _slices(texts):
        at, found = part.bounds(), tokens(part)
        own = [np.unique(found[at[k] : at[k + 1]]) for k in range(part.n)]
        bad = np.repeat(1 - good[part.first : part.first + part.n], [len(x) for x in own]).astype(np.int64)
        used = np.repeat(~held[part.first : part.first + part.n], [len(x) for x in own])
        both = np.concatenate([words, np.concatenate(own)[used]])
        words, index = np.unique(both, return_inverse=True)
        counts = np.bincount(index, np.concatenate([counts, np.ones(int(used.sum()), np.int64)]), len(words)).astype(np.int64)
        bad_in = np.bincount(index, np.concatenate([bad_in, bad[used]]), len(words)).astype(np.int64)
    rate = float(1 - good[~held].mean())
    surprise = (bad_in - counts * rate) ** 2 / np.maximum(counts * rate * (1 - rate), 1e-9)
    often = np.flatnonzero((counts >= LEAST_DOCS) & (words != 0))
    return np.sort(words[often[np.argsort(-surprise[often], kind="stable")[:VOCABULARY]]])


def train(labelled: pa.Table, known: tuple[np.ndarray, list[np.ndarray]] | None = None) -> Model | None:
    """``labelled`` has h, text, source, lang, n_chars and good; ``known`` the vocabulary and both views' log odds of a round before."""
    labelled = labelled.sort_by("h")
    good = np.array(labelled.column("good").to_pylist(), float)
    if not len(good) or good.min() == good.max():
        return None
    held = np.arange(len(good)) % 5 == 0
    if not held.any() or good[held].min() == good[held].max() or good[~held].min() == good[~held].max():
        held = np.zeros(len(good), bool)  # too few to hold any back
    vocabulary = known[0] if known else _vocabulary(labelled.column("text"), good, held)
    odds = known[1] if known else [np.zeros(max(len(vocabulary), 1)), np.zeros(META)]
    parts = [Rows(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, 8)))]
    for part in _slices(labelled.column("text")):
        found = text_rows(part, vocabulary)
        parts.append(Rows(found.ids.astype(np.int32), found.count, found.dense))
    text = Rows(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("ids", "count", "dense")))
    train_rows, back = np.flatnonzero(~held), np.flatnonzero(held) if held.any() else np.arange(len(good))
    model, logits = Model(vocabulary), []
    for own, by_other in zip((text, meta_rows(_columns(labelled))), odds):
        view = View(Logistic(len(by_other)), by_other)
        view.learner.fit(view.rows(own.take(train_rows)), good[train_rows])
        logits.append(view.logit(own.take(back)))
        model.text, model.meta = model.meta, view  # text comes first
    y = good[back]
    model.calibration = [tuple(_line(z[:, None], y)) for z in logits]
    both = np.column_stack([a * z + b for z, (a, b) in zip(logits, model.calibration)])
    model.weights = tuple(_line(both, y, penalty=5.0))  # firm: a view that says nothing stays out
    return model


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(h, text, source, lang, n_chars, good) of the labelled distinct texts of least hash; good is of quality and not toxic.

    An id or a text with several labels counts as bad if any says so.  What is known about a page
    is taken from one of the rows that have its text.
    """
    good = (F.coalesce(F.col("quality"), F.lit(1)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of_doc")).agg(F.min(good).alias("good"))
    some = inputs(docs).withColumns({"h": F.xxhash64("text"), "r": F.xxhash64("doc_id", "source", "lang", "n_chars")})
    slim = some.select("doc_id", "h", "r", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    texts = slim.join(known, F.col("doc_id") == F.col("of_doc")).groupBy("h").agg(F.min("good").alias("good"), F.min("r").alias("r"), F.first("size").alias("size"))
    work = Workspace(docs.sparkSession, "cotrain")
    texts = work.table(texts.withColumn("one", F.lit(1)), "texts")
    chosen = least_hashes(texts, {1: texts.count()}, most, "one", most_bytes)
    return work.table(some.join(F.broadcast(chosen.select("h", "r", "good")), ["h", "r"]).dropDuplicates(["h"]).select("h", "text", "source", "lang", "n_chars", "good"), "sample")


def inputs(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "long", "text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return docs.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])


def handed(docs: DataFrame, model: Model) -> list[np.ndarray]:
    """Log odds of either view's features by the documents that the other view is sure of, counted over all documents.

    A task adds up its documents and gives a row a feature; what reaches the driver has a row a feature too.
    """
    ship(docs.sparkSession)
    sizes = [len(model.text.odds), META]
    limit = float(np.log(SURE / (1 - SURE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros((2, n), np.int64) for n in sizes]
        for batch in batches:
            for rows in _rows(model, {c: k for k, c in enumerate(docs_columns)}, batch):
                logits = model.views(*rows)
                for own, other, count in zip(rows, reversed(logits), counts):
                    for label, at in enumerate((other <= -limit, other >= limit)):
                        count[label] += np.bincount(own.take(np.flatnonzero(at)).ids, minlength=count.shape[1])
        for view, count in enumerate(counts):
            at = np.flatnonzero(count.sum(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), view), pa.int32()), pa.array(at, pa.int32()), pa.array(count[0, at]), pa.array(count[1, at])], names=["view", "feature", "bad", "good"])

    table = inputs(docs)
    docs_columns = table.columns
    sums = table.mapInArrow(run, "view int, feature int, bad long, good long").groupBy("view", "feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    with setting(docs.sparkSession, ACTION):
        sums = sums.toArrow()
    out, view = [], sums.column("view").to_numpy()
    for k, n in enumerate(sizes):
        counts = np.zeros((2, n), np.int64)
        for label, name in enumerate(("bad", "good")):
            counts[label, sums.column("feature").to_numpy()[view == k]] = sums.column(name).to_numpy()[view == k]
        out.append(log_odds(counts[1], counts[0]))
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> Model | None:
    """Co-train on ``docs`` with ``labels`` (``doc_id``, ``quality``, ``toxic``)."""
    labelled = sample(docs, labels, most)
    model = fitted(labelled, train)
    for _ in range(rounds if model else 0):
        known = model.vocabulary, handed(docs, model)
        model = fitted(labelled, lambda table, known=known: train(table, known))
    return model


def _rows(model: Model, columns: dict[str, int], batch: pa.RecordBatch) -> Iterator[tuple[Rows, Rows]]:
    """Both views of a batch's documents, slice by slice."""
    for part in textscan.slices(batch.column(columns["text"]).cast(pa.large_string()), letters()):
        own = {c: batch.column(columns[c]).slice(part.first, part.n).to_pylist() for c in ("source", "lang", "n_chars")}
        yield text_rows(part, model.vocabulary), meta_rows(own)


def _scored(model: Model, columns: dict[str, int], batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out = [(np.zeros(0),) * 3, *[model.scores(*rows) for rows in _rows(model, columns, batch)]]
    return tuple(np.concatenate(x) for x in zip(*out))


def scores(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_score, meta_score, score, kept) of every document."""
    ship(docs.sparkSession)
    places = {c: k for k, c in enumerate(["doc_id", "text", "source", "lang", "n_chars"])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            three = _scored(model, places, batch) if model else (np.ones(batch.num_rows),) * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *map(pa.array, three), pa.array(three[2] >= threshold)],
                names=["doc_id", "text_score", "meta_score", "score", "kept"],
            )

    return docs.select(*places).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, kept boolean")


def kept(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    if model is None:
        return docs
    ship(docs.sparkSession)
    places = {c: docs.columns.index(c) for c in ("text", "source", "lang", "n_chars")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scored(model, places, batch)[2] >= threshold))

    return docs.mapInArrow(run, docs.schema)
