"""Language identification of code-switched text by a linear-chain conditional random field.

Words are the chain, languages the labels.  A word's features are its affixes, its byte
trigrams and whether the lexicon of a language has it; transitions are learned with them.
The model is trained on documents with a known language: their words carry it, and spliced
sequences of several documents show it switching.  Forward-backward gives each word a
distribution over languages; a document's are summed, its language is the largest and its
score that one's share.

The fit takes as many distinct labelled texts of each language, those of least hash, as make
``SAMPLE_DOCS`` together, but ``LEAST_DOCS`` of each at least, and ``LEXICON`` words; the
model's size depends on these and the number of languages, which are all learned.  Prediction is one pass over
whole texts without a shuffle: long chains are cut into blocks whose transfer matrices are
multiplied in order, which gives the same marginals as one chain.

Defined results: a null text or one without letters is ``und`` with score 0; without any
labelled document that has a word every text is; a text without spaces is one word; repeated rows are predicted each; an empty table gives an
empty result; a clashing column name stays out, for only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .shared import Workspace, fitted, least_hashes, ship

SAMPLE_DOCS = 1500
LEXICON = 50_000
LEAST_DOCS = 30  # of a language, however many there are
SAMPLE_BYTES = 16 << 10  # a text on average
BITS = 16
CHAIN = 64
EPOCHS = 4
BATCH = 128
UND = "und"

U = np.uint64


def letters() -> textscan.Alphabet:
    """Words of ASCII letters and of all beyond ASCII, A-Z taken as a-z."""
    return textscan.Alphabet.make(lambda b: 0x61 <= b <= 0x7A or b >= 0x80, True)


@dataclass
class Features:
    """Feature numbers of all words of a slice: those of word ``k`` end at ``ends[k]``."""

    ids: np.ndarray
    ends: np.ndarray


def features(part: textscan.Slice, lexicon: np.ndarray, owner: np.ndarray) -> Features:
    """Six affixes, one lexicon number and as many trigrams as bytes, for each word."""
    length = part.end - part.start
    n, mask = len(length), U((1 << BITS) - 1)
    folded = textscan.BYTE_VALUES.copy()
    folded[65:91] = folded[97:123]
    value = folded[part.text]
    fixed = np.zeros((n, 7), np.int64)
    for k in range(3):  # prefixes and suffixes of one to three bytes
        inside = length > k
        head, tail = np.zeros(n, U), np.zeros(n, U)
        for j in range(k + 1):
            head[inside] = textscan.mix(head[inside] + value[part.start[inside] + j] + U(j))
            tail[inside] = textscan.mix(tail[inside] + value[part.end[inside] - 1 - j] + U(j + 7))
        fixed[:, k] = np.where(inside, head & mask, 0)
        fixed[:, 3 + k] = np.where(inside, tail & mask, 0)
    if len(lexicon):
        spot = np.minimum(np.searchsorted(lexicon, part.hash), len(lexicon) - 1)
        known = lexicon[spot] == part.hash
        fixed[:, 6] = (1 << BITS) + np.where(known, 1 + owner[spot], 0)
    else:
        fixed[:, 6] = 1 << BITS
    at = np.repeat(part.start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    middle = value[at]
    word_start, word_end = np.repeat(part.start, length), np.repeat(part.end, length)
    edge = U(0x5851F42D4C957F2D)
    before = np.where(at > word_start, value[np.maximum(at - 1, 0)], edge)
    after = np.where(at + 1 < word_end, value[np.minimum(at + 1, max(len(value) - 1, 0))], edge)
    grams = (textscan.mix(before + textscan.mix(middle + textscan.mix(after))) & mask).astype(np.int64)
    count = length + 7
    ends = np.cumsum(count)
    ids = np.empty(int(count.sum()), np.int64)
    begin = ends - count
    for k in range(7):
        ids[begin + k] = fixed[:, k]
    ids[np.repeat(begin + 7 - (np.cumsum(length) - length), length) + np.arange(len(grams))] = grams
    return Features(ids, ends)


def emissions(found: Features, weights: np.ndarray) -> np.ndarray:
    """Summed weights of each word's features."""
    if not len(found.ends):
        return np.zeros((0, weights.shape[1]), np.float32)
    return np.add.reduceat(weights[found.ids], np.append(0, found.ends[:-1]), axis=0)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def chain_marginals(e: np.ndarray, real: np.ndarray, a: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Marginals of chains of equal length: ``e`` (chains, length, labels) are exponentials.

    ``first`` is what comes into each chain from before it and ``last`` from behind; places
    that are not ``real`` are skipped.
    """
    alpha = np.empty_like(e)
    state = first
    for t in range(e.shape[1]):
        state = np.where(real[:, t, None], _scaled((state @ a) * e[:, t]), state)
        alpha[:, t] = state
    state = last
    for t in range(e.shape[1] - 1, -1, -1):
        alpha[:, t] *= state
        state = np.where(real[:, t, None], _scaled((state * e[:, t]) @ a.T), state)
    return _scaled(alpha)


def marginals(e: np.ndarray, bounds: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Marginals of all words of documents ``bounds``, exact at any length.

    Each document is padded to whole blocks; a block's transfer matrix takes the message
    before it to the message behind it.
    """
    labels = e.shape[1]
    words = np.diff(bounds)
    blocks = -(-words // CHAIN)
    total = int(blocks.sum())
    if not total:
        return np.zeros((0, labels))
    base = np.cumsum(blocks) - blocks
    at = np.repeat(base * CHAIN - bounds[:-1], words) + np.arange(bounds[0], bounds[-1])
    padded, real = np.ones((total * CHAIN, labels)), np.zeros(total * CHAIN, bool)
    padded[at], real[at] = np.exp(e - e.max(axis=1, keepdims=True)), True
    padded, real = padded.reshape(total, CHAIN, labels), real.reshape(total, CHAIN)
    first = np.full((total, labels), 1 / labels)
    last = np.full((total, labels), 1 / labels)
    if blocks.max() > 1:
        transfer = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
        for t in range(CHAIN):
            moved = (transfer @ a) * padded[:, t, None, :]
            moved /= moved.sum(axis=(1, 2), keepdims=True)
            transfer = np.where(real[:, t, None, None], moved, transfer)
        for k in range(1, int(blocks.max())):
            rows = (base + k)[blocks > k]
            first[rows] = _scaled(np.einsum("ni,nij->nj", first[rows - 1], transfer[rows - 1]))
        for k in range(1, int(blocks.max())):
            rows = (base + blocks - 1 - k)[blocks > k]
            last[rows] = _scaled(np.einsum("nij,nj->ni", transfer[rows + 1], last[rows + 1]))
    return chain_marginals(padded, real, a, first, last).reshape(-1, labels)[at]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray  # exponentials
    lexicon: np.ndarray
    owner: np.ndarray


def _lexicon(hashes: np.ndarray, langs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words seen thrice or more, nine times in ten in one language."""
    values, index = np.unique(hashes, return_inverse=True)
    table = np.zeros((len(values), n), np.int64)
    np.add.at(table, (index, langs), 1)
    total, top = table.sum(axis=1), table.max(axis=1)
    clear = np.flatnonzero((total >= 3) & (10 * top >= 9 * total))
    clear = np.sort(clear[np.argsort(-total[clear], kind="stable")[:LEXICON]])
    return values[clear], table[clear].argmax(axis=1)


def _spliced(bounds: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Word numbers of chains: stretches of documents, -1 behind a short one; every word is in one chain.

    About half of the chains have swapped a stretch with another, so that they switch between two.
    """
    words = np.diff(bounds)
    blocks = -(-words // CHAIN)
    chains = np.full(int(blocks.sum()) * CHAIN, -1, np.int64)
    base = (np.cumsum(blocks) - blocks) * CHAIN
    chains[np.repeat(base - bounds[:-1], words) + np.arange(bounds[0], bounds[-1])] = np.arange(bounds[0], bounds[-1])
    chains = chains.reshape(-1, CHAIN)
    length = (chains >= 0).sum(axis=1)
    swapped = rng.permutation(len(chains))[: len(chains) // 4 * 2].reshape(-1, 2)
    for j, k in swapped:
        low, high = np.sort(rng.integers(0, min(length[j], length[k]) + 1, 2))
        chains[[j, k], low:high] = chains[[k, j], low:high]
    return chains


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model | None:
    """Fit by stochastic gradients of the conditional likelihood."""
    names = sorted({x for t, x in zip(texts, langs) if t})
    number = {x: k for k, x in enumerate(names)}
    pairs = [(t, number[x]) for t, x in zip(texts, langs) if t]
    if not pairs:
        return None
    n, rng = len(names), np.random.default_rng(seed)
    [part] = textscan.slices(pa.array([t for t, _ in pairs], pa.large_string()), letters(), most=1 << 62)
    if not len(part.hash):
        return None
    bounds, label = part.bounds(), np.array([k for _, k in pairs])[part.row]
    lexicon, owner = _lexicon(part.hash, label, n)
    found = features(part, lexicon, owner)
    begin = np.append(0, found.ends[:-1])
    chains = _spliced(bounds, rng)
    weights = np.zeros(((1 << BITS) + n + 1, n), np.float32)
    squares = np.full_like(weights, 1e-3)
    trans, trans_squares = np.zeros((n, n)), np.full((n, n), 1e-3)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(chains)), -(-len(chains) // BATCH)):
            real = chains[rows] >= 0
            words = chains[rows][real]
            count = found.ends[words] - begin[words]
            at = np.repeat(begin[words] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            ids = found.ids[at]
            own = np.add.reduceat(weights[ids], np.cumsum(count) - count, axis=0).astype(float)
            e, truth = np.ones((*real.shape, n)), np.zeros((*real.shape, n))
            e[real], truth[real] = np.exp(own - own.max(axis=1, keepdims=True)), np.eye(n)[label[words]]
            a, ones = np.exp(trans), np.full((len(rows), n), 1 / n)
            gamma = chain_marginals(e, real, a, ones, ones)
            slope = (gamma - truth)[real] / len(rows)
            step = np.zeros_like(weights)
            spread = np.repeat(slope, count, axis=0)
            for k in range(n):
                step[:, k] = np.bincount(ids, spread[:, k], len(weights))
            squares += step * step
            weights -= 0.3 * step / np.sqrt(squares) + 1e-5 * weights
            # Expected and observed transitions; the pair marginal from messages around it.
            alpha, beta = _messages(e, real, a)
            both = real[:, 1:]
            left, right = alpha[:, :-1][both], (e * beta)[:, 1:][both]
            left /= ((left @ a) * right).sum(axis=1, keepdims=True)
            seen = truth[:, :-1][both].T @ truth[:, 1:][both]
            step = (a * (left.T @ right) - seen) / len(rows)
            trans_squares += step * step
            trans -= 0.1 * step / np.sqrt(trans_squares)
    return Model(names, weights, np.exp(trans), lexicon, owner)


def _messages(e: np.ndarray, real: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    alpha, beta = np.empty_like(e), np.ones_like(e)
    state = np.full((len(e), e.shape[2]), 1 / e.shape[2])
    for t in range(e.shape[1]):
        state = alpha[:, t] = _scaled((state @ a) * e[:, t])
    for t in range(e.shape[1] - 2, -1, -1):
        beta[:, t] = np.where(real[:, t + 1, None], _scaled((beta[:, t + 1] * e[:, t + 1]) @ a.T), 1)
    return alpha, beta


def sample(labelled: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """(h, text, lang): distinct texts of ``labelled`` (``text``, ``lang``), those of least hash of each language.

    All languages get an equal share of ``most``, but ``LEAST_DOCS`` texts at least, if they have them,
    within ``SAMPLE_BYTES`` a text of the share.  A text with several languages counts for the one most of its rows have.
    """
    known = labelled.select(F.col("text").cast("string").alias("text"), "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    known = known.withColumn("h", F.xxhash64("text"))
    votes = known.groupBy("h", "lang").agg(F.count(F.lit(1)).alias("n"), F.first(F.octet_length("text")).alias("size"))
    work = Workspace(labelled.sparkSession, "langid")
    texts = work.table(votes.groupBy("h").agg(F.max(F.struct("n", "lang")).alias("top"), F.first("size").alias("size")).select("h", F.col("top.lang").alias("lang"), "size"), "texts")
    counts = dict(texts.groupBy("lang").count().collect())
    share = max(LEAST_DOCS, most // max(len(counts), 1))
    some = least_hashes(texts, counts, share, "lang", share * SAMPLE_BYTES).select("h", F.col("lang").alias("lang_of"))
    rows = known.drop("lang").join(F.broadcast(some), "h").groupBy("h").agg(F.first("text").alias("text"), F.first("lang_of").alias("lang"))
    return work.table(rows, "sample")


def fit(labelled: DataFrame, most: int = SAMPLE_DOCS) -> Model | None:
    """Train on a ``sample`` of ``labelled``, in one task of an executor."""

    def run(table: pa.Table) -> Model | None:
        rows = sorted(zip(table.column("lang").to_pylist(), table.column("text").to_pylist()))
        return train([t for _, t in rows], [x for x, _ in rows])

    return fitted(sample(labelled, most), run)


def label_words(text: str, model: Model) -> list[tuple[str, str]]:
    """Each word of one text with its most likely language."""
    out = []
    for part in textscan.slices(pa.array([text], pa.large_string()), letters()):
        gamma = marginals(emissions(features(part, model.lexicon, model.owner), model.weights), part.bounds(), model.transitions)
        raw = text.encode()
        out += [(raw[a:b].decode(errors="replace"), model.languages[k]) for a, b, k in zip(part.start, part.end, gamma.argmax(axis=1))]
    return out


RUNS = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("n", pa.int32())]))


def _runs(best: np.ndarray, bounds: np.ndarray, languages: list[str]) -> pa.Array:
    """Maximal runs of words of one language in each document: language, number of the first word, and of words."""
    new = np.ones(len(best), bool)
    new[1:] = best[1:] != best[:-1]
    new[bounds[:-1][bounds[:-1] < len(best)]] = True
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(best)))
    at = np.searchsorted(first, bounds)
    place = first - np.repeat(bounds[:-1], np.diff(at))
    langs = pa.array(languages, pa.string()).take(pa.array(best[first]))
    runs = pa.StructArray.from_arrays([langs, pa.array(place, pa.int32()), pa.array(n, pa.int32())], names=["lang", "first", "n"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), runs)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, runs) of every document of ``docs`` (``doc_id``, ``text``); ``runs`` has the language of each word."""
    ship(docs.sparkSession)
    alphabet = letters()
    most = textscan.SLICE_BYTES * 8 // max(len(model.languages) if model else 0, 8)  # arrays are as wide as there are languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch.column(1), alphabet, most=most):
                names, scores, runs = [UND] * part.n, np.zeros(part.n), pa.array([[]] * part.n, RUNS)
                if model is not None:
                    bounds = part.bounds()
                    gamma = marginals(emissions(features(part, model.lexicon, model.owner), model.weights), bounds, model.transitions)
                    runs = _runs(gamma.argmax(axis=1) if len(gamma) else np.zeros(0, np.int64), bounds, model.languages)
                    total = np.concatenate([np.zeros((1, gamma.shape[1])), np.cumsum(gamma, axis=0)])
                    share = (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)[:, None]
                    best = share.argmax(axis=1)
                    scores = np.clip(share[np.arange(part.n), best], 0, 1)
                    ascii_letter = alphabet.word & (np.arange(256) < 128)
                    plain = np.append(0, np.cumsum(ascii_letter[part.text]))[part.offsets]
                    for k in range(part.n):
                        if bounds[k] < bounds[k + 1] and (plain[k] < plain[k + 1] or any(map(str.isalpha, batch.column(1)[part.first + k].as_py()))):
                            names[k] = model.languages[best[k]]
                        else:
                            scores[k] = 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.n).cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64()), runs.cast(RUNS)],
                    names=["doc_id", "lang_pred", "score", "runs"],
                )

    schema = "doc_id long, lang_pred string, score double, runs array<struct<lang:string,first:int,n:int>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
