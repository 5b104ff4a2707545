"""Benchmark decontamination by a distributed positional inverted index.

The index is split by documents: each row of the stored table is a segment, a few MB of
text with its sorted terms and, for each term, the list of its positions.  A test window is
looked up from its rarest term, by frequencies over the whole corpus: that term's list,
shifted by the term's offset, gives candidate starts, and the shifted lists of the other
terms, rarest first, cut them down.  A window that survives all its terms is an exact
phrase match; a looser rule on the same lists gives proximity matches.  A document lies in
one segment, so that no posting is ever shuffled.

Only terms of the test set are stored while there are at most ``MOST_TERMS`` of them, and
all terms beyond that.  Test items are searched in blocks of about ``BLOCK_WORDS`` words,
which bounds what a task is sent.

Defined results: a null or wordless text has no words and no hits; a null or wordless item
has no windows; equal documents each count, items of one id
are one; an empty table on either side
gives no hits; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .shared import Workspace

WINDOW = 10
REACH = 15
MOST_TERMS = 2_000_000
BLOCK_WORDS = 500_000

INDEX = "doc_ids array<long>, bases array<long>, terms array<long>, lists array<long>, positions array<int>"
FOUND = "doc_no int, doc_id long, n_words long, spans array<struct<a:int,b:int>>, items array<string>, near array<string>"


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    bounds = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """Segments of ``docs`` (``doc_id``, ``text``): term hashes and position lists.

    ``bases`` has where each document's words begin among those of the segment, and the
    end; ``lists`` has where each term's positions begin.  With a sorted ``vocabulary`` of
    term hashes, other terms keep their places but get no list.
    """
    alphabet = textscan.alphanumeric()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch.column(1), alphabet):
                at, hashes = np.arange(len(part.hash)), part.hash
                if vocabulary is not None:
                    spot = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
                    known = vocabulary[spot] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
                    at, hashes = at[known], hashes[known]
                order = np.argsort(hashes, kind="stable")
                terms, begin = np.unique(hashes[order], return_index=True)
                ids = batch.column(0).slice(part.first, part.n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, part.n], pa.int32()), ids),
                        _lists([part.bounds()], pa.int64()),
                        _lists([terms.view(np.int64)], pa.int64()),
                        _lists([np.append(begin, len(at))], pa.int64()),
                        _lists([at[order].astype(np.int32)], pa.int32()),
                    ],
                    names=["doc_ids", "bases", "terms", "lists", "positions"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, INDEX)


def frequencies(index: DataFrame) -> DataFrame:
    """Occurrences of each indexed term in the whole corpus."""
    counted = index.select("terms", F.expr("transform(sequence(1, size(terms)), i -> lists[i] - lists[i - 1])").alias("n"))
    pairs = counted.filter("size(terms) > 0").select(F.explode(F.arrays_zip("terms", "n")).alias("p"))
    return pairs.select(F.col("p.terms").alias("term"), F.col("p.n").alias("n")).groupBy("term").agg(F.sum("n").alias("n"))


@dataclass
class Phrases:
    """Distinct windows of a block of items, their terms ordered by rarity."""

    terms: np.ndarray  # sorted hashes
    phrase: np.ndarray  # (phrases, window): term numbers, rarest first; -1 beyond the length
    offset: np.ndarray  # (phrases, window): where in the phrase each of them stands
    length: np.ndarray
    owner_phrase: np.ndarray  # pairs of phrase and item
    owner_item: np.ndarray
    items: list[str]

    @classmethod
    def make(cls, items: list[tuple[str, str]], counts: dict[int, int], window: int) -> Phrases:
        hashed = textscan.hash_words([t or "" for _, t in items], textscan.alphanumeric())
        terms = np.unique(np.concatenate([*hashed, np.zeros(0, np.uint64)]))
        weight = np.array([counts.get(int(t), 0) for t in terms.view(np.int64)], np.int64)
        seen: dict[tuple, int] = {}
        owners = set()
        for k, words in enumerate(hashed):
            ids = np.searchsorted(terms, words).tolist()
            size = min(window, len(ids))
            for s in range(len(ids) - size + 1) if size else ():
                owners.add((seen.setdefault(tuple(ids[s : s + size]), len(seen)), k))
        phrase = np.full((len(seen), window), -1)
        offset = np.zeros((len(seen), window), np.int64)
        length = np.zeros(len(seen), np.int64)
        for words, p in seen.items():
            order = sorted(range(len(words)), key=lambda o: (weight[words[o]], o))
            length[p] = len(words)
            phrase[p, : len(words)] = [words[o] for o in order]
            offset[p, : len(words)] = order
        pairs = np.array(sorted(owners), np.int64).reshape(-1, 2)
        return cls(terms, phrase, offset, length, pairs[:, 0], pairs[:, 1], [i for i, _ in items])


class Segment:
    """One index row, with its lists numbered by the terms of the phrases."""

    def __init__(self, bases: np.ndarray, terms: np.ndarray, lists: np.ndarray, positions: np.ndarray, wanted: np.ndarray):
        self.bases, self.positions = bases, positions
        spot = np.minimum(np.searchsorted(terms, wanted), max(len(terms) - 1, 0))
        found = terms[spot] == wanted if len(terms) else np.zeros(len(wanted), bool)
        self.begin = np.where(found, lists[spot] if len(terms) else 0, 0)
        self.count = np.where(found, lists[spot + 1] - lists[spot] if len(terms) else 0, 0)
        self.at = np.full(int(bases[-1]), -1)  # the same lists by position
        for_term = np.repeat(np.arange(len(wanted)), self.count)
        self.flat = positions[self.expand(self.begin, self.count)]
        self.at[self.flat] = for_term
        self.keys = for_term << 32 | self.flat  # sorted: by term, then position
        self.key_begin = np.cumsum(self.count) - self.count

    @staticmethod
    def expand(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
        """begin[0], begin[0] + 1, ... count[0] of them; then those from begin[1]; and so on."""
        return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))

    def rarest(self, q: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and position of every occurrence of a phrase's rarest term."""
        first = q.phrase[:, 0]
        return np.repeat(np.arange(len(first)), self.count[first]), self.flat[self.expand(self.key_begin[first], self.count[first])].astype(np.int64)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, at, "right") - 1

    def exact(self, q: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrase, first position and document of all exact occurrences."""
        phrase, at = self.rarest(q)
        start = at - q.offset[phrase, 0]
        doc = self.document(at)
        inside = (start >= self.bases[doc]) & (start + q.length[phrase] <= self.bases[doc + 1])
        phrase, start, doc = phrase[inside], start[inside], doc[inside]
        for k in range(1, q.phrase.shape[1]):
            more = k < q.length[phrase]
            same = self.at[np.where(more, start + q.offset[phrase, k], start)] == q.phrase[phrase, k]
            kept = same | ~more
            phrase, start, doc = phrase[kept], start[kept], doc[kept]
        return phrase, start, doc

    def near(self, q: Phrases, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and document where all terms stand, in any order, within ``reach`` words of the rarest."""
        phrase, at = self.rarest(q)
        doc = self.document(at)
        for k in range(1, q.phrase.shape[1]):
            term = q.phrase[phrase, k]
            low, high = np.maximum(at - reach, self.bases[doc]), np.minimum(at + reach, self.bases[doc + 1] - 1)
            spot = np.searchsorted(self.keys, np.maximum(term, 0) << 32 | low)
            hit = spot < len(self.keys)
            hit[hit] = self.keys[spot[hit]] <= (np.maximum(term[hit], 0) << 32 | high[hit])
            kept = hit | (term < 0)
            phrase, at, doc = phrase[kept], at[kept], doc[kept]
        return phrase, doc


def _items_of(q: Phrases, phrase: np.ndarray, doc: np.ndarray, n: int) -> list[np.ndarray]:
    """Of each document, the numbers of the items that own its phrases."""
    pairs = np.unique(np.stack([doc, phrase]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
    begin = np.searchsorted(q.owner_phrase, pairs[1])
    count = np.searchsorted(q.owner_phrase, pairs[1], "right") - begin
    doc, item = np.repeat(pairs[0], count), q.owner_item[Segment.expand(begin, count)]
    both = np.unique(np.stack([doc, item]), axis=1)
    return np.split(both[1], np.searchsorted(both[0], np.arange(1, n)))


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and adjoining spans of a document as one; positions are the segment's, so documents never mix."""
    if not len(start):
        return doc, start, end
    order = np.argsort(start, kind="stable")
    doc, start, reach = doc[order], start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return doc[first], start[first], reach[last]


def search(index: DataFrame, q: Phrases, reach: int) -> DataFrame:
    """One row for each document: hit spans in its words, items that occur, items that occur nearly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(q.items, object)
        for batch in batches:
            for k in range(batch.num_rows):
                ids, bases, terms, lists, positions = (batch.column(c)[k].values for c in range(1, 6))
                bases = bases.to_numpy()
                n = len(bases) - 1
                segment = Segment(bases, terms.to_numpy().view(np.uint64), lists.to_numpy(), positions.to_numpy(), q.terms)
                phrase, start, doc = segment.exact(q)
                near = _items_of(q, *segment.near(q, reach), n)
                items = _items_of(q, phrase, doc, n)
                doc, low, high = _merged(doc, start, start + q.length[phrase])
                bounds = np.searchsorted(doc, np.arange(n + 1))
                spans = pa.StructArray.from_arrays([pa.array(x - bases[doc], pa.int32()) for x in (low, high)], names=["a", "b"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, batch.column(0)[k].as_py()), pa.int64()),
                        pa.array(np.arange(n), pa.int32()),
                        ids.cast(pa.int64()),
                        pa.array(np.diff(bases), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans),
                        _lists_of_names(names, items),
                        _lists_of_names(names, near),
                    ],
                    names=["segment", "doc_no", "doc_id", "n_words", "spans", "items", "near"],
                )

    return index.select("segment", "doc_ids", "bases", "terms", "lists", "positions").mapInArrow(run, f"segment long, {FOUND}")


def _lists_of_names(names: np.ndarray, parts: list[np.ndarray]) -> pa.Array:
    bounds = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(names[np.concatenate(parts).astype(np.int64)].tolist(), pa.string()))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, reach: int = REACH) -> DataFrame:
    """Every document with its exact hits (``spans``, ``items``) and nearly found items (``near``)."""
    spark = docs.sparkSession
    work = Workspace(spark, "decontam")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    sizes = items.select(F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    blocks = max(1, -(-int(sizes.agg(F.sum("n")).first()[0] or 0) // (6 * BLOCK_WORDS)))
    items = work.table(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    vocabulary = None
    if blocks * BLOCK_WORDS <= MOST_TERMS:
        texts = [t or "" for (t,) in items.select("text").toLocalIterator()]
        vocabulary = np.unique(np.concatenate([*textscan.hash_words(texts, textscan.alphanumeric()), np.zeros(0, np.uint64)]))
    index = work.table(build_index(docs, vocabulary), "index").withColumn("segment", F.monotonically_increasing_id())
    counted = work.table(frequencies(index), "frequencies")
    parts = []
    for block in range(blocks):
        own = [(r.item_id, r.text) for r in items.filter(F.col("block") == block).toLocalIterator()]
        terms = np.unique(np.concatenate([*textscan.hash_words([t or "" for _, t in own], textscan.alphanumeric()), np.zeros(0, np.uint64)]))
        wanted = spark.createDataFrame([(int(t),) for t in terms.view(np.int64)], "term long")
        counts = {t: n for t, n in counted.join(F.broadcast(wanted), "term").toLocalIterator()}
        parts.append(search(index, Phrases.make(own, counts, window), reach))
    found = parts[0]
    if blocks > 1:
        for part in parts[1:]:
            found = found.unionAll(part)
        gathered = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near")]
        found = found.groupBy("segment", "doc_no", "doc_id", "n_words").agg(*gathered)
    return found


def digest(found: DataFrame) -> DataFrame:
    """Counts for each document; spans of different blocks may overlap and count once."""
    covered = F.expr(
        "aggregate(array_sort(spans), named_struct('upto', 0, 'n', 0L), (s, x) -> named_struct("
        "'upto', greatest(s.upto, x.b), 'n', s.n + greatest(0, x.b - greatest(s.upto, x.a))), s -> s.n)"
    )
    return found.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size(F.array_distinct("items")).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.array_distinct("items")), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.size(F.array_except("near", "items")).cast("long").alias("n_near_items"),
    )
