"""Exact repeated passages by fixed-block anchors.

A passage of ``window`` words holds, wherever it starts, at least one whole block of
``window // 2 + 1`` words that begins at a multiple of that length in its document.

1. Index and probes: the hashes of each document's fixed, non-overlapping blocks are the
   index; every rolling window of block length probes it.  Both go to hash buckets as
   sorted arrays, several thousand words to a row, and a bucket names the blocks whose
   words also stand elsewhere.
2. Extension: only windows around such anchor blocks can repeat.  Each slice of documents sends
   the hashes of its own, of 96 bits, once to a bucket, with a mark if they repeat within it; a
   bucket answers each slice with those of its hashes that repeat.
3. Removal: a slice finds the answered hashes among its windows, joins them to maximal
   repeats, and drops the words that these cover.

A bucket gets distinct values of each slice, so that a passage common to many documents weighs
no more there than any other of the slice; positions never travel.  Buckets and slices grow in
number with the input.  A slice is a class of hashes of id and text, so that a source or a
group of copies is spread evenly; rows equal in both share one.

Defined results: a null or wordless text has no words and keeps none, as the hash of the
empty string says; texts shorter than the window keep all; repeated rows repeat each
other's passages; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from . import textscan
from .shared import Workspace, partitions

WINDOW = 35
BUCKET_BYTES = 13 << 20
SLICE_BYTES = 4 << 20  # larger slices send a bucket fewer rows

U = np.uint64


def keyed(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("key"))


def sliced(rows: DataFrame, slices: int) -> GroupedData:
    """``rows``, which have a ``key``, by slices; some of these to a partition."""
    rows = rows.withColumn("slice", F.pmod("key", F.lit(slices)).cast("int"))
    return rows.repartition(max(partitions(rows.sparkSession), slices // 4), "slice").groupBy("slice")


def _split(bucket: np.ndarray, buckets: int, *values: np.ndarray) -> Iterator[tuple]:
    """(bucket, values that belong there) for each bucket that has any; ``bucket`` is sorted."""
    bounds = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)):
        yield (int(b), *(v[bounds[b] : bounds[b + 1]] for v in values))


def _binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


PROBES = "bucket int, once binary, many binary, block binary, block_key binary, block_no binary"


def probes_and_blocks(docs: DataFrame, block: int, buckets: int) -> DataFrame:
    """For each slice of text and bucket: rolling probes, seen once or more often there, and index blocks."""
    alphabet = textscan.unspaced(lower=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for part in textscan.slices(batch.column(1), alphabet, SLICE_BYTES):
                at, grams = part.grams(block)
                values, counts = np.unique(grams, return_counts=True)
                order = np.argsort((values >> U(32)) % U(buckets), kind="stable")
                values, counts = values[order], counts[order]
                rows = {b: [v[c == 1], v[c > 1]] for b, v, c in _split((values >> U(32)) % U(buckets), buckets, values.astype(np.uint32), counts)}
                place = at - part.bounds()[part.row[at]]
                fixed = place % block == 0
                grams, place, key = grams[fixed], place[fixed] // block, keys[part.first + part.row[at[fixed]]]
                bucket = (grams >> U(32)) % U(buckets)
                order = np.argsort(bucket, kind="stable")
                own = {b: v for b, *v in _split(bucket[order], buckets, grams[order].astype(np.uint32), key[order], place[order].astype(np.int32))}
                none = [np.zeros(0, np.uint32)] * 3
                names = sorted(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int32()), *(_binary([(rows[b] + list(own.get(b, none)))[k] for b in names]) for k in range(5))],
                    names=["bucket", "once", "many", "block", "block_key", "block_no"],
                )

    return docs.select("key", "text").mapInArrow(run, PROBES)


def _numbers(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _anchors(table: pa.Table) -> pa.Table:
    """Blocks of a bucket whose words stand more than once."""
    values, counts = np.unique(_numbers(table.column("once"), np.uint32), return_counts=True)
    repeated = np.unique(np.concatenate([values[counts > 1], _numbers(table.column("many"), np.uint32)]))
    blocks = _numbers(table.column("block"), np.uint32)
    hit = np.zeros(len(blocks), bool)
    if len(repeated):
        hit = repeated[np.minimum(np.searchsorted(repeated, blocks), len(repeated) - 1)] == blocks
    return pa.table({"key": _numbers(table.column("block_key"), np.int64)[hit], "block_no": _numbers(table.column("block_no"), np.int32)[hit]})


REQUESTS = "bucket int, slice int, hash binary, check binary, many binary"
REPLIES = "slice int, hash binary, check binary"
CHECKS = textscan.Powers(U(0xE7037ED1A0B428DB))  # of the second hash: 32 bits more


def _hashes(part: textscan.Slice, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows begin, and the two hashes of each."""
    at, grams = part.grams(window)
    return at, grams, (part.grams(window, CHECKS)[1] >> U(32)).astype(np.uint32)


def _requests(window: int, block: int, buckets: int):
    """For each bucket, the distinct windows of a slice that hold an anchor block."""
    alphabet = textscan.unspaced(lower=False)

    def run(texts: pa.Table, anchors: pa.Table) -> pa.Table:
        rows = []
        order = np.argsort(anchors.column("key").to_numpy(), kind="stable")
        anchor_keys, blocks = anchors.column("key").to_numpy()[order], anchors.column("block_no").to_numpy()[order].astype(np.int64)
        keys = texts.column("key").to_numpy()
        low, high = np.searchsorted(anchor_keys, keys, "left"), np.searchsorted(anchor_keys, keys, "right")
        column = texts.column("text").combine_chunks() if len(keys) and len(anchor_keys) else pa.array([], pa.string())
        for part in textscan.slices(column, alphabet, SLICE_BYTES):
            begins = part.bounds()
            near = np.zeros(len(part.hash) + 1, np.int64)
            for k in range(part.n):
                q = np.unique(blocks[low[part.first + k] : high[part.first + k]]) * block + begins[k]
                np.add.at(near, np.maximum(q - (window - block), begins[k]), 1)
                np.add.at(near, np.minimum(q + 1, begins[k + 1]), -1)
            at, hashes, checks = _hashes(part, window)
            chosen = np.cumsum(near)[at] > 0
            hashes, checks = hashes[chosen], checks[chosen]
            bucket = (hashes >> U(32)) % U(buckets)
            order = np.lexsort((checks, hashes, bucket))
            bucket, hashes, checks = bucket[order], hashes[order], checks[order]
            first = np.ones(len(hashes), bool)
            first[1:] = (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])
            begin = np.flatnonzero(first)
            many = np.diff(np.append(begin, len(hashes))) > 1
            rows += list(_split(bucket[begin], buckets, hashes[begin], checks[begin], many))
        b, *rest = zip(*rows) if rows else ((), (), (), ())
        own = texts.column("slice")[0].as_py() if rows else 0
        return pa.table([pa.array(b, pa.int32()), pa.array([own] * len(rows), pa.int32()), *map(_binary, rest)], names=["bucket", "slice", "hash", "check", "many"])

    return run


def _replies(table: pa.Table) -> pa.Table:
    """For each request of a bucket those of its windows that occur more than once anywhere."""
    hashes, checks, repeated = (_numbers(table.column(c), kind) for c, kind in (("hash", U), ("check", np.uint32), ("many", bool)))
    request = np.repeat(np.arange(len(table)), [len(x) // 4 for x in table.column("check").to_pylist()])
    order = np.lexsort((checks, hashes))
    same = (hashes[order[1:]] == hashes[order[:-1]]) & (checks[order[1:]] == checks[order[:-1]])
    repeated = repeated.copy()
    repeated[order[1:][same]] = repeated[order[:-1][same]] = True
    # Of equal ones, one that is marked within its slice marks all.
    begin = np.flatnonzero(np.append(True, ~same)) if len(order) else np.zeros(0, np.int64)
    repeated[order] = np.repeat(np.logical_or.reduceat(repeated[order], begin), np.diff(np.append(begin, len(order)))) if len(order) else repeated
    rows = list(_split(request[repeated], len(table), hashes[repeated], checks[repeated]))
    k, *rest = zip(*rows) if rows else ((), (), ())
    return pa.table([table.column("slice").take(pa.array(k, pa.int64())), *map(_binary, rest)], names=["slice", "hash", "check"])


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<int>"


def _known(hashes: np.ndarray, checks: np.ndarray, own: np.ndarray, own_checks: np.ndarray) -> np.ndarray:
    """Which windows are among the sorted ones given by ``hashes`` and ``checks``."""
    hit = np.zeros(len(own), bool)
    if len(hashes):
        at = np.searchsorted(hashes, own)
        for step in range(int(np.unique(hashes, return_counts=True)[1].max())):  # once, but for two that share their first hash
            spot = np.minimum(at + step, len(hashes) - 1)
            hit |= (hashes[spot] == own) & (checks[spot] == own_checks)
    return hit


def _removed(window: int):
    """Each document of a slice without its repeats."""
    alphabet = textscan.unspaced(lower=False)

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        hashes, checks = _numbers(replies.column("hash"), U), _numbers(replies.column("check"), np.uint32)
        order = np.lexsort((checks, hashes))
        hashes, checks, rows = hashes[order], checks[order], []
        column = texts.column("text").combine_chunks() if len(texts) else pa.array([], pa.string())
        for part in textscan.slices(column, alphabet, SLICE_BYTES):
            begins, cover = part.bounds(), np.zeros(len(part.hash) + 1, np.int64)
            if len(hashes):
                at, own, own_checks = _hashes(part, window)
                at = at[_known(hashes, checks, own, own_checks)]
                cover[at] += 1
                np.add.at(cover, at + window, -1)
            covered = np.cumsum(cover)[:-1] > 0
            total = np.append(0, np.cumsum(covered))[begins]
            for k in range(part.n):
                words, spans = column[part.first + k].as_py().encode().split(), []
                if total[k] < total[k + 1]:
                    own = np.concatenate([[False], covered[begins[k] : begins[k + 1]], [False]])
                    spans = np.flatnonzero(own[1:] != own[:-1]).tolist()
                    kept, end = [], 0
                    for a, b in zip(spans[::2], spans[1::2]):
                        kept += words[end:a]
                        end = b
                    words = kept + words[end:]
                n = int(begins[k + 1] - begins[k])
                rows.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest(), spans))
        n, removed, digest, spans = zip(*rows) if rows else ((), (), (), ())
        return pa.table(
            [texts.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, pa.list_(pa.int32()))],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"],
        )

    return run


def repeated(docs: DataFrame, window: int, buckets: int | None, slices: int | None) -> tuple[DataFrame, DataFrame, int]:
    """Keyed documents, (slice, hash, check) of the windows that repeat, and the number of slices."""
    spark = docs.sparkSession
    work = Workspace(spark, "substring")
    block = window // 2 + 1 if window % 2 else window // 2
    texts = keyed(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets or max(partitions(spark), -(-size // BUCKET_BYTES))
    slices = slices or max(partitions(spark), -(-size // SLICE_BYTES))
    found = probes_and_blocks(texts, block, buckets).repartition(buckets, "bucket").groupBy("bucket")
    anchors = work.table(found.applyInArrow(_anchors, "key long, block_no int"), "anchors")
    asked = sliced(texts.select("key", "text"), slices).cogroup(sliced(anchors, slices)).applyInArrow(_requests(window, block, buckets), REQUESTS)
    replies = work.table(asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_replies, REPLIES), "replies")
    work.drop("anchors")
    return texts, replies, slices


def deduplicated(docs: DataFrame, window: int = WINDOW, buckets: int | None = None, slices: int | None = None) -> DataFrame:
    """Every document's word count, removed words, hash of the words kept, and spans removed."""
    texts, replies, slices = repeated(docs, window, buckets, slices)
    replies = replies.repartition(max(partitions(docs.sparkSession), slices // 4), "slice").groupBy("slice")
    return sliced(texts, slices).cogroup(replies).applyInArrow(_removed(window), RESULT)
