"""Best-fit packing of tokenised documents into fixed-length training sequences.

Method: bound-certified repacking.  Pieces are dealt to groups of bounded size; each group
packs its pieces by best-fit decreasing and compares its bin count with a lower bound from
dual feasible functions.  A group that meets its bound is certified and final, and so is
every full bin.  Groups with a gap exchange the documents of their unfilled bins: these are
dealt anew to fewer groups and packed again, until nothing is open, one group packed all
that was open, or a round no longer reduces the number of groups.

Defined results: a null text counts as empty and gives one piece with only the closing id;
an empty table gives an empty result; repeated rows are packed each on its own; a document
longer than a sequence is cut so that only its first piece may be short, whatever its length and
characters; columns other than the id and the text are ignored, whatever their names.

``bound`` says of every row how few sequences any packing of all pieces could have, by the same
functions over the lengths of the whole table.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace
from .textscan import give_back

CAPACITY = 2048
END_ID = 0
GROUP_PIECES = 16384
SPECIAL = "<|endoftext|>"
LONG_SPACE = 50_000  # characters

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.lru_cache(maxsize=2)
def encoder(json_path: str, rank_path: str, pattern: str) -> Callable[[str], list[int]]:
    """Ids of the tokenizer file at ``json_path``.

    The rank file holds the same vocabulary, and its library gives the same ids in a third
    of the time; a text that spells a special token goes through the tokenizer file itself, and
    so does one with a run of spaces that is too long for the library's pattern matcher.
    """
    import tiktoken

    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if SPECIAL in text or len(text) >= LONG_SPACE and re.search(rf"\s{{{LONG_SPACE}}}", text):
            return exact_encoder(json_path).encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


@functools.lru_cache(maxsize=2)
def exact_encoder(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; all but the first have ``capacity`` ids."""
    head = n % capacity or capacity
    starts = [0, *range(head, n, capacity)]
    return [(s, min(head if s == 0 else capacity, n)) for s in starts]


def tokenise(docs: DataFrame, tokenizer: dict[str, str], capacity: int) -> DataFrame:
    """One row for each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(**tokenizer)
        for batch in batches:
            ids, rows = batch.column(0), []
            for k, text in enumerate(batch.column(1)):
                got = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                rows += [(k, p, s, n, zlib.crc32(got[s : s + n].tobytes())) for p, (s, n) in enumerate(cut(len(got), capacity))]
            if rows:
                at, piece, start, length, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
            give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that ``lengths`` need at least."""
    return bound_of(*np.unique(lengths, return_counts=True), capacity)


def bound_of(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Bins that ``counts`` items of each of ``sizes`` need at least: the best of three families of dual feasible functions.

    Each function maps sizes to values such that no bin's values exceed one; so the sum of
    the values, rounded up, is a bound.  All sums are exact integers over a common divisor.
    """
    if not len(sizes):
        return 0
    best = -(-int((sizes * counts).sum()) // capacity)
    # Sizes above capacity - e count as whole bins and those below e not at all.
    for e in range(1, capacity // 2 + 1):
        value = np.where(sizes > capacity - e, capacity, np.where(sizes < e, 0, sizes))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    # Rounding to k + 1 steps: a size between two steps counts as the lower step of k.
    for k in range(1, 65):
        scaled = sizes * (k + 1)
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (capacity * k)))
    # Units of e: small sizes round down to units, large ones leave their gap in whole units.
    for e in range(1, capacity // 2 + 1):
        units = capacity // e
        value = np.where(2 * sizes > capacity, 2 * (units - (capacity - sizes) // e), np.where(2 * sizes == capacity, units, 2 * (sizes // e)))
        best = max(best, -(-int((value * counts).sum()) // (2 * units)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and what each bin has left."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: some bin has r left
    for k in np.argsort(-lengths, kind="stable"):
        need = int(lengths[k])
        fitting = free >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                free ^= 1 << room
        else:
            b, room = len(left), capacity
            left.append(capacity)
        bins[k], offsets[k] = b, capacity - room
        left[b] = room = room - need
        if room:
            if not stacks[room]:
                free |= 1 << room
            stacks[room].append(b)
    return bins, offsets, np.array(left, np.int64)


def _pack_group(capacity: int, round_no: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        lengths = group["length"].to_numpy()
        bins, offsets, left = best_fit_decreasing(lengths, capacity)
        certified = len(left) == lower_bound(lengths, capacity)
        label = (round_no << 56) + (int(group["g"].iloc[0]) << 24)
        out = group.drop(columns="g")
        out["sequence_id"], out["offset"] = label + bins, offsets
        out["open"] = (left[bins] > 0) & (not certified)
        return out

    return run


def pack(
    docs: DataFrame,
    tokenizer: dict[str, str],
    capacity: int = CAPACITY,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it.

    ``docs`` needs ``doc_id`` and ``text``; ``tokenizer`` names the files for ``encoder``.
    A group gets about ``group_pieces`` pieces, which bounds a task's memory at any input
    size; groups are dealt by hash, so no source or key makes one larger than the others.
    """
    work = Workspace(docs.sparkSession, "packing")
    items = work.table(tokenise(docs, tokenizer, capacity), "pieces")
    sizes, counts = np.array(sorted(map(tuple, items.groupBy("length").count().collect())), np.int64).reshape(-1, 2).T
    out, count, round_no = [], int(counts.sum()), 0
    groups = -(-count // group_pieces)
    while count:
        dealt = items.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(round_no)), F.lit(groups)))
        packed = dealt.groupBy("g").applyInPandas(_pack_group(capacity, round_no), f"{PIECES}, sequence_id long, offset long, open boolean")
        packed = work.table(packed, f"round{round_no}")
        if round_no == 0:
            work.drop("pieces")
        count = packed.filter("open").count() if groups > 1 else 0
        fewer = -(-count // group_pieces)
        if count and fewer < groups:
            out.append(packed.filter(~F.col("open")))
            items, groups, round_no = packed.filter("open").drop("open", "sequence_id", "offset"), fewer, round_no + 1
        else:
            out.append(packed)
            count = 0
    if not out:
        out = [items.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    packed = functools.reduce(DataFrame.unionAll, [x.select(columns) for x in out])
    return packed.withColumn("bound", F.lit(bound_of(sizes, counts, capacity)).cast("long"))
