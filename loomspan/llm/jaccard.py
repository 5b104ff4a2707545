"""Exact Jaccard join of documents' shingle sets as a metric-space join.

One minus the Jaccard similarity is a metric on sets.  Unrelated documents all lie at
distance one from each other, so that documents alone make poor pivots; the first level
therefore takes one-shingle sets, which are points of the same space.  The nearest of these
pivots to a document are its own shingles, all equally near, and a fixed order breaks the
tie.  A document within the radius of another misses at most a known share of its shingles,
so that its region lies within a window of that order: a document is replicated to the
regions of its first ``n - ceil(t * n) + 1`` shingles, and any two linked documents meet in
a region.

* In a small region all pairs are candidates.  They are counted over all regions, and the
  count, the sizes and what the windows leave open bound the overlap before any set moves.
  Candidates that hang together are one region of the next level.
* Large regions with one least member are one region of the next level too.
* Such regions join recursively: document pivots, exact distances to them, Voronoi regions with
  documents copied to a neighbour if their distance to it is within twice the radius of that to
  their own pivot, and so on.  Documents far from all pivots are a region of their own, and
  copied to pivots that a neighbour within the radius may belong to.  Where that would copy nearly
  all to nearly everywhere, as in a large group of near copies, the members outside the largest
  component meet all others instead: a matrix product over the elements that most have bounds
  all overlaps at once, and only pairs that it leaves possible are compared.
* A region of more than ``REGION_BYTES`` is split by Spark: its members' distances to the pivots
  are found in slices.  Pivots are the members that stand in most large regions, as the centre
  of a group of near copies does.  What is linked to one pivot is one component already, and
  a region whose members are one component is done; a pivot is done at once, having met all.
  A smaller region is joined by one task, by the same recursion.
* What pivots do not separate, or is still larger after ``LEVELS`` levels, is compared in blocks and
  slices: members outside its largest component with all others.

The order puts shingles of large regions last; that only steers the work, for any order
gives the same links.  Equal sets are one class throughout.

Defined results: null, empty and wordless texts have no shingles and link with nothing, each
its own component; texts of fewer words than a shingle have one, their whole sequence;
repeated rows share a component; a null id is ignored for the component's least id; an
empty table gives an empty result.  Sets hold 64-bit hashes, of which 48 bits are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textscan
from .components import components
from .shared import ACTION, Workspace, setting, small_enough

SHINGLE = 4
PERCENT = 85
LEAF = 32
REGION_BYTES = 6 << 20  # of packed sets in one task
PIVOTS = 8
LEVELS = 6
FAR = 0.6  # distance beyond which a document belongs to no pivot
MOST_OF, MOST_COPIES = 0.7, 3  # of a region's members: in one of its cells, and in all of them together
DENSE, COLUMNS, AT_ONCE = 1 << 23, 2048, 1 << 21  # numbers of four bytes in a matrix, its columns, and pairs bounded at once
MOST_BROADCAST = 100_000  # rows of a few numbers
MOST_FREQUENT = 200_000
BYTES = 6  # of each shingle in a packed set

U = np.uint64


def shingle_sets(part: textscan.Slice, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a slice."""
    at, grams = part.grams(size)
    rows = part.row[at]
    bounds = np.searchsorted(rows, np.arange(part.n + 1))
    words = part.bounds()
    out = []
    for k in range(part.n):
        if bounds[k] < bounds[k + 1]:
            out.append(np.unique(grams[bounds[k] : bounds[k + 1]]))
        else:
            few = part.hash[words[k] : words[k + 1]]
            whole = np.zeros(min(len(few), 1), U)
            for h in few:  # fewer than ``size``
                whole = textscan.mix(whole * textscan.WORD_BASE + h + U(len(few)))
            out.append(whole)
    return out


def signature(values: np.ndarray) -> int:
    """One number for a set, the same for equal sets."""
    total = textscan.mix(values + U(0xA0761D6478BD642F)).sum(dtype=U)
    return int(textscan.mix(np.array([total + U(len(values))], U)).view(np.int64)[0])


def needed(a: int, b: int, percent: int) -> int:
    """Common shingles that sets of sizes ``a`` and ``b`` need to be linked."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1 if n else 0


def sets_and_prefixes(docs: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Of each document: set size, signature and the shingles of its window."""
    alphabet = textscan.unspaced(lower=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch.column(1), alphabet):
                sets = shingle_sets(part, size)
                prefixes = []
                for values in sets:
                    k = prefix_size(len(values), percent)
                    if len(frequent) and k:
                        spot = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
                        last = frequent[spot] == values
                        values = np.concatenate([values[~last], values[last]])
                    prefixes.append(values[:k].view(np.int64))
                bounds = np.cumsum([0, *map(len, prefixes)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, part.n).cast(pa.int64()),
                        pa.array([len(v) for v in sets], pa.int64()),
                        pa.array([signature(v) if len(v) else None for v in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(prefixes), pa.int64())),
                    ],
                    names=["doc_id", "n", "sig", "prefix"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, sig long, prefix array<long>")


def frequent_shingles(docs: DataFrame, size: int, percent: int, leaf: int, most: int) -> np.ndarray:
    """Shingles whose regions would be large in the plain hash order, the ``most`` largest at most."""
    windows = sets_and_prefixes(docs, size, percent, np.zeros(0, U))
    counted = windows.select(F.explode("prefix").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    with setting(docs.sparkSession, ACTION):
        top = counted.filter(F.col("n") > leaf).orderBy(F.desc("n"), "s").limit(most).select("s").toArrow()
    return np.unique(top.column(0).to_numpy().view(U))


def packed_sets(texts: DataFrame, size: int) -> DataFrame:
    """(sig, n, blob): the top 48 bits of each shingle, sorted."""
    alphabet = textscan.unspaced(lower=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_numpy()
            for part in textscan.slices(batch.column(1), alphabet):
                rows = [(sig, len(v), v.view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :].tobytes()) for v in shingle_sets(part, size) for sig in [signature(v)]]
                rows = [r for r, w in zip(rows, wanted[part.first : part.first + part.n]) if r[0] == w]
                sig, n, blob = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(n, pa.int64()), pa.array(blob, pa.binary())], names=["sig", "n", "blob"])

    return texts.mapInArrow(run, "sig long, n long, blob binary")


class Sets:
    """Members of a cell as one sparse table: element numbers of all sets, one after another."""

    def __init__(self, sigs: np.ndarray, blobs: list[bytes]):
        self.sigs = sigs
        self.n = np.array([len(b) // BYTES for b in blobs], np.int64)
        wide = np.zeros((int(self.n.sum()), 8), np.uint8)
        wide[:, 8 - BYTES :] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, BYTES)
        values, self.ids, often = np.unique(wide.view(U).ravel(), return_inverse=True, return_counts=True)
        self.begin = np.cumsum(self.n) - self.n
        self.mark = np.zeros(len(values), bool)
        total = np.concatenate([[0], np.cumsum(often[self.ids])])
        self.central = (total[self.begin + self.n] - total[self.begin]) / np.maximum(self.n, 1)  # how many have a member's elements

    def elements(self, members: np.ndarray) -> np.ndarray:
        """Element numbers of ``members``, one after another."""
        count = self.n[members]
        return self.ids[np.repeat(self.begin[members] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]

    def overlaps(self, x: int, others: np.ndarray) -> np.ndarray:
        """Elements that member ``x`` has in common with each of ``others``."""
        own = self.ids[self.begin[x] : self.begin[x] + self.n[x]]
        self.mark[own] = True
        count = self.n[others]
        total = np.concatenate([[0], np.cumsum(self.mark[self.elements(others)])])
        self.mark[own] = False
        ends = np.cumsum(count)
        return total[ends] - total[ends - count]

    def dense(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row of 0 and 1 for each member, over the elements that most of them have; and how many other shared elements each has."""
        ids = self.elements(members)
        own, counts = np.unique(ids, return_counts=True)
        shared = own[counts > 1]
        most = max(1, min(COLUMNS, DENSE // len(members)))
        top = shared[np.argsort(-counts[counts > 1], kind="stable")[:most]]
        column = np.full(len(self.mark), -1, np.int32)
        column[shared], column[top] = -2, np.arange(len(top))
        row, spot = np.repeat(np.arange(len(members)), self.n[members]), column[ids]
        table = np.zeros((len(members), len(top)), np.float32)
        table[row[spot >= 0], spot[spot >= 0]] = 1
        return table, np.bincount(row[spot == -2], minlength=len(members)).astype(np.float32)


class Forest:
    """Union-find over a cell's members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y

    def roots(self, members: np.ndarray) -> np.ndarray:
        if len(members) < len(self.up) // 16:
            return np.array([self.find(int(m)) for m in members], np.int64)
        up = np.array(self.up, np.int64)
        while (up != up[up]).any():
            up = up[up]
        return up[members]


class Region:
    """Exact links within a cell, as far as they connect what is not yet connected."""

    DIRECT, DEPTH, FEW = 16, 6, 64

    def __init__(self, sets: Sets, percent: int):
        self.sets, self.percent, self.radius = sets, percent, 1 - percent / 100
        self.forest, self.links = Forest(len(sets.n)), []

    def known(self, labels: list) -> None:
        """Members of one label are connected; null is none."""
        first: dict[int, int] = {}
        for k, label in enumerate(labels):
            if label is not None:
                self.forest.join(first.setdefault(label, k), k)

    def compare(self, x: int, others: np.ndarray, level: int) -> np.ndarray:
        """Distances of ``x`` to ``others``; links found on the way are kept, with ``level``: that of the pivots, 0 without."""
        common = self.sets.overlaps(x, others)
        union = self.sets.n[others] + self.sets.n[x] - common
        for y in others[100 * common >= self.percent * union]:
            if self.forest.join(x, int(y)):
                self.links.append((x, int(y), level))
        return 1 - common / union

    def join(self, members: np.ndarray, depth: int = 0) -> None:
        roots = self.forest.roots(members)
        if len(members) < 2 or (roots == roots[0]).all():
            return
        if len(members) <= self.DIRECT or depth == self.DEPTH:
            return self.outright(members)
        pivots = members[np.linspace(0, len(members) - 1, min(PIVOTS, len(members))).astype(int)]
        pivots[0] = members[np.argmax(self.sets.central[members])]  # of a group of near copies, what they are copies of
        distance = np.stack([self.compare(int(p), members, depth + 1) for p in pivots])
        own = distance.min(axis=0)
        near = distance <= own + 2 * self.radius + 1e-9
        cells = [members[row] for row in near]
        if max(map(len, cells)) > MOST_OF * len(members) or sum(map(len, cells)) > MOST_COPIES * len(members):  # the pivots do not separate these
            return self.outright(members)
        for cell in cells:
            self.join(cell, depth + 1)

    def outright(self, members: np.ndarray) -> None:
        """Compare members with all others that sizes and common elements leave possible.

        Pairs within the largest component stay uncompared: they are connected already.
        """
        roots = self.forest.roots(members)
        values, counts = np.unique(roots, return_counts=True)
        asking = np.flatnonzero(roots != values[np.argmax(counts)])
        if len(members) > self.FEW:
            return self.meet(members, asking, np.arange(len(members)))
        sizes = self.sets.n[members]
        for k in asking:
            x = int(members[k])
            others = self.forest.roots(members) != self.forest.find(x)
            others &= (100 * sizes >= self.percent * sizes[k]) & (self.percent * sizes <= 100 * sizes[k])
            if others.any():
                self.compare(x, members[others], 0)

    def meet(self, members: np.ndarray, asking: np.ndarray, others: np.ndarray) -> None:
        """Compare ``asking`` with ``others`` of other components, both places in ``members``, where overlaps may be large enough.

        An overlap is that of the matrix and no more than either has beside it.
        """
        if not len(asking) or not len(others):
            return
        table, left = self.sets.dense(members)
        share = np.float32(self.percent / (100 + self.percent))
        need = share * self.sets.n[members].astype(np.float32) - np.float32(0.25)
        right, left_right, need_right = table[others].T, left[others], need[others]
        step = max(1, AT_ONCE // len(others))
        for first in range(0, len(asking), step):
            part = asking[first : first + step]
            roots = self.forest.roots(members)
            most = table[part] @ right
            most += np.minimum(left[part, None], left_right)
            most -= need[part, None]
            possible = (most >= need_right) & (roots[part, None] != roots[others])
            for k in np.flatnonzero(possible.any(axis=1)):
                x, ys = int(members[part[k]]), members[others[possible[k]]]
                ys = ys[self.forest.roots(ys) != self.forest.find(x)]
                if len(ys):
                    self.compare(x, ys, 0)


LINKS = "u long, v long, level int"


def _links(sigs: np.ndarray, links: list[tuple[int, int, int]]) -> pa.Table:
    u, v, level = np.array(links, np.int64).reshape(-1, 3).T
    return pa.table({"u": pa.array(sigs[u], pa.int64()), "v": pa.array(sigs[v], pa.int64()), "level": pa.array(level, pa.int32())})


def _sets(table: pa.Table, order: np.ndarray) -> Sets:
    return Sets(table.column("sig").to_numpy()[order], [table.column("blob")[int(k)].as_py() for k in order])


def _join_region(percent: int):
    """All links of one region that connect what its members' components do not."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = np.argsort(table.column("sig").to_numpy(), kind="stable")
        region = Region(_sets(table, order), percent)
        region.known(table.column("comp").take(pa.array(order)).to_pylist())
        region.join(np.arange(len(order)))
        return _links(region.sets.sigs, region.links)

    return run


SPLIT = "region long, sig long, n long, wide long, comp long, own boolean, nearest int, near int, linked int, links array<long>"


def _distances(percent: int):
    """For each member of a slice: its nearest pivot, the pivots within its window, and those it is linked with, as bits."""
    radius = 1 - percent / 100

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        pivot = table.column("pivot").to_numpy()
        members, pivots = np.flatnonzero(pivot < 0), np.flatnonzero(pivot >= 0)
        pivots = pivots[np.argsort(pivot[pivots])]
        sets = _sets(table, np.arange(len(pivot)))
        bits = 1 << np.arange(len(pivots))[:, None]
        common = np.stack([sets.overlaps(int(p), members) for p in pivots])
        union = sets.n[pivots][:, None] + sets.n[members] - common
        distance, linked = 1 - common / union, 100 * common >= percent * union
        own, done = distance.min(axis=0), np.isin(sets.sigs[members], sets.sigs[pivots])
        near = (distance <= np.where(own > FAR, FAR + radius, own + 2 * radius) + 1e-9) & ~done
        rest = np.where((own > FAR) & ~done, 1 << PIVOTS, 0)
        out = table.take(pa.array(members))
        names = sets.sigs[pivots]
        return pa.table(
            {c: out.column(c) for c in ("region", "sig", "n", "wide", "comp", "own")}
            | {
                "nearest": pa.array(np.where(own > FAR, PIVOTS, distance.argmin(axis=0)), pa.int32()),
                "near": pa.array((near * bits).sum(axis=0) | rest, pa.int32()),
                "linked": pa.array((linked * bits).sum(axis=0), pa.int32()),
                "links": pa.array([names[row].tolist() for row in linked.T], pa.list_(pa.int64())),
            }
        )

    return run


def _merged(table: pa.Table) -> pa.Table:
    """Components that a region's pivots make of each other; no more rows than earlier components times sets of pivots."""
    rows = table.select(["region", "comp", "linked", "links"]).to_pylist()
    labels = [([] if r["comp"] is None else [r["comp"]]) + r["links"] for r in rows]
    number = {x: k for k, x in enumerate(sorted({x for own in labels for x in own}))}
    forest, names = Forest(len(number)), sorted(number)
    for own in labels:
        for x in own[1:]:
            forest.join(number[own[0]], number[x])
    merged = [names[forest.find(number[own[0]])] if own else None for own in labels]
    return pa.table([table.column("region"), table.column("comp"), table.column("linked"), pa.array(merged, pa.int64())], names=["region", "comp", "linked", "merged"])


def _outright(percent: int):
    """Links of the queries of a block with the members of a slice that are of other components."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        query = table.column("query").to_numpy(zero_copy_only=False)
        region = Region(_sets(table, np.arange(len(query))), percent)
        region.known(table.column("comp").to_pylist())
        region.known(table.column("sig").to_pylist())  # queries are among the members too
        region.meet(np.arange(len(query)), np.flatnonzero(query), np.flatnonzero(~query))
        return _links(region.sets.sigs, region.links)

    return run


def candidates(regions: DataFrame, percent: int, leaf: int) -> DataFrame:
    """(sig_a, sig_b) of small regions that their counts leave possible; ``a`` has the larger set.

    ``regions`` has (s, sig, n, p, size, pivot), ``p`` the window's length and ``size`` the region's.
    Common shingles outside both windows are at most those that the shorter reach leaves out.
    """
    in_large = regions.filter(F.col("size") > leaf).groupBy("sig").agg(F.count("*").alias("wide"))
    small = regions.filter(F.col("size") <= leaf).join(in_large, "sig", "left").fillna(0, ["wide"])
    a = small.select("s", *[F.col(c).alias(f"{c}_a") for c in ("sig", "n", "p", "wide")])
    b = small.select("s", *[F.col(c).alias(f"{c}_b") for c in ("sig", "n", "p", "wide")])
    pairs = a.join(b, "s").filter(
        (F.struct("n_a", "sig_a") > F.struct("n_b", "sig_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    )
    pairs = pairs.groupBy("sig_a", "sig_b", "n_a", "n_b", "p_a", "p_b", "wide_a", "wide_b").agg(F.count("*").alias("c"))
    need = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent) - 1e-9)
    beyond = F.greatest(F.expr("n_a - p_a"), F.expr("n_b - p_b"))
    return pairs.filter(F.col("c") + F.least("wide_a", "wide_b") + beyond >= need).select("sig_a", "sig_b")


def around_pivots(regions: DataFrame, leaf: int) -> DataFrame:
    """(pivot, sig): the large regions' members, around the least member of each."""
    return regions.filter(F.col("size") > leaf).select("pivot", "sig").distinct()


def _attach(rows: DataFrame, few: DataFrame, on) -> DataFrame:
    """``rows`` with the columns of ``few``, of which each row meets one; by broadcast while they are few."""
    return rows.join(F.broadcast(few) if small_enough(few, MOST_BROADCAST) else few, on)


class Regions:
    """Recursion over regions too large for a task; ``sets`` has (sig, blob)."""

    def __init__(self, sets: DataFrame, work: Workspace, percent: int, most: int):
        self.sets, self.work, self.percent, self.most = sets, work, percent, most
        self.links: list[DataFrame] = []

    def sized(self, members: DataFrame, name: str) -> DataFrame:
        """(region, bytes, open): open if it has members of its own and of more than one component."""
        several = (F.count("comp") < F.count(F.lit(1))) | (F.min("comp") < F.max("comp"))
        sizes = members.groupBy("region").agg((F.sum("n") * BYTES).alias("bytes"), (F.max("own") & several & (F.count(F.lit(1)) > 1)).alias("open"))
        return self.work.table(sizes, name)

    def join(self, members: DataFrame, level: int = 0) -> None:
        """Links of the regions of ``members`` (region, sig, n, wide, comp, own)."""
        sizes = self.sized(members, f"sizes{level}")
        members = _attach(members, sizes.filter("open"), "region")
        small = members.filter(F.col("bytes") <= self.most).join(self.sets, "sig").select("region", "sig", "comp", "blob")
        small = small.groupBy("region").applyInArrow(_join_region(self.percent), LINKS)
        self.links.append(self.work.table(small, f"joined{level}"))
        if sizes.filter(F.col("open") & (F.col("bytes") > self.most)).isEmpty():
            return
        large = members.filter(F.col("bytes") > self.most)
        if level == LEVELS:
            return self.compare(large, level)
        self.join(self.split(large, level + 1), level + 1)

    def split(self, large: DataFrame, level: int) -> DataFrame:
        """The members of the Voronoi regions around each region's pivots, and copies within their windows.

        Regions that these would not make much smaller are compared here, and have none.
        """
        first = Window.partitionBy("region").orderBy(F.col("comp").isNotNull(), F.desc("wide"), "sig")
        pivots = large.withColumn("pivot", F.row_number().over(first) - 1).filter(F.col("pivot") < PIVOTS)
        pivots = self.work.table(pivots.withColumn("slice", F.explode(F.sequence(F.lit(0), self.slices("bytes") - 1))), f"pivots{level}")
        dealt = large.withColumns({"pivot": F.lit(-1), "slice": F.pmod(F.xxhash64("sig"), self.slices("bytes")).cast("int")})
        rows = dealt.unionByName(pivots).join(self.sets, "sig")
        found = rows.groupBy("region", "slice").applyInArrow(_distances(self.percent), SPLIT)
        found = self.work.table(found, f"split{level}")
        kinds = found.groupBy("region", "comp", "linked").agg(F.first("links").alias("links"), F.min("sig").alias("one"))
        kinds = self.work.table(kinds, f"kinds{level}")
        stars = found.filter("linked != 0").select(F.col("links")[0].alias("u"), F.col("sig").alias("v"))
        bridges = kinds.select(F.explode("links").alias("u"), F.col("one").alias("v"))
        self.links.append(stars.unionAll(bridges).withColumn("level", F.lit(100 + level)))
        merged = kinds.groupBy("region").applyInArrow(_merged, "region long, comp long, linked int, merged long")
        merged = self.work.table(merged.select(F.col("region").alias("of"), F.col("comp").alias("was"), F.col("linked").alias("by"), "merged"), f"merged{level}")
        on = (F.col("region") == F.col("of")) & F.col("comp").eqNullSafe(F.col("was")) & (F.col("linked") == F.col("by"))
        bits = F.expr(f"filter(sequence(0, {PIVOTS}), i -> (shiftright(near, i) & 1) = 1)")
        cells = [F.count_if(F.shiftright("near", i) % 2 == 1) for i in range(PIVOTS + 1)]
        apart = (F.greatest(*cells) <= MOST_OF * F.count(F.lit(1))) & (sum(cells[1:], cells[0]) <= MOST_COPIES * F.count(F.lit(1)))
        apart = found.groupBy("region").agg(apart.alias("apart"), (F.sum("n") * BYTES).alias("bytes"))
        apart = self.work.table(apart.select(F.col("region").alias("cut"), "apart", "bytes"), f"apart{level}")
        rows = _attach(_attach(found.filter("near != 0"), merged, on), apart, F.col("region") == F.col("cut"))
        if not apart.filter("NOT apart").isEmpty():
            self.compare(rows.filter("NOT apart").select("region", "sig", "n", F.col("merged").alias("comp"), "bytes"), level)
        rows = rows.filter("apart").withColumn("i", F.explode(bits))
        rows = rows.select(F.xxhash64("region", "i").alias("region"), "sig", "n", "wide", F.col("merged").alias("comp"), (F.col("own") & (F.col("i") == F.col("nearest"))).alias("own"))
        return self.work.table(rows, f"members{level}")

    def slices(self, size: str) -> Column:
        return F.ceil(F.col(size) / F.lit(float(self.most))).cast("int")

    def compare(self, large: DataFrame, level: int) -> None:
        """Links of a region's members outside its most frequent component with all others, by blocks and slices."""
        main = large.groupBy("region").agg(F.mode("comp").alias("main"))
        large = self.work.table(_attach(large, self.work.table(main, f"mains{level}"), "region"), f"large{level}")
        asking = F.col("comp").isNull() | (F.col("comp") != F.col("main"))
        blocks = self.work.table(large.filter(asking).groupBy("region").agg((F.sum("n") * BYTES).alias("asked")), f"blocks{level}")
        rows = _attach(large, blocks, "region").withColumns({"block": F.pmod(F.xxhash64("sig"), self.slices("asked")).cast("int"), "slice": F.pmod(F.xxhash64("sig", F.lit(1)), self.slices("bytes")).cast("int")})
        asks = rows.filter(asking).withColumns({"query": F.lit(True), "slice": F.explode(F.sequence(F.lit(0), self.slices("bytes") - 1))})
        rest = rows.withColumns({"query": F.lit(False), "block": F.explode(F.sequence(F.lit(0), self.slices("asked") - 1))})
        rows = asks.unionByName(rest).join(self.sets, "sig").select("region", "block", "slice", "sig", "comp", "query", "blob")
        self.links.append(self.work.table(rows.groupBy("region", "block", "slice").applyInArrow(_outright(self.percent), LINKS), f"compared{level}"))


def links(docs: DataFrame, found: DataFrame, least: DataFrame, work: Workspace, size: int, percent: int, leaf: int, most: int) -> DataFrame:
    """(u, v, level) of linked sets, as many as connect what is linked; ``found`` has the documents' sets and windows, ``least`` each set once.

    ``level`` is 0 for sets compared outright, 1 and more for those of a pivot within a task, above 100 for those of a pivot by Spark.
    """
    classes = found.filter("n > 0").groupBy("sig").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    rows = classes.select(F.explode("prefix").alias("s"), "sig", "n", F.size("prefix").alias("p"))
    # Counts combine before their shuffle, and a join can split a large region over tasks; a window could not.
    sizes = rows.groupBy("s").agg(F.count("*").alias("size"), F.min("sig").alias("pivot")).filter("size > 1")
    regions = work.table(rows.join(sizes, "s"), "regions")
    pairs = work.table(candidates(regions, percent, leaf), "pairs")
    cells = work.table(around_pivots(regions, leaf), "cells")
    wide = work.table(regions.filter(F.col("size") > leaf).groupBy("sig").agg(F.count("*").alias("wide")), "wide")
    work.drop("regions")
    group = components(pairs.select(F.col("sig_a").alias("u"), F.col("sig_b").alias("v")), work, "groups")
    group = group.unionAll(group.select(F.col("root").alias("node"), "root").distinct())
    roots = group.select(F.xxhash64(F.lit("pairs"), "root").alias("region"), F.col("node").alias("sig"))
    roots = roots.unionAll(cells.select(F.xxhash64(F.lit("pivot"), "pivot").alias("region"), "sig"))
    members = roots.join(least.select("sig", "n"), "sig").join(wide, "sig", "left").fillna(0, ["wide"])
    members = work.table(members.select("region", "sig", "n", "wide", F.lit(None).cast("long").alias("comp"), F.lit(True).alias("own")), "members0")
    wanted = members.select("sig").distinct().join(least, "sig").select("sig", F.col("least").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id"))).select("sig", "text")
    sets = work.table(packed_sets(texts, size).dropDuplicates(["sig"]) if repeats_ids(docs) else packed_sets(texts, size), "sets")
    recursion = Regions(sets.select("sig", "blob"), work, percent, most)
    recursion.join(members)
    return reduce(DataFrame.unionAll, recursion.links)


def linked(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, leaf: int = LEAF, most: int = REGION_BYTES) -> DataFrame:
    """Every document with the size of its set and the least id that links reach."""
    work = Workspace(docs.sparkSession, "jaccard")
    frequent = frequent_shingles(docs, size, percent, leaf, MOST_FREQUENT)
    found = work.table(sets_and_prefixes(docs, size, percent, frequent), "documents")
    least = work.table(found.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"), F.first("n").alias("n")), "least")
    edges = links(docs, found, least, work, size, percent, leaf, most)
    roots = components(edges.select("u", "v"), work)
    named = least.join(roots, least.sig == roots.node, "left").select("sig", "least", F.coalesce("root", "sig").alias("root"))
    named = work.table(named, "roots")
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
    final = named.join(of_root, "root").select("sig", "component_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), "sig").join(final, "sig", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def repeats_ids(docs: DataFrame) -> bool:
    """Whether an id occurs on several rows; their texts may be equal, and a set must be there once."""
    return bool(docs.groupBy("doc_id").count().filter("count > 1").limit(1).count())
