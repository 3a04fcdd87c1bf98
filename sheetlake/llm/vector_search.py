"""Nearest neighbours by an inverted multi-index over vector halves.

Two codebooks, one per half, are fitted on a bounded sample; a vector belongs to the cell of its two
nearest centroids.  A query walks the pairs of centroids by the sum of its two distances, taken from
a heap, until the cells it has met hold enough rows; the rows of those cells are ranked by
their exact distance.  How many are enough is read off the sample: the share of all rows that has to
be met so that ``TARGET`` of the sample's true neighbours are among them, and ``LEAST`` at any rate.

All rows are laid on a line, cell by cell, and the line is cut into shelves of equal length, so a
crowded cell spans several shelves and no task holds more rows than others.  A shelf sits in
one task's memory while its queries stream past; each query meets a shelf once.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType
from pyspark.sql.window import Window

from sheetlake.llm.tables import arrow_map, stored
from sheetlake.llm.vectors import blobs, matrix, unblobbed
from sheetlake.llm.words import mix

NEIGHBOURS, EVERY = 10, 100
#: Rows that fit the codebooks and the depth; about this many are drawn, at most twice as many.
SAMPLE = 8192
#: Share of the sample's true neighbours the walk has to reach, and rows it reaches at least.
TARGET, LEAST = 0.97, 2048
#: Centroids a half: cells of about 64 rows, within these bounds.
CELL_ROWS, FEWEST, MOST = 64, 4, 256
#: Rows of a shelf, and shelves at least.
SHELF_ROWS, SHELVES = 1 << 18, 64
#: Distances computed at a time.
TILE = 1 << 21
U = np.uint64


def fit(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids of the sample's rows; starts are spread over it by a fixed stride."""
    k = min(k, len(sample))
    order = np.lexsort(sample.T) if sample.shape[1] else np.arange(len(sample))
    centroids = sample[order[np.linspace(0, len(sample) - 1, k).astype(int)]].copy()
    for _ in range(rounds):
        near = assign(sample, centroids)
        for c in range(k):
            members = sample[near == c]
            if len(members):
                centroids[c] = members.mean(axis=0)
    return centroids


def assign(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each row, the smaller of equals."""
    return spans(rows, centroids).argmin(axis=1)


def spans(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centroids."""
    return (rows * rows).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * (rows @ centroids.T)


class Index:
    """Codebooks, cell sizes and the line of shelves."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right, self.cut = left, right, left.shape[1]
        self.depth = 1.0

    def cells(self, rows: np.ndarray) -> np.ndarray:
        return assign(rows[:, : self.cut], self.left) * len(self.right) + assign(rows[:, self.cut :], self.right)

    def fill(self, sizes: np.ndarray, shelf_rows: int = SHELF_ROWS) -> None:
        """Cell sizes: where each cell lies on the line of all rows, and how many shelves cut it."""
        self.sizes, self.rows = sizes, int(sizes.sum())
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.shelves = max(SHELVES, -(-self.rows // shelf_rows))
        self.enough = max(LEAST, int(np.ceil(self.depth * self.rows)))
        # first and last cell with rows on each shelf
        filled = np.flatnonzero(sizes)
        low = (self.starts[filled] * self.shelves) // max(self.rows, 1)
        high = ((self.starts[filled + 1] - 1) * self.shelves) // max(self.rows, 1)
        at = np.arange(self.shelves)
        self.first = np.append(filled, 0)[np.searchsorted(high, at)]
        self.last = np.append(filled, 0)[np.searchsorted(low, at, "right") - 1]
        self.occupied = np.searchsorted(high, at) <= np.searchsorted(low, at, "right") - 1

    def shelf(self, cells: np.ndarray, share: np.ndarray) -> np.ndarray:
        """The shelf of rows: a cell's rows are dealt over its stretch of the line by ``share`` (0 to 1)."""
        place = self.starts[cells] + np.minimum((share * self.sizes[cells]).astype(np.int64), self.sizes[cells] - 1)
        return place * self.shelves // self.rows

    def walk(self, query: np.ndarray) -> list[int]:
        """Cells by summed distance until they hold enough rows."""
        a = spans(query[None, : self.cut], self.left)[0]
        b = spans(query[None, self.cut :], self.right)[0]
        by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = a[by_a].tolist(), b[by_b].tolist()
        by_a, by_b, sizes, wide = by_a.tolist(), by_b.tolist(), self.sizes, len(self.right)
        heap, met, out = [(a[0] + b[0], 0, 0)], 0, []
        while heap and met < self.enough:
            _, i, j = heapq.heappop(heap)
            cell = by_a[i] * wide + by_b[j]
            if sizes[cell]:
                out.append(cell)
                met += int(sizes[cell])
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        return out

    def calibrate(self, sample: np.ndarray, queries: int = 128) -> None:
        """Share of the rows to meet so that TARGET of the sample's true neighbours are met."""
        cells, wide = self.cells(sample), len(self.right)
        sizes = np.bincount(cells, minlength=len(self.left) * wide)
        needed = []
        for q in np.unique(np.linspace(0, len(sample) - 1, queries).astype(int)):
            apart = ((sample - sample[q]) ** 2).sum(1)
            apart[q] = np.inf
            true = np.argsort(apart, kind="stable")[: min(NEIGHBOURS, len(sample) - 1)]
            pairs = (spans(sample[q][None, : self.cut], self.left)[0][:, None]
                     + spans(sample[q][None, self.cut :], self.right)[0][None, :]).ravel()
            order = np.argsort(pairs, kind="stable")
            share = np.empty(len(order))
            share[order] = np.cumsum(sizes[order]) / len(sample)
            needed += share[cells[true]].tolist()
        self.depth = float(np.quantile(needed, TARGET)) if needed else 1.0


class Shelf:
    """The rows of one shelf; of equal vectors only the smallest ids that a list can need."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray, values: np.ndarray):
        bits = np.ascontiguousarray(values).view(np.uint64)
        key = mix((bits * (np.arange(1, bits.shape[1] + 1, dtype=U) * U(0x9E3779B97F4A7C15) | U(1))).sum(1, dtype=U))
        order = np.lexsort((ids, key))
        ids, cells, values, key = ids[order], cells[order], values[order], key[order]
        new = np.ones(len(ids), bool)
        new[1:] = (key[1:] != key[:-1]) | (values[1:] != values[:-1]).any(axis=1)
        at = np.arange(len(ids))
        other = new.copy()
        other[1:] |= ids[1:] != ids[:-1]
        copy = at - np.maximum.accumulate(np.where(other, at, 0))
        number = np.cumsum(other)
        number = number - number[np.maximum.accumulate(np.where(new, at, 0))] if len(at) else number
        # one id more than a list holds, since one may be the query's own
        keep = (copy < NEIGHBOURS) & (number <= NEIGHBOURS)
        self.ids, self.cells, self.values = ids[keep], cells[keep], values[keep]
        with np.errstate(over="ignore"):
            self.norms = (self.values * self.values).sum(1)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, allowed: np.ndarray) -> Iterator[tuple]:
        """(query number, ids, distances) of each query's NEIGHBOURS, ``allowed``: which rows it may see."""
        step = max(1, TILE // max(len(self.ids), 1))
        for at in range(0, len(queries), step):
            q, own, seen = queries[at : at + step], query_ids[at : at + step], allowed[at : at + step]
            seen = seen & (self.ids[None, :] != own[:, None])
            with np.errstate(over="ignore", invalid="ignore"):
                norms = (q * q).sum(1)
                rough = np.where(seen, norms[:, None] + self.norms[None, :] - 2 * (q @ self.values.T), np.inf)
                slack = 1e-10 * (norms + (self.norms.max() if len(self.norms) else 0.0))
            for k in range(len(q)):
                some = np.flatnonzero(seen[k])
                if not len(some):
                    continue
                if len(some) > NEIGHBOURS and np.isfinite(slack[k]):
                    line = rough[k][some]
                    some = some[line <= np.partition(line, NEIGHBOURS - 1)[NEIGHBOURS - 1] + slack[k]]
                apart = distance(self.values[some], q[k])
                first = np.lexsort((self.ids[some], apart))[:NEIGHBOURS]
                yield at + k, self.ids[some][first], apart[first]


def distance(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components added in their order."""
    with np.errstate(over="ignore"):
        return np.sqrt(np.add.reduce(np.ascontiguousarray((rows - query).T) ** 2, axis=0))


def _usable(embeddings: DataFrame, vector: str) -> tuple[DataFrame, int, str]:
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").alias("vector"))
    rows = rows.where("vec_id is not null and vector is not null")
    kind = "<f4" if isinstance(rows.schema["vector"].dataType.elementType, FloatType) else "<f8"
    lengths = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows, (lengths["width"] if lengths else 0), kind


def search(embeddings: DataFrame, vector: str = "embedding", every: int = EVERY, shelf_rows: int = SHELF_ROWS) -> DataFrame:
    """The NEIGHBOURS nearest rows of every row whose vec_id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score (Euclidean distance of the original vectors), nearest
    first, ties to the smaller vec_id; fewer rows where fewer were found.  Rows without vec_id, null and
    all-zero vectors, and those with a null or non-finite component take no part, nor do vectors of
    another length than most (the longer of equally frequent ones).  Rows that share the query's vec_id
    are its own.  A repeated row is found once or more, a repeated query answered once; rows of one
    vec_id with different vectors are different rows, and each asks its own query.  An empty table
    gives no rows.  Other columns are ignored.  The index holds every row; recall depends on TARGET, and
    is exact for tables of up to LEAST rows.
    """
    rows, width, kind = _usable(embeddings, vector)

    def usable(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        at, values = matrix(batch.column("vector"), width)
        fine = (values != 0).any(axis=1) if width else np.zeros(0, bool)
        return batch.column("vec_id").to_numpy(zero_copy_only=False)[at[fine]], values[fine]

    n = rows.count()
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id(), "vec_id"), F.lit(1 << 32)) < F.lit(
        int((1 << 32) * min(1.0, SAMPLE / max(n, 1)))
    )

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([blobs(usable(batch)[1])], ["value"])

    taken = arrow_map(rows.where(drawn), draw, "value binary").limit(2 * SAMPLE).collect()  # bounded
    sample = np.zeros((1, width))
    if taken:
        sample = np.frombuffer(b"".join(sorted(bytes(r[0]) for r in taken)), np.float64).reshape(len(taken), width)
    cut, k = width // 2, int(np.clip(round((n / CELL_ROWS) ** 0.5), FEWEST, MOST))
    index = Index(fit(sample[:, :cut], k), fit(sample[:, cut:], k))
    index.calibrate(sample)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = usable(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(index.cells(values), pa.int32()), blobs(values.astype(kind))],
                ["vec_id", "cell", "value"],
            )

    placed = stored(arrow_map(rows, place, "vec_id bigint, cell int, value binary"))
    sizes = np.zeros(len(index.left) * len(index.right), np.int64)
    for r in placed.groupBy("cell").count().collect():  # MOST ** 2 cells at most
        sizes[r["cell"]] = r["count"]
    index.fill(sizes, shelf_rows)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            share = (mix(np.arange(met, met + len(ids)).astype(U)) >> U(11)).astype(np.float64) / (1 << 53)
            met += len(ids)
            none = pa.nulls(len(ids), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(index.shelf(cells, share), pa.int32()), pa.array(np.zeros(len(ids)), pa.int32()),
                 batch.column("vec_id"), batch.column("cell"), none, batch.column("value")], _NAMES,
            )
            asks = np.flatnonzero(ids % every == 0)
            values = unblobbed(batch.column("value").take(pa.array(asks)), kind, width).astype(np.float64)
            for at, value in zip(asks, values, strict=True):
                wanted = np.zeros(len(sizes), bool)
                wanted[index.walk(value)] = True
                shelves, masks = [], []
                for s in np.flatnonzero(index.occupied):
                    part = wanted[index.first[s] : index.last[s] + 1]
                    if part.any():
                        shelves.append(s)
                        masks.append(np.packbits(part).tobytes())
                m = len(shelves)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shelves, pa.int32()), pa.array([1] * m, pa.int32()), pa.array([int(ids[at])] * m, pa.int64()),
                     pa.nulls(m, pa.int32()), pa.array(masks, pa.binary()),
                     pa.array([batch.column("value")[int(at)].as_py()] * m, pa.binary())], _NAMES,
                )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        shelf, number, before = None, None, None
        for batch in batches:
            at = batch.column("shelf").to_numpy(zero_copy_only=False)
            ask = batch.column("kind").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(at) != 0) | (np.diff(ask) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(at)], strict=True):
                if hi == lo:
                    continue
                part = batch.slice(lo, hi - lo)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                values = unblobbed(part.column("value"), kind, width).astype(np.float64)
                if at[lo] != number:
                    number, held, shelf, before = at[lo], [], None, None
                if not ask[lo]:
                    held.append((ids, part.column("cell").to_numpy(zero_copy_only=False), values))
                    continue
                if shelf is None and not held:
                    continue  # dealing by chance may leave a shelf of few rows empty
                if shelf is None:
                    shelf = Shelf(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                names = list(zip(ids.tolist(), part.column("value").to_pylist(), strict=True))
                fresh = [k for k, x in enumerate(names) if x != (names[k - 1] if k else before)]
                before = names[-1]
                if not fresh:
                    continue
                first, last = index.first[number], index.last[number]
                masks = unblobbed(part.column("mask"), np.uint8, (last - first + 8) // 8)[fresh]
                seen = np.unpackbits(masks, axis=1, count=last - first + 1).astype(bool)[:, shelf.cells - first]
                for k, found, apart in shelf.nearest(ids[fresh], values[fresh], seen):
                    name = names[fresh[k]]
                    told = int.from_bytes(hashlib.blake2b(name[1], digest_size=8).digest(), "little", signed=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name[0]] * len(found), pa.int64()), pa.array([told] * len(found), pa.int64()),
                         pa.array(found, pa.int64()), pa.array(apart, pa.float64())],
                        ["query_id", "query", "vec_id", "score"],
                    )

    dealt = arrow_map(placed, deal, "shelf int, kind int, vec_id bigint, cell int, mask binary, value binary")
    together = dealt.repartition(index.shelves, "shelf").sortWithinPartitions("shelf", "kind", "vec_id", "value")
    found = arrow_map(together, find, "query_id bigint, query bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEIGHBOURS).select(
        "query_id", "rank", "vec_id", "score"
    )


_NAMES = ["shelf", "kind", "vec_id", "cell", "mask", "value"]
