"""Centroid clustering on dictionaries of subvectors, in exact integer arithmetic.

Vectors are cut into blocks of ``BLOCK`` dimensions.  Each run of rows keeps, for every block, a
dictionary of the distinct subvectors it holds and one code a row: a lossless encoding, made once and
written to the shared folder.  A round computes the distance of every dictionary entry to every
centroid's block once, adds up the entries' distances by code, and sums the members of a cluster as
counts of codes times entries.  Dictionaries stay with their rows, so rounds shuffle nothing but a few
sums a task; a vector met often is one entry with many codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.tables import arrow_map, stored
from sheetlake.llm.vectors import matrix

WIDTH, BLOCK, CLUSTERS, ROUNDS, SCALE = 64, 2, 8, 10, 1024
#: Largest component: the squared distance of two vectors then fits a long.
LARGEST = 1 << 27
#: Below this size products of blocks are exact in doubles as well.
_EXACT = 1 << 22
#: Rows that share dictionaries.
RUN = 16_384


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of every component; too large ones are an error."""
    scaled = np.floor(values * SCALE)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} have squared distances that no long can hold")
    return scaled.astype(np.int32)


@dataclass
class Run:
    """Some rows: per block, its distinct subvectors and the rows' codes."""

    entries: list[np.ndarray]
    codes: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Run:
        entries, codes = [], []
        for at in range(0, rows.shape[1], BLOCK):
            part = np.ascontiguousarray(rows[:, at : at + BLOCK])
            keys = part.view(np.dtype((np.void, part.shape[1] * 4))).ravel()
            _, first, code = np.unique(keys, return_index=True, return_inverse=True)
            entries.append(part[first])
            codes.append(code.ravel().astype(np.uint16))
        return cls(entries, np.array(codes))

    @classmethod
    def read(cls, row: dict) -> Run:
        flat, at, entries = np.frombuffer(row["entries"], np.int32), 0, []
        for k, size in enumerate(row["sizes"]):
            wide = min(BLOCK, WIDTH - k * BLOCK)
            entries.append(flat[at : at + size * wide].reshape(size, wide))
            at += size * wide
        return cls(entries, np.frombuffer(row["codes"], np.uint16).reshape(len(entries), -1))

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distance of every row to every centroid: entries first, then summed by code."""
        total = np.zeros((self.codes.shape[1], len(centroids)), np.int64)
        most = max((int(np.abs(e).max()) for e in [*self.entries, centroids] if e.size), default=0)
        kind = np.float64 if most <= _EXACT else np.int64
        for k, (entry, code) in enumerate(zip(self.entries, self.codes, strict=True)):
            e, c = entry.astype(kind), centroids[:, k * BLOCK : k * BLOCK + BLOCK].astype(kind)
            apart = (e * e).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (e @ c.T)
            total += apart.astype(np.int64)[code]
        return total

    def sums(self, cluster: np.ndarray, clusters: int) -> np.ndarray:
        """Sum of the rows of each cluster: how often a cluster has each code, times the entries."""
        out = []
        for entry, code in zip(self.entries, self.codes, strict=True):
            often = np.bincount(cluster * len(entry) + code, minlength=clusters * len(entry))
            out.append(often.reshape(clusters, len(entry)) @ entry.astype(np.int64))
        return np.concatenate(out, axis=1)


_RUNS = "vec_ids array<bigint>, sizes array<int>, entries binary, codes binary"


def _encode(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, values = matrix(batch.column("vector"), WIDTH)
        ids = batch.column("vec_id").cast(pa.int64()).take(pa.array(rows))
        whole = integers(values)
        for at in range(0, len(rows), most):
            run = Run.of(whole[at : at + most])
            part = ids.slice(at, most)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part),
                    pa.array([[len(e) for e in run.entries]], pa.list_(pa.int32())),
                    pa.array([b"".join(e.tobytes() for e in run.entries)], pa.binary()),
                    pa.array([run.codes.tobytes()], pa.binary()),
                ],
                ["vec_ids", "sizes", "entries", "codes"],
            )


def _nearest(run: Run, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    apart = run.distances(centroids)
    cluster = apart.argmin(axis=1)  # the first of equals: the smaller number
    return cluster, apart[np.arange(len(apart)), cluster]


@dataclass
class Totals:
    """Sums over all vectors: components and members of each cluster, distances within it."""

    sums: list[list[int]]
    members: list[int]
    inertia: list[int]


def measure(runs: DataFrame, centroids: np.ndarray) -> Totals:
    """Assign all rows and add them up; a task sends one row a cluster and dimension."""
    k = len(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, WIDTH), object)
        members, inertia = np.zeros(k, object), np.zeros(k, object)
        for batch in batches:
            for row in batch.to_pylist():
                run = Run.read(row)
                cluster, apart = _nearest(run, centroids)
                sums += run.sums(cluster, k).astype(object)
                members += np.bincount(cluster, minlength=k).astype(object)
                for half, shift in ((apart >> 32, 32), (apart & 0xFFFFFFFF, 0)):  # no sum leaves 64 bits
                    part = np.zeros(k, np.int64)
                    np.add.at(part, cluster, half)
                    inertia += part.astype(object) * (1 << shift)
        flat = [(c, d, str(int(sums[c, d]))) for c in range(k) for d in range(WIDTH)]
        flat += [(c, WIDTH, str(int(members[c]))) for c in range(k)]
        flat += [(c, WIDTH + 1, str(int(inertia[c]))) for c in range(k)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(x), t) for x, t in zip(zip(*flat, strict=True), (pa.int32(), pa.int32(), pa.string()), strict=True)],
            ["cluster", "dim", "total"],
        )

    told = arrow_map(runs, add, "cluster int, dim int, total string").groupBy("cluster", "dim").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    )
    found = {(r["cluster"], r["dim"]): int(r["total"]) for r in told.collect()}  # k * (WIDTH + 2) numbers
    at = lambda c, d: found.get((c, d), 0)
    return Totals(
        [[at(c, d) for d in range(WIDTH)] for c in range(k)],
        [at(c, WIDTH) for c in range(k)],
        [at(c, WIDTH + 1) for c in range(k)],
    )


def usable(vector: Column) -> Column:
    """Exactly WIDTH components, none null or non-finite."""
    fine = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    )
    return F.coalesce((F.size(vector) == WIDTH) & fine, F.lit(False))


def seeds(rows: DataFrame) -> np.ndarray:
    """The CLUSTERS vectors with the smallest sha256 of `3:<vec_id>`, in that order; ties by components."""
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    name = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.where(usable(F.col("vector"))).select(name.alias("name"), whole.alias("whole"))
    return np.array([r["whole"] for r in first.orderBy("name", "whole").limit(CLUSTERS).collect()], np.int64).reshape(-1, WIDTH)


_RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def cluster_vectors(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row per usable vector: its cluster after ROUNDS rounds, and how far it is from the centroid.

    A vector is usable with exactly WIDTH components, none null or non-finite; others give no row.
    Components become floor(SCALE * x); beyond 131,072 they are an error, since no long holds the
    squared distance.  The first centroids are the vectors with the smallest sha256 of `3:<vec_id>` (a
    null vec_id is hashed as empty; ties by components); fewer vectors give fewer clusters.  Equally near
    centroids: the smaller number.  Every repeated row counts, and comes back.  A cluster without members
    keeps its centroid.  An empty table gives no rows.  Other columns are ignored.
    """
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").alias("vector"))
    centroids = seeds(rows)
    runs = stored(arrow_map(rows, partial(_encode, most=RUN), _RUNS))
    for _ in range(ROUNDS if len(centroids) else 0):
        told = measure(runs, centroids)
        centroids = np.array(
            [[s // n for s in told.sums[c]] if (n := told.members[c]) else centroids[c] for c in range(len(centroids))],
            np.int64,
        )
    last = measure(runs, centroids) if len(centroids) else Totals([], [], [])
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    whole = sum(last.inertia)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids = row.column("vec_ids").flatten()
                cluster, apart = _nearest(Run.read(row.drop_columns(["vec_ids"]).to_pylist()[0]), centroids)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(cluster, pa.int32()), pa.array(apart, pa.int64()),
                        pa.array(np.array(last.inertia, np.int64)[cluster]), pa.array(np.full(len(cluster), whole, np.int64)),
                        pa.array(names, pa.string()).take(pa.array(cluster)),
                    ],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return arrow_map(runs, tell, _RESULT)
