"""Substring dedup by difference-cover anchors.

Positions of a document are anchors when they fall, modulo ``PERIOD``, on a difference cover: for any two
positions some shift below the period brings both onto the cover.  An anchor hashes ``ANCHOR`` words.  Two
documents that share a window of ``WINDOW`` words therefore share an aligned anchor inside it, though only
a fifth of the positions is hashed.  Anchors met in two documents are extended: every window around them
is hashed, and of a window's documents all but those with the smallest doc_id lose its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.tables import arrow_map, bit_filter, may_hold, stored
from sheetlake.llm.words import BLANKS, TextRun, byte_table, mix, ngrams, rows_of, text_runs

WINDOW, PERIOD = 50, 31
#: Fixed value: a perfect difference cover of 31; every difference occurs once.
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
_TABLE = byte_table(BLANKS, lower=False)
U = np.uint64
LOW = (1 << 32) - 1


def row_marks(run: TextRun, hashes: np.ndarray) -> np.ndarray:
    """32 bits of each row's word sequence: tells rows of one doc_id with other words apart."""
    counts = np.diff(run.first)
    place = np.arange(len(hashes)) - np.repeat(run.first[:-1], counts)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(mix(hashes + place.astype(U) * U(0x9E3779B97F4A7C15)), out=total[1:])
    return (mix(total[run.first[1:]] - total[run.first[:-1]]) & U(LOW)).astype(np.int64)


def ids_of(run: TextRun, column: str = "doc_id") -> np.ndarray:
    return run.rows.column(column).to_numpy(zero_copy_only=False).astype(np.int64)


def anchors_of(run: TextRun) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and position of every anchor of a run."""
    hashes = run.word_hashes()
    counts = np.diff(run.first)
    grams = ngrams(hashes, ANCHOR)
    each = np.maximum(counts - ANCHOR + 1, 0)
    row = rows_of(each)
    place = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    on = np.isin(place % PERIOD, COVER)
    row, place = row[on], place[on]
    return grams[run.first[row] + place].view(np.int64), row, place


def spans_around(anchors: np.ndarray, n_words: int) -> np.ndarray:
    """Starts of all windows of a row that hold one of its anchors whole."""
    last = n_words - WINDOW
    if last < 0:
        return np.zeros(0, np.int64)
    edge = np.zeros(last + 2, np.int64)
    np.add.at(edge, np.clip(anchors - (WINDOW - ANCHOR), 0, last + 1), 1)
    np.add.at(edge, np.clip(anchors + 1, 0, last + 1), -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def covered(starts: np.ndarray, n_words: int) -> np.ndarray:
    """Which words lie in a window with one of the starts."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + WINDOW, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """Hashes of anchors met in more than one doc_id."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in text_runs(batches, _TABLE):
            anchor, row, _ = anchors_of(run)
            if len(anchor):
                order = np.argsort(anchor, kind="stable")
                anchor, ids = anchor[order], ids_of(run)[row[order]]
                at = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
                low, high = np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at)
                yield pa.record_batch([pa.array(anchor[at]), pa.array(low), pa.array(high)], names=["anchor", "low", "high"])

    rows = arrow_map(docs, emit, "anchor long, low long, high long")
    met = rows.groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return met.where("low < high").select("anchor")


def anchor_places(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Per row with repeated anchors (doc_id, mark): the positions of these."""
    maybe = bit_filter(repeated.select(F.col("anchor").alias("key")))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in text_runs(batches, _TABLE):
            anchor, row, place = anchors_of(run)
            on = may_hold(maybe.value, anchor)
            row, marks = row[on], row_marks(run, run.word_hashes())
            yield pa.record_batch(
                [pa.array(anchor[on]), pa.array(ids_of(run)[row]), pa.array(place[on] << 32 | marks[row])],
                names=["anchor", "doc_id", "at"],
            )

    rows = arrow_map(docs, emit, "anchor long, doc_id long, at long")
    return (
        rows.join(repeated, "anchor")
        .groupBy("doc_id", F.col("at").bitwiseAND(LOW).alias("mark"))
        .agg(F.collect_set(F.shiftrightunsigned("at", 32)).alias("anchors"))  # bounded by the row's words
    )


def with_kept_text(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every row as (doc_id, mark, n_words, text); text only where the row may have a repeated anchor."""
    maybe = bit_filter(candidates.select(F.col("doc_id").alias("key")))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in text_runs(batches, _TABLE):
            ids, marks = ids_of(run), row_marks(run, run.word_hashes())
            on = may_hold(maybe.value, ids)
            rows, digests, texts = run.rows.column("text"), [], []
            for k, text in enumerate(rows):
                if on[k]:
                    texts.append(text.as_py())
                    digests.append(None)
                else:
                    texts.append(None)
                    digests.append(hashlib.sha256(b" ".join((text.as_py() or "").encode().split())).hexdigest())
            yield pa.record_batch(
                [pa.array(ids), pa.array(marks), pa.array(np.diff(run.first)), pa.array(texts, pa.string()),
                 pa.array(digests, pa.string()), pa.array(on)],
                names=["doc_id", "mark", "n_words", "text", "whole_sha256", "candidate"],
            )

    schema = "doc_id long, mark long, n_words long, text string, whole_sha256 string, candidate boolean"
    return arrow_map(docs, emit, schema)


def _windows(run: TextRun) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, row and start of every window around the anchors of a run."""
    hashes = run.word_hashes()
    first, second = ngrams(hashes, WINDOW), ngrams(mix(hashes + U(0x632BE59BD9B4E019)), WINDOW)
    rows, starts = [], []
    for k, anchors in enumerate(run.rows.column("anchors")):
        own = spans_around(anchors.values.to_numpy(), int(run.first[k + 1] - run.first[k]))
        rows.append(np.full(len(own), k))
        starts.append(own)
    row, start = np.concatenate(rows), np.concatenate(starts)
    at = run.first[row] + start
    return first[at].view(np.int64), (second[at] >> U(33)).astype(np.int32), row, start


def repeated_windows(rows: DataFrame) -> DataFrame:
    """Windows around anchors that more than one doc_id has: (w1, w2, low), low the smallest doc_id."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in text_runs(batches, _TABLE):
            w1, w2, row, _ = _windows(run)
            if len(w1):
                order = np.lexsort((w2, w1))
                w1, w2, ids = w1[order], w2[order], ids_of(run)[row[order]]
                at = np.flatnonzero(np.concatenate(([True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]))))
                low, high = np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at)
                yield pa.record_batch([pa.array(x) for x in (w1[at], w2[at], low, high)], names=["w1", "w2", "low", "high"])

    met = arrow_map(rows, emit, "w1 long, w2 int, low long, high long")
    owners = met.groupBy("w1", "w2").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return owners.where("low < high").select("w1", "w2", "low")


def windows_around(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Windows that may be among ``repeated``: (w1, w2, doc_id, at) with start and mark in ``at``."""
    maybe = bit_filter(repeated.select(F.col("w1").alias("key")))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in text_runs(batches, _TABLE):
            w1, w2, row, start = _windows(run)
            on = may_hold(maybe.value, w1)
            w1, w2, row, start = w1[on], w2[on], row[on], start[on]
            at = start << 32 | ids_of(run, "mark")[row]
            yield pa.record_batch([pa.array(x) for x in (w1, w2, ids_of(run)[row], at)], names=["w1", "w2", "doc_id", "at"])

    return arrow_map(rows, emit, "w1 long, w2 int, doc_id long, at long")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) without words of windows that a smaller doc_id has too.

    Words are runs without ASCII white space.  Returns doc_id, n_words, n_removed, kept_text (null where
    nothing was removed) and kept_sha256, the digest of the kept words joined by one space.  Windows are
    judged on the input.  Null and empty texts have no words; a text of fewer than 50 words loses nothing;
    rows of equal doc_id don't take words from each other, and repeated rows come back as often as they
    were there.  Rows without doc_id lose nothing and take nothing.  An empty table gives no rows.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known, nameless = named.where("doc_id is not null"), named.where("doc_id is null")
    repeated = stored(repeated_anchors(known))
    places = stored(anchor_places(known, repeated))
    rows = with_kept_text(known, places)
    found = rows.where("candidate").select("doc_id", "mark", "text").join(places, ["doc_id", "mark"])
    owners = stored(repeated_windows(found))
    taken = (
        windows_around(found, owners).join(owners, ["w1", "w2"])
        .where("doc_id > low")
        .groupBy("doc_id", F.col("at").bitwiseAND(LOW).alias("mark"))
        .agg(F.collect_set(F.shiftrightunsigned("at", 32)).alias("starts"))  # bounded by the row's words
    )
    return _cut(rows.join(taken, ["doc_id", "mark"], "left")).unionByName(
        _cut(nameless.select("doc_id", F.lit(0).cast("long").alias("n_words"), "text",
                             F.lit(None).cast("string").alias("whole_sha256"),
                             F.lit(None).cast("array<long>").alias("starts")))
    )


def _cut(rows: DataFrame) -> DataFrame:
    """Take the windows with the given starts out of the texts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, removed, texts, digests = [], [], [], []
                for size, text, digest, starts in zip(*(part.column(k) for k in range(1, 5)), strict=True):
                    lost, kept = 0, None
                    digest, n = digest.as_py(), size.as_py()
                    if digest is None:
                        words = (text.as_py() or "").encode().split()
                        n = len(words)
                        if starts.is_valid:
                            gone = covered(starts.values.to_numpy(), n)
                            lost = int(gone.sum())
                            words = [w for w, g in zip(words, gone, strict=True) if not g]
                            kept = b" ".join(words).decode()
                        digest = hashlib.sha256(b" ".join(words)).hexdigest()
                    sizes.append(n)
                    removed.append(lost)
                    texts.append(kept)
                    digests.append(digest)
                yield pa.record_batch(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(texts, pa.string()), pa.array(digests, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
                )

    return arrow_map(
        rows.select("doc_id", "n_words", "text", "whole_sha256", "starts"), emit,
        "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string",
    )
