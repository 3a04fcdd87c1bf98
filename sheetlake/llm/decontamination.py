"""Benchmark decontamination: Wu-Manber search for the word windows of test items in documents.

Words are the symbols.  For the windows of one length a table says how far the search may skip when it
sees a block of two words: the distance of the block's last occurrence in any window from the window's
end.  A block that ends a window can't be skipped; its bucket lists the windows that end so, and these
are compared with the text directly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.tables import arrow_map, release, stored
from sheetlake.llm.words import NOT_ALNUM, byte_table

WINDOW = 13
#: Bytes of item text that one pass holds in its tables; larger benchmarks take several passes.
PASS_BYTES = 2 << 20
_TABLE = byte_table(NOT_ALNUM, lower=True)
_BYTES = bytes(32 if b == 256 else int(b) for b in _TABLE)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lowered, then the runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, as UTF-8."""
    return (text or "").encode().translate(_BYTES).split()


class WuManber:
    """All windows of one length: skip table by word block, buckets by last block."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], set[int]]):
        self.length = length
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.skip: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[list[bytes], set[int]]]] = defaultdict(list)
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                block = window[end - self.block : end]
                self.skip[block] = min(self.skip.get(block, self.far), length - end)
            self.bucket[block].append((list(window), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """End position (exclusive) and items of every occurrence, from left to right."""
        skip, far, size, length, n = self.skip.get, self.far, self.block, self.length, len(words)
        at = length
        while at <= n:
            block = (words[at - 2], words[at - 1]) if size == 2 else (words[at - 1],)
            step = skip(block, far)
            if step:
                at += step
                continue
            found = words[at - length : at]
            for window, items in self.bucket[block]:
                if window == found:
                    yield at, items
            at += 1


def searchers(items: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[WuManber]:
    """One search per window length; an item shorter than a window is one window of its own."""
    by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
    for number, text in items:
        words = words_of(text)
        if words:
            length = min(window, len(words))
            for at in range(len(words) - length + 1):
                by_length[length][tuple(words[at : at + length])].add(number)
    return [WuManber(length, dict(w)) for length, w in sorted(by_length.items())]


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with touching ones made one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _marked(frame: DataFrame, items: list[tuple[int | None, str | None]], window: int) -> DataFrame:
    shared = frame.sparkSession.sparkContext.broadcast(items)  # at most pass_bytes of text
    text_at = frame.schema["row"].dataType.fieldNames().index("text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = searchers(shared.value, window)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, spans, met = [], [], []
                texts = part.column("row").field(text_at)
                for text, old_spans, old_items in zip(texts, part.column("spans"), part.column("items"), strict=True):
                    words = words_of(text.as_py())
                    hits = [(s["start"], s["end"]) for s in old_spans.as_py() or ()]
                    numbers = set(old_items.as_py() or ())
                    for finder in finders:
                        for end, found in finder.search(words):
                            hits.append((end - finder.length, end))
                            numbers |= found
                    counts.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in joined(hits)])
                    met.append(sorted(x for x in numbers if x is not None))
                yield pa.record_batch(
                    [part.column("row"), pa.array(counts, pa.int64()), pa.array(spans, kind),
                     pa.array(met, pa.list_(pa.int64()))],
                    names=["row", "n_words", "spans", "items"],
                )

    return arrow_map(frame, mark, frame.schema)


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Where windows of ``items`` (item_id, text) occur in the column text of ``docs``.

    Returns one row per row of ``docs``, repeated rows included: ``row``, a struct of all its columns,
    n_words, ``spans`` of hit words (start, end; joined) and ``items`` with an occurring window.  Null and
    empty texts have no words; items without words can't occur; an item without item_id marks words but
    is not listed; equal item_ids count once.  Without items nothing is hit; without documents there are
    no rows.  Every task holds the items of one pass, so items are dealt over as many passes as
    ``pass_bytes`` asks.
    """
    found = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"),
        F.lit(None).cast("array<long>").alias("items"),
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // pass_bytes) or 1
    last = None
    for k in range(passes):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        found = _marked(found, [tuple(r) for r in own.select("item_id", "text").collect()], window)
        if k + 1 < passes:
            found = stored(found)
            if last is not None:
                release(last)
            last = found
    return found


def _judged(found: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated: one word in twenty or more is hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumn("n_hit", hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
    )


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, the digest of the items, and whether it is contaminated."""
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return _judged(find_items(docs.select("doc_id", "text"), items)).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), "contaminated",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows, all columns as they were."""
    return _judged(find_items(docs, items)).where(~F.col("contaminated")).select("row.*")
