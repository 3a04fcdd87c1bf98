"""Exact dedup: a Bloom filter of cells met twice decides which hashes may repeat; only those meet by digest.

Texts are read and hashed once; their digests are written, and both passes read those.  Pass one turns
every digest into ``PROBES`` cells of a bit table, counts the cells (two folded cell rows a document
shuffle for that), and keeps a bit for each cell met more than once.  In pass two a row with a probe on
a clear bit has no copy and passes straight through; the others meet by their digest.  The bit table is
broadcast: it has at most ``MAX_BITS`` bits (128 MB), whatever the input.  Beyond a few hundred million
rows it fills up and more rows take the shuffle; the result stays exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.tables import stored
from sheetlake.plans.scale import spread_join

PROBES = 2
BITS_PER_ROW = 16
MIN_BITS, MAX_BITS = 1 << 20, 1 << 30
#: Bits in a block of the table: what bitmap_construct_agg holds.
BLOCK_BITS = 32768


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def table_bits(rows: int) -> int:
    """Size of the bit table: a power of two, BITS_PER_ROW a row, within MIN_BITS and MAX_BITS."""
    bits = MIN_BITS
    while bits < min(rows * BITS_PER_ROW, MAX_BITS):
        bits *= 2
    return bits


def cells(digest: Column, bits: int) -> list[Column]:
    """The cells of a hex digest: independent slices of it."""
    return [
        F.pmod(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("long"), F.lit(bits))
        for k in range(PROBES)
    ]


def repeated_cells(digests: DataFrame, bits: int) -> DataFrame:
    """The bit table as rows (block, bitmap): bits of the cells met more than once."""
    probes = [F.struct(F.lit(k).alias("k"), c.alias("cell")) for k, c in enumerate(cells(F.col("text_sha256"), bits))]
    met = digests.select(F.inline(F.array(*probes)))
    often = met.groupBy("k", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return often.groupBy("k", F.floor(F.col("cell") / BLOCK_BITS).cast("int").alias("block")).agg(
        F.bitmap_construct_agg(F.col("cell") % BLOCK_BITS).alias("bitmap")
    )


def bit_set(bitmap: Column, cell: Column) -> Column:
    """Whether the bit of a cell is set in the bitmap of its block."""
    inside = F.pmod(cell, F.lit(BLOCK_BITS))
    byte = F.conv(F.hex(F.substring(bitmap, (inside / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (inside % 8).cast("int")) == 1


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): which row of its equals stays.

    Texts are equal when identical after ``normalised``; the smallest doc_id stays.  Returns doc_id,
    keep_id, group_size, kept, text_sha256.  Null text counts as empty text.  Repeated rows count as
    members of the group; if several rows share the smallest doc_id, all of them have kept = true.  Rows
    without doc_id come back with their group, and are kept only if no row of the group has a doc_id.
    An empty table gives no rows.  Other columns are ignored.
    """
    # Read by the bit table and three times below: a row of it is a tenth of a document, or less.
    digests = stored(docs.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256")))
    bits = table_bits(digests.count())
    table = repeated_cells(digests, bits)
    tested = digests
    for k, cell in enumerate(cells(F.col("text_sha256"), bits)):
        # proven bound: MAX_BITS / 8 bytes over all blocks of a probe
        part = F.broadcast(
            table.where(F.col("k") == k).select(F.col("block").alias("_block"), F.col("bitmap").alias(f"_bits{k}"))
        )
        tested = tested.join(part, F.floor(cell / BLOCK_BITS).cast("int") == F.col("_block"), "left").drop("_block")
    sure = F.lit(True)
    for k, cell in enumerate(cells(F.col("text_sha256"), bits)):
        sure = sure & F.coalesce(bit_set(F.col(f"_bits{k}"), cell), F.lit(False))
    tested = tested.select("doc_id", "text_sha256", sure.alias("_maybe"))
    alone = tested.where(~F.col("_maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256"
    )
    maybe = tested.where("_maybe").select("doc_id", "text_sha256")
    groups = maybe.groupBy("text_sha256").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    met = spread_join(maybe, groups, ["text_sha256"], "doc_id", salts=8).select(
        "doc_id", "keep_id", "group_size", "text_sha256"
    )
    return alone.unionByName(met).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_marked(docs: DataFrame, gone: DataFrame, mark: Column) -> DataFrame:
    """The rows of ``docs`` whose doc_id and ``mark`` are no row of ``gone`` (doc_id, mark); all columns as they were.

    A bit table of the doc_ids of ``gone`` is broadcast, as large as that of ``exact_duplicates`` at most.
    Rows on a clear bit stay where they are; the others, few where few are dropped, meet ``gone`` itself.
    """
    gone = stored(gone.select("doc_id", "mark").distinct())
    bits = table_bits(docs.count())

    def cell(doc_id: str) -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(bits))

    table = gone.groupBy(F.floor(cell("doc_id") / BLOCK_BITS).cast("int").alias("_block")).agg(
        F.bitmap_construct_agg(cell("doc_id") % BLOCK_BITS).alias("_bits")
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # proven bound: MAX_BITS / 8 bytes
    tested = rows.join(F.broadcast(table), F.floor(cell("row.doc_id") / BLOCK_BITS).cast("int") == F.col("_block"), "left")
    tested = tested.select("row", F.coalesce(bit_set(F.col("_bits"), cell("row.doc_id")), F.lit(False)).alias("_maybe"))
    maybe = tested.where("_maybe").select("row", mark.alias("row_mark"))
    hit = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("row_mark") == F.col("mark"))
    return tested.where(~F.col("_maybe")).select("row.*").unionByName(maybe.join(gone, hit, "left_anti").select("row.*"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text no row with a smaller doc_id has, all columns as they were.

    All rows are dealt by doc_id and text, so what is left is in even parts for the tasks that read it.
    """
    found = exact_duplicates(docs).where(~F.col("kept")).select("doc_id", "text_sha256").distinct()
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.sha2(normalised(F.col("text")), 256).alias("sha")
    )
    hit = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("text_sha256"))
    return marked.join(found, hit, "left_anti").select("row.*")
