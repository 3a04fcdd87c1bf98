"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Two sets of sizes m and n are similar enough only if they share ``needed(m, n)`` n-grams.  With all
n-grams in one order, by the number of sets that hold them and rarest first, such sets meet within the
first ``head`` n-grams of each: this block of the matrix is multiplied first.  Passages that many
documents share come last, so that they make no pairs.  A pair that meets at places where it can't share
enough before and after is not written; counts of the others are added up, pairs that can't reach the
size-derived bound with all that is left are discarded, and the remaining blocks of the product are taken
for the surviving pairs alone.

Only components are asked for, so the product is taken in rounds: first of every document with the most
central document of each n-gram, then, once linked documents are one component, of what is left between
components.  A group of near copies costs rows in proportion to its size, and no link between components
is lost.  Documents with equal sets are one row of the matrix throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.components import components
from sheetlake.llm.exact_dedup import drop_marked
from sheetlake.llm.tables import arrow_map, bit_filter, may_hold, release, stored
from sheetlake.llm.words import BLANKS, TextRun, byte_table, mix, ngrams, text_runs

SHINGLE = 5
#: Least similarity, in hundredths.
LEAST = 75
#: n-grams a task folds before it hands them on, and about as many as are counted at once.
STRETCH = 1 << 21
#: Least number of parts, as a power of two, that n-grams are dealt to for counting.
PARTS = 12
#: n-grams in fewer sets than this are equal in the order.  It changes the work, not the result.
OFTEN = 2
#: Rounds with central documents: one, and up to MORE while the rest would meet over SPARE pairs a row and
#: the round before has halved them.
ROUNDS, MORE, SPARE = 1, 4, 32
#: Sketch of a set: whether the number of its n-grams is odd, in each of 1,024 hash cells.
SKETCH = [f"b{i}" for i in range(16)]
_TABLE = byte_table(BLANKS, lower=True)
U = np.uint64


def sets_of(run: TextRun) -> list[np.ndarray]:
    """The distinct n-gram hashes of every row, sorted; a shorter row is one n-gram, an empty one none."""
    hashes = run.word_hashes()
    grams = ngrams(hashes, SHINGLE)
    out = []
    for a, b in zip(run.first[:-1], run.first[1:], strict=True):
        n = b - a
        if n >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif n:
            out.append(mix(ngrams(hashes[a:b], int(n)) + U(n)))
        else:
            out.append(hashes[:0])
    return out


def digest(grams: np.ndarray) -> np.int64:
    """Identity of a set: documents with equal sets have it in common."""
    return mix(np.array([mix(grams).sum(dtype=U) + U(len(grams))], U)).view(np.int64)[0]


def head(n: Column | int) -> Column | int:
    """How many n-grams of a set of n are in the first block."""
    if isinstance(n, int):
        return n - -(-LEAST * n // 100) + 1
    return n - F.ceil(n * LEAST / 100).cast("int") + 1


def needed(m: Column, n: Column) -> Column:
    """Least number of shared n-grams of sets of m and n: 100 shared >= 75 (m + n - shared)."""
    return F.ceil((m + n) * LEAST / (100 + LEAST))


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of a set's n-grams over hash cells, as 64-bit numbers.

    Two sets differ in at least as many n-grams as their sketches differ in bits.
    """
    odd = np.bincount((grams >> U(54)).astype(np.int64), minlength=64 * len(SKETCH)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def near_sketches(m: Column, n: Column, a: str, b: str) -> Column:
    """May sets of m and n with the sketches in the structs a and b be similar."""
    differ = sum((F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))) for k in SKETCH), F.lit(0))
    return differ + 2 * needed(m, n) <= m + n


def classes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, cls, n, sketch columns): the set every row has; ``mark`` tells texts of one doc_id apart."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in text_runs(batches, _TABLE):
            sets = sets_of(run)
            sketches = np.array([sketch(s) for s in sets], np.int64).reshape(len(sets), len(SKETCH))
            yield pa.record_batch(
                [run.rows.column(0), run.rows.column(2), pa.array([digest(s) for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int32()), *[pa.array(c) for c in sketches.T.copy()]],
                names=["doc_id", "mark", "cls", "n", *SKETCH],
            )

    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    schema = ", ".join(["doc_id long, mark long, cls long, n int", *[f"{k} long" for k in SKETCH]])
    return arrow_map(marked, emit, schema)


def sets_chosen(maybe, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.int64, np.ndarray]]:
    """(cls, set) of the rows (text, key) whose key passes a bit filter; empty sets are passed over."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):  # a filter copies its texts
            part = batch.slice(at, 1024)
            on = may_hold(maybe.value, part.column(1).to_numpy(zero_copy_only=False))
            for run in text_runs([part.filter(pa.array(on))], _TABLE):
                for s in sets_of(run):
                    if len(s):
                        yield digest(s), s


def keyed(docs: DataFrame) -> DataFrame:
    """(text, key): the key says which rows speak for a set."""
    return docs.select("text", F.xxhash64("doc_id", F.xxhash64("text")).alias("key"))


def _numbers(column: pa.Array, kind) -> np.ndarray:
    """All numbers in a column of byte strings, one after the other."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)


def _strings(numbers: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Numbers as byte strings that start at ``cuts``; the last cut is the end."""
    offsets = (cuts * numbers.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(numbers)])


def frequencies(docs: DataFrame, speaking, total: int) -> DataFrame:
    """(gram, df) of the n-grams that more than one set holds; ``total``: about how many n-grams there are.

    n-grams travel as sorted byte strings, a range of hashes each; ranges are as many as keep one small,
    and a task counts one after the other as they come in order.
    """
    shift = U(64 - max(PARTS, (max(total, 1) // STRETCH).bit_length()))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0

        def folded() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate([*held.values(), np.zeros(0, U)]), return_counts=True)
            part = grams >> shift
            first = np.flatnonzero(np.diff(part, prepend=~part[:1]))
            cuts = np.append(first, len(grams))
            return pa.record_batch(
                [pa.array(part[first].view(np.int64)), _strings(grams, cuts), _strings(n.astype(np.uint32), cuts)],
                names=["part", "grams", "n"],
            )

        for key, s in sets_chosen(speaking, batches):
            if key not in held:
                held[key] = s
                size += len(s)
            if size >= STRETCH:
                yield folded()
                held, size = {}, 0
        if held:
            yield folded()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shared(grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(grams)
            grams, n = grams[order], n[order].astype(np.int64)
            first = np.flatnonzero(np.diff(grams, prepend=~grams[:1]))
            df = np.add.reduceat(n, first) if len(first) else n
            often = df > 1
            return pa.record_batch([pa.array(grams[first][often].view(np.int64)), pa.array(df[often])], names=["gram", "df"])

        grams, n = np.zeros(0, U), np.zeros(0, np.uint32)
        for batch in batches:
            if not batch.num_rows:
                continue
            grams = np.concatenate([grams, _numbers(batch.column(1), U)])
            n = np.concatenate([n, _numbers(batch.column(2), np.uint32)])
            open_ = grams >> shift == U(batch.column(0)[-1].as_py())  # the next batch may have more of this part
            yield shared(grams[~open_], n[~open_])
            grams, n = grams[open_], n[open_]
        yield shared(grams, n)

    parts = arrow_map(keyed(docs), emit, "part long, grams binary, n binary")
    return arrow_map(parts.repartition("part").sortWithinPartitions("part"), count, "gram long, df long")


def candidates(docs: DataFrame, speaking, maybe) -> DataFrame:
    """Shared n-grams (gram, cls, n) of the sets whose first block may hold one; ``maybe``: a filter on n-grams."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            n = [len(g) for g in grams]
            return pa.record_batch(
                [pa.array(np.concatenate(grams)), pa.array(np.repeat(np.array(classes, np.int64), n)),
                 pa.array(np.repeat(np.array(sizes, np.int32), n))],
                names=["gram", "cls", "n"],
            )

        grams, classes, sizes, held = [], [], [], 0
        for key, s in sets_chosen(speaking, batches):
            own = s.view(np.int64)
            own = own[may_hold(maybe.value, own)]
            if len(s) - len(own) >= head(len(s)):
                continue  # n-grams that no other set holds come first and fill the block
            grams.append(own)
            classes.append(key)
            sizes.append(len(s))
            held += len(own)
            if held >= STRETCH // 8:
                yield rows()
                grams, classes, sizes, held = [], [], [], 0
        if grams:
            yield rows()

    return arrow_map(keyed(docs), emit, "gram long, cls long, n int")


def least_met(m: Column, n: Column) -> Column:
    """Least count in the first block of similar sets of m and n: what the rest can't make up for."""
    return needed(m, n) - F.greatest(m - head(m), n - head(n))


def first_block(docs: DataFrame, speakers: DataFrame, total: int) -> DataFrame:
    """The first block of the matrix as rows (gram, cls, n, pos, k), without n-grams of one set alone.

    ``pos``: place in the set, rarest n-gram first; ``k``: how many rows of the block the set has.
    """
    speaking = bit_filter(speakers.select("key"))
    known = stored(frequencies(docs, speaking, total))
    maybe = bit_filter(known.select(F.col("gram").alias("key")))
    rank = F.when(F.col("df") >= OFTEN, F.col("df")).otherwise(0)
    rows = candidates(docs, speaking, maybe).join(known, "gram").select("cls", "n", F.struct(rank.alias("df"), "gram").alias("own"))
    sets = rows.groupBy("cls").agg(F.max("n").alias("n"), F.sort_array(F.collect_set("own")).alias("own"))
    alone = F.col("n") - F.size("own")
    sets = sets.select("cls", "n", "own", alone.alias("alone"), (head(F.col("n")) - alone).alias("k")).where("k > 0")
    block = sets.select("cls", "n", "alone", "k", F.posexplode(F.slice("own", F.lit(1), F.col("k"))).alias("at", "gram"))
    block = stored(block.select("gram.gram", "cls", "n", (F.col("alone") + F.col("at")).alias("pos"), "k"))
    release(known)
    for table in (speaking, maybe):
        table.unpersist()
    return block


def shared_columns(docs: DataFrame, speakers: DataFrame, total: int) -> DataFrame:
    """Rows of the first block whose n-gram occurs there in more than one set.

    A row is left out when its set meets others in too few n-grams for any size its column holds; the
    bound is weakest for the smallest and for the largest size that is near enough.
    """
    block = first_block(docs, speakers, total)
    shared = block.groupBy("gram").agg(
        F.min("cls").alias("low"), F.max("cls").alias("high"), F.min("n").alias("least"), F.max("n").alias("most")
    ).where("low < high").select("gram", "least", "most")
    n = F.col("n")
    small = F.greatest("least", F.ceil(n * LEAST / 100)).cast("int")
    large = F.least("most", F.floor(n * 100 / LEAST)).cast("int")
    # rounding up may put a size between the two one below them
    enough = F.col("k") >= F.least(least_met(small, n), least_met(large, n)) - 1
    rows = block.join(shared, "gram").where(enough)
    rows = stored(rows.select("gram", "cls", "n", "pos", (F.col("k") / head(n)).alias("share")))
    release(block)
    return rows


def speakers_of(classes: DataFrame) -> DataFrame:
    """(cls, key, sketch columns): the row that stands for each set, by a hash of its doc_id and text."""
    kept = [F.max(k).alias(k) for k in SKETCH]  # one value in all rows of a set
    return classes.where("n > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "mark")).alias("at"), *kept).select(
        "cls", F.xxhash64("at.doc_id", "at.mark").alias("key"), *SKETCH
    )


def in_reach(m: Column, n: Column, i: Column, j: Column) -> Column:
    """May similar sets of m and n share the n-gram at places i and j: enough of both before and after it."""
    return F.least(i, j) + 1 + F.least(m - 1 - i, n - 1 - j) >= needed(m, n)


def similar(docs: DataFrame, speakers: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (x, y) of sets that are similar enough, by the remaining blocks of the product."""
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct()
    maybe = bit_filter(wanted.join(speakers, "cls").select("key"))
    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(at, 1024) for batch in batches for at in range(0, batch.num_rows, 1024)):
            on = may_hold(maybe.value, part.column(1).to_numpy(zero_copy_only=False))
            for run in text_runs([part.filter(pa.array(on))], _TABLE):
                keys = pa.array([digest(s) for s in sets_of(run)], pa.int64())
                yield pa.record_batch([keys, run.rows.column(0)], names=["cls", "text"])

    texts = stored(arrow_map(keyed(docs), chosen, "cls long, text string"))
    maybe.unpersist()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                left, right = (
                    [s for run in text_runs([part], _TABLE, text=c) for s in sets_of(run)] for c in ("tx", "ty")
                )
                on = []
                for a, b in zip(left, right, strict=True):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    on.append(100 * both >= LEAST * (len(a) + len(b) - both))
                yield part.select(["x", "y"]).filter(pa.array(on, pa.bool_()))

    met = pairs.join(texts.select(F.col("cls").alias("y"), F.col("text").alias("ty")), "y").join(
        texts.select(F.col("cls").alias("x"), F.col("text").alias("tx")), "x"
    )
    links = stored(arrow_map(met.select("x", "y", "tx", "ty"), compare, "x long, y long"))
    release(texts)
    return links


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs with the smaller end first, if their sizes and places allow enough similarity."""
    fits = 100 * F.least("nx", "ny") >= LEAST * F.greatest("nx", "ny")
    fits = fits & in_reach(F.col("nx"), F.col("ny"), F.col("px"), F.col("py"))
    return pairs.where((F.col("a") != F.col("b")) & fits).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))


def link_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, root): components of the sets that are linked with another one."""
    speakers = stored(speakers_of(classes))
    block = shared_columns(docs, speakers, classes.agg(F.sum("n")).first()[0] or 0)
    links = tested = roots = product = last = None
    for turn in range(MORE + 1):
        left = block.withColumns({"root": F.col("cls"), "apart": F.lit(True)})
        if roots is not None:
            left = block.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
                "root", F.coalesce("root", "cls")
            )
            shares = left.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("k"))
            columns = shares.groupBy("gram").agg(
                F.sum("k").alias("m"), F.max("k").alias("most"), F.max_by("root", F.struct("k", "root")).alias("major"),
                F.count(F.lit(1)).alias("roots"),
            ).where("roots > 1")
            left = left.join(columns.select("gram", "major", (F.col("m") - F.col("most")).alias("minor")), "gram")
            left = stored(left.select(*block.columns, "root", "minor", (F.col("root") != F.col("major")).alias("apart")))
            last, (rows, product) = product, left.agg(F.count(F.lit(1)), F.sum("minor")).first()
            if not rows:
                break
        rest = turn == MORE or turn >= ROUNDS and (product is None or product <= SPARE * rows)
        rest = rest or last is not None and 2 * product > last
        if rest:
            # Of a column's components the largest needs no pairs within: every pair has an end apart from it.
            seen = left.join(speakers.select("cls", *SKETCH), "cls").withColumn("sketch", F.struct(*SKETCH))
            met = seen.select(
                "gram", F.struct("cls", "n", "pos").alias("a"), F.col("root").alias("ra"), "apart", F.col("sketch").alias("sa")
            )
            other = seen.where("apart").select(
                "gram", F.struct("cls", "n", "pos").alias("b"), F.col("root").alias("rb"), F.col("sketch").alias("sb")
            )
            fits = 100 * F.least("a.n", "b.n") >= LEAST * F.greatest("a.n", "b.n")
            fits = fits & in_reach(F.col("a.n"), F.col("b.n"), F.col("a.pos"), F.col("b.pos"))
            fits = fits & near_sketches(F.col("a.n"), F.col("b.n"), "sa", "sb")
            once = ~F.col("apart") | (F.col("a.cls") < F.col("b.cls"))
            ends = met.join(other, "gram").where(once & (F.col("ra") != F.col("rb")) & fits).select(
                F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")
            )
            counts = ends.groupBy("x.cls", "y.cls", F.col("x.n").alias("nx"), F.col("y.n").alias("ny")).agg(
                F.count(F.lit(1)).alias("count"), F.max("x.pos").alias("px"), F.max("y.pos").alias("py")
            ).toDF("x", "y", "nx", "ny", "count", "px", "py")
            # what is shared beyond the last n-gram met comes after it in both sets
            beyond = F.least(F.col("nx") - 1 - F.col("px"), F.col("ny") - 1 - F.col("py"))
            pairs = counts.where(F.col("count") + beyond >= needed(F.col("nx"), F.col("ny"))).select("x", "y")
        else:
            order = F.struct("share", "cls") if turn == 0 else F.struct(F.xxhash64("root", F.lit(turn)), "share", "cls")
            middle = left.groupBy("gram").agg(F.max_by(F.struct("cls", "n", "pos", "root"), order).alias("mid"))
            met = left.join(middle, "gram").where(F.col("root") != F.col("mid.root"))
            pairs = _ordered(met.select(
                F.col("cls").alias("a"), F.col("n").alias("nx"), F.col("pos").alias("px"),
                F.col("mid.cls").alias("b"), F.col("mid.n").alias("ny"), F.col("mid.pos").alias("py"),
            )).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti")
        pairs = stored(pairs)
        found = similar(docs, speakers, pairs)
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        roots = components(links)
        if rest:
            break
    return roots


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Two rows link when the Jaccard similarity of their sets of 5-word n-grams (A-Z lowered, words are
    runs without ASCII white space) is 0.75 or more; component_id is the smallest doc_id reachable.  A
    text of fewer than five words is one n-gram; a null, empty or blank text has none and links with
    nothing.  Repeated rows come back as often as they were there; rows without doc_id get the smallest
    doc_id of their component, or null.  An empty table gives no rows.
    """
    return marked_components(docs).drop("mark")


def marked_components(docs: DataFrame, salts: int = 8) -> DataFrame:
    """``ngram_components`` with ``mark``, a hash of the text, which tells texts of one doc_id apart."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    classes = stored(classes_of(docs))
    roots = link_classes(docs, classes)
    rooted = classes.where("n > 0").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select(
        "doc_id", "mark", "n", F.coalesce("root", "cls").alias("root")
    )
    many = rooted.groupBy("root").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("m")).where("m > 1")
    salted = many.select("root", "low", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    out = rooted.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(
        salted, ["root", "salt"], "left"
    )
    empty = classes.where("n = 0")
    return out.select(
        "doc_id", "mark", F.col("n").cast("long").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id")
    ).unionByName(empty.select("doc_id", "mark", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their component, all columns as they were.

    Of several rows with one doc_id each is judged by its own text.  Rows without doc_id, and null or empty
    texts, stay; so do repeated rows of the document that stays.  An empty table gives no rows.
    """
    gone = marked_components(docs).where("doc_id <> component_id")
    return drop_marked(docs, gone, F.xxhash64("row.text"))
