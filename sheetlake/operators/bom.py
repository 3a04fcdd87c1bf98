"""Bills of material and member intent from drawing text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..plans.scale import block_of, dense_position, keep_when, with_halo


def bom_sequence_rows(lines: DataFrame) -> DataFrame:
    """Runs mark, quantity, description, length (then weight, remarks, grade) as one row each.

    ``lines``: doc_id, ord, text.  Lines get a dense position per document, documents are cut
    into blocks that carry the next seven lines, and each start reads its own seven leads.
    Starts cannot overlap: a start needs a quantity next, which no line inside a row has.
    """
    clean = lines.select("doc_id", "ord", F.trim("text").alias("t")).filter("t <> ''")
    placed = dense_position(clean, ["doc_id"], ["ord"], [block_of("ord")])
    t = F.col("t")
    placed = tx.with_profile_hint(tx.with_length(placed, t, "len"), t).withColumns(
        {
            "head": tx.is_header_line(t),
            "mark": t.rlike(tx.MARK_LINE),
            "qty": t.rlike(tx.QTY_LINE),
            "weigh": t.rlike(tx.WEIGHT_LINE),
        }
    ).withColumn("s", F.struct("t", "len", "head", "mark", "qty", "weigh", "hint"))
    w = Window.partitionBy("doc_id", "_block").orderBy("pos")
    ahead = with_halo(placed.select("doc_id", "ord", "pos", "s"), "pos", after=8).withColumns(
        {f"n{i}": F.lead("s", i).over(w) for i in range(1, 9)}
    ).filter(~F.col("_halo"))
    start = (
        ~F.col("s.head") & F.col("s.mark") & F.col("n1.qty") & F.col("n2.hint").isNotNull()
        & F.col("n3.len").isNotNull()
    )
    rows = ahead.filter(start)

    def pick(offset, shift):
        """The line ``offset`` places on, moved by the optional lines already taken."""
        out = F.when(shift == 0, F.col(f"n{offset}"))
        for k in range(1, 9 - offset):
            out = out.when(shift == k, F.col(f"n{offset + k}"))
        return out

    rows = rows.withColumn("_w", F.coalesce(F.col("n4.weigh"), F.lit(False)).cast("int"))
    rows = rows.withColumn("_c", pick(4, F.col("_w")))
    takes = F.col("_c").isNotNull() & ~F.col("_c.mark") & ~F.col("_c.head")
    rows = rows.withColumn("_r", F.coalesce(takes, F.lit(False)).cast("int"))
    rows = rows.withColumn("_g", pick(4, F.col("_w") + F.col("_r"))).withColumn(
        "_h", pick(5, F.col("_w") + F.col("_r"))
    )
    next_row = F.col("_g.mark") & F.coalesce(F.col("_h.qty"), F.lit(False))
    grade = F.col("_g").isNotNull() & ~next_row & ~F.col("_g.head")
    return rows.select(
        "doc_id", F.col("pos").alias("line_start"), F.col("s.t").alias("piece_mark"),
        F.col("n1.t").try_cast("long").alias("quantity"), F.col("n2.t").alias("description"),
        F.col("n2.hint").alias("profile_hint"), tx.part_kind(F.col("n2.hint")).alias("kind"),
        F.round("n3.len", 4).alias("length_in"),
        F.when(F.col("_w") == 1, F.col("n4.t").try_cast("double")).alias("total_weight"),
        F.when(F.col("_r") == 1, F.col("_c.t")).alias("remarks"),
        F.when(grade, F.col("_g.t")).alias("grade"),
    )


def bom_line_rows(texts: DataFrame, sequences: DataFrame) -> DataFrame:
    """Fallback rows for documents without sequence rows: the first line of every mark."""
    t = F.trim("text")
    rest = texts.join(sequences.select("doc_id").distinct(), "doc_id", "left_anti").withColumn(
        "text", t
    ).filter("text <> ''")
    facts = tx.with_profile_hint(
        tx.with_length(rest, F.col("text"), "length_in"), F.col("text"), "profile"
    ).withColumn("piece_mark", F.coalesce(tx.group(F.col("text"), tx.PIECE_MARK), F.col("profile")))
    first = keep_when(facts, F.col("piece_mark").isNotNull()).groupBy("doc_id", F.lower("piece_mark").alias("key")).agg(
        F.min_by(
            F.struct("piece_mark", tx.row_quantity(F.col("text")).alias("quantity"), "profile",
                     "length_in", "page"),
            "ord",
        ).alias("r")
    )
    return first.select(
        "doc_id", "r.piece_mark", "r.quantity", F.col("r.profile").alias("profile_hint"),
        F.when(F.col("r.profile").isNotNull(), tx.part_kind(F.col("r.profile"))).alias("kind"),
        F.round("r.length_in", 4).alias("length_in"), "r.page",
    )


def member_intent(texts: DataFrame) -> DataFrame:
    """Plate callouts and section designations per document: repeats, first length and mark."""
    t = F.col("text")
    base = tx.with_length(texts.select("doc_id", "ord", "text"), t, "length_in").withColumns(
        {
            "mark": tx.group(t, tx.PIECE_MARK),
            "plates": F.regexp_extract_all(t, F.lit(tx.PLATE), F.lit(0)),
            "members": F.regexp_extract_all(t, F.lit(tx.MEMBER), F.lit(0)),
        }
    )
    m = F.col("m")
    plates = base.select("doc_id", "ord", "length_in", "mark", F.posexplode("plates").alias("i", "m"))
    plates = plates.withColumns(
        {"_t": tx.group(m, tx.PLATE, 1), "_w": tx.group(m, tx.PLATE, 2),
         "_l": F.coalesce(tx.group(m, tx.PLATE, 3), F.lit(""))}
    )
    plates = tx.with_length(plates, F.col("_l"), "_own").withColumns(
        {"thickness_in": F.round(tx.parse_inches(F.col("_t")), 6),
         "width_in": F.round(tx.parse_inches(F.col("_w")), 6)}
    )
    fits = F.col("thickness_in").between(0.01, 12.0)
    own = F.when(F.col("_own") != 0, F.col("_own"))
    rows = plates.select(
        "doc_id", F.struct("ord", F.lit(0).alias("k"), "i").alias("at"), F.lit("plate").alias("kind"),
        F.when(fits, tx.squeeze(m)).alias("key"), F.lit(None).cast("string").alias("family"),
        "thickness_in", "width_in", F.coalesce(own, F.col("length_in")).alias("length_in"), "mark",
    )
    members = base.select("doc_id", "ord", "length_in", "mark", F.posexplode("members").alias("i", "m"))
    fam = F.coalesce(*[tx.group(m, tx.MEMBER, k) for k in (1, 4, 8, 12)])
    rows = rows.unionByName(
        members.select(
            "doc_id", F.struct("ord", F.lit(1).alias("k"), "i").alias("at"), F.lit("member").alias("kind"),
            tx.member_designation(m).alias("key"), fam.alias("family"),
            F.lit(None).cast("double").alias("thickness_in"), F.lit(None).cast("double").alias("width_in"),
            "length_in", "mark",
        )
    )
    return rows.groupBy("doc_id", "kind", "key").agg(
        F.count(F.lit(1)).alias("count"),
        F.min_by(F.struct("family", "thickness_in", "width_in", "length_in", "mark"), "at").alias("f"),
    ).filter("key is not null").select("doc_id", "kind", "key", "count", "f.*")


def normalized_designation(designation):
    return F.upper(F.regexp_replace(F.coalesce(designation, F.lit("")), r"\s+", ""))


def catalog_lookup(rows: DataFrame, column: str, catalog: DataFrame) -> DataFrame:
    """Rows with the dimensions of their designation; ``X`` may be written ``x`` in the catalog.

    ``catalog``: designation, family, d, bf, tw, tf.  The optimizer broadcasts it when its size
    allows, otherwise both sides shuffle.
    """
    dims = [c for c in catalog.columns if c != "designation"]
    found = F.struct(*dims).alias("dims")
    direct = catalog.select(F.col("designation").alias("_key"), found)
    folded = catalog.select(F.col("designation").alias("_alt"), F.struct(*dims).alias("dims2"))
    key = normalized_designation(F.col(column))
    keyed = rows.withColumns({"_key": key, "_alt": F.replace(key, F.lit("X"), F.lit("x"))})
    both = keyed.join(direct, "_key", "left").join(folded, "_alt", "left")
    hit = F.coalesce("dims", "dims2")
    return both.select(
        *rows.columns, hit.isNotNull().alias("profile_found"), *[hit[d].alias(f"p_{d}") for d in dims]
    )


def member_plan(members: DataFrame, catalog: DataFrame, default_length: float = 12.0) -> DataFrame:
    """Members with their profile, an assumed length where none is given, and a skip reason."""
    m = members.filter("kind = 'member'")
    return catalog_lookup(m, "key", catalog).withColumns(
        {
            "length_assumed": F.col("length_in").isNull(),
            "length_in": F.coalesce("length_in", F.lit(default_length)),
            "skip_reason": F.when(~F.col("profile_found"), "designation not in catalog"),
        }
    )
