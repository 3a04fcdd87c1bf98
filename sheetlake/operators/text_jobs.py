"""Jobs over text items and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..plans.scale import block_of, dense_position, spread_join

PAGE = ["doc_id", "page"]


def with_normalized(texts: DataFrame) -> DataFrame:
    """Texts with ``normalized``, worked out where the column is absent or null."""
    rule = tx.normalize_text(F.col("text"))
    return texts.withColumn("normalized", F.coalesce("normalized", rule) if "normalized" in texts.columns else rule)


def classify_text(texts: DataFrame) -> DataFrame:
    """Texts with their distinct tags."""
    return with_normalized(texts).withColumn("tags", tx.text_tags(F.col("text"), F.col("normalized")))


def text_annotations(texts: DataFrame) -> DataFrame:
    """Per page and font: items, width and height totals, and one count per tag.

    Reads the span sizes nominal_size, raw_size and the text matrix ma, mb, mc, md.
    """
    t, norm = F.col("text"), F.col("normalized")
    size = tx.font_size_effective(
        *[F.col(c) for c in ("nominal_size", "raw_size", "ma", "mb", "mc", "md")]
    )
    ext = tx.glyph_extent(
        F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0"), F.col("rotation")
    )
    return with_normalized(texts).groupBy(*PAGE, "font_name").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum(tx.text_width_units(t)).alias("width_units"),
        F.sum(size).alias("font_size"),
        F.sum(ext["height"]).alias("glyph_height"),
        F.sum(ext["width"]).alias("glyph_width"),
        *[F.sum(tx.tag_flag(tag, t, norm).cast("long")).alias(tag) for tag in tx.TAGS],
    )


def dimension_facts(texts: DataFrame) -> DataFrame:
    """Per document, dimension kind and action: items and value statistics."""
    t = F.col("text")
    sized = tx.with_length(tx.with_dimension(texts.select("doc_id", "text"), t, "d"), t, "inches")
    parsed = sized.select(
        "doc_id", "d", "inches",
        tx.split_fraction_digits(t).isNotNull().alias("split"),
        (tx.strip_temporal(t) != F.trim(t)).alias("temporal"),
    )
    value = F.coalesce("d.value", "d.length", "d.ratio_den")
    return parsed.groupBy(
        "doc_id", F.col("d.kind").alias("kind"), tx.confidence_action(F.col("d.confidence")).alias("action")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(value).alias("min_value"), F.avg(value).alias("avg_value"), F.max(value).alias("max_value"),
        F.sum("d.quantity").alias("quantity"),
        F.sum("inches").alias("inches"),
        F.sum(F.col("split").cast("long")).alias("splits"),
        F.sum(F.col("temporal").cast("long")).alias("temporal"),
    )


def redaction_report(
    docs: DataFrame, max_lines: int = 3000, head: int = 2000, tail: int = 500
) -> DataFrame:
    """Per source and language: documents masked, clipped, and characters before and after."""
    masked = tx.redact_secrets(F.col("text"))
    clip = tx.clip_head_tail(F.col("_m"), max_lines, head, tail)
    rows = docs.select("source", "lang", "text", masked.alias("_m")).withColumn("_c", clip)
    return rows.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum((F.col("_m") != F.col("text")).cast("long")).alias("masked"),
        F.sum(F.col("_c.clipped").cast("long")).alias("clipped"),
        F.sum(F.length("text")).alias("chars_in"),
        F.sum(F.length("_c.text")).alias("chars_out"),
    )


#: Rank filters up to this are pushed below the exchange by the engine.
PUSHED_RANK = 1000


def text_cap(texts: DataFrame, n: int) -> DataFrame:
    """The first ``n`` texts of every page by source order.

    A small rank filter is pushed below the exchange, so a page sends at most ``n`` rows per task;
    for a large one rows are numbered block by block, so that no page is sorted in one task.
    """
    if n > PUSHED_RANK:
        return dense_position(texts, PAGE, ["ord"], [block_of("ord")], "_rn").filter(F.col("_rn") < n).drop("_rn")
    w = Window.partitionBy(*PAGE).orderBy("ord")
    return texts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def resolve_scale(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """Best drawing scale of every page, 1:1 when no text states one.

    Texts without a scale drop out inside the aggregate (a null rank is ignored): a filter on
    the parsed factor would be pushed down and repeat the whole parse.
    """
    raw = F.trim("text")
    s = tx.strip_temporal(raw)
    joined = (
        texts.filter(raw != "")
        .withColumn("_st", s)
        .filter("_st <> ''")
        .withColumns(
            {
                "_u": F.upper("_st"),
                "_pt": tx.group(F.col("_st"), tx.ARCH_SCALE, 1),
                "_rt": F.regexp_replace(
                    F.upper(F.trim(tx.group(F.col("_st"), tx.ARCH_SCALE, 2))), r"[\"']+$", ""
                ),
            }
        )
    )
    joined = tx.with_dimension(joined, F.col("_st"), "_d").withColumns(
        {
            "_paper": tx.parse_token(F.col("_pt")),
            "_real": F.coalesce(
                tx.feet_inches(F.col("_rt"), tx.ARCH_REAL), tx.parse_token(F.col("_rt"))
            ),
        }
    )
    d = F.col("_d")

    def ratio(num, den):
        return F.when((num > 0) & (den > 0), den / num)

    stated = F.when(d["kind"] == "scale", ratio(d["ratio_num"], d["ratio_den"]))
    paper, real = F.col("_paper"), F.col("_real")
    arch = F.when((paper > 0) & (real != 0), real / paper)
    bare = ratio(
        tx.number(F.col("_u"), tx.BARE_RATIO, 1), tx.number(F.col("_u"), tx.BARE_RATIO, 2)
    )
    scored = joined.withColumn("_stated", stated).withColumn("_arch", arch).withColumn(
        "factor", F.coalesce("_stated", "_arch", bare)
    )
    base = F.when(F.col("_stated").isNotNull(), 0.75).when(F.col("_arch").isNotNull(), 0.88).otherwise(0.75)
    in_page = spread_join(scored, pages.select(*PAGE, "width", "height"), PAGE, "ord")

    def bonus(test, points):
        return F.when(test, F.lit(points)).otherwise(F.lit(0.0))

    corner = bonus(F.col("iy") <= F.col("height") * 0.35, 0.35) + bonus(
        F.col("ix") >= F.col("width") * 0.45, 0.35
    )
    conf = (
        base + corner
        + bonus(F.col("_u").rlike(tx.SCALE_LABEL), 0.15)
        + bonus(tx.tag_flag("titleblock_like", F.col("text"), F.col("normalized")), 0.10)
        + bonus(tx.tag_flag("scale_like", F.col("text"), F.col("normalized")), 0.10)
    )
    conf = F.least(conf, F.lit(0.98))
    best = (
        in_page.withColumn("confidence", F.round(conf, 3))
        .withColumn("source", F.when(conf >= 0.70, "titleblock").otherwise("page_text"))
        .groupBy(*PAGE)
        .agg(
            F.max_by(
                F.struct("factor", F.trim("text").alias("notation"), "source", "confidence"),
                F.when(F.col("factor").isNotNull(), F.struct("confidence", -F.col("ord"))),
            ).alias("b"),
        )
    )
    return pages.select(*PAGE).join(best, PAGE, "left").select(
        *PAGE,
        F.coalesce("b.factor", F.lit(1.0)).alias("factor"),
        F.coalesce("b.notation", F.lit("1:1")).alias("notation"),
        F.coalesce("b.source", F.lit("default")).alias("source"),
        F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.col("b").isNull(), "no_scale_detected").otherwise("").alias("fallback_reason"),
    )
