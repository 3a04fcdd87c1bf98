"""Page-level rules: cleaning, tagging, profiles, content class, import mode, bounds, roll-ups.

Pages are folded to one row by partial aggregation before they meet the page table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ContentClass, RasterBudget
from ..functions import geometry as g
from ..functions import style as st
from ..functions import text as tx
from ..plans.scale import shuffled_join
from .shapes import fit_residuals
from .style_jobs import page_stack

PAGE = ["doc_id", "page"]


def flag_sum(test: Column) -> Column:
    return F.coalesce(F.sum(test.cast("long")), F.lit(0))


def is_micro(min_len: float) -> Column:
    """A two-point line shorter than ``min_len``."""
    size = g.segment_length(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return (F.col("type") == "line") & (F.col("n_points") == 2) & (size < min_len)


def prune_micro(prims: DataFrame, min_len: float) -> DataFrame:
    """Primitives without micro lines; nothing is dropped for a zero tolerance."""
    return prims.filter(~is_micro(min_len)) if min_len > 0 else prims


def prune_stats(prims: DataFrame, min_len: float) -> DataFrame:
    """Kept and removed primitives per page."""
    return prims.groupBy(*PAGE).agg(
        flag_sum(~is_micro(min_len)).alias("kept"), flag_sum(is_micro(min_len)).alias("removed")
    )


def tag_primitives(prims: DataFrame, pages: DataFrame) -> DataFrame:
    """Primitives with their tags: page border, table cell, dashed, thin."""
    sized = prims.join(pages.select(*PAGE, (F.col("width") * F.col("height")).alias("_pa")), PAGE)
    loop = (F.col("type") == "closed_loop") & (F.col("area") > 0) & F.col("n_points").between(1, 5)
    dash = st.parse_dashes(F.col("dash"))["dash"]
    tags = F.array(
        F.when(loop & (F.col("area") > F.col("_pa") * 0.7), "page_border"),
        F.when(loop & (F.col("area") < 50.0), "possible_table_cell"),
        F.when(dash.isNotNull(), "dashed_line"),
        F.when(F.col("line_width") < 0.3, "thin_line"),
    )
    return sized.withColumn("tags", F.filter(tags, lambda t: t.isNotNull())).drop("_pa")


def table_cells(prims: DataFrame) -> DataFrame:
    """Small closed loops that can be table cells."""
    return prims.filter(
        (F.col("type") == "closed_loop") & (F.col("area") > 0) & (F.col("area") < 50.0)
        & F.col("n_points").between(1, 5)
    )


def hatch_policy(prims: DataFrame, hatch_ids: DataFrame, mode: str) -> DataFrame:
    """Keep, drop or move to their own layer the lines of hatch patterns."""
    if mode not in ("import", "skip", "group"):
        raise ValueError(f"unknown hatch mode {mode!r}")
    if mode == "import":
        return prims
    if mode == "skip":
        return prims.join(hatch_ids.select("prim_id"), "prim_id", "left_anti")
    flagged = prims.join(
        hatch_ids.select("prim_id").withColumn("_hatch", F.lit(True)), "prim_id", "left"
    )
    own = F.concat(F.lit("Hatch_Page_"), F.col("page").cast("string"))
    return flagged.withColumn("layer", F.when(F.col("_hatch"), own).otherwise(F.col("layer"))).drop(
        "_hatch"
    )


def page_counts(prims: DataFrame, texts: DataFrame) -> DataFrame:
    """Primitive and text counts per page, one row for every page that has either."""
    p = prims.select(*PAGE, F.lit(1).alias("p"), F.lit(0).alias("t"))
    t = texts.select(*PAGE, F.lit(0).alias("p"), F.lit(1).alias("t"))
    return p.unionByName(t).groupBy(*PAGE).agg(
        F.sum("p").alias("n_prims"), F.sum("t").alias("n_texts")
    )


def text_cloud_page(counts: DataFrame, min_texts: int = 180, ratio: float = 2.5) -> DataFrame:
    """Pages that are mostly text: many items, and many per primitive."""
    p, t = F.col("n_prims"), F.col("n_texts")
    flag = (p > 0) & (t >= min_texts) & (t / F.greatest(p, F.lit(1)) >= ratio)
    return counts.withColumn("text_cloud", flag)


def frame_only_page(
    prims: DataFrame, texts: DataFrame, pages: DataFrame,
    max_prims: int = 12, max_texts: int = 12, share: float = 0.88,
) -> DataFrame:
    """Pages that hold little more than a border."""
    size = F.abs(F.col("bx1") - F.col("bx0")) * F.abs(F.col("by1") - F.col("by0"))
    p = prims.select(*PAGE, F.lit(1).alias("p"), F.lit(0).alias("t"), size.alias("s"))
    t = texts.select(*PAGE, F.lit(0).alias("p"), F.lit(1).alias("t"), F.lit(0.0).alias("s"))
    folded = p.unionByName(t).groupBy(*PAGE).agg(
        F.sum("p").alias("n_prims"), F.sum("t").alias("n_texts"), F.max("s").alias("largest")
    )
    area = F.greatest(F.col("width") * F.col("height"), F.lit(1.0))
    flag = (
        (F.col("n_prims") > 0) & (F.col("n_prims") <= max_prims) & (F.col("n_texts") <= max_texts)
        & (F.col("largest") / area >= share)
    )
    return folded.join(pages.select(*PAGE, "width", "height"), PAGE).select(
        *PAGE, "n_prims", "n_texts", flag.alias("frame_only")
    )


SCORES = ("fabrication", "cad_drawing", "architectural", "vector_art", "raster_only")


def page_profile(
    prims: DataFrame, texts: DataFrame, pages: DataFrame, points: DataFrame | None = None
) -> DataFrame:
    """Counts, five type scores and the winning page type.

    ``points`` (with ``prim_id``) lets closed loops of at least 8 points that fit a circle
    count as circles.
    """
    kind = F.col("type")
    zero = F.lit(0)
    fields = ("lines", "closed", "polylines", "circles", "geom", "layered",
              "dims", "scales", "titles", "callouts", "texts")

    def part(df, **given):
        return df.select(*PAGE, *[given.get(f, zero).cast("long").alias(f) for f in fields])

    t, norm = F.col("text"), F.col("normalized")
    parts = [
        part(
            prims, lines=kind == "line", closed=kind == "closed_loop", polylines=kind == "polyline",
            circles=kind == "circle", geom=F.lit(1),
            layered=F.coalesce(F.trim("layer") != "", F.lit(False)),
        ),
        part(
            texts, dims=tx.tag_flag("dimension_like", t, norm),
            scales=tx.tag_flag("scale_like", t, norm),
            titles=tx.tag_flag("titleblock_like", t, norm),
            callouts=tx.tag_flag("callout_like", t, norm), texts=F.lit(1),
        ),
    ]
    if points is not None:
        loops = prims.filter((kind == "closed_loop") & (F.col("n_points") >= 8))
        fits = fit_residuals(shuffled_join(points, loops.select("prim_id"), "prim_id", "left_semi"))
        round_ones = fits.filter("rms < 0.5").select("prim_id")
        parts.append(part(shuffled_join(loops, round_ones, "prim_id", "left_semi"), circles=F.lit(1)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    folded = rows.groupBy(*PAGE).agg(*[F.sum(f).alias(f) for f in fields])
    c = pages.select(*PAGE).join(folded, PAGE, "left").fillna(0, list(fields))

    def on(points_, test):
        return F.when(test, F.lit(points_)).otherwise(F.lit(0.0))

    col = {f: F.col(f) for f in fields}
    layered = col["layered"] > 0
    fab = (
        on(0.20, col["circles"] > 3) + on(0.15, col["callouts"] > 2) + on(0.15, col["dims"] > 5)
        + on(0.10, col["closed"] > 10) + on(0.10, col["titles"] > 2) + on(0.10, col["scales"] > 0)
    )
    cad = (
        on(0.20, col["lines"] > 50) + on(0.15, col["dims"] > 3) + on(0.15, layered)
        + on(0.10, col["closed"] > 5) + on(0.10, col["scales"] > 0) + on(0.10, col["titles"] > 0)
    )
    arch = (
        on(0.20, col["lines"] > 100) + on(0.15, layered) + on(0.15, col["dims"] > 10)
        + on(0.10, col["texts"] > 30) - on(0.15, col["circles"] > 10)
    )
    art = (
        on(0.30, (col["geom"] > 20) & (col["dims"] == 0)) + on(0.20, col["polylines"] > col["lines"])
        + on(0.10, col["texts"] < 5) - on(0.20, layered) - on(0.20, col["dims"] > 2)
    )
    raster = on(0.90, (col["geom"] == 0) & (col["texts"] == 0))
    scored = c.withColumns(
        {
            n: F.round(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)), 6)
            for n, s in zip(SCORES, (fab, cad, arch, art, raster), strict=True)
        }
    )
    best = F.array_max(
        F.array(*[F.struct(F.col(n).alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("n"))
                  for i, n in enumerate(SCORES)])
    )
    primary = F.when(
        best["s"] < 0.25, F.when(col["geom"] > 0, "cad_drawing").otherwise("unknown")
    ).otherwise(best["n"])
    return scored.select(
        *PAGE, primary.alias("primary_type"), *SCORES,
        layered.alias("has_layers"), (col["texts"] > 0).alias("has_text"),
        (col["dims"] > 0).alias("has_dimensions"), col["circles"].alias("circle_count"),
        col["closed"].alias("closed_loop_count"), col["lines"].alias("line_count"),
        col["texts"].alias("text_count"), (col["titles"] > 2).alias("titleblock_likely"),
    )


def page_content_class(
    prims: DataFrame, texts: DataFrame, pages: DataFrame,
    cfg: ContentClass = ContentClass(), variant: str = "core", tiny_side: float = 2.0,
) -> DataFrame:
    """Content class of every page from fill, stroke, rectangle and text statistics."""
    page_variant = variant == "page"
    w, h = F.abs(F.col("bx1") - F.col("bx0")), F.abs(F.col("by1") - F.col("by0"))
    single = (F.col("n_items") == 1) & (F.col("op") == "re")
    tiny = single & ((w * h <= 36.0) if page_variant else ((w < tiny_side) & (h < tiny_side)))
    sized = F.when(F.lit(True) if page_variant else single, w * h).otherwise(0.0)
    filled, stroked = F.col("fr").isNotNull(), F.col("sr").isNotNull()
    zero = F.lit(0)
    fields = ("total", "fills", "strokes", "fill_only", "tiny", "items", "blocks", "words")

    def part(df, rect, **given):
        return df.select(
            *PAGE, *[given.get(f, zero).cast("long").alias(f) for f in fields], rect.alias("rect")
        )

    rows = part(
        prims, sized, total=F.lit(1), fills=filled, strokes=stroked,
        fill_only=filled & ~stroked, tiny=tiny, items=F.col("n_items"),
    ).unionByName(
        part(
            texts, F.lit(0.0), blocks=F.lit(1),
            words=F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda v: v != "")),
        )
    )
    folded = rows.groupBy(*PAGE).agg(
        *[F.sum(f).alias(f) for f in fields], F.max("rect").alias("rect")
    )
    c = pages.select(*PAGE, "width", "height").join(folded, PAGE, "left").fillna(
        0, [*fields, "rect"]
    )
    total = F.greatest(F.col("total"), F.lit(1)).cast("double")
    fill, stroke = F.col("fills") / total, F.col("strokes") / total
    only, tiny_share = F.col("fill_only") / total, F.col("tiny") / total
    avg = F.col("items") / total
    large = F.col("rect") / (F.col("width") * F.col("height"))
    n = F.col("total")
    glyph = (n >= cfg.glyph_drawings) & (fill >= cfg.glyph_fill) & (stroke <= cfg.glyph_stroke_max)
    dense = glyph & (tiny_share >= cfg.glyph_tiny)
    wordy = glyph & ((F.col("blocks") >= cfg.glyph_blocks) | (F.col("words") >= cfg.glyph_words))
    if page_variant:
        wordy = wordy & (tiny_share >= 0.10) & (avg <= 8.0)
    complex_fill = (
        (only >= cfg.complex_ratio) & (stroke <= cfg.complex_stroke_max)
        & (F.col("items") >= cfg.complex_min_items)
    )
    pure = (
        (only >= cfg.pure_ratio) & (stroke <= cfg.pure_stroke_max) & (avg <= 5.0)
        & (n >= cfg.pure_min_groups)
        & ((F.col("items") >= cfg.pure_min_items) | (large >= cfg.pure_large_rect))
    )
    heavy = (
        (n >= cfg.fill_drawings) & (only >= cfg.fill_heavy) & (stroke <= cfg.fill_stroke_max)
        & (avg <= 5.0)
    )
    empty = F.when((F.col("blocks") > 0) | (F.col("words") > 0), "text_only").otherwise("no_vectors")
    rule = F.when(n == 0, empty).when(dense, "glyph_dense").when(wordy, "glyph_text")
    if page_variant:
        rule = rule.when(heavy, "heavy_fill").when(pure, "pure_fill")
    else:
        rule = rule.when(complex_fill, "complex_fill").when(pure, "pure_fill").when(heavy, "heavy_fill")
    rule = rule.otherwise("normal")
    kind = (
        F.when(F.col("rule") == "text_only", "text_only")
        .when(F.col("rule") == "no_vectors", "raster_candidate")
        .when(F.col("rule").startswith("glyph"), "glyph_flood")
        .when(F.col("rule").endswith("fill"), "fill_art")
        .otherwise("vectors")
    )
    return c.withColumn("rule", rule).select(
        *PAGE, kind.alias("type"), "rule", F.col("total").alias("drawings"),
        F.col("blocks").alias("text_count"), "words",
        F.when(n > 0, fill).alias("fill_ratio"), F.when(n > 0, stroke).alias("stroke_ratio"),
        F.when(n > 0, only).alias("fill_only_ratio"), F.when(n > 0, tiny_share).alias("tiny_ratio"),
        F.when(n > 0, avg).alias("avg_items"), F.when(n > 0, large).alias("max_rect_ratio"),
    )


def suggest_import_mode(classes: DataFrame, has_images: Column, ignore_images: bool = False) -> DataFrame:
    """Vector, raster or hybrid for a page that was left on automatic."""
    kind, n, t = F.col("type"), F.col("drawings"), F.col("text_count")
    pictured = has_images & F.lit(not ignore_images)
    both = F.struct(F.lit("hybrid").alias("mode"), F.lit("text_with_images").alias("reason"))

    def pick(mode, reason):
        return F.struct(F.lit(mode).alias("mode"), F.lit(reason).alias("reason"))

    choice = (
        F.when((n == 0) & (t == 0), pick("raster", "no_vector_content"))
        .when(
            (kind == "text_only") | ((n == 0) & (t > 0)),
            F.when(pictured, both).otherwise(pick("vector", "text_only")),
        )
        .when(
            kind == "vectors",
            F.when(pictured, pick("hybrid", "vectors_with_images")).otherwise(
                pick("vector", "vectors")
            ),
        )
        .when(kind.isin("glyph_flood", "fill_art"), F.struct(
            F.lit("raster").alias("mode"), F.concat_ws(":", kind, F.col("rule")).alias("reason")))
        .when(kind == "raster_candidate", pick("raster", "raster_candidate"))
        .otherwise(pick("vector", "unclassified"))
    )
    return classes.withColumn("_m", choice).withColumns(
        {"suggested_mode": F.col("_m.mode"), "suggested_reason": F.col("_m.reason")}
    ).drop("_m")


def resolve_import_mode(
    classes: DataFrame, frames: DataFrame, requested: str = "auto", keep_text: bool = False,
    fallback: bool = True, cloud_texts: int = 180, cloud_ratio: float = 2.5,
) -> DataFrame:
    """Final mode of every page.

    A forced mode stays; automatic raster gives way to text that was asked for; automatic
    vector pages that turn out to be a text cloud or a bare frame fall back to raster.
    """
    keeps = F.lit(keep_text) & (F.col("text_count") > 0)
    flood = F.col("type").isin("glyph_flood", "fill_art", "raster_candidate")
    if requested == "auto":
        first = F.when(flood, "raster").otherwise("vector")
        reason = F.when(flood, F.concat_ws(":", "type", "rule")).otherwise(F.col("rule"))
    else:
        first, reason = F.lit(requested), F.lit(f"forced_{requested}")
    c = classes.withColumns({"_mode": first, "_why": reason}).join(
        frames.select(*PAGE, "frame_only"), PAGE, "left"
    )
    saved = keeps & (F.col("_mode") == "raster")
    after = F.when(saved, F.lit("vector" if requested == "auto" else "hybrid")).otherwise(F.col("_mode"))
    why = F.when(saved, "requested_text_kept").otherwise(F.col("_why"))
    c = c.withColumns({"_mode": after, "_why": why})
    n, t = F.col("drawings"), F.col("text_count")
    cloud = (n > 0) & (t >= cloud_texts) & (t / F.greatest(n, F.lit(1)) >= cloud_ratio)
    may = F.lit(requested == "auto" and fallback) & (F.col("_mode") != "raster") & ~keeps
    frame = F.coalesce("frame_only", F.lit(False))
    return c.select(
        *PAGE, "type",
        F.when(may & (cloud | frame), "raster").otherwise(F.col("_mode")).alias("mode"),
        F.when(may & cloud, "text_cloud_fallback").when(may & frame, "frame_only_fallback")
        .otherwise(F.col("_why")).alias("reason"),
    )


def page_layers(prims: DataFrame) -> DataFrame:
    """Distinct non-blank layer names per page, one row each, with their use."""
    return (
        prims.withColumn("layer", F.trim("layer"))
        .filter("layer <> ''")
        .groupBy(*PAGE, "layer")
        .agg(F.count(F.lit(1)).alias("prims"))
    )


def page_bounds(prims: DataFrame, texts: DataFrame, pages: DataFrame) -> DataFrame:
    """Extent of every page's content, the page frame where there is none."""
    box = g.bbox_of(
        F.when(F.col("bx0").isNotNull(), F.struct(*[F.col(f"b{k}").alias(k) for k in ("x0", "y0", "x1", "y1")])),
        F.least("x0", "x1"), F.least("y0", "y1"), F.greatest("x0", "x1"), F.greatest("y0", "y1"),
        F.col("cx"), F.col("cy"), F.col("radius"),
    )
    spot = [F.coalesce(b, i) for b, i in (
        (F.col("bx0"), F.col("ix")), (F.col("by0"), F.col("iy")),
        (F.col("bx1"), F.col("ix")), (F.col("by1"), F.col("iy")))]
    names = ("x0", "y0", "x1", "y1")
    boxes = prims.select(*PAGE, box.alias("b")).select(*PAGE, *[F.col(f"b.{k}").alias(k) for k in names])
    rows = boxes.unionByName(texts.select(*PAGE, *[s.alias(k) for s, k in zip(spot, names, strict=True)]))
    folded = rows.groupBy(*PAGE).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"),
        F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    frame = {"x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.col("width"), "y1": F.col("height")}
    return pages.select(*PAGE, "width", "height").join(folded, PAGE, "left").select(
        *PAGE, "width", "height", *[F.coalesce(F.col(k), frame[k]).alias(k) for k in names]
    )


def _padded(df: DataFrame, fraction: float, least: float) -> DataFrame:
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(least))
    pad = F.greatest(span * fraction, F.lit(least))
    return df.withColumn("_p", pad).select(
        "doc_id",
        (F.col("x0") - F.col("_p")).alias("min_x"), (F.col("y0") - F.col("_p")).alias("min_y"),
        (F.col("x1") + F.col("_p")).alias("max_x"), (F.col("y1") + F.col("_p")).alias("max_y"),
    )


def _union_box(df: DataFrame) -> DataFrame:
    return df.groupBy("doc_id").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"),
        F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


def import_bounds(
    prims: DataFrame, texts: DataFrame, pages: DataFrame, fraction: float = 0.02, least: float = 1.0
) -> DataFrame:
    """Padded extent of every document."""
    return _padded(_union_box(page_bounds(prims, texts, pages)), fraction, least)


def framing(prims: DataFrame, texts: DataFrame, pages: DataFrame, multiplier: float = 1.2) -> DataFrame:
    """Padded extent, centre and view height of every document with its pages stacked."""
    stacked = page_stack(pages, "spread", multiplier=multiplier).select(*PAGE, "dy")
    moved = page_bounds(prims, texts, pages).join(stacked, PAGE).withColumns(
        {"y0": F.col("y0") + F.col("dy"), "y1": F.col("y1") + F.col("dy")}
    )
    box = _padded(_union_box(moved), 0.02, 1.0)
    w = F.greatest(F.lit(1.0), F.col("max_x") - F.col("min_x"))
    h = F.greatest(F.lit(1.0), F.col("max_y") - F.col("min_y"))
    return box.withColumns(
        {
            "center_x": (F.col("min_x") + F.col("max_x")) * 0.5,
            "center_y": (F.col("min_y") + F.col("max_y")) * 0.5,
            "view_height": F.greatest(w, h) * 1.1,
        }
    )


def title_block(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """Box of the title block texts of a page, when it stays in the lower 40 percent."""
    tagged = texts.filter(tx.tag_flag("titleblock_like", F.col("text"), F.col("normalized")))
    box = tagged.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("texts"),
        (F.min("ix") - 1).alias("x0"), (F.min("iy") - 1).alias("y0"),
        (F.max("ix") + 1).alias("x1"), (F.max("iy") + 1).alias("y1"),
    ).filter("texts >= 2")
    return box.join(pages.select(*PAGE, "height"), PAGE).filter(
        F.col("y1") < F.col("height") * 0.4
    ).drop("height")


def document_summary(
    pages: DataFrame, prims: DataFrame, texts: DataFrame, images: DataFrame, modes: DataFrame
) -> DataFrame:
    """Totals of every document: pages, content, pages per mode, image sources."""
    zero = F.lit(0).cast("long")
    fields = ("pages", "primitives", "text_items", "images", "source_instances",
              "vector", "raster", "hybrid", "inline_images", "xobject_images")

    def part(df, **given):
        return df.select("doc_id", *[given.get(f, zero).cast("long").alias(f) for f in fields])

    count = F.greatest(F.lit(1), F.coalesce("instances", F.lit(1)))
    inline = F.col("kind") == "inline_image"
    one = F.lit(1)
    rows = part(pages, pages=one)
    for p in (
        part(prims, primitives=one),
        part(texts, text_items=one),
        part(images, images=one, source_instances=count,
             inline_images=F.when(inline, count).otherwise(0),
             xobject_images=F.when(inline, 0).otherwise(count)),
        part(modes, **{m: F.col("mode") == m for m in ("vector", "raster", "hybrid")}),
    ):
        rows = rows.unionByName(p)
    total = rows.groupBy("doc_id").agg(*[F.sum(f).alias(f) for f in fields])
    parts = [F.when(F.col(m) > 0, F.concat(F.col(m).cast("string"), F.lit(f" {m}")))
             for m in ("hybrid", "raster", "vector")]
    text = F.concat_ws(", ", *parts)
    head = F.concat(F.col("pages").cast("string"), F.lit(" pages"))
    return total.withColumn(
        "summary", F.when(text != "", F.concat_ws(": ", head, text)).otherwise(head)
    )


def doc_scale(page_scales: DataFrame, profiles: DataFrame) -> DataFrame:
    """Document scale: the most confident page, first page on ties; other factors beside it."""
    sure = page_scales.filter("confidence > 0")
    best = sure.groupBy("doc_id").agg(
        F.max_by(F.struct("factor", "notation", "source", "confidence"),
                 F.struct("confidence", -F.col("page"))).alias("b")
    )
    factors = sure.select("doc_id", F.round("factor", 6).alias("f")).distinct().groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("factors"), F.min("f").alias("min_factor"), F.max("f").alias("max_factor")
    )
    blocks = profiles.groupBy("doc_id").agg(F.bool_or("titleblock_likely").alias("title_block"))
    return blocks.join(best, "doc_id", "left").join(factors, "doc_id", "left").select(
        "doc_id", "b.factor", "b.notation", "b.source", "b.confidence",
        F.coalesce("factors", F.lit(0)).alias("factors"), "min_factor", "max_factor", "title_block",
    )


def doc_scale_factors(page_scales: DataFrame) -> DataFrame:
    """Every distinct scale factor of a document, a row each, with the pages that show it."""
    return page_scales.filter("confidence > 0").groupBy("doc_id", F.round("factor", 6).alias("factor")).agg(
        F.count(F.lit(1)).alias("pages"), F.max("confidence").alias("confidence")
    )


def corpus_rollup(prims: DataFrame, texts: DataFrame) -> DataFrame:
    """Counts by page, by document and for the corpus; null keys mark the totals."""
    counts = page_counts(prims, texts)
    return counts.rollup(*PAGE).agg(
        F.sum("n_prims").alias("n_prims"), F.sum("n_texts").alias("n_texts"),
        F.count(F.lit(1)).alias("pages"),
    )


def heavy_pages(
    counts: DataFrame, threshold: int = 3000, entity_hint: int = 50_000, k: int = 20, peak_hint_mb: float = 1024.0
) -> DataFrame:
    """The ``k`` heaviest pages above the object threshold, with the low-memory hint.

    The hint is given for many objects, or for a peak of ``peak_hint_mb`` or more where ``counts`` has a
    column ``peak_mb``.
    """
    size = F.col("n_prims") + F.col("n_texts")
    peak = F.coalesce("peak_mb", F.lit(0.0)) if "peak_mb" in counts.columns else F.lit(0.0)
    return (
        counts.withColumns({"objects": size, "hint": (size >= entity_hint) | (peak >= peak_hint_mb)})
        .filter(F.col("objects") > threshold)
        .orderBy(F.desc("objects"), *PAGE)
        .limit(k)
    )


def fidelity_diagnostics(counts: DataFrame, layers: DataFrame, images: DataFrame, mode: str) -> DataFrame:
    """Quality level, signals and recommended actions per page."""
    layer_n = layers.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("layers"))
    image_n = images.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("images"))
    c = counts.join(layer_n, PAGE, "left").join(image_n, PAGE, "left").fillna(0, ["layers", "images"])
    p, t = F.col("n_prims"), F.col("n_texts")
    level = (
        F.when(p >= 50, "high").when(p >= 10, "moderate").when(p > 0, "low")
        .when(F.col("images") > 0, "raster").otherwise("empty")
    )
    first = (
        F.when(p >= 50, "good_vector_content").when(p >= 10, "limited_vector_content")
        .when(p > 0, "very_limited_vector_content")
        .when(F.col("images") > 0, "raster_or_image_content_delivered")
        .otherwise("no_vector_geometry_created")
    )
    chars = F.col("glyphs") if "glyphs" in counts.columns else F.lit(0)
    fell = F.col("fallbacks") > 0 if "fallbacks" in counts.columns else F.lit(False)
    warned = F.col("warnings") > 0 if "warnings" in counts.columns else F.lit(False)
    signals = F.array(
        first,
        F.when(fell, "fallback_used"),
        F.when(warned, "warnings_present"),
        F.when(F.col("layers") == 0, "no_pdf_layers_detected").otherwise("pdf_layers_preserved"),
        F.lit(f"text_mode_{mode}"),
        F.when((t > 0) & (F.coalesce(F.col("delivered"), t) == 0),
               "source_text_seen_but_no_text_entities_created")
        if "delivered" in counts.columns else F.lit(None),
        F.when(chars >= 1000, "dense_text_glyph_workload"),
    )
    actions = F.array(
        F.when(fell, "inspect_item_proof"), F.when(warned, "review_warnings"),
        F.lit("confirm_text_representation"),
        F.when(chars >= 1000, "diagnose_one_page_first"),
    )
    return c.select(
        *PAGE, level.alias("quality_level"),
        tx.unique_strings(signals).alias("signals"), tx.unique_strings(actions).alias("actions"),
    )


def raster_dpi(pages: DataFrame, requested: float, budget: RasterBudget) -> DataFrame:
    """Admitted page resolution under the terminal page budgets."""
    w, h = F.col("width"), F.col("height")
    zoom = F.least(
        F.lit(requested / 72.0),
        F.sqrt(F.lit(float(budget.terminal_page_pixels)) / (w * h)),
        F.lit(float(budget.terminal_page_dimension)) / w,
        F.lit(float(budget.terminal_page_dimension)) / h,
    )
    return pages.withColumn("dpi", zoom * 72)


def dpi_budget_fit(
    pages: DataFrame, requested: float, budget: RasterBudget = RasterBudget(), step: float = 1.0
) -> DataFrame:
    """Largest resolution at which all pages of a document fit the job budgets.

    Pixels and tiles grow with the resolution, so the feasible set is an interval and the
    best grid value is its upper end.  Pages are folded to distinct sizes per document first;
    each size meets the fixed grid of resolutions.  Null when even the least one does not fit.
    """
    low = budget.min_dpi
    n = int((requested - low) / step)
    grid = sorted({low + step * i for i in range(n + 1)} | {requested})
    sizes = pages.groupBy("doc_id", "width", "height").agg(F.count(F.lit(1)).alias("copies"))
    w, h = F.col("width"), F.col("height")
    cap = F.least(
        F.sqrt(F.lit(float(budget.terminal_page_pixels)) / (w * h)),
        F.lit(float(budget.terminal_page_dimension)) / w,
        F.lit(float(budget.terminal_page_dimension)) / h,
    )
    use = sizes.withColumn("dpi", F.explode(F.array(*[F.lit(d) for d in grid]))).withColumn(
        "_z", F.least(F.col("dpi") / 72.0, cap)
    )
    # The small slack keeps an exact product from rounding up to the next pixel.
    pw, ph = (F.ceil(v * F.col("_z") - 1e-6) for v in (w, h))
    tile = budget.tile_pixels
    usage = use.withColumns({"_pw": pw, "_ph": ph}).groupBy("doc_id", "dpi").agg(
        F.sum(F.col("copies") * F.col("_pw") * F.col("_ph")).alias("pixels"),
        F.sum(F.col("copies") * F.ceil(F.col("_pw") / tile) * F.ceil(F.col("_ph") / tile)).alias("tiles"),
    )
    fits = (F.col("pixels") <= budget.terminal_job_pixels) & (F.col("tiles") <= budget.terminal_job_tiles)
    return usage.groupBy("doc_id").agg(F.max(F.when(fits, F.col("dpi"))).alias("dpi"))
