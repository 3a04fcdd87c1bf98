"""Style and placement jobs over primitives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import RasterBudget
from ..functions import geometry as g
from ..functions import style as st
from ..plans.scale import block_of, dense_position, running_sum, spread_join

PAGE = ["doc_id", "page"]


def color_of(prefix: str) -> Column:
    """The stroke (``s``) or fill (``f``) colour columns as a struct, null when absent."""
    r, gr, b = (F.col(f"{prefix}{k}") for k in "rgb")
    return F.when(r.isNotNull(), st.rgb(r, gr, b))


def page_matrix(pages: DataFrame) -> DataFrame:
    """Pages with the affine ``m`` of their rotation and the turned height."""
    turn = F.pmod(F.col("rotation"), F.lit(360))
    a = F.when(turn == 0, 1.0).when(turn == 180, -1.0).otherwise(0.0)
    b = F.when(turn == 90, 1.0).when(turn == 270, -1.0).otherwise(0.0)
    swaps = turn.isin(90, 270)
    w, h = F.col("width"), F.col("height")
    seen_w, seen_h = F.when(swaps, h).otherwise(w), F.when(swaps, w).otherwise(h)
    return pages.withColumns(
        {"m": g.page_affine(seen_w, seen_h, a, b, -b, a), "seen_h": seen_h}
    )


def place_on_model(
    rows: DataFrame, pages: DataFrame, xs, ys, scale: float = 1.0, form: str = "matrix"
) -> DataFrame:
    """Rows with their points (column pairs ``xs``, ``ys``) mapped to model millimetres.

    ``form``: ``matrix`` maps with the page's affine, ``rotation`` with its angle and raw size alone.
    """
    new, extra = {}, {"matrix": ["m", "seen_h"], "rotation": ["_w", "_h", "_rot"]}[form]
    named = page_matrix(pages).withColumns({"_w": F.col("width"), "_h": F.col("height"), "_rot": F.col("rotation")})
    placed = rows.join(named.select(*PAGE, *extra), PAGE)
    for x, y in zip(xs, ys, strict=True):
        if form == "matrix":
            q = g.page_to_model(F.col(x), F.col(y), F.col("m"), F.col("seen_h"), scale=scale)
        else:
            q = g.page_to_model_rot(F.col(x), F.col(y), F.col("_w"), F.col("_h"), F.col("_rot"), scale=scale)
        new[x], new[y] = q["x"], q["y"]
    return placed.withColumns(new).drop(*extra)


def page_extents(
    prims: DataFrame, texts: DataFrame, pages: DataFrame, scale: float = 1.0, form: str = "matrix"
) -> DataFrame:
    """Extents and counts per page in model millimetres.

    Page matrices turn by multiples of 90 degrees, so the extent of the mapped points is the
    mapped extent: pages are reduced to one row before they meet the page table.
    """
    if scale <= 0:
        raise ValueError("scale factor must be positive")
    boxes = prims.select(*PAGE, "bx0", "by0", "bx1", "by1", F.lit(1).alias("p"), F.lit(0).alias("t"))
    spots = texts.select(
        *PAGE, F.col("ix").alias("bx0"), F.col("iy").alias("by0"),
        F.col("ix").alias("bx1"), F.col("iy").alias("by1"), F.lit(0).alias("p"), F.lit(1).alias("t"),
    )
    per_page = boxes.unionByName(spots).groupBy(*PAGE).agg(
        F.sum("p").alias("n_prims"), F.sum("t").alias("n_texts"),
        F.min("bx0").alias("x0"), F.min("by0").alias("y0"),
        F.max("bx1").alias("x1"), F.max("by1").alias("y1"),
    )
    placed = place_on_model(per_page, pages, ["x0", "x1"], ["y0", "y1"], scale, form)
    return placed.select(
        *PAGE, "n_prims", "n_texts",
        F.least("x0", "x1").alias("min_x"), F.least("y0", "y1").alias("min_y"),
        F.greatest("x0", "x1").alias("max_x"), F.greatest("y0", "y1").alias("max_y"),
    )


# Columns of the corpus tables that are lengths (or hold nested ones) and areas; all others stay.
LENGTHS = {
    "primitives": ("x0", "y0", "x1", "y1", "cx", "cy", "radius", "bx0", "by0", "bx1", "by1", "line_width"),
    "points": ("x", "y"),
    "texts": ("ix", "iy", "font_size", "bx0", "by0", "bx1", "by1"),
    "pages": ("width", "height"),
    "images": ("a", "b", "c", "d", "e", "f"),
}
AREAS = {"primitives": ("area",)}


def scaled(value: Column, kind: T.DataType, k: float) -> Column:
    """A value with every number inside it, at any depth of arrays, structs and maps, times ``k``."""
    if isinstance(kind, T.NumericType):
        return value * F.lit(float(k))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: scaled(v, kind.elementType, k))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: scaled(v, kind.valueType, k))
    if isinstance(kind, T.StructType):
        parts = F.struct(*[scaled(value[f.name], f.dataType, k).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), parts)
    return value


def uniform_scale(rows: DataFrame, factor: float, lengths=(), areas=()) -> DataFrame:
    """Scale length columns, nested ones too, by ``factor`` and area columns by its square.

    Nulls stay null; a factor that is not positive is an error.
    """
    if not factor > 0:
        raise ValueError("scale factor must be positive")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    new = {c: scaled(F.col(c), kinds[c], factor) for c in lengths}
    new |= {c: scaled(F.col(c), kinds[c], factor * factor) for c in areas}
    return rows.withColumns(new)


def rescale_corpus(tables: dict[str, DataFrame], factor: float) -> dict[str, DataFrame]:
    """The corpus tables with every length and area rescaled; one projection each, nothing moves."""
    out = {}
    for name, df in tables.items():
        have = set(df.columns)
        out[name] = uniform_scale(
            df, factor, [c for c in LENGTHS[name] if c in have], [c for c in AREAS.get(name, ()) if c in have]
        )
    return out


def paint_use(strokes: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows per document, kind and colour as it looks on white paper.

    ``strokes``: doc_id, packed (24-bit integer), parts (grey, RGB or CMYK components), opacity (0 to 1).
    ``spans``: doc_id, packed, alpha (0 to 255), flags (paint bits).  Raw paints are folded first, so the
    colour rules run once per distinct paint.  Rows without a readable colour count under null channels.
    """
    none = F.lit(None)
    lines = strokes.groupBy("doc_id", "packed", "parts", "opacity").agg(F.count(F.lit(1)).alias("n")).select(
        "doc_id", F.lit("stroke").alias("kind"), "n",
        st.composite_alpha(st.normalize_color(F.col("packed"), F.col("parts")), F.col("opacity")).alias("c"),
    )
    texts = spans.groupBy("doc_id", "packed", "alpha", "flags").agg(F.count(F.lit(1)).alias("n")).select(
        "doc_id", F.lit("text").alias("kind"), "n",
        st.composite_alpha(
            st.normalize_color(F.col("packed"), none.cast("array<double>")), st.text_alpha(F.col("alpha"), F.col("flags"))
        ).alias("c"),
    )
    return lines.unionByName(texts).groupBy(
        "doc_id", "kind", *[F.when(F.col("c").isNotNull(), st.byte(F.col("c")[k])).alias(k) for k in "rgb"]
    ).agg(F.sum("n").alias("n"))


def plain_linetypes(strokes: DataFrame) -> DataFrame:
    """Strokes per document and plain line type (by number and size of dashes); no pattern is CONTINUOUS.

    ``strokes``: doc_id, dash.  Patterns are folded before they are read.
    """
    folded = strokes.groupBy("doc_id", "dash").agg(F.count(F.lit(1)).alias("n"))
    read = folded.withColumn("_dash", st.parse_dashes(F.col("dash"))["dash"])
    return read.groupBy(
        "doc_id", F.coalesce(st.linetype_simple(F.col("_dash")), F.lit("CONTINUOUS")).alias("linetype")
    ).agg(F.sum("n").alias("n"))


def style_profile(prims: DataFrame) -> DataFrame:
    """Length, segments and distinct colours per (doc, layer, line type, line weight).

    Rows are folded by their raw style first, so dash and layer rules run once per style.
    """
    folded = prims.groupBy("doc_id", "page", "layer", "dash", "line_width", "sr", "sg", "sb").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(g.segment_length(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).alias("len"),
    )
    color = st.composite_alpha(color_of("s"), F.lit(0.5))
    line = F.col("line")
    styled = st.with_linetype(folded, "dash").select(
        "doc_id",
        st.layer_name(F.col("page"), F.col("layer"), color_of("s")).alias("layer"),
        F.coalesce(line["name"], F.lit("CONTINUOUS")).alias("linetype"),
        line["ltscale"].alias("ltscale"),
        st.lineweight(F.col("line_width")).alias("lineweight"),
        F.struct(*[st.byte(color[k]) for k in "rgb"]).alias("c"),
        color.isNotNull().alias("has_c"),
        "n", "len",
    )
    keys = ["doc_id", "layer", "linetype", "lineweight"]
    by_color = styled.groupBy(*keys, "c", "has_c").agg(
        F.sum("n").alias("n"), F.sum("len").alias("len"), F.max("ltscale").alias("ltscale")
    )
    return by_color.groupBy(*keys).agg(
        F.sum("n").alias("segments"),
        F.sum("len").alias("total_length"),
        F.sum(F.col("has_c").cast("long")).alias("colors"),
        F.max("ltscale").alias("ltscale"),
    )


def image_screen(
    images: DataFrame, pages: DataFrame, dpi: float, budget: RasterBudget = RasterBudget()
) -> DataFrame:
    """Per page: placements, admitted resolution, placements that are not upright."""
    upright = g.is_rectilinear(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    per_page = images.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("placements"), F.sum((~upright).cast("long")).alias("skewed")
    )
    zoom = st.raster_zoom(F.col("width"), F.col("height"), F.lit(dpi), budget)
    return per_page.join(pages.select(*PAGE, "width", "height"), PAGE).select(
        *PAGE, "placements", "skewed", (zoom * 72).alias("dpi")
    )


def page_stack(
    pages: DataFrame, arrangement: str = "spread", gap: float = 0.02, multiplier: float = 1.2
) -> DataFrame:
    """Vertical offset of every page when a document's pages are stacked downwards."""
    h = F.greatest(F.coalesce("height", F.lit(0.0)), F.lit(1.0))
    step = {
        "overlay": F.lit(0.0),
        "touch": h,
        "compact": h * (1.0 + max(0.0, gap)),
        "spread": h * multiplier,
    }[arrangement]
    return running_sum(
        pages, ["doc_id"], "page", {"_sum": step}, inclusive=False
    ).withColumn("dy", -F.col("_sum")).drop("_sum")


def redundant_page_fill(prims: DataFrame, pages: DataFrame) -> DataFrame:
    """Fill-only white rectangles that cover exactly the page."""
    w, h = F.col("width"), F.col("height")
    tol = F.greatest(F.lit(1e-7), F.greatest(w, h, F.lit(1.0)) * 1e-7)
    fits = [F.abs(F.col(c) - t) <= tol for c, t in
            (("bx0", F.lit(0.0)), ("by0", F.lit(0.0)), ("bx1", w), ("by1", h))]
    white = prims.filter(
        F.col("sr").isNull() & (F.least("fr", "fg", "fb") >= 0.995) & F.col("bx0").isNotNull()
        & F.col("fr").isNotNull()
    )
    return white.join(pages.select(*PAGE, "width", "height"), PAGE).filter(
        fits[0] & fits[1] & fits[2] & fits[3]
    ).select("prim_id", *PAGE)


def drawables(prims: DataFrame, pages: DataFrame, arrangement: str = "spread") -> DataFrame:
    """Primitives with the offset ``dy`` of their page, once per entity ``_e`` (kind, colour ``c``) they become."""
    placed = prims.join(page_stack(pages, arrangement).select(*PAGE, "width", "height", "dy"), PAGE)
    stroke, fill = color_of("s"), color_of("f")
    w, h = F.col("width"), F.col("height")
    tol = F.greatest(F.lit(1e-7), F.greatest(w, h, F.lit(1.0)) * 1e-7)
    paper = (
        stroke.isNull() & (F.least("fr", "fg", "fb") >= 0.995)
        & (F.abs("bx0") <= tol) & (F.abs("by0") <= tol)
        & (F.abs(F.col("bx1") - w) <= tol) & (F.abs(F.col("by1") - h) <= tol)
    )
    area = (F.col("bx1") > F.col("bx0")) & (F.col("by1") > F.col("by0")) & (F.col("n_points") >= 3)
    kind = (
        F.when((F.col("type") == "line") & (F.col("n_points") == 2), "line")
        .when((F.col("type") == "circle") & F.col("cx").isNotNull() & (F.col("radius") > 0), "circle")
        .when((F.col("type") == "arc") & F.col("cx").isNotNull() & (F.col("radius") > 0), "arc")
        .when(F.col("n_points") >= 2, "polyline")
    )
    rows = F.array(
        F.when(fill.isNotNull() & ~paper & area, F.struct(F.lit("fill").alias("kind"), fill.alias("c"))),
        F.when(stroke.isNotNull() & kind.isNotNull(), F.struct(kind.alias("kind"), stroke.alias("c"))),
    )
    return placed.withColumn("_e", F.explode(F.filter(rows, lambda e: e.isNotNull())))


def entity_table(
    prims: DataFrame, pages: DataFrame, arrangement: str = "spread"
) -> DataFrame:
    """One styled row per drawable: a fill row and a stroke row where both exist.

    ``ltscale`` is the scale of the line type, null for plain lines and fills.  The points of polylines
    and fills are rows of ``entity_points``.
    """
    stroke, fill, line = color_of("s"), color_of("f"), F.col("line")
    # Dash patterns are few: the line type rule runs once per pattern.
    lines = st.with_linetype(prims.select("dash").filter("dash is not null").distinct(), "dash")
    drawn = spread_join(drawables(prims, pages, arrangement), lines, ["dash"], "prim_id", how="left")
    drawn = st.with_palette(drawn, F.col("_e.c"))
    is_fill = F.col("_e.kind") == "fill"
    return drawn.select(
        "prim_id", *PAGE, F.col("_e.kind").alias("kind"),
        st.layer_name(F.col("page"), F.col("layer"), F.coalesce(stroke, fill)).alias("layer"),
        F.when(~is_fill, F.coalesce(line["name"], F.lit("CONTINUOUS"))).alias("linetype"),
        F.when(~is_fill, line["ltscale"]).alias("ltscale"),
        F.when(~is_fill, st.lineweight(F.col("line_width"))).alias("lineweight"),
        "palette",
        "x0", (F.col("y0") + F.col("dy")).alias("y0"), "x1", (F.col("y1") + F.col("dy")).alias("y1"),
        "radius",
    )


def entity_points(
    prims: DataFrame, points: DataFrame, pages: DataFrame, arrangement: str = "spread"
) -> DataFrame:
    """Ordered points of every line, polyline and fill, shifted to its page's slot: one row a point.

    ``points``: prim_id, seq, x, y.  ``position`` counts from 0 within an entity in order of seq.  Lines have their two
    ends; circles and arcs have no points.  ``closed`` tells whether the last point joins the first; fills
    always do.  Points are dealt over tasks, whatever share of them one primitive has.
    """
    drawn = drawables(prims, pages, arrangement).withColumn("kind", F.col("_e.kind"))
    ends = F.array(*[F.struct(F.lit(k).cast("long").alias("position"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (0, 1)])
    lines = drawn.filter("kind = 'line'").select(
        "prim_id", *PAGE, "kind", F.lit(False).alias("closed"), "dy", F.explode(ends).alias("p")
    ).select("prim_id", *PAGE, "kind", "closed", "p.position", "p.x", (F.col("p.y") + F.col("dy")).alias("y"))
    placed = dense_position(points.select("prim_id", "seq", "x", "y"), ["prim_id"], ["seq"], [block_of("seq")], "position")
    shapes = drawn.filter("kind in ('polyline', 'fill')").select(
        "prim_id", *PAGE, "kind", ((F.col("kind") == "fill") | F.coalesce("closed", F.lit(False))).alias("closed"), "dy"
    )
    rows = spread_join(placed, shapes, ["prim_id"], "position").select(
        "prim_id", *PAGE, "kind", "closed", "position", "x", (F.col("y") + F.col("dy")).alias("y")
    )
    return lines.unionByName(rows)


def palette_use(prims: DataFrame) -> DataFrame:
    """Primitives per stroke colour and the palette index nearest to it."""
    folded = prims.filter("sr is not null").groupBy("sr", "sg", "sb").agg(
        F.count(F.lit(1)).alias("n")
    )
    return st.with_palette(folded, color_of("s"))
