"""Style rules as Column expressions: colour, dash, line weight, layer, raster zoom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MM_PER_PT, RasterBudget

# Indexed palette (r, g, b, index) and the dash-length variants in millimetres.
PALETTE = (
    (255, 0, 0, 1), (255, 255, 0, 2), (0, 255, 0, 3), (0, 255, 255, 4), (0, 0, 255, 5),
    (255, 0, 255, 6), (255, 255, 255, 7), (128, 128, 128, 8), (192, 192, 192, 9),
)
DASH_VARIANTS = (("TINY", 3.175), ("2", 6.35), ("", 12.7), ("X2", 25.4))
DOT_MAX_MM = 0.75


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"))


def unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def normalize_color(packed: Column, parts: Column) -> Column:
    """Packed 24-bit integer, or grey / RGB / CMYK components, to clamped RGB."""
    low = packed.bitwiseAND(F.lit(0xFFFFFF))
    channel = [
        F.shiftright(low, s).bitwiseAND(F.lit(0xFF)).cast("double") / 255 for s in (16, 8, 0)
    ]
    v = F.transform(parts, lambda c: unit(c))
    ink = 1 - F.get(v, F.lit(3))
    last = F.coalesce(F.try_element_at(v, F.lit(-1)), F.lit(0.0))
    plain = [F.coalesce(F.get(v, F.lit(i)), last) for i in range(3)]
    return (
        F.when(packed >= 0, rgb(*channel))
        .when(packed < 0, F.lit(None))
        .when(
            F.size(v) >= 4,
            rgb(*[unit((1 - F.get(v, F.lit(i))) * ink) for i in range(3)]),
        )
        .when(parts.isNotNull(), rgb(*plain))
    )


def composite_alpha(color: Column, alpha: Column) -> Column:
    """Constant opacity over white paper; opaque or unknown alpha leaves the colour as is."""
    opaque = alpha.isNull() | F.isnan(alpha) | (alpha >= 1)
    a = F.greatest(alpha, F.lit(0.0))
    mixed = rgb(*[unit(a * color[k] + (1 - a)) for k in "rgb"])
    return F.when(color.isNull() | opaque, color).otherwise(mixed)


def text_alpha(alpha: Column, flags: Column) -> Column:
    """Text opacity is 0-255; text that is not painted at all keeps its colour."""
    hidden = flags.isNotNull() & (flags.bitwiseAND(F.lit(48)) == 0)
    return F.when(~hidden, unit(alpha.cast("double") / 255))


def parse_dashes(raw: Column) -> Column:
    """``[6 6] 3`` as an array and a phase; null array for solid or unreadable patterns."""
    s = F.trim(raw)
    inner = F.trim(F.regexp_extract(s, r"\[([^\]]*)\]", 1))
    words = F.filter(F.split(inner, r"\s+"), lambda w: w != "")
    nums = F.transform(words, lambda w: w.try_cast("double"))
    good = (F.size(nums) > 0) & ~F.exists(nums, lambda n: n.isNull())
    tail = F.trim(F.regexp_extract(s, r"\](.*)$", 1))
    return F.struct(
        F.when(good, nums).alias("dash"),
        F.when(good, F.coalesce(tail.try_cast("double"), F.lit(0.0)))
        .otherwise(F.lit(0.0))
        .alias("phase"),
    )


def with_linetype(df: DataFrame, raw: str, name: str = "line") -> DataFrame:
    """Add the named line type nearest to a dash pattern: struct name, family, ltscale; or null.

    Each step is a column of its own, so no list is worked out twice.
    """
    kept = df.columns
    mm, dashes, longest = F.col("_mm"), F.col("_dashes"), F.col("_longest")
    d = df.withColumn("_dash", parse_dashes(F.col(raw))["dash"])
    d = d.withColumn(
        "_size",
        F.transform(
            F.filter(F.col("_dash"), lambda v: v != 0),
            lambda v: F.greatest(F.lit(0.1), F.abs(v) * MM_PER_PT),
        ),
    )
    last = F.try_element_at(F.col("_size"), F.lit(-1))
    odd = F.size("_size") % 2 == 1
    d = d.withColumn(
        "_mm", F.when(odd, F.concat(F.col("_size"), F.array(last))).otherwise(F.col("_size"))
    )
    d = d.withColumn("_dashes", F.filter(mm, lambda v, i: i % 2 == 0))
    d = d.withColumn("_longest", F.array_max(dashes))
    d = d.withColumns(
        {
            "_dots": F.size(F.filter(dashes, lambda v: v <= DOT_MAX_MM)),
            "_n": F.size(dashes),
            "_even": ~F.exists(dashes, lambda v: F.abs(v - longest) > longest * 0.35),
        }
    )
    dots, n = F.col("_dots"), F.col("_n")
    longs = n - dots
    family = (
        F.when(longs == 0, "DOT")
        .when((n == 1) | F.col("_even"), "DASHED")
        .when(n == 2, F.when(dots > 0, "DASHDOT").otherwise("CENTER"))
        .when((dots >= 2) & (longs == 1), "DIVIDE")
        .when((longs >= 2) & (dots >= 1), "BORDER")
        .otherwise("CENTER")
    )
    d = d.withColumns(
        {"_family": family, "_ref": F.when(longs == 0, F.array_max(mm)).otherwise(longest)}
    )
    variant = F.array_min(
        F.array(
            *[
                F.struct(
                    F.abs(F.lit(size) - F.col("_ref")).alias("d"), F.lit(i).alias("i"),
                    F.lit(tail).alias("tail"), F.lit(size).alias("size"),
                )
                for i, (tail, size) in enumerate(DASH_VARIANTS)
            ]
        )
    )
    d = d.withColumn("_v", variant)
    ratio = longest / F.col("_v.size")
    line = F.struct(
        F.concat("_family", "_v.tail").alias("name"),
        F.col("_family").alias("family"),
        F.round(F.least(F.greatest(ratio, F.lit(0.05)), F.lit(20.0)), 4).alias("ltscale"),
    )
    return d.select(*kept, F.when(F.size("_size") >= 2, line).alias(name))


def linetype_simple(dash: Column) -> Column:
    """The plain variant: line type family from the number and size of dashes only."""
    mag = F.transform(dash, lambda v: F.abs(v))
    n = F.size(mag)
    total = F.aggregate(mag, F.lit(0.0), lambda a, v: a + v)
    dots = F.size(F.filter(mag, lambda v: v < 0.05))

    def at(i: int) -> Column:
        return F.get(mag, F.lit(i))

    return F.when(dash.isNull() | (n == 0) | (total < 0.01), F.lit(None)).otherwise(
        F.when(n == 1, "DASHED")
        .when(
            n == 2,
            F.when(at(0) < 0.01, "DOTTED").when(at(1) > at(0) * 2, "DASHED").otherwise("CENTER"),
        )
        .when(n == 4, F.when(at(2) < 0.05, "DASHDOT").otherwise("CENTER"))
        .when(n >= 6, F.when(dots >= 2, "DASHDOTDOT").otherwise("PHANTOM"))
        .otherwise("DASHED")
    )


def lineweight(width_mm: Column) -> Column:
    """Millimetres to hundredths, clamped to the supported range; null when not finite."""
    finite = ~F.isnan(width_mm) & (F.abs(width_mm) != float("inf"))
    return F.when(
        finite, F.least(F.greatest(F.bround(width_mm * 100), F.lit(5.0)), F.lit(211.0))
    ).cast("long")


def byte(channel: Column) -> Column:
    return F.least(F.greatest(F.bround(channel * 255), F.lit(0.0)), F.lit(255.0)).cast("long")


def layer_name(page: Column, source: Column, color: Column) -> Column:
    """Page prefix plus the cleaned source layer, or else the colour key."""
    clean = F.regexp_replace(F.trim(source), r"[^\p{L}\p{N}_-]", "_")
    clean = F.left(F.regexp_replace(clean, r"^_+|_+$", ""), F.lit(120))
    clean = F.when(clean == "", "Layer").otherwise(clean)
    key = F.format_string(
        "RGB_%03d_%03d_%03d", byte(color["r"]), byte(color["g"]), byte(color["b"])
    )
    return F.concat_ws(
        "_",
        F.format_string("P%03d", page),
        F.when(source.isNotNull() & (source != ""), clean).when(color.isNotNull(), key),
    )


def with_palette(df: DataFrame, color: Column, name: str = "palette") -> DataFrame:
    """Add the palette index nearest by squared RGB distance; near-white is the paper colour 7.

    The channels are rounded once, as columns, before the distances read them.
    """
    kept = df.columns
    d = df.withColumns(
        {f"_p{k}": F.bround(color[k] * 255).cast("long") for k in "rgb"}
    )
    r, g, b = (F.col(f"_p{k}") for k in "rgb")
    best = F.array_min(
        F.array(
            *[
                F.struct(
                    ((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)).alias("d"),
                    F.lit(i).alias("pos"),
                    F.lit(idx).cast("long").alias("idx"),
                )
                for i, (pr, pg, pb, idx) in enumerate(PALETTE)
            ]
        )
    )
    white = (r > 245) & (g > 245) & (b > 245)
    index = F.when(r.isNotNull(), F.when(white, F.lit(7).cast("long")).otherwise(best["idx"]))
    return d.select(*kept, index.alias(name))


def raster_zoom(w: Column, h: Column, dpi: Column, budget: RasterBudget) -> Column:
    """Zoom admitted by resolution, pixel and dimension budgets; null below the least DPI."""
    asked = F.greatest(F.lit(budget.min_dpi), dpi) / 72
    zoom = F.least(
        asked,
        F.sqrt(F.lit(float(budget.page_pixels)) / (w * h)),
        F.lit(float(budget.page_dimension)) / w,
        F.lit(float(budget.page_dimension)) / h,
    )
    return F.when(zoom * 72 + 1e-9 >= budget.min_dpi, zoom)
