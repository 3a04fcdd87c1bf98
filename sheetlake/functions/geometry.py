"""Geometry rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MM_PER_PT


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def page_affine(w: Column, h: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Keep the linear part of a page matrix; translate the turned page to the origin.

    ``w``, ``h`` are the visible page size.
    """
    swaps = F.abs(b) + F.abs(c) > F.abs(a) + F.abs(d)
    sw, sh = F.when(swaps, h).otherwise(w), F.when(swaps, w).otherwise(h)
    zero = F.lit(0.0)
    e = -F.least(zero, a * sw, c * sh, a * sw + c * sh)
    f = -F.least(zero, b * sw, d * sh, b * sw + d * sh)
    names = zip("abcdef", (a, b, c, d, e, f), strict=True)
    return F.struct(*[v.cast("double").alias(n) for n, v in names])


def page_to_model(
    x: Column, y: Column, m: Column, page_h: Column, flip_y: bool = True, scale: float = 1.0
) -> Column:
    """Page point to model millimetres: affine turn, optional Y flip, unit factor."""
    px = m["a"] * x + m["c"] * y + m["e"]
    py = m["b"] * x + m["d"] * y + m["f"]
    if flip_y:
        py = page_h - py
    k = MM_PER_PT * scale
    return point(px * k, py * k)


def page_to_model_rot(
    x: Column, y: Column, w: Column, h: Column, rot: Column, flip_y: bool = True, scale: float = 1.0
) -> Column:
    """The same for pages that only carry a rotation of 0, 90, 180 or 270 degrees."""
    turn = F.pmod(rot, F.lit(360))
    px = F.when(turn == 90, h - y).when(turn == 180, w - x).when(turn == 270, y).otherwise(x)
    py = F.when(turn == 90, x).when(turn == 180, h - y).when(turn == 270, w - x).otherwise(y)
    if flip_y:
        py = F.when(turn.isin(90, 270), w).otherwise(h) - py
    k = MM_PER_PT * scale
    return point(px * k, py * k)


def bezier_flatten(p0: Column, p1: Column, p2: Column, p3: Column, max_samples: int = 32) -> Column:
    """Sample points of a cubic after its start; the end point is always the last one."""
    chord = F.hypot(p3["x"] - p0["x"], p3["y"] - p0["y"])
    n = F.greatest(F.lit(4), F.least(F.lit(max_samples), F.ceil(chord / 0.5))).cast("int")

    def at(t: Column) -> Column:
        u = F.lit(1.0) - t

        def axis(k: str) -> Column:
            return (
                u * u * u * p0[k] + 3 * u * u * t * p1[k] + 3 * u * t * t * p2[k] + t * t * t * p3[k]
            )

        return point(axis("x"), axis("y"))

    steps = F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("double") / n)
    return F.transform(steps, at)


def rect_loop(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Rectangle as a closed loop of five points."""
    return F.array(
        point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h), point(x, y)
    )


def quad_loop(ul: Column, ur: Column, lr: Column, ll: Column) -> Column:
    """Quadrilateral as a closed loop of five points."""
    return F.array(ul, ur, lr, ll, ul)


def keep_apart(points: Column, tol: float) -> Column:
    """Drop points no farther than ``tol`` from the last point that was kept."""
    return F.aggregate(
        F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))),
        F.slice(points, 1, 1),
        lambda kept, p: F.when(
            F.hypot(F.element_at(kept, -1)["x"] - p["x"], F.element_at(kept, -1)["y"] - p["y"])
            > tol,
            F.concat(kept, F.array(p)),
        ).otherwise(kept),
    )


def primitive_type(n_points: Column, closed: Column) -> Column:
    return F.when(n_points == 2, "line").when(closed, "closed_loop").otherwise("polyline")


def bbox_of(bbox: Column, x0, y0, x1, y1, cx: Column, cy: Column, radius: Column) -> Column:
    """Given box, else the extent of the points, else the circle's box, else null."""
    fields = ("x0", "y0", "x1", "y1")
    extent = F.struct(*[v.alias(n) for n, v in zip(fields, (x0, y0, x1, y1), strict=True)])
    ring = F.struct(
        (cx - radius).alias("x0"), (cy - radius).alias("y0"),
        (cx + radius).alias("x1"), (cy + radius).alias("y1"),
    )
    return F.coalesce(
        bbox, F.when(x0.isNotNull(), extent), F.when(cx.isNotNull() & radius.isNotNull(), ring)
    )


def segment_length(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(x1 - x0, y1 - y0)


def segment_angle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Undirected angle in [0, 180)."""
    raw = F.degrees(F.atan2(y1 - y0, x1 - x0))
    folded = F.when(raw < 0, raw + 180).otherwise(raw)
    return F.when(folded >= 180, F.lit(0.0)).otherwise(folded)


def wrap_angle(a: Column) -> Column:
    """Angle in [0, 360)."""
    return F.pmod(a, F.lit(360.0))


def arc_angles(first: Column, last: Column) -> Column:
    """Counter-clockwise start and end of an unwrapped angle run."""
    forward = last >= first
    return F.struct(
        wrap_angle(F.when(forward, first).otherwise(last)).alias("start"),
        wrap_angle(F.when(forward, last).otherwise(first)).alias("end"),
    )


def half_turn(a: Column) -> Column:
    """Degrees folded into (-180, 180]."""
    return -(F.pmod(-a + 180, F.lit(360.0)) - 180)


def minor_sweep_ok(first: Column, mid: Column, last: Column) -> Column:
    """Whether the middle point lies within 90 degrees of the half-sweep direction."""
    expected = half_turn(first + half_turn(last - first) * 0.5)
    return F.abs(half_turn(mid - expected)) <= 90


def is_rectilinear(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether an image placement is upright and unsheared."""
    tol = F.greatest(F.abs(a), F.abs(d), F.lit(1.0)) * 1e-10
    return (a > 0) & (d > 0) & (F.abs(b) <= tol) & (F.abs(c) <= tol)


def boxes_within(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1, gap: float) -> Column:
    """Whether two boxes are less than ``gap`` apart on both axes."""
    zero = F.lit(0.0)
    gx = F.greatest(ax0 - bx1, bx0 - ax1, zero)
    gy = F.greatest(ay0 - by1, by0 - ay1, zero)
    return (gx < gap) & (gy < gap)
