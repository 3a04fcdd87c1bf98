"""Circle fits, arc promotion and run shapes over long point tables.

``points``: prim_id, seq (dense from 0), x, y.  All passes shuffle on the primitive and its
block of points, so no primitive is ever held by one task, and folded rows meet per primitive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ArcFit
from ..functions import geometry as g
from ..plans.scale import BLOCK, block_of, shuffled_join, with_halo


def with_facts(blocked: DataFrame, facts: DataFrame) -> DataFrame:
    """Join points that carry ``_block`` to one-row-per-primitive facts with their count ``n``.

    A primitive's row is copied once per block of its points, so a primitive of any size is
    joined, and then partially aggregated, block by block.
    """
    last = F.floor((F.col("n") - 1) / BLOCK).cast("long")
    copies = facts.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return shuffled_join(blocked, copies, ["prim_id", "_block"])


def _det(a, b, c, d, e, f, p, q, r) -> Column:
    return a * (e * r - f * q) - b * (d * r - f * p) + c * (d * q - e * p)


def fit_points(points: DataFrame, drop_closing: bool) -> DataFrame:
    """Points with their primitive's mean; a repeated closing point can be left out."""
    at = F.struct("x", "y")
    ends = points.groupBy("prim_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("x").alias("_sx"),
        F.sum("y").alias("_sy"),
        F.min_by(at, "seq").alias("_a"),
        F.max_by(at, "seq").alias("_z"),
    )
    gap = F.hypot(F.col("_a.x") - F.col("_z.x"), F.col("_a.y") - F.col("_z.y"))
    drop = ((F.col("n") >= 2) & (gap <= 1e-6)) if drop_closing else F.lit(False)
    ends = (
        ends.withColumn("end_gap", gap)
        .withColumn("n_fit", F.col("n") - drop.cast("long"))
        .withColumn("mx", F.when(drop, F.col("_sx") - F.col("_z.x")).otherwise(F.col("_sx")) / F.col("n_fit"))
        .withColumn("my", F.when(drop, F.col("_sy") - F.col("_z.y")).otherwise(F.col("_sy")) / F.col("n_fit"))
        .drop("_sx", "_sy", "_a", "_z")
    )
    return with_facts(points.withColumn("_block", block_of("seq")), ends).drop("_block")


def circle_fit(points: DataFrame, drop_closing: bool = False) -> DataFrame:
    """Algebraic least-squares circle per primitive: n, n_fit, end_gap, cx, cy, r.

    Sums run over coordinates centred on the primitive's mean, which keeps them small and
    their rounding harmless.  No row for fewer than 3 points or a singular system.
    """
    p = fit_points(points, drop_closing).filter(F.col("seq") < F.col("n_fit"))
    u, v = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    z = u * u + v * v
    s = p.groupBy("prim_id").agg(
        F.first("n").alias("n"),
        F.first("n_fit").alias("n_fit"),
        F.first("end_gap").alias("end_gap"),
        F.first("mx").alias("mx"),
        F.first("my").alias("my"),
        F.sum(u).alias("u"), F.sum(v).alias("v"),
        F.sum(u * u).alias("uu"), F.sum(v * v).alias("vv"), F.sum(u * v).alias("uv"),
        F.sum(z).alias("z"), F.sum(u * z).alias("uz"), F.sum(v * z).alias("vz"),
    )
    c = {k: F.col(k) for k in ("u", "v", "uu", "vv", "uv", "z", "uz", "vz")}
    m = F.col("n_fit").cast("double")
    den = _det(c["u"], c["v"], m, c["uu"], c["uv"], c["u"], c["uv"], c["vv"], c["v"])
    da = _det(c["z"], c["v"], m, c["uz"], c["uv"], c["u"], c["vz"], c["vv"], c["v"])
    db = _det(c["u"], c["z"], m, c["uu"], c["uz"], c["u"], c["uv"], c["vz"], c["v"])
    dc = _det(c["u"], c["v"], c["z"], c["uu"], c["uv"], c["uz"], c["uv"], c["vv"], c["vz"])
    return (
        s.filter("n_fit >= 3")
        .withColumn("_d", den)
        .filter(F.abs("_d") >= 1e-12)
        .withColumns({"_a": da / F.col("_d") / 2, "_b": db / F.col("_d") / 2, "_c": dc / F.col("_d")})
        .withColumn(
            "r",
            F.sqrt(F.greatest(F.lit(0.0), F.col("_c") + F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b"))),
        )
        .select(
            "prim_id", "n", "n_fit", "end_gap",
            (F.col("_a") + F.col("mx")).alias("cx"), (F.col("_b") + F.col("my")).alias("cy"), "r",
        )
    )


def arc_facts(points: DataFrame, drop_closing: bool = True) -> DataFrame:
    """Fit, residuals, unwrapped angles and turning of every primitive that has a fit.

    Points are cut into blocks along ``seq``; a block carries one neighbour on each side, and
    per-block angle runs are joined up on one row per block.
    """
    fits = circle_fit(points, drop_closing)
    w = Window.partitionBy("prim_id", "_block").orderBy("seq")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    p = with_facts(with_halo(points, "seq", before=1, after=1), fits)
    angle = F.degrees(F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")))
    p = p.withColumn("_ang", angle).withColumns(
        {
            "_dx": F.col("x") - F.lag("x").over(w),
            "_dy": F.col("y") - F.lag("y").over(w),
            "_ex": F.lead("x").over(w) - F.col("x"),
            "_ey": F.lead("y").over(w) - F.col("y"),
            "_lag": F.lag("_ang").over(w),
        }
    )
    p = p.filter(~F.col("_halo"))
    step = F.coalesce(g.half_turn(F.col("_ang") - F.col("_lag")), F.lit(0.0))
    la, lb = F.hypot("_dx", "_dy"), F.hypot("_ex", "_ey")
    cross = F.col("_dx") * F.col("_ey") - F.col("_dy") * F.col("_ex")
    dot = F.col("_dx") * F.col("_ex") + F.col("_dy") * F.col("_ey")
    fitted = F.col("seq") < F.col("n_fit")
    turns = (F.col("seq") <= F.col("n_fit") - 2) & (la > 1e-9) & (lb > 1e-9)
    err = F.abs(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) - F.col("r"))
    sin = cross / (la * lb)
    p = p.withColumn("_step", step).withColumn("_run", F.sum("_step").over(run))
    blocks = p.groupBy("prim_id", "_block").agg(
        *[F.first(k).alias(k) for k in ("n", "n_fit", "end_gap", "cx", "cy", "r")],
        F.sum("_step").alias("_total"),
        F.min("_run").alias("_lo"),
        F.max("_run").alias("_hi"),
        F.sum(F.when(fitted, err * err)).alias("_sq"),
        F.max(F.when(fitted, err)).alias("_err"),
        F.sum(la).alias("_len"),
        F.max(F.when(turns, F.abs(F.degrees(F.atan2(cross, dot))))).alias("_turn"),
        F.sum(turns.cast("long")).alias("_turns"),
        F.max(F.when(turns & (cross > 1e-9), 1).otherwise(0)).alias("_left"),
        F.max(F.when(turns & (cross < -1e-9), 1).otherwise(0)).alias("_right"),
        F.sum(((la > 0.01) & (lb > 0.01) & (F.abs(sin) > 0.1)).cast("long")).alias("_bends"),
        F.max(F.when(F.col("seq") == 0, F.col("_ang"))).alias("_first"),
        F.max(F.when(F.col("seq") == F.floor(F.col("n_fit") / 2), F.col("_ang"))).alias("_mid"),
        F.max(F.when(F.col("seq") == F.col("n_fit") - 1, F.col("_ang"))).alias("_last"),
    )
    outer = Window.partitionBy("prim_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_at", F.coalesce(F.sum("_total").over(outer), F.lit(0.0)))
    return blocks.groupBy("prim_id").agg(
        *[F.first(k).alias(k) for k in ("n", "n_fit", "end_gap", "cx", "cy", "r")],
        F.sqrt(F.sum("_sq") / F.first("n_fit")).alias("rms"),
        F.max("_err").alias("max_err"),
        F.sum("_len").alias("length"),
        F.sum("_total").alias("sweep"),
        (F.max(F.col("_at") + F.col("_hi")) - F.min(F.col("_at") + F.col("_lo"))).alias("span_range"),
        F.max("_first").alias("first_angle"),
        F.max("_mid").alias("mid_angle"),
        F.max("_last").alias("last_angle"),
        F.coalesce(F.max("_turn"), F.lit(0.0)).alias("max_turn"),
        F.sum("_turns").alias("turns"),
        (F.max("_left") + F.max("_right") > 1).alias("both_ways"),
        F.coalesce(F.sum("_bends"), F.lit(0)).alias("bends"),
    )


def smooth(max_turn_deg: float = 60.0) -> Column:
    """Small turns, all to one side, at least two of them."""
    return (
        (F.col("n_fit") >= 5)
        & (F.col("max_turn") <= max_turn_deg)
        & ~F.col("both_ways")
        & (F.col("turns") >= 2)
    )


def run_shape(points: DataFrame) -> DataFrame:
    """One shape row per primitive: length, turning, span, smoothness, curvature, sweep."""
    facts = arc_facts(points)
    return facts.select(
        "prim_id", "n", "length", "max_turn", "turns", "bends",
        F.abs("sweep").alias("span"),
        smooth().alias("smooth"),
        ((F.col("n") >= 4) & (F.col("bends") >= 3)).alias("curved"),
        g.minor_sweep_ok(F.col("first_angle"), F.col("mid_angle"), F.col("last_angle")).alias(
            "minor_sweep"
        ),
    )


def promote_arcs(
    prims: DataFrame, points: DataFrame, cfg: ArcFit = ArcFit(), variant: str = "strict"
) -> DataFrame:
    """Replace circular polylines by arcs and circles.

    ``prims``: prim_id, closed (already limited to polylines and loops).  Returns one row per
    promoted primitive: prim_id, type, cx, cy, r, start_deg, end_deg.
    """
    loose = variant == "loose"
    p = shuffled_join(points, prims, "prim_id", "left_semi")
    facts = shuffled_join(arc_facts(p, drop_closing=not loose), prims.select("prim_id", "closed"), "prim_id")
    r, rms = F.col("r"), F.col("rms")
    arc = g.arc_angles(F.col("first_angle"), F.col("first_angle") + F.col("sweep"))
    if loose:
        ok = (F.col("n") >= 6) & (rms <= cfg.loose_tol_mm) & (r > 0)
        circle = F.col("closed") & (F.col("span_range") >= 330)
        is_arc = F.col("span_range") >= cfg.loose_min_deg
    else:
        tol = F.greatest(F.lit(cfg.tol_mm), r * 0.005)
        span = F.abs("sweep")
        ok = (
            (F.col("n") >= 5) & (F.col("n_fit") >= 5) & (r > 0.1) & (rms <= tol)
            & (F.col("max_err") <= F.greatest(tol * 1.8, r * 0.008))
        )
        ring = (F.col("end_gap") <= F.greatest(F.lit(0.25), r * 0.01)) & (span >= 350)
        circle = ring & (F.col("n_fit") >= 10)
        is_arc = (
            ~ring & ~F.col("closed") & (F.col("n_fit") <= cfg.max_segments + 1)
            & (span >= cfg.min_arc_deg) & smooth()
            & g.minor_sweep_ok(F.col("first_angle"), F.col("mid_angle"), F.col("last_angle"))
        )
    kind = F.when(ok & circle, "circle").when(ok & is_arc, "arc")
    return (
        facts.withColumn("type", kind)
        .filter(F.col("type").isNotNull())
        .select(
            "prim_id", "type", "cx", "cy", "r",
            F.when(F.col("type") == "circle", F.lit(0.0)).otherwise(arc["start"]).alias("start_deg"),
            F.when(F.col("type") == "circle", F.lit(360.0)).otherwise(arc["end"]).alias("end_deg"),
        )
    )


def fit_residuals(points: DataFrame) -> DataFrame:
    """Fit and root-mean-square residual over all points of a primitive."""
    fits = circle_fit(points)
    err = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) - F.col("r")
    return (
        with_facts(points.withColumn("_block", block_of("seq")), fits)
        .groupBy("prim_id")
        .agg(
            *[F.first(k).alias(k) for k in ("n", "cx", "cy", "r")],
            F.sqrt(F.avg(err * err)).alias("rms"),
        )
    )


def find_circles(explicit: DataFrame, loops: DataFrame, points: DataFrame, tol: float) -> DataFrame:
    """Circle primitives as they are, and closed loops of at least 6 points that fit one.

    ``explicit``: prim_id, cx, cy, radius.  ``loops``: prim_id of closed loops.
    """
    fits = fit_residuals(shuffled_join(points, loops, "prim_id", "left_semi"))
    fitted = fits.filter((F.col("n") >= 6) & (F.col("rms") < tol)).select(
        "prim_id", "cx", "cy", F.col("r").alias("radius"), "rms", F.lit("fit").alias("origin")
    )
    given = explicit.filter((F.col("radius") != 0) & F.col("cx").isNotNull()).select(
        "prim_id", "cx", "cy", "radius", F.lit(0.0).alias("rms"), F.lit("given").alias("origin")
    )
    return given.unionByName(fitted)


def visible_fill(points: DataFrame) -> DataFrame:
    """Whether a filled ring paints any area.

    A ring paints nothing when it has under 3 distinct points in a row, when all its points
    are collinear, or when it retraces every edge backwards exactly as often as forwards.
    """
    w = Window.partitionBy("prim_id", "_block").orderBy("seq")
    p = with_halo(points, "seq", before=1).withColumns(
        {"_lx": F.lag("x").over(w), "_ly": F.lag("y").over(w)}
    )
    # Edges between distinct neighbours; repeats add no edge, so they need not be removed first.
    p = p.filter(~F.col("_halo"))
    at = F.struct("x", "y")
    ends = p.groupBy("prim_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(at, "seq").alias("a"),
        F.max_by(at, "seq").alias("z"),
        F.count(
            F.when(
                F.col("_lx").isNull() | (F.col("x") != F.col("_lx")) | (F.col("y") != F.col("_ly")), 1
            )
        ).alias("kept"),
    )
    edges = (
        p.filter(F.col("_lx").isNotNull())
        .select("prim_id", F.col("_lx").alias("ax"), F.col("_ly").alias("ay"),
                F.col("x").alias("bx"), F.col("y").alias("by"))
        .unionByName(
            ends.select("prim_id", F.col("z.x").alias("ax"), F.col("z.y").alias("ay"),
                        F.col("a.x").alias("bx"), F.col("a.y").alias("by"))
        )
        .filter((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")))
    )
    # Every edge is filed under its undirected form; an exact retrace balances each form.
    forward = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
    balance = (
        edges.select(
            "prim_id",
            F.when(forward, F.array("ax", "ay", "bx", "by"))
            .otherwise(F.array("bx", "by", "ax", "ay")).alias("e"),
            F.when(forward, 1).otherwise(-1).alias("s"),
        )
        .groupBy("prim_id", "e")
        .agg(F.sum("s").alias("net"))
        .groupBy("prim_id")
        .agg(F.max(F.abs("net")).alias("unbalanced"))
    )
    far = F.greatest(F.abs(F.col("x") - F.col("a.x")), F.abs(F.col("y") - F.col("a.y")))
    # Facts are joined as narrow as each pass needs them: these rows are the ones that are sorted.
    place = p.select("prim_id", "_block", "seq", "x", "y")
    anchor = (
        with_facts(place, ends.select("prim_id", "n", "a"))
        .groupBy("prim_id")
        .agg(F.first("n").alias("n"), F.first("a").alias("a"), F.max_by(at, F.struct(far, -F.col("seq"))).alias("m"))
    )
    off = (F.col("m.x") - F.col("a.x")) * (F.col("y") - F.col("a.y")) - (
        F.col("m.y") - F.col("a.y")
    ) * (F.col("x") - F.col("a.x"))
    wide = (
        with_facts(place.drop("seq"), anchor).groupBy("prim_id").agg(F.max((off != 0).cast("int")).alias("spans"))
    )
    ring = (F.col("a") == F.col("z")) & (F.col("kept") >= 2)
    spans = shuffled_join(
        wide, ends.select("prim_id", (F.col("kept") - F.when(ring, 1).otherwise(0)).alias("kept")), "prim_id"
    )
    return shuffled_join(spans, balance, "prim_id", "left").select(
        "prim_id",
        (
            (F.col("kept") >= 3) & (F.col("spans") == 1)
            & (F.coalesce("unbalanced", F.lit(0)) != 0)
        ).alias("visible"),
    )
