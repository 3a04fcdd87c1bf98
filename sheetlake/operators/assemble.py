"""Path operators to primitives: subpaths, curve flattening, point thinning, area."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..plans.scale import BLOCK, block_of, cut_lineage, running_sum, with_halo, written

# Room for the points of one operator (a curve gives at most 32, plus its start).
SLOTS = 64


def split_subpaths(ops: DataFrame, gap: float = 0.01, tol: float = 0.01) -> DataFrame:
    """Cut ordered path operators into subpaths and give every operator its points.

    ``ops``: path_id, seq (dense), op (m l c re qu h), x0, y0 (null start: continue from the
    current point), x1, y1, control points.  A quadrilateral states its corners as start, first control
    point, end and second control point.  A subpath starts at a move, a rectangle or quadrilateral, after a
    closing, or where a stated start lies more than ``gap`` from the current point.
    Returns pieces of subpaths: path_id, sub_id, seq (the first one of the piece), ``closes``, ``busy``, count ``n``,
    box, shoelace sum ``s``, first and last point ``a`` and ``z``, and ``end`` (pos and island of the last point).
    A busy piece is one operator with points that thinning may drop; it carries ``pts`` (array of x, y, pos,
    island, near).  All other points stay, so they are folded where they are made.
    """
    w = Window.partitionBy("path_id", "_block").orderBy("seq")
    seen = with_halo(ops, "seq", before=1).withColumns(
        {
            "_op": F.lag("op").over(w),
            "_px": F.lag("x1").over(w),
            "_py": F.lag("y1").over(w),
        }
    )
    draws = F.col("op").isin("l", "c")
    fresh = F.col("_op").isNull() | F.col("_op").isin("h", "re", "qu")
    stated = draws & F.col("x0").isNotNull()
    jump = stated & ~fresh & (F.hypot(F.col("x0") - F.col("_px"), F.col("y0") - F.col("_py")) > gap)
    starts = F.col("op").isin("m", "re", "qu") | (draws & fresh) | jump
    p0 = g.point(F.col("x0"), F.col("y0"))
    p3 = g.point(F.col("x1"), F.col("y1"))
    curve = g.bezier_flatten(
        g.point(F.coalesce("x0", "_px"), F.coalesce("y0", "_py")),
        g.point(F.col("c1x"), F.col("c1y")),
        g.point(F.col("c2x"), F.col("c2y")),
        p3,
    )
    body = (
        F.when(F.col("op") == "re", g.rect_loop(
            F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
        .when(F.col("op") == "qu", g.quad_loop(
            p0, g.point(F.col("c1x"), F.col("c1y")), p3, g.point(F.col("c2x"), F.col("c2y"))))
        .when(F.col("op") == "c", curve)
        .when(F.col("op").isin("m", "l"), F.array(p3))
    )
    pts = F.when(F.col("_starts") & stated, F.concat(F.array(p0), body)).otherwise(body)
    prev = F.when(~F.col("_starts"), g.point(F.col("_px"), F.col("_py")))
    cut = (
        seen.filter(~F.col("_halo"))
        .filter(~((F.col("op") == "h") & fresh))
        .filter(~((F.col("op") == "c") & fresh & F.col("x0").isNull()))
        .withColumn("_starts", starts)
        .withColumn("_pts", pts)
        .withColumn("_prev", prev)
    )
    stepped = F.transform(
        F.col("_pts"),
        lambda p, i: F.struct(
            p["x"].alias("x"),
            p["y"].alias("y"),
            i.alias("i"),
            F.when(
                i > 0,
                F.hypot(
                    p["x"] - F.get("_pts", i - 1)["x"],
                    p["y"] - F.get("_pts", i - 1)["y"],
                ),
            )
            .otherwise(F.hypot(p["x"] - F.col("_prev.x"), p["y"] - F.col("_prev.y")))
            .alias("d"),
        ),
    )
    # A point more than two tolerances from its predecessor is kept whatever was kept before.
    sure = lambda p: p["d"].isNull() | (p["d"] > 2 * tol)
    cut = (
        cut.withColumn("_pts", stepped)
        .withColumn("_sure", F.coalesce(F.size(F.filter("_pts", sure)), F.lit(0)))
        .select("path_id", "seq", "op", "_starts", "_pts", "_sure")
    )
    # What the operator adds to its subpath; only operators that need thinning keep their points.
    last = lambda p, i: F.get("_kept", i - 1)
    cross = F.transform(
        F.col("_kept"),
        lambda p, i: F.when(i > 0, last(p, i)["x"] * p["y"] - p["x"] * last(p, i)["y"]).otherwise(F.lit(0.0)),
    )
    xs, ys = F.transform("_kept", lambda p: p["x"]), F.transform("_kept", lambda p: p["y"])
    at = lambda p: F.when(F.size("_kept") > 0, F.struct(p["x"].alias("x"), p["y"].alias("y")))
    busy = F.exists("_kept", lambda p: ~sure(p))
    cut = cut.withColumn("_kept", F.filter("_pts", lambda p: p["d"].isNull() | (p["d"] > 0))).select(
        "path_id", "seq", "_starts", "_sure",
        F.col("op").isin("h", "re", "qu").alias("closes"),
        F.coalesce(busy, F.lit(False)).alias("busy"),
        F.coalesce(F.size("_kept"), F.lit(0)).cast("long").alias("n"),
        F.array_min(xs).alias("bx0"), F.array_min(ys).alias("by0"),
        F.array_max(xs).alias("bx1"), F.array_max(ys).alias("by1"),
        F.aggregate(cross, F.lit(0.0), lambda t, c: t + c).alias("s"),
        at(F.get("_kept", F.lit(0))).alias("a"),
        at(F.get("_kept", F.size("_kept") - 1)).alias("z"),
        F.when(busy, F.col("_pts")).alias("_pts"),
        F.when(F.size("_kept") > 0, F.get("_kept", F.size("_kept") - 1)["i"]).alias("_i"),
    )
    # Written once: the sums below read it twice, and the point lists are costly to redo.
    cut = running_sum(
        written(cut, "operators"),
        ["path_id"],
        "seq",
        {
            "sub_id": F.col("_starts").cast("long"),
            "_islands": F.col("_sure").cast("long"),
            "_busy": F.col("busy").cast("long"),
        },
        keep_block=True,
    )
    # Operators between busy ones are folded in the block they lie in; a busy one is a piece of its own.
    cut = cut.withColumn("piece", 2 * F.col("_busy") - F.col("busy").cast("long"))
    keys = ["path_id", "_block", "sub_id", "piece"]
    before = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.when(F.col("n") > 0, F.col("seq"))
    pieces = (
        cut.withColumn("_lz", F.last("z", ignorenulls=True).over(before))
        .groupBy(*keys)
        .agg(
            F.min("seq").alias("seq"),
            F.max("closes").alias("closes"),
            F.max("busy").alias("busy"),
            F.sum("n").alias("n"),
            F.min("bx0").alias("bx0"), F.min("by0").alias("by0"),
            F.max("bx1").alias("bx1"), F.max("by1").alias("by1"),
            (F.coalesce(F.sum("s"), F.lit(0.0)) + F.coalesce(F.sum(between(F.col("_lz"), F.col("a"))), F.lit(0.0))).alias("s"),
            F.min_by("a", filled).alias("a"),
            F.max_by("z", filled).alias("z"),
            F.max_by(F.struct(
                (F.col("seq") * SLOTS + F.col("_i")).alias("pos"), F.col("_islands").alias("island")
            ), filled).alias("end"),
            F.max("_islands").alias("_islands"),
            F.max("_sure").alias("_sure"),
            F.first("_pts", ignorenulls=True).alias("_pts"),
        )
    )
    numbered = F.transform(
        F.filter("_pts", lambda p: p["d"].isNull() | (p["d"] > 0)),
        lambda p: F.struct(
            p["x"].alias("x"),
            p["y"].alias("y"),
            (F.col("seq") * SLOTS + p["i"]).alias("pos"),
            # The count of sure points up to this one names its run.
            (
                F.col("_islands")
                - F.col("_sure")
                + F.size(F.filter("_pts", lambda q: sure(q) & (q["i"] <= p["i"])))
            ).alias("island"),
            (~sure(p)).alias("near"),
        ),
    )
    return pieces.select(
        "path_id", "sub_id", "seq", "closes", "busy", "n", "bx0", "by0", "bx1", "by1", "s", "a", "z", "end",
        F.when(F.col("busy"), numbered).alias("pts"),
    )


def between(a: Column, b: Column) -> Column:
    """Twice the area that the edge from one point to another adds."""
    return a["x"] * b["y"] - b["x"] * a["y"]


def thin_points(points: DataFrame, tol: float = 0.01, short: int = 256, width: int = BLOCK) -> DataFrame:
    """Drop points within ``tol`` of the last kept point of their subpath.

    Only runs of points that all sit within two tolerances of their predecessor need the
    fold; every other point is kept as it is.  Short runs fold as arrays, long ones block by block.
    """
    run = ["path_id", "sub_id", "island"]
    near = points.filter("near").groupBy("path_id", "island").agg(F.count(F.lit(1)).alias("_n"))
    marked = points.join(near, ["path_id", "island"], "left")
    plain = marked.filter(F.col("_n").isNull()).select("path_id", "sub_id", "pos", "x", "y")
    runs = (
        marked.filter(F.col("_n") < short)
        .groupBy(*run)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("pts"))
        .select("path_id", "sub_id", F.inline(g.keep_apart(F.col("pts"), tol)))
    )
    long = marked.filter(F.col("_n") >= short).select(*run, "pos", "x", "y", block_of("pos", width).alias("block"))
    return plain.unionByName(runs).unionByName(thin_blocks(long, run, tol))


def thin_blocks(points: DataFrame, run: list[str], tol: float) -> DataFrame:
    """``thin_points`` for long runs: blocks of at most BLOCK positions are folded side by side.

    A block needs the last point kept before it.  At first every block assumes that there is none;
    then blocks whose predecessor ended on another point are folded again, until nothing changes.
    Folds from different points soon keep the same ones, so few blocks are folded twice.
    """
    points = cut_lineage(points)
    if points.isEmpty():
        return points.select("path_id", "sub_id", "pos", "x", "y")
    keys = [*run, "block"]

    def fold(kept_only: bool):
        def kept(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("pos", kind="stable")
            x, y = pdf["x"].to_list(), pdf["y"].to_list()
            lx, ly = pdf["lx"].iloc[0], pdf["ly"].iloc[0]
            first = pd.isna(lx)
            keep = []
            for px, py in zip(x, y, strict=True):
                keep.append(first or math.hypot(lx - px, ly - py) > tol)
                if keep[-1]:
                    lx, ly, first = px, py, False
            if kept_only:
                return pdf[keep][["path_id", "sub_id", "pos", "x", "y"]]
            return pdf[keys].head(1).assign(ox=lx, oy=ly)

        return kept

    end = ", ".join(f"{f} {t}" for f, t in points.select(*keys).dtypes) + ", ox double, oy double"
    none = F.lit(None).cast("double")
    blocks = points.select(*keys).distinct()
    ins = cut_lineage(blocks.withColumns({"lx": none, "ly": none}))
    outs = cut_lineage(points.join(ins, keys).groupBy(*keys).applyInPandas(fold(False), end))
    before = Window.partitionBy(*run).orderBy("block")  # one row per block
    while True:
        told = outs.withColumns({"nx": F.lag("ox").over(before), "ny": F.lag("oy").over(before)})
        wrong = ins.join(told, keys).filter(~(F.col("lx").eqNullSafe(F.col("nx")) & F.col("ly").eqNullSafe(F.col("ny"))))
        wrong = cut_lineage(wrong.select(*keys, F.col("nx").alias("lx"), F.col("ny").alias("ly")))
        if wrong.isEmpty():
            break
        again = points.join(wrong, keys).groupBy(*keys).applyInPandas(fold(False), end)
        outs = cut_lineage(outs.join(wrong, keys, "left_anti").unionByName(again))
        ins = cut_lineage(ins.join(wrong, keys, "left_anti").unionByName(wrong))
    final = ", ".join(f"{f} {t}" for f, t in points.select("path_id", "sub_id", "pos", "x", "y").dtypes)
    return points.join(ins, keys).groupBy(*keys).applyInPandas(fold(True), final)


def assemble_primitives(ops: DataFrame, gap: float = 0.01, tol: float = 0.01) -> DataFrame:
    """One row per subpath of at least two points: type, size, box, area.

    Areas sum the shoelace over consecutive kept points; paths are cut into blocks, so a
    path of any length is summed side by side.  Only points near others are ever rows of their own.
    """
    pieces = written(split_subpaths(ops, gap, tol), "pieces")
    rows = ["path_id", "sub_id", "seq", "closes", "n", "bx0", "by0", "bx1", "by1", "s", "a", "z"]
    calm = pieces.filter(~F.col("busy")).select(*rows)
    folded = calm.unionByName(thinned_pieces(pieces, tol).select(*rows))
    # Consecutive pieces within a block, then one row per block across its edges.
    keys = ["path_id", "sub_id"]
    inner = Window.partitionBy(*keys, "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    def fold(df: DataFrame, by: list[str], order: str, near: Window) -> DataFrame:
        edge = between(F.last("z", ignorenulls=True).over(near), F.col("a"))
        filled = F.when(F.col("n") > 0, F.col(order))
        return df.withColumn("_e", edge).groupBy(*by).agg(
            F.max("closes").alias("closes"), F.sum("n").alias("n"),
            F.min("bx0").alias("bx0"), F.min("by0").alias("by0"),
            F.max("bx1").alias("bx1"), F.max("by1").alias("by1"),
            (F.coalesce(F.sum("s"), F.lit(0.0)) + F.coalesce(F.sum("_e"), F.lit(0.0))).alias("s"),
            F.min_by("a", filled).alias("a"), F.max_by("z", filled).alias("z"),
        )

    blocks = fold(folded.withColumn("_block", block_of("seq")), [*keys, "_block"], "seq", inner)
    prims = fold(blocks, keys, "_block", outer).filter("n >= 2")
    kind = g.primitive_type(F.col("n"), F.col("closes"))
    return prims.select(
        *keys, kind.alias("type"), F.col("n").alias("n_points"), F.col("closes").alias("closed"),
        "bx0", "by0", "bx1", "by1",
        F.when(
            F.col("closes") & (F.col("n") >= 3), F.abs(F.col("s") + between(F.col("z"), F.col("a"))) / 2
        ).alias("area"),
    )


def thinned_pieces(pieces: DataFrame, tol: float) -> DataFrame:
    """Busy pieces as they are after thinning, with the columns of the others.

    A run of near points may start with the last point of an earlier piece; that point stays in
    any case and only leads the run here.
    """
    busy = pieces.filter("busy")
    points = busy.select("path_id", "sub_id", F.inline("pts"))
    opened = busy.select("path_id", F.get("pts", F.lit(0)).alias("p")).filter("p.near")
    opened = opened.select("path_id", F.col("p.island").alias("island")).distinct()
    heads = pieces.filter(~F.col("busy") & (F.col("n") > 0)).select(
        "path_id", "sub_id", "z.x", "z.y", "end.pos", "end.island", F.lit(False).alias("near")
    ).join(opened, ["path_id", "island"], "left_semi")
    points = cut_lineage(points.unionByName(heads))  # read by three branches
    kept = thin_points(points, tol).withColumn("seq", F.floor(F.col("pos") / SLOTS).cast("long"))
    keys = ["path_id", "sub_id", "seq"]
    near = Window.partitionBy(*keys).orderBy("pos")  # at most SLOTS points
    at = F.struct("x", "y")
    sums = (
        kept.join(busy.select("path_id", "seq"), ["path_id", "seq"], "left_semi")
        .withColumn("_c", F.lag("x").over(near) * F.col("y") - F.col("x") * F.lag("y").over(near))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("x").alias("bx0"), F.min("y").alias("by0"),
            F.max("x").alias("bx1"), F.max("y").alias("by1"),
            F.coalesce(F.sum("_c"), F.lit(0.0)).alias("s"),
            F.min_by(at, "pos").alias("a"), F.max_by(at, "pos").alias("z"),
        )
    )
    return busy.select(*keys, "closes").join(sums, keys, "left").fillna(0, ["n"])


def polygon_facts(points: DataFrame) -> DataFrame:
    """Per primitive of a dense point table: count, box, absolute shoelace area."""
    w = Window.partitionBy("prim_id", "_block").orderBy("seq")
    turned = with_halo(points, "seq", before=1).withColumn(
        "_cross", F.lag("x").over(w) * F.col("y") - F.col("x") * F.lag("y").over(w)
    )
    at = F.struct("x", "y")
    return (
        turned.filter(~F.col("_halo"))
        .groupBy("prim_id")
        .agg(
            F.first("closed").alias("closed"),
            F.count(F.lit(1)).alias("n_points"),
            F.min("x").alias("bx0"), F.min("y").alias("by0"),
            F.max("x").alias("bx1"), F.max("y").alias("by1"),
            F.sum("_cross").alias("_s"),
            F.min_by(at, "seq").alias("_a"),
            F.max_by(at, "seq").alias("_z"),
        )
        .withColumn(
            "area",
            F.when(
                F.col("closed") & (F.col("n_points") >= 3),
                F.abs(
                    F.coalesce("_s", F.lit(0.0))
                    + F.col("_z.x") * F.col("_a.y") - F.col("_a.x") * F.col("_z.y")
                ) / 2,
            ),
        )
        .withColumn("type", g.primitive_type(F.col("n_points"), F.col("closed")))
        .drop("_s", "_a", "_z")
    )
