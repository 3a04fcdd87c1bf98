"""Fits, promotion, path assembly and fills on known shapes."""

import math
import random

import pytest

from sheetlake.operators import assemble, fractions, shapes

OPS = ("path_id long, seq long, op string, x0 double, y0 double, x1 double, y1 double, "
       "c1x double, c1y double, c2x double, c2y double")


def ring(prim, n, r, span, closed):
    pts = []
    for k in range(n):
        a = math.radians(span * k / (n - 1))
        pts.append((prim, k, 100 + r * math.cos(a), 50 + r * math.sin(a), closed))
    return pts


def test_promotion(spark):
    rows = ring(1, 24, 10, 360, True) + ring(2, 12, 20, 90, False) + [
        (3, i, float(i * i), float(i % 2 * 9), False) for i in range(8)
    ]
    pts = spark.createDataFrame(rows, "prim_id long, seq long, x double, y double, closed boolean")
    heads = pts.filter("seq = 0").select("prim_id", "closed")
    for variant in ("strict", "loose"):
        got = {r.prim_id: r for r in shapes.promote_arcs(heads, pts, variant=variant).collect()}
        assert got[1].type == "circle" and got[1].r == pytest.approx(10)
        assert got[2].type == "arc" and got[2].cx == pytest.approx(100)
        assert got[2].end_deg == pytest.approx(90)
        assert min(got[2].start_deg, 360 - got[2].start_deg) < 1e-6
        assert 3 not in got
    shape = {r.prim_id: r for r in shapes.run_shape(pts).collect()}
    assert shape[2].smooth and shape[2].curved and shape[2].minor_sweep
    assert 3 not in shape or not shape[3].smooth


def test_paths(spark):
    n = None
    rows = [
        (1, 0, "m", 0.0, 0.0, 0.0, 0.0, n, n, n, n),
        (1, 1, "l", n, n, 10.0, 0.0, n, n, n, n),
        (1, 2, "l", n, n, 10.0, 0.005, n, n, n, n),  # within the thinning tolerance
        (1, 3, "l", n, n, 10.0, 10.0, n, n, n, n),
        (1, 4, "h", n, n, n, n, n, n, n, n),
        (1, 5, "re", 0.0, 0.0, 4.0, 3.0, n, n, n, n),
        (1, 6, "l", 50.0, 50.0, 60.0, 50.0, n, n, n, n),
        (1, 7, "l", 80.0, 50.0, 90.0, 50.0, n, n, n, n),  # a jump opens another subpath
        (1, 8, "c", 90.0, 50.0, 92.0, 50.0, 90.5, 52.0, 91.5, 52.0),
    ]
    got = {r.sub_id: r for r in assemble.assemble_primitives(spark.createDataFrame(rows, OPS)).collect()}
    assert [got[k].type for k in sorted(got)] == ["closed_loop", "closed_loop", "line", "polyline"]
    assert got[1].n_points == 3 and got[1].area == pytest.approx(50)
    assert got[2].n_points == 5 and got[2].area == pytest.approx(12)
    assert got[4].n_points == 2 + 4


def test_fills(spark):
    shapes_in = {
        1: [(0, 0), (4, 0), (4, 3)],
        2: [(0, 0), (4, 0), (8, 0)],
        3: [(0, 0), (4, 0), (4, 3), (4, 0)],
        4: [(0, 0), (4, 0), (4, 0), (0, 0)],
    }
    rows = [(k, i, float(x), float(y), True) for k, ps in shapes_in.items() for i, (x, y) in enumerate(ps)]
    pts = spark.createDataFrame(rows, "prim_id long, seq long, x double, y double, closed boolean")
    got = {r.prim_id: r.visible for r in shapes.visible_fill(pts).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def fraction_rows(items):
    """Texts and characters of (id, text, x, y, laid_out)."""
    texts = [(0, 1, i, i, t, x, y, 2.5, 0.0, "F", ok) for i, t, x, y, ok in items]
    chars = [(i, k, c, x + k * 1.2, y) for i, t, x, y, ok in items if ok for k, c in enumerate(t)]
    return texts, chars


@pytest.mark.parametrize(
    ("items", "want"),
    [
        ([(1, "7", 0, 2, True), (2, "/", 0, 0, True), (3, "8", 0, -2, True)], ["7/8"]),
        ([(1, "716", -0.5, 0.0, True), (2, "/", 0.3, 0, True)], ["7/16"]),
        ([(1, "3", -3, 0, True), (2, "/", 0, 0, True), (3, "8", 3, 0, True), (4, "5", -3, 0.5, True)],
         ["3", "/", "5", "8"]),
        ([(1, "7", 0, 2, False), (2, "/", 0, 0, True), (3, "8", 0, -2, True)], ["/", "7", "8"]),
        ([(1, "7", 0, 2, True), (2, "/", 0, 0, True), (3, "8", 0, -2, True), (4, "7", 0, 2, True),
          (5, "8", 0, -2, True)], ["7/8"]),
    ],
)
def test_fractions(spark, items, want):
    texts, chars = fraction_rows([(i, t, float(x), float(y), ok) for i, t, x, y, ok in items])
    t = spark.createDataFrame(
        texts, "doc_id long, page long, text_id long, ord long, text string, ix double, iy double, "
        "font_size double, rotation double, font_name string, laid_out boolean")
    ch = spark.createDataFrame(chars, "text_id long, idx int, ch string, x double, y double")
    rows = fractions.merge_fractions(t, ch).orderBy("new_id").collect()
    assert sorted(r.text for r in rows) == sorted(want)
    assert [r.new_id for r in rows] == list(range(1, len(rows) + 1))


def test_one_primitive_larger_than_a_block(spark):
    from pyspark.sql import functions as F

    n = 150_000
    a = F.radians(F.col("id") * (360.0 / (n - 1)))
    pts = spark.range(n).select(
        F.lit(1).cast("long").alias("prim_id"), F.col("id").alias("seq"),
        (100 + 10 * F.cos(a)).alias("x"), (50 + 10 * F.sin(a)).alias("y"), F.lit(True).alias("closed"),
    )
    row = shapes.fit_residuals(pts).first()
    assert row.n == n and row.r == pytest.approx(10, abs=1e-6)
    shape = shapes.run_shape(pts).first()
    assert shape.span == pytest.approx(360) and shape.length == pytest.approx(20 * math.pi, abs=1e-4)
    assert shapes.promote_arcs(pts.limit(1).select("prim_id", "closed"), pts).first().type == "circle"
    facts = assemble.polygon_facts(pts).first()
    assert facts.area == pytest.approx(100 * math.pi, abs=1e-3)
    assert shapes.visible_fill(pts).first().visible


def test_one_path_larger_than_a_block(spark):
    from pyspark.sql import functions as F

    n = 70_000
    k = F.col("id")
    ops = spark.range(n).select(
        F.lit(1).cast("long").alias("path_id"), k.alias("seq"),
        F.when(k == 0, "m").when(k == n - 1, "h").otherwise("l").alias("op"),
        *[F.lit(None).cast("double").alias(c) for c in ("x0", "y0")],
        (k * 1.0).alias("x1"), F.when(k == n - 2, 1000.0).otherwise(0.0).alias("y1"),
        *[F.lit(None).cast("double").alias(c) for c in ("c1x", "c1y", "c2x", "c2y")],
    )
    row = assemble.assemble_primitives(ops).first()
    assert row.n_points == n - 1 and row.closed
    assert row.area == pytest.approx((n - 3) * 1000.0 / 2)


def test_generated_points_are_never_broadcast(spark):
    """Points made by a generator look as few as their source rows; none may pass the driver."""
    source = spark.range(1, 40).selectExpr("id AS prim_id", "id % 3 = 0 AS closed")
    pts = source.selectExpr("*", "explode(sequence(0L, 7L + prim_id % 5)) AS seq").selectExpr(
        "*", "10 * cos(seq * 0.5) AS x", "10 * sin(seq * 0.5) AS y"
    )
    heads = pts.filter("seq = 0").select("prim_id", "closed")
    given = heads.selectExpr("-prim_id AS prim_id", "1D AS cx", "1D AS cy", "5D AS radius")
    for made in (
        shapes.fit_residuals(pts), shapes.run_shape(pts), shapes.promote_arcs(heads, pts),
        shapes.promote_arcs(heads, pts, variant="loose"),
        shapes.visible_fill(pts.filter("closed")), shapes.find_circles(given, heads.select("prim_id"), pts, 0.25),
    ):
        assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
    fits = shapes.fit_residuals(pts).collect()
    assert len(fits) == 39 and all(r.rms < 1e-6 and r.r == pytest.approx(10) for r in fits)


def test_only_points_near_others_become_rows(spark):
    """Runs of near points that start in an earlier operator; everything else is folded where it is made."""
    rng, rows, want = random.Random(5), [], {}
    for path in range(12):
        x = y = 0.0
        kept = [(x, y)]
        rows.append((path, 0, "m", x, y, x, y) + (None,) * 4)
        for k in range(1, 40):
            step = rng.choice((0.0, 0.004, 0.008, 0.015, 5.0)) if path % 3 else 5.0
            x, y = x + step, y + (1.0 if step == 5.0 and k % 2 else 0.0)
            rows.append((path, k, "l", None, None, x, y) + (None,) * 4)
            if math.hypot(kept[-1][0] - x, kept[-1][1] - y) > 0.01:
                kept.append((x, y))
        rows.append((path, 40, "h") + (None,) * 8)
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(kept, kept[1:] + kept[:1], strict=True))
        want[path] = (len(kept), round(abs(area) / 2, 6))
    ops = spark.createDataFrame(rows, OPS)
    got = {r.path_id: (r.n_points, round(r.area, 6)) for r in assemble.assemble_primitives(ops).collect()}
    assert got == want
    pieces = assemble.split_subpaths(ops.filter("path_id % 3 = 0"))
    assert pieces.count() == 4 and not pieces.filter("pts is not null").count()
