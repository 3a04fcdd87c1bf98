"""Paints, line types, rescaling and quadrilaterals on hand-made rows."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sheetlake.functions import style as st
from sheetlake.operators import assemble, delivery, style_jobs


def test_colours(spark):
    rows = [
        (0x336699, None, (0x33 / 255, 0x66 / 255, 0x99 / 255)), (-5, [0.5], None), (None, [0.25], (0.25, 0.25, 0.25)),
        (None, [2.0, -1.0, 0.5], (1.0, 0.0, 0.5)), (None, [0.5, 0.25, 0.0, 0.5], (0.25, 0.375, 0.5)),
        (None, [], (0.0, 0.0, 0.0)), (None, [0.5, 0.25], (0.5, 0.25, 0.25)), (None, None, None),
        (0x1FF0000, None, (1.0, 0.0, 0.0)),
    ]
    df = spark.createDataFrame([(i, p, v) for i, (p, v, _) in enumerate(rows)], "i int, p long, v array<double>")
    got = {r.i: r.c for r in df.select("i", st.normalize_color(F.col("p"), F.col("v")).alias("c")).collect()}
    for i, (_, _, want) in enumerate(rows):
        assert (got[i] is None) == (want is None), i
        if want:
            assert tuple(got[i]) == pytest.approx(want), i


def test_paint_use(spark):
    strokes = spark.createDataFrame(
        [(1, 0, None, 0.5), (1, 0, None, 0.5), (1, 0, None, None), (1, 0, None, float("nan")), (1, 0, None, -1.0), (1, -1, None, 0.5)],
        "doc_id long, packed long, parts array<double>, opacity double",
    )
    spans = spark.createDataFrame(
        [(1, 0, 0, 16), (1, 0, 0, 4), (1, 0, 255, None), (1, 0, None, 16)], "doc_id long, packed long, alpha int, flags int"
    )
    got = {(r.kind, r.r): r.n for r in style_jobs.paint_use(strokes, spans).collect()}
    assert got == {("stroke", 128): 2, ("stroke", 0): 2, ("stroke", 255): 1, ("stroke", None): 1, ("text", 255): 1, ("text", 0): 3}
    assert style_jobs.paint_use(strokes.limit(0), spans.limit(0)).count() == 0


def test_plain_linetypes(spark):
    df = spark.createDataFrame([(1, d) for d in ("[3] 0", "[1 4] 0", "[1 1] 0", "[0 1] 0", "", "x", None)], "doc_id long, dash string")
    got = {r.linetype: r.n for r in style_jobs.plain_linetypes(df).collect()}
    assert got == {"DASHED": 2, "CENTER": 1, "DOTTED": 1, "CONTINUOUS": 3}


def test_uniform_scale_reaches_nested_numbers(spark):
    row = spark.range(1).select(
        F.lit("a").alias("name"), F.lit(2.0).alias("r"), F.lit(3.0).alias("area"), F.lit(None).cast("double").alias("none"),
        F.array(F.struct(F.array(F.struct(F.lit(1.0).alias("x"), F.lit(None).cast("double").alias("y"))).alias("quad"), F.lit("c").alias("ch"))).alias("chars"),
        F.create_map(F.lit("k"), F.lit(4.0)).alias("m"),
    )
    got = style_jobs.uniform_scale(row, 3.0, ["r", "none", "chars", "m"], ["area"]).first()
    assert (got.name, got.r, got.area, got.none, got.m) == ("a", 6.0, 27.0, None, {"k": 12.0})
    assert got.chars[0].quad[0].x == 3.0 and got.chars[0].quad[0].y is None and got.chars[0].ch == "c"
    for bad in (0.0, -1.0, float("nan")):
        with pytest.raises(ValueError):
            style_jobs.uniform_scale(row, bad, ["r"])


def test_quadrilateral_is_a_closed_loop(spark):
    cols = "path_id long, seq long, op string, x0 double, y0 double, x1 double, y1 double, c1x double, c1y double, c2x double, c2y double"
    df = spark.createDataFrame([
        (1, 0, "qu", 0.0, 0.0, 4.0, 3.0, 4.0, 0.0, 0.0, 3.0), (1, 1, "l", None, None, 9.0, 9.0, None, None, None, None),
        (1, 2, "l", None, None, 9.0, 12.0, None, None, None, None),
    ], cols)
    got = assemble.assemble_primitives(df).orderBy("sub_id").collect()
    assert [(r.type, r.n_points, r.area) for r in got] == [("closed_loop", 5, 12.0), ("line", 2, None)]


def test_session_manifest(spark):
    objects = spark.createDataFrame(
        [(1, f"o{i}", 1, "text_span", "dxf_text" if i % 2 else "raster_image", f"h{i}", "text", "" if i % 2 else "why") for i in range(9)],
        "session long, object_id string, page long, source_kind string, created_entity_type string, parent_handle string, selected_text_mode string, fallback_reason string",
    )
    sources = spark.createDataFrame([(1, "a.pdf", "s1", 3), (2, "b.pdf", "s2", 0)], "session long, path string, sha256 string, page_count long")
    one, two = delivery.session_manifest(objects, sources, "importer").orderBy("session").collect()
    assert (one.objects, one.fallbacks, one.entity_types, one.page_count) == (9, 5, 2, 3)
    assert (two.objects, two.fallbacks, two.entity_types, two.page_count, two.objects_sha256) == (0, 0, 0, None, None)
    again = delivery.session_manifest(objects.orderBy(F.desc("object_id")).repartition(3), sources, "importer").orderBy("session").first()
    assert again.objects_sha256 == one.objects_sha256
    other = objects.withColumn("parent_handle", F.when(F.col("object_id") == "o4", "x").otherwise(F.col("parent_handle")))
    assert delivery.session_manifest(other, sources, "importer").orderBy("session").first().objects_sha256 != one.objects_sha256


def test_resume_identity(spark):
    want = spark.createDataFrame([(i, "s", "text", 1.0) for i in range(4)], "session long, source_sha string, mode string, scale double")
    ledger = spark.createDataFrame([(1, "s", "text", 1.0), (2, "t", "text", 1.0), (3, "s", "text", 1.0), (3, "s", "text", None)], want.schema)
    got = {r.session: r.status for r in delivery.resume_identity(want, ledger, ["mode", "scale"]).collect()}
    assert got == {0: "new", 1: "same", 2: "source", 3: "options"}
    a, b = (delivery.resume_identity(want, ledger, o).orderBy("session").first().options_sha for o in (["mode", "scale"], ["scale", "mode"]))
    assert a == b
    with pytest.raises(PySparkException, match="resume session"):
        delivery.resume_identity(want, ledger, ["mode", "scale"], refuse=True).collect()
