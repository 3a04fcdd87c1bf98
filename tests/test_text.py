"""Text rules on hand-made strings."""

import pytest
from pyspark.sql import functions as F

from sheetlake.functions import text as tx
from sheetlake.operators import bom, text_jobs

DIMENSIONS = [
    ('13/16" X 1 1/4" SLOT', "slot", None, 0.95),
    ("Ø7/16", "diameter", 7 / 16 * 25.4, 0.95),
    ("(4) HOLE 3/4", "diameter", 0.75 * 25.4, 0.95),
    ("11'-6 1/2\"", "linear", 138.5 * 25.4, 0.95),
    ("12.5 mm", "linear", 12.5, 0.90),
    ("3 CM", "linear", 30.0, 0.90),
    ('6 7/8"', "linear", 6.875 * 25.4, 0.85),
    ("3/0", "unknown", None, 0.10),
    ("1:50", "scale", None, 0.80),
    ("GENERAL NOTES", "unknown", None, 0.10),
]


def test_dimensions(spark):
    df = spark.createDataFrame([(i, d[0]) for i, d in enumerate(DIMENSIONS)], "i int, t string")
    got = {r.i: r.dim for r in tx.with_dimension(df, F.col("t")).collect()}
    for i, (text, kind, value, conf) in enumerate(DIMENSIONS):
        assert (got[i].kind, got[i].confidence) == (kind, conf), text
        assert (got[i].value is None) == (value is None), text
        if value is not None:
            assert got[i].value == pytest.approx(value), text
    assert got[0].width == pytest.approx(13 / 16 * 25.4)
    assert got[2].quantity == 4


@pytest.mark.parametrize(
    ("text", "factor"),
    [('SCALE: 1/4" = 1\'-0"', 48.0), ("SCALE 1:50", 50.0), ("9:10:47 AM", 1.0), ("DATE 3/14/2024", 1.0),
     ("9:10 PM SCALE 1:20", 20.0)],
)
def test_scales(spark, text, factor):
    texts = spark.createDataFrame(
        [(0, 1, 1, text, text.upper(), 900.0, 100.0)],
        "doc_id long, page long, ord long, text string, normalized string, ix double, iy double",
    )
    pages = spark.createDataFrame([(0, 1, 1000.0, 700.0)], "doc_id long, page long, width double, height double")
    row = text_jobs.resolve_scale(texts, pages).first()
    assert row.factor == pytest.approx(factor)
    assert (row.source == "default") == (factor == 1.0)


def test_small_rules(spark):
    row = spark.range(1).select(
        tx.split_fraction_digits(F.lit("1116"))["num"].alias("n"),
        tx.split_fraction_digits(F.lit("99")).isNull().alias("none"),
        tx.redact_secrets(F.lit('api_key = "abc" and token: \'x\'')).alias("red"),
        tx.text_width_units(F.lit("M1 a")).alias("units"),
        tx.profile_hint(F.lit("W 12 x 30 beam")).alias("hint"),
        F.array_join(tx.text_tags(F.lit("SEE DETAIL A 1:50"), F.lit("SEE DETAIL A 1:50")), ",").alias("tags"),
        tx.clip_head_tail(F.lit("a\nb\nc\nd\ne\n"), 4, 2, 1)["text"].alias("clip"),
        tx.text_angle(F.lit(-90.0)).alias("angle"),
    ).first()
    assert row.n == 11 and row.none
    assert row.red == "api_key = \"<REDACTED>\" and token: '<REDACTED>'"
    assert row.units == pytest.approx(0.95 + 0.55 + 0.30 + 0.65)
    assert row.hint == "W12X30"
    assert set(row.tags.split(",")) == {"scale_like", "detail_reference", "label_like"}
    assert row.clip == "a\nb\n\n# ... SNIPPED ...\n\ne"
    assert row.angle == 90.0


def test_bill_of_material_rows(spark):
    lines = ["BILL OF MATERIAL", "b101", "2", "W12X30", "12'-6", "350.5", "GALV", "A992",
             "b102", "1", "L2X2X1/4", "3'-0", "b103", "4", "C6X8.2", "1'-0"]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(lines)], "doc_id long, ord long, text string")
    rows = bom.bom_sequence_rows(df).orderBy("line_start").collect()
    assert [r.piece_mark for r in rows] == ["b101", "b102", "b103"]
    assert (rows[0].total_weight, rows[0].remarks, rows[0].grade) == (350.5, "GALV", "A992")
    assert (rows[1].remarks, rows[1].grade, rows[1].length_in) == (None, None, 36.0)
