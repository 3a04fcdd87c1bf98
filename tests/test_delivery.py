"""The representation ladder and what is delivered, on hand-made attempts."""

from pyspark.sql import functions as F

from sheetlake.operators import delivery

SCHEMA = "source_id long, requested string, attempted string, outcome string, handle string, ord long"


def ladder(spark, rows):
    made = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA)
    made = made.withColumns({"doc_id": F.lit(0).cast("long"), "page": F.lit(1).cast("long")})
    return delivery.representation_ladder(made)


def test_ladder(spark):
    rows = [
        (1, "text", "text", "impossible", "a"),  # two rungs were never tried
        (2, "text", "text", "impossible", "a"), (2, "text", "glyphs", "impossible", "b"),
        (2, "text", "geometry", "impossible", "c"),  # all tried, nothing drawn
        (3, "text", "text", "impossible", "a"), (3, "text", "glyphs", "impossible", "b"),
        (3, "text", "geometry", "impossible", "c"), (3, "text", "raster", "verified", "r3"),
        (4, "raster", "raster", "verified", "r4"), (5, "raster", "raster", "failed", "r5"),
        (6, "labels", "labels", "impossible", "a"), (6, "labels", "text", "verified", "t6"),
        (7, "labels", "labels", "failed", "a"), (7, "labels", "text", "verified", "t7"),
        (8, "text", "text", "impossible", "a"), (8, "text", "text", "impossible", "a"), (8, "text", "glyphs", "impossible", "b"),
    ]
    got = {r.source_id: (r.final, r.verified, r.terminal, r.handle) for r in ladder(spark, rows).collect()}
    assert got == {
        1: (None, False, False, None), 2: ("raster", False, True, None), 3: ("raster", True, True, "r3"),
        4: ("raster", True, True, "r4"), 5: ("raster", False, True, None), 6: ("text", True, False, "t6"),
        7: (None, False, False, None), 8: (None, False, False, None),
    }


def test_summary_and_failures(spark):
    rows = [(1, "raster", "raster", "verified", "r"), (2, "text", "text", "failed", "t"), (3, "text", "text", "failed", "t")]
    sent = ladder(spark, rows)
    summary = delivery.delivery_summary(sent, ["doc_id"]).first()
    assert (summary.items, summary.failed, summary.entities, summary.delivered) == (3, 2, 1, "raster")
    assert sorted(r.source_id for r in delivery.delivery_failures(sent, ["doc_id"]).collect()) == [2, 3]


def test_every_bucket_counts(spark):
    sent = ladder(spark, [(k, "raster", "raster", "verified", f"h{k}") for k in range(12)])
    names = F.array(*[F.lit(b) for b in delivery.BUCKET_TYPES])
    row = delivery.entity_type_rollup(sent.withColumn("bucket", F.get(names, F.col("source_id").cast("int"))), ["doc_id"]).first()
    assert [row[b] for b in delivery.BUCKET_TYPES] == [1] * 12
    assert row.total == 11 and row.entity_type == "mixed" and row.font_rendered
    plain = delivery.entity_type_rollup(sent, ["doc_id"]).first()
    assert plain.raster_image == 12 and plain.entity_type == "raster"
