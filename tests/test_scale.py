"""Block helpers against plain Python, with blocks small enough to be crossed often."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetlake.plans import scale


def test_halo_gives_the_same_lags_as_one_window(spark):
    df = spark.range(100).select(
        (F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).alias("p"), (F.col("id") * 7 % 11).alias("v")
    )
    whole = Window.partitionBy("k").orderBy("p")
    want = df.select("k", "p", F.lag("v").over(whole).alias("a"), F.lead("v", 2).over(whole).alias("b"))
    block = Window.partitionBy("k", "_block").orderBy("p")
    got = scale.with_halo(df, "p", before=1, after=2, width=4).select(
        "k", "p", "_halo", F.lag("v").over(block).alias("a"), F.lead("v", 2).over(block).alias("b")
    ).filter(~F.col("_halo")).drop("_halo")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_dense_position_and_running_sum(spark):
    rng = random.Random(5)
    rows = [(k, o, rng.randint(0, 9)) for k in (1, 2) for o in sorted(rng.sample(range(500), 60))]
    df = spark.createDataFrame(rows, "k int, o long, v int").repartition(3)
    pos = scale.dense_position(df, ["k"], ["o"], [scale.block_of("o", 16)])
    run = scale.running_sum(df, ["k"], "o", {"s": F.col("v")}, width=16)
    before = scale.running_sum(df, ["k"], "o", {"s": F.col("v")}, width=16, inclusive=False)
    for k in (1, 2):
        mine = [(o, v) for kk, o, v in rows if kk == k]
        assert [(r.o, r.pos) for r in pos.filter(f"k={k}").orderBy("o").collect()] == [
            (o, i) for i, (o, _) in enumerate(mine)
        ]
        total, want, prior = 0, [], []
        for _, v in mine:
            prior.append(total)
            total += v
            want.append(total)
        assert [r.s for r in run.filter(f"k={k}").orderBy("o").collect()] == want
        assert [r.s for r in before.filter(f"k={k}").orderBy("o").collect()] == prior


def test_gap_moments(spark):
    values = [0.0, 0.0, 1.5, 1.5, 4.0, 9.25, 30.0]
    df = spark.createDataFrame([(1, v) for v in values], "k int, v double")
    row = scale.gap_moments(df, ["k"], "v", width=2.0).first()
    gaps = [b - a for a, b in zip(values, values[1:], strict=False)]
    assert row.n == len(values)
    assert abs(row.gap_sum - sum(gaps)) < 1e-9
    assert abs(row.gap_sq - sum(g * g for g in gaps)) < 1e-9


def test_spread_join_keeps_every_row(spark):
    rows = spark.range(200).select(F.lit(1).alias("k"), "id")
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert scale.spread_join(rows, dim, ["k"], "id", salts=8).count() == 200


def test_checkpoint_folder_is_the_named_one(spark, tmp_path):
    sc = spark.sparkContext
    before = sc.getCheckpointDir()
    assert scale.cut_lineage(spark.range(3)).count() == 3
    assert sc.getCheckpointDir() is not None
    assert before is None or sc.getCheckpointDir() == before


def test_dense_position_numbers_rows_once(spark):
    """Run sizes are counted, not read off a second numbering of all rows."""
    df = spark.createDataFrame([(k, v // 3, v) for k in range(3) for v in range(9)], "k long, b long, v long")
    got = scale.dense_position(df, ["k"], ["v"], [F.col("b")])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1
    assert all(r.pos == r.v for r in got.collect())
