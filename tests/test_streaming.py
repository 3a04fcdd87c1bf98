"""Streams against the same job on the whole table."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sheetlake.operators import page_rules
from sheetlake.plans.views import Corpus
from sheetlake.sources.corpus import SCHEMAS, conform
from sheetlake.streaming import jobs

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def drain(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_pages_stream_equals_batch(spark, tmp_path):
    prims = conform(Corpus(spark, SF).prims(), "primitives")
    prims.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = jobs.page_stream(spark, str(tmp_path / "in"), SCHEMAS["primitives"], 2)
    q = jobs.stream_pages(
        stream, str(tmp_path / "out"), str(tmp_path / "cp"),
        lambda b: page_rules.prune_stats(b, 4.5),
    )
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/pages")).select("batch").distinct().count() == 3
    assert rows(jobs.read_pages(spark, str(tmp_path / "out"))) == rows(page_rules.prune_stats(prims, 4.5))


def test_windows_and_sessions(spark, tmp_path):
    events = Corpus(spark, SF).events().withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    drain(jobs.stream_stage_timing(stream, "1 hour"), "t_win", "update")
    got = spark.table("t_win").withColumn("ms", F.round("ms", 3))
    want = jobs.stream_stage_timing(events, "1 hour").withColumn("ms", F.round("ms", 3))
    assert rows(got) == rows(want)
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    drain(jobs.over_budget_totals(stream, 100.0), "t_over", "complete")
    want = jobs.over_budget_totals(events, 100.0)
    assert sorted(r.run_id for r in spark.table("t_over").collect()) == sorted(r.run_id for r in want.collect())
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    drain(jobs.stream_sessions(stream, "1 hour", "1 hour"), "t_sess", "append")
    closed = {(r.run_id, r.session_start): r.events for r in spark.table("t_sess").collect()}
    whole = {(r.run_id, r.session_start): r.events for r in jobs.stream_sessions(events, "1 hour").collect()}
    assert closed and all(whole[k] == n for k, n in closed.items())


def test_resume_certifies_once(spark, tmp_path):
    schema = "source_sha string, options_sha string, page long, entities long"
    land, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")

    def batch(pages):
        spark.createDataFrame([("s", "o", p, p * 10) for p in pages], schema).coalesce(1).write.mode("append").parquet(land)

    def run():
        stream = spark.readStream.schema(schema).parquet(land)
        jobs.stream_resume(stream, ledger, str(tmp_path / "cp"), "s", "o").awaitTermination()

    batch([1, 2])
    run()
    batch([2, 3, 3])
    run()
    run()
    assert sorted(r.page for r in spark.read.parquet(ledger).collect()) == [1, 2, 3]
    spark.createDataFrame([("other", "o", 99, 1)], schema).write.mode("append").parquet(land)
    with pytest.raises(StreamingQueryException, match="another source"):
        run()
    assert sorted(r.page for r in spark.read.parquet(ledger).collect()) == [1, 2, 3]


def test_a_broken_ledger_is_an_error(spark, tmp_path):
    assert jobs.read_ledger(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        jobs.read_ledger(spark, str(tmp_path / "bad")).collect()
