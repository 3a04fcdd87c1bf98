"""Structured Streaming jobs: page intake, timing windows, sessions, resume.  Stateful ones are in ``stateful``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reports import usable

PAGE = ["doc_id", "page"]


def page_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """Landed page tables as a stream with a bounded number of files per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_pages(
    stream: DataFrame, out_dir: str, checkpoint: str, op: Callable[[DataFrame], DataFrame], buckets: int = 64
) -> StreamingQuery:
    """Apply ``op`` to every page that a batch touched, over all rows of the page landed so far.

    Rows are kept in ``out_dir/rows``, dealt over folders by page, so that a page split over several
    batches is worked on whole and a batch reads the folders of its own pages only.  Results go to
    ``out_dir/pages``; ``read_pages`` gives the last one of each page.  Batch numbers are part of the
    paths, so a batch that is replayed after a failure overwrites itself.
    """
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(*PAGE), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("_bucket", bucket)
        batch.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(
            f"{out_dir}/rows/_batch={number}"
        )
        touched = [r[0] for r in batch.select("_bucket").distinct().collect()]  # `buckets` numbers at most
        pages = batch.select(*PAGE).distinct()
        landed = spark.read.parquet(f"{out_dir}/rows").filter(F.col("_batch") <= number)
        whole = landed.filter(F.col("_bucket").isin(touched)).join(pages, PAGE, "left_semi")
        op(whole.drop("_batch", "_bucket")).write.mode("overwrite").parquet(f"{out_dir}/pages/batch={number}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_pages(spark: SparkSession, out_dir: str) -> DataFrame:
    """What ``stream_pages`` found for every page, from the last batch that touched it."""
    found = spark.read.parquet(f"{out_dir}/pages")
    last = found.groupBy(*PAGE).agg(F.max("batch").alias("batch"))
    return found.join(last, [*PAGE, "batch"], "left_semi").drop("batch")


def stream_stage_timing(
    events: DataFrame, window: str = "10 minutes", slide: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Stage totals per run and time window; works on batches and streams alike."""
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    win = F.window("ts", window, slide) if slide else F.window("ts", window)
    return timed.filter(usable(F.col("ms"))).groupBy("run_id", "stage", win.alias("w")).agg(
        F.sum("ms").alias("ms"), F.count(F.lit(1)).alias("n")
    ).select("run_id", "stage", F.col("w.start").alias("window_start"), "ms", "n")


def stream_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "30 minutes") -> DataFrame:
    """Sessions of a run: events closer than ``gap`` belong together."""
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    return timed.groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.when(usable(F.col("ms")), F.col("ms"))).alias("ms")
    ).select("run_id", F.col("w.start").alias("session_start"), "events", "ms")


def stream_resume(
    stream: DataFrame, ledger_path: str, checkpoint: str, source_sha: str, options_sha: str
) -> StreamingQuery:
    """Certify each landed page once per (source, options) identity.

    A row of another identity stops the stream.  Every identity has a folder of its own, the only one
    that is read; each batch writes its own folder in it, so a replay rewrites the same rows.
    """
    spark = stream.sparkSession
    own = f"{ledger_path}/source_sha={source_sha}/options_sha={options_sha}"

    def certify(batch: DataFrame, number: int) -> None:
        same = F.col("source_sha").eqNullSafe(F.lit(source_sha)) & F.col("options_sha").eqNullSafe(F.lit(options_sha))
        foreign = batch.filter(~same).select("source_sha", "options_sha").head(1)
        if foreign:
            raise ValueError(f"rows of another source or options: {foreign[0].asDict()}")
        fresh = batch.drop("source_sha", "options_sha").dropDuplicates(["page"])
        done = read_ledger(spark, own)
        if done is not None:
            fresh = fresh.join(done.filter(F.col("batch") != number).select("page"), "page", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{own}/batch={number}")

    return (
        stream.writeStream.foreachBatch(certify).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The certified pages so far, or None before the first batch; a broken ledger is an error."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(path)


def over_budget_totals(events: DataFrame, budget_ms: float) -> DataFrame:
    """Runs whose time so far exceeds the budget; in update mode a run reappears as its total grows."""
    return events.filter(usable(F.col("ms"))).groupBy("run_id").agg(
        F.sum("ms").alias("elapsed_ms"), F.count(F.lit(1)).alias("pages")
    ).filter(F.col("elapsed_ms") > budget_ms)
