"""Intermediate tables in the shared folder, and small helpers of the llm operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlake.plans.scale import ensure_checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: lineage ends here.

    Lost executors cost only tasks, not earlier stages.  The folder is the one the session names in
    ``spark.checkpoint.dir``; see ``ensure_checkpoint_dir``.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a table made by ``stored`` that no later plan reads."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/table-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Give executors this package through Spark's own file server, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_sheetlake_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "sheetlake.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._sheetlake_shipped = True


def arrow_map(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``mapInArrow`` with a function of this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


#: Size of a bit filter: 16 MB, whatever the input.
FILTER_BITS = 1 << 27
_BLOCK = 32768


def bit_filter(keys: DataFrame, bits: int = FILTER_BITS):
    """A broadcast bit table of a long column ``key``, for tasks to pass over rows that can't match.

    A key whose bit is clear is not among ``keys``.  The table has ``bits`` bits; when it fills up fewer
    rows are passed over, and results stay the same, since a join decides.
    """
    cell = F.pmod(F.col("key"), F.lit(bits))
    blocks = keys.groupBy(F.floor(cell / _BLOCK).cast("int").alias("block")).agg(
        F.bitmap_construct_agg(cell % _BLOCK).alias("bitmap")
    )
    table = np.zeros((bits // _BLOCK, _BLOCK // 8), np.uint8)
    for block, bitmap in blocks.collect():  # bits / 8 bytes in all
        table[block] = np.frombuffer(bytes(bitmap), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table.reshape(-1))


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys have their bit set in a bit filter's table."""
    cell = keys.view(np.int64) & np.int64(len(table) * 8 - 1)
    return (table[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
