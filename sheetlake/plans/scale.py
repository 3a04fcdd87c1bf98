"""Helpers that keep plans flat when one key holds a large share of the rows.

The rule behind all of them: a window or a collected list may only span a group
whose size has a bound.  Where an operator needs the order of a whole page,
path, run or document, the group is cut into blocks of its order column, the
blocks are solved side by side, and only one row per block crosses the group.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 65_536


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a scratch folder only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, for tables that a job writes and reads again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table below the shared folder and read it back.

    For wide rows that are read more than once: unlike a checkpoint, columns are packed, and each
    reader takes only those it uses.
    """
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def block_of(position: str | Column, width: int = BLOCK) -> Column:
    """Block number of an integer order column."""
    col = F.col(position) if isinstance(position, str) else position
    return F.floor(col / F.lit(width)).cast("long")


def with_halo(
    df: DataFrame, position: str, before: int = 0, after: int = 0, width: int = BLOCK
) -> DataFrame:
    """Cut a dense order column into blocks that also carry their neighbours' edge rows.

    Adds ``_block`` and ``_halo``.  A window over ``(key, _block)`` then sees up to
    ``before`` preceding and ``after`` following rows across a block edge; rows with
    ``_halo`` true are copies and must be dropped after the window.
    """
    pos = F.col(position)
    block = block_of(position, width)
    inside = F.pmod(pos, F.lit(width))
    homes = [F.struct(block.alias("b"), F.lit(False).alias("h"))]
    if after:
        homes.append(
            F.when(inside < after, F.struct((block - 1).alias("b"), F.lit(True).alias("h")))
        )
    if before:
        homes.append(
            F.when(
                inside >= width - before,
                F.struct((block + 1).alias("b"), F.lit(True).alias("h")),
            )
        )
    spread = F.explode(F.filter(F.array(*homes), lambda s: s.isNotNull()))
    return (
        df.withColumn("_h", spread)
        .withColumn("_block", F.col("_h.b"))
        .withColumn("_halo", F.col("_h.h"))
        .drop("_h")
    )


def dense_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Sequence[Column],
    name: str = "pos",
) -> DataFrame:
    """Zero-based rank of every row within ``keys``, without one task per key.

    ``block`` are columns that split a key into runs and grow with ``order``.
    Rows are numbered inside their run; run sizes are summed per key on one row
    per run; the two are added.
    """
    names = [f"_b{i}" for i in range(len(block))]
    cut = df.withColumns(dict(zip(names, block, strict=True)))
    inner = Window.partitionBy(*keys, *names).orderBy(*order)
    numbered = cut.withColumn("_rn", F.row_number().over(inner))
    # Counted from the rows, not the numbers: that needs no order, and folds before it is moved.
    sizes = cut.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    outer = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn(
        "_start", F.coalesce(F.sum("_n").over(outer), F.lit(0))
    ).drop("_n")
    return (
        numbered.join(starts, [*keys, *names])
        .withColumn(name, (F.col("_start") + F.col("_rn") - 1).cast("long"))
        .drop("_start", "_rn", *names)
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: dict[str, Column],
    width: int = BLOCK,
    inclusive: bool = True,
    keep_block: bool = False,
) -> DataFrame:
    """Running sums per key along an integer order column, block by block.

    ``keep_block`` leaves ``_block`` in, so that a fold per key and block needs no other exchange.

    ``values`` maps the new column to the summed expression.  ``order`` must be
    unique within the key, so a block holds at most ``width`` rows.
    """
    cut = df.withColumn("_block", block_of(order, width))
    inner = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    totals = cut.groupBy(*keys, "_block").agg(
        *[F.sum(v).alias(f"_t_{n}") for n, v in values.items()]
    )
    outer = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *keys,
        "_block",
        *[F.coalesce(F.sum(f"_t_{n}").over(outer), F.lit(0)).alias(f"_s_{n}") for n in values],
    )
    local = cut.withColumns(
        {f"_l_{n}": F.coalesce(F.sum(v).over(inner), F.lit(0)) for n, v in values.items()}
    )
    out = local.join(starts, [*keys, "_block"])
    return out.withColumns({n: F.col(f"_s_{n}") + F.col(f"_l_{n}") for n in values}).drop(
        *([] if keep_block else ["_block"]), *[f"_s_{n}" for n in values], *[f"_l_{n}" for n in values]
    )


def gap_moments(
    df: DataFrame, keys: Sequence[str], value: str, width: float, digits: int = 9
) -> DataFrame:
    """Count, sum and sum of squares of the gaps between sorted values of each key.

    Equal values are folded first (their gap is zero), then the value axis is cut
    into bins of ``width``: gaps inside a bin come from a window over the bin, gaps
    between bins from a window over one row per bin.
    """
    folded = (
        df.withColumn("_v", F.round(value, digits))
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bin", F.floor(F.col("_v") / width).cast("long"))
    )
    inner = Window.partitionBy(*keys, "_bin").orderBy("_v")
    bins = (
        folded.withColumn("_gap", F.col("_v") - F.lag("_v").over(inner))
        .groupBy(*keys, "_bin")
        .agg(
            F.sum("_n").alias("_n"),
            F.min("_v").alias("_lo"),
            F.max("_v").alias("_hi"),
            F.sum(F.col("_gap") * F.col("_gap")).alias("_sq"),
        )
    )
    outer = Window.partitionBy(*keys).orderBy("_bin")
    step = F.col("_lo") - F.lag("_hi").over(outer)
    return (
        bins.withColumn("_step", step)
        .groupBy(*keys)
        .agg(
            F.sum("_n").alias("n"),
            (F.max("_hi") - F.min("_lo")).alias("gap_sum"),
            (
                F.coalesce(F.sum("_sq"), F.lit(0.0))
                + F.coalesce(F.sum(F.col("_step") * F.col("_step")), F.lit(0.0))
            ).alias("gap_sq"),
        )
    )


def cells_between(lo: Column, hi: Column, side: float) -> Column:
    """Array of the grid cells touched by the interval [lo, hi]."""
    return F.sequence(F.floor(lo / side).cast("long"), F.floor(hi / side).cast("long"))


def neighbor_cells(value: Column, side: float) -> Column:
    """The cell of a coordinate and the two beside it."""
    cell = F.floor(value / side).cast("long")
    return F.array(cell - 1, cell, cell + 1)


def spread_join(
    rows: DataFrame, dim: DataFrame, keys: Sequence[str], salt_on: str, salts: int = 16, how: str = "inner"
) -> DataFrame:
    """Join rows to a one-row-per-key table, with each key's rows dealt over ``salts`` tasks.

    For joins whose result is aggregated by the same keys: without the salt the aggregation
    would inherit the join's partitioning and one hot key would stay in one task.  ``salts`` is how
    many tasks a key may take: about its share of all rows times the tasks of the job.  ``how`` may
    be "left"; rows without a key are dealt as well.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.hash(salt_on), F.lit(salts)))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def shuffled_join(
    rows: DataFrame, other: DataFrame, keys: Sequence[str] | str, how: str = "inner"
) -> DataFrame:
    """A join that moves both sides by key and broadcasts neither.

    The optimizer takes generated rows (points, copies per block) for as few as the rows they come
    from; a side of many gigabytes would be sent through the driver to every task.
    """
    return rows.join(other.hint("merge"), keys, how)


def keep_when(df: DataFrame, test: Column) -> DataFrame:
    """A filter the optimizer leaves in place.

    A plain filter on a deeply derived column is pushed to the scan with the whole derivation
    written out again, once per use; behind a generator it reads the finished column.
    """
    once = F.when(test, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return df.withColumn("_keep", F.explode(once)).drop("_keep")
