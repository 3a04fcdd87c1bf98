"""Streams with state of their own: runs that stop at their budget, pages in request order, a page ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..operators.reports import usable

PAGE = ["doc_id", "page"]
CANCELLED = "cancelled by the progress callback"


# ---- stopping a stream -----------------------------------------------------------------------------------


class StopOnProgress(StreamingQueryListener):
    """Stops one query as soon as ``keep_going`` returns False for the progress of a finished batch.

    What was written stays valid, and a later start from the same checkpoint goes on behind it.
    """

    def __init__(self, query: StreamingQuery, keep_going: Callable[[int, int], bool]) -> None:
        self.query, self.keep_going, self.stopped = query, keep_going, False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        done = event.progress
        if str(done.id) == str(self.query.id) and self.keep_going(done.batchId, done.numInputRows) is False:
            self.stopped = True
            self.query.stop()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def finish(query: StreamingQuery, keep_going: Callable[[int, int], bool] | None = None) -> str:
    """Wait for a query: ``complete``, or ``cancelled`` if the callback or its own batches ended it."""
    streams, listener = SparkSession.active().streams, None
    if keep_going is not None:
        listener = StopOnProgress(query, keep_going)
        streams.addListener(listener)
    try:
        query.awaitTermination()
    except Exception as gone:
        if CANCELLED in str(gone):
            return "cancelled"
        raise
    finally:
        if listener is not None:
            streams.removeListener(listener)
    return "cancelled" if listener is not None and listener.stopped else "complete"


def written(
    stream: DataFrame, out_dir: str, checkpoint: str, cancelled: Callable[[int], bool] | None = None
) -> StreamingQuery:
    """Append a stream to ``out_dir``, one folder a batch; a batch that is replayed overwrites itself.

    ``cancelled`` is asked before each batch.  If it says yes, that batch alone is discarded: the stream
    ends, earlier batches stay, and the next start from the checkpoint takes the batch up again.
    """

    def write(batch: DataFrame, number: int) -> None:
        if cancelled is not None and cancelled(number):
            raise RuntimeError(CANCELLED)
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


# ---- budgets ---------------------------------------------------------------------------------------------

_STOPPED = "run_id bigint, session_start timestamp, stopped_ord bigint, pages bigint, elapsed_ms double"
_RUN_STATE = (
    "run array<bigint>, session array<bigint>, last array<bigint>, pages array<bigint>, elapsed array<double>, "
    "stopped array<boolean>"
)
#: Groups that runs, and documents, are dealt to by hash: a call and a state row each, whatever their number.
BUCKETS = 1024


def _dealt(key: str, buckets: int) -> Column:
    """Bucket of a long key; rows without one have a bucket of their own, -1."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")


def _runs_of(keys: np.ndarray) -> list[np.ndarray]:
    """Row numbers of each distinct key, in the order of the rows."""
    at = np.argsort(keys, kind="stable")
    return np.split(at, np.flatnonzero(np.diff(keys[at])) + 1)


def _spend(ts: np.ndarray, order: np.ndarray, ms: np.ndarray, state: tuple | None, budget: float, idle: int):
    """Rows of one run in time order: the sessions that stop here, and the state after them."""
    rows = np.lexsort((order, ts))
    ts, order, ms = ts[rows], order[rows], ms[rows]
    begun, last, pages, elapsed, stopped = state if state else (int(ts[0]), int(ts[0]), 0, 0.0, False)
    new = np.diff(ts, prepend=last) > idle
    number = np.cumsum(new)
    out = []
    for k in range(int(number[-1]) + 1):
        part = slice(int(np.searchsorted(number, k)), int(np.searchsorted(number, k, "right")))
        if k:  # a pause longer than ``idle``: the run starts anew
            begun, pages, elapsed, stopped = int(ts[part][0]), 0, 0.0, False
        here = ms[part]
        if not len(here):
            continue
        if not stopped:
            total = np.cumsum(np.append(elapsed, here))[1:]
            over = np.flatnonzero(total > budget)
            stopped = bool(len(over))
            taken = int(over[0]) + 1 if stopped else len(here)
            pages, elapsed = pages + taken, float(total[taken - 1])
            if stopped:
                out.append((begun, int(order[part][taken - 1]), pages, elapsed))
        last = int(ts[part][-1])
    return out, (begun, last, pages, elapsed, stopped)


def stream_over_budget(
    events: DataFrame, budget_ms: float, idle: str = "1 hour", delay: str = "10 minutes", buckets: int = BUCKETS
) -> DataFrame:
    """One row per session of a run that passes its budget: where it stopped, and nothing of it afterwards.

    ``events``: run_id, ord, ts, ms, a stream whose rows arrive in time order up to ``delay``.  A run's time adds up in
    order of (ts, ord); rows without a usable time count for nothing.  The event that takes it over the
    budget is the last one counted.  A pause longer than ``idle`` ends a session: what follows is a new
    one.  State is five values a run, kept by ``buckets`` of runs, and goes when the watermark passes the run's
    last event by ``idle``.  Results do not depend on how the events fall into batches or buckets.
    """
    gap = int(pd.Timedelta(idle).value // 1000)

    def spend(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {run: rest for run, *rest in zip(*state.get, strict=True)} if state.exists else {}
        found = []
        if not state.hasTimedOut:
            rows = pd.concat(list(parts))
            runs, us, order, ms = (rows[c].to_numpy() for c in ("run", "us", "ord", "ms"))
            for at in _runs_of(runs):
                run = int(runs[at[0]])
                out, held[run] = _spend(us[at], order[at], ms[at], held.get(run), budget_ms, gap)
                found += [(None if key[0] < 0 else run, *x) for x in out]
        now = state.getCurrentWatermarkMs()
        expires = {run: (after[1] + gap) // 1000 + 1 for run, after in held.items()}
        held = {run: after for run, after in held.items() if expires[run] > now}
        if held:
            state.update(tuple(list(x) for x in zip(*[(run, *after) for run, after in held.items()], strict=True)))
            state.setTimeoutTimestamp(min(expires[run] for run in held))
        elif state.exists:
            state.remove()
        if found:
            out = pd.DataFrame(found, columns=["run_id", "session_start", "stopped_ord", "pages", "elapsed_ms"])
            out["session_start"] = pd.to_datetime(out["session_start"], unit="us")
            yield out

    timed = events.filter(usable(F.col("ms"))).withWatermark("ts", delay)
    rows = timed.select(
        _dealt("run_id", buckets).alias("bucket"), F.coalesce("run_id", F.lit(0)).cast("long").alias("run"),
        "ts", F.unix_micros("ts").alias("us"), "ord", F.col("ms").cast("double").alias("ms"),
    )
    return rows.groupBy("bucket").applyInPandasWithState(
        spend, _STOPPED, _RUN_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


# ---- pages in request order ------------------------------------------------------------------------------


def _fold(batches: Iterator[pa.RecordBatch], measures: list[str]) -> Iterator[pa.RecordBatch]:
    """One row per page of a task's rows: a hot document sends few rows."""
    total: pa.Table | None = None
    for batch in batches:
        here = pa.Table.from_arrays(batch.columns, names=batch.schema.names)
        total = here if total is None else pa.concat_tables([total, here])
        folded = total.group_by(PAGE).aggregate([(c, "sum") for c in ["seen", *measures]])
        total = folded.rename_columns([c.removesuffix("_sum") for c in folded.column_names]).select([*PAGE, "seen", *measures])
    if total is not None:
        yield from total.combine_chunks().to_batches()


def _release(held: dict[int, list[int]], due: int, width: int) -> tuple[list[list[int]], int]:
    """Pages whose turn it is: all those before them are out, and all their rows have come."""
    out = []
    while due in held and held[due][2] >= held[due][1]:
        page, _, _, *values = held.pop(due)
        out.append([due, page, *values[:width]])
        due += 1
    return out, due


def stream_pages_in_order(
    stream: DataFrame, requests: DataFrame, measures: dict[str, Column], buckets: int = BUCKETS
) -> DataFrame:
    """Sums of ``measures`` per requested page, released in request order within each document.

    ``stream``: page rows in any order, a page may be split over batches.  ``requests``: doc_id, page,
    position (1, 2, ... within the document), rows (how many rows the page has).  Rows of pages not
    requested are left out.  A page is released once all its rows have come and every page before it is
    out; until then its sums wait in the document's state, a handful of numbers a page, kept by ``buckets`` of
    documents.  A requested page of which nothing lands holds up those behind it.
    """
    names = list(measures)
    width = len(names)
    rows = stream.select(*PAGE, F.lit(1).cast("long").alias("seen"), *[m.cast("long").alias(n) for n, m in measures.items()])
    schema = ", ".join([f"{c} bigint" for c in [*PAGE, "seen", *names]])
    folded = rows.mapInArrow(lambda b: _fold(b, names), schema)
    asked = folded.join(requests.select(*PAGE, "position", F.col("rows").alias("expected")), PAGE)

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        docs, dues, counts, flat = state.get if state.exists else ([], [], [], [])
        step = 4 + width
        # per document: the position that is due and its held pages, which lie one after the other in the state
        held, at = {}, 0
        for doc, due, n in zip(docs, dues, counts, strict=True):
            held[doc] = (due, {int(flat[k]): [int(x) for x in flat[k + 1 : k + step]] for k in range(at, at + n * step, step)})
            at += n * step
        touched = set()
        for part in parts:
            for row in part[["doc_id", "position", "page", "expected", "seen", *names]].itertuples(index=False):
                doc = int(row[0])
                touched.add(doc)
                page = held.setdefault(doc, (1, {}))[1].setdefault(int(row[1]), [int(row[2]), int(row[3]), 0, *[0] * width])
                page[2:] = [a + int(b) for a, b in zip(page[2:], row[4:], strict=True)]
        out = []
        for doc in touched:
            due, pages = held[doc]
            found, due = _release(pages, due, width)
            held[doc] = (due, pages)
            out += [[doc, *x] for x in found]
        state.update((
            list(held), [due for due, _ in held.values()], [len(pages) for _, pages in held.values()],
            [x for _, pages in held.values() for position, rest in sorted(pages.items()) for x in (position, *rest)],
        ))
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "position", "page", *names])

    return asked.withColumn("bucket", _dealt("doc_id", buckets)).groupBy("bucket").applyInPandasWithState(
        keep, ", ".join(f"{c} bigint" for c in ["doc_id", "position", "page", *names]),
        "doc array<bigint>, due array<bigint>, pages array<bigint>, held array<bigint>", "append", GroupStateTimeout.NoTimeout,
    )


# ---- the ledger ------------------------------------------------------------------------------------------

KEYS = ["source_sha", "options_sha", "page", "digest"]


def ledger_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("source_sha", "options_sha", "page"), F.lit(buckets)).cast("int")


def _by_bucket(rows: DataFrame, buckets: int, parts: int = 32) -> DataFrame:
    """Rows moved once, to where their page is judged and written: a bucket's pages are dealt to ``parts`` tasks at most."""
    part = F.pmod(F.shiftright(F.xxhash64("source_sha", "options_sha", "page"), 32), F.lit(parts)).cast("int")
    return rows.withColumns({"bucket": ledger_bucket(buckets), "part": part}).repartition("bucket", "part")


def _append(rows: DataFrame, folder: str) -> None:
    rows.select(*KEYS, "bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(folder)


def seed_ledger(done: DataFrame, ledger: str, buckets: int = 32) -> None:
    """Write pages that are certified already as a ledger of their own batch."""
    rows = _by_bucket(done.select(*KEYS), buckets).groupBy("bucket", "part", *KEYS).agg(F.count(F.lit(1)))
    _append(rows, f"{ledger}/run=seed/batch=0")


def stream_ledger(
    stream: DataFrame, ledger: str, checkpoint: str, run: str, buckets: int = 32,
    cancelled: Callable[[int], bool] | None = None,
) -> StreamingQuery:
    """Certify each landed page once per (source, options, digest); a ledger serves many sources.

    The ledger is laid out by run, batch and bucket of the key.  A batch looks up the buckets of its own
    pages only, in the key columns only, and writes a folder of its own, so a replay rewrites the same
    rows.  Of different rows of a page the one with the smallest digest counts.  Pages under another
    source or options are other keys: they are certified anew.
    """
    spark = stream.sparkSession

    def certify(batch: DataFrame, number: int) -> None:
        if cancelled is not None and cancelled(number):
            raise RuntimeError(CANCELLED)
        rows = batch.select(*KEYS, F.lit(True).alias("asked"))
        touched = [r[0] for r in batch.select(ledger_bucket(buckets).alias("bucket")).distinct().collect()]  # `buckets` numbers at most
        done = read_pages_done(spark, ledger)
        if done is not None:
            own = (F.col("run") == run) & (F.col("batch") == number)
            known = done.filter(F.col("bucket").isin(touched) & ~own)
            rows = rows.unionByName(known.select(*KEYS, F.lit(False).alias("asked")))
        # Pages and what is known of them move together once; all that follows happens where they are.
        page = ["bucket", "part", "source_sha", "options_sha", "page"]
        order = Window.partitionBy(*page).orderBy(F.col("digest").isNull(), "digest", "asked")
        judged = _by_bucket(rows, buckets).withColumns({
            "nth": F.sum(F.col("asked").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "before": F.lag(F.struct("digest", "asked")).over(order),
        })
        # the smallest digest asked for counts, and a known one like it stands right before it
        same = F.col("before").isNotNull() & ~F.col("before.asked") & F.col("before.digest").eqNullSafe(F.col("digest"))
        _append(judged.filter(F.col("asked") & (F.col("nth") == 1) & ~same), f"{ledger}/run={run}/batch={number}")

    return (
        stream.writeStream.foreachBatch(certify).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_pages_done(spark: SparkSession, ledger: str) -> DataFrame | None:
    """All certified pages, or None before the first batch; a broken ledger is an error."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    schema = "source_sha string, options_sha string, page bigint, digest string, run string, batch long, bucket int"
    return spark.read.schema(schema).option("basePath", ledger).parquet(ledger)
