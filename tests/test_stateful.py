"""Stateful streams: restarts, order, budgets and ledgers against plain Python."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sheetlake.streaming import stateful

EVENTS = "run_id long, ord long, ts timestamp, ms double"
START = datetime(2024, 1, 1, tzinfo=UTC)


def land(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").parquet(path)


def brute_budget(rows, budget, idle):
    out = []
    runs = {}
    for run, order, ts, ms in sorted(rows, key=lambda r: (r[2], r[1])):
        if ms is None or ms != ms or ms < 0:
            continue
        s = runs.get(run)
        if s is None or ts - s["last"] > idle:
            s = runs[run] = {"begun": ts, "pages": 0, "sum": 0.0, "stopped": False}
        s["last"] = ts
        if not s["stopped"]:
            s["pages"] += 1
            s["sum"] += ms
            if s["sum"] > budget:
                s["stopped"] = True
                out.append((run, s["begun"].timestamp(), order, s["pages"], round(s["sum"], 6)))
    return sorted(out)


def test_runs_stop_at_their_budget_over_restarts(spark, tmp_path):
    rng = random.Random(4)
    ts, rows = START, []
    for k in range(600):
        ts += timedelta(minutes=rng.choice([0, 1, 5, 200 if k % 50 == 0 else 2]))
        rows.append((rng.choice([1, 1, 1, 2, 3, *range(10, 40)]), k, ts, rng.choice([1.0, 5.0, 20.0, -3.0, None, float("nan")])))
    path = str(tmp_path / "in")
    for k in range(4):  # the stream ends and starts again between the landings
        land(spark, rows[150 * k : 150 * k + 150], EVENTS, path)
        stream = spark.readStream.schema(EVENTS).parquet(path)
        over = stateful.stream_over_budget(stream, 60.0, "1 hour", "1 minute")
        query = stateful.written(over, str(tmp_path / "out"), str(tmp_path / "cp"))
        assert stateful.finish(query) == "complete"
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    found = sorted((r.run_id, r.session_start.replace(tzinfo=UTC).timestamp(), r.stopped_ord, r.pages, round(r.elapsed_ms, 6)) for r in got)
    assert found == brute_budget(rows, 60.0, timedelta(hours=1))
    assert len({(r[0], r[1]) for r in found}) == len(found)  # once a session


def test_runs_share_state_rows_by_bucket(spark, tmp_path):
    """As many calls and state rows as buckets, however many runs; rows without a run are a run of their own."""
    path = str(tmp_path / "in")
    rows = [(run, 60 * n + k, START + timedelta(minutes=n), 7.0) for n in range(4) for k, run in enumerate([None, *range(-3, 50)])]
    for k in (0, 1):
        land(spark, rows[108 * k : 108 * k + 108], EVENTS, path)
        over = stateful.stream_over_budget(spark.readStream.schema(EVENTS).parquet(path), 20.0, buckets=3)
        query = stateful.written(over, str(tmp_path / "out"), str(tmp_path / "cp"))
        assert stateful.finish(query) == "complete"
        progress = [p for p in query.recentProgress if p["stateOperators"]]
        assert 0 < progress[-1]["stateOperators"][0]["numRowsTotal"] <= 4
    got = {(r.run_id, r.stopped_ord, r.pages, r.elapsed_ms) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(run, 120 + k, 3, 21.0) for k, run in enumerate([None, *range(-3, 50)])}


def test_state_goes_when_a_run_is_idle(spark, tmp_path):
    path = str(tmp_path / "in")
    for day in range(3):  # another run each day
        land(spark, [(day, k, START + timedelta(days=day, minutes=k), 1.0) for k in range(5)], EVENTS, path)
        stream = spark.readStream.schema(EVENTS).parquet(path)
        query = stateful.written(stateful.stream_over_budget(stream, 99.0), str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination()
        progress = [p for p in query.recentProgress if p["stateOperators"]]
        assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 1


PAGES = "doc_id long, page long, v long"


def test_pages_come_in_request_order(spark, tmp_path):
    rng = random.Random(5)
    wanted = [(d, p, n + 1, rng.choice([0, 1, 3, 9])) for d in range(6) for n, p in enumerate(rng.sample(range(50), 12))]
    rows = [(d, p, rng.randint(0, 9)) for d, p, _, n in wanted for _ in range(n)] + [(0, 99, 1), (9, 1, 1)]
    rng.shuffle(rows)
    requests = spark.createDataFrame(wanted, "doc_id long, page long, position long, rows long")
    # a page without rows is never seen landing, so only pages with rows are asked for here
    requests = requests.filter("rows > 0").withColumn(
        "position", F.expr("row_number() over (partition by doc_id order by position)").cast("long")
    )
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen = {}
    for k in range(4):
        land(spark, rows[k::4], PAGES, path)
        stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(path)
        pages = stateful.stream_pages_in_order(stream, requests, {"total": F.col("v"), "big": (F.col("v") > 5)})
        assert stateful.finish(stateful.written(pages, out, str(tmp_path / "cp"))) == "complete"
        for r in spark.read.parquet(out).orderBy("batch", "doc_id", "position").collect():
            seen.setdefault(r.doc_id, {}).setdefault(r.position, r)
        for doc in seen:  # no page is out before those in front of it
            assert sorted(seen[doc]) == list(range(1, len(seen[doc]) + 1))
    got = sorted((r.doc_id, r.page, r.position, r.total, r.big) for x in seen.values() for r in x.values())
    asked = {(r.doc_id, r.page): r.position for r in requests.collect()}
    assert got == sorted(
        (d, p, at, sum(v for a, b, v in rows if (a, b) == (d, p)), sum(v > 5 for a, b, v in rows if (a, b) == (d, p)))
        for (d, p), at in asked.items()
    )
    batches = {(r.doc_id, r.position): r.batch for r in spark.read.parquet(out).collect()}
    assert all(batches[d, k] <= batches[d, k + 1] for d, k in batches if (d, k + 1) in batches)
    assert len(set(batches.values())) > 2


def test_documents_share_state_rows_by_bucket(spark, tmp_path):
    """As many calls and state rows as buckets, however many documents; their order is kept apart."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs = range(-2, 40)
    requests = spark.createDataFrame([(d, p, p, 2) for d in docs for p in (1, 2)], "doc_id long, page long, position long, rows long")
    # the second page lands first, one half of the first page with it
    for rows in ([(d, p, 1) for d in docs for p in (2, 1, 2)], [(d, 1, 5) for d in docs]):
        land(spark, rows, PAGES, path)
        stream = spark.readStream.schema(PAGES).parquet(path)
        query = stateful.written(
            stateful.stream_pages_in_order(stream, requests, {"total": F.col("v")}, buckets=3), out, str(tmp_path / "cp")
        )
        assert stateful.finish(query) == "complete"
        progress = [p for p in query.recentProgress if p["stateOperators"]]
        assert 0 < progress[-1]["stateOperators"][0]["numRowsTotal"] <= 3
    got = sorted((r.doc_id, r.page, r.position, r.total, r.batch) for r in spark.read.parquet(out).collect())
    assert got == [(d, p, p, 6 if p == 1 else 2, 1) for d in docs for p in (1, 2)]


LANDED = "source_sha string, options_sha string, page long, digest string"


def test_ledger_certifies_once_and_a_cancelled_batch_is_taken_up_again(spark, tmp_path):
    path, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")
    land(spark, [("s", "o", 1, "a"), ("s", "o", 2, "b"), ("t", "o", 1, "a")], LANDED, path)

    def run(name, cancelled=None):
        stream = spark.readStream.schema(LANDED).parquet(path)
        query = stateful.stream_ledger(stream, ledger, str(tmp_path / name), name, buckets=4, cancelled=cancelled)
        return stateful.finish(query)

    def certified(name):
        done = stateful.read_pages_done(spark, ledger).filter(F.col("run") == name)
        return sorted((r.source_sha, r.options_sha, r.page, r.digest) for r in done.collect())

    assert stateful.read_pages_done(spark, ledger) is None
    stateful.seed_ledger(spark.createDataFrame([("s", "o", 2, "b"), ("s", "other", 1, "a")], LANDED), ledger, buckets=4)
    assert run("one") == "complete"
    assert certified("one") == [("s", "o", 1, "a"), ("t", "o", 1, "a")]
    land(spark, [("s", "o", 3, "d"), ("s", "o", 3, "c"), ("s", "o", 1, "new")], LANDED, path)
    assert run("one", cancelled=lambda number: True) == "cancelled"
    assert len(certified("one")) == 2
    assert run("one") == "complete"
    assert certified("one")[:2] == [("s", "o", 1, "a"), ("s", "o", 1, "new")] and ("s", "o", 3, "c") in certified("one")
    assert len(certified("one")) == 4
    assert run("two") == "complete" and certified("two") == []


def test_ledger_moves_each_page_once(spark, tmp_path):
    """One exchange of the pages by bucket serves the fold, the look-up and the write; nulls are keys and digests too."""
    rows = [("s", "o", 1, None), ("s", "o", 1, "b"), (None, "o", 2, None), ("s", None, 3, "x"), ("s", "o", 4, "z")]
    frame = spark.createDataFrame(rows, LANDED)
    plan = stateful._by_bucket(frame, 4).groupBy("bucket", "part", *stateful.KEYS).count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    path, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")
    land(spark, rows, LANDED, path)
    stateful.seed_ledger(spark.createDataFrame([(None, "o", 2, None), ("s", "o", 4, "y")] * 2, LANDED), ledger, buckets=4)
    assert stateful.read_pages_done(spark, ledger).count() == 2
    for name in ("one", "two"):
        stream = spark.readStream.schema(LANDED).parquet(path)
        stateful.finish(stateful.stream_ledger(stream, ledger, str(tmp_path / name), name, buckets=4))
    done = stateful.read_pages_done(spark, ledger).filter("run <> 'seed'").collect()
    assert sorted(((r.run, r.source_sha, r.options_sha, r.page, r.digest) for r in done), key=str) == [
        ("one", "s", "o", 1, "b"), ("one", "s", "o", 4, "z"), ("one", "s", None, 3, "x")
    ]


def test_progress_callback_stops_the_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    for k in range(8):
        spark.createDataFrame([(k, 1, k)], PAGES).coalesce(1).write.mode("append").parquet(path)

    def start():
        stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(path)
        return stateful.written(stream, str(tmp_path / "out"), str(tmp_path / "cp"))

    seen = []
    how = stateful.finish(start(), lambda batch, rows: seen.append(rows) or False)
    assert how in ("cancelled", "complete") and seen
    kept = {r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert stateful.finish(start()) == "complete"
    after = [r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(after) == list(range(8)) and kept <= set(after)


def test_a_failed_batch_is_an_error(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, [(1, 1, 1)], PAGES, path)
    stream = spark.readStream.schema(PAGES).parquet(path).select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        stateful.finish(stateful.written(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
