"""Folds that are sequential within a group, cut into blocks."""

import math
import random

import numpy as np
import pytest
from sheetlake.operators import assemble, images, reports, text_jobs


def test_long_near_run_is_thinned_block_by_block(spark):
    rng = random.Random(4)
    x, rows = 0.0, []
    for i in range(20_000):
        x += rng.choice([0.0, 0.002, 0.007, 0.012])
        rows.append((1, 1, 1, i, x, rng.uniform(0, 0.004), i > 0))
    rows += [(2, 1, 1, i, i * 0.006, 0.0, i > 0) for i in range(40)]
    df = spark.createDataFrame(rows, "path_id long, sub_id long, island long, pos long, x double, y double, near boolean")
    want = []
    for path in (1, 2):
        last = None
        for p, _, _, pos, px, py, _ in rows:
            if p == path and (last is None or math.hypot(last[0] - px, last[1] - py) > 0.01):
                want.append((p, pos))
                last = px, py
    got = assemble.thin_points(df, width=4096).select("path_id", "pos").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("batch", [10_000, 700])
def test_alternating_sizes_pass_in_one_scan(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        sizes = [1 if k % 2 == 0 else 10_000 - k // 2 for k in range(10_000)]
        df = spark.createDataFrame([(d, k, s) for k, s in enumerate(sizes) for d in (0, 1)], "doc_id long, ord long, px long")
        room, want = 20_000, {}
        for k, s in enumerate(sizes):
            want[k] = s <= room
            room -= s if want[k] else 0
        rows = images.raster_budget_greedy(df, 20_000).collect()
        assert len(rows) == 20_000
        assert all({r.ord: r.admitted for r in rows if r.doc_id == d} == want for d in (0, 1))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_admit_equals_one_by_one():
    rng = np.random.default_rng(2)
    for _ in range(200):
        px, room = rng.integers(0, 12, rng.integers(0, 30)), int(rng.integers(0, 40))
        fits, left, want = *images.admit(room, px), []
        for x in px.tolist():
            want.append(x <= room)
            room -= x if want[-1] else 0
        assert fits.tolist() == want and left == room


def test_digest_does_not_depend_on_order_or_tasks(spark):
    rows = [(k % 2, f"p{k}", f"h{k}") for k in range(200)]
    files = spark.createDataFrame(rows, "folder long, path string, sha256 string")
    one = {tuple(r) for r in reports.set_digest(files.coalesce(1), ["folder"]).collect()}
    other = {tuple(r) for r in reports.set_digest(files.orderBy("path").repartition(5), ["folder"]).collect()}
    fewer = {tuple(r) for r in reports.set_digest(files.where("path <> 'p7'"), ["folder"]).collect()}
    assert one == other and len(one & fewer) == 1


def test_text_cap_for_large_n(spark, monkeypatch):
    rows = [(0, k % 2, 3 * k, str(k)) for k in range(50)]
    texts = spark.createDataFrame(rows, "doc_id long, page long, ord long, text string")
    want = sorted(map(tuple, text_jobs.text_cap(texts, 5).collect()))
    monkeypatch.setattr(text_jobs, "PUSHED_RANK", 2)
    assert sorted(map(tuple, text_jobs.text_cap(texts, 5).collect())) == want
