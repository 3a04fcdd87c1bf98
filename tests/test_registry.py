"""Registered queries: complete, equal to their SQL, and independent of the partition count."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import TABLES, canon  # noqa: E402

from sheetlake.oracles import ORACLES  # noqa: E402
from sheetlake.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "place_on_model", "style_profile", "dimension_facts", "redaction_report", "page_content_class",
    "import_bounds", "document_summary", "promote_arcs", "parallel_pairs", "raster_compare",
    "representation_ladder", "fallback_transitions", "member_intent", "set_digest", "limit_breaches",
)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.queries()) >= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), cols)


@pytest.mark.parametrize("name", ("page_profile", "hatch_groups", "merge_fractions", "page_progress"))
def test_partition_count_does_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = entry.queries()[name](spark, SF)
            results.append(canon([tuple(r) for r in df.collect()], df.columns))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
