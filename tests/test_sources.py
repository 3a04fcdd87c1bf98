"""Readers, writers and SQL functions."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sheetlake.functions import sql
from sheetlake.functions import text as tx
from sheetlake.operators import style_jobs
from sheetlake.plans.views import Corpus
from sheetlake.sources import corpus as src

SF = "/root/testdata/sf0.001"


def test_corpus_round_trip_prunes_and_pushes(spark, tmp_path):
    c = Corpus(spark, SF)
    src.conform(c.prims(), "primitives").write.parquet(str(tmp_path / "primitives"))
    for name, df in (
        ("texts", c.texts()), ("pages", c.pages()), ("images", c.images()), ("points", c.points())
    ):
        src.conform(df, name).write.parquet(str(tmp_path / name))
    tables = src.load_corpus(spark, str(tmp_path))
    assert tables["primitives"].count() == c.prims().count()
    plan = tables["primitives"].filter("layer = 'F'").select("prim_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(layer,F)" in text and "ReadSchema: struct<prim_id:bigint,layer:string>" in text


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"junk %PDF-1.7 more")
    (tmp_path / "b.pdf").write_bytes(b"")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.pdf").write_bytes(b"x" * 2000)
    (tmp_path / "n.txt").write_bytes(b"no")
    flat = src.read_files(spark, str(tmp_path))
    assert flat.count() == 2
    deep = src.read_files(spark, str(tmp_path), recursive=True)
    got = {r.path[-5:]: r.status for r in src.precheck_files(deep).collect()}
    assert got == {"a.pdf": "ok", "b.pdf": "empty_file", "c.pdf": "not_a_pdf"}
    sizes = {r.name: (r.size, r.size_label) for r in src.file_inventory(deep).collect()}
    assert sizes["c.pdf"] == (2000, "1.95 KB")


def test_listing_by_tasks(spark, tmp_path):
    for i in range(40):
        folder = tmp_path / f"a {i % 4}" / f"b{i % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{i}.pdf").write_bytes(b"x" * (i % 5))
        (folder / f"_h{i}.pdf").write_bytes(b"")
    (tmp_path / "top.PDF").write_bytes(b"")
    deep = {r.path.removeprefix("file:"): r.size for r in src.list_files(spark, str(tmp_path), "*.pdf", True).collect()}
    want = {str(p): p.stat().st_size for p in tmp_path.rglob("*.pdf") if p.name[0] != "_"}
    assert deep == want and len(want) == 40
    assert [r.path[-7:] for r in src.list_files(spark, str(tmp_path), "*.{PDF,txt}").collect()] == ["top.PDF"]
    files = src.read_files(spark, str(tmp_path), recursive=True)
    assert files.count() == 40 and files.filter("length(content) = 0").count() == 8
    assert src.list_files(spark, str(tmp_path / "a 1"), "*", False).count() == 0


@pytest.mark.parametrize(("glob", "yes", "no"), [
    ("*.pdf", "a.pdf", "a.pdfx"), ("a?[0-9].{txt,md}", "ab3.md", "ab3.pdf"), ("[!x]*", "y1", "x1"), ("a+b", "a+b", "aab"),
])
def test_glob(glob, yes, no):
    import re

    pattern = src.glob_pattern(glob)
    assert re.fullmatch(pattern, yes) and not re.fullmatch(pattern, no)


def test_page_selection(spark):
    pages = spark.createDataFrame([(0, p) for p in range(1, 6)], "doc_id long, page long")

    def pick(spec, strict):
        specs = spark.createDataFrame([(0, spec)], "doc_id long, spec string")
        return [r.page for r in src.page_selection(pages, specs, strict).orderBy("page").collect()]

    assert pick("1,3-5", True) == [1, 3, 4, 5]
    assert pick("4-2, x ,9", False) == [2, 3, 4]
    assert pick("all", False) == [1, 2, 3, 4, 5]
    assert pick("first", False) == [1]
    for bad in ("1,,2", "0", "3-1", "a"):
        with pytest.raises(PySparkException):
            pick(bad, True)
    with pytest.raises(PySparkException):
        pick("77", False)


def test_reports(spark, tmp_path):
    (tmp_path / "r1.json").write_text(json.dumps({"mode": "vector", "result": {"text_entities": 3}}, indent=1))
    (tmp_path / "r2.json").write_text("{broken")
    rows = {r.path[-7:]: r for r in src.read_reports(spark, str(tmp_path)).collect()}
    assert rows["r1.json"].mode == "vector" and rows["r1.json"].text_entities == 3
    assert rows["r2.json"].mode == "auto" and rows["r2.json"].corrupt == "{broken"
    good = spark.createDataFrame([(1, 2.5)], "id int, ms double")
    src.write_reports(good, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().ms == 2.5
    with pytest.raises(PySparkException, match="non-finite JSON number at ms"):
        src.write_reports(good.withColumn("ms", F.lit(float("nan"))), str(tmp_path / "bad"))
    nested = good.select("id", F.struct(F.array(F.struct(F.create_map(F.lit("k"), "ms").alias("m"))).alias("a")).alias("r"))
    src.write_reports(nested, str(tmp_path / "nested"))
    broken = good.withColumn("ms", F.lit(float("inf"))).select(*nested.columns[:1], F.struct(
        F.array(F.struct(F.create_map(F.lit("k"), "ms").alias("m"))).alias("a")).alias("r"))
    with pytest.raises(PySparkException, match=r"non-finite JSON number at r.a\[\].m\{\}"):
        src.write_reports(broken, str(tmp_path / "bad2"))


def test_catalog(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"W12X30": {"family": "W", "d": 12.3}, "L2X2X1/4": {"d": 2}}))
    assert {r.designation: r.d for r in src.load_catalog(spark, str(tmp_path)).collect()} == {
        "W12X30": 12.3, "L2X2X1/4": 2.0,
    }
    (tmp_path / "d.json").write_text(json.dumps({"W12X30": {"family": "W", "d": 12.5}}))
    assert {r.designation: r.d for r in src.load_catalog(spark, str(tmp_path)).collect()}["W12X30"] == 12.5


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql(
        "SELECT classify_text('SCALE 1:50') AS tags, strip_temporal('9:10 PM 1:20') AS s, "
        "redact_secrets('token = \"abc\"') AS r, confidence_action(0.8) AS c"
    ).first()
    texts = ['13/16" X 1 1/4" SLOT', "(2) Ø7/16 DIA.", "11'-6 1/2\"", "3 CM", '6 7/8"', "1:50", "3/0", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    df.createOrReplaceTempView("dimension_texts")
    by_sql = {r.i: r.d for r in spark.sql("SELECT i, parse_dimension(t) AS d FROM dimension_texts").collect()}
    assert by_sql == {r.i: r.dim for r in tx.with_dimension(df, F.col("t")).collect()}
    assert "scale_like" in row.tags and "titleblock_like" in row.tags
    assert (row.s, row.r, row.c) == ("1:20", 'token = "<REDACTED>"', "build_warn")
    pages = spark.sql("SELECT page FROM selected_pages('5-3,4,9,x', 6)").collect()
    assert [r.page for r in pages] == [3, 4, 5]


def test_entities_go_to_few_bounded_files_per_layer(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id as prim_id", "if(id % 10 < 8, 'hot', concat('l', id % 10)) as layer")
    src.write_entities(rows.repartition(7), str(tmp_path / "out"), rows_per_file=300)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 1000 and back.select("layer").distinct().count() == 3
    files = back.groupBy(F.input_file_name().alias("f"), "layer").count().collect()
    assert max(r["count"] for r in files) <= 300 and len(files) <= 3 * 4 * 3


def test_entity_points_in_order(spark):
    c = Corpus(spark, SF)
    points = style_jobs.entity_points(c.prims(), c.points(), c.pages())
    table = style_jobs.entity_table(c.prims(), c.pages())
    of = {}
    for r in points.collect():
        of.setdefault((r.prim_id, r.kind), []).append((r.position, r.x, r.y, r.closed))
    wanted = {}
    for r in c.points().collect():
        wanted.setdefault(r.prim_id, []).append((r.seq, r.x, r.y))
    dy = {(r.doc_id, r.page): r.dy for r in style_jobs.page_stack(c.pages()).collect()}
    drawn = 0
    for e in table.collect():
        got = sorted(of.get((e.prim_id, e.kind), []))
        if e.kind == "line":
            assert [p[1:3] for p in got] == [(e.x0, e.y0), (e.x1, e.y1)] and not got[0][3]
        elif e.kind in ("polyline", "fill"):
            shift = dy[e.doc_id, e.page]
            assert [p[1:3] for p in got] == [(x, y + shift) for _, x, y in sorted(wanted.get(e.prim_id, []))]
            assert [p[0] for p in got] == list(range(len(got))) and all(p[3] for p in got if e.kind == "fill")
            drawn += len(got)
    assert drawn > 50
