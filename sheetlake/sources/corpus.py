"""Corpus tables with a fixed schema, catalogs, files, page selections and reports."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rules import non_finite
from ..plans.scale import cut_lineage

_D, _L, _S, _B = T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType()


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


SCHEMAS = {
    "primitives": _schema(
        doc_id=_L, page=_L, prim_id=_L, ord=_L, type=_S, closed=_B, n_points=_L, n_items=_L, op=_S,
        x0=_D, y0=_D, x1=_D, y1=_D, cx=_D, cy=_D, radius=_D, bx0=_D, by0=_D, bx1=_D, by1=_D, area=_D,
        sr=_D, sg=_D, sb=_D, fr=_D, fg=_D, fb=_D, line_width=_D, dash=_S, layer=_S,
    ),
    "points": _schema(prim_id=_L, seq=_L, x=_D, y=_D, closed=_B),
    "texts": _schema(
        doc_id=_L, page=_L, text_id=_L, ord=_L, text=_S, normalized=_S, ix=_D, iy=_D,
        font_size=_D, rotation=_D, font_name=_S, bx0=_D, by0=_D, bx1=_D, by1=_D,
    ),
    "pages": _schema(doc_id=_L, page=_L, width=_D, height=_D, rotation=_L),
    "images": _schema(
        doc_id=_L, page=_L, ord=_L, xref=_L, smask=_L, a=_D, b=_D, c=_D, d=_D, e=_D, f=_D,
        px_w=_L, px_h=_L, kind=_S, instances=_L,
    ),
}
REPORT = T.StructType(
    [
        T.StructField("schema", _S), T.StructField("mode", _S),
        T.StructField("result", T.StructType([T.StructField("text_entities", _L), T.StructField("status", _S)])),
        T.StructField("fallback", T.StructType([T.StructField("used", _B), T.StructField("reason", _S)])),
        T.StructField("k", _L), T.StructField("_corrupt_record", _S),
    ]
)


def load_corpus(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Lazy readers of every corpus table below ``path``; columns and filters reach the scan."""
    return {
        name: spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{name}")
        for name, schema in SCHEMAS.items()
    }


def conform(df: DataFrame, table: str) -> DataFrame:
    """A derived table in the fixed schema of ``table``."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
          for f in SCHEMAS[table].fields]
    )


def write_entities(entities: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Entity rows as Parquet, one folder per layer, files of a bounded size.

    Rows are dealt by layer, so that a layer has few files; adaptive execution splits a layer that holds a large share
    over several tasks.
    """
    dealt = entities.hint("rebalance", F.col("layer"))
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("layer").parquet(path)


# ---- files ------------------------------------------------------------------------------

# Language by file suffix.
LANGUAGES = {
    "py": "python", "rb": "ruby", "dart": "dart", "js": "javascript", "ts": "typescript",
    "tsx": "tsx", "jsx": "jsx", "css": "css", "scss": "scss", "html": "html", "htm": "html",
    "json": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml", "plist": "xml", "md": "markdown",
    "txt": "text", "sql": "sql", "toml": "toml", "kts": "kotlin", "gradle": "groovy", "sh": "bash",
    "ps1": "powershell", "bat": "bat", "cmd": "bat", "svg": "xml", "cmake": "cmake",
}
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """Files below ``path`` as (path, content), flat or recursive.

    The scan leaves out files of length zero, so those come from a listing of the folders by Spark's tasks.
    """
    full = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")
    )
    none = list_files(spark, path, glob, recursive).filter("size = 0").select("path")
    return full.unionByName(none.withColumn("content", F.lit(b"")))


LISTED = "path string, size long, folder boolean"


def list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in each folder of a batch, without what lies in its folders, some 10,000 entries a batch."""
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            scheme, _, rest = folder.partition(":")
            if scheme == "file":
                system, inside = pafs.LocalFileSystem(), "/" + rest.lstrip("/")
            else:
                # the object store is the same under both names
                uri = ("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest
                system, inside = pafs.FileSystem.from_uri(quote(uri, safe=":/@"))
                inside = unquote(inside)
            head = folder[: len(folder) - len(inside)] if folder.endswith(inside) else folder
            infos = system.get_file_info(pafs.FileSelector(inside, recursive=False))
            for k in range(0, len(infos), 10_000):
                part = infos[k : k + 10_000]
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([head + e.path for e in part], pa.string()),
                    "size": pa.array([e.size if e.is_file else None for e in part], pa.int64()),
                    "folder": pa.array([e.type == pafs.FileType.Directory for e in part], pa.bool_()),
                })


def list_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """Files below ``path`` as (path, size), listed by tasks: one round per level of folders.

    Names that start with ``_`` or ``.`` are left out, as Spark's readers do.  The driver only learns whether a
    level has folders.  Each level is written before the next one reads it, so a folder is listed once.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    named = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    level = spark.createDataFrame([(named,)], "path string")
    levels = []
    while True:
        name = F.substring_index("path", "/", -1)
        found = cut_lineage(level.mapInArrow(list_folders, LISTED).filter(~name.rlike("^[_.]")))
        levels.append(found.filter("not folder").select("path", "size"))
        below = found.filter("folder").select("path")
        if not recursive or below.isEmpty():
            break
        level = below.repartition(F.col("path"))
    files = functools.reduce(DataFrame.unionByName, levels)
    return files.filter(F.substring_index("path", "/", -1).rlike("^(?:" + glob_pattern(glob) + ")$"))


def glob_pattern(glob: str) -> str:
    """A file name glob as a regular expression: ``*``, ``?``, ``[...]``, ``{a,b}``."""
    out, i, open_braces = [], 0, 0
    while i < len(glob):
        ch = glob[i]
        end = glob.find("]", i + 2)
        if ch == "[" and end > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "^!" else inner) + "]")
            i = end
        elif ch == "{":
            out.append("(?:")
            open_braces += 1
        elif ch == "}" and open_braces:
            out.append(")")
            open_braces -= 1
        elif ch == "," and open_braces:
            out.append("|")
        else:
            out.append({"*": ".*", "?": "."}.get(ch) or re.escape(ch))
        i += 1
    return "".join(out)


def size_label(size: Column) -> Column:
    """Size in the largest unit below 1024."""
    out = None
    for i, unit in enumerate(SIZE_UNITS):
        text = F.format_string(f"%.2f {unit}", F.bround(size / (1024.0**i), 2))
        if i == len(SIZE_UNITS) - 1:
            return out.otherwise(text)
        test = size < 1024.0 ** (i + 1)
        out = F.when(test, text) if out is None else out.when(test, text)
    return out


def file_inventory(files: DataFrame) -> DataFrame:
    """Size, digest and labels of every file (path, content)."""
    name = F.substring_index(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), "/", -1)
    suffix = F.lower(F.substring_index(name, ".", -1))
    table = F.create_map(*[F.lit(v) for kv in LANGUAGES.items() for v in kv])
    return files.select(
        "path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"),
        name.alias("name"),
        F.when(F.lower(name) == "cmakelists.txt", "cmake")
        .otherwise(F.coalesce(F.try_element_at(table, suffix), F.lit(""))).alias("language"),
        size_label(F.length("content")).alias("size_label"),
    )


def precheck_files(files: DataFrame) -> DataFrame:
    """Why a file cannot be read: empty, or no header in its first 1024 bytes."""
    head = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")
    return files.select(
        "path",
        F.when(F.length("content") == 0, "empty_file").when(~head.contains("%PDF-"), "not_a_pdf")
        .otherwise("ok").alias("status"),
    )


# ---- page selections -----------------------------------------------------------------------


def page_selection(pages: DataFrame, specs: DataFrame, strict: bool = True) -> DataFrame:
    """Pages named by each document's selection such as ``1,3-5``.

    ``specs``: doc_id, spec.  Strict: every token must be a page or a rising range, else the job
    fails.  Tolerant: reversed ranges are swapped, unreadable tokens are skipped, ``all`` and
    ``first`` are known, and a document left without any page fails.  Ranges meet the pages as
    conditions on the page number; they are never expanded.
    """
    s = F.lower(F.trim("spec"))
    token = r"^(\d+)(?:-(\d+))?$" if strict else r"^\s*([+-]?\d+)(?:\s*-\s*([+-]?\d+))?\s*$"
    named = specs.select("doc_id", s.alias("s"), "spec")
    if not strict:
        every = F.col("s").isin("all", "*", "a") | F.col("spec").isNull()
        first = F.col("s").isin("", "1", "first")
        named = named.withColumn(
            "s", F.when(every, F.lit(f"1-{2**62}")).when(first, F.lit("1")).otherwise(F.col("s"))
        )
    parts = named.withColumn("tok", F.explode(F.split("s", ","))).withColumn("tok", F.trim("tok"))
    lo = F.nullif(F.regexp_extract("tok", token, 1), F.lit("")).try_cast("long")
    hi = F.coalesce(F.nullif(F.regexp_extract("tok", token, 2), F.lit("")).try_cast("long"), lo)
    ranges = parts.select("doc_id", "tok", lo.alias("lo"), hi.alias("hi"))
    if strict:
        bad = F.col("lo").isNull() | (F.col("lo") < 1) | (F.col("hi") < F.col("lo"))
        fail = F.raise_error(F.concat(F.lit("invalid page selection "), F.col("tok")))
        ranges = ranges.withColumn("lo", F.when(bad, fail.cast("long")).otherwise(F.col("lo")))
    else:
        ranges = ranges.filter("lo is not null")
    ranges = ranges.select("doc_id", F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))
    chosen = pages.select("doc_id", "page").join(ranges, "doc_id").filter(
        F.col("page").between(F.col("lo"), F.col("hi"))
    ).select("doc_id", "page").distinct()
    if strict:
        return chosen
    empty = F.when(
        F.col("page").isNull(),
        F.raise_error(F.concat(F.lit("no page selected in document "), F.col("doc_id").cast("string"))).cast("long"),
    ).otherwise(F.col("page"))
    return specs.select("doc_id").distinct().join(chosen, "doc_id", "left").select(
        "doc_id", empty.alias("page")
    )


# ---- reports and catalogs --------------------------------------------------------------------


def parse_reports(rows: DataFrame, column: str) -> DataFrame:
    """Report JSON with defaults for absent blocks; unreadable text is kept beside nulls."""
    p = F.from_json(column, REPORT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return rows.withColumn("_r", p).select(
        *[c for c in rows.columns if c != column],
        F.coalesce("_r.schema", F.lit("import_report/1.1")).alias("schema"),
        F.coalesce("_r.mode", F.lit("auto")).alias("mode"),
        F.coalesce("_r.result.text_entities", F.lit(0)).alias("text_entities"),
        F.coalesce("_r.result.status", F.lit("unknown")).alias("status"),
        F.coalesce("_r.fallback.used", F.lit(False)).alias("fallback_used"),
        F.col("_r.fallback.reason").alias("fallback_reason"),
        F.coalesce("_r.k", F.lit(0)).alias("k"),
        F.col("_r._corrupt_record").alias("corrupt"),
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report files (one JSON document each) below ``path``."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return parse_reports(files, "value")


def report_violations(df: DataFrame, key: str, paths: dict[str, Column]) -> DataFrame:
    """(key, path) of every number JSON cannot carry."""
    return non_finite(df, key, paths)


def bad_numbers(value: Column, kind: T.DataType) -> list[tuple[str, Column]]:
    """(path, test) for every place of a value where JSON could meet a NaN or infinite number."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return [("", F.isnan(value) | (F.abs(value) == math.inf))]
    if isinstance(kind, T.StructType):
        return [
            (f".{f.name}{path}", test) for f in kind.fields for path, test in bad_numbers(value[f.name], f.dataType)
        ]
    inner = None
    if isinstance(kind, T.ArrayType):
        inner, items, mark = kind.elementType, value, "[]"
    elif isinstance(kind, T.MapType):
        inner, items, mark = kind.valueType, F.map_values(value), "{}"
    if inner is None:
        return []
    paths = [path for path, _ in bad_numbers(F.lit(None), inner)]

    def somewhere(i: int) -> Column:
        return F.exists(items, lambda x: F.coalesce(bad_numbers(x, inner)[i][1], F.lit(False)))

    return [(f"{mark}{path}", somewhere(i)) for i, path in enumerate(paths)]


def write_reports(df: DataFrame, path: str) -> None:
    """Write reports as JSON; a NaN or infinite number at any depth stops the job and is named."""
    tests = [
        (f"{f.name}{place}", test) for f in df.schema.fields for place, test in bad_numbers(F.col(f"`{f.name}`"), f.dataType)
    ]
    if tests:
        where = F.coalesce(*[F.when(test, F.lit(place)) for place, test in tests])
        fail = F.raise_error(F.concat(F.lit("non-finite JSON number at "), where))
        first = df.schema.fields[0]
        kept = F.when(where.isNotNull(), fail.cast(first.dataType)).otherwise(F.col(f"`{first.name}`"))
        df = df.withColumn(first.name, kept)
    df.write.mode("overwrite").json(path)


CATALOG_ENTRY = T.MapType(
    _S, T.StructType([T.StructField(n, t) for n, t in (("family", _S), ("d", _D), ("bf", _D), ("tw", _D), ("tf", _D))])
)


def parse_catalog(rows: DataFrame, column: str, order: str) -> DataFrame:
    """``{designation: {dims}}`` maps, one JSON text per row, as one row per designation.

    Of entries with one designation the last by ``order`` wins.
    """
    entries = rows.select(F.col(order).alias("_o"), F.explode(F.from_json(column, CATALOG_ENTRY)).alias("designation", "v"))
    return entries.groupBy("designation").agg(F.max_by("v", F.struct("_o", "v")).alias("v")).select("designation", "v.*")


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Section catalog from JSON files; a later file, by path, overrides an earlier one."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return parse_catalog(files, "value", "path")
