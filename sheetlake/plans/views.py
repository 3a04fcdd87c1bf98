"""Corpus tables derived from the test tables, as SQL that Spark and DuckDB both read.

Braces name the source tables.  Coordinates are integers or dyadic fractions
wherever an operator sums them, so the order of addition does not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scale import dense_position

SEGMENTS = """
SELECT CAST(floor(pg / 3) AS BIGINT) AS doc_id, CAST(1 + pg % 3 AS BIGINT) AS page, pg,
       o AS prim_id, o AS ord, type, closed, n_points, n_items, op,
       x0, y0, x0 + dx AS x1, y0 + dy AS y1,
       CASE WHEN type = 'circle' THEN x0 END AS cx,
       CASE WHEN type = 'circle' THEN y0 END AS cy,
       CASE WHEN type = 'circle' THEN 5.0E0 END AS radius,
       CASE WHEN type = 'circle' THEN x0 - 5 WHEN dx < 0 THEN x0 + dx ELSE x0 END AS bx0,
       CASE WHEN type = 'circle' THEN y0 - 5 ELSE y0 END AS by0,
       CASE WHEN type = 'circle' THEN x0 + 5 WHEN dx < 0 THEN x0 ELSE x0 + dx END AS bx1,
       CASE WHEN type = 'circle' THEN y0 + 5 ELSE y0 + dy END AS by1,
       CASE WHEN type = 'closed_loop' THEN dx * dy END AS area,
       CASE WHEN frame OR c = 3 THEN NULL ELSE CAST(c AS DOUBLE) / 8 END AS sr,
       CASE WHEN frame OR c = 3 THEN NULL ELSE CAST((c * 3) % 7 AS DOUBLE) / 8 END AS sg,
       CASE WHEN frame OR c = 3 THEN NULL WHEN c = 6 THEN 1.0
            ELSE CAST((c * 5) % 7 AS DOUBLE) / 8 END AS sb,
       CASE WHEN frame THEN 1.0E0 WHEN c = 3 OR c = 5 THEN 0.5E0 END AS fr,
       CASE WHEN frame THEN 1.0E0 WHEN c = 3 OR c = 5 THEN 0.25E0 END AS fg,
       CASE WHEN frame THEN 1.0E0 WHEN c = 3 OR c = 5 THEN 0.75E0 END AS fb,
       CAST(o % 5 AS DOUBLE) * 0.125 AS line_width,
       CASE o_orderpriority WHEN '1-URGENT' THEN '[] 0' WHEN '2-HIGH' THEN '[ 6 6 ] 0'
            WHEN '3-MEDIUM' THEN '[18 3 1 3] 2' WHEN '5-LOW' THEN '[1 3] 0' END AS dash,
       o_orderstatus AS layer
FROM (
  SELECT o, pg, k, c, o_orderpriority, o_orderstatus, frame,
         CASE WHEN frame THEN 'closed_loop' WHEN k = 7 AND m = 0 THEN 'closed_loop'
              WHEN k = 7 AND m = 1 THEN 'circle' ELSE 'line' END AS type,
         frame OR (k = 7 AND m < 2) AS closed,
         CAST(CASE WHEN frame OR (k = 7 AND m = 0) THEN 5 WHEN k = 7 AND m = 1 THEN 0 ELSE 2 END
              AS BIGINT) AS n_points,
         CAST(CASE WHEN k = 3 THEN 3 ELSE 1 END AS BIGINT) AS n_items,
         CASE WHEN frame OR (k = 7 AND m = 0) THEN 're' ELSE 'l' END AS op,
         CASE WHEN frame THEN 0.0 WHEN lined THEN 100.0
              ELSE CAST((o * 37) % 2999 AS DOUBLE) END AS x0,
         CASE WHEN frame THEN 0.0 WHEN lined THEN 5.0 * rn
              ELSE CAST((o * 7) % 1999 AS DOUBLE) END AS y0,
         CAST(CASE WHEN frame THEN (CASE WHEN pg % 5 = 0 THEN 2000 ELSE 3000 END)
              WHEN k IN (0, 1, 5) THEN 20 WHEN k = 3 THEN 10 WHEN k = 4 THEN -20
              WHEN k = 7 THEN 3 ELSE 0 END AS DOUBLE) AS dx,
         CAST(CASE WHEN frame THEN (CASE WHEN pg % 5 = 0 THEN 3000 ELSE 2000 END)
              WHEN k = 2 THEN 20 WHEN k = 3 THEN 10 WHEN k = 5 THEN 1
              WHEN k = 7 THEN 4 ELSE 0 END AS DOUBLE) AS dy
  FROM (
    SELECT o_orderkey AS o, CAST(floor(o_custkey / 5) AS BIGINT) AS pg, o_orderkey % 8 AS k,
           o_orderkey % 7 AS c, CAST(floor(o_orderkey / 8) AS BIGINT) % 3 AS m,
           o_orderkey % 8 = 6 AND o_orderkey % 13 = 0 AS frame,
           CAST(floor(o_custkey / 5) AS BIGINT) % 4 = 0 AND o_orderkey % 8 IN (0, 1, 4, 5) AS lined,
           o_orderpriority, o_orderstatus,
           row_number() OVER (
             PARTITION BY CAST(floor(o_custkey / 5) AS BIGINT), o_orderkey % 8 IN (0, 1, 4, 5),
                          floor(o_orderkey / 1048576)
             ORDER BY o_orderkey) AS rn
    FROM {orders}
  ) a
) b
"""

PAGES = """
SELECT CAST(floor(pg / 3) AS BIGINT) AS doc_id, CAST(1 + pg % 3 AS BIGINT) AS page, pg,
       CAST(CASE WHEN pg % 5 = 0 THEN 2000 ELSE 3000 END AS DOUBLE) AS width,
       CAST(CASE WHEN pg % 5 = 0 THEN 3000 ELSE 2000 END AS DOUBLE) AS height,
       90 * (pg % 4) AS rotation
FROM (
  SELECT DISTINCT CAST(floor(o_custkey / 5) AS BIGINT) AS pg FROM {orders}
  UNION
  SELECT DISTINCT CAST(floor(p_partkey / 6) AS BIGINT) AS pg FROM {part}
) p
"""

TEXTS = """
SELECT doc_id, page, pg, text_id, ord, text,
       trim(replace(upper(text), '  ', ' ')) AS normalized, ix, iy, font_size, rotation, font_name,
       CASE WHEN ord % 4 > 0 THEN font_size END AS nominal_size,
       CASE WHEN ord % 3 > 0 THEN font_size END AS raw_size, 1.0E0 AS ma, 0.0E0 AS mb, 0.0E0 AS mc,
       CASE WHEN ord % 8 = 0 THEN 0.0E0 ELSE 2.0E0 END AS md, embedded, ix AS bx0, iy AS by0,
       CASE WHEN rotation = 90 THEN ix + 4 ELSE ix + 2.0 * length(text) END AS bx1,
       CASE WHEN rotation = 90 THEN iy + 2.0 * length(text) ELSE iy + 4 END AS by1
FROM (
  SELECT CAST(floor(p_partkey / 18) AS BIGINT) AS doc_id,
         CAST(1 + floor(p_partkey / 6) % 3 AS BIGINT) AS page,
         CAST(floor(p_partkey / 6) AS BIGINT) AS pg,
         p_partkey AS text_id, p_partkey AS ord,
         CAST((p_partkey * 53) % 2999 AS DOUBLE) AS ix, CAST((p_partkey * 29) % 1999 AS DOUBLE) AS iy,
         2.5 + CAST(p_partkey % 4 AS DOUBLE) * 0.5 AS font_size,
         CAST(CASE WHEN p_partkey % 8 = 5 THEN 90 ELSE 0 END AS DOUBLE) AS rotation,
         concat('Font', CAST(p_partkey % 9 AS VARCHAR(9))) AS font_name,
         p_partkey % 9 < 2 AS embedded,
         CASE p_partkey % 16
           WHEN 0 THEN concat('SCALE 1:', CAST(p_size AS VARCHAR(9)))
           WHEN 1 THEN 'SCALE: 1/4" = 1''-0"'
           WHEN 2 THEN concat('DATE 3/', CAST(1 + p_size % 28 AS VARCHAR(9)), '/2024  SHEET ',
                              CAST(p_size AS VARCHAR(9)))
           WHEN 3 THEN concat('9:10:47 AM VIEW 1:', CAST(1 + p_size % 4 AS VARCHAR(9)))
           WHEN 4 THEN concat(CAST(p_size AS VARCHAR(9)), '.5 mm')
           WHEN 5 THEN concat(CAST(1 + p_size % 9 AS VARCHAR(9)), ''' - ',
                              CAST(p_size % 12 AS VARCHAR(9)), ' 1/2"')
           WHEN 6 THEN concat(CAST(p_size AS VARCHAR(9)), ' 3/8"')
           WHEN 7 THEN '13/16" X 1 1/4" SLOT'
           WHEN 8 THEN concat('(2) Ø', CAST(p_size AS VARCHAR(9)), '/16 DIA.')
           WHEN 9 THEN concat('PL1/2"X5 1/2"X', CAST(1 + p_size % 8 AS VARCHAR(9)), '''-6" p',
                              CAST(9000 + p_size AS VARCHAR(9)))
           WHEN 10 THEN concat('W', CAST(8 + 2 * (p_size % 4) AS VARCHAR(9)), 'X',
                               CAST(20 + p_size % 3 AS VARCHAR(9)), ' b', CAST(100 + p_size AS VARCHAR(9)),
                               CASE WHEN p_size % 2 = 0 THEN ' 12''-6 1/2"' ELSE '' END,
                               ' QTY: ', CAST(p_size % 5 AS VARCHAR(9)))
           WHEN 11 THEN concat('B', CAST(100 + p_size AS VARCHAR(9)))
           WHEN 12 THEN CAST(p_size AS VARCHAR(9))
           WHEN 13 THEN CASE p_size % 3 WHEN 0 THEN 'W12X30' WHEN 1 THEN 'L2X2X1/4' ELSE 'C6X8.2' END
           WHEN 14 THEN concat(CAST(p_size AS VARCHAR(9)), '''-6 1/2"')
           ELSE CASE p_size % 4 WHEN 0 THEN concat(CAST(p_size AS VARCHAR(9)), '.5')
                     WHEN 1 THEN 'NOTE: SEE DETAIL A DRAWN BY ME' WHEN 2 THEN 'REV B  DIA 3/4 HOLE'
                     ELSE 'SHEET TITLE PROJECT' END
         END AS text
  FROM {part}
) t
"""

RAW_POINTS = """
SELECT l_orderkey AS prim_id, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       l_returnflag, CAST(l_partkey % 1000 AS DOUBLE) AS x,
       CAST(l_suppkey * 4 AS DOUBLE) + l_quantity AS y, l_orderkey % 2 = 0 AS closed
FROM {lineitem}
"""

ARCS = """
SELECT p_partkey AS prim_id, CAST(k AS BIGINT) AS seq, n AS n_points, p_partkey % 6 = 0 AS closed,
       CAST(floor(p_partkey / 6) AS BIGINT) AS pg,
       round(p_partkey % 500 + rr * cos(radians(span * k / (n - 1) + p_partkey % 360)), 4) AS x,
       round((p_partkey * 7) % 300 + rr * sin(radians(span * k / (n - 1) + p_partkey % 360)), 4) AS y
FROM (
  SELECT p_partkey, n, k, 5 + p_size + ((p_partkey * 13 + k * 7) % 11 - 5) / 1000.0E0 AS rr,
         CAST(CASE WHEN p_partkey % 6 = 0 THEN 360 ELSE 20 + (p_partkey * 37) % 341 END AS DOUBLE)
           AS span
  FROM (
    SELECT p_partkey, p_size,
           CASE WHEN p_partkey % 50 = 0 THEN 70 ELSE 8 + p_size % 24 END AS n,
           {arc_series}
    FROM {part}
  ) a WHERE k < n
) b
"""

EVENTS = """
SELECT user_id AS run_id, event_id AS ord, ts,
       CASE event_type WHEN 'view' THEN 'extract_ms' WHEN 'click' THEN 'host_build_ms'
            WHEN 'signup' THEN 'cache_lookup_ms' WHEN 'purchase' THEN 'cache_store_ms'
            ELSE 'other_ms' END AS stage,
       CASE WHEN event_id % 97 = 0 THEN -value ELSE value END AS ms
FROM {events}
"""

OUTCOMES = """
SELECT o_orderkey AS cell_id, CAST(floor(o_custkey / 50) AS BIGINT) AS run_id,
  CASE WHEN o_orderkey % 101 = 0 THEN 'warp' WHEN o_orderkey % 4 = 0 THEN 'native'
       WHEN o_orderkey % 4 = 1 THEN 'host_proved_hybrid' WHEN o_orderkey % 4 = 2 THEN 'visual_recovery'
       ELSE 'incomplete' END AS effective_page_strategy,
  CASE o_orderkey % 7 WHEN 0 THEN 'text' WHEN 1 THEN 'labels' WHEN 2 THEN '3d_text' WHEN 3 THEN 'glyphs'
       WHEN 4 THEN 'geometry' WHEN 5 THEN 'raster' ELSE 'none' END AS requested_representation,
  CASE WHEN o_orderkey % 3 < 2 THEN 'pass' ELSE 'not_certified' END AS structural_status,
  CASE WHEN o_orderkey % 5 < 3 THEN 'pass' WHEN o_orderkey % 5 = 3 THEN 'fail' ELSE 'unproved' END
    AS visual_status,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'pass'
       WHEN o_orderkey % 3 = 1 THEN 'not_applicable' ELSE 'fail' END AS requested_representation_status,
  CASE WHEN o_orderstatus = 'F' THEN 'pass' ELSE 'fail' END AS cell_status,
  CASE WHEN o_orderkey % 9 = 0 THEN 'failed' WHEN o_orderkey % 5 = 0 THEN 'certified' ELSE 'absent' END
    AS visual_recovery,
  o_orderkey % 3 AS native_peer_count,
  CASE WHEN o_orderkey % 2 = 0 THEN 'd1' ELSE '' END AS visual_proof_digest,
  o_orderkey % 13 = 0 AS has_item_transitions,
  o_orderkey % 23 AS entities, o_orderkey % 17 = 0 AS crashed, o_totalprice
FROM {orders}
"""

RAW_PIXELS = """SELECT vec_id, embedding FROM {embeddings}"""

ATTEMPTS = """
SELECT CAST(l_orderkey AS BIGINT) AS source_id,
       CAST(floor(l_orderkey / 40) AS BIGINT) AS doc_id, CAST(1 + floor(l_orderkey / 8) % 5 AS BIGINT) AS page,
       l_linenumber * CAST(1099511627776 AS BIGINT) + (l_partkey % 1048576) * 1048576
         + (l_suppkey % 1024) * 1024 + CAST(l_quantity AS BIGINT) AS ord,
       CASE l_orderkey % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'labels' WHEN 2 THEN 'glyphs'
            WHEN 3 THEN 'geometry' WHEN 4 THEN '3d_text' ELSE 'raster' END AS requested,
       CASE WHEN l_linenumber = 6 OR (l_orderkey % 6 = 5 AND l_linenumber % 2 = 1) THEN 'raster'
            ELSE CASE l_linenumber % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'glyphs' WHEN 2 THEN 'geometry'
            WHEN 3 THEN 'labels' ELSE '3d_text' END END AS attempted,
       CASE WHEN l_orderkey % 9 = 4 AND l_linenumber <> 6 THEN 'impossible'
            ELSE CASE l_returnflag WHEN 'N' THEN 'verified' WHEN 'A' THEN 'impossible' ELSE 'failed' END END AS outcome,
       l_linestatus = 'O' AS type_verified, l_partkey % 5 > 0 AS delivery_verified,
       l_suppkey % 5 > 0 AS visual_verified, l_quantity > 5 AS cleanup_verified,
       concat('h', CAST(l_partkey AS VARCHAR(20)), '_', CAST(l_suppkey AS VARCHAR(20))) AS handle
FROM {lineitem}
"""

FILES = """
SELECT concat(source, '/', CAST(doc_id AS VARCHAR(20)), CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.PY'
              WHEN 2 THEN '.json' ELSE '.pdf' END) AS path,
       source AS folder, doc_id AS file_no,
       CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 3 = 0 THEN concat('%PDF-1.7 ', text)
            ELSE text END AS body
FROM {documents}
"""

IMAGES = """
SELECT CAST(floor(pg / 3) AS BIGINT) AS doc_id, CAST(1 + pg % 3 AS BIGINT) AS page, pg,
       o_orderkey AS ord, o_custkey % 40 AS xref, o_orderkey % 2 AS smask,
       CAST(10 + o_orderkey % 90 AS DOUBLE) AS a,
       CAST(CASE WHEN o_orderkey % 9 = 0 THEN 2 ELSE 0 END AS DOUBLE) AS b,
       CAST(0 AS DOUBLE) AS c, CAST(10 + o_orderkey % 50 AS DOUBLE) AS d,
       CAST((o_orderkey * 37) % 2999 AS DOUBLE) AS e, CAST((o_orderkey * 7) % 1999 AS DOUBLE) AS f,
       16 + o_orderkey % 500 AS px_w, 16 + (o_orderkey * 3) % 300 AS px_h,
       CASE WHEN o_orderkey % 5 = 0 THEN 'inline_image' ELSE 'xobject_image' END AS kind,
       o_orderkey % 3 AS instances
FROM (SELECT o_orderkey, o_custkey, CAST(floor(o_custkey / 5) AS BIGINT) AS pg FROM {orders}) i
"""

FRACTIONS = """
SELECT CAST(floor(p_partkey / 18) AS BIGINT) AS doc_id,
       CAST(1 + floor(p_partkey / 6) % 3 AS BIGINT) AS page,
       p_partkey * 10 + role AS text_id, p_partkey * 10 + role AS ord,
       CASE role WHEN 0 THEN CASE WHEN p_partkey % 5 = 0 THEN concat(CAST(1 + p_size % 15 AS VARCHAR(9)), '16')
                                  ELSE CAST(1 + p_size % 7 AS VARCHAR(9)) END
                 WHEN 1 THEN '/' WHEN 2 THEN '8' WHEN 3 THEN '3' ELSE CAST(1 + p_size % 7 AS VARCHAR(9)) END
         AS text,
       CAST(p_partkey * 40 AS DOUBLE) + CASE
         WHEN p_partkey % 2 = 0 THEN 0.0
         WHEN role = 0 OR role = 4 THEN -3.0 WHEN role = 2 THEN 3.0 WHEN role = 3 THEN -1.5 ELSE 0.0 END AS ix,
       CASE WHEN p_partkey % 2 = 1 THEN 0.0
            WHEN role = 0 OR role = 4 THEN 2.0 WHEN role = 2 THEN -2.0 WHEN role = 3 THEN 1.0 ELSE 0.0 END AS iy,
       CASE WHEN p_partkey % 17 = 0 AND role = 2 THEN 9.0 WHEN p_partkey % 29 = 0 AND role = 1 THEN 40.0 ELSE 2.5 END AS font_size,
       CAST(0 AS DOUBLE) AS rotation,
       CASE WHEN p_partkey % 19 = 0 AND role = 2 THEN 'FontB' ELSE 'FontA' END AS font_name,
       NOT ((p_partkey % 23 = 0 AND role = 0) OR (p_partkey % 29 = 0 AND role = 1)) AS laid_out
FROM (
  SELECT p_partkey, p_size, {role_series} FROM {part}
) r
WHERE role IN (0, 1) OR (role = 2 AND p_partkey % 5 > 0) OR (role = 3 AND p_partkey % 7 = 0)
   OR (role = 4 AND p_partkey % 11 = 0 AND p_partkey % 5 > 0)
"""

PAINTS = """
SELECT CAST(floor(o_custkey / 15) AS BIGINT) AS doc_id, o_orderkey AS prim_id,
       CASE o_orderkey % 5 WHEN 0 THEN (o_orderkey * 7919) % 16777216 WHEN 1 THEN CAST(-1 AS BIGINT) END AS packed,
       CASE o_orderkey % 5 WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 0 END AS n_parts,
       CAST(o_custkey % 11 - 1 AS DOUBLE) / 8 AS p1, CAST(o_custkey % 7 AS DOUBLE) / 8 AS p2,
       CAST(o_custkey % 5 AS DOUBLE) / 4 AS p3, CAST(o_custkey % 9 AS DOUBLE) / 16 AS p4,
       CASE o_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 1.0E0 WHEN 2 THEN 0.5E0 WHEN 3 THEN -0.25E0
            WHEN 4 THEN 0.25E0 ELSE CAST('NaN' AS DOUBLE) END AS opacity,
       CASE o_custkey % 10 WHEN 0 THEN '[6 3] 0' WHEN 1 THEN '[0.001 2] 0' WHEN 2 THEN '[ 3 ] 1'
            WHEN 3 THEN '[6 1 0.02 1] 0' WHEN 4 THEN '[6 1 1 1] 0' WHEN 5 THEN '[6 1 0.01 1 0.01 1] 0'
            WHEN 6 THEN '[6 1 2 1 2 1] 0' WHEN 7 THEN '[] 0' WHEN 8 THEN '[1 5] 2' ELSE '[1 2 3] 0' END AS dash
FROM {orders}
"""

SPANS = """
SELECT CAST(floor(p_partkey / 18) AS BIGINT) AS doc_id, (p_partkey * 104729) % 16777216 AS packed,
       CASE p_partkey % 4 WHEN 0 THEN 255 WHEN 1 THEN 128 WHEN 2 THEN 0 END AS alpha,
       CASE p_partkey % 3 WHEN 0 THEN 16 WHEN 1 THEN 4 END AS flags
FROM {part}
"""

# Angle brackets stand for the braces of JSON, which the SQL above reads as table names.
REPORTS = """
SELECT cell_id, translate(report, '<>', concat(chr(123), chr(125))) AS report FROM (
  SELECT cell_id, CASE cell_id % 13
    WHEN 0 THEN '<"mode": "vector", "result": <"text_ent'
    WHEN 1 THEN '<>'
    WHEN 2 THEN CAST(NULL AS VARCHAR(9))
    ELSE concat('<"mode": "', requested_representation, '"',
      CASE WHEN cell_id % 4 = 0 THEN '' ELSE concat(', "schema": "import_report/1.', CAST(cell_id % 3 AS VARCHAR(9)), '"') END,
      CASE WHEN cell_id % 7 = 0 THEN '' ELSE concat(', "result": <"text_entities": ', CAST(entities AS VARCHAR(20)),
        CASE WHEN cell_id % 2 = 0 THEN concat(', "status": "', structural_status, '"') ELSE '' END, '>') END,
      CASE WHEN cell_id % 5 = 0 THEN '' ELSE concat(', "fallback": <"used": ', CASE WHEN crashed THEN 'true, "reason": "crash"'
        ELSE 'false' END, '>') END, ', "k": ', CAST(cell_id % 17 AS VARCHAR(9)), '>') END AS report
  FROM (""" + OUTCOMES + """) o
) j
"""

SPARK_SERIES = {
    "arc_series": "explode(sequence(0, 69)) AS k",
    "role_series": "explode(sequence(0, 4)) AS role",
}
DUCK_SERIES = {
    "arc_series": "unnest(range(70)) AS k",
    "role_series": "unnest(range(5)) AS role",
}
TABLES = ("orders", "lineitem", "part", "events", "documents", "embeddings")


class Corpus:
    """Lazy access to the corpus tables derived from one directory of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _sql(self, text: str) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        for name, series in SPARK_SERIES.items():
            text = text.replace("{" + name + "}", series)
        return self.spark.sql(text, **used)

    def prims(self) -> DataFrame:
        return self._sql(SEGMENTS)

    def pages(self) -> DataFrame:
        return self._sql(PAGES)

    def texts(self) -> DataFrame:
        return self._sql(TEXTS)

    def points(self, closed_only: bool = False) -> DataFrame:
        """Polyline points with a dense ``seq`` per primitive, of all or of closed ones.

        A primitive is closed as a whole, so leaving others out before numbering changes no number;
        the optimizer can't know that and would number all of them.
        """
        raw = self._sql(RAW_POINTS)
        if closed_only:
            raw = raw.filter("closed")
        return dense_position(
            raw,
            ["prim_id"],
            ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"],
            [F.col("l_linenumber"), F.floor(F.col("l_partkey") / 100_000)],
            "seq",
        )

    def arcs(self) -> DataFrame:
        return self._sql(ARCS)

    def events(self) -> DataFrame:
        return self._sql(EVENTS)

    def outcomes(self) -> DataFrame:
        return self._sql(OUTCOMES)

    def pixels(self) -> DataFrame:
        """One row per pixel of every asset; every seventh asset is one row shorter."""
        raw = self._sql(RAW_PIXELS)
        e = F.posexplode("embedding").alias("i", "e")
        level = F.least(
            F.lit(255), F.greatest(F.lit(0), ((F.col("e").cast("double") + 1) * 127.5).cast("int"))
        )
        return (
            raw.select("vec_id", e)
            .filter(~((F.col("vec_id") % 7 == 0) & (F.col("i") >= 56)))
            .select(
                F.col("vec_id").alias("asset_id"),
                (F.col("i") % 8).cast("long").alias("x"),
                F.floor(F.col("i") / 8).cast("long").alias("y"),
                level.cast("long").alias("r"),
                (F.lit(255) - level).cast("long").alias("g"),
                ((level * 3) % 256).cast("long").alias("b"),
                F.when(F.col("vec_id") % 5 == 0, F.lit(255))
                .when(F.col("vec_id") % 5 == 1, F.lit(0))
                .when(
                    F.col("vec_id") % 5 == 2,
                    F.when((F.col("i") % 8).between(2, 5), F.lit(255)).otherwise(F.lit(0)),
                )
                .when(
                    F.col("vec_id") % 5 == 3,
                    F.when(level % 2 == 0, F.lit(255)).otherwise(F.lit(0)),
                )
                .otherwise(level)
                .cast("long")
                .alias("a"),
            )
        )

    def attempts(self) -> DataFrame:
        return self._sql(ATTEMPTS)

    def files(self) -> DataFrame:
        return self._sql(FILES)

    def images(self) -> DataFrame:
        return self._sql(IMAGES)

    def fractions(self) -> DataFrame:
        return self._sql(FRACTIONS)

    def strokes(self) -> DataFrame:
        """Raw paints of primitives: packed colours or components, opacity, dash pattern."""
        raw = self._sql(PAINTS)
        parts = F.slice(F.array("p1", "p2", "p3", "p4"), F.lit(1), F.col("n_parts"))
        return raw.select(
            "doc_id", "prim_id", "packed", F.when(F.col("n_parts") > 0, parts).alias("parts"), "opacity", "dash"
        )

    def spans(self) -> DataFrame:
        return self._sql(SPANS)

    def reports(self) -> DataFrame:
        """Run reports as JSON: whole, with blocks left out, cut off, and absent ones."""
        return self._sql(REPORTS)

    def path_ops(self) -> DataFrame:
        """Path operators of every order: lines, curves, rectangles, closings."""
        n = F.col("l_linenumber")
        joined = F.col("l_returnflag") == "N"
        return self.points().select(
            F.col("prim_id").alias("path_id"),
            "seq",
            F.when(n == 7, "h").when((n == 6) & (F.col("prim_id") % 3 == 0), "qu").when(n == 6, "re").when(n == 4, "c").when(n == 1, "m")
            .otherwise("l").alias("op"),
            F.when((n.isin(2, 3, 5)) & joined, F.lit(None)).otherwise(F.col("x")).alias("x0"),
            F.when((n.isin(2, 3, 5)) & joined, F.lit(None)).otherwise(F.col("y")).alias("y0"),
            F.when(n == 1, F.col("x")).otherwise(F.col("x") + F.col("l_quantity")).alias("x1"),
            F.when(n == 1, F.col("y")).otherwise(F.col("y") + 2).alias("y1"),
            (F.col("x") + 1).alias("c1x"), (F.col("y") + 3).alias("c1y"),
            (F.col("x") + 2).alias("c2x"), (F.col("y") + 5).alias("c2y"),
        )


def duck(text: str) -> str:
    """The same view text for DuckDB."""
    for name, series in DUCK_SERIES.items():
        text = text.replace("{" + name + "}", series)
    for name in TABLES:
        text = text.replace("{" + name + "}", name)
    return text
