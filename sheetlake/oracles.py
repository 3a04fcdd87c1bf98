"""DuckDB SQL for the registered queries, written directly over the test tables.

The SQL states each result in the plainest way (whole-group windows, list lambdas, recursive
queries); it shares the corpus views with the Spark side and nothing else but fixed patterns.
"""

from __future__ import annotations

from .functions import text as tx
from .functions.style import DASH_VARIANTS, PALETTE
from .plans import views as v

K = 25.4 / 72.0
ORACLES: dict[str, str] = {}

POINTS_SQL = (
    "SELECT *, row_number() OVER (PARTITION BY prim_id ORDER BY l_linenumber, l_partkey, l_suppkey, "
    "l_quantity, l_extendedprice) - 1 AS seq FROM (" + v.duck(v.RAW_POINTS) + ")"
)
OPS_SQL = """
SELECT prim_id AS path_id, seq,
  CASE l_linenumber WHEN 7 THEN 'h' WHEN 6 THEN CASE WHEN prim_id % 3 = 0 THEN 'qu' ELSE 're' END WHEN 4 THEN 'c' WHEN 1 THEN 'm' ELSE 'l' END AS op,
  CASE WHEN l_linenumber IN (2, 3, 5) AND l_returnflag = 'N' THEN NULL ELSE x END AS x0,
  CASE WHEN l_linenumber IN (2, 3, 5) AND l_returnflag = 'N' THEN NULL ELSE y END AS y0,
  CASE WHEN l_linenumber = 1 THEN x ELSE x + l_quantity END AS x1,
  CASE WHEN l_linenumber = 1 THEN y ELSE y + 2 END AS y1,
  x + 1 AS c1x, y + 3 AS c1y, x + 2 AS c2x, y + 5 AS c2y
FROM v_points
"""
PIXELS_SQL = """
SELECT vec_id AS asset_id, i % 8 AS x, i // 8 AS y, lv AS r, 255 - lv AS g, (lv * 3) % 256 AS b,
  CASE vec_id % 5 WHEN 0 THEN 255 WHEN 1 THEN 0
    WHEN 2 THEN CASE WHEN i % 8 BETWEEN 2 AND 5 THEN 255 ELSE 0 END
    WHEN 3 THEN CASE WHEN lv % 2 = 0 THEN 255 ELSE 0 END ELSE lv END AS a
FROM (
  SELECT vec_id, i, least(255, greatest(0, CAST(trunc((CAST(e AS DOUBLE) + 1) * 127.5) AS BIGINT))) AS lv
  FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS i FROM embeddings)
) WHERE NOT (vec_id % 7 = 0 AND i >= 56)
"""
VIEWS = {
    "v_prims": v.duck(v.SEGMENTS),
    "v_pages": v.duck(v.PAGES),
    "v_texts": v.duck(v.TEXTS),
    "v_points": POINTS_SQL,
    "v_ops": OPS_SQL,
    "v_arcs": v.duck(v.ARCS),
    "v_events": v.duck(v.EVENTS),
    "v_outcomes": v.duck(v.OUTCOMES),
    "v_pixels": PIXELS_SQL,
    "v_attempts": v.duck(v.ATTEMPTS),
    "v_files": v.duck(v.FILES),
    "v_images": v.duck(v.IMAGES),
    "v_fractions": v.duck(v.FRACTIONS),
    "v_paints": v.duck(v.PAINTS),
    "v_spans": v.duck(v.SPANS),
    "v_reports": v.duck(v.REPORTS),
}


def oracle(name: str, body: str, *steps: tuple[str, str], recursive: bool = False) -> None:
    """Register SQL; the views it names are put in front, then ``steps``, then ``body``."""
    text = body + " ".join(s for _, s in steps)
    used = [n for n in VIEWS if n in text or (n == "v_points" and "v_ops" in text)]
    ctes = [(n, VIEWS[n]) for n in used] + list(steps)
    if not ctes:
        ORACLES[name] = body
        return
    head = "WITH " + ("RECURSIVE " if recursive else "")
    ORACLES[name] = head + ",\n".join(f"{n} AS ({s})" for n, s in ctes) + "\n" + body


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ex(e: str, pattern: str, i: int = 1) -> str:
    return f"nullif(regexp_extract({e}, {lit(pattern)}, {i}), '')"


def num(e: str, pattern: str, i: int = 1) -> str:
    return f"TRY_CAST({ex(e, pattern, i)} AS DOUBLE)"


def has(e: str, pattern: str) -> str:
    return f"regexp_matches({e}, {lit(pattern)})"


def rep(e: str, pattern: str, to: str) -> str:
    return f"regexp_replace({e}, {lit(pattern)}, {lit(to)}, 'g')"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def r(e: str, digits: int = 4) -> str:
    return f"(round(CAST({e} AS DOUBLE), {digits}) + 0.0)"


def token(e: str) -> str:
    s = rep(f"trim({e})", "[\"']+$", "")
    mixed = f"({num(s, tx.MIXED, 1)} + {div(num(s, tx.MIXED, 2), num(s, tx.MIXED, 3))})"
    simple = div(num(s, tx.SIMPLE_FRACTION, 1), num(s, tx.SIMPLE_FRACTION, 2))
    return f"coalesce({mixed}, {simple}, {num(s, tx.DECIMAL)})"


def feet(e: str, pattern: str) -> str:
    frac = div(num(e, pattern, 3), num(e, pattern, 4))
    return f"({num(e, pattern, 1)} * 12 + coalesce({num(e, pattern, 2)}, 0) + coalesce({frac}, 0))"


def inches(e: str) -> str:
    s = "trim(" + rep(f"trim({e})", r"^\"+|\"+$", "") + ")"
    a, b = r"^(\d+)\s+(\d+)/(\d+)$", r"^(\d+)/(\d+)$"
    return (
        f"coalesce({num(s, a, 1)} + {div(num(s, a, 2), num(s, a, 3))}, "
        f"{div(num(s, b, 1), num(s, b, 2))}, {num(s, tx.DECIMAL)})"
    )


def length_in(e: str) -> str:
    rest = f"coalesce({ex(e, tx.LENGTH_RUN, 2)}, '0')"
    return f"({num(e, tx.LENGTH_RUN, 1)} * 12 + coalesce({inches(rest)}, 0))"


def tag(name: str, t: str = "text", n: str = "normalized") -> str:
    tests = []
    for got, form, pattern in tx.RAW_TAGS:
        if got == name:
            e = f"trim({t})" if form == "raw" else f"upper(trim({t}))"
            test = has(e, pattern)
            if form == "label":
                test = f"(length(trim({t})) > 1 AND length(trim({t})) < 60 AND {test})"
            tests.append(test)
    tests += [has(n, p) for got, p in tx.NORMAL_TAGS if got == name]
    return "(" + " OR ".join(tests) + ")"


def strip_time(e: str) -> str:
    """RE2 has no look-around, so the neighbours are captured and put back."""
    date = r"(^|[^0-9])\d{1,2}\s*[/\-]\s*\d{1,2}\s*[/\-]\s*\d{2,4}($|[^0-9])"
    clock = (
        r"(?i)(^|[^0-9])(?:\d{1,2}\s*:\s*\d{2}\s*:\s*\d{2}(?:\s*(?:AM|PM)\b)?"
        r"|\d{1,2}\s*:\s*\d{2}\s*(?:AM|PM)\b)"
    )
    return "trim(" + rep(rep(e, date, r"\1 \2"), clock, r"\1 ") + ")"


def dimension_steps(src: str, text: str, prefix: str = "d") -> list[tuple[str, str]]:
    """CTEs that parse ``text`` of ``src``: kind, value, width, length_mm, rn, rd, qty, conf."""
    s0 = f"translate({text}, '‘’“”–—⁄', '''''\"\"--/')"
    clean = "trim(" + rep(rep(s0, r"(?i)DIA\.?", "DIA"), r"\s+", " ") + ")"
    one = f"SELECT *, {clean} AS s FROM {src}"
    unit = f"upper({ex('s', tx.METRIC, 2)})"
    noise = "trim(" + rep("s", tx.DIAMETER_NOISE, " ") + ")"
    im = tx.IMPERIAL_MIXED
    two = f"""SELECT *, {token(ex('s', tx.SLOT, 1))} AS sw, {token(ex('s', tx.SLOT, 2))} AS sl,
      CASE WHEN {has('s', tx.DIAMETER)} THEN {token(noise)} END AS bore,
      {feet('s', tx.FEET_INCHES)} AS ft,
      {num('s', tx.METRIC, 1)} * CASE {unit} WHEN 'CM' THEN 10 WHEN 'M' THEN 1000 ELSE 1 END AS metric,
      coalesce({num('s', im, 1)} + {div(num('s', im, 2), num('s', im, 3))},
        {div(num('s', tx.IMPERIAL_FRACTION, 1), num('s', tx.IMPERIAL_FRACTION, 2))},
        {num('s', tx.IMPERIAL_PLAIN)}) AS imp,
      {num('s', tx.RATIO, 1)} AS qn, {num('s', tx.RATIO, 2)} AS qd,
      nullif(CAST(coalesce({ex('s', tx.QTY_PAREN)}, {ex('s', tx.QTY_PREFIX)}) AS BIGINT), 0) AS qty
      FROM {prefix}1"""
    three = f"""SELECT *,
      CASE WHEN sw <> 0 AND sl <> 0 THEN 'slot' WHEN bore IS NOT NULL THEN 'diameter'
        WHEN coalesce(ft, metric, imp) IS NOT NULL THEN 'linear' WHEN qn IS NOT NULL THEN 'scale'
        ELSE 'unknown' END AS kind,
      CASE WHEN sw <> 0 AND sl <> 0 THEN 0.95 WHEN bore IS NOT NULL OR ft IS NOT NULL THEN 0.95
        WHEN metric IS NOT NULL THEN 0.90 WHEN imp IS NOT NULL THEN 0.85 WHEN qn IS NOT NULL THEN 0.80
        ELSE 0.10 END AS conf,
      CASE WHEN sw <> 0 AND sl <> 0 THEN NULL WHEN bore IS NOT NULL THEN bore * 25.4
        WHEN ft IS NOT NULL THEN ft * 25.4 WHEN metric IS NOT NULL THEN metric
        WHEN imp IS NOT NULL THEN imp * 25.4 END AS value
      FROM {prefix}2"""
    return [(f"{prefix}1", one), (f"{prefix}2", two), (f"{prefix}3", three)]


ACTION = (
    "CASE WHEN conf >= 0.85 THEN 'trusted' WHEN conf >= 0.75 THEN 'build_warn' "
    "WHEN conf >= 0.60 THEN 'candidate' ELSE 'report_only' END"
)
LOOP = "type = 'closed_loop' AND area > 0 AND n_points BETWEEN 1 AND 5"


# ---- geometry, style, text -------------------------------------------------------------

oracle(
    "assemble_primitives",
    """
SELECT path_id, sub_id,
  CASE WHEN n = 2 THEN 'line' WHEN closed THEN 'closed_loop' ELSE 'polyline' END AS type,
  n AS n_points, closed,
  round(list_min(list_transform(p, lambda q: q.x)), 4) AS bx0, round(list_min(list_transform(p, lambda q: q.y)), 4) AS by0,
  round(list_max(list_transform(p, lambda q: q.x)), 4) AS bx1, round(list_max(list_transform(p, lambda q: q.y)), 4) AS by1,
  CASE WHEN closed AND n >= 3 THEN round(abs(list_sum(list_transform(range(1, n + 1),
    lambda i: p[i].x * p[i % n + 1].y - p[i % n + 1].x * p[i].y))) / 2, 4) END AS area
FROM (SELECT path_id, sub_id, closed, p, len(p) AS n FROM thin) WHERE n >= 2
""",
    ("o1", """SELECT *, lag(op) OVER w AS po, lag(x1) OVER w AS px, lag(y1) OVER w AS py
       FROM v_ops WINDOW w AS (PARTITION BY path_id ORDER BY seq)"""),
    ("o2", """SELECT *, po IS NULL OR po IN ('h', 're', 'qu') AS fresh FROM o1"""),
    ("o3", """SELECT *, op IN ('m', 're', 'qu') OR (op IN ('l', 'c') AND (fresh OR (x0 IS NOT NULL AND
       sqrt((x0 - px) * (x0 - px) + (y0 - py) * (y0 - py)) > 0.01))) AS brk
       FROM o2 WHERE NOT (op = 'h' AND fresh)"""),
    ("o4", """SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY path_id ORDER BY seq) AS sub_id,
       CASE op WHEN 'm' THEN [{'x': x1, 'y': y1}]
         WHEN 'l' THEN CASE WHEN brk AND x0 IS NOT NULL THEN [{'x': x0, 'y': y0}, {'x': x1, 'y': y1}]
                       ELSE [{'x': x1, 'y': y1}] END
         WHEN 're' THEN [{'x': x0, 'y': y0}, {'x': x1, 'y': y0}, {'x': x1, 'y': y1}, {'x': x0, 'y': y1}, {'x': x0, 'y': y0}]
         WHEN 'qu' THEN [{'x': x0, 'y': y0}, {'x': c1x, 'y': c1y}, {'x': x1, 'y': y1}, {'x': c2x, 'y': c2y}, {'x': x0, 'y': y0}]
         WHEN 'c' THEN list_concat(CASE WHEN brk THEN [{'x': x0, 'y': y0}] ELSE [] END,
           list_transform(range(1, ns + 1), lambda i: {
             'x': (1-i/ns)**3*x0 + 3*(1-i/ns)**2*(i/ns)*c1x + 3*(1-i/ns)*(i/ns)**2*c2x + (i/ns)**3*x1,
             'y': (1-i/ns)**3*y0 + 3*(1-i/ns)**2*(i/ns)*c1y + 3*(1-i/ns)*(i/ns)**2*c2y + (i/ns)**3*y1}))
       END AS pts
       FROM (SELECT *, greatest(4, least(32, CAST(ceil(sqrt((x1-x0)**2 + (y1-y0)**2) / 0.5) AS BIGINT))) AS ns FROM o3)"""),
    ("subs", """SELECT path_id, sub_id, bool_or(op IN ('h', 're', 'qu')) AS closed,
       flatten(list(pts ORDER BY seq) FILTER (pts IS NOT NULL)) AS p FROM o4 GROUP BY ALL"""),
    ("thin", """SELECT path_id, sub_id, closed, list_reduce(list_transform(p, lambda q: [q]),
       lambda a, b: CASE WHEN sqrt((a[-1].x - b[1].x)**2 + (a[-1].y - b[1].y)**2) > 0.01
                    THEN list_concat(a, b) ELSE a END) AS p FROM subs WHERE len(p) > 0"""),
)

MM = f"{K!r} * 2"
oracle(
    "place_on_model",
    f"""
SELECT doc_id, page, n_prims, n_texts,
  {r('CASE rotation WHEN 90 THEN seen_w - y1 WHEN 180 THEN seen_w - x1 WHEN 270 THEN y0 ELSE x0 END * ' + MM)} AS min_x,
  {r('(seen_h - CASE rotation WHEN 90 THEN x1 WHEN 180 THEN seen_h - y0 WHEN 270 THEN seen_h - x0 ELSE y1 END) * ' + MM)} AS min_y,
  {r('CASE rotation WHEN 90 THEN seen_w - y0 WHEN 180 THEN seen_w - x0 WHEN 270 THEN y1 ELSE x1 END * ' + MM)} AS max_x,
  {r('(seen_h - CASE rotation WHEN 90 THEN x0 WHEN 180 THEN seen_h - y1 WHEN 270 THEN seen_h - x1 ELSE y0 END) * ' + MM)} AS max_y
FROM (
  SELECT doc_id, page, sum(p) AS n_prims, sum(t) AS n_texts, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
  FROM (SELECT doc_id, page, 1 AS p, 0 AS t, bx0 AS x0, by0 AS y0, bx1 AS x1, by1 AS y1 FROM v_prims
        UNION ALL SELECT doc_id, page, 0, 1, ix, iy, ix, iy FROM v_texts)
  GROUP BY ALL
) JOIN (SELECT doc_id, page, rotation, CASE WHEN rotation % 180 = 90 THEN width ELSE height END AS seen_h,
               CASE WHEN rotation % 180 = 90 THEN height ELSE width END AS seen_w FROM v_pages) USING (doc_id, page)
""",
)

ARC_STEPS = [
    ("ends", """SELECT prim_id, count(*) AS n, arg_min(x, seq) AS ax, arg_min(y, seq) AS ay,
       arg_max(x, seq) AS zx, arg_max(y, seq) AS zy FROM v_arcs GROUP BY 1"""),
    ("en2", """SELECT *, sqrt((ax-zx)**2 + (ay-zy)**2) AS end_gap,
       n - CASE WHEN $DROP AND sqrt((ax-zx)**2 + (ay-zy)**2) <= 1e-6 THEN 1 ELSE 0 END AS n_fit FROM ends"""),
    ("fp", "SELECT a.*, e.n, e.n_fit, e.end_gap FROM v_arcs a JOIN en2 e USING (prim_id)"),
    ("mean", "SELECT prim_id, avg(x) AS mx, avg(y) AS my FROM fp WHERE seq < n_fit GROUP BY 1"),
    ("mom", """SELECT prim_id, any_value(n_fit) AS m, sum(u) AS su, sum(w) AS sv, sum(u*u) AS uu, sum(w*w) AS vv,
       sum(u*w) AS uv, sum(u*u+w*w) AS z, sum(u*(u*u+w*w)) AS uz, sum(w*(u*u+w*w)) AS vz
       FROM (SELECT prim_id, n_fit, x - mx AS u, y - my AS w FROM fp JOIN mean USING (prim_id) WHERE seq < n_fit) GROUP BY 1"""),
    ("fit", """SELECT prim_id, a/2 + mx AS cx, b/2 + my AS cy, sqrt(greatest(0, c + a*a/4 + b*b/4)) AS r FROM (
       SELECT prim_id,
         (z*(uv*sv - su*vv) - sv*(uz*sv - su*vz) + m*(uz*vv - uv*vz)) / d AS a,
         (su*(uz*sv - su*vz) - z*(uu*sv - su*uv) + m*(uu*vz - uz*uv)) / d AS b,
         (su*(uv*vz - uz*vv) - sv*(uu*vz - uz*uv) + z*(uu*vv - uv*uv)) / d AS c
       FROM (SELECT *, su*(uv*sv - su*vv) - sv*(uu*sv - su*uv) + m*(uu*vv - uv*uv) AS d FROM mom) WHERE m >= 3 AND abs(d) >= 1e-12
     ) JOIN mean USING (prim_id)"""),
    ("res", """SELECT *, sqrt((x-cx)**2 + (y-cy)**2) - r AS e, degrees(atan2(y-cy, x-cx)) AS ang,
       x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, lead(x) OVER w - x AS fx, lead(y) OVER w - y AS fy
       FROM fp JOIN fit USING (prim_id) WINDOW w AS (PARTITION BY prim_id ORDER BY seq)"""),
    ("res2", """SELECT *, coalesce(ang - lag(ang) OVER w - 360 * round((ang - lag(ang) OVER w) / 360), 0) AS step,
       dx*fy - dy*fx AS crs, dx*fx + dy*fy AS dt, sqrt(dx*dx+dy*dy) AS la, sqrt(fx*fx+fy*fy) AS lb,
       seq <= n_fit - 2 AND sqrt(dx*dx+dy*dy) > 1e-9 AND sqrt(fx*fx+fy*fy) > 1e-9 AS turns
       FROM res WINDOW w AS (PARTITION BY prim_id ORDER BY seq)"""),
    ("res3", "SELECT *, sum(step) OVER (PARTITION BY prim_id ORDER BY seq) AS run FROM res2"),
    ("fact", """SELECT prim_id, any_value(closed) AS closed, any_value(n) AS n, any_value(n_fit) AS n_fit, any_value(end_gap) AS end_gap,
       any_value(cx) AS cx, any_value(cy) AS cy, any_value(r) AS r,
       sqrt(sum(e*e) FILTER (seq < n_fit) / any_value(n_fit)) AS rms, max(abs(e)) FILTER (seq < n_fit) AS max_err,
       sum(la) AS length, sum(step) AS sweep, max(run) - min(run) AS span_range,
       max(ang) FILTER (seq = 0) AS a0, max(ang) FILTER (seq = n_fit // 2) AS am, max(ang) FILTER (seq = n_fit - 1) AS az,
       coalesce(max(abs(degrees(atan2(crs, dt)))) FILTER (turns), 0) AS max_turn, count(*) FILTER (turns) AS turns,
       bool_or(turns AND crs > 1e-9) AND bool_or(turns AND crs < -1e-9) AS both_ways,
       count(*) FILTER (la > 0.01 AND lb > 0.01 AND abs(crs / (la*lb)) > 0.1) AS bends
       FROM res3 GROUP BY 1"""),
    ("fact2", """SELECT *, n_fit >= 5 AND max_turn <= 60 AND NOT both_ways AND turns >= 2 AS smooth,
       abs(am - mid - 360 * round((am - mid) / 360)) <= 90 AS minor
       FROM (SELECT *, a0 + 0.5 * (az - a0 - 360 * round((az - a0) / 360)) AS mid FROM fact)"""),
]


def arc_steps(drop: bool) -> list[tuple[str, str]]:
    return [(n, s.replace("$DROP", str(drop).lower())) for n, s in ARC_STEPS]


ORACLES["place_on_model_rotation"] = ORACLES["place_on_model"]
BOX = "(bx1 - bx0) * 2.5 AS w, (by1 - by0) * 2.5 AS h"
oracle(
    "uniform_scale",
    f"""SELECT kind, id, {", ".join(f"{r(c)} AS {c}" for c in ("x", "y", "w", "h", "size", "area"))} FROM (
      SELECT 'primitive' AS kind, prim_id AS id, bx0 * 2.5 AS x, by0 * 2.5 AS y, {BOX}, line_width * 2.5 AS size, area * 6.25 AS area FROM v_prims
      UNION ALL SELECT 'text', text_id, ix * 2.5, iy * 2.5, {BOX}, font_size * 2.5, NULL FROM v_texts
      UNION ALL SELECT 'image', ord, e * 2.5, f * 2.5, a * 2.5, d * 2.5, NULL, NULL FROM v_images
      UNION ALL SELECT 'page', pg, NULL, NULL, width * 2.5, height * 2.5, NULL, NULL FROM v_pages
      UNION ALL SELECT 'point', prim_id, x * 2.5, y * 2.5, NULL, NULL, NULL, NULL FROM v_points)""",
)

oracle(
    "run_shape",
    f"""SELECT prim_id, n, {r('length', 3)} AS length, {r('max_turn', 3)} AS max_turn, turns, bends,
       {r('abs(sweep)', 3)} AS span, smooth, n >= 4 AND bends >= 3 AS curved, minor AS minor_sweep FROM fact2""",
    *arc_steps(True),
)
oracle(
    "circle_fit",
    f"""SELECT prim_id, any_value(n) AS n, {r('any_value(cx)', 3)} AS cx, {r('any_value(cy)', 3)} AS cy,
       {r('any_value(r)', 3)} AS r, {r('sqrt(avg(e*e))', 3)} AS rms FROM res GROUP BY 1""",
    *arc_steps(False)[:7],
)
PROMOTED = f"""SELECT prim_id, type, {r('cx', 3)} AS cx, {r('cy', 3)} AS cy, {r('r', 3)} AS r,
  {r("CASE WHEN type = 'circle' THEN 0 ELSE ((lo % 360) + 360) % 360 END", 3)} AS start_deg,
  {r("CASE WHEN type = 'circle' THEN 360 ELSE ((hi % 360) + 360) % 360 END", 3)} AS end_deg
  FROM (SELECT *, least(a0, a0 + sweep) AS lo, greatest(a0, a0 + sweep) AS hi, $KIND AS type FROM fact2) WHERE type IS NOT NULL"""
oracle(
    "promote_arcs",
    PROMOTED.replace("$KIND", """CASE WHEN NOT (n >= 5 AND n_fit >= 5 AND r > 0.1 AND rms <= greatest(0.05, r*0.005)
      AND max_err <= greatest(1.8*greatest(0.05, r*0.005), r*0.008)) THEN NULL
      WHEN end_gap <= greatest(0.25, r*0.01) AND abs(sweep) >= 350 THEN CASE WHEN n_fit >= 10 THEN 'circle' END
      WHEN NOT closed AND n_fit <= 65 AND abs(sweep) >= 5 AND smooth AND minor THEN 'arc' END"""),
    *arc_steps(True),
)
oracle(
    "promote_arcs_loose",
    PROMOTED.replace("$KIND", """CASE WHEN NOT (n >= 6 AND rms <= 0.2 AND r > 0) THEN NULL
      WHEN closed AND span_range >= 330 THEN 'circle' WHEN span_range >= 8 THEN 'arc' END"""),
    *arc_steps(False),
)
FITS = ("fits", "SELECT prim_id, any_value(closed) AS closed, any_value(n) AS n, any_value(cx) AS cx, any_value(cy) AS cy, "
        "any_value(r) AS r, sqrt(avg(e*e)) AS rms FROM res GROUP BY 1")
oracle(
    "find_circles",
    f"""SELECT -prim_id - 1 AS prim_id, {r('cx', 3)} AS cx, {r('cy', 3)} AS cy, {r('radius', 3)} AS radius,
       CAST(0 AS DOUBLE) AS rms, 'given' AS origin FROM v_prims WHERE type = 'circle'
       UNION ALL SELECT prim_id, {r('cx', 3)}, {r('cy', 3)}, {r('r', 3)}, {r('rms', 3)}, 'fit' FROM fits
       WHERE closed AND n >= 6 AND rms < 0.25""",
    *arc_steps(False)[:7], FITS,
)

VARIANT = "list_min([" + ", ".join(
    f"{{'d': abs({size} - $R), 'i': {i}, 'name': '{name}', 'size': {size}}}"
    for i, (name, size) in enumerate(DASH_VARIANTS)
) + "])"
DASH_STEPS = [
    ("dash1", """SELECT DISTINCT dash, list_transform(list_filter(string_split_regex(trim(regexp_extract(dash, '\\[([^\\]]*)\\]', 1)), '\\s+'),
       lambda w: w <> ''), lambda w: CAST(w AS DOUBLE)) AS vals FROM v_prims WHERE dash IS NOT NULL"""),
    ("dash2", f"SELECT dash, list_transform(list_filter(vals, lambda q: q <> 0), lambda q: greatest(0.1, abs(q) * {K!r})) AS mm FROM dash1"),
    ("dash3", "SELECT dash, CASE WHEN len(mm) % 2 = 1 THEN list_append(mm, mm[-1]) ELSE mm END AS mm FROM dash2 WHERE len(mm) >= 2"),
    ("dash4", "SELECT dash, mm, list_transform(range(1, len(mm) + 1, 2), lambda i: mm[i]) AS ds FROM dash3"),
    ("dash5", """SELECT dash, mm, len(ds) AS n, list_max(ds) AS longest, len(list_filter(ds, lambda q: q <= 0.75)) AS dots,
       len(list_filter(ds, lambda q: q > 0.75)) AS longs,
       len(list_filter(ds, lambda q: abs(q - list_max(ds)) > 0.35 * list_max(ds))) = 0 AS even FROM dash4"""),
    ("dash6", f"""SELECT *, CASE WHEN longs = 0 THEN 'DOT' WHEN n = 1 OR even THEN 'DASHED' WHEN n = 2 THEN CASE WHEN dots > 0 THEN 'DASHDOT' ELSE 'CENTER' END
       WHEN dots >= 2 AND longs = 1 THEN 'DIVIDE' WHEN longs >= 2 AND dots >= 1 THEN 'BORDER' ELSE 'CENTER' END AS family,
       {VARIANT.replace('$R', 'CASE WHEN longs = 0 THEN list_max(mm) ELSE longest END')} AS va FROM dash5"""),
    ("dashes", """SELECT dash, concat(family, va.name) AS linetype,
       round(least(greatest(longest / va.size, 0.05), 20.0), 4) AS ltscale FROM dash6"""),
]


def byte(e: str) -> str:
    return f"CAST(least(greatest(round_even({e} * 255, 0), 0), 255) AS BIGINT)"


def layer(color: str = "s") -> str:
    cr, cg, cb = (f"$C{k}".replace("$C", color) for k in "rgb")
    key = f"printf('RGB_%03d_%03d_%03d', {byte(cr)}, {byte(cg)}, {byte(cb)})"
    return (
        f"concat_ws('_', printf('P%03d', page), CASE WHEN layer IS NOT NULL AND layer <> '' THEN "
        f"trim(regexp_replace(trim(layer), '[^\\pL\\pN_-]', '_', 'g'), '_') WHEN {cr} IS NOT NULL THEN {key} END)"
    )


WEIGHT = "CAST(least(greatest(round_even(line_width * 100, 0), 5), 211) AS BIGINT)"
oracle(
    "style_profile",
    f"""SELECT doc_id, {layer()} AS layer, coalesce(linetype, 'CONTINUOUS') AS linetype, {WEIGHT} AS lineweight,
      count(*) AS segments, {r('sum(sqrt((x1-x0)**2 + (y1-y0)**2))')} AS total_length,
      count(DISTINCT CASE WHEN sr IS NOT NULL THEN concat({byte('(0.5*sr+0.5)')}, '-', {byte('(0.5*sg+0.5)')}, '-', {byte('(0.5*sb+0.5)')}) END) AS colors,
      max(ltscale) + 0.0 AS ltscale
    FROM v_prims LEFT JOIN dashes USING (dash) GROUP BY 1, 2, 3, 4""",
    *DASH_STEPS,
)
def shown(ch: str, a: str) -> str:
    """A channel on white paper as a byte."""
    return f"CASE WHEN {ch} IS NOT NULL THEN " + byte(f"(CASE WHEN {a} IS NULL OR isnan({a}) OR {a} >= 1 THEN {ch} ELSE least(1, greatest(0, greatest({a}, 0) * {ch} + (1 - greatest({a}, 0)))) END)") + " END"


def packed(shift: int) -> str:
    return f"CAST((packed >> {shift}) & 255 AS DOUBLE) / 255"


def unit(e: str) -> str:
    return f"least(1.0, greatest(0.0, {e}))"


oracle(
    "paint_use",
    f"""SELECT doc_id, 'stroke' AS kind, {', '.join(f"{shown('c' + k, 'opacity')} AS {k}" for k in 'rgb')}, count(*) AS n FROM raw GROUP BY ALL
      UNION ALL SELECT doc_id, 'text', {', '.join(f"{shown(packed(s), 'CASE WHEN flags IS NULL OR flags & 48 <> 0 THEN alpha / 255.0::DOUBLE END')} AS {k}" for s, k in ((16, 'r'), (8, 'g'), (0, 'b')))},
        count(*) FROM v_spans GROUP BY ALL""",
    ("raw", f"SELECT doc_id, opacity, " + ", ".join(
        f"""CASE WHEN packed >= 0 THEN {packed(s)} WHEN packed < 0 THEN NULL WHEN n_parts = 1 THEN {unit('p1')}
          WHEN n_parts = 3 THEN {unit(p)} WHEN n_parts = 4 THEN (1 - {unit(p)}) * (1 - {unit('p4')}) END AS c{k}"""
        for k, p, s in (("r", "p1", 16), ("g", "p2", 8), ("b", "p3", 0))) + " FROM v_paints"),
)
oracle(
    "plain_linetypes",
    """SELECT doc_id, CASE WHEN n = 0 OR tot < 0.01 THEN 'CONTINUOUS' WHEN n = 1 THEN 'DASHED'
        WHEN n = 2 THEN CASE WHEN m[1] < 0.01 THEN 'DOTTED' WHEN m[2] > m[1] * 2 THEN 'DASHED' ELSE 'CENTER' END
        WHEN n = 4 THEN CASE WHEN m[3] < 0.05 THEN 'DASHDOT' ELSE 'CENTER' END
        WHEN n >= 6 THEN CASE WHEN len(list_filter(m, lambda q: q < 0.05)) >= 2 THEN 'DASHDOTDOT' ELSE 'PHANTOM' END
        ELSE 'DASHED' END AS linetype, count(*) AS n
      FROM (SELECT doc_id, m, len(m) AS n, coalesce(list_sum(m), 0) AS tot FROM (
        SELECT doc_id, list_transform(list_filter(string_split(regexp_extract(dash, '\\[([^\\]]*)\\]', 1), ' '), lambda w: w <> ''), lambda w: abs(CAST(w AS DOUBLE))) AS m
        FROM v_paints)) GROUP BY 1, 2""",
)
oracle(
    "image_screen",
    f"""SELECT doc_id, page, placements, skewed, CASE WHEN z*72 + 1e-9 >= 36 THEN {r('z * 72')} END AS dpi FROM (
      SELECT doc_id, page, placements, skewed, least(200.0/72, sqrt(16000000.0 / (width*height)), 8192.0/width, 8192.0/height) AS z
      FROM (SELECT doc_id, page, count(*) AS placements, sum(CASE WHEN a > 0 AND d > 0 AND b = 0 AND c = 0 THEN 0 ELSE 1 END) AS skewed
            FROM v_images GROUP BY 1, 2) JOIN v_pages USING (doc_id, page))""",
)
W_UNITS = (
    "(0.55 * (length(text) - length(translate(text, '0123456789', ''))) + 0.30 * (length(text) - length(translate(text, ' /''-\".', ''))) "
    "+ 0.95 * (length(text) - length(translate(text, 'MW@#%', ''))) + 0.65 * length(translate(text, '0123456789 /''-\".MW@#%', '')))"
)
oracle(
    "text_annotations",
    "SELECT doc_id, page, font_name, count(*) AS items, " + r(f"sum({W_UNITS})") + " AS width_units, "
    + r("sum(coalesce(nominal_size, raw_size * CASE WHEN sqrt(mc*mc+md*md) >= 1e-6 THEN sqrt(mc*mc+md*md) ELSE sqrt(ma*ma+mb*mb) END, 3.0))")
    + " AS font_size, "
    + r("sum(CASE WHEN abs(rotation) >= 45 THEN least(w, h) ELSE h END)") + " AS glyph_height, "
    + r("sum(CASE WHEN abs(rotation) >= 45 THEN greatest(w, h) ELSE w END)") + " AS glyph_width, "
    + ", ".join(f"CAST(count(*) FILTER ({tag(t)}) AS BIGINT) AS {t}" for t in tx.TAGS)
    + " FROM (SELECT *, bx1 - bx0 AS w, by1 - by0 AS h FROM v_texts) GROUP BY 1, 2, 3",
)
SPLIT = " OR ".join(
    f"(right(q, {len(str(d))}) = '{d}' AND length(q) > {len(str(d))} AND TRY_CAST(left(q, length(q) - {len(str(d))}) AS BIGINT) BETWEEN 1 AND {d - 1})"
    for d in (64, 32, 16, 8, 4, 2)
)
oracle(
    "dimension_facts",
    f"""SELECT doc_id, kind, {ACTION} AS action, count(*) AS n, {r('min(val)', 6)} AS min_value, {r('avg(val)', 6)} AS avg_value,
      {r('max(val)', 6)} AS max_value, sum(qty) AS quantity, {r('sum(inch)', 6)} AS inches,
      count(*) FILTER (split) AS splits, count(*) FILTER (temporal) AS temporal
    FROM (SELECT *, coalesce(value, CASE kind WHEN 'slot' THEN sl * 25.4 WHEN 'scale' THEN qd END) AS val, {length_in('text')} AS inch,
          {has('q', '^[0-9][0-9]+$')} AND ({SPLIT}) AS split, {strip_time('text')} <> trim(text) AS temporal
          FROM (SELECT *, trim(text) AS q FROM d3)) GROUP BY 1, 2, 3""",
    *dimension_steps("v_texts", "text"),
)
oracle(
    "dimension_sql",
    f"""SELECT doc_id, kind, {ACTION} AS action, count(*) AS n, {r("sum(coalesce(value, CASE kind WHEN 'slot' THEN sl * 25.4 WHEN 'scale' THEN qd END))")} AS total,
      {r("sum(CASE kind WHEN 'slot' THEN sw * 25.4 END)")} AS width, sum(qty) AS quantity FROM d3 GROUP BY 1, 2, 3""",
    *dimension_steps("v_texts", "text"),
)
NAMES = r"(?im)(\b(?:api[_-]?key|token|secret|password|client[_-]?secret)\b\s*[:=]\s*)"
masked = rep("text", NAMES + "\"([^\"']+)\"", '\\1"<REDACTED>"')
masked = rep(masked, NAMES + "'([^\"']+)'", "\\1'<REDACTED>'")
masked = rep(masked, tx.PRIVATE_KEY, "<REDACTED_PRIVATE_KEY_BLOCK>")
BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"
oracle(
    "redaction_report",
    f"""SELECT source, lang, count(*) AS docs, count(*) FILTER (m <> text) AS masked, count(*) FILTER (len(ls) > 40) AS clipped,
      sum(length(text)) AS chars_in,
      sum(CASE WHEN len(ls) > 40 THEN length(array_to_string(ls[1:20], chr(10))) + length(array_to_string(ls[-10:], chr(10))) + 21 ELSE length(m) END) AS chars_out
    FROM (SELECT source, lang, text, m, string_split_regex(regexp_replace(m, '(?:' || {lit(BREAKS)} || ')\\z', ''), {lit(BREAKS)}) AS ls
          FROM (SELECT source, lang, text, {masked} AS m FROM documents)) GROUP BY 1, 2""",
)
STACK = "SELECT doc_id, page, width, height, -coalesce(sum(greatest(height, 1) * $F) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dy FROM v_pages"


def palette(p: str) -> str:
    b = [f"CAST(round_even({p}{k} * 255, 0) AS BIGINT)" for k in "rgb"]
    best = "list_min([" + ", ".join(
        f"{{'d': ({b[0]} - {x})**2 + ({b[1]} - {y})**2 + ({b[2]} - {z})**2, 'p': {i}, 'idx': {idx}}}"
        for i, (x, y, z, idx) in enumerate(PALETTE)
    ) + "]).idx"
    return f"CAST(CASE WHEN {p}r IS NULL THEN NULL WHEN {b[0]} > 245 AND {b[1]} > 245 AND {b[2]} > 245 THEN 7 ELSE {best} END AS BIGINT)"


oracle(
    "nearest_palette",
    f"SELECT sr, sg, sb, count(*) AS n, {palette('s')} AS palette FROM v_prims WHERE sr IS NOT NULL GROUP BY 1, 2, 3",
)
oracle(
    "entity_table",
    f"""SELECT prim_id, doc_id, page, kind, CASE WHEN sr IS NOT NULL THEN {layer('s')} ELSE {layer('f')} END AS layer,
      CASE WHEN kind <> 'fill' THEN coalesce(linetype, 'CONTINUOUS') END AS linetype,
      CASE WHEN kind <> 'fill' THEN ltscale END AS ltscale,
      CASE WHEN kind <> 'fill' THEN {WEIGHT} END AS lineweight,
      CASE WHEN kind = 'fill' THEN {palette('f')} ELSE {palette('s')} END AS palette,
      x0, {r('y0 + dy')} AS y0, x1, {r('y1 + dy')} AS y1, radius
    FROM (
      SELECT p.*, s.dy, 'fill' AS kind FROM v_prims p JOIN stack s USING (doc_id, page)
      WHERE fr IS NOT NULL AND bx1 > bx0 AND by1 > by0 AND n_points >= 3
        AND NOT (sr IS NULL AND fr >= 0.995 AND fg >= 0.995 AND fb >= 0.995 AND bx0 = 0 AND by0 = 0 AND bx1 = width AND by1 = height)
      UNION ALL
      SELECT p.*, s.dy, CASE WHEN type = 'line' AND n_points = 2 THEN 'line' WHEN type = 'circle' THEN 'circle' ELSE 'polyline' END
      FROM v_prims p JOIN stack s USING (doc_id, page) WHERE sr IS NOT NULL
    ) LEFT JOIN dashes USING (dash)""",
    *DASH_STEPS, ("stack", STACK.replace("$F", "1.2")),
)

oracle(
    "entity_points",
    f"""SELECT prim_id, doc_id, page, 'line' AS kind, false AS closed, CAST(k AS BIGINT) AS position, CASE k WHEN 0 THEN x0 ELSE x1 END AS x,
      {r('CASE k WHEN 0 THEN y0 ELSE y1 END + dy')} AS y
    FROM v_prims JOIN stack USING (doc_id, page), (VALUES (0), (1)) t(k) WHERE sr IS NOT NULL AND type = 'line' AND n_points = 2
    UNION ALL
    SELECT prim_id, doc_id, page, kind, closed, seq AS position, x, {r('y + dy')} AS y FROM (
      SELECT prim_id, p.doc_id, p.page, s.dy, 'fill' AS kind, true AS closed FROM v_prims p JOIN stack s USING (doc_id, page)
      WHERE fr IS NOT NULL AND bx1 > bx0 AND by1 > by0 AND n_points >= 3
        AND NOT (sr IS NULL AND fr >= 0.995 AND fg >= 0.995 AND fb >= 0.995 AND bx0 = 0 AND by0 = 0 AND bx1 = width AND by1 = height)
      UNION ALL
      SELECT prim_id, p.doc_id, p.page, s.dy, 'polyline', closed FROM v_prims p JOIN stack s USING (doc_id, page)
      WHERE sr IS NOT NULL AND NOT (type = 'line' AND n_points = 2) AND type <> 'circle' AND n_points >= 2
    ) JOIN (SELECT prim_id, seq, x, y FROM v_points) USING (prim_id)""",
    ("stack", STACK.replace("$F", "1.2")),
)

# ---- filters and page rules --------------------------------------------------------------

MICRO = "type = 'line' AND n_points = 2 AND sqrt((x1-x0)**2 + (y1-y0)**2) < 6"
oracle("prune_micro", f"SELECT doc_id, page, count(*) FILTER (NOT ({MICRO})) AS kept, count(*) FILTER ({MICRO}) AS removed FROM v_prims GROUP BY 1, 2")
oracle(
    "tag_primitives",
    f"""SELECT prim_id, doc_id, page, concat_ws(',', CASE WHEN regexp_matches(dash, '[0-9]+[^\\]]*\\]') THEN 'dashed_line' END,
      CASE WHEN {LOOP} AND area > width*height*0.7 THEN 'page_border' END,
      CASE WHEN {LOOP} AND area < 50 THEN 'possible_table_cell' END,
      CASE WHEN line_width < 0.3 THEN 'thin_line' END) AS tags FROM v_prims JOIN v_pages USING (doc_id, page)""",
)
COUNTS = ("counts", """SELECT doc_id, page, sum(p) AS n_prims, sum(t) AS n_texts FROM
  (SELECT doc_id, page, 1 AS p, 0 AS t FROM v_prims UNION ALL SELECT doc_id, page, 0, 1 FROM v_texts) GROUP BY 1, 2""")
oracle(
    "text_cloud_page",
    "SELECT *, n_prims > 0 AND n_texts >= 4 AND n_texts / greatest(n_prims, 1) >= 0.12 AS text_cloud FROM counts",
    COUNTS,
)
FRAMES = ("frames", """SELECT doc_id, page, n_prims, n_texts, n_prims BETWEEN 1 AND 45 AND n_texts <= 12
  AND coalesce(big, 0) / (width*height) >= 0.88 AS frame_only
  FROM counts JOIN v_pages USING (doc_id, page) LEFT JOIN
  (SELECT doc_id, page, max(abs(bx1-bx0)*abs(by1-by0)) AS big FROM v_prims GROUP BY 1, 2) USING (doc_id, page)""")
oracle("frame_only_page", "SELECT * FROM frames", COUNTS, FRAMES)
oracle(
    "visible_fill",
    """SELECT prim_id, m >= 3 AND spans AND NOT retrace AS visible FROM (
      SELECT prim_id, m, p,
        len(list_filter(p, lambda q: (a.x - p[1].x) * (q.y - p[1].y) - (a.y - p[1].y) * (q.x - p[1].x) <> 0)) > 0 AS spans,
        len(list_filter(range(1, m + 1), lambda i: len(list_filter(range(1, m + 1), lambda j: p[j] = p[i] AND p[j % m + 1] = p[i % m + 1]))
          <> len(list_filter(range(1, m + 1), lambda j: p[j] = p[i % m + 1] AND p[j % m + 1] = p[i])))) = 0 AS retrace
      FROM (SELECT *, list_filter(p, lambda q: greatest(abs(q.x - p[1].x), abs(q.y - p[1].y)) = far)[1] AS a FROM (
        SELECT *, list_max(list_transform(p, lambda q: greatest(abs(q.x - p[1].x), abs(q.y - p[1].y)))) AS far FROM ring)))""",
    ("d0", """SELECT prim_id, seq, x, y FROM (SELECT *, lag(x) OVER w AS lx, lag(y) OVER w AS ly FROM v_points WHERE closed
       WINDOW w AS (PARTITION BY prim_id ORDER BY seq)) WHERE lx IS NULL OR lx <> x OR ly <> y"""),
    ("r0", "SELECT prim_id, list({'x': x, 'y': y} ORDER BY seq) AS p FROM d0 GROUP BY 1"),
    ("ring", "SELECT prim_id, p, len(p) AS m FROM (SELECT prim_id, CASE WHEN len(p) >= 2 AND p[1] = p[-1] THEN p[1:len(p)-1] ELSE p END AS p FROM r0)"),
)
oracle(
    "redundant_page_fill",
    """SELECT prim_id, doc_id, page FROM v_prims JOIN v_pages USING (doc_id, page) WHERE sr IS NULL AND fr >= 0.995 AND fg >= 0.995 AND fb >= 0.995
      AND abs(bx0) <= 1e-4 AND abs(by0) <= 1e-4 AND abs(bx1 - width) <= 1e-4 AND abs(by1 - height) <= 1e-4""",
)
PROFILE_STEPS = [
    *arc_steps(False)[:7], FITS,
    ("hdr", """SELECT doc_id, page, type, layer FROM v_prims UNION ALL
       SELECT pg // 3, 1 + pg % 3, CASE WHEN closed THEN 'closed_loop' ELSE 'polyline' END, NULL FROM v_arcs WHERE seq = 0"""),
    ("geo", """SELECT doc_id, page, count(*) FILTER (type = 'line') AS l, count(*) FILTER (type = 'closed_loop') AS cl,
       count(*) FILTER (type = 'polyline') AS pl, count(*) FILTER (type = 'circle') AS c0, count(*) AS g,
       count(*) FILTER (trim(layer) <> '') AS ly FROM hdr GROUP BY 1, 2"""),
    ("rnd", """SELECT pg // 3 AS doc_id, 1 + pg % 3 AS page, count(*) AS c1 FROM fits JOIN (SELECT prim_id, pg FROM v_arcs WHERE seq = 0) USING (prim_id)
       WHERE closed AND n >= 8 AND rms < 0.5 GROUP BY 1, 2"""),
    ("tex", "SELECT doc_id, page, count(*) AS t, " + ", ".join(
        f"count(*) FILTER ({tag(full)}) AS {short}" for short, full in
        (("dm", "dimension_like"), ("sc", "scale_like"), ("tb", "titleblock_like"), ("co", "callout_like")))
     + " FROM v_texts GROUP BY 1, 2"),
    ("pf", """SELECT doc_id, page, coalesce(l,0) AS l, coalesce(cl,0) AS cl, coalesce(pl,0) AS pl, coalesce(c0,0) + coalesce(c1,0) AS c,
       coalesce(g,0) AS g, coalesce(ly,0) > 0 AS ly, coalesce(t,0) AS t, coalesce(dm,0) AS dm, coalesce(sc,0) AS sc, coalesce(tb,0) AS tb, coalesce(co,0) AS co
       FROM v_pages LEFT JOIN geo USING (doc_id, page) LEFT JOIN rnd USING (doc_id, page) LEFT JOIN tex USING (doc_id, page)"""),
    ("scored", """SELECT *,
       0.2*(c>3)::INT + 0.15*(co>2)::INT + 0.15*(dm>5)::INT + 0.1*(cl>10)::INT + 0.1*(tb>2)::INT + 0.1*(sc>0)::INT AS fabrication,
       0.2*(l>50)::INT + 0.15*(dm>3)::INT + 0.15*ly::INT + 0.1*(cl>5)::INT + 0.1*(sc>0)::INT + 0.1*(tb>0)::INT AS cad_drawing,
       greatest(0, 0.2*(l>100)::INT + 0.15*ly::INT + 0.15*(dm>10)::INT + 0.1*(t>30)::INT - 0.15*(c>10)::INT) AS architectural,
       greatest(0, 0.3*(g>20 AND dm=0)::INT + 0.2*(pl>l)::INT + 0.1*(t<5)::INT - 0.2*ly::INT - 0.2*(dm>2)::INT) AS vector_art,
       CASE WHEN g=0 AND t=0 THEN 0.9 ELSE 0 END AS raster_only FROM pf"""),
    ("profile", """SELECT doc_id, page,
       CASE WHEN top < 0.25 THEN CASE WHEN g > 0 THEN 'cad_drawing' ELSE 'unknown' END WHEN fabrication = top THEN 'fabrication' WHEN cad_drawing = top THEN 'cad_drawing'
         WHEN architectural = top THEN 'architectural' WHEN vector_art = top THEN 'vector_art' ELSE 'raster_only' END AS primary_type,
       CAST(fabrication AS DOUBLE) AS fabrication, CAST(cad_drawing AS DOUBLE) AS cad_drawing, CAST(architectural AS DOUBLE) AS architectural,
       CAST(vector_art AS DOUBLE) AS vector_art, CAST(raster_only AS DOUBLE) AS raster_only,
       ly AS has_layers, t > 0 AS has_text, dm > 0 AS has_dimensions, c AS circle_count, cl AS closed_loop_count, l AS line_count, t AS text_count, tb > 2 AS titleblock_likely
       FROM (SELECT *, greatest(fabrication, cad_drawing, architectural, vector_art, raster_only) AS top FROM scored)"""),
]
oracle("page_profile", "SELECT * FROM profile", *PROFILE_STEPS)


def class_steps(variant: str) -> list[tuple[str, str]]:
    core = variant == "core"
    a = "abs(bx1-bx0)*abs(by1-by0)"
    one = "n_items = 1 AND op = 're'"
    tiny = f"{one} AND " + ("abs(bx1-bx0) < 5 AND abs(by1-by0) < 5" if core else f"{a} <= 36")
    rect = f"CASE WHEN {one} THEN {a} ELSE 0 END" if core else a
    glyph = "n >= 40 AND fl >= 0.30 AND sk <= 0.86"
    wordy = f"{glyph} AND (bl >= 5 OR wd >= 14)" + ("" if core else " AND ty >= 0.10 AND av <= 8")
    pure = "fo >= 0.15 AND sk <= 0.84 AND av <= 5 AND n >= 12 AND (it >= 70 OR lg >= 0.5)"
    heavy = "n >= 30 AND fo >= 0.17 AND sk <= 0.83 AND av <= 5"
    rest = (
        f"WHEN fo >= 0.20 AND sk <= 0.80 AND it >= 40 THEN 'complex_fill' WHEN {pure} THEN 'pure_fill' WHEN {heavy} THEN 'heavy_fill'"
        if core else f"WHEN {heavy} THEN 'heavy_fill' WHEN {pure} THEN 'pure_fill'"
    )
    x = variant[0]
    return [
        (f"{x}1", f"""SELECT doc_id, page, count(*) AS n, count(fr) / count(*) AS fl, count(sr) / count(*) AS sk,
           count(*) FILTER (fr IS NOT NULL AND sr IS NULL) / count(*) AS fo, count(*) FILTER ({tiny}) / count(*) AS ty, sum(n_items) AS it,
           sum(n_items) / count(*) AS av, max({rect}) AS rc FROM v_prims GROUP BY 1, 2"""),
        (f"{x}2", """SELECT doc_id, page, count(*) AS bl, sum(len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> ''))) AS wd
           FROM v_texts GROUP BY 1, 2"""),
        (f"{x}3", f"""SELECT doc_id, page, coalesce(n, 0) AS n, fl, sk, fo, ty, it, av, rc / (width*height) AS lg, coalesce(bl, 0) AS bl, coalesce(wd, 0) AS wd
           FROM v_pages LEFT JOIN {x}1 USING (doc_id, page) LEFT JOIN {x}2 USING (doc_id, page)"""),
        (f"{x}4", f"""SELECT *, CASE WHEN n = 0 THEN CASE WHEN bl > 0 THEN 'text_only' ELSE 'no_vectors' END
           WHEN {glyph} AND ty >= 0.04 THEN 'glyph_dense' WHEN {wordy} THEN 'glyph_text' {rest} ELSE 'normal' END AS rule FROM {x}3"""),
        (f"class_{variant}", f"""SELECT *, CASE WHEN rule = 'text_only' THEN 'text_only' WHEN rule = 'no_vectors' THEN 'raster_candidate'
           WHEN rule LIKE 'glyph%' THEN 'glyph_flood' WHEN rule LIKE '%fill' THEN 'fill_art' ELSE 'vectors' END AS type FROM {x}4"""),
    ]


CLASS_COLS = f"""doc_id, page, type, rule, n AS drawings, bl AS text_count, CAST(wd AS BIGINT) AS words, {r('fl')} AS fill_ratio, {r('sk')} AS stroke_ratio,
  {r('fo')} AS fill_only_ratio, {r('ty')} AS tiny_ratio, {r('av')} AS avg_items, {r('lg')} AS max_rect_ratio"""
oracle(
    "page_content_class",
    f"SELECT {CLASS_COLS}, 'core' AS variant FROM class_core UNION ALL SELECT {CLASS_COLS}, 'page' FROM class_page",
    *class_steps("core"), *class_steps("page"),
)
MODE_STEPS = [
    *class_steps("page"), COUNTS, FRAMES,
    ("modes", """SELECT doc_id, page, type, CASE WHEN flood OR cloud OR frame THEN 'raster' ELSE 'vector' END AS mode,
       CASE WHEN flood THEN concat_ws(':', type, rule) WHEN cloud THEN 'text_cloud_fallback' WHEN frame THEN 'frame_only_fallback' ELSE rule END AS reason
       FROM (SELECT c.*, type IN ('glyph_flood', 'fill_art', 'raster_candidate') AS flood,
             n > 0 AND bl >= 5 AND bl / greatest(n, 1) >= 0.12 AS cloud, coalesce(frame_only, false) AS frame
             FROM class_page c LEFT JOIN frames USING (doc_id, page))"""),
]
oracle(
    "resolve_import_mode",
    """SELECT doc_id, page, m.type, mode, reason,
      CASE WHEN n = 0 AND bl = 0 THEN 'raster' WHEN c.type IN ('text_only', 'vectors') THEN CASE WHEN page = 2 THEN 'hybrid' ELSE 'vector' END ELSE 'raster' END AS suggested_mode,
      CASE WHEN n = 0 AND bl = 0 THEN 'no_vector_content' WHEN c.type = 'text_only' THEN CASE WHEN page = 2 THEN 'text_with_images' ELSE 'text_only' END
        WHEN c.type = 'vectors' THEN CASE WHEN page = 2 THEN 'vectors_with_images' ELSE 'vectors' END
        ELSE concat_ws(':', c.type, c.rule) END AS suggested_reason
    FROM modes m JOIN class_core c USING (doc_id, page)""",
    *MODE_STEPS, *class_steps("core"),
)
oracle("page_layers", "SELECT doc_id, page, trim(layer) AS layer, count(*) AS prims FROM v_prims WHERE trim(layer) <> '' GROUP BY 1, 2, 3")
BOUNDS = ("pb", """SELECT doc_id, page, coalesce(x0, 0) AS x0, coalesce(y0, 0) AS y0, coalesce(x1, width) AS x1, coalesce(y1, height) AS y1 FROM v_pages LEFT JOIN
  (SELECT doc_id, page, min(bx0) AS x0, min(by0) AS y0, max(bx1) AS x1, max(by1) AS y1 FROM
    (SELECT doc_id, page, bx0, by0, bx1, by1 FROM v_prims UNION ALL SELECT doc_id, page, bx0, by0, bx1, by1 FROM v_texts) GROUP BY 1, 2) USING (doc_id, page)""")
DOC_BOX = """SELECT doc_id, x0 - p AS min_x, y0 - p AS min_y, x1 + p AS max_x, y1 + p AS max_y FROM
  (SELECT *, greatest(greatest(x1-x0, y1-y0, 1) * 0.02, 1) AS p FROM
   (SELECT doc_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM $T GROUP BY 1))"""
oracle(
    "import_bounds",
    f"SELECT doc_id, {r('min_x')} AS min_x, {r('min_y')} AS min_y, {r('max_x')} AS max_x, {r('max_y')} AS max_y FROM box",
    BOUNDS, ("box", DOC_BOX.replace("$T", "pb")),
)
oracle(
    "framing",
    f"""SELECT doc_id, {r('min_x')} AS min_x, {r('min_y')} AS min_y, {r('max_x')} AS max_x, {r('max_y')} AS max_y,
      {r('(min_x+max_x)*0.5')} AS center_x, {r('(min_y+max_y)*0.5')} AS center_y, {r('greatest(1, max_x-min_x, max_y-min_y)*1.1')} AS view_height FROM box""",
    BOUNDS, ("stack", STACK.replace("$F", "1.2")),
    ("moved", "SELECT doc_id, x0, y0 + dy AS y0, x1, y1 + dy AS y1 FROM pb JOIN stack USING (doc_id, page)"),
    ("box", DOC_BOX.replace("$T", "moved")),
)
oracle(
    "title_block",
    f"""SELECT b.* FROM (SELECT doc_id, page, count(*) AS texts, min(ix)-1 AS x0, min(iy)-1 AS y0, max(ix)+1 AS x1, max(iy)+1 AS y1
      FROM v_texts WHERE {tag('titleblock_like')} GROUP BY 1, 2) b JOIN v_pages USING (doc_id, page) WHERE texts >= 2 AND y1 < height*0.4""",
)
oracle(
    "document_summary",
    """SELECT doc_id, pages, primitives, text_items, images, source_instances, vector, raster, hybrid, inline_images, xobject_images,
      concat(pages, ' pages: ', concat_ws(', ', CASE WHEN hybrid > 0 THEN concat(hybrid, ' hybrid') END, CASE WHEN raster > 0 THEN concat(raster, ' raster') END,
        CASE WHEN vector > 0 THEN concat(vector, ' vector') END)) AS summary
    FROM (SELECT doc_id, count(*) AS pages FROM v_pages GROUP BY 1)
    LEFT JOIN (SELECT doc_id, count(*) FILTER (mode = 'vector') AS vector, count(*) FILTER (mode = 'raster') AS raster, count(*) FILTER (mode = 'hybrid') AS hybrid FROM modes GROUP BY 1) USING (doc_id)
    JOIN (SELECT doc_id, coalesce(a, 0) AS primitives, coalesce(b, 0) AS text_items, coalesce(i, 0) AS images, coalesce(si, 0) AS source_instances,
          coalesce(ii, 0) AS inline_images, coalesce(xi, 0) AS xobject_images FROM (SELECT DISTINCT doc_id FROM v_pages)
      LEFT JOIN (SELECT doc_id, count(*) AS a FROM v_prims GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS b FROM v_texts GROUP BY 1) USING (doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS i, sum(greatest(1, instances)) AS si, coalesce(sum(greatest(1, instances)) FILTER (kind = 'inline_image'), 0) AS ii,
                 coalesce(sum(greatest(1, instances)) FILTER (kind <> 'inline_image'), 0) AS xi FROM v_images GROUP BY 1) USING (doc_id)) USING (doc_id)""",
    *MODE_STEPS,
)
REAL = rep(f"upper(trim({ex('st', tx.ARCH_SCALE, 2)}))", "[\"']+$", "")
SCALE_STEPS = [
    ("s0", f"SELECT *, {strip_time('trim(text)')} AS st FROM v_texts WHERE trim(text) <> ''"),
    *dimension_steps("(SELECT * FROM s0 WHERE st <> '')", "st"),
    ("s1", f"""SELECT *, CASE WHEN kind = 'scale' AND qn > 0 AND qd > 0 THEN qd / qn END AS stated,
       {token(ex('st', tx.ARCH_SCALE, 1))} AS paper, coalesce({feet(REAL, tx.ARCH_REAL)}, {token(REAL)}) AS realin,
       {num('upper(st)', tx.BARE_RATIO, 1)} AS bn, {num('upper(st)', tx.BARE_RATIO, 2)} AS bd FROM d3"""),
    ("s2", """SELECT *, CASE WHEN paper > 0 AND realin <> 0 THEN realin / paper END AS arch, CASE WHEN bn > 0 AND bd > 0 THEN bd / bn END AS bare FROM s1"""),
    ("s3", f"""SELECT s2.*, coalesce(stated, arch, bare) AS factor, least(0.98, CASE WHEN stated IS NOT NULL THEN 0.75 WHEN arch IS NOT NULL THEN 0.88 ELSE 0.75 END
       + CASE WHEN iy <= height*0.35 THEN 0.35 ELSE 0 END + CASE WHEN ix >= width*0.45 THEN 0.35 ELSE 0 END
       + CASE WHEN {has('upper(st)', tx.SCALE_LABEL)} THEN 0.15 ELSE 0 END + CASE WHEN {tag('titleblock_like')} THEN 0.10 ELSE 0 END
       + CASE WHEN {tag('scale_like')} THEN 0.10 ELSE 0 END) AS cf
       FROM s2 JOIN (SELECT doc_id, page, width, height FROM v_pages) USING (doc_id, page) WHERE coalesce(stated, arch, bare) IS NOT NULL"""),
    ("s4", """SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY round(cf, 3) DESC, ord) AS rn FROM s3"""),
    ("scales", """SELECT doc_id, page, coalesce(factor, 1.0) AS factor, coalesce(trim(text), '1:1') AS notation,
       CASE WHEN cf IS NULL THEN 'default' WHEN cf >= 0.70 THEN 'titleblock' ELSE 'page_text' END AS source, CAST(coalesce(round(cf, 3), 0) AS DOUBLE) AS confidence,
       CASE WHEN cf IS NULL THEN 'no_scale_detected' ELSE '' END AS fallback_reason
       FROM (SELECT doc_id, page FROM v_pages) LEFT JOIN (SELECT * FROM s4 WHERE rn = 1) USING (doc_id, page)"""),
]
oracle("resolve_scale", f"SELECT * REPLACE ({r('factor')} AS factor) FROM scales", *SCALE_STEPS)
oracle(
    "doc_scale",
    f"""SELECT doc_id, {r('factor')} AS factor, notation, source, confidence, coalesce(factors, 0) AS factors, {r('min_factor')} AS min_factor, {r('max_factor')} AS max_factor, title_block
    FROM (SELECT doc_id, bool_or(titleblock_likely) AS title_block FROM profile GROUP BY 1)
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, page) AS k FROM scales WHERE confidence > 0) WHERE k = 1) USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(DISTINCT round(factor, 6)) AS factors, min(factor) AS min_factor, max(factor) AS max_factor FROM scales WHERE confidence > 0 GROUP BY 1) USING (doc_id)""",
    *SCALE_STEPS, *PROFILE_STEPS,
)
oracle(
    "doc_scale_factors",
    f"SELECT doc_id, {r('round(factor, 6)')} AS factor, count(*) AS pages, max(confidence) AS confidence FROM scales WHERE confidence > 0 GROUP BY doc_id, round(factor, 6)",
    *SCALE_STEPS,
)
oracle(
    "corpus_rollup",
    "SELECT doc_id, page, sum(n_prims) AS n_prims, sum(n_texts) AS n_texts, count(*) AS pages FROM counts GROUP BY ROLLUP (doc_id, page)",
    COUNTS,
)
oracle(
    "page_stack",
    " UNION ALL ".join(
        f"SELECT doc_id, page, '{how}' AS how, {r('dy')} AS dy FROM ({STACK.replace('$F', f)})"
        for how, f in (("spread", "1.2"), ("touch", "1.0"), ("compact", "1.02"), ("overlay", "0.0"))
    ),
)
oracle(
    "heavy_pages",
    f"""SELECT counts.*, {r('peak_mb')} AS peak_mb, n_prims + n_texts AS objects, n_prims + n_texts >= 62 OR coalesce(peak_mb, 0) >= 4.0 AS hint
      FROM counts LEFT JOIN (SELECT doc_id, page, sum(px_w * px_h) * 4 / 1048576.0E0 AS peak_mb FROM v_images GROUP BY 1, 2) USING (doc_id, page)
      WHERE n_prims + n_texts > 40 ORDER BY objects DESC, doc_id, page LIMIT 25""",
    COUNTS,
)
oracle(
    "text_cap",
    "SELECT text_id, doc_id, page, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS k FROM v_texts) WHERE k <= 2",
)
oracle(
    "fidelity_diagnostics",
    """SELECT doc_id, page, CASE WHEN n_prims >= 50 THEN 'high' WHEN n_prims >= 10 THEN 'moderate' WHEN n_prims > 0 THEN 'low' WHEN im > 0 THEN 'raster' ELSE 'empty' END AS quality_level,
      array_to_string(list_sort(list_filter([
        CASE WHEN n_prims >= 50 THEN 'good_vector_content' WHEN n_prims >= 10 THEN 'limited_vector_content' WHEN n_prims > 0 THEN 'very_limited_vector_content'
             WHEN im > 0 THEN 'raster_or_image_content_delivered' ELSE 'no_vector_geometry_created' END,
        CASE WHEN n_prims % 3 > 0 THEN 'fallback_used' END, CASE WHEN n_texts % 2 > 0 THEN 'warnings_present' END,
        CASE WHEN ly = 0 THEN 'no_pdf_layers_detected' ELSE 'pdf_layers_preserved' END, 'text_mode_labels',
        CASE WHEN n_texts > 0 AND n_prims % 2 = 0 THEN 'source_text_seen_but_no_text_entities_created' END,
        CASE WHEN n_prims * 25 >= 1000 THEN 'dense_text_glyph_workload' END], lambda q: q IS NOT NULL)), ',') AS signals,
      array_to_string(list_sort(list_filter([CASE WHEN n_prims % 3 > 0 THEN 'inspect_item_proof' END, CASE WHEN n_texts % 2 > 0 THEN 'review_warnings' END,
        'confirm_text_representation', CASE WHEN n_prims * 25 >= 1000 THEN 'diagnose_one_page_first' END], lambda q: q IS NOT NULL)), ',') AS actions
    FROM (SELECT doc_id, page, n_prims, n_texts, coalesce(im, 0) AS im, coalesce(ly, 0) AS ly FROM counts
      LEFT JOIN (SELECT doc_id, page, count(*) AS im FROM v_images GROUP BY 1, 2) USING (doc_id, page)
      LEFT JOIN (SELECT doc_id, page, count(DISTINCT trim(layer)) AS ly FROM v_prims WHERE trim(layer) <> '' GROUP BY 1, 2) USING (doc_id, page))""",
    COUNTS,
)
oracle(
    "dpi_budget_fit",
    """SELECT doc_id, max(dpi) FILTER (px <= 200000000 AND tl <= 120) AS dpi FROM (
      SELECT doc_id, dpi, sum(pw * ph) AS px, sum(ceil(pw / 1536) * ceil(ph / 1536)) AS tl FROM (
        SELECT doc_id, dpi, ceil(width * z - 1e-6) AS pw, ceil(height * z - 1e-6) AS ph FROM (
          SELECT *, least(dpi / 72, sqrt(134217728.0 / (width*height)), 24576.0/width, 24576.0/height) AS z
          FROM v_pages, (SELECT CAST(36 + 4 * k AS DOUBLE) AS dpi FROM (SELECT unnest(range(67)) AS k))))
      GROUP BY 1, 2) GROUP BY 1""",
)

# ---- sources ------------------------------------------------------------------------------

oracle("load_corpus", "SELECT * FROM counts", COUNTS)
SIZE = "length(encode(body))"
LANGS = "{" + ", ".join(f"'{k}': '{w}'" for k, w in (("txt", "text"), ("py", "python"), ("json", "json"))) + "}"
FILES = ("files", f"""SELECT path, folder, file_no, CAST(octet_length(encode(body)) AS BIGINT) AS size, sha256(body) AS sha256 FROM v_files""")
oracle(
    "file_inventory",
    """SELECT path, size, sha256, regexp_extract(path, '[^/]*$') AS name,
      CASE lower(regexp_extract(path, '[^.]*$')) WHEN 'txt' THEN 'text' WHEN 'py' THEN 'python' WHEN 'json' THEN 'json' ELSE '' END AS language,
      CASE WHEN size < 1024 THEN printf('%.2f B', CAST(size AS DOUBLE)) ELSE printf('%.2f KB', size / 1024.0) END AS size_label FROM files""",
    FILES,
)
oracle(
    "precheck_files",
    "SELECT path, CASE WHEN body = '' THEN 'empty_file' WHEN body NOT LIKE '\\%PDF-%' ESCAPE '\\' THEN 'not_a_pdf' ELSE 'ok' END AS status FROM v_files",
)
oracle(
    "page_selection",
    """SELECT doc_id, page, 'strict' AS how FROM f WHERE (doc_id % 3 = 0 AND page IN (1, 3)) OR (doc_id % 3 = 1 AND page IN (2, 3)) OR (doc_id % 3 = 2 AND page IN (1, 2))
      UNION ALL SELECT doc_id, page, 'tolerant' FROM f WHERE CASE WHEN doc_id % 4 = 0 THEN true WHEN low <> 1 THEN page = low WHEN doc_id % 4 = 1 THEN page IN (2, 3) ELSE page = 1 END""",
    ("f", "SELECT doc_id, page, min(page) OVER (PARTITION BY doc_id) AS low FROM v_pages"),
)
oracle(
    "read_reports",
    """SELECT event_id, 'import_report/1.1' AS schema, 'auto' AS mode, CAST(0 AS BIGINT) AS text_entities, 'unknown' AS status, false AS fallback_used,
      CAST(NULL AS VARCHAR) AS fallback_reason, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, CAST(NULL AS VARCHAR) AS corrupt FROM events""",
)
REP = "CASE WHEN json_valid(report) THEN json_extract_string(report, '$P') END"
oracle(
    "read_run_reports",
    "SELECT cell_id, " + ", ".join(
        f"coalesce(TRY_CAST({REP.replace('$P', p)} AS {kind}), {default}) AS {name}"
        for name, p, kind, default in (
            ("schema", "$.schema", "VARCHAR", "'import_report/1.1'"), ("mode", "$.mode", "VARCHAR", "'auto'"),
            ("text_entities", "$.result.text_entities", "BIGINT", "0"), ("status", "$.result.status", "VARCHAR", "'unknown'"),
            ("fallback_used", "$.fallback.used", "BOOLEAN", "false"), ("fallback_reason", "$.fallback.reason", "VARCHAR", "NULL"),
            ("k", "$.k", "BIGINT", "0"),
        )
    ) + ", CASE WHEN NOT json_valid(report) THEN report END AS corrupt FROM v_reports",
)
oracle(
    "write_reports",
    """SELECT event_id, 'performance.elapsed_ms' AS path FROM events WHERE event_id % 97 = 0
      UNION ALL SELECT event_id, 'performance.peak_mb' FROM events WHERE event_id % 89 = 0""",
)
CATALOG = ("catalog", """SELECT designation, family, d, bf, tw, tf FROM (
  SELECT *, row_number() OVER (PARTITION BY designation ORDER BY k DESC) AS rn FROM (
    SELECT p_partkey AS k, concat('W', p_size % 4 * 2 + 8, CASE WHEN p_size % 4 = 1 THEN 'x' ELSE 'X' END, p_size % 2 + 20) AS designation,
      'W' AS family, p_size % 4 * 2 + 8.5::DOUBLE AS d, (p_partkey % 5 + 2)::DOUBLE AS bf, 0.25::DOUBLE AS tw, 0.375::DOUBLE AS tf FROM part)) WHERE rn = 1""")
oracle("load_catalog", "SELECT * FROM catalog", CATALOG)

# ---- joins ----------------------------------------------------------------------------------

SEGS = ("segs", """SELECT doc_id, page, prim_id, ord, sqrt((x1-x0)**2 + (y1-y0)**2) AS len, (x0+x1)/2 AS mx, (y0+y1)/2 AS my,
  CASE WHEN degrees(atan2(y1-y0, x1-x0)) < 0 THEN degrees(atan2(y1-y0, x1-x0)) + 180 WHEN degrees(atan2(y1-y0, x1-x0)) >= 180 THEN 0 ELSE degrees(atan2(y1-y0, x1-x0)) END AS angle
  FROM v_prims WHERE type = 'line' AND n_points = 2 AND sqrt((x1-x0)**2 + (y1-y0)**2) >= 0.5""")
oracle(
    "dimension_assoc",
    f"""SELECT doc_id, page, text_id, ix, iy, kind, {r('value')} AS value, prim_id AS nearest_prim_id, {r('d')} AS distance FROM (
      SELECT t.*, p.prim_id, sqrt((ix-px)**2 + (iy-py)**2) AS d, row_number() OVER (PARTITION BY text_id ORDER BY sqrt((ix-px)**2 + (iy-py)**2), p.ord) AS k
      FROM dims t LEFT JOIN (SELECT doc_id, page, prim_id, ord, (bx0+bx1)/2 AS px, (by0+by1)/2 AS py FROM v_prims) p
        ON t.doc_id = p.doc_id AND t.page = p.page AND sqrt((ix-px)**2 + (iy-py)**2) < 75) WHERE k = 1""",
    *dimension_steps("v_texts", "text"),
    ("dims", f"SELECT doc_id, page, text_id, ix, iy, kind, value FROM d3 WHERE {tag('dimension_like')} AND kind <> 'unknown' AND conf >= 0.3"),
)
oracle(
    "parallel_pairs",
    f"""SELECT doc_id, page, {r('angle', 6)} AS angle, count(*) AS n, any_value(k) - 1 AS parallel FROM
      (SELECT a.doc_id, a.page, a.prim_id, a.angle, count(*) AS k FROM segs a JOIN segs b ON a.doc_id = b.doc_id AND a.page = b.page
        AND CASE WHEN abs(a.angle-b.angle) > 90 THEN 180 - abs(a.angle-b.angle) ELSE abs(a.angle-b.angle) END < 3 GROUP BY ALL) GROUP BY ALL
      """.replace("GROUP BY ALL\n", "GROUP BY doc_id, page, angle\n"),
    SEGS,
)
CELLS = ("cells", """SELECT doc_id, page, CAST(trunc((bx0+bx1)/2/150) AS BIGINT) AS gx, CAST(trunc((by0+by1)/2/150) AS BIGINT) AS gy, min(ord) AS ord, count(*) AS n,
  min(bx0) AS x0, min(by0) AS y0, max(bx1) AS x1, max(by1) AS y1 FROM v_prims GROUP BY 1, 2, 3, 4""")
oracle(
    "cell_neighbors",
    """SELECT a.doc_id, a.page, a.ord AS a, b.ord AS b, a.gx AS ax, a.gy AS ay, b.gx AS bx, b.gy AS by FROM cells a JOIN cells b
      ON a.doc_id = b.doc_id AND a.page = b.page AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND a.ord <> b.ord""",
    CELLS,
)
sq = "upper(regexp_replace($E, '\\s+', '', 'g'))"
# RE2 here reads at most nine groups, so each section family has its own pattern.
BEAM = r"^(W|S|M|HP|WT|MT|ST|C|MC)\s?(\d{1,3})\s?[xX]\s?(\d{1,3}(?:\.\d+)?)$"
ANGLE = r"^(L)\s?(\d{1,2})\s?[xX]\s?(\d{1,2})\s?[xX]\s?(" + tx.FRACTION + r")$"
TUBE = r"^(HSS)\s?(\d{1,2}(?:\.\d+)?)\s?[xX]\s?(\d{1,2}(?:\.\d+)?)\s?[xX]\s?(" + tx.FRACTION + r")$"
PIPE = r"^(PIPE)\s?(\d{1,2})\s?(STD|XS|XXS)$"


def designation(m: str) -> str:
    def g(p, k):
        return ex(m, p, k)

    return (
        f"CASE WHEN {g(BEAM, 1)} IS NOT NULL THEN concat({g(BEAM, 1)}, {g(BEAM, 2)}, 'X', {g(BEAM, 3)}) "
        f"WHEN {g(ANGLE, 1)} IS NOT NULL THEN concat('L', {g(ANGLE, 2)}, 'X', {g(ANGLE, 3)}, 'X', {g(ANGLE, 4)}) "
        f"WHEN {g(TUBE, 1)} IS NOT NULL THEN concat('HSS', {g(TUBE, 2)}, 'X', {g(TUBE, 3)}, 'X', {g(TUBE, 4)}) "
        f"WHEN {g(PIPE, 1)} IS NOT NULL THEN concat('PIPE', {g(PIPE, 2)}, {g(PIPE, 3)}) END"
    )


DESIG = designation("m")
FAMILY = "coalesce(" + ", ".join(ex("m", p, 1) for p in (BEAM, ANGLE, TUBE, PIPE)) + ")"
INTENT = [
    ("pl", f"SELECT doc_id, ord, text, unnest(regexp_extract_all(text, {lit(tx.PLATE)})) AS m FROM v_texts"),
    ("me", f"SELECT doc_id, ord, text, unnest(regexp_extract_all(text, {lit(tx.MEMBER)})) AS m FROM v_texts"),
    ("pl2", f"""SELECT doc_id, ord, 0 AS k, 'plate' AS kind, {sq.replace('$E', 'm')} AS key, CAST(NULL AS VARCHAR) AS family,
       round({inches(ex('m', tx.PLATE, 1))}, 6) AS thickness_in, round({inches(ex('m', tx.PLATE, 2))}, 6) AS width_in,
       coalesce(nullif({length_in(ex('m', tx.PLATE, 3))}, 0), {length_in('text')}) AS length_in, {ex('text', tx.PIECE_MARK)} AS mark FROM pl"""),
    ("rows", f"""SELECT * FROM pl2 WHERE thickness_in BETWEEN 0.01 AND 12 UNION ALL
       SELECT doc_id, ord, 1, 'member', {DESIG}, {FAMILY}, NULL, NULL, {length_in('text')}, {ex('text', tx.PIECE_MARK)} FROM me"""),
    ("intent", """SELECT doc_id, kind, key, n AS count, family, thickness_in, width_in, length_in, mark FROM (
       SELECT *, count(*) OVER (PARTITION BY doc_id, kind, key) AS n, row_number() OVER (PARTITION BY doc_id, kind, key ORDER BY ord, k) AS rn FROM rows) WHERE rn = 1"""),
]
oracle(
    "member_intent",
    f"SELECT * REPLACE ({r('length_in', 6)} AS length_in, {r('thickness_in', 6)} AS thickness_in, {r('width_in', 6)} AS width_in) FROM intent",
    *INTENT,
)
P_COLS = "c.family AS p_family, c.d AS p_d, c.bf AS p_bf, c.tw AS p_tw, c.tf AS p_tf"
ON_CAT = "ON replace(i.key, 'X', 'x') = replace(c.designation, 'X', 'x')"
oracle(
    "catalog_lookup",
    f"SELECT doc_id, kind, key, count, c.d IS NOT NULL AS profile_found, {P_COLS} FROM intent i LEFT JOIN catalog c {ON_CAT}",
    *INTENT, CATALOG,
)
oracle(
    "member_plan",
    f"""SELECT i.* REPLACE ({r('coalesce(length_in, 12)', 6)} AS length_in), length_in IS NULL AS length_assumed, c.d IS NOT NULL AS profile_found, {P_COLS},
      CASE WHEN c.d IS NULL THEN 'designation not in catalog' END AS skip_reason FROM (SELECT * FROM intent WHERE kind = 'member') i LEFT JOIN catalog c {ON_CAT}""",
    *INTENT, CATALOG,
)
oracle(
    "manifest_diff",
    """SELECT path, CASE WHEN file_no % 11 = 0 THEN 'unexpected' WHEN file_no % 26 = 0 THEN 'allowed_divergence' ELSE 'hash_mismatch' END AS status FROM v_files
      WHERE file_no % 11 = 0 OR file_no % 13 = 0 UNION ALL SELECT concat(path, '.old'), 'missing' FROM v_files WHERE file_no % 17 = 0""",
)
SESSION = [
    ("want", "SELECT source_id AS session, ord AS page, requested AS opt, handle AS digest, outcome, attempted FROM v_attempts"),
    ("done", """SELECT session, page, CASE WHEN session % 7 = 0 THEN 'other' ELSE opt END AS opt, CASE WHEN outcome = 'impossible' THEN 'stale' ELSE digest END AS digest,
       page % 5 AS entities, attempted AS delivered FROM want WHERE outcome <> 'failed'"""),
    ("left_pages", """SELECT session, page FROM want w WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.session = w.session AND d.page = w.page AND d.opt = w.opt AND d.digest = w.digest)"""),
]
oracle("pending_pages", "SELECT * FROM left_pages", *SESSION)
oracle(
    "stream_resume",
    """SELECT session, asked, coalesce(pending, 0) AS pending, CAST(0 AS BIGINT) AS again, asked - coalesce(pending, 0) AS resumed FROM (SELECT session, count(*) AS asked FROM want GROUP BY 1)
      LEFT JOIN (SELECT session, count(*) AS pending FROM left_pages GROUP BY 1) USING (session)""",
    *SESSION,
)
oracle(
    "resume_summary",
    """SELECT session, count(*) AS pages_requested, count(entities) AS pages_certified, coalesce(sum(entities), 0) AS entities,
      CASE WHEN count(*) = count(entities) THEN 'complete' ELSE 'cancelled' END AS result,
      CASE count(DISTINCT delivered) WHEN 0 THEN 'none' WHEN 1 THEN any_value(delivered) ELSE 'mixed' END AS delivered
    FROM want LEFT JOIN (SELECT session, page, entities, delivered FROM done) USING (session, page) GROUP BY 1""",
    *SESSION,
)
RUNG = "CASE " + " ".join(
    f"WHEN requested = '{w}' AND attempted = '{a}' THEN {i}"
    for w, rungs in (("text", ("text", "glyphs", "geometry")), ("labels", ("labels", "text", "glyphs", "geometry")),
                     ("glyphs", ("glyphs", "geometry", "text")), ("geometry", ("geometry", "glyphs", "text")),
                     ("3d_text", ("3d_text", "text", "glyphs", "geometry")), ("raster", ("raster",)))
    for i, a in enumerate(rungs)
) + " END"
LADDER = [
    ("la", f"SELECT *, {RUNG} AS rung FROM v_attempts"),
    ("lb", """SELECT source_id, doc_id, page, requested, count(rung) AS attempts, count(DISTINCT rung) AS tried, min(rung) FILTER (outcome = 'failed') AS stop, min(rung) FILTER (outcome = 'verified') AS won
       FROM la GROUP BY 1, 2, 3, 4"""),
    ("lc", """SELECT source_id, attempted, handle FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY rung, ord) AS k FROM la WHERE rung IS NOT NULL AND outcome = 'verified') WHERE k = 1"""),
    ("lr", """SELECT source_id, handle AS raster_handle, true AS drawn FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ord) AS k FROM la WHERE attempted = 'raster' AND outcome = 'verified') WHERE k = 1"""),
    ("ld", """SELECT lb.*, lc.attempted, lc.handle AS h, raster_handle, coalesce(drawn, false) AS drawn, requested <> 'raster' AND won IS NOT NULL AND (stop IS NULL OR stop >= won) AS ok,
       requested = 'raster' OR (won IS NULL AND stop IS NULL AND tried = CASE WHEN requested IN ('labels', '3d_text') THEN 4 ELSE 3 END) AS terminal
       FROM lb LEFT JOIN lc USING (source_id) LEFT JOIN lr USING (source_id)"""),
    ("sent", """SELECT source_id, doc_id, page, requested, CASE WHEN ok THEN attempted WHEN terminal THEN 'raster' END AS final,
       ok OR (terminal AND drawn) AS verified, terminal, coalesce(CASE WHEN ok THEN attempted WHEN terminal THEN 'raster' END <> requested, false) AS fallback_used,
       CASE WHEN ok THEN h WHEN terminal THEN raster_handle END AS handle, attempts FROM ld"""),
]
oracle("representation_ladder", "SELECT * FROM sent", *LADDER)
oracle(
    "attempt_invariants",
    """SELECT source_id, ord, attempted FROM v_attempts WHERE outcome = 'verified' AND NOT (type_verified AND delivery_verified AND visual_verified AND cleanup_verified)""",
)
EXPECTED = ("want_ids", "SELECT o_orderkey AS source_id FROM orders WHERE o_orderkey % 50 <> 3")
oracle(
    "delivery_reconcile",
    """SELECT source_id, 'missing' AS problem FROM want_ids WHERE source_id NOT IN (SELECT source_id FROM sent)
      UNION ALL SELECT source_id, 'unexpected' FROM sent WHERE source_id NOT IN (SELECT source_id FROM want_ids)
      UNION ALL SELECT source_id, 'duplicate_id' FROM al GROUP BY 1 HAVING count(*) > 1
      UNION ALL SELECT DISTINCT source_id, 'duplicate_handle' FROM al WHERE handle IN (SELECT handle FROM al GROUP BY 1 HAVING count(*) > 1)
      UNION ALL SELECT source_id, 'not_verified' FROM sent WHERE NOT (verified AND final IS NOT NULL)""",
    *LADDER, EXPECTED, ("al", "SELECT * FROM sent UNION ALL SELECT * FROM sent WHERE source_id % 31 = 0"),
)
oracle(
    "id_set_checks",
    """SELECT coalesce(w.source_id, s.source_id) AS source_id, CASE WHEN s.source_id IS NULL THEN 'missing' WHEN w.source_id IS NULL THEN 'extra' ELSE 'common' END AS status
      FROM want_ids w FULL OUTER JOIN (SELECT source_id FROM sent WHERE verified) s ON w.source_id = s.source_id""",
    *LADDER, EXPECTED,
)
oracle(
    "delivery_summary",
    """SELECT doc_id, count(*) AS items, count(*) FILTER (fallback_used) AS fallbacks, count(handle) AS entities, count(*) FILTER (NOT verified OR final IS NULL) AS failed,
      CASE count(DISTINCT final) WHEN 0 THEN 'none' WHEN 1 THEN any_value(final) ELSE 'mixed' END AS delivered,
      count(*) FILTER (NOT verified OR final IS NULL) = 0 AS all_verified FROM sent GROUP BY 1""",
    *LADDER,
)
oracle("delivery_failures", "SELECT doc_id, source_id, requested, final FROM sent WHERE NOT verified OR final IS NULL", *LADDER)
REASON = """CASE WHEN final = 'raster' THEN 'structural_representations_failed_verification' WHEN requested IN ('glyphs', 'geometry') THEN 'text2path_failed'
  ELSE 'requested_representation_failed_verification' END"""
BUCKET = """CASE final WHEN '3d_text' THEN 'native_3d_text' WHEN 'glyphs' THEN 'outline_curve_or_mesh' WHEN 'geometry' THEN 'raw_geometry_edges' WHEN 'raster' THEN 'raster_image'
  WHEN 'text' THEN 'dxf_text' WHEN 'labels' THEN 'dxf_text' END"""
oracle("fallback_counts", f"SELECT requested, final AS delivered, {REASON} AS reason, count(*) AS n FROM sent WHERE fallback_used GROUP BY 1, 2, 3", *LADDER)
BUCKETS = {"native_label": "labels", "native_text": "text", "native_3d_text": "3d_text", "glyph_curve": "glyphs", "geometry_mesh": "geometry", "raster_patch": "raster",
           "outline_curve_or_mesh": "glyphs", "raw_geometry_edges": "geometry", "raster_text_patch": "raster", "dxf_text": "text", "raster_image": "raster", "fallback_geometry": "geometry"}
OWN_BUCKET = f"""CASE WHEN final = 'labels' AND source_id % 3 > 0 THEN 'native_label' WHEN final = 'text' AND source_id % 3 = 1 THEN 'native_text'
  WHEN final = 'glyphs' AND source_id % 3 = 1 AND doc_id % 2 = 0 THEN 'glyph_curve' WHEN final = 'geometry' AND source_id % 3 = 1 AND doc_id % 4 = 0 THEN 'geometry_mesh'
  WHEN final = 'geometry' AND source_id % 3 = 2 THEN 'fallback_geometry' WHEN final = 'raster' AND source_id % 3 = 1 THEN 'raster_patch'
  WHEN final = 'raster' AND source_id % 3 = 2 THEN 'raster_text_patch' ELSE {BUCKET} END"""
oracle(
    "entity_type_rollup",
    f"""SELECT doc_id, {", ".join(BUCKETS)}, {" + ".join(k for k in BUCKETS if k != "outline_curve_or_mesh")}
        + CASE WHEN glyph_curve > 0 OR geometry_mesh > 0 THEN 0 ELSE outline_curve_or_mesh END AS total,
      CASE len(types) WHEN 0 THEN 'none' WHEN 1 THEN types[1] ELSE 'mixed' END AS entity_type,
      native_label + native_text + native_3d_text + dxf_text > 0 AS font_rendered
    FROM (SELECT doc_id, {", ".join(f"count(*) FILTER (bk = '{k}') AS {k}" for k in BUCKETS)},
      list(DISTINCT CASE bk {" ".join(f"WHEN '{k}' THEN '{t}'" for k, t in BUCKETS.items())} END) AS types
      FROM (SELECT doc_id, {OWN_BUCKET} AS bk FROM sent WHERE verified) GROUP BY 1)""",
    *LADDER,
)
oracle(
    "delivery_examples",
    """SELECT doc_id, final, rank, source_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, final ORDER BY source_id) AS rank FROM sent WHERE verified) WHERE rank <= 3""",
    *LADDER,
)
oracle(
    "fallback_transitions",
    """SELECT run_id, id, "from", "to", reason, page, src AS origin FROM (SELECT *, row_number() OVER (PARTITION BY run_id, id, "from", "to", reason ORDER BY src, ord) AS k FROM al
      WHERE "from" <> "to" AND reason <> '') WHERE k = 1""",
    ("a0", """SELECT doc_id AS run_id, CAST(source_id AS VARCHAR) AS id, requested AS "from", attempted AS "to", CASE WHEN ord % 4 = 0 THEN '' ELSE outcome END AS reason, ord, page
       FROM v_attempts WHERE outcome <> 'verified'"""),
    ("owners", "SELECT DISTINCT run_id FROM a0 WHERE run_id % 3 = 0 AND ord % 2 = 0"),
    ("al", """SELECT *, 0 AS src FROM a0 WHERE run_id % 3 = 0 AND ord % 2 = 0
       UNION ALL SELECT *, 1 FROM a0 WHERE ord % 2 = 0 AND run_id NOT IN (SELECT run_id FROM owners)
       UNION ALL SELECT *, 2 FROM a0 WHERE (ord % 2 = 1 OR ord % 3 = 0) AND run_id NOT IN (SELECT run_id FROM owners)"""),
)
oracle(
    "provenance",
    f"""SELECT concat_ws(':', 'text_span', t.page, s.source_id, 'entity', s.handle) AS object_id, t.page, 'text_span' AS source_kind, {BUCKET} AS created_entity_type,
      s.handle AS parent_handle, t.bx0, t.by0, t.bx1, t.by1, requested AS selected_text_mode, CASE WHEN fallback_used THEN {REASON} ELSE '' END AS fallback_reason, s.source_id AS span_id
    FROM sent s JOIN v_texts t ON s.source_id = t.text_id WHERE s.verified AND s.handle IS NOT NULL""",
    *LADDER,
)
oracle(
    "counts_delta",
    """SELECT run_id, stage, count(*) FILTER (ord % 2 = 0) AS before, count(*) FILTER (ord % 2 = 1) AS after, count(*) FILTER (ord % 2 = 1) - count(*) FILTER (ord % 2 = 0) AS delta
      FROM v_events GROUP BY 1, 2""",
)
oracle(
    "raster_compare",
    f"""SELECT asset_id, same AS same_size, same AND err = 0 AS pixel_exact, CASE WHEN same THEN {r('err / (n * 4)', 6)} END AS mae,
      {r('CASE WHEN NOT same THEN 0 WHEN ink > 0 THEN kept / ink ELSE 1 END', 6)} AS ink_recall
    FROM (SELECT asset_id, coalesce(max(e.y) = max(d.y) AND max(e.x) = max(d.x), false) AS same, sum(abs(e.r-d.r) + abs(e.g-d.g) + abs(e.b-d.b) + abs(e.a-d.a)) AS err, count(*) AS n,
          count(*) FILTER (e.a > 0 AND least(e.r, e.g, e.b) < 250) AS ink,
          count(*) FILTER (e.a > 0 AND least(e.r, e.g, e.b) < 250 AND d.a > 0 AND least(d.r, d.g, d.b) < 250) AS kept
          FROM v_pixels e FULL OUTER JOIN (SELECT * REPLACE (asset_id + 1 AS asset_id) FROM v_pixels) d USING (asset_id, x, y) GROUP BY 1)""",
)
oracle(
    "alpha_class",
    """SELECT asset_id, CASE WHEN n = 0 THEN 'zero' WHEN part THEN 'compositing_required' WHEN n = (rt-lf)*(bt-tp) AND lf = 0 AND tp = 0 AND rt = w AND bt = h THEN 'opaque'
      WHEN n = (rt-lf)*(bt-tp) THEN 'rectangular_opaque' ELSE 'binary_mask' END AS kind, coalesce(lf, 0) AS left, coalesce(tp, 0) AS top, coalesce(rt, 0) AS right, coalesce(bt, 0) AS bottom
    FROM (SELECT asset_id, max(x)+1 AS w, max(y)+1 AS h, count(*) FILTER (a > 0) AS n, bool_or(a > 0 AND a < 255) AS part, min(x) FILTER (a > 0) AS lf, min(y) FILTER (a > 0) AS tp,
          max(x) FILTER (a > 0) + 1 AS rt, max(y) FILTER (a > 0) + 1 AS bt FROM v_pixels GROUP BY 1)""",
)

# ---- aggregations and ranks --------------------------------------------------------------------


def hatch_stats(keys: str, src: str) -> list[tuple[str, str]]:
    return [
        ("h1", f"SELECT *, proj - lag(proj) OVER (PARTITION BY {keys} ORDER BY proj) AS gap FROM {src}"),
        ("h2", f"""SELECT {keys}, count(*) AS n, avg(gap) AS mean_spacing, CASE WHEN avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) END AS spacing_cv,
           stddev_pop(len) / avg(len) AS length_cv FROM h1 GROUP BY {keys} HAVING count(*) >= 6"""),
        ("h3", "SELECT *, coalesce(mean_spacing >= 0.3 AND spacing_cv < 0.35 AND length_cv < 0.5, false) AS accepted FROM h2"),
    ]


ACROSS = "my * cos(radians($A)) - mx * sin(radians($A))"
oracle(
    "hatch_accept",
    f"SELECT doc_id, page, bin, n, {r('mean_spacing')} AS mean_spacing, {r('spacing_cv')} AS spacing_cv, {r('length_cv')} AS length_cv, accepted FROM h3",
    SEGS, ("hb", f"SELECT *, {ACROSS.replace('$A', 'bin * 3.0')} AS proj FROM (SELECT *, CAST(floor(angle / 3) AS BIGINT) AS bin FROM segs)"),
    *hatch_stats("doc_id, page, bin", "hb"),
)
NEAR = "CASE WHEN abs(q - $A) > 90 THEN 180 - abs(q - $A) ELSE abs(q - $A) END < 3"
HATCH = [
    SEGS,
    ("ang", "SELECT doc_id, page, angle, min(ord) AS ord FROM segs GROUP BY 1, 2, 3"),
    ("lead", f"""SELECT doc_id, page, list_reduce(list([angle] ORDER BY ord), lambda acc, a:
       CASE WHEN len(list_filter(acc, lambda q: {NEAR.replace('$A', 'a[1]')})) > 0 THEN acc ELSE list_concat(acc, a) END) AS ls FROM ang GROUP BY 1, 2"""),
    ("own", f"SELECT segs.*, list_filter(ls, lambda q: {NEAR.replace('$A', 'angle')})[1] AS la FROM segs JOIN lead USING (doc_id, page)"),
    ("own2", f"SELECT own.*, ang.ord AS leader, {ACROSS.replace('$A', 'la')} AS proj FROM own JOIN ang ON own.doc_id = ang.doc_id AND own.page = ang.page AND own.la = ang.angle"),
    *hatch_stats("doc_id, page, leader", "own2"),
    ("hatch", "SELECT doc_id, page, prim_id, leader FROM own2 SEMI JOIN (SELECT * FROM h3 WHERE accepted) g USING (doc_id, page, leader)"),
]
oracle("hatch_groups", "SELECT * FROM hatch", *HATCH)
oracle(
    "hatch_policy",
    """SELECT doc_id, page, CASE WHEN prim_id IN (SELECT prim_id FROM hatch) THEN concat('Hatch_Page_', page) ELSE trim(layer) END AS layer, count(*) AS prims
      FROM v_prims GROUP BY 1, 2, 3""",
    *HATCH,
)
BOXES = ("boxes", f"""SELECT doc_id, page, ord, floor(bx0/12) AS bx0, floor(by0/12) AS by0, floor(bx1/12) AS bx1, floor(by1/12) AS by1 FROM v_prims WHERE {LOOP} AND area < 50""")


def box_steps(gap: float) -> list[tuple[str, str]]:
    near = f"greatest(q.x0 - $B.x1, $B.x0 - q.x1, 0) < {gap} AND greatest(q.y0 - $B.y1, $B.y0 - q.y1, 0) < {gap}"
    return [
        BOXES,
        ("bl", f"""SELECT doc_id, page, list_reduce(list([{{'o': ord, 'x0': bx0, 'y0': by0, 'x1': bx1, 'y1': by1}}] ORDER BY ord), lambda acc, a:
           CASE WHEN len(list_filter(acc, lambda q: {near.replace('$B', 'a[1]')})) > 0 THEN acc ELSE list_concat(acc, a) END) AS ls FROM boxes GROUP BY 1, 2"""),
        ("links", f"""SELECT * FROM (SELECT b.*, unnest(list_filter(ls, lambda q: {near.replace('$B', "{'x0': bx0, 'y0': by0, 'x1': bx1, 'y1': by1}")})) AS l
           FROM boxes b JOIN bl USING (doc_id, page)) WHERE l.o <= ord"""),
        ("owner", "SELECT doc_id, page, ord, min(l.o) AS leader, any_value(bx0) AS bx0, any_value(by0) AS by0, any_value(bx1) AS bx1, any_value(by1) AS by1 FROM links GROUP BY 1, 2, 3"),
    ]


oracle("bbox_adjacent", "SELECT doc_id, page, ord, l.o AS leader FROM links", *box_steps(12.0))
oracle("leader_cluster", "SELECT doc_id, page, ord, leader FROM owner", *box_steps(30.0))
oracle(
    "table_regions",
    "SELECT doc_id, page, leader, count(*) AS cells, min(bx0) AS x0, min(by0) AS y0, max(bx1) AS x1, max(by1) AS y1 FROM owner GROUP BY 1, 2, 3 HAVING count(*) >= 2",
    *box_steps(60.0),
)
oracle(
    "regions",
    """SELECT doc_id, page, region, type, CASE type WHEN 'title_block' THEN 'TitleBlock' WHEN 'assembly' THEN 'Assembly' ELSE concat('Detail_', region) END AS label,
      CAST(CASE WHEN type = 'title_block' THEN 0.8 ELSE 0 END AS DOUBLE) AS confidence, prims, x0, y0, x1, y1
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY label) AS region,
            CASE WHEN y0 < height*0.15 AND y1 < height*0.3 THEN 'title_block' WHEN prims > 50 THEN 'assembly' ELSE 'detail' END AS type
          FROM (SELECT doc_id, page, label, CAST(sum(n) AS BIGINT) AS prims, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
                FROM cells JOIN (SELECT doc_id, page, ord, min(lb) AS label FROM reach GROUP BY 1, 2, 3) USING (doc_id, page, ord)
                GROUP BY 1, 2, 3 HAVING sum(n) >= 3) JOIN (SELECT doc_id, page, height FROM v_pages) USING (doc_id, page))""",
    CELLS,
    ("edges", """SELECT a.doc_id, a.page, a.ord AS a, b.ord AS b FROM cells a JOIN cells b
       ON a.doc_id = b.doc_id AND a.page = b.page AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1"""),
    ("reach", "SELECT doc_id, page, ord, ord AS lb FROM cells UNION SELECT e.doc_id, e.page, e.b, r.lb FROM reach r JOIN edges e ON e.doc_id = r.doc_id AND e.page = r.page AND e.a = r.ord AND e.b > r.lb"),
    recursive=True,
)
FACTS = [
    ("pt", """SELECT prim_id, closed, seq, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM v_points
       WINDOW w AS (PARTITION BY prim_id ORDER BY seq)"""),
    ("facts", """SELECT prim_id, closed, count(*) AS n_points, min(x) AS bx0, min(y) AS by0, max(x) AS bx1, max(y) AS by1,
       CASE WHEN closed AND count(*) >= 3 THEN abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2 END AS area,
       CASE WHEN count(*) = 2 THEN 'line' WHEN closed THEN 'closed_loop' ELSE 'polyline' END AS type FROM pt GROUP BY 1, 2"""),
]
oracle(
    "repeated_patterns",
    """SELECT area_key, n_points, count, prim_id FROM (SELECT *, count(*) OVER (PARTITION BY area_key, n_points) AS count FROM
      (SELECT *, CAST(round_even(area, 0) AS BIGINT) AS area_key FROM facts WHERE type = 'closed_loop' AND area > 1)) WHERE count >= 3""",
    *FACTS,
)
oracle("boundaries", "SELECT prim_id, area, bx0, by0, bx1, by1 FROM facts WHERE type = 'closed_loop' AND closed AND area >= 100 ORDER BY area DESC, prim_id", *FACTS)
ST = ("extract_ms", "host_build_ms", "cache_lookup_ms", "cache_store_ms", "other_ms")
oracle(
    "stage_timing",
    "SELECT run_id, " + ", ".join(f"{r(f'sum(ms) FILTER (stage = {lit(k)})', 3)} AS {k}, count(*) FILTER (stage = '{k}') AS {k}_count" for k in ST)
    + f""", count(*) FILTER (stage = 'other_ms') AS unclassified, any_value(total_ms) AS total_ms, {r('greatest(any_value(total_ms) - sum(ms), 0)', 3)} AS unaccounted_ms,
      {r("coalesce(sum(ms) FILTER (stage = 'extract_ms'), 0) / any_value(total_ms) * 100", 3)} AS extract_share_pct,
      {r("coalesce(sum(ms) FILTER (stage = 'host_build_ms'), 0) / any_value(total_ms) * 100", 3)} AS host_build_share_pct
    FROM v_events JOIN (SELECT run_id, CAST(count(*) * 40 AS DOUBLE) AS total_ms FROM v_events GROUP BY 1) USING (run_id) WHERE ms >= 0 GROUP BY 1""",
)
oracle(
    "page_progress",
    f"""SELECT run_id, ord, ms, row_number() OVER (PARTITION BY run_id ORDER BY ord) AS position, count(*) OVER (PARTITION BY run_id) AS total,
      {r('sum(ms) OVER (PARTITION BY run_id ORDER BY ord)', 3)} AS elapsed_ms, ms > 60 AS over_budget FROM v_events WHERE ms >= 0""",
)
oracle(
    "batch_rollup",
    """SELECT run_id, count(*) AS total, count(*) FILTER (NOT crashed) AS passed, count(*) FILTER (crashed) AS failed, count(*) FILTER (NOT crashed AND entities >= 5) AS smoke_passed,
      CAST(sum(CASE WHEN crashed THEN 0 ELSE entities END) AS BIGINT) AS entities FROM v_outcomes GROUP BY 1""",
)
oracle(
    "corpus_quantiles",
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {r(f'quantile_cont({m}, 0.5)')} AS p50, {r(f'quantile_cont({m}, 0.99)')} AS p99, CAST(max({m}) AS DOUBLE) AS max, {r(f'{cap} / max({m})')} AS headroom FROM q"
        for m, cap in (("resolved_objects", 4096), ("decoded_bytes", 16777216), ("operator_tokens", 1000000))
    ),
    ("q", "SELECT run_id, CAST(count(*) AS DOUBLE) AS resolved_objects, CAST(sum(ord) AS DOUBLE) AS decoded_bytes, CAST(max(ord) AS DOUBLE) AS operator_tokens FROM v_events GROUP BY 1"),
)
oracle(
    "image_dedupe",
    "SELECT doc_id, page, xref, smask, ord, px_w, px_h FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, xref, smask ORDER BY ord) AS k FROM v_images) WHERE k = 1",
)
oracle(
    "image_composite",
    """SELECT doc_id, page, kind, ord, a, d, CAST(1 AS BIGINT) AS instances FROM v_images JOIN st USING (doc_id, page, kind) WHERE NOT folds
      UNION ALL SELECT doc_id, page, concat(kind, '_page_fidelity_required'), NULL, width, height, n FROM st JOIN v_pages USING (doc_id, page) WHERE folds""",
    ("st", "SELECT doc_id, page, kind, count(*) AS n, count(*) > 38 OR bool_or(kind = 'inline_image' AND NOT (a > 0 AND d > 0 AND b = 0 AND c = 0)) AS folds FROM v_images GROUP BY 1, 2, 3"),
)
oracle(
    "raster_budget_greedy",
    """SELECT doc_id, q.o AS ord, q.p AS px, list_contains(kept, q.o) AS admitted FROM (
      SELECT doc_id, unnest(items) AS q, list_transform(list_reduce(list_transform(items, lambda i: [i]), lambda acc, i:
        CASE WHEN list_sum(list_transform(acc, lambda z: z.p)) + i[1].p <= 2000000 THEN list_concat(acc, i) ELSE acc END), lambda z: z.o) AS kept
      FROM (SELECT doc_id, list({'o': ord, 'p': px_w * px_h} ORDER BY ord) AS items FROM v_images GROUP BY 1))""",
)
oracle(
    "font_substitution",
    """SELECT doc_id, len(f) AS fonts, concat(array_to_string(f[1:5], ', '), CASE WHEN len(f) > 5 THEN concat(' (+', len(f) - 5, ' more)') ELSE '' END) AS sample
      FROM (SELECT doc_id, list_sort(list(DISTINCT trim(font_name))) AS f FROM v_texts WHERE NOT embedded GROUP BY 1)""",
)
oracle(
    "set_digest",
    f"""SELECT folder, sha256(concat_ws(':', count(*), {", ".join(f"sum(w[{i}])" for i in range(1, 9))}, {", ".join(f"bit_xor(w[{i}])" for i in range(1, 9))})) AS sha256, count(*) AS files
      FROM (SELECT folder, list_transform(range(8), lambda i: CAST(concat('0x', h[1 + 8 * i : 8 + 8 * i]) AS BIGINT)) AS w
        FROM (SELECT folder, sha256(concat(path, '=', sha256)) AS h FROM files)) GROUP BY 1""",
    FILES,
)
DIGEST = f"sha256(concat_ws(':', count(*), {', '.join(f'sum(w[{i}])' for i in range(1, 9))}, {', '.join(f'bit_xor(w[{i}])' for i in range(1, 9))}))"
oracle(
    "session_manifest",
    """SELECT 'source_provenance/1.0' AS schema, f.file_no AS session, 'sheetlake' AS importer_name, '3' AS importer_version, CAST(NULL AS VARCHAR) AS importer_build,
      f.path AS source_path, f.sha256 AS source_sha256, p.page_count, coalesce(n, 0) AS objects, coalesce(fb, 0) AS fallbacks, coalesce(kinds, 0) AS entity_types, objects_sha256
    FROM files f LEFT JOIN (SELECT doc_id, count(*) AS page_count FROM v_pages GROUP BY 1) p ON p.doc_id = f.file_no LEFT JOIN tally t ON t.doc_id = f.file_no""",
    FILES,
    *LADDER,
    ("made", f"""SELECT t.doc_id, t.page, requested, {BUCKET} AS bucket, s.handle, CASE WHEN fallback_used THEN {REASON} ELSE '' END AS reason,
      concat_ws(':', 'text_span', t.page, s.source_id, 'entity', s.handle) AS object_id FROM sent s JOIN v_texts t ON s.source_id = t.text_id WHERE s.verified AND s.handle IS NOT NULL"""),
    ("hashed", """SELECT *, sha256(concat(object_id, '=', sha256(concat_ws('|', CAST(page AS VARCHAR), 'text_span', bucket, handle, requested, reason)))) AS h FROM made"""),
    ("tally", f"""SELECT doc_id, count(*) AS n, count(*) FILTER (reason <> '') AS fb, count(DISTINCT bucket) AS kinds, {DIGEST} AS objects_sha256
      FROM (SELECT *, list_transform(range(8), lambda i: CAST(concat('0x', h[1 + 8 * i : 8 + 8 * i]) AS BIGINT)) AS w FROM hashed) GROUP BY 1"""),
)
OPTIONS = "{'effective_page_strategy': effective_page_strategy, 'has_item_transitions': has_item_transitions, 'native_peer_count': native_peer_count, 'requested_representation': requested_representation, 'requested_representation_status': requested_representation_status}"
oracle(
    "resume_identity",
    f"""SELECT cell_id AS session, concat('s', cell_id) AS source_sha, sha256(CAST(to_json({OPTIONS}) AS VARCHAR)) AS options_sha,
      CASE WHEN cell_id % 6 = 0 THEN 'new' WHEN cell_id % 15 = 0 THEN 'source' WHEN cell_id % 7 = 0 THEN 'options' ELSE 'same' END AS status FROM v_outcomes""",
)
HINT = f"coalesce({sq.replace('$E', ex('$T', tx.PLATE, 0))}, {designation(ex('$T', tx.MEMBER, 0))}, {sq.replace('$E', ex('$T', tx.ROW_PROFILE, 1))})"
HEADS = ", ".join(lit(h) for h in tx.HEADER_LINES)
BOM = [
    ("b0", "SELECT doc_id, ord, page, trim(text) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS pos FROM v_texts WHERE trim(text) <> ''"),
    ("b1", f"""SELECT *, {length_in('t')} AS ln, upper(t) IN ({HEADS}) AS head, {has('t', tx.MARK_LINE)} AS mark, {has('t', tx.QTY_LINE)} AS qty, {has('t', tx.WEIGHT_LINE)} AS wt,
       {HINT.replace('$T', 't')} AS hint FROM b0"""),
    ("b2", "SELECT *, {'t': t, 'ln': ln, 'head': head, 'mark': mark, 'qty': qty, 'wt': wt, 'hint': hint} AS s FROM b1"),
    ("b3", "SELECT *, " + ", ".join(f"lead(s, {i}) OVER w AS n{i}" for i in range(1, 8)) + " FROM b2 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"),
    ("b4", "SELECT *, [n4, n5, n6, n7] AS tail, CASE WHEN n4.wt THEN 1 ELSE 0 END AS w FROM b3 WHERE NOT head AND mark AND n1.qty AND n2.hint IS NOT NULL AND n3.ln IS NOT NULL"),
    ("b5", "SELECT *, CASE WHEN tail[1 + w] IS NOT NULL AND NOT tail[1 + w].mark AND NOT tail[1 + w].head THEN 1 ELSE 0 END AS rr FROM b4"),
    ("b6", f"""SELECT doc_id, pos AS line_start, t AS piece_mark, TRY_CAST(n1.t AS BIGINT) AS quantity, n2.t AS description, n2.hint AS profile_hint,
       CASE WHEN upper(n2.hint) LIKE 'PL%' THEN 'plate' ELSE 'member' END AS kind, {r('n3.ln')} AS length_in, CASE WHEN w = 1 THEN {r('TRY_CAST(n4.t AS DOUBLE)')} END AS total_weight,
       CASE WHEN rr = 1 THEN tail[1 + w].t END AS remarks,
       CASE WHEN tail[1+w+rr] IS NOT NULL AND NOT (tail[1+w+rr].mark AND coalesce(tail[2+w+rr].qty, false)) AND NOT tail[1+w+rr].head THEN tail[1+w+rr].t END AS grade FROM b5"""),
]
oracle("bom_sequence_rows", "SELECT * FROM b6", *BOM)
oracle(
    "bom_line_rows",
    f"""SELECT doc_id, piece_mark, greatest(1, coalesce(CAST(coalesce({ex('t', tx.QTY_LABEL)}, {ex('t', tx.QTY_LEADING)}) AS BIGINT), 1)) AS quantity, hint AS profile_hint,
      CASE WHEN hint IS NULL THEN NULL WHEN upper(hint) LIKE 'PL%' THEN 'plate' ELSE 'member' END AS kind, {r('ln')} AS length_in, page
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(piece_mark) ORDER BY ord) AS k FROM
      (SELECT *, coalesce({ex('t', tx.PIECE_MARK)}, hint) AS piece_mark FROM b1 WHERE doc_id NOT IN (SELECT doc_id FROM b6 WHERE quantity > 40)) WHERE piece_mark IS NOT NULL) WHERE k = 1""",
    *BOM,
)

# ---- rules ------------------------------------------------------------------------------------------

DERIVED = """coalesce(effective_page_strategy <> 'visual_recovery' AND structural_status = 'pass' AND requested_representation_status IN ('pass', 'not_applicable') AND visual_status = 'pass', false)"""
RECOV = "effective_page_strategy = 'visual_recovery'"
LAWS = [
    (f"requested_representation = 'raster' AND ({RECOV} OR visual_recovery <> 'absent')", "law5_raster_label"),
    (f"{RECOV} AND has_item_transitions", "law2_item_transitions"),
    (f"{RECOV} AND requested_representation_status = 'pass'", "law2_representation_pass"),
    (f"{RECOV} AND structural_status <> 'not_certified'", "law3_structural"),
    (f"{RECOV} AND requested_representation NOT IN ('raster', 'none') AND requested_representation_status <> 'fail'", "law3_representation"),
    (f"{RECOV} AND native_peer_count <> 0", "law6_native_peers"),
    ("visual_status = 'pass' AND visual_proof_digest = ''", "law3_visual_proof"),
    ("visual_status = 'pass' AND visual_recovery = 'failed'", "law6_failed_recovery"),
    (f"cell_status = 'pass' AND NOT {DERIVED}", "law4_cell_pass"),
]
WORDS = [
    ("effective_page_strategy = 'warp'", "vocabulary:effective_page_strategy"),
    ("requested_representation_status IS NULL", "missing:requested_representation_status"),
]


def codes(tests) -> str:
    """Codes of the tests that hold, in alphabetical order."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {t} THEN '{c}' END" for t, c in sorted(tests, key=lambda p: p[1])) + ")"


oracle(
    "outcome_violations",
    f"SELECT cell_id, CASE WHEN {' OR '.join(t for t, _ in WORDS)} THEN {codes(WORDS)} ELSE {codes(LAWS)} END AS violations FROM v_outcomes",
)
oracle(
    "cell_status",
    f"""SELECT run_id, CASE WHEN {DERIVED} THEN 'pass' ELSE 'fail' END AS status, CASE WHEN {RECOV} THEN 'visual recovery created; requested representation not certified'
      WHEN {DERIVED} THEN 'requested representation delivered and certified' ELSE 'requested representation not certified' END AS completion, count(*) AS n FROM v_outcomes GROUP BY 1, 2, 3""",
)
oracle(
    "source_profile_check",
    "SELECT o_orderkey AS cell_id, " + codes([
        ("o_orderkey % 37 = 0", "schema"), ("o_orderkey % 19 = 0", "closed_world_mode"), ("o_orderkey % 19 <> 0 AND o_orderkey % 43 = 0", "accounting_mode"),
        ("o_orderkey % 31 = 0", "closed_world_flag"), ("o_orderkey % 29 = 0", "scan_complete"), ("o_orderkey % 23 = 0", "status_code"),
        ("o_orderkey % 5 = 2", "unknown_code"), ("o_orderkey % 5 = 1", "codes_order"),
    ]) + " AS faults, o_orderkey % 19 = 0 AND o_orderkey % 29 = 0 AND o_orderkey % 5 > 2 AS native_eligible FROM orders",
)
BREACH = [("o_orderkey % 6000 > 4096", "resolved_objects"), ("o_orderkey * 4001 > 16777216", "decoded_bytes"),
          ("trunc(o_totalprice) > 250000", "operator_tokens"), ("o_orderkey % 2100 > 2048", "annotation_entries")]
ANY = " OR ".join(t for t, _ in BREACH)
oracle(
    "limit_breaches",
    f"""SELECT o_orderkey AS cell_id, {codes(BREACH)} AS breaches,
      CASE WHEN {ANY} THEN 'incomplete' WHEN o_orderkey % 29 = 0 THEN 'complete' WHEN o_orderkey % 2 = 0 THEN 'partial' ELSE 'incomplete' END AS scan_status,
      CASE WHEN {ANY} THEN 'resource_budget_incomplete' WHEN o_orderkey % 23 = 0 THEN 'weird' ELSE 'source_profile_partial' END AS status_code FROM orders""",
)
oracle(
    "contract_ready",
    """SELECT *, build_stamp AND scale_crosscheck AND actual_text_entity_types AND text_delivery AND result_succeeded AND no_terminal_failure AND no_open_failure AS ready, count(*) AS n
    FROM (SELECT o % 9 > 0 AS build_stamp, NOT (o % 16 = 2) AS scale_crosscheck, o % 23 <= 0 OR o % 7 > 0 AS actual_text_entity_types,
      o % 5 = 0 OR o % 3 <= 0 OR o % 8 = 0 OR o % 10 < 7 AS text_delivery, o % 6 <> 0 AND o % 17 <> 0 AS result_succeeded, o % 17 <> 0 AS no_terminal_failure, o % 41 <> 0 AS no_open_failure
      FROM (SELECT o_orderkey AS o FROM orders)) GROUP BY ALL""",
)
oracle(
    "scale_crosscheck",
    """SELECT doc_id, CASE WHEN reasons = '' THEN 'ok' ELSE 'warn' END AS level, reasons FROM (SELECT doc_id, concat_ws(',',
      CASE WHEN hi > 0 AND f > 0 AND (abs(lo - f) / greatest(lo, f) > 0.15 OR abs(hi - f) / greatest(hi, f) > 0.15) THEN 'conflicting_scale_notations' END,
      CASE WHEN f IS NOT NULL AND cf < 0.70 THEN 'low_confidence' END, CASE WHEN f IS NULL THEN 'no_scale_detected' END,
      CASE WHEN doc_id % 2 = 0 AND f IS NOT NULL AND coalesce(dc, 0) >= 3 AND cf < 0.85 THEN 'titleblock_dimension_tension' END,
      CASE WHEN doc_id % 2 = 0 AND f IS NOT NULL AND source <> 'titleblock' THEN 'titleblock_source_mismatch' END) AS reasons
    FROM (SELECT DISTINCT doc_id FROM v_pages)
    LEFT JOIN (SELECT doc_id, factor AS f, confidence AS cf, source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, page) AS k FROM scales WHERE confidence > 0) WHERE k = 1) USING (doc_id)
    LEFT JOIN (SELECT doc_id, min(factor) AS lo, max(factor) AS hi FROM scales WHERE confidence > 0 GROUP BY 1) USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS dc FROM v_texts WHERE """ + tag("dimension_like") + " GROUP BY 1) USING (doc_id))",
    *SCALE_STEPS,
)
oracle(
    "recognition_review",
    """SELECT prim_id, 'plate' AS kind, printf('Dimensions: %.1f x %.1fmm, thickness=1/2', bx1 - bx0, by1 - by0) AS note FROM facts WHERE closed AND prim_id % 3 = 0 AND bx1 > bx0 AND by1 > by0
      UNION ALL SELECT prim_id, 'hole', 'Hole not inside any detected plate' FROM v_prims WHERE type = 'circle' AND prim_id % 2 = 1 AND prim_id % 10 / 10.0 > 0.5""",
    *FACTS,
)
oracle(
    "recognize_page_totals",
    f"""SELECT doc_id, page, primary_type AS mode_used, coalesce(tb, 0) AS title_block, coalesce(dm, 0) AS dims, coalesce(lk, 0) AS linked FROM profile
    LEFT JOIN (SELECT b.doc_id, b.page, 1 AS tb FROM (SELECT doc_id, page, count(*) AS n, max(iy)+1 AS y1 FROM v_texts WHERE {tag('titleblock_like')} GROUP BY 1, 2) b JOIN v_pages p
      ON b.doc_id = p.doc_id AND b.page = p.page WHERE n >= 2 AND y1 < height*0.4) USING (doc_id, page)
    LEFT JOIN (SELECT doc_id, page, count(*) AS dm, count(*) FILTER (EXISTS (SELECT 1 FROM v_prims p WHERE p.doc_id = t.doc_id AND p.page = t.page
        AND sqrt((t.ix-(bx0+bx1)/2)**2 + (t.iy-(by0+by1)/2)**2) < 75)) AS lk FROM dims t GROUP BY 1, 2) USING (doc_id, page)""",
    *PROFILE_STEPS, *dimension_steps("v_texts", "text"),
    ("dims", f"SELECT doc_id, page, text_id, ix, iy FROM d3 WHERE {tag('dimension_like')} AND kind <> 'unknown' AND conf >= 0.3"),
)

# ---- fractions ----------------------------------------------------------------------------------------

SPLIT = "CASE " + " ".join(
    f"WHEN length(t) > {len(str(d))} AND length(t) >= 2 AND t[-{len(str(d))}:] = '{d}' AND TRY_CAST(t[:-{len(str(d)) + 1}] AS BIGINT) BETWEEN 1 AND {d - 1} THEN {len(str(d))}"
    for d in (64, 32, 16, 8, 4, 2)
) + " END"


def local(x: str, y: str, ax: str, ay: str, em: str) -> tuple[str, str]:
    dx, dy, t = f"({x} - {ax})", f"({y} - {ay})", "radians(s_rot)"
    return f"(({dx} * cos({t}) + {dy} * sin({t})) / {em})", f"(({dy} * cos({t}) - {dx} * sin({t})) / {em})"


def layout(na: str, nn: str, da: str, dn: str) -> str:
    up = f"({nn} >= 0.1 AND {dn} <= -0.1 AND greatest(abs({nn}), abs({dn})) <= 3.5 AND greatest(abs({na}), abs({da})) <= 1.75)"
    side = f"({na} <= -0.1 AND {da} >= 0.1 AND greatest(abs({na}), abs({da})) <= 5 AND greatest(abs({nn}), abs({dn})) <= 0.75)"
    return f"CASE WHEN {up} AND NOT {side} THEN 'vertical' WHEN {side} AND NOT {up} THEN 'horizontal' END"


def turned(a: str, b: str) -> str:
    return f"abs((({a} - {b} + 180) % 360 + 360) % 360 - 180)"


AT_CHAR, AT_PEN = local("x", "y", "s_x", "s_y", "em"), local("ix", "iy", "s_ix", "s_iy", "em")
ONE = layout(*local("nx", "iy", "s_x", "s_y", "fs"), *local("dx", "iy", "s_x", "s_y", "fs"))
TWO = layout(*local("n.x", "n.y", "n.s_x", "n.s_y", "em3"), *local("d.x", "d.y", "n.s_x", "n.s_y", "em3")).replace("(s_rot)", "(n.s_rot)")
FRACTION_STEPS = [
    ("f0", "SELECT *, trim(text) AS t FROM v_fractions"),
    ("f1", f"""SELECT doc_id, page, text_id, ord, t, ix, iy, font_size AS fs, rotation AS rot, font_name AS font, laid_out AS exact, length(t) AS n, {SPLIT} AS tail,
       regexp_full_match(t, '[/⁄∕]') AS is_slash FROM f0 WHERE regexp_full_match(t, '[/⁄∕]') OR regexp_full_match(t, '\\d{{1,4}}')"""),
    ("f2", """SELECT *, ix + CASE WHEN exact THEN fs * 0.5 * (n - 1) / 2 ELSE 0 END AS x, iy AS y, ix + fs * 0.5 * (n - tail - 1) / 2 AS nx, ix + fs * 0.5 * (n - tail + n - 1) / 2 AS dx FROM f1"""),
    ("fc", """SELECT doc_id, page, min(ord) AS ord, arg_min(text_id, ord) AS text_id, list(text_id) AS members, t, ix, iy, fs, rot, font, exact, any_value(x) AS x, any_value(y) AS y, any_value(nx) AS nx,
       any_value(dx) AS dx, any_value(tail) AS tail, any_value(is_slash) AS is_slash, TRY_CAST(t AS BIGINT) AS value FROM f2 GROUP BY doc_id, page, t, ix, iy, fs, rot, font, exact"""),
    ("fn", f"""SELECT * FROM (SELECT d.*, s.ord AS s_ord, s.t AS s_t, s.x AS s_x, s.y AS s_y, s.ix AS s_ix, s.iy AS s_iy, s.fs AS s_fs, s.rot AS s_rot, s.font AS s_font,
         s.exact AND s.t = '/' AS good, greatest(d.fs, s.fs) AS em FROM fc d JOIN fc s ON d.doc_id = s.doc_id AND d.page = s.page AND NOT d.is_slash AND s.is_slash)
       WHERE {turned('rot', 's_rot')} <= 1 AND CASE WHEN good THEN abs({AT_CHAR[0]}) <= 5 AND abs({AT_CHAR[1]}) <= 5 ELSE abs({AT_PEN[0]}) <= 5 AND abs({AT_PEN[1]}) <= 5 END"""),
    ("fp", f"""SELECT doc_id, page, s_ord, ord AS n_ord, CAST(NULL AS BIGINT) AS d_ord, 'concatenated' AS kind, {ONE} AS encoding, concat(t[:-tail - 1], '/', t[-tail:]) AS semantic, font = s_font AS bound
       FROM fn WHERE good AND exact AND tail IS NOT NULL AND greatest(fs, s_fs) <= 2 * least(fs, s_fs)
       UNION ALL SELECT doc_id, page, s_ord, n_ord, d_ord, 'separate', encoding, semantic, bound FROM (
         SELECT n.doc_id, n.page, n.s_ord, n.ord AS n_ord, d.ord AS d_ord, concat(n.t, '/', d.t) AS semantic, n.font = n.s_font AND d.font = n.s_font AS bound,
           list_sort([n.fs, n.s_fs, d.fs])[2] AS em3, {TWO} AS encoding
         FROM fn n JOIN fn d ON n.doc_id = d.doc_id AND n.page = d.page AND n.s_ord = d.s_ord AND n.good AND n.exact AND d.exact AND n.tail IS NULL AND d.tail IS NULL
           AND d.value IN (2, 4, 8, 16, 32, 64) AND n.value > 0 AND n.value < d.value AND greatest(n.fs, n.s_fs, d.fs) <= 2 * least(n.fs, n.s_fs, d.fs)
           AND {turned('n.rot', 'd.rot')} <= 1)"""),
    ("fk", "SELECT *, [s_ord, n_ord, d_ord] AS parts, row_number() OVER (PARTITION BY doc_id, page, s_ord, bound ORDER BY kind, least(n_ord, coalesce(d_ord, n_ord)), greatest(n_ord, coalesce(d_ord, n_ord))) AS k FROM fp WHERE encoding IS NOT NULL"),
    ("fs0", "SELECT doc_id, page, s_ord, bool_or(NOT good) AS bad_slash, bool_or(good AND NOT exact) AS bad_digit FROM fn GROUP BY 1, 2, 3"),
    ("fs1", "SELECT fs0.*, coalesce(n, 0) AS n, ok FROM fs0 LEFT JOIN (SELECT doc_id, page, s_ord, count(*) AS n, bool_and(bound) AS ok FROM fk GROUP BY 1, 2, 3) USING (doc_id, page, s_ord)"),
    ("blocked", """SELECT DISTINCT * FROM (SELECT doc_id, page, ord AS c FROM fc WHERE is_slash AND NOT (exact AND t = '/')
       UNION ALL SELECT doc_id, page, unnest([ord, s_ord]) FROM fn WHERE NOT good OR NOT exact
       UNION ALL SELECT doc_id, page, unnest(parts) FROM fk JOIN fs1 USING (doc_id, page, s_ord) WHERE NOT bad_slash AND NOT bad_digit AND ((NOT ok AND NOT bound AND k = 1) OR (ok AND n > 1))) WHERE c IS NOT NULL"""),
    ("opened", """SELECT fk.* FROM fk JOIN fs1 USING (doc_id, page, s_ord) WHERE NOT bad_slash AND NOT bad_digit AND n = 1 AND ok
       AND NOT EXISTS (SELECT 1 FROM blocked b WHERE b.doc_id = fk.doc_id AND b.page = fk.page AND list_contains(fk.parts, b.c))"""),
    ("shared", "SELECT doc_id, page, c FROM (SELECT doc_id, page, unnest(parts) AS c FROM opened) WHERE c IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1"),
    ("accepted", "SELECT * FROM opened o WHERE NOT EXISTS (SELECT 1 FROM shared s WHERE s.doc_id = o.doc_id AND s.page = o.page AND list_contains(o.parts, s.c))"),
    ("eaten", "SELECT DISTINCT a.doc_id, a.page, unnest(members) AS text_id FROM accepted a JOIN fc c ON a.doc_id = c.doc_id AND a.page = c.page AND list_contains(a.parts, c.ord)"),
]
oracle("fraction_candidates", "SELECT doc_id, page, s_ord, n_ord, d_ord, kind, encoding, semantic, bound FROM fk", *FRACTION_STEPS)
oracle(
    "merge_fractions",
    """SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS new_id FROM (
      SELECT doc_id, page, text_id, ord, text, '' AS encoding FROM v_fractions f WHERE NOT EXISTS (SELECT 1 FROM eaten e WHERE e.doc_id = f.doc_id AND e.page = f.page AND e.text_id = f.text_id)
      UNION ALL SELECT a.doc_id, a.page, c.text_id, c.ord, semantic, encoding FROM accepted a JOIN fc c ON a.doc_id = c.doc_id AND a.page = c.page AND a.s_ord = c.ord)""",
    *FRACTION_STEPS,
)

# ---- streaming jobs ---------------------------------------------------------------------------------

oracle(
    "stream_stage_timing",
    f"SELECT run_id, stage, date_trunc('hour', ts) AS window_start, {r('sum(ms)', 3)} AS ms, count(*) AS n FROM v_events WHERE ms >= 0 GROUP BY 1, 2, 3",
)
oracle(
    "stream_stage_timing_sliding",
    f"""SELECT run_id, stage, w AS window_start, {r('sum(ms)', 3)} AS ms, count(*) AS n FROM (
      SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM v_events WHERE ms >= 0) GROUP BY 1, 2, 3""",
)
oracle(
    "stream_sessions",
    f"""SELECT run_id, min(ts) AS session_start, count(*) AS events, {r('sum(ms) FILTER (ms >= 0)', 3)} AS ms FROM (
      SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts) AS sid
      FROM (SELECT *, lag(ts) OVER (PARTITION BY run_id ORDER BY ts) AS p FROM v_events)) GROUP BY run_id, sid""",
)
oracle(
    "over_budget_totals",
    f"SELECT run_id, {r('sum(ms)', 3)} AS elapsed_ms, count(*) AS pages FROM v_events WHERE ms >= 0 GROUP BY 1 HAVING sum(ms) > 3200",
)
oracle(
    "stream_over_budget",
    f"""SELECT run_id, session_start, ord AS stopped_ord, k AS pages, {r('total', 3)} AS elapsed_ms FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id, part ORDER BY k) AS f FROM (
        SELECT *, row_number() OVER w AS k, sum(ms) OVER w AS total, min(ts) OVER (PARTITION BY run_id, part) AS session_start FROM (
          SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY ts, ord) AS part FROM (
            SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY run_id ORDER BY ts, ord) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh
            FROM v_events WHERE ms >= 0))
        WINDOW w AS (PARTITION BY run_id, part ORDER BY ts, ord)) WHERE total > 400) WHERE f = 1""",
)
oracle(
    "stream_pages",
    f"SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS position, count(*) FILTER (NOT ({MICRO.replace('< 6', '< 4.5')})) AS kept, count(*) FILTER ({MICRO.replace('< 6', '< 4.5')}) AS removed FROM v_prims GROUP BY 1, 2",
)

ORACLES["recognize_pages"] = f"""
    WITH home AS (
      SELECT prim_id, doc_id, page FROM ({v.duck(v.SEGMENTS)})
      UNION ALL SELECT DISTINCT -prim_id - 1, CAST(floor(pg / 3) AS BIGINT), CAST(1 + pg % 3 AS BIGINT) FROM ({v.duck(v.ARCS)})
    ), totals AS ({ORACLES["recognize_page_totals"]})
    SELECT doc_id, page, 'profile' AS part, CAST(1 AS BIGINT) AS items, mode_used AS note FROM totals
    UNION ALL SELECT doc_id, page, 'title_blocks', CAST(1 AS BIGINT), NULL FROM totals WHERE title_block = 1
    UNION ALL SELECT doc_id, page, 'dimensions', dims, CAST(linked AS VARCHAR) FROM totals WHERE dims > 0
    UNION ALL SELECT doc_id, page, 'circles', count(*), NULL FROM (
      SELECT -prim_id - 1 AS prim_id FROM ({ORACLES["find_circles"]})) JOIN home USING (prim_id) GROUP BY 1, 2
    UNION ALL SELECT doc_id, page, 'boundaries', count(*), NULL FROM ({ORACLES["boundaries"]}) JOIN home USING (prim_id) GROUP BY 1, 2
    UNION ALL SELECT doc_id, page, 'patterns', count(*), NULL FROM ({ORACLES["repeated_patterns"]}) JOIN home USING (prim_id) GROUP BY 1, 2
    UNION ALL SELECT doc_id, page, 'tables', count(*), NULL FROM (WITH v_prims AS ({VIEWS["v_prims"]}), {", ".join(
      f"{n} AS ({q})" for n, q in [("boxes", f"SELECT doc_id, page, ord, bx0, by0, bx1, by1 FROM v_prims WHERE {LOOP} AND area < 50"), *box_steps(60.0)[1:]])}
      SELECT doc_id, page, leader FROM owner GROUP BY 1, 2, 3 HAVING count(*) >= 2) GROUP BY 1, 2
    UNION ALL SELECT doc_id, page, 'text_tags', count(*), NULL FROM ({v.duck(v.TEXTS)}) WHERE {" OR ".join(f"({tag(t)})" for t in tx.TAGS)} GROUP BY 1, 2
"""
