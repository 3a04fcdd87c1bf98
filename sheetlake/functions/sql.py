"""The text rules as SQL functions, and page selections as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import text as tx


def _lit(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _tag_case(tag: str) -> str:
    tests = []
    for name, form, pattern in tx.RAW_TAGS:
        if name == tag:
            value = "trim(t)" if form == "raw" else "upper(trim(t))"
            test = f"{value} RLIKE {_lit(pattern)}"
            if form == "label":
                test = f"(length(trim(t)) BETWEEN 2 AND 59 AND {test})"
            tests.append(test)
    normal = "trim(replace(upper(t), '  ', ' '))"
    tests += [f"{normal} RLIKE {_lit(p)}" for name, p in tx.NORMAL_TAGS if name == tag]
    return f"CASE WHEN {' OR '.join(tests)} THEN '{tag}' END"


def _group(e: str, pattern: str, i: int = 1) -> str:
    return f"nullif(regexp_extract({e}, {_lit(pattern)}, {i}), '')"


def _number(e: str, pattern: str, i: int = 1) -> str:
    return f"TRY_CAST({_group(e, pattern, i)} AS DOUBLE)"


def _ratio(e: str, pattern: str, top: int, bottom: int) -> str:
    return f"try_divide({_number(e, pattern, top)}, {_number(e, pattern, bottom)})"


def dimension_functions() -> dict[str, str]:
    """``parse_dimension`` and the functions it is made of.

    Each hands its intermediate values to the next one as arguments, so a value is written down once.
    """
    s, n, mm = "s", _number, tx.MM_PER_INCH
    feet = f"{n(s, tx.FEET_INCHES, 1)} * 12 + coalesce({n(s, tx.FEET_INCHES, 2)}, 0) + coalesce({_ratio(s, tx.FEET_INCHES, 3, 4)}, 0)"
    inches = (
        f"coalesce({n(s, tx.IMPERIAL_MIXED, 1)} + {_ratio(s, tx.IMPERIAL_MIXED, 2, 3)}, "
        f"{_ratio(s, tx.IMPERIAL_FRACTION, 1, 2)}, {n(s, tx.IMPERIAL_PLAIN)})"
    )
    metric = f"{n(s, tx.METRIC, 1)} * CASE upper({_group(s, tx.METRIC, 2)}) WHEN 'CM' THEN 10 WHEN 'M' THEN 1000 ELSE 1 END"
    bore = f"CASE WHEN s RLIKE {_lit(tx.DIAMETER)} THEN trim(regexp_replace(s, {_lit(tx.DIAMETER_NOISE)}, ' ')) END"
    quantity = f"TRY_CAST(coalesce({_group(s, tx.QTY_PAREN)}, {_group(s, tx.QTY_PREFIX)}) AS BIGINT)"
    token = (
        f"coalesce({n(s, tx.MIXED, 1)} + {_ratio(s, tx.MIXED, 2, 3)}, {_ratio(s, tx.SIMPLE_FRACTION, 1, 2)}, {n(s, tx.DECIMAL)})"
    )
    fact = (
        "STRUCT<kind: STRING, value: DOUBLE, width: DOUBLE, length: DOUBLE, ratio_num: DOUBLE, ratio_den: DOUBLE, "
        "units: STRING, quantity: BIGINT, confidence: DOUBLE>"
    )
    parts = "w DOUBLE, l DOUBLE, bore DOUBLE, ft DOUBLE, mt DOUBLE, im DOUBLE, num DOUBLE, den DOUBLE, qty BIGINT"
    return {
        "dimension_text(t STRING) RETURNS STRING":
            f"trim(regexp_replace(regexp_replace(translate(t, {_lit(tx.TYPOGRAPHIC[0])}, {_lit(tx.TYPOGRAPHIC[1])}), "
            f"r'(?i)DIA\\.?', 'DIA'), r'\\s+', ' '))",
        "dimension_number(s STRING) RETURNS DOUBLE": token,
        "dimension_token(t STRING) RETURNS DOUBLE": f"dimension_number(regexp_replace(trim(t), {_lit(tx.TRAILING_MARKS)}, ''))",
        f"dimension_of_kind(kind STRING, {parts}) RETURNS {fact}":
            "named_struct('kind', kind, "
            f"'value', CASE kind WHEN 'diameter' THEN bore * {mm!r} WHEN 'linear' THEN coalesce(ft * {mm!r}, mt, im * {mm!r}) END, "
            f"'width', CASE kind WHEN 'slot' THEN w * {mm!r} END, 'length', CASE kind WHEN 'slot' THEN l * {mm!r} END, "
            "'ratio_num', CASE kind WHEN 'scale' THEN num END, 'ratio_den', CASE kind WHEN 'scale' THEN den END, "
            "'units', CASE WHEN kind IN ('slot', 'diameter', 'linear') THEN 'mm' END, 'quantity', nullif(qty, 0), "
            "'confidence', CASE WHEN kind IN ('slot', 'diameter') THEN 0.95D WHEN kind = 'scale' THEN 0.80D "
            "WHEN kind = 'unknown' THEN 0.10D WHEN ft IS NOT NULL THEN 0.95D WHEN mt IS NOT NULL THEN 0.90D ELSE 0.85D END)",
        f"dimension_of_parts({parts}) RETURNS {fact}":
            "dimension_of_kind(CASE WHEN w <> 0 AND l <> 0 THEN 'slot' WHEN bore IS NOT NULL THEN 'diameter' "
            "WHEN coalesce(ft, mt, im) IS NOT NULL THEN 'linear' WHEN num IS NOT NULL THEN 'scale' ELSE 'unknown' END, "
            "w, l, bore, ft, mt, im, num, den, qty)",
        f"dimension_of_clean(s STRING) RETURNS {fact}":
            f"dimension_of_parts(dimension_token({_group(s, tx.SLOT, 1)}), dimension_token({_group(s, tx.SLOT, 2)}), "
            f"dimension_token({bore}), {feet}, {metric}, {inches}, {n(s, tx.RATIO, 1)}, {n(s, tx.RATIO, 2)}, {quantity})",
        f"parse_dimension(t STRING) RETURNS {fact}": "dimension_of_clean(dimension_text(t))",
    }


@udtf(returnType="page BIGINT")
class SelectedPages:
    """Pages of a tolerant selection such as ``1,5-3,all`` in a document of ``n`` pages."""

    def eval(self, spec: str, n: int):
        spec = (spec or "all").strip().lower()
        if spec in ("all", "*", "a"):
            spec = f"1-{n}"
        elif spec in ("", "first"):
            spec = "1"
        spans = []
        for token in spec.split(","):
            left, dash, right = token.strip().partition("-")
            try:
                a, b = int(left), int(right if dash else left)
            except ValueError:
                continue
            spans.append((max(1, min(a, b)), min(n, max(a, b))))
        last = 0
        for lo, hi in sorted(spans):
            for page in range(max(lo, last + 1), hi + 1):
                yield (page,)
            last = max(last, hi)


def register(spark: SparkSession) -> None:
    """Make ``classify_text``, ``strip_temporal``, ``redact_secrets``, ``confidence_action``,
    ``parse_dimension`` and the table function ``selected_pages`` known to SQL.  The scalar ones expand to native SQL."""
    tags = ", ".join(_tag_case(t) for t in tx.TAGS)
    bodies = {
        "classify_text(t STRING) RETURNS ARRAY<STRING>": f"filter(array({tags}), x -> x IS NOT NULL)",
        "strip_temporal(t STRING) RETURNS STRING":
            f"trim(regexp_replace(regexp_replace(t, {_lit(tx.DATE_TOKEN)}, ' '), {_lit(tx.CLOCK_TOKEN)}, ' '))",
        "redact_secrets(t STRING) RETURNS STRING":
            f"regexp_replace(regexp_replace(t, {_lit(tx.SECRET)}, '$1$2<REDACTED>$2'), "
            f"{_lit(tx.PRIVATE_KEY)}, '<REDACTED_PRIVATE_KEY_BLOCK>')",
        "confidence_action(c DOUBLE) RETURNS STRING":
            "CASE WHEN c >= 0.85 THEN 'trusted' WHEN c >= 0.75 THEN 'build_warn' "
            "WHEN c >= 0.60 THEN 'candidate' ELSE 'report_only' END",
    } | dimension_functions()
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("selected_pages", SelectedPages)
