"""Text rules as Column expressions: tags, dimensions, lengths, scales, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MM_PER_INCH

# Patterns of the text rules.
FRACTION = r"(?:\d+\s+\d+/\d+|\d+/\d+|\d+(?:\.\d+)?)"
MIXED = r"^(\d+)\s+(\d+)\s*/\s*(\d+)$"
SIMPLE_FRACTION = r"^(\d+)\s*/\s*(\d+)$"
DECIMAL = r"^(\d+(?:\.\d+)?)$"
SLOT = (
    r'(?i)(\d+(?:\.\d+)?(?:\s*/\s*\d+)?)\s*"?\s*[xX×]\s*'
    r'(\d+(?:\.\d+)?(?:\s+\d+\s*/\s*\d+)?(?:\s*/\s*\d+)?)\s*"?\s*(?:SLOT|SSL|LSL)'
)
DIAMETER = r"(?i)[Øø]|DIA\b|HOLE"
DIAMETER_NOISE = r"(?i)[Øø]|DIA\b|HOLE\b|\(\d+\)|\d+\s*[-xX]\s*"
FEET_INCHES = (
    r"^(\d+(?:\.\d+)?)\s*['′]\s*[-–]?\s*(\d+(?:\.\d+)?)?\s*(?:(\d+)\s*/\s*(\d+))?\s*[\"″]?\s*$"
)
METRIC = r"(?i)(\d+(?:\.\d+)?)\s*(MM|CM|M)\b"
IMPERIAL_MIXED = r"^\s*(\d+)\s+(\d+)\s*/\s*(\d+)\s*[\"″]?"
IMPERIAL_FRACTION = r"^\s*(\d+)\s*/\s*(\d+)\s*[\"″]?\s*$"
IMPERIAL_PLAIN = r"^\s*(\d+(?:\.\d+)?)\s*[\"″]"
RATIO = r"(\d+)\s*:\s*(\d+)"
QTY_PAREN = r"^\s*\((\d+)\)"
# Typographic marks and their plain forms; marks at the end of a number.
TYPOGRAPHIC = ("‘’“”–—⁄", "''\"\"--/")
TRAILING_MARKS = r"[\"']+$"
QTY_PREFIX = r"^\s*(\d+)\s*[-xX]\s*(?:[Øø]|\d)"
DATE_TOKEN = r"(?<!\d)\d{1,2}\s*[/\-]\s*\d{1,2}\s*[/\-]\s*\d{2,4}(?!\d)"
CLOCK_TOKEN = (
    r"(?i)(?<!\d)(?:\d{1,2}\s*:\s*\d{2}\s*:\s*\d{2}(?:\s*(?:AM|PM)\b)?"
    r"|\d{1,2}\s*:\s*\d{2}\s*(?:AM|PM)\b)"
)
ARCH_SCALE = r"(?i)(\d+(?:\.\d+)?(?:\s*/\s*\d+)?)\s*[\"″]?\s*=\s*(.+)"
ARCH_REAL = (
    r"^(\d+(?:\.\d+)?)\s*(?:'|′|FT|FEET)?\s*[-–]?\s*(\d+(?:\.\d+)?)?\s*"
    r"(?:(\d+)\s*/\s*(\d+))?\s*(?:\"|″|IN|INCH|INCHES)?\s*$"
)
SCALE_LABEL = r"\b(SCALE|SC\.?|SCL\.?)\b"
BARE_RATIO = r"\b(\d+)\s*:\s*(\d+)\b"
LENGTH_RUN = r"(\d+)'\s*-?\s*(\d+(?:\s+\d+/\d+|/\d+)?(?:\.\d+)?)?\s*\"?"
PIECE_MARK = r"\b([a-z]{1,2}\d{3,5}(?:[A-Z]{1,3}\d{0,3})?)\b"
PLATE = (
    r"\bPL\s*(" + FRACTION + r")\s*\"?\s*[xX]\s*(" + FRACTION + r")\s*\"?"
    r"(?:\s*[xX]\s*([0-9'\-\s/\.\"]+))?"
)
MEMBER = (
    r"\b(W|S|M|HP|WT|MT|ST|C|MC)\s?(\d{1,3})\s?[xX]\s?(\d{1,3}(?:\.\d+)?)\b"
    r"|\b(L)\s?(\d{1,2})\s?[xX]\s?(\d{1,2})\s?[xX]\s?(" + FRACTION + r")\b"
    r"|\b(HSS)\s?(\d{1,2}(?:\.\d+)?)\s?[xX]\s?(\d{1,2}(?:\.\d+)?)\s?[xX]\s?(" + FRACTION + r")\b"
    r"|\b(PIPE)\s?(\d{1,2})\s?(STD|XS|XXS)\b"
)
ROW_PROFILE = (
    r"(?i)\b(PL\s*" + FRACTION + r"\s*\"?\s*[xX]\s*[^\s]+"
    r"|W\d{1,3}\s?[xX]\s?\d{1,3}(?:\.\d+)?"
    r"|L\d{1,2}\s?[xX]\s?\d{1,2}\s?[xX]\s?" + FRACTION
    + r"|HSS\d{1,2}(?:\.\d+)?\s?[xX]\s?\d{1,2}(?:\.\d+)?\s?[xX]\s?" + FRACTION
    + r"|PIPE\d{1,2}(?:STD|XS|XXS)"
    r"|C\d{1,2}\s?[xX]\s?\d{1,3}(?:\.\d+)?)\b"
)
QTY_LABEL = r"(?i)\b(?:QUAN|QTY|QTY\.|Q\.)\s*[:.]?\s*(\d+)\b"
QTY_LEADING = r"^\s*(\d+)\s+"
MARK_LINE = r"(?i)^[A-Za-z]{1,3}\d{3,6}(?:[A-Za-z]{1,4}\d*)?$|^\d{3,6}[A-Za-z]{1,4}\d*$"
QTY_LINE = r"^\d+$"
WEIGHT_LINE = r"^\d+(?:\.\d+)?$"
HEADER_LINES = (
    "BILL OF MATERIAL", "QUAN", "QTY", "MARK", "DESCRIPTION", "LENGTH",
    "TOTAL WT.", "TOTAL  WT.", "REMARKS",
)
# Fixed values: (tag, form of the raw text that is read, pattern).
RAW_TAGS = (
    ("dimension_like", "raw", r"\d+['']\s*[-–]?\s*\d"),
    ("dimension_like", "raw", r"\d+\s*/\s*\d+"),
    ("dimension_like", "raw", r'(?i)\d+\.?\d*\s*(?:"|mm|cm|in|ft)'),
    ("scale_like", "upper", r"SCALE[:\s]*\d"),
    ("scale_like", "raw", r"\d+\s*:\s*\d+"),
    ("titleblock_like", "upper", r"\b(DRAWN|CHECKED|DATE|SCALE|REV|SHEET|PROJECT|DWG|TITLE)\b"),
    ("callout_like", "raw", r"(?i)[Øø]|\bDIA\b|\bRAD\b|\bR\d"),
    ("detail_reference", "upper", r"\b(DETAIL|SECTION|SEC|VIEW|ELEVATION)\s+[A-Z]"),
    ("label_like", "label", r"[A-Z]{2,}"),
)
# Fixed values: (tag, pattern) on the normalised text.
NORMAL_TAGS = (
    ("note_indicator", r"\b(NOTE|NOTES|N\.?T\.?S\.?|SEE\s+DWG)\b"),
    ("quantity_indicator", r"\b(QTY|EA|EACH|PCS)\b"),
    ("revision_like", r"\bREV[.\s]?[A-Z0-9]?\b"),
    ("detail_reference", r"\b(DETAIL|SECTION|VIEW|ELEVATION)\s+[A-Z]"),
    ("scale_like", r"\b(SCALE|SC\.?|SCL\.?)\b"),
    ("scale_like", r"\d+\s*:\s*\d+"),
    ("titleblock_like", r"\b(DRAWN|CHECKED|APPROVED|PROJECT|JOB|DATE|SHEET)\b"),
    ("dimension_like", r'\d+(?:\.\d+)?(?:\s*/\s*\d+)?\s*["″]?\s*=\s*\d'),
    ("dimension_like", r"\b\d+(?:\.\d+)?\s*(MM|CM|IN|FT|M)\b"),
)
TAGS = (
    "dimension_like", "scale_like", "titleblock_like", "callout_like", "detail_reference",
    "label_like", "note_indicator", "quantity_indicator", "revision_like",
)
SECRET = (
    r"(?im)(\b(?:api[_-]?key|token|secret|password|client[_-]?secret)\b\s*[:=]\s*)"
    r"([\"'])([^\"']+)\2"
)
PRIVATE_KEY = r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----"


def group(text: Column, pattern: str, index: int = 1) -> Column:
    """A capture group, null when it did not take part in a match."""
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


def number(text: Column, pattern: str, index: int = 1) -> Column:
    """A capture group as DOUBLE."""
    return group(text, pattern, index).try_cast("double")


def normalize_text(text: Column) -> Column:
    """Upper case, double spaces collapsed once, trimmed."""
    return F.trim(F.replace(F.upper(text), F.lit("  "), F.lit(" ")))


def tag_flag(tag: str, text: Column, normalized: Column) -> Column:
    """Whether either tagger gives ``tag`` to the text."""
    raw = F.trim(text)
    upper = F.upper(raw)
    tests = []
    for name, form, pattern in RAW_TAGS:
        if name != tag:
            continue
        if form == "label":
            size = F.length(raw)
            tests.append((size > 1) & (size < 60) & upper.rlike(pattern))
        else:
            tests.append((raw if form == "raw" else upper).rlike(pattern))
    tests += [normalized.rlike(p) for name, p in NORMAL_TAGS if name == tag]
    hit = tests[0]
    for t in tests[1:]:
        hit = hit | t
    return hit


def text_tags(text: Column, normalized: Column) -> Column:
    """Distinct tags of a text item as an array."""
    return F.filter(
        F.array(*[F.when(tag_flag(t, text, normalized), F.lit(t)) for t in TAGS]),
        lambda t: t.isNotNull(),
    )


def parse_token(token: Column) -> Column:
    """``1 3/8``, ``3/8`` or ``1.25`` as a number; null for anything else or a zero divisor."""
    s = F.regexp_replace(F.trim(token), TRAILING_MARKS, "")
    mixed = number(s, MIXED, 1) + F.try_divide(number(s, MIXED, 2), number(s, MIXED, 3))
    simple = F.try_divide(number(s, SIMPLE_FRACTION, 1), number(s, SIMPLE_FRACTION, 2))
    return F.coalesce(mixed, simple, number(s, DECIMAL))


def clean_dimension_text(text: Column) -> Column:
    """Typographic quotes and dashes to ASCII, ``DIA.`` to ``DIA``, blanks collapsed."""
    s = F.translate(text, *TYPOGRAPHIC)
    s = F.regexp_replace(s, r"(?i)DIA\.?", "DIA")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def feet_inches(s: Column, pattern: str) -> Column:
    """Inches of a feet-inches-fraction match; null when the pattern does not match."""
    return (
        number(s, pattern, 1) * 12
        + F.coalesce(number(s, pattern, 2), F.lit(0.0))
        + F.coalesce(F.try_divide(number(s, pattern, 3), number(s, pattern, 4)), F.lit(0.0))
    )


def with_token(df: DataFrame, token: Column, name: str) -> DataFrame:
    """Add ``parse_token(token)`` as a column, with the token worked out once."""
    return df.withColumn(f"_{name}", token).withColumn(name, parse_token(F.col(f"_{name}"))).drop(
        f"_{name}"
    )


def with_dimension(df: DataFrame, text: Column, name: str = "dim") -> DataFrame:
    """Add one parsed dimension per row as a struct; the first rule that applies wins.

    Fields: kind, value, width, length, ratio_num, ratio_den, units, quantity, confidence.
    Lengths are millimetres.  Every intermediate is a column of its own: the optimizer keeps
    such projections apart, so no pattern runs twice and the generated code stays small.
    """
    s = F.col("_s")
    kept = df.columns
    d = df.withColumn("_s", clean_dimension_text(text)).withColumns(
        {
            "_sw": group(s, SLOT, 1),
            "_sl": group(s, SLOT, 2),
            "_bt": F.when(s.rlike(DIAMETER), F.trim(F.regexp_replace(s, DIAMETER_NOISE, " "))),
            "_unit": F.upper(group(s, METRIC, 2)),
            "_num": number(s, RATIO, 1),
            "_den": number(s, RATIO, 2),
            "_qty": F.coalesce(group(s, QTY_PAREN), group(s, QTY_PREFIX)).try_cast("long"),
            "_ft": feet_inches(s, FEET_INCHES),
            "_im": F.coalesce(
                number(s, IMPERIAL_MIXED, 1)
                + F.try_divide(number(s, IMPERIAL_MIXED, 2), number(s, IMPERIAL_MIXED, 3)),
                F.try_divide(number(s, IMPERIAL_FRACTION, 1), number(s, IMPERIAL_FRACTION, 2)),
                number(s, IMPERIAL_PLAIN),
            ),
        }
    )
    d = d.withColumn(
        "_mt",
        number(s, METRIC, 1)
        * F.when(F.col("_unit") == "CM", 10).when(F.col("_unit") == "M", 1000).otherwise(1),
    ).withColumns({"_w": parse_token(F.col("_sw")), "_l": parse_token(F.col("_sl")),
                   "_bore": parse_token(F.col("_bt"))})
    kind = (
        F.when((F.col("_w") != 0) & (F.col("_l") != 0), "slot")
        .when(F.col("_bore").isNotNull(), "diameter")
        .when(F.coalesce("_ft", "_mt", "_im").isNotNull(), "linear")
        .when(F.col("_num").isNotNull(), "scale")
        .otherwise("unknown")
    )
    k = F.col("_kind")
    linear = F.when(F.col("_ft").isNotNull(), F.col("_ft") * MM_PER_INCH).when(
        F.col("_mt").isNotNull(), F.col("_mt")
    ).otherwise(F.col("_im") * MM_PER_INCH)
    conf = (
        F.when(k.isin("slot", "diameter"), 0.95)
        .when(k == "scale", 0.80)
        .when(k == "unknown", 0.10)
        .when(F.col("_ft").isNotNull(), 0.95)
        .when(F.col("_mt").isNotNull(), 0.90)
        .otherwise(0.85)
    )
    fact = F.struct(
        k.alias("kind"),
        F.when(k == "diameter", F.col("_bore") * MM_PER_INCH).when(k == "linear", linear).alias("value"),
        F.when(k == "slot", F.col("_w") * MM_PER_INCH).alias("width"),
        F.when(k == "slot", F.col("_l") * MM_PER_INCH).alias("length"),
        F.when(k == "scale", F.col("_num")).alias("ratio_num"),
        F.when(k == "scale", F.col("_den")).alias("ratio_den"),
        F.when(k.isin("slot", "diameter", "linear"), "mm").alias("units"),
        F.when(F.col("_qty") != 0, F.col("_qty")).alias("quantity"),
        conf.alias("confidence"),
    )
    return d.withColumn("_kind", kind).select(*kept, fact.alias(name))


def with_length(df: DataFrame, text: Column, name: str = "length_in") -> DataFrame:
    """Add the first feet-inches run of a text, in inches; null when there is none."""
    kept = [c for c in df.columns if c != name]
    d = df.withColumns(
        {"_feet": number(text, LENGTH_RUN, 1),
         "_rest": F.coalesce(group(text, LENGTH_RUN, 2), F.lit("0"))}
    )
    size = F.col("_feet") * 12 + F.coalesce(parse_inches(F.col("_rest")), F.lit(0.0))
    return d.select(*kept, size.alias(name))


def parse_inches(token: Column) -> Column:
    """``3/8``, ``6 7/8`` or ``1.25`` inches; no blanks around the slash."""
    s = F.trim(F.regexp_replace(F.trim(token), r"^\"+|\"+$", ""))
    mixed = r"^(\d+)\s+(\d+)/(\d+)$"
    simple = r"^(\d+)/(\d+)$"
    return F.coalesce(
        number(s, mixed, 1) + F.try_divide(number(s, mixed, 2), number(s, mixed, 3)),
        F.try_divide(number(s, simple, 1), number(s, simple, 2)),
        number(s, DECIMAL),
    )


def split_fraction_digits(text: Column) -> Column:
    """``1116`` as (11, 16): the largest power-of-two divisor that leaves a proper fraction."""
    s = F.trim(text)
    ok = s.rlike(r"^\d{2,}$")
    options = []
    for den in (64, 32, 16, 8, 4, 2):
        tail = str(den)
        head = F.left(s, F.length(s) - len(tail))
        value = head.try_cast("long")
        options.append(
            F.when(
                ok
                & s.endswith(tail)
                & (F.length(s) > len(tail))
                & (value > 0)
                & (value < den),
                F.struct(
                    head.alias("num_text"), F.lit(tail).alias("den_text"),
                    value.alias("num"), F.lit(den).cast("long").alias("den"),
                ),
            )
        )
    return F.coalesce(*options)


def strip_temporal(text: Column) -> Column:
    """Drop dates and clock times, which would read as fractions and ratios."""
    return F.trim(
        F.regexp_replace(F.regexp_replace(text, DATE_TOKEN, " "), CLOCK_TOKEN, " ")
    )


def text_width_units(text: Column) -> Column:
    """Approximate run width in font-size units, by character class."""

    def count_of(chars: str) -> Column:
        return F.length(text) - F.length(F.translate(text, chars, ""))

    digits = count_of("0123456789")
    narrow = count_of(" /'-\".")
    wide = count_of("MW@#%")
    other = F.length(text) - digits - narrow - wide
    return digits * 0.55 + narrow * 0.30 + wide * 0.95 + other * 0.65


def positive(value: Column) -> Column:
    """The value when it is finite and above zero, else null."""
    ok = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < float("inf"))
    return F.when(ok, value)


def font_size_effective(
    nominal: Column, raw: Column, ma: Column, mb: Column, mc: Column, md: Column
) -> Column:
    """Nominal size; else raw size times the text matrix's normal axis; else 3.0."""
    along, normal = F.hypot(ma, mb), F.hypot(mc, md)
    axis = F.when(normal >= 1e-6, normal).otherwise(along)
    scaled = positive(raw) * F.when(axis < 1e-6, F.lit(1.0)).otherwise(axis)
    return F.coalesce(positive(nominal), scaled, positive(raw), F.lit(3.0))


def text_angle(angle: Column) -> Column:
    """Angle folded into (-90, 90]."""
    return -(F.pmod(-angle + 90, F.lit(180.0)) - 90)


def glyph_extent(w: Column, h: Column, angle: Column) -> Column:
    """Glyph height and run width of an axis-aligned box, by text direction."""
    w, h = F.greatest(w, F.lit(0.0)), F.greatest(h, F.lit(0.0))
    eps = 1e-9
    empty = (w <= eps) & (h <= eps)
    steep = F.abs(text_angle(angle)) >= 45
    height = (
        F.when(empty, F.lit(0.0))
        .when(
            steep,
            F.when((w > eps) & (h > eps), F.least(w, h)).otherwise(F.greatest(w, h)),
        )
        .otherwise(F.when(h > eps, h).otherwise(w))
    )
    width = (
        F.when(empty, F.lit(0.0))
        .when(steep, F.greatest(w, h))
        .otherwise(F.when(w > eps, w).otherwise(h))
    )
    return F.struct(height.alias("height"), width.alias("width"))


def redact_secrets(text: Column) -> Column:
    """Mask quoted values behind secret-like names, and private key blocks."""
    masked = F.regexp_replace(text, SECRET, "$1$2<REDACTED>$2")
    return F.regexp_replace(masked, PRIVATE_KEY, "<REDACTED_PRIVATE_KEY_BLOCK>")


# Fixed value: the line breaks a text is cut at.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def text_lines(text: Column) -> Column:
    """Lines of a text; a closing line break does not open another line."""
    return F.split(F.regexp_replace(text, r"(?:" + LINE_BREAK + r")\z", ""), LINE_BREAK)


def clip_head_tail(text: Column, max_lines: int, head: int, tail: int) -> Column:
    """Keep the first and last lines of a very long text, with a marker between."""
    lines = text_lines(text)
    kept = F.concat(
        F.array_join(F.slice(lines, 1, head), "\n"),
        F.lit("\n\n# ... SNIPPED ...\n\n"),
        F.array_join(F.slice(lines, -tail, tail), "\n"),
    )
    long = F.size(lines) > max_lines
    return F.struct(F.when(long, kept).otherwise(text).alias("text"), long.alias("clipped"))


def confidence_action(score: Column) -> Column:
    """What a consumer may do with a value of this confidence."""
    return (
        F.when(score >= 0.85, "trusted")
        .when(score >= 0.75, "build_warn")
        .when(score >= 0.60, "candidate")
        .otherwise("report_only")
    )


def squeeze(text: Column) -> Column:
    """All blanks removed, upper case."""
    return F.upper(F.regexp_replace(text, r"\s+", ""))


def member_designation(match: Column) -> Column:
    """Canonical designation of one section callout, e.g. ``W 12 x 30`` to ``W12X30``."""
    family = group(match, MEMBER, 1)
    angle = group(match, MEMBER, 4)
    tube = group(match, MEMBER, 8)
    pipe = group(match, MEMBER, 12)

    def parts(*idx):
        return F.concat_ws("X", *[F.regexp_extract(match, MEMBER, i) for i in idx])

    return (
        F.when(family.isNotNull(), F.concat(family, parts(2, 3)))
        .when(angle.isNotNull(), F.concat(F.lit("L"), parts(5, 6, 7)))
        .when(tube.isNotNull(), F.concat(F.lit("HSS"), parts(9, 10, 11)))
        .when(
            pipe.isNotNull(),
            F.concat(
                F.lit("PIPE"),
                F.regexp_extract(match, MEMBER, 13),
                F.regexp_extract(match, MEMBER, 14),
            ),
        )
    )


def profile_hint(text: Column) -> Column:
    """Plate callout, else section designation, else a loosely written profile."""
    return F.coalesce(
        squeeze(group(text, PLATE, 0)),
        member_designation(group(text, MEMBER, 0)),
        squeeze(group(text, ROW_PROFILE, 1)),
    )


def with_profile_hint(df: DataFrame, text: Column, name: str = "hint") -> DataFrame:
    """Add ``profile_hint(text)`` in two steps, so each pattern is searched once per text."""
    kept = [c for c in df.columns if c != name]
    found = df.withColumns(
        {
            "_plate": group(text, PLATE, 0),
            "_member": group(text, MEMBER, 0),
            "_loose": group(text, ROW_PROFILE, 1),
        }
    )
    hint = F.coalesce(
        squeeze(F.col("_plate")), member_designation(F.col("_member")), squeeze(F.col("_loose"))
    )
    return found.select(*kept, hint.alias(name))


def part_kind(profile: Column) -> Column:
    return F.when(F.upper(profile).startswith("PL"), "plate").otherwise("member")


def row_quantity(text: Column) -> Column:
    """Labelled quantity, else a leading number, else one; at least one."""
    qty = F.coalesce(group(text, QTY_LABEL), group(text, QTY_LEADING)).try_cast("long")
    return F.greatest(F.coalesce(qty, F.lit(1)), F.lit(1)).cast("long")


def is_header_line(text: Column) -> Column:
    return F.upper(F.trim(text)).isin(*HEADER_LINES)


def unique_strings(values: Column) -> Column:
    """Trimmed non-blank strings of an array, first occurrence kept."""
    trimmed = F.transform(values, lambda v: F.trim(v))
    return F.array_distinct(F.filter(trimmed, lambda v: v.isNotNull() & (v != "")))
