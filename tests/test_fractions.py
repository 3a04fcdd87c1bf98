"""What blocks a fraction, on hand-made texts."""

from pyspark.sql import functions as F

from sheetlake.operators import fractions

TEXTS = (
    "doc_id long, page long, text_id long, ord long, text string, ix double, iy double, font_size double, "
    "rotation double, font_name string, laid_out boolean, color string"
)


def merged(spark, rows):
    """rows: text, x, y, size, font, laid out, colour."""
    made = [(0, 1, k, k, t, x, y, s, 0.0, f, ok, c) for k, (t, x, y, s, f, ok, c) in enumerate(rows)]
    texts = spark.createDataFrame(made, TEXTS)
    chars = [(k, i, ch, r[5] + i * r[7] * 0.5, r[6]) for k, r in enumerate(made) if r[10] for i, ch in enumerate(r[4])]
    chars = spark.createDataFrame(chars, "text_id long, idx int, ch string, x double, y double")
    return sorted(r.text for r in fractions.merge_fractions(texts, chars).collect())


def row(text, x, size=2.5, font="A", ok=True, y=0.0, color="black"):
    return text, x, y, size, font, ok, color


PLAIN = [row("3", -2.0), row("/", 0.0), row("8", 2.0)]


def test_plain_and_unclear_slashes(spark):
    assert merged(spark, PLAIN) == ["3/8"]
    for size in (2.5, 20.0, 20_000.0):
        assert merged(spark, [*PLAIN, row("⁄", 3.0, size)]) == sorted(["3", "/", "8", "⁄"])
    assert merged(spark, [*PLAIN, row("⁄", 3_000.0, 20.0)]) == ["3/8", "⁄"]


def test_first_pair_without_one_font_is_all_that_is_blocked(spark):
    rows = [row("3", -2.0, font="B"), row("/", 0.0), row("8", 2.0), row("1", 47.0), row("/", 49.0), row("4", 51.0)]
    assert merged(spark, rows) == sorted(["3", "/", "8", "1/4"])


def test_overlays_must_agree_in_all_they_show(spark):
    assert merged(spark, [*PLAIN, *PLAIN]) == ["3/8"]
    other = [row("3", -2.0, color="red"), *PLAIN[1:]]
    assert merged(spark, [*PLAIN, *other]) == sorted(["3", "3", "/", "/", "8", "8"])


def test_slashes_look_around_and_digits_stay_in_their_cell(spark):
    """Digits are the many: only the rows of slashes are copied to neighbouring cells."""
    texts = spark.createDataFrame([], TEXTS)
    chars = spark.createDataFrame([], "text_id long, idx int, ch string, x double, y double")
    plan = fractions.near_digits(fractions.spans(texts, chars))._jdf.queryExecution().analyzed().toString()
    around = [line for line in plan.splitlines() if "Generate explode(array(" in line]
    assert len(around) == 2 and all("s_x" in line or "s_y" in line for line in around)


def test_generated_texts_and_cells_are_never_broadcast(spark):
    """Texts, cells and copies made of few rows look small to the optimizer."""
    made = spark.range(2).select(*[F.col("id").cast(kind).alias(name) for name, kind in map(str.split, TEXTS.split(", "))])
    chars = made.selectExpr("text_id", "1 as idx", "text as ch", "ix as x", "iy as y")
    sp = fractions.spans(made, chars)
    for found in (sp, fractions.near_digits(sp)):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
