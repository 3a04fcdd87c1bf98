"""Stacked and inline fractions: find the parts around a slash and merge them.

``texts``: doc_id, page, text_id, ord, text, ix, iy, font_size, rotation, font_name, laid_out.
``chars``: text_id, idx, ch, x, y of the items whose characters were all placed.
Identical overlays (equal in every observed column and in their characters) are folded to one class
before any pairing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.scale import block_of, dense_position, keep_when, shuffled_join, spread_join, written

PAGE = ["doc_id", "page"]
#: What overlays must share, as far as the texts have it, beside their characters.
OBSERVED = ("text", "normalized", "ix", "iy", "bx0", "by0", "bx1", "by1", "font_size", "rotation", "font_name", "color", "laid_out")
REACH_EM, AXIS_EM, INLINE_EM, STACK_ALONG_EM, STACK_NORMAL_EM = 5.0, 0.10, 0.75, 1.75, 3.5
DENOMS = (2, 4, 8, 16, 32, 64)


def _turn(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def _local(x: Column, y: Column, ax: Column, ay: Column, rot: Column, em: Column) -> tuple[Column, Column]:
    t = F.radians(rot)
    dx, dy = x - ax, y - ay
    return (dx * F.cos(t) + dy * F.sin(t)) / em, (dy * F.cos(t) - dx * F.sin(t)) / em


def _middle(*sizes: Column) -> Column:
    """Upper median of two or three sizes."""
    if len(sizes) == 2:
        return F.greatest(*sizes)
    a, b, c = sizes
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def _same_size(*sizes: Column) -> Column:
    return F.greatest(*sizes) <= F.least(*sizes) * 2


def spans(texts: DataFrame, chars: DataFrame) -> DataFrame:
    """Slash and digit items with their class, centroid and the centroids of a fraction split."""
    t = F.trim("text")
    slash = t.rlike(r"^[/⁄∕]$")
    digit = t.rlike(r"^\d{1,4}$")
    rows = texts.withColumns({"t": t, "is_slash": slash}).filter(slash | digit)
    rows = rows.withColumn("split", tx.split_fraction_digits(F.col("t")))
    cut = F.length("split.num_text")
    # Texts may be made of few rows by a generator, so none of them goes to the driver.
    placed = shuffled_join(chars, rows.select("text_id", cut.alias("cut")), "text_id").groupBy("text_id").agg(
        F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        F.avg(F.when(F.col("idx") < F.col("cut"), F.col("x"))).alias("nx"),
        F.avg(F.when(F.col("idx") < F.col("cut"), F.col("y"))).alias("ny"),
        F.avg(F.when(F.col("idx") >= F.col("cut"), F.col("x"))).alias("dx"),
        F.avg(F.when(F.col("idx") >= F.col("cut"), F.col("y"))).alias("dy"),
        # combines in any order; equal characters in equal places give equal sums
        F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("idx", "ch", "x", "y")).alias("_h"),
    )
    seen = [c for c in OBSERVED if c in texts.columns]
    k = F.ceil(F.log2(F.greatest("font_size", F.lit(0.01)))).cast("int")
    return shuffled_join(rows, placed, "text_id", "left").withColumns(
        {
            "exact": F.col("laid_out") & F.col("cx").isNotNull(),
            "x": F.coalesce("cx", "ix"), "y": F.coalesce("cy", "iy"), "k": k,
            "value": F.col("t").try_cast("long"),
            "cls": F.sha2(F.to_json(F.struct(*seen, "_n", "_h")), 256),
        }
    )


def near_digits(sp: DataFrame) -> DataFrame:
    """Slash and digit classes within reach, found on a grid per size class.

    A digit is filed under its own size class and the next one, since sizes further apart cannot form
    a fraction; also under those up to the largest unclear slash of its page, which blocks digits of
    any size; and under all classes of the page when it lacks a layout, because such a digit blocks
    the slash whatever its size.  A digit lies in its own cell only: slashes, which are fewer, look around.
    """
    unclear = F.col("is_slash") & ~(F.col("exact") & (F.col("t") == "/"))
    # Dealt over salts below, which makes it many times as large as the optimizer takes it for.
    tops = sp.groupBy(*PAGE).agg(
        F.max("k").alias("hi"), F.coalesce(F.max(F.when(unclear, F.col("k"))), F.min("k")).alias("hi_unclear")
    ).hint("merge")
    reach = REACH_EM * F.pow(F.lit(2.0), F.col("c"))

    def cell(v):
        return F.floor(F.col(v) / reach).cast("long")

    cols = ("text_id", "ord", "t", "x", "y", "ix", "iy", "font_size", "rotation", "font_name",
            "exact", "k", "cls")
    s = sp.filter("is_slash").groupBy(*PAGE, "cls").agg(F.min_by(F.struct(*cols), "ord").alias("s")).select(
        *PAGE, *[F.col(f"s.{c}").alias(f"s_{c}") for c in cols]
    )
    d = sp.filter("not is_slash").groupBy(*PAGE, "cls").agg(
        F.min_by(F.struct(*cols, "split", "nx", "ny", "dx", "dy", "value"), "ord").alias("d")
    ).select(*PAGE, "d.*")
    s = spread_join(s, tops.select(*PAGE, "hi"), PAGE, "s_text_id")
    s = s.withColumn("c", F.explode(F.sequence("s_k", "hi"))).drop("hi").withColumn(
        "gx", F.explode(F.array(cell("s_x") - 1, cell("s_x"), cell("s_x") + 1))
    ).withColumn("gy", F.explode(F.array(cell("s_y") - 1, cell("s_y"), cell("s_y") + 1)))
    upto = F.when(F.col("exact"), F.greatest(F.col("k") + 1, F.col("hi_unclear"))).otherwise(F.col("hi"))
    d = spread_join(d, tops, PAGE, "text_id").withColumn("c", F.explode(F.sequence(F.col("k"), upto)))
    d = d.drop("hi", "hi_unclear").withColumns({"gx": cell("x"), "gy": cell("y")})
    em = _middle(F.col("font_size"), F.col("s_font_size"))
    at_char = _local(F.col("x"), F.col("y"), F.col("s_x"), F.col("s_y"), F.col("s_rotation"), em)
    at_pen = _local(F.col("ix"), F.col("iy"), F.col("s_ix"), F.col("s_iy"), F.col("s_rotation"), em)
    good = F.col("s_exact") & (F.col("s_t") == "/")

    def within(p):
        return (F.abs(p[0]) <= REACH_EM) & (F.abs(p[1]) <= REACH_EM)

    return (
        shuffled_join(d, s, [*PAGE, "c", "gx", "gy"])
        .filter(F.col("c") == F.greatest("k", "s_k"))
        .filter(_turn(F.col("rotation"), F.col("s_rotation")) <= 1.0)
        .filter(F.when(good, within(at_char)).otherwise(within(at_pen)))
        .withColumn("good_slash", good)
        .drop("c", "gx", "gy")
    )


def _encoding(na, nn, da, dn) -> Column:
    vertical = (
        (nn >= AXIS_EM) & (dn <= -AXIS_EM) & (F.greatest(F.abs(nn), F.abs(dn)) <= STACK_NORMAL_EM)
        & (F.greatest(F.abs(na), F.abs(da)) <= STACK_ALONG_EM)
    )
    horizontal = (
        (na <= -AXIS_EM) & (da >= AXIS_EM) & (F.greatest(F.abs(na), F.abs(da)) <= REACH_EM)
        & (F.greatest(F.abs(nn), F.abs(dn)) <= INLINE_EM)
    )
    return F.when(vertical & ~horizontal, "vertical").when(horizontal & ~vertical, "horizontal")


def fraction_candidates(near: DataFrame) -> DataFrame:
    """Proposals around every good slash class: numerator and denominator class, layout kind.

    ``bound`` is false when the parts do not share one font, which makes the slash ambiguous.
    """
    ok = near.filter("good_slash and exact")
    slash = ("s_cls", "s_ord", "s_x", "s_y", "s_font_size", "s_rotation", "s_font_name")
    sx, sy, rot = F.col("s_x"), F.col("s_y"), F.col("s_rotation")
    em2 = _middle(F.col("font_size"), F.col("s_font_size"), F.col("font_size"))
    na, nn = _local(F.col("nx"), F.col("ny"), sx, sy, rot, em2)
    da, dn = _local(F.col("dx"), F.col("dy"), sx, sy, rot, em2)
    joined = ok.filter("split is not null").filter(_same_size(F.col("font_size"), F.col("s_font_size")))
    single = joined.select(
        *PAGE, "s_cls", F.lit("concatenated").alias("kind"),
        _encoding(na, nn, da, dn).alias("encoding"),
        F.concat_ws("/", "split.num_text", "split.den_text").alias("semantic"),
        F.col("cls").alias("n_cls"), F.lit("").alias("d_cls"), F.col("ord").alias("n_ord"),
        F.lit(None).cast("long").alias("d_ord"), "s_ord",
        F.struct(F.lit(0).alias("kind"), F.col("ord").alias("lo"), F.col("ord").alias("hi")).alias("turn"),
        (F.col("font_name") == F.col("s_font_name")).alias("bound"),
    )
    part = ("cls", "ord", "t", "x", "y", "font_size", "rotation", "font_name", "value")
    loose = ok.filter("split is null")
    num = loose.select(*PAGE, *slash, *[F.col(c).alias(f"n_{c}") for c in part])
    den = loose.filter(F.col("value").isin(*DENOMS)).select(
        *PAGE, "s_cls", *[F.col(c).alias(f"d_{c}") for c in part]
    )
    sizes = [F.col(f"{p}_font_size") for p in ("n", "s", "d")]
    em3 = _middle(*sizes)
    a1, n1 = _local(F.col("n_x"), F.col("n_y"), sx, sy, rot, em3)
    a2, n2 = _local(F.col("d_x"), F.col("d_y"), sx, sy, rot, em3)
    pair = (
        num.join(den, [*PAGE, "s_cls"])
        .filter((F.col("n_value") > 0) & (F.col("n_value") < F.col("d_value")) & _same_size(*sizes))
        .filter(_turn(F.col("n_rotation"), F.col("d_rotation")) <= 1.0)
        .select(
            *PAGE, "s_cls", F.lit("separate").alias("kind"), _encoding(a1, n1, a2, n2).alias("encoding"),
            F.concat_ws("/", "n_t", "d_t").alias("semantic"), "n_cls", "d_cls", "n_ord", "d_ord", "s_ord",
            F.struct(F.lit(1).alias("kind"), F.least("n_ord", "d_ord").alias("lo"),
                     F.greatest("n_ord", "d_ord").alias("hi")).alias("turn"),
            ((F.col("n_font_name") == F.col("s_font_name"))
             & (F.col("d_font_name") == F.col("s_font_name"))).alias("bound"),
        )
    )
    return keep_when(single.unionByName(pair), F.col("encoding").isNotNull())


def merge_decisions(texts: DataFrame, chars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, members): one accepted proposal per fraction, and every class's items."""
    sp = written(spans(texts, chars), "spans")
    # Read by several joins below, so each is written once.
    near = written(near_digits(sp), "near")
    cand = written(fraction_candidates(near), "proposals")
    members = sp.select(*PAGE, "cls", "text_id", "ord")
    bad = near.groupBy(*PAGE, "s_cls").agg(
        F.max((~F.col("good_slash")).cast("int")).alias("bad_slash"),
        F.max((F.col("good_slash") & ~F.col("exact")).cast("int")).alias("bad_digit"),
    )
    tally = cand.groupBy(*PAGE, "s_cls").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("bound").cast("int")).alias("all_bound"),
    )
    state = bad.join(tally, [*PAGE, "s_cls"], "left")
    lone_bad = sp.filter("is_slash and not (exact and t = '/')").select(*PAGE, F.col("cls").alias("c"))
    invalid = near.filter("not good_slash or not exact").select(
        *PAGE, F.explode(F.array("cls", "s_cls")).alias("c")
    )
    unclear = state.filter("bad_slash = 0 and bad_digit = 0 and n is not null and (n > 1 or all_bound = 0)")
    # The first pair without one font stops its slash and is all that is blocked; else every proposal is.
    first = cand.filter("not bound").groupBy(*PAGE, "s_cls").agg(
        F.min_by(F.array("s_cls", "n_cls", "d_cls"), "turn").alias("parts")
    )
    doubtful = cand.join(unclear.select(*PAGE, "s_cls"), [*PAGE, "s_cls"], "left_semi")
    stopped = first.join(unclear.select(*PAGE, "s_cls"), [*PAGE, "s_cls"], "left_semi")
    rivals = doubtful.join(first, [*PAGE, "s_cls"], "left_anti").select(
        *PAGE, F.array("s_cls", "n_cls", "d_cls").alias("parts")
    )
    parts = stopped.select(*PAGE, "parts").unionByName(rivals).select(*PAGE, F.explode("parts").alias("c"))
    blocked = lone_bad.unionByName(invalid).unionByName(parts).filter("c <> ''").distinct()
    fine = state.filter("bad_slash = 0 and bad_digit = 0 and n = 1 and all_bound = 1")
    props = cand.join(fine.select(*PAGE, "s_cls"), [*PAGE, "s_cls"], "left_semi")
    props = props.withColumn("parts", F.filter(F.array("s_cls", "n_cls", "d_cls"), lambda c: c != ""))
    uses = props.select(*PAGE, F.col("s_cls").alias("p"), F.explode("parts").alias("c"))
    struck = uses.join(blocked, [*PAGE, "c"], "left_semi").select(*PAGE, "p").distinct()
    open_uses = uses.join(struck, [*PAGE, "p"], "left_anti")
    shared = open_uses.groupBy(*PAGE, "c").agg(F.count(F.lit(1)).alias("u")).filter("u > 1")
    clash = open_uses.join(shared, [*PAGE, "c"], "left_semi").select(*PAGE, "p").distinct()
    accepted = props.join(
        struck.unionByName(clash).select(*PAGE, F.col("p").alias("s_cls")).distinct(),
        [*PAGE, "s_cls"], "left_anti",
    )
    return accepted, members


def merge_fractions(texts: DataFrame, chars: DataFrame) -> DataFrame:
    """Texts with every unambiguous fraction merged into its slash, and dense page-local ids."""
    accepted, members = merge_decisions(texts, chars)
    accepted = written(accepted, "accepted")
    eaten = accepted.select(*PAGE, F.explode("parts").alias("cls")).join(members, [*PAGE, "cls"]).select(
        *PAGE, "text_id"
    ).distinct()
    anchors = accepted.join(
        members.groupBy(*PAGE, F.col("cls").alias("s_cls")).agg(F.min_by("text_id", "ord").alias("text_id")),
        [*PAGE, "s_cls"],
    ).select(*PAGE, "text_id", "semantic", "encoding")
    kept = texts.join(eaten, [*PAGE, "text_id"], "left_anti").select(
        *PAGE, "text_id", "ord", "text", F.lit("").alias("encoding")
    )
    merged = texts.join(anchors, [*PAGE, "text_id"]).select(
        *PAGE, "text_id", "ord", F.col("semantic").alias("text"), "encoding"
    )
    rows = kept.unionByName(merged)
    return dense_position(rows, PAGE, ["ord"], [block_of("ord")], "pos").withColumn(
        "new_id", F.col("pos") + 1
    ).drop("pos")
