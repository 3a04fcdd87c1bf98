"""Roll-ups of runs, timings, files, fonts and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scale import running_sum, spread_join

# Stages a timing report knows.
KNOWN_STAGES = ("extract_ms", "host_build_ms", "cache_lookup_ms", "cache_store_ms")


def usable(ms: Column) -> Column:
    return ms.isNotNull() & ~F.isnan(ms) & (ms >= 0) & (ms < float("inf"))


def stage_timing(events: DataFrame, totals: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """Milliseconds and counts per stage of every run, unclassified time, what is unaccounted.

    Unusable durations are dropped.  ``totals``: run_id, total_ms (wall clock).
    """
    good = events.filter(usable(F.col("ms")))
    aggs = []
    for s in stages:
        hit = F.col("stage") == s
        aggs += [
            F.sum(F.when(hit, F.col("ms"))).alias(s),
            F.count(F.when(hit, 1)).alias(f"{s}_count"),
        ]
    loose = ~F.col("stage").isin(*KNOWN_STAGES)
    runs = good.groupBy("run_id").agg(
        *aggs, F.sum("ms").alias("_leaf"), F.count(F.when(loose, 1)).alias("unclassified")
    )
    total = F.col("total_ms")
    rest = F.greatest(total - F.col("_leaf"), F.lit(0.0))

    def share(c):
        return F.when(total > 0, F.coalesce(F.col(c), F.lit(0.0)) / total * 100)

    return runs.join(totals, "run_id", "left").select(
        "run_id",
        *[F.col(n) for s in stages for n in (s, f"{s}_count")],
        "unclassified", "total_ms", rest.alias("unaccounted_ms"),
        share("extract_ms").alias("extract_share_pct"),
        share("host_build_ms").alias("host_build_share_pct"),
    )


def page_progress(events: DataFrame, budget_ms: float) -> DataFrame:
    """Running time and position of every event of a run, with the soft budget flag."""
    good = events.filter(usable(F.col("ms")))
    run = running_sum(
        good, ["run_id"], "ord", {"position": F.lit(1).cast("long"), "elapsed_ms": F.col("ms")}
    )
    totals = good.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"))
    return spread_join(run, totals, ["run_id"], "ord").select(
        "run_id", "ord", "ms", "position", "total", "elapsed_ms",
        (F.col("ms") > budget_ms).alias("over_budget"),
    )


def batch_rollup(results: DataFrame, keys: list[str], min_entities: int) -> DataFrame:
    """Passed and failed items per run; the smoke rule also asks for enough entities."""
    passed = ~F.col("crashed")
    smoke = passed & (F.col("entities") >= min_entities)
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(passed, 1)).alias("passed"),
        F.count(F.when(~passed, 1)).alias("failed"),
        F.count(F.when(smoke, 1)).alias("smoke_passed"),
        F.sum(F.when(passed, F.col("entities")).otherwise(0)).alias("entities"),
    )


def counts_delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """After minus before for every key either side has; a missing side counts as zero."""
    b = before.groupBy(*keys).agg(F.sum("n").alias("before"))
    a = after.groupBy(*keys).agg(F.sum("n").alias("after"))
    return b.join(a, keys, "full_outer").fillna(0, ["before", "after"]).withColumn(
        "delta", F.col("after") - F.col("before")
    )


def corpus_quantiles(counters: DataFrame, caps: dict[str, float]) -> DataFrame:
    """Exact p50, p99 and maximum of every integer counter and its headroom below the cap.

    Values are folded to their counts and given running counts block by block; a quantile then
    is the lowest value whose running count passes its rank, a combinable minimum.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("v")) for m in caps])
    folded = counters.select(F.explode(pairs).alias("p")).select("p.*").filter("v is not null").groupBy(
        "metric", "v"
    ).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sum(folded, ["metric"], "v", {"upto": F.col("n")})
    total = folded.groupBy("metric").agg(F.sum("n").alias("total"))
    joined = spread_join(ranked, total, ["metric"], "v")

    def at(p, edge):
        rank = edge((F.col("total") - 1) * p)
        return F.min(F.when(F.col("upto") > rank, F.col("v")))

    probs = {"p50": 0.5, "p99": 0.99}
    marks = [at(p, e).alias(f"{k}_{n}") for k, p in probs.items() for n, e in (("lo", F.floor), ("hi", F.ceil))]
    found = joined.groupBy("metric").agg(*marks, F.max("v").alias("_max"), F.first("total").alias("total"))

    def between(k, p):
        pos = (F.col("total") - 1) * p
        return F.col(f"{k}_lo") + (pos - F.floor(pos)) * (F.col(f"{k}_hi") - F.col(f"{k}_lo"))

    cap = F.create_map(*[F.lit(v) for m, c in caps.items() for v in (m, float(c))])
    return found.select(
        "metric", *[between(k, p).cast("double").alias(k) for k, p in probs.items()],
        F.col("_max").cast("double").alias("max"), (cap[F.col("metric")] / F.col("_max")).alias("headroom"),
    )


def set_digest(files: DataFrame, keys: list[str]) -> DataFrame:
    """Order-free digest of a set of (path, sha256) pairs per key.

    The digest of every line is cut into eight words; their sums and exclusive ors, which combine in
    any order and in any task, are hashed together with the number of lines.
    """
    line = F.sha2(F.concat_ws("=", "path", "sha256"), 256)
    words = {f"_w{i}": F.conv(F.substring(line, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(8)}
    folded = files.select(*keys, *[c.alias(n) for n, c in words.items()]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"),
        *[F.sum(n).alias(f"{n}s") for n in words], *[F.bit_xor(n).alias(f"{n}x") for n in words],
    )
    parts = [F.col("files"), *[F.col(f"{n}s") for n in words], *[F.col(f"{n}x") for n in words]]
    return folded.select(
        *keys, F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256).alias("sha256"), "files"
    )


def manifest_diff(files: DataFrame, manifest: DataFrame, allowed: DataFrame) -> DataFrame:
    """Files against a manifest: unexpected, missing, hash mismatch, allowed divergence."""
    have = files.select("path", F.col("sha256").alias("actual"))
    want = manifest.select("path", F.col("sha256").alias("expected"))
    ok = allowed.select("path").distinct().withColumn("_ok", F.lit(True))
    both = have.join(want, "path", "full_outer").join(ok, "path", "left")
    status = (
        F.when(F.col("expected").isNull(), "unexpected")
        .when(F.col("actual").isNull(), "missing")
        .when(F.col("actual") == F.col("expected"), "match")
        .when(F.col("_ok"), "allowed_divergence")
        .otherwise("hash_mismatch")
    )
    return both.select("path", status.alias("status")).filter("status <> 'match'")


def font_substitution(fonts: DataFrame, shown: int = 5) -> DataFrame:
    """Fonts that are not embedded, per document: how many, and the first few by name.

    Names are folded to distinct ones first; ranks beyond ``shown`` are cut before the exchange.
    """
    names = fonts.filter(~F.col("embedded")).select(
        "doc_id", F.trim(F.coalesce("font_name", F.lit("unknown"))).alias("font")
    ).filter("font <> ''").distinct()
    total = names.groupBy("doc_id").agg(F.count(F.lit(1)).alias("fonts"))
    w = Window.partitionBy("doc_id").orderBy("font")
    first = names.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= shown)
    sample = first.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_list("font")), ", ").alias("_s")
    )
    more = F.when(
        F.col("fonts") > shown,
        F.concat(F.lit(" (+"), (F.col("fonts") - shown).cast("string"), F.lit(" more)")),
    ).otherwise("")
    return total.join(sample, "doc_id").select(
        "doc_id", "fonts", F.concat("_s", more).alias("sample")
    )


def ink(prefix: str) -> Column:
    """A visible pixel that is not nearly white."""
    r, g, b, a = (F.col(f"{prefix}_{k}") for k in "rgba")
    return (a > 0) & (F.least(r, g, b) < 250)


def raster_compare(reference: DataFrame, delivered: DataFrame) -> DataFrame:
    """Pixel comparison per asset: exact flag, mean absolute RGBA error, ink recall.

    Both sides: asset_id, x, y, r, g, b, a.  Assets of different size score null and zero.
    Pixels meet on (asset, x, y), so one large asset spreads over many tasks.
    """
    def side(df, p):
        return df.select("asset_id", "x", "y", *[F.col(k).alias(f"{p}_{k}") for k in "rgba"])

    both = side(reference, "e").join(side(delivered, "d"), ["asset_id", "x", "y"], "full_outer")
    err = sum((F.abs(F.col(f"e_{k}") - F.col(f"d_{k}")) for k in "rgba"), F.lit(0))
    in_e, in_d = F.col("e_a").isNotNull(), F.col("d_a").isNotNull()
    t = both.groupBy("asset_id").agg(
        F.sum(err).alias("_err"), F.count(F.lit(1)).alias("_n"),
        F.max(F.when(in_e, F.col("x"))).alias("_ew"), F.max(F.when(in_e, F.col("y"))).alias("_eh"),
        F.max(F.when(in_d, F.col("x"))).alias("_dw"), F.max(F.when(in_d, F.col("y"))).alias("_dh"),
        F.count(F.when(ink("e"), 1)).alias("_ink"),
        F.count(F.when(ink("e") & ink("d"), 1)).alias("_kept"),
    )
    same = (F.col("_ew") == F.col("_dw")) & (F.col("_eh") == F.col("_dh"))
    same = F.coalesce(same, F.lit(False))
    return t.select(
        "asset_id", same.alias("same_size"), (same & (F.col("_err") == 0)).alias("pixel_exact"),
        F.when(same, F.col("_err") / (F.col("_n") * 4)).alias("mae"),
        F.when(~same, 0.0).when(F.col("_ink") > 0, F.col("_kept") / F.col("_ink")).otherwise(1.0)
        .alias("ink_recall"),
    )


def alpha_class(pixels: DataFrame) -> DataFrame:
    """Kind of transparency of every asset, and the box of its visible pixels (half open)."""
    seen = F.col("a") > 0
    t = pixels.groupBy("asset_id").agg(
        (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"),
        F.count(F.when(seen, 1)).alias("visible"),
        F.max((seen & (F.col("a") < 255)).cast("int")).alias("partial"),
        F.min(F.when(seen, F.col("x"))).alias("left"), F.min(F.when(seen, F.col("y"))).alias("top"),
        (F.max(F.when(seen, F.col("x"))) + 1).alias("right"),
        (F.max(F.when(seen, F.col("y"))) + 1).alias("bottom"),
    )
    area = (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))
    full = (F.col("left") == 0) & (F.col("top") == 0) & (F.col("right") == F.col("w")) & (
        F.col("bottom") == F.col("h")
    )
    kind = (
        F.when(F.col("visible") == 0, "zero")
        .when(F.col("partial") == 1, "compositing_required")
        .when((F.col("visible") == area) & full, "opaque")
        .when(F.col("visible") == area, "rectangular_opaque")
        .otherwise("binary_mask")
    )
    return t.select(
        "asset_id", kind.alias("kind"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("left", "top", "right", "bottom")],
    )
