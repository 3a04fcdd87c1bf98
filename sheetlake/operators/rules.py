"""Rule validators over outcome, profile and report records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vocabularies of the outcome axes and source profiles.
STRATEGIES = ("native", "host_proved_hybrid", "visual_recovery", "incomplete")
REPRESENTATIONS = ("text", "labels", "3d_text", "glyphs", "geometry", "raster", "none")
EDITABLE = ("text", "labels", "3d_text", "glyphs", "geometry")
VOCABULARY = {
    "effective_page_strategy": STRATEGIES,
    "requested_representation": REPRESENTATIONS,
    "structural_status": ("pass", "fail", "not_certified"),
    "visual_status": ("pass", "fail", "unproved"),
    "requested_representation_status": ("pass", "fail", "not_applicable"),
    "cell_status": ("pass", "fail"),
    "visual_recovery": ("absent", "attempted", "certified", "failed"),
}
SCAN_STATUSES = ("partial", "incomplete", "error")
STATUS_CODES = (
    "source_profile_partial", "semantic_scan_incomplete", "resource_budget_incomplete",
    "semantic_scan_error",
)
FEATURE_CODES = (
    "pdf_shading_paint", "pdf_shading_pattern_paint", "pdf_tiling_pattern_paint",
    "pdf_visible_annotation_appearance", "pdf_visible_widget_appearance", "pdf_non_normal_blend",
    "pdf_fill_alpha", "pdf_stroke_alpha", "pdf_soft_mask_composite", "pdf_image_mask_composite",
    "pdf_transparency_group", "pdf_knockout_group", "pdf_type3_glyph_program",
    "pdf_inline_image_paint", "pdf_text_clip", "pdf_nontrivial_clip", "pdf_complex_color_space",
    "pdf_postscript_xobject",
)
CAPS = {
    "resolved_objects": 4096, "decoded_bytes": 16 * 1024 * 1024,
    "operator_tokens": 1_000_000, "annotation_entries": 2048,
}
FAILED_STATES = ("failed", "error", "incomplete", "cancelled", "pending", "pending_export")


def hits(*tests: tuple[Column, str]) -> Column:
    """Codes of the tests that hold, in order."""
    return F.filter(
        F.array(*[F.when(test, F.lit(code)) for test, code in tests]), lambda c: c.isNotNull()
    )


def derived_cell_status() -> Column:
    """Pass only when structure, requested representation and visuals all pass."""
    ok = (
        (F.col("effective_page_strategy") != "visual_recovery")
        & (F.col("structural_status") == "pass")
        & F.col("requested_representation_status").isin("pass", "not_applicable")
        & (F.col("visual_status") == "pass")
    )
    return F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")


def outcome_violations(outcomes: DataFrame) -> DataFrame:
    """Records with the codes of every law they break; vocabulary faults come first, alone."""
    words = hits(
        *[(F.col(f).isNull(), f"missing:{f}") for f in VOCABULARY],
        *[(~F.col(f).isin(*allowed), f"vocabulary:{f}") for f, allowed in VOCABULARY.items()],
    )
    recovery = F.col("effective_page_strategy") == "visual_recovery"
    req, status = F.col("requested_representation"), F.col("requested_representation_status")
    laws = hits(
        ((req == "raster") & (recovery | (F.col("visual_recovery") != "absent")), "law5_raster_label"),
        (recovery & F.col("has_item_transitions"), "law2_item_transitions"),
        (recovery & (status == "pass"), "law2_representation_pass"),
        (recovery & (F.col("structural_status") != "not_certified"), "law3_structural"),
        (recovery & req.isin(*EDITABLE) & (status != "fail"), "law3_representation"),
        (recovery & (F.coalesce("native_peer_count", F.lit(0)) != 0), "law6_native_peers"),
        ((F.col("visual_status") == "pass")
         & (F.coalesce("visual_proof_digest", F.lit("")) == ""), "law3_visual_proof"),
        ((F.col("visual_status") == "pass") & (F.col("visual_recovery") == "failed"), "law6_failed_recovery"),
        ((F.col("cell_status") == "pass") & (derived_cell_status() != "pass"), "law4_cell_pass"),
    )
    return outcomes.withColumn("violations", F.when(F.size(words) > 0, words).otherwise(laws))


def cell_status(outcomes: DataFrame) -> DataFrame:
    """The only status the axes support, and the sentence a user reads."""
    derived = derived_cell_status()
    sentence = (
        F.when(
            F.col("effective_page_strategy") == "visual_recovery",
            "visual recovery created; requested representation not certified",
        )
        .when(derived == "pass", "requested representation delivered and certified")
        .otherwise("requested representation not certified")
    )
    return outcomes.withColumns({"status": derived, "completion": sentence})


def source_profile_check(profiles: DataFrame, schema: str) -> DataFrame:
    """Profiles with their conformance faults and whether they may authorise a native route."""
    codes = F.col("feature_codes")
    mode, status = F.col("accounting_mode"), F.col("scan_status")
    known = F.array(*[F.lit(c) for c in FEATURE_CODES])
    faults = hits(
        (F.coalesce(F.col("schema") != schema, F.lit(True)), "schema"),
        (mode == "closed_world", "closed_world_mode"),
        (F.coalesce(~mode.isin("closed_world", "feature_detection"), F.lit(True)), "accounting_mode"),
        (F.coalesce("closed_world", F.lit(False)), "closed_world_flag"),
        (status == "complete", "scan_complete"),
        (F.coalesce(~status.isin("complete", *SCAN_STATUSES), F.lit(True)), "scan_status"),
        (F.coalesce(~F.col("status_code").isin(*STATUS_CODES), F.lit(True)), "status_code"),
        (codes.isNull(), "codes_missing"),
        (F.size(F.array_except(codes, known)) > 0, "unknown_code"),
        (codes != F.array_sort(F.array_distinct(codes)), "codes_order"),
    )
    native = (mode == "closed_world") & (status == "complete") & (F.size(codes) == 0)
    return profiles.withColumns(
        {"faults": faults, "native_eligible": F.coalesce(native, F.lit(False))}
    )


def limit_breaches(profiles: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Counters above their caps, and the status a breach forces."""
    caps = caps or CAPS
    over = hits(*[(F.coalesce(F.col(k), F.lit(0)) > caps[k], k) for k in sorted(caps)])
    any_over = F.size("breaches") > 0
    return profiles.withColumn("breaches", over).withColumns(
        {
            "scan_status": F.when(any_over, "incomplete").otherwise(F.col("scan_status")),
            "status_code": F.when(any_over, "resource_budget_incomplete").otherwise(
                F.col("status_code")
            ),
        }
    )


def contract_ready(reports: DataFrame) -> DataFrame:
    """Readiness checks of a report and their conjunction."""
    no = F.lit(False)
    ok_state = ~F.lower(F.coalesce("status", F.lit("success"))).isin(*FAILED_STATES)
    checks = {
        "build_stamp": F.trim(F.coalesce("build_stamp", F.lit(""))) != "",
        "scale_crosscheck": F.coalesce(F.col("crosscheck_level").isin("ok", "warn"), no),
        "actual_text_entity_types": (F.coalesce("text_entities", F.lit(0)) <= 0) | F.col("has_entity_types"),
        "text_delivery": (
            ~F.coalesce("import_text", F.lit(True)) | (F.coalesce("text_source_spans", F.lit(0)) <= 0)
            | F.coalesce(~F.col("delivery_required"), no) | F.coalesce("delivery_verified", no)
        ),
        "result_succeeded": ok_state & F.col("terminal_failure").isNull(),
        "no_terminal_failure": F.col("terminal_failure").isNull(),
        "no_open_failure": F.col("open_failure").isNull(),
    }
    ready = F.lit(True)
    for c in checks:
        ready = ready & F.col(c)
    return reports.withColumns(checks).withColumn("ready", ready)


def scale_crosscheck(reports: DataFrame, trust: float = 0.70, tension: float = 0.85,
                     disagree: float = 0.15) -> DataFrame:
    """Reasons to distrust a document scale.

    ``reports``: factor, source, confidence, fallback_reason, title_block, dimension_count,
    alternates (array of factors).
    """
    factor, conf = F.col("factor"), F.col("confidence")
    has = F.coalesce(factor != 0, F.lit(False))
    none = (F.coalesce("fallback_reason", F.lit("")) == "no_scale_detected") | ~has
    title = F.coalesce("title_block", F.lit(False))
    apart = F.exists(
        "alternates",
        lambda a: (a > 0) & (F.abs(a - factor) / F.greatest(factor, a) > disagree),
    )
    reasons = hits(
        (none, "no_scale_detected"),
        (~none & (conf < trust), "low_confidence"),
        (title & has & (F.coalesce("source", F.lit("")) != "") & (F.col("source") != "titleblock"),
         "titleblock_source_mismatch"),
        (title & has & (F.col("dimension_count") >= 3) & (conf < tension), "titleblock_dimension_tension"),
        (has & (factor > 0) & F.coalesce(apart, F.lit(False)), "conflicting_scale_notations"),
    )
    return reports.withColumn("reasons", reasons).withColumn(
        "level", F.when(F.size("reasons") > 0, "warn").otherwise("ok")
    )


def recognition_review(plates: DataFrame, holes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence text for plates with thickness and size; warnings for holes outside plates."""
    evidence = F.when(
        (F.coalesce("thickness_note", F.lit("")) != "") & (F.col("width") != 0) & (F.col("height") != 0),
        F.format_string(
            "Dimensions: %.1f x %.1fmm, thickness=%s", F.col("width"), F.col("height"), "thickness_note"
        ),
    )
    warning = F.when(
        F.col("plate_id").isNull() & (F.col("confidence") > 0.5), "Hole not inside any detected plate"
    )
    return plates.withColumn("evidence", evidence), holes.withColumn("warning", warning)


def non_finite(df: DataFrame, key: str, paths: dict[str, Column]) -> DataFrame:
    """Rows (key, path) of every NaN or infinite number among ``paths``."""
    bad = hits(
        *[(F.isnan(c) | (F.abs(c) == float("inf")), path) for path, c in sorted(paths.items())]
    )
    return df.select(key, F.explode(bad).alias("path"))
