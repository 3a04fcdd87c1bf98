"""Registered queries: each runs one operator over the whole corpus tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ContentClass, RasterBudget, Recognition
from .functions import sql as sql_functions
from .operators import (
    assemble, bom, clusters, delivery, fractions, images, page_rules, reports, rules, shapes,
    style_jobs, text_jobs,
)
from .plans import recognize
from .plans.scale import block_of, dense_position, scratch_folder, written
from .plans.views import Corpus
from .sources import corpus as sources
from .streaming import jobs as streams
from .streaming import stateful

PAGE = ["doc_id", "page"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
    """Register ``fn`` under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Corpus(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every DOUBLE column, and turn negative zero into zero."""
    return df.withColumns(
        {c: F.round(c, digits) + F.lit(0.0) for c, t in df.dtypes if t == "double"}
    )


def joined(df: DataFrame, *cols: str) -> DataFrame:
    """Array columns as comma-separated text, in sorted order."""
    return df.withColumns({c: F.array_join(F.array_sort(c), ",") for c in cols})


# ---- geometry, style, text -------------------------------------------------------------


@query
def assemble_primitives(c):
    return rounded(assemble.assemble_primitives(c.path_ops()))


@query
def place_on_model(c):
    return rounded(style_jobs.page_extents(c.prims(), c.texts(), c.pages(), scale=2.0))


@query
def place_on_model_rotation(c):
    """The same extents from page rotations instead of page matrices."""
    return rounded(style_jobs.page_extents(c.prims(), c.texts(), c.pages(), scale=2.0, form="rotation"))


@query
def uniform_scale(c):
    """Every box, point and size of the corpus at 2.5 times its size."""
    t = style_jobs.rescale_corpus(
        {"primitives": c.prims(), "points": c.points(), "texts": c.texts(), "images": c.images(), "pages": c.pages()}, 2.5
    )
    none = F.lit(None).cast("double")

    def boxes(kind, df, key, x, y, w, h, size=none, area=none):
        cols = {"x": x, "y": y, "w": w, "h": h, "size": size, "area": area}
        return df.select(F.lit(kind).alias("kind"), key.alias("id"), *[v.alias(n) for n, v in cols.items()])

    box = [F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")]
    rows = boxes("primitive", t["primitives"], F.col("prim_id"), F.col("bx0"), F.col("by0"), *box, F.col("line_width"), F.col("area"))
    rows = rows.unionByName(boxes("text", t["texts"], F.col("text_id"), F.col("ix"), F.col("iy"), *box, F.col("font_size")))
    rows = rows.unionByName(boxes("image", t["images"], F.col("ord"), F.col("e"), F.col("f"), F.col("a"), F.col("d")))
    rows = rows.unionByName(boxes("page", t["pages"], F.col("pg"), none, none, F.col("width"), F.col("height")))
    return rounded(rows.unionByName(boxes("point", t["points"], F.col("prim_id"), F.col("x"), F.col("y"), none, none)))


@query
def paint_use(c):
    return style_jobs.paint_use(c.strokes(), c.spans())


@query
def plain_linetypes(c):
    return style_jobs.plain_linetypes(c.strokes())


@query
def run_shape(c):
    return rounded(shapes.run_shape(c.arcs()), 3)


@query
def style_profile(c):
    return rounded(style_jobs.style_profile(c.prims()))


@query
def image_screen(c):
    return rounded(style_jobs.image_screen(c.images(), c.pages(), 200.0))


@query
def text_annotations(c):
    return rounded(text_jobs.text_annotations(c.texts().drop("normalized")))


@query
def dimension_facts(c):
    return rounded(text_jobs.dimension_facts(c.texts()), 6)


@query
def dimension_sql(c):
    """Dimensions by the SQL function: kinds and sums per document."""
    sql_functions.register(c.spark)
    rows = c.spark.sql(
        """SELECT doc_id, d.kind AS kind, confidence_action(d.confidence) AS action, count(*) AS n,
          sum(coalesce(d.value, d.length, d.ratio_den)) AS total, sum(d.width) AS width, sum(d.quantity) AS quantity
        FROM (SELECT doc_id, parse_dimension(text) AS d FROM {texts}) GROUP BY ALL""",
        texts=c.texts(),
    )
    return rounded(rows)


@query
def redaction_report(c):
    return text_jobs.redaction_report(c.table("documents"), 40, 20, 10)


@query
def entity_table(c):
    return rounded(style_jobs.entity_table(c.prims(), c.pages()))


@query
def entity_points(c):
    return rounded(style_jobs.entity_points(c.prims(), c.points(), c.pages()))


@query
def nearest_palette(c):
    return style_jobs.palette_use(c.prims())


# ---- filters and page rules --------------------------------------------------------------


@query
def prune_micro(c):
    return page_rules.prune_stats(c.prims(), 6.0)


@query
def tag_primitives(c):
    tagged = page_rules.tag_primitives(c.prims(), c.pages())
    return joined(tagged.select("prim_id", *PAGE, "tags"), "tags")


@query
def text_cloud_page(c):
    return page_rules.text_cloud_page(page_rules.page_counts(c.prims(), c.texts()), 4, 0.12)


@query
def frame_only_page(c):
    return page_rules.frame_only_page(c.prims(), c.texts(), c.pages(), 45, 12)


@query
def visible_fill(c):
    return shapes.visible_fill(c.points(closed_only=True))


@query
def redundant_page_fill(c):
    return style_jobs.redundant_page_fill(c.prims(), c.pages())


@query
def circle_fit(c):
    return rounded(shapes.fit_residuals(c.arcs()), 3)


def _arc_headers(c):
    return c.arcs().filter("seq = 0").select(
        "prim_id", "closed", "n_points", "pg",
        F.when(F.col("closed"), "closed_loop").otherwise("polyline").alias("type"),
    )


@query
def promote_arcs(c):
    return rounded(shapes.promote_arcs(_arc_headers(c), c.arcs()), 3)


@query
def promote_arcs_loose(c):
    return rounded(shapes.promote_arcs(_arc_headers(c), c.arcs(), variant="loose"), 3)


@query
def find_circles(c):
    explicit = c.prims().filter("type = 'circle'").select(
        (-F.col("prim_id") - 1).alias("prim_id"), "cx", "cy", "radius"
    )
    loops = _arc_headers(c).filter("closed").select("prim_id")
    return rounded(shapes.find_circles(explicit, loops, c.arcs(), 0.25), 3)


def _all_prims(c):
    """Segments and arc polylines as one primitive table; arc ids are negative."""
    arcs = _arc_headers(c).select(
        F.floor(F.col("pg") / 3).cast("long").alias("doc_id"),
        (F.col("pg") % 3 + 1).cast("long").alias("page"),
        (-F.col("prim_id") - 1).alias("prim_id"), "type", "closed",
        F.col("n_points").cast("long").alias("n_points"),
    )
    return c.prims().unionByName(arcs, allowMissingColumns=True)


def _profile(c):
    points = c.arcs().select((-F.col("prim_id") - 1).alias("prim_id"), "seq", "x", "y")
    return page_rules.page_profile(_all_prims(c), c.texts(), c.pages(), points)


@query
def page_profile(c):
    return _profile(c)


# Reduced thresholds, so that the small test pages reach every branch.
SMALL = ContentClass(
    glyph_drawings=40, glyph_fill=0.30, glyph_tiny=0.04, glyph_blocks=5, glyph_words=14,
    glyph_stroke_max=0.86, fill_drawings=30, fill_heavy=0.17, fill_stroke_max=0.83,
    pure_ratio=0.15, pure_stroke_max=0.84, pure_min_groups=12, pure_min_items=70,
    pure_large_rect=0.5, complex_ratio=0.20, complex_stroke_max=0.80, complex_min_items=40,
)


def _classes(c, variant):
    return page_rules.page_content_class(
        c.prims(), c.texts(), c.pages(), SMALL, variant, tiny_side=5.0
    )


@query
def page_content_class(c):
    both = _classes(c, "core").withColumn("variant", F.lit("core")).unionByName(
        _classes(c, "page").withColumn("variant", F.lit("page"))
    )
    return rounded(both)


def _modes(c):
    frames = page_rules.frame_only_page(c.prims(), c.texts(), c.pages(), 45, 12)
    return page_rules.resolve_import_mode(
        _classes(c, "page"), frames, cloud_texts=5, cloud_ratio=0.12
    )


@query
def resolve_import_mode(c):
    suggested = page_rules.suggest_import_mode(_classes(c, "core"), F.col("page") == 2)
    return _modes(c).join(
        suggested.select(*PAGE, "suggested_mode", "suggested_reason"), PAGE
    )


@query
def page_layers(c):
    return page_rules.page_layers(c.prims())


@query
def import_bounds(c):
    return rounded(page_rules.import_bounds(c.prims(), c.texts(), c.pages()))


@query
def framing(c):
    return rounded(page_rules.framing(c.prims(), c.texts(), c.pages()))


@query
def title_block(c):
    return page_rules.title_block(c.texts(), c.pages())


@query
def document_summary(c):
    return page_rules.document_summary(c.pages(), c.prims(), c.texts(), c.images(), _modes(c))


@query
def resolve_scale(c):
    return rounded(text_jobs.resolve_scale(c.texts(), c.pages()))


@query
def doc_scale(c):
    scales = text_jobs.resolve_scale(c.texts(), c.pages())
    return rounded(page_rules.doc_scale(scales, _profile(c)))


@query
def doc_scale_factors(c):
    return rounded(page_rules.doc_scale_factors(text_jobs.resolve_scale(c.texts(), c.pages())))


@query
def corpus_rollup(c):
    return page_rules.corpus_rollup(c.prims(), c.texts())


@query
def page_stack(c):
    out = None
    for how in ("spread", "touch", "compact", "overlay"):
        part = style_jobs.page_stack(c.pages(), how).select(*PAGE, F.lit(how).alias("how"), "dy")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query
def heavy_pages(c):
    counts = page_rules.page_counts(c.prims(), c.texts())
    # the peak of a page: its image placements' pixels, four bytes each
    peaks = c.images().groupBy(*PAGE).agg((F.sum(F.col("px_w") * F.col("px_h")) * 4 / 1048576.0).alias("peak_mb"))
    counts = counts.join(peaks, PAGE, "left")
    return rounded(page_rules.heavy_pages(counts, threshold=40, entity_hint=62, k=25, peak_hint_mb=4.0))


@query
def text_cap(c):
    return text_jobs.text_cap(c.texts(), 2).select("text_id", *PAGE, "text")


@query
def fidelity_diagnostics(c):
    counts = page_rules.page_counts(c.prims(), c.texts()).withColumns(
        {"fallbacks": F.col("n_prims") % 3, "warnings": F.col("n_texts") % 2,
         "glyphs": F.col("n_prims") * 25, "delivered": F.col("n_prims") % 2}
    )
    out = page_rules.fidelity_diagnostics(
        counts, page_rules.page_layers(c.prims()), c.images(), "labels"
    )
    return joined(out, "signals", "actions")


@query
def dpi_budget_fit(c):
    budget = RasterBudget(terminal_job_pixels=200_000_000, terminal_job_tiles=120)
    return page_rules.dpi_budget_fit(c.pages(), 300.0, budget, step=4.0)


# ---- sources ------------------------------------------------------------------------------


@query
def load_corpus(c):
    prims, texts = sources.conform(c.prims(), "primitives"), sources.conform(c.texts(), "texts")
    return page_rules.page_counts(prims, texts)


def _files(c):
    return c.files().withColumn("content", F.encode("body", "UTF-8"))


@query
def file_inventory(c):
    return sources.file_inventory(_files(c))


@query
def precheck_files(c):
    return sources.precheck_files(_files(c))


@query
def page_selection(c):
    spec = F.when(F.col("doc_id") % 3 == 0, "1,3").when(F.col("doc_id") % 3 == 1, "2-3").otherwise("1-2,2")
    loose = F.when(F.col("doc_id") % 4 == 0, "all").when(F.col("doc_id") % 4 == 1, "3-2,x").when(
        F.col("doc_id") % 4 == 2, "first").otherwise("1, 99")
    # a document may lack page 1, and then a selection of page 1 alone would be refused
    docs = c.pages().groupBy("doc_id").agg(F.min("page").cast("string").alias("low"))
    loose = F.when((F.col("low") != "1") & (F.col("doc_id") % 4 >= 1), F.concat(F.lit("x,"), "low")).otherwise(loose)
    pages = c.pages()
    a = sources.page_selection(pages, docs.select("doc_id", spec.alias("spec")))
    b = sources.page_selection(pages, docs.select("doc_id", loose.alias("spec")), strict=False)
    return a.withColumn("how", F.lit("strict")).unionByName(b.withColumn("how", F.lit("tolerant")))


@query
def read_reports(c):
    return sources.parse_reports(c.table("events").select("event_id", "props"), "props")


@query
def read_run_reports(c):
    return sources.parse_reports(c.reports(), "report")


@query
def write_reports(c):
    e = c.table("events").withColumns(
        {
            "elapsed": F.when(F.col("event_id") % 97 == 0, float("nan")).otherwise(F.col("value")),
            "peak": F.when(F.col("event_id") % 89 == 0, float("inf")).otherwise(F.col("value")),
        }
    )
    return sources.report_violations(
        e, "event_id", {"performance.elapsed_ms": F.col("elapsed"), "performance.peak_mb": F.col("peak")}
    )


def _catalog(c):
    name = F.concat(F.lit("W"), (F.col("p_size") % 4 * 2 + 8).cast("string"),
                    F.when(F.col("p_size") % 4 == 1, "x").otherwise("X"), (F.col("p_size") % 2 + 20).cast("string"))
    entry = F.format_string(
        '{"%s": {"family": "W", "d": %d.5, "bf": %d, "tw": 0.25, "tf": 0.375}}', name, F.col("p_size") % 4 * 2 + 8,
        F.col("p_partkey") % 5 + 2,
    )
    return sources.parse_catalog(c.table("part").select(entry.alias("j"), "p_partkey"), "j", "p_partkey")


@query
def load_catalog(c):
    return _catalog(c)


# ---- joins ----------------------------------------------------------------------------------


@query
def dimension_assoc(c):
    dims = recognize.dimension_texts(c.texts()).select(
        *PAGE, "text_id", "ix", "iy", F.col("dim.kind").alias("kind"), F.col("dim.value").alias("value")
    )
    return rounded(clusters.dimension_assoc(dims, c.prims()))


@query
def parallel_pairs(c):
    return rounded(clusters.parallel_degree(clusters.segment_metrics(c.prims())), 6)


@query
def cell_neighbors(c):
    return clusters.cell_neighbors(clusters.occupied_cells(c.prims(), 150.0))


@query
def catalog_lookup(c):
    members = bom.member_intent(c.texts()).select("doc_id", "kind", "key", "count")
    return bom.catalog_lookup(members, "key", _catalog(c))


@query
def manifest_diff(c):
    files = sources.file_inventory(_files(c)).join(c.files().select("path", "file_no"), "path")
    stored = files.filter("file_no % 11 <> 0").select(
        "path", F.when(F.col("file_no") % 13 == 0, "stale").otherwise(F.col("sha256")).alias("sha256")
    )
    ghosts = files.filter("file_no % 17 = 0").select(F.concat("path", F.lit(".old")).alias("path"), "sha256")
    return reports.manifest_diff(files, stored.unionByName(ghosts), files.filter("file_no % 26 = 0"))


def _session(c):
    """Requested pages per session (an order) and the ledger of the pages that are done."""
    a = c.attempts().select(
        F.col("source_id").alias("session"), F.col("ord").alias("page"),
        F.concat(F.lit("s"), F.col("source_id").cast("string")).alias("source_sha"), "requested",
        F.col("handle").alias("digest"), "outcome", "attempted",
    )
    want = a.withColumn("options_sha", F.col("requested"))
    done = want.filter("outcome <> 'failed'").withColumns(
        {
            "options_sha": F.when(F.col("session") % 7 == 0, "other").otherwise(F.col("options_sha")),
            "digest": F.when(F.col("outcome") == "impossible", "stale").otherwise(F.col("digest")),
            "entities": F.col("page") % 5, "delivered": F.col("attempted"),
        }
    )
    return want, done


@query
def pending_pages(c):
    want, done = _session(c)
    return delivery.pending_pages(want, done).select("session", "page")


@query
def resume_summary(c):
    want, done = _session(c)
    return delivery.resume_summary(want.select("session", "page"), done.select("session", "page", "entities", "delivered"))


def _deliveries(c):
    return delivery.representation_ladder(c.attempts())


@query
def representation_ladder(c):
    return _deliveries(c)


@query
def attempt_invariants(c):
    return delivery.attempt_invariants(c.attempts()).select("source_id", "ord", "attempted")


def _expected(c):
    return c.table("orders").filter("o_orderkey % 50 <> 3").select(F.col("o_orderkey").alias("source_id"))


@query
def delivery_reconcile(c):
    sent = _deliveries(c)
    twice = sent.filter("source_id % 31 = 0")
    return delivery.delivery_reconcile(_expected(c), sent.unionByName(twice))


@query
def id_set_checks(c):
    return delivery.id_set_checks(_expected(c), _deliveries(c).filter("verified"))


@query
def delivery_summary(c):
    return delivery.delivery_summary(_deliveries(c), ["doc_id"])


@query
def delivery_failures(c):
    return delivery.delivery_failures(_deliveries(c), ["doc_id"])


@query
def fallback_counts(c):
    return delivery.fallback_counts(_deliveries(c))


@query
def entity_type_rollup(c):
    rest = F.col("source_id") % 3
    own = (
        F.when((F.col("final") == "labels") & (rest > 0), "native_label")
        .when((F.col("final") == "text") & (rest == 1), "native_text")
        .when((F.col("final") == "glyphs") & (rest == 1) & (F.col("doc_id") % 2 == 0), "glyph_curve")
        .when((F.col("final") == "geometry") & (rest == 1) & (F.col("doc_id") % 4 == 0), "geometry_mesh")
        .when((F.col("final") == "geometry") & (rest == 2), "fallback_geometry")
        .when((F.col("final") == "raster") & (rest == 1), "raster_patch")
        .when((F.col("final") == "raster") & (rest == 2), "raster_text_patch")
    )
    return delivery.entity_type_rollup(_deliveries(c).withColumn("bucket", own), ["doc_id"])


@query
def delivery_examples(c):
    return delivery.examples_top3(_deliveries(c), ["doc_id"])


@query
def fallback_transitions(c):
    a = c.attempts().filter("outcome <> 'verified'").select(
        F.col("doc_id").alias("run_id"), F.col("source_id").cast("string").alias("id"),
        F.concat(F.lit(" "), F.upper("requested")).alias("from"), F.col("attempted").alias("to"),
        F.when(F.col("ord") % 4 == 0, "").otherwise(F.col("outcome")).alias("reason"), "ord", "page",
    )
    return delivery.fallback_transitions(
        a.filter("run_id % 3 = 0 and ord % 2 = 0"), a.filter("ord % 2 = 0"), a.filter("ord % 2 = 1 or ord % 3 = 0")
    )


@query
def provenance(c):
    return delivery.provenance(_deliveries(c), c.texts())


@query
def session_manifest(c):
    """One import session per document of the corpus: its file, its pages and the objects it delivered."""
    objects = delivery.provenance(_deliveries(c), c.texts(), ["doc_id"]).withColumnRenamed("doc_id", "session")
    pages = c.pages().groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))
    files = sources.file_inventory(_files(c)).join(c.files().select("path", F.col("file_no").alias("session")), "path")
    known = files.select("session", "path", "sha256").join(pages, F.col("session") == F.col("doc_id"), "left")
    return delivery.session_manifest(objects, known, "sheetlake", "3", "")


@query
def resume_identity(c):
    """Cells of the outcome table as sessions, against a ledger with other sources, other options and gaps."""
    options = ["effective_page_strategy", "requested_representation", "native_peer_count", "has_item_transitions",
               "requested_representation_status"]
    want = c.outcomes().select(F.col("cell_id").alias("session"), F.concat(F.lit("s"), F.col("cell_id").cast("string")).alias("source_sha"), *options)
    k = F.col("session")
    ledger = want.filter(k % 6 != 0).withColumns({
        "source_sha": F.when(k % 15 == 0, "other").otherwise(F.col("source_sha")),
        "native_peer_count": F.when(k % 7 == 0, F.col("native_peer_count") + 1).otherwise(F.col("native_peer_count")),
    })
    return delivery.resume_identity(want, ledger, options)


@query
def counts_delta(c):
    e = c.events().withColumn("n", F.lit(1))
    before, after = e.filter("ord % 2 = 0"), e.filter("ord % 2 = 1")
    return reports.counts_delta(before, after, ["run_id", "stage"])


@query
def raster_compare(c):
    px = c.pixels()
    return rounded(
        reports.raster_compare(px, px.withColumn("asset_id", F.col("asset_id") + 1)), 6
    )


@query
def alpha_class(c):
    return reports.alpha_class(c.pixels())


# ---- aggregations and ranks --------------------------------------------------------------------


@query
def hatch_accept(c):
    return rounded(clusters.hatch_accept(c.prims()))


def _loop_facts(c):
    return assemble.polygon_facts(c.points())


@query
def repeated_patterns(c):
    return clusters.repeated_patterns(_loop_facts(c))


@query
def boundaries(c):
    return clusters.boundaries(_loop_facts(c)).select("prim_id", "area", "bx0", "by0", "bx1", "by1")


@query
def stage_timing(c):
    totals = c.events().groupBy("run_id").agg((F.count(F.lit(1)) * 40.0).alias("total_ms"))
    stages = ("extract_ms", "host_build_ms", "cache_lookup_ms", "cache_store_ms", "other_ms")
    return rounded(reports.stage_timing(c.events(), totals, stages), 3)


@query
def page_progress(c):
    return rounded(reports.page_progress(c.events(), 60.0), 3)


@query
def batch_rollup(c):
    return reports.batch_rollup(c.outcomes(), ["run_id"], 5)


@query
def member_intent(c):
    return rounded(bom.member_intent(c.texts()), 6)


@query
def member_plan(c):
    return rounded(bom.member_plan(bom.member_intent(c.texts()), _catalog(c)), 6)


@query
def corpus_quantiles(c):
    per_run = c.events().groupBy("run_id").agg(
        F.count(F.lit(1)).alias("resolved_objects"), F.sum("ord").alias("decoded_bytes"),
        F.max("ord").alias("operator_tokens"),
    )
    caps = {"resolved_objects": 4096, "decoded_bytes": 16 * 1024 * 1024, "operator_tokens": 1_000_000}
    return rounded(reports.corpus_quantiles(per_run, caps))


@query
def image_dedupe(c):
    return images.image_dedupe(c.images()).select(*PAGE, "xref", "smask", "ord", "px_w", "px_h")


@query
def image_composite(c):
    return images.image_composite(c.images(), c.pages(), threshold=38)


@query
def raster_budget_greedy(c):
    px = c.images().select("doc_id", "ord", (F.col("px_w") * F.col("px_h")).alias("px"))
    return images.raster_budget_greedy(px, 2_000_000)


@query
def font_substitution(c):
    return reports.font_substitution(c.texts())


@query
def set_digest(c):
    files = sources.file_inventory(_files(c)).join(c.files().select("path", "folder"), "path")
    return reports.set_digest(files, ["folder"])


@query
def bom_sequence_rows(c):
    return rounded(bom.bom_sequence_rows(c.texts()))


@query
def bom_line_rows(c):
    sequences = bom.bom_sequence_rows(c.texts()).filter("quantity > 40")
    return rounded(bom.bom_line_rows(c.texts(), sequences))


# ---- clusters -------------------------------------------------------------------------------------


@query
def bbox_adjacent(c):
    return clusters.bbox_adjacent(_cells(c))


def _cells(c):
    """Boxes on a coarse lattice, so that neighbours exist: the first corner of every segment."""
    from .operators.page_rules import table_cells

    moved = c.prims().withColumns(
        {k: F.floor(F.col(k) / 12) for k in ("bx0", "by0", "bx1", "by1")}
    )
    return table_cells(moved).withColumns({k: F.col(k).cast("double") for k in ("bx0", "by0", "bx1", "by1")})


@query
def leader_cluster(c):
    boxes = clusters.box_items(_cells(c), 30.0)
    _, links = clusters.box_clusters(boxes, 30.0)
    return clusters.first_leader(links)


@query
def table_regions(c):
    from .config import Recognition

    return clusters.table_regions(_cells(c), Recognition(table_gap=60.0, table_min_cells=2))


@query
def hatch_groups(c):
    return clusters.hatch_groups(c.prims())


@query
def hatch_policy(c):
    kept = page_rules.hatch_policy(c.prims(), clusters.hatch_groups(c.prims()), "group")
    return page_rules.page_layers(kept)


@query
def regions(c):
    return clusters.regions(c.prims(), c.pages())


def _chars(c):
    t = c.fractions().filter("laid_out")
    return t.select(
        "text_id", "ix", "iy", "font_size", F.posexplode(F.split("text", "")).alias("idx", "ch")
    ).filter("ch <> ''").select(
        "text_id", "idx", "ch", (F.col("ix") + F.col("idx") * F.col("font_size") * 0.5).alias("x"),
        F.col("iy").alias("y"),
    )


@query
def fraction_candidates(c):
    # Each is read by several joins, so it is written once.
    sp = written(fractions.spans(c.fractions(), _chars(c)), "spans")
    found = fractions.fraction_candidates(written(fractions.near_digits(sp), "near"))
    return found.select(*PAGE, "s_ord", "n_ord", "d_ord", "kind", "encoding", "semantic", "bound")


@query
def merge_fractions(c):
    return fractions.merge_fractions(c.fractions(), _chars(c))


# ---- rules ------------------------------------------------------------------------------------------


@query
def outcome_violations(c):
    out = rules.outcome_violations(c.outcomes()).select("cell_id", "violations")
    return joined(out, "violations")


@query
def cell_status(c):
    return rules.cell_status(c.outcomes()).groupBy("run_id", "status", "completion").agg(
        F.count(F.lit(1)).alias("n")
    )


def _profiles(c):
    o = F.col("cell_id")
    return c.outcomes().select(
        "cell_id",
        F.when(o % 37 == 0, "old").otherwise("semantics/2.0").alias("schema"),
        F.when(o % 19 == 0, "closed_world").when(o % 43 == 0, "guess").otherwise("feature_detection").alias("accounting_mode"),
        (o % 31 == 0).alias("closed_world"),
        F.when(o % 29 == 0, "complete").when(o % 2 == 0, "partial").otherwise("incomplete").alias("scan_status"),
        F.when(o % 23 == 0, "weird").otherwise("source_profile_partial").alias("status_code"),
        F.when(o % 5 == 0, F.array(F.lit("pdf_fill_alpha"), F.lit("pdf_text_clip")))
        .when(o % 5 == 1, F.array(F.lit("pdf_text_clip"), F.lit("pdf_fill_alpha")))
        .when(o % 5 == 2, F.array(F.lit("pdf_unknown"))).otherwise(F.array().cast("array<string>")).alias("feature_codes"),
        (o % 6000).alias("resolved_objects"), (o * 4001).alias("decoded_bytes"),
        F.col("o_totalprice").cast("long").alias("operator_tokens"), (o % 2100).alias("annotation_entries"),
    )


@query
def source_profile_check(c):
    out = rules.source_profile_check(_profiles(c), "semantics/2.0")
    return joined(out.select("cell_id", "faults", "native_eligible"), "faults")


@query
def limit_breaches(c):
    caps = {**rules.CAPS, "operator_tokens": 250_000}
    out = rules.limit_breaches(_profiles(c), caps)
    return joined(out.select("cell_id", "breaches", "scan_status", "status_code"), "breaches")


@query
def contract_ready(c):
    o = F.col("cell_id")
    rep = c.outcomes().select(
        "cell_id", F.when(o % 9 > 0, "build").otherwise(" ").alias("build_stamp"),
        F.when(o % 4 == 0, "ok").when(o % 4 == 1, "warn").when(o % 16 == 2, "bad").otherwise("ok").alias("crosscheck_level"),
        F.col("entities").alias("text_entities"), (o % 7 > 0).alias("has_entity_types"),
        F.when(o % 6 == 0, "Failed").when(o % 6 == 1, F.lit(None)).otherwise("success").alias("status"),
        F.when(F.col("crashed"), "crash").alias("terminal_failure"), F.when(o % 41 == 0, "empty_file").alias("open_failure"),
        (o % 5 > 0).alias("import_text"), (o % 3).alias("text_source_spans"),
        (o % 8 > 0).alias("delivery_required"), (o % 10 < 7).alias("delivery_verified"),
    )
    checks = ("build_stamp", "scale_crosscheck", "actual_text_entity_types", "text_delivery", "result_succeeded",
              "no_terminal_failure", "no_open_failure", "ready")
    return rules.contract_ready(rep).groupBy(*checks).agg(F.count(F.lit(1)).alias("n"))


@query
def scale_crosscheck(c):
    page = text_jobs.resolve_scale(c.texts(), c.pages())
    doc = page_rules.doc_scale(page, _profile(c))
    dims = c.texts().filter(
        text_jobs.tx.tag_flag("dimension_like", F.col("text"), F.col("normalized"))
    ).groupBy("doc_id").agg(F.count(F.lit(1)).alias("dimension_count"))
    rep = doc.join(dims, "doc_id", "left").fillna(0, ["dimension_count"]).withColumns(
        {"alternates": F.array("min_factor", "max_factor"), "fallback_reason": F.lit(""),
         "title_block": F.col("doc_id") % 2 == 0}
    )
    return joined(rules.scale_crosscheck(rep).select("doc_id", "level", "reasons"), "reasons")


@query
def recognition_review(c):
    plates = _loop_facts(c).filter("closed").select(
        "prim_id", F.when(F.col("prim_id") % 3 == 0, "1/2").alias("thickness_note"),
        (F.col("bx1") - F.col("bx0")).alias("width"), (F.col("by1") - F.col("by0")).alias("height"),
    )
    holes = c.prims().filter("type = 'circle'").select(
        "prim_id", F.when(F.col("prim_id") % 2 == 0, F.lit(1)).alias("plate_id"),
        (F.col("prim_id") % 10 / 10.0).alias("confidence"),
    )
    p, h = rules.recognition_review(plates, holes)
    return p.select("prim_id", F.lit("plate").alias("kind"), F.col("evidence").alias("note")).unionByName(
        h.select("prim_id", F.lit("hole").alias("kind"), F.col("warning").alias("note"))
    ).filter("note is not null")


def _recognized(c, cfg):
    return recognize.recognize_pages(
        _all_prims(c), c.arcs().select((-F.col("prim_id") - 1).alias("prim_id"), "seq", "x", "y"),
        _loop_facts(c), c.texts(), c.pages(), cfg,
    )


@query
def recognize_page_totals(c):
    """Totals per page over the parts of the composite plan that are keyed by page."""
    parts = _recognized(c, Recognition())
    profile = parts["profile"].select(*PAGE, "mode_used")
    blocks = parts["title_blocks"].select(*PAGE, F.lit(1).alias("title_block"))
    dims = parts["dimensions"].groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("dims"), F.count("nearest_prim_id").alias("linked")
    )
    return profile.join(blocks, PAGE, "left").join(dims, PAGE, "left").fillna(
        0, ["title_block", "dims", "linked"]
    )


@query
def recognize_pages(c):
    """All eight parts of the composite plan: one row per page and part."""
    cfg = Recognition(circle_fit_tol=0.25, table_gap=60.0, table_min_cells=2)
    return recognize.part_rows(_recognized(c, cfg), _all_prims(c))


# ---- streaming jobs over the whole table ------------------------------------------


@query
def stream_stage_timing(c):
    return rounded(streams.stream_stage_timing(c.events(), "1 hour"), 3)


@query
def stream_stage_timing_sliding(c):
    return rounded(streams.stream_stage_timing(c.events(), "2 hours", "1 hour"), 3)


@query
def stream_sessions(c):
    return rounded(streams.stream_sessions(c.events(), "6 hours"), 3)


@query
def over_budget_totals(c):
    return rounded(streams.over_budget_totals(c.events(), 3200.0), 3)


@query
def stream_over_budget(c):
    """The stream over three landings of the events, started anew for each; what its sink holds."""
    folder = scratch_folder(c.spark, "budget")
    events = c.events().withColumn("ts", F.col("ts").cast("timestamp"))
    lo, hi = events.agg(F.min("ts"), F.max("ts")).select(F.unix_micros("min(ts)"), F.unix_micros("max(ts)")).first()
    part = F.least(F.lit(2), F.floor((F.unix_micros("ts") - F.lit(lo or 0)) * 3 / F.lit(max((hi or 0) - (lo or 0), 1))))
    for k in range(3):
        events.filter(part == k).write.mode("append").parquet(f"{folder}/in")
        landed = c.spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        over = stateful.stream_over_budget(landed, 400.0, "12 hours")
        stateful.finish(stateful.written(over, f"{folder}/out", f"{folder}/checkpoint"))
    return rounded(c.spark.read.parquet(f"{folder}/out"), 3).drop("batch")


@query
def stream_pages(c):
    """The stream over the landed page table, a few files a batch; what its sink holds."""
    folder = scratch_folder(c.spark, "pages")
    prims = sources.conform(c.prims(), "primitives")
    prims.write.option("maxRecordsPerFile", 1_000_000).parquet(f"{folder}/in")
    sizes = c.spark.read.parquet(f"{folder}/in").groupBy(*PAGE).agg(F.count(F.lit(1)).alias("rows"))
    asked = dense_position(sizes, ["doc_id"], ["page"], [block_of("page")], "position")
    asked.withColumn("position", F.col("position") + 1).write.parquet(f"{folder}/requests")
    landed = streams.page_stream(c.spark, f"{folder}/in", sources.SCHEMAS["primitives"], 4)
    micro = F.coalesce(page_rules.is_micro(4.5), F.lit(False))
    pages = stateful.stream_pages_in_order(
        landed, c.spark.read.parquet(f"{folder}/requests"), {"kept": ~micro, "removed": micro}
    )
    stateful.finish(stateful.written(pages, f"{folder}/out", f"{folder}/checkpoint"))
    return c.spark.read.parquet(f"{folder}/out").drop("batch")


@query
def stream_resume(c):
    """The ledger job over all sessions, twice: pages asked, certified by the first and by the second run."""
    folder = scratch_folder(c.spark, "resume")
    want, done = _session(c)
    land = want.select("session", *stateful.KEYS)
    land.write.option("compression", "zstd").parquet(f"{folder}/in")
    stateful.seed_ledger(done, f"{folder}/ledger")
    for run in ("first", "second"):
        landed = c.spark.readStream.schema(land.schema).parquet(f"{folder}/in").drop("session")
        stateful.finish(stateful.stream_ledger(landed, f"{folder}/ledger", f"{folder}/checkpoint-{run}", run))
    # Counted per source before sessions meet them, so that counts move and not pages.
    certified = stateful.read_pages_done(c.spark, f"{folder}/ledger").filter("run <> 'seed'").groupBy("source_sha").agg(
        F.count(F.when(F.col("run") == "first", 1)).alias("pending"), F.count(F.when(F.col("run") == "second", 1)).alias("again")
    )
    asked = c.spark.read.schema(land.schema).parquet(f"{folder}/in").groupBy("session", "source_sha").agg(F.count(F.lit(1)).alias("asked"))
    counts = asked.join(certified, "source_sha", "left").groupBy("session").agg(
        *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("asked", "pending", "again")]
    )
    return counts.withColumn(
        "resumed", F.col("asked") - F.col("pending")
    )
