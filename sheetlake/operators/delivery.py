"""Delivery records: ladders, reconciliation, roll-ups, fallback ledgers, resume state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .reports import set_digest

# Rungs tried for each requested representation, and entity type of each bucket.
LADDERS = {
    "text": ("text", "glyphs", "geometry"),
    "labels": ("labels", "text", "glyphs", "geometry"),
    "glyphs": ("glyphs", "geometry", "text"),
    "geometry": ("geometry", "glyphs", "text"),
    "3d_text": ("3d_text", "text", "glyphs", "geometry"),
    "raster": ("raster",),
}
BUCKET_TYPES = {
    "native_label": "labels", "native_text": "text", "native_3d_text": "3d_text",
    "glyph_curve": "glyphs", "geometry_mesh": "geometry", "raster_patch": "raster",
    "outline_curve_or_mesh": "glyphs", "raw_geometry_edges": "geometry",
    "raster_text_patch": "raster", "dxf_text": "text", "raster_image": "raster",
    "fallback_geometry": "geometry",
}
DELIVERED_BUCKET = {
    "3d_text": "native_3d_text", "text": "dxf_text", "labels": "dxf_text",
    "glyphs": "outline_curve_or_mesh", "geometry": "raw_geometry_edges", "raster": "raster_image",
}


def lookup(table: dict, key: Column) -> Column:
    """A fixed mapping as one CASE expression."""
    items = list(table.items())
    out = F.when(key == items[0][0], items[0][1])
    for k, v in items[1:]:
        out = out.when(key == k, v)
    return out


def rung_of(requested: Column, attempted: Column) -> Column:
    """Position of an attempt on its ladder, null when it is not on it."""
    out = None
    for want, rungs in LADDERS.items():
        for i, rung in enumerate(rungs):
            test = (requested == want) & (attempted == rung)
            out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return out


def proofs() -> Column:
    return (
        F.col("type_verified") & F.col("delivery_verified")
        & F.col("visual_verified") & F.col("cleanup_verified")
    )


def attempt_invariants(attempts: DataFrame) -> DataFrame:
    """Attempts that claim to be verified without all four proofs."""
    return attempts.filter((F.col("outcome") == "verified") & ~proofs())


def representation_ladder(attempts: DataFrame) -> DataFrame:
    """Final representation of every item.

    Rungs are tried in order: the first verified attempt wins, provided every attempt on a
    lower rung proved its representation impossible.  An item all of whose rungs were tried and
    proved impossible, or that asked for a raster, is handed to the terminal raster; a verified
    raster attempt delivers it.  Anything else fails.
    """
    a = attempts.withColumn("rung", rung_of(F.col("requested"), F.col("attempted"))).withColumn(
        "rank", F.struct("rung", "ord")
    )
    on = F.col("rung").isNotNull()
    won = on & (F.col("outcome") == "verified")
    stop = on & (F.col("outcome") == "failed")
    drawn = (F.col("attempted") == "raster") & (F.col("outcome") == "verified")
    folded = a.groupBy("source_id", "doc_id", "page", "requested").agg(
        F.min(F.when(won, F.col("rank"))).alias("_won"),
        F.min_by(F.when(won, F.col("attempted")), F.when(won, F.col("rank"))).alias("_final"),
        F.min(F.when(stop, F.col("rung"))).alias("_stop"),
        F.min_by(F.when(won, F.col("handle")), F.when(won, F.col("rank"))).alias("_handle"),
        F.bit_or(F.when(on, F.pow(F.lit(2), F.col("rung")).cast("long"))).alias("_tried"),
        F.bool_or(drawn).alias("_drawn"),
        F.min_by(F.when(drawn, F.col("handle")), F.when(drawn, F.col("ord"))).alias("_raster"),
        F.count(F.when(on, 1)).alias("attempts"),
    )
    rungs = lookup({want: len(r) for want, r in LADDERS.items()}, F.col("requested"))
    asked = F.col("requested") == "raster"
    ladder_won = ~asked & F.col("_won").isNotNull() & (
        F.col("_stop").isNull() | (F.col("_stop") >= F.col("_won.rung"))
    )
    terminal = asked | (
        F.col("_won").isNull() & F.col("_stop").isNull()
        & (F.bit_count(F.coalesce("_tried", F.lit(0))) == rungs)
    )
    final = F.when(ladder_won, F.col("_final")).when(terminal, "raster")
    raster_done = terminal & F.coalesce("_drawn", F.lit(False))
    return folded.select(
        "source_id", "doc_id", "page", "requested", final.alias("final"),
        (ladder_won | raster_done).alias("verified"), terminal.alias("terminal"),
        F.coalesce(final != F.col("requested"), F.lit(False)).alias("fallback_used"),
        F.when(ladder_won, F.col("_handle")).when(raster_done, F.col("_raster")).alias("handle"),
        "attempts",
    )


def delivery_reconcile(expected: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Problems between expected and delivered items, one row per item and problem.

    ``expected``: source_id.  ``deliveries``: source_id, handle, verified, final.
    """
    per_item = deliveries.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("verified") & F.col("final").isNotNull()).alias("ok"),
    )
    shared = (
        deliveries.filter("handle is not null").groupBy("handle")
        .agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")
    )
    # The few handles used twice meet the deliveries, not the other way round.
    clash = deliveries.join(shared, "handle", "left_semi").select("source_id").distinct()
    both = expected.select("source_id", F.lit(True).alias("_e")).join(
        per_item.join(clash.withColumn("_c", F.lit(True)), "source_id", "left"), "source_id", "full_outer"
    )
    problems = F.array(
        F.when(F.col("n").isNull(), "missing"), F.when(F.col("_e").isNull(), "unexpected"),
        F.when(F.col("n") > 1, "duplicate_id"), F.when(F.col("_c"), "duplicate_handle"),
        F.when(~F.col("ok"), "not_verified"),
    )
    return both.select(
        "source_id", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem")
    )


def id_set_checks(expected: DataFrame, delivered: DataFrame) -> DataFrame:
    """Set difference both ways and the intersection of two id columns."""
    e, d = expected.select("source_id"), delivered.select("source_id")
    parts = [
        (e.subtract(d), "missing"), (d.subtract(e), "extra"), (e.intersect(d), "common"),
    ]
    out = None
    for df, name in parts:
        df = df.withColumn("status", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def delivery_summary(deliveries: DataFrame, keys: list[str]) -> DataFrame:
    """Per run: the one delivered type or mixed/none, fallbacks, entities, failures."""
    final = F.col("final")
    failed = ~F.col("verified") | final.isNull()
    return deliveries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"),
        F.min(final).alias("_lo"), F.max(final).alias("_hi"),
        F.count(F.when(F.col("fallback_used"), 1)).alias("fallbacks"),
        F.count("handle").alias("entities"),
        F.count(F.when(failed, 1)).alias("failed"),
    ).withColumn(
        "delivered",
        F.when(F.col("_lo").isNull(), "none").when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
        .otherwise("mixed"),
    ).withColumn("all_verified", F.col("failed") == 0).drop("_lo", "_hi")


def delivery_failures(deliveries: DataFrame, keys: list[str]) -> DataFrame:
    """Every item that was not delivered: a row per id beside the counts of ``delivery_summary``."""
    failed = ~F.col("verified") | F.col("final").isNull()
    return deliveries.filter(failed).select(*keys, "source_id", "requested", "final")


def fallback_reason() -> Column:
    return (
        F.when(F.col("final") == "raster", "structural_representations_failed_verification")
        .when(F.col("requested").isin("glyphs", "geometry", "outlines"), "text2path_failed")
        .otherwise("requested_representation_failed_verification")
    )


def fallback_counts(deliveries: DataFrame) -> DataFrame:
    """Substitutions by requested type, delivered type and reason."""
    return deliveries.filter("fallback_used").groupBy(
        "requested", F.col("final").alias("delivered"), fallback_reason().alias("reason")
    ).agg(F.count(F.lit(1)).alias("n"))


def entity_type_rollup(deliveries: DataFrame, keys: list[str]) -> DataFrame:
    """Delivered buckets per run and the entity type they amount to.

    A delivery may name its ``bucket``; the others count in the one of their representation.
    The outline bucket aggregates glyph curves and meshes; where those are counted on their
    own it is not added again.
    """
    usual = lookup(DELIVERED_BUCKET, F.col("final"))
    named = F.coalesce("bucket", usual) if "bucket" in deliveries.columns else usual
    b = deliveries.filter("verified").withColumn("bucket", named)
    counted = b.groupBy(*keys).pivot("bucket", sorted(BUCKET_TYPES)).agg(F.count(F.lit(1))).fillna(0)
    split = (F.col("glyph_curve") > 0) | (F.col("geometry_mesh") > 0)
    weight = {
        k: F.when(split, F.lit(0)).otherwise(F.col(k)) if k == "outline_curve_or_mesh" else F.col(k)
        for k in sorted(BUCKET_TYPES)
    }
    total = sum(weight.values(), F.lit(0))
    types = F.array_distinct(
        F.filter(
            F.array(*[F.when(F.col(k) > 0, BUCKET_TYPES[k]) for k in sorted(BUCKET_TYPES)]),
            lambda t: t.isNotNull(),
        )
    )
    drawn = F.array("native_label", "native_text", "native_3d_text", "dxf_text")
    return counted.select(
        *keys, *[F.col(k) for k in BUCKET_TYPES],
        total.alias("total"),
        F.when(F.size(types) == 0, "none").when(F.size(types) == 1, F.get(types, F.lit(0)))
        .otherwise("mixed").alias("entity_type"),
        F.exists(drawn, lambda n: n > 0).alias("font_rendered"),
    )


def examples_top3(deliveries: DataFrame, keys: list[str]) -> DataFrame:
    """First three delivered items per type; the rank filter runs before the exchange too."""
    w = Window.partitionBy(*keys, "final").orderBy("source_id")
    return (
        deliveries.filter("verified").withColumn("rank", F.row_number().over(w)).filter("rank <= 3")
        .select(*keys, "final", F.col("rank").cast("long").alias("rank"), "source_id")
    )


def fallback_transitions(ledger: DataFrame, events: DataFrame, items: DataFrame) -> DataFrame:
    """Certified changes of representation, first occurrence of each.

    ``ledger``, ``events`` and ``items`` share run_id, id, from, to, reason, ord.  A run that
    has a ledger uses only that; other runs unite what their events and items tell.
    """
    told = events.withColumn("src", F.lit(1)).unionByName(items.withColumn("src", F.lit(2)))
    owners = ledger.select("run_id").distinct()
    rest = told.join(owners, "run_id", "left_anti")
    rows = ledger.withColumn("src", F.lit(0)).unionByName(rest).select(
        "run_id", F.trim("id").alias("id"), F.lower(F.trim("from")).alias("from"),
        F.lower(F.trim("to")).alias("to"), F.trim("reason").alias("reason"), "src", "ord", "page",
    )
    valid = rows.filter("id <> '' and from <> '' and to <> '' and from <> to and reason <> ''")
    return valid.groupBy("run_id", "id", "from", "to", "reason").agg(
        F.min_by("page", F.struct("src", "ord")).alias("page"),
        F.min_by("src", F.struct("src", "ord")).cast("long").alias("origin"),
    )


def pending_pages(requested: DataFrame, ledger: DataFrame) -> DataFrame:
    """Requested pages without a completed record of the same identity and digest.

    ``requested``: source_sha, options_sha, page, digest.  ``ledger``: the same columns.
    """
    keys = ["source_sha", "options_sha", "page", "digest"]
    return requested.join(ledger.select(*keys).distinct(), keys, "left_anti")


def identity_mismatch(requested: DataFrame, ledger: DataFrame) -> DataFrame:
    """Sessions in the ledger whose source or options differ from the request."""
    want = requested.select("session", "source_sha", "options_sha").distinct()
    have = ledger.select(
        "session", F.col("source_sha").alias("h_source"), F.col("options_sha").alias("h_options")
    ).distinct()
    return want.join(have, "session").filter(
        (F.col("source_sha") != F.col("h_source")) | (F.col("options_sha") != F.col("h_options"))
    ).select(
        "session",
        F.when(F.col("source_sha") != F.col("h_source"), "source").otherwise("options").alias("differs"),
    )


def resume_summary(requested: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per session: pages asked and certified, result, totals, one delivered mode or mixed."""
    done = requested.join(ledger, ["session", "page"], "left")
    return done.groupBy("session").agg(
        F.count(F.lit(1)).alias("pages_requested"),
        F.count("entities").alias("pages_certified"),
        F.coalesce(F.sum("entities"), F.lit(0)).alias("entities"),
        F.min("delivered").alias("_lo"), F.max("delivered").alias("_hi"),
    ).select(
        "session", "pages_requested", "pages_certified", "entities",
        F.when(F.col("pages_requested") == F.col("pages_certified"), "complete")
        .otherwise("cancelled").alias("result"),
        F.when(F.col("_lo").isNull(), "none").when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
        .otherwise("mixed").alias("delivered"),
    )


def resume_identity(requested: DataFrame, ledger: DataFrame, options: list[str], refuse: bool = False) -> DataFrame:
    """Per requested session: the digest of its options, and how it stands to the ledger.

    ``requested``, ``ledger``: session, source_sha and the option columns.  Status: ``new`` (not in the ledger), ``same``,
    ``source`` (other source bytes) or ``options``.  A session with several rows in the ledger must agree with all.
    ``refuse``: a session that disagrees fails the job.
    """
    def identity(df: DataFrame) -> DataFrame:
        return df.select("session", "source_sha", options_digest(options).alias("options_sha")).distinct()

    have = identity(ledger).select(
        "session", F.col("source_sha").alias("_source"), F.col("options_sha").alias("_options")
    )
    found = identity(requested).join(have, "session", "left").groupBy("session", "source_sha", "options_sha").agg(
        F.count("_source").alias("_n"),
        F.bool_or(F.col("source_sha") != F.col("_source")).alias("_s"),
        F.bool_or(F.col("options_sha") != F.col("_options")).alias("_o"),
    )
    status = F.when(F.col("_n") == 0, "new").when(F.col("_s"), "source").when(F.col("_o"), "options").otherwise("same")
    if refuse:
        fail = F.raise_error(F.concat(F.lit("resume session "), F.col("session").cast("string"), F.lit(" uses different "), status))
        status = F.when(F.col("_s") | F.col("_o"), fail.cast("string")).otherwise(status)
    return found.select("session", "source_sha", "options_sha", status.alias("status"))


def options_digest(options: list[str]) -> Column:
    """SHA-256 of an options record as JSON with sorted keys; absent options count as null."""
    record = F.to_json(F.struct(*[F.col(c) for c in sorted(options)]), {"ignoreNullFields": "false"})
    return F.sha2(record, 256)


def provenance(deliveries: DataFrame, texts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per delivered entity of a text item: ids, boxes, modes, fallback reason.

    ``keys``: columns of ``texts`` that are put in front, such as the document.
    """
    made = deliveries.filter("verified and handle is not null")
    t = texts.select(
        F.col("text_id").alias("source_id"), F.col("page").alias("text_page"),
        "bx0", "by0", "bx1", "by1", *[F.col(k).alias(f"_key_{k}") for k in keys],
    )
    return made.join(t, "source_id").select(
        *[F.col(f"_key_{k}").alias(k) for k in keys],
        F.concat_ws(":", F.lit("text_span"), F.col("text_page").cast("string"),
                    F.col("source_id").cast("string"), F.lit("entity"), "handle").alias("object_id"),
        F.col("text_page").alias("page"), F.lit("text_span").alias("source_kind"),
        lookup(DELIVERED_BUCKET, F.col("final")).alias("created_entity_type"),
        F.col("handle").alias("parent_handle"),
        "bx0", "by0", "bx1", "by1", F.col("requested").alias("selected_text_mode"),
        F.when(F.col("fallback_used"), fallback_reason()).otherwise("").alias("fallback_reason"),
        F.col("source_id").alias("span_id"),
    )


MANIFEST_SCHEMA = "source_provenance/1.0"
OBJECT_FIELDS = ("page", "source_kind", "created_entity_type", "parent_handle", "selected_text_mode", "fallback_reason")


def session_manifest(
    objects: DataFrame, sources: DataFrame, name: str, version: str = "", build: str = ""
) -> DataFrame:
    """One row per import session: importer, source file, pages, and its provenance objects as counts and one digest.

    ``objects``: session and the columns of ``provenance``; ``sources``: session, path, sha256, page_count (null or
    below 1: unknown).  The digest combines the objects in any order, so no session is collected; sessions without
    objects have zero counts and a null digest.
    """
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in OBJECT_FIELDS]
    lines = objects.select("session", F.col("object_id").alias("path"), F.sha2(F.concat_ws("|", *texts), 256).alias("sha256"))
    digest = set_digest(lines, ["session"]).select("session", F.col("sha256").alias("objects_sha256"))
    counts = provenance_manifest(objects, ["session"]).groupBy("session").agg(
        F.sum("objects").alias("objects"), F.sum("fallbacks").alias("fallbacks"), F.count(F.lit(1)).alias("entity_types")
    )
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("objects", "fallbacks", "entity_types")}
    return sources.join(counts.join(digest, "session"), "session", "left").select(
        F.lit(MANIFEST_SCHEMA).alias("schema"), "session",
        *[F.lit(v or None).cast("string").alias(c) for c, v in
          (("importer_name", name), ("importer_version", version), ("importer_build", build))],
        F.col("path").alias("source_path"), F.col("sha256").alias("source_sha256"),
        F.when(F.col("page_count") > 0, F.col("page_count")).alias("page_count"),
        *zero.values(), "objects_sha256",
    )


def provenance_manifest(objects: DataFrame, keys: list[str]) -> DataFrame:
    """Roll-up of provenance rows per session: objects, fallbacks, entity types."""
    return objects.groupBy(*keys, "created_entity_type").agg(
        F.count(F.lit(1)).alias("objects"),
        F.count(F.when(F.col("fallback_reason") != "", 1)).alias("fallbacks"),
    )
