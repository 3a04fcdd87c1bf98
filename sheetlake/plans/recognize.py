"""The composite page recognition plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Recognition
from ..functions import text as tx
from ..operators import clusters, page_rules, shapes, text_jobs
from .scale import keep_when

PAGE = ["doc_id", "page"]


def dimension_texts(texts: DataFrame, cfg: Recognition = Recognition()) -> DataFrame:
    """Texts that look like and parse as a dimension of sufficient confidence."""
    tagged = texts.filter(tx.tag_flag("dimension_like", F.col("text"), F.col("normalized")))
    d = tx.with_dimension(tagged, F.col("text"), "dim")
    has = F.coalesce("dim.value", "dim.width", "dim.ratio_num").isNotNull()
    return keep_when(d, has & (F.col("dim.confidence") >= cfg.min_dimension_confidence))


class Parts(Mapping):
    """Parts by name, each planned when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]) -> None:
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def recognize_pages(
    prims: DataFrame, points: DataFrame, loop_facts: DataFrame, texts: DataFrame, pages: DataFrame,
    cfg: Recognition = Recognition(), mode: str = "auto",
) -> Mapping[str, DataFrame]:
    """Profile, circles, boundaries, patterns, tables, title blocks and dimension links.

    ``loop_facts``: prim_id, type, closed, n_points, area of point-based primitives.  Nothing
    runs until a part is used; mode ``none`` returns no parts.
    """
    if mode == "none":
        return {}
    used = F.col("primary_type") if mode == "auto" else F.lit(mode)
    explicit = prims.filter("type = 'circle'").select("prim_id", "cx", "cy", "radius")
    loops = prims.filter("type = 'closed_loop' and n_points >= 6").select("prim_id")
    return Parts({
        "profile": lambda: page_rules.page_profile(prims, texts, pages, points).withColumn("mode_used", used),
        "circles": lambda: shapes.find_circles(explicit, loops, points, cfg.circle_fit_tol),
        "boundaries": lambda: clusters.boundaries(loop_facts, cfg.closed_loop_min_area),
        "patterns": lambda: clusters.repeated_patterns(loop_facts),
        "tables": lambda: clusters.table_regions(prims, cfg),
        "title_blocks": lambda: page_rules.title_block(texts, pages),
        "dimensions": lambda: clusters.dimension_assoc(dimension_texts(texts, cfg), prims, cfg.dimension_assoc_radius),
        "text_tags": lambda: text_jobs.classify_text(texts),
    })


def part_rows(parts: Mapping[str, DataFrame], prims: DataFrame) -> DataFrame:
    """One row per page and part that found something there: doc_id, page, part, items, note.

    ``note``: the mode of the profile, and how many dimensions are linked to a primitive.  Parts keyed by
    primitive are folded together before they meet the primitives' pages, so these are joined once.
    """
    none = F.lit(None).cast("string")
    one = F.lit(1).cast("long")
    by_prim = None
    for part in ("circles", "boundaries", "patterns"):
        rows = parts[part].select("prim_id", F.lit(part).alias("part"))
        by_prim = rows if by_prim is None else by_prim.unionByName(rows)
    found = [
        by_prim.join(prims.select("prim_id", *PAGE), "prim_id").groupBy(*PAGE, "part").agg(F.count(F.lit(1)).alias("items"))
        .withColumn("note", none),
        parts["profile"].select(*PAGE, F.lit("profile").alias("part"), one.alias("items"), F.col("mode_used").alias("note")),
        parts["title_blocks"].select(*PAGE, F.lit("title_blocks").alias("part"), one.alias("items"), none.alias("note")),
        parts["tables"].groupBy(*PAGE).agg(F.count(F.lit(1)).alias("items")).select(
            *PAGE, F.lit("tables").alias("part"), "items", none.alias("note")
        ),
        parts["dimensions"].groupBy(*PAGE).agg(
            F.count(F.lit(1)).alias("items"), F.count("nearest_prim_id").cast("string").alias("note")
        ).select(*PAGE, F.lit("dimensions").alias("part"), "items", "note"),
        parts["text_tags"].filter(F.size("tags") > 0).groupBy(*PAGE).agg(F.count(F.lit(1)).alias("items")).select(
            *PAGE, F.lit("text_tags").alias("part"), "items", none.alias("note")
        ),
    ]
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out
