"""Image placements: de-duplication, page composites, document raster budgets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..plans.groups import Columns, scan_groups

PAGE = ["doc_id", "page"]


def image_dedupe(images: DataFrame) -> DataFrame:
    """First placement of every (xref, smask) per page, by source order.

    The first row is found by a combinable minimum; no group is sorted.
    """
    keys = [*PAGE, "xref", "smask"]
    rest = [c for c in images.columns if c not in keys]
    return images.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("s")).select(*keys, "s.*")


def image_composite(images: DataFrame, pages: DataFrame, threshold: int = 256) -> DataFrame:
    """Pages with too many placements, or an inline one that is not upright, become one row.

    Placed images (kind xobject_image) fold by count alone; inline images also fold when one of
    them is sheared or flipped.  The replacement row is page-sized and counts its sources.
    """
    upright = g.is_rectilinear(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    inline = F.col("kind") == "inline_image"
    stats = images.groupBy(*PAGE, "kind").agg(
        F.count(F.lit(1)).alias("n"), F.max((inline & ~upright).cast("int")).alias("skewed")
    ).withColumn("folds", (F.col("n") > threshold) | (F.col("skewed") == 1))
    kept = images.join(stats.filter(~F.col("folds")).select(*PAGE, "kind"), [*PAGE, "kind"], "left_semi")
    folded = stats.filter("folds").join(pages.select(*PAGE, "width", "height"), PAGE)
    page_rows = folded.select(
        *PAGE, F.concat("kind", F.lit("_page_fidelity_required")).alias("kind"),
        F.lit(None).cast("long").alias("ord"),
        F.col("width").alias("a"), F.col("height").alias("d"), F.col("n").alias("instances"),
    )
    return kept.select(*PAGE, "kind", "ord", "a", "d", F.lit(1).cast("long").alias("instances")).unionByName(page_rows)


def admit(room: int, px: np.ndarray) -> tuple[np.ndarray, int]:
    """Which of some rasters, in order, fit the room that is left, and what is left after them.

    Rasters larger than the room are out at once, for room only shrinks; of the others all up to
    the first that doesn't fit come in together.
    """
    fits = np.zeros(len(px), bool)
    open_ = np.flatnonzero(px <= room)
    while len(open_):
        total = np.cumsum(px[open_])
        k = int(np.searchsorted(total, room, "right"))
        fits[open_[:k]] = True
        room -= int(total[k - 1])
        open_ = open_[k + 1 :]
        open_ = open_[px[open_] <= room]
    return fits, room


def raster_budget_greedy(rasters: DataFrame, budget: int) -> DataFrame:
    """Admit rasters of a document in order while they fit; a rejected one uses no budget.

    ``rasters``: doc_id, ord, px (not negative).  A plain running sum is wrong, since the rejected do not count.  Each
    decision needs the room that all before it left, so a document's rasters, three numbers each, stream through one
    task in order; the room is all that is kept, and a stretch is decided in a few vector steps.
    """

    def step(room: int, rows: Columns) -> tuple[int, Columns]:
        fits, room = admit(room, rows["px"])
        return room, rows | {"admitted": fits}

    rows = rasters.select(*[F.col(c).cast("bigint").alias(c) for c in ("doc_id", "ord", "px")]).filter("px is not null")
    return scan_groups(rows, ["doc_id"], ["ord"], lambda: budget, step, "doc_id bigint, ord bigint, px bigint, admitted boolean")
