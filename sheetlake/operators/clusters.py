"""Clustering without pair lists: leader clusters, hatch groups, tables, regions, neighbours."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Hatching, Recognition
from ..functions import geometry as g
from ..plans.groups import Columns, solve_groups
from ..plans.scale import cells_between, cut_lineage, gap_moments, shuffled_join, spread_join
from .page_rules import table_cells

PAGE = ["doc_id", "page"]
Adjacent = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]
Near = Callable[[tuple, tuple], bool]
#: Cells along the side of a tile, by the items of the page: about as large as one task holds well.  A
#: page that one task holds well is a single tile.
TILES = ((20_000, 1 << 40), (320_000, 256), (None, 64))
#: Items up to which a tile is settled as a whole.
CROWD = 20_000


def tile_side(n: Column) -> Column:
    side = F.lit(TILES[-1][1])
    for most, cells in reversed(TILES[:-1]):
        side = F.when(n <= most, cells).otherwise(side)
    return side


def tile_solver(near: Near, shape: list[str]) -> Callable[[Columns], Columns]:
    """One ordered pass over a tile: items known to lead, and those free as far as the tile shows.

    An item next to an earlier leader is taken; one next to an earlier undecided item waits; any other
    leads, if its cells all lie in the tile, or is free here and may yet be taken elsewhere.
    """

    def settle(tile: Columns) -> Columns:
        boxes = list(zip(*(np.asarray(tile[c]).tolist() for c in shape), strict=True))
        leads: dict = {}
        waits: dict = {}
        rows, how = [], []
        for i, (keys, single) in enumerate(zip(tile["keys"], tile["single"].tolist(), strict=True)):
            mine = boxes[i]
            if any(near(mine, boxes[j]) for k in keys for j in leads.get(k, ())):
                continue
            waiting = bool(waits) and any(near(mine, boxes[j]) for k in keys for j in waits.get(k, ()))
            leading = single and not waiting
            if not waiting:
                rows.append(i)
                how.append(leading)
            for k in keys:
                (leads if leading else waits).setdefault(k, []).append(i)
        rows = np.array(rows, np.int64)
        return {**{c: tile[c][rows] for c in (*PAGE, "ord")}, "leads": np.array(how, bool)}

    return settle


def leader_cluster(
    items: DataFrame, shape: list[str], adjacent: Adjacent, near: Near, tile_of: Callable[[Column, Column, float], Column]
) -> tuple[DataFrame, DataFrame]:
    """Greedy leader clustering: the lowest unused item leads and takes its unused neighbours.

    ``items``: doc_id, page, ord, the columns of ``shape``, ``anchor`` (items of one anchor are
    always adjacent) and ``cells`` (adjacent items share a cell).  ``near`` is ``adjacent`` for two
    shapes at hand, ``tile_of`` names the tile of a cell, with tiles moved by a share of their side.  Returns (leaders, links); a link is an
    item next to a leader, so there are only a few links per item.

    Leaders come in rounds.  Pages are cut into tiles of many cells and a tile is settled in one
    ordered pass; only items on an edge need to hear from other tiles, so a chain of items costs a
    round per tile it crosses.  Every other round the tiles move by half their side, so that a chain
    along an edge comes to lie inside.  A tile with more than ``CROWD`` items is not held in one task:
    there an item leads when none of its cells has a lower one, a fold without pairs, which clears
    crowded cells at once.
    """
    cols = [*PAGE, "ord", *shape, "anchor", "cells", "side"]
    sizes = items.groupBy(*PAGE).agg(tile_side(F.count(F.lit(1))).alias("side"))
    base = cut_lineage(items.join(sizes, PAGE).select(*cols))
    left, leaders, shift = base, None, 0.5  # tiles of whole pages are centred on zero
    while True:
        left = left.withColumn("tiles", F.array_distinct(F.transform("cells", lambda c: tile_of(c, F.col("side"), shift))))
        spread = left.select("*", (F.size("tiles") == 1).alias("single"), F.explode("tiles").alias("tile"))
        crowds = spread.groupBy(*PAGE, "tile").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD)
        crowds = cut_lineage(crowds.select(*PAGE, "tile"))
        calm = spread.join(crowds, [*PAGE, "tile"], "left_anti").select(
            *PAGE, "tile", "ord", *shape, "single", F.transform("cells", lambda c: c.cast("string")).alias("keys")
        )
        told = solve_groups(
            calm.withColumn("tile", F.col("tile").cast("string")), [*PAGE, "tile"], ["ord"],
            tile_solver(near, shape), "doc_id long, page long, ord long, leads boolean",
        )
        full = spread.join(crowds, [*PAGE, "tile"], "left_semi")
        own = F.filter("cells", lambda c: tile_of(c, F.col("side"), shift) == F.col("tile"))
        lowest = full.select(*PAGE, "ord", F.explode(own).alias("cell")).groupBy(*PAGE, "cell").agg(
            F.min("ord").alias("low")
        )
        first = full.groupBy(*PAGE, "tile", "anchor").agg(
            F.min_by(F.struct("ord", "single", own.alias("own")), "ord").alias("s")
        )
        free = (
            first.select(*PAGE, "tile", "s.ord", "s.single", F.explode("s.own").alias("cell"))
            .join(lowest, [*PAGE, "cell"])
            .groupBy(*PAGE, "tile", "ord", "single")
            .agg(F.min("low").alias("low"))
            .filter("low = ord")
            .select(*PAGE, "ord", F.col("single").alias("leads"))
        )
        votes = told.unionByName(free).groupBy(*PAGE, "ord").agg(
            F.bool_or("leads").alias("leads"), F.count(F.lit(1)).alias("n")
        )
        new = cut_lineage(
            left.join(votes, [*PAGE, "ord"]).filter(F.col("leads") | (F.col("n") == F.size("tiles"))).select(*cols)
        )
        taken = leader_links(left, new, shape, adjacent).select(*PAGE, "ord").distinct()
        left = cut_lineage(left.join(taken, [*PAGE, "ord"], "left_anti").select(*cols))
        leaders = new if leaders is None else leaders.unionByName(new)
        if left.isEmpty():
            break
        shift = 0.5 - shift
    return leaders, leader_links(base, leaders, shape, adjacent)


def leader_links(items: DataFrame, leaders: DataFrame, shape: list[str], adjacent: Adjacent) -> DataFrame:
    """Pairs (item, leader) that are adjacent, leader not after the item."""
    a = items.select(*PAGE, "ord", *shape, F.explode("cells").alias("cell"))
    b = leaders.select(
        *PAGE, F.col("ord").alias("leader"), *[F.col(c).alias(f"l_{c}") for c in shape],
        F.explode("cells").alias("cell"),
    )
    near = adjacent(lambda c: F.col(c), lambda c: F.col(f"l_{c}"))
    return (
        shuffled_join(a, b, [*PAGE, "cell"])
        .filter(near & (F.col("leader") <= F.col("ord")))
        .select(*PAGE, "ord", "leader", *[f"l_{c}" for c in shape])
        .distinct()
    )


def first_leader(links: DataFrame, carry: list[str] = ()) -> DataFrame:
    """Every item with the earliest leader next to it: the one that took it."""
    return links.groupBy(*PAGE, "ord").agg(
        F.min("leader").alias("leader"), *[F.min_by(c, "leader").alias(c) for c in carry]
    )


def box_items(boxes: DataFrame, gap: float) -> DataFrame:
    """Boxes as cluster items: anchored by their corner, covering the cells of their halo."""
    half = gap / 2
    xs = cells_between(F.col("bx0") - half, F.col("bx1") + half, gap)
    ys = cells_between(F.col("by0") - half, F.col("by1") + half, gap)
    grid = F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return boxes.withColumns(
        {
            "anchor": F.struct(F.floor(F.col("bx0") / gap).alias("x"), F.floor(F.col("by0") / gap).alias("y")),
            "cells": grid,
        }
    )


BOX = ["bx0", "by0", "bx1", "by1"]


def box_adjacent(gap: float) -> Adjacent:
    return lambda a, b: g.boxes_within(*[a(c) for c in BOX], *[b(c) for c in BOX], gap)


def box_near(gap: float) -> Near:
    def near(a: tuple, b: tuple) -> bool:
        return max(a[0] - b[2], b[0] - a[2], 0.0) < gap and max(a[1] - b[3], b[1] - a[3], 0.0) < gap

    return near


def box_tile(cell: Column, side: Column, shift: float) -> Column:
    return F.struct(F.floor(cell["x"] / side + shift).alias("x"), F.floor(cell["y"] / side + shift).alias("y"))


def box_clusters(items: DataFrame, gap: float) -> tuple[DataFrame, DataFrame]:
    """Leaders and links of box items that are less than ``gap`` apart."""
    return leader_cluster(items, BOX, box_adjacent(gap), box_near(gap), box_tile)


def bbox_adjacent(boxes: DataFrame, gap: float = 12.0) -> DataFrame:
    """Boxes next to a cluster leader: (ord, leader), several leaders per box are possible."""
    return box_clusters(box_items(boxes, gap), gap)[1].select(
        *PAGE, "ord", "leader"
    )


def table_regions(prims: DataFrame, cfg: Recognition = Recognition()) -> DataFrame:
    """Clusters of at least four small cells: union box and cell count."""
    cells = table_cells(prims).filter("bx0 is not null")
    items = box_items(cells, cfg.table_gap)
    _, links = box_clusters(items, cfg.table_gap)
    owned = cells.select(*PAGE, "ord", *BOX).join(first_leader(links), [*PAGE, "ord"])
    return owned.groupBy(*PAGE, "leader").agg(
        F.count(F.lit(1)).alias("cells"), F.min("bx0").alias("x0"), F.min("by0").alias("y0"),
        F.max("bx1").alias("x1"), F.max("by1").alias("y1"),
    ).filter(F.col("cells") >= cfg.table_min_cells)


def segment_metrics(prims: DataFrame, min_len: float = 0.5) -> DataFrame:
    """Length, undirected angle and middle point of every two-point line long enough."""
    ends = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    lines = prims.filter((F.col("type") == "line") & (F.col("n_points") == 2))
    return lines.select(
        *PAGE, "prim_id", "ord", g.segment_length(*ends).alias("len"),
        g.segment_angle(*ends).alias("angle"),
        ((ends[0] + ends[2]) / 2).alias("mx"), ((ends[1] + ends[3]) / 2).alias("my"),
    ).filter(F.col("len") >= min_len)


def angle_gap(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d > 90, 180 - d).otherwise(d)


def parallel_degree(segs: DataFrame, tol: float = 3.0) -> DataFrame:
    """How many other segments of the page run within ``tol`` degrees of each angle.

    Counting instead of pairing: angles are folded to their counts, and a neighbourhood is the
    difference of two running counts over sorted distinct angles.  The running counts are made
    in narrow bins of the half turn; one row per bin carries them across.
    """
    counts = segs.groupBy(*PAGE, "angle").agg(F.count(F.lit(1)).alias("n"))
    # The half turn closes on itself: copies near the ends stand in for the other side.
    around = counts.select(
        *PAGE, F.explode(F.array(F.col("angle") - 180, F.col("angle"), F.col("angle") + 180)).alias("v"), "n"
    ).filter((F.col("v") > -tol) & (F.col("v") < 180 + tol))
    zero = F.lit(0).cast("long")
    # Points count before an upper query at the same value is not included (strictly closer).
    marks = (
        around.select(*PAGE, "v", F.lit(1).alias("o"), "n", F.lit(None).cast("double").alias("angle"), zero.alias("s"))
        .unionByName(counts.select(*PAGE, (F.col("angle") + tol).alias("v"), F.lit(0).alias("o"),
                                   zero.alias("n"), "angle", F.lit(1).cast("long").alias("s")))
        .unionByName(counts.select(*PAGE, (F.col("angle") - tol).alias("v"), F.lit(2).alias("o"),
                                   zero.alias("n"), "angle", F.lit(-1).cast("long").alias("s")))
        .withColumn("bin", F.floor(F.col("v") / (tol / 32)).cast("long"))
    )
    inner = Window.partitionBy(*PAGE, "bin").orderBy("v", "o").rowsBetween(Window.unboundedPreceding, 0)
    bins = marks.groupBy(*PAGE, "bin").agg(F.sum("n").alias("t"))
    outer = Window.partitionBy(*PAGE).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.select(*PAGE, "bin", F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("start"))
    ranked = marks.withColumn("c", F.sum("n").over(inner)).filter("s <> 0").join(starts, [*PAGE, "bin"])
    return ranked.groupBy(*PAGE, "angle").agg(
        (F.sum((F.col("c") + F.col("start")) * F.col("s")) - 1).alias("parallel")
    ).join(counts, [*PAGE, "angle"])


def hatch_stats(lines: DataFrame, keys: list[str], cfg: Hatching = Hatching()) -> DataFrame:
    """Spacing and length regularity of line groups and whether they pass as hatching.

    ``lines``: keys, proj (position across the group direction), len.
    """
    gaps = gap_moments(lines, keys, "proj", width=50.0)
    sizes = lines.groupBy(*keys).agg(F.avg("len").alias("_ml"), F.stddev_pop("len").alias("_sl"))
    k = F.col("n") - 1
    mean = F.col("gap_sum") / k
    var = F.greatest(F.col("gap_sq") / k - mean * mean, F.lit(0.0))
    joined = gaps.filter(F.col("n") >= cfg.min_lines).join(sizes, keys).withColumns(
        {
            "mean_spacing": mean,
            "spacing_cv": F.when(mean > 0, F.sqrt(var) / mean),
            "length_cv": F.when(F.col("_ml") > 0, F.col("_sl") / F.col("_ml")).otherwise(1.0),
        }
    )
    ok = (
        (F.col("mean_spacing") >= cfg.min_spacing) & (F.col("spacing_cv") < cfg.spacing_cv)
        & (F.col("length_cv") < cfg.length_cv)
    )
    return joined.select(
        *keys, "n", "mean_spacing", "spacing_cv", "length_cv",
        F.coalesce(ok, F.lit(False)).alias("accepted"),
    )


def across(angle: Column) -> Column:
    """Position of a line's middle across a direction in degrees."""
    return F.col("my") * F.cos(F.radians(angle)) - F.col("mx") * F.sin(F.radians(angle))


def hatch_accept(prims: DataFrame, cfg: Hatching = Hatching()) -> DataFrame:
    """Regularity of the lines of every fixed angle bin of a page."""
    segs = segment_metrics(prims, cfg.min_len).withColumn(
        "bin", F.floor(F.col("angle") / cfg.angle_tol_deg).cast("long")
    )
    lines = segs.withColumn("proj", across(F.col("bin") * cfg.angle_tol_deg))
    return hatch_stats(lines, [*PAGE, "bin"], cfg)


def angle_items(segs: DataFrame, tol: float) -> DataFrame:
    """Distinct angles of a page as cluster items: lines of one angle always share their fate."""
    bins = F.floor(F.col("angle") / tol).cast("long")
    n = int(-(-180.0 // tol))
    return segs.groupBy(*PAGE, "angle").agg(F.min("ord").alias("ord")).withColumns(
        {"anchor": bins, "cells": F.array_distinct(F.array(bins, (bins + 1) % n))}
    )


def circle_leaders(tol: float) -> Callable[[Columns], Columns]:
    """Greedy leaders of one page's angles on the half turn, each angle with the first leader that takes it.

    Leaders are at least ``tol`` apart, so there are at most 180 / tol of them; each takes its
    stretch of the angles at once.
    """

    def solve(page: Columns) -> Columns:
        angle, order = page["angle"], page["ord"]
        leader, l_angle = np.full(len(angle), -1, np.int64), np.zeros(len(angle))
        at = 0
        while at < len(angle):
            d = np.abs(angle - angle[at])
            takes = (np.where(d > 90, 180 - d, d) < tol) & (leader < 0)
            leader[takes], l_angle[takes] = order[at], angle[at]
            rest = np.flatnonzero(leader[at:] < 0)
            at = at + int(rest[0]) if len(rest) else len(angle)
        return {**{c: page[c] for c in (*PAGE, "angle")}, "leader": leader, "l_angle": l_angle}

    return solve


#: Distinct angles of a page up to which one task finds its leaders.
MOST_ANGLES = 1_000_000


def angle_owners(segs: DataFrame, tol: float) -> DataFrame:
    """Every distinct angle of a page with the leader that takes it; crowded pages by the general rounds."""
    items = cut_lineage(angle_items(segs, tol))
    crowded = items.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_ANGLES).select(*PAGE)
    crowded = cut_lineage(crowded)
    schema = "doc_id bigint, page bigint, angle double, leader bigint, l_angle double"
    if crowded.isEmpty():
        return solve_groups(items.select(*PAGE, "angle", "ord"), PAGE, ["ord"], circle_leaders(tol), schema)
    calm = items.join(crowded, PAGE, "left_anti").select(*PAGE, "angle", "ord")
    full = items.join(crowded, PAGE, "left_semi")

    def near(a: tuple, b: tuple) -> bool:
        d = abs(a[0] - b[0])
        return (180 - d if d > 90 else d) < tol

    _, links = leader_cluster(
        full, ["angle"], lambda a, b: angle_gap(a("angle"), b("angle")) < tol, near,
        lambda cell, side, shift: F.lit("all"),
    )
    owner = first_leader(links, ["l_angle"]).join(full.select(*PAGE, "ord", "angle"), [*PAGE, "ord"])
    solved = solve_groups(calm, PAGE, ["ord"], circle_leaders(tol), schema)
    return solved.unionByName(owner.select(*PAGE, "angle", "leader", "l_angle"))


def hatch_lines(prims: DataFrame, cfg: Hatching = Hatching()) -> DataFrame:
    """Lines with the leader of their parallel group and the leader's angle."""
    segs = cut_lineage(segment_metrics(prims, cfg.min_len))
    owner = angle_owners(segs, cfg.angle_tol_deg)
    # A hatched page is one angle, so its lines are dealt over several tasks.
    dealt = spread_join(segs, owner, [*PAGE, "angle"], "prim_id")
    return dealt.withColumn("proj", across(F.col("l_angle")))


def hatch_groups(prims: DataFrame, cfg: Hatching = Hatching()) -> DataFrame:
    """Lines that belong to a hatch pattern, with their group leader."""
    lines = hatch_lines(prims, cfg)
    good = hatch_stats(lines, [*PAGE, "leader"], cfg).filter("accepted").select(*PAGE, "leader")
    return spread_join(lines, good, [*PAGE, "leader"], "prim_id").select(*PAGE, "prim_id", "leader")


def occupied_cells(prims: DataFrame, side: float) -> DataFrame:
    """Occupied grid cells of every page with the extent and count of their primitives.

    Cells truncate towards zero, so the cells around zero are merged.
    """
    gx = ((F.col("bx0") + F.col("bx1")) / 2 / side).cast("long")
    gy = ((F.col("by0") + F.col("by1")) / 2 / side).cast("long")
    return prims.filter("bx0 is not null").groupBy(*PAGE, gx.alias("gx"), gy.alias("gy")).agg(
        F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"),
        F.min("bx0").alias("x0"), F.min("by0").alias("y0"),
        F.max("bx1").alias("x1"), F.max("by1").alias("y1"),
    )


def cell_neighbors(cells: DataFrame) -> DataFrame:
    """Ordered pairs of neighbouring occupied cells (8 directions), at most 8 per cell."""
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    step = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in steps]))
    out = cells.select(*PAGE, "gx", "gy", F.col("ord").alias("a"), step.alias("s")).select(
        *PAGE, "a", F.col("gx").alias("ax"), F.col("gy").alias("ay"),
        (F.col("gx") + F.col("s.dx")).alias("gx"), (F.col("gy") + F.col("s.dy")).alias("gy"),
    )
    return out.join(cells.select(*PAGE, "gx", "gy", F.col("ord").alias("b")), [*PAGE, "gx", "gy"]).select(
        *PAGE, "a", "b", "ax", "ay", F.col("gx").alias("bx"), F.col("gy").alias("by")
    )


def tile_labels(tile: Columns) -> Columns:
    """Lowest ord of the component of every cell of one tile: trees are hooked and flattened until none meet."""
    gx, gy = (tile[c] - tile[c].min() for c in ("gx", "gy"))
    wide = int(gy.max()) + 3
    key = gx * wide + gy + 1
    order = np.argsort(key)
    ends = []
    for step in (1, wide - 1, wide, wide + 1):
        at = np.searchsorted(key[order], key + step)
        met = at < len(key)
        met[met] = key[order][at[met]] == key[met] + step
        ends.append((np.flatnonzero(met), order[at[met]]))
    a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
    root = np.arange(len(key))
    while len(a):
        ra, rb = root[a], root[b]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return tile | {"label": tile["ord"][root]}


def component_labels(cells: DataFrame, side: int = 128) -> DataFrame:
    """Lowest ord of the connected component of every cell.

    Tiles of ``side`` by ``side`` cells are labelled on their own.  Components that meet across the edges
    of tiles are then joined in rounds over links between them, whose number follows the edges and
    not the cells.
    """
    tile = {t: F.floor((F.col(g) + F.lit(side // 2)) / F.lit(side)).cast("long") for t, g in (("tx", "gx"), ("ty", "gy"))}
    schema = "doc_id bigint, page bigint, gx bigint, gy bigint, tx bigint, ty bigint, ord bigint, label bigint"
    local = cut_lineage(
        solve_groups(
            cells.select(*PAGE, "gx", "gy", F.col("ord").cast("bigint").alias("ord")).withColumns(tile),
            [*PAGE, "tx", "ty"], ["ord"], tile_labels, schema,
        )
    )
    inside = [F.pmod(F.col(c) + side // 2, F.lit(side)).isin(0, side - 1) for c in ("gx", "gy")]
    edge = local.filter(inside[0] | inside[1])
    steps = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y]
    step = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in steps]))
    beside = edge.select(*PAGE, F.col("label").alias("a"), "tx", "ty", "gx", "gy", step.alias("s")).select(
        *PAGE, "a", F.col("tx").alias("ax"), F.col("ty").alias("ay"), (F.col("gx") + F.col("s.dx")).alias("gx"), (F.col("gy") + F.col("s.dy")).alias("gy")
    )
    met = beside.join(edge.select(*PAGE, "gx", "gy", "tx", "ty", F.col("label").alias("b")), [*PAGE, "gx", "gy"])
    links = cut_lineage(met.filter("ax <> tx or ay <> ty").select(*PAGE, "a", "b").distinct())
    if links.isEmpty():
        return local.select(*PAGE, "ord", "label")
    roots = linked_labels(links)
    return local.join(roots, [*PAGE, "label"], "left").select(*PAGE, "ord", F.coalesce("root", "label").alias("label"))


def linked_labels(links: DataFrame) -> DataFrame:
    """(label, root): the lowest label that each can reach over ``links`` (a, b), given both ways.

    Each round takes the lowest root among a label's neighbours and then the root of that root, so
    rounds grow with the logarithm of the longest way; every round is checkpointed.
    """
    edges = links.unionByName(links.select(*PAGE, "a", F.col("a").alias("b")).distinct())
    labels = links.select(*PAGE, F.col("a").alias("label"), F.col("a").alias("root")).distinct()
    while True:
        around = edges.join(labels.select(*PAGE, F.col("label").alias("b"), "root"), [*PAGE, "b"]).groupBy(
            *PAGE, F.col("a").alias("label")
        ).agg(F.min("root").alias("near"))
        hop = around.join(
            labels.select(*PAGE, F.col("label").alias("near"), F.col("root").alias("far")), [*PAGE, "near"]
        ).join(labels, [*PAGE, "label"])
        moved = cut_lineage(
            hop.select(*PAGE, "label", F.least("near", "far").alias("root"), (F.least("near", "far") < F.col("root")).alias("changed"))
        )
        labels = moved.select(*PAGE, "label", "root")
        if moved.filter("changed").isEmpty():
            return labels


def regions(prims: DataFrame, pages: DataFrame, cfg: Recognition = Recognition()) -> DataFrame:
    """Detail regions of every page: box, size, type, label, confidence.

    Primitives are folded to cells before and cells to regions after the labelling.
    """
    cells = cut_lineage(occupied_cells(prims, cfg.region_gap * 3))
    folded = cells.join(component_labels(cells), [*PAGE, "ord"]).groupBy(*PAGE, "label").agg(
        F.sum("n").alias("prims"), F.min("x0").alias("x0"), F.min("y0").alias("y0"),
        F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    ).filter(F.col("prims") >= cfg.region_min_prims)
    sized = folded.join(pages.select(*PAGE, "height"), PAGE)
    # Regions are at least one empty cell apart, so a page holds a bounded number of them.
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("label")).cast("long")
    h = F.col("height")
    title = (F.col("y0") < h * 0.15) & (F.col("y1") < h * 0.3)
    kind = F.when(title, "title_block").when(F.col("prims") > cfg.assembly_prims, "assembly").otherwise("detail")
    return sized.withColumns({"region": number, "type": kind}).select(
        *PAGE, "region", "type",
        F.when(title, "TitleBlock").when(F.col("type") == "assembly", "Assembly")
        .otherwise(F.concat(F.lit("Detail_"), F.col("region").cast("string"))).alias("label"),
        F.when(title, 0.80).otherwise(0.0).alias("confidence"),
        "prims", "x0", "y0", "x1", "y1",
    )


def square(value: Column, reach: int) -> Column:
    """The cells around a cell, ``reach`` to either side."""
    return F.sequence(value - reach, value + reach)


def dimension_assoc(dims: DataFrame, prims: DataFrame, radius: float = 75.0, levels: int = 4) -> DataFrame:
    """Nearest primitive centre within ``radius`` of every dimension text, or null.

    ``dims``: doc_id, page, text_id, ix, iy.  Primitives of one centre and texts of one spot are folded
    first.  Cells of ``levels`` + 1 sizes, each half as wide as the one before, say where primitives are.  A text
    asks around the smallest occupied cell it lies in: a primitive there is no further away than the
    cell's diagonal, so the nearest lies within two cells.  Texts in no occupied cell ask the eight
    cells around theirs of the largest size.  Two joins find them, whatever ``levels`` is.
    """
    mid = prims.filter("bx0 is not null").groupBy(
        *PAGE, ((F.col("bx0") + F.col("bx1")) / 2).alias("px"), ((F.col("by0") + F.col("by1")) / 2).alias("py")
    ).agg(F.min("ord").alias("ord"), F.min_by("prim_id", "ord").alias("prim_id"))

    def at_levels(df: DataFrame, x: str, y: str) -> DataFrame:
        side = F.lit(radius) / F.pow(F.lit(2.0), F.col("level"))
        return df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumns(
            {"gx": F.floor(F.col(x) / side).cast("long"), "gy": F.floor(F.col(y) / side).cast("long")}
        )

    cell = [*PAGE, "level", "gx", "gy"]
    dims = cut_lineage(dims)  # parsed texts: used twice
    homes = cut_lineage(at_levels(mid, "px", "py"))
    spots = at_levels(dims.select(*PAGE, "ix", "iy").distinct(), "ix", "iy")
    occupied = homes.select(*cell).distinct().withColumn("met", F.lit(True))
    deepest = shuffled_join(spots, occupied, cell, "left").groupBy(*PAGE, "ix", "iy").agg(
        F.max_by(F.struct("level", "gx", "gy"), F.when(F.col("met") | (F.col("level") == 0), F.col("level"))).alias("own")
    ).select(*PAGE, "ix", "iy", "own.*")
    reach = F.when(F.col("level") == 0, 1).otherwise(2)
    asks = deepest.withColumn("gx", F.explode(square(F.col("gx"), reach))).withColumn("gy", F.explode(square(F.col("gy"), reach)))
    d = F.hypot(F.col("ix") - F.col("px"), F.col("iy") - F.col("py"))
    found = shuffled_join(asks, homes, cell).withColumn("d", d).filter(F.col("d") < radius).groupBy(*PAGE, "ix", "iy").agg(
        F.min_by(F.struct("prim_id", "d"), F.struct("d", "ord")).alias("hit")
    )
    return dims.join(found, [*PAGE, "ix", "iy"], "left").withColumns(
        {"nearest_prim_id": F.col("hit.prim_id"), "distance": F.col("hit.d")}
    ).drop("hit")


def boundaries(facts: DataFrame, min_area: float = 100.0) -> DataFrame:
    """Closed loops of at least ``min_area``, largest first, input order on ties."""
    return facts.filter(
        (F.col("type") == "closed_loop") & F.col("closed") & (F.col("area") >= min_area)
    ).orderBy(F.desc("area"), "prim_id")


def repeated_patterns(facts: DataFrame, min_area: float = 1.0, min_count: int = 3) -> DataFrame:
    """Closed loops of the same rounded area and point count, at least three of them.

    Long form: one row per member with the size of its pattern.
    """
    loops = facts.filter((F.col("type") == "closed_loop") & (F.col("area") > min_area)).withColumn(
        "area_key", F.bround("area").cast("long")
    )
    keys = ["area_key", "n_points"]
    groups = loops.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= min_count)
    return loops.join(groups, keys).select(*keys, "count", "prim_id")
