"""Density grids and non-overlapping structure partitions of many slides at once.

Grids are long tables ``(case_id, structure_id, ix, iy, density)`` that leave zeros
out. Cells are only touched by the binning and the final look-up; everything between
works on grid tables, whose size is set by the number of bins and slides.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import materialize
from . import components as C, tiles
from .ranking import exact_quantiles
from .spatial import CASE, with_case

PIXEL = (CASE, "ix", "iy")


@dataclass(frozen=True)
class PartitionConfig:
    # Defaults of the partition
    bins_x: int = 900
    bins_y: int = 700
    gaussian_sigma: float = 2.25
    density_scale_quantile: float = 0.98
    support_quantile: float = 0.18
    tissue_quantile: float = 0.06
    min_dominance: float = 0.34
    closing_iterations: int = 2
    opening_iterations: int = 1
    fill_holes: bool = True
    min_cells: int = 500
    min_component_pixels: int = 180
    min_tissue_pixels: int = 500
    min_fallback_pixels: int = 20


def extent(cells: DataFrame) -> DataFrame:
    """Bounds per case. Written, so the optimizer sees how small it is."""
    return materialize(with_case(cells).groupBy(CASE).agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"),
                                                          F.min("y").alias("y_min"), F.max("y").alias("y_max")))


def bin_index(v, lo, hi, bins: int) -> Column:
    """Bin of ``v`` between evenly spaced edges, right-open but for the last.

    The estimate by division can be off by one at an edge, so it is checked against
    the edges themselves. Values outside fall into the first or last bin.
    """
    v, lo, hi = (F.col(c) if isinstance(c, str) else c for c in (v, lo, hi))
    step = (hi - lo) / bins
    guess = F.coalesce(F.floor(F.try_divide(v - lo, step)).cast("int"), F.lit(0))
    guess = F.greatest(F.least(guess, F.lit(bins - 1)), F.lit(0))
    fixed = F.when(v < guess * step + lo, guess - 1).when(v >= (guess + 1) * step + lo, guess + 1).otherwise(guess)
    return F.greatest(F.least(fixed, F.lit(bins - 1)), F.lit(0)).cast("int")


def with_bins(cells: DataFrame, bounds: DataFrame, bins_x: int, bins_y: int) -> DataFrame:
    return (with_case(cells).join(bounds, CASE).withColumn("ix", bin_index("x", "x_min", "x_max", bins_x))
            .withColumn("iy", bin_index("y", "y_min", "y_max", bins_y)).drop("x_min", "x_max", "y_min", "y_max"))


def histogram2d(binned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return binned.groupBy(CASE, *keys, "ix", "iy").agg(F.count("*").alias("n"))


def gaussian_kernel(sigma: float) -> list[tuple[int, float]]:
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [(i, v / sum(w)) for i, v in zip(range(-r, r + 1), w)]


def _mirror(c: Column, n: int) -> Column:
    m = F.pmod(c, F.lit(2 * n))
    return F.when(m < n, m).otherwise(2 * n - 1 - m).cast("int")


def gaussian_smooth(grid: DataFrame, keys: Sequence[str], value: str, sigma: float, width: int, height: int) -> DataFrame:
    """Separable Gaussian blur with mirrored edges; each pass adds ``2r+1`` rows per pixel, summed before the shuffle."""
    kernel = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in gaussian_kernel(sigma)])
    out = grid.select(*keys, "ix", "iy", F.col(value).cast("double").alias("v"))
    for axis, n in (("ix", width), ("iy", height)):
        other = "iy" if axis == "ix" else "ix"
        out = (out.select(*keys, other, axis, "v", F.explode(kernel).alias("k"))
               .groupBy(*keys, other, _mirror(F.col(axis) + F.col("k.i"), n).alias(axis)).agg(F.sum(F.col("v") * F.col("k.w")).alias("v")))
    return out.select(*keys, "ix", "iy", F.col("v").alias("density"))


def positive_quantiles(grid: DataFrame, keys: Sequence[str], qs: dict[str, float]) -> DataFrame:
    """Quantiles of positive densities; a group is at most one grid."""
    return grid.groupBy(*keys).agg(*[F.percentile(F.when(F.col("density") > 0, F.col("density")), float(q)).alias(n) for n, q in qs.items()])


def normalize_density(binned: DataFrame, cfg: PartitionConfig) -> tuple[DataFrame, DataFrame]:
    """``(density table, structure table)``.

    Structure rows say which structures take part: ``(case_id, structure_id, cells,
    scale, support, reason)`` with ``reason`` null for valid ones.
    """
    own = binned.filter("structure_id > 0")
    counts = own.groupBy(CASE, "structure_id").agg(F.count("*").alias("cells"))
    enough = counts.filter(F.col("cells") >= cfg.min_cells).select(CASE, "structure_id")
    hist = histogram2d(own, ["structure_id"]).join(enough, [CASE, "structure_id"], "left_semi")
    density = materialize(gaussian_smooth(hist, [CASE, "structure_id"], "n", cfg.gaussian_sigma, cfg.bins_x, cfg.bins_y))
    q = positive_quantiles(density, [CASE, "structure_id"], {"scale": cfg.density_scale_quantile, "support": cfg.support_quantile})
    too_few = F.concat(F.lit("Only "), F.col("cells").cast("string"), F.lit(f" cells, below min_cells={cfg.min_cells}"))
    structures = counts.join(q, [CASE, "structure_id"], "left").withColumn(
        "reason", F.when(F.col("cells") < cfg.min_cells, too_few)
        .when(F.col("scale").isNull(), "Density map contained no positive pixels after smoothing.")
        .when((F.col("scale") <= 0) | (F.col("support") <= 0), "Could not derive positive scale/support thresholds for this structure."))
    return density, materialize(structures)


def posterior(density: DataFrame, structures: DataFrame) -> DataFrame:
    """Share of each valid structure in every pixel and whether it dominates (lowest id on ties).

    The window holds one row per structure of a pixel.
    """
    valid = structures.filter("reason IS NULL").select(CASE, "structure_id", "scale", "support")
    w = Window.partitionBy(*PIXEL)
    norm = density.join(valid, [CASE, "structure_id"]).withColumn("norm", F.col("density") / F.col("scale"))
    share = norm.withColumn("posterior", F.col("norm") / (F.sum("norm").over(w) + 1e-12)).withColumn("total_density", F.sum("density").over(w))
    order = w.orderBy(F.desc("posterior"), "structure_id")
    return share.withColumn("dominant", F.row_number().over(order) == 1)


def tissue_mask(post: DataFrame, occupied: DataFrame, cfg: PartitionConfig) -> DataFrame:
    total = post.filter("dominant").select(*PIXEL, F.col("total_density").alias("density"))
    cut = positive_quantiles(total, [CASE], {"cut": cfg.tissue_quantile})
    dense = total.join(cut, CASE).filter("density >= cut").select(*PIXEL)
    raw = dense.unionByName(occupied.select(*PIXEL)).distinct()
    clean = C.clean_mask(raw, [CASE], cfg.bins_x, cfg.bins_y, cfg.closing_iterations, cfg.opening_iterations, cfg.fill_holes,
                         max(cfg.min_tissue_pixels, cfg.min_component_pixels))
    return materialize(clean.unionByName(occupied.select(*PIXEL)).distinct())


def seed_mask(post: DataFrame, tissue: DataFrame, structures: DataFrame, cfg: PartitionConfig) -> DataFrame:
    """Confident pixels of each structure, or its dominant area, or its densest pixel."""
    keys = [CASE, "structure_id"]
    lead = materialize(post.filter("dominant").join(tissue, list(PIXEL), "left_semi"))
    sure = lead.filter((F.col("density") >= F.col("support")) & (F.col("posterior") >= cfg.min_dominance)).select(*keys, "ix", "iy")
    seeds = materialize(C.clean_mask(sure, keys, cfg.bins_x, cfg.bins_y, cfg.closing_iterations, cfg.opening_iterations,
                                     cfg.fill_holes, cfg.min_component_pixels))
    valid = structures.filter("reason IS NULL").select(*keys)
    without = materialize(valid.join(seeds.select(*keys).distinct(), keys, "left_anti"))
    if without.isEmpty():
        return seeds
    area = lead.filter("density > 0").join(without, keys, "left_semi").select(*keys, "ix", "iy")
    area = materialize(C.remove_small_components(area, keys, max(cfg.min_fallback_pixels, cfg.min_component_pixels // 2), cfg.bins_x))
    bare = without.join(area.select(*keys).distinct(), keys, "left_anti")
    first = F.min_by(F.struct("ix", "iy"), F.struct(-F.col("density"), "iy", "ix"))
    peak = post.join(bare, keys, "left_semi").groupBy(*keys).agg(first.alias("p")).select(*keys, "p.ix", "p.iy")
    return materialize(seeds.unionByName(area).unionByName(peak))


def exclusive_seed(seeds: DataFrame, post: DataFrame, min_pixels: int, width: int) -> DataFrame:
    """Where seeds overlap keep the structure with the largest posterior, then drop fragments.

    Only structures of slides with an overlap are cleaned again.
    """
    keys = [CASE, "structure_id"]
    claims = seeds.groupBy(*PIXEL).agg(F.count("*").alias("_claims"))
    contested = claims.filter("_claims > 1").select(CASE).distinct()
    if contested.isEmpty():
        return seeds
    winner = post.groupBy(*PIXEL).agg(F.min_by("structure_id", F.struct(-F.col("posterior"), "structure_id")).alias("_win"))
    left = (seeds.join(claims, list(PIXEL)).join(winner, list(PIXEL), "left")
            .filter((F.col("_claims") == 1) | (F.col("_win") == F.col("structure_id"))).select(*keys, "ix", "iy"))
    redo = C.remove_small_components(left.join(contested, CASE, "left_semi"), keys, min_pixels, width)
    return materialize(redo.unionByName(left.join(contested, CASE, "left_anti")))


def nearest_seed(pixels: DataFrame, seeds: DataFrame) -> DataFrame:
    """Structure of the closest seed pixel for each pixel; on equal distance the smallest id."""
    a = tiles.pack(pixels.select(CASE, F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y")), [CASE], block=tiles.SEARCH)
    b = tiles.pack(seeds.select(CASE, F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), "structure_id"), [CASE])
    near = tiles.nearest(a, b, [CASE], [CASE, "x", "y"], ["structure_id"])
    return near.select(CASE, F.col("x").cast("int").alias("ix"), F.col("y").cast("int").alias("iy"), "structure_id", "d")


def partition_labels(post: DataFrame, tissue: DataFrame, seeds: DataFrame, occupied: DataFrame, structures: DataFrame) -> DataFrame:
    """``(case_id, ix, iy, structure_id)``: seed, else dominant structure, else nearest seed."""
    seed = seeds.groupBy(*PIXEL).agg(F.max("structure_id").alias("_seed"))
    lead = post.filter("dominant").select(*PIXEL, F.col("structure_id").alias("_lead"))
    # seeds may lie outside the tissue after closing and hole filling; they keep their label
    base = (tissue.withColumn("_in", F.lit(True)).join(seed, list(PIXEL), "full_outer").join(lead, list(PIXEL), "left")
            .withColumn("structure_id", F.coalesce("_seed", F.when(F.col("_in"), F.col("_lead")))))
    base = materialize(base)
    bare = base.filter("structure_id IS NULL").select(*PIXEL)
    done = base.filter("structure_id IS NOT NULL").select(*PIXEL, "structure_id")
    if not bare.isEmpty():
        near = nearest_seed(bare, seeds).select(*PIXEL, "structure_id")
        done = done.unionByName(near)
        first = structures.filter("reason IS NULL").groupBy(CASE).agg(F.min("structure_id").alias("structure_id"))
        left = bare.join(occupied.select(*PIXEL), list(PIXEL), "left_semi").join(near, list(PIXEL), "left_anti")
        done = done.unionByName(left.join(first, CASE).select(*PIXEL, "structure_id"))
    return materialize(done)


@dataclass
class Partition:
    labels: DataFrame
    structures: DataFrame
    seeds: DataFrame
    occupied: DataFrame
    bounds: DataFrame
    binned: DataFrame


def build_partition(cells: DataFrame, cfg: PartitionConfig = PartitionConfig()) -> Partition:
    """Partition every slide of ``cells(case_id, x, y, structure_id)`` into structure areas."""
    cells = with_case(cells)
    bounds = extent(cells)
    binned = with_bins(cells, bounds, cfg.bins_x, cfg.bins_y)
    occupied = materialize(binned.select(*PIXEL).distinct())
    density, structures = normalize_density(binned, cfg)
    if structures.filter("reason IS NULL").isEmpty():
        raise ValueError("no structure has enough cells to build a partition")
    post = materialize(posterior(density, structures))
    tissue = tissue_mask(post, occupied, cfg)
    seeds = exclusive_seed(seed_mask(post, tissue, structures, cfg), post, cfg.min_component_pixels, cfg.bins_x)
    return Partition(partition_labels(post, tissue, seeds, occupied, structures), structures, seeds, occupied, bounds, binned)


def partition_metrics(p: Partition) -> DataFrame:
    """Per structure: cells, reason when skipped, partition and seed pixels, seed pixels shared with another."""
    area = p.labels.groupBy(CASE, "structure_id").agg(F.count("*").alias("partition_pixels"))
    shared = p.seeds.withColumn("_k", F.count("*").over(Window.partitionBy(*PIXEL)))
    seed = shared.groupBy(CASE, "structure_id").agg(F.count("*").alias("seed_pixels"), F.count_if(F.col("_k") > 1).alias("overlap_pixels"))
    return (p.structures.select(CASE, "structure_id", "cells", "reason").join(area, [CASE, "structure_id"], "left").join(seed, [CASE, "structure_id"], "left")
            .fillna(0, ["partition_pixels", "seed_pixels", "overlap_pixels"]))


def grid_lookup(binned: DataFrame, labels: DataFrame, spec: DataFrame | None = None) -> DataFrame:
    """Cells with the structure of their pixel; without one the id is 0 and the name ``unassigned``.

    Each pixel has one label row, so a crowded pixel is an ordinary hot key of the left side.
    """
    out = (binned.join(labels.withColumnRenamed("structure_id", "partition_structure_id"), list(PIXEL), "left")
           .withColumn("partition_structure_id", F.coalesce("partition_structure_id", F.lit(0))))
    if spec is None:
        return out
    names = spec.select(F.col("structure_id").alias("partition_structure_id"), F.col("structure_name").alias("partition_structure_name"))
    return (out.join(names, "partition_structure_id", "left")
            .withColumn("partition_structure_name", F.coalesce("partition_structure_name", F.lit("unassigned"))))


def assignment_metrics(assigned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    hit = F.col("partition_structure_id") > 0
    return assigned.groupBy(*by).agg(F.count("*").alias("cell_count"), F.count_if(hit).alias("assigned_cell_count"),
                                     F.avg(hit.cast("double")).alias("assigned_cell_fraction"))


def structure_count_table(spec: DataFrame, assigned: DataFrame, contours: DataFrame | None = None) -> DataFrame:
    """Per structure: cells put in, cells assigned, contours."""
    fed = assigned.groupBy(F.col("structure_id")).agg(F.count("*").alias("input_cell_count"))
    got = assigned.groupBy(F.col("partition_structure_id").alias("structure_id")).agg(F.count("*").alias("assigned_cell_count"))
    out = spec.select("structure_id", "structure_name", F.array_join("cluster_ids", ", ").alias("selected_cluster_ids"))
    out = out.join(fed, "structure_id", "left").join(got, "structure_id", "left")
    if contours is None:
        out = out.withColumn("contour_count", F.lit(0).cast("bigint"))
    else:
        n = contours.select("structure_id", "component", "ring").distinct().groupBy("structure_id").agg(F.count("*").alias("contour_count"))
        out = out.join(n, "structure_id", "left")
    return out.fillna(0, ["input_cell_count", "assigned_cell_count", "contour_count"])


def contour_rings(labels: DataFrame, width: int, min_points: int = 3) -> DataFrame:
    """Outlines of each structure area at half level: ``(case_id, structure_id, ring, seq, x, y)`` in pixel units.

    Holes are rings of their own, walked the other way.
    """
    rings = C.trace_rings(labels.select(CASE, "structure_id", "ix", "iy"), [CASE, "structure_id"], width)
    big = rings.groupBy(CASE, "structure_id", "ring").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_points).drop("_n")
    return rings.join(big, [CASE, "structure_id", "ring"], "left_semi")


def dedup_consecutive(vertices: DataFrame, ring: Sequence[str]) -> DataFrame:
    """Drop a vertex equal to the one before it at six decimals, and number the rest from 0.

    A ring comes from the cells of one grid, so its vertices fit a task.
    """
    along = Window.partitionBy(*ring).orderBy("seq")
    r = vertices.withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))
    place = F.struct("x", "y")
    return (r.withColumn("_same", F.coalesce(F.lag(place).over(along) == place, F.lit(False))).filter(~F.col("_same")).drop("_same")
            .withColumn("seq", (F.row_number().over(along) - 1).cast("bigint")))


def thin_vertices(vertices: DataFrame, ring: Sequence[str], max_vertices: int) -> DataFrame:
    """Every step-th vertex of rings that have more than ``max_vertices``, numbered from 0 anew.

    ``thinned`` tells which rings were; ``seq`` may have gaps.
    """
    whole = Window.partitionBy(*ring)
    step = F.ceil(F.count("*").over(whole) / F.lit(max_vertices))
    numbered = vertices.withColumn("_step", step).withColumn("seq", (F.row_number().over(whole.orderBy("seq")) - 1).cast("bigint"))
    return (numbered.filter(F.pmod(F.col("seq"), F.col("_step")) == 0)
            .withColumn("seq", (F.col("seq") / F.col("_step")).cast("bigint")).withColumn("thinned", F.col("_step") > 1).drop("_step"))


def close_rings(vertices: DataFrame, ring: Sequence[str], even_if_closed: bool = True) -> DataFrame:
    """Repeat the first vertex at the end of each ring, or only of rings that end elsewhere."""
    place = F.struct("x", "y") if "y" in vertices.columns else F.struct("x")
    ends = vertices.groupBy(*ring).agg(F.min("seq").alias("_first"), F.max("seq").alias("_last"), F.min_by(place, "seq").alias("_a"), F.max_by(place, "seq").alias("_b"))
    if not even_if_closed:
        ends = ends.filter(F.col("_a") != F.col("_b"))
    first = (vertices.join(ends, list(ring)).filter(F.col("seq") == F.col("_first")).withColumn("seq", (F.col("_last") + 1).cast("bigint")))
    return vertices.unionByName(first.select(*vertices.columns))


def polygon_export(labels: DataFrame, bounds: DataFrame, spec: DataFrame, cfg: PartitionConfig, pixel_size_um: float,
                   max_vertices: int | None = None) -> DataFrame:
    """Closed outlines of every component in slide pixels, holes filled, with selection names.

    Repeated vertices are dropped and outlines of under four points left out. With ``max_vertices``
    longer outlines are thinned, and ``thinned`` says so.

    Components are numbered by the position of their first pixel; a filled component has
    one outline, so its polygon number is 1.
    """
    from ..functions import scalars as S
    keys = [CASE, "structure_id", "part"]
    comp = C.label_components(labels.select(CASE, "structure_id", "ix", "iy"), [CASE, "structure_id"], cfg.bins_x)
    comp = materialize(comp.select(CASE, "structure_id", F.col("component").alias("part"), "ix", "iy"))
    solid = C.fill_holes(comp, keys, cfg.bins_x, cfg.bins_y)
    rings = C.trace_rings(solid, keys, cfg.bins_x)
    order = Window.partitionBy(CASE, "structure_id").orderBy("part")
    numbered = comp.select(*keys).distinct()
    numbers = numbered.withColumn("component_index", F.row_number().over(order)).withColumn(
        "_components", F.count("*").over(Window.partitionBy(CASE, "structure_id")))
    k = S.check_pixel_size(pixel_size_um)
    dx, dy = (F.col("x_max") - F.col("x_min")) / cfg.bins_x, (F.col("y_max") - F.col("y_min")) / cfg.bins_y
    out = (rings.join(numbers, keys).join(bounds, CASE).join(spec.select("structure_id", "structure_name", "structure_color"), "structure_id")
           .withColumn("x", F.round((F.col("x_min") + F.col("x") * dx) / k, 6)).withColumn("y", F.round((F.col("y_min") + F.col("y") * dy) / k, 6)))
    ring = [*keys, "ring"]

    def large(d):
        return d.join(d.groupBy(*ring).agg(F.count("*").alias("_n")).filter("_n >= 4").select(*ring), ring, "left_semi")
    out = large(dedup_consecutive(close_rings(out, ring, even_if_closed=False), ring)).withColumn("thinned", F.lit(False))
    if max_vertices is not None:
        out = large(close_rings(thin_vertices(out, ring, max_vertices), ring, even_if_closed=False))
    name = S.selection_name("structure_id", "structure_name", "component_index", F.lit(1), F.col("_components") == 1)
    return out.select(CASE, "structure_id", "structure_name", "structure_color", "component_index", F.lit(1).alias("polygon_index"),
                      name.alias("selection"), "seq", "x", "y", "thinned")


def polygon_summary(polygons: DataFrame) -> DataFrame:
    return (polygons.groupBy(CASE, F.col("selection").alias("Selection"), F.col("structure_id").alias("StructureID"),
                             F.col("structure_name").alias("AssignedStructure"), F.col("component_index").alias("ComponentIndex"),
                             F.col("polygon_index").alias("PolygonIndex")).agg(F.count("*").alias("VertexCount")))


def write_annotations(polygons: DataFrame, path: str) -> dict[str, str]:
    """Features (one JSON object per line), vertex CSV and summary CSV.

    A feature gathers its own vertices, at most the export's vertex limit.
    """
    from ..functions import scalars as S
    who = [CASE, "selection", "structure_id", "structure_name", "structure_color", "component_index", "polygon_index"]
    ring = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda v: F.array(v["x"], v["y"]))
    feature = polygons.groupBy(*who).agg(ring.alias("_ring")).select(
        F.lit("Feature").alias("type"), F.sha2(F.concat_ws("|", CASE, "selection"), 256).alias("id"),
        F.struct(F.lit("Polygon").alias("type"), F.array("_ring").alias("coordinates")).alias("geometry"),
        F.struct(F.lit("annotation").alias("objectType"), F.col("selection").alias("name"),
                 F.struct(F.col("selection").alias("name"), S.hex_to_rgb("structure_color").alias("color")).alias("classification"),
                 "structure_id", F.col("structure_name").alias("assigned_structure"), "component_index", "polygon_index").alias("properties"))
    feature.write.mode("errorifexists").json(f"{path}/features")
    (polygons.select(F.col("selection").alias("Selection"), F.col("x").alias("X"), F.col("y").alias("Y"), "seq")
     .repartitionByRange("Selection", "seq").sortWithinPartitions("Selection", "seq").drop("seq")
     .write.mode("errorifexists").csv(f"{path}/vertices", header=True))
    polygon_summary(polygons).write.mode("errorifexists").csv(f"{path}/summary", header=True)
    return {n: f"{path}/{n}" for n in ("features", "vertices", "summary")}


def density_proxy_raster(cells: DataFrame, max_side: int = 2200, min_side: int = 256, margin: float = 50.0, sigma: float = 2.0) -> DataFrame:
    """Colour raster of cell density for slides without an image: ``(case_id, ix, iy, r, g, b)``.

    Only pixels with density are listed; all others have the colour (250, 244, 252).
    The raster size follows the extent, so slides are rastered one by one.
    """
    cells = with_case(cells)
    out = None
    for e in extent(cells).collect():  # one row per slide
        x0, x1, y0, y1 = e["x_min"] - margin, e["x_max"] + margin, e["y_min"] - margin, e["y_max"] + margin
        scale = max(x1 - x0, y1 - y0) / max_side
        width, height = max(min_side, math.ceil((x1 - x0) / scale)), max(min_side, math.ceil((y1 - y0) / scale))
        own = cells.filter(F.col(CASE) == e[CASE])
        binned = own.select(CASE, bin_index("x", F.lit(x0), F.lit(x1), width).alias("ix"), bin_index("y", F.lit(y0), F.lit(y1), height).alias("iy"))
        smooth = gaussian_smooth(histogram2d(binned), [CASE], "n", sigma, width, height)
        smooth = materialize(smooth)
        q = exact_quantiles(smooth.filter("density > 0"), [CASE], "density", {"q": 0.995})
        norm = F.least(F.col("density") / F.greatest(F.col("q"), F.lit(1e-6)), F.lit(1.0))
        rgb = smooth.join(q, CASE).select(*PIXEL, *[F.floor(a - b * norm).cast("int").alias(n) for n, a, b in
                                                     (("r", 250.0, 35.0), ("g", 244.0, 120.0), ("b", 252.0, 70.0))])
        out = rgb if out is None else out.unionByName(rgb)
    return out


def polygon_bbox(vertices: DataFrame, keys: Sequence[str] = ("polygon_id",)) -> DataFrame:
    return vertices.groupBy(*keys).agg(F.floor(F.min("x")).cast("int").alias("x0"), F.floor(F.min("y")).cast("int").alias("y0"),
                                       F.ceil(F.max("x")).cast("int").alias("x1"), F.ceil(F.max("y")).cast("int").alias("y1"))


def pyramid_level(bbox: DataFrame, levels: DataFrame, max_side: int, keys: Sequence[str] = ("polygon_id",)) -> DataFrame:
    """First level coarse enough for the box, else the coarsest.

    ``levels(level, width, height)`` describes one image: a handful of rows.
    """
    base = levels.agg(F.max("width").alias("w"), F.max("height").alias("h")).select(F.struct("w", "h")).scalar()
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1))
    target = F.greatest(side / F.lit(max(float(max_side), 1.0)), F.lit(1.0))
    table = levels.select("level", (base["w"] / F.col("width")).alias("sx"), (base["h"] / F.col("height")).alias("sy"))
    ladder = table.agg(F.array_sort(F.collect_list(F.struct("level", "sx", "sy")))).scalar()
    with_ladder = bbox.withColumn("_target", target).withColumn("_ladder", ladder)
    fit = F.filter("_ladder", lambda v: F.greatest(v["sx"], v["sy"]) >= F.col("_target"))
    pick = F.coalesce(F.get(fit, F.lit(0)), F.element_at("_ladder", -1))
    return with_ladder.withColumn("_l", pick).select(*keys, "x0", "y0", "x1", "y1", "_l.level", F.col("_l.sx").alias("scale_x"), F.col("_l.sy").alias("scale_y"))


def crop(bbox: DataFrame, width: int, height: int) -> DataFrame:
    """Box clamped to the image, with ``error`` when nothing is left."""
    c = (bbox.withColumn("x0", F.greatest("x0", F.lit(0))).withColumn("y0", F.greatest("y0", F.lit(0)))
         .withColumn("x1", F.least("x1", F.lit(width))).withColumn("y1", F.least("y1", F.lit(height))))
    return c.withColumn("error", F.when((F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")), "contour box does not meet the image"))


def scanline_spans(vertices: DataFrame) -> DataFrame:
    """``(polygon_id, part, py, px0, px1)``: runs of pixels, ends included, whose centres are inside a part.

    ``vertices(polygon_id, part, ring, seq, x, y)``, rings open or closed. Each edge gives its
    crossing with the middle of every pixel row that it passes; in a row the crossings, in
    order, open and close in turns, holes included (even-odd). The work is that of the edges' rows
    and of the runs: no pixel is tested against an edge.
    """
    along = Window.partitionBy("polygon_id", "part", "ring").orderBy("seq")
    end = F.struct("x", "y")
    edges = (vertices.withColumn("_b", F.coalesce(F.lead(end).over(along), F.first(end).over(along)))
             .select("polygon_id", "part", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("_b.x").alias("bx"), F.col("_b.y").alias("by")))
    low, high = F.ceil(F.least("ay", "by") - 0.5), F.ceil(F.greatest("ay", "by") - 0.5) - 1
    rows = edges.where(low <= high).withColumn("py", F.explode(F.sequence(low, high)))
    at = F.col("ax") + (F.col("py") + 0.5 - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    across = Window.partitionBy("polygon_id", "part", "py").orderBy("at")
    runs = rows.select("polygon_id", "part", "py", at.alias("at")).select("polygon_id", "part", "py", "at", F.lead("at").over(across).alias("to"), F.row_number().over(across).alias("k"))
    first, last = F.ceil(F.col("at") - 0.5), F.ceil(F.col("to") - 0.5) - 1
    return runs.where((F.col("k") % 2 == 1) & (first <= last)).select("polygon_id", "part", F.col("py").cast("int").alias("py"), first.cast("int").alias("px0"), last.cast("int").alias("px1"))


def masked_pixels(pixels: DataFrame, vertices: DataFrame, tile: float = 64.0) -> DataFrame:
    """Pixels inside each polygon's box, zero outside the outline: ``(polygon_id, px, py, r, g, b, inside)``.

    ``pixels(px, py, r, g, b)``; a pixel counts by its centre. Boxes meet pixels through tiles,
    outlines as runs of pixels. Tiles and runs are exploded, which Spark's sizes do not see: it
    would send them whole through the driver, so both joins are merged.
    """
    box = polygon_bbox(vertices)

    def cell(c):
        return F.floor(F.col(c) / F.lit(tile)).cast("bigint")
    cover = (box.withColumn("tx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("ty", F.explode(F.sequence(cell("y0"), cell("y1")))))
    boxed = (pixels.withColumn("tx", cell("px")).withColumn("ty", cell("py")).join(cover.hint("merge"), ["tx", "ty"])
             .filter("px >= x0 AND px < x1 AND py >= y0 AND py < y1").select("polygon_id", "px", "py", "r", "g", "b"))
    hit = scanline_spans(vertices).select("polygon_id", F.explode(F.sequence("px0", "px1")).alias("px"), "py").distinct().withColumn("inside", F.lit(True))
    out = boxed.join(hit.hint("merge"), ["polygon_id", "px", "py"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    return out.select("polygon_id", "px", "py", *[F.when(F.col("inside"), F.col(c)).otherwise(0).alias(c) for c in ("r", "g", "b")], "inside")


def pixel_quality(pixels: DataFrame, keys: Sequence[str] = ("patch_id",)) -> DataFrame:
    """Width, height, mean grey and share of non-black pixels per patch."""
    grey = F.floor((F.col("r") * 19595 + F.col("g") * 38470 + F.col("b") * 7471 + 32768) / 65536)
    return pixels.groupBy(*keys).agg((F.max("px") - F.min("px") + 1).alias("width"), (F.max("py") - F.min("py") + 1).alias("height"),
                                     F.avg(grey).alias("mean_intensity"), F.avg((grey > 3).cast("double")).alias("nonzero_fraction"),
                                     F.avg((F.col("r") + F.col("g") + F.col("b") > 3).cast("double")).alias("nonzero_rgb_fraction"))


def stretch_to_byte(pixels: DataFrame, value: str, keys: Sequence[str] = ("patch_id",)) -> DataFrame:
    """Values stretched between their 1st and 99th percentile to 0..255 per patch."""
    q = exact_quantiles(pixels, keys, value, {"_lo": 0.01, "_hi": 0.99})
    hi = F.when(F.col("_hi") <= F.col("_lo"), F.col("_lo") + 1.0).otherwise(F.col("_hi"))
    part = F.greatest(F.least((F.col(value) - F.col("_lo")) / (hi - F.col("_lo")), F.lit(1.0)), F.lit(0.0))
    return pixels.join(q, list(keys)).withColumn(value, F.floor(part * 255.0).cast("int")).drop("_lo", "_hi")


def preview_sample(cells: DataFrame, id_: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of ``n`` cells: the smallest MD5 digests of id and seed (all when there are fewer)."""
    return cells.orderBy(F.md5(F.concat_ws(":", F.col(id_).cast("string"), F.lit(str(seed))).cast("binary")), id_).limit(n)
