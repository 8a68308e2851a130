"""Neighbourhoods, distances, orientation and containment of cells.

Definitions of our own (the published tables give results, not formulas) are marked "ours".
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.lineage import materialize
from . import tiles
from .ranking import exact_quantiles

CASE = "case_id"
#: Places of a searching block of circle sums, at most.
WIDEST = 1 << 17


def with_case(df: DataFrame) -> DataFrame:
    return df if CASE in df.columns else df.withColumn(CASE, F.lit("case"))


def distinct_places(cells: DataFrame, label: str) -> DataFrame:
    """One row per case, label and coordinate, with the number of cells there."""
    return cells.groupBy(CASE, label, "x", "y").agg(F.count("*").cast("double").alias("weight"))


def nearest_of_group(cells: DataFrame, targets: DataFrame, group: str, target_group: str = "target") -> DataFrame:
    """``(case_id, cell_id, target, d)``: distance to the nearest target of every target group."""
    a = tiles.pack(with_case(cells).select(CASE, "cell_id", "x", "y"), [CASE], block=tiles.SEARCH)
    b = tiles.pack(with_case(targets).select(CASE, F.col(group).alias(target_group), "x", "y").distinct(), [CASE, target_group])
    return tiles.nearest(a, b, [CASE], [CASE, "cell_id"])


def searcher_findee_distance(cells: DataFrame, label: str = "cluster") -> DataFrame:
    """Mean distance from the cells of one label to the nearest cell of another (ours), per case.

    Long form ``(case_id, a, b, d)``. Cells at one place are searched for once. The matrix is
    kept, as trees and rankings read it several times and each reading would search again.
    """
    places = distinct_places(with_case(cells), label)
    a = tiles.pack(places.select(CASE, F.col(label).alias("a"), "x", "y", "weight"), [CASE], block=tiles.SEARCH)
    b = tiles.pack(places.select(CASE, F.col(label).alias("b"), "x", "y"), [CASE, "b"])
    near = tiles.nearest(a, b, [CASE], [CASE, "a", "x", "y", "weight"])
    return materialize(near.groupBy(CASE, "a", "b").agg((F.sum(F.col("d") * F.col("weight")) / F.sum("weight")).alias("d")))


def symmetric_distance(matrix: DataFrame) -> DataFrame:
    """Mean of both directions for each unordered pair of different labels."""
    return (matrix.filter("a <> b").groupBy(CASE, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .agg(F.avg("d").alias("d")))


def radius_neighbors(cells: DataFrame, r: float) -> DataFrame:
    """Pairs of different cells within ``r``: ``(case_id, cell_id, near_cell_id, d)``, each pair both ways."""
    c = with_case(cells).select(CASE, "cell_id", "x", "y")
    pairs = tiles.radius_pairs(tiles.pack(c, [CASE], block=tiles.SEARCH), tiles.pack(c, [CASE]), [CASE], r, [CASE, "cell_id"], ["cell_id"])
    return pairs.filter("cell_id <> b_cell_id").select(CASE, "cell_id", F.col("b_cell_id").alias("near_cell_id"), "d")


def neighborhood_sums(cells: DataFrame, values: Sequence[str], radii: Sequence[float], group: str | None = None) -> DataFrame:
    """Sums of ``values`` over the cells around each place, the place itself included.

    Returns ``(case_id, x, y, [group,] radius, values…)``: cells at one place share a row. The more
    cells there are, the wider a searching block, up to ``WIDEST`` places: what surrounds it is sent to it.
    """
    by = [CASE] + ([group] if group else [])
    block = min(WIDEST, max(4 * tiles.SEARCH, cells.count() // (8 * cells.sparkSession.sparkContext.defaultParallelism)))
    at = with_case(cells).groupBy(*by, "x", "y").agg(*[F.sum(v).alias(v) for v in values])
    b = tiles.pack(at, by, values)
    a = tiles.pack(at.select(CASE, "x", "y").distinct(), [CASE], block=block)
    return tiles.radius_sums(a, b, [CASE], [CASE, "x", "y"], radii)


def neighbor_counts(cells: DataFrame, radii: Sequence[float]) -> DataFrame:
    """Number of other cells within each radius of every cell."""
    c = with_case(cells).withColumn("_one", F.lit(1).cast("bigint"))
    sums = neighborhood_sums(c, ["_one"], radii)
    return (c.select(CASE, "cell_id", "x", "y").join(sums, [CASE, "x", "y"])
            .select(CASE, "cell_id", "radius", (F.col("_one") - 1).alias("neighbors")))


def axis_strength_by_radius(cells: DataFrame, radii: Sequence[float], angle: str = "angle", group: str = "group") -> DataFrame:
    """Agreement of axes around each cell, per group and radius.

    Ours: coherence is the length of the mean doubled-angle vector of the other cells in
    the circle, ANE is that vector's sum; the density is ANE over the area of the circle.
    """
    c = (with_case(cells).withColumn("_c", F.cos(F.col(angle) * 2)).withColumn("_s", F.sin(F.col(angle) * 2))
         .withColumn("_n", F.lit(1).cast("bigint")))
    sums = neighborhood_sums(c, ["_n", "_c", "_s"], radii)
    own = c.select(CASE, "x", "y", F.col(group).alias("group"), F.col("_c").alias("oc"), F.col("_s").alias("os"))
    rows = own.join(sums, [CASE, "x", "y"]).select(
        "group", "radius", (F.col("_n") - 1).alias("neigh"), F.round(F.hypot(F.col("_c") - F.col("oc"), F.col("_s") - F.col("os")), 9).alias("ANE"))
    # one unpivoted table, so the values are sorted across the cluster once
    rows = materialize(rows).select("group", "radius", F.explode(F.array(
        F.struct(F.lit("coh").alias("m"), F.when(F.col("neigh") > 0, F.col("ANE") / F.col("neigh")).alias("v")),
        F.struct(F.lit("neigh").alias("m"), F.col("neigh").cast("double").alias("v")),
        F.struct(F.lit("ANE").alias("m"), F.when(F.col("neigh") > 0, F.col("ANE")).alias("v")))).alias("e")).select("group", "radius", "e.m", "e.v")
    q = exact_quantiles(rows, ["group", "radius", "m"], "v", {"median": 0.5, "q25": 0.25, "q75": 0.75})
    wide = [F.max(F.when(F.col("m") == m, F.col(s))).alias(f"{m}_{s}") for m in ("coh", "neigh", "ANE") for s in ("median", "q25", "q75")]
    out = q.groupBy("group", "radius").agg(*wide)
    area = F.col("radius") * F.col("radius") * math.pi
    for s in ("median", "q25", "q75"):
        out = out.withColumn(f"ANE_density_{s}", F.col(f"ANE_{s}") / area)
    return out.withColumnRenamed("radius", "radius_um")


def fisher_kappa(r: Column) -> Column:
    """Concentration of doubled angles from their mean resultant length."""
    small = 2 * r + F.pow(r, 3) + 5 * F.pow(r, 5) / 6
    middle = -0.4 + 1.39 * r + 0.43 / (1 - r)
    large = 1 / (F.pow(r, 3) - 4 * F.pow(r, 2) + 3 * r)
    return F.when(r < 0.53, small).when(r < 0.85, middle).when(r < 1, large).otherwise(F.lit(float("inf")))


def rayleigh_p(n: Column, r: Column, exact_below: int = 50) -> Column:
    """P value of the Rayleigh test, with the small-sample correction below 50 angles."""
    z = n * r * r
    fix = 1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z * z + 76 * F.pow(z, 3) - 9 * F.pow(z, 4)) / (288 * n * n)
    return F.exp(-z) * F.when(n < exact_below, fix).otherwise(1.0)


def axial_mean(angle: str) -> tuple[Column, Column]:
    """(mean cos, mean sin) of doubled angles as aggregates."""
    return F.avg(F.cos(F.col(angle) * 2)), F.avg(F.sin(F.col(angle) * 2))


def orientation_summary(cells: DataFrame, angle: str = "angle", group: str = "group", local_k: int | None = None) -> DataFrame:
    """Axial statistics per group; with ``local_k`` also of the nearest neighbours' axes."""
    c, s = axial_mean(angle)
    out = (cells.groupBy(F.col(group).alias("group")).agg(F.count(angle).alias("n_axes"), c.alias("_c"), s.alias("_s"))
           .withColumn("axial_rbar", F.hypot("_c", "_s"))
           .withColumn("mean_axis_degrees", F.pmod(F.degrees(F.atan2("_s", "_c")) / 2, F.lit(180.0))))
    out = (out.withColumn("kappa", fisher_kappa(F.col("axial_rbar"))).withColumn("rayleigh_p", rayleigh_p(F.col("n_axes"), F.col("axial_rbar")))
           .drop("_c", "_s"))
    if local_k is None:
        return out
    p = tiles.pack(with_case(cells).select(CASE, "cell_id", "x", "y", F.col(angle).alias("angle"), F.col(group).alias("group")), [CASE])
    near = tiles.k_nearest(p, [CASE], "cell_id", local_k, ["angle"])
    lc, ls = axial_mean("angle")
    local = near.groupBy(CASE, "cell_id").agg(F.round(F.hypot(lc, ls), 9).alias("r"))
    local = materialize(local.join(with_case(cells).select(CASE, "cell_id", F.col(group).alias("group")), [CASE, "cell_id"]))
    q = exact_quantiles(local, ["group"], "r", {"local_rbar_median": 0.5, "local_rbar_q25": 0.25, "local_rbar_q75": 0.75})
    return out.join(q, "group")


def polarity_summary(cells: DataFrame, dx: str, dy: str, size: str, threshold: float = 0.3, by: Sequence[str] = ()) -> DataFrame:
    """Cells whose offset relative to their size exceeds the threshold, with medians."""
    rows = cells.withColumn("_d", F.hypot(dx, dy)).withColumn("_norm", F.try_divide(F.col("_d"), F.col(size)))
    counts = rows.groupBy(*by).agg(F.count("_norm").alias("n_cells"), F.count_if(F.col("_norm") > threshold).alias("n_polarized"),
                                   F.avg((F.col("_norm") > threshold).cast("double")).alias("polarized_fraction"))
    norm = exact_quantiles(rows, by, "_norm", {"offset_norm_median": 0.5})
    dist = exact_quantiles(rows, by, "_d", {"offset_distance_median_um": 0.5})
    if by:
        return counts.join(norm, list(by)).join(dist, list(by))
    return counts.select("*", norm.scalar().alias("offset_norm_median"), dist.scalar().alias("offset_distance_median_um"))


def tumor_stroma_growth(cells: DataFrame, tumor: str, stroma: str, radius: float, label: str = "cluster") -> DataFrame:
    """Split of tumour cells into infiltrating and expanding, with distances to stroma.

    Ours: a cell infiltrates when its circle holds at least as many stroma cells as other
    tumour cells and at least one; it is valid when the case has stroma.
    """
    c = with_case(cells).filter(F.col(label).isin(tumor, stroma))
    c = (c.withColumn("_t", (F.col(label) == tumor).cast("bigint")).withColumn("_s", (F.col(label) == stroma).cast("bigint")))
    t = c.filter("_t = 1").select(CASE, "cell_id", "x", "y")
    around = neighborhood_sums(c, ["_t", "_s"], [radius])
    near = nearest_of_group(t, c.filter("_s = 1").withColumn("target", F.lit("stroma")), "target")
    rows = (t.join(around, [CASE, "x", "y"]).join(near.select(CASE, "cell_id", "d"), [CASE, "cell_id"], "left")
            .withColumn("_inf", (F.col("_s") > 0) & (F.col("_s") >= F.col("_t") - 1)))
    valid = F.col("d").isNotNull()
    return rows.groupBy(CASE).agg(
        F.count("*").alias("n_tumor"), F.count_if(valid & F.col("_inf")).alias("n_infiltrative"), F.count_if(valid & ~F.col("_inf")).alias("n_expanding"),
        F.count_if(valid).alias("n_tumor_valid"), F.avg(F.when(valid, F.col("_inf").cast("double"))).alias("infiltrative_proportion"),
        F.avg(F.when(F.col("_inf"), F.col("d"))).alias("mean_infil_dist_to_stromal"), F.avg(F.when(~F.col("_inf"), F.col("d"))).alias("mean_expand_dist_to_stromal"))


def best_celltype(matrix: DataFrame, entity: str = "entity", celltype: str = "celltype") -> DataFrame:
    """Nearest cell type per entity and its distance."""
    return matrix.groupBy(entity).agg(F.min_by(celltype, F.struct("d", celltype)).alias("best_celltype"), F.min("d").alias("best_distance"))


def acceptance_checks(matrix: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected against observed nearest cell type, with the rank of the expected one."""
    ranked = matrix.withColumn("rank", F.rank().over(Window.partitionBy("entity").orderBy("d")))
    return (expected.join(best_celltype(matrix), "entity", "left")
            .join(ranked.select("entity", F.col("celltype").alias("expected_celltype"), F.col("d").alias("expected_distance"), "rank"),
                  ["entity", "expected_celltype"], "left")
            .withColumn("passed", F.coalesce(F.col("best_celltype") == F.col("expected_celltype"), F.lit(False))))


def ranked_lr_pairs(ligands: DataFrame, receptors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sender and receiver cell types per ligand-receptor pair, closest topology first.

    ``ligands/receptors(entity, celltype, d)``, ``pairs(ligand, receptor)``. Ours: the
    score is ``(1 - d_ligand) * (1 - d_receptor)``. Both sides are joined on the pair.
    """
    left = pairs.join(ligands.select(F.col("entity").alias("ligand"), F.col("celltype").alias("sender"), F.col("d").alias("d_ligand")), "ligand")
    right = receptors.select(F.col("entity").alias("receptor"), F.col("celltype").alias("receiver"), F.col("d").alias("d_receptor"))
    scored = left.join(right, "receptor").withColumn("score", (1 - F.col("d_ligand")) * (1 - F.col("d_receptor")))
    w = Window.partitionBy("ligand", "receptor").orderBy(F.desc("score"), "sender", "receiver")
    return scored.withColumn("rank", F.rank().over(w))


#: Polygons of a tile that a task holds at a time, and points it tests at a time.
HELD, TESTED = 4096, 1 << 13


def _inside(id_: str):
    """Streams the points of each tile past the edges of its polygons, which come before them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, edges, shapes = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in (CASE, "tx", "ty", "salt"))))
            kind = np.asarray(batch.column("kind"))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or kind[i] != kind[i - 1]), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if keys[i] != key:
                    key, edges, shapes = keys[i], [], None
                part = batch.slice(i, j - i)
                if kind[i] == 0:
                    edges.append(part.select(["polygon_id", "part", "ax", "ay", "bx", "by"]))
                    continue
                if shapes is None:
                    shapes = _shapes(pa.Table.from_batches(edges)) if edges else []
                    edges = []
                x, y = (np.asarray(part.column(c)) for c in ("ax", "ay"))
                for at in range(0, len(x), TESTED):
                    px, py = x[at:at + TESTED], y[at:at + TESTED]
                    for polygon, rings in shapes:
                        hit = np.zeros(len(px), bool)
                        for ax, ay, bx, by in rings:
                            odd = np.zeros(len(px), bool)
                            low, high = min(ay.min(), by.min()), max(ay.max(), by.max())
                            near = np.flatnonzero((py >= low) & (py < high) & (px < max(ax.max(), bx.max())))
                            step = max(1, (1 << 18) // max(1, len(near)))
                            for e in range(0, len(ax), step):
                                cx, cy, dx, dy = (v[e:e + step] for v in (ax, ay, bx, by))
                                spans = (cy > py[near, None]) != (dy > py[near, None])
                                crossing = cx + (py[near, None] - cy) / (dy - cy) * (dx - cx)
                                odd[near] ^= (spans & (px[near, None] < crossing)).sum(axis=1) % 2 == 1
                            hit |= odd
                        rows = np.flatnonzero(hit)
                        if len(rows):
                            yield pa.RecordBatch.from_pydict({CASE: pa.array([key[0]] * len(rows), batch.schema.field(CASE).type), id_: part.column(id_).take(pa.array(rows + at)),
                                                              "polygon_id": pa.array([polygon] * len(rows), batch.schema.field("polygon_id").type)})
    return run


def _shapes(edges: pa.Table) -> list:
    """Each polygon with the edges of its parts, from rows sorted by polygon and part."""
    found: list = []
    names, parts = edges.column("polygon_id").to_pylist(), edges.column("part").to_pylist()
    columns = [np.asarray(edges.column(c)) for c in ("ax", "ay", "bx", "by")]
    cuts = [0, *(i for i in range(1, len(names)) if (names[i], parts[i]) != (names[i - 1], parts[i - 1])), len(names)]
    for i, j in zip(cuts, cuts[1:]):
        if not found or found[-1][0] != names[i]:
            found.append((names[i], []))
        found[-1][1].append([c[i:j] for c in columns])
    return found


def point_in_polygon(points: DataFrame, vertices: DataFrame, tile: float, id_: str = "cell_id") -> DataFrame:
    """``(case_id, cell_id, polygon_id)`` for points inside a polygon and outside its holes.

    ``vertices(case_id, polygon_id, part, ring, seq, x, y)``; rings may be open or closed,
    ring 0 is the outline. Each ring edge is listed in the tiles that it can matter in: those of
    the horizontal strips it crosses that its polygon's box covers, up to its right end. The
    polygons of a tile are dealt out by at most ``HELD`` on average; a task holds their edges and streams the
    tile's points past them, so that pairs leave it as they are found and are not shuffled.
    An odd number of edges to its right means inside a part, as holes flip the same count;
    a point in any part is in the polygon. ``seq`` orders a ring and may have gaps.
    """
    v = with_case(vertices).withColumn("x", F.col("x").cast("double")).withColumn("y", F.col("y").cast("double"))
    ring = [CASE, "polygon_id", "part", "ring"]
    box = v.groupBy(CASE, "polygon_id").agg(F.min("x").alias("x0"))

    def cell(c):
        return F.floor(c / F.lit(float(tile))).cast("bigint")
    # the successor of a vertex is the next in its ring, the last goes back to the first
    along = Window.partitionBy(*ring).orderBy("seq")
    end = F.struct("x", "y")
    edges = (v.withColumn("_b", F.coalesce(F.lead(end).over(along), F.first(end).over(along)))
             .select(CASE, "polygon_id", "part", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("_b.x").alias("bx"), F.col("_b.y").alias("by"))
             .filter(F.col("ay") != F.col("by")).join(box, [CASE, "polygon_id"]))
    edges = (edges.withColumn("tx", F.explode(F.sequence(cell(F.col("x0")), cell(F.greatest("ax", "bx")))))
             .withColumn("ty", F.explode(F.sequence(cell(F.least("ay", "by")), cell(F.greatest("ay", "by"))))).drop("x0"))
    edges = materialize(edges)
    where = [CASE, "tx", "ty"]
    full = edges.groupBy(*where).agg(F.ceil(F.count_distinct("polygon_id") / HELD).cast("int").alias("salts"))
    full = materialize(full)
    kind = dict(points.dtypes)[id_]
    salt = F.pmod(F.xxhash64("polygon_id"), F.col("salts")).cast("int").alias("salt")
    left = edges.join(full, where).select(*where, salt, F.lit(0).alias("kind"), "polygon_id", "part", "ax", "ay", "bx", "by", F.lit(None).cast(kind).alias(id_))
    p = with_case(points).select(CASE, id_, F.col("x").cast("double").alias("ax"), F.col("y").cast("double").alias("ay"), cell(F.col("x")).alias("tx"), cell(F.col("y")).alias("ty"))
    right = p.join(full, where).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("kind", F.lit(1)).drop("salts")
    rows = left.unionByName(right, allowMissingColumns=True).repartition(*where, "salt").sortWithinPartitions(*where, "salt", "kind", "polygon_id", "part")
    out = StructType([rows.schema[CASE], StructField(id_, points.schema[id_].dataType), rows.schema["polygon_id"]])
    return rows.mapInArrow(_inside(id_), out)


def zscore_projection(labels: DataFrame, cells: DataFrame, min_matched: float = 0.5) -> DataFrame:
    """Two axes per barcode: standardised coordinates, or a circle by label when coordinates are missing.

    ``labels(barcode, cluster)``, ``cells(barcode, x, y)``.
    """
    from ..functions import scalars as S
    from .align import join_with_stem_fallback
    merged = join_with_stem_fallback(labels, cells, min_matched=min_matched)
    stats = merged.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"),
                       F.avg(F.col("x").isNotNull().cast("double")).alias("m"))
    row = stats.first()
    if (row["m"] or 0.0) >= min_matched:
        sx, sy = ((s if s and not math.isnan(s) else 1.0) for s in (row["sx"], row["sy"]))
        return merged.select("barcode", ((F.col("x") - row["mx"]) / sx).alias("axis_1"), (-(F.col("y") - row["my"]) / sy).alias("axis_2"))
    names = labels.select("cluster").distinct()
    ordered = names.agg(F.array_sort(F.collect_list("cluster"))).scalar()
    angle = (F.array_position(ordered, F.col("cluster")) - 1) * 2 * math.pi / F.size(ordered)
    jx, jy = S.stable_jitter("barcode")
    return labels.select("barcode", (F.cos(angle) + jx).alias("axis_1"), (F.sin(angle) + jy).alias("axis_2"))
