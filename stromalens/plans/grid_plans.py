"""Grid, partition and outline operators bound to the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components as C, grid as G, specs
from ..operators.spatial import CASE, with_case
from .bindings import CELLS, GROUPS_TEXT, STRUCTURE_OF, cells, structure_of, table
from .registry import plan
from .spatial_plans import squares

CFG = G.PartitionConfig(bins_x=90, bins_y=70, min_cells=200, min_component_pixels=12, min_tissue_pixels=40, min_fallback_pixels=6)
FINE = (200, 180)    # mostly empty pixels, small components
COARSE = (100, 90)   # mostly set pixels, small holes


def BIN(v, lo, hi, n):
    step = f"(({hi} - {lo}) / {n})"
    guess = f"greatest(least(CAST(floor(({v} - {lo}) / {step}) AS INTEGER), {n - 1}), 0)"
    return (f"greatest(least(CASE WHEN {v} < {guess} * {step} + {lo} THEN {guess} - 1 WHEN {v} >= ({guess} + 1) * {step} + {lo} THEN {guess} + 1 "
            f"ELSE {guess} END, {n - 1}), 0)")


def BINNED(w, h):
    return f"""{CELLS}, b AS (SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM cells),
 binned AS (SELECT cell_id, {STRUCTURE_OF('cluster')} AS structure_id, {BIN('x', 'x_min', 'x_max', w)} AS ix, {BIN('y', 'y_min', 'y_max', h)} AS iy FROM cells, b)"""


def _cells(spark, sf):
    c = with_case(cells(spark, sf))
    return c.select(CASE, "cell_id", "x", "y", structure_of("cluster").alias("structure_id"))


def _binned(spark, sf, w, h):
    c = _cells(spark, sf)
    return G.with_bins(c, G.extent(c), w, h)


@plan("histogram2d", f"WITH {BINNED(90, 70)} SELECT structure_id, ix, iy, count(*) AS n FROM binned GROUP BY 1, 2, 3")
def histogram2d(spark, sf):
    return G.histogram2d(_binned(spark, sf, 90, 70), ["structure_id"]).drop(CASE)


def MIRROR(c, n):
    m = f"((({c}) % {2 * n} + {2 * n}) % {2 * n})"
    return f"CAST(CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 1} - {m} END AS INTEGER)"


KERNEL = "kernel(i, w) AS (VALUES " + ", ".join(f"({i}, {w!r}::DOUBLE)" for i, w in G.gaussian_kernel(2.25)) + ")"
DENSITY = f"""{BINNED(90, 70)}, {KERNEL}, hist AS (SELECT structure_id, ix, iy, count(*) AS n FROM binned GROUP BY 1, 2, 3),
 px AS (SELECT structure_id, iy, {MIRROR('ix + i', 90)} AS ix, sum(n * w) AS v FROM hist, kernel GROUP BY 1, 2, 3),
 density AS (SELECT structure_id, ix, {MIRROR('iy + i', 70)} AS iy, sum(v * w) AS density FROM px, kernel GROUP BY 1, 2, 3),
 structures AS (SELECT structure_id, (SELECT count(*) FROM binned x WHERE x.structure_id = d.structure_id) AS cells, quantile_cont(density, 0.98) FILTER (density > 0) AS scale,
   quantile_cont(density, 0.18) FILTER (density > 0) AS support FROM density d GROUP BY 1),
 shares AS (SELECT structure_id, ix, iy, density, density / scale / (sum(density / scale) OVER (PARTITION BY ix, iy) + 1e-12) AS posterior,
   sum(density) OVER (PARTITION BY ix, iy) AS total FROM density JOIN structures USING (structure_id)),
 post AS (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY posterior DESC, structure_id) = 1 AS dominant FROM shares)"""


@plan("gaussian_smooth", f"WITH {DENSITY} SELECT structure_id, ix, iy, round(density, 6) AS density FROM density")
def gaussian_smooth(spark, sf):
    h = G.histogram2d(_binned(spark, sf, 90, 70), ["structure_id"])
    return G.gaussian_smooth(h, ["structure_id"], "n", 2.25, 90, 70).withColumn("density", F.round("density", 6))


@plan("positive_quantiles", f"""WITH {DENSITY} SELECT structure_id, round(scale, 6) AS scale, round(support, 6) AS support,
  round(quantile_cont(density, 0.06), 6) AS tissue, round(quantile_cont(density, 0.995), 6) AS proxy FROM density JOIN structures USING (structure_id) WHERE density > 0 GROUP BY ALL""")
def positive_quantiles(spark, sf):
    h = G.histogram2d(_binned(spark, sf, 90, 70), ["structure_id"])
    d = G.gaussian_smooth(h, ["structure_id"], "n", 2.25, 90, 70)
    q = G.positive_quantiles(d, ["structure_id"], {"scale": 0.98, "support": 0.18, "tissue": 0.06, "proxy": 0.995})
    return q.select("structure_id", *[F.round(c, 6).alias(c) for c in ("scale", "support", "tissue", "proxy")])


def _density(spark, sf):
    return G.normalize_density(_binned(spark, sf, 90, 70), CFG)


@plan("normalize_density", f"WITH {DENSITY} SELECT structure_id, cells, round(scale, 6) AS scale, round(support, 6) AS support FROM structures")
def normalize_density(spark, sf):
    return _density(spark, sf)[1].select("structure_id", "cells", F.round("scale", 6).alias("scale"), F.round("support", 6).alias("support"))


@plan("dominance_posterior", f"WITH {DENSITY} SELECT structure_id, ix, iy, round(posterior, 6) AS posterior, dominant FROM post")
def dominance_posterior(spark, sf):
    return G.posterior(*_density(spark, sf)).select("structure_id", "ix", "iy", F.round("posterior", 6).alias("posterior"), "dominant")


@plan("exclusive_seed", f"""WITH {DENSITY}, s AS (SELECT structure_id, ix, iy, posterior FROM post JOIN structures USING (structure_id) WHERE density >= support)
  SELECT arg_min(structure_id, -posterior) AS structure_id, ix, iy FROM s GROUP BY ix, iy""")
def exclusive_seed(spark, sf):
    density, structures = _density(spark, sf)
    post = G.posterior(density, structures)
    seeds = post.filter("density >= support").select(CASE, "structure_id", "ix", "iy")
    # the winner among claimants, as all structures above support claim a pixel here
    claimed = post.join(seeds, [CASE, "structure_id", "ix", "iy"], "left_semi")
    return G.exclusive_seed(seeds, claimed, 1, 90).select("structure_id", "ix", "iy")


def _mask(spark, sf, size):
    return _binned(spark, sf, *size).select("ix", "iy").distinct()


def MASK(size):
    return f"{BINNED(*size)}, mask AS (SELECT DISTINCT ix, iy FROM binned)"


def _diamond(n):
    return "(VALUES " + ", ".join(f"({dx}, {dy})" for dx, dy in C.diamond(n)) + ") o(dx, dy)"


@plan("binary_close", f"""WITH {MASK(FINE)}, wide AS (SELECT DISTINCT ix + dx AS ix, iy + dy AS iy FROM mask, {_diamond(2)} WHERE ix + dx BETWEEN 0 AND 199 AND iy + dy BETWEEN 0 AND 179)
  SELECT ix + dx AS ix, iy + dy AS iy FROM wide, {_diamond(2)} GROUP BY 1, 2 HAVING count(*) = 13""")
def binary_close(spark, sf):
    return C.binary_close(_mask(spark, sf, FINE), [], 2, *FINE)


@plan("binary_open", f"""WITH {MASK(COARSE)}, core AS (SELECT ix + dx AS ix, iy + dy AS iy FROM mask, {_diamond(1)} GROUP BY 1, 2 HAVING count(*) = 5)
  SELECT DISTINCT ix + dx AS ix, iy + dy AS iy FROM core, {_diamond(1)} WHERE ix + dx BETWEEN 0 AND 99 AND iy + dy BETWEEN 0 AND 89""")
def binary_open(spark, sf):
    return C.binary_open(_mask(spark, sf, COARSE), [], 1, *COARSE)


_NEXT = "(VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy)"


def REACH(pixels, w):
    """Pixels reachable over 4-neighbours and the smallest position among them."""
    return f"""adj AS (SELECT p.ix, p.iy, q.ix AS nx, q.iy AS ny FROM {pixels} p, {_NEXT} JOIN {pixels} q ON q.ix = p.ix + dx AND q.iy = p.iy + dy),
 reach AS (SELECT iy * {w} + ix AS root, ix, iy FROM {pixels} UNION SELECT root, nx, ny FROM reach JOIN adj USING (ix, iy)),
 comp AS (SELECT ix, iy, CAST(min(root) AS INTEGER) AS component FROM reach GROUP BY 1, 2)"""


@plan("connected_components", f"WITH RECURSIVE {MASK(FINE)}, {REACH('mask', 200)} SELECT ix, iy, component FROM comp")
def connected_components(spark, sf):
    return C.label_components(_mask(spark, sf, FINE), [], FINE[0]).select("ix", "iy", F.col("component").cast("int").alias("component"))


@plan("remove_small_components", f"""WITH RECURSIVE {MASK(FINE)}, {REACH('mask', 200)}
  SELECT ix, iy FROM comp WHERE component IN (SELECT component FROM comp GROUP BY 1 HAVING count(*) >= 5)""")
def remove_small_components(spark, sf):
    return C.remove_small_components(_mask(spark, sf, FINE), [], 5, FINE[0])


@plan("fill_holes", f"""WITH RECURSIVE {MASK(COARSE)}, back AS (SELECT CAST(x.i AS INTEGER) AS ix, CAST(y.i AS INTEGER) AS iy FROM range(100) x(i), range(90) y(i)
    WHERE (x.i, y.i) NOT IN (SELECT ix, iy FROM mask)), {REACH('back', 100)}
  SELECT ix, iy FROM mask UNION ALL SELECT ix, iy FROM comp WHERE component NOT IN (SELECT component FROM comp WHERE ix IN (0, 99) OR iy IN (0, 89))""")
def fill_holes(spark, sf):
    return C.fill_holes(_mask(spark, sf, COARSE), [], *COARSE)


LABELS = f"""{BINNED(90, 70)}, c AS (SELECT structure_id, ix, iy, count(*) AS n FROM binned GROUP BY 1, 2, 3),
 labels AS (SELECT ix, iy, CAST(first(structure_id ORDER BY n DESC, structure_id) AS INTEGER) AS label FROM c GROUP BY 1, 2)"""


def _labels(spark, sf):
    c = G.histogram2d(_binned(spark, sf, 90, 70), ["structure_id"])
    return c.groupBy(CASE, "ix", "iy").agg(F.min_by("structure_id", F.struct(-F.col("n"), "structure_id")).alias("structure_id"))


@plan("grid_lookup", f"""WITH {LABELS} SELECT cell_id, CASE WHEN label = 2 THEN 0 ELSE label END AS partition_structure_id,
  CASE WHEN label = 2 THEN 'unassigned' ELSE 'Structure ' || label END AS partition_structure_name FROM binned JOIN labels USING (ix, iy)""")
def grid_lookup(spark, sf):
    labels = _labels(spark, sf).filter("structure_id <> 2")
    d = G.grid_lookup(_binned(spark, sf, 90, 70), labels, specs.structure_spec(spark, GROUPS_TEXT))
    return d.select("cell_id", "partition_structure_id", "partition_structure_name")


@plan("nearest_seed", f"""WITH {LABELS}, seeds AS (SELECT * FROM labels JOIN (SELECT ix, iy, sum(n) AS t FROM c GROUP BY 1, 2) USING (ix, iy) WHERE t >= 5),
   bare AS (SELECT ix, iy FROM labels WHERE (ix, iy) NOT IN (SELECT ix, iy FROM seeds)),
   d AS (SELECT a.ix, a.iy, label, (a.ix - s.ix) * (a.ix - s.ix) + (a.iy - s.iy) * (a.iy - s.iy) AS d2 FROM bare a, seeds s)
  SELECT ix, iy, first(label ORDER BY d2, label) AS structure_id, round(sqrt(min(d2)), 6) AS d FROM d GROUP BY 1, 2""")
def nearest_seed(spark, sf):
    labels = _labels(spark, sf)
    heavy = G.histogram2d(_binned(spark, sf, 90, 70)).filter("n >= 5").select(CASE, "ix", "iy")
    seeds = labels.join(heavy, [CASE, "ix", "iy"], "left_semi")
    bare = labels.join(heavy, [CASE, "ix", "iy"], "left_anti")
    return G.nearest_seed(bare, seeds).select("ix", "iy", "structure_id", F.round("d", 6).alias("d"))


@plan("contour_edges", f"""WITH {LABELS}, s AS (SELECT a.label AS structure_id, a.ix + 0.5 + dx / 2.0 AS x, a.iy + 0.5 + dy / 2.0 AS y FROM labels a, {_NEXT}
    LEFT JOIN labels b ON b.ix = a.ix + dx AND b.iy = a.iy + dy AND b.label = a.label WHERE b.label IS NULL)
  SELECT structure_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, count(*) AS n FROM s GROUP BY 1, 2, 3""")
def contour_edges(spark, sf):
    r = G.contour_rings(_labels(spark, sf), 90)
    return r.groupBy("structure_id", "x", "y").agg(F.count("*").alias("n"))


@plan("density_proxy_raster")
def density_proxy_raster(spark, sf):
    """Colour raster; rows only, as the blur over 2 million pixels is slow in SQL (a small one is tested)."""
    return G.density_proxy_raster(cells(spark, sf)).drop(CASE)


def _partition(spark, sf):
    return G.build_partition(_cells(spark, sf), CFG)


@plan("structure_partition")
def structure_partition(spark, sf):
    """Whole partition pipeline; properties are tested (SQL would need nested recursion)."""
    return _partition(spark, sf).labels.drop(CASE)


@plan("partition_metrics")
def partition_metrics(spark, sf):
    return G.partition_metrics(_partition(spark, sf)).drop(CASE)


@plan("assign_cells", f"""WITH {CELLS} SELECT {STRUCTURE_OF('cluster')} AS structure_id, count(*) AS cell_count, count(*) AS assigned_cell_count, 1.0::DOUBLE AS assigned_cell_fraction FROM cells GROUP BY 1""")
def assign_cells(spark, sf):
    """Every occupied pixel belongs to the partition, so every cell is assigned."""
    p = _partition(spark, sf)
    return G.assignment_metrics(G.grid_lookup(p.binned, p.labels), ["structure_id"])


@plan("structure_count_table")
def structure_count_table(spark, sf):
    p = _partition(spark, sf)
    rings = C.label_components(p.labels, [CASE, "structure_id"], 90).select(CASE, "structure_id", "component", F.col("component").alias("ring"))
    return G.structure_count_table(specs.structure_spec(spark, GROUPS_TEXT), G.grid_lookup(p.binned, p.labels), rings)


@plan("polygon_export")
def polygon_export(spark, sf):
    p = _partition(spark, sf)
    d = G.polygon_export(p.labels, p.bounds, specs.structure_spec(spark, GROUPS_TEXT), CFG, 0.2125)
    return d.drop(CASE)


@plan("polygon_summary")
def polygon_summary(spark, sf):
    p = _partition(spark, sf)
    return G.polygon_summary(G.polygon_export(p.labels, p.bounds, specs.structure_spec(spark, GROUPS_TEXT), CFG, 0.2125)).drop(CASE)


@plan("clean_rings", f"""WITH {CELLS}, s AS (SELECT custkey, round(x, 0) AS x, cluster, row_number() OVER (PARTITION BY custkey ORDER BY cell_id) - 1 AS seq FROM cells),
   l AS (SELECT *, lag(x) OVER w AS px, lag(cluster) OVER w AS pc FROM s WINDOW w AS (PARTITION BY custkey ORDER BY seq))
  SELECT custkey, row_number() OVER (PARTITION BY custkey ORDER BY seq) - 1 AS seq, x FROM l WHERE NOT (px IS NOT NULL AND px = x)""")
def clean_rings(spark, sf):
    from pyspark.sql import Window
    c = cells(spark, sf)
    seq = F.row_number().over(Window.partitionBy("custkey").orderBy("cell_id")) - 1
    v = c.select("custkey", F.round("x", 0).alias("x"), F.lit(0.0).alias("y"), seq.cast("bigint").alias("seq"))
    return G.dedup_consecutive(v, ["custkey"]).select("custkey", "seq", "x")


@plan("thin_rings", f"""WITH {CELLS}, s AS (SELECT custkey, x, row_number() OVER (PARTITION BY custkey ORDER BY cell_id) - 1 AS seq, count(*) OVER (PARTITION BY custkey) AS n FROM cells),
   t AS (SELECT custkey, x, CAST(seq // CAST(ceil(n / 6) AS BIGINT) AS BIGINT) AS seq FROM s WHERE seq % CAST(ceil(n / 6) AS BIGINT) = 0)
  SELECT custkey, seq, x FROM t UNION ALL SELECT custkey, max(seq) + 1, arg_min(x, seq) FROM t GROUP BY 1""")
def thin_rings(spark, sf):
    from pyspark.sql import Window
    c = cells(spark, sf)
    seq = F.row_number().over(Window.partitionBy("custkey").orderBy("cell_id")) - 1
    v = c.select("custkey", "x", seq.cast("bigint").alias("seq"))
    return G.close_rings(G.thin_vertices(v, ["custkey"], 6), ["custkey"]).select("custkey", "seq", "x")


BOXES = """q AS (SELECT s_suppkey AS polygon_id, s_suppkey * 37 % 500 AS cx, s_suppkey * 211 % 2600 + 900 AS cy, s_nationkey + 5 AS r FROM supplier),
 box AS (SELECT polygon_id, cx - r AS x0, cy - 3 * r AS y0, cx + r AS x1, cy + 3 * r AS y1 FROM q)"""


@plan("polygon_bbox", f"""WITH {BOXES} SELECT polygon_id, CAST(greatest(x0, 0) AS INTEGER) AS x0, CAST(greatest(y0, 0) AS INTEGER) AS y0, CAST(least(x1, 480) AS INTEGER) AS x1, CAST(least(y1, 2000) AS INTEGER) AS y1,
  CASE WHEN greatest(x0, 0) >= least(x1, 480) OR greatest(y0, 0) >= least(y1, 2000) THEN 'contour box does not meet the image' END AS error FROM box""")
def polygon_bbox(spark, sf):
    return G.crop(G.polygon_bbox(squares(spark, sf)), 480, 2000)


@plan("pyramid_level", f"""WITH {BOXES}, t AS (SELECT polygon_id, greatest(greatest(x1 - x0, y1 - y0) / 40.0, 1) AS target FROM box)
  SELECT polygon_id, CAST(CASE WHEN target <= 1 THEN 0 WHEN target <= 2 THEN 1 ELSE 2 END AS INTEGER) AS level,
   CASE WHEN target <= 1 THEN 1.0::DOUBLE WHEN target <= 2 THEN 2 ELSE 4 END AS scale_x FROM t""")
def pyramid_level(spark, sf):
    levels = spark.createDataFrame([(0, 1000, 4000), (1, 500, 2000), (2, 250, 1000)], "level int, width int, height int")
    return G.pyramid_level(G.polygon_bbox(squares(spark, sf)), levels, 40).select("polygon_id", "level", "scale_x")


def _pixels(spark, sf):
    b = _binned(spark, sf, 90, 70)
    return b.groupBy("ix", "iy").agg((F.count("*") * 20 % 256).cast("int").alias("r"), (F.sum("structure_id") % 256).cast("int").alias("g"), F.lit(7).alias("b")) \
        .withColumnRenamed("ix", "px").withColumnRenamed("iy", "py")


PIXELS = f"""{BINNED(90, 70)}, pixels AS (SELECT ix AS px, iy AS py, CAST(count(*) * 20 % 256 AS INTEGER) AS r, CAST(sum(structure_id) % 256 AS INTEGER) AS g, 7 AS b FROM binned GROUP BY 1, 2)"""


@plan("masked_pixels", f"""WITH {PIXELS}, q AS (SELECT s_suppkey AS polygon_id, s_suppkey * 37 % 90 AS cx, s_suppkey * 211 % 70 AS cy, 3.2 + s_nationkey / 4.0 AS r, s_acctbal > 5000 AS hole FROM supplier),
  p AS (SELECT *, px + 0.5 - cx AS dx, py + 0.5 - cy AS dy FROM q, pixels WHERE px >= floor(cx - r) AND px < ceil(cx + 2 * r) AND py >= floor(cy - r) AND py < ceil(cy + 2 * r)),
  m AS (SELECT *, abs(dx) < r AND abs(dy) < r AND NOT (hole AND abs(dx) < r / 2 AND abs(dy) < r / 2) OR dx > 0 AND dy > 0 AND dx + dy < 2 * r AS inside FROM p)
  SELECT polygon_id, px, py, CASE WHEN inside THEN r_1 ELSE 0 END AS r, CASE WHEN inside THEN g ELSE 0 END AS g, CASE WHEN inside THEN b ELSE 0 END AS b, inside FROM m""".replace("q, pixels WHERE", "q, (SELECT px, py, r AS r_1, g, b FROM pixels) WHERE"))
def masked_pixels(spark, sf):
    """A square of each supplier, with a hole where the balance is high, and a triangle that overlaps it."""
    s = table(spark, sf, "supplier")
    r, cx, cy = F.lit(3.2) + F.col("s_nationkey") / 4.0, F.col("s_suppkey") * 37 % 90, F.col("s_suppkey") * 211 % 70
    square, triangle = [(-1, -1), (1, -1), (1, 1), (-1, 1)], [(0, 0), (2, 0), (0, 2)]

    def ring(part, n, corners, size):
        return [F.struct(F.lit(part).alias("part"), F.lit(n).alias("ring"), F.lit(i).alias("seq"), (cx + a * size).cast("double").alias("x"), (cy + b * size).cast("double").alias("y")) for i, (a, b) in enumerate(corners)]
    hole = F.when(F.col("s_acctbal") > 5000, r / 2)
    v = s.select(F.col("s_suppkey").alias("polygon_id"), F.explode(F.array(*ring(0, 0, square, r), *ring(0, 1, square, hole), *ring(1, 0, triangle, r))).alias("v")).select("polygon_id", "v.*")
    return G.masked_pixels(_pixels(spark, sf), v.where("x IS NOT NULL AND y IS NOT NULL"), 16.0)


_GREY = "((r * 19595 + g * 38470 + b * 7471 + 32768) // 65536)"


@plan("pixel_quality", f"""WITH {PIXELS} SELECT px // 10 AS patch_id, max(px) - min(px) + 1 AS width, max(py) - min(py) + 1 AS height, round(avg({_GREY}), 6) AS mean_intensity,
  round(count(*) FILTER ({_GREY} > 3) / count(*), 6) AS nonzero_fraction, round(count(*) FILTER (r + g + b > 3) / count(*), 6) AS nonzero_rgb_fraction FROM pixels GROUP BY 1""")
def pixel_quality(spark, sf):
    d = G.pixel_quality(_pixels(spark, sf).withColumn("patch_id", F.floor(F.col("px") / 10).cast("int")))
    return d.select("patch_id", "width", "height", *[F.round(c, 6).alias(c) for c in ("mean_intensity", "nonzero_fraction", "nonzero_rgb_fraction")])


@plan("stretch_to_byte", f"""WITH {PIXELS}, q AS (SELECT px // 10 AS patch_id, quantile_cont(r::DOUBLE, 0.01) AS lo, quantile_cont(r::DOUBLE, 0.99) AS hi0 FROM pixels GROUP BY 1), h AS (SELECT *, CASE WHEN hi0 <= lo THEN lo + 1 ELSE hi0 END AS hi FROM q)
  SELECT px // 10 AS patch_id, px, py, CAST(floor(greatest(least((r - lo) / (hi - lo), 1), 0) * 255) AS INTEGER) AS r FROM pixels JOIN h ON patch_id = px // 10""")
def stretch_to_byte(spark, sf):
    p = _pixels(spark, sf).withColumn("patch_id", F.floor(F.col("px") / 10).cast("int")).withColumn("r", F.col("r").cast("double"))
    return G.stretch_to_byte(p, "r").select("patch_id", "px", "py", "r")


@plan("preview_sample", f"WITH {CELLS} SELECT cell_id FROM cells ORDER BY md5(cell_id || ':42'), cell_id LIMIT 4000")
def preview_sample(spark, sf):
    return G.preview_sample(cells(spark, sf), "cell_id", 4000).select("cell_id")
