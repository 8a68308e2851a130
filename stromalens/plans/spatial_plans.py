"""Neighbour searches, distances and orientation bound to the shared tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import delaunay as D, expression as X, spatial as P
from .bindings import CELLS, EXPRESSION, cells, expression, table
from .registry import plan

PAIR = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@plan("nearest_of_group", f"""WITH {CELLS} SELECT a.cell_id, b.cluster AS target, round(min({PAIR}), 6) AS d FROM cells a, cells b GROUP BY 1, 2""")
def nearest_of_group(spark, sf):
    c = cells(spark, sf)
    return P.nearest_of_group(c, c, "cluster").select("cell_id", "target", F.round("d", 6).alias("d"))


MATRIX = f"""{CELLS}, near AS (SELECT a.cell_id, a.cluster AS a, b.cluster AS b, min({PAIR}) AS d FROM cells a, cells b GROUP BY 1, 2, 3),
 matrix AS (SELECT a, b, avg(d) AS d FROM near GROUP BY 1, 2)"""


@plan("searcher_findee_distance", f"WITH {MATRIX} SELECT a, b, round(d, 6) AS d FROM matrix")
def searcher_findee_distance(spark, sf):
    return P.searcher_findee_distance(cells(spark, sf)).select("a", "b", F.round("d", 6).alias("d"))


@plan("best_celltype", f"WITH {MATRIX} SELECT a AS entity, arg_min(b, d) AS best_celltype, round(min(d), 6) AS best_distance FROM matrix WHERE a <> b GROUP BY 1")
def best_celltype(spark, sf):
    m = P.searcher_findee_distance(cells(spark, sf)).filter("a <> b").select(F.col("a").alias("entity"), F.col("b").alias("celltype"), "d")
    return P.best_celltype(m).withColumn("best_distance", F.round("best_distance", 6))


@plan("acceptance_checks", f"""WITH {MATRIX}, r AS (SELECT *, rank() OVER (PARTITION BY a ORDER BY d) AS rank, first(b) OVER (PARTITION BY a ORDER BY d) AS best FROM matrix WHERE a <> b)
  SELECT a AS entity, b AS expected_celltype, best AS best_celltype, CAST(rank AS INTEGER) AS rank, best = b AS passed FROM r WHERE b = CASE WHEN a = '5-LOW' THEN '1-URGENT' ELSE '5-LOW' END""")
def acceptance_checks(spark, sf):
    m = P.searcher_findee_distance(cells(spark, sf)).filter("a <> b").select(F.col("a").alias("entity"), F.col("b").alias("celltype"), "d")
    e = cells(spark, sf).select(F.col("cluster").alias("entity")).distinct()
    e = e.withColumn("expected_celltype", F.when(F.col("entity") == "5-LOW", "1-URGENT").otherwise("5-LOW"))
    return P.acceptance_checks(m, e).select("entity", "expected_celltype", "best_celltype", "rank", "passed")


@plan("ranked_lr_pairs", f"""WITH {MATRIX}, top AS (SELECT max(d) AS m FROM matrix), s AS (SELECT l.a AS ligand, r.a AS receptor, l.b AS sender, r.b AS receiver,
   (1 - l.d / m) * (1 - r.d / m) AS score FROM matrix l, matrix r, top WHERE r.a = CASE l.a WHEN '1-URGENT' THEN '2-HIGH' WHEN '2-HIGH' THEN '5-LOW' END)
  SELECT ligand, receptor, sender, receiver, round(score, 6) AS score, CAST(rank() OVER (PARTITION BY ligand, receptor ORDER BY score DESC, sender, receiver) AS INTEGER) AS rank FROM s""")
def ranked_lr_pairs(spark, sf):
    m = P.searcher_findee_distance(cells(spark, sf)).select(F.col("a").alias("entity"), F.col("b").alias("celltype"), "d")
    m = m.withColumn("d", F.col("d") / m.agg(F.max("d")).scalar())
    pairs = spark.createDataFrame([("1-URGENT", "2-HIGH"), ("2-HIGH", "5-LOW")], "ligand string, receptor string")
    return P.ranked_lr_pairs(m, m, pairs).select("ligand", "receptor", "sender", "receiver", F.round("score", 6).alias("score"), "rank")


@plan("radius_neighbors", f"WITH {CELLS} SELECT a.cell_id, b.cell_id AS near_cell_id, round({PAIR}, 6) AS d FROM cells a, cells b WHERE a.cell_id <> b.cell_id AND {PAIR} <= 4")
def radius_neighbors(spark, sf):
    return P.radius_neighbors(cells(spark, sf), 4.0).select("cell_id", "near_cell_id", F.round("d", 6).alias("d"))


@plan("neighbor_counts", f"""WITH {CELLS}, r(radius) AS (VALUES (5.0::DOUBLE), (20.0::DOUBLE), (80.0::DOUBLE)), c AS (
   SELECT a.cell_id, count(*) FILTER ({PAIR} <= 5) - 1 AS n5, count(*) FILTER ({PAIR} <= 20) - 1 AS n20, count(*) - 1 AS n80 FROM cells a, cells b WHERE {PAIR} <= 80 GROUP BY 1)
  SELECT cell_id, radius, CASE radius WHEN 5 THEN n5 WHEN 20 THEN n20 ELSE n80 END AS neighbors FROM c, r""")
def neighbor_counts(spark, sf):
    return P.neighbor_counts(cells(spark, sf), [5.0, 20.0, 80.0]).select("cell_id", "radius", "neighbors")


def axes(spark, sf):
    c = cells(spark, sf)
    return c.select("cell_id", "x", "y", F.col("cluster").alias("group"), (F.col("cell_id") % 360 * (2 * math.pi) / 360).alias("angle"))


AXES = f"{CELLS}, axes AS (SELECT cell_id, x, y, cluster AS grp, cell_id % 360 * {2 * math.pi!r}::DOUBLE / 360 AS angle FROM cells)"


@plan("axis_strength_by_radius", f"""WITH {AXES}, s AS (SELECT a.cell_id, a.grp, r.radius, count(*) - 1 AS n, sum(cos(2 * b.angle)) - any_value(cos(2 * a.angle)) AS c, sum(sin(2 * b.angle)) - any_value(sin(2 * a.angle)) AS s
   FROM axes a, axes b, (VALUES (10.0::DOUBLE), (20.0::DOUBLE)) r(radius) WHERE {PAIR} <= r.radius GROUP BY 1, 2, 3),
  v AS (SELECT grp, radius, n, round(sqrt(c * c + s * s), 9) AS ane FROM s)
  SELECT grp AS "group", radius AS radius_um, {', '.join(f'round(quantile_cont(ane / n, {q}) FILTER (n > 0), 6) AS coh_{s}, round(quantile_cont(n::DOUBLE, {q}), 6) AS neigh_{s}, round(quantile_cont(ane, {q}) FILTER (n > 0), 6) AS ANE_{s}, round(quantile_cont(ane, {q}) FILTER (n > 0) / (pi() * radius * radius), 8) AS ANE_density_{s}' for s, q in (('median', 0.5), ('q25', 0.25), ('q75', 0.75)))}
  FROM v GROUP BY 1, 2""")
def axis_strength_by_radius(spark, sf):
    d = P.axis_strength_by_radius(axes(spark, sf), [10.0, 20.0])
    return d.select("group", "radius_um", *[F.round(c, 8 if "density" in c else 6).alias(c) for c in d.columns if c not in ("group", "radius_um")])


@plan("orientation_summary", f"""WITH {AXES}, m AS (SELECT grp, count(*) AS n, avg(cos(2 * angle)) AS c, avg(sin(2 * angle)) AS s FROM axes GROUP BY 1), q AS (SELECT *, sqrt(c * c + s * s) AS r FROM m),
  d AS (SELECT a.cell_id, a.grp, b.angle, row_number() OVER (PARTITION BY a.cell_id ORDER BY {PAIR}, b.cell_id) AS k FROM axes a, axes b WHERE a.cell_id <> b.cell_id AND {PAIR} <= 120),
  l AS (SELECT cell_id, grp, round(sqrt(avg(cos(2 * angle)) ** 2 + avg(sin(2 * angle)) ** 2), 9) AS r FROM d WHERE k <= 15 GROUP BY 1, 2),
  lq AS (SELECT grp, quantile_cont(r, 0.5) AS m, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.75) AS q3 FROM l GROUP BY 1)
  SELECT grp AS "group", n AS n_axes, round(r, 9) AS axial_rbar, round(((degrees(atan2(s, c)) / 2) % 180 + 180) % 180, 4) AS mean_axis_degrees, round(2 * r + r ** 3 + 5 * r ** 5 / 6, 8) AS kappa,
   round(exp(-n * r * r), 6) AS rayleigh_p, round(m, 6) AS local_rbar_median, round(q1, 6) AS local_rbar_q25, round(q3, 6) AS local_rbar_q75 FROM q JOIN lq USING (grp)""")
def orientation_summary(spark, sf):
    d = P.orientation_summary(axes(spark, sf), local_k=15)
    digits = {"axial_rbar": 9, "mean_axis_degrees": 4, "kappa": 8}
    return d.select("group", "n_axes", *[F.round(c, digits.get(c, 6)).alias(c) for c in d.columns if c not in ("group", "n_axes")])


@plan("polarity_summary", f"""WITH {CELLS}, p AS (SELECT cluster, sqrt((x / 100 - 2) ** 2 + (y / 500 - 2) ** 2) AS d, sqrt((x / 100 - 2) ** 2 + (y / 500 - 2) ** 2) / 4 AS norm FROM cells)
  SELECT cluster, count(*) AS n_cells, count(*) FILTER (norm > 0.3) AS n_polarized, round(count(*) FILTER (norm > 0.3) / count(*), 6) AS polarized_fraction,
   round(quantile_cont(norm, 0.5), 6) AS offset_norm_median, round(quantile_cont(d, 0.5), 6) AS offset_distance_median_um FROM p GROUP BY 1""")
def polarity_summary(spark, sf):
    c = cells(spark, sf).select("cluster", (F.col("x") / 100 - 2).alias("dx"), (F.col("y") / 500 - 2).alias("dy"), F.lit(4.0).alias("size"))
    d = P.polarity_summary(c, "dx", "dy", "size", by=["cluster"])
    return d.select("cluster", "n_cells", "n_polarized", *[F.round(v, 6).alias(v) for v in ("polarized_fraction", "offset_norm_median", "offset_distance_median_um")])


@plan("tumor_stroma_growth", f"""WITH {CELLS}, t AS (SELECT * FROM cells WHERE cluster = '5-LOW'), s AS (SELECT * FROM cells WHERE cluster = '1-URGENT'),
  n AS (SELECT a.cell_id, min({PAIR}) AS d, count(*) FILTER ({PAIR} <= 15) AS ns FROM t a, s b GROUP BY 1),
  m AS (SELECT a.cell_id, count(*) FILTER ({PAIR} <= 15) - 1 AS nt FROM t a, t b GROUP BY 1), r AS (SELECT *, ns > 0 AND ns >= nt AS inf FROM n JOIN m USING (cell_id))
  SELECT count(*) AS n_tumor, count(*) FILTER (inf) AS n_infiltrative, count(*) FILTER (NOT inf) AS n_expanding, count(*) AS n_tumor_valid,
   round(count(*) FILTER (inf) / count(*), 6) AS infiltrative_proportion, round(avg(d) FILTER (inf), 6) AS mean_infil_dist_to_stromal, round(avg(d) FILTER (NOT inf), 6) AS mean_expand_dist_to_stromal FROM r""")
def tumor_stroma_growth(spark, sf):
    d = P.tumor_stroma_growth(cells(spark, sf), "5-LOW", "1-URGENT", 15.0)
    return d.select(*[F.col(c) for c in d.columns if c.startswith("n_")], *[F.round(c, 6).alias(c) for c in d.columns if c.startswith(("inf", "mean"))])


@plan("distance_expression_coupling", f"""WITH {CELLS}, {EXPRESSION}, dist AS (SELECT a.cell_id, min({PAIR}) AS d FROM cells a, cells b WHERE a.cluster = '5-LOW' AND b.cluster = '1-URGENT' GROUP BY 1),
  rd AS (SELECT cell_id, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2 AS rd FROM dist), tot AS (SELECT count(*) AS n, sum(rd) AS srd, sum(rd * rd) AS srd2 FROM rd),
  v AS (SELECT gene, cell_id, sum(n) AS v FROM expression GROUP BY 1, 2 HAVING sum(n) <> 0), j AS (SELECT gene, v, rd FROM v JOIN rd USING (cell_id)),
  k AS (SELECT gene, v, rd, count(*) OVER (PARTITION BY gene) AS nnz, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2 AS rv FROM j),
  g AS (SELECT gene, any_value(nnz) AS nnz, sum(v) AS sv, sum(rd) AS nzrd, sum((n - nnz + rv) * rd) AS c1, sum((n - nnz + rv) ** 2) AS q1 FROM k, tot GROUP BY 1),
  f AS (SELECT gene, n, nnz, sv, c1 + (n - nnz + 1) / 2 * (srd - nzrd) - n * ((n + 1) / 2) ** 2 AS cov, q1 + (n - nnz) * ((n - nnz + 1) / 2) ** 2 - n * ((n + 1) / 2) ** 2 AS vv, srd2 - n * ((n + 1) / 2) ** 2 AS vd FROM g, tot)
  SELECT gene, n AS n_cells, nnz AS n_nonzero_cells, round(cov / sqrt(vv * vd), 6) AS spearman_rho, round(sv / n, 6) AS mean_expression FROM f""")
def distance_expression_coupling(spark, sf):
    c = cells(spark, sf)
    near = P.nearest_of_group(c.filter("cluster = '5-LOW'"), c.filter("cluster = '1-URGENT'"), "cluster")
    d = X.distance_expression_coupling(expression(spark, sf), near.select("cell_id", "d"))
    return d.withColumn("spearman_rho", F.round("spearman_rho", 6)).withColumn("mean_expression", F.round("mean_expression", 6))


@plan("zscore_projection", f"""WITH {CELLS}, s AS (SELECT avg(x) AS mx, avg(y) AS my, stddev_samp(x) AS sx, stddev_samp(y) AS sy FROM cells)
  SELECT CAST(cell_id AS VARCHAR) AS barcode, round((x - mx) / sx, 6) AS axis_1, round(-(y - my) / sy, 6) AS axis_2 FROM cells, s""")
def zscore_projection(spark, sf):
    c = cells(spark, sf).withColumn("barcode", F.col("cell_id").cast("string"))
    d = P.zscore_projection(c.select("barcode", "cluster"), c.select("barcode", "x", "y"))
    return d.select("barcode", F.round("axis_1", 6).alias("axis_1"), F.round("axis_2", 6).alias("axis_2"))


@plan("circle_projection", """WITH l AS (SELECT c_name, c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS i, sha1(c_name) AS h FROM customer), n AS (SELECT count(DISTINCT c_mktsegment) AS n FROM customer)
  SELECT c_name AS barcode, round(cos(2 * pi() * i / n), 1) AS near_1, round(sin(2 * pi() * i / n), 1) AS near_2 FROM l, n""")
def circle_projection(spark, sf):
    c = table(spark, sf, "customer")
    d = P.zscore_projection(c.select(F.col("c_name").alias("barcode"), F.col("c_mktsegment").alias("cluster")),
                            c.select(F.concat("c_name", F.lit("x")).alias("barcode"), F.col("c_acctbal").alias("x"), F.col("c_acctbal").alias("y")))
    # jitter is at most 0.04, compared exactly by its own query; here only the layout
    from ..functions import scalars as S
    jx, jy = S.stable_jitter("barcode")
    return d.select("barcode", (F.round(F.col("axis_1") - jx, 1) + 0.0).alias("near_1"), (F.round(F.col("axis_2") - jy, 1) + 0.0).alias("near_2"))


def squares(spark, sf):
    """Polygons from suppliers: a square around a point, with a square hole where the balance is high."""
    s = table(spark, sf, "supplier")
    cx, cy, r = F.col("s_suppkey") * 37 % 500, F.col("s_suppkey") * 211 % 2600 + 900, F.col("s_nationkey") + 5
    hole = F.when(F.col("s_acctbal") > 5000, r / 2)

    def ring(n, size):
        corners = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
        return [F.struct(F.lit(n).alias("ring"), F.lit(i).alias("seq"), (cx + a * size).alias("x"), (cy + b * size * 3).alias("y")) for i, (a, b) in enumerate(corners)]
    v = s.select(F.col("s_suppkey").alias("polygon_id"), F.explode(F.array(*ring(0, r.cast("double")), *ring(1, hole))).alias("v"))
    return v.select("polygon_id", F.lit(0).alias("part"), "v.ring", "v.seq", F.col("v.x").cast("double").alias("x"), "v.y").filter("x IS NOT NULL AND y IS NOT NULL")


@plan("point_in_polygon", f"""WITH {CELLS}, q AS (SELECT s_suppkey AS polygon_id, s_suppkey * 37 % 500 AS cx, s_suppkey * 211 % 2600 + 900 AS cy, s_nationkey + 5 AS r, s_acctbal > 5000 AS hole FROM supplier)
  SELECT cell_id, polygon_id FROM cells, q WHERE x >= cx - r AND x < cx + r AND y >= cy - 3 * r AND y < cy + 3 * r
   AND NOT (hole AND x >= cx - r / 2 AND x < cx + r / 2 AND y >= cy - 1.5 * r AND y < cy + 1.5 * r)
   OR x >= cx AND x < cx + 2 * r AND y >= cy AND y < cy + 6 * r AND NOT (x >= cx + r AND y >= cy + 3 * r)""")
def point_in_polygon(spark, sf):
    """Squares with and without a hole, each with an L-shaped second part that overlaps the first."""
    v = squares(spark, sf).withColumn("seq", F.col("seq") * 3)  # gaps in the numbering
    s = table(spark, sf, "supplier")
    r, cx, cy = (F.col("s_nationkey") + 5), F.col("s_suppkey") * 37 % 500, F.col("s_suppkey") * 211 % 2600 + 900
    ell = [(0, 0), (2, 0), (2, 3), (1, 3), (1, 6), (0, 6)]
    corners = F.array(*[F.struct(F.lit(i * i).alias("seq"), (cx + a * r).cast("double").alias("x"), (cy + b * r).cast("double").alias("y")) for i, (a, b) in enumerate(ell)])
    second = s.select(F.col("s_suppkey").alias("polygon_id"), F.lit(1).alias("part"), F.lit(0).alias("ring"), F.explode(corners).alias("v")).select("polygon_id", "part", "ring", "v.*")
    return P.point_in_polygon(cells(spark, sf).select("cell_id", "x", "y"), v.unionByName(second), 25.0).select("cell_id", "polygon_id")


PROGRAMS = f"""{CELLS}, {EXPRESSION}, sets AS (SELECT p_type AS pathway, p_partkey AS gene FROM part),
 score AS (SELECT pathway, cell_id, sum(n) / any_value(k) AS score FROM expression JOIN sets USING (gene) JOIN (SELECT pathway, count(*) AS k FROM sets GROUP BY 1) USING (pathway) GROUP BY 1, 2),
 cut AS (SELECT pathway, quantile_cont(score, 0.95) AS c FROM score GROUP BY 1), kept AS (SELECT pathway, cell_id, x, y FROM score JOIN cut USING (pathway) JOIN cells USING (cell_id) WHERE score > c)"""


@plan("program_activity", f"""WITH {PROGRAMS}, near AS (SELECT a.pathway, a.cell_id, b.cluster AS celltype, min({PAIR}) AS d FROM kept a, cells b GROUP BY 1, 2, 3)
  SELECT pathway, celltype, count(*) AS retained_cell_count, round(avg(d), 6) AS d FROM near GROUP BY 1, 2""")
def program_activity(spark, sf):
    sets = table(spark, sf, "part").select(F.col("p_type").alias("pathway"), F.col("p_partkey").cast("string").alias("gene"))
    d = X.program_activity(expression(spark, sf), sets, cells(spark, sf))
    return d.withColumn("d", F.round("d", 6))


@plan("data_profile", f"""WITH {CELLS}, {EXPRESSION}, t AS (SELECT cell_id, sum(n) AS total, count(DISTINCT gene) AS genes FROM expression GROUP BY 1)
  SELECT cluster, count(*) AS n_cells, round(quantile_cont(coalesce(total, 0), 0.5), 6) AS median_counts, round(quantile_cont(coalesce(genes, 0)::DOUBLE, 0.5), 6) AS median_genes
  FROM cells LEFT JOIN t USING (cell_id) GROUP BY 1""")
def data_profile(spark, sf):
    d = X.data_profile(expression(spark, sf), cells(spark, sf).select("cell_id", "cluster"))
    return d.withColumn("median_counts", F.round("median_counts", 6)).withColumn("median_genes", F.round("median_genes", 6))


@plan("delaunay_edges")
def delaunay_edges(spark, sf):
    """Delaunay neighbours among the places of all cells."""
    d = D.delaunay_edges(D.number_places(cells(spark, sf)), ends=True)
    return d.select("ax", "ay", "bx", "by", F.round("d", 6).alias("d"))


@plan("tumor_hops")
def tumor_hops(spark, sf):
    return D.tumor_hops(cells(spark, sf), "5-LOW", "1-URGENT").select("cell_id", "hops")


@plan("tumor_growth_by_hops")
def tumor_growth_by_hops(spark, sf):
    d = D.tumor_growth_by_hops(cells(spark, sf), "5-LOW", "1-URGENT")
    return d.select(*[F.col(c) for c in d.columns if c.startswith("n_")], *[F.round(c, 6).alias(c) for c in d.columns if c.startswith(("inf", "mean"))])
