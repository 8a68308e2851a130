import numpy as np
import pytest
from pyspark.sql import functions as F

from stromalens.operators import components as C, grid as G


def mask_df(spark, text):
    rows = text.strip("\n").split("\n")
    return spark.createDataFrame([(x, y) for y, row in enumerate(rows) for x, c in enumerate(row) if c == "#"], "ix int, iy int"), len(rows[0]), len(rows)


def pixels(df):
    return {(r.ix, r.iy) for r in df.collect()}


SPIRAL = """
#########
........#
#######.#
#.....#.#
#.###.#.#
#.#...#.#
#.#####.#
#.......#
#########
"""
RING = """
.......
.#####.
.#...#.
.#.#.#.
.#...#.
.#####.
.......
"""
CORNERS = """
##....
##....
..##..
..##..
#.....
"""


@pytest.mark.parametrize("strip", [65536, 9])
def test_components(spark, monkeypatch, strip):
    monkeypatch.setattr(C, "STRIP_PIXELS", strip)
    m, w, h = mask_df(spark, SPIRAL)
    assert C.label_components(m, [], w).select("component").distinct().count() == 1
    m, w, h = mask_df(spark, CORNERS)
    sizes = sorted(r["count"] for r in C.label_components(m, [], w).groupBy("component").count().collect())
    assert sizes == [1, 4, 4]
    assert len(pixels(C.remove_small_components(m, [], 4, w))) == 8


@pytest.mark.parametrize("strip", [65536, 7])
def test_fill_holes(spark, monkeypatch, strip):
    monkeypatch.setattr(C, "STRIP_PIXELS", strip)
    m, w, h = mask_df(spark, RING)
    got = pixels(C.fill_holes(m, [], w, h))
    assert got == {(x, y) for x in range(1, 6) for y in range(1, 6)}
    m, w, h = mask_df(spark, SPIRAL)
    assert pixels(C.fill_holes(m, [], w, h)) == pixels(m)


def test_morphology_properties(spark):
    rng = np.random.default_rng(2)
    grid = rng.random((12, 14)) < 0.6
    m = spark.createDataFrame([(int(x), int(y)) for y, x in zip(*np.nonzero(grid))], "ix int, iy int")
    src = pixels(m)
    closed, opened = pixels(C.binary_close(m, [], 1, 14, 12)), pixels(C.binary_open(m, [], 1, 14, 12))
    inner = {(x, y) for x, y in src if 0 < x < 13 and 0 < y < 11}
    assert inner <= closed and opened <= src


def test_rings(spark):
    m, w, h = mask_df(spark, RING)
    rows = C.trace_rings(m, [], w).collect()
    rings = {}
    for r in rows:
        rings.setdefault(r.ring, []).append((r.seq, r.x, r.y))
    areas = []
    for pts in rings.values():
        pts = [p[1:] for p in sorted(pts)]
        for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
            assert abs(x1 - x2) <= 1 and abs(y1 - y2) <= 1 and (x1, y1) != (x2, y2)
        areas.append(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1])) / 2)
    # outline, hole (walked the other way) and the island in it, corners cut by half a pixel
    assert len(rings) == 3 and sorted(np.sign(areas)) == [-1, 1, 1]
    assert max(areas) == 25 - 4 * 0.125


def test_touching_corners_have_two_rings(spark):
    m, w, h = mask_df(spark, CORNERS)
    assert C.trace_rings(m, [], w).select("ring").distinct().count() == 3


def reflect_blur(a, sigma):
    k = np.array([v for _, v in G.gaussian_kernel(sigma)])
    r = len(k) // 2
    for axis in (0, 1):
        a = np.apply_along_axis(lambda v: np.convolve(np.pad(v, r, mode="symmetric"), k, "valid"), axis, a)
    return a


def test_gaussian_matches_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 3, (9, 11)).astype(float)
    d = spark.createDataFrame([("c", int(x), int(y), int(a[y, x])) for y in range(9) for x in range(11) if a[y, x]], "case_id string, ix int, iy int, n int")
    got = np.zeros_like(a)
    for r in G.gaussian_smooth(d, ["case_id"], "n", 1.0, 11, 9).collect():
        got[r.iy, r.ix] = r.density
    assert np.allclose(got, reflect_blur(a, 1.0))


def test_bins_match_edges(spark):
    rng = np.random.default_rng(4)
    vals = np.concatenate([rng.random(500) * 7 + 3, np.linspace(3, 10, 13)])
    lo, hi = vals.min(), vals.max()
    edges = np.linspace(lo, hi, 13)
    want = np.clip(np.searchsorted(edges, vals, side="right") - 1, 0, 11)
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i int, v double")
    got = {r.i: r.b for r in d.select("i", G.bin_index("v", F.lit(float(lo)), F.lit(float(hi)), 12).alias("b")).collect()}
    assert [got[i] for i in range(len(vals))] == list(want)


@pytest.fixture(scope="module")
def slide(spark):
    rng = np.random.default_rng(8)
    rows, i = [], 0
    for case in ("s1", "s2"):
        for sid, (cx, cy) in {1: (20, 20), 2: (70, 25), 3: (45, 70)}.items():
            for x, y in rng.normal((cx, cy), 6, (150, 2)):
                rows.append((case, i, float(x), float(y), sid))
                i += 1
        rows += [(case, i + 1, 95.0, 95.0, 0), (case, i + 2, 96.0, 1.0, 4)]
        i += 2
    return spark.createDataFrame(rows, "case_id string, cell_id int, x double, y double, structure_id int")


def test_partition_properties(spark, slide):
    cfg = G.PartitionConfig(bins_x=40, bins_y=40, gaussian_sigma=1.5, min_cells=50, min_component_pixels=6, min_tissue_pixels=10)
    p = G.build_partition(slide, cfg)
    labels = p.labels.collect()
    assert len({(r.case_id, r.ix, r.iy) for r in labels}) == len(labels)  # disjoint
    at = {(r.case_id, r.ix, r.iy) for r in labels}
    assert {(r.case_id, r.ix, r.iy) for r in p.occupied.collect()} <= at  # covers occupied pixels
    metrics = {(r.case_id, r.structure_id): r for r in G.partition_metrics(p).collect()}
    assert metrics["s1", 4].reason.startswith("Only 1 cells") and metrics["s1", 4].partition_pixels == 0
    assert all(metrics["s2", s].overlap_pixels == 0 and metrics["s2", s].partition_pixels > 0 for s in (1, 2, 3))
    a = G.grid_lookup(p.binned, p.labels)
    right = a.filter("structure_id IN (1, 2, 3)").agg(F.avg((F.col("structure_id") == F.col("partition_structure_id")).cast("double"))).first()[0]
    assert right > 0.95
    m = {r.case_id: r for r in G.assignment_metrics(a, ["case_id"]).collect()}
    assert m["s1"].assigned_cell_count == m["s1"].cell_count == 452


def test_no_structure_is_an_error(spark):
    d = spark.createDataFrame([("c", 1, 0.0, 0.0, 1), ("c", 2, 1.0, 1.0, 1)], "case_id string, cell_id int, x double, y double, structure_id int")
    with pytest.raises(ValueError):
        G.build_partition(d, G.PartitionConfig(bins_x=4, bins_y=4))


def test_export_scales_and_names(spark, tmp_path):
    labels = spark.createDataFrame([("c", 1, 1, 1), ("c", 2, 1, 1), ("c", 5, 5, 1), ("c", 0, 5, 2)], "case_id string, ix int, iy int, structure_id int")
    bounds = spark.createDataFrame([("c", 0.0, 10.0, 0.0, 10.0)], "case_id string, x_min double, x_max double, y_min double, y_max double")
    spec = spark.createDataFrame([(1, "[Core]", "#6EF0D4"), (2, "Edge", "#78B9FF")], "structure_id int, structure_name string, structure_color string")
    cfg = G.PartitionConfig(bins_x=10, bins_y=10)
    poly = G.polygon_export(labels, bounds, spec, cfg, 0.5)
    got = {r.Selection: r.VertexCount for r in G.polygon_summary(poly).collect()}
    assert got == {"S1 Core #1.1": 7, "S1 Core #2.1": 5, "S2 Edge": 5}
    xs = [r.x for r in poly.filter("selection = 'S2 Edge'").collect()]
    assert min(xs) == 0.0 and max(xs) == 2.0
    out = G.write_annotations(poly, str(tmp_path / "a"))
    f = spark.read.json(out["features"]).filter("properties.name = 'S2 Edge'").first()
    assert f.geometry.coordinates[0][0] == f.geometry.coordinates[0][-1] and f.properties.classification.color == [120, 185, 255]


def test_raster_small(spark):
    d = spark.createDataFrame([(0.0, 0.0), (100.0, 50.0), (100.0, 50.0)], "x double, y double")
    r = G.density_proxy_raster(d, max_side=40, min_side=8, margin=10.0, sigma=1.0).collect()
    assert {x.ix for x in r} <= set(range(40)) and min(x.r for x in r) == 215 and max(x.r for x in r) <= 250


def test_scanline_runs_equal_the_crossing_rule(spark):
    """Rings with holes and parts, open and closed, with corners and edges on pixel centres."""
    import random

    r = random.Random(11)
    rings, rows = {}, []
    for polygon in range(12):
        for part in range(2):
            for ring in range(2):
                corners = [(r.choice([r.uniform(0, 20), r.randint(0, 19) + 0.5]), r.choice([r.uniform(0, 15), r.randint(0, 14) + 0.5])) for _ in range(r.randint(3, 7))]
                rings.setdefault((polygon, part), []).append(corners)
                closed = [*corners, corners[0]] if polygon % 2 else corners
                rows += [(polygon, part, ring, 3 * i, float(x), float(y)) for i, (x, y) in enumerate(closed)]

    def inside(polygon, part, x, y):
        odd = False
        for corners in rings[polygon, part]:
            for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
                if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                    odd = not odd
        return odd
    want = {(p, k, px, py) for p, k in rings for px in range(-1, 22) for py in range(-1, 17) if inside(p, k, px + 0.5, py + 0.5)}
    v = spark.createDataFrame(rows, "polygon_id int, part int, ring int, seq int, x double, y double").repartition(4)
    got = [(x["polygon_id"], x["part"], px, x["py"]) for x in G.scanline_spans(v).collect() for px in range(x["px0"], x["px1"] + 1)]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    assert G.scanline_spans(v.limit(0)).count() == 0


def test_masked_pixels_sends_no_exploded_side_through_the_driver(spark):
    vertices = spark.range(40).selectExpr("id AS polygon_id", "0 AS part", "0 AS ring", "explode(array(struct(0 AS seq, 0D AS x, 0D AS y), struct(1 AS seq, 30D AS x, 0D AS y), struct(2 AS seq, 0D AS x, 30D AS y))) AS v").select("polygon_id", "part", "ring", "v.*")
    pixels = spark.range(1600).selectExpr("CAST(id % 40 AS INT) AS px", "CAST(id DIV 40 AS INT) AS py", "1 AS r", "2 AS g", "3 AS b")
    out = G.masked_pixels(pixels, vertices, 16.0)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 40 * 900 and out.where("inside").count() == 40 * 435
