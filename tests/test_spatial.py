import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from stromalens.operators import ranking, spatial as P, tiles


def crowd(seed=1):
    """Spread points, a dense knot and a pile at one place: the pile holds a third of all rows."""
    rng = np.random.default_rng(seed)
    pts = [(float(x), float(y)) for x, y in rng.random((120, 2)) * [100, 300]]
    pts += [(float(x), float(y)) for x, y in 50 + rng.random((80, 2)) * 0.01]
    pts += [(10.0, 10.0)] * 100
    labels = [["a", "b", "c"][i] for i in rng.integers(0, 3, len(pts))]
    return [(i, x, y, g) for i, ((x, y), g) in enumerate(zip(pts, labels))]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(crowd(), "cell_id int, x double, y double, cluster string")


def dist(p, q):
    return math.hypot(p[1] - q[1], p[2] - q[2])


def test_nearest_matches_brute_force(cells):
    rows = crowd()
    got = {(r.cell_id, r.target): r.d for r in P.nearest_of_group(cells, cells, "cluster").collect()}
    assert len(got) == len(rows) * 3
    for p in rows:
        for g in "abc":
            assert abs(got[p[0], g] - min(dist(p, q) for q in rows if q[3] == g)) < 1e-9


def test_mean_distance_counts_piled_cells(cells):
    rows = crowd()
    got = {(r.a, r.b): r.d for r in P.searcher_findee_distance(cells).collect()}
    for a in "abc":
        for b in "abc":
            want = np.mean([min(dist(p, q) for q in rows if q[3] == b) for p in rows if p[3] == a])
            assert abs(got[a, b] - want) < 1e-9


def test_z_order_interleaves_bits_and_stays_small(spark):
    """Both coordinates are named once; with shifts and masks each was named 16 times and the code was not compiled."""
    places = [(0.0, 0.0), (65536.0, 65536.0), (1.0, 2.0), (255.5, 256.0), (12345.0, 54321.0), (65535.0, 1.0)]
    points = spark.createDataFrame(places, "x double, y double")
    rows = points.withColumn("_z", tiles.z_order(points))
    for r in rows.collect():
        x, y = (min(int(v), 65535) for v in (r.x, r.y))
        assert r["_z"] == sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(16))
    assert rows._jdf.queryExecution().analyzed().toString().lower().count("floor(") == 2


def test_matrix_is_searched_for_once(cells):
    """Trees and rankings read the matrix several times: what they read must be the kept table, not the search."""
    plan = P.searcher_findee_distance(cells)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "MapInArrow" not in plan


def test_radius_counts_match_brute_force(cells):
    rows = crowd()
    got = {(r.cell_id, r.radius): r.neighbors for r in P.neighbor_counts(cells, [5.0, 60.0]).collect()}
    for p in rows:
        for r in (5.0, 60.0):
            assert got[p[0], r] == sum(1 for q in rows if q[0] != p[0] and dist(p, q) <= r)


def test_radius_pairs_match_brute_force(cells):
    rows = [r for r in crowd()]
    got = {(r.cell_id, r.near_cell_id) for r in P.radius_neighbors(cells, 3.0).collect()}
    assert got == {(p[0], q[0]) for p in rows for q in rows if p[0] != q[0] and dist(p, q) <= 3.0}


def test_k_nearest(spark):
    rows = crowd()[:120]
    c = P.with_case(spark.createDataFrame(rows, "cell_id int, x double, y double, cluster string").drop("cluster"))
    p = tiles.pack(c, ["case_id"])
    got = {}
    for r in tiles.k_nearest(p, ["case_id"], "cell_id", 4).collect():
        got.setdefault(r.cell_id, {})[r.rank] = r.d
    for a in rows:
        want = sorted(dist(a, b) for b in rows if b[0] != a[0])[:4]
        assert np.allclose([got[a[0]][i + 1] for i in range(4)], want)


def test_cases_do_not_mix(spark):
    rows = [("s1", 1, 0.0, 0.0, "a"), ("s1", 2, 5.0, 0.0, "b"), ("s2", 3, 0.0, 0.0, "a"), ("s2", 4, 1.0, 0.0, "b")]
    c = spark.createDataFrame(rows, "case_id string, cell_id int, x double, y double, cluster string")
    got = {(r.case_id, r.a, r.b): r.d for r in P.searcher_findee_distance(c).collect()}
    assert got["s1", "a", "b"] == 5.0 and got["s2", "a", "b"] == 1.0


def test_polygons(spark):
    square = [(1, 0, 0, i, x, y) for i, (x, y) in enumerate([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)])]
    hole = [(1, 0, 1, i, x, y) for i, (x, y) in enumerate([(4, 4), (6, 4), (6, 6), (4, 6)])]
    two = [(2, part, 0, i, x + 20 * part, y) for part in (0, 1) for i, (x, y) in enumerate([(0, 0), (3, 0), (3, 3), (0, 3)])]
    v = spark.createDataFrame([tuple(map(float, r)) for r in square + hole + two], "polygon_id double, part double, ring double, seq double, x double, y double")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 9.5, 5.0), (4, 21.0, 1.0), (5, 15.0, 1.0), (6, -1.0, 5.0)], "cell_id int, x double, y double")
    got = {(r.cell_id, int(r.polygon_id)) for r in P.point_in_polygon(pts, v, 2.0).collect()}
    assert got == {(1, 1), (1, 2), (3, 1), (4, 2)}


def test_published_orientation_formulas(spark):
    rows = [(13460, 0.1133809126899563, 0.22823497740001486, 7.135290247812729e-76), (3345, 0.0785773370410871, 0.15764233817562853, 1.0724061618986453e-09)]
    d = spark.createDataFrame(rows, "n int, r double, k double, p double")
    for x in d.select("k", P.fisher_kappa(F.col("r")).alias("kk"), "p", P.rayleigh_p(F.col("n"), F.col("r")).alias("pp")).collect():
        assert abs(x.k - x.kk) < 1e-12 and abs(x.p - x.pp) / x.p < 1e-6


def test_best_celltype_and_acceptance(spark):
    m = spark.createDataFrame([("M", "Mac", 0.1), ("M", "T", 0.3), ("V", "Mac", 0.2), ("V", "T", 0.05)], "entity string, celltype string, d double")
    e = spark.createDataFrame([("M", "Mac"), ("V", "Mac")], "entity string, expected_celltype string")
    got = {r.entity: (r.best_celltype, r["rank"], r.passed) for r in P.acceptance_checks(m, e).collect()}
    assert got == {"M": ("Mac", 1, True), "V": ("T", 2, False)}


def test_exact_quantiles_and_ranks(spark):
    rng = np.random.default_rng(5)
    rows = [(["p", "q", None][i % 3], float(v)) for i, v in enumerate(rng.integers(0, 9, 200))]
    d = spark.createDataFrame(rows, "k string, v double")
    for r in ranking.exact_quantiles(d, ["k"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.95}).collect():
        vals = [v for k, v in rows if k == r.k]
        assert np.allclose([r.lo, r.mid, r.hi], np.quantile(vals, [0.1, 0.5, 0.95]))
    got = sorted((r.v, r.rn) for r in ranking.dense_row_number(d.select("v"), ["v"]).collect())
    assert [g[1] for g in got] == list(range(1, 201))


def test_projection_falls_back_to_circle(spark):
    labels = spark.createDataFrame([("a-1", "x"), ("b-1", "y")], "barcode string, cluster string")
    cells = spark.createDataFrame([("z", 1.0, 2.0)], "barcode string, x double, y double")
    got = {r.barcode: r for r in P.zscore_projection(labels, cells).collect()}
    assert abs(got["a-1"].axis_1 - 1) <= 0.04 and abs(got["b-1"].axis_1 + 1) <= 0.04


def test_blocks_keep_to_quadtree_squares_and_few_pairs(spark):
    """What a search sends is a few points per point: one row per pair of wide blocks, whatever the points."""
    rng = np.random.default_rng(8)
    rows = [("case", i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((6000, 2)) * 100)]
    c = spark.createDataFrame(rows, "case_id string, cell_id long, x double, y double")
    a, b = tiles.pack(c, ["case_id"], block=tiles.SEARCH), tiles.pack(c, ["case_id"])
    boxes = b.leaves.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area")).first()
    assert boxes.n == 6000 and boxes.most <= tiles.BLOCK and boxes.area <= 100 * 100
    pairs = tiles.nearest_blocks(a, b, ["case_id"])
    assert pairs.join(b.leaves.select(F.col("leaf").alias("bblock"), "n"), "bblock").agg(F.sum("n")).first()[0] <= 8 * 6000


def test_pairs_in_reach_are_not_shuffled(cells):
    plan = P.radius_neighbors(cells, 3.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("MapInArrow") < plan.index("RepartitionByExpression"), "one join with the few groups' names after the search"
    assert "a_pid" not in plan


def test_nearest_carries_the_smallest_of_equals_and_skips_odd_places(spark):
    a = spark.createDataFrame([("s", "p", 0.0, 0.0), ("s", "q", float("nan"), 0.0), ("s", "r", None, 1.0)], "case_id string, id string, x double, y double")
    b = spark.createDataFrame([("s", 1.0, 0.0, "z"), ("s", -1.0, 0.0, "k"), ("s", 0.0, 1.0, "m"), ("s", float("inf"), 0.0, "a"), ("s", None, 0.0, "a")], "case_id string, x double, y double, name string")
    got = tiles.nearest(tiles.pack(a, ["case_id"], block=2), tiles.pack(b, ["case_id"]), ["case_id"], ["id"], ["name"]).collect()
    assert [(r.id, r.d, r.name) for r in got] == [("p", 1.0, "k")]


def test_points_in_polygons_are_not_shuffled_as_pairs(spark):
    """Many polygons over one tile: no join of points with polygons, and the same pairs as the crossing rule."""
    rng = np.random.default_rng(3)
    shapes = {k: [(float(x), float(y)) for x, y in rng.random((5, 2)) * 60] for k in range(600)}
    v = spark.createDataFrame([(k, 0, 0, i, x, y) for k, ring in shapes.items() for i, (x, y) in enumerate(ring)], "polygon_id long, part int, ring int, seq int, x double, y double")
    pts = [(f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.random((40, 2)) * 60)]
    out = P.point_in_polygon(spark.createDataFrame(pts, "cell_id string, x double, y double"), v, 25.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("MapInArrow")
    want = set()
    for k, ring in shapes.items():
        for name, x, y in pts:
            crossings = sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in zip(ring, ring[1:] + ring[:1]))
            if crossings % 2:
                want.add((name, k))
    got = [(r.cell_id, r.polygon_id) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want


def test_strips_give_the_sums_of_circles():
    """Random places, rows, lattices, lines both ways and knots, whole numbers exactly."""
    r = np.random.default_rng(1)
    shapes = [lambda n: r.random((n, 2)) * 50, lambda n: np.stack([r.random(n) * 50, r.integers(0, 40, n)], axis=1), lambda n: r.integers(0, 12, (n, 2)).astype(float), lambda n: np.stack([np.full(n, 3.0), r.random(n) * 50], axis=1),
              lambda n: np.stack([r.random(n) * 50, np.full(n, 3.0)], axis=1), lambda n: np.concatenate([r.normal(size=(n, 2)) * 1e-3, r.random((n, 2)) * 100]) + 1e6]
    for k in range(120):
        a, b = (shapes[k % 6](int(r.integers(1, 300))) for _ in "ab")
        radius, values = float(r.choice([0.0, 1.0, 5.0, 7.5, 20.0, 1e-3, 200.0])), np.column_stack([np.ones(len(b)), r.normal(size=len(b))])
        got = np.zeros((len(a), 2))
        for at, sums in tiles.circle_sums(a[:, 0], a[:, 1], b[:, 0], b[:, 1], values, radius):
            got[at] += sums
        want = (np.hypot(0, np.sqrt((a[:, :1] - b[:, 0]) ** 2 + (a[:, 1:] - b[:, 1]) ** 2)) <= radius).astype(float) @ values
        assert (got[:, 0] == want[:, 0]).all() and np.abs(got - want).max() < 1e-9


def test_distances_that_round_to_the_radius_are_inside(spark):
    """As in SQL, where the root is compared: the squares of these add up to one unit above 6400."""
    df = spark.createDataFrame([(1, 2.36841, 0.0), (2, 50.368410000000004, 64.0)], "cell_id int, x double, y double")
    assert [x.neighbors for x in P.neighbor_counts(df, [80.0]).collect()] == [1, 1]
    assert P.radius_neighbors(df, 80.0).count() == 2


def test_a_point_is_sent_once_to_a_crowded_tile(spark, monkeypatch):
    def arrivals(id_):
        def run(batches):
            for b in batches:
                points = b.filter(pc.equal(b.column("kind"), 1))
                yield pa.RecordBatch.from_arrays([points.column("case_id"), points.column(id_), points.column("polygon_id")], ["case_id", id_, "polygon_id"])
        return run
    monkeypatch.setattr(P, "_inside", arrivals)
    v = spark.createDataFrame([(k, 0, 0, i, x, y) for k in range(600) for i, (x, y) in enumerate([(1.0, 1.0), (20.0, 2.0), (10.0, 20.0)])], "polygon_id long, part int, ring int, seq int, x double, y double")
    pts = spark.createDataFrame([(i, 2.0 + i / 10, 5.0) for i in range(40)], "cell_id int, x double, y double")
    assert P.point_in_polygon(pts, v, 25.0).count() == 40
