"""Rows at the edge of an operator's contract, each with the answer it must give."""

import pytest
from pyspark.sql import functions as F

from stromalens.functions import lineage, scalars as S
from stromalens.operators import evidence as E, grid as G, retrieval as V, review as R, spatial as P


def test_white_space_of_any_kind_is_cut(spark):
    rows = [("\t3.0\n",), ("\r\n",), (" cluster 7\t",), ("12345678901234567890",)]
    got = spark.createDataFrame(rows, "s string").select(S.safe_double("s", 0.5), S.canonical_id("s")).collect()
    assert [tuple(r) for r in got] == [(3.0, "3"), (0.5, None), (0.5, "cluster 7"), (1.2345678901234567e19, "12345678901234567890")]


def test_reviews_without_evidence_are_left_alone(spark):
    own = [f"line {i % 15}" for i in range(20)]
    reviews = spark.createDataFrame([("9", own)], "structure_id string, key_evidence array<string>")
    part = "struct<top_reference_label string, mean_reference_confidence double, ambiguous_fraction double>"
    schema = (f"structure_id string, rna_foundation {part.replace(' string', ':string').replace(' double', ':double')}, pathway_activity struct<top_activated_pathways:string>, "
              "he_morphology struct<dominant_signal:string,dominant_visual_label:string,visual_entropy:double>, niche_fusion struct<consistency_summary:string>")
    evidence = spark.createDataFrame([("1", None, None, None, None)], schema)
    assert E.attach_evidence(reviews, evidence, limit=14).first()["key_evidence"] == own


def square(part, x, y, size, step=1, ring=0):
    return [("p", part, ring, i * step, float(x + a * size), float(y + b * size)) for i, (a, b) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]


def test_gaps_parts_and_holes_of_polygons(spark):
    rows = [*square(0, 0, 0, 10, step=5), *square(1, 5, 5, 10), *square(0, 2, 2, 2, ring=1)]
    v = spark.createDataFrame(rows, "polygon_id string, part int, ring int, seq int, x double, y double")
    pts = spark.createDataFrame([(1, 7.0, 7.0), (2, 3.0, 3.0), (3, 12.0, 12.0), (4, 1.0, 7.0), (5, 12.0, 2.0)], "cell_id int, x double, y double")
    assert {r.cell_id for r in P.point_in_polygon(pts, v, 4.0).collect()} == {1, 3, 4}


def test_cleaned_rings_stay_whole(spark):
    ring = [(0, 0), (0, 0), (10, 0), (10, 10), (10, 10), (0, 10), (0, 5)]
    v = spark.createDataFrame([("r", i, float(x), float(y)) for i, (x, y) in enumerate(ring)], "ring string, seq long, x double, y double")
    clean = G.dedup_consecutive(v, ["ring"])
    assert [r.seq for r in clean.orderBy("seq").collect()] == [0, 1, 2, 3, 4]
    thin = G.thin_vertices(clean, ["ring"], 3)
    assert thin.count() == 3 and thin.filter("thinned").count() == 3
    closed = G.close_rings(thin, ["ring"], even_if_closed=False)
    assert closed.count() == 4 and G.close_rings(closed, ["ring"], even_if_closed=False).count() == 4
    inside = P.point_in_polygon(spark.createDataFrame([(1, 5.0, 7.0)], "cell_id int, x double, y double"),
                                clean.select(F.col("ring").alias("polygon_id"), F.lit(0).alias("part"), F.lit(0).alias("ring"), "seq", "x", "y"), 4.0)
    assert inside.count() == 1


def test_equal_versions_take_the_incoming_row(spark):
    schema = "point_id string, version int, text string"
    old = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], schema)
    new = spark.createDataFrame([("a", 1, "new"), ("b", 1, "late"), ("c", 1, "x"), ("c", 1, "y")], schema)
    for parts in (1, 7):
        got = {r.point_id: r.text for r in V.upsert(old.repartition(parts), new.repartition(parts)).collect()}
        assert got == {"a": "new", "b": "old", "c": "y"}


@pytest.mark.parametrize("report", ["[1,2]", "3", '"x"', "null"])
def test_reports_that_are_no_object_are_fatal(spark, report):
    got = R.qc_verdict(spark.createDataFrame([(report,)], "report string"), "report").first()
    assert got["qc_status"] == "fail" and got["fatal_errors"] == ["QC report is not a JSON object."]


def test_intermediate_tables_can_be_released(spark):
    import os
    held = lineage.materialize(spark.range(3))
    folder = lineage.shared_dir(spark).removeprefix("file:").replace("//", "/")
    assert held.count() == 3 and os.path.isdir(folder)
    lineage.release(spark)
    assert not os.path.exists(folder)


def test_no_folder_of_our_own_on_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(ValueError):
        lineage.shared_dir(Session())


def test_missing_structures_joins_each_label_once(spark):
    from stromalens.operators import align

    spec = spark.createDataFrame([(1, "A", ["x"]), (2, "B", ["y", "z"]), (3, "C", [])], "structure_id int, structure_name string, cluster_ids array<string>")
    cells = spark.range(1000).selectExpr("id AS cell_id", "CASE WHEN id % 3 = 0 THEN 'z' WHEN id % 3 = 1 THEN 'w' END AS cluster")
    out = align.missing_structures(spec, cells)
    assert "Aggregate [cluster" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.structure_id for r in out.collect()) == [1, 3]
