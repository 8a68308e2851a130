import hashlib
import json

import pytest

from stromalens.operators import review as R
from stromalens.sources import files


def test_delimited(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes(b"\xef\xbb\xbfBarcode\tCluster\nAA-1\t3\nBB-1\t\n")
    rows = files.read_delimited(spark, str(tmp_path / "a.tsv")).collect()
    assert [tuple(r) for r in rows] == [("AA-1", "3"), ("BB-1", None)] and rows[0].asDict().keys() == {"Barcode", "Cluster"}


def test_cluster_table_priority(spark, tmp_path):
    for name in ("zeta", "gene_expression_graphclust", "alpha"):
        d = tmp_path / "analysis" / "clustering" / name
        d.mkdir(parents=True)
        (d / "clusters.csv").write_text("Barcode,Cluster\n")
    assert files.find_cluster_table(spark, str(tmp_path)).endswith("gene_expression_graphclust/clusters.csv")
    (tmp_path / "analysis/clustering/gene_expression_graphclust/clusters.csv").unlink()
    assert files.find_cluster_table(spark, str(tmp_path)).endswith("clustering/alpha/clusters.csv")
    with pytest.raises(FileNotFoundError):
        (tmp_path / "empty").mkdir()
        (tmp_path / "empty" / "clusters.csv").write_text("x\n")
        files.find_cluster_table(spark, str(tmp_path / "empty"))


def test_jsonl_bad_lines_count(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"evidence_id": "a"}\nbroken\n[1]\n{"evidence_id": "b"}\n{"evidence_id": "c"}\n')
    got = [r.evidence_id for r in files.read_evidence_jsonl(spark, str(tmp_path / "e.jsonl"), "evidence_id string", 4).collect()]
    assert got == ["a", "b"]


def test_first_json(spark, tmp_path):
    (tmp_path / "region_qc_report.json").write_text("[1, 2]")
    (tmp_path / "qc_report.json").write_text('{"status": "ok"}')
    got = files.read_first_json(spark, str(tmp_path), ["region_qc_report.json", "qc_report.json"]).collect()
    assert [r.name for r in got] == ["qc_report.json"]


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "", "polygon_id": "p1"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}},
        {"type": "Feature", "properties": None, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1]]], [[[5, 5], [6, 5], [6, 6]]]]}}]}
    p = tmp_path / "c.geojson"
    p.write_text(json.dumps(doc, indent=2))
    f = files.read_geojson_features(spark, str(p))
    assert [r.contour_id for r in f.collect()] == ["p1", "contour_2"]
    assert {(r.contour_id, r.part): r["count"] for r in files.geojson_vertices(f).groupBy("contour_id", "part").count().collect()} == {
        ("p1", 0): 3, ("contour_2", 0): 3, ("contour_2", 1): 3}
    p.write_text('{"type": "FeatureCollection", "features": []}')
    with pytest.raises(Exception, match="no features"):
        files.read_geojson_features(spark, str(p)).collect()


def test_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_bytes(b"{}")
    (tmp_path / "sub" / "b.csv").write_bytes(b"x" * 50)
    got = {r.name: r for r in files.file_inventory(spark, str(tmp_path), hash_below=10).collect()}
    assert got["a.json"].sha256 == hashlib.sha256(b"{}").hexdigest() and got["a.json"].media_type == "application/json"
    assert got["b.csv"].sha256 is None and got["b.csv"].size_bytes == 50


def test_union_and_write(spark, tmp_path):
    a = spark.createDataFrame([("1", ["p"])], "id string, tags array<string>")
    b = spark.createDataFrame([("2", "z")], "id string, note string")
    out = files.write_table(files.union_tables(a, b), str(tmp_path / "t"))
    got = {r.id: r for r in files.read_delimited(spark, out["csv"]).collect()}
    assert got["1"].tags == '["p"]' and got["1"].note is None and got["2"].note == "z"


def test_pending_and_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    u = spark.createDataFrame([("a", "h1", 0.5, "o/a"), ("b", "h1", 0.5, "o/b")], "unit_id string, input_hash string, elapsed_seconds double, output_artifact string")
    R.ledger_append(u, "tool", path)
    todo = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h1"), ("a", "h2")], "unit_id string, input_hash string")
    there = spark.createDataFrame([("o/a",)], "path string")
    got = {tuple(r) for r in R.pending_work(todo, spark.read.parquet(path), there).collect()}
    assert got == {("b", "h1"), ("c", "h1"), ("a", "h2")}
