"""Sources and sinks: tables are written by Spark and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.lineage import shared_dir
from ..operators import grid as G, review as R
from ..sources import files
from .bindings import CELLS, STRUCTURE_OF, cells, structure_of, table
from .registry import plan
from .spatial_plans import squares


def _scratch(spark, name):
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}/{name}"


@plan("read_delimited", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment || ', "' || c_nationkey || '"' END AS note FROM customer""")
def read_delimited(spark, sf):
    path = _scratch(spark, "customers.tsv")
    note = F.when(F.col("c_nationkey") == 3, "").otherwise(F.concat("c_mktsegment", F.lit(', "'), F.col("c_nationkey").cast("string"), F.lit('"')))
    table(spark, sf, "customer").select("c_custkey", note.alias("note")).write.csv(path, header=True, sep="\t", quote='"', escape='"')
    return files.read_delimited(spark, path)


@plan("write_table", """SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, '' AS segment FROM nation UNION ALL SELECT CAST(c_custkey AS VARCHAR), '', c_mktsegment FROM customer""")
def write_table(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("segment"))
    out = files.write_table(files.union_tables(n, c), _scratch(spark, "table"))
    return spark.read.schema("id string, name string, segment string").json(out["json"])


@plan("write_cells", f"WITH {CELLS} SELECT cell_id, {STRUCTURE_OF('cluster')} AS structure_id, x, y FROM cells")
def write_cells(spark, sf):
    d = cells(spark, sf).select("cell_id", structure_of("cluster").alias("structure_id"), "x", "y")
    return spark.read.parquet(files.write_cells(d, _scratch(spark, "cells")))


def _collections(spark, sf):
    """One GeoJSON file per supplier nation, written from the supplier squares."""
    path = _scratch(spark, "geojson")
    ring = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda v: F.array(v["x"], v["y"]))
    rings = squares(spark, sf).groupBy("polygon_id", "ring").agg(ring.alias("r"))
    shapes = rings.groupBy("polygon_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "r"))), lambda v: v["r"]).alias("rings"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("polygon_id"), F.col("s_nationkey").alias("nation"), "s_name", "s_acctbal")
    props = F.struct(F.when(F.col("s_acctbal") > 2000, F.col("s_name")).otherwise("").alias("name"), F.col("nation").alias("structure_id"))
    feature = F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates")).alias("geometry"))
    docs = shapes.join(s, "polygon_id").groupBy("nation").agg(F.array_sort(F.collect_list(F.struct("polygon_id", feature.alias("f")))).alias("fs"))
    text = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("fs", lambda v: v["f"]).alias("features")))
    docs.select("nation", text.alias("value")).repartition("nation").write.partitionBy("nation").text(path)
    return path


FEATURES = """f AS (SELECT s_nationkey AS nation, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS feature_no, * FROM supplier),
 named AS (SELECT *, CASE WHEN s_acctbal > 2000 THEN s_name ELSE 'contour_' || feature_no END AS contour_id FROM f)"""


@plan("read_geojson_features", f"WITH {FEATURES} SELECT CAST(nation AS VARCHAR) AS structure_id, CAST(feature_no AS INTEGER) AS feature_no, contour_id, 'Polygon' AS geometry_type FROM named")
def read_geojson_features(spark, sf):
    d = files.read_geojson_features(spark, f"{_collections(spark, sf)}/*")
    return d.select(F.col("properties")["structure_id"].alias("structure_id"), "feature_no", "contour_id", "geometry_type")


@plan("geojson_vertices", f"""WITH {FEATURES} SELECT CAST(nation AS VARCHAR) AS structure_id, contour_id, CAST(ring AS INTEGER) AS ring, round(min(CAST(s_suppkey * 37 % 500 AS DOUBLE) - (s_nationkey + 5) / CASE ring WHEN 1 THEN 2 ELSE 1 END), 6) AS x0,
  count(*) * 4 AS n FROM named, (VALUES (0), (1)) r(ring) WHERE ring = 0 OR s_acctbal > 5000 GROUP BY 1, 2, 3""")
def geojson_vertices(spark, sf):
    f = files.read_geojson_features(spark, f"{_collections(spark, sf)}/*")
    v = files.geojson_vertices(f.withColumn("contour_id", F.concat(F.col("properties")["structure_id"], F.lit("|"), "contour_id")))
    parts = F.split("contour_id", r"\|")
    return (v.groupBy("contour_id", "ring").agg(F.round(F.min("x"), 6).alias("x0"), F.count("*").alias("n"))
            .select(parts[0].alias("structure_id"), parts[1].alias("contour_id"), "ring", "x0", "n"))


@plan("write_annotations", """SELECT 'S' || s_nationkey || ' Area #' || s_suppkey || '.1' AS "Selection", CAST(s_suppkey AS VARCHAR) AS "X", count(*) AS n FROM supplier, (VALUES (0), (1), (2)) v(i) GROUP BY 1, 2""")
def write_annotations(spark, sf):
    from ..functions import scalars as S
    s = table(spark, sf, "supplier")
    d = s.select(F.lit("case").alias("case_id"), F.col("s_nationkey").alias("structure_id"), F.lit("Area").alias("structure_name"), S.palette_color("s_nationkey").alias("structure_color"),
                 F.col("s_suppkey").alias("component_index"), F.lit(1).alias("polygon_index"), S.selection_name("s_nationkey", F.lit("Area"), "s_suppkey", F.lit(1), F.lit(False)).alias("selection"),
                 F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("seq"), F.col("s_suppkey").alias("x"), F.col("s_suppkey").alias("y"))
    out = G.write_annotations(d, _scratch(spark, "annotations"))
    return files.read_delimited(spark, out["vertices"]).groupBy("Selection", "X").agg(F.count("*").alias("n"))


@plan("ledger_append", "SELECT CAST(event_id AS VARCHAR) AS unit_id, event_type AS tool FROM events")
def ledger_append(spark, sf):
    path = _scratch(spark, "ledger")
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("unit_id"), "event_type", F.lit("h").alias("input_hash"), F.col("value").alias("elapsed_seconds"),
                                          F.concat(F.lit("out/"), F.col("event_id").cast("string")).alias("output_artifact"))
    for tool in ("view", "purchase", "click", "error", "signup"):
        R.ledger_append(e.filter(F.col("event_type") == tool), tool, path)
    return spark.read.parquet(path).select("unit_id", "tool")


@plan("stale_outputs", """SELECT CAST(user_id AS VARCHAR) AS unit_id, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS missing FROM events
  GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') > 0 OR max(ts) FILTER (event_type = 'click') > min(ts) FILTER (event_type NOT IN ('error', 'click'))""")
def stale_outputs(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("unit_id"), F.col("event_id").cast("string").alias("path"), F.col("ts").alias("modificationTime"), "event_type")
    made = e.filter("event_type NOT IN ('error', 'click')")
    return R.stale_outputs(e.filter("event_type = 'click'"), made, e.filter("event_type <> 'click'").select("unit_id", "path")).select("unit_id", "missing")
