"""How the domain tables map onto the shared test tables.

Every helper has a SQL fragment of the same name in capitals, so a plan and its
oracle start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cells(spark, sf) -> DataFrame:
    """Cells: id, x, y, cluster label, one case per customer nation is *not* implied (single slide)."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("cell_id"),
        (F.col("o_totalprice") / 1000.0).alias("x"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double").alias("y"),
        F.col("o_orderpriority").alias("cluster"),
        F.col("o_custkey").alias("custkey"),
    )


CELLS = """cells AS (SELECT o_orderkey AS cell_id, o_totalprice / CAST(1000 AS DOUBLE) AS x,
  CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS y,
  o_orderpriority AS cluster, o_custkey AS custkey FROM orders)"""

STRUCTURES = {"1-URGENT": 1, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 3}
GROUPS_TEXT = "Urgent side: 1-URGENT, 2-HIGH\nmiddle: 3-MEDIUM ; rest: 4-NOT SPECIFIED,5-LOW"


def structure_of(cluster) -> Column:
    c = F.col(cluster) if isinstance(cluster, str) else cluster
    out = None
    for label, sid in STRUCTURES.items():
        out = F.when(c == label, sid) if out is None else out.when(c == label, sid)
    return out.cast("int")


def STRUCTURE_OF(c: str) -> str:
    arms = " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in STRUCTURES.items())
    return f"CAST(CASE {arms} END AS INTEGER)"


def cluster_structure(spark, sf) -> DataFrame:
    """cluster -> structure map derived from the labels present."""
    return (table(spark, sf, "orders").select(F.col("o_orderpriority").alias("cluster_id")).distinct()
            .select("cluster_id", structure_of("cluster_id").cast("string").alias("structure_id")))


CLUSTER_STRUCTURE = f"""cluster_structure AS (SELECT DISTINCT o_orderpriority AS cluster_id,
  CAST({STRUCTURE_OF('o_orderpriority')} AS VARCHAR) AS structure_id FROM orders)"""


def expression(spark, sf) -> DataFrame:
    """Transcript counts in long form: gene, cell, n (duplicates allowed)."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_partkey").alias("gene"), F.col("l_orderkey").alias("cell_id"),
                     F.col("l_quantity").alias("n"))


EXPRESSION = "expression AS (SELECT l_partkey AS gene, l_orderkey AS cell_id, l_quantity AS n FROM lineitem)"

LABELS = {
    "view": "Invasive tumor epithelium",
    "purchase": "Immune infiltrate",
    "click": "Stroma collagen",
    "error": "Blur artifact",
    "signup": "Normal lobule",
}


def visual_label(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = None
    for k, v in LABELS.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def VISUAL_LABEL(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} = '{k}' THEN '{v}'" for k, v in LABELS.items()) + " END"


def contours(spark, sf) -> DataFrame:
    """Contour classifications: top class from the event, a second class from its properties."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    score = F.col("value") / 400.0
    return e.select(
        F.col("event_id").alias("contour_id"),
        F.when(F.col("user_id") % 11 != 0, (F.col("user_id") % 7).cast("int")).alias("structure_id"),
        F.when(F.col("user_id") % 11 != 0, F.concat(F.lit("Region "), (F.col("user_id") % 7).cast("string"))).alias("structure_name"),
        visual_label("event_type").alias("top_label"),
        score.alias("top_score"),
        F.when(F.col("value") >= 1.0, F.array(
            F.struct(F.col("event_type").alias("label_id"), visual_label("event_type").alias("label"), score.alias("score")),
            F.struct(F.when(k < 50, "stroma_low").otherwise("plasma_high").alias("label_id"),
                     F.when(k < 50, "Fibrous stroma").otherwise("Plasma cells").alias("label"),
                     (k / 200.0).alias("score")),
        )).alias("top_classes"),
    )


CONTOURS = f"""contours AS (SELECT event_id AS contour_id,
  CASE WHEN user_id % 11 <> 0 THEN CAST(user_id % 7 AS INTEGER) END AS structure_id,
  CASE WHEN user_id % 11 <> 0 THEN 'Region ' || CAST(user_id % 7 AS VARCHAR) END AS structure_name,
  {VISUAL_LABEL('event_type')} AS top_label, value / CAST(400 AS DOUBLE) AS top_score,
  event_type AS label1, value >= 1.0 AS has_classes,
  CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events),
 classes AS (
  SELECT contour_id, structure_id, structure_name, 1 AS pos, label1 AS label_id, top_label AS label, top_score AS score
    FROM contours WHERE has_classes
  UNION ALL
  SELECT contour_id, structure_id, structure_name, 2, CASE WHEN k < 50 THEN 'stroma_low' ELSE 'plasma_high' END,
    CASE WHEN k < 50 THEN 'Fibrous stroma' ELSE 'Plasma cells' END, k / CAST(200 AS DOUBLE)
    FROM contours WHERE has_classes)"""


def bundles(spark, sf) -> DataFrame:
    """Evidence bundles: status by value range, source by event type."""
    return bundle_columns(table(spark, sf, "events"))


def bundle_columns(e: DataFrame) -> DataFrame:
    v = F.col("value")
    return e.select(
        F.concat(F.lit("ev."), F.col("event_id").cast("string")).alias("evidence_id"),
        F.concat(F.lit("case-"), (F.col("user_id") % 5).cast("string")).alias("case_id"),
        F.col("event_type").alias("source"),
        F.col("user_id").cast("string").alias("unit_id"),
        F.when(v < 30, "ok").when(v < 80, "warning").when(v < 200, "fail").otherwise("unknown").alias("qc_status"),
        F.when(v > 150, F.concat(F.lit("conflict on "), F.col("event_type"))).otherwise("").alias("conflict_note"),
        F.col("ts"), v.alias("value"), F.col("props"),
    )


BUNDLES = """bundles AS (SELECT 'ev.' || CAST(event_id AS VARCHAR) AS evidence_id,
  'case-' || CAST(user_id % 5 AS VARCHAR) AS case_id, event_type AS source, CAST(user_id AS VARCHAR) AS unit_id,
  CASE WHEN value < 30 THEN 'ok' WHEN value < 80 THEN 'warning' WHEN value < 200 THEN 'fail' ELSE 'unknown' END AS qc_status,
  CASE WHEN value > 150 THEN 'conflict on ' || event_type ELSE '' END AS conflict_note, ts, value, props FROM events)"""
