"""Alignment, expression and pathway operators bound to the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import align, expression as X, specs
from .bindings import (STRUCTURES, CELLS, CLUSTER_STRUCTURE, EXPRESSION, GROUPS_TEXT, STRUCTURE_OF, cells, cluster_structure, expression,
                       structure_of, table)
from .registry import plan

DE = f"""{CELLS}, {EXPRESSION},
 sizes AS (SELECT cluster, count(*) AS k, (SELECT count(*) FROM cells) AS total FROM cells GROUP BY 1),
 sums AS (SELECT gene, cluster, sum(n) AS s FROM expression JOIN cells USING (cell_id) GROUP BY 1, 2),
 totals AS (SELECT gene, sum(s) AS t FROM sums GROUP BY 1),
 means AS (SELECT gene, cluster, coalesce(s, 0) / k AS m, (t - coalesce(s, 0)) / (total - k) AS r
   FROM totals CROSS JOIN sizes LEFT JOIN sums USING (gene, cluster)),
 de AS (SELECT gene, cluster, log2((m + 0.05) / (r + 0.05)) AS log2fc, m AS mean_counts FROM means)"""


def _de(spark, sf):
    c = cells(spark, sf).select("cell_id", "cluster")
    return X.pseudobulk_de(expression(spark, sf), c)


def _sets(spark, sf):
    return table(spark, sf, "part").select(F.col("p_type").alias("pathway"), F.col("p_partkey").cast("string").alias("gene"))


@plan("pseudobulk_de", f"""WITH {DE} SELECT gene, cluster, round(log2fc, 6) AS log2fc,
  CASE WHEN abs(log2fc) >= 0.5 THEN 0.001::DOUBLE ELSE 1::DOUBLE END AS adj_p, round(mean_counts, 6) AS mean_counts FROM de""")
def pseudobulk_de(spark, sf):
    return _de(spark, sf).select("gene", "cluster", F.round("log2fc", 6).alias("log2fc"), "adj_p",
                                 F.round("mean_counts", 6).alias("mean_counts"))


def _clusters(spark, sf):
    """All labels, as the columns of a wide table."""
    return [r[0] for r in cells(spark, sf).select("cluster").distinct().orderBy("cluster").collect()]


@plan("diffexp_wide", f"""WITH {DE} SELECT gene AS "Feature Name",
  {', '.join(f'''round(max(log2fc) FILTER (cluster = '{k}'), 6) AS "Cluster {k} Log2 fold change",
   max(CASE WHEN abs(log2fc) >= 0.5 THEN 0.001::DOUBLE ELSE 1::DOUBLE END) FILTER (cluster = '{k}') AS "Cluster {k} Adjusted p value",
   round(max(mean_counts) FILTER (cluster = '{k}'), 6) AS "Cluster {k} Mean Counts"''' for k in STRUCTURES)} FROM de GROUP BY 1""")
def diffexp_wide(spark, sf):
    return X.diffexp_wide(pseudobulk_de(spark, sf), _clusters(spark, sf))


@plan("align_cells_clusters", f"""WITH {CELLS} SELECT cell_id, c_mktsegment AS cluster, x, y FROM cells
  JOIN customer ON c_custkey = custkey AND c_nationkey <> 3""")
def align_cells_clusters(spark, sf):
    labels = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"),
        F.when(F.col("c_nationkey") == 3, " ").otherwise(F.concat(F.lit(" "), "c_mktsegment")).alias("cluster"))
    d = align.align_cells_clusters(cells(spark, sf).drop("cluster"), labels, on="custkey")
    return d.select("cell_id", "cluster", "x", "y")


@plan("join_with_stem_fallback", "SELECT c_name || '-1' AS barcode, c_mktsegment AS cluster, c_acctbal AS x FROM customer")
def join_with_stem_fallback(spark, sf):
    c = table(spark, sf, "customer")
    labels = c.select(F.concat("c_name", F.lit("-1")).alias("barcode"), F.col("c_mktsegment").alias("cluster"))
    return align.join_with_stem_fallback(labels, c.select(F.col("c_name").alias("barcode"), F.col("c_acctbal").alias("x")))


@plan("exact_then_stem_lookup", """SELECT c_name || CASE WHEN c_nationkey < 10 THEN '-1' ELSE '-2' END AS barcode,
  CASE WHEN c_nationkey < 10 THEN c_mktsegment ELSE 'late ' || c_mktsegment END AS cluster FROM customer WHERE c_acctbal > 0""")
def exact_then_stem_lookup(spark, sf):
    c = table(spark, sf, "customer")
    rows = c.select(F.concat("c_name", F.when(F.col("c_nationkey") < 10, "-1").otherwise("-2")).alias("barcode"))
    known = c.filter("c_acctbal > 0").select(F.concat("c_name", F.lit("-1")).alias("barcode"), F.col("c_mktsegment").alias("cluster"),
                                             F.lit(1).alias("line"))
    late = known.select(F.regexp_replace("barcode", "-1$", "-7").alias("barcode"), F.concat(F.lit("late "), "cluster").alias("cluster"),
                        F.lit(2).alias("line"))
    return align.exact_then_stem_lookup(rows, known.unionByName(late), order="line")


@plan("cluster_to_structure", """SELECT cluster_id, arg_max(structure_id, n) AS structure_id FROM (
  SELECT o_orderpriority AS cluster_id, o_orderstatus AS structure_id, count(*) * 10 - ascii(o_orderstatus) / 1000.0 AS n
  FROM orders GROUP BY 1, 2) GROUP BY 1""")
def cluster_to_structure(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    reviews = counts.groupBy(F.col("o_orderstatus").alias("structure_id")).agg(F.collect_list(F.struct(
        F.lit("").alias("cluster_id"), F.concat(F.lit(" "), "o_orderpriority").alias("cluster"),
        F.col("n").cast("string").alias("cell_count"), F.lit("0.5").alias("fraction"))).alias("top_clusters"))
    return align.cluster_to_structure(reviews.withColumn("review_no", F.ascii("structure_id")))


@plan("gene_set_join", f"""WITH {EXPRESSION} SELECT p_type AS pathway, count(*) AS n_rows, round(sum(n), 3) AS total
  FROM expression JOIN part ON p_partkey = gene GROUP BY 1""")
def gene_set_join(spark, sf):
    e = expression(spark, sf).withColumn("gene", F.concat(F.lit(" "), F.col("gene").cast("string")))
    return (align.gene_set_join(e, _sets(spark, sf)).groupBy("pathway")
            .agg(F.count("*").alias("n_rows"), F.round(F.sum("n"), 3).alias("total")))


@plan("label_selected_structure", f"""WITH {CELLS} SELECT cell_id, CAST(CASE cluster WHEN '3-MEDIUM' THEN 2
  WHEN '5-LOW' THEN 3 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 0 END AS INTEGER) AS selected_structure_id FROM cells""")
def label_selected_structure(spark, sf):
    spec = specs.structure_spec(spark, "a: none\n3-MEDIUM\n4-NOT SPECIFIED, 5-LOW")
    return align.label_selected_structure(cells(spark, sf), spec).select("cell_id", "selected_structure_id")


@plan("missing_structures", f"""WITH {CELLS}, spec(structure_id, structure_name, cluster) AS (VALUES (1, 'Structure 1', 'none'),
    (2, 'Structure 2', '3-MEDIUM'), (3, 'Structure 3', '4-NOT SPECIFIED'), (4, 'Structure 4', 'nowhere'))
  SELECT structure_id, structure_name FROM spec WHERE cluster NOT IN (SELECT cluster FROM cells)""")
def missing_structures(spark, sf):
    spec = specs.structure_spec(spark, "none;3-MEDIUM;4-NOT SPECIFIED;nowhere")
    return align.missing_structures(spec, cells(spark, sf)).select("structure_id", "structure_name")


@plan("vocabulary_check", """WITH vocab AS (SELECT DISTINCT c_mktsegment AS id FROM customer WHERE c_mktsegment <> 'BUILDING'),
  a AS (SELECT c_custkey, c_mktsegment AS label_id, CASE WHEN c_nationkey < 5 THEN 'BUILDING' ELSE 'MACHINERY' END AS alt FROM customer)
  SELECT c_custkey, v.id AS label, CASE WHEN v.id IS NOT NULL AND alt = 'MACHINERY' THEN 'accepted' ELSE 'rejected' END AS status,
   CASE WHEN alt = 'BUILDING' THEN 'BUILDING' ELSE '' END AS unknown_alternatives,
   CASE WHEN alt = 'MACHINERY' AND label_id <> alt THEN 'MACHINERY' ELSE '' END AS alternative_labels
  FROM a LEFT JOIN vocab v ON v.id = label_id""")
def vocabulary_check(spark, sf):
    c = table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    vocab = c.filter(seg != "BUILDING").select(seg.alias("id"), seg.alias("label"), F.lower(seg).alias("broad_family"),
                                               F.lit("normal").alias("malignancy_state")).distinct()
    ann = c.select("c_custkey", seg.alias("label_id"),
                   F.array(F.when(F.col("c_nationkey") < 5, "BUILDING").otherwise("MACHINERY")).alias("alternative_label_ids"))
    d = align.vocabulary_check(ann, vocab, key="c_custkey")
    return d.select("c_custkey", "label", "status", F.array_join("unknown_alternatives", ",").alias("unknown_alternatives"),
                    F.array_join("alternative_labels", ",").alias("alternative_labels"))


_SCORES = """SELECT cluster AS cluster_id, p_type AS pathway, avg(log2fc) AS score, count(DISTINCT gene) AS n_genes,
   string_agg(DISTINCT CAST(gene AS VARCHAR), ';' ORDER BY CAST(gene AS VARCHAR)) AS matched_genes
  FROM de JOIN part ON p_partkey = gene GROUP BY 1, 2"""


def _pathways(spark, sf):
    return X.pathway_scores(X.normalize_diffexp(_de(spark, sf).select("gene", "cluster", "log2fc")), _sets(spark, sf))


@plan("pathway_scores_long", f"WITH {DE} SELECT cluster_id, pathway, round(score, 6) AS score, n_genes, matched_genes FROM ({_SCORES})")
def pathway_scores_long(spark, sf):
    return _pathways(spark, sf).withColumn("score", F.round("score", 6))


@plan("pathway_scores_wide", f"WITH {DE} SELECT cluster_id, pathway, round(score, 6) AS score, n_genes FROM ({_SCORES})")
def pathway_scores_wide(spark, sf):
    wide = X.diffexp_wide(_de(spark, sf), _clusters(spark, sf))
    return (X.pathway_scores(X.normalize_diffexp(wide), _sets(spark, sf)).drop("matched_genes")
            .withColumn("score", F.round("score", 6)))


def STRUCTURE_SCORES(source: str) -> str:
    return f"""SELECT structure_id,
   coalesce(array_to_string(list_slice(list(pathway || ':' || printf('%.3f', score) ORDER BY score DESC, pathway) FILTER (score > 0), 1, 5), ';'), '') AS top_activated_pathways,
   coalesce(array_to_string(list_slice(list(pathway || ':' || printf('%.3f', score) ORDER BY score, pathway) FILTER (score < 0), 1, 5), ';'), '') AS top_suppressed_pathways,
   round(max(score) - min(score), 6) AS pathway_separation_score,
   string_agg(pathway || '=' || printf('%.3f', score), ',' ORDER BY pathway) AS pathway_scores
  FROM ({source}) GROUP BY 1"""


def show_scores(d):
    text = F.transform(F.map_entries("pathway_scores"), lambda e: F.format_string("%s=%.3f", e["key"], e["value"]))
    return (d.withColumn("pathway_scores", F.array_join(text, ","))
            .withColumn("pathway_separation_score", F.round("pathway_separation_score", 6)))


MEANS = f"""SELECT structure_id, pathway, avg(score) AS score FROM ({_SCORES}) JOIN cluster_structure USING (cluster_id) GROUP BY 1, 2"""


def structure_pathways(spark, sf):
    return X.pathways_to_structures(_pathways(spark, sf), cluster_structure(spark, sf))


@plan("pathways_to_structures", f"WITH {DE}, {CLUSTER_STRUCTURE} {STRUCTURE_SCORES(MEANS)}")
def pathways_to_structures(spark, sf):
    return show_scores(structure_pathways(spark, sf))


@plan("route_pathway_input", f"""WITH rows AS (SELECT p_brand AS pathway, p_retailprice / 1000 - 1 AS score,
    CASE WHEN p_size > 25 THEN CAST(p_size % 4 AS VARCHAR) ELSE s.structure_id END AS structure_id
   FROM part JOIN (SELECT '1-URGENT' AS c, '1' AS structure_id UNION ALL SELECT '5-LOW', '3') s
   ON c = CASE WHEN p_size % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END)
  {STRUCTURE_SCORES('SELECT structure_id, pathway, avg(score) AS score FROM rows GROUP BY 1, 2')}""")
def route_pathway_input(spark, sf):
    p = table(spark, sf, "part")
    raw = p.select(F.when(F.col("p_size") > 25, F.concat((F.col("p_size") % 4).cast("string"), F.lit(".0"))).alias("Structure"),
                   F.when(F.col("p_size") % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("cluster id"),
                   F.col("p_brand").alias("Gene-Set"), (F.col("p_retailprice") / 1000 - 1).cast("string").alias("Activity"))
    direct, by_cluster = X.route_pathway_input(raw)
    return show_scores(X.pathways_to_structures(by_cluster, cluster_structure(spark, sf), direct))
