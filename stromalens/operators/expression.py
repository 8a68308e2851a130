"""Transcript counts: differential expression, pathway scores, program activity."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from ..functions.lineage import materialize
from .align import gene_set_join
from . import tiles
from .ranking import average_rank, exact_quantiles, ranks_of_counts
from .spatial import CASE, with_case

PSEUDOCOUNT = 0.05

# Accepted column names
CLUSTER_NAMES = ("cluster_id", "cluster", "group", "group_id")
GENE_NAMES = ("gene", "genes", "feature", "feature_name", "symbol")
SCORE_NAMES = ("log2fc", "log2_fold_change", "log_fold_change", "logfoldchanges", "avg_log2fc", "score", "statistic")
WIDE_SCORE = r"Cluster\s+(.+?)\s+Log2\s+fold\s+change$"


def pseudobulk_de(expression: DataFrame, cell_clusters: DataFrame, min_log2fc: float = 0.5) -> DataFrame:
    """Mean count and log2 fold change of every gene in every cluster.

    ``expression(gene, cell_id, n)`` is sparse, ``cell_clusters(cell_id, cluster)``
    lists all matched cells, including those without counts: means divide by them.
    The counts are joined and summed once. Zeros are filled in per gene from one
    small array of (cluster, cells), so there is no gene-by-cluster cross join.
    """
    sizes = cell_clusters.groupBy("cluster").agg(F.count("*").alias("cells"))
    panel = sizes.agg(F.collect_list(F.struct("cluster", "cells")).alias("p")).scalar()
    total_cells = sizes.agg(F.sum("cells")).scalar()
    sums = (expression.join(cell_clusters, "cell_id", "left").groupBy("gene", "cluster").agg(F.sum("n").alias("s")))
    per_gene = sums.groupBy("gene").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("cluster").isNotNull(), F.struct("cluster", "s")))).alias("by_cluster"),
        F.sum(F.when(F.col("cluster").isNotNull(), F.col("s"))).alias("gene_total"))
    rows = per_gene.select("gene", "by_cluster", F.coalesce("gene_total", F.lit(0.0)).alias("gene_total"),
                           F.explode(panel).alias("c"))
    s = F.coalesce(F.element_at("by_cluster", F.col("c.cluster")), F.lit(0.0))
    count = F.greatest(F.col("c.cells"), F.lit(1)).cast("double")
    rest = F.greatest(total_cells - count, F.lit(1.0))
    rows = rows.select("gene", F.col("c.cluster").alias("cluster"), (s / count).alias("mean_counts"),
                       ((F.col("gene_total") - s) / rest).alias("rest_mean"))
    fold = F.log2((F.col("mean_counts") + PSEUDOCOUNT) / (F.col("rest_mean") + PSEUDOCOUNT))
    return (rows.withColumn("log2fc", fold)
            .withColumn("adj_p", F.when(F.abs("log2fc") >= min_log2fc, 0.001).otherwise(1.0))
            .select("gene", "cluster", "log2fc", "adj_p", "mean_counts"))


def diffexp_wide(de: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per gene with three named columns per cluster label."""
    def at(label: str, c: str) -> Column:
        return F.max(F.when(F.col("cluster") == label, F.col(c)))
    cols = []
    for k in labels:
        cols += [at(k, "log2fc").alias(f"Cluster {k} Log2 fold change"), at(k, "adj_p").alias(f"Cluster {k} Adjusted p value"),
                 at(k, "mean_counts").alias(f"Cluster {k} Mean Counts")]
    return de.groupBy(F.col("gene").alias("Feature Name")).agg(*cols)


def normalize_diffexp(df: DataFrame) -> DataFrame:
    """Differential expression from any accepted layout to ``(cluster_id, gene, score)``."""
    gene = S.pick_column(df, GENE_NAMES, required="gene")
    cluster, score = S.pick_column(df, CLUSTER_NAMES), S.pick_column(df, SCORE_NAMES)
    if cluster is None or score is None:
        wide = {c: m.group(1) for c in df.columns if (m := re.match(WIDE_SCORE, c, re.IGNORECASE))}
        if not wide:
            raise ValueError("differential expression needs cluster, gene and score columns")
        df = df.select(F.col(gene).alias("gene"), *[F.col(f"`{c}`").cast("string").alias(k) for c, k in wide.items()])
        df = df.unpivot("gene", [f"`{k}`" for k in wide.values()], "cluster_id", "score")
        gene, cluster, score = "gene", "cluster_id", "score"
    typed = dict(df.dtypes)[score] == "double"
    value = S.finite_or(score) if typed else S.safe_double(score)
    return (df.select(S.canonical_id(cluster).alias("cluster_id"), F.upper(F.trim(F.col(gene).cast("string"))).alias("gene"),
                      value.alias("score")).filter("cluster_id IS NOT NULL AND gene <> ''"))


def pathway_scores(de: DataFrame, sets: DataFrame) -> DataFrame:
    """Mean score and matched genes per cluster and pathway."""
    return (gene_set_join(de, sets).groupBy("cluster_id", "pathway")
            .agg(F.avg("score").alias("score"), F.count_distinct("gene").alias("n_genes"),
                 F.array_join(F.array_sort(F.collect_set("gene")), ";").alias("matched_genes")))


def route_pathway_input(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a pathway table into direct structure rows and cluster rows."""
    structure = S.pick_column(df, ("structure_id", "structure", "region_id"))
    cluster = S.pick_column(df, CLUSTER_NAMES)
    pathway = S.pick_column(df, ("pathway", "gene_set", "signature", "term"), required="pathway")
    score = S.pick_column(df, ("score", "activity", "zscore", "z_score", "mean_score"), required="score")
    empty = F.lit(None).cast("string")
    sid = S.canonical_id(structure) if structure else empty
    cid = S.canonical_id(cluster) if cluster else empty
    rows = df.select(sid.alias("structure_id"), cid.alias("cluster_id"), F.trim(pathway).alias("pathway"),
                     S.safe_double(score).alias("score")).filter("pathway <> ''")
    direct = rows.filter("structure_id IS NOT NULL").drop("cluster_id")
    return direct, rows.filter("structure_id IS NULL AND cluster_id IS NOT NULL").drop("structure_id")


def pathways_to_structures(cluster_rows: DataFrame, cluster_structure: DataFrame, direct: DataFrame | None = None,
                           top: int = 5) -> DataFrame:
    """Mean pathway score per structure with its strongest and weakest pathways."""
    rows = cluster_rows.join(cluster_structure, "cluster_id").select("structure_id", "pathway", "score")
    if direct is not None:
        rows = rows.unionByName(direct.select("structure_id", "pathway", "score"))
    means = rows.groupBy("structure_id", "pathway").agg(F.avg("score").alias("score"))
    pos = F.when(F.col("score") > 0, F.struct((-F.col("score")).alias("o"), F.col("pathway").alias("name"), "score"))
    neg = F.when(F.col("score") < 0, F.struct(F.col("score").alias("o"), F.col("pathway").alias("name"), "score"))
    return means.groupBy("structure_id").agg(
        S.pathway_text(F.slice(F.array_sort(F.collect_list(pos)), 1, top)).alias("top_activated_pathways"),
        S.pathway_text(F.slice(F.array_sort(F.collect_list(neg)), 1, top)).alias("top_suppressed_pathways"),
        (F.max("score") - F.min("score")).alias("pathway_separation_score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("pathway", "score")))).alias("pathway_scores"))


def program_scores(expression: DataFrame, sets: DataFrame) -> DataFrame:
    """Score of each program in each cell that has a count: mean over the program's genes."""
    size = sets.groupBy("pathway").agg(F.count_distinct("gene").alias("_genes"))
    return (gene_set_join(expression, sets).groupBy("pathway", "cell_id").agg(F.sum("n").alias("_n"))
            .join(size, "pathway").select("pathway", "cell_id", (F.col("_n") / F.col("_genes")).alias("score")))


def distance_expression_coupling(expression: DataFrame, distances: DataFrame) -> DataFrame:
    """Spearman correlation of a cell's distance with each gene's count.

    ``distances(cell_id, d)`` lists the cells in scope; a cell without a count has 0.
    Zeros all share one rank, so their part of every sum is known from the totals
    and only the stored counts are ranked: nothing is filled in. Every sum follows from how
    often a gene has a count and from the distance ranks added up over those cells, so
    ranks are never joined back to the single counts.
    """
    # both tables are read by several branches: ranks, totals and joins
    ranked = materialize(average_rank(materialize(distances.select("cell_id", "d")), [], "d", "rd"))
    whole = ranked.agg(F.count("*").cast("double").alias("n"), F.sum("rd").alias("sum_rd"),
                       F.sum(F.col("rd") * F.col("rd")).alias("sum_rd2"))
    counts = expression.groupBy("gene", "cell_id").agg(F.sum("n").alias("v")).filter("v <> 0")
    values = (counts.join(ranked.select("cell_id", "rd"), "cell_id").groupBy("gene", "v")
              .agg(F.count("*").alias("k"), F.sum("rd").alias("rd")))
    rv = F.col("rv")
    g = ranks_of_counts(values, ["gene"], "v", "k", "rv").groupBy("gene").agg(
        F.sum("k").alias("n_nonzero"), F.sum(F.col("v") * F.col("k")).alias("sum_v"), F.sum("rd").alias("nz_rd"), F.sum(rv * F.col("k")).alias("nz_rv"),
        F.sum(rv * rv * F.col("k")).alias("nz_rv2"), F.sum(rv * F.col("rd")).alias("nz_rdrv"))
    total = whole.select(F.struct("n", "sum_rd", "sum_rd2")).scalar()
    n, sum_rd, sum_rd2 = total["n"], total["sum_rd"], total["sum_rd2"]
    z = n - F.col("n_nonzero")
    zero_rank = (z + 1) / 2
    mean = (n + 1) / 2
    cross = zero_rank * (sum_rd - F.col("nz_rd")) + F.col("nz_rdrv") + z * F.col("nz_rd")
    square = z * zero_rank * zero_rank + F.col("nz_rv2") + 2 * z * F.col("nz_rv") + F.col("n_nonzero") * z * z
    cov, var_v, var_d = cross - n * mean * mean, square - n * mean * mean, sum_rd2 - n * mean * mean
    rho = F.when((var_v > 0) & (var_d > 0), cov / F.sqrt(F.when(var_v > 0, var_v) * var_d))
    return g.select("gene", n.cast("bigint").alias("n_cells"), F.col("n_nonzero").alias("n_nonzero_cells"),
                    rho.alias("spearman_rho"), (F.col("sum_v") / n).alias("mean_expression"))


def program_activity(expression: DataFrame, sets: DataFrame, cells: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Distance from the most active cells of each program to every cell type (ours).

    Cells scoring above the program's quantile are kept and searched for as one point
    cloud per program: ``(pathway, celltype, retained_cell_count, d)``.
    """
    scores = materialize(program_scores(expression, sets))
    cuts = exact_quantiles(scores, ["pathway"], "score", {"cut": quantile})
    kept = scores.join(cuts, "pathway").filter("score > cut").select("pathway", "cell_id")
    active = with_case(kept.join(cells.select("cell_id", "x", "y"), "cell_id"))
    a = tiles.pack(active.select(CASE, "pathway", "cell_id", "x", "y"), [CASE], block=tiles.SEARCH)
    b = tiles.pack(with_case(cells).select(CASE, F.col("cluster").alias("celltype"), "x", "y").distinct(), [CASE, "celltype"])
    near = tiles.nearest(a, b, [CASE], [CASE, "pathway", "cell_id"])
    return near.groupBy("pathway", "celltype").agg(F.count("*").alias("retained_cell_count"), F.avg("d").alias("d"))


def data_profile(expression: DataFrame, cell_clusters: DataFrame) -> DataFrame:
    """Cells per cluster and medians of counts and genes per cell; cells without a cluster are ``unassigned``."""
    per_cell = expression.groupBy("cell_id", "gene").agg(F.sum("n").alias("n")).groupBy("cell_id").agg(
        F.sum("n").alias("total"), F.count("*").cast("double").alias("genes"))
    rows = (cell_clusters.withColumn("cluster", F.coalesce("cluster", F.lit("unassigned"))).join(per_cell, "cell_id", "left")
            .fillna(0.0, ["total", "genes"]))
    counts = rows.groupBy("cluster").agg(F.count("*").alias("n_cells"))
    return (counts.join(exact_quantiles(rows, ["cluster"], "total", {"median_counts": 0.5}), "cluster")
            .join(exact_quantiles(rows, ["cluster"], "genes", {"median_genes": 0.5}), "cluster"))
