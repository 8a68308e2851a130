"""Joins between cells, labels, structures, gene sets and artifacts.

No join carries a broadcast hint: the small sides (labels, structures, gene sets)
are measured by Spark, which broadcasts them below its size threshold and shuffles
beyond it, splitting hot keys at run time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalars as S

# Built-in gene sets ------------------------------------------
GENE_SETS = {
    "epithelial_tumor": ("EPCAM", "KRT8", "KRT18", "KRT19", "KRT7", "MUC1", "ERBB2", "ESR1", "PGR"),
    "proliferation": ("MKI67", "TOP2A", "PCNA", "UBE2C", "BIRC5", "CCNB1"),
    "immune_inflammation": ("PTPRC", "CD3D", "CD3E", "MS4A1", "CD79A", "NKG7", "GNLY"),
    "macrophage_myeloid": ("CD68", "CD163", "LYZ", "LST1", "CSF1R", "AIF1"),
    "fibroblast_stroma": ("COL1A1", "COL1A2", "COL3A1", "DCN", "LUM", "CXCL12", "ACTA2"),
    "endothelial_angiogenesis": ("PECAM1", "VWF", "KDR", "FLT1", "ENG", "EMCN"),
    "myoepithelial_basal": ("KRT5", "KRT14", "ACTA2", "TP63", "MYL9", "TAGLN"),
    "interferon": ("ISG15", "IFIT1", "IFIT3", "MX1", "OAS1", "STAT1"),
    "hypoxia_stress": ("VEGFA", "CA9", "ENO1", "LDHA", "ALDOA", "NDRG1"),
}
# ----------------------------------------------------------------------------


def align_cells_clusters(cells: DataFrame, labels: DataFrame, on: str = "cell_id") -> DataFrame:
    """Cells with their normalised cluster label; cells without one are dropped."""
    named = labels.withColumn("cluster", S.normalize_cluster_label("cluster")).filter("cluster <> ''")
    return cells.join(named, on, "inner")


def join_with_stem_fallback(labels: DataFrame, cells: DataFrame, key: str = "barcode", value: str = "x",
                            min_matched: float = 0.5) -> DataFrame:
    """Left join on the exact barcode, or on its stem when too few rows match.

    One aggregate decides between the two plans, so the fallback costs nothing
    when it is not taken.
    """
    exact = labels.join(cells, key, "left")
    matched = exact.agg(F.avg(F.col(value).isNotNull().cast("double")).alias("m")).first()["m"]
    if matched is None or matched >= min_matched:
        return exact
    stems = cells.select(S.barcode_stem(key).alias("_stem"), *[c for c in cells.columns if c != key])
    return labels.withColumn("_stem", S.barcode_stem(key)).join(stems, "_stem", "left").drop("_stem")


def exact_then_stem_lookup(rows: DataFrame, labels: DataFrame, order: str, key: str = "barcode",
                           value: str = "cluster") -> DataFrame:
    """Label per row by exact barcode, else by stem, else dropped; the last duplicate by ``order`` wins."""
    last = F.max_by(value, order)
    exact = labels.groupBy(key).agg(last.alias("_exact"))
    stem = labels.groupBy(S.barcode_stem(key).alias("_stem")).agg(last.alias("_by_stem"))
    return (rows.join(exact, key, "left").withColumn("_stem", S.barcode_stem(key)).join(stem, "_stem", "left")
            .withColumn(value, F.coalesce("_exact", "_by_stem")).filter(F.col(value).isNotNull())
            .drop("_stem", "_exact", "_by_stem"))


def cluster_to_structure(reviews: DataFrame) -> DataFrame:
    """``(cluster_id, structure_id)`` from reviews with ``top_clusters`` arrays of text fields.

    A cluster named by several structures goes to the one with the largest weight,
    on a tie to the earlier review (``review_no``).
    """
    items = reviews.select(S.canonical_id("structure_id").alias("structure_id"), "review_no", F.explode("top_clusters").alias("i"))
    fields = set(reviews.schema["top_clusters"].dataType.elementType.fieldNames())

    def pick(names: Sequence[str]) -> list[Column]:
        return [F.col(f"i.{n}") for n in names if n in fields]

    raw = F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in pick(("cluster_id", "cluster", "id", "label"))])
    weights = [S.safe_double(c) for c in pick(("cell_count", "count", "fraction", "fraction_of_structure"))]
    weight = F.greatest(*weights, F.lit(0.0))
    return (items.select("structure_id", S.canonical_id(raw).alias("cluster_id"), weight.alias("w"), "review_no")
            .filter("structure_id IS NOT NULL AND cluster_id IS NOT NULL")
            .groupBy("cluster_id").agg(F.max_by("structure_id", F.struct("w", -F.col("review_no"))).alias("structure_id")))


def gene_set_table(spark: SparkSession, sets: Mapping[str, Sequence[str]] = GENE_SETS) -> DataFrame:
    rows = [(p, g) for p, genes in sets.items() for g in genes]
    return spark.createDataFrame(rows, "pathway string, gene string")


def gene_set_join(df: DataFrame, sets: DataFrame, gene: str = "gene") -> DataFrame:
    """Rows of ``df`` repeated for each pathway containing their gene."""
    key = F.upper(F.trim(F.col(gene).cast("string")))
    return df.withColumn(gene, key).join(sets.withColumnRenamed("gene", gene), gene)


def label_selected_structure(cells: DataFrame, spec: DataFrame) -> DataFrame:
    """Add ``selected_structure_id`` (0 when no structure lists the cell's cluster)."""
    by_label = (spec.select("structure_id", F.explode("cluster_ids").alias("cluster"))
                .groupBy("cluster").agg(F.max("structure_id").alias("_sid")))
    return (cells.join(by_label, "cluster", "left")
            .withColumn("selected_structure_id", F.coalesce("_sid", F.lit(0))).drop("_sid"))


def missing_structures(spec: DataFrame, cells: DataFrame) -> DataFrame:
    """Structures none of whose labels occurs among the cells; each label of the cells is joined once."""
    present = (spec.select("structure_id", F.explode("cluster_ids").alias("cluster"))
               .join(cells.select("cluster").distinct(), "cluster", "left_semi").select("structure_id"))
    return spec.join(present, "structure_id", "left_anti")


def claims_to_artifacts(claims: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``(evidence_id, artifact, artifact_id)``; unknown paths become ``artifact.{basename}``."""
    name = F.element_at(F.split("artifact", "/"), -1)
    known = artifacts.select(F.col("path").alias("artifact"), F.col("id").alias("_id"))
    return (claims.select("evidence_id", F.explode(F.array_sort(F.array_distinct("artifact_paths"))).alias("artifact"))
            .join(known, "artifact", "left")
            .select("evidence_id", "artifact", F.coalesce("_id", F.concat(F.lit("artifact."), name)).alias("artifact_id")))


def missing_required(required: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Required ids with no existing artifact, listed or not."""
    return required.join(artifacts.filter("`exists`").select("id"), "id", "left_anti")


def coverage_gaps(expected: DataFrame, bundles: DataFrame, on: Sequence[str] = ("source",)) -> DataFrame:
    """Expected evidence channels with no bundle."""
    return expected.join(bundles, list(on), "left_anti")


def vocabulary_check(annotations: DataFrame, vocabulary: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Attach label attributes and a ``status``.

    ``accepted`` rows have a known label; unknown alternatives (and the label itself)
    are listed in ``unknown_alternatives`` and make the strict status ``rejected``.
    """
    vocab = vocabulary.select(F.col("id").alias("label_id"), "label", "broad_family", "malignancy_state")
    joined = annotations.join(vocab, "label_id", "left")
    alts = (annotations.select(key, F.explode_outer("alternative_label_ids").alias("alt"), "label_id")
            .join(vocabulary.select(F.col("id").alias("alt"), F.lit(True).alias("known"), F.col("label").alias("alt_label")), "alt", "left")
            .groupBy(key).agg(
                F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.col("alt")))).alias("unknown_alternatives"),
                F.array_sort(F.collect_list(F.when(F.col("known") & (F.col("alt") != F.col("label_id")), F.col("alt_label")))).alias("alternative_labels")))
    ok = F.col("label").isNotNull() & (F.size("unknown_alternatives") == 0)
    return joined.join(alts, key).withColumn("status", F.when(ok, "accepted").otherwise("rejected"))
