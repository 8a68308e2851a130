"""Roll-ups of cell, contour and model scores to structures, and their fusion."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from .ranking import top_per_group

SIGNALS = tuple(S.SIGNAL_TOKENS)

# Accepted column names
MAPPING_CLUSTER_NAMES = ("cluster_id", "cluster", "group", "group_id", "leiden", "louvain")
MAPPING_LABEL_NAMES = ("predicted_label", "reference_label", "cell_type", "label", "celltype")
MAPPING_CONFIDENCE_NAMES = ("confidence", "score", "probability", "max_probability")
SUMMARY_CLUSTER_NAMES = ("cluster_id", "cluster", "group", "group_id")
SUMMARY_LABEL_NAMES = ("top_reference_label", "reference_label", "predicted_label", "cell_type", "label")
SUMMARY_CONFIDENCE_NAMES = ("mean_reference_confidence", "reference_confidence", "confidence", "score", "probability")
SUMMARY_FRACTION_NAMES = ("top_reference_fraction", "reference_fraction", "fraction", "proportion")
SUMMARY_COUNT_NAMES = ("n_cells", "cell_count", "count", "n")
# Report sentences
NOTE_TUMOR = "RNA reference and H&E morphology both support tumor/epithelial identity"
NOTE_STROMA = "RNA reference and H&E morphology both support stromal identity"
NOTE_INFLAMMATION = "H&E adds inflammatory context that may complement RNA/cell-type evidence"
NOTE_ARTIFACT = "H&E morphology raises a tissue-quality caveat for this structure"
NOTE_PATHWAYS = "pathway activity adds molecular program context: "
# Reason codes of the consensus (kept for equal results)
REASON_UNAVAILABLE = "pathology_ai_unavailable"
REASON_ERROR = "pathology_ai_error"
REASON_LOW = "pathology_ai_low_confidence"
REASON_SAME = "same_label"
REASON_NO_OVERLAP = "no_marker_overlap"
REASON_WEAK_HEURISTIC = "heuristic_low_confidence"
REASON_MARGIN = "pathology_ai_confidence_margin"
REASON_RETAINED = "heuristic_retained"
SOURCE_MODEL = "pathology_ai_api"
SOURCE_HEURISTIC = "heuristic"
# Fixed value: report sentence
NOTE_NONE = "No strong cross-modal concordance or conflict detected"


def _distribution(label: str, n: str) -> Column:
    """Sorted ``label -> n`` map of one group; groups hold one row per label."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, n))))


def argmax_label(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Most frequent label per key, the alphabetically first one on ties."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return top_per_group(counts, keys, [F.desc("n"), F.asc(label)], 1)


def mapping_problems(mapping: DataFrame) -> list[str]:
    """What keeps a cell mapping from being read (fixed texts); no row is looked at."""
    if S.pick_column(mapping, MAPPING_CLUSTER_NAMES) is None:
        return ["RNA foundation cell mapping is missing a cluster_id/cluster column."]
    if S.pick_column(mapping, MAPPING_LABEL_NAMES) is None:
        return ["RNA foundation cell mapping is missing a predicted/reference label column."]
    return []


def cell_mapping_to_clusters(mapping: DataFrame) -> DataFrame:
    """Cell-level reference labels summed up per cluster; a missing column gives a warning and no rows.

    Counted per (cluster, label) first, so a cluster holding most cells is reduced
    before it is shuffled.
    """
    for problem in mapping_problems(mapping):
        warnings.warn(problem, stacklevel=2)
    missing = F.lit(None).cast("string").alias("_missing")
    cluster = S.pick_column(mapping, MAPPING_CLUSTER_NAMES)
    label = S.pick_column(mapping, MAPPING_LABEL_NAMES)
    if cluster is None or label is None:  # no rows, but the columns of a result
        mapping, cluster, label = mapping.limit(0).withColumn("_missing", missing), "_missing", "_missing"
    conf = S.pick_column(mapping, MAPPING_CONFIDENCE_NAMES)
    if conf is None:
        value = F.lit(0.0)
    else:
        value = S.finite_or(conf) if dict(mapping.dtypes)[conf] == "double" else S.safe_double(conf)
    text = F.trim(F.col(label).cast("string"))
    rows = mapping.select(S.canonical_id(cluster).alias("cluster_id"),
                          F.coalesce(F.nullif(text, F.lit("")), F.lit("unknown")).alias("label"), value.alias("conf"))
    counts = (rows.filter("cluster_id IS NOT NULL").groupBy("cluster_id", "label")
              .agg(F.count("*").alias("n"), F.sum("conf").alias("conf")))
    ambiguous = F.when(F.lower("label").isin(*S.AMBIGUOUS_LABELS), F.col("n")).otherwise(0)
    total = F.sum("n")
    first_label = F.min_by("label", F.struct(-F.col("n"), "label"))
    return counts.groupBy("cluster_id").agg(
        total.alias("n_cells"), first_label.alias("top_reference_label"),
        (F.max("n") / total).alias("top_reference_fraction"),
        (F.sum("conf") / total).alias("mean_reference_confidence"),
        (F.sum(ambiguous) / total).alias("ambiguous_fraction"),
        _distribution("label", "n").alias("label_distribution"))


def normalize_cluster_summary(df: DataFrame, row_no: str | None = None) -> DataFrame:
    """A ready-made cluster summary with missing columns filled by defaults."""
    def pick(names):
        return S.pick_column(df, names)
    cluster, label, conf, frac, count = map(pick, (SUMMARY_CLUSTER_NAMES, SUMMARY_LABEL_NAMES, SUMMARY_CONFIDENCE_NAMES,
                                                   SUMMARY_FRACTION_NAMES, SUMMARY_COUNT_NAMES))
    if cluster is None and row_no is None:
        raise ValueError("a summary without a cluster column needs a row number column")
    text = F.trim(F.col(label).cast("string")) if label else F.lit("")
    named = F.coalesce(F.nullif(text, F.lit("")), F.lit("unknown"))
    ambiguous = S.safe_double("ambiguous_fraction") if "ambiguous_fraction" in df.columns else F.lit(0.0)
    return df.select(
        (S.canonical_id(cluster) if cluster else F.col(row_no).cast("string")).alias("cluster_id"),
        (S.safe_long(count, 1) if count else F.lit(1).cast("bigint")).alias("n_cells"), named.alias("top_reference_label"),
        (S.safe_double(frac, 1.0) if frac else F.lit(1.0)).alias("top_reference_fraction"),
        (S.safe_double(conf) if conf else F.lit(0.0)).alias("mean_reference_confidence"),
        ambiguous.alias("ambiguous_fraction"),
        F.create_map(named, F.lit(1).cast("bigint")).alias("label_distribution"))


def clusters_to_structures(clusters: DataFrame, cluster_structure: DataFrame) -> DataFrame:
    """Cluster summaries weighted by cell count, per structure."""
    rows = (clusters.join(cluster_structure, "cluster_id")
            .withColumn("n", F.greatest(F.coalesce("n_cells", F.lit(1)), F.lit(1)))
            .withColumn("w", F.bround(F.col("n") * F.col("top_reference_fraction")).cast("bigint")))
    per_label = rows.groupBy("structure_id", F.col("top_reference_label").alias("label")).agg(
        F.sum("w").alias("w"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean_reference_confidence")).alias("c"),
        F.sum(F.col("n") * F.col("ambiguous_fraction")).alias("a"), F.collect_list("cluster_id").alias("clusters"))
    total = F.sum("n")
    return per_label.groupBy("structure_id").agg(
        total.alias("n_cells"), F.min_by("label", F.struct(-F.col("w"), "label")).alias("top_reference_label"),
        (F.max("w") / total).alias("top_reference_fraction"), (F.sum("c") / total).alias("mean_reference_confidence"),
        (F.sum("a") / total).alias("ambiguous_fraction"),
        F.array_sort(F.flatten(F.collect_list("clusters"))).alias("clusters"), _distribution("label", "w").alias("label_distribution"))


def class_signals(contours: DataFrame) -> DataFrame:
    """Highest score per signal over a contour's top label and its class list.

    Array functions on the row: a contour never leaves its task.
    """
    top = F.array(F.struct(F.col("top_label").alias("label"), F.col("top_score").cast("double").alias("score")))
    rest = F.transform(F.coalesce("top_classes", F.array()),
                       lambda c: F.struct(F.coalesce(F.nullif(c["label"], F.lit("")), c["label_id"]).alias("label"),
                                          c["score"].cast("double").alias("score")))
    items = F.concat(top, rest) if "top_classes" in contours.columns else top
    marked = F.transform(items, lambda c: F.struct(S.signal_bucket(c["label"]).alias("b"), S.finite_or(c["score"]).alias("s")))
    out = contours.withColumn("_m", marked)
    for sig in SIGNALS:
        best = F.array_max(F.transform(F.filter("_m", lambda c: c["b"] == sig), lambda c: c["s"]))
        out = out.withColumn(sig, F.greatest(F.coalesce(best, F.lit(0.0)), F.lit(0.0)))
    return out.drop("_m")


def entropy_of_counts(n: str) -> Column:
    """Entropy of a group of counts over its logarithm of size; 0 for a single count.

    ``-sum(p ln p) = ln N - sum(n ln n) / N`` needs one pass only.
    """
    total, k = F.sum(n), F.count("*")
    raw = F.log(total) - F.sum(F.col(n) * F.log(n)) / total
    return F.when(k > 1, raw / F.log(F.when(k > 1, k))).otherwise(0.0)


def he_morphology(contours: DataFrame) -> DataFrame:
    """Visual labels and signal means per structure."""
    rows = (class_signals(contours).withColumn("structure_id", S.canonical_id("structure_id")).filter("structure_id IS NOT NULL")
            .withColumn("label", F.coalesce(F.nullif("top_label", F.lit("")), F.lit("unknown"))))
    per_label = rows.groupBy("structure_id", "label").agg(
        F.count("*").alias("n"), F.sum(S.finite_or("top_score")).alias("score"), *[F.sum(s).alias(s) for s in SIGNALS])
    total = F.sum("n")
    out = per_label.groupBy("structure_id").agg(
        total.alias("n_contours"), F.min_by("label", F.struct(-F.col("n"), "label")).alias("dominant_visual_label"),
        (F.max("n") / total).alias("dominant_visual_fraction"), (F.sum("score") / total).alias("mean_foundation_score"),
        *[(F.sum(s) / total).alias(s) for s in SIGNALS], entropy_of_counts("n").alias("visual_entropy"),
        _distribution("label", "n").alias("label_distribution"))
    # ties go to the first signal in the fixed order
    best = F.greatest(*SIGNALS)
    dominant = F.lit(None)
    for s in reversed(SIGNALS):
        dominant = F.when(F.col(s) == best, s.replace("_signal", "")).otherwise(dominant)
    return out.withColumn("dominant_signal", dominant)


def top_k_classes(scores: DataFrame, prompts: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` scored prompts per contour with their label; an unknown prompt names itself.

    Contours without scores keep one row with their ``error``.
    """
    items = scores.select("contour_id", "error", F.posexplode_outer(F.slice(F.array_sort(
        "scored", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
        .when(a["prompt"] < b["prompt"], -1).otherwise(1)), 1, k)).alias("i", "s"))
    rows = items.select("contour_id", "error", (F.col("i") + 1).alias("rank"), F.col("s.prompt").alias("prompt"), F.col("s.score").alias("score"))
    return (rows.join(prompts, "prompt", "left")
            .select("contour_id", "rank", F.coalesce("label_id", "prompt").alias("label_id"), F.coalesce("label", "prompt").alias("label"),
                    "prompt", "score", "error"))


def contours_to_structure(contours: DataFrame, top: int = 5, examples: int = 6) -> DataFrame:
    """Class scores per structure: counts, strongest labels, example contours.

    Three partial aggregations are joined; no group of contours is ever collected.
    """
    keyed = contours.withColumn("structure_name", F.coalesce(F.nullif("structure_name", F.lit("")), F.lit("unassigned")))
    keys = ["structure_id", "structure_name"]
    counts = keyed.groupBy(*keys).agg(F.count("*").alias("n_contours"),
                                      F.count_if(F.size(F.coalesce("top_classes", F.array())) > 0).alias("n_classified"))
    first = top_per_group(keyed.filter(F.size("top_classes") > 0).select(*keys, "contour_id"), keys, [F.asc("contour_id")], examples)
    first = first.groupBy(*keys).agg(F.array_sort(F.collect_list("contour_id")).alias("example_contours"))
    per_label = (keyed.select(*keys, F.explode("top_classes").alias("c")).groupBy(*keys, F.col("c.label_id").alias("label_id"))
                 .agg(F.min("c.label").alias("label"), F.avg("c.score").alias("mean_score"), F.max("c.score").alias("max_score"),
                      F.count("*").alias("contour_count")))
    best = top_per_group(per_label, keys, [F.desc("mean_score"), F.desc("max_score"), F.asc("label_id")], top, rank="_r")
    best = best.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("_r", "label_id", "label", "mean_score", "max_score", "contour_count"))).alias("top_visual_labels"))
    # null structure ids are a group of their own: join null-safe
    out = counts
    for side in (first, best):
        renamed = side.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in side.columns if c not in keys])
        out = out.join(renamed, (F.col("structure_id").eqNullSafe(F.col("_structure_id"))) & (F.col("structure_name") == F.col("_structure_name")),
                       "left").drop("_structure_id", "_structure_name")
    lead = F.get("top_visual_labels", F.lit(0))
    return (out.withColumn("top_label_id", lead["label_id"]).withColumn("top_label", lead["label"])
            .withColumn("top_mean_score", F.coalesce(lead["mean_score"], F.lit(0.0)))
            .withColumn("top_max_score", F.coalesce(lead["max_score"], F.lit(0.0))))


def consistency_summary(rna_label, he_signal, activated_pathways) -> Column:
    """One sentence on how far the modalities of a structure agree."""
    rna, he = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in (rna_label, he_signal))
    names = S.top_pathways(activated_pathways, 3)
    note = (F.when((rna == "") | (he == ""), F.lit(None))
            .when(rna.contains("tumor") & (he == "tumor"), NOTE_TUMOR)
            .when(rna.rlike("fibro|stroma") & (he == "stroma"), NOTE_STROMA)
            .when(he == "inflammation", NOTE_INFLAMMATION).when(he == "artifact", NOTE_ARTIFACT))
    path = F.when(F.size(names) > 0, F.concat(F.lit(NOTE_PATHWAYS), F.array_join(names, ", ")))
    return F.coalesce(F.nullif(F.concat_ws("; ", note, path), F.lit("")), F.lit(NOTE_NONE))


def niche_fusion(reviews: DataFrame, rna: DataFrame, pathway: DataFrame, he: DataFrame) -> DataFrame:
    """All modalities side by side per structure; a structure in any input is kept."""
    review = reviews.select(S.canonical_id("structure_id").alias("structure_id"),
                            F.coalesce(F.nullif("title", F.lit("")), F.nullif("assigned_label", F.lit("")), F.lit("")).alias("current_name"))
    out = (review.join(rna.select("structure_id", "top_reference_label", "mean_reference_confidence", F.lit(True).alias("_rna")), "structure_id", "full_outer")
           .join(pathway.select("structure_id", "top_activated_pathways", "pathway_separation_score", F.lit(True).alias("_path")), "structure_id", "full_outer")
           .join(he.select("structure_id", "dominant_signal", "visual_entropy", F.lit(True).alias("_he")), "structure_id", "full_outer"))
    present = F.array_compact(F.array(F.when(F.col("_rna"), "rna_foundation"), F.when(F.col("_path"), "pathway"), F.when(F.col("_he"), "he_morphology")))
    return out.select(
        "structure_id", F.concat(F.lit("N"), "structure_id").alias("niche_id"), F.coalesce("current_name", F.lit("")).alias("current_name"),
        F.coalesce("top_reference_label", F.lit("")).alias("rna_top_reference_label"),
        F.col("mean_reference_confidence").alias("rna_reference_confidence"),
        F.coalesce("top_activated_pathways", F.lit("")).alias("top_activated_pathways"), "pathway_separation_score",
        F.coalesce("dominant_signal", F.lit("")).alias("he_dominant_signal"), F.col("visual_entropy").alias("he_visual_entropy"),
        F.size(present).alias("evidence_modality_count"), present.alias("evidence_modalities"),
        consistency_summary("top_reference_label", "dominant_signal", "top_activated_pathways").alias("consistency_summary"))


def sort_ids(df: DataFrame, c: str = "structure_id") -> DataFrame:
    """Order ids by length, then text, so ``"10"`` follows ``"9"``."""
    return df.orderBy(F.length(c), c)


def natural_label_keys(df: DataFrame, c: str) -> DataFrame:
    """Add the sort keys ``_text`` and ``_number``: numeric labels come first, as numbers, then text by ``c``."""
    number = F.when(F.col(c).rlike("^[0-9]+$"), F.col(c).try_cast("decimal(38,0)"))
    return df.withColumn("_text", number.isNull()).withColumn("_number", number)


def foundation_map(rna: DataFrame, pathway: DataFrame, he: DataFrame, niche: DataFrame) -> DataFrame:
    """One struct per modality per structure, null where a modality is absent."""
    out = None
    for name, df in (("rna_foundation", rna), ("pathway_activity", pathway), ("he_morphology", he), ("niche_fusion", niche)):
        side = df.select("structure_id", F.struct(*[c for c in df.columns if c != "structure_id"]).alias(name))
        out = side if out is None else out.join(side, "structure_id", "full_outer")
    return out


def _fixed2(c: Column) -> Column:
    return F.format_string("%.2f", F.coalesce(c, F.lit(0.0)))


def evidence_lines() -> Column:
    """Up to four text lines from a ``foundation_map`` row."""
    rna, path, he, niche = (F.col(c) for c in ("rna_foundation", "pathway_activity", "he_morphology", "niche_fusion"))
    return F.array_compact(F.array(
        F.when(rna.isNotNull(), F.concat(F.lit("RNA foundation/reference mapping: "), F.coalesce(rna["top_reference_label"], F.lit("unknown")),
               F.lit(" (confidence "), _fixed2(rna["mean_reference_confidence"]), F.lit(", ambiguous "), _fixed2(rna["ambiguous_fraction"]), F.lit(")."))),
        F.when(path.isNotNull(), F.concat(F.lit("Pathway activity: "), F.coalesce(F.nullif(path["top_activated_pathways"], F.lit("")),
               F.lit("no dominant activated pathway")), F.lit("."))),
        F.when(he.isNotNull(), F.concat(F.lit("H&E morphology foundation signal: "), F.coalesce(he["dominant_signal"], F.lit("unknown")), F.lit(" via "),
               F.coalesce(he["dominant_visual_label"], F.lit("unknown")), F.lit(" (entropy "), _fixed2(he["visual_entropy"]), F.lit(")."))),
        F.when(niche.isNotNull(), F.concat(F.lit("Cross-modal consistency: "), niche["consistency_summary"], F.lit(".")))))


def attach_evidence(reviews: DataFrame, evidence: DataFrame, limit: int | None = None) -> DataFrame:
    """Reviews with evidence lines put before their own, repeated lines dropped, cut to ``limit`` if given.

    Reviews without evidence stay as they are.
    """
    lines = evidence.select("structure_id", evidence_lines().alias("_lines"))
    merged = F.array_distinct(F.concat(F.coalesce("_lines", F.array().cast("array<string>")), F.coalesce("key_evidence", F.array().cast("array<string>"))))
    return (reviews.withColumn("structure_id", S.canonical_id("structure_id")).join(lines, "structure_id", "left")
            .withColumn("key_evidence", F.when(F.col("_lines").isNull(), F.col("key_evidence")).otherwise(merged if limit is None else F.slice(merged, 1, limit)))
            .drop("_lines"))


def consensus_annotation(heuristic: DataFrame, model: DataFrame, markers: DataFrame, min_model_confidence: float = 0.60,
                         override_margin: float = 0.15, require_marker_overlap: bool = True, low_heuristic: float = 0.65) -> DataFrame:
    """Choose between the rule-based and the model label of each cluster, with the reason.

    ``heuristic/model(cluster_id, label_id, confidence[, supporting_markers][, error])``; a model
    row with an ``error`` is a call that failed, a cluster without a row was never asked for,
    ``markers(cluster_id, positive_genes ARRAY<STRING>)``.
    """
    def names(c):
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda g: F.upper(F.trim(g)))
    error = F.col("error") if "error" in model.columns else F.lit(None).cast("string")
    answer = F.when(error.isNull(), F.col("label_id")).alias("model_label_id")
    rows = (heuristic.select("cluster_id", F.col("label_id").alias("heuristic_label_id"), F.col("confidence").alias("heuristic_confidence"))
            .join(model.select("cluster_id", answer, F.col("confidence").alias("model_confidence"),
                               "supporting_markers", error.alias("_error"), F.when(error.isNull(), True).alias("_has")), "cluster_id", "left")
            .join(markers, "cluster_id", "left"))
    shared = F.filter(F.array_intersect(names("positive_genes"), names("supporting_markers")), lambda g: g != "")
    overlap = F.col("_has").isNotNull() & (F.size(shared) > 0)
    h, m = F.col("heuristic_confidence"), F.col("model_confidence")
    reason = (F.when(F.col("_error").isNotNull(), REASON_ERROR).when(F.col("_has").isNull(), REASON_UNAVAILABLE).when(m < min_model_confidence, REASON_LOW)
              .when(F.col("model_label_id").eqNullSafe(F.col("heuristic_label_id")), REASON_SAME)
              .when(F.lit(require_marker_overlap) & ~overlap, REASON_NO_OVERLAP).when(h < low_heuristic, REASON_WEAK_HEURISTIC)
              .when(m - h >= override_margin, REASON_MARGIN).otherwise(REASON_RETAINED))
    accept = F.col("reason").isin(REASON_SAME, REASON_WEAK_HEURISTIC, REASON_MARGIN)
    return (rows.withColumn("marker_overlap", overlap).withColumn("reason", reason).withColumn("accepted", accept)
            .withColumn("label_id", F.when(F.col("accepted"), F.col("model_label_id")).otherwise(F.col("heuristic_label_id")))
            .withColumn("consensus_source", F.when(F.col("accepted"), SOURCE_MODEL).otherwise(SOURCE_HEURISTIC))
            .select("cluster_id", "label_id", "consensus_source", "reason", "accepted", "marker_overlap", "heuristic_label_id",
                    "heuristic_confidence", "model_label_id", "model_confidence"))


def consensus_counts(decisions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    has_model = F.col("model_label_id").isNotNull()
    return decisions.groupBy(*by).agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted") & has_model).alias("rejected"),
                                      F.count_if(~has_model).alias("fallback"), F.count("*").alias("clusters"))


def case_review(annotations: DataFrame, limit: int = 8) -> DataFrame:
    """First ids of high review priority and of tumour labels, in id order."""
    high = F.lower(F.coalesce("review_priority", F.lit(""))) == "high"
    tumor = (F.lower(F.coalesce("malignancy_state", F.lit(""))) == "tumor") | F.lower("label_id").contains("tumor")
    listed = (annotations.select(F.explode(F.array_compact(F.array(F.when(high, "high_priority"), F.when(tumor, "discovery_candidate")))).alias("list"), "cluster_id"))
    return top_per_group(listed, ["list"], [F.asc("cluster_id")], limit, rank="position")


def visual_override(reviews: DataFrame, summaries: DataFrame, naming: DataFrame, enabled: bool = True,
                    min_confidence: float = 0.70, min_score: float = 0.35, max_evidence: int = 10, max_checks: int = 8) -> DataFrame:
    """Decide per structure whether the name proposed from the image replaces the current one."""
    joined = (reviews.join(summaries.select("structure_id", F.col("top_label").alias("foundation_top_label"), "top_max_score", "top_mean_score",
                                            F.lit(True).alias("_he")), "structure_id", "left")
              .join(naming.select("structure_id", "final_name", "visual_override", F.col("confidence").alias("naming_confidence"),
                                  "visual_evidence", "molecular_evidence", F.col("recommended_checks").alias("naming_checks"),
                                  "error"), "structure_id", "left"))
    current = F.coalesce(F.nullif("title", F.lit("")), F.nullif("assigned_label", F.lit("")), F.lit(""))
    seen = F.col("_he").isNotNull()
    score = F.coalesce(F.nullif("top_max_score", F.lit(0.0)), F.nullif("top_mean_score", F.lit(0.0)), F.lit(0.0))
    proposed = F.coalesce("visual_override", F.lit(False))
    accepted = (F.lit(enabled) & seen & proposed & (F.coalesce("naming_confidence", F.lit(0.0)) >= min_confidence) & (score >= min_score))
    none = F.array().cast("array<string>")

    def lines(*cols):
        return F.concat(*[F.coalesce(F.col(c), none) for c in cols])
    return (joined.withColumn("foundation_top_score", F.when(seen, score)).withColumn("accepted", accepted)
            .withColumn("pre_visual_name", current)
            .withColumn("final_name", F.when(seen, F.coalesce(F.nullif("final_name", F.lit("")), current)).otherwise(current))
            .withColumn("assigned_name", F.when(F.col("accepted"), F.col("final_name")).otherwise(current))
            .withColumn("visual_override", seen & proposed)
            .withColumn("review_confidence", F.when(F.col("accepted"), F.col("naming_confidence")).otherwise(F.col("confidence")))
            .withColumn("error", F.when(~seen, "no_he_visual_summary").otherwise(F.col("error")))
            .withColumn("key_evidence", F.when(seen, F.slice(lines("visual_evidence", "molecular_evidence", "key_evidence"), 1, max_evidence)).otherwise(F.col("key_evidence")))
            .withColumn("recommended_checks", F.when(seen, F.slice(lines("naming_checks", "recommended_checks"), 1, max_checks)).otherwise(F.col("recommended_checks")))
            .select("structure_id", "pre_visual_name", "final_name", "assigned_name", "visual_override", "accepted", "review_confidence",
                    "foundation_top_label", "foundation_top_score", "key_evidence", "recommended_checks", "error"))


def override_counts(decisions: DataFrame) -> DataFrame:
    """Number of accepted overrides and the headline finding."""
    n = F.count_if("accepted")
    return decisions.agg(n.alias("accepted"), F.count("*").alias("reviewed")).withColumn("finding", F.when(
        F.col("accepted") > 0, F.concat(F.lit("H&E contour foundation model accepted visual overrides for "), F.col("accepted").cast("string"),
                                        F.lit(" structure names."))).otherwise(
        "H&E contour foundation model reviewed structure names; no visual override met acceptance thresholds."))
