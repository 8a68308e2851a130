"""Row contracts, payload normalisation and format drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S

# Record formats ----------------------------------------------
EVIDENCE_SCHEMA_VERSION = "0.2.1"
QC_STATUSES = ("ok", "warning", "fail", "unknown")
EVIDENCE_UNITS = ("cell", "region", "structure", "case")
REVIEW_STATES = ("pending", "approved", "rejected", "not_required")
CORRECTION_TYPES = ("label_override", "reject", "flag_for_finetuning")
EVIDENCE_FIELDS = ("schema_version", "evidence_id", "unit", "unit_id", "source", "evidence_type", "measured", "model_derived", "qc_status", "summary",
                   "supporting_artifacts", "artifact_ids", "artifact_hashes", "tool_name", "input_hash", "model_version", "checkpoint_hash",
                   "elapsed_seconds", "timestamp", "requires_human_review", "human_review_state", "conflict_note")
CORRECTION_FIELDS = ("schema_version", "correction_id", "evidence_id", "unit_id", "correction_type", "original_label", "corrected_label",
                     "reviewer_id", "note", "timestamp")
PAYLOAD_LISTS = ("visual_evidence", "molecular_evidence", "conflicts", "recommended_checks")
# ----------------------------------------------------------------------------

Rule = tuple[str, Column]  # (name, true when violated)


def one_of(c: str, allowed: Sequence[str]) -> Rule:
    return f"{c}:enum", ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))


def min_length(c: str, n: int = 1) -> Rule:
    return f"{c}:min_length", F.coalesce(F.length(c), F.lit(0)) < n


def in_range(c: str, low: float | None = None, high: float | None = None) -> Rule:
    bad = F.isnan(F.col(c).cast("double"))
    if low is not None:
        bad = bad | (F.col(c) < low)
    if high is not None:
        bad = bad | (F.col(c) > high)
    return f"{c}:range", F.coalesce(bad, F.lit(False))


def max_items(c: str, n: int) -> Rule:
    return f"{c}:max_items", F.coalesce(F.size(c), F.lit(0)) > n


def no_extra_fields(json_text: str, allowed: Sequence[str]) -> Rule:
    keys = F.json_object_keys(json_text)
    return f"{json_text}:extra_field", F.coalesce(F.size(F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))) > 0, F.lit(False))


def row_contract(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``violations ARRAY<STRING>``: the names of the rules each row breaks."""
    marks = F.array(*[F.when(bad, F.lit(name)) for name, bad in rules])
    return df.withColumn("violations", F.array_compact(marks))




def evidence_bundle_rules(source_json: str | None = None) -> list[Rule]:
    """Contract of an evidence bundle; with the column of its JSON text, other fields are forbidden."""
    extra = [no_extra_fields(source_json, EVIDENCE_FIELDS)] if source_json else []
    return [*extra, min_length("evidence_id"), one_of("unit", EVIDENCE_UNITS), min_length("source"), min_length("evidence_type"),
            one_of("qc_status", QC_STATUSES), one_of("human_review_state", REVIEW_STATES)]


def correction_rules(source_json: str | None = None) -> list[Rule]:
    """Contract of a reviewer's correction; with the column of its JSON text, other fields are forbidden."""
    extra = [no_extra_fields(source_json, CORRECTION_FIELDS)] if source_json else []
    return [*extra, min_length("correction_id"), min_length("evidence_id"), one_of("correction_type", CORRECTION_TYPES)]


def annotation_rules() -> list[Rule]:
    """Contract of a model annotation row."""
    return [min_length("label_id"), in_range("confidence", 0.0, 1.0), one_of("review_priority", ("low", "medium", "high")),
            max_items("supporting_markers", 8), max_items("conflicting_markers", 8), max_items("alternative_label_ids", 4)]


def normalize_model_payload(df: DataFrame, payload: str, fallback_structure_id: str) -> DataFrame:
    """Model JSON to typed columns; a missing structure id comes from the request."""
    text = F.col(payload)
    sid = F.coalesce(F.get_json_object(text, "$.structure_id").try_cast("bigint"), F.col(fallback_structure_id))
    fields = F.from_json(text, "map<string,string>")
    out = df.withColumn("structure_id", sid)
    for name in PAYLOAD_LISTS:
        value = fields[name]
        # a plain string field arrives unquoted; quote it again so its JSON shape is known
        shaped = F.when(F.try_parse_json(value).isNull(), S.json_string(value)).otherwise(value)
        out = out.withColumn(name, S.text_list(shaped))
    return out


def metrics_at_k(df: DataFrame, metrics: str, k: int = 5) -> DataFrame:
    """Prediction scores and the retrieval row of one ``k`` from a metrics document per run."""
    doc = F.from_json(metrics, "overall_prediction struct<gene_mse: double, gene_correlation: double>, "
                               "overall_retrieval array<struct<k: int, image_to_gene_topk: double, gene_to_image_topk: double>>")
    row = F.get(F.filter(F.col("_doc.overall_retrieval"), lambda r: r["k"] == k), F.lit(0))
    return (df.withColumn("_doc", doc).withColumn("_row", row)
            .select(*df.columns, "_doc.overall_prediction.gene_mse", "_doc.overall_prediction.gene_correlation",
                    F.col("_row.image_to_gene_topk").alias(f"image_to_gene_top{k}"),
                    F.col("_row.gene_to_image_topk").alias(f"gene_to_image_top{k}")))


def schema_drift(df: DataFrame, json_text: str, version: str = EVIDENCE_SCHEMA_VERSION) -> DataFrame:
    """Rows whose JSON is invalid or was written by another schema version."""
    found = F.get_json_object(json_text, "$.schema_version")
    problem = (F.when(F.try_parse_json(F.col(json_text)).isNull(), "invalid_json")
               .when(F.coalesce(found, F.lit("")) != version, "version"))
    return df.withColumn("problem", problem).filter("problem IS NOT NULL")
