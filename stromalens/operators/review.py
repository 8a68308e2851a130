"""Quality control of evidence bundles: critic, verdicts, claims and work ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from .ranking import top_per_group

# Severity order and report texts -------------------------------
QC_ORDER = {"ok": 0, "warning": 1, "fail": 2, "unknown": 3}
COVERAGE_KEYS = ("image_coverage", "cell_coverage", "patch_cell_coverage", "patch_cell_coverage_fraction")
BLOCKED_TEXT = "Biological conclusions are blocked because fatal QC errors are present."
NO_RECORDS_TEXT = "No sampled stGPT evidence-chain records were available for biological interpretation."
ACTION_FATAL = "Resolve fatal QC before accepting biological conclusions."
ACTION_REVIEW = "Pathologist review required before clinical or biological assertion."
GUARDRAIL = "Model-derived evidence; do not report as measured expression or diagnosis."
# ------------------------------------------------------------------------------


def qc_rank(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(3)
    for name, r in QC_ORDER.items():
        out = F.when(c == name, r).otherwise(out)
    return out


def critic_counts(bundles: DataFrame, min_qc: str = "warning", by: Sequence[str] = ()) -> DataFrame:
    """Counts by status and the worst status; statuses outside the list rank as unknown."""
    s = F.col("qc_status")
    names = F.array(*[F.lit(n) for n in QC_ORDER])
    return bundles.groupBy(*by).agg(
        F.count("*").alias("total_bundles"), F.count_if(s == "ok").alias("passed"), F.count_if(s == "warning").alias("warned"),
        F.count_if(s == "fail").alias("failed"), F.count_if(qc_rank(s) > QC_ORDER[min_qc]).alias("flagged"),
        F.count_if(F.coalesce("conflict_note", F.lit("")) != "").alias("conflicts"),
        F.element_at(names, F.max(qc_rank(s)) + 1).alias("overall_status"))


def flagged_bundles(bundles: DataFrame, min_qc: str = "warning") -> DataFrame:
    """Bundles below the accepted status. A table, not a list: it may hold most bundles."""
    return bundles.filter(qc_rank("qc_status") > QC_ORDER[min_qc])


def conflicts(bundles: DataFrame) -> DataFrame:
    return bundles.filter(F.col("conflict_note") != "").select("evidence_id", F.col("conflict_note").alias("note"), "unit_id")


def resolve_conflicts(bundles: DataFrame, policy: str = "flag_only") -> DataFrame:
    """Add what happens to a conflicting bundle under the review policy."""
    if policy not in ("auto_skip", "block", "flag_only"):
        raise ValueError(f"unknown policy {policy!r}")
    has = F.coalesce("conflict_note", F.lit("")) != ""
    return bundles.withColumn("conflict_action", F.when(has, policy))


def evidence_split(bundles: DataFrame, flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(approved, pending review) by the flagged ids."""
    ids = flagged.select("evidence_id")
    return bundles.join(ids, "evidence_id", "left_anti"), bundles.join(ids, "evidence_id", "left_semi")


def finetuning_trigger(corrections: DataFrame, threshold: int = 50, by: Sequence[str] = ()) -> DataFrame:
    n = F.count_if(F.col("correction_type") == "flag_for_finetuning")
    return corrections.groupBy(*by).agg(n.alias("flagged"), (n >= threshold).alias("triggered"))


def _texts(json_text: Column) -> Column:
    return S.text_list(json_text)


def qc_verdict(df: DataFrame, report: str, min_coverage: float = 0.0, require_pass: bool = True,
               fail_words: Sequence[str] = ("fail",)) -> DataFrame:
    """Errors, warnings, coverage and a verdict from one QC report document per row."""
    doc = F.col(report)
    parsed = F.try_parse_json(doc)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    raw = F.coalesce(*[F.when(F.size(_texts(F.get_json_object(doc, p))) > 0, _texts(F.get_json_object(doc, p)))
                       for p in ("$.fatal_errors", "$.errors")])
    failed = F.get_json_object(doc, "$.status").isin(*fail_words)
    fatal = (F.when(parsed.isNull(), F.array(F.lit("QC report is not valid JSON.")))
             .when(~is_object, F.array(F.lit("QC report is not a JSON object."))).when(raw.isNotNull(), raw)
             .when(failed, F.array(F.lit("QC status is fail."))).otherwise(F.array().cast("array<string>")))
    listed = F.coalesce(*[F.get_json_object(doc, f"$.{k}") for k in COVERAGE_KEYS])
    total = F.get_json_object(doc, "$.n_cells_total").try_cast("double")
    covered = F.get_json_object(doc, "$.n_cells_with_image").try_cast("double")
    coverage = F.when(listed.isNotNull(), listed.try_cast("double")).otherwise(F.try_divide(covered, total))
    low = F.when(coverage < min_coverage, F.array(F.concat(F.lit("coverage "), F.format_string("%.3f", coverage), F.lit(" is below minimum "),
                                                           F.lit(f"{min_coverage:.3f}."))))
    none = F.array().cast("array<string>")
    out = (df.withColumn("fatal_errors", fatal).withColumn("cell_coverage", coverage)
           .withColumn("warnings", F.concat(_texts(F.get_json_object(doc, "$.warnings")), F.coalesce(low, none))))
    has_fatal = F.size("fatal_errors") > 0
    return out.withColumn("qc_status", F.when(has_fatal & F.lit(require_pass), "fail").when(has_fatal | (F.size("warnings") > 0), "warning").otherwise("ok"))


def summary_rows(structures: DataFrame, qc: DataFrame, case_name: str, artifact_ids: Sequence[str], checkpoint_sha256: str = "") -> DataFrame:
    """One evidence row per structure; a single case row when there is no structure.

    ``qc`` has one row with ``qc_status``. The fallback row carries the number of
    structures found, so both branches stay lazy.
    """
    status = qc.select("qc_status").scalar()
    names = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("structure_label", "structure_id", "structure") if c in structures.columns]
    label = F.coalesce(*names, F.lit("unknown"))
    count = F.coalesce(F.col("n_cells").cast("string"), F.lit("")) if "n_cells" in structures.columns else F.lit("")
    rows = structures.select(F.concat(F.lit("stgpt.structure."), label).alias("evidence_id"), F.lit("stgpt_structure_embedding").alias("evidence_type"),
                             label.alias("structure_label"), count.alias("n_cells"))
    none_found = structures.limit(1).groupBy().agg(F.count("*").alias("n")).filter("n = 0")
    case = none_found.select(F.lit(f"stgpt.case.{case_name}").alias("evidence_id"), F.lit("stgpt_case_embedding").alias("evidence_type"),
                             F.lit("case").alias("structure_label"), F.lit("").alias("n_cells"))
    return (rows.unionByName(case).withColumn("qc_status", status).withColumn("human_review_state", F.lit("pending"))
            .withColumn("model_derived", F.lit(True)).withColumn("measured_expression", F.lit(False))
            .withColumn("artifact_ids", F.array(*[F.lit(a) for a in artifact_ids])).withColumn("checkpoint_sha256", F.lit(checkpoint_sha256))
            .withColumn("claim_guardrail", F.lit(GUARDRAIL)))


def artifact_paths(measured: str, derived: str) -> Column:
    """Sorted distinct artifacts named in two ``MAP<STRING, STRUCT<artifact, …>>`` columns."""
    def paths(c):
        return F.coalesce(F.transform(F.map_values(F.col(c)), lambda v: v["artifact"]), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(paths(measured), paths(derived)), lambda p: F.coalesce(p, F.lit("")) != "")))


def build_claims(cases: DataFrame, records: DataFrame, limit: int = 20) -> DataFrame:
    """Claims per case from its QC verdict and its first evidence records.

    ``cases(case_id, qc_status, has_fatal, has_warnings)``;
    ``records(case_id, record_no, evidence_id, prototype_id, artifact_paths, checkpoint_hash)``.
    Fatal QC leaves one blocking claim, no record one placeholder.
    """
    first_hash = records.filter(F.coalesce("checkpoint_hash", F.lit("")) != "").groupBy("case_id").agg(F.min_by("checkpoint_hash", "record_no").alias("_hash"))
    base = (cases.join(first_hash, "case_id", "left").withColumn("checkpoint_hash", F.coalesce("_hash", F.lit(""))).drop("_hash"))
    picked = top_per_group(records.drop("checkpoint_hash"), ["case_id"], [F.asc("record_no")], limit)
    open_cases = base.filter(~F.col("has_fatal"))
    none = F.array().cast("array<string>")
    eid = F.coalesce(F.nullif("evidence_id", F.lit("")), F.concat(F.lit("stgpt.region."), F.col("record_no").cast("string")))
    text = F.concat(F.lit("Region-level stGPT evidence for "), F.col("case_id"), F.lit(" maps to prototype "), F.coalesce("prototype_id", F.lit("unknown")),
                    F.lit(". This is model-derived morpho-molecular evidence, not measured expression."))
    normal = open_cases.join(picked, "case_id").select(
        "case_id", F.concat(F.lit("claim."), eid).alias("claim_id"), text.alias("claim_text"), F.array(eid).alias("evidence_ids"), "qc_status",
        "artifact_paths", "checkpoint_hash", (F.col("has_warnings") | (F.col("qc_status") == "warning")).alias("cautionary"))

    def fallback(df: DataFrame, prefix: str, message: str, status: Column) -> DataFrame:
        return df.select("case_id", F.concat(F.lit(prefix), "case_id").alias("claim_id"), F.lit(message).alias("claim_text"), none.alias("evidence_ids"),
                         status.alias("qc_status"), none.alias("artifact_paths"), "checkpoint_hash", F.lit(True).alias("cautionary"))
    blocked = fallback(base.filter("has_fatal"), "claim.blocked.", BLOCKED_TEXT, F.lit("fail"))
    empty = fallback(open_cases.join(records.select("case_id"), "case_id", "left_anti"), "claim.no_records.", NO_RECORDS_TEXT, F.col("qc_status"))
    return (normal.unionByName(blocked).unionByName(empty).withColumn("human_review_state", F.lit("pending"))
            .withColumn("model_derived", F.lit(True)).withColumn("measured_expression", F.lit(False)))


def claim_table(claims: DataFrame) -> DataFrame:
    """Claims with their lists joined by ``;``."""
    out = claims
    for c in ("evidence_ids", "artifact_paths"):
        out = out.withColumn(c, F.array_join(c, ";"))
    return out


def review_checklist(claims: DataFrame, cases: DataFrame) -> DataFrame:
    """What a reviewer has to do: one item per claim, or one per blocked case."""
    fatal = cases.filter("has_fatal").select("case_id", F.lit("QC fatal review").alias("item"), F.lit("pending").alias("state"),
                                             F.lit("").alias("evidence_ids"), F.lit(ACTION_FATAL).alias("required_action"))
    open_claims = claims.join(cases.filter("has_fatal").select("case_id"), "case_id", "left_anti").select(
        "case_id", F.col("claim_id").alias("item"), F.col("human_review_state").alias("state"), F.array_join("evidence_ids", ";").alias("evidence_ids"),
        F.lit(ACTION_REVIEW).alias("required_action"))
    return fatal.unionByName(open_claims)


def manifest_counts(artifacts: DataFrame, required: DataFrame) -> DataFrame:
    """Total, existing and missing required artifacts in one pass over the outer join."""
    j = artifacts.select("id", "exists", F.lit(True).alias("_listed")).join(required.select("id", F.lit(True).alias("_required")), "id", "full_outer")
    there = F.coalesce("exists", F.lit(False))
    return j.agg(F.count_if(F.col("_listed")).alias("total"), F.count_if(F.col("_listed") & there).alias("existing"),
                 F.count_if(F.col("_required") & ~there).alias("missing_required"))


def pending_work(plan: DataFrame, ledger: DataFrame, outputs: DataFrame) -> DataFrame:
    """Plan rows whose input hash has no ledger entry with an existing output."""
    done = ledger.join(outputs.select(F.col("path").alias("output_artifact")), "output_artifact", "left_semi").select("unit_id", "input_hash")
    return plan.join(done, ["unit_id", "input_hash"], "left_anti")


def stale_outputs(inputs: DataFrame, outputs: DataFrame, expected: DataFrame, force: bool = False) -> DataFrame:
    """Units to recompute: forced, an output missing, or an input newer than the oldest output.

    ``inputs/outputs(unit_id, path, modificationTime)``, ``expected(unit_id, path)``.
    """
    newest = inputs.groupBy("unit_id").agg(F.max("modificationTime").alias("newest_input"))
    state = (expected.join(outputs.select("unit_id", "path", "modificationTime"), ["unit_id", "path"], "left").groupBy("unit_id")
             .agg(F.count_if(F.col("modificationTime").isNull()).alias("missing"), F.min("modificationTime").alias("oldest_output")))
    stale = F.lit(force) | (F.col("missing") > 0) | (F.col("newest_input") > F.col("oldest_output"))
    return state.join(newest, "unit_id", "left").filter(stale).select("unit_id", "missing", "oldest_output", "newest_input")


def ledger_append(units: DataFrame, tool: str, path: str) -> None:
    """Append ``(unit_id, input_hash, tool, elapsed_seconds, output_artifact, time)`` to the ledger."""
    (units.select("unit_id", "input_hash", F.lit(tool).alias("tool"), "elapsed_seconds", "output_artifact", F.current_timestamp().alias("recorded_at"))
     .write.mode("append").parquet(path))
