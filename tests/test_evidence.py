import pytest
from pyspark.sql import functions as F

from stromalens.operators import align, contracts, evidence as E, expression as X, review as R, specs


def test_mapping_to_structure(spark):
    rows = [("c1", "0", "tumor epithelial cell", "0.91"), ("c2", "0.0", "tumor epithelial cell", "0.87"), ("c3", " ", "x", "1")]
    m = spark.createDataFrame(rows, "cell_id string, cluster_id string, predicted_label string, confidence string")
    c = E.cell_mapping_to_clusters(m).collect()
    assert len(c) == 1 and c[0].cluster_id == "0" and c[0].n_cells == 2 and abs(c[0].mean_reference_confidence - 0.89) < 1e-12
    reviews = spark.createDataFrame([(1, 1, [(0, 5)])], "structure_id bigint, review_no int, top_clusters array<struct<cluster_id: bigint, cell_count: bigint>>")
    links = align.cluster_to_structure(reviews)
    s = E.clusters_to_structures(E.cell_mapping_to_clusters(m), links).collect()[0]
    assert (s.structure_id, s.top_reference_label, s.n_cells) == ("1", "tumor epithelial cell", 2)


def test_missing_column_is_a_warning_and_no_rows(spark):
    with pytest.warns(UserWarning, match="cluster_id/cluster column"):
        got = E.cell_mapping_to_clusters(spark.createDataFrame([(1,)], "cell_id int"))
    assert got.count() == 0 and "top_reference_label" in got.columns


def test_label_ties_go_to_first_name(spark):
    rows = [("0", n) for n in ("ab", "a", "ab", "a")]
    m = spark.createDataFrame(rows, "cluster string, label string")
    assert E.cell_mapping_to_clusters(m).collect()[0].top_reference_label == "a"


def test_wide_pathways(spark):
    de = spark.createDataFrame([("EPCAM", "1.4", "0.01"), (" krt8", "1.1", "0.02"), ("MKI67", "0.6", "0.03"), ("NONE", "9", "1")],
                               "`Feature Name` string, `Cluster 0 Log2 fold change` string, `Cluster 0 Adjusted p value` string")
    got = {r.pathway: r for r in X.pathway_scores(X.normalize_diffexp(de), align.gene_set_table(spark)).collect()}
    assert set(got) == {"epithelial_tumor", "proliferation"}
    assert abs(got["epithelial_tumor"].score - 1.25) < 1e-12 and got["epithelial_tumor"].matched_genes == "EPCAM;KRT8"


def test_he_morphology(spark):
    c = spark.createDataFrame([("k", "1", "Invasive tumor epithelium", 0.82, None)],
                              "contour_id string, structure_id string, top_label string, top_score double, top_classes array<struct<label_id: string, label: string, score: double>>")
    r = E.he_morphology(c).collect()[0]
    assert (r.dominant_signal, r.visual_entropy, r.n_contours) == ("tumor", 0.0, 1) and abs(r.tumor_signal - 0.82) < 1e-12


def test_all_zero_signals_are_artifact(spark):
    c = spark.createDataFrame([("k", "1", "Normal lobule", 0.5, None)],
                              "contour_id string, structure_id string, top_label string, top_score double, top_classes array<struct<label_id: string, label: string, score: double>>")
    assert E.he_morphology(c).collect()[0].dominant_signal == "artifact"


def test_contours_to_structure(spark):
    cls = "array<struct<label_id: string, label: string, score: double>>"
    rows = [("a", 1, "S", [("tumor", "T", 0.8), ("st", "S", 0.1)]), ("b", 1, "S", [("tumor", "T", 0.6)]), ("c", None, None, None)]
    got = E.contours_to_structure(spark.createDataFrame(rows, f"contour_id string, structure_id bigint, structure_name string, top_classes {cls}")).collect()
    by = {r.structure_name: r for r in got}
    assert by["S"].top_label_id == "tumor" and abs(by["S"].top_mean_score - 0.7) < 1e-12 and by["S"].n_classified == 2
    assert by["unassigned"].n_contours == 1 and by["unassigned"].top_mean_score == 0.0 and by["unassigned"].top_label_id is None


def test_consensus_rules(spark):
    h = spark.createDataFrame([(1, "fib", 0.35), (2, "fib", 0.91), (3, "fib", 0.5), (4, "fib", 0.7), (5, "fib", 0.7), (6, "fib", 0.7)], "cluster_id int, label_id string, confidence double")
    m = spark.createDataFrame([(1, "caf", 0.86, ["CXCL12"]), (2, "caf", 0.95, ["ZZZ"]), (4, "caf", 0.9, ["cxcl12 "]), (5, "caf", 0.8, ["CXCL12"]), (6, "caf", 0.5, ["CXCL12"])],
                              "cluster_id int, label_id string, confidence double, supporting_markers array<string>")
    k = h.select("cluster_id", F.array(F.lit("CXCL12")).alias("positive_genes"))
    failed = E.consensus_annotation(h, m.withColumn("error", F.when(F.col("cluster_id") == 1, "timeout")), k).filter("cluster_id = 1").first()
    assert (failed.reason, failed.accepted, failed.label_id, failed.model_label_id) == ("pathology_ai_error", False, "fib", None)
    got = {r.cluster_id: (r.reason, r.accepted, r.label_id) for r in E.consensus_annotation(h, m, k).collect()}
    assert got == {1: ("heuristic_low_confidence", True, "caf"), 2: ("no_marker_overlap", False, "fib"), 3: ("pathology_ai_unavailable", False, "fib"),
                   4: ("pathology_ai_confidence_margin", True, "caf"), 5: ("heuristic_retained", False, "fib"), 6: ("pathology_ai_low_confidence", False, "fib")}


def test_attach_evidence_is_idempotent(spark):
    r = spark.createDataFrame([("1", ["own"])], "structure_id string, key_evidence array<string>")
    rna = spark.createDataFrame([("1", "tumor", 0.5, 0.1)], "structure_id string, top_reference_label string, mean_reference_confidence double, ambiguous_fraction double")
    path = spark.createDataFrame([("1", "")], "structure_id string, top_activated_pathways string")
    he = spark.createDataFrame([("1", "tumor", "T", 0.25)], "structure_id string, dominant_signal string, dominant_visual_label string, visual_entropy double")
    niche = spark.createDataFrame([("1", "fine")], "structure_id string, consistency_summary string")
    ev = E.foundation_map(rna, path, he, niche)
    once = E.attach_evidence(r, ev)
    twice = E.attach_evidence(once, ev)
    assert once.collect() == twice.collect()
    assert once.first().key_evidence[1] == "Pathway activity: no dominant activated pathway."
    assert len(once.first().key_evidence) == 5


def test_critic_and_trigger(spark):
    b = spark.createDataFrame([("a", "ok", ""), ("b", "ok", ""), ("c", "warning", "")], "evidence_id string, qc_status string, conflict_note string")
    r = R.critic_counts(b).first()
    assert (r.passed, r.warned, r.failed, r.overall_status, r.flagged) == (2, 1, 0, "warning", 0)
    for flags, other, want in ((49, 10, False), (50, 5, True), (100, 0, True)):
        rows = [("flag_for_finetuning",)] * flags + [("reject",)] * other
        assert R.finetuning_trigger(spark.createDataFrame(rows, "correction_type string")).first().triggered is want


def test_qc_and_claims(spark):
    docs = spark.createDataFrame([("x", '{"status": "fail", "fatal_errors": ["bad registration"]}'), ("y", '{"warnings": ["w"]}')], "case_id string, report string")
    q = R.qc_verdict(docs, "report").withColumn("has_fatal", F.size("fatal_errors") > 0).withColumn("has_warnings", F.size("warnings") > 0)
    assert {r.case_id: r.qc_status for r in q.collect()} == {"x": "fail", "y": "warning"}
    rec = spark.createDataFrame([("y", 0, "stgpt.region.7", "3", ["m.csv"], "abc123"), ("x", 0, "e", "1", [], "")],
                                "case_id string, record_no int, evidence_id string, prototype_id string, artifact_paths array<string>, checkpoint_hash string")
    got = {r.claim_id: r for r in R.build_claims(q, rec).collect()}
    assert set(got) == {"claim.blocked.x", "claim.stgpt.region.7"}
    assert got["claim.stgpt.region.7"].cautionary and got["claim.stgpt.region.7"].checkpoint_hash == "abc123" and "prototype 3" in got["claim.stgpt.region.7"].claim_text


def test_summary_rows_fallback(spark):
    qc = spark.createDataFrame([("ok",)], "qc_status string")
    none = spark.createDataFrame([], "structure_label string, n_cells string")
    assert [r.evidence_id for r in R.summary_rows(none, qc, "demo", ["a"]).collect()] == ["stgpt.case.demo"]
    some = spark.createDataFrame([("tumor", "12")], "structure_label string, n_cells string")
    assert [r.evidence_id for r in R.summary_rows(some, qc, "demo", ["a"]).collect()] == ["stgpt.structure.tumor"]


def test_contract_rules(spark):
    d = spark.createDataFrame([("e", "cell", "s", "t", "ok", "pending", '{"a": 1}'), ("", "planet", "s", "", "bad", "pending", '{"zz": 1}')],
                              "evidence_id string, unit string, source string, evidence_type string, qc_status string, human_review_state string, doc string")
    got = [r.violations for r in contracts.row_contract(d, [*contracts.evidence_bundle_rules(), contracts.no_extra_fields("doc", ["a"])]).collect()]
    assert got == [[], ["evidence_id:min_length", "unit:enum", "evidence_type:min_length", "qc_status:enum", "doc:extra_field"]]


def test_group_text_errors(spark):
    with pytest.raises(ValueError):
        specs.structure_spec(spark, "1,2\n2,3")
    with pytest.raises(ValueError):
        specs.structure_spec(spark, " ; \n")
    got = specs.structure_spec(spark, "a: 10, 23,10.0\n\n19", ["Core"]).orderBy("structure_id").collect()
    assert [(r.structure_id, r.structure_name, r.cluster_ids) for r in got] == [(1, "Core", ["10", "23"]), (2, "Structure 2", ["19"])]


def test_pseudobulk_zero_fill_and_unmatched(spark):
    e = spark.createDataFrame([("g1", "c1", 2.0), ("g1", "c1", 1.0), ("g2", "c3", 4.0), ("g3", "zz", 5.0)], "gene string, cell_id string, n double")
    k = spark.createDataFrame([("c1", "A"), ("c2", "A"), ("c3", "B")], "cell_id string, cluster string")
    got = {(r.gene, r.cluster): r for r in X.pseudobulk_de(e, k).collect()}
    assert len(got) == 6
    assert got["g1", "A"].mean_counts == 1.5 and got["g1", "B"].mean_counts == 0.0 and got["g3", "A"].mean_counts == 0.0
    import math
    assert abs(got["g1", "A"].log2fc - math.log2(1.55 / 0.05)) < 1e-12 and got["g1", "A"].adj_p == 0.001 and got["g3", "A"].adj_p == 1.0


def test_stem_join(spark):
    labels = spark.createDataFrame([("a-1", "0"), ("b-1", "1")], "barcode string, cluster string")
    cells = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "barcode string, x double")
    assert sorted(r.x for r in align.join_with_stem_fallback(labels, cells).collect()) == [1.0, 2.0]


def test_spearman_matches_ranks(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    n = 60
    d = rng.integers(0, 25, n).astype(float)
    v = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 6, n)).astype(float)
    dist = spark.createDataFrame([(i, float(d[i])) for i in range(n)], "cell_id int, d double")
    expr = spark.createDataFrame([("g", i, float(v[i])) for i in range(n) if v[i]], "gene string, cell_id int, n double")

    def rank(a):
        return np.array([(a < x).sum() + ((a == x).sum() + 1) / 2 for x in a])
    r = X.distance_expression_coupling(expr, dist).first()
    assert abs(r.spearman_rho - np.corrcoef(rank(d), rank(v))[0, 1]) < 1e-9 and r.n_cells == n
