"""Structure roll-ups, fusion and review decisions bound to the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import align, evidence as E, ranking
from .bindings import (CELLS, CLUSTER_STRUCTURE, CONTOURS, VISUAL_LABEL, cells, cluster_structure, contours, table,
                       visual_label)
from .expression_plans import DE, MEANS, STRUCTURE_SCORES, structure_pathways
from .registry import plan

MAPPING = f"""{CELLS}, mapping AS (SELECT cell_id, cluster AS cluster_id,
   CASE WHEN c_nationkey < 2 THEN 'unknown' WHEN c_nationkey = 2 THEN 'Other' ELSE lower(c_mktsegment) || ' tumor' END AS label,
   CASE WHEN c_nationkey = 4 THEN 0 ELSE x / 500 END AS conf FROM cells JOIN customer ON c_custkey = custkey)"""
CLUSTER_ROWS = f"""{MAPPING}, counts AS (SELECT cluster_id, label, count(*) AS n, sum(conf) AS conf FROM mapping GROUP BY 1, 2),
 cluster_rows AS (SELECT cluster_id, CAST(sum(n) AS BIGINT) AS n_cells, first(label ORDER BY n DESC, label) AS top_reference_label, max(n) / sum(n) AS top_reference_fraction,
   sum(conf) / sum(n) AS mean_reference_confidence,
   coalesce(sum(n) FILTER (lower(label) IN ('unknown', 'ambiguous', 'unassigned', 'other')), 0) / sum(n) AS ambiguous_fraction,
   string_agg(label || '=' || n, ',' ORDER BY label) AS label_distribution FROM counts GROUP BY 1)"""
STRUCTURE_ROWS = f"""{CLUSTER_ROWS}, {CLUSTER_STRUCTURE}, weighted AS (SELECT *, CAST(round_even(n_cells * top_reference_fraction, 0) AS BIGINT) AS w
    FROM cluster_rows JOIN cluster_structure USING (cluster_id)),
 labels_by_structure AS (SELECT structure_id, top_reference_label AS label, sum(w) AS w FROM weighted GROUP BY 1, 2),
 best AS (SELECT structure_id, first(label ORDER BY w DESC, label) AS top_reference_label, CAST(max(w) AS DOUBLE) AS top_w,
    string_agg(label || '=' || w, ',' ORDER BY label) AS label_distribution FROM labels_by_structure GROUP BY 1),
 structure_rows AS (SELECT structure_id, CAST(sum(n_cells) AS BIGINT) AS n_cells, any_value(best.top_reference_label) AS top_reference_label,
   any_value(top_w) / sum(n_cells) AS top_reference_fraction, sum(n_cells * mean_reference_confidence) / sum(n_cells) AS mean_reference_confidence,
   sum(n_cells * ambiguous_fraction) / sum(n_cells) AS ambiguous_fraction, string_agg(cluster_id, ',' ORDER BY cluster_id) AS clusters,
   any_value(best.label_distribution) AS label_distribution FROM weighted JOIN best USING (structure_id) GROUP BY 1)"""


def _mapping(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), "c_nationkey", "c_mktsegment")
    label = (F.when(F.col("c_nationkey") < 2, " ").when(F.col("c_nationkey") == 2, "Other")
             .otherwise(F.concat(F.lower("c_mktsegment"), F.lit(" tumor"))))
    conf = F.when(F.col("c_nationkey") == 4, float("nan")).otherwise(F.col("x") / 500)
    return cells(spark, sf).join(c, "custkey").select("cell_id", F.col("cluster").alias("Leiden"), label.alias("Predicted Label"), conf.alias("confidence"))


def _clusters(spark, sf):
    return E.cell_mapping_to_clusters(_mapping(spark, sf))


def _structures(spark, sf):
    return E.clusters_to_structures(_clusters(spark, sf), cluster_structure(spark, sf))


def _show(d, *doubles):
    text = F.transform(F.map_entries("label_distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    d = d.withColumn("label_distribution", F.array_join(text, ",")) if "label_distribution" in d.columns else d
    for c in doubles:
        d = d.withColumn(c, F.round(c, 6))
    return d


RATES = ("top_reference_fraction", "mean_reference_confidence", "ambiguous_fraction")
_ROUND_RATES = ", ".join(f"round({c}, 6) AS {c}" for c in RATES)


@plan("cell_mapping_to_clusters", f"""WITH {CLUSTER_ROWS} SELECT cluster_id, n_cells, top_reference_label, {_ROUND_RATES},
  label_distribution FROM cluster_rows""")
def cell_mapping_to_clusters(spark, sf):
    return _show(_clusters(spark, sf), *RATES)


@plan("normalize_cluster_summary", """SELECT CAST(c_nationkey AS VARCHAR) AS cluster_id, CASE WHEN max(c_acctbal) > 9000
   THEN CAST(trunc(max(c_acctbal)) AS BIGINT) ELSE 1 END AS n_cells, 'unknown' AS top_reference_label, 1.0::DOUBLE AS top_reference_fraction,
   round(avg(c_acctbal), 6) AS mean_reference_confidence, 0.0::DOUBLE AS ambiguous_fraction, 'unknown=1' AS label_distribution
  FROM customer GROUP BY c_nationkey""")
def normalize_cluster_summary(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("double").cast("string").alias("Group-ID")).agg(
        F.when(F.max("c_acctbal") > 9000, F.max("c_acctbal").cast("string")).otherwise("bad").alias("N Cells"),
        F.lit(" ").alias("cell_type"), F.avg("c_acctbal").cast("string").alias("Score"))
    return _show(E.normalize_cluster_summary(c), *RATES)


@plan("clusters_to_structures", f"""WITH {STRUCTURE_ROWS} SELECT structure_id, n_cells, top_reference_label, {_ROUND_RATES},
  clusters, label_distribution FROM structure_rows""")
def clusters_to_structures(spark, sf):
    return _show(_structures(spark, sf), *RATES).withColumn("clusters", F.array_join("clusters", ","))


@plan("argmax_label", """SELECT o_custkey, o_orderpriority AS label, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n,
   row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2) WHERE r = 1""")
def argmax_label(spark, sf):
    return (E.argmax_label(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority")
            .withColumnRenamed("o_orderpriority", "label"))


_BUCKET = "CASE {} WHEN 'Invasive tumor epithelium' THEN 'tumor' WHEN 'Immune infiltrate' THEN 'inflammation' WHEN 'Stroma collagen' THEN 'stroma' WHEN 'Fibrous stroma' THEN 'stroma' WHEN 'Plasma cells' THEN 'inflammation' WHEN 'Blur artifact' THEN 'artifact' END"
SIGNALS = f"""{CONTOURS}, marked AS (SELECT contour_id, {_BUCKET.format('top_label')} AS b, top_score AS s FROM contours
   UNION ALL SELECT contour_id, {_BUCKET.format('label')}, score FROM classes),
 signals AS (SELECT contour_id, {', '.join(f"coalesce(max(s) FILTER (b = '{x}'), 0) AS {x}_signal" for x in ('artifact', 'tumor', 'inflammation', 'stroma'))}
   FROM marked GROUP BY 1)"""
_SIGNAL_COLS = ", ".join(f"{x}_signal" for x in ("artifact", "tumor", "inflammation", "stroma"))


@plan("class_signals", f"WITH {SIGNALS} SELECT contour_id, {_SIGNAL_COLS} FROM signals")
def class_signals(spark, sf):
    return E.class_signals(contours(spark, sf)).select("contour_id", *E.SIGNALS)


MORPHOLOGY = f"""{SIGNALS}, per AS (SELECT CAST(structure_id AS VARCHAR) AS structure_id, top_label AS label, count(*) AS n, sum(top_score) AS score,
   {', '.join(f'sum({x}_signal) AS {x}_signal' for x in ('artifact', 'tumor', 'inflammation', 'stroma'))}
   FROM contours JOIN signals USING (contour_id) WHERE structure_id IS NOT NULL GROUP BY 1, 2),
 sized AS (SELECT *, sum(n) OVER (PARTITION BY structure_id) AS total, count(*) OVER (PARTITION BY structure_id) AS k FROM per),
 morph AS (SELECT structure_id, CAST(any_value(total) AS BIGINT) AS n_contours, first(label ORDER BY n DESC, label) AS dominant_visual_label,
   max(n) / any_value(total) AS dominant_visual_fraction, sum(score) / any_value(total) AS mean_foundation_score,
   {', '.join(f'sum({x}_signal) / any_value(total) AS {x}_signal' for x in ('artifact', 'tumor', 'inflammation', 'stroma'))},
   CASE WHEN any_value(k) > 1 THEN -sum(n / total * ln(n / total)) / ln(any_value(k)) ELSE 0 END AS visual_entropy,
   string_agg(label || '=' || n, ',' ORDER BY label) AS label_distribution FROM sized GROUP BY 1),
 morphology AS (SELECT *, CASE greatest({_SIGNAL_COLS}) WHEN artifact_signal THEN 'artifact' WHEN tumor_signal THEN 'tumor'
   WHEN inflammation_signal THEN 'inflammation' ELSE 'stroma' END AS dominant_signal FROM morph)"""
_MORPH_DOUBLES = ("dominant_visual_fraction", "mean_foundation_score", *E.SIGNALS, "visual_entropy")


@plan("he_morphology", f"""WITH {MORPHOLOGY} SELECT structure_id, n_contours, dominant_visual_label, dominant_signal, label_distribution,
  {', '.join(f'round({c}, 6) AS {c}' for c in _MORPH_DOUBLES)} FROM morphology""")
def he_morphology(spark, sf):
    return _show(E.he_morphology(contours(spark, sf)), *_MORPH_DOUBLES)


@plan("normalized_entropy", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
  p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
  SELECT user_id, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS entropy FROM p GROUP BY 1""")
def normalized_entropy(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.round(E.entropy_of_counts("n"), 6).alias("entropy"))


@plan("top_k_classes", f"""WITH s AS (SELECT event_id AS contour_id, 'p.' || event_type AS prompt, value AS score FROM events WHERE value >= 5
   UNION ALL SELECT event_id, 'p.k', CAST(json_extract(props, '$.k') AS DOUBLE) FROM events WHERE value >= 5
   UNION ALL SELECT event_id, 'p.zero', 0 FROM events WHERE value >= 5),
  r AS (SELECT *, row_number() OVER (PARTITION BY contour_id ORDER BY score DESC, prompt) AS rank FROM s)
  SELECT contour_id, CAST(rank AS INTEGER) AS rank, coalesce(substr(prompt, 3), prompt) AS label_id, score, NULL::VARCHAR AS error FROM r WHERE rank <= 2 AND prompt NOT IN ('p.k', 'p.zero')
  UNION ALL SELECT contour_id, CAST(rank AS INTEGER), prompt, score, NULL FROM r WHERE rank <= 2 AND prompt IN ('p.k', 'p.zero')
  UNION ALL SELECT event_id, NULL, NULL, NULL, 'not scored' FROM events WHERE value < 5""")
def top_k_classes(spark, sf):
    e = table(spark, sf, "events")
    scored = F.array(F.struct(F.concat(F.lit("p."), "event_type").alias("prompt"), F.col("value").alias("score")),
                     F.struct(F.lit("p.k").alias("prompt"), F.get_json_object("props", "$.k").cast("double").alias("score")),
                     F.struct(F.lit("p.zero").alias("prompt"), F.lit(0.0).alias("score")))
    low = F.col("value") < 5
    rows = e.select(F.col("event_id").alias("contour_id"), F.when(~low, scored).alias("scored"), F.when(low, "not scored").alias("error"))
    prompts = e.select(F.concat(F.lit("p."), "event_type").alias("prompt"), F.col("event_type").alias("label_id"),
                       visual_label("event_type").alias("label")).distinct()
    return E.top_k_classes(rows, prompts, 2).select("contour_id", "rank", "label_id", "score", "error")


SUMMARY = f"""{CONTOURS}, keyed AS (SELECT *, coalesce(structure_name, 'unassigned') AS sname FROM contours),
 n AS (SELECT structure_id, sname, count(*) AS n_contours, count(*) FILTER (has_classes) AS n_classified,
   array_to_string(list_slice(list(contour_id ORDER BY contour_id) FILTER (has_classes), 1, 6), ',') AS example_contours FROM keyed GROUP BY 1, 2),
 l AS (SELECT structure_id, coalesce(structure_name, 'unassigned') AS sname, label_id, min(label) AS label, avg(score) AS mean_score, max(score) AS max_score
   FROM classes GROUP BY 1, 2, 3),
 t AS (SELECT structure_id, sname, first(label_id ORDER BY mean_score DESC, max_score DESC, label_id) AS top_label_id,
   first(label ORDER BY mean_score DESC, max_score DESC, label_id) AS top_label, first(mean_score ORDER BY mean_score DESC, max_score DESC, label_id) AS top_mean_score,
   first(max_score ORDER BY mean_score DESC, max_score DESC, label_id) AS top_max_score,
   array_to_string(list_slice(list(label_id || '=' || printf('%.4f', mean_score) ORDER BY mean_score DESC, max_score DESC, label_id), 1, 5), ',') AS top_visual_labels
   FROM l GROUP BY 1, 2),
 summary AS (SELECT n.structure_id, n.sname AS structure_name, n_contours, n_classified, example_contours, top_label_id, top_label, top_mean_score, top_max_score, top_visual_labels
   FROM n LEFT JOIN t ON n.structure_id IS NOT DISTINCT FROM t.structure_id AND n.sname = t.sname)"""


def _summary(spark, sf):
    return E.contours_to_structure(contours(spark, sf))


@plan("contours_to_structure", f"""WITH {SUMMARY} SELECT structure_id, structure_name, n_contours, n_classified, example_contours, top_label_id, top_label,
  round(top_mean_score, 6) AS top_mean_score, round(top_max_score, 6) AS top_max_score, top_visual_labels FROM summary""")
def contours_to_structure(spark, sf):
    labels = F.transform("top_visual_labels", lambda v: F.format_string("%s=%.4f", v["label_id"], v["mean_score"]))
    return (_summary(spark, sf).withColumn("top_visual_labels", F.array_join(labels, ","))
            .withColumn("example_contours", F.array_join("example_contours", ","))
            .withColumn("top_mean_score", F.round("top_mean_score", 6)).withColumn("top_max_score", F.round("top_max_score", 6)))


REVIEWS = """reviews AS (SELECT DISTINCT CAST(user_id % 9 AS VARCHAR) AS structure_id, CASE WHEN user_id % 9 < 5 THEN 'Niche ' || user_id % 9 ELSE '' END AS title,
   'Assigned ' || user_id % 9 AS assigned_label FROM events)"""


def _reviews(spark, sf):
    k = F.col("user_id") % 9
    return (table(spark, sf, "events").select(k.alias("structure_id")).distinct().select(
        F.concat("structure_id", F.lit(".0")).alias("structure_id"),
        F.when(F.col("structure_id") < 5, F.concat(F.lit("Niche "), F.col("structure_id").cast("string"))).otherwise("").alias("title"),
        F.concat(F.lit("Assigned "), F.col("structure_id").cast("string")).alias("assigned_label")))


def _fusion(spark, sf):
    return E.niche_fusion(_reviews(spark, sf), _structures(spark, sf), structure_pathways(spark, sf), E.he_morphology(contours(spark, sf)))


FUSION = f"""{STRUCTURE_ROWS}, {DE.replace(CELLS + ',', '')}, pathway_rows AS ({STRUCTURE_SCORES(MEANS)}), {MORPHOLOGY}, {REVIEWS},
 fused AS (SELECT structure_id, 'N' || structure_id AS niche_id, coalesce(CASE WHEN title <> '' THEN title ELSE assigned_label END, '') AS current_name,
   coalesce(top_reference_label, '') AS rna_top_reference_label, mean_reference_confidence AS rna_reference_confidence,
   coalesce(top_activated_pathways, '') AS top_activated_pathways, pathway_separation_score, coalesce(dominant_signal, '') AS he_dominant_signal,
   visual_entropy AS he_visual_entropy, concat_ws(',', CASE WHEN s.n_cells IS NOT NULL THEN 'rna_foundation' END,
     CASE WHEN p.pathway_scores IS NOT NULL THEN 'pathway' END, CASE WHEN m.n_contours IS NOT NULL THEN 'he_morphology' END) AS evidence_modalities
  FROM reviews FULL JOIN structure_rows s USING (structure_id) FULL JOIN pathway_rows p USING (structure_id) FULL JOIN morphology m USING (structure_id)),
 noted AS (SELECT *, CASE WHEN rna_top_reference_label = '' OR he_dominant_signal = '' THEN NULL
    WHEN rna_top_reference_label LIKE '%tumor%' AND he_dominant_signal = 'tumor' THEN '{E.NOTE_TUMOR}'
    WHEN regexp_matches(rna_top_reference_label, 'fibro|stroma') AND he_dominant_signal = 'stroma' THEN '{E.NOTE_STROMA}'
    WHEN he_dominant_signal = 'inflammation' THEN '{E.NOTE_INFLAMMATION}' WHEN he_dominant_signal = 'artifact' THEN '{E.NOTE_ARTIFACT}' END AS note1,
   CASE WHEN top_activated_pathways <> '' THEN '{E.NOTE_PATHWAYS}' || array_to_string(list_slice(list_transform(string_split(top_activated_pathways, ';'),
     lambda v: split_part(v, ':', 1)), 1, 3), ', ') END AS note2 FROM fused),
 fusion AS (SELECT *, CASE WHEN note1 IS NULL AND note2 IS NULL THEN '{E.NOTE_NONE}' ELSE concat_ws('; ', note1, note2) END AS consistency_summary FROM noted)"""


@plan("niche_fusion", f"""WITH {FUSION} SELECT structure_id, niche_id, current_name, rna_top_reference_label, round(rna_reference_confidence, 6) AS rna_reference_confidence,
  top_activated_pathways, round(pathway_separation_score, 5) AS pathway_separation_score, he_dominant_signal, round(he_visual_entropy, 6) AS he_visual_entropy,
  evidence_modalities, CAST(CASE WHEN evidence_modalities = '' THEN 0 ELSE len(string_split(evidence_modalities, ',')) END AS INTEGER) AS evidence_modality_count,
  consistency_summary FROM fusion""")
def niche_fusion(spark, sf):
    d = _show(_fusion(spark, sf), "rna_reference_confidence", "he_visual_entropy")
    d = d.withColumn("pathway_separation_score", F.round("pathway_separation_score", 5)).withColumn("evidence_modalities", F.array_join("evidence_modalities", ","))
    return E.sort_ids(d)


def _map(spark, sf):
    return E.foundation_map(_structures(spark, sf), structure_pathways(spark, sf), E.he_morphology(contours(spark, sf)),
                            _fusion(spark, sf).select("structure_id", "consistency_summary"))


@plan("foundation_map", f"""WITH {FUSION} SELECT f.structure_id, top_reference_label AS rna_label, p.top_activated_pathways AS pathways, dominant_signal AS he_signal,
  consistency_summary AS niche_note FROM fusion f LEFT JOIN structure_rows s USING (structure_id) LEFT JOIN pathway_rows p USING (structure_id)
  LEFT JOIN morphology m USING (structure_id)""")
def foundation_map(spark, sf):
    return _map(spark, sf).select("structure_id", F.col("rna_foundation.top_reference_label").alias("rna_label"),
                                  F.col("pathway_activity.top_activated_pathways").alias("pathways"), F.col("he_morphology.dominant_signal").alias("he_signal"),
                                  F.col("niche_fusion.consistency_summary").alias("niche_note"))


LINES = f"""{FUSION}, lines AS (SELECT f.structure_id, concat_ws('|',
   CASE WHEN s.n_cells IS NOT NULL THEN 'RNA foundation/reference mapping: ' || s.top_reference_label || ' (confidence ' || printf('%.2f', s.mean_reference_confidence)
     || ', ambiguous ' || printf('%.2f', s.ambiguous_fraction) || ').' END,
   CASE WHEN p.pathway_scores IS NOT NULL THEN 'Pathway activity: ' || CASE WHEN p.top_activated_pathways = '' THEN 'no dominant activated pathway' ELSE p.top_activated_pathways END || '.' END,
   CASE WHEN m.n_contours IS NOT NULL THEN 'H&E morphology foundation signal: ' || dominant_signal || ' via ' || dominant_visual_label || ' (entropy ' || printf('%.2f', visual_entropy) || ').' END,
   'Cross-modal consistency: ' || consistency_summary || '.') AS text
  FROM fusion f LEFT JOIN structure_rows s USING (structure_id) LEFT JOIN pathway_rows p USING (structure_id) LEFT JOIN morphology m USING (structure_id))"""


@plan("evidence_lines", f"WITH {LINES} SELECT structure_id, text FROM lines")
def evidence_lines(spark, sf):
    return _map(spark, sf).select("structure_id", F.array_join(E.evidence_lines(), "|").alias("text"))


@plan("attach_evidence", f"""WITH {LINES} SELECT structure_id, text || '|seen ' || structure_id AS key_evidence FROM reviews JOIN lines USING (structure_id)
  UNION ALL SELECT 'none', repeat('own|', 19) || 'own'""")
def attach_evidence(spark, sf):
    r = _reviews(spark, sf)
    own = F.concat(F.lit("seen "), S.canonical_id("structure_id"))
    r = r.withColumn("key_evidence", F.array(own, own))
    # a review without evidence keeps all of its lines
    r = r.select("structure_id", "key_evidence").unionByName(spark.range(1).select(F.lit("none").alias("structure_id"), F.array_repeat(F.lit("own"), 20).alias("key_evidence")))
    return E.attach_evidence(r, _map(spark, sf), limit=14).select("structure_id", F.array_join("key_evidence", "|").alias("key_evidence"))


@plan("case_review_text", f"WITH {FUSION} SELECT structure_id, consistency_summary FROM fusion")
def case_review_text(spark, sf):
    return _fusion(spark, sf).select("structure_id", "consistency_summary")


CONSENSUS = """h AS (SELECT c_custkey AS cluster_id, c_mktsegment AS label_id, round((c_custkey % 100) / 100.0::DOUBLE, 2) AS confidence, c_nationkey AS nk FROM customer),
 m AS (SELECT c_custkey AS cluster_id, c_custkey % 11 = 0 AS failed, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_nationkey < 8 THEN c_mktsegment ELSE 'tumor ' || lower(c_mktsegment) END AS label_id,
    abs(c_acctbal) / 10000 AS confidence FROM customer WHERE c_nationkey <> 3),
 d AS (SELECT h.cluster_id, h.label_id AS hl, h.confidence AS hc, m.label_id AS ml, m.confidence AS mc, coalesce(m.failed, false) AS failed, m.cluster_id IS NOT NULL AND NOT m.failed AND nk % 3 <> 0 AS marker_overlap
   FROM h LEFT JOIN m USING (cluster_id)),
 reasons AS (SELECT *, CASE WHEN failed THEN 'pathology_ai_error' WHEN ml IS NULL THEN 'pathology_ai_unavailable' WHEN mc < 0.6 THEN 'pathology_ai_low_confidence' WHEN ml = hl THEN 'same_label'
   WHEN NOT marker_overlap THEN 'no_marker_overlap' WHEN hc < 0.65 THEN 'heuristic_low_confidence' WHEN mc - hc >= 0.15 THEN 'pathology_ai_confidence_margin'
   ELSE 'heuristic_retained' END AS reason FROM d),
 decided AS (SELECT *, reason IN ('same_label', 'heuristic_low_confidence', 'pathology_ai_confidence_margin') AS accepted FROM reasons)"""


def _consensus(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "cluster_id")
    h = c.select("cluster_id", F.col("c_mktsegment").alias("label_id"), F.round((F.col("cluster_id") % 100) / 100.0, 2).alias("confidence"))
    m = c.filter("c_nationkey <> 3").select(
        "cluster_id", F.when(F.col("c_nationkey") < 8, F.col("c_mktsegment")).otherwise(F.concat(F.lit("tumor "), F.lower("c_mktsegment"))).alias("label_id"),
        (F.abs("c_acctbal") / 10000).alias("confidence"), F.array(F.concat(F.lit(" g"), (F.col("c_nationkey") % 3).cast("string")), F.lit("")).alias("supporting_markers"),
        F.when(F.col("cluster_id") % 11 == 0, "timeout").alias("error"))
    k = c.select("cluster_id", F.array(F.lit("G1"), F.lit("g2"), F.lit(" ")).alias("positive_genes"))
    return E.consensus_annotation(h, m, k)


@plan("consensus_annotation", f"""WITH {CONSENSUS} SELECT cluster_id, CASE WHEN accepted THEN ml ELSE hl END AS label_id,
  CASE WHEN accepted THEN 'pathology_ai_api' ELSE 'heuristic' END AS consensus_source, reason, accepted, marker_overlap FROM decided""")
def consensus_annotation(spark, sf):
    return _consensus(spark, sf).select("cluster_id", "label_id", "consensus_source", "reason", "accepted", "marker_overlap")


@plan("consensus_counts", f"""WITH {CONSENSUS} SELECT reason, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted AND ml IS NOT NULL) AS rejected,
  count(*) FILTER (ml IS NULL) AS fallback, count(*) AS clusters FROM decided GROUP BY 1""")
def consensus_counts(spark, sf):
    return E.consensus_counts(_consensus(spark, sf), ["reason"])


@plan("case_review", f"""WITH {CONSENSUS}, a AS (SELECT cluster_id, CASE WHEN accepted THEN ml ELSE hl END AS label_id, hc FROM decided),
  l AS (SELECT 'high_priority' AS list, cluster_id FROM a WHERE hc < 0.3 UNION ALL SELECT 'discovery_candidate', cluster_id FROM a WHERE label_id LIKE '%tumor%')
  SELECT list, cluster_id, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY cluster_id) AS position FROM l) WHERE position <= 8""")
def case_review(spark, sf):
    a = (_consensus(spark, sf).withColumn("review_priority", F.when(F.col("heuristic_confidence") < 0.3, "High").otherwise("low"))
         .withColumn("malignancy_state", F.lit(None).cast("string")))
    return E.case_review(a)


OVERRIDE = f"""{SUMMARY}, named AS (SELECT DISTINCT user_id % 9 AS sid FROM events),
 o AS (SELECT CAST(sid AS INTEGER) AS structure_id, 'Old ' || sid AS pre_visual_name, summary.n_contours IS NOT NULL AS seen, sid % 2 = 0 AS proposed, 0.5 + sid / 20.0 AS conf,
    coalesce(nullif(top_max_score, 0), nullif(top_mean_score, 0), 0) AS score, top_label FROM named LEFT JOIN summary ON structure_id = sid),
 od AS (SELECT *, seen AND proposed AND CAST(conf AS DOUBLE) >= 0.7 AND score >= 0.35 AS accepted FROM o)"""


def _override(spark, sf):
    ids = table(spark, sf, "events").select((F.col("user_id") % 9).cast("int").alias("structure_id")).distinct()
    text = F.col("structure_id").cast("string")
    none = F.array().cast("array<string>")
    reviews = ids.select("structure_id", F.lit("").alias("title"), F.concat(F.lit("Old "), text).alias("assigned_label"), F.lit(0.4).alias("confidence"),
                         F.array(F.lit("kept")).alias("key_evidence"), none.alias("recommended_checks"))
    naming = ids.select("structure_id", F.concat(F.lit("New "), text).alias("final_name"), (F.col("structure_id") % 2 == 0).alias("visual_override"),
                        (0.5 + F.col("structure_id") / 20.0).alias("confidence"), F.array(F.concat(F.lit("sees "), text)).alias("visual_evidence"),
                        none.alias("molecular_evidence"), F.array(F.lit("look again")).alias("recommended_checks"), F.lit(None).cast("string").alias("error"))
    return E.visual_override(reviews, _summary(spark, sf).filter("structure_id IS NOT NULL"), naming)


@plan("visual_override", f"""WITH {OVERRIDE} SELECT structure_id, pre_visual_name, CASE WHEN seen THEN 'New ' || structure_id ELSE pre_visual_name END AS final_name,
  CASE WHEN accepted THEN 'New ' || structure_id ELSE pre_visual_name END AS assigned_name, seen AND proposed AS visual_override, accepted,
  CASE WHEN accepted THEN CAST(conf AS DOUBLE) ELSE 0.4::DOUBLE END AS review_confidence, top_label AS foundation_top_label,
  CASE WHEN seen THEN round(score, 6) END AS foundation_top_score, CASE WHEN seen THEN 'sees ' || structure_id || '|kept' ELSE 'kept' END AS key_evidence,
  CASE WHEN seen THEN 'look again' ELSE '' END AS recommended_checks, CASE WHEN NOT seen THEN 'no_he_visual_summary' END AS error FROM od""")
def visual_override(spark, sf):
    return (_override(spark, sf).withColumn("foundation_top_score", F.round("foundation_top_score", 6))
            .withColumn("key_evidence", F.array_join("key_evidence", "|")).withColumn("recommended_checks", F.array_join("recommended_checks", "|")))


@plan("override_counts", f"""WITH {OVERRIDE} SELECT count(*) FILTER (accepted) AS accepted, count(*) AS reviewed,
  CASE WHEN count(*) FILTER (accepted) > 0 THEN 'H&E contour foundation model accepted visual overrides for ' || count(*) FILTER (accepted) || ' structure names.'
  ELSE 'H&E contour foundation model reviewed structure names; no visual override met acceptance thresholds.' END AS finding FROM od""")
def override_counts(spark, sf):
    return E.override_counts(_override(spark, sf))
