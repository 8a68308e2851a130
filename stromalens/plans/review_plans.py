"""Critic, claims and ledgers bound to the shared tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lineage import shared_dir
from ..operators import align, evidence as E, review as R
from ..sources import files
from .bindings import BUNDLES, bundles, table
from .registry import plan

_RANK = "CASE qc_status WHEN 'ok' THEN 0 WHEN 'warning' THEN 1 WHEN 'fail' THEN 2 ELSE 3 END"


@plan("critic_report", f"""WITH {BUNDLES} SELECT case_id, count(*) AS total_bundles, count(*) FILTER (qc_status = 'ok') AS passed,
  count(*) FILTER (qc_status = 'warning') AS warned, count(*) FILTER (qc_status = 'fail') AS failed, count(*) FILTER ({_RANK} > 1) AS flagged,
  count(*) FILTER (conflict_note <> '') AS conflicts, ['ok', 'warning', 'fail', 'unknown'][max({_RANK}) + 1] AS overall_status FROM bundles GROUP BY 1""")
def critic_report(spark, sf):
    return R.critic_counts(bundles(spark, sf), by=["case_id"])


@plan("flagged_bundles", f"WITH {BUNDLES} SELECT evidence_id, qc_status FROM bundles WHERE {_RANK} > 1")
def flagged_bundles(spark, sf):
    return R.flagged_bundles(bundles(spark, sf)).select("evidence_id", "qc_status")


@plan("conflicts", f"WITH {BUNDLES} SELECT evidence_id, conflict_note AS note, unit_id, 'block' AS conflict_action FROM bundles WHERE conflict_note <> ''")
def conflicts(spark, sf):
    resolved = R.resolve_conflicts(bundles(spark, sf), "block").select("evidence_id", "conflict_action")
    return R.conflicts(bundles(spark, sf)).join(resolved, "evidence_id")


@plan("coverage_gaps", """WITH expected AS (SELECT DISTINCT u.user_id, e.event_type AS source FROM events u, (SELECT DISTINCT event_type FROM events) e)
  SELECT CAST(user_id AS VARCHAR) AS unit_id, source FROM expected WHERE (user_id, source) NOT IN (SELECT user_id, event_type FROM events WHERE value > 20)
  UNION ALL SELECT 'case', 'morphomolecular'""")
def coverage_gaps(spark, sf):
    b = bundles(spark, sf)
    channels = F.array(*[F.lit(c) for c in ("view", "purchase", "click", "error", "signup")])
    expected = b.select("unit_id").distinct().select("unit_id", F.explode(channels).alias("source"))
    expected = expected.unionByName(spark.createDataFrame([("case", "morphomolecular")], "unit_id string, source string"))
    return align.coverage_gaps(expected, b.filter("value > 20"), ["unit_id", "source"])


@plan("evidence_split", f"""WITH {BUNDLES} SELECT case_id, count(*) FILTER ({_RANK} <= 1) AS approved_count, count(*) FILTER ({_RANK} > 1) AS pending_count
  FROM bundles GROUP BY 1""")
def evidence_split(spark, sf):
    b = bundles(spark, sf)
    ok, wait = R.evidence_split(b, R.flagged_bundles(b))
    both = ok.select("case_id", F.lit(True).alias("ok")).unionByName(wait.select("case_id", F.lit(False).alias("ok")))
    return both.groupBy("case_id").agg(F.count_if("ok").alias("approved_count"), F.count_if(~F.col("ok")).alias("pending_count"))


def corrections(spark, sf):
    """Corrections: one record per event."""
    return correction_columns(table(spark, sf, "events"))


def correction_columns(e):
    kind = F.when(F.col("event_type") == "signup", "flag_for_finetuning").when(F.col("event_type") == "error", "reject").otherwise("label_override")
    return e.select(F.col("event_id").cast("string").alias("correction_id"), F.col("user_id").cast("string").alias("case_id"),
                                             kind.alias("correction_type"), "ts")


@plan("finetuning_trigger", """SELECT CAST(user_id AS VARCHAR) AS case_id, count(*) FILTER (event_type = 'signup') AS flagged,
  count(*) FILTER (event_type = 'signup') >= 14 AS triggered FROM events GROUP BY 1""")
def finetuning_trigger(spark, sf):
    return R.finetuning_trigger(corrections(spark, sf), 14, ["case_id"])


@plan("qc_verdict", """WITH q AS (SELECT event_id, event_type, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events),
  c AS (SELECT *, CASE event_type WHEN 'view' THEN k / 100 WHEN 'purchase' THEN CASE WHEN k > 0 THEN value / k END END AS cov FROM q)
  SELECT event_id, CASE event_type WHEN 'error' THEN CASE WHEN k < 30 THEN 'QC report is not a JSON object.' ELSE 'QC report is not valid JSON.' END WHEN 'click' THEN CASE WHEN k < 50 THEN 'bad registration|low depth' ELSE 'QC status is fail.' END
    ELSE '' END AS fatal_errors, round(cov, 9) AS cell_coverage,
   CAST((CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) + (CASE WHEN cov < 0.4 THEN 1 ELSE 0 END) AS INTEGER) AS n_warnings,
   CASE WHEN event_type IN ('error', 'click') THEN 'fail' WHEN event_type = 'signup' OR cov < 0.4 THEN 'warning' ELSE 'ok' END AS qc_status FROM c""")
def qc_verdict(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    t = F.col("event_type")
    doc = (F.when((t == "error") & (F.col("k") < 15), "[1, 2]").when((t == "error") & (F.col("k") < 30), "3").when(t == "error", "{oops").when((t == "click") & (F.col("k") < 50), '{"errors": ["bad registration", " ", "low depth"], "status": "fail"}')
           .when(t == "click", '{"status": "fail"}').when(t == "signup", '{"warnings": ["check", ""]}')
           .when(t == "view", F.to_json(F.struct((F.col("k") / 100).alias("cell_coverage"))))
           .otherwise(F.to_json(F.struct(F.col("k").alias("n_cells_total"), F.col("value").alias("n_cells_with_image")))))
    d = R.qc_verdict(e.withColumn("report", doc), "report", min_coverage=0.4)
    return d.select("event_id", F.array_join("fatal_errors", "|").alias("fatal_errors"), F.round("cell_coverage", 9).alias("cell_coverage"),
                    F.size("warnings").alias("n_warnings"), "qc_status")


@plan("summary_rows", """SELECT 'stgpt.structure.' || user_id % 9 AS evidence_id, 'stgpt_structure_embedding' AS evidence_type,
  CAST(user_id % 9 AS VARCHAR) AS structure_label, CAST(count(*) AS VARCHAR) AS n_cells, 'warning' AS qc_status, true AS model_derived,
  false AS measured_expression, 'a.csv;b.json' AS artifact_ids FROM events GROUP BY user_id % 9""")
def summary_rows(spark, sf):
    s = table(spark, sf, "events").groupBy((F.col("user_id") % 9).alias("structure_id")).agg(F.count("*").alias("n_cells")).withColumn("structure_label", F.lit(""))
    qc = R.qc_verdict(table(spark, sf, "events").agg(F.lit('{"warnings": ["w"]}').alias("report"), F.count("*").alias("n")), "report")
    d = R.summary_rows(s, qc, "case", ["a.csv", "b.json"])
    return d.select("evidence_id", "evidence_type", "structure_label", "n_cells", "qc_status", "model_derived", "measured_expression",
                    F.array_join("artifact_ids", ";").alias("artifact_ids"))


CLAIMS = """cases AS (SELECT CAST(user_id AS VARCHAR) AS case_id, max(value) > 150 AS has_fatal, min(value) < 0.5 AS has_warnings FROM events GROUP BY 1 UNION ALL SELECT 'case-none', false, true),
 recs AS (SELECT CAST(user_id AS VARCHAR) AS case_id, event_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
 hashes AS (SELECT case_id, arg_min('h' || event_id, event_id) AS h FROM recs WHERE event_type = 'view' GROUP BY 1),
 claims AS (SELECT case_id, 'claim.' || CASE WHEN event_type = 'click' THEN 'stgpt.region.' || event_id ELSE 'ev.' || event_id END AS claim_id,
    CASE WHEN event_type = 'click' THEN 'stgpt.region.' || event_id ELSE 'ev.' || event_id END AS evidence_ids,
    CASE WHEN has_warnings THEN 'warning' ELSE 'ok' END AS qc_status, CASE WHEN k < 50 THEN 'a/m.csv;b/' || event_type || '.json' ELSE 'b/' || event_type || '.json' END AS artifact_paths,
    coalesce(h, '') AS checkpoint_hash, has_warnings AS cautionary,
    'Region-level stGPT evidence for ' || case_id || ' maps to prototype ' || k || '. This is model-derived morpho-molecular evidence, not measured expression.' AS claim_text
   FROM cases JOIN recs USING (case_id) LEFT JOIN hashes USING (case_id) WHERE NOT has_fatal AND r <= 20
  UNION ALL SELECT case_id, 'claim.blocked.' || case_id, '', 'fail', '', coalesce(h, ''), true, 'Biological conclusions are blocked because fatal QC errors are present.'
   FROM cases LEFT JOIN hashes USING (case_id) WHERE has_fatal
  UNION ALL SELECT case_id, 'claim.no_records.' || case_id, '', CASE WHEN has_warnings THEN 'warning' ELSE 'ok' END, '', '', true,
    'No sampled stGPT evidence-chain records were available for biological interpretation.' FROM cases WHERE NOT has_fatal AND case_id NOT IN (SELECT case_id FROM recs))"""


def _cases(spark, sf):
    return (table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("case_id"))
            .agg((F.max("value") > 150).alias("has_fatal"), (F.min("value") < 0.5).alias("has_warnings"))
            .unionByName(spark.createDataFrame([("case-none", False, True)], "case_id string, has_fatal boolean, has_warnings boolean"))
            .withColumn("qc_status", F.when(F.col("has_warnings"), "warning").otherwise("ok")))


def _records(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = "map<string,struct<artifact:string,prototype_id:string>>"

    def item(path):
        return F.create_map(F.lit("ref"), F.struct(path.alias("artifact"), k.cast("string").alias("prototype_id"))).cast(kind)
    e = e.withColumn("measured", F.when(k < 50, item(F.lit("a/m.csv")))).withColumn("derived", item(F.concat(F.lit("b/"), "event_type", F.lit(".json"))))
    return e.select(F.col("user_id").cast("string").alias("case_id"), F.col("event_id").alias("record_no"),
                    F.when(F.col("event_type") != "click", F.concat(F.lit("ev."), F.col("event_id").cast("string"))).alias("evidence_id"),
                    F.col("derived")["ref"]["prototype_id"].alias("prototype_id"), R.artifact_paths("measured", "derived").alias("artifact_paths"),
                    F.when(F.col("event_type") == "view", F.concat(F.lit("h"), F.col("event_id").cast("string"))).alias("checkpoint_hash"))


def _claims(spark, sf):
    return R.build_claims(_cases(spark, sf), _records(spark, sf))


@plan("build_claims", f"WITH {CLAIMS} SELECT claim_id, evidence_ids, qc_status, checkpoint_hash, cautionary, claim_text FROM claims")
def build_claims(spark, sf):
    return R.claim_table(_claims(spark, sf)).select("claim_id", "evidence_ids", "qc_status", "checkpoint_hash", "cautionary", "claim_text")


@plan("claim_table", f"WITH {CLAIMS} SELECT case_id, claim_id, evidence_ids, artifact_paths FROM claims")
def claim_table(spark, sf):
    return R.claim_table(_claims(spark, sf)).select("case_id", "claim_id", "evidence_ids", "artifact_paths")


@plan("review_checklist", f"""WITH {CLAIMS} SELECT case_id, 'QC fatal review' AS item, 'pending' AS state, '' AS evidence_ids, 'Resolve fatal QC before accepting biological conclusions.' AS required_action
  FROM cases WHERE has_fatal UNION ALL SELECT case_id, claim_id, 'pending', evidence_ids, 'Pathologist review required before clinical or biological assertion.' FROM claims WHERE qc_status <> 'fail'""")
def review_checklist(spark, sf):
    return R.review_checklist(_claims(spark, sf), _cases(spark, sf))


@plan("claims_to_artifacts", f"""WITH {CLAIMS}, paths AS (SELECT claim_id AS evidence_id, unnest(string_split(artifact_paths, ';')) AS artifact FROM claims WHERE artifact_paths <> '')
  SELECT evidence_id, artifact, CASE WHEN artifact LIKE 'b/%' AND artifact <> 'b/error.json' THEN 'foundation.' || replace(substr(artifact, 3), '.json', '')
   ELSE 'artifact.' || substr(artifact, 3) END AS artifact_id FROM paths""")
def claims_to_artifacts(spark, sf):
    known = (table(spark, sf, "events").filter("event_type <> 'error'").select("event_type").distinct()
             .select(F.concat(F.lit("b/"), "event_type", F.lit(".json")).alias("path"), F.concat(F.lit("foundation."), "event_type").alias("id")))
    claims = _claims(spark, sf).select(F.col("claim_id").alias("evidence_id"), "artifact_paths")
    return align.claims_to_artifacts(claims, known)


def _artifacts(spark, sf):
    e = table(spark, sf, "events")
    art = e.groupBy(F.concat(F.lit("a."), F.col("user_id").cast("string")).alias("id")).agg((F.max("value") > 100).alias("exists"))
    required = e.filter("value > 120 OR value < 0.2").select(F.concat(F.lit("a."), F.when(F.col("value") > 250, F.lit("never")).otherwise(F.col("user_id").cast("string"))).alias("id")).distinct()
    return art, required


ARTIFACTS = """art AS (SELECT 'a.' || user_id AS id, max(value) > 100 AS ex FROM events GROUP BY 1),
 req AS (SELECT DISTINCT 'a.' || CASE WHEN value > 250 THEN 'never' ELSE CAST(user_id AS VARCHAR) END AS id FROM events WHERE value > 120 OR value < 0.2)"""


@plan("missing_required", f"WITH {ARTIFACTS} SELECT id FROM req WHERE id NOT IN (SELECT id FROM art WHERE ex)")
def missing_required(spark, sf):
    art, required = _artifacts(spark, sf)
    return align.missing_required(required, art)


@plan("manifest_counts", f"""WITH {ARTIFACTS} SELECT (SELECT count(*) FROM art) AS total, (SELECT count(*) FROM art WHERE ex) AS existing,
  (SELECT count(*) FROM req WHERE id NOT IN (SELECT id FROM art WHERE ex)) AS missing_required""")
def manifest_counts(spark, sf):
    return R.manifest_counts(*_artifacts(spark, sf))


@plan("pending_work", """SELECT CAST(event_id AS VARCHAR) AS unit_id, sha256('{"props": "' || replace(props, '"', '\\"') || '"}') AS input_hash FROM events
  WHERE NOT (event_type IN ('view', 'click') AND value < 100)""")
def pending_work(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("unit_id"), S.input_hash(F.create_map(F.lit("props"), F.col("props"))).alias("input_hash"),
                                          "event_type", "value", F.concat(F.lit("out/"), F.col("event_id").cast("string")).alias("path"))
    ledger = e.filter("event_type IN ('view', 'click', 'error')").select(
        "unit_id", F.when(F.col("event_type") == "error", "old").otherwise(F.col("input_hash")).alias("input_hash"), F.col("path").alias("output_artifact"))
    return R.pending_work(e.select("unit_id", "input_hash"), ledger, e.filter("value < 100").select("path"))


@plan("natural_label_sort", """WITH l AS (SELECT DISTINCT CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE o_orderpriority END AS label FROM orders)
  SELECT label, row_number() OVER (ORDER BY TRY_CAST(label AS INTEGER) IS NULL, TRY_CAST(label AS INTEGER), label) AS position FROM l""")
def natural_label_sort(spark, sf):
    from ..operators.ranking import dense_row_number
    o = table(spark, sf, "orders")
    label = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise(F.col("o_orderpriority"))
    d = o.select(label.alias("label")).distinct()
    return dense_row_number(E.natural_label_keys(d, "label"), ["_text", "_number", "label"], "position").select("label", "position")


@plan("id_sort", "SELECT id, row_number() OVER (ORDER BY length(id), id) AS position FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders)")
def id_sort(spark, sf):
    from ..operators.ranking import dense_row_number
    d = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("id")).distinct().withColumn("_len", F.length("id"))
    return dense_row_number(d, ["_len", "id"], "position").select("id", "position")


@plan("nulls_last_sort", """SELECT CAST(CASE WHEN user_id % 11 <> 0 THEN user_id % 7 END AS BIGINT) AS structure_id, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 NULLS LAST""")
def nulls_last_sort(spark, sf):
    d = table(spark, sf, "events").groupBy(F.when(F.col("user_id") % 11 != 0, F.col("user_id") % 7).alias("structure_id")).agg(F.count("*").alias("n"))
    return d.orderBy(F.asc_nulls_last("structure_id"))


@plan("bounded_lists", """SELECT user_id, array_to_string(list_slice(list(event_id ORDER BY event_id), 1, 6), ',') AS first_ids,
  substr(repeat('x', CAST(least(count(*), 1000) AS BIGINT)), 1, 400) AS excerpt FROM events GROUP BY 1""")
def bounded_lists(spark, sf):
    from ..operators.ranking import top_per_group
    e = table(spark, sf, "events")
    first = top_per_group(e.select("user_id", "event_id"), ["user_id"], [F.asc("event_id")], 6)
    first = first.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("first_ids"))
    n = e.groupBy("user_id").agg(F.least(F.count("*"), F.lit(1000)).cast("int").alias("n"))
    return first.join(n, "user_id").select("user_id", "first_ids", F.substring(F.expr("repeat('x', n)"), 1, 400).alias("excerpt"))


@plan("marker_overlap", """SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN upper(c_mktsegment) ELSE '' END AS shared FROM customer""")
def marker_overlap(spark, sf):
    a = F.array(F.upper("c_mktsegment"), F.lit("X"))
    b = F.array(F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).otherwise("none"), F.lit("Y"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(F.array_intersect(a, b), ",").alias("shared"))


@plan("unselected_clusters", "SELECT DISTINCT o_orderpriority AS cluster FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def unselected_clusters(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("cluster")).distinct()
    chosen = spark.createDataFrame([("1-URGENT",), ("5-LOW",)], "cluster string")
    return o.join(chosen, "cluster", "left_anti")


@plan("id_union", """SELECT user_id % 7 AS structure_id FROM events UNION SELECT c_nationkey FROM customer UNION SELECT n_regionkey FROM nation
  UNION SELECT s_nationkey FROM supplier""")
def id_union(spark, sf):
    parts = [table(spark, sf, "events").select((F.col("user_id") % 7).alias("structure_id"))]
    for t, c in (("customer", "c_nationkey"), ("nation", "n_regionkey"), ("supplier", "s_nationkey")):
        parts.append(table(spark, sf, t).select(F.col(c).cast("bigint").alias("structure_id")))
    out = parts[0].distinct()
    for p in parts[1:]:
        out = out.union(p.distinct())
    return out.distinct()


@plan("file_inventory", """WITH f AS (SELECT string_agg(c_custkey || ' ' || c_mktsegment || chr(10), '' ORDER BY c_custkey) AS body FROM customer GROUP BY c_nationkey)
  SELECT CAST(strlen(body) AS BIGINT) AS size_bytes, sha256(body) AS sha256, 'text/plain' AS media_type FROM f""")
def file_inventory(spark, sf):
    """A text file per nation, with the customers in it, listed with size, hash and type."""
    path = f"{shared_dir(spark)}/inventory-{uuid.uuid4().hex}"
    c = table(spark, sf, "customer").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    c.select(F.concat_ws(" ", F.col("c_custkey").cast("string"), "c_mktsegment").alias("value"), "c_nationkey").write.partitionBy("c_nationkey").text(path)
    return files.file_inventory(spark, path, glob="*.txt").select("size_bytes", "sha256", "media_type")


@plan("distinct_paths", """SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS path FROM pages""")
def distinct_paths(spark, sf):
    return table(spark, sf, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("path"), "page_id").dropDuplicates(["path"]).select("path")
