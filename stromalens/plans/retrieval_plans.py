"""Tree, retrieval and streaming operators bound to the shared tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.lineage import materialize, shared_dir, spread
from ..operators import retrieval as V, spatial as P, tree as Y
from ..streaming import streams
from .bindings import BUNDLES, bundle_columns, bundles, cells, table
from .registry import plan
from .review_plans import correction_columns, corrections
from .spatial_plans import MATRIX


def _matrix(spark, sf):
    return P.symmetric_distance(P.searcher_findee_distance(cells(spark, sf)))


def _merges(spark, sf):
    return Y.average_linkage(_matrix(spark, sf))


@plan("symmetric_distance", f"WITH {MATRIX} SELECT least(a, b) AS a, greatest(a, b) AS b, round(avg(d), 6) AS d FROM matrix WHERE a <> b GROUP BY 1, 2")
def symmetric_distance(spark, sf):
    return _matrix(spark, sf).select("a", "b", F.round("d", 6).alias("d"))


#: Average linkage step by step: for each step, the cluster, height, place and size of every label.
WALK = f"""{MATRIX}, sym AS (SELECT least(a, b) AS a, greatest(a, b) AS b, avg(d) AS d FROM matrix WHERE a <> b GROUP BY 1, 2),
 walk(step, label, c, h, pos, size) AS (
  SELECT 0, a, a, 0::DOUBLE, 0, 1 FROM (SELECT DISTINCT a FROM matrix)
  UNION ALL
  SELECT step + 1, label, CASE WHEN c = hi THEN lo ELSE c END, CASE WHEN c IN (lo, hi) THEN d ELSE h END,
   pos + CASE WHEN c = hi AND first THEN lo_size WHEN c = lo AND NOT first THEN hi_size ELSE 0 END, CASE WHEN c IN (lo, hi) THEN lo_size + hi_size ELSE size END
  FROM walk, (SELECT *, (lo_size > 1, lo_h, lo) <= (hi_size > 1, hi_h, hi) AS first FROM (
   SELECT x.c AS lo, y.c AS hi, avg(sym.d) AS d, any_value(x.size) AS lo_size, any_value(y.size) AS hi_size, any_value(x.h) AS lo_h, any_value(y.h) AS hi_h
   FROM walk x JOIN walk y ON x.c < y.c JOIN sym ON sym.a = least(x.label, y.label) AND sym.b = greatest(x.label, y.label) GROUP BY 1, 2 ORDER BY 3, 1, 2 LIMIT 1)))"""
COPHENETIC = f"""{WALK}, tree AS (SELECT x.label AS a, y.label AS b, min(x.h) AS d FROM walk x JOIN walk y ON x.step = y.step AND x.c = y.c AND x.label < y.label GROUP BY 1, 2)"""
GROUPS = f"""{WALK}, last AS (SELECT max(step) AS top FROM walk), leaf AS (SELECT label, pos AS leaf_pos FROM walk, last WHERE step = top),
 cut AS (SELECT label, leaf_pos, c, h FROM walk JOIN leaf USING (label), last WHERE step = top - 2), lead AS (SELECT c, min(leaf_pos) AS p FROM cut GROUP BY 1),
 groups AS (SELECT label, leaf_pos, dense_rank() OVER (ORDER BY p) AS group_id, h AS height FROM cut JOIN lead USING (c))"""


@plan("structure_groups", f"WITH RECURSIVE {GROUPS} SELECT label, leaf_pos, CAST(group_id AS INTEGER) AS group_id, round(height, 6) AS height FROM groups")
def structure_groups(spark, sf):
    """Tree cut into three groups."""
    d = Y.structure_groups(_merges(spark, sf), 3)
    return d.select("label", "leaf_pos", "group_id", F.round("height", 6).alias("height"))


@plan("leaf_spans", f"""WITH RECURSIVE {GROUPS} SELECT CAST(group_id AS INTEGER) AS group_id, count(*) AS cluster_count, min(leaf_pos) AS leaf_start, max(leaf_pos) AS leaf_end,
  10.0::DOUBLE * min(leaf_pos) AS span_left, 10.0::DOUBLE * max(leaf_pos) + 10 AS span_right, round(avg(5 + 10.0::DOUBLE * leaf_pos), 6) AS x_data, round(max(height), 6) AS y_data,
  string_agg(label, ',' ORDER BY leaf_pos) AS clusters FROM groups GROUP BY 1""")
def leaf_spans(spark, sf):
    d = Y.leaf_spans(Y.structure_groups(_merges(spark, sf), 3)).drop("case_id").withColumn("clusters", F.array_join("clusters", ","))
    return d.withColumn("x_data", F.round("x_data", 6)).withColumn("y_data", F.round("y_data", 6))


@plan("cophenetic_matrix", f"WITH RECURSIVE {COPHENETIC} SELECT a, b, round(d / (SELECT max(d) FROM tree), 6) AS d FROM tree")
def cophenetic_matrix(spark, sf):
    return Y.cophenetic_matrix(_merges(spark, sf), scale_to_one=True).select("a", "b", F.round("d", 6).alias("d"))


@plan("cophenetic_block_stats", f"""WITH RECURSIVE {COPHENETIC}
  SELECT count(*) AS n_pairs, {', '.join(f'round({e}, 6) AS {n}' for n, e in (('min', 'min(d)'), ('p05', 'quantile_cont(d, 0.05)'), ('median', 'quantile_cont(d, 0.5)'), ('mean', 'avg(d)'), ('p95', 'quantile_cont(d, 0.95)'), ('max', 'max(d)')))}
  FROM tree WHERE (a IN ('1-URGENT', '5-LOW')) <> (b IN ('1-URGENT', '5-LOW'))""")
def cophenetic_block_stats(spark, sf):
    d = Y.block_stats(Y.cophenetic_matrix(_merges(spark, sf)), ["1-URGENT", "5-LOW"])
    return d.select("n_pairs", *[F.round(c, 6).alias(c) for c in ("min", "p05", "median", "mean", "p95", "max")])


@plan("renumber_by_leaf_order", """WITH l AS (SELECT n_regionkey AS raw, n_nationkey * 7 % 25 AS leaf_pos FROM nation), f AS (SELECT raw, min(leaf_pos) AS p FROM l GROUP BY 1)
  SELECT leaf_pos, raw, CAST(dense_rank() OVER (ORDER BY p) AS INTEGER) AS group_id FROM l JOIN f USING (raw)""")
def renumber_by_leaf_order(spark, sf):
    d = table(spark, sf, "nation").select(F.lit("case").alias("case_id"), F.col("n_regionkey").alias("raw"), (F.col("n_nationkey") * 7 % 25).alias("leaf_pos"))
    return Y.renumber_by_leaf_order(d, "raw").select("leaf_pos", "raw", "group_id")


def _docs(spark, sf):
    return spread(table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text", "lang", "source"))


_LAST = "CASE WHEN regexp_matches(w, '(?s){0}') THEN length(regexp_extract(w, '(?s)^(.*){0}', 1)) ELSE -1 END"
CHUNKS = f"""docs AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, lang, source, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\\s+|\\s+$', '', 'g') AS t FROM documents),
 walk AS (
  SELECT document_id, t, 0 AS pos, 0 AS stop, 0 AS step FROM docs WHERE t <> ''
  UNION ALL
  SELECT document_id, t, pos2, CASE WHEN pos2 + 1200 < length(t) AND cut > 600 THEN pos2 + cut + 1 ELSE least(length(t), pos2 + 1200) END, step + 1 FROM (
   SELECT *, greatest({_LAST.format(chr(92) + 'n' + chr(92) + 'n')}, {_LAST.format(chr(92) + '. ')}, {_LAST.format(' ')}) AS cut FROM (
    SELECT *, substring(t, pos2 + 1, 1200) AS w FROM (SELECT document_id, t, step, CASE WHEN step = 0 THEN 0 ELSE greatest(pos + 1, stop - 120) END AS pos2, stop FROM walk WHERE step = 0 OR stop < length(t)))) ),
 pieces AS (SELECT document_id, pos, stop, regexp_replace(substring(t, CAST(pos + 1 AS BIGINT), CAST(stop - pos AS BIGINT)), '^\\s+|\\s+$', '', 'g') AS text FROM walk WHERE step > 0),
 chunks AS (SELECT document_id, CAST(pos AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, text,
   'chunk-' || lpad(CAST(row_number() OVER (PARTITION BY document_id ORDER BY pos) AS VARCHAR), 4, '0') AS chunk_id FROM pieces WHERE text <> '')"""


@plan("chunk_text", f"WITH RECURSIVE {CHUNKS} SELECT document_id, chunk_id, document_id || ':' || chunk_id AS point_id, start, stop, md5(text) AS digest FROM chunks")
def chunk_text(spark, sf):
    d = V.chunk_documents(_docs(spark, sf))
    return d.select("document_id", "chunk_id", "point_id", "start", "stop", F.md5("text").alias("digest"))


@plan("document_chunk_counts", f"WITH RECURSIVE {CHUNKS} SELECT document_id, count(*) AS chunk_count FROM chunks GROUP BY 1")
def document_chunk_counts(spark, sf):
    return V.document_chunk_counts(V.chunk_documents(_docs(spark, sf)))


def EMBED(source, key, text):
    """Hashed term counts in long form."""
    return f"""SELECT {key}, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS INTEGER) AS b, count(*) AS n
   FROM (SELECT {key}, unnest(string_split_regex(lower({text}), '\\s+')) AS tok FROM {source}) WHERE tok <> '' GROUP BY 1, 2"""


@plan("embed_terms", f"""WITH e AS ({EMBED('benchmark', 'item_id', 'text')}) SELECT item_id, b AS dim, CAST(n AS DOUBLE) AS value FROM e""")
def embed_terms(spark, sf):
    d = V.embed_terms(table(spark, sf, "benchmark"))
    return d.select("item_id", F.posexplode("vector").alias("dim", "value")).filter("value > 0")


@plan("mean_pool_l2", """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS v FROM e GROUP BY 1, 2),
   n AS (SELECT label, sqrt(sum(v * v)) AS s FROM m GROUP BY 1)
  SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(v / s, 6) AS value FROM m JOIN n USING (label)""")
def mean_pool_l2(spark, sf):
    d = V.mean_pool_l2(table(spark, sf, "embeddings"), ["label"], "embedding", 64)
    return d.select("label", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.round("value", 6))


@plan("cosine", """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0""")
def cosine(spark, sf):
    e = table(spark, sf, "embeddings")
    one = e.filter("vec_id = 0").select("embedding").scalar()
    return e.withColumn("_q", one).select("vec_id", F.round(V.cosine("embedding", "_q"), 6).alias("score"))


@plan("vector_top_k", """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS v FROM e GROUP BY 1, 2),
   q AS (SELECT label, list(v ORDER BY i) AS qv FROM m GROUP BY 1), s AS (SELECT q.label AS query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], qv), 9) AS score FROM embeddings, q),
   r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
  SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def vector_top_k(spark, sf):
    e = table(spark, sf, "embeddings")
    q = V.mean_pool_l2(e, ["label"], "embedding", 64).withColumnRenamed("label", "query_id")
    d = V.vector_top_k(e.withColumnRenamed("embedding", "vector"), q, 10, key="vec_id")
    return d.withColumn("score", F.round("score", 6))


def _index(spark, sf):
    return materialize(V.embed_terms(V.chunk_documents(_docs(spark, sf))))


def _questions(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return V.embed_terms(b, "question")


RETRIEVED = f"""{CHUNKS}, p AS (SELECT document_id || ':' || chunk_id AS point_id, * FROM chunks), ce AS ({EMBED('p', 'point_id', 'text')}), qe AS ({EMBED('benchmark', 'item_id', 'text')}),
 cn AS (SELECT point_id, sqrt(sum(n * n)) AS s FROM ce GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(n * n)) AS s FROM qe GROUP BY 1),
 dot AS (SELECT item_id, point_id, sum(ce.n * qe.n) AS v FROM ce JOIN qe USING (b) GROUP BY 1, 2),
 sc AS (SELECT qn.item_id AS query_id, p.point_id, round(coalesce(v, 0) / qn.s / cn.s, 9) AS score FROM qn CROSS JOIN p JOIN cn USING (point_id) LEFT JOIN dot ON dot.item_id = qn.item_id AND dot.point_id = p.point_id),
 cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM sc QUALIFY rank <= 10),
 rr AS (SELECT query_id, document_id, chunk_id, cand.point_id, score, rank, substring(p.text, 1, 400) AS text_excerpt,
   CAST(len(list_intersect(list_distinct(string_split_regex(lower(b.text), '\\s+')), list_distinct(string_split_regex(lower(p.text), '\\s+')))) AS DOUBLE) AS rerank_score
   FROM cand JOIN p USING (point_id) JOIN benchmark b ON b.item_id = query_id),
 cited AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS INTEGER) AS position FROM rr QUALIFY position <= 5)"""


def _retrieved(spark, sf):
    return V.retrieve(_questions(spark, sf), _index(spark, sf), 5)


@plan("retrieve", f"""WITH RECURSIVE {RETRIEVED} SELECT query_id, 'C' || position AS citation_id, position, document_id, chunk_id, point_id, round(score, 6) AS score, rerank_score, md5(text_excerpt) AS digest FROM cited""")
def retrieve(spark, sf):
    d = _retrieved(spark, sf)
    return d.select("query_id", "citation_id", "position", "document_id", "chunk_id", "point_id", F.round("score", 6).alias("score"), "rerank_score", F.md5("text_excerpt").alias("digest"))


@plan("retrieval_stats", f"""WITH RECURSIVE {RETRIEVED} SELECT item_id AS query_id, (SELECT count(*) FROM cand c WHERE c.query_id = item_id) AS candidate_count, (SELECT count(*) FROM cited c WHERE c.query_id = item_id) AS returned_count,
  false AS document_filter_applied, NULL::VARCHAR AS error FROM benchmark""")
def retrieval_stats(spark, sf):
    q, ix = _questions(spark, sf), _index(spark, sf)
    return V.retrieval_stats(q, V.vector_top_k(ix, q, 10), V.retrieve(q, ix, 5), False)


@plan("resolve_citations", f"""WITH RECURSIVE {RETRIEVED} SELECT query_id, a.pos AS answer_pos, a.c AS citation_id, point_id FROM cited JOIN (VALUES (0, 'C3'), (2, 'C1')) a(pos, c) ON a.c = 'C' || position""")
def resolve_citations(spark, sf):
    r = _retrieved(spark, sf)
    answers = r.select("query_id").distinct().withColumn("citation_ids", F.array(F.lit("C3"), F.lit("C9"), F.lit("C1")))
    return V.resolve_citations(answers, r).select("query_id", "answer_pos", "citation_id", "point_id")


@plan("rerank", """WITH s AS (SELECT b.item_id AS query_id, d.doc_id, CAST(len(list_intersect(list_distinct(string_split_regex(lower(b.text), '\\s+')), list_distinct(string_split_regex(lower(d.text), '\\s+')))) AS DOUBLE) AS rerank_score
    FROM benchmark b JOIN documents d ON d.source = 'src' || (b.item_id % 7))
  SELECT query_id, doc_id, rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) AS INTEGER) AS position FROM s QUALIFY position <= 3""")
def rerank(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.concat(F.lit("src"), (F.col("item_id") % 7).cast("string")).alias("source"))
    c = b.join(table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("rank"), "text", "source"), "source")
    return V.rerank(c, 3).select("query_id", "doc_id", "rerank_score", "position")


@plan("upsert_chunks", """SELECT CAST(doc_id AS VARCHAR) AS point_id, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS version,
  CASE WHEN lang = 'en' THEN 'new en' WHEN lang = 'fr' THEN 'again fr' ELSE lang END AS text FROM documents""")
def upsert_chunks(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("point_id"), F.lit(1).alias("version"), F.col("lang").alias("text"))
    newer = d.filter("text = 'en'").withColumn("version", F.lit(2)).withColumn("text", F.concat(F.lit("new "), "text"))
    # of equal versions the incoming row wins
    same = d.filter("text = 'fr'").withColumn("text", F.concat(F.lit("again "), "text"))
    return V.upsert(V.upsert(newer, d), same)


@plan("qc_windows", f"""WITH {BUNDLES} SELECT CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS day, source, count(*) AS total_bundles, count(*) FILTER (qc_status = 'ok') AS passed,
  count(*) FILTER (qc_status = 'warning') AS warned, count(*) FILTER (qc_status = 'fail') AS failed FROM bundles GROUP BY 1, 2""")
def qc_windows(spark, sf):
    d = streams.qc_windows(bundles(spark, sf))
    return d.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "source", "total_bundles", "passed", "warned", "failed")


def _scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Micro-batches that the events arrive in, and by how many days every eleventh of them is late.
ARRIVAL_BATCHES, DAYS_LATE = 8, 12
#: arrivals: events with the number of the file they come in, out of order by event time.
ARRIVALS = f"""seen AS (SELECT *, epoch_ms(ts) + CASE WHEN event_id % 11 = 0 THEN {DAYS_LATE} * 86400000 ELSE 0 END AS came FROM events),
 reach AS (SELECT min(came) AS low, max(came) AS high FROM seen),
 arrivals AS (SELECT seen.* EXCLUDE (came), CAST({ARRIVAL_BATCHES} * (came - low) // (high - low + 1) AS INTEGER) AS batch FROM seen, reach)"""


def _arrivals(spark, sf):
    e = table(spark, sf, "events")
    came = e.withColumn("came", F.unix_millis(F.col("ts").cast("timestamp")) + F.when(F.col("event_id") % 11 == 0, DAYS_LATE * 86400000).otherwise(0))
    reach = came.agg(F.struct(F.min("came").alias("low"), F.max("came").alias("high"))).scalar()
    return came.withColumn("batch", F.floor(ARRIVAL_BATCHES * (F.col("came") - reach["low"]) / (reach["high"] - reach["low"] + 1)).cast("int")).drop("came")


def _event_stream(spark, sf):
    """Events as a stream of files, one per micro-batch in the order of arrival."""
    rows, folder = materialize(_arrivals(spark, sf)), _scratch(spark, "arrivals")
    for i in range(ARRIVAL_BATCHES):
        rows.where(F.col("batch") == i).drop("batch").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(table(spark, sf, "events").schema).option("maxFilesPerTrigger", 1).parquet(folder)


#: The watermark that drops rows of a batch: an hour behind the latest event time two batches ago and before.
CLOSED = f"""{ARRIVALS}, days AS (SELECT date_trunc('day', ts) AS day, event_type AS source, value, batch, ts FROM arrivals),
 tops AS (SELECT b.i AS batch, max(ts) FILTER (arrivals.batch <= b.i - 2) - INTERVAL 1 HOUR AS mark FROM arrivals, range({ARRIVAL_BATCHES + 2}) b(i) GROUP BY 1),
 kept AS (SELECT days.*, mark IS NOT NULL AND day + INTERVAL 1 DAY <= mark AS late FROM days JOIN tops USING (batch)),
 final AS (SELECT max(mark) AS mark FROM tops)"""


@plan("stream_qc_windows", f"""WITH {CLOSED} SELECT day::DATE::VARCHAR AS day, source, count(*) AS total_bundles, count(*) FILTER (value >= 80 AND value < 200) AS failed
  FROM kept, final WHERE NOT late AND day + INTERVAL 1 DAY <= final.mark GROUP BY 1, 2""")
def stream_qc_windows(spark, sf):
    """Windows closed by the watermark over eight micro-batches out of order; what comes after is dropped."""
    d = spark.read.parquet(_closed_windows(spark, sf))
    return d.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "source", "total_bundles", "failed")


def _closed_windows(spark, sf):
    out = _scratch(spark, "qc")
    with streams.rocksdb_state(spark):
        query = streams.append_to(streams.qc_windows(bundle_columns(_event_stream(spark, sf))), f"{out}/table", f"{out}/state")
    query.awaitTermination()
    return f"{out}/table"


@plan("stream_late_rows", f"""WITH {CLOSED} SELECT day::DATE::VARCHAR AS day, source, count(*) FILTER (late) AS late_rows FROM kept, final WHERE day + INTERVAL 1 DAY <= final.mark GROUP BY 1, 2""")
def stream_late_rows(spark, sf):
    """How many rows came too late for each closed window."""
    closed = spark.read.parquet(_closed_windows(spark, sf))
    d = streams.late_rows(bundle_columns(_arrivals(spark, sf).drop("batch")), closed)
    return d.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "source", "late_rows")


@plan("stream_finetuning_trigger", f"""WITH {ARRIVALS}, flags AS (SELECT CAST(user_id AS VARCHAR) AS case_id, CAST(event_id AS VARCHAR) AS correction_id, ts,
   row_number() OVER (PARTITION BY user_id ORDER BY batch, ts, CAST(event_id AS VARCHAR)) AS n FROM arrivals WHERE event_type = 'signup')
  SELECT case_id, correction_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS fired_at, CAST(14 AS BIGINT) AS threshold FROM flags WHERE n = 14""")
def stream_finetuning_trigger(spark, sf):
    """One row per case, at the flag that reaches the threshold, over eight micro-batches."""
    out = _scratch(spark, "flags")
    with streams.rocksdb_state(spark):
        query = streams.log_batches(streams.fire_once(correction_columns(_event_stream(spark, sf)), 14), f"{out}/log", f"{out}/state")
    query.awaitTermination()
    d = spark.read.parquet(f"{out}/log")
    return d.select("case_id", "correction_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("fired_at"), "threshold")


@plan("stream_upsert", f"""WITH {ARRIVALS} SELECT CAST(user_id AS VARCHAR) AS point_id, max(event_id % 97) AS version,
   arg_max(event_type, (event_id % 97, batch, event_type)) AS text FROM arrivals GROUP BY 1""")
def stream_upsert(spark, sf):
    """The last version of each point, merged bucket by bucket over eight micro-batches."""
    out = _scratch(spark, "points")
    rows = _event_stream(spark, sf).select(F.col("user_id").cast("string").alias("point_id"), (F.col("event_id") % 97).alias("version"), F.col("event_type").alias("text"))
    streams.merge_upserts(rows, f"{out}/table", f"{out}/state", buckets=16).awaitTermination()
    return streams.merged_points(spark, f"{out}/table")
