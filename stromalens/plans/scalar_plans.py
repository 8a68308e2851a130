"""Scalar functions bound to the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import contracts, specs
from ..sources import files
from .bindings import (BUNDLES, CELLS, GROUPS_TEXT, VISUAL_LABEL, bundles, cells, table, visual_label)
from .registry import plan


@plan("read_cells", "SELECT o_orderkey AS cell_id, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y FROM orders")
def read_cells(spark, sf):
    return files.read_cells(spark, f"{sf}/orders.parquet", id_names=["cell_id", "O-OrderKey"],
                            x_names=["x_centroid", " o_totalprice "], y_names=["y_centroid", "O_CustKey"])


@plan("read_expression_coo", """SELECT coalesce(p_name, CAST(l_partkey AS VARCHAR), 'feature_' || l_suppkey) AS gene,
  l_orderkey AS barcode, l_quantity AS n FROM lineitem LEFT JOIN part
  ON p_partkey = l_partkey AND p_size > 10""")
def read_expression_coo(spark, sf):
    features = (table(spark, sf, "part").filter("p_size > 10")
                .select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    counts = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("row"),
                                                 F.col("l_orderkey").alias("barcode"), F.col("l_quantity").alias("n"))
    return files.name_features(counts.join(features, "id", "left")).select("gene", "barcode", "n")


@plan("read_evidence_lines", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
  WHERE event_type <> 'error'""")
def read_evidence_lines(spark, sf):
    e = table(spark, sf, "events")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("!"), F.col("props"))).otherwise(F.col("props"))
    return (files.json_objects(e.withColumn("line", line), "line", "k bigint")
            .select("event_id", F.col("record.k").alias("k")))


@plan("read_embeddings", """SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dims,
  round(list_aggregate(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), 'sum'), 6) AS total FROM embeddings""")
def read_embeddings(spark, sf):
    d = files.read_embeddings(spark, f"{sf}/embeddings.parquet", "embedding")
    total = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v)
    return d.select("vec_id", "label", F.size("vector").alias("dims"), F.round(total, 6).alias("total"))


@plan("batch_rows", """SELECT (rn - 1) // 32 AS batch_id, count(*) AS n_rows, min(doc_id) AS first_id, max(doc_id) AS last_id
  FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY 1""")
def batch_rows(spark, sf):
    d = files.batch_rows(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 32)
    return d.groupBy("batch_id").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first_id"),
                                     F.max("doc_id").alias("last_id"))


def _dirty():
    """Readable, blank, broken, infinite and exponent forms of one number."""
    v, t = F.col("value").cast("string"), F.col("event_type")
    return (F.when(t == "view", F.concat(F.lit("  "), v, F.lit(" "))).when(t == "error", F.concat(F.lit("x"), v))
            .when(t == "click", F.when(F.col("value") > 100, "inf").otherwise("")).when(t == "signup", "nan")
            .otherwise(F.concat(F.lit("-"), F.floor("value").cast("string"), F.lit("e1"))))


_DIRTY = """CASE WHEN event_type = 'purchase' THEN CAST(-floor(value) * 10 AS DOUBLE) WHEN event_type = 'view' THEN value END"""


@plan("safe_scalars", f"""SELECT event_id, coalesce({_DIRTY}, 0.5) AS as_double,
  CAST(trunc(coalesce({_DIRTY}, 7)) AS BIGINT) AS as_long FROM events""")
def safe_scalars(spark, sf):
    d = table(spark, sf, "events")
    # minus zero has no counterpart in integer text
    return d.select("event_id", (S.safe_double(_dirty(), 0.5) + 0.0).alias("as_double"),
                    S.safe_long(_dirty(), 7).alias("as_long"))


@plan("canonical_id", """SELECT event_id, CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR)
  WHEN event_type = 'click' THEN NULL WHEN event_type = 'error' THEN 'cluster ' || user_id
  WHEN event_type = 'signup' THEN 'nan' ELSE CAST(event_id AS VARCHAR) END AS id FROM events""")
def canonical_id(spark, sf):
    u, t = F.col("user_id").cast("string"), F.col("event_type")
    raw = (F.when(t == "view", F.concat(F.lit("\t "), u, F.lit(".0 \n"))).when(t == "click", " \r\n ")
           .when(t == "error", F.concat(F.lit("cluster "), u, F.lit("\n"))).when(t == "signup", "nan")
           .otherwise(F.col("event_id").cast("string")))
    return table(spark, sf, "events").select("event_id", S.canonical_id(raw).alias("id"))


@plan("json_cell", """SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN -1
  ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def json_cell(spark, sf):
    t = F.col("event_type")
    raw = (F.when(t == "error", F.expr("substring(props, 1, length(props) - 1)")).when(t == "signup", "  ")
           .otherwise(F.col("props")))
    parsed = S.json_cell(raw, "k bigint", F.struct(F.lit(-1).cast("bigint").alias("k")))
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"))


@plan("barcode_stem", "SELECT c_custkey, c_name AS stem, split_part(c_mktsegment, '-', 1) AS plain FROM customer")
def barcode_stem(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", S.barcode_stem(F.concat("c_name", F.lit("-1"))).alias("stem"),
        S.barcode_stem("c_mktsegment").alias("plain"))


@plan("normalize_cluster_label", f"WITH {CELLS} SELECT cluster, count(*) AS n FROM cells WHERE x <= 450 GROUP BY 1")
def normalize_cluster_label(spark, sf):
    raw = F.when(F.col("x") > 450, "  ").otherwise(F.concat(F.lit(" "), F.col("cluster")))
    d = cells(spark, sf).withColumn("cluster", S.normalize_cluster_label(raw))
    return d.filter("cluster <> ''").groupBy("cluster").agg(F.count("*").alias("n"))


@plan("parse_cluster_groups", """WITH lines AS (SELECT c_custkey, unnest([c_mktsegment || ': ' || c_nationkey || ', ,' || c_custkey,
    ' ' || c_nationkey]) AS line, unnest([1, 2]) AS group_no FROM customer)
  SELECT c_custkey, CAST(group_no AS INTEGER) AS group_no, CAST(i AS INTEGER) AS item_no, label FROM (
    SELECT c_custkey, group_no, CASE WHEN group_no = 1 THEN [CAST(c_nationkey AS VARCHAR), CAST(c_custkey AS VARCHAR)]
      ELSE [CAST(c_nationkey AS VARCHAR)] END AS items FROM lines JOIN customer USING (c_custkey)),
   LATERAL (SELECT unnest(items) AS label, generate_subscripts(items, 1) AS i)""")
def parse_cluster_groups(spark, sf):
    text = F.concat("c_mktsegment", F.lit(": "), F.col("c_nationkey").cast("string"), F.lit(", ,"),
                    F.col("c_custkey").cast("string"), F.lit("\n\n ; "), F.col("c_nationkey").cast("string"), F.lit(","))
    d = table(spark, sf, "customer").select("c_custkey", text.alias("text"))
    return specs.parse_cluster_groups(d, "text", keep=["c_custkey"])


@plan("structure_spec", f"""WITH {CELLS}, spec(structure_id, structure_name, structure_color, cluster) AS (VALUES
  (1, 'Structure 1', '#6EF0D4', '1-URGENT'), (1, 'Structure 1', '#6EF0D4', '2-HIGH'),
  (2, 'Structure 2', '#78B9FF', '3-MEDIUM'),
  (3, 'Structure 3', '#FFB870', '4-NOT SPECIFIED'), (3, 'Structure 3', '#FFB870', '5-LOW'))
  SELECT CAST(structure_id AS INTEGER) AS structure_id, structure_name, structure_color, cluster, count(*) AS n
  FROM spec JOIN cells USING (cluster) GROUP BY ALL""")
def structure_spec(spark, sf):
    spec = specs.structure_spec(spark, GROUPS_TEXT)
    c = cells(spark, sf).groupBy("cluster").agg(F.count("*").alias("n"))
    return (spec.select("structure_id", "structure_name", "structure_color", F.explode("cluster_ids").alias("cluster"))
            .join(c, "cluster"))


@plan("structure_naming", """SELECT n_nationkey, CASE ((n_nationkey - 1) % 12 + 12) % 12
    WHEN 0 THEN '#6EF0D4' WHEN 1 THEN '#78B9FF' WHEN 2 THEN '#FFB870' WHEN 3 THEN '#C8A2FF' WHEN 4 THEN '#FF8DA1'
    WHEN 5 THEN '#90F184' WHEN 6 THEN '#FFD76C' WHEN 7 THEN '#80E1FF' WHEN 8 THEN '#F4A6FF' WHEN 9 THEN '#FFA07A'
    WHEN 10 THEN '#B8F0DE' ELSE '#A7BFFF' END AS color,
  CAST(('0x' || substr(color, 2, 2))::INTEGER AS INTEGER) AS r, CAST(('0x' || substr(color, 4, 2))::INTEGER AS INTEGER) AS g,
  CAST(('0x' || substr(color, 6, 2))::INTEGER AS INTEGER) AS b,
  'S' || n_nationkey || ' ' || n_name || CASE WHEN n_regionkey = 1 THEN '' ELSE ' #' || n_regionkey || '.2' END AS selection
  FROM nation""")
def structure_naming(spark, sf):
    n = table(spark, sf, "nation").withColumn("color", S.palette_color("n_nationkey"))
    rgb = S.hex_to_rgb("color")
    return n.select("n_nationkey", "color", rgb[0].alias("r"), rgb[1].alias("g"), rgb[2].alias("b"),
                    S.selection_name("n_nationkey", F.concat(F.lit("["), "n_name", F.lit("]")), "n_regionkey",
                                     F.lit(2), F.col("n_regionkey") == 1).alias("selection"))


@plan("slug", """SELECT p_partkey, replace(p_name, ' ', '_') AS slug, 'contour' AS fallback FROM part""")
def slug(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", S.slug(F.concat(F.lit("(( "), "p_name", F.lit(" ))"))).alias("slug"), S.slug(F.lit(" * ")).alias("fallback"))


def _u32(first: int) -> str:
    terms = []
    for b in range(4):
        pos = 2 * (first + b) + 1
        hexdigit = "(strpos('0123456789abcdef', substr(h, {}, 1)) - 1)"
        terms.append(f"({hexdigit.format(pos)} * 16 + {hexdigit.format(pos + 1)}) * {256 ** b}::DOUBLE")
    return " + ".join(terms)


@plan("stable_jitter", f"""SELECT c_custkey, round((({_u32(0)}) / 4294967296 - 0.5) * 0.08, 9) AS dx,
  round((({_u32(4)}) / 4294967296 - 0.5) * 0.08, 9) AS dy FROM (SELECT c_custkey, sha1(c_name) AS h FROM customer)""")
def stable_jitter(spark, sf):
    dx, dy = S.stable_jitter("c_name")
    return table(spark, sf, "customer").select("c_custkey", F.round(dx, 9).alias("dx"), F.round(dy, 9).alias("dy"))


@plan("signal_bucket", """SELECT event_id, CASE event_type WHEN 'view' THEN 'tumor_signal' WHEN 'purchase' THEN 'inflammation_signal'
  WHEN 'click' THEN 'stroma_signal' WHEN 'error' THEN 'artifact_signal' END AS bucket FROM events""")
def signal_bucket(spark, sf):
    return table(spark, sf, "events").select("event_id", S.signal_bucket(visual_label("event_type")).alias("bucket"))


@plan("feature_modality", """SELECT p_partkey, CASE WHEN p_type = 'SMALL' OR p_name = 'red widget' THEN 'protein' ELSE 'rna' END AS modality
  FROM part""")
def feature_modality(spark, sf):
    name = F.when(F.col("p_type") == "SMALL", F.concat(F.lit("adt_"), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", S.feature_modality(name, ["Red Widget"]).alias("modality"))


@plan("pixel_units", f"""WITH {CELLS} SELECT cell_id, round(x * (1.0::DOUBLE / 0.2125::DOUBLE), 6) AS px,
  round(y * 0.25::DOUBLE, 6) AS um, CASE WHEN custkey % 3 = 0 THEN 0.2125::DOUBLE ELSE 0.5::DOUBLE END AS pixel_size,
  CASE WHEN custkey % 3 = 0 THEN 'fallback' ELSE 'metadata' END AS size_source FROM cells""")
def pixel_units(spark, sf):
    size, source = S.resolve_pixel_size(F.when(F.col("custkey") % 3 != 0, 0.5))
    return cells(spark, sf).select("cell_id", F.round(S.um_to_px("x"), 6).alias("px"), F.round(S.px_to_um("y", 0.25), 6).alias("um"),
                                   size.alias("pixel_size"), source.alias("size_source"))


@plan("transform_chain", f"WITH {CELLS} SELECT cell_id, round(y * 2 + 10, 6) AS x, round(x * 0.5 - 4, 6) AS y FROM cells")
def transform_chain(spark, sf):
    chain = [{"type": "identity"}, {"type": "swap_axes"}, {"type": "scale", "x": 2.0, "y": 0.5},
             {"type": "translation", "x": 10.0, "y": -4.0}]
    x, y = S.transform_chain("x", "y", chain)
    return cells(spark, sf).select("cell_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@plan("affine_round_trip", f"""WITH {CELLS} SELECT cell_id, round(x * 2 + y * 0.5 + 3, 6) AS fx, round(y * 4 - x - 1, 6) AS fy,
  round(x, 6) AS bx, round(y, 6) AS by FROM cells""")
def affine_round_trip(spark, sf):
    m = (2.0, 0.5, 3.0, -1.0, 4.0, -1.0)
    fx, fy = S.apply_affine("x", "y", m)
    bx, by = S.apply_affine(fx, fy, S.invert_affine(m))
    return cells(spark, sf).select("cell_id", *[F.round(c, 6).alias(n) for c, n in zip((fx, fy, bx, by), ("fx", "fy", "bx", "by"))])


@plan("pathway_text", """SELECT p_brand, string_agg(p_type || ':' || printf('%.3f', score), ';' ORDER BY score DESC, p_type) AS text,
  array_to_string(list_slice(list(p_type ORDER BY score DESC, p_type), 1, 3), ',') AS top3
  FROM (SELECT p_brand, p_type, round(avg(p_retailprice), 1) AS score FROM part GROUP BY 1, 2) GROUP BY 1""")
def pathway_text(spark, sf):
    d = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.round(F.avg("p_retailprice"), 1).alias("score"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), F.col("p_type").alias("name"), "score"))),
                          lambda s: F.struct(s["name"].alias("name"), s["score"].alias("score")))
    d = d.groupBy("p_brand").agg(S.pathway_text(entries).alias("text"))
    return d.select("p_brand", "text", F.array_join(S.top_pathways("text", 3), ",").alias("top3"))


@plan("text_list", """SELECT conv_id, turn, CASE role WHEN 'system' THEN 'role: system | turn: ' || turn
  WHEN 'user' THEN 'user | ' || turn ELSE 'assistant' END AS items,
  CAST(CASE role WHEN 'assistant' THEN 1 ELSE 2 END AS INTEGER) AS n FROM conversations""")
def text_list(spark, sf):
    r = F.col("role")
    raw = (F.when(r == "system", F.to_json(F.struct("role", "turn", F.lit("  ").alias("blank"))))
           .when(r == "user", F.to_json(F.array("role", F.lit(" "), F.col("turn").cast("string"))))
           .otherwise(S.json_string(F.concat(F.lit(" "), r, F.lit(" ")))))
    d = table(spark, sf, "conversations").select("conv_id", "turn", S.text_list(raw).alias("l"))
    return d.select("conv_id", "turn", F.array_join("l", " | ").alias("items"), F.size("l").alias("n"))


@plan("extract_model_json", """SELECT conv_id, turn, role AS parsed_role,
  CAST(length(text) AS INTEGER) AS text_length, CAST(NULL AS VARCHAR) AS missing FROM conversations""")
def extract_model_json(spark, sf):
    body = F.to_json(F.struct("role", "text"))
    raw = (F.when(F.col("role") == "user", F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone.")))
           .otherwise(F.concat(F.lit("The answer is "), body, F.lit(" as asked."))))
    parsed = F.from_json(S.extract_json_text(raw), "role string, text string")
    return table(spark, sf, "conversations").select("conv_id", "turn", parsed["role"].alias("parsed_role"),
                                                    F.length(parsed["text"]).alias("text_length"),
                                                    S.extract_json_text(F.lit("no object")).alias("missing"))


@plan("normalize_model_payload", """SELECT conv_id, turn, CASE role WHEN 'user' THEN conv_id ELSE turn END AS structure_id,
  CASE role WHEN 'user' THEN role ELSE '' END AS visual_evidence, 'check: ' || turn AS recommended_checks FROM conversations""")
def normalize_model_payload(spark, sf):
    payload = F.to_json(F.struct(
        F.when(F.col("role") != "user", F.col("turn")).alias("structure_id"),
        F.when(F.col("role") == "user", F.col("role")).alias("visual_evidence"),
        F.create_map(F.lit("check"), F.col("turn")).alias("recommended_checks")))
    d = table(spark, sf, "conversations").select("conv_id", "turn", payload.alias("payload"))
    d = contracts.normalize_model_payload(d, "payload", fallback_structure_id="conv_id")
    return d.select("conv_id", "turn", "structure_id", F.array_join("visual_evidence", "|").alias("visual_evidence"),
                    F.array_join("recommended_checks", "|").alias("recommended_checks"))


@plan("row_contract", f"""WITH {BUNDLES} SELECT evidence_id, concat_ws(',',
   CASE WHEN qc_status NOT IN ('ok', 'warning', 'fail') THEN 'qc_status:enum' END,
   CASE WHEN length(unit_id) < 2 THEN 'unit_id:min_length' END,
   CASE WHEN value < 0 OR value > 180 THEN 'value:range' END, CASE WHEN length(unit_id) = 3 THEN 'doc:extra_field' END) AS violations FROM bundles
  WHERE qc_status NOT IN ('ok', 'warning', 'fail') OR length(unit_id) < 2 OR value > 180 OR length(unit_id) = 3""")
def row_contract(spark, sf):
    extra = F.when(F.length("unit_id") == 3, "x")
    doc = F.to_json(F.struct(F.lit("e").alias("evidence_id"), F.lit("cell").alias("unit"), extra.alias("guess")))
    d = contracts.row_contract(bundles(spark, sf).withColumn("doc", doc), [
        contracts.one_of("qc_status", ["ok", "warning", "fail"]),
        contracts.min_length("unit_id", 2),
        contracts.in_range("value", 0.0, 180.0),
        contracts.no_extra_fields("doc", contracts.EVIDENCE_FIELDS),
    ])
    return d.filter(F.size("violations") > 0).select("evidence_id", F.array_join("violations", ",").alias("violations"))


@plan("input_hash", """SELECT o_orderkey, sha256('{"case": "' || o_orderpriority || '", "node": "' || o_orderkey
  || '", "tool": "price \\"' || o_orderstatus || '\\""}') AS input_hash FROM orders""")
def input_hash(spark, sf):
    m = F.create_map(F.lit("tool"), F.concat(F.lit('price "'), "o_orderstatus", F.lit('"')),
                     F.lit("node"), F.col("o_orderkey").cast("string"), F.lit("case"), F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", S.input_hash(m).alias("input_hash"))


@plan("metrics_at_k", """SELECT event_id, value AS gene_mse, CASE WHEN event_type = 'error' THEN NULL
  ELSE CAST(json_extract(props, '$.k') AS DOUBLE) END AS image_to_gene_top5 FROM events""")
def metrics_at_k(spark, sf):
    k5 = F.when(F.col("event_type") == "error", 7).otherwise(5)
    rows = F.array(F.struct(F.lit(1).alias("k"), F.lit(0.5).alias("image_to_gene_topk")),
                   F.struct(k5.alias("k"), F.get_json_object("props", "$.k").cast("double").alias("image_to_gene_topk")))
    text = F.to_json(F.struct(F.struct(F.col("value").alias("gene_mse")).alias("overall_prediction"), rows.alias("overall_retrieval")))
    d = contracts.metrics_at_k(table(spark, sf, "events").withColumn("metrics", text), "metrics", 5)
    return d.select("event_id", "gene_mse", "image_to_gene_top5")


@plan("schema_drift", """SELECT event_id, CASE event_type WHEN 'error' THEN 'invalid_json' ELSE 'version' END AS problem
  FROM events WHERE event_type IN ('error', 'signup')""")
def schema_drift(spark, sf):
    t = F.col("event_type")
    doc = (F.when(t == "error", "{broken").otherwise(F.to_json(F.struct(
        F.when(t == "signup", "0.1.0").otherwise("0.2.1").alias("schema_version"), "event_id"))))
    return (contracts.schema_drift(table(spark, sf, "events").withColumn("doc", doc), "doc", "0.2.1")
            .select("event_id", "problem"))
