"""The text operators bound to the shared test tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, html_text, language, packing, phrases, quality, simhash, substrings, token_files, topk, urls, vector_copies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OP1_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.e::double[], c.e::double[])::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


@query("op1_top_k_search", _OP1_SQL)
def op1_top_k_search(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query("op2_bpe_round_trip")
def op2_bpe_round_trip(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens = bpe.encode(table(spark, sf_dir, "documents"), path)
    coded = tokens.select("doc_id", "n_tokens", "ids", F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"))
    return bpe.decode(coded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


#: Host, path and verdict of the rules of op3.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
_OP3_SQL = """
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from pages),
f as (
  select *, case
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule from u)
select page_id, host, path, rule, case when rule in ('example.org/es/', 'example.org/en/1', 'com/de/') then 'block' else 'allow' end as verdict from f
"""


@query("op3_url_rules", _OP3_SQL)
def op3_url_rules(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


@query("op4_simhash_groups")
def op4_simhash_groups(spark, sf_dir):
    return simhash.groups(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def packed_documents(docs: DataFrame, ids: bool = False) -> DataFrame:
    """Documents in sequences of 2048 tokens, each ended by id 0; with ``ids`` also the tokens of each piece."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0, ranked=True)
    own = ["ids"] if ids else []
    return packing.pack_pieces(pieces.select("_part", "_rank", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *own), 2048)


@query("op5_pack_sequences")
def op5_pack_sequences(spark, sf_dir):
    return packed_documents(table(spark, sf_dir, "documents"))


@query("op10_token_files")
def op10_token_files(spark, sf_dir):
    folder = token_files.scratch_folder(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, 2)
    return token_files.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def trusted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are labelled good and not toxic, whatever else is said of them."""
    return table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0").select("doc_id")


@query("op7_quality_rules")
def op7_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), trusted_documents(spark, sf_dir)).drop("key")


def language_model(docs: DataFrame) -> language.Model:
    """Fitted on labelled documents outside the held-out fold."""
    return language.train(docs.select("doc_id", "text", "lang").where(~language.held_out(F.col("doc_id"))))


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language_model(docs)).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query("op8_repeated_passages")
def op8_repeated_passages(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op6_html_text")
def op6_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op13_token_alignment")
def op13_token_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_vector_near_copies")
def op12_vector_near_copies(spark, sf_dir):
    return vector_copies.near_copies(table(spark, sf_dir, "embeddings"))


@query("op11_phrase_collocations")
def op11_phrase_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))
