"""Chunking, embedding and passage retrieval for many questions at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import materialize
from .ranking import top_per_group

#: Rows of a block of chunks and of queries, and scores that a task holds at a time.
CHUNK_ROWS, QUERY_ROWS, TILE = 16_384, 1024, 1 << 21
#: Characters that a worker lays out at a time; their arrays take about 40 bytes each.
CHUNK_CHARS = 1 << 19
CHUNK = "array<struct<start:int,stop:int,text:string>>"


def _pieces(texts, size: int, overlap: int):
    """The chunks of each text, as lists of dictionaries."""
    import numpy as np

    bodies = [(t or "").replace("\r\n", "\n").strip() for t in texts]
    laid = np.frombuffer("".join(bodies).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(b) for b in bodies], dtype=np.int64)
    begins = ends - np.array([len(b) for b in bodies], np.int64)
    # for each character, the last place at or before it where a cut may fall; the blank
    # after a full stop lies behind the stop, so sentences need no mark of their own
    place = np.arange(len(laid))
    breaks = np.where(laid == 32, place, -1)
    if len(laid) > 1:
        paragraph = (laid[1:] == 10) & (laid[:-1] == 10)
        breaks[1:] = np.where(paragraph, np.maximum(breaks[1:], place[:-1]), breaks[1:])
    breaks = np.maximum.accumulate(breaks)
    # all texts advance together, one chunk a round
    row = np.flatnonzero(ends > begins)
    front = begins[row]
    found = []
    while len(row):
        limit = np.minimum(front + size, ends[row])
        back = breaks[limit - 1]
        far = (limit < ends[row]) & (back - front > size // 2)
        limit = np.where(far, back + 1, limit)
        found.append((row, front - begins[row], limit - begins[row]))
        more = limit < ends[row]
        row, front = row[more], np.maximum(front[more] + 1, limit[more] - overlap)
    pieces = np.empty(len(bodies), object)
    pieces[:] = [[] for _ in bodies]
    for rows, lo, hi in found:
        for i, start, stop in zip(rows.tolist(), lo.tolist(), hi.tolist()):
            piece = bodies[i][start:stop].strip()
            if piece:
                pieces[i].append({"start": start, "stop": stop, "text": piece})
    return pieces


def _spans(texts, size: int, overlap: int):
    """The chunks of a batch of texts, laid out ``CHUNK_CHARS`` at a time."""
    import numpy as np
    import pandas as pd

    out = np.empty(len(texts), object)
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= CHUNK_CHARS or i + 1 == len(texts):
            out[begin:i + 1] = _pieces(texts.iloc[begin:i + 1], size, overlap)
            begin, held = i + 1, 0
    return pd.Series(out, dtype=object)


def chunk_spans(text, size: int = 1200, overlap: int = 120) -> Column:
    """Overlapping pieces of a text, cut at a paragraph, sentence or word where one is near.

    The places where a cut may fall are found for many texts at once, of ``CHUNK_CHARS`` in all;
    then all of them take their next chunk in the same round of array operations.
    """
    if size < 1 or overlap < 0:
        raise ValueError("chunk size must be positive and overlap not negative")

    @F.pandas_udf(CHUNK)
    def spans(texts):
        return _spans(texts, size, overlap)
    return spans(text if isinstance(text, Column) else F.col(text))


def chunk_documents(docs: DataFrame, size: int = 1200, overlap: int = 120, document_id: str = "document_id", text: str = "text") -> DataFrame:
    """One row per chunk with ``chunk_id`` and ``point_id``; all other document columns are kept."""
    rest = [c for c in docs.columns if c not in (document_id, text)]
    rows = docs.select(F.col(document_id).cast("string").alias("document_id"), *rest, F.posexplode(chunk_spans(text, size, overlap)).alias("_i", "_c"))
    chunk_id = F.concat(F.lit("chunk-"), F.when(F.col("_i") < 9999, F.lpad((F.col("_i") + 1).cast("string"), 4, "0")).otherwise((F.col("_i") + 1).cast("string")))
    return (rows.withColumn("chunk_id", chunk_id).withColumn("point_id", F.concat("document_id", F.lit(":"), "chunk_id"))
            .select("point_id", "document_id", "chunk_id", *rest, F.col("_c.start").alias("start"), F.col("_c.stop").alias("stop"), F.col("_c.text").alias("text")))


def documents_without_chunks(docs: DataFrame, document_id: str = "document_id", text: str = "text") -> DataFrame:
    """Documents that would produce no chunk (only white space); an upsert rejects them."""
    return docs.filter(~F.coalesce(F.col(text), F.lit("")).rlike(r"\S")).select(document_id)


def tokens(text) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != "")


def term_buckets(text, dims: int) -> Column:
    return F.transform(tokens(text), lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dims).cast("int"))


def embed_terms(df: DataFrame, text: str = "text", dims: int = 64) -> DataFrame:
    """Default embedding: term counts hashed into ``dims`` buckets, as ``vector``.

    Array functions on the row, so nothing is shuffled.
    """
    def counts(buckets):
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
    # the outer lambda binds the hashed tokens once; a plain column would be hashed again for every bucket
    return df.withColumn("vector", F.get(F.transform(F.array(term_buckets(text, dims)), counts), F.lit(0)))


def embed_with(df: DataFrame, model: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """Embedding by a user's column function, for example a ``pandas_udf`` to ``ARRAY<FLOAT>``."""
    return df.withColumn("vector", model(F.col(text)).cast("array<double>"))


def mean_pool_l2(df: DataFrame, keys: Sequence[str], vector: str, dims: int, mask: str | None = None) -> DataFrame:
    """Mean vector of the unmasked rows per key, scaled to unit length.

    ``dims`` plain sums in one aggregate; nothing is exploded.
    """
    use = F.lit(1.0) if mask is None else F.col(mask).cast("double")
    n = F.greatest(F.sum(use), F.lit(1e-9))
    sums = [(F.sum(F.col(vector)[i].cast("double") * use) / n).alias(f"_v{i}") for i in range(dims)]
    pooled = df.groupBy(*keys).agg(*sums).select(*keys, F.array(*[F.col(f"_v{i}") for i in range(dims)]).alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v))
    return pooled.withColumn("_norm", norm).withColumn("vector", F.transform("vector", lambda v: F.when(F.col("_norm") > 0, v / F.col("_norm")).otherwise(0.0))).drop("_norm")


def cosine(left, right) -> Column:
    """Cosine of two vectors, over the shorter length for the product; 0 when a norm is 0."""
    a, b = ((F.col(c) if isinstance(c, str) else c).cast("array<double>") for c in (left, right))

    def total(arr):
        return F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.transform(F.filter(F.arrays_zip(a.alias("p"), b.alias("q")), lambda z: z["p"].isNotNull() & z["q"].isNotNull()), lambda z: z["p"] * z["q"]))
    na, nb = (F.sqrt(total(F.transform(v, lambda x: x * x))) for v in (a, b))
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(F.try_divide(dot, na * nb))


def vector_top_k(chunks: DataFrame, queries: DataFrame, k: int, key: str = "point_id", query_id: str = "query_id",
                 document_ids: Sequence[str] | None = None, digits: int = 9) -> DataFrame:
    """``(query_id, key, score, rank)``: the ``k`` chunks with the largest cosine per query.

    Exact. Chunks and queries are cut into blocks by hash, and each pair of blocks is one unit of
    work that scores tiles of at most ``TILE`` products and passes on its best k, so no side
    goes through the driver and a task's memory does not grow with either side. Scores are rounded
    before ranking and equal scores go by key, which keeps the result independent of the
    partitioning. Without queries the result is empty.
    """
    if document_ids is not None:
        chunks = chunks.filter(F.col("document_id").isin(list(document_ids)))
    side = chunks.select(F.col(key).alias("_k"), F.col("vector").cast("array<double>").alias("_v")).filter("_v IS NOT NULL")
    # vectors may be costly to make, so they are kept before they are counted
    side = materialize(side)
    qs = materialize(queries.select(F.col(query_id).alias("_k"), F.col("vector").cast("array<double>").alias("_v")).filter("_v IS NOT NULL"))
    c_blocks, q_blocks = (max(1, -(-d.count() // rows)) for d, rows in ((side, CHUNK_ROWS), (qs, QUERY_ROWS)))

    def block(n):
        return F.pmod(F.xxhash64("_k", F.lit(5)), F.lit(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = side.select("_k", "_v", block(c_blocks).alias("_c"), every(q_blocks).alias("_b"))
    right = qs.select("_k", "_v", every(c_blocks).alias("_c"), block(q_blocks).alias("_b"))
    schema = f"{query_id} {dict(queries.dtypes)[query_id]}, {key} {dict(chunks.dtypes)[key]}, score double"

    def unit(chunk_rows, query_rows):
        return _best_of_block(chunk_rows, query_rows, k, key, query_id, digits)
    best = left.groupBy("_c", "_b").cogroup(right.groupBy("_c", "_b")).applyInPandas(unit, schema)
    return top_per_group(best, [query_id], [F.desc("score"), F.asc(key)], k, rank="rank")


def _unit_rows(vectors, width: int):
    """Vectors cut or padded to ``width`` and divided by their own length; zero vectors stay zero."""
    import numpy as np
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        v = np.asarray(v, float)
        size = np.linalg.norm(v)
        if size > 0:
            out[i, :min(width, len(v))] = v[:width] / size
    return out


def _best_of_block(chunk_rows, query_rows, k: int, key: str, query_id: str, digits: int):
    """Best ``k`` chunks of one block for each query of another."""
    import numpy as np
    import pandas as pd
    parts = []
    if len(chunk_rows) and len(query_rows):
        chunk_rows = chunk_rows.sort_values("_k", ignore_index=True)
        width = max(map(len, query_rows["_v"]))
        names, m = chunk_rows["_k"].to_numpy(), _unit_rows(chunk_rows["_v"], width)
        step = max(1, TILE // len(names))
        for at in range(0, len(query_rows), step):
            tile = query_rows.iloc[at:at + step]
            s = np.round(_unit_rows(tile["_v"], width) @ m.T, digits) + 0.0
            # a stable sort leaves equal scores in the order of their keys
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            parts.append(pd.DataFrame({query_id: np.repeat(tile["_k"].to_numpy(), top.shape[1]), key: names[top.ravel()], "score": np.take_along_axis(s, top, 1).ravel()}))
    return pd.concat(parts) if parts else pd.DataFrame()


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "point_id", version: str = "version") -> DataFrame:
    """Union of both with the last version of each point; each task forwards one row per point.

    Of equal versions the incoming row wins, and of several incoming ones the largest in
    the order of the other columns, so that the result does not depend on the shuffle.
    """
    both = existing.withColumn("_incoming", F.lit(0)).unionByName(incoming.withColumn("_incoming", F.lit(1)), allowMissingColumns=True)
    rest = [F.desc(F.to_json(F.struct(*[c for c in both.columns if c not in (key, version, "_incoming")])))]
    return top_per_group(both, [key], [F.desc(version), F.desc("_incoming"), *rest], 1).drop("_incoming")


def lexical_overlap(question, text) -> Column:
    return F.size(F.array_intersect(tokens(question), tokens(text))).cast("double")


def rerank(candidates: DataFrame, top_n: int, score: Callable[[Column, Column], Column] = lexical_overlap, query_id: str = "query_id",
           question: str = "question", text: str = "text") -> DataFrame:
    """Best ``top_n`` candidates per question by ``score(question, text)``; equal scores keep the candidate order."""
    scored = candidates.withColumn("rerank_score", score(F.col(question), F.col(text)))
    return top_per_group(scored, [query_id], [F.desc("rerank_score"), F.asc("rank")], top_n, rank="position")


def retrieve(questions: DataFrame, chunks: DataFrame, k: int, document_ids: Sequence[str] | None = None, excerpt: int = 400,
             score: Callable[[Column, Column], Column] = lexical_overlap) -> DataFrame:
    """Cited passages per question.

    ``questions(query_id, question, vector)``, ``chunks(point_id, document_id, chunk_id, text, vector)``.
    Twice ``k`` candidates by cosine are reranked to ``k`` and numbered C1, C2, …
    """
    found = vector_top_k(chunks, questions, max(2 * k, k), document_ids=document_ids)
    rows = found.join(chunks.drop("vector"), "point_id").join(questions.select("query_id", "question"), "query_id")
    kept = rerank(rows, k, score)
    return kept.select("query_id", F.concat(F.lit("C"), F.col("position").cast("string")).alias("citation_id"), "position", "document_id", "chunk_id", "point_id",
                       "score", "rerank_score", F.substring("text", 1, excerpt).alias("text_excerpt"))


def retrieval_stats(questions: DataFrame, candidates: DataFrame, cited: DataFrame, document_filter: bool) -> DataFrame:
    """Candidates and passages per question; a question without candidates carries an error."""
    c = candidates.groupBy("query_id").agg(F.count("*").alias("candidate_count"))
    r = cited.groupBy("query_id").agg(F.count("*").alias("returned_count"))
    out = questions.select("query_id").join(c, "query_id", "left").join(r, "query_id", "left").fillna(0, ["candidate_count", "returned_count"])
    return (out.withColumn("document_filter_applied", F.lit(document_filter))
            .withColumn("error", F.when(F.col("candidate_count") == 0, "No reference passages matched the provided document filter.")))


def resolve_citations(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """Citations named by an answer that exist, in the order of the answer.

    ``answers(query_id, citation_ids ARRAY<STRING>)``.
    """
    named = answers.select("query_id", F.posexplode("citation_ids").alias("answer_pos", "citation_id"))
    return named.join(cited, ["query_id", "citation_id"])


def document_chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
