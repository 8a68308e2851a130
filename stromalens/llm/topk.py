"""Exact search for the largest inner products by pivot tables.

Every vector keeps its distances to a set of pivots. By the triangle inequality no candidate
is nearer to a query than the largest difference of their pivot distances, which with
the two norms bounds the inner product from above. A query takes its candidates in the order
of that bound and stops once the bound falls below its k-th best score.

Queries and candidates are cut into blocks, and each pair of blocks is one unit of work of
bounded size; the best k of each unit are merged per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pivots, and the rows they are chosen from (those with the smallest hashes).
PIVOTS, PIVOT_SAMPLE = 24, 2000
#: Rows of a block of candidates and of queries.
CANDIDATE_ROWS, QUERY_ROWS = 8192, 512
#: Candidates that are scored between two looks at the bound.
STEP = 64
HIT_SCHEMA = "query_id long, vec_id long, score long"


def quantized(vec: Column, scale: int = 256) -> Column:
    """Whole numbers floor(scale * x); null if the vector or a component is null or not finite."""
    doubles = vec.cast("array<double>")
    usable = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(usable, F.transform(doubles, lambda x: F.floor(x * scale).cast("long")))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows that lie far from each other, the first one farthest from the mean."""
    if not len(sample):
        return sample
    far = ((sample - sample.mean(axis=0)) ** 2).sum(axis=1)
    chosen = [int(far.argmax())]
    gap = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def search_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, pivots: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The best ``k`` of the candidates for each query, ties to the smaller id, exactly.

    Whole numbers below 2**53 are exact in doubles. The bound is raised by more than its
    rounding error, so that no candidate that ties is passed over.
    """
    to_pivots = lambda v: np.sqrt(np.maximum(((v[:, None, :] - pivots[None]) ** 2).sum(axis=2), 0))
    table = np.concatenate([to_pivots(x[i:i + 1024]) for i in range(0, len(x), 1024)])
    norms = (x ** 2).sum(axis=1)
    out = []
    for vector, name, from_pivots in zip(q, q_ids, to_pivots(q)):
        own = (vector ** 2).sum()
        least = np.zeros(len(x))
        for p in range(len(pivots)):
            np.maximum(least, np.abs(table[:, p] - from_pivots[p]), out=least)
        bound = (own + norms - least ** 2) / 2
        bound += 1e-9 * (own + norms) + 1e-6
        bound[ids == name] = -np.inf
        order = np.argsort(-bound)
        best_s, best_i = np.zeros(0), np.zeros(0, np.int64)
        for start in range(0, len(order), STEP):
            now = order[start:start + STEP]
            if bound[now[0]] == -np.inf or len(best_s) == k and bound[now[0]] < best_s[-1]:
                break
            now = now[bound[now] > -np.inf]
            s, i = np.concatenate([best_s, x[now] @ vector]), np.concatenate([best_i, ids[now]])
            top = np.lexsort((i, -s))[:k]
            best_s, best_i = s[top], i[top]
        out += [(int(name), int(i), int(s)) for s, i in zip(best_s, best_i)]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vec: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's ``k`` best inner products.

    Components count as floor(``scale`` * x). A query's own id is no candidate; rows with a null
    id, a null vector, or a null or non-finite component take no part, and only vectors as
    long as the query's are compared. Every candidate row counts, so equal rows take a rank each;
    a query that is repeated with one vector is asked once. All hits are returned if there are fewer than ``k``.

    The numbers of blocks follow from one count. Each candidate is sent once per block of
    queries, each query once per block of candidates.
    """
    whole = vectors.select(F.col(key).cast("long").alias("id"), quantized(F.col(vec), scale).alias("v"), is_query.alias("q")).where("id is not null and v is not null")
    sizes = whole.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("long")).alias("q")).collect()
    found = None
    for size in sizes:
        hits = _search(whole.where(F.size("v") == size["dim"]), size["n"], size["q"] or 0, k)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], HIT_SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, n: int, n_queries: int, k: int) -> DataFrame:
    spark = rows.sparkSession
    c_blocks, q_blocks = max(1, -(-n // CANDIDATE_ROWS)), max(1, -(-n_queries // QUERY_ROWS))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).toPandas()
    pivots = choose_pivots(np.array(sample["v"].tolist(), np.float64).reshape(len(sample), -1), PIVOTS)
    block = lambda m: F.pmod(F.xxhash64("id", F.lit(7)), F.lit(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = rows.select("id", "v", block(c_blocks).alias("c"), all_of(q_blocks).alias("b"))
    queries = rows.where("q").select("id", "v").distinct().select("id", "v", all_of(c_blocks).alias("c"), block(q_blocks).alias("b"))

    def unit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        stack = lambda f: np.stack(f["v"].to_numpy()).astype(np.float64)
        out = search_block(stack(right), right["id"].to_numpy(), stack(left), left["id"].to_numpy(), pivots, k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return candidates.groupBy("c", "b").cogroup(queries.groupBy("c", "b")).applyInPandas(unit, HIT_SCHEMA)
