"""Average-linkage trees over labels, many cases at once.

Each case is one group: a matrix of its labels, whose number is a property of the staining and
not of the number of cells. Inside it a nearest-neighbour chain finds pairs that are each
other's nearest; average linkage never moves a merged pair closer to a third cluster than
both were, so such pairs can be merged as they are found, in time quadratic in the labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .spatial import CASE

#: Labels of a case; their matrix is held by one task (128 MB at this bound).
MOST_LABELS = 4000


def _chain(labels: list[str], total: np.ndarray) -> list[tuple[list[str], list[str], float]]:
    """Merges (left leaves, right leaves, distance) of the labels, in ascending order, with these distances."""
    n = len(labels)
    pairs = np.ones((n, n))
    leaves, height = [[x] for x in labels], [0.0] * n
    alive = np.ones(n, bool)
    chain: list[int] = []
    merges = []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        top = chain[-1]
        d = np.where(alive, total[top] / pairs[top], np.inf)
        d[top] = np.inf
        least = d.min()
        if not np.isfinite(least):
            raise ValueError("no closest pair among the labels that are left; is a distance missing or not a number?")
        # of equal distances the pair whose names come first
        near = min(np.flatnonzero(d == least).tolist(), key=lambda j: (min(top, j), max(top, j)))
        if len(chain) < 2 or chain[-2] != near:
            chain.append(near)
            continue
        chain = chain[:-2]
        a, b = min(top, near), max(top, near)
        order = sorted((a, b), key=lambda i: (len(leaves[i]) > 1, height[i], i))
        merges.append((leaves[order[0]], leaves[order[1]], float(least)))
        for m in (total, pairs):
            m[a] += m[b]
            m[:, a] += m[:, b]
        leaves[a], height[a] = leaves[order[0]] + leaves[order[1]], float(least)
        alive[b] = False
    return merges


def average_linkage(pairs: DataFrame) -> DataFrame:
    """Merges ``(case_id, left_leaves, right_leaves, dist, size)`` of ``pairs(case_id, a, b, d)``, one row per unordered pair.

    Of two children a leaf comes before a tree and a lower tree before a higher one;
    leaves are ordered by label. Every pair of labels of a case needs a distance.
    """
    rows = pairs.select(CASE, "a", "b", F.col("d").cast("double").alias("d"))
    if rows.isEmpty():
        raise ValueError("need at least two labels to build a tree")
    case, label = (rows.schema[c].dataType.simpleString() for c in (CASE, "a"))

    def tree(table: pa.Table) -> pa.Table:
        a, b, d = table.column("a").to_pylist(), table.column("b").to_pylist(), table.column("d").to_pylist()
        names = sorted({*a, *b})
        if len(names) > MOST_LABELS:
            raise ValueError(f"more than {MOST_LABELS} labels in a case")
        at = {x: i for i, x in enumerate(names)}
        total = np.full((len(names), len(names)), np.nan)
        for x, y, v in zip(a, b, d):
            total[at[x], at[y]] = total[at[y], at[x]] = np.nan if v is None else v
        np.fill_diagonal(total, 0.0)
        if np.isnan(total).any():
            raise ValueError("no closest pair among the labels that are left; is a distance missing or not a number?")
        left, right, dist = zip(*_chain(names, total))
        kind = pa.list_(table.column("a").type)
        return pa.table({CASE: table.column(CASE).combine_chunks().take(pa.array([0] * len(dist))), "left_leaves": pa.array(left, kind), "right_leaves": pa.array(right, kind),
                         "dist": pa.array(dist, pa.float64()), "size": pa.array([len(x) + len(y) for x, y in zip(left, right)], pa.int32())})

    return rows.groupBy(CASE).applyInArrow(tree, f"{CASE} {case}, left_leaves array<{label}>, right_leaves array<{label}>, dist double, size int")


def cophenetic_matrix(merges: DataFrame, scale_to_one: bool = False) -> DataFrame:
    """``(case_id, a, b, d)``, ``a < b``: height of the merge that first joins two labels."""
    out = (merges.select(CASE, F.explode("left_leaves").alias("l"), "right_leaves", "dist").select(CASE, "l", F.explode("right_leaves").alias("r"), "dist")
           .select(CASE, F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), F.col("dist").alias("d")))
    if not scale_to_one:
        return out
    top = merges.groupBy(CASE).agg(F.max("dist").alias("_top"))
    return out.join(top, CASE).withColumn("d", F.try_divide("d", "_top")).drop("_top")


def leaf_order(merges: DataFrame) -> DataFrame:
    """``(case_id, label, leaf_pos)`` along the tree, from 0."""
    root = merges.groupBy(CASE).agg(F.max_by(F.concat("left_leaves", "right_leaves"), "size").alias("leaves"))
    return root.select(CASE, F.posexplode("leaves").alias("leaf_pos", "label"))


def structure_groups(merges: DataFrame, n_groups: int) -> DataFrame:
    """``(case_id, label, leaf_pos, group_id, height)``: the tree cut into at most ``n_groups`` groups.

    Groups are numbered by first appearance along the leaves; merges of equal height
    are cut together.
    """
    order = leaf_order(merges)
    w = Window.partitionBy(CASE)
    # merges of one case: one fewer than its labels
    ranked = merges.withColumn("_k", F.row_number().over(w.orderBy("dist", "size"))).withColumn("_m", F.count("*").over(w))
    cut = ranked.groupBy(CASE).agg(F.max(F.when(F.col("_k") <= F.col("_m") + 1 - n_groups, F.col("dist"))).alias("cut"))
    kept = merges.join(cut, CASE).filter("dist <= cut").select(CASE, F.explode(F.concat("left_leaves", "right_leaves")).alias("label"), "dist", "size",
                                                               F.get("left_leaves", F.lit(0)).alias("lead"))
    top = kept.groupBy(CASE, "label").agg(F.max(F.struct("size", "dist", "lead")).alias("t"))
    rows = order.join(top, [CASE, "label"], "left").select(CASE, "label", "leaf_pos", F.coalesce("t.lead", "label").alias("lead"), F.coalesce("t.dist", F.lit(0.0)).alias("height"))
    return renumber_by_leaf_order(rows, "lead").select(CASE, "label", "leaf_pos", "group_id", "height")


def renumber_by_leaf_order(rows: DataFrame, raw: str) -> DataFrame:
    """Add ``group_id`` 1..g: raw groups in the order of their first leaf."""
    first = rows.groupBy(CASE, raw).agg(F.min("leaf_pos").alias("_first"))
    ids = first.withColumn("group_id", F.dense_rank().over(Window.partitionBy(CASE).orderBy("_first"))).drop("_first")
    return rows.join(ids, [CASE, raw])


def leaf_spans(groups: DataFrame) -> DataFrame:
    """Per group: labels, leaf range, drawing span and height of its node."""
    x = 5.0 + 10.0 * F.col("leaf_pos")
    return groups.groupBy(CASE, "group_id").agg(
        F.count("*").alias("cluster_count"), F.min("leaf_pos").alias("leaf_start"), F.max("leaf_pos").alias("leaf_end"), (F.min(x) - 5).alias("span_left"),
        (F.max(x) + 5).alias("span_right"), F.avg(x).alias("x_data"), F.max("height").alias("y_data"),
        F.array_sort(F.collect_list(F.struct("leaf_pos", "label"))).alias("clusters")).withColumn("clusters", F.col("clusters.label"))


def block_stats(matrix: DataFrame, selected: list[str]) -> DataFrame:
    """Distances between selected and other labels; a matrix has one row per label pair."""
    inside = [F.col(c).isin(*selected) for c in ("a", "b")]
    d = F.col("d")

    def q(v):
        return F.percentile(d, v)
    return (matrix.filter((inside[0] != inside[1]) & d.isNotNull() & ~F.isnan(d)).groupBy(CASE)
            .agg(F.count("*").alias("n_pairs"), F.min(d).alias("min"), q(0.05).alias("p05"), q(0.5).alias("median"), F.avg(d).alias("mean"), q(0.95).alias("p95"), F.max(d).alias("max")))
