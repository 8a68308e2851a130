"""Ranks that do not need one task to see every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import materialize


def running_total(df: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over all rows before the current one in ``order``.

    The rows are range-sorted into even partitions and written, because a recomputed
    range split need not be the same. The total inside a partition plus the totals of
    the partitions before it (one row each) is the answer, so no task sees all rows.
    """
    srt = df.withColumn("_v", value).repartitionByRange(*order).sortWithinPartitions(*order)
    srt = materialize(srt.withColumn("_mid", F.monotonically_increasing_id()))
    srt = srt.withColumn("_part", F.shiftright("_mid", 33))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (srt.groupBy("_part").agg(F.sum("_v").alias("_sum"))
               .select("_part", F.coalesce(F.sum("_sum").over(before.orderBy("_part")), F.lit(0)).alias("_offset")))
    inside = F.coalesce(F.sum("_v").over(before.partitionBy("_part").orderBy("_mid")), F.lit(0))
    return (srt.withColumn(name, inside).join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col(name) + F.col("_offset")).drop("_v", "_mid", "_part", "_offset"))


def dense_row_number(df: DataFrame, order: Sequence[str], name: str = "rn") -> DataFrame:
    """``row_number()`` over the whole table without a single-partition window."""
    srt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    srt = materialize(srt.withColumn("_mid", F.monotonically_increasing_id()))
    srt = srt.withColumn("_part", F.shiftright("_mid", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (srt.groupBy("_part").agg(F.count("*").alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    return (srt.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_mid") - F.shiftleft(F.col("_part"), 33) + F.col("_offset") + 1)
            .drop("_part", "_mid", "_offset"))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key. Spark keeps only k rows per key and task before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def ranks_of_counts(counts: DataFrame, keys: Sequence[str], value: str, ties: str, name: str) -> DataFrame:
    """``counts`` (one row per key and value, ``ties`` times each) with the mean rank of the value inside its key.

    The rank is the running total over the distinct values minus the running total where the
    key begins.
    """
    totals = running_total(counts, [*keys, value], F.col(ties), "_before")
    if keys:
        totals = totals.join(totals.groupBy(*keys).agg(F.min("_before").alias("_first")), list(keys))
    else:
        totals = totals.withColumn("_first", F.lit(0))
    return totals.withColumn(name, F.col("_before") - F.col("_first") + (F.col(ties) + 1) / 2).drop("_before", "_first")


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Average rank of ``value`` inside each key, ties sharing their mean rank; equal values are counted first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_ties"))
    return df.join(ranks_of_counts(counts, keys, value, "_ties", name).select(*keys, value, name), [*keys, value])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per key, one named column each; nulls do not count.

    The built-in ``percentile`` gathers the distinct values of a key in one task. Here
    the values are counted, sorted across the cluster, and only the two order
    statistics around each quantile are kept.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_q")).agg(F.count("*").alias("_ties"))
    totals = running_total(counts, [*keys, "_q"], F.col("_ties"), "_before")
    spans = totals.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min("_before").alias("_first"), F.sum("_ties").alias("_n"))
    if keys:
        # null-safe so that a null key is a group like any other
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        joined = totals.join(spans, on)
    else:
        span = spans.select(F.struct("_first", "_n")).scalar()
        joined = totals.withColumn("_first", span["_first"]).withColumn("_n", span["_n"])
    rows = joined.select(*keys, "_q", (F.col("_before") - F.col("_first")).alias("_at"), "_ties", "_n")
    aggs = []
    for name, q in quantiles.items():
        pos = F.lit(float(q)) * (F.col("_n") - 1)

        def at(rank):
            return F.max(F.when((F.col("_at") <= rank) & (rank < F.col("_at") + F.col("_ties")), F.col("_q")))
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        part = F.max(pos - F.floor(pos))
        aggs.append((low + (high - low) * part).alias(name))
    return rows.groupBy(*keys).agg(*aggs)
