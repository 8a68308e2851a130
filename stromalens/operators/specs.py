"""Structure specifications typed or picked by a user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S


def parse_cluster_groups(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Group text to rows ``(keep…, group_no, item_no, label)``.

    One group per line or ``;``; anything up to the first colon is a title; labels
    are separated by commas; empty groups and labels do not count.
    """
    # Plain array functions rather than three explodes: the text of one row is one spec.
    lines = F.split(F.regexp_replace(F.col(text), ";", "\n"), "\r\n|\r|\n")
    bodies = F.transform(lines, lambda s: F.regexp_replace(s, r"^[^:]*:", ""))
    groups = F.transform(bodies, lambda s: F.filter(F.transform(F.split(s, ","), lambda v: F.trim(v)), lambda v: v != ""))
    groups = F.filter(groups, lambda g: F.size(g) > 0)
    return (df.select(*keep, F.posexplode(groups).alias("g", "items"))
            .select(*keep, (F.col("g") + 1).alias("group_no"), F.posexplode("items").alias("i", "label"))
            .select(*keep, "group_no", (F.col("i") + 1).alias("item_no"), "label"))


def structure_spec(spark: SparkSession, groups_text: str, names: Sequence[str] = ()) -> DataFrame:
    """One row per structure, numbered from 1, labels de-duplicated in order.

    The text is one user input, so reading the few parsed rows to validate them is fine.
    """
    raw = spark.createDataFrame([(groups_text,)], "text string")
    items = parse_cluster_groups(raw, "text").withColumn("label", S.normalize_cluster_label("label"))
    named = F.create_map(*[F.lit(v) for i, n in enumerate(names, 1) for v in (i, n)]) if names else None
    default = F.concat(F.lit("Structure "), F.col("group_no").cast("string"))
    spec = (items.groupBy("group_no").agg(F.array_sort(F.collect_list(F.struct("item_no", "label"))).alias("items"))
            .select(F.col("group_no").alias("structure_id"),
                    (F.coalesce(named[F.col("group_no")], default) if named is not None else default).alias("structure_name"),
                    S.palette_color("group_no").alias("structure_color"),
                    F.array_distinct(F.col("items.label")).alias("cluster_ids")))
    problems = repeated_labels(spec).limit(20).collect()
    if problems:
        raise ValueError("label used by more than one structure: " + ", ".join(r["label"] for r in problems))
    if spec.isEmpty():
        raise ValueError("no structure groups in the text")
    return spec


def repeated_labels(spec: DataFrame) -> DataFrame:
    return (spec.select("structure_id", F.explode("cluster_ids").alias("label")).groupBy("label")
            .agg(F.count_distinct("structure_id").alias("n")).filter("n > 1").select("label"))
