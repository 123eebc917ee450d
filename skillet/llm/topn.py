"""The N best items of every group, whatever the size of the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int = 5, bands: int = 16, accuracy: int = 1_000) -> DataFrame:
    """(group, item, score, place): up to ``n`` items per group by falling score, ties by rising item as text.

    An item counts once per group, with its highest score. Null groups, items
    and scores and NaN scores are left out. ``place`` runs from 1.

    The scores are cut into ``bands`` ranges of about equal numbers of rows,
    the highest first. Items are counted per group and band, with partial
    counts before the shuffle; the running count from the top shows at which
    band a group is filled. All bands below it leave by an anti-join on (group,
    band); the bands above it are taken whole and the boundary band is ranked
    exactly. Ranking keeps at most ``n`` rows per group and task before its
    shuffle, so neither a group of any size nor a band of equal scores gathers
    in one task.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    s = F.col(score).cast("double")
    clean = rows.where(s.isNotNull() & ~F.isnan(s) & F.col(group).isNotNull() & F.col(item).isNotNull())
    best = clean.groupBy(F.col(group).alias("_g"), F.col(item).alias("_i")).agg(F.max(s).alias("_s"))
    edges = clean.agg(F.percentile_approx(s, [k / bands for k in range(bands - 1, 0, -1)], accuracy)).first()[0] or []
    edges = sorted(set(edges), reverse=True)
    band = F.lit(len(edges))
    for k in reversed(range(len(edges))):
        band = F.when(F.col("_s") >= F.lit(edges[k]), k).otherwise(band)
    banded = best.withColumn("_b", band)
    above = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    filled = banded.groupBy("_g", "_b").agg(F.count("*").alias("_n")).withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0))).where(F.col("_above") >= n)
    left = banded.join(filled.select("_g", "_b"), ["_g", "_b"], "left_anti")
    order = Window.partitionBy("_g").orderBy(F.col("_s").desc(), F.col("_i").cast("string"))
    placed = left.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return placed.select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_s").alias(score), "place")
