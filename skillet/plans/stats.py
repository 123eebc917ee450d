"""Evaluation statistics: rates with intervals, paired tests, thresholds, agreement of rankings."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson interval, within [0, 1]; (0, 0) for no trials."""
    n = total.cast("double")
    p = F.try_divide(successes.cast("double"), n)
    scale = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    low, high = F.greatest(middle - half, F.lit(0.0)), F.least(middle + half, F.lit(1.0))
    return F.when(total > 0, low).otherwise(0.0), F.when(total > 0, high).otherwise(0.0)


def error(first: Column, second: Column, floor: float = 5.0) -> Column:
    """Relative error of two amounts; 0 within ``floor``; null if either is missing."""
    gap = F.abs(first - second)
    return F.when(first.isNull() | second.isNull(), None).when(gap <= floor, 0.0).otherwise(gap / F.greatest(F.abs(first), F.abs(second)))


def band(e: Column, cuts: tuple[float, ...] = (0.10, 0.25, 0.50)) -> Column:
    out = F.lit("beyond")
    for c in reversed(cuts):
        out = F.when(e < c, f"under {c:.2f}").otherwise(out)
    return out


def mcnemar(pairs: DataFrame, a: str, b: str) -> tuple[int, int, float]:
    """(only a right, only b right, exact two-sided p)."""
    r = pairs.agg(F.count_if(F.col(a) & ~F.col(b)), F.count_if(~F.col(a) & F.col(b))).first()
    x, y = int(r[0]), int(r[1])
    n = x + y
    return x, y, min(1.0, 2 * sum(comb(n, k) for k in range(min(x, y) + 1)) / 2**n) if n else 1.0


def bootstrap(df: DataFrame, value: str, draws: int = 2_000, seed: int = 20260729) -> DataFrame:
    """One row (mean, low, high): percentile bootstrap of a mean; nulls without values."""
    known = df.where(F.col(value).isNotNull())
    got = resampled(known, [value], lambda m: m[:, 0], draws, seed)
    return known.agg(F.avg(F.col(value).cast("double")).alias("mean")).crossJoin(got.agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high")))


def running(df: DataFrame, order: str, columns: list[str], blocks: int = 64, accuracy: int = 1_000) -> DataFrame:
    """``df`` with ``<column>_below``: the sums of ``columns`` over all rows that come before by ``order`` (distinct and not null).

    The rows are cut into ranges of about equal numbers; each range is summed where it lies and gets the sum of the
    ranges before it, of which there are at most ``blocks``. So no task orders all rows.
    """
    edges = sorted(set(df.agg(F.percentile_approx(order, [k / blocks for k in range(1, blocks)], accuracy)).first()[0] or []))
    block = F.lit(0)
    for k, e in enumerate(edges):
        block = F.when(F.col(order) > F.lit(e), k + 1).otherwise(block)
    cut = df.withColumn("_block", block)
    # One row per range, so a single window and a broadcast.
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("_block").agg(*[F.sum(c).alias(f"_{c}") for c in columns]).select("_block", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    own = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(F.broadcast(offsets), "_block")
    return out.select(*df.columns, *[(F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"_{c}")).alias(f"{c}_below") for c in columns])


def f_beta(p: Column, r: Column, beta: float = 2.0) -> Column:
    """The weighted harmonic mean of precision and recall; 0 where it is undefined."""
    b2 = beta * beta
    return F.coalesce(F.try_divide((1 + b2) * p * r, b2 * p + r), F.lit(0.0))


def sweep(df: DataFrame, score: str, negative: str, beta: float = 2.0) -> DataFrame:
    """(threshold, precision, recall, f): declining every row whose score lies below the threshold, at each distinct score."""
    known = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    by = known.groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("n"), F.count_if(negative).alias("neg"))
    total = known.agg(F.count_if(negative).alias("all"))
    p = F.try_divide(F.col("neg_below").cast("double"), F.col("n_below"))
    r = F.try_divide(F.col("neg_below").cast("double"), F.col("all"))
    rows = running(by, "threshold", ["n", "neg"]).crossJoin(F.broadcast(total)).where("n_below > 0")
    return rows.select("threshold", p.alias("precision"), r.alias("recall"), f_beta(p, r, beta).alias("f"))


def fit_threshold(df: DataFrame, score: str, negative: str, beta: float = 2.0) -> DataFrame:
    """One row (threshold, f): the operating point of highest F, of equal ones the lowest; threshold 0 if none is above 0."""
    best = sweep(df, score, negative, beta).where("f > 0").agg(F.min(F.struct((-F.col("f")).alias("f"), "threshold")).alias("m"))
    return best.select(F.coalesce("m.threshold", F.lit(0.0)).alias("threshold"), F.coalesce(-F.col("m.f"), F.lit(0.0)).alias("f"))


def fold_of(key: Column, folds: int = 5, seed: int = 20260730) -> Column:
    """A fold from the hash of a key: the same key always falls into the same fold."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("bigint") % folds).cast("int")


def cross_validated(df: DataFrame, key: str, score: str, negative: str, folds: int = 5, beta: float = 2.0) -> DataFrame:
    """(key, fold, threshold, declined): each row decided by the threshold that the other folds fit."""
    rows = df.where(F.col(score).isNotNull()).withColumn("fold", fold_of(F.col(key), folds))
    cuts = None
    for k in range(folds):
        one = fit_threshold(rows.where(F.col("fold") != k), score, negative, beta).select(F.lit(k).alias("fold"), "threshold")
        cuts = one if cuts is None else cuts.unionByName(one)
    return rows.join(F.broadcast(cuts), "fold").select(key, "fold", "threshold", (F.col(score) < F.col("threshold")).alias("declined"), F.col(negative).alias("negative"))


def coverage_curve(df: DataFrame, score: str, outcome: str, key: str, points: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """(point, n, accuracy): how often the outcome holds among the best rows by score, for shares of all rows; ties go by key."""
    by = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.count_if(outcome).alias("good"))
    below = running(by.withColumn("o", -F.col("s")), "o", ["n", "good"])
    total = by.agg(F.sum("n").alias("all"))
    cut = below.crossJoin(F.broadcast(total)).select("s", "n", "good", "n_below", "good_below", F.explode(F.array(*[F.struct(F.lit(p).alias("point"), F.greatest(F.lit(1), F.round(F.col("all") * p)).cast("bigint").alias("take")) for p in points])).alias("p"))
    edge = cut.where((F.col("n_below") < F.col("p.take")) & (F.col("n_below") + F.col("n") >= F.col("p.take"))).select("s", "good_below", "n_below", "p.point", "p.take")
    # Of the score at which a share ends only the first rows by key count.
    tied = df.where(F.col(outcome).isNotNull()).select(F.col(score).alias("s"), key, outcome).join(F.broadcast(edge), "s")
    place = F.row_number().over(Window.partitionBy("point").orderBy(key))
    got = tied.withColumn("_r", place).where(F.col("_r") <= F.col("take") - F.col("n_below"))
    return got.groupBy("point", "take", "good_below").agg(F.count_if(outcome).alias("g")).select("point", F.col("take").alias("n"), ((F.col("good_below") + F.col("g")) / F.col("take")).alias("accuracy"))


def best_at_target(df: DataFrame, score: str, outcome: str, target: float = 0.9) -> DataFrame:
    """One row (threshold, n, accuracy): the lowest score down to which the outcome holds in at least ``target`` of the rows; nulls if there is none."""
    by = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.count_if(outcome).alias("good"))
    upto = running(by.withColumn("o", -F.col("s")), "o", ["n", "good"]).select("s", (F.col("n") + F.col("n_below")).alias("n"), ((F.col("good") + F.col("good_below")) / (F.col("n") + F.col("n_below"))).alias("accuracy"))
    return upto.where(F.col("accuracy") >= target).agg(F.min(F.struct(F.col("s").alias("threshold"), "n", "accuracy")).alias("m")).select("m.*")


def resampled(df: DataFrame, columns: list[str], statistic, draws: int = 2_000, seed: int = 20260729, blocks: int = 8, group: str | None = None) -> DataFrame:
    """(draw, value): ``statistic`` of the column means in bootstrap samples, by group if there is one.

    Each row enters a draw a Poisson(1) number of times (the Poisson bootstrap), so that rows are resampled where they lie, in
    one pass, and only sums per block of draws leave a task: the number of rows and of distinct values has no bound.
    ``statistic`` maps an array (draw, column) of means, or with ``group`` a dict of them, to a value per draw.
    """
    names = list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for b in batches:
            for g, part in b.groupby("_g"):
                x = part[names].to_numpy(dtype=float)
                # The hash of a batch's rows seeds it, so that a run can be repeated.
                mark = int(pd.util.hash_pandas_object(part[names], index=False).sum() % np.uint64(2**63))
                rng = np.random.default_rng([seed, mark])
                w = rng.poisson(1.0, (draws, len(part))).astype(float)
                s = np.concatenate([w.sum(axis=1, keepdims=True), w @ x], axis=1)
                sums[g] = sums.get(g, 0.0) + s
        for g, s in sums.items():
            yield pd.DataFrame({"g": g, "draw": np.arange(draws), "v": list(s)})

    rows = df.dropna(subset=names).select(*[F.col(c).cast("double").alias(c) for c in names], (F.col(group).cast("string") if group else F.lit("")).alias("_g"))
    by = rows.mapInPandas(run, "g string, draw int, v array<double>").select("g", "draw", F.posexplode("v").alias("k", "x")).groupBy("g", "draw", "k").agg(F.sum("x").alias("x"))
    table = by.groupBy("g", "draw").pivot("k", list(range(len(names) + 1))).agg(F.first("x")).toPandas()
    means = {}
    for g, part in table.groupby("g"):
        part = part.sort_values("draw")
        n = part["0"].to_numpy() if "0" in part else part[0].to_numpy()
        means[g] = np.stack([part[str(k) if str(k) in part else k].to_numpy() / np.maximum(n, 1e-12) for k in range(1, len(names) + 1)], axis=1)
    value = (statistic(means) if group else statistic(means[""])) if means else np.zeros(0)
    return df.sparkSession.createDataFrame(pd.DataFrame({"draw": np.arange(len(value), dtype=np.int32), "value": np.asarray(value, dtype=float)}), "draw int, value double")


def paired_bootstrap(df: DataFrame, a: str, b: str, draws: int = 2_000) -> DataFrame:
    """One row (difference, low, high, p_b_better): the mean of b minus that of a, with its interval."""
    pairs = df.dropna(subset=[a, b])
    got = resampled(pairs, [a, b], lambda m: m[:, 1] - m[:, 0], draws)
    mean = pairs.agg(F.avg(F.col(b).cast("double") - F.col(a).cast("double")).alias("difference"))
    return mean.crossJoin(got.agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"), F.avg((F.col("value") > 0).cast("double")).alias("p_b_better")))


def stratified_interval(df: DataFrame, stratum: str, value: str, weights: dict[str, float], draws: int = 2_000) -> DataFrame:
    """One row (low, high): interval of a mean weighted by ``weights`` of the strata, resampled within each."""
    whole = sum(weights.values()) or 1.0
    got = resampled(df, [value], lambda m: sum(weights.get(g, 0.0) / whole * x[:, 0] for g, x in m.items()), draws, group=stratum)
    return got.agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"))


def isotonic(spark: SparkSession, df: DataFrame, score: str, outcome: str):
    """A fitted non-decreasing curve from score to outcome."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    rows = VectorAssembler(inputCols=[score], outputCol="features").transform(df.select(F.col(score).cast("double"), F.col(outcome).cast("double").alias("label")).dropna())
    return IsotonicRegression(isotonic=True).fit(rows)


def krippendorff(answers: DataFrame) -> DataFrame:
    """One row (alpha, n_items, n_answers) of (item, label): chance-corrected nominal agreement over the items with two answers or more.

    1 where only one label occurs, null where no item has two answers.
    """
    counts = answers.groupBy("item", "label").agg(F.count("*").alias("c"))
    per = counts.groupBy("item").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq")).where("n > 1")
    observed = per.agg(F.sum((F.col("n") * F.col("n") - F.col("sq")) / (F.col("n") - 1)).alias("differ"), F.sum("n").alias("n_answers"), F.count("*").alias("n_items"))
    labels = counts.join(per.select("item"), "item").groupBy("label").agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("sq"))
    n, differ = F.col("n_answers").cast("double"), F.col("differ")
    chance = (n * n - F.col("sq")) / (n - 1)
    return observed.crossJoin(labels).select(F.when(n.isNull(), None).when(chance == 0, 1.0).otherwise(1 - differ / F.nullif(chance, F.lit(0.0))).alias("alpha"), "n_items", F.coalesce("n_answers", F.lit(0)).alias("n_answers"))


#: P(X <= k) of the Poisson distribution of mean 1, for k from 0.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def krippendorff_interval(answers: DataFrame, draws: int = 200) -> DataFrame:
    """One row (low, high): the percentile interval of Krippendorff's alpha over resampled items.

    An item enters a draw a Poisson(1) number of times, told by the hash of item and draw, so draws can be repeated and
    the items are resampled where they lie: only sums per draw and label are shuffled.
    """
    counts = answers.groupBy("item", "label").agg(F.count("*").alias("c"))
    per = counts.groupBy("item").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq")).where("n > 1")

    def drawn(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        u = F.conv(F.substring(F.md5(F.concat_ws("|", "item", F.col("d").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
        times = F.lit(0)
        for p in POISSON:
            times = times + F.when(u >= p, 1).otherwise(0)
        return rows.withColumn("w", times).where("w > 0")

    items = drawn(per).groupBy("d").agg(F.sum(F.col("w") * (F.col("n") * F.col("n") - F.col("sq")) / (F.col("n") - 1)).alias("differ"), F.sum(F.col("w") * F.col("n")).cast("double").alias("n"))
    labels = drawn(counts.join(per.select("item"), "item")).groupBy("d", "label").agg(F.sum(F.col("w") * F.col("c")).alias("c")).groupBy("d").agg(F.sum(F.col("c") * F.col("c")).alias("sq"))
    chance = (F.col("n") * F.col("n") - F.col("sq")) / (F.col("n") - 1)
    alpha = items.join(labels, "d").select(F.when(chance == 0, 1.0).otherwise(1 - F.col("differ") / F.nullif(chance, F.lit(0.0))).alias("alpha"))
    return alpha.agg(F.percentile("alpha", 0.025).alias("low"), F.percentile("alpha", 0.975).alias("high"))
