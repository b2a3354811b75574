"""Detection metrics as aggregations: confusion counts, curves, histograms, tables of thresholds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import ratio, reached
from ..functions.storage import stored

RATES = ("precision", "recall", "f1", "fpr", "z_dr")


def confusion(pred: Column, y: str = "y", family: str = "family") -> list[Column]:
    """tp, fp, tn, fn, and what zero-day detection counts: rows of attack families, and those predicted."""
    count = lambda x, name: F.coalesce(F.sum(x.cast("long")), F.lit(0)).alias(name)
    hit, real, attack = pred.cast("boolean"), F.col(y) == 1, F.col(family) != "benign"
    return [
        count(hit & real, "tp"), count(hit & ~real, "fp"), count(~hit & ~real, "tn"), count(~hit & real, "fn"),
        count(attack, "attacks"), count(attack & hit, "attacks_hit"),
    ]


def with_rates(df: DataFrame) -> DataFrame:
    """Precision, recall, F1, false-positive rate and zero-day detection rate from confusion counts; 0 over nothing is 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return df.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "fpr": ratio(fp, fp + tn),
            "z_dr": ratio(F.col("attacks_hit"), F.col("attacks")),
        }
    )


def metrics(df: DataFrame, pred: Column, by: list[str] = (), y: str = "y", family: str = "family") -> DataFrame:
    """Confusion counts and rates of a predicate, over all rows or by group."""
    return with_rates(df.groupBy(*by).agg(*confusion(pred, y, family)))


def metrics_at(df: DataFrame, threshold: float, by: list[str] = (), score: str = "score", y: str = "y", family: str = "family") -> DataFrame:
    return metrics(df, F.col(score) >= threshold, by, y, family)


def running_totals(df: DataFrame, key: str, columns: list[str], buckets: int = 256, by: list[str] = ()) -> DataFrame:
    """``columns`` summed over all rows with the same or a larger ``key``, as columns total_<name>; keys are distinct. With
    ``by``, within each group of these columns.

    A window without a partition would put all rows into one task. Instead, rows are dealt by approximate quantiles of
    the key; each bucket is summed on its own, and the sums of the buckets above, one row each, are added.
    """
    cuts = df.approxQuantile(key, [k / buckets for k in range(1, buckets)], 1 / (2 * buckets))
    dealt = df.withColumn("_b", reached(F.col(key), sorted(set(map(float, cuts)))))
    sums = dealt.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    above = (W.partitionBy(*by) if by else W).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*by, "_b", *[F.coalesce(F.sum(f"_s_{c}").over(above), F.lit(0)).alias(f"_a_{c}") for c in columns])
    own = W.partitionBy(*by, "_b").orderBy(F.desc(key))
    out = dealt.join(sums if by else F.broadcast(sums), [*by, "_b"]).withColumns({f"total_{c}": F.sum(c).over(own) + F.col(f"_a_{c}") for c in columns})
    return out.drop("_b", *[f"_a_{c}" for c in columns])


#: Up to so many brackets a row's values are compared with literals, within generated code; more are joined.
LITERALS = 64


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float], error: float = 1 / 512) -> list[list[float] | None]:
    """For each column its interpolated quantiles, as ``percentile`` gives them, or None if it has no values.

    ``percentile`` brings a column's distinct values to one task. Here approximate quantiles enclose each exact one in a
    bracket of about 4 * ``error`` of the rows; values below are only counted, and running totals are taken within it."""
    if not columns:
        return []
    at = [str(k) for k in range(len(columns))]
    data = df.select(*[F.col(c).cast("double").alias(k) for k, c in zip(at, columns, strict=True)])
    near = data.approxQuantile(at, [x for p in shares for x in (max(0.0, p - 2 * error), min(1.0, p + 2 * error))], error)
    around = {(k, i): (near[int(k)][2 * i], near[int(k)][2 * i + 1]) for k in at if near[int(k)] for i in range(len(shares))}
    if not around:
        return [None] * len(columns)
    counts = data.agg(*[F.count(k).alias(f"n{k}") for k in at], *[F.count(F.when(F.col(k) < lo, 1)).alias(f"b{k}_{i}") for (k, i), (lo, _) in around.items()]).first()
    place = {(k, i): shares[i] * (counts[f"n{k}"] - 1) for k, i in around}
    rows = [(k, i, lo, hi, math.floor(place[k, i]) - counts[f"b{k}_{i}"], math.ceil(place[k, i]) - counts[f"b{k}_{i}"]) for (k, i), (lo, hi) in around.items()]
    table = df.sparkSession.createDataFrame(rows, "_k string, _i int, _lo double, _hi double, _low long, _high long")
    if len(around) <= LITERALS:
        held = [F.when((F.col(k) >= lo) & (F.col(k) <= hi), F.struct(F.lit(k).alias("_k"), F.lit(i).alias("_i"), F.col(k).alias("x"))) for (k, i), (lo, hi) in around.items()]
        inside = data.select(F.explode(F.array(*held)).alias("_in")).where("_in is not null").select("_in.*")
    else:
        inside = data.unpivot([], at, "k", "x").join(F.broadcast(table), (F.col("k") == F.col("_k")) & (F.col("x") >= F.col("_lo")) & (F.col("x") <= F.col("_hi"))).select("_k", "_i", "x")
    each = inside.groupBy("_k", "_i", "x").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(table), ["_k", "_i"])
    each = each.withColumn("upto", F.sum("c").over(W.partitionBy("_k", "_i").orderBy("x")))
    found = each.groupBy("_k", "_i").agg(F.min(F.when(F.col("upto") > F.col("_low"), F.col("x"))).alias("low"), F.min(F.when(F.col("upto") > F.col("_high"), F.col("x"))).alias("high"), F.min("_low").alias("first"))
    out: list[list[float] | None] = [[0.0] * len(shares) if near[int(k)] else None for k in at]
    missed = set()
    for r in found.collect():
        if r["first"] < 0 or r["high"] is None:
            missed.add(int(r["_k"]))
            continue
        p = place[r["_k"], r["_i"]]
        out[int(r["_k"])][r["_i"]] = r["low"] if r["low"] == r["high"] else (math.ceil(p) - p) * r["low"] + (p - math.floor(p)) * r["high"]
    # With fewer rows than 1 / error, the next value up can lie outside a bracket.
    for k, again in zip(sorted(missed), exact_quantiles(data, [str(k) for k in sorted(missed)], shares, 16 * error), strict=True):
        out[k] = again
    return out


def reconstruction_statistics(df: DataFrame, score: str = "memory_score", y: str = "y") -> DataFrame:
    """One row about a reconstruction score: n, positive_rate, mean, spread (population) and exact p50, p90, p95, p99."""
    shares = (0.5, 0.9, 0.95, 0.99)
    found = exact_quantiles(df, [score], list(shares))[0] or [None] * len(shares)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("positive_rate"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("spread"),
        *[F.lit(x).cast("double").alias(f"p{100 * p:.0f}") for p, x in zip(shares, found, strict=True)],
    )


def threshold_curve(df: DataFrame, score: str = "score", y: str = "y", by: list[str] = ()) -> DataFrame:
    """For each distinct score as a threshold: tp and fp at it, and the numbers of positives and negatives; with ``by``, for
    each group of these columns on its own."""
    each = df.groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg")
    )
    if by:  # read three times below
        each = stored(each, "scores")
    both = each.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    curve = running_totals(each, "threshold", ["pos", "neg"], by=by).select(*by, "threshold", "pos", "neg", F.col("total_pos").alias("tp"), F.col("total_neg").alias("fp"))
    return curve.join(both, by) if by else curve.crossJoin(F.broadcast(both))


def roc_curve(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """(threshold, fpr, tpr) for each distinct score."""
    return threshold_curve(df, score, y).select("threshold", ratio(F.col("fp"), F.col("negatives")).alias("fpr"), ratio(F.col("tp"), F.col("positives")).alias("tpr"))


def precision_recall_curve(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    return threshold_curve(df, score, y).select("threshold", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("positives")).alias("recall"))


def areas(df: DataFrame, score: str = "score", y: str = "y", by: list[str] = ()) -> DataFrame:
    """roc_auc (trapezoids between distinct scores) and average_precision (steps); null if one class is missing. With ``by``,
    a row for each group of these columns.

    A step's area needs only its own counts and the totals above it, so both are plain sums over thresholds."""
    c = threshold_curve(df, score, y, by).groupBy(*by)
    both = (F.max("positives") > 0) & (F.max("negatives") > 0)
    roc = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / (F.max("positives").cast("double") * F.max("negatives"))
    ap = F.sum(F.col("pos") * ratio(F.col("tp"), F.col("tp") + F.col("fp"))) / F.max("positives")
    return c.agg(F.when(both, roc).alias("roc_auc"), F.when(both, ap).alias("average_precision"))


def histogram(df: DataFrame, score: str = "score", bins: int = 100, by: str | None = "y") -> DataFrame:
    """Counts and densities in ``bins`` equal bins over the range of all scores; the largest score is in the last bin.
    If all scores are equal, they are in the first."""
    edges = df.agg(F.min(score).cast("double").alias("lo"), F.max(score).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(score) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    keys = [by] if by else []
    counts = df.where(F.col(score).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(*keys, place.cast("int").alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    own = F.sum("n").over(W.partitionBy(*keys))  # a row a bin
    return counts.select(*keys, "bin", (F.col("lo") + F.col("bin") * width).alias("left"), "n", ratio(F.col("n"), own * width).alias("density"))


def confusion_matrix(df: DataFrame, pred: Column, y: str = "y") -> DataFrame:
    """(y, pred, n, share of its row)."""
    n = df.groupBy(F.col(y).alias("y"), pred.cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / (F.sum("n").over(W.partitionBy("y")) + 1e-9))


def at_thresholds(df: DataFrame, thresholds: list[float], by: list[str] = (), score: str = "score", y: str = "y", family: str = "family") -> DataFrame:
    """Confusion counts and rates at each of a list of thresholds, in one pass that makes no row per threshold.

    Rows are counted by the last threshold that they reach; counts at a threshold are sums over it and those above.
    """
    cuts = sorted(set(map(float, thresholds)))
    place = reached(F.col(score), cuts)
    flags = {"real": F.col(y) == 1, "other": F.col(y) != 1, "attack": F.col(family) != "benign"}
    groups = df.groupBy(*by, place.alias("reached")).agg(*[F.sum(v.cast("long")).alias(k) for k, v in flags.items()])
    grid = df.sparkSession.createDataFrame([(k + 1, t) for k, t in enumerate(cuts)], "place int, threshold double")
    up = F.col("reached") >= F.col("place")
    total = lambda c, when, name: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).alias(name)
    return with_rates(
        groups.crossJoin(F.broadcast(grid)).groupBy(*by, "threshold").agg(
            total("real", up, "tp"), total("other", up, "fp"), total("other", ~up, "tn"), total("real", ~up, "fn"),
            F.sum("attack").alias("attacks"), total("attack", up, "attacks_hit"),
        )
    )


def fpr_drift(test: Column, calibration: Column) -> Column:
    return test / F.greatest(calibration, F.lit(1e-12))


def with_fpr_status(df: DataFrame, cap: float, fpr: str = "fpr") -> DataFrame:
    return df.withColumn("fpr_status", F.when(F.col(fpr) <= cap, "PASS").otherwise("FAIL"))


def detection_summary(families: DataFrame, z_dr: str = "z_dr", support: str = "support") -> DataFrame:
    """Mean, support-weighted mean and worst zero-day detection rate over families."""
    return families.agg(
        F.avg(z_dr).alias("macro_z_dr"),
        ratio(F.sum(F.col(z_dr) * F.col(support)), F.sum(support)).alias("weighted_z_dr"),
        F.min(z_dr).alias("worst_z_dr"),
    )


def cross_family(df: DataFrame, pred: Column, group: str = "experiment", y: str = "y", family: str = "family") -> DataFrame:
    """The rates of each experiment in long form: (experiment, metric, value)."""
    return metrics(df, pred, [group], y, family).unpivot([group], list(RATES), "metric", "value")


def feature_block_shares(gains: DataFrame, blocks: list[tuple[str, int]]) -> DataFrame:
    """Gain by block of features (feature: its number, gain): blocks are named and sized in their order."""
    first, rows = 0, []
    for name, size in blocks:
        rows.append((name, first, first + size))
        first += size
    table = gains.sparkSession.createDataFrame(rows, "block string, lo long, hi long")
    per = gains.join(F.broadcast(table), (F.col("feature") >= F.col("lo")) & (F.col("feature") < F.col("hi"))).groupBy("block").agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("features"))
    return per.withColumn("share", ratio(F.col("gain"), F.sum("gain").over(W.partitionBy())))


def top_features(gains: DataFrame, k: int = 50) -> DataFrame:
    return gains.orderBy(F.desc("gain"), "feature").limit(k)
