"""Thresholds for false-positive budgets, grids of candidates, and their selection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored
from .metrics import at_thresholds, exact_quantiles, fpr_drift, reached, running_totals, with_rates

BUDGETS = (0.001, 0.005, 0.01, 0.02, 0.05)
JITTER = 1e-7


def threshold_for_fpr(scores: DataFrame, target: float, score: str = "score", jitter: bool = False, fallback: str = "nextafter") -> dict[str, float]:
    """The smallest observed score that at most ``target`` of the scores reach.

    A target of 0, or none that is low enough, gives the number after the largest score; with ``fallback`` "percentile"
    the interpolated quantile is tried before. ``jitter`` parts scores of at most ten distinct values by less than 1e-7,
    by a hash. Scores that are missing or not finite are an error, as are targets beyond 0 and 1.
    """
    return thresholds_for_fpr(scores, [target], score, jitter, fallback)[0]


def thresholds_for_fpr(scores: DataFrame, targets: list[float], score: str = "score", jitter: bool = False, fallback: str = "nextafter") -> list[dict[str, float]]:
    """``threshold_for_fpr`` for several targets, from one count of the scores."""
    if not all(0 <= t <= 1 for t in targets):
        raise ValueError("targets must lie between 0 and 1")
    if fallback not in ("nextafter", "percentile"):
        raise ValueError(f"unknown fallback: {fallback}")
    s = F.col(score).cast("double")
    bad = F.col("s").isNull() | F.isnan("s") | (F.abs("s") == float("inf"))
    count = lambda scores, s: stored(scores.groupBy(s.alias("s")).agg(F.count(F.lit(1)).alias("n")), "score-counts")
    counts = count(scores, s)  # the one pass over the rows
    n, broken, top, few = counts.agg(F.sum("n"), F.sum(F.when(bad, F.col("n"))), F.max("s"), F.count(F.lit(1))).first()
    if not n or broken:
        raise ValueError("finite scores are needed")
    if jitter and few <= 10:
        noise = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(42)), F.lit(1 << 30)) / (1 << 30) * JITTER
        scores, s = stored(scores.select((s + noise).alias("_jittered")), "jittered"), F.col("_jittered")
        counts = count(scores, s)
        top = counts.agg(F.max("s")).first()[0]
    share = F.col("total_n") / n
    least = [F.min_by(F.struct("s", "total_n"), F.when(share <= t, F.col("s"))).alias(f"t{k}") for k, t in enumerate(targets)]
    reached = [F.min(F.when(share <= t, F.col("s"))).isNotNull().alias(f"r{k}") for k, t in enumerate(targets)]
    found = running_totals(counts, "s", ["n"]).agg(*least, *reached).first()
    beyond = math.nextafter(top, math.inf)
    out = []
    for k, t in enumerate(targets):
        cut, fpr = (found[f"t{k}"].s, found[f"t{k}"].total_n / n) if t > 0 and found[f"r{k}"] else (beyond, 0.0)
        if t > 0 and cut == beyond and fallback == "percentile":
            tried = exact_quantiles(scores.select(s.alias("s")), ["s"], [1 - t])[0][0]
            over = scores.agg(F.avg((s >= tried).cast("double"))).first()[0]
            cut, fpr = (tried, over) if over <= t else (cut, fpr)
        out.append({"threshold": cut, "calibration_fpr": fpr, "target_fpr": t})
    return out


def benign_pool(df: DataFrame, mode: str = "val_only", split: str = "split", family: str = "family", validation: str = "val") -> DataFrame:
    """The benign rows that thresholds are calibrated on: of the validation split, or of it and test_seen."""
    splits = {"val_only": [validation], "val_plus_test_seen": [validation, "test_seen"]}
    if mode not in splits:
        raise ValueError(f"unknown mode: {mode}")
    return df.where(F.col(split).isin(splits[mode]) & (F.col(family) == "benign"))


def best_f1_threshold(df: DataFrame, low: float = 0.01, high: float = 0.99, steps: int = 99, score: str = "score", y: str = "y") -> float:
    """The lowest of the evenly spaced thresholds with the best F1; 0.5 if none has any."""
    grid = [low + (high - low) * k / max(1, steps - 1) for k in range(steps)]
    rows = at_thresholds(df.withColumn("family", F.lit("benign")), grid, score=score, y=y).where("f1 > 0")
    best = rows.orderBy(F.desc("f1"), "threshold").first()
    return best.threshold if best else 0.5


def budget_grid(df: DataFrame, budgets=BUDGETS, score: str = "score", mode: str = "val_only", model: str = "model", validation: str = "val", **kw) -> DataFrame:
    """One model: for each budget the threshold from the benign pool and its metrics on every split."""
    cuts = thresholds_for_fpr(benign_pool(df, mode, validation=validation), list(budgets), score, **kw)
    table = df.sparkSession.createDataFrame([(model, b, c["threshold"], c["calibration_fpr"]) for b, c in zip(budgets, cuts, strict=True)], "model_name string, target_fpr double, threshold double, calibration_fpr double")
    return table.join(at_thresholds(df, [c["threshold"] for c in cuts], ["split"], score), "threshold")


def either_grid(df: DataFrame, budgets=BUDGETS, steps: int = 11, first: str = "tree_score", second: str = "memory_score", mode: str = "val_only", y: str = "y", family: str = "family", validation: str = "val", **kw) -> DataFrame:
    """Two scores joined by OR: each budget is dealt between them in ``steps`` ways; a row per way and split.

    Thresholds are taken once for each distinct share. Rows of the data are counted by split and by the last threshold of
    either score that they reach, in one aggregation; a way's counts are sums over these cells, which are few.
    """
    pool = benign_pool(df, mode, validation=validation)
    ways = [(b, k / (steps - 1), b * k / (steps - 1), b - b * k / (steps - 1)) for b in budgets for k in range(steps)]
    found: dict[str, dict[float, dict]] = {}
    for name, place in ((first, 2), (second, 3)):
        shares = sorted({max(0.0, w[place]) for w in ways})
        found[name] = dict(zip(shares, thresholds_for_fpr(pool, shares, name, **kw), strict=True))
    cuts = {name: sorted({float(c["threshold"]) for c in cut.values()}) for name, cut in found.items()}
    rows = []
    for k, (b, r, x, m) in enumerate(ways):
        a, c = found[first][max(0.0, x)], found[second][max(0.0, m)]
        places = [cuts[n].index(float(t["threshold"])) + 1 for n, t in ((first, a), (second, c))]
        rows.append((k, "or_fusion", b, r, a["threshold"], c["threshold"], a["calibration_fpr"] + c["calibration_fpr"], *places))
    schema = "grid_index int, model_name string, target_fpr double, ratio double, first_threshold double, second_threshold double, calibration_fpr double, _first int, _second int"
    table = df.sparkSession.createDataFrame(rows, schema)
    flags = {"real": F.col(y) == 1, "other": F.col(y) != 1, "attack": F.col(family) != "benign"}
    cells = df.groupBy("split", reached(F.col(first), cuts[first]).alias("_i"), reached(F.col(second), cuts[second]).alias("_j"))
    cells = cells.agg(*[F.sum(v.cast("long")).alias(k) for k, v in flags.items()])
    pred = (F.col("_i") >= F.col("_first")) | (F.col("_j") >= F.col("_second"))
    total = lambda c, when, name: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).alias(name)
    counts = cells.crossJoin(F.broadcast(table)).groupBy("grid_index", "split").agg(
        total("real", pred, "tp"), total("other", pred, "fp"), total("other", ~pred, "tn"), total("real", ~pred, "fn"),
        F.coalesce(F.sum("attack"), F.lit(0)).alias("attacks"), total("attack", pred, "attacks_hit"),
    )
    return table.drop("_first", "_second").join(with_rates(counts), "grid_index")


def fusion_grid(df: DataFrame, budgets=BUDGETS, score: str = "fusion_score", mode: str = "val_only", validation: str = "val", **kw) -> DataFrame:
    """The fused score's rows of the grid, numbered like those of the others."""
    grid = budget_grid(df, budgets, score, mode, "logistic_fusion", validation, **kw)
    place = {b: k for k, b in enumerate(budgets)}
    number = F.coalesce(*[F.when(F.col("target_fpr") == b, F.lit(k)) for b, k in place.items()])
    return grid.withColumn("grid_index", number)


def flattened(rows: DataFrame) -> DataFrame:
    """Candidates with their structs as columns <split>_<metric>, as reports and CSV files need them."""
    flat = []
    for f in rows.schema.fields:
        inner = getattr(f.dataType, "fieldNames", None)
        flat += [F.col(f"{f.name}.{x}").alias(f"{f.name}_{x}") for x in inner()] if inner else [F.col(f.name)]
    return rows.select(*flat)


def candidates(grid: DataFrame, keys: list[str], validation: str = "val") -> DataFrame:
    """A row per candidate: its keys and its metrics as structs validation, test_seen and test_zero_day, with FPR drift."""
    fields = F.struct("z_dr", "fpr", "f1", "recall", "precision")
    at = lambda split, name: F.max(F.when(F.col("split") == split, fields)).alias(name)
    out = grid.groupBy(*keys).agg(at(validation, "validation"), at("test_seen", "test_seen"), at("test_zero_day", "test_zero_day"))
    return out.withColumn("fpr_drift", fpr_drift(F.col("test_zero_day.fpr"), F.col("calibration_fpr")))


def best_of(df: DataFrame, *order: Column) -> DataFrame:
    """The first row in an order, which must leave no ties."""
    return df.orderBy(*order).limit(1)


def top_by_recall(rows: DataFrame, cap: float, k: int = 10) -> DataFrame:
    """The fine grid's best: validation FPR within the cap, the most recall on validation, ties by place in the grid."""
    return rows.where(F.col("validation.fpr") <= cap).orderBy(F.desc("validation.recall"), "grid_index").limit(k)


def best_under(rows: DataFrame, cap: float = 0.01) -> DataFrame:
    """The candidate with the best zero-day detection under a validation FPR; no row if none is."""
    return best_of(rows.where(F.col("validation.fpr") <= cap), F.desc("validation.z_dr"), F.asc("grid_index"))


def budget_row(rows: DataFrame, budget: float) -> DataFrame:
    """The row for a budget: of that very budget, else of a validation FPR within it, else the nearest FPR to it."""
    exact, within = F.col("target_fpr") == budget, F.col("validation.fpr") <= budget
    kind = F.when(exact, 0).when(within, 1).otherwise(2)
    far = F.when(kind == 2, F.abs(F.col("validation.fpr") - budget)).otherwise(0.0)
    return best_of(rows, kind.asc(), far.asc(), F.desc("validation.f1"), F.desc("validation.z_dr"), F.asc("validation.fpr"), F.asc("grid_index"))


def primary_candidate(rows: DataFrame, cap: float = 0.05) -> DataFrame:
    """The candidate to report: of those with a validation FPR within the cap, by F1, detection, lower FPR and lower
    budget on validation; if there are none, the lowest validation FPR. Its test FPR passes or fails the cap."""
    within = F.col("validation.fpr") <= cap
    order = [within.desc(), F.when(~within, F.col("validation.fpr")).asc(), F.desc("validation.f1"), F.desc("validation.z_dr"), F.asc("validation.fpr"), F.asc("target_fpr"), F.asc("grid_index")]
    return best_of(rows, *order).withColumn("fpr_status", F.when(F.col("test_zero_day.fpr") <= cap, "PASS").otherwise("FAIL"))


def validation_split(splits: DataFrame) -> str:
    """model_selection_val where it has rows, else val."""
    return "val" if splits.where("split = 'model_selection_val'").isEmpty() else "model_selection_val"
