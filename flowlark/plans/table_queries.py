"""Queries for cleaning, scaling, metrics, thresholds, splits and samples, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import mapped, normalized_label
from ..operators import cleaning, fusion, groups, metrics, sampling, scaling, splits, thresholds
from .views import EVENT_FLOWS, SCORES, oracle, view

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the oracle's text if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SCORES)


_SCORES = f"WITH s AS ({oracle(SCORES)})"
_FLOWS = f"WITH f AS ({oracle(EVENT_FLOWS)})"

# Cleaning -------------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || ' -x  y', '\\s*-\\s*', ' - ', 'g'), '\\s+', ' ', 'g')) AS label,
 CASE WHEN p_partkey % 4 = 0 THEN 'dos' WHEN p_partkey % 4 = 1 THEN 'botnet' WHEN p_partkey % 4 = 2 THEN 'benign' END AS family FROM part""")
def label_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(x) for x in ("DoS Hulk", "Bot", "BENIGN", "unknown")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", normalized_label(F.concat("p_name", F.lit(" –x  y"))).alias("label"), mapped(raw, cleaning.FAMILIES).alias("family")
    )


@query("""SELECT row_id, CASE WHEN row_id % 7 = 0 THEN NULL ELSE x END AS x, CASE WHEN bytes < 0 THEN NULL ELSE bytes END AS bytes FROM
 (SELECT event_id AS row_id, value AS x, CAST(event_id % 9 - 3 AS DOUBLE) AS bytes FROM events)""")
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("event_id") % 14 == 0, float("inf")).when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value"))
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), odd.alias("x"), (F.col("event_id") % 9 - 3).cast("double").alias("bytes"))
    return cleaning.negatives_to_null(cleaning.infinities_to_null(df), ["bytes"])


@query("""SELECT min(event_id) AS row_id, user_id, event_type, k FROM (SELECT event_id, user_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 2 END AS k FROM events)
 GROUP BY user_id, event_type, k""")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), "user_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 2).alias("k"))
    return cleaning.drop_duplicate_rows(df)


_FLOW_COLUMNS = (
    "row_id", "source_file", "source_ip", "destination_ip", "source_port", "destination_port", "timestamp", "syn_flag_count", "ack_flag_count", "rst_flag_count",
    "fin_flag_count", "total_fwd_packets", "total_backward_packets", "total_length_of_fwd_packets", "total_length_of_bwd_packets", "protocol", "attack_family",
)


@query(f"{_FLOWS} " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER ("{c}" IS NULL) AS nulls FROM f HAVING count(*) FILTER ("{c}" IS NULL) > 0""" for c in _FLOW_COLUMNS))
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.null_counts(view(spark, sf_dir, EVENT_FLOWS))


def _roles_sql() -> str:
    """A column's role from its values: one distinct value (null is one) is constant, else numbers are numeric."""
    role = lambda c: (
        "any_value('leakage')" if c in cleaning.LEAKAGE else
        f"""CASE WHEN count(DISTINCT "{c}") + CAST(count(*) > count("{c}") AS INT) <= 1 THEN 'constant' WHEN any_value(typeof("{c}")) IN ('INTEGER', 'BIGINT', 'DOUBLE') THEN 'numeric' ELSE 'other' END"""
    )
    return f"{_FLOWS} " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {role(c)} AS role FROM f""" for c in _FLOW_COLUMNS if c not in cleaning.KEPT_APART)


@query(_roles_sql())
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = cleaning.column_schema(view(spark, sf_dir, EVENT_FLOWS))
    roles = [(c, "leakage" if c in cleaning.LEAKAGE else "constant") for c in schema["dropped_columns"]]
    roles += [(c, "numeric") for c in schema["numerical_features"]] + [(c, "other") for c in schema["categorical_features"]]
    return spark.createDataFrame(roles, "`column` string, role string")


@query("SELECT event_id, event_id AS row_id FROM events")
def dense_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.dense_ids(table(spark, sf_dir, "events").select("event_id"), ["event_id"])


@query("""SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS "timestamp" FROM orders""")
def timestamps_day_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("o_orderdate", "d/M/yyyy H:mm:ss")
    return cleaning.parse_timestamps(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("timestamp")))


@query(f"{_FLOWS} SELECT DISTINCT source_file FROM f")
def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import source_files as listed

    return listed(view(spark, sf_dir, EVENT_FLOWS))


@query(f"{_FLOWS} SELECT attack_family, count(*) AS n FROM f GROUP BY attack_family")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.group_sizes(view(spark, sf_dir, EVENT_FLOWS), ["attack_family"])


@query(f"{_SCORES} SELECT split, count(*) FILTER (family = 'benign') AS benign, count(*) FILTER (family = 'bot') AS bot, count(*) FILTER (family = 'dos') AS dos FROM s GROUP BY split")
def split_family_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.value_table(scores(spark, sf_dir), "split", ["benign", "bot", "dos"], "family")


# Scaling --------------------------------------------------------------------------------------------------------------

_SCALED = ("l_quantity", "l_extendedprice", "l_discount", "is_late_indicator", "nothing")


def scaler_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_partkey") % 13 == 0, float("inf")).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when(F.col("l_discount") < 0.02, -1.0).otherwise(F.col("l_discount")).alias("l_discount"),
        (F.col("l_partkey") % 1000 == 0).cast("double").alias("is_late_indicator"),
        F.lit(None).cast("double").alias("nothing"),
    )


def _scaler_sql() -> str:
    source = """SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN l_partkey % 11 <> 0 THEN l_quantity END AS l_quantity,
     CASE WHEN l_partkey % 13 <> 0 THEN l_extendedprice END AS l_extendedprice, CASE WHEN l_discount >= 0.02 THEN l_discount END AS l_discount,
     CASE WHEN l_partkey % 1000 = 0 THEN 1.0 ELSE 0.0 END AS is_late_indicator FROM lineitem"""
    names = _SCALED[:3]
    q = ", ".join(f"quantile_cont({c}, 0.001) AS lo_{c}, quantile_cont({c}, 0.999) AS hi_{c}" for c in names)
    clip = ", ".join(f"CASE WHEN {c} < lo_{c} THEN lo_{c} WHEN {c} > hi_{c} THEN hi_{c} ELSE {c} END AS {c}" for c in names)
    med = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in names)
    fill = ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in names)
    every = (*names, "is_late_indicator")
    mean = ", ".join(f"avg({c}) AS a_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in every)
    out = ", ".join(f"round(({c} - a_{c}) / s_{c}, 6) AS {c}" for c in every)
    return f"""WITH r AS ({source}), q AS (SELECT {q} FROM r), c AS (SELECT row_id, {clip}, is_late_indicator FROM r, q), m AS (SELECT {med} FROM c),
     f AS (SELECT row_id, {fill}, is_late_indicator FROM c, m), z AS (SELECT {mean} FROM f) SELECT row_id, {out}, 0.0::DOUBLE AS nothing FROM f, z"""


@query(_scaler_sql())
def robust_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scaler_input(spark, sf_dir)
    model = scaling.fit_robust_scaler(df, list(_SCALED), negative_is_missing=("l_discount",))
    return model.transform(df, "double").select("row_id", *[F.round(c, 6).alias(c) for c in _SCALED])


# Metrics --------------------------------------------------------------------------------------------------------------


def _confusion_sql(pred: str) -> str:
    return f"""CAST(count(*) FILTER ({pred} AND y = 1) AS BIGINT) AS tp, CAST(count(*) FILTER ({pred} AND y <> 1) AS BIGINT) AS fp,
     CAST(count(*) FILTER (NOT ({pred}) AND y <> 1) AS BIGINT) AS tn, CAST(count(*) FILTER (NOT ({pred}) AND y = 1) AS BIGINT) AS fn,
     CAST(count(*) FILTER (family <> 'benign') AS BIGINT) AS attacks, CAST(count(*) FILTER (family <> 'benign' AND ({pred})) AS BIGINT) AS attacks_hit"""


_RATES = """tp, fp, tn, fn, attacks, attacks_hit, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 9) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0.0), 9) AS recall,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 9) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0.0), 9) AS fpr, round(coalesce(attacks_hit / nullif(attacks, 0), 0.0), 9) AS z_dr"""


def _rounded(df: DataFrame, *names: str, places: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names or metrics.RATES})


@query(f"{_SCORES}, c AS (SELECT split, {_confusion_sql('score >= 0.5')} FROM s GROUP BY split) SELECT split, {_RATES} FROM c")
def metrics_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.metrics_at(scores(spark, sf_dir), 0.5, ["split"]))


@query(f"""{_SCORES}, t AS (SELECT DISTINCT score AS threshold FROM s), p AS (SELECT count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM s),
 g AS (SELECT score AS threshold, count(*) FILTER (y = 1) AS a, count(*) FILTER (y <> 1) AS b FROM s GROUP BY score),
 c AS (SELECT threshold, sum(a) OVER (ORDER BY threshold DESC) AS tp, sum(b) OVER (ORDER BY threshold DESC) AS fp FROM g)
 SELECT threshold, round(fp / neg, 9) AS fpr, round(tp / pos, 9) AS tpr FROM c, p""")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.roc_curve(scores(spark, sf_dir)), "fpr", "tpr")


@query(f"""{_SCORES}, p AS (SELECT count(*) FILTER (y = 1) AS pos FROM s), g AS (SELECT score AS threshold, count(*) FILTER (y = 1) AS a, count(*) AS n FROM s GROUP BY score),
 c AS (SELECT threshold, sum(a) OVER (ORDER BY threshold DESC) AS tp, sum(n) OVER (ORDER BY threshold DESC) AS n FROM g)
 SELECT threshold, round(tp / n, 9) AS "precision", round(tp / pos, 9) AS recall FROM c, p""")
def precision_recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.precision_recall_curve(scores(spark, sf_dir)), "precision", "recall")


@query(f"""{_SCORES}, p AS (SELECT count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM s),
 g AS (SELECT score, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (y <> 1) AS DOUBLE) AS b FROM s GROUP BY score),
 c AS (SELECT a, b, sum(a) OVER w AS tp, sum(b) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC)),
 d AS (SELECT *, coalesce(lag(tp) OVER w, 0) AS tp0 FROM c WINDOW w AS (ORDER BY tp + fp))
 SELECT round(sum(b * (tp + tp0) / 2) / (any_value(pos) * any_value(neg)), 9) AS roc_auc, round(sum(a * tp / (tp + fp)) / any_value(pos), 9) AS average_precision FROM d, p""")
def curve_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.areas(scores(spark, sf_dir)), "roc_auc", "average_precision")


@query(f"""{_SCORES}, e AS (SELECT min(score) AS lo, (max(score) - min(score)) / 100 AS w FROM s),
 b AS (SELECT y, CAST(least(floor((score - lo) / w), 99) AS INT) AS bin, lo, w FROM s, e), n AS (SELECT y, bin, lo, w, count(*) AS n FROM b GROUP BY ALL)
 SELECT y, bin, round(lo + bin * w, 9) AS "left", n, round(n / (sum(n) OVER (PARTITION BY y) * w), 6) AS density FROM n""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = metrics.histogram(scores(spark, sf_dir))
    return df.withColumns({"left": F.round("left", 9), "density": F.round("density", 6)})


@query(f"""{_SCORES}, n AS (SELECT y, CAST(score >= 0.4 AS INT) AS pred, count(*) AS n FROM s GROUP BY ALL) SELECT y, pred, n, round(n / (sum(n) OVER (PARTITION BY y) + 1e-9), 9) AS share FROM n""")
def normalized_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.confusion_matrix(scores(spark, sf_dir), F.col("score") >= 0.4), "share")


_GRID = [0.01 + 0.98 * k / 199 for k in range(200)]


@query(f"""{_SCORES}, t AS (SELECT unnest([{', '.join(map(repr, _GRID))}]::DOUBLE[]) AS threshold),
 c AS (SELECT threshold, {_confusion_sql('score >= threshold')} FROM s, t GROUP BY threshold) SELECT round(threshold, 9) AS threshold, {_RATES} FROM c""")
def threshold_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.at_thresholds(scores(spark, sf_dir), _GRID), *metrics.RATES, "threshold")


@query(f"""{_SCORES}, c AS (SELECT split, {_confusion_sql('score >= 0.6')} FROM s GROUP BY split), r AS (SELECT split, {_RATES} FROM c)
 SELECT split, fpr, CASE WHEN fpr <= 0.2 THEN 'PASS' ELSE 'FAIL' END AS fpr_status, round(fpr / greatest((SELECT fpr FROM r WHERE split = 'val'), 1e-12), 6) AS drift FROM r""")
def fpr_status_and_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.with_fpr_status(_rounded(metrics.metrics_at(scores(spark, sf_dir), 0.6, ["split"])), 0.2)
    base = rows.where("split = 'val'").select(F.col("fpr").alias("calibration"))
    return rows.crossJoin(F.broadcast(base)).select("split", "fpr", "fpr_status", F.round(metrics.fpr_drift(F.col("fpr"), F.col("calibration")), 6).alias("drift"))


@query(f"""{_SCORES}, c AS (SELECT split, {_confusion_sql('score >= 0.5')} FROM s GROUP BY split), r AS (SELECT {_RATES} FROM c)
 SELECT round(avg(z_dr), 6) AS macro_z_dr, round(sum(z_dr * attacks) / sum(attacks), 6) AS weighted_z_dr, round(min(z_dr), 6) AS worst_z_dr FROM r""")
def detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rounded(metrics.metrics_at(scores(spark, sf_dir), 0.5, ["split"]))
    return _rounded(metrics.detection_summary(rows, support="attacks"), "macro_z_dr", "weighted_z_dr", "worst_z_dr", places=6)


@query(f"""{_SCORES}, c AS (SELECT split AS experiment, {_confusion_sql('score >= 0.5')} FROM s GROUP BY split), r AS (SELECT experiment, {_RATES} FROM c)
 SELECT experiment, 'precision' AS metric, "precision" AS "value" FROM r UNION ALL SELECT experiment, 'recall', recall FROM r UNION ALL SELECT experiment, 'f1', f1 FROM r
 UNION ALL SELECT experiment, 'fpr', fpr FROM r UNION ALL SELECT experiment, 'z_dr', z_dr FROM r""")
def cross_family_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = metrics.cross_family(scores(spark, sf_dir), F.col("score") >= 0.5, "split")
    return df.select(F.col("split").alias("experiment"), "metric", F.round("value", 9).alias("value"))


@query("""WITH g AS (SELECT p_partkey % 500 AS feature, CAST(sum(p_size) AS DOUBLE) AS gain FROM part GROUP BY 1), b(block, lo, hi) AS (VALUES ('first', 0, 1), ('second', 1, 201), ('third', 201, 500))
 SELECT block, sum(gain) AS gain, count(*) AS features, round(sum(gain) / sum(sum(gain)) OVER (), 9) AS share FROM g JOIN b ON feature >= lo AND feature < hi GROUP BY block""")
def feature_block_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    gains = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 500).alias("feature")).agg(F.sum("p_size").cast("double").alias("gain"))
    return _rounded(metrics.feature_block_shares(gains, [("first", 1), ("second", 200), ("third", 299)]), "share")


# The same with a feature for each part: the last block ends with the last part.
@query("""WITH g AS (SELECT p_partkey AS feature, CAST(p_size AS DOUBLE) AS gain FROM part),
 b AS (SELECT 'first' AS block, 0 AS lo, 1 AS hi UNION ALL SELECT 'second', 1, 201 UNION ALL SELECT 'third', 201, max(p_partkey) + 1 FROM part)
 SELECT block, sum(gain) AS gain, count(*) AS features, round(sum(gain) / sum(sum(gain)) OVER (), 9) AS share FROM g JOIN b ON feature >= lo AND feature < hi GROUP BY block""")
def feature_block_shares_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    gains = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature"), F.col("p_size").cast("double").alias("gain"))
    last = gains.agg(F.max("feature")).first()[0] or 0
    return _rounded(metrics.feature_block_shares(gains, [("first", 1), ("second", 200), ("third", max(0, last - 200))]), "share")


@query("SELECT p_partkey AS feature, CAST(p_size AS DOUBLE) AS gain FROM part ORDER BY p_size DESC, p_partkey LIMIT 50")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_features(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature"), F.col("p_size").cast("double").alias("gain")))


# Thresholds -----------------------------------------------------------------------------------------------------------


def _threshold_sql(budget: float, score: str = "score") -> str:
    """Threshold and share of a budget over the benign rows of val, as one row: the number after the largest score where
    no score is rare enough."""
    pool = "FROM s WHERE split = 'val' AND family = 'benign'"
    return f"""(SELECT coalesce(min({score}) FILTER (f <= {budget!r} AND {budget!r} > 0), (SELECT nextafter(max({score}), 'infinity'::DOUBLE) {pool})) AS threshold,
     coalesce(max(f) FILTER (f <= {budget!r} AND {budget!r} > 0), 0.0) AS fpr FROM (SELECT {score}, sum(count(*)) OVER (ORDER BY {score} DESC) / sum(count(*)) OVER () AS f {pool} GROUP BY {score}))"""


@query(
    f"{_SCORES} "
    + " UNION ALL ".join(
        f"SELECT CAST({b!r} AS DOUBLE) AS target_fpr, round(threshold, 9) AS threshold, round(fpr, 9) AS calibration_fpr FROM {_threshold_sql(b)}" for b in thresholds.BUDGETS
    )
)
def budget_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = thresholds.thresholds_for_fpr(thresholds.benign_pool(scores(spark, sf_dir)), list(thresholds.BUDGETS))
    rows = [(c["target_fpr"], round(c["threshold"], 9), round(c["calibration_fpr"], 9)) for c in cuts]
    return spark.createDataFrame(rows, "target_fpr double, threshold double, calibration_fpr double")


@query(
    f"{_SCORES}, t AS ("
    + " UNION ALL ".join(f"SELECT CAST({b!r} AS DOUBLE) AS target_fpr, threshold, fpr AS calibration_fpr FROM {_threshold_sql(b)}" for b in thresholds.BUDGETS)
    + f"), c AS (SELECT target_fpr, threshold, calibration_fpr, split, {_confusion_sql('score >= threshold')} FROM s, t GROUP BY ALL) SELECT 'model' AS model_name, target_fpr, round(threshold, 9) AS threshold, round(calibration_fpr, 9) AS calibration_fpr, split, {_RATES} FROM c"
)
def single_model_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(thresholds.budget_grid(scores(spark, sf_dir)), *metrics.RATES, "threshold", "calibration_fpr")


@query(
    f"{_SCORES}, t AS ("
    + " UNION ALL ".join(f"SELECT {k} AS grid_index, CAST({b!r} AS DOUBLE) AS target_fpr, threshold, fpr AS calibration_fpr FROM {_threshold_sql(b, 'memory_score')}" for k, b in enumerate(thresholds.BUDGETS))
    + f"), c AS (SELECT grid_index, target_fpr, threshold, calibration_fpr, split, {_confusion_sql('memory_score >= threshold')} FROM s, t GROUP BY ALL) SELECT 'logistic_fusion' AS model_name, grid_index, target_fpr, round(threshold, 9) AS threshold, round(calibration_fpr, 9) AS calibration_fpr, split, {_RATES} FROM c"
)
def memory_score_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(thresholds.fusion_grid(scores(spark, sf_dir), score="memory_score"), *metrics.RATES, "threshold", "calibration_fpr")


@query()
def logistic_fusion_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of a fused score, whose logistic models and isotonic maps are fitted on the validation rows."""
    df = scores(spark, sf_dir).withColumnRenamed("score", "tree_score")
    fused = fusion.fit_fusion(df.where("split = 'val'")).transform(df)
    return thresholds.fusion_grid(fused, fallback="nextafter")


def _ways(steps: int) -> list[tuple[float, float, float, float]]:
    return [(b, k / (steps - 1), b * k / (steps - 1), b - b * k / (steps - 1)) for b in thresholds.BUDGETS for k in range(steps)]


def _either_sql(steps: int) -> str:
    """Every budget dealt between two scores in ``steps`` ways, none and all of it to either one included."""
    ways = _ways(steps)
    tables = {n: sorted({max(0.0, w[k]) for w in ways}) for n, k in (("score", 2), ("memory_score", 3))}
    cuts = ", ".join(
        f"{name[0]}_cut AS (" + " UNION ALL ".join(f"SELECT {k} AS k, * FROM {_threshold_sql(x, name)}" for k, x in enumerate(shares)) + ")"
        for name, shares in tables.items()
    )
    at = lambda name, x: tables[name].index(max(0.0, x))
    rows = ", ".join(f"({k}, {b!r}::DOUBLE, {r!r}::DOUBLE, {at('score', x)}, {at('memory_score', m)})" for k, (b, r, x, m) in enumerate(ways))
    return f"""{_SCORES}, {cuts}, ways(grid_index, target_fpr, ratio, ka, kc) AS (VALUES {rows}),
 t AS (SELECT grid_index, target_fpr, ratio, a.threshold AS ta, c.threshold AS tc, a.fpr + c.fpr AS calibration_fpr FROM ways JOIN s_cut AS a ON a.k = ka JOIN m_cut AS c ON c.k = kc),
 c AS (SELECT grid_index, target_fpr, ratio, calibration_fpr, split, {_confusion_sql('(score >= ta OR memory_score >= tc)')} FROM s, t GROUP BY ALL)"""


def either_rows(spark: SparkSession, sf_dir: str, steps: int = 11) -> DataFrame:
    return _rounded(thresholds.either_grid(scores(spark, sf_dir), steps=steps, first="score", second="memory_score"))


@query(f"{_either_sql(11)} SELECT grid_index, target_fpr, ratio, round(calibration_fpr, 9) AS calibration_fpr, split, {_RATES} FROM c")
def either_of_two_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = either_rows(spark, sf_dir)
    return df.select("grid_index", "target_fpr", "ratio", F.round("calibration_fpr", 9).alias("calibration_fpr"), "split", "tp", "fp", "tn", "fn", "attacks", "attacks_hit", *metrics.RATES)


def _picked(steps: int) -> str:
    return f"{_either_sql(steps)}, r AS (SELECT grid_index, target_fpr, ratio, calibration_fpr, split, {_RATES} FROM c), v AS (SELECT * FROM r WHERE split = 'val')"


def candidate_rows(spark: SparkSession, sf_dir: str, steps: int = 11) -> DataFrame:
    return thresholds.candidates(either_rows(spark, sf_dir, steps), ["grid_index", "target_fpr", "calibration_fpr"])


@query(f"""{_picked(11)} SELECT v.grid_index, v.f1, v.fpr AS val_fpr, z.z_dr AS test_z_dr, CASE WHEN z.fpr <= 0.05 THEN 'PASS' ELSE 'FAIL' END AS fpr_status
 FROM v JOIN r AS z ON z.grid_index = v.grid_index AND z.split = 'test_zero_day'
 ORDER BY v.fpr > 0.05, CASE WHEN v.fpr > 0.05 THEN v.fpr END, v.f1 DESC, v.z_dr DESC, v.fpr, v.target_fpr, v.grid_index LIMIT 1""")
def primary_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = thresholds.primary_candidate(candidate_rows(spark, sf_dir))
    return best.select("grid_index", F.col("validation.f1").alias("f1"), F.col("validation.fpr").alias("val_fpr"), F.col("test_zero_day.z_dr").alias("test_z_dr"), "fpr_status")


@query(f"{_picked(21)} SELECT grid_index, recall, fpr FROM v WHERE fpr <= 0.05 ORDER BY recall DESC, grid_index LIMIT 10")
def fine_grid_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = thresholds.top_by_recall(candidate_rows(spark, sf_dir, 21), 0.05)
    return top.select("grid_index", F.col("validation.recall").alias("recall"), F.col("validation.fpr").alias("fpr"))


@query(f"{_picked(11)} SELECT grid_index, z_dr, fpr FROM v WHERE fpr <= 0.03 ORDER BY z_dr DESC, grid_index LIMIT 1")
def best_under_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = thresholds.best_under(candidate_rows(spark, sf_dir), 0.03)
    return best.select("grid_index", F.col("validation.z_dr").alias("z_dr"), F.col("validation.fpr").alias("fpr"))


@query(f"{_picked(11)} SELECT grid_index, target_fpr, f1 FROM v WHERE target_fpr = 0.05 ORDER BY f1 DESC, z_dr DESC, fpr, grid_index LIMIT 1")
def budget_row_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.budget_row(candidate_rows(spark, sf_dir), 0.05).select("grid_index", "target_fpr", F.col("validation.f1").alias("f1"))


@query(f"""{_picked(11)} SELECT v.grid_index, v.target_fpr, round(v.calibration_fpr, 9) AS calibration_fpr, v.z_dr AS validation_z_dr, v.fpr AS validation_fpr, v.f1 AS validation_f1, t.z_dr AS test_seen_z_dr,
 z.z_dr AS test_zero_day_z_dr, z.fpr AS test_zero_day_fpr, z.f1 AS test_zero_day_f1 FROM v JOIN r AS t ON t.grid_index = v.grid_index AND t.split = 'test_seen' JOIN r AS z ON z.grid_index = v.grid_index AND z.split = 'test_zero_day'""")
def flattened_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = thresholds.flattened(candidate_rows(spark, sf_dir)).withColumn("calibration_fpr", F.round("calibration_fpr", 9))
    return wide.select("grid_index", "target_fpr", "calibration_fpr", *[f"{s}_{m}" for s, ms in (("validation", ("z_dr", "fpr", "f1")), ("test_seen", ("z_dr",)), ("test_zero_day", ("z_dr", "fpr", "f1"))) for m in ms])


@query(f"""{_SCORES}, t AS (SELECT unnest(range(99)) AS k), c AS (SELECT k, count(*) FILTER (score >= 0.01 + 0.98 * k / 98 AND y = 1) AS tp, count(*) FILTER (score >= 0.01 + 0.98 * k / 98 AND y <> 1) AS fp,
 count(*) FILTER (score < 0.01 + 0.98 * k / 98 AND y = 1) AS fn FROM s, t GROUP BY k) SELECT round(0.01 + 0.98 * k / 98, 6) AS threshold FROM c ORDER BY 2 * tp / (2 * tp + fp + fn) DESC, k LIMIT 1""")
def best_f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(thresholds.best_f1_threshold(scores(spark, sf_dir)), 6),)], "threshold double")


@query(f"{_SCORES} SELECT row_id, score FROM s WHERE family = 'benign' AND split IN ('val', 'test_seen')")
def calibration_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.benign_pool(scores(spark, sf_dir), "val_plus_test_seen").select("row_id", "score")


# Splits, samples, fusion ----------------------------------------------------------------------------------------------


@query()
def leave_one_family_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = view(spark, sf_dir, EVENT_FLOWS)
    grouped = flows.withColumn("source_ip", F.concat("source_ip", F.lit("-"), F.floor(F.col("row_id") / 50)))
    done = splits.leave_one_family_out(grouped, "dos")
    splits.check_split(done, "dos")
    return done.select("row_id", "attack_family", "split")


@query("""WITH g AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%') SELECT c_custkey, c_custkey IN (SELECT k FROM g) AS urgent FROM customer""")
def group_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    inside, outside = groups.rows_in(customers, urgent, ["c_custkey"]), groups.rows_not_in(customers, urgent, ["c_custkey"])
    return groups.under_each_other([inside.withColumn("urgent", F.lit(True)), outside.withColumn("urgent", F.lit(False))])


@query(f"{_SCORES} SELECT family, count(*) AS n FROM s WHERE y = 1 AND family <> 'benign' GROUP BY family HAVING count(*) >= 100")
def qualified_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.qualified_families(scores(spark, sf_dir), 100)


@query(f"{_FLOWS} SELECT source_file, CAST(greatest(1, round_even(count(*) * 0.1, 0)) AS BIGINT) AS n FROM f GROUP BY source_file")
def sample_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_per_file(view(spark, sf_dir, EVENT_FLOWS), 0.1).groupBy("source_file").agg(F.count("*").alias("n"))


@query(f"""{_FLOWS}, c AS (SELECT attack_family, count(*) AS n FROM f GROUP BY attack_family), a AS (SELECT sum(least(n, 300)) AS n FROM c WHERE attack_family <> 'benign')
 SELECT attack_family, CAST(least(c.n, CASE WHEN attack_family = 'benign' THEN floor(a.n * 2.5) ELSE 300 END) AS BIGINT) AS n FROM c, a""")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balanced_sample(view(spark, sf_dir, EVENT_FLOWS), 300, 2.5, family="attack_family").groupBy("attack_family").agg(F.count("*").alias("n"))


def _fusion_sql() -> str:
    clip = "least(greatest(x, 1e-6), 1 - 1e-6)"
    grown = "ln(1 + greatest(m, 0))"
    squashed = f"tanh({grown} / 10)"
    values = ("x", f"ln({clip} / (1 - {clip}))", "m", grown, f"x * {grown}", f"greatest(x, {squashed})", "abs(x - m)", f"least(x, {squashed})")
    out = ", ".join(f"round({v}, 6) AS fusion_{n}" for n, v in zip(fusion.NAMES, values, strict=True))
    return f"{_SCORES}, q AS (SELECT row_id, score AS x, memory_score AS m FROM s) SELECT row_id, {out} FROM q"


@query(_fusion_sql())
def fusion_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fusion.with_fusion_features(scores(spark, sf_dir), "score")
    return df.select("row_id", *[F.round(f"fusion_{n}", 6).alias(f"fusion_{n}") for n in fusion.NAMES])


@query(f"{_SCORES} SELECT count(*) AS n, round(avg(y), 9) AS positive_rate, round(avg(memory_score), 6) AS mean, round(stddev_pop(memory_score), 6) AS spread, round(quantile_cont(memory_score, 0.5), 6) AS p50, round(quantile_cont(memory_score, 0.9), 6) AS p90, round(quantile_cont(memory_score, 0.95), 6) AS p95, round(quantile_cont(memory_score, 0.99), 6) AS p99 FROM s")
def reconstruction_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _rounded(metrics.reconstruction_statistics(scores(spark, sf_dir)), "mean", "spread", "p50", "p90", "p95", "p99", places=6)
    return df.withColumn("positive_rate", F.round("positive_rate", 9))


@query()
def memory_autoencoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import models

    names = list(_SCALED[:3])
    df = scaler_input(spark, sf_dir)
    scaled = scaling.fit_robust_scaler(df, names).transform(df, "double")
    model = models.fit_memory_autoencoder(scaled, names)
    return model.reconstruction_error(scaled, names)


@query()
def fusion_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scores(spark, sf_dir).withColumnRenamed("score", "tree_score")
    return fusion.fit_fusion(df.where("split = 'train'")).transform(df).select("row_id", "split", F.col("fusion_score").cast("double").alias("fusion_score"))


@query()
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import models

    df = scores(spark, sf_dir)
    model = models.fit_trees(df.where("split = 'train'"), ["score", "memory_score"])
    return models.tree_scores(model, df).select("row_id", "tree_score")



# Set operations and groups --------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"))
    return groups.under_each_other([customers, suppliers])


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.group_sizes(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"]).drop("n")


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 25")
def largest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.group_sizes(table(spark, sf_dir, "lineitem"), ["l_suppkey"], 25)


@query(f"""{_FLOWS} SELECT '{{"source_ip":"' || source_ip || '","destination_ip":"' || destination_ip || '"}}' AS key FROM f GROUP BY source_ip, destination_ip HAVING min(row_id % 2) <> max(row_id % 2)""")
def groups_in_two_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = view(spark, sf_dir, EVENT_FLOWS).withColumn("split", F.col("row_id") % 2)
    return splits.overlapping_groups(labelled, ("source_ip", "destination_ip")).select("key")


# The same by source: those before u5 are whole in one split, by their last digit.
_EVERY_SPLIT = "CASE WHEN source_ip < 'u5' THEN CAST(right(source_ip, 1) AS INT) % 2 ELSE row_id % 2 END"


@query(f"{_FLOWS}, s AS (SELECT source_ip, {_EVERY_SPLIT} AS split FROM f) SELECT '{{\"source_ip\":\"' || source_ip || '\"}}' AS key FROM s GROUP BY source_ip HAVING min(split) <> max(split)")
def groups_in_two_splits_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = view(spark, sf_dir, EVENT_FLOWS).withColumn("split", F.expr(_EVERY_SPLIT))
    return splits.overlapping_groups(labelled, ("source_ip",)).select("key")


@query(f"{_SCORES} SELECT row_id, score FROM s WHERE row_id IN (SELECT row_id FROM s WHERE split = 'val' AND y = 1)")
def rows_by_id_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    return groups.rows_in(rows.select("row_id", "score"), rows.where("split = 'val' and y = 1"), ["row_id"])
