"""Window queries, and the plain window SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import OFF, SHIPPED
from ..operators.windows import FEATURES, add_window_features, feature_names, scoped_window_features
from .views import DENSE_FLOWS, EVENT_FLOWS, LINE_FLOWS, LINE_ORDER, oracle, view

ALL_ON = dict.fromkeys(OFF, True)
_METHOD = "spark.sql.codegen.hugeMethodLimit"
COLLECTING = ("single_dest_ratio", "dest_ip_concentration")


def _recipe(rows: list[int], seconds: list[int], **more) -> dict:
    return {**ALL_ON, "window_sizes": rows, "time_window_seconds": seconds, **more}


def _flows(spark: SparkSession, sf_dir: str, flows: str) -> DataFrame:
    """The flows, for a query of many features. Java's compiler leaves methods of more than 8000 bytes interpreted, and one
    projection of all features is such a method; with Spark's limit set there, it is cut into small ones instead."""
    if spark.conf.get(_METHOD) == "65535":
        spark.conf.set(_METHOD, "8000")
    return view(spark, sf_dir, flows)


def sixth(x: Column) -> Column:
    """``F.round(x, 6)``, which goes through a decimal of the number's digits: it is left to the numbers that are large or
    near the middle of two results. Elsewhere the nearest whole number of millionths is known, and its quotient is exact."""
    scaled = x * 1e6
    whole = F.rint(scaled)
    return F.when((F.abs(scaled) < float(1 << 44)) & (F.abs(scaled - whole) < 0.49), whole / 1e6 + 0.0).otherwise(F.round(x, 6))


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("row_id", *[sixth(F.col(n)).alias(n) for n in names])


def _query(flows: str, recipe: dict, names: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(add_window_features(_flows(spark, sf_dir, flows), recipe, "double", names), names)

    return run


_G = "PARTITION BY source_file, source_ip"


def _prelude(flows: str) -> str:
    order = ", ".join(f'"{c}" NULLS LAST' for c in (LINE_ORDER if flows is LINE_FLOWS else ["timestamp", "row_id"]))
    return f"""
WITH flows AS ({oracle(flows)}),
a AS (SELECT *, row_number() OVER ({_G} ORDER BY {order}) AS rn, CAST(floor(epoch("timestamp")) AS BIGINT) AS t,
      coalesce(destination_port, -1) AS dp, coalesce(source_port, -1) AS sp, coalesce(destination_ip, 'missing') AS di,
      coalesce(total_fwd_packets + total_backward_packets, 0) AS packets, coalesce(total_length_of_fwd_packets + total_length_of_bwd_packets, 0) AS bytes FROM flows),
b AS (SELECT *, t * 2097152 + row_number() OVER ({_G}, t ORDER BY rn) - 1 AS k, coalesce(t - lag(t) OVER ({_G} ORDER BY rn), 0) AS gap,
      lag(dp) OVER ({_G} ORDER BY rn) AS was FROM a),
c AS (SELECT *, gap * gap AS gap2, CASE WHEN rn > 1 AND gap <= 1 THEN 1 ELSE 0 END AS quick, CASE WHEN dp <> was THEN 1 ELSE 0 END AS switch,
      CASE WHEN dp = was + 1 THEN 1 ELSE 0 END AS follows, CASE WHEN dp >= 1024 THEN 1 ELSE 0 END AS high, CASE WHEN packets <= 6 THEN 1 ELSE 0 END AS short,
      CASE WHEN bytes <= 512 THEN 1 ELSE 0 END AS small, CASE WHEN syn_flag_count > ack_flag_count THEN 1 ELSE 0 END AS syn_led,
      CASE WHEN rst_flag_count > ack_flag_count THEN 1 ELSE 0 END AS rst_led FROM b)
"""


def _formulas(kind: str, size: int) -> dict[str, str]:
    """Each feature over its own plain frame."""

    def over(*values: str) -> str:
        frame = f"ORDER BY k RANGE BETWEEN {size * 2097152 + 1048575} PRECEDING AND CURRENT ROW" if kind == "t" else f"ORDER BY rn RANGE BETWEEN {size - 1} PRECEDING AND CURRENT ROW"
        return f"OVER ({_G}{''.join(', ' + v for v in values)} {frame})"

    n = f"CAST(count(*) {over()} AS DOUBLE)"
    total = lambda x: f"CAST(sum({x}) {over()} AS DOUBLE)"
    count = lambda *v: f"CAST(count(*) {over(*v)} AS DOUBLE)"
    distinct = lambda v: f"CAST(count(DISTINCT {v}) {over()} AS DOUBLE)"
    flag = lambda x: f"{total(x + '_flag_count')} / " + (f"({total('ack_flag_count')} + 1e-6)" if kind == "r" else f"greatest({total('ack_flag_count')}, 1e-6)")
    mean = f"({total('gap')} / {n})"
    cv = f"(CASE WHEN {n} <= 1 THEN 0.0 ELSE sqrt(greatest(0.0, {total('gap2')} / {n} - {mean} * {mean})) / greatest({mean}, 1e-6) END)"
    entropy = lambda v: f"entropy({v}) {over()}"
    return {
        "flow_count": n,
        "unique_destination_port": distinct("dp"),
        "destination_port_count": count("dp"),
        "unique_destination_ip": distinct("di"),
        "destination_ip_count": count("di"),
        "destination_service_count": count("di", "dp"),
        "unique_destination_port_ratio": f"{distinct('dp')} / {n}",
        "same_destination_port_ratio": f"{count('dp')} / {n}",
        "new_destination_port_indicator": f"CASE WHEN {count('dp')} <= 1 THEN 1.0 ELSE 0.0 END",
        "packets_sum": total("packets"),
        "bytes_sum": total("bytes"),
        "syn_ratio": flag("syn"),
        "rst_ratio": flag("rst"),
        "fin_ratio": flag("fin"),
        "port_switch_ratio": f"{total('switch')} / {n}",
        "short_flow_ratio": f"{total('short')} / {n}",
        "small_bytes_ratio": f"{total('small')} / {n}",
        "syn_dominant_ratio": f"{total('syn_led')} / {n}",
        "rst_dominant_ratio": f"{total('rst_led')} / {n}",
        "burst_count": total("quick"),
        "dest_repeat_ratio": f"{count('di')} / {n}",
        "source_port_repeat_ratio": f"{count('sp')} / {n}",
        "source_dest_port_pair_repeat_ratio": f"{count('sp', 'dp')} / {n}",
        "low_slow_repeat_count": total("(short * small)"),
        "port_entropy": entropy("dp"),
        "port_concentration": f"1 - {distinct('dp')} / {n}",
        "sequential_port_ratio": f"{total('follows')} / {n}",
        "high_port_ratio": f"{total('high')} / {n}",
        "inter_arrival_cv": cv,
        "inter_arrival_regularity": f"1 / (1 + {cv})",
        "beaconing_score": f"1 / (1 + {cv}) * {n} / {size}",
        "dest_ip_entropy": entropy("di"),
        "port_per_dest_ip": f"{distinct('dp')} / {distinct('di')}",
    }


def _sql(flows: str, names: list[str]) -> str:
    columns = []
    for name in names:
        kind, _, rest = name.partition("_")
        stem, _, size = rest.rpartition("_")
        columns.append(f"round(CAST({_formulas(kind[0].replace('w', 'r'), int(size.rstrip('s')))[stem]} AS DOUBLE), 6) AS {name}")
    return f"{_prelude(flows)} SELECT row_id, {', '.join(columns)} FROM c"


def _named(recipe: dict, only=None) -> list[str]:
    names = [n for n in feature_names(recipe) if not n.startswith("ctx_") and not any(c in n for c in COLLECTING)]
    return [n for n in names if only is None or any(k in n for k in only)]


_BASIC = ("flow_count", "unique_destination", "destination_port_count", "_ip_count", "service_count", "same_dest", "new_dest", "sum_", "syn_ratio", "rst_ratio", "fin_ratio")
_BEHAVIOUR = ("switch", "short_flow", "small_bytes", "dominant", "burst", "repeat")
_SHAPE = ("entropy", "concentration", "sequential", "high_port", "inter_arrival", "beaconing", "port_per")
DAY = 86400
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, flows: str, recipe: dict, only: tuple[str, ...] | None) -> None:
    names = _named(recipe, only)
    QUERIES[name] = _query(flows, recipe, names)
    ORACLE_SQL[name] = _sql(flows, names)


for _part, _only in (("", _BASIC), ("_behaviour", _BEHAVIOUR), ("_shape", _SHAPE)):
    _add(f"window_count_features{_part}", EVENT_FLOWS, _recipe([5, 50], []), _only)
    _add(f"window_time_features{_part}", EVENT_FLOWS, _recipe([], [DAY, 14 * DAY]), _only)
    _add(f"window_ties_count{_part}", LINE_FLOWS, _recipe([30], [], order_by=LINE_ORDER), _only)
    _add(f"window_ties_time{_part}", LINE_FLOWS, _recipe([], [30 * DAY], order_by=LINE_ORDER), _only)
_add("window_shipped_recipe", EVENT_FLOWS, SHIPPED, None)
_add("window_dense_host", DENSE_FLOWS, _recipe([], [600]), ("flow_count", "unique_destination_port_6", "_ip_count", "bytes_sum", "dest_ip_entropy", "inter_arrival_cv"))


def window_dense_host_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features over frames of an hour that hold the whole table in the end."""
    recipe = _recipe([1000], [3600])
    names = [n for n in feature_names(recipe) if not n.startswith("ctx_")]
    return _rounded(add_window_features(_flows(spark, sf_dir, DENSE_FLOWS), recipe, "double", names), names)


QUERIES["window_dense_host_all"] = window_dense_host_all


def window_largest_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipe = _recipe([20], [7 * DAY])
    names = [n for n in feature_names(recipe) if any(c in n for c in COLLECTING)]
    return _rounded(add_window_features(_flows(spark, sf_dir, EVENT_FLOWS), recipe, "double", names), names)


def _largest(kind: str, bound: str) -> str:
    return f"""(SELECT max(n) FROM (SELECT count(*) AS n FROM c AS o WHERE o.source_file = c.source_file AND o.source_ip = c.source_ip AND o.{kind} <= c.{kind} AND o.{kind} >= c.{kind} - {bound} GROUP BY o.di))
     / CAST((SELECT count(*) FROM c AS o WHERE o.source_file = c.source_file AND o.source_ip = c.source_ip AND o.{kind} <= c.{kind} AND o.{kind} >= c.{kind} - {bound}) AS DOUBLE)"""


QUERIES["window_largest_frequency"] = window_largest_frequency
_time = _largest("k", str(7 * DAY * 2097152 + 1048575))
ORACLE_SQL["window_largest_frequency"] = f"""{_prelude(EVENT_FLOWS)} SELECT row_id, round({_largest('rn', '19')}, 6) AS win_single_dest_ratio_20,
 round({_time}, 6) AS time_single_dest_ratio_{7 * DAY}s, round({_time}, 6) AS time_dest_ip_concentration_{7 * DAY}s FROM c"""


def context_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipe = _recipe([5], [], include_flow_count=True)
    names = [n for n in feature_names(recipe) if n.startswith("ctx_")]
    return add_window_features(_flows(spark, sf_dir, EVENT_FLOWS), recipe, "double", names).select("row_id", *names)


def _context_sql() -> str:
    from ..functions.config import DEFAULTS

    yes = lambda x, name: f"CASE WHEN {x} THEN 1.0 ELSE 0.0 END AS {name}"
    out = []
    for side, p in (("dest", "dp"), ("source", "sp")):
        out += [yes(f"{p} < 1024", f"ctx_{side}_port_is_system"), yes(f"{p} >= 1024 AND {p} < 49152", f"ctx_{side}_port_is_registered"), yes(f"{p} >= 49152", f"ctx_{side}_port_is_dynamic")]
        out += [yes(f"{p} IN ({', '.join(map(str, ports))})", f"ctx_{'source_' if side == 'source' else ''}service_{name}") for name, ports in sorted(DEFAULTS["service_family_ports"].items())]
        out += [yes(f"{p} = 8080", f"ctx_{side}_port_8080")]
    out.append(yes("sp = dp", "ctx_source_dest_same_port"))
    return f"{_prelude(EVENT_FLOWS)} SELECT row_id, {', '.join(out)} FROM c"


QUERIES["context_features"] = context_features
ORACLE_SQL["context_features"] = _context_sql()

_SPLIT = "CASE row_id % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'model_selection_val' WHEN 2 THEN 'val' WHEN 3 THEN 'test_seen' ELSE 'test_zero_day' END"


def _scope(scope: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _flows(spark, sf_dir, EVENT_FLOWS)
        names = ["win_flow_count_25", "win_unique_destination_port_25", "win_packets_sum_25"]
        made = scoped_window_features(df, df.select("row_id", F.expr(_SPLIT).alias("split")), scope, _recipe([25], []), "double", names)
        return made.select("row_id", "split", *names)

    return run


def _scope_sql(seen: str) -> str:
    frame = "OVER (PARTITION BY seer, source_file, source_ip ORDER BY \"timestamp\" NULLS LAST, row_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)"
    return f"""
WITH f AS (SELECT *, {_SPLIT} AS split FROM ({oracle(EVENT_FLOWS)})),
s(seer, place) AS (VALUES ('train', 0), ('model_selection_val', 1), ('val', 2), ('test_seen', 3), ('test_zero_day', 4)),
v AS (SELECT f.*, s.seer FROM f JOIN s AS own ON own.seer = f.split JOIN s ON {seen}),
w AS (SELECT row_id, split, seer, CAST(count(*) {frame} AS DOUBLE) AS win_flow_count_25, CAST(count(DISTINCT coalesce(destination_port, -1)) {frame} AS DOUBLE) AS win_unique_destination_port_25,
      CAST(sum(coalesce(total_fwd_packets + total_backward_packets, 0)) {frame} AS DOUBLE) AS win_packets_sum_25 FROM v)
SELECT row_id, split, win_flow_count_25, win_unique_destination_port_25, win_packets_sum_25 FROM w WHERE seer = split"""


for _scope_name, _seen in (
    ("full_source_file", "true"),
    ("split_only", "s.place = own.place"),
    ("causal_past_only", "own.place <= s.place AND NOT (own.place = 3 AND s.place = 4)"),
):
    QUERIES[f"window_scope_{_scope_name}"] = _scope(_scope_name)
    ORACLE_SQL[f"window_scope_{_scope_name}"] = _scope_sql(_seen)
assert {name for name, *_ in FEATURES} <= {*_formulas("r", 1), *COLLECTING}
