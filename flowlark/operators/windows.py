"""Sliding-window features of grouped, time-ordered rows.

Every feature of a row looks back from that row in its group: over the last W rows (``RowsFrame``) or over the rows of
the last S whole seconds (``TimeFrame``), the row itself included and later rows of the same second left out.

How it runs. One shuffle by group brings each group together; all windows share it. A row costs the same whatever its
frames hold: sums and counts are differences of running sums, distinct counts and entropies are running sums of what
enters and leaves the frame. A running sum's part before a time frame ends at a whole second, so rows of one second,
however many, need no special case. Largest frequencies have no such sum: where they are asked for, a narrow pass over
the groups' places, seconds and values keeps each frame's counts in Arrow batches (``_top_counts``).

A group that is too large for one task is not windowed at all: its rows are put into order, cut into blocks anywhere, and
scanned in two phases with a carry from block to block (``scans``). Only the features that are asked for are worked out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.config import recipe, required_columns
from ..functions.expressions import f_log_f
from . import frames, scans

#: A group is hot if it has more than HOT_ROWS rows and more than 1 / HOT_GROUPS of all rows (so HOT_GROUPS groups at most),
#: or too many for a row's place within a second (2**PLACE_BITS).
HOT_ROWS, HOT_GROUPS, PLACE_BITS = 1 << 17, 4096, 24
#: Rows without a whole group key have no frames; they are dealt to so many tasks.
KEYLESS = 4096
#: A task of groups gets about so many rows, and fewer where they get many features: rows times features at most TASK_VALUES.
TASK_ROWS, TASK_VALUES, LEAST_ROWS = 1 << 15, 1 << 20, 1 << 12
#: From so many features on, frames are gone through as arrays: a window for each part of a feature would take longer.
WIDE = 48


class Frame:
    """Counts, sums and so on over one frame; each asks for helper columns in the stage where they can be computed.

    A helper of a stage may use those of earlier stages, since a window function can't hold another one.
    """

    kind = ""
    tag = property(lambda self: f"{self.kind}{self.size}")

    def __init__(self, group: list[str], size: int, stages: list[dict[str, Column]], tops: dict[str, tuple[str, str, int]]):
        self.group, self.size, self.stages, self.tops = group, size, stages, tops

    def helper(self, stage: int, name: str, value: Callable[[], Column]) -> Column:
        """The helper column of that name; ``value`` makes it where it is asked for first."""
        if name not in self.stages[stage]:
            self.stages[stage][name] = value()
        return F.col(name)

    def top_share(self, value: str) -> Column:
        """The share of the frame's most frequent value, whose number comes from the last pass over the rows."""
        name = f"_top{value}_{self.tag}"
        self.tops[name] = (value, self.kind, self.size)
        return F.col(name) / self.n

    def share(self, x: Column) -> Column:
        return x / F.greatest(self.n, F.lit(1.0))

    def inter_arrival(self) -> tuple[Column, Column]:
        """Variation and regularity of the gaps; the mean is over all rows, the first one's gap of 0 included."""
        mean, square = self.share(self.total("_gap")), self.share(self.total("_gap2"))
        cv = F.when(self.n <= 1, F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)) / F.greatest(mean, F.lit(1e-6)))
        return cv, 1 / (1 + cv)

    def _entropy(self, spread: Column) -> Column:
        return F.when(self.n <= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.log2(self.n) - spread / self.n))


class RowsFrame(Frame):
    """The last ``size`` rows."""

    kind = "r"

    @property
    def n(self) -> Column:
        return F.least(F.col("_rn"), F.lit(self.size)).cast("double")

    def _ordered(self, *values: str):
        return W.partitionBy(*self.group, *values).orderBy("_rn")

    def total(self, x: str) -> Column:
        running = self.helper(0, f"_sum{x}", lambda: F.sum(F.col(x).cast("double")).over(self._ordered().rowsBetween(W.unboundedPreceding, 0)))
        before = self.helper(1, f"_sum{x}_{self.tag}", lambda: F.lag(running, self.size).over(self._ordered()))
        return running - F.coalesce(before, F.lit(0.0))

    def count_of(self, *values: str) -> Column:
        past = self._counted(f"_past{''.join(values)}_{self.tag}", -self.size, *values)
        return (self._upto(*values) - past).cast("double")

    def _upto(self, *values: str) -> Column:
        return self.helper(0, f"_upto{''.join(values)}", lambda: F.count(F.lit(1)).over(self._ordered(*values).rowsBetween(W.unboundedPreceding, 0)))

    def _counted(self, name: str, last: int, *values: str) -> Column:
        """The rows with these values from the group's beginning to ``last`` places after the row (before it, if negative):
        a frame that only grows, so that its count costs the same for any size."""
        return self.helper(0, name, lambda: F.count(F.lit(1)).over(self._ordered(*values).rangeBetween(W.unboundedPreceding, last)))

    def distinct(self, value: str) -> Column:
        """Every row enters. One leaves when its value comes again within the frame, or when it is too far back."""
        own = lambda: self._ordered(value)
        before = self.helper(0, f"_prev{value}", lambda: F.lag("_rn").over(own()))
        after = self.helper(0, f"_next{value}", lambda: F.lead("_rn").over(own()))
        late = self.helper(1, f"_late{value}_{self.tag}", lambda: F.lag(after, self.size).over(self._ordered()))
        again = F.coalesce(F.col("_rn") - before < self.size, F.lit(False)).cast("int")
        expired = ((F.col("_rn") > self.size) & F.coalesce(late >= F.col("_rn"), F.lit(True))).cast("int")
        change = 1 - again - expired
        return self.helper(2, f"_dst{value}_{self.tag}", lambda: F.sum(change).over(self._ordered().rowsBetween(W.unboundedPreceding, 0)).cast("double"))

    def entropy(self, value: str) -> Column:
        """The sum of f * log2 f changes by what the entering row adds and the leaving one takes away."""
        into = self._upto(value) - self._counted(f"_past1{value}_{self.tag}", -self.size - 1, value)
        out = self._counted(f"_meet{value}_{self.tag}", self.size, value) - self._upto(value) + 1
        lost = self.helper(1, f"_lost{value}_{self.tag}", lambda: F.lag(f_log_f(out - 1) - f_log_f(out), self.size).over(self._ordered()))
        change = f_log_f(into) - f_log_f(into - 1) + F.coalesce(lost, F.lit(0.0))
        return self._entropy(self.helper(2, f"_ent{value}_{self.tag}", lambda: F.sum(change).over(self._ordered().rowsBetween(W.unboundedPreceding, 0))))


class TimeFrame(Frame):
    """The rows of the last ``size`` seconds, up to the row itself; a row just ``size`` seconds old is in.

    What left the frame is whatever lies ``size`` + 1 seconds back or more: a RANGE from the group's beginning, which only
    grows from row to row. Ranges are over ``_o``, the row's second and, in its lower bits, its place in the group, so that
    one sort serves them and the running sums; a whole second less one is as far as a place can be off.
    """

    kind = "t"
    far = property(lambda self: ((self.size + 1) << PLACE_BITS) - 1)

    def _own(self, *values: str):
        return W.partitionBy(*self.group, *values).orderBy("_o")

    def _so_far(self, *values: str):
        return self._own(*values).rowsBetween(W.unboundedPreceding, 0)

    def _left(self, *values: str):
        return self._own(*values).rangeBetween(W.unboundedPreceding, -self.far)

    @property
    def n(self) -> Column:
        return self.count_of()

    def total(self, x: str) -> Column:
        running = self.helper(0, f"_sum{x}", lambda: F.sum(F.col(x).cast("double")).over(self._so_far()))
        return running - F.coalesce(self.helper(0, f"_gone{x}_{self.tag}", lambda: F.sum(F.col(x).cast("double")).over(self._left())), F.lit(0.0))

    def count_of(self, *values: str) -> Column:
        running = self.helper(0, f"_upto{''.join(values)}", lambda: F.count(F.lit(1)).over(self._so_far(*values)))
        return (running - self.helper(0, f"_past{''.join(values)}_{self.tag}", lambda: F.count(F.lit(1)).over(self._left(*values)))).cast("double")

    def distinct(self, value: str) -> Column:
        """A value enters with a row that finds it in no frame, and leaves with the last row before a pause in it."""
        own = lambda: self._own(value)
        before, after = self.helper(0, f"_since{value}", lambda: F.lag("_t").over(own())), self.helper(0, f"_until{value}", lambda: F.lead("_t").over(own()))
        new = F.coalesce(F.col("_t") - before > self.size, F.lit(True)).cast("int")
        lost = F.coalesce(after - F.col("_t") > self.size, F.lit(True)).cast("int")
        came = self.helper(1, f"_came{value}_{self.tag}", lambda: F.sum(new).over(self._so_far()))
        return (came - F.coalesce(self.helper(1, f"_went{value}_{self.tag}", lambda: F.sum(lost).over(self._left())), F.lit(0))).cast("double")

    def entropy(self, value: str) -> Column:
        """The sum of f * log2 f changes by what an entering row adds and a leaving one takes away. A leaving row is the
        oldest of its value; it meets the rows that came with it or up to ``size`` seconds after it."""
        into = self.count_of(value)
        until = self.helper(0, f"_meet{value}_{self.tag}", lambda: F.count(F.lit(1)).over(self._own(value).rangeBetween(W.unboundedPreceding, self.far)))
        out = until - F.col(f"_upto{value}") + 1
        came = self.helper(1, f"_fcame{value}_{self.tag}", lambda: F.sum(f_log_f(into) - f_log_f(into - 1)).over(self._so_far()))
        went = self.helper(1, f"_fwent{value}_{self.tag}", lambda: F.sum(f_log_f(out) - f_log_f(out - 1)).over(self._left()))
        return self._entropy(came - F.coalesce(went, F.lit(0.0)))


class ScannedFrame(Frame):
    """A frame whose parts are columns that a pass over arrays makes, or of a hot group a segmented scan; it says which ones
    it needs."""

    def __init__(self, kind: str, size: int, needs: dict[str, tuple[str, int, str, tuple]]):
        self.kind, self.size, self.needs = kind, size, needs

    def _part(self, what: str, *values: str) -> Column:
        name = f"_{what}{''.join(values)}_{self.tag}"
        self.needs[name] = (self.kind, self.size, what, values)
        return F.col(name)

    @property
    def n(self) -> Column:
        return self.total("_one")

    def total(self, x: str) -> Column:
        return self._part("total", x)

    def count_of(self, *values: str) -> Column:
        return self._part("count", *values)

    def distinct(self, value: str) -> Column:
        return self._part("distinct", value)

    def entropy(self, value: str) -> Column:
        return self._entropy(self._part("spread", value))

    def top_share(self, value: str) -> Column:
        return self._part("top", value) / self.n


def _top_counts(rows: DataFrame, group: list[str], tops: dict[str, tuple[str, str, int]]) -> DataFrame:
    """The group, the place and the numbers of the frames' most frequent values, from one pass over narrow rows in their
    order."""
    keep, values = [*group, "_rn", "_t"], sorted({value for value, _, _ in tops.values()})
    rows = rows.select(*keep, *values).sortWithinPartitions(*group, "_rn")
    schema = T.StructType([*rows.schema.fields[: len(keep) - 1], *[T.StructField(name, T.DoubleType()) for name in tops]])

    def run(batches):
        steps = [(value, frames.top_count(kind, size)) for value, kind, size in tops.values()]
        numbers: dict[str, dict] = {value: {} for value in values}
        for batch in batches:
            coded = {}
            for value in values:
                column = batch.column(batch.schema.get_field_index(value)).dictionary_encode()
                known = numbers[value]
                number = np.array([known.setdefault(v, len(known)) for v in column.dictionary.to_pylist()], np.int64)
                coded[value] = number[column.indices.to_numpy()].tolist()
            place, second = (batch.column(len(keep) - k).to_pylist() for k in (2, 1))
            made = [pa.array(map(step, place, second, coded[value]), pa.float64()) for value, step in steps]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) - 1], *made], [*keep[:-1], *tops])

    return rows.mapInArrow(run, schema)


def _flag_ratio(f: Frame, flag: str) -> Column:
    ack = f.total("_ack")
    base = ack + 1e-6 if f.kind == "r" else F.greatest(ack, F.lit(1e-6))
    return f.total(f"_{flag}") / base


#: Features in their order: the name without its size, the switches that must all be on, where they exist (r: row
#: frames, t: time frames), and the value. The order is a contract; names are listed here and nowhere else.
FEATURES = (
    ("flow_count", "flow_count", "r", lambda f: f.n),
    ("flow_count", "", "t", lambda f: f.n),
    ("unique_destination_port", "unique_destination_port", "rt", lambda f: f.distinct("_dp")),
    ("destination_port_count", "destination_port_count", "rt", lambda f: f.count_of("_dp")),
    ("unique_destination_ip", "unique_destination_ip", "t", lambda f: f.distinct("_di")),
    ("destination_ip_count", "destination_ip_count", "t", lambda f: f.count_of("_di")),
    ("destination_service_count", "destination_service_count", "t", lambda f: f.count_of("_di", "_dp")),
    ("unique_destination_port_ratio", "unique_port_ratio", "rt", lambda f: f.share(f.distinct("_dp"))),
    ("same_destination_port_ratio", "unique_port_ratio", "r", lambda f: f.share(f.count_of("_dp"))),
    ("new_destination_port_indicator", "unique_port_ratio", "r", lambda f: (f.count_of("_dp") <= 1).cast("double")),
    ("packets_sum", "packet_byte_sums", "rt", lambda f: f.total("_packets")),
    ("bytes_sum", "packet_byte_sums", "rt", lambda f: f.total("_bytes")),
    ("syn_ratio", "flag_ratios", "rt", lambda f: _flag_ratio(f, "syn")),
    ("rst_ratio", "flag_ratios", "rt", lambda f: _flag_ratio(f, "rst")),
    ("fin_ratio", "flag_ratios", "rt", lambda f: _flag_ratio(f, "fin")),
    ("port_switch_ratio", "behavior_proxies", "rt", lambda f: f.share(f.total("_switch"))),
    ("short_flow_ratio", "behavior_proxies", "rt", lambda f: f.share(f.total("_short"))),
    ("small_bytes_ratio", "behavior_proxies", "rt", lambda f: f.share(f.total("_small"))),
    ("syn_dominant_ratio", "behavior_proxies", "rt", lambda f: f.share(f.total("_syn_led"))),
    ("rst_dominant_ratio", "behavior_proxies", "rt", lambda f: f.share(f.total("_rst_led"))),
    ("burst_count", "periodicity", "rt", lambda f: f.total("_quick")),
    ("dest_repeat_ratio", "botnet_context", "rt", lambda f: f.share(f.count_of("_di"))),
    ("source_port_repeat_ratio", "botnet_context", "rt", lambda f: f.share(f.count_of("_sp"))),
    ("source_dest_port_pair_repeat_ratio", "botnet_context", "rt", lambda f: f.share(f.count_of("_sp", "_dp"))),
    ("low_slow_repeat_count", "low_slow", "rt", lambda f: f.total("_low_slow")),
    ("port_entropy", "port_diversity", "rt", lambda f: f.entropy("_dp")),
    ("port_concentration", "port_diversity", "rt", lambda f: 1 - f.share(f.distinct("_dp"))),
    ("sequential_port_ratio", "port_diversity", "rt", lambda f: f.share(f.total("_next_port"))),
    ("high_port_ratio", "port_diversity", "rt", lambda f: f.share(f.total("_high"))),
    ("inter_arrival_cv", "timing_regularity", "rt", lambda f: f.inter_arrival()[0]),
    ("inter_arrival_regularity", "timing_regularity", "rt", lambda f: f.inter_arrival()[1]),
    ("beaconing_score", "beaconing_detection", "r", lambda f: f.inter_arrival()[1] * f.n / max(f.size, 1)),
    ("dest_ip_entropy", "dest_concentration", "rt", lambda f: f.entropy("_di")),
    ("single_dest_ratio", "dest_concentration", "rt", lambda f: f.top_share("_di")),
    ("port_per_dest_ip", "dest_concentration", "rt", lambda f: f.distinct("_dp") / F.greatest(f.distinct("_di"), F.lit(1.0))),
    ("dest_ip_concentration", "beaconing_detection", "t", lambda f: f.top_share("_di")),
)


def _frame_features(cfg: dict) -> list[tuple[str, str, int, object]]:
    """(column name, frame kind, size, value) of every sliding feature that is on."""
    out = []
    for kind, prefix, suffix, sizes in (("r", "win", "", cfg["window_sizes"]), ("t", "time", "s", cfg["time_window_seconds"])):
        for size in sizes:
            out += [(f"{prefix}_{name}_{size}{suffix}", kind, int(size), value) for name, switch, where, value in FEATURES if kind in where and (not switch or cfg[f"include_{switch}"])]
    return out


def context_features(cfg: dict) -> dict[str, Column]:
    """Features of the row alone: port classes, service families, watched ports. Missing ports are -1, a system port."""
    out: dict[str, Column] = {}

    def classes(side: str, port: Column) -> None:
        out[f"ctx_{side}_port_is_system"] = port < 1024
        out[f"ctx_{side}_port_is_registered"] = (port >= 1024) & (port < 49152)
        out[f"ctx_{side}_port_is_dynamic"] = port >= 49152

    dest, source = F.col("_dp"), F.col("_sp")
    families = sorted(cfg["service_family_ports"].items())
    if cfg["include_service_context"]:
        classes("dest", dest)
        out |= {f"ctx_service_{name}": dest.isin(list(ports)) for name, ports in families}
    if cfg["include_source_port_context"]:
        classes("source", source)
        out["ctx_source_dest_same_port"] = source == dest
        out |= {f"ctx_source_service_{name}": source.isin(list(ports)) for name, ports in families}
    if cfg["include_watched_ports"]:
        for port in sorted(map(int, cfg["watched_ports"])):
            out |= {f"ctx_source_port_{port}": source == port, f"ctx_dest_port_{port}": dest == port}
    return {name: value.cast("double") for name, value in out.items()}


def feature_names(changes: dict | None = None) -> list[str]:
    """The names of all features of a recipe, in the order of their columns."""
    cfg = recipe(changes)
    return [*context_features_names(cfg), *[name for name, *_ in _frame_features(cfg)]]


def context_features_names(cfg: dict) -> list[str]:
    names = []
    kinds = ("is_system", "is_registered", "is_dynamic")
    families = sorted(cfg["service_family_ports"])
    if cfg["include_service_context"]:
        names += [*(f"ctx_dest_port_{k}" for k in kinds), *(f"ctx_service_{k}" for k in families)]
    if cfg["include_source_port_context"]:
        names += [*(f"ctx_source_port_{k}" for k in kinds), "ctx_source_dest_same_port", *(f"ctx_source_service_{k}" for k in families)]
    if cfg["include_watched_ports"]:
        names += [f"ctx_{side}_port_{port}" for port in sorted(map(int, cfg["watched_ports"])) for side in ("source", "dest")]
    return names


def _hot_groups(df: DataFrame, cfg: dict) -> tuple[DataFrame | None, int, int]:
    """The keys of the hot groups with a number _gid, their rows _n and last second _hi; the rows of all of them; the other
    rows, those without a whole key among them."""
    group = cfg["group_by"]
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.max(_second(cfg)).alias("_hi"))
    whole = F.when(_whole(group), F.col("_n"))
    every, total, most = counts.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("_n"), F.sum(whole), F.max(whole))]).first()
    enough = min(max(HOT_ROWS, total // HOT_GROUPS), (1 << PLACE_BITS) - 1)
    if most <= enough:
        return None, 0, every
    hot = counts.where(_whole(group) & (F.col("_n") > enough))
    rows = hot.collect()  # HOT_GROUPS at most, or one for every 2**PLACE_BITS rows
    schema = T.StructType([*hot.schema.fields, T.StructField("_gid", T.LongType())])
    n = sum(row["_n"] for row in rows)
    return df.sparkSession.createDataFrame([(*row, k) for k, row in enumerate(rows)], schema), n, every - n


def _tasks(df: DataFrame, rows: int, features: int) -> int:
    """So many tasks that one's rows don't grow with the table; on small ones as many as there are cores."""
    most = min(TASK_ROWS, max(1, TASK_VALUES // max(1, features)))
    return max(1, -(-rows // most), min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS)))


def _second(cfg: dict) -> Column:
    return F.unix_seconds(F.col(cfg["timestamp_column"]).cast("timestamp"))


def _whole(group: list[str]) -> Column:
    """Is no group key missing?"""
    whole = F.lit(True)
    for c in group:
        whole = whole & F.col(c).isNotNull()
    return whole


def _values(df: DataFrame, cfg: dict) -> DataFrame:
    """The helper columns of a row alone: its second and what features are made of; missing ports are -1, sums 0."""
    has = lambda c: c is not None and c in df.columns
    port = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(-1)) if has(c) else F.lit(-1)
    both = lambda pair: F.coalesce(F.col(pair["fwd"]).cast("double") + F.col(pair["bwd"]).cast("double"), F.lit(0.0)) if all(map(has, pair.values())) else F.lit(0.0)
    count = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if has(c) else F.lit(0.0)
    address = cfg["destination_ip_column"]
    return df.withColumns(
        {
            "_ts": _second(cfg),
            "_dp": port(cfg["destination_port_column"]),
            "_sp": port(cfg["source_port_column"]),
            "_di": F.coalesce(F.col(address).cast("string"), F.lit("missing")) if has(address) else F.lit("missing"),
            "_packets": both(cfg["packet_columns"]),
            "_bytes": both(cfg["byte_columns"]),
            **{f"_{k}": count(c) for k, c in cfg["flag_columns"].items()},
        }
    )


def _indicators(df: DataFrame, cfg: dict) -> DataFrame:
    """The helper columns that compare a row with the one before it, whose second and port are ``_t_was`` and ``_was``."""
    has = lambda c: c is not None and c in df.columns
    short = (F.col("_packets") <= cfg["short_flow_packet_threshold"]).cast("double")
    small = (F.col("_bytes") <= cfg["small_flow_byte_threshold"]).cast("double")
    yes = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    known = all(has(c) for pair in ("packet_columns", "byte_columns") for c in cfg[pair].values())
    flags = all(map(has, cfg["flag_columns"].values()))
    return df.withColumn("_gap", F.coalesce(F.col("_t") - F.col("_t_was"), F.lit(0)).cast("double")).withColumns(
        {
            "_gap2": F.col("_gap") * F.col("_gap"),
            "_quick": ((F.col("_rn") > 1) & (F.col("_gap") <= cfg["burst_gap_seconds"])).cast("double"),
            "_switch": yes(F.col("_dp") != F.col("_was")),
            "_next_port": yes(F.col("_dp") == F.col("_was") + 1),
            "_high": (F.col("_dp") >= 1024).cast("double"),
            "_short": short if known else F.lit(0.0),
            "_small": small if known else F.lit(0.0),
            "_low_slow": short * small if known else F.lit(0.0),
            "_syn_led": (F.col("_syn") > F.col("_ack")).cast("double") if flags else F.lit(0.0),
            "_rst_led": (F.col("_rst") > F.col("_ack")).cast("double") if flags else F.lit(0.0),
        }
    )


def _ordering(cfg: dict) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in cfg["order_by"]]


def prelude(df: DataFrame, cfg: dict, tasks: int) -> DataFrame:
    """The helper columns that all frames build on: position, second, values and indicators; groups are dealt to ``tasks`` by
    ``_block``, a part of their key. (By the keys themselves, a constant one, which windows don't keep, would deal them again.)

    Times are whole seconds. Rows without one come last in their group and take its last known time, else their position.
    """
    group = cfg["group_by"]
    df = _values(df.repartition(tasks, "_block"), cfg)
    order = W.partitionBy(*group).orderBy(*_ordering(cfg))
    last = F.max("_ts").over(W.partitionBy(*group))
    df = df.withColumns({"_rn": F.row_number().over(order).cast("long"), "_was": F.lag("_dp").over(order), "_ts_was": F.lag("_ts").over(order), "_last": last})
    at = lambda ts, back: F.coalesce(ts, "_last", F.col("_rn") - back)
    df = df.withColumns({"_t": at("_ts", 1), "_t_was": F.when(F.col("_rn") > 1, at("_ts_was", 2))})
    return _indicators(df.withColumn("_o", F.shiftleft("_t", PLACE_BITS) + F.col("_rn")), cfg)


def _dealt(df: DataFrame, cfg: dict) -> tuple[DataFrame, dict]:
    """The rows with ``_block``, by which groups are dealt to tasks, and the recipe with it as a part of their key, the first
    to be compared."""
    key = F.xxhash64(*cfg["group_by"])
    block = F.when(_whole(cfg["group_by"]), key).otherwise(F.pmod(F.xxhash64(*cfg["order_by"]), F.lit(KEYLESS))).cast("long")
    return df.withColumn("_block", block), {**cfg, "group_by": ["_block", *cfg["group_by"]]}


def _by_windows(df: DataFrame, cfg: dict, sliding: list, context: dict[str, Column], kind: str, rows: int) -> DataFrame:
    """The features of groups that are each one task's, ``rows`` in all. Rows without a whole key have no frames and are dealt to many tasks."""
    columns, whole = df.columns, _whole(cfg["group_by"])
    df, cfg = _dealt(df, cfg)
    stages: list[dict[str, Column]] = [{}, {}, {}]
    tops: dict[str, tuple[str, str, int]] = {}
    values = {name: value((RowsFrame if frame == "r" else TimeFrame)(cfg["group_by"], size, stages, tops)) for name, frame, size, value in sliding}
    tasks = _tasks(df, rows, len(sliding))
    out = prelude(df, cfg, tasks)
    if tops:
        counts = _top_counts(prelude(df.where(whole), cfg, tasks), cfg["group_by"], tops)
        # A join by place deals rows anew, into few tasks where they are small: the windows get their own number again.
        out = out.join(counts, [*cfg["group_by"], "_rn"], "left").repartition(tasks, "_block")
    for stage in stages:
        out = out.withColumns(stage) if stage else out
    made = [F.when(whole, v).otherwise(F.lit(0.0)).cast(kind).alias(name) for name, v in values.items()]
    return out.select(*columns, *[v.cast(kind).alias(name) for name, v in context.items()], *made)


def _by_arrays(df: DataFrame, cfg: dict, sliding: list, context: dict[str, Column], kind: str, rows: int) -> DataFrame:
    """The same as ``_by_windows``, of many features: their parts come from one pass over each task's groups (``frames``)."""
    columns, whole = df.columns, _whole(cfg["group_by"])
    needs: dict[str, tuple[str, int, str, tuple]] = {}
    values = {name: value(ScannedFrame(frame, size, needs)) for name, frame, size, value in sliding}
    df, cfg = _dealt(df, cfg)
    placed = prelude(df, cfg, _tasks(df, rows, 1)).sortWithinPartitions(*cfg["group_by"], "_rn")
    # A row without a whole key stands alone, so that no group is larger than those with one.
    placed = placed.withColumn("_rn", F.when(whole, F.col("_rn")).otherwise(F.lit(1)))
    out = frames.with_parts(placed, [*columns, *(["_dp", "_sp"] if context else [])], needs)
    made = [F.when(whole, v).otherwise(F.lit(0.0)).cast(kind).alias(name) for name, v in values.items()]
    return out.select(*columns, *[v.cast(kind).alias(name) for name, v in context.items()], *made)


def _by_scans(df: DataFrame, cfg: dict, sliding: list, context: dict[str, Column], kind: str, rows: int) -> DataFrame:
    """The features of hot groups (with _gid, _n and _hi), from scans over blocks of their rows."""
    columns = [c for c in df.columns if c not in ("_gid", "_n", "_hi")]
    needs: dict[str, tuple[str, int, str, tuple]] = {}
    values = {name: value(ScannedFrame(frame, size, needs)) for name, frame, size, value in sliding}
    last = ["_dp", "_ts"]
    # Helper columns that a row alone makes aren't moved and stored, but made again where the table is read.
    listed = scans.ordered(_values(df, cfg).select(*df.columns, F.struct(*last).alias("_before")), [F.col("_gid"), *_ordering(cfg)], rows)
    placed = scans.with_neighbours(_values(listed, cfg), last)
    at = lambda ts, back: F.coalesce(ts, "_hi", F.col("_rn") - back)
    placed = placed.withColumns({"_t": at("_ts", 1), "_was": F.col("_before._dp"), "_t_was": F.when(F.col("_rn") > 1, at("_before._ts", 2))})
    placed = _indicators(placed, cfg).withColumns({"_one": F.lit(1.0), "_end": F.coalesce("_hi", F.col("_n") - 1)}).drop("_before")
    out = scans.with_frames(placed, rows, needs)
    return out.select(*columns, *[v.cast(kind).alias(name) for name, v in context.items()], *[v.cast(kind).alias(name) for name, v in values.items()])


def add_window_features(df: DataFrame, changes: dict | None = None, kind: str = "float", columns: list[str] | None = None) -> DataFrame:
    """``df`` with the recipe's features as columns of type ``kind``, after its own columns; only those in ``columns``, if given.

    Rows with a missing group key keep their context features and have 0 for every sliding one. Columns that the recipe
    needs must exist: nothing is silently 0. Windows stay within a source file if the table has that column.
    """
    cfg = recipe(changes, set(df.columns))
    if "source_file" in df.columns and "source_file" not in cfg["group_by"]:
        cfg["group_by"] = ["source_file", *cfg["group_by"]]
    if missing := [c for c in required_columns(cfg) if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    asked = lambda name: columns is None or name in columns
    sliding = [x for x in _frame_features(cfg) if asked(x[0])]
    context = {name: v for name, v in context_features(cfg).items() if asked(name)}
    if not sliding:
        return _values(df, cfg).select(*df.columns, *[v.cast(kind).alias(name) for name, v in context.items()])
    hot, rows, others = _hot_groups(df, cfg)
    # Arrays hold a group at once; beyond so many rows in all a group that isn't hot may be too large for that.
    few = len(sliding) < WIDE or (rows + others) // HOT_GROUPS > max(HOT_ROWS, frames.AT_ONCE)
    in_tasks = _by_windows if few else _by_arrays
    if hot is None:
        return in_tasks(df, cfg, sliding, context, kind, others)
    marked = df.join(F.broadcast(hot), cfg["group_by"], "left").select(*df.columns, "_gid", "_n", "_hi")
    cold = in_tasks(marked.where("_gid is null").drop("_gid", "_n", "_hi"), cfg, sliding, context, kind, others)
    return cold.unionByName(_by_scans(marked.where("_gid is not null"), cfg, sliding, context, kind, rows))


#: Which splits' rows a split's windows may see, under the causal scope (fixed values).
CAUSAL = {
    "train": ("train",),
    "model_selection_val": ("train", "model_selection_val"),
    "val": ("train", "model_selection_val", "val"),
    "test_seen": ("train", "model_selection_val", "val", "test_seen"),
    "test_zero_day": ("train", "model_selection_val", "val", "test_zero_day"),
}


def scoped_window_features(df: DataFrame, splits: DataFrame, scope: str = "full_source_file", changes: dict | None = None, kind: str = "float", columns: list[str] | None = None) -> DataFrame:
    """Features of the rows in ``splits`` (row_id, split), whose windows see what the scope allows: all rows of the file
    (``full_source_file``), only the split's own (``split_only``), or the split's and those before it
    (``causal_past_only``). Other rows are left out."""
    if scope == "full_source_file":
        return add_window_features(df, changes, kind, columns).join(splits, "row_id")
    labelled = df.join(splits, "row_id")
    if scope == "split_only":
        allowed = {name: (name,) for name in CAUSAL}
    elif scope == "causal_past_only":
        allowed = CAUSAL
    else:
        raise ValueError(f"unknown scope: {scope}")
    # One plan for all splits: each row is seen once by every split that may see it, and kept by its own.
    seers = F.array(*[F.struct(F.lit(name).alias("seer"), F.array(*map(F.lit, rows)).alias("seen")) for name, rows in allowed.items()])
    seen = labelled.withColumn("_s", F.explode(F.filter(seers, lambda x: F.array_contains(x["seen"], F.col("split"))))).withColumn("_seer", F.col("_s.seer")).drop("_s")
    cfg = dict(changes or {})
    cfg["group_by"] = [*recipe(changes)["group_by"], "_seer"]
    return add_window_features(seen, cfg, kind, columns).where("_seer = split").drop("_seer")
