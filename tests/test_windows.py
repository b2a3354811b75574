"""The window engine against a queue that is filled and emptied row by row."""

import datetime as dt
import math
import random
import re
from collections import Counter, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlark.functions.config import DEFAULTS, OFF, SHIPPED, recipe, required_columns
from flowlark.operators import scans, windows
from flowlark.operators.windows import add_window_features, feature_names, scoped_window_features

ALL = dict.fromkeys(OFF, True)
SCHEMA = (
    "row_id long, source_file string, source_ip string, source_port int, destination_ip string, destination_port int, timestamp timestamp, syn_flag_count int, ack_flag_count int,"
    " rst_flag_count int, fin_flag_count int, total_fwd_packets int, total_backward_packets int, total_length_of_fwd_packets int, total_length_of_bwd_packets int"
)
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def entropy(values):
    n, c = len(values), Counter(values)
    return 0.0 if n <= 1 else max(0.0, math.log2(n) - sum(f * math.log2(f) for f in c.values()) / n)


def brute(rows, sizes, seconds):
    """Features by row id; rows are dictionaries in the order of their group."""
    out, groups = {}, {}
    for r in rows:
        groups.setdefault((r["source_file"], r["source_ip"]), []).append(r)
    for key, group in groups.items():
        group.sort(key=lambda r: (r["timestamp"] is None, r["timestamp"] or START, r["row_id"]))
        known = [None if r["timestamp"] is None else math.floor(r["timestamp"].timestamp()) for r in group]
        t, last = [], None
        for v in known:
            last = v if v is not None else last
            t.append(last)
        first = next((v for v in known if v is not None), None)
        t = [v if v is not None else first if first is not None else i for i, v in enumerate(t)]
        made = []
        for i, r in enumerate(group):
            p = None if i == 0 else group[i - 1]
            port = lambda x, c="destination_port": -1 if x[c] is None else x[c]
            total = lambda a, b: 0 if r[a] is None or r[b] is None else r[a] + r[b]
            packets, size = total("total_fwd_packets", "total_backward_packets"), total("total_length_of_fwd_packets", "total_length_of_bwd_packets")
            gap = t[i] - t[i - 1] if i else 0
            m = {"t": t[i], "dp": port(r), "sp": port(r, "source_port"), "di": r["destination_ip"] or "missing", "packets": packets, "bytes": size, "gap": gap}
            m |= {k: r[f"{k}_flag_count"] or 0 for k in ("syn", "ack", "rst", "fin")}
            m |= {"switch": int(i > 0 and m["dp"] != port(p)), "follows": int(i > 0 and m["dp"] == port(p) + 1), "quick": int(i > 0 and gap <= 1)}
            m |= {"short": int(packets <= 6), "small": int(size <= 512), "syn_led": int(m["syn"] > m["ack"]), "rst_led": int(m["rst"] > m["ack"]), "high": int(m["dp"] >= 1024)}
            made.append(m)
        for kind, spans in (("win", sizes), ("time", seconds)):
            for span in spans:
                queue = deque()
                for r, m in zip(group, made):
                    queue.append(m)
                    while len(queue) > span if kind == "win" else m["t"] - queue[0]["t"] > span:
                        queue.popleft()
                    if None in key:
                        out.setdefault(r["row_id"], {}).update({n: 0.0 for n in feature_names({**ALL, "window_sizes": sizes, "time_window_seconds": seconds}) if not n.startswith("ctx_")})
                        continue
                    out.setdefault(r["row_id"], {}).update(values(kind, span, list(queue), m))
    return out


def values(kind, span, q, m):
    n, s = len(q), lambda k: sum(x[k] for x in q)
    same = lambda *k: sum(all(x[c] == m[c] for c in k) for x in q)
    dp, di = [x["dp"] for x in q], [x["di"] for x in q]
    ack = s("ack") + 1e-6 if kind == "win" else max(s("ack"), 1e-6)
    mean = s("gap") / n
    cv = 0.0 if n <= 1 else math.sqrt(max(0.0, sum(x["gap"] ** 2 for x in q) / n - mean**2)) / max(mean, 1e-6)
    top = max(Counter(di).values()) / n
    f = {
        "flow_count": n, "unique_destination_port": len(set(dp)), "destination_port_count": same("dp"), "unique_destination_port_ratio": len(set(dp)) / n,
        "packets_sum": s("packets"), "bytes_sum": s("bytes"), "syn_ratio": s("syn") / ack, "rst_ratio": s("rst") / ack, "fin_ratio": s("fin") / ack,
        "port_switch_ratio": s("switch") / n, "short_flow_ratio": s("short") / n, "small_bytes_ratio": s("small") / n, "syn_dominant_ratio": s("syn_led") / n, "rst_dominant_ratio": s("rst_led") / n,
        "burst_count": s("quick"), "dest_repeat_ratio": same("di") / n, "source_port_repeat_ratio": same("sp") / n, "source_dest_port_pair_repeat_ratio": same("sp", "dp") / n,
        "low_slow_repeat_count": sum(x["short"] * x["small"] for x in q), "port_entropy": entropy(dp), "port_concentration": 1 - len(set(dp)) / n, "sequential_port_ratio": s("follows") / n,
        "high_port_ratio": s("high") / n, "inter_arrival_cv": cv, "inter_arrival_regularity": 1 / (1 + cv), "dest_ip_entropy": entropy(di), "single_dest_ratio": top, "port_per_dest_ip": len(set(dp)) / len(set(di)),
    }
    if kind == "win":
        f |= {"same_destination_port_ratio": same("dp") / n, "new_destination_port_indicator": float(same("dp") <= 1), "beaconing_score": 1 / (1 + cv) * n / span}
        return {f"win_{k}_{span}": v for k, v in f.items()}
    f |= {"unique_destination_ip": len(set(di)), "destination_ip_count": same("di"), "destination_service_count": same("di", "dp"), "dest_ip_concentration": top}
    return {f"time_{k}_{span}s": v for k, v in f.items()}


def flows(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        time = None if r.random() < 0.05 else START + dt.timedelta(seconds=r.choice([0, 0.5, 1, 1.5]) + r.randint(0, n // 4))
        maybe = lambda v: None if r.random() < 0.08 else v  # noqa: E731, B023
        rows.append((i, "a.csv", maybe(f"ip{r.randint(0, 2)}"), maybe(r.choice([80, 8080, 50000])), maybe(r.choice("xyz")), maybe(r.choice([80, 81, 443, 8080])), time,
                     *[r.randint(0, 2) for _ in range(4)], *[maybe(r.randint(0, 8)) for _ in range(2)], *[maybe(r.randint(0, 600)) for _ in range(2)]))
    return rows


@pytest.mark.parametrize("seed,sizes,seconds", [(1, [1, 3, 10], [0, 2, 60]), (2, [5, 400], [7, 3600])])
def test_features_match_a_queue(spark, seed, sizes, seconds):
    rows = flows(160, seed)
    cfg = {**ALL, "window_sizes": sizes, "time_window_seconds": seconds}
    got = {r.row_id: r.asDict() for r in add_window_features(spark.createDataFrame(rows, SCHEMA), cfg, "double").collect()}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    want = brute([dict(zip([n.strip() for n in names], r)) for r in rows], sizes, seconds)
    slide = [n for n in feature_names(cfg) if not n.startswith("ctx_")]
    assert got.keys() == want.keys() and set(slide) == set(want[0])
    for i in want:
        for n in slide:
            assert math.isclose(got[i][n], want[i][n], abs_tol=1e-9), (i, n, got[i][n], want[i][n])


def against_a_queue(spark, rows, sizes, seconds, **more):
    cfg = {**ALL, "window_sizes": sizes, "time_window_seconds": seconds, **more}
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.row_id: r.asDict() for r in add_window_features(df, cfg, "double").collect()}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    want = brute([dict(zip(names, r)) for r in rows], sizes, seconds)
    assert len(got) == len(rows) and got.keys() == want.keys()
    for i in want:
        for n in want[i]:
            assert math.isclose(got[i][n], want[i][n], abs_tol=1e-9), (i, n, got[i][n], want[i][n])


@pytest.mark.parametrize("sizes,seconds,block", [([1, 3, 5], [0, 2, 9], 16), ([7, 200], [], 50), ([], [12, 9999], 7)])
def test_hot_groups_match_a_queue(spark, monkeypatch, sizes, seconds, block):
    monkeypatch.setattr(windows, "HOT_ROWS", 25)
    monkeypatch.setattr(scans, "BLOCK", block)
    against_a_queue(spark, flows(300, 5), sizes, seconds)


def test_hot_and_other_groups_in_one_table(spark, monkeypatch):
    monkeypatch.setattr(windows, "HOT_ROWS", 60)
    monkeypatch.setattr(scans, "BLOCK", 20)
    few = [(1000 + r[0], r[1], r[2] and r[2] + "few", *r[3:]) for r in flows(40, 6)]
    against_a_queue(spark, flows(300, 7) + few, [4], [5])


@pytest.mark.parametrize("time", [None, START])
def test_one_second_and_no_time_at_all_are_cut_as_well(spark, monkeypatch, time):
    monkeypatch.setattr(windows, "HOT_ROWS", 25)
    monkeypatch.setattr(scans, "BLOCK", 16)
    rows = [(*r[:2], "h", *r[3:6], time, *r[7:]) for r in flows(150, 8)]
    blocks = []
    monkeypatch.setattr(scans, "ordered", lambda df, keys, n, f=scans.ordered: blocks.append(f(df, keys, n)) or blocks[-1])
    against_a_queue(spark, rows, [6], [3])
    assert all(b.select("_block").distinct().count() >= 8 for b in blocks) and len(blocks) == 3


def test_a_million_rows_of_one_second_are_many_tasks_work(spark, monkeypatch):
    """Over 8 blocks of the rows, and of their events; every row's count, sum and largest frequency as NumPy has them."""
    n, size = 1_000_000, 1000
    value = F.pmod(F.col("id") * 7919, F.lit(10_007)) % 13
    df = spark.range(n).select(
        F.col("id").alias("row_id"), F.lit("f").alias("source_file"), F.lit("h").alias("source_ip"), F.lit(START).alias("timestamp"), value.cast("string").alias("destination_ip"),
        (F.col("id") % 50).cast("int").alias("destination_port"), F.lit(1).alias("source_port"), *[F.lit(0).alias(f"{k}_flag_count") for k in ("syn", "ack", "rst", "fin")],
        (F.col("id") % 11).cast("int").alias("total_fwd_packets"), *[F.lit(0).alias(c) for c in ("total_backward_packets", "total_length_of_fwd_packets", "total_length_of_bwd_packets")],
    )
    names = [f"win_single_dest_ratio_{size}", "time_flow_count_60s", "time_packets_sum_60s", "time_destination_ip_count_60s", "time_unique_destination_port_60s"]
    blocks = []
    monkeypatch.setattr(scans, "ordered", lambda df, keys, n, f=scans.ordered: blocks.append(f(df, keys, n)) or blocks[-1])
    got = add_window_features(df, {**ALL, "window_sizes": [size], "time_window_seconds": [60]}, "double", names).select("row_id", *names).toPandas().sort_values("row_id")
    assert all(b.select("_block").distinct().count() >= 8 for b in blocks)
    i = np.arange(n)
    v = i * 7919 % 10_007 % 13
    seen = np.zeros((13, n + 1), np.int64)
    for k in range(13):
        seen[k, 1:] = np.cumsum(v == k)
    frame = seen[:, 1:] - seen[:, np.maximum(0, i + 1 - size)]
    want = [frame.max(axis=0) / np.minimum(i + 1, size), i + 1, np.cumsum(i % 11), seen[v, i + 1], np.minimum(i + 1, 50)]
    assert len(got) == n
    for name, x in zip(names, want):
        assert np.allclose(got[name].to_numpy(), x, atol=1e-9), name


def test_only_what_is_asked_for_is_worked_out(spark):
    df = spark.createDataFrame(flows(40, 9), SCHEMA)
    cfg = {**ALL, "window_sizes": [5], "time_window_seconds": [60]}
    some = ["win_flow_count_5", "time_bytes_sum_60s", "ctx_dest_port_8080"]
    out = add_window_features(df, cfg, "double", some)
    assert set(out.columns) == {*df.columns, *some}
    assert "Python" not in out._jdf.queryExecution().toString() and "MapInArrow" not in out._jdf.queryExecution().toString()
    whole = {r.row_id: r for r in add_window_features(df, cfg, "double").collect()}
    assert all(r[n] == whole[r.row_id][n] for r in out.collect() for n in some)
    plan = add_window_features(df, cfg, "double", ["time_single_dest_ratio_60s"])._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("MapInArrow") :].split("Project [")[1].split("]")[0]
    assert "_di" in below and "packets" not in below and "row_id" not in below


def test_wide_recipes_take_one_pass_whatever_their_features(spark, monkeypatch):
    """Parts of many features come from one pass, not from a window each. Batches cut groups anywhere; fractions are added as
    windows add them, and an infinite number stays in its group."""
    few = [(1000 + r[0], r[1], r[2] and f"few{r[0] % 9}", *r[3:]) for r in flows(60, 22)]
    df = spark.createDataFrame(flows(240, 21) + few, SCHEMA).withColumns(
        {"total_fwd_packets": F.col("total_fwd_packets") * 0.1, "total_length_of_fwd_packets": F.when(F.col("row_id") % 100 == 3, math.inf).otherwise(F.col("total_length_of_fwd_packets") / 3)}
    )
    monkeypatch.setattr(windows.frames, "AT_ONCE", 16)
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cfg, got = {**ALL, "window_sizes": [7], "time_window_seconds": [9]}, {}
        for wide in (0, 1 << 30):
            monkeypatch.setattr(windows, "WIDE", wide)
            made = add_window_features(df, cfg, "double")
            plan = made._jdf.queryExecution().optimizedPlan().toString()
            got[wide] = ({r.row_id: r.asDict() for r in made.collect()}, len(re.findall(r"\bWindow \[", plan)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)
    (one, passes), (other, many) = got.values()
    assert passes <= 2 < many and one.keys() == other.keys() and len(one) == 300
    same = lambda a, b: a == b or math.isnan(a) and math.isnan(b) or math.isclose(a, b, abs_tol=1e-9)
    for i in one:
        for n in feature_names(cfg):
            assert same(one[i][n], other[i][n]), (i, n, one[i][n], other[i][n])
    assert any(math.isnan(r["win_bytes_sum_7"]) for r in one.values()) and any(math.isfinite(r["win_bytes_sum_7"]) and r["win_bytes_sum_7"] > 0 for r in one.values())


def test_the_shipped_recipe_goes_through_arrays(spark):
    from flowlark.plans.registry import QUERIES

    plan = QUERIES["window_shipped_recipe"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and len(re.findall(r"\bWindow \[", plan)) <= 2


def test_worked_example(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [
        (k + 1, "a", "10.0.0.1", sp, di, dp, at(k / 2), syn, ack, 0, 0, fwd, bwd, fb, bb)
        for k, (sp, di, dp, syn, ack, fwd, bwd, fb, bb) in enumerate(
            [(8080, "x", 80, 1, 1, 1, 0, 100, 0), (8080, "x", 80, 1, 1, 2, 0, 120, 0), (4242, "y", 443, 0, 1, 10, 1, 2000, 300), (8080, "x", 80, 1, 1, 1, 0, 100, 0), (51515, "x", 8080, 0, 1, 2, 0, 110, 0)]
        )
    ]
    on = {f"include_{k}": True for k in ("periodicity", "botnet_context", "low_slow")}
    out = add_window_features(spark.createDataFrame(rows, SCHEMA), {**on, "window_sizes": [3], "time_window_seconds": [60]}).orderBy("row_id").collect()
    expected = {
        "win_flow_count_3": [1, 2, 3, 3, 3], "win_destination_port_count_3": [1, 2, 1, 2, 1], "win_unique_destination_port_3": [1, 1, 2, 2, 3],
        "win_new_destination_port_indicator_3": [1, 0, 1, 0, 1], "win_packets_sum_3": [1, 3, 14, 14, 14], "win_low_slow_repeat_count_3": [1, 2, 2, 2, 2], "win_burst_count_3": [0, 1, 2, 3, 3],
        "time_flow_count_60s": [1, 2, 3, 4, 5], "time_destination_port_count_60s": [1, 2, 1, 3, 1], "time_destination_ip_count_60s": [1, 2, 1, 3, 4],
    }
    for name, want in expected.items():
        assert [r[name] for r in out] == want, name


def test_names_and_recipes():
    assert len(feature_names(SHIPPED)) == 154 and len(feature_names()) == 148
    full = feature_names({**ALL, "window_sizes": [9], "time_window_seconds": [9]})
    assert sum(n.startswith("win_") for n in full) == 31 and sum(n.startswith("time_") for n in full) == 32
    assert len(set(full)) == len(full)
    fallen = recipe({}, {"protocol"})
    assert fallen["destination_port_column"] == "protocol" and not fallen["include_service_context"]
    assert recipe({}, set())["destination_port_column"] is None
    assert recipe({"flag_columns": {"syn": "s"}})["flag_columns"] == {**DEFAULTS["flag_columns"], "syn": "s"}
    assert "source_port" in required_columns(recipe({"include_watched_ports": True}))
    with pytest.raises(ValueError):
        recipe({"order_by": ["row_id"]})


def test_missing_columns_are_an_error(spark):
    df = spark.createDataFrame(flows(5, 1), SCHEMA).drop("syn_flag_count")
    with pytest.raises(ValueError, match="syn_flag_count"):
        add_window_features(df)


def test_windows_stay_in_their_file_and_rows_stay_whole(spark):
    df = spark.createDataFrame(flows(40, 3), SCHEMA)
    two = df.union(df.withColumns({"source_file": F.lit("b.csv"), "row_id": F.col("row_id") + 100}))
    cfg = {"group_by": ["source_ip"], "window_sizes": [1000], "time_window_seconds": []}
    out = {r.row_id: r.win_flow_count_1000 for r in add_window_features(two, cfg).collect()}
    assert len(out) == 80 and all(out[i] == out[i + 100] for i in range(40))


def test_scopes(spark):
    df = spark.createDataFrame(flows(60, 4), SCHEMA).where("source_ip is not null")
    names = ["train", "model_selection_val", "val", "test_seen", "test_zero_day"]
    split = df.select("row_id", F.element_at(F.array(*map(F.lit, names)), (F.col("row_id") % 5 + 1).cast("int")).alias("split"))
    cfg = {"window_sizes": [1000], "time_window_seconds": []}
    made = {s: {r.row_id: r.win_flow_count_1000 for r in scoped_window_features(df, split, s, cfg).collect()} for s in ("full_source_file", "split_only", "causal_past_only")}
    assert all(len(m) == df.count() for m in made.values())
    assert all(made["split_only"][i] <= made["causal_past_only"][i] <= made["full_source_file"][i] for i in made["split_only"])
    with pytest.raises(ValueError):
        scoped_window_features(df, split, "other", cfg)


@pytest.mark.parametrize("hot", [1 << 17, 500])
def test_every_feature_of_a_dense_host(spark, monkeypatch, hot):
    """The query of one host's hour, whose frames hold the whole table in the end, by windows and by scans."""
    from flowlark.plans.registry import QUERIES
    from flowlark.plans.views import DENSE_FLOWS, view

    monkeypatch.setattr(windows, "HOT_ROWS", hot)
    monkeypatch.setattr(scans, "BLOCK", 300)
    folder = "/root/testdata/sf0.001"
    rows = [{**r.asDict(), "timestamp": r.timestamp.astimezone(dt.timezone.utc)} for r in view(spark, folder, DENSE_FLOWS).collect()]
    want = brute(rows, [1000], [3600])
    got = {r.row_id: r.asDict() for r in QUERIES["window_dense_host_all"](spark, folder).collect()}
    assert got.keys() == want.keys() and len(got[0]) == 64
    for i in want:
        for n in want[i]:
            assert math.isclose(got[i][n], want[i][n], abs_tol=2e-6), (i, n, got[i][n], want[i][n])


def test_a_tasks_rows_do_not_grow_with_the_table(spark, monkeypatch):
    """Groups are dealt to more tasks where there are more rows or more features, and features stay the same."""
    rows = [(i, "f", f"h{i % 300}", i % 7, f"d{i % 5}", i % 11, START + dt.timedelta(seconds=i // 3), *[i % 2, i % 3, 0, 1, i % 9, 2, i % 700, 40]) for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("source_file", F.lit("f"))  # a constant key must not deal them again
    names = ["win_flow_count_20", "time_dest_repeat_ratio_60s", "win_single_dest_ratio_20"]
    make = lambda: add_window_features(df, {**ALL, "window_sizes": [20], "time_window_seconds": [60]}, "double", names)
    want = sorted(make().select("row_id", *names).collect())
    monkeypatch.setattr(windows, "TASK_ROWS", 100)
    for values, tasks in ((1 << 20, 60), (150, 120)):
        monkeypatch.setattr(windows, "TASK_VALUES", values)
        got = make()
        assert got.rdd.getNumPartitions() == tasks
    assert sorted(got.select("row_id", *names).collect()) == want


def test_scans_deal_rows_by_their_numbers_only(spark, monkeypatch):
    """What blocks begin with is broadcast, whatever Spark thinks of its size: nothing is dealt by blocks for it."""
    monkeypatch.setattr(windows, "HOT_ROWS", 25)
    monkeypatch.setattr(scans, "BLOCK", 16)
    df = spark.createDataFrame([(*r[:2], "h", *r[3:]) for r in flows(150, 12)], SCHEMA)
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = add_window_features(df, {**ALL, "window_sizes": [6], "time_window_seconds": [3]}, "double")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert re.search(r"hashpartitioning\(_gid#\d+L, _rn#\d+L", plan) and not re.search(r"hashpartitioning\(_gid#\d+L, _block#\d+L", plan)


def test_millionths_are_those_of_round(spark):
    from flowlark.plans.window_queries import sixth

    r = random.Random(3)
    xs = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, -1e-12, 5e-7, -5e-7, 1e17, -1e300, 537719024.9020485, -275249721.5836645, *[(k + 0.5) / 1e6 for k in range(-500, 500)]]
    xs += [r.uniform(-2, 2) * 10 ** r.randint(-8, 12) for _ in range(20_000)] + [r.randint(-(10**9), 10**9) / 10 ** r.randint(3, 7) for _ in range(20_000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", F.round("x", 6).cast("string").alias("want"), sixth(F.col("x")).cast("string").alias("got"))
    assert got.where("not (want <=> got)").collect() == [] and got.count() == len(xs)
