import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlark.operators import cleaning, fusion, groups, metrics, models, sampling, scaling, splits, thresholds
from flowlark.plans.views import EVENT_FLOWS, view
from flowlark.sources import tables


def test_names():
    assert cleaning.clean_name(" Flow Bytes/s ") == "flow_bytes_s"
    assert cleaning.clean_names(["A b", "a-b", "A.b", "Avg Packet Size"]) == ["a_b", "a_b_1", "a_b_2", "average_packet_size"]


def test_csv_folder_is_read_cleaned_and_written(spark, tmp_path):
    (tmp_path / "Monday-x.csv").write_text("Label, Flow Bytes/s,Timestamp,Dup,Dup\nBENIGN,1.5,3/7/2017 8:55:58,1,2\nDoS Hulk,Infinity,4/7/2017 8:55,1,2\nBENIGN,1.5,3/7/2017 8:55:58,1,2\n")
    (tmp_path / "Tuesday-y.csv").write_text("label,flow bytes/s,extra\nBot,NaN,7\n")
    (tmp_path / "ignored.parquet").write_text("")
    raw = tables.load_raw(spark, str(tmp_path))
    assert [r.row_id for r in raw.orderBy("row_id").collect()] == [0, 1, 2, 3]
    assert {"dup", "dup_1", "extra", "flow_bytes_s", "source_file", "day_of_week"} <= set(raw.columns)
    done = cleaning.clean(raw)
    got = {r.row_id: r for r in done.collect()}
    assert got.keys() == {0, 1, 3}
    assert (got[1].attack_family, got[1].flow_bytes_s, got[3].flow_bytes_s, got[3].day_of_week) == ("dos", None, None, "tuesday")
    assert got[0].timestamp == dt.datetime(2017, 7, 3, 8, 55, 58) and got[1].timestamp == dt.datetime(2017, 7, 4, 8, 55)
    report = cleaning.quality_report(cleaning.with_labels(raw), done)
    assert report["duplicates_dropped"] == 1 and report["attack_family_counts"] == {"benign": 1, "dos": 1, "botnet": 1}
    tables.write_clean(done, str(tmp_path / "clean"))
    assert spark.read.parquet(str(tmp_path / "clean")).where("source_file = 'Monday-x.csv'").count() == 2
    tables.write_json(spark, str(tmp_path / "report"), report)
    assert tables.read_json(spark, str(tmp_path / "report"))["original_rows"] == 4


def test_reading_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.discover(spark, str(tmp_path))
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.txt")


def test_month_first_only_if_nothing_is_day_first(spark):
    one = spark.createDataFrame([("1/31/2020 0:00",), ("2/29/2020 0:00",)], "timestamp string")
    assert [r.timestamp.month for r in cleaning.parse_timestamps(one).orderBy("timestamp").collect()] == [1, 2]
    both = spark.createDataFrame([("1/31/2020 0:00",), ("3/2/2020 0:00",)], "timestamp string")
    assert [r.timestamp for r in cleaning.parse_timestamps(both).collect()] == [None, dt.datetime(2020, 2, 3)]


def test_unknown_label_stops(spark):
    with pytest.raises(Exception, match="unknown label"):
        cleaning.with_labels(spark.createDataFrame([("Newest",)], "label string")).collect()


def test_recipe_file(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("window_sizes: [5, 6]\ngroup_by:\n  - a\n  - b\nflag_columns:\n  syn: s\nenabled: true # yes\nrate: 0.5\nname: 'x'\n")
    assert tables.read_recipe(spark, str(tmp_path / "r.yaml")) == {"window_sizes": [5, 6], "group_by": ["a", "b"], "flag_columns": {"syn": "s"}, "enabled": True, "rate": 0.5, "name": "x"}


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, None, 2, "a"), (1, None, None, "b")], "one int, none int, part int, two string")
    assert cleaning.constant_columns(df, df.columns) == ["one", "none"]


def test_scaler_cases(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (None, 3.0)], "a double, b double")
    model = scaling.fit_robust_scaler(df, ["a", "b"])
    out = model.transform(spark.createDataFrame([(None, 2.0), (float("inf"), 4.0)], "a double, b double")).collect()
    assert all(r.a == 0 and math.isfinite(r.b) for r in out)
    for bad in (lambda: scaling.fit_robust_scaler(df, ["c"]), lambda: model.transform(df.drop("b")), lambda: scaling.fit_robust_scaler(df.limit(0), ["a"])):
        with pytest.raises(ValueError):
            bad()
    zeros = spark.range(1000).select(F.lit(0.0).alias("ctx_dest_port_8080"), F.lit(0.0).alias("rare_numeric"))
    rare = scaling.fit_robust_scaler(zeros, zeros.columns).transform(spark.createDataFrame([(1.0, 1.0)], "ctx_dest_port_8080 double, rare_numeric double")).first()
    assert (rare.ctx_dest_port_8080, rare.rare_numeric) == (1.0, 0.0)
    assert scaling.is_indicator("win_new_destination_port_indicator_50") and not scaling.is_indicator("win_bytes_sum_50")


def test_scaler_matches_numpy(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=400) ** 3
    x[::7] = np.nan
    model = scaling.fit_robust_scaler(spark.createDataFrame([(float(v),) for v in x], "x double"), ["x"])
    lo, hi = np.nanquantile(x, [0.001, 0.999])
    c = np.clip(x, lo, hi)
    c = np.where(np.isnan(c), np.nanmedian(c), c)
    s = model.stats["x"]
    assert np.allclose([s["low"], s["high"], s["mean"], s["std"]], [lo, hi, c.mean(), c.std()])


def scored(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "score double")


def test_thresholds(spark):
    cut = lambda v, t, **k: thresholds.threshold_for_fpr(scored(spark, v), t, **k)
    assert cut([0.1, 0.2, 0.3, 0.4], 0.25) == {"threshold": 0.4, "calibration_fpr": 0.25, "target_fpr": 0.25}
    assert cut([0, 0, 0, 1], 0.25)["threshold"] == 1
    zero = cut([0.1, 0.2, 0.2], 0.0)
    assert zero["threshold"] > 0.2 and zero["calibration_fpr"] == 0
    tied = cut([1.0] * 5, 0.2)
    assert tied["threshold"] > 1 and tied["calibration_fpr"] == 0
    assert cut([1.0] * 5, 0.2, fallback="percentile")["calibration_fpr"] <= 0.2
    jittered = cut([0.5] * 40, 0.25, jitter=True)
    assert 0.5 <= jittered["threshold"] <= 0.5 + 1e-7 and jittered["calibration_fpr"] <= 0.25
    for bad in (lambda: cut([float("nan")], 0.1), lambda: cut([], 0.1), lambda: cut([1], 1.5), lambda: cut([1], 0.1, fallback="x")):
        with pytest.raises(ValueError):
            bad()


def test_confusion_and_areas(spark):
    df = spark.createDataFrame([(0, "benign", 0.0), (0, "benign", 1.0), (1, "dos", 1.0), (1, "dos", 0.0)], "y int, family string, score double")
    r = metrics.metrics_at(df, 0.5).first()
    assert (r.tp, r.fp, r.tn, r.fn, r.z_dr, r.fpr) == (1, 1, 1, 1, 0.5, 0.5)
    assert metrics.areas(df).first().roc_auc == 0.5
    assert metrics.areas(df.where("y = 1")).first().roc_auc is None
    assert metrics.metrics_at(df.limit(0), 0.5).first().f1 == 0.0


def test_histogram_of_equal_scores(spark):
    df = scored(spark, [2, 2, 2]).withColumn("y", F.lit(1))
    assert [(r.bin, r.n) for r in metrics.histogram(df).collect()] == [(0, 3)]


def test_running_totals_over_many_values(spark):
    df = spark.range(5000).select((F.col("id") % 997).cast("double").alias("k"), F.lit(1).alias("n")).groupBy("k").agg(F.sum("n").alias("n"))
    got = {r.k: r.total_n for r in metrics.running_totals(df, "k", ["n"]).collect()}
    assert got == {k: sum(1 for i in range(5000) if i % 997 >= k) for k in range(997)}


def candidates(spark):
    grid = spark.createDataFrame([(k, 0.01 * (k + 1), 0.0, s, z, f, f1, f1, f1) for k, (z, f, f1) in enumerate([(0.5, 0.02, 0.6), (0.9, 0.2, 0.9), (0.7, 0.04, 0.8)]) for s in ("val", "test_seen", "test_zero_day")],
                                 "grid_index int, target_fpr double, calibration_fpr double, split string, z_dr double, fpr double, f1 double, recall double, precision double")
    return thresholds.candidates(grid, ["grid_index", "target_fpr", "calibration_fpr"])


def test_selection(spark):
    rows = candidates(spark)
    best = thresholds.primary_candidate(rows).first()
    assert (best.grid_index, best.fpr_status) == (2, "PASS")
    assert thresholds.primary_candidate(rows, 0.001).first().grid_index == 0
    assert thresholds.best_under(rows).isEmpty()
    assert thresholds.budget_row(rows, 0.02).first().grid_index == 1
    assert thresholds.budget_row(rows, 0.045).first().grid_index == 2
    assert thresholds.budget_row(rows, 0.001).first().grid_index == 0


def split_rows(spark):
    rows = [(i, f, f, "a.csv", f"{f}{k // 2}-{k % 2}", "d", 80) for i, (f, k) in enumerate((f, k) for f, n in (("benign", 20), ("botnet", 16), ("ddos", 16), ("dos", 10)) for k in range(n))]
    return spark.createDataFrame(rows, "row_id long, attack_family string, original_label string, source_file string, source_ip string, destination_ip string, destination_port int")


def test_split_properties(spark, tmp_path):
    df = split_rows(spark)
    out = splits.leave_one_family_out(df, "dos", splits.EXACT_FLOW, seed=7, ratios=(0.6, 0.2, 0.1, 0.1), selection=0.25)
    splits.check_split(out, "dos", splits.EXACT_FLOW)
    assert out.count() == df.count() == out.select("row_id").distinct().count()
    by = tables.checked_counts(out)
    assert set(by) == {"train", "model_selection_val", "val", "test_seen", "test_zero_day"}
    assert {r.attack_family for r in out.where("split = 'test_zero_day'").collect()} == {"benign", "dos"}
    again = splits.leave_one_family_out(df, "dos", splits.EXACT_FLOW, seed=7, ratios=(0.6, 0.2, 0.1, 0.1), selection=0.25)
    assert sorted(out.select("row_id", "split").collect()) == sorted(again.select("row_id", "split").collect())
    tables.write_splits(out, str(tmp_path))
    assert tables.read_splits(spark, str(tmp_path)).count() == df.count()
    assert splits.manifest(out, "dos")["split_counts"] == by
    with pytest.raises(ValueError):
        splits.leave_one_family_out(df, "absent")


def test_mixed_groups_go_to_one_split(spark):
    df = split_rows(spark).withColumn("source_ip", F.concat(F.lit("h"), F.col("row_id") % 9))
    out = splits.leave_one_family_out(df, "dos", splits.HOST)
    assert splits.overlapping_groups(out).isEmpty()
    assert set(out.where("split = 'test_zero_day'").select("attack_family").distinct().toPandas().attack_family) <= {"benign", "dos"}


def test_dealing_follows_the_ratios():
    weights = {f"k{i}": i % 7 + 1 for i in range(200)}
    held = {}
    for k, s in splits.deal(weights, {"train": 0.7, "val": 0.2, "test": 0.1}).items():
        held[s] = held.get(s, 0) + weights[k]
    total = sum(weights.values())
    assert all(abs(held[s] / total - r) < 0.02 for s, r in (("train", 0.7), ("val", 0.2), ("test", 0.1)))


def test_dealing_sizes_is_dealing_groups():
    r = np.random.default_rng(5)
    for ratios in ({"train": 0.7, "val": 0.1, "test_seen": 0.1, "test_zero_day": 0.1}, {"train": 0.85, "model_selection_val": 0.15}, {"a": 0.5, "b": 0.5, "c": 0.0}):
        for top, groups in ((1, 1000), (6, 900), (300, 400), (5, 3)):
            weights = {f"k{i}": int(n) for i, n in enumerate(r.integers(1, top + 1, groups))}
            want = {}
            for k, s in splits.deal(weights, ratios).items():
                want[weights[k], s] = want.get((weights[k], s), 0) + 1
            sizes = {n: list(weights.values()).count(n) for n in set(weights.values())}
            assert {(n, s): c for n, d in splits.deal_sizes(sizes, ratios).items() for s, c in d.items() if c} == want


def test_groups_stay_off_the_driver(spark, monkeypatch):
    made, create = [], type(spark).createDataFrame
    rows = spark.range(6000).select(F.concat(F.lit("g"), (F.col("id") % 3000 + F.col("id") % 2 * 7000)).alias("key"), F.when(F.col("id") % 300 == 7, "dos").when(F.col("id") % 10 < 3, "bot").otherwise("benign").alias("family"))
    groups = rows.groupBy("key", "family").agg(F.count("*").alias("n")).unionByName(spark.createDataFrame([("none", None, 3)], "key string, family string, n long"))
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: (made.append(len(data)), create(self, data, *a, **b))[1])
    monkeypatch.setattr(splits, "PLACES", 100, raising=False)
    out = splits.split_groups(groups, "dos").join(groups, "key").select("key", "split", "family", "n").toPandas()
    assert max(made) < 50
    assert len(out) == groups.count() and out.groupby("key").split.nunique().max() == 1 and set(out[out.family == "dos"].split) == {"test_zero_day"}
    free = out[~out.key.isin(out[out.family == "dos"].key)]
    for family, ratios in (("bot", {"train": 0.7, "val": 0.1, "test_seen": 0.1}), ("benign", {"train": 0.7, "val": 0.1, "test_seen": 0.1, "test_zero_day": 0.1})):
        mine = free[free.family == family].assign(split=lambda x: x.split.replace("model_selection_val", "train"))
        want = {}
        for k, s in splits.deal(dict(zip(mine.key, mine.n)), ratios).items():
            want[s] = want.get(s, 0) + 1
        assert mine.split.value_counts().to_dict() == want


def test_samples_are_the_first_by_hash_without_ranking_all(spark):
    df = spark.range(30000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 == 0, "dos").otherwise("benign").alias("family"), F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("source_file"))
    hashed = df.withColumn("h", sampling.shuffled("row_id")).toPandas().sort_values(["h", "row_id"])
    got = sampling.sample_per_file(df, 0.11)
    want = {i for _, g in hashed.groupby("source_file", dropna=False) for i in g.row_id.head(round(len(g) * 0.11))}
    assert {r.row_id for r in got.collect()} == want
    got = {r.row_id for r in sampling.balanced_sample(df, 700, 1.5).collect()}
    assert got == set(hashed[hashed.family == "dos"].row_id.head(700)) | set(hashed[hashed.family == "benign"].row_id.head(1050))
    edge = sampling.first_by_hash(df, "family", df.select("family").distinct().withColumn("_most", F.lit(40)))
    assert edge.count() == 80
    assert sampling.first_by_hash(df, "family", df.select("family").distinct().withColumn("_most", F.lit(10**6))).count() == 30000


def test_exact_quantiles_are_percentiles(spark):
    df = spark.range(5000).select((F.xxhash64("id") % 1000 / 7).alias("a"), F.when(F.col("id") % 3 == 0, F.col("id") % 4).cast("double").alias("b c"), F.lit(None).cast("double").alias("none"), F.lit(2.5).alias("same"))
    shares = [0.0, 0.001, 0.37, 0.5, 0.999, 1.0]
    want = df.agg(*[F.percentile(f"`{c}`", F.array(*map(F.lit, shares))).alias(str(k)) for k, c in enumerate(df.columns)]).first()
    assert metrics.exact_quantiles(df.toDF("a", "b", "none", "same"), ["a", "b", "none", "same"], shares) == list(want)
    assert metrics.exact_quantiles(df.limit(0).toDF("a", "b", "none", "same"), ["a"], [0.5]) == [None]


def test_samples(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 == 0, "dos").when(F.col("id") % 10 == 1, "bot").otherwise("benign").alias("family"), (F.col("id") % 3).cast("string").alias("source_file"))
    assert sampling.sample_rows(df, 30).count() == 30
    assert sampling.sample_rows(df, 30).collect() == sampling.sample_rows(df.repartition(5), 30).collect()
    counts = {r.family: r["count"] for r in sampling.balanced_sample(df, 50, 2.0).groupBy("family").count().collect()}
    assert counts == {"dos": 50, "bot": 50, "benign": 200}
    assert sampling.balanced_sample(df, 50, 2.0, total=60).count() == 60
    assert {r["count"] for r in sampling.sample_per_file(df, 0.1).groupBy("source_file").count().collect()} == {33}


def test_fusion_features_and_model(spark):
    df = spark.createDataFrame([(i, i % 2, 0.2 + 0.6 * (i % 2) + 0.001 * i, 1.0 + 2 * (i % 2)) for i in range(90)], "row_id long, y int, tree_score double, memory_score double")
    r = fusion.with_fusion_features(df).first()
    x, m = r.tree_score, r.memory_score
    grown = math.log1p(m)
    want = [x, math.log(x / (1 - x)), m, grown, x * grown, max(x, math.tanh(grown / 10)), abs(x - m), min(x, math.tanh(grown / 10))]
    assert np.allclose([r[f"fusion_{n}"] for n in fusion.NAMES], want)
    done = fusion.fit_fusion(df).transform(df)
    assert metrics.areas(done, "fusion_score").first().roc_auc > 0.99


def test_memory_autoencoder(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(3, 5))
    x = r.normal(size=(400, 3)) @ base
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "row_id long, a double, b double, c double, d double, e double")
    names = list("abcde")
    model = models.fit_memory_autoencoder(df, names, latent=4, slots=12, epochs=30, rate=1e-2, batches=1)
    error = [v.re_scalar for v in model.reconstruction_error(df, names).orderBy("row_id").collect()]
    assert np.mean(error) < 0.7 * (x**2).sum(axis=1).mean()
    row = model.represent(df, names).orderBy("row_id").first()
    assert len(row.residual) == 5 and len(row.latent) == 4 and math.isclose(row.re_scalar, error[0])
    assert models.representation_width(5, 4) == 26 and models.protected_features(3, 2) == [0, 13, 14, 15]
    assert np.allclose(models.hard_shrink(np.array([[0.5, 0.3, 0.2]]), 0.25), [[0.5 / 0.8, 0.3 / 0.8, 0]])
    with pytest.raises(ValueError):
        models.raw_features(names, ["zz"])


def test_slots_alike_cost_more_than_slots_apart():
    assert models.slot_likeness(np.eye(3))[0] == 0 and models.slot_likeness(np.ones((3, 2)))[0] == pytest.approx(1)
    assert models.slot_likeness(np.ones((1, 2)))[0] == 0 and models.slot_likeness(np.zeros((2, 2)))[0] == 0


@pytest.mark.parametrize("diversity", [0.0, 0.7])
def test_gradients_match_differences(diversity):
    r = np.random.default_rng(3)
    w = {"e1": r.normal(size=(3, 6)), "e2": r.normal(size=(6, 2)), "memory": r.normal(size=(4, 2)), "d1": r.normal(size=(2, 6)), "d2": r.normal(size=(6, 3))}
    w |= {"e1b": r.normal(size=6), "e2b": r.normal(size=2), "d1b": r.normal(size=6), "d2b": r.normal(size=3)}
    x, model = r.normal(size=(5, 3)), models.MemoryAutoencoder(w, 0.0)
    grads = models._gradients(model, x, 0.0, diversity)
    loss = lambda: ((x - model.forward(x)["x_hat"]) ** 2).mean() + diversity * models.slot_likeness(w["memory"])[0]
    for k, g in grads.items():
        at = tuple(0 for _ in g.shape)
        w[k][at] += 1e-6
        up = loss()
        w[k][at] -= 2e-6
        down = loss()
        w[k][at] += 1e-6
        assert math.isclose((up - down) / 2e-6, g[at], rel_tol=1e-4, abs_tol=1e-7), k


def test_permutation_importance(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 2), float(i % 7)) for i in range(300)], "row_id long, y int, good double, noise double")
    found = models.permutation_importance(lambda d: d.withColumn("score", F.col("good")), df, ["good", "noise"])
    assert found["good"] > 0.3 and found["noise"] == 0
    assert models.selected_features(found) == ["good"] and models.selected_features(found, 0.0, ("noise",)) == ["good", "noise"]
    assert models.selected_features({"a": -1.0, "b": 0.0}) == ["a", "b"]


def test_importance_of_many_rows_is_that_of_a_whole_shuffle(spark):
    """60,000 rows: a shuffled column holds the very values it held, and the precision falls as in NumPy."""
    rng = np.random.default_rng(4)
    y = (rng.random(60_000) < 0.2).astype(int)
    x = y + rng.normal(0, 1, len(y))
    df = spark.createDataFrame(list(zip(range(len(y)), y.tolist(), x.tolist(), strict=True)), "row_id long, y int, x double").coalesce(1)
    sums = []

    def score(d):
        sums.append(d.agg(F.count("*"), F.sum("x"), F.countDistinct("row_id")).first())  # one feature: a row each
        return d.withColumn("score", F.col("x"))

    found = models.permutation_importance(score, df, ["x"], repeats=2)
    assert all(n == ids == len(y) and math.isclose(total, x.sum(), rel_tol=1e-9) for n, total, ids in sums)

    def precision(v):
        order = np.argsort(-v, kind="stable")
        hits = y[order].cumsum()
        return (y[order] * hits / np.arange(1, len(y) + 1)).sum() / y.sum()

    want = precision(x) - np.mean([precision(rng.permutation(x)) for _ in range(5)])
    assert abs(found["x"] - want) < 0.01


def test_dense_ids_of_one_large_partition(spark):
    for _ in range(3):
        got = cleaning.dense_ids(spark.range(150_000, numPartitions=1).select((F.col("id") * 7919 % 150_000).alias("k")), ["k"])
        n, least, most, ids, off = got.agg(F.count("*"), F.min("row_id"), F.max("row_id"), F.countDistinct("row_id"), F.sum((F.col("row_id") != F.col("k")).cast("int"))).first()
        assert (n, least, most, ids, off) == (150_000, 0, 149_999, 150_000, 0)
    placed = cleaning.dense_ids(spark.range(1000, numPartitions=7))
    assert all(r.id == r.row_id for r in placed.collect())


def test_two_groups_keep_the_dealing_unless_train_is_empty():
    assert splits._family_shares({10: 1, 6: 1}, False, (0.7, 0.1, 0.1, 0.1), 0.0) == splits.deal_sizes({10: 1, 6: 1}, {"train": 0.7, "val": 0.1, "test_seen": 0.1})
    assert splits._family_shares({5: 2}, False, (0.0, 0.5, 0.5, 0.0), 0.0) == {5: {"train": 1, "val": 1}}


def test_report_helpers():
    assert tables.markdown_table([{"a": 0.5, "b": None}], ["a", "b"]).splitlines()[-1] == "| 0.500000 |  |"
    now = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert tables.run_name("x y", {"x_y_20240102_030405"}, now) == "x_y_20240102_030405_1"


def test_fingerprints_and_prepared_tables(spark, tmp_path):
    import hashlib

    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/run/clean")
    got = {r.path: r for r in tables.fingerprint(spark, f"{tmp_path}/run/clean").collect() if r.path.endswith(".parquet")}
    (path, row), = got.items()
    data = open(path.removeprefix("file:"), "rb").read()
    assert (row.length, row.sha256) == (len(data), hashlib.sha256(data).hexdigest())
    assert tables.find_prepared(spark, [None, f"{tmp_path}/none", f"{tmp_path}/run"]) == f"{tmp_path}/run"
    assert tables.drop_tables(spark, f"{tmp_path}/run", ["clean", "absent"]) == ["clean"]
    for bad in (lambda: tables.find_prepared(spark, [f"{tmp_path}/run"]), lambda: tables.drop_tables(spark, str(tmp_path), [".."])):
        with pytest.raises((FileNotFoundError, ValueError)):
            bad()


def test_groups_with_missing_keys(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 1), (3, None, None), (4, "b", 1), (5, "a", None)], "row_id long, k string, v int")
    keys = spark.createDataFrame([("a", None), ("a", None), (None, None), ("z", 9)], "k string, v int")
    ids = lambda d: sorted(r.row_id for r in d.collect())
    assert ids(groups.rows_in(df, keys, ["k", "v"])) == [1, 3, 5] and ids(groups.rows_not_in(df, keys, ["k", "v"])) == [2, 4]
    assert {r.row_id: r["in"] for r in groups.with_membership(df, keys, ["k", "v"], "in").collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}
    assert [(r.k, r.n) for r in groups.group_sizes(df, ["k"], 2).collect()] == [("a", 3), ("b", 1)]
    assert {(r.k, r["1"], r["None"]) for r in groups.value_table(df, "k", [1, None], "v").collect()} == {("a", 1, 2), ("b", 1, 0), (None, 0, 1)}
    both = groups.under_each_other([df, spark.createDataFrame([(7, 2.5)], "row_id long, w double")])
    assert both.count() == 6 and both.where("row_id = 7").first().asDict() == {"row_id": 7, "k": None, "v": None, "w": 2.5}
    with pytest.raises(ValueError):
        groups.under_each_other([])


def test_samples_hold_the_rows_with_the_least_hashes(spark):
    """The members of both samples, not their number alone."""
    flows = view(spark, "/root/testdata/sf0.001", EVENT_FLOWS).select("row_id", "source_file", "attack_family")
    rows = flows.withColumn("h", sampling.shuffled("row_id", 42)).toPandas().sort_values(["h", "row_id"])
    want = {i for _, g in rows.groupby("source_file") for i in g.row_id.head(max(1, round(len(g) * 0.1)))}
    assert {r.row_id for r in sampling.sample_per_file(flows, 0.1).collect()} == want
    attacks = rows[rows.attack_family != "benign"].groupby("attack_family")
    kept = {i for _, g in attacks for i in g.row_id.head(30)}
    kept |= set(rows[rows.attack_family == "benign"].row_id.head(int(len(kept) * 2.5)))
    assert {r.row_id for r in sampling.balanced_sample(flows, 30, 2.5, family="attack_family").collect()} == kept


def test_recipes_in_whole_yaml(spark, tmp_path, monkeypatch):
    text = "window_sizes: [5, 50]  # rows\nservice_family_ports:\n  web:\n    - 80\n    - 443\n  other: {a: 1}\nburst_gap_seconds: 1.5\nnote: >\n  two\n  lines\n"
    (tmp_path / "r.yaml").write_text(text)
    path = f"file://{tmp_path}/r.yaml"
    if tables.yaml is not None:
        assert tables.read_recipe(spark, path) == {"window_sizes": [5, 50], "service_family_ports": {"web": [80, 443], "other": {"a": 1}}, "burst_gap_seconds": 1.5, "note": "two lines\n"}
        (tmp_path / "l.yaml").write_text("- 1\n- 2\n")
        with pytest.raises(ValueError):
            tables.read_recipe(spark, f"file://{tmp_path}/l.yaml")
    monkeypatch.setattr(tables, "yaml", None)
    (tmp_path / "p.yaml").write_text("window_sizes: [5]\nports:\n  web: [80]\n")
    assert tables.read_recipe(spark, f"file://{tmp_path}/p.yaml") == {"window_sizes": [5], "ports": {"web": [80]}}
