"""Training on the executors, the transformer, staged boosting and importance, against NumPy."""

import math
import time
from contextlib import nullcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlark.operators import fusion, models, sampling, thresholds, training, transformer
from flowlark.plans.registry import QUERIES
from flowlark.plans.table_queries import scores
from flowlark.sources import artifacts


def frame(spark, x, y=None):
    names = [f"c{k}" for k in range(x.shape[1])]
    rows = [(i, int(y[i]) if y is not None else 0, *map(float, v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, y int, " + ", ".join(f"{c} double" for c in names)), names


def average_precision(y, score):
    order = np.argsort(-score, kind="stable")
    y, score = y[order], score[order]
    last = np.append(np.flatnonzero(np.diff(score)), len(y) - 1)  # of each distinct score
    hits = y.cumsum()[last]
    return float((np.diff(hits, prepend=0) * hits / (last + 1)).sum() / y.sum())


def test_rounds_are_those_of_numpy_on_the_union(spark):
    """Three rounds of the autoencoder over seven partitions: the same weights as from all rows at once."""
    r = np.random.default_rng(1)
    x = r.normal(size=(900, 3))
    df, names = frame(spark, x)
    rows = training.dealt(df.repartition(7), names, "row_id", None, 2, 5).persist()
    assert rows.count() == 900 and 40 < rows.where("_batch = -1").count() < 160
    small = lambda *s: r.normal(0, 0.4, s)
    w = {"e1": small(3, 70), "e2": small(70, 2), "memory": small(5, 2), "d1": small(2, 70), "d2": small(70, 3), "e1b": small(70), "e2b": small(2), "d1b": small(70), "d2b": small(3)}
    union = {k: np.array([v.x for v in rows.where(F.col("_batch") == k).collect()]) for k in (0, 1)}

    def gradient(w, x, y):
        return {k: g * len(x) for k, g in models._gradients(models.MemoryAutoencoder(w, 0.0), x, 2e-4).items()}, 0.0

    mine, theirs = {k: v.copy() for k, v in w.items()}, {k: v.copy() for k, v in w.items()}
    a, b = training.Adam(mine, 1e-2), training.Adam(theirs, 1e-2)
    for k in (0, 1, 0):
        g, _, n = training.summed(rows.where(F.col("_batch") == k), mine, gradient, 64)
        assert n == len(union[k])
        a.step(mine, {c: v / n for c, v in g.items()})
        b.step(theirs, models._gradients(models.MemoryAutoencoder(theirs, 0.0), union[k], 2e-4))
    assert all(np.allclose(mine[k], theirs[k], atol=1e-10) for k in w)


def test_equal_rows_are_learnt_from_once_with_their_number(spark):
    """A batch of copies holds each row once; sums, counts and gradients are those of all rows."""
    r = np.random.default_rng(7)
    base = r.normal(size=(40, 3))
    df, names = frame(spark, base[r.integers(0, 40, 2000)])
    plain, merged = training.dealt(df, names, "row_id", None, 2, 5), training.dealt(df, names, "row_id", None, 2, 5, merged=True)
    assert merged.count() <= 3 * 40 and merged.agg(F.sum("n")).first()[0] == 2000
    small = lambda *s: r.normal(0, 0.4, s)
    w = {"e1": small(3, 70), "e2": small(70, 2), "memory": small(5, 2), "d1": small(2, 70), "d2": small(70, 3), "e1b": small(70), "e2b": small(2), "d1b": small(70), "d2b": small(3)}
    model = models.MemoryAutoencoder(w, 0.1)
    for k in (-1, 0, 1):
        a = training.summed(plain.where(F.col("_batch") == k), w, lambda w, x, y: ({c: g * len(x) for c, g in models._gradients(model, x, 2e-2).items()}, float(len(x))), 64)
        b = training.summed(merged.where(F.col("_batch") == k), w, lambda w, x, y, n: ({c: g * n.sum() for c, g in models._gradients(model, x, 2e-2, number=n).items()}, float(n.sum())), 64)
        assert a[1:] == b[1:] and all(np.allclose(a[0][c], b[0][c], atol=1e-9) for c in w)


def test_copies_are_counted_under_one_key_for_all_batches(spark, monkeypatch):
    """What is moved is a row for each different row, not for each and batch; with very many batches the counts are the same."""
    df = spark.range(4000).selectExpr("cast(id % 50 AS double) AS _x0", "0.0D AS y", "cast(id % 7 - 1 AS int) AS _batch")
    few = training.counted(df, ["_x0"], 6)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_x0" in plan and "_batch" not in plan.split("hashpartitioning(")[1].split(")")[0]
    monkeypatch.setattr(training, "COUNTED", 5)
    many = training.counted(df, ["_x0"], 6)
    got = sorted(few.select("_x0", "_batch", "n").collect())
    assert got == sorted(many.select("_x0", "_batch", "n").collect()) and len(got) == 350 and sum(r.n for r in got) == 4000


def test_scaler_takes_all_quantiles_of_a_column_at_once(spark, monkeypatch):
    from flowlark.operators import scaling

    asked = []
    monkeypatch.setattr(scaling, "exact_quantiles", lambda df, columns, shares, f=scaling.exact_quantiles: asked.append(shares) or f(df, columns, shares))
    x = np.random.default_rng(5).lognormal(size=3001)
    df = spark.createDataFrame([(float(v), None) for v in x] + [(None, None)] * 40, "a double, b double")
    s = scaling.fit_robust_scaler(df, ["a", "b"]).stats
    low, high = np.quantile(x, [scaling.LOW, scaling.HIGH])
    full = np.append(np.clip(x, low, high), [np.median(np.clip(x, low, high))] * 40)
    assert len(asked) == 1 and np.allclose([s["a"][k] for k in ("low", "high", "median", "mean", "std")], [low, high, np.median(np.clip(x, low, high)), full.mean(), full.std()])
    assert s["b"] == {"low": 0.0, "high": 0.0, "median": 0.0, "mean": 0.0, "std": 1.0}


def test_few_brackets_of_quantiles_are_compared_without_a_join(spark, monkeypatch):
    """What lies in a few brackets is found by literals, in many by a join: the same exact quantiles."""
    from flowlark.operators import metrics

    r = np.random.default_rng(6)
    x = np.stack([r.lognormal(size=2500), np.round(r.normal(size=2500), 1)], axis=1)
    df = spark.createDataFrame([tuple(map(float, v)) for v in x] + [(None, None)] * 9, "a double, b double")
    shares = [0.001, 0.5, 0.999]
    joined, want = [], np.quantile(x, shares, axis=0).T
    monkeypatch.setattr(type(df), "unpivot", lambda self, *a, f=type(df).unpivot: joined.append(1) or f(self, *a))
    for literals, joins in ((metrics.LITERALS, 0), (0, 1)):
        monkeypatch.setattr(metrics, "LITERALS", literals)
        assert np.allclose(metrics.exact_quantiles(df, ["a", "b"], shares), want) and len(joined) == joins


def test_training_stops_and_keeps_the_best(spark):
    df, names = frame(spark, np.random.default_rng(2).normal(size=(200, 2)))
    rows = training.dealt(df, names, "row_id")
    seen = []

    def gradient(w, x, y):  # towards 1, and past it
        return {"a": np.full(1, -1.0 * len(x))}, 0.0

    def loss(w, x, y):
        return float(abs(w["a"][0] - 0.3) * len(x))

    out = training.train(rows, {"a": np.zeros(1)}, gradient, loss, lambda w: seen.append(w["a"][0]) or {}, epochs=30, rate=0.1, patience=2, plateau=9)
    assert math.isclose(out["a"][0], 0.3, abs_tol=1e-6) and len(seen) == 5
    with pytest.raises(ValueError):
        training.train(rows.limit(0), {"a": np.zeros(1)}, gradient)


def test_error_function():
    x = np.concatenate([np.linspace(-7, 7, 5001), [0.0, 1e-9, -50, 50]])
    assert np.abs(transformer.erf(x) - [math.erf(v) for v in x]).max() < 1e-9


@pytest.mark.parametrize("pooling", transformer.POOLING)
def test_transformer_gradients_match_differences(pooling):
    r = np.random.default_rng(3)
    t = transformer.NumericTransformer.random(3, embed=4, heads=2, depth=2, latent=3, seed=4, pooling=pooling)
    for v in t.weights.values():
        v += r.normal(0, 0.3, v.shape)
    x, y = r.normal(size=(5, 3)), np.array([0.0, 1, 1, 0, 1])
    g, loss = t.gradients(x, y, 2.5)
    assert math.isclose(loss, t.loss(x, y, 2.5)) and g.keys() == t.weights.keys()
    for k, own in g.items():
        assert own.shape == t.weights[k].shape, k
        for at in {tuple(int(v) for v in r.integers(0, own.shape)) for _ in range(3)}:
            held = t.weights[k][at]
            t.weights[k][at] = held + 1e-5
            up = t.loss(x, y, 2.5)
            t.weights[k][at] = held - 1e-5
            down = t.loss(x, y, 2.5)
            t.weights[k][at] = held
            assert math.isclose((up - down) / 2e-5, own[at], rel_tol=1e-4, abs_tol=1e-6), (k, at)


def plain(t, x):
    """The transformer row by row and head by head."""
    w, out = t.weights, []
    norm = lambda v, g, b: np.array([(u - u.mean()) / math.sqrt(u.var() + 1e-5) * g + b for u in np.atleast_2d(v)])
    bend = np.vectorize(lambda v: v * 0.5 * (1 + math.erf(v / math.sqrt(2))))
    for row in x:
        tokens = np.vstack([w["cls"], row[:, None] * w["scale"] + w["shift"]])
        size = tokens.shape[1] // t.heads
        for k in range(t.depth):
            q, key, v = np.split(norm(tokens, w[f"g1_{k}"], w[f"b1_{k}"]) @ w[f"qkv{k}"] + w[f"qkvb{k}"], 3, axis=1)
            heads = []
            for h in range(t.heads):
                s = slice(h * size, (h + 1) * size)
                e = np.exp(q[:, s] @ key[:, s].T / math.sqrt(size))
                heads.append(e / e.sum(axis=1, keepdims=True) @ v[:, s])
            tokens = tokens + np.hstack(heads) @ w[f"o{k}"] + w[f"ob{k}"]
            a, gate = np.split(norm(tokens, w[f"g2_{k}"], w[f"b2_{k}"]) @ w[f"up{k}"] + w[f"upb{k}"], 2, axis=1)
            tokens = tokens + (a * bend(gate)) @ w[f"down{k}"] + w[f"downb{k}"]
        tokens = norm(tokens, w["g"], w["b"])
        pooled = {"cls": tokens[0], "mean": tokens[1:].mean(axis=0), "cls_mean": np.concatenate([tokens[0], tokens[1:].mean(axis=0)])}[t.pooling]
        out.append(norm(bend(pooled @ w["project"] + w["projectb"]), w["gp"], w["bp"])[0])
    return np.array(out)


def test_transformer_saved_loaded_and_applied(spark, tmp_path):
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 4))
    df, names = frame(spark, x)
    for pooling in transformer.POOLING:
        t = transformer.NumericTransformer.random(4, embed=8, heads=4, depth=2, latent=6, pooling=pooling)
        for v in t.weights.values():
            v += r.normal(0, 0.2, v.shape)
        artifacts.save_transformer(spark, t, f"file://{tmp_path}/{pooling}")
        again = artifacts.load_transformer(spark, f"file://{tmp_path}/{pooling}")
        assert (again.heads, again.depth, again.pooling) == (4, 2, pooling)
        got = again.apply(df, names).orderBy("row_id").collect()
        want = plain(t, x)
        assert np.allclose([v.representation for v in got], want, atol=1e-6)
        assert np.allclose([v.transformer_score for v in got], 1 / (1 + np.exp(-(want @ t.weights["head"] + t.weights["headb"]))), atol=1e-6)
        flat = again.flat(df, names)
        assert flat.columns == ["row_id", *again.columns()]
    with pytest.raises(ValueError):
        transformer.NumericTransformer.random(4, embed=6, heads=4)


def test_transformer_learns_what_no_column_tells_alone(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(1500, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    df, names = frame(spark, x, y)
    t = transformer.fit_transformer(df, names, embed=16, heads=2, depth=2, latent=8, epochs=12, rate=1e-2, batches=4)
    got = {v.row_id: v.transformer_score for v in t.apply(df, names).collect()}
    score = np.array([got[i] for i in range(len(y))])
    assert average_precision(y, score) > 0.9
    with pytest.raises(ValueError):
        transformer.fit_transformer(df.where("y = 1"), names)


def test_trees_are_cut_at_the_round_with_the_best_precision(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(1200, 3))
    y = ((x[:, 0] + 0.8 * r.normal(size=1200)) > 0.8).astype(int)
    df, names = frame(spark, x, y)
    df = df.withColumn("held", F.col("row_id") % 3 == 0)
    model = models.fit_trees(df, names, depth=4, rounds=12, rate=0.3, validation="held")
    trees, weights = model.pipeline.stages[1].trees, model.pipeline.stages[1].treeWeights
    assert len(trees) == 12
    from pyspark.ml.linalg import Vectors

    held = np.arange(1200) % 3 == 0
    single = np.array([[t.predict(Vectors.dense(v)) for t in trees] for v in x[held]])
    margins = (single * weights).cumsum(axis=1)
    found = models.precision_by_round(model.__class__(model.pipeline, 12), df.where("held"))
    want = [average_precision(y[held], 1 / (1 + np.exp(-2 * margins[:, k]))) for k in range(12)]
    assert np.allclose([found[k + 1] for k in range(12)], want, atol=1e-9)
    assert model.rounds == int(np.argmax(np.round(want, 12))) + 1
    got = {v.row_id: v.tree_score for v in models.tree_scores(model, df.where("held")).collect()}
    assert np.allclose([got[i] for i in np.flatnonzero(held)], 1 / (1 + np.exp(-2 * margins[:, model.rounds - 1])))
    whole = {v.row_id: v.probability[1] for v in model.pipeline.transform(df).collect()}
    full = {v.row_id: v.tree_score for v in models.tree_scores(models.BoostedTrees(model.pipeline, 12), df).collect()}
    assert all(math.isclose(whole[i], full[i], abs_tol=1e-12) for i in whole)


def test_importance_of_many_features_in_one_pass(spark, monkeypatch):
    """60,000 rows and 50 features: the precisions are those of NumPy for the very same shuffles, within a minute."""
    n, k = 60_000, 50
    weights = np.zeros(k)
    weights[:5] = [1.0, 0.7, 0.5, 0.3, 0.1]
    names = [f"c{j}" for j in range(k)]
    df = spark.range(n).select(F.col("id").alias("row_id"), F.pmod(F.xxhash64("id"), F.lit(5)).alias("_y"), *[(F.rand(j) + (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).cast("double")).alias(c) for j, c in enumerate(names)])
    df = df.withColumn("y", (F.col("_y") == 0).cast("int")).drop("_y")
    seen = []
    monkeypatch.setattr(models, "scratch", lambda spark: nullcontext())  # the shuffled rows are looked at below

    def score(d):
        out = d.withColumn("score", F.round(sum(F.col(c) * float(w) for c, w in zip(names, weights) if w), 6))
        seen.append(out)
        return out

    began = time.time()
    found = models.permutation_importance(score, df, names, repeats=1)
    assert time.time() - began < 60
    assert all(found[c] == 0 for c in names[5:])
    base = seen[0].select("y", "score").toPandas()
    ap = average_precision(base.y.to_numpy(), base.score.to_numpy())
    for j in (0, 4, 30):
        moved = seen[1].where(F.col("_k") == j).select("row_id", "y", "score", names[j]).toPandas()
        assert len(moved) == n and moved.row_id.nunique() == n
        assert math.isclose(found[names[j]], ap - average_precision(moved.y.to_numpy(), moved.score.to_numpy()), abs_tol=1e-9)
    assert found["c0"] > found["c1"] > found["c3"] > 0


def test_holdout_takes_its_share_of_every_family_and_class(spark):
    r = np.random.default_rng(9)
    rows = [(i, ["benign", "dos", "bot", None][k], int(k in (1, 2))) for i, k in enumerate(r.choice(4, 3000, p=[0.9, 0.07, 0.02, 0.01]))]
    df = spark.createDataFrame(rows, "row_id long, family string, y int")
    made = sampling.stratified_holdout(df, 0.2, ["family", "y"])
    assert made.count() == 3000
    for row in made.groupBy("family", "y").agg(F.count("*").alias("n"), F.sum(F.col("_held").cast("int")).alias("held")).collect():
        assert abs(row.held - 0.2 * row.n) <= 1, row


def test_thresholds_come_from_the_split_that_is_asked_for(spark):
    r = np.random.default_rng(10)
    rows = [(i, s, "benign" if y == 0 else "dos", y, float(round(r.random() + y * 0.3 + shift, 3)), float(round(r.random(), 3))) for i, (s, y, shift) in enumerate((s, y, 0.5 * (s == "val")) for s in ("val", "model_selection_val", "test_seen", "test_zero_day") for y in (0, 1) for _ in range(200))]
    df = spark.createDataFrame(rows, "row_id long, split string, family string, y int, tree_score double, memory_score double")
    for check in ("val", "model_selection_val"):
        benign = np.sort([v[4] for v in rows if v[1] == check and v[3] == 0])
        cut = next(v for v in np.unique(benign) if (benign >= v).mean() <= 0.05)
        grid = thresholds.budget_grid(df, (0.05,), "tree_score", validation=check)
        assert {v.threshold for v in grid.collect()} == {cut}
        row = thresholds.candidates(grid, ["model_name", "target_fpr", "calibration_fpr"], check).first()
        assert math.isclose(row.validation.fpr, (benign >= cut).mean()) and row.validation.fpr == row.calibration_fpr
        either = thresholds.either_grid(df, (0.05,), 3, validation=check)
        assert cut in {v.first_threshold for v in either.collect()}


def test_fits_go_through_equal_rows_once(spark, monkeypatch):
    """Trees and fusion see one row for all copies of it; a table and its fifty copies give the same scores."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression

    r = np.random.default_rng(12)
    rows = [(i, int(r.random() < 0.2 + 0.1 * (i % 7)), float(i % 7) / 8, float(i % 4)) for i in range(56)]
    once = spark.createDataFrame(rows, "row_id long, y int, tree_score double, memory_score double")
    many = once.crossJoin(spark.range(50).withColumnRenamed("id", "copy")).drop("copy")
    seen = []
    for kind in (GBTClassifier, LogisticRegression):
        monkeypatch.setattr(kind, "fit", lambda self, data, params=None, fit=kind.fit: seen.append(data.count()) or fit(self, data, params))
    names = ["tree_score", "memory_score"]
    read = lambda df, column: [v[column] for v in df.orderBy("row_id").collect()]
    trees = [read(models.tree_scores(models.fit_trees(df, names, depth=3, rounds=4), once), "tree_score") for df in (once, many)]
    fused = [read(fusion.fit_fusion(df).transform(once), "fusion_score") for df in (once, many)]
    assert np.allclose(*trees) and np.allclose(*fused, atol=1e-4) and max(seen) <= 56


def test_logistic_fusion_grid_is_that_of_the_fitted_score(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["logistic_fusion_grid"](spark, folder).collect()
    df = scores(spark, folder).withColumnRenamed("score", "tree_score")
    fused = fusion.fit_fusion(df.where("split = 'val'")).transform(df).toPandas()
    pool = np.sort(fused[(fused.split == "val") & (fused.family == "benign")].fusion_score.to_numpy())
    assert len(got) == len(thresholds.BUDGETS) * fused.split.nunique()
    for row in got:
        reached = [v for v in np.unique(pool) if (pool >= v).mean() <= row.target_fpr]
        cut = reached[0] if reached else np.nextafter(pool.max(), np.inf)
        assert math.isclose(row.threshold, cut, rel_tol=1e-12) and row.model_name == "logistic_fusion"
        mine = fused[fused.split == row.split]
        hit, real = mine.fusion_score.to_numpy() >= row.threshold, mine.y.to_numpy() == 1
        assert math.isclose(row.recall, (hit & real).sum() / max(1, real.sum())) and math.isclose(row.fpr, (hit & ~real).sum() / max(1, (~real).sum()))


def test_scratch_tables_go_and_others_stay(spark):
    from pathlib import Path

    from flowlark.functions.storage import fresh_path, scratch, stored

    out = fresh_path(spark, "kept")
    with scratch(spark):
        inner = stored(spark.range(5), "inner")
        with scratch(spark):
            stored(spark.range(3), "innermost")
        inner.write.parquet(out)
        gone = Path(inner.inputFiles()[0].removeprefix("file://")).parent
        assert gone.exists()
    assert not gone.exists() and spark.read.parquet(out).count() == 5
