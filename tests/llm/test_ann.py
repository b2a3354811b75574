import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlark.llm import ann
from flowlark.llm.queries import op8_nearest_neighbours

from .helpers import save

SCHEMA = "vec_id long, embedding array<float>, label int"


def check(got, rows, k=20, least=0.9):
    """Every row is right for its rank's vector, and enough of the true neighbours are there."""
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert by.keys() == {i for i in good if i % 20 == 0}
    hits = total = 0
    for q, found in by.items():
        true = sorted(((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q))[:k]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(true) + 1))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(abs(s - good[q] @ good[i]) < 1e-12 for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in true})
        total += len(true)
    assert hits >= least * total


def test_recall_copies_and_unusable_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 30)
    monkeypatch.setattr(ann, "LEAST", 20)
    monkeypatch.setattr(ann, "BLOCK", 64)
    r = np.random.default_rng(3)
    centers = r.normal(size=(12, 16))
    rows = [(i, (centers[i % 12] + 0.4 * r.normal(size=16)).tolist()) for i in range(900)]
    rows += [(i, [1.0] * 16) for i in range(900, 1200)]
    rows += [(1200, None), (1220, [0.0] * 16), (1240, [None] * 16), (1260, [float("nan")] + [1.0] * 15), (1280, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (1300, []), (1320, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("score", F.lit("clash"))
    got = op8_nearest_neighbours(spark, save(df, tmp_path, "embeddings")).collect()
    check(got, [(i, v) for i, v in rows if v is None or len(v) == 16])


@pytest.mark.parametrize("n", [0, 1, 2, 15])
def test_few_rows_give_all_candidates(spark, tmp_path, n):
    rows = [(20 * i, [float(i), 1.0, -0.5]) for i in range(n)]
    got = op8_nearest_neighbours(spark, save(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), tmp_path, "embeddings")).collect()
    assert len(got) == n * (n - 1)
    check(got, rows if n > 1 else [], least=1.0)


def test_repeated_ids(spark):
    """Equal rows count once; one id with two vectors is two queries, neither a candidate of the other."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0]), (3, [0.5, 0.5])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect()
    lists = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        lists.setdefault((r.query_id, r.query_key), []).append((r.vec_id, r.score))
    assert sorted(lists.values()) == sorted([[(1, 2.0), (2, 1.0), (3, 0.5)], [(2, 3.0), (1, 1.0), (3, 0.5)]])
