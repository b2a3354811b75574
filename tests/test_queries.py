"""Every registered flow query against its oracle."""

import os

import pytest

from flowlark.plans.registry import ORACLE_SQL, QUERIES

from .oracle import same

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_oracle(spark, name):
    assert same(spark, name, QUERIES[name], ORACLE_SQL[name], FOLDER)[0] >= 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_oracle_has_rows(spark, name):
    assert not QUERIES[name](spark, FOLDER).isEmpty()


def test_block_shares_count_every_feature(spark, tmp_path):
    spark.range(2000).selectExpr("id AS p_partkey", "id % 50 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    assert sum(r.features for r in QUERIES["feature_block_shares_all"](spark, str(tmp_path)).collect()) == 2000


def test_second_split_in_any_row_is_found(spark, tmp_path):
    rows = [(1, 7), (3, 7), (1, 8), (6, 8), (2, 40), (5, 40)]  # only row 6, whose id is a multiple of 3, has the second split of u8
    spark.createDataFrame(rows, "event_id long, user_id long").selectExpr("event_id", "user_id", "'a' AS event_type", "'1' AS props", "current_timestamp() AS ts").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.key for r in QUERIES["groups_in_two_splits_all"](spark, str(tmp_path)).collect()} == {'{"source_ip":"u8"}'}


def test_models_are_fitted_on_all_rows_at_their_own_sizes(spark, monkeypatch):
    from flowlark.operators import models

    seen = {}

    class Stop(Exception):
        pass

    def autoencoder(df, features, **sizes):
        seen["autoencoder"] = (df.count(), sizes)
        raise Stop

    def trees(df, features, **sizes):
        seen["trees"] = sizes
        raise Stop

    monkeypatch.setattr(models, "fit_memory_autoencoder", autoencoder)
    monkeypatch.setattr(models, "fit_trees", trees)
    for name in ("memory_autoencoder", "boosted_trees"):
        with pytest.raises(Stop):
            QUERIES[name](spark, FOLDER)
    assert seen == {"autoencoder": (spark.read.parquet(f"{FOLDER}/lineitem.parquet").count(), {}), "trees": {}}
