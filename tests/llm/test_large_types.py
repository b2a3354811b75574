"""One run of the queries with Arrow's large types, whose offsets have 64 bits, against a run without."""

import pytest

from flowlark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SETTING = "spark.sql.execution.arrow.useLargeVarTypes"


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select(sorted(df.columns)).collect())))


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("op7", "op10"))))
def test_large_types_change_nothing(spark, name):
    want = rows(QUERIES[name](spark, FOLDER))
    spark.conf.set(SETTING, "true")
    try:
        assert rows(QUERIES[name](spark, FOLDER)) == want
    finally:
        spark.conf.unset(SETTING)


def test_large_types_in_the_pipeline(spark):
    cp = pytest.importorskip("corpus_pipeline")
    want = rows(cp.run(spark, FOLDER))
    spark.conf.set(SETTING, "true")
    try:
        assert rows(cp.run(spark, FOLDER)) == want
    finally:
        spark.conf.unset(SETTING)
