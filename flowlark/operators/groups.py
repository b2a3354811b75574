"""Groups of rows as small tables: their sizes, and the rows that lie in some of them.

Keys that are missing are a value like any other: they make up groups, and a group with a missing key is found again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_sizes(df: DataFrame, by: list[str], most: int | None = None, name: str = "n") -> DataFrame:
    """The groups with their rows' number, the ``most`` largest ones if that is given; ties go by the keys."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    return sizes if most is None else sizes.orderBy(F.desc(name), *[F.col(c).asc_nulls_last() for c in by]).limit(most)


def value_table(df: DataFrame, rows: str, values: list, columns: str) -> DataFrame:
    """A row for each value of ``rows`` with the numbers of rows that have each of ``values`` in ``columns``; 0 where none."""
    count = lambda v: F.count(F.when(F.col(columns).eqNullSafe(F.lit(v)), 1)).alias(str(v))
    return df.groupBy(rows).agg(*map(count, values))


def _matched(df: DataFrame, keys: DataFrame, by: list[str], how: str) -> DataFrame:
    keys = keys.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(by)]).distinct()
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{k}"))
    return df.join(keys, same, how)


def rows_in(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose group is among ``groups``, each once however often the group stands there."""
    return _matched(df, groups, by, "left_semi")


def rows_not_in(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose group isn't among ``groups``."""
    return _matched(df, groups, by, "left_anti")


def with_membership(df: DataFrame, groups: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df`` with a boolean: is the row's group among ``groups``. One join, not a semi and an anti join."""
    keys = groups.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(by)]).distinct().withColumn("_in", F.lit(True))
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{k}"))
    return df.join(keys, same, "left").select(*df.columns, F.coalesce("_in", F.lit(False)).alias(name))


def under_each_other(tables: list[DataFrame]) -> DataFrame:
    """The tables' rows by name; a column that a table lacks is null there. Of differing types of a column the wider one
    is taken; none at all is an error."""
    if not tables:
        raise ValueError("no tables")
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
