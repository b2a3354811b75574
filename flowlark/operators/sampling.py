"""Bounded, repeatable samples. The order of rows is a hash of their id and a seed, so it needs no random state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shuffled(id_col: str, seed: int = 42) -> Column:
    return F.xxhash64(F.col(id_col), F.lit(seed))


#: The hash's upper bits by which rows are counted to find a sample's bound.
HASH_BITS = 12


def first_by_hash(df: DataFrame, by: str, most: DataFrame, id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """Of each group the first rows in order of their hash, as many as ``most`` (``by``, _most) says; groups that it lacks have none.

    Ranking a group would put it into one task. Instead rows are counted by the hash's upper bits: buckets below the bound
    are whole in the sample, those above it out, and only the one bucket a group that the bound lies in is ranked."""
    row = F.struct(*df.columns).alias("_row")
    dealt = df.select(row, F.col(by).alias("_g"), shuffled(id_col, seed).alias("_h"), F.col(id_col).alias("_id")).withColumn("_b", F.shiftright("_h", 64 - HASH_BITS))
    counts = dealt.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(W.partitionBy("_g").orderBy("_b"))
    limits = most.select(F.col(by).alias("_m"), "_most")
    reach = counts.withColumn("_upto", upto).join(F.broadcast(limits), F.col("_g").eqNullSafe(F.col("_m")))
    # The bound's bucket: the first that doesn't fit as a whole. Without one, the group is all in the sample.
    edge = reach.groupBy(F.col("_g").alias("_e")).agg(
        F.min(F.when(F.col("_upto") > F.col("_most"), F.col("_b"))).alias("_edge"),
        (F.first("_most") - F.coalesce(F.max(F.when(F.col("_upto") <= F.col("_most"), F.col("_upto"))), F.lit(0))).alias("_rest"),
    )
    bound = dealt.join(F.broadcast(edge), F.col("_g").eqNullSafe(F.col("_e")))
    inside = bound.where(F.col("_edge").isNull() | (F.col("_b") < F.col("_edge")))
    place = F.row_number().over(W.partitionBy("_g").orderBy("_h", "_id"))
    last = bound.where(F.col("_b") == F.col("_edge")).withColumn("_place", place).where("_place <= _rest")
    return inside.select("_row.*").unionByName(last.select("_row.*"))


def sample_rows(df: DataFrame, n: int, id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, or all if there are fewer."""
    return df.orderBy(shuffled(id_col, seed), id_col).limit(n)


def sample_per_file(df: DataFrame, share: float, id_col: str = "row_id", file_col: str = "source_file", seed: int = 42) -> DataFrame:
    """Of each file that share of its rows, one at least; halves round to even."""
    sizes = df.groupBy(file_col).agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(share), 0)).cast("long").alias("_most"))
    return first_by_hash(df, file_col, sizes, id_col, seed)


def sample_fraction_for(rows: int, most: int) -> float:
    """The share that keeps about ``most`` of ``rows``."""
    return 1.0 if rows <= most else most / rows


def balanced_sample(df: DataFrame, per_family: int, benign_ratio: float, total: int | None = None, family: str = "family", id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """At most ``per_family`` rows of each attack family and ``benign_ratio`` times as many benign rows as attacks kept,
    then at most ``total`` rows."""
    attacks = df.where(F.col(family) != "benign").groupBy(family).count().agg(F.sum(F.least("count", F.lit(per_family)))).first()[0] or 0
    most = F.when(F.col(family) == "benign", F.lit(int(attacks * benign_ratio))).otherwise(F.lit(per_family))
    out = first_by_hash(df, family, df.select(family).distinct().withColumn("_most", most), id_col, seed)
    return out if total is None else sample_rows(out, total, id_col, seed)


def qualified_families(df: DataFrame, least: int, y: str = "y", family: str = "family") -> DataFrame:
    """Attack families with enough positive rows, and how many."""
    return df.where((F.col(y) == 1) & (F.col(family) != "benign")).groupBy(family).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def stratified_holdout(df: DataFrame, share: float, by: list[str], id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """``df`` with a boolean column _held: of each combination of the columns ``by`` the rows with the least hashes, that
    share of them to one row (halves round to even). Ids must be unique."""
    key = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in by]), {"ignoreNullFields": "false"})
    keyed = df.select(id_col, key.alias("_stratum"))
    sizes = keyed.groupBy("_stratum").agg(F.bround(F.count(F.lit(1)) * F.lit(share), 0).cast("long").alias("_most"))
    held = first_by_hash(keyed, "_stratum", sizes, id_col, seed).select(id_col, F.lit(True).alias("_held"))
    return df.join(held, id_col, "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
