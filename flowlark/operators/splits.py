"""Leave-one-family-out splits with disjoint groups.

Rows are never moved one by one: whole groups are, by their sizes. The greedy dealing needs a group's size and families
only, and looks at groups in order of size, so the driver deals counts of groups of one family and size; the groups are
numbered on the executors, and the assignment is joined back to the rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import group_key

EXACT_FLOW = ("source_file", "source_ip", "destination_ip", "destination_port")
HOST = ("source_file", "source_ip")
SPLITS = ("train", "model_selection_val", "val", "test_seen", "test_zero_day")
#: Groups of one family and size that are numbered in one bucket.
PLACES = 4096


def deal(weights: dict[str, int], ratios: dict[str, float]) -> dict[str, str]:
    """Each key to a split, the heaviest first, always to the split that is furthest behind its share of the weight.
    Equal weights keep the order of the keys given; ties go to the split with less so far, then the larger ratio, then the first."""
    total = sum(weights.values())
    held = dict.fromkeys(ratios, 0)
    out = {}
    for key in sorted(weights, key=lambda k: -weights[k]):
        best = max(ratios, key=lambda s: (ratios[s] * total - held[s], -held[s], ratios[s]))
        held[best] += weights[key]
        out[key] = best
    return out


def deal_sizes(sizes: dict[int, int], ratios: dict[str, float]) -> dict[int, dict[str, int]]:
    """``deal`` for many groups: sizes has how many groups there are of each weight; returns how many of them go to each
    split. Groups of one weight are interchangeable, so a weight costs a few steps, however many groups have it.

    A split that is behind by d takes its j-th group of weight n when d - j n is the largest such number left. Those far
    above the level at which the class runs out are dealt at once, the last few one by one."""
    total = sum(n * c for n, c in sizes.items())
    held = dict.fromkeys(ratios, 0)
    out = {}
    for n in sorted(sizes, reverse=True):
        left = sizes[n]
        behind = {s: (r * total - held[s]) / n for s, r in ratios.items()}
        level, open_ = 0.0, sorted(behind.values(), reverse=True)
        for k in range(len(open_)):
            level = (sum(open_[: k + 1]) - left) / (k + 1)
            if k + 1 == len(open_) or open_[k + 1] <= level:
                break
        got = {s: max(0, int(d - level) - 1) for s, d in behind.items()}
        for s in ratios:
            held[s] += n * got[s]
        for _ in range(left - sum(got.values())):
            best = max(ratios, key=lambda s: (ratios[s] * total - held[s], -held[s], ratios[s]))
            held[best] += n
            got[best] += 1
        out[n] = got
    return out


def _family_shares(sizes: dict[int, int], benign: bool, ratios: tuple[float, ...], selection: float) -> dict[int, dict[str, int]]:
    """How many of a family's groups of each size go to each split."""
    train, val, seen, zero = ratios
    shares = {"train": train, "val": val, "test_seen": seen} | ({"test_zero_day": zero} if benign else {})
    groups = sum(sizes.values())
    if groups == 1:
        dealt = {n: {"train": 1} for n in sizes}
    else:
        dealt = deal_sizes(sizes, shares)
        if groups == 2 and not benign and not any(d.get("train") for d in dealt.values()):
            heavy, light = max(sizes), min(sizes)
            dealt = {heavy: {"train": 1, "val": 1}} if heavy == light else {heavy: {"train": 1}, light: {"val": 1}}
    mine = {n: d["train"] for n, d in dealt.items() if d.get("train")}
    if sum(mine.values()) >= 2 and selection:
        kept = deal_sizes(mine, {"train": 1 - selection, "model_selection_val": selection})
        for lacking, other, n in (("model_selection_val", "train", min(mine)), ("train", "model_selection_val", max(mine))):
            if not any(k[lacking] for k in kept.values()):
                kept[n][lacking] += 1
                kept[n][other] -= 1
        dealt = {n: d | kept.get(n, {}) for n, d in dealt.items()}
    return dealt


def split_groups(groups: DataFrame, target: str, seed: int = 42, ratios: tuple[float, ...] = (0.7, 0.1, 0.1, 0.1), selection: float = 0.15) -> DataFrame:
    """(key, split) of each group. groups: key, family, n (rows of the family in the group).

    Groups with the target family go to test_zero_day. Each other attack family's groups are dealt to train, val and
    test_seen, benign ones to all four; a group belongs to its largest attack family. A share of train's groups, by family, becomes
    model_selection_val.

    Groups never leave the executors: the driver gets how many groups each family has of each size, at most
    sqrt(2 rows) sizes a family, and decides how many of them go to each split. Which ones is their order by a hash of the
    key, numbered in buckets of about PLACES groups.
    """
    if not 0 <= selection < 1 or abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must add up to 1 and the selection share must lie in [0, 1)")
    spark = groups.sparkSession
    attack = F.when(F.col("family") != "benign", F.col("n")).otherwise(0)
    whole = groups.groupBy("key").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.max((F.col("family") == target).cast("int")), F.lit(0)).alias("held_out"),
        F.max_by("family", F.struct(attack, F.col("family"))).alias("family"),
    )
    families: dict[str, dict[int, int]] = {}
    zero_day = 0
    for r in whole.groupBy(F.when(F.col("held_out") == 0, F.col("n")).alias("n"), F.when(F.col("held_out") == 0, F.col("family")).alias("family"), "held_out").count().collect():
        if r["held_out"]:
            zero_day += r["count"]
        else:
            families.setdefault(r["family"], {})[r["n"]] = r["count"]
    if not zero_day:
        raise ValueError(f"no rows of the target family {target}")
    rows = []
    for family, sizes in families.items():
        for n, dealt in _family_shares(sizes, family == "benign", ratios, selection).items():
            ends = list(itertools.accumulate(dealt.get(s, 0) for s in SPLITS))
            rows.append((family, n, -(-sizes[n] // PLACES), ends))
    held = whole.where("held_out = 1").select("key", F.lit("test_zero_day").alias("split"))
    if not rows:
        return held
    table = spark.createDataFrame(rows, "_family string, _n long, _buckets long, _ends array<long>")
    same_class = F.col("family").eqNullSafe(F.col("_family")) & (F.col("n") == F.col("_n"))
    order = F.xxhash64("key", F.lit(seed))
    free = whole.where("held_out = 0").join(F.broadcast(table), same_class).select("key", "family", "n", "_buckets", "_ends", order.alias("_h"))
    free = free.withColumn("_b", F.pmod("_h", "_buckets"))
    # A class of few groups is one bucket; one row a bucket is left for the running count.
    before = F.coalesce(F.sum("_c").over(W.partitionBy("family", "n").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = free.groupBy("family", "n", "_b").agg(F.count(F.lit(1)).alias("_c")).select(F.col("family").alias("_f"), F.col("n").alias("_m"), F.col("_b").alias("_k"), before.alias("_start"))
    place = F.row_number().over(W.partitionBy("family", "n", "_b").orderBy("_h", "key")) - 1
    numbered = free.withColumn("_place", place).join(starts, F.col("family").eqNullSafe(F.col("_f")) & (F.col("n") == F.col("_m")) & (F.col("_b") == F.col("_k")))
    at = F.col("_start") + F.col("_place")
    chosen = F.coalesce(*[F.when(at < F.col("_ends")[k], F.lit(s)) for k, s in enumerate(SPLITS)])
    return held.unionByName(numbered.select("key", chosen.alias("split")))


def leave_one_family_out(df: DataFrame, target: str, group_columns: tuple[str, ...] = HOST, family: str = "attack_family", **kw) -> DataFrame:
    """``df`` with its split. Of test_zero_day only benign rows and the target family stay; other attacks that share a
    group with the target are left out. Raises if a group is in two splits or the target in one that is learnt from."""
    keyed = df.withColumn("_key", group_key(list(group_columns)))
    groups = keyed.groupBy(F.col("_key").alias("key"), F.col(family).alias("family")).agg(F.count(F.lit(1)).alias("n"))
    chosen = split_groups(groups, target, **kw)
    out = keyed.join(chosen.withColumnRenamed("key", "_key"), "_key").where((F.col("split") != "test_zero_day") | F.col(family).isin("benign", target)).drop("_key")
    return out


def overlapping_groups(labelled: DataFrame, group_columns: tuple[str, ...] = HOST) -> DataFrame:
    """Groups with rows in more than one split: there must be none."""
    key = group_key(list(group_columns)).alias("key")
    return labelled.groupBy(key).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")


def manifest(labelled: DataFrame, target: str, family: str = "attack_family", **settings) -> dict:
    """Settings, and the rows of each split and family."""
    counts: dict[str, dict[str, int]] = {}
    for r in labelled.groupBy("split", family).count().collect():
        counts.setdefault(r["split"], {})[r[family]] = r["count"]
    return {"target_family": target, **settings, "split_counts": {s: sum(c.values()) for s, c in counts.items()}, "family_counts": counts}


def check_split(labelled: DataFrame, target: str, group_columns: tuple[str, ...] = HOST, family: str = "attack_family") -> None:
    if not overlapping_groups(labelled, group_columns).isEmpty():
        raise ValueError("a group is in two splits")
    learnt = F.col("split").isin("train", "val", "model_selection_val", "test_seen")
    if not labelled.where(learnt & (F.col(family) == target)).isEmpty():
        raise ValueError("the target family is outside test_zero_day")
