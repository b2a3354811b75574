"""Segmented scans: sliding sums, counts and frequencies of groups that are too large for one task.

A frame's content is a running sum over *events*: a row enters at its own place and leaves once for each frame, ``size``
places or ``size`` + 1 seconds later. Rows and events are put into a total order and cut into blocks of about ``BLOCK``, anywhere:
within a second, among rows without a time, inside a frame. Then, in two phases,

1. each block is summed up to a partial state (its sums; how often each value came and went), and a scan over the blocks'
   states, which are far fewer than the rows, gives every block what holds before it begins (its carry);
2. each block is gone through once from its carry.

What a block needs of values that don't occur in it is only how frequent they are at most. That is a maximum over all
values' pauses that cover the block; pauses are split into aligned runs of 2^k blocks, so that they are few.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.storage import stored

#: Rows or events of a block, about.
BLOCK = 1 << 17
_SHIFT = 33  # of Spark's increasing ids: the partition's number stands above the row's


def ordered(df: DataFrame, keys: list[Column], rows: int) -> DataFrame:
    """``df`` as a stored table with _block and _place, which ascend in the order of ``keys``. Blocks are ranges of that order.
    A column _before, where there is one, moves to the next row of its block."""
    parts = max(1, -(-rows // BLOCK))
    out = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    if "_before" in df.columns:
        out = out.mapInArrow(_moved, T.StructType([T.StructField(f.name, f.dataType) if f.name == "_before" else f for f in df.schema]))
    out = out.withColumn("_place", F.monotonically_increasing_id())
    return stored(out.withColumn("_block", F.shiftright("_place", _SHIFT)), "ordered")


def _moved(batches):
    last = None
    for batch in batches:
        if batch.num_rows:
            at = batch.schema.get_field_index("_before")
            own = batch.column(at)
            before = pa.concat_arrays([pa.nulls(1, own.type) if last is None else last, own.slice(0, len(own) - 1)])
            last = own.slice(len(own) - 1)
            yield batch.set_column(at, batch.schema.field(at), before)


def with_neighbours(df: DataFrame, last: list[str]) -> DataFrame:
    """A table that was ordered with the struct of the columns ``last`` as _before, with each row's number in its group (_rn)
    and the row before as _before.

    A block's row numbers go on from those of the blocks before it, and its first row looks at the last one before. What
    blocks begin with is a row for each block, so that it is broadcast and the table isn't dealt again.
    """
    state = F.struct(*last)
    heads = df.groupBy("_gid", "_block").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"), F.max_by(state, F.col("_place")).alias("_end"))
    blocks = W.partitionBy("_gid").orderBy("_block")
    heads = heads.select(
        "_gid", "_block", "_first",
        F.coalesce(F.sum("_rows").over(blocks.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.lag("_end").over(blocks).alias("_carried"),
    )
    heads = F.broadcast(stored(heads, "heads"))
    before = F.when(F.col("_place") == F.col("_first"), F.col("_carried")).otherwise(F.col("_before"))
    out = df.join(heads, ["_gid", "_block"]).withColumns({"_rn": F.col("_offset") + F.col("_place") - F.col("_first") + 1, "_before": before})
    return out.drop("_first", "_offset", "_carried", "_place", "_block")


def _f_log_f(f: np.ndarray) -> np.ndarray:
    return np.where(f > 0, f * np.log2(np.maximum(f, 1)), 0.0)


def _coded(x) -> tuple[np.ndarray, int]:
    """Values as numbers from 0 on."""
    found = pa.array(x).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), len(found.dictionary)


def _numbered(*tuples: tuple[np.ndarray, ...]) -> tuple[list[np.ndarray], int]:
    """Each tuple of values as a number from 0 on, over all the given arrays alike."""
    first, *others = (np.concatenate(x) for x in zip(*tuples, strict=True))
    number, n = _coded(first)
    for x in others:
        code, m = _coded(x)
        number, n = _coded(number * m + code)
    return np.split(number, np.cumsum([len(x[0]) for x in tuples])[:-1]), n


class _Block:
    """One block's events in their order, and what its values' counts were before it."""

    def __init__(self, events: pa.Table, carry: pa.Table, n_frames: int, kinds: list[list[str]]):
        self.events, self.carry, self.kinds = events.sort_by("_place"), carry, kinds
        frame = self._column("_frame")
        self.enters = frame < 0
        self.moves = [np.where(self.enters, 1, 0) - (frame == j) for j in range(n_frames)]
        self.known: dict = {}

    def _column(self, name: str) -> np.ndarray:
        return self.events.column(name).to_numpy()

    def total(self, j: int, x: str) -> np.ndarray:
        return np.cumsum(self._column(x) * self.moves[j])

    def _codes(self, kind: int) -> tuple[np.ndarray, list[np.ndarray], list[float]]:
        """The events' values as numbers, each frame's counts of these values before the block, and the most that other
        values have there."""
        if kind not in self.known:
            mine = self.carry.filter(pa.array(self.carry.column("_v").to_numpy() == kind))
            quiet = mine.column("_a").is_null().to_numpy(zero_copy_only=False) if mine.num_rows else np.zeros(0, bool)
            seen = mine.filter(pa.array(~quiet))
            names = self.kinds[kind]
            (codes, old), n = _numbered(tuple(map(self._column, names)), tuple(seen.column(c).to_numpy() for c in ("_a", "_b")[: len(names)]))
            counts, most = [], []
            for j in range(len(self.moves)):
                held = np.zeros(n, np.int64)
                held[old] = seen.column(f"_c{j}").to_numpy()
                counts.append(held)
                most.append(max(mine.column(f"_c{j}").to_numpy()[quiet].tolist(), default=0))
            self.known[kind] = codes, counts, most
        return self.known[kind]

    def _steps(self, j: int, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The events that count for a frame: their places, values, moves, and the value's count after each."""
        if (j, kind) not in self.known:
            codes, counts, _ = self._codes(kind)
            at = np.flatnonzero(self.moves[j])
            code, move = codes[at], self.moves[j][at]
            order = np.argsort(code, kind="stable")
            sums, sorted_code = np.cumsum(move[order]), code[order]
            head = np.flatnonzero(np.diff(sorted_code, prepend=-1))
            before = np.repeat(sums[head] - move[order][head], np.diff(np.append(head, len(order))))
            after = np.empty(len(at), np.int64)
            after[order] = sums - before + counts[j][sorted_code]
            self.known[j, kind] = at, code, move, after
        return self.known[j, kind]

    def _spread_out(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.enters))
        out[at] = x
        return out

    def count(self, j: int, kind: int) -> np.ndarray:
        at, _, _, after = self._steps(j, kind)
        return self._spread_out(at, after)

    def distinct(self, j: int, kind: int) -> np.ndarray:
        at, _, move, after = self._steps(j, kind)
        return np.cumsum(self._spread_out(at, np.where(move > 0, after == 1, -1 * (after == 0))))

    def spread(self, j: int, kind: int) -> np.ndarray:
        """The sum of f * log2 f over the frame's values."""
        at, _, move, after = self._steps(j, kind)
        return np.cumsum(self._spread_out(at, _f_log_f(after) - _f_log_f(after - move)))

    def top(self, j: int, kind: int) -> np.ndarray:
        """How often the frame's most frequent value occurs. ``having``: how many of the block's values have each count."""
        at, _, move, after = self._steps(j, kind)
        _, counts, most = self._codes(kind)
        quiet, start = int(most[j]), counts[j]
        top = max(int(start.max(initial=0)), quiet)
        having = np.bincount(start, minlength=top + 1).tolist()
        having[quiet] += 1  # stands for the values outside the block, so that the largest never falls below theirs
        having += [0] * (int(after.max(initial=0)) + 2 - len(having))
        found = []
        for new, step in zip(after.tolist(), move.tolist(), strict=True):
            having[new - step] -= 1
            having[new] += 1
            if new > top:
                top = new
            elif not having[top]:
                top -= 1
            found.append(top)
        return self._spread_out(at, found)


def _scan(rows: DataFrame, n_rows: int, last: Column, key: Column, needs: dict[str, tuple[int, str, tuple]], shifts: list[int]) -> DataFrame:
    """_gid, _rn and the columns ``needs``: name -> (frame, what, values). A row enters at ``key`` and leaves frame j
    ``shifts[j]`` later, unless that is beyond ``last``, where nothing looks any more."""
    xs = sorted({v[0] for _, what, v in needs.values() if what == "total"})
    kinds = sorted({v for _, what, v in needs.values() if what != "total"})
    code = lambda v: F.col(v).cast("long")
    frames = range(len(shifts))
    move = lambda k, enter, j: F.struct(k.cast("long").alias("key"), F.lit(enter).alias("enter"), F.lit(j).alias("frame"))
    moves = F.filter(F.array(move(key, 1, -1), *[move(key + shift, 0, j) for j, shift in enumerate(shifts)]), lambda m: m["key"] <= last)
    coded = {v: f"_v{k}" for k, v in enumerate(sorted({v for kind in kinds for v in kind}))}
    values = [code(v).alias(c) for v, c in coded.items()]
    events = rows.select("_gid", "_rn", *[F.col(x).cast("double").alias(x) for x in xs], *values, F.explode(moves).alias("_m"))
    events = events.select("*", F.col("_m.key").alias("_key"), F.col("_m.enter").alias("_enter"), F.col("_m.frame").alias("_frame")).drop("_m")
    # Of one place, whatever leaves goes before what enters.
    events = ordered(events, [F.col(c) for c in ("_gid", "_key", "_enter", "_rn", "_frame")], n_rows * (1 + len(shifts)))
    signs = {f"_w{j}": F.when(F.col("_frame") < 0, 1).when(F.col("_frame") == j, -1).otherwise(0) for j in frames}
    carry_schema = "_gid long, _block long, _v int, _a long, _b long, " + ", ".join(f"_c{j} long" for j in frames)
    carry = events.sparkSession.createDataFrame([], carry_schema)
    if kinds:
        second = lambda v: F.col(coded[v[1]]) if len(v) > 1 else F.lit(0).cast("long")
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("v"), F.col(coded[v[0]]).alias("a"), second(v).alias("b")) for k, v in enumerate(kinds)]))
        deltas = events.select("_gid", "_block", *[w.alias(c) for c, w in signs.items()], each.alias("_k")).groupBy("_gid", "_block", F.col("_k.v").alias("_v"), F.col("_k.a").alias("_a"), F.col("_k.b").alias("_b"))
        deltas = deltas.agg(*[F.sum(f"_w{j}").alias(f"_d{j}") for j in frames])
        own = W.partitionBy("_gid", "_v", "_a", "_b").orderBy("_block")
        states = deltas.select("*", *[F.coalesce(F.sum(f"_d{j}").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_c{j}") for j in frames], F.lead("_block").over(own).alias("_again"))
        tops = sorted({kinds.index(v) for _, what, v in needs.values() if what == "top"})
        if tops:
            states = stored(states, "states")
        carry = states.select("_gid", "_block", "_v", "_a", "_b", *[f"_c{j}" for j in frames])
        if tops:
            carry = carry.unionByName(_quiet(events, states.where(F.col("_v").isin(tops)), len(shifts)))
    summed = [name for name, (_, what, _) in needs.items() if what in ("total", "distinct", "spread")]
    plan = [(name, what, j, v[0] if what == "total" else kinds.index(v)) for name, (j, what, v) in needs.items()]
    columns_of = [[coded[v] for v in kind] for kind in kinds]

    def run(key, events, carry):
        block = _Block(events, carry, len(shifts), columns_of)
        made = {name: getattr(block, what)(j, v) for name, what, j, v in plan}
        at = np.flatnonzero(block.enters)
        # The block's own sums follow its rows, without a row's number.
        columns = {name: np.append(x[at], x[-1:] if name in summed else np.zeros(1)).astype(float) for name, x in made.items()}
        numbers = pa.array(np.append(block.events.column("_rn").to_numpy()[at], 0), pa.int64(), mask=np.arange(len(at) + 1) == len(at))
        ids = [pa.array(np.full(len(at) + 1, k.as_py()), pa.int64()) for k in key]
        return pa.table([*ids, numbers, *map(pa.array, columns.values())], names=["_gid", "_block", "_rn", *columns])

    schema = "_gid long, _block long, _rn long, " + ", ".join(f"`{name}` double" for name, *_ in plan)
    made = stored(events.groupBy("_gid", "_block").cogroup(carry.groupBy("_gid", "_block")).applyInArrow(run, schema), "blocks")
    blocks = W.partitionBy("_gid").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = made.where("_rn is null").select("_gid", "_block", *[F.coalesce(F.sum(name).over(blocks), F.lit(0.0)).alias(f"_before{name}") for name in summed])
    # A row for each block: broadcast, so that the table is dealt once, by its rows' numbers.
    out = made.where("_rn is not null").join(F.broadcast(offsets), ["_gid", "_block"])
    return out.select("_gid", "_rn", *[(F.col(name) + F.col(f"_before{name}") if name in summed else F.col(name)).alias(name) for name, *_ in plan])


def _quiet(events: DataFrame, states: DataFrame, n_frames: int) -> DataFrame:
    """For each block the largest counts of the values that don't occur in it, as rows of the carry without a value."""
    blocks = events.select("_gid", "_block").distinct()
    ends = blocks.groupBy("_gid").agg(F.max("_block").alias("_last"))
    after = [(F.col(f"_c{j}") + F.col(f"_d{j}")).alias(f"_c{j}") for j in range(n_frames)]
    pauses = states.join(ends, "_gid").select("_gid", "_v", *after, (F.col("_block") + 1).alias("_lo"), (F.coalesce("_again", F.col("_last") + 1) - 1).alias("_hi"))
    pauses = pauses.where(F.col("_lo") <= F.col("_hi")).where(F.greatest(*[F.col(f"_c{j}") for j in range(n_frames)], F.lit(0)) > 0)
    level = F.explode(F.sequence(F.lit(0), F.lit(40)))
    aligned = pauses.withColumn("_level", level).withColumns({"_lo": F.expr("shiftright(_lo + shiftleft(1L, _level) - 1, _level)"), "_hi": F.expr("shiftright(_hi + 1, _level) - 1")})
    # A run of 2^level blocks is taken where its double isn't within the pause as well.
    runs = F.array_compact(F.array(F.when(F.col("_lo") % 2 == 1, F.col("_lo")), F.when(F.col("_hi") % 2 == 0, F.col("_hi"))))
    runs = aligned.where(F.col("_lo") <= F.col("_hi")).withColumn("_run", F.explode(runs)).groupBy("_gid", "_level", "_run", "_v").agg(*[F.max(f"_c{j}").alias(f"_c{j}") for j in range(n_frames)])
    over = blocks.withColumn("_level", level).withColumn("_run", F.expr("shiftright(_block, _level)")).join(runs, ["_gid", "_level", "_run"])
    found = over.groupBy("_gid", "_block", "_v").agg(*[F.max(f"_c{j}").alias(f"_c{j}") for j in range(n_frames)])
    return found.withColumns({"_a": F.lit(None).cast("long"), "_b": F.lit(None).cast("long")})


def with_frames(rows: DataFrame, n_rows: int, needs: dict[str, tuple[str, int, str, tuple]]) -> DataFrame:
    """``rows`` with the columns ``needs``: name -> (r or t, size, what, values), where what is a total, count, distinct,
    spread (the sum of f * log2 f) or top (the largest frequency) over the frame of the last ``size`` rows or seconds.

    ``rows`` comes from a stored table of large groups with _gid, the group's rows _n, its last second _end, each row's number _rn
    and second _t, and the values. Strings among these are told apart by the number of their first row.
    """
    strings = dict(rows.dtypes)
    values = {v for _, _, what, vs in needs.values() if what != "total" for v in vs}
    for v in sorted(v for v in values if strings[v] == "string"):
        # Stored, so that the join knows its size: few strings are broadcast, and rows aren't dealt by them.
        first = stored(rows.groupBy("_gid", v).agg(F.min("_rn").alias(f"_first{v}")), "strings")
        rows = rows.join(first, ["_gid", v])
    coded = {v: f"_first{v}" if strings[v] == "string" else v for v in values}
    out = rows
    for kind, key, last in (("r", "_rn", "_n"), ("t", "_t", "_end")):
        sizes = sorted({size for k, size, _, _ in needs.values() if k == kind})
        mine = {name: (sizes.index(size), what, tuple(v if what == "total" else coded[v] for v in vs)) for name, (k, size, what, vs) in needs.items() if k == kind}
        if mine:
            made = _scan(rows, n_rows, F.col(last), F.col(key), mine, [size + (kind == "t") for size in sizes])
            out = out.join(made, ["_gid", "_rn"])
    return out.drop(*chain(f"_first{v}" for v in values))
