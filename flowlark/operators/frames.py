"""The parts of sliding frames (sums, counts, distinct values and so on) from one pass over whole groups in their order.

A frame of a row is a run of its group's rows that ends with it and whose first row only moves on, whether it is cut by rows
or by seconds. So every part is a difference of running sums at the two ends, made for some thousands of rows of many groups
at once; a row costs the same whatever its frames hold. Spark deals the groups, sorts them and works out features from parts.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: So many rows, and what is left of their last group, are gone through at once.
AT_ONCE = 1 << 13
#: Whole numbers up to here are exact as doubles.
EXACT = float(1 << 53)

Needs = dict[str, tuple[str, int, str, tuple]]


def top_count(kind: str, size: int):
    """A function from the next row's (place, second, value) to the number of the most frequent value in its frame. It keeps
    the frame's rows, the count of each value and how many values have each count, so a row costs the same whatever the
    frame holds. Place 1 begins a group."""
    rows, held, having, top = deque(), defaultdict(int), defaultdict(int), 0

    def step(place: int, second: int, value: int) -> int:
        nonlocal top
        if place == 1:
            rows.clear()
            held.clear()
            having.clear()
            top = 0
        rows.append((second, value))
        n = held[value] = held[value] + 1
        having[n] += 1
        having[n - 1] -= 1
        top = max(top, n)
        while len(rows) > size if kind == "r" else rows[0][0] < second - size:
            _, old = rows.popleft()
            n = held[old]
            having[n] -= 1
            having[n - 1] += 1
            if n == top and not having[n]:
                top -= 1
            if n == 1:
                del held[old]
            else:
                held[old] = n - 1
        return top

    return step


def _f_log_f(f: np.ndarray) -> np.ndarray:
    f = f.astype(float)
    return f * np.log2(np.maximum(f, 1))


class Rows:
    """Whole groups in their order; ``_rn`` is a row's place in its group and ``_t`` its second. What several parts need is made once."""

    def __init__(self, table: pa.Table):
        self.table, self.made = table, {}
        self.place, self.second = self._numbers("_rn"), self._numbers("_t")
        self.n = len(self.place)
        self.at = np.arange(self.n)
        first = self.place == 1
        self.group = np.cumsum(first) - 1
        self.start = np.maximum.accumulate(np.where(first, self.at, 0))

    def _numbers(self, name: str) -> np.ndarray:
        return self.table.column(name).combine_chunks().to_numpy(zero_copy_only=False)

    def _once(self, key: tuple, make) -> object:
        if key not in self.made:
            self.made[key] = make()
        return self.made[key]

    def low(self, kind: str, size: int) -> np.ndarray:
        """The first row of each row's frame."""
        if kind == "r":
            return self._once((kind, size), lambda: np.maximum(self.start, self.at - (size - 1)))
        age = self._once(("age",), lambda: self.second - self.second[self.start])
        base = self._once(("base",), lambda: self.group * (int(age.max()) + 1))
        return self._once((kind, size), lambda: np.searchsorted(base + age, base + np.maximum(age - size, 0)))

    def _restarted(self, x: np.ndarray) -> np.ndarray:
        """Running sums that begin anew with each group, so that no group's rounding, or infinity, reaches another one."""
        ends = np.append(np.flatnonzero(self.place == 1)[1:], self.n)
        out, a = np.empty(self.n), 0
        for b in ends.tolist():
            np.cumsum(x[a:b], out=out[a:b])
            a = b
        return out

    def _between(self, x: np.ndarray, gone: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The sum of ``x`` up to each row in its group less that of ``gone`` before ``low``."""
        up, away = self._restarted(x), self._restarted(gone)
        return up - np.where(low > self.start, away[low - 1], 0.0)

    def total(self, low: np.ndarray, x: str) -> np.ndarray:
        if x == "_one":
            return self.at - low + 1

        def running():
            values = self._numbers(x).astype(float, copy=False)
            whole = np.array_equal(values, np.rint(values)) and np.abs(values).sum() < EXACT
            return np.append(0.0, np.cumsum(values)) if whole else values

        sums = self._once((x,), running)
        return sums[1:] - sums[low] if len(sums) > self.n else self._between(sums, sums, low)

    def _codes(self, value: str) -> tuple[np.ndarray, int]:
        column = self.table.column(value).combine_chunks().dictionary_encode()
        return column.indices.to_numpy().astype(np.int64), len(column.dictionary)

    def _runs(self, values: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows put by group, values and place; which group and values each has then; both as one rising number."""

        def made():
            own = self.group
            for value in values:
                codes, n = self._once(("codes", value), lambda value=value: self._codes(value))
                own = own * n + codes
            order = np.argsort(own, kind="stable")
            run = np.cumsum(np.diff(own[order], prepend=own[order[0]]) != 0) * self.n
            return order, run, run + order

        return self._once(("runs", *values), made)

    def count(self, low: np.ndarray, *values: str) -> np.ndarray:
        order, run, key = self._runs(values)
        out = np.empty(self.n, np.int64)
        out[order] = self.at + 1 - np.searchsorted(key, run + low[order])
        return out

    def distinct(self, low: np.ndarray, value: str) -> np.ndarray:
        """A value enters with a row that finds none of it in its frame, and leaves with the last row before such a one."""
        order, run, _ = self._runs((value,))
        before, after = np.full(self.n, -1), np.full(self.n, self.n)
        same = np.flatnonzero(run[1:] == run[:-1])
        before[order[same + 1]], after[order[same]] = order[same], order[same + 1]
        new = before < low
        lost = self.at < np.append(low, self.n)[after]
        return np.cumsum(new) - np.append(0, np.cumsum(lost))[low]

    def spread(self, low: np.ndarray, value: str) -> np.ndarray:
        """The sum of f * log2 f over the frame's values: what each entering row adds less what each leaving one, the oldest
        of its value, takes away."""
        order, run, key = self._runs((value,))
        into, out = self.count(low, value), np.empty(self.n, np.int64)
        last = np.searchsorted(low, self.at, "right") - 1
        out[order] = np.searchsorted(key, run + last[order], "right") - self.at
        return self._between(_f_log_f(into) - _f_log_f(into - 1), _f_log_f(out) - _f_log_f(out - 1), low)

    def part(self, kind: str, size: int, what: str, values: tuple) -> pa.Array:
        if what == "top":
            step, codes = top_count(kind, size), self._once(("codes", values[0]), lambda: self._codes(values[0]))[0]
            return pa.array(map(step, self.place.tolist(), self.second.tolist(), codes.tolist()), pa.float64())
        return pa.array(getattr(self, what)(self.low(kind, size), *values).astype(float, copy=False))


def with_parts(rows: DataFrame, keep: list[str], needs: Needs) -> DataFrame:
    """The columns ``keep`` of ``rows`` and the parts in ``needs``: (kind, size, what, values) by name. Rows lie in their order,
    a partition holds whole groups, and each begins with a row whose ``_rn`` is 1. A task holds ``AT_ONCE`` rows or a group."""
    used = {v for _, _, _, values in needs.values() for v in values} - {"_one"}
    rows = rows.select(*keep, *sorted(({"_rn", "_t"} | used) - set(keep)))
    schema = T.StructType([*rows.select(*keep).schema.fields, *[T.StructField(name, T.DoubleType()) for name in needs]])

    def made(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        if table.num_rows:
            groups = Rows(table)
            yield from pa.Table.from_arrays([*table.select(keep).columns, *[groups.part(*need) for need in needs.values()]], [*keep, *needs]).to_batches(AT_ONCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            first = np.flatnonzero(batch.column(batch.schema.get_field_index("_rn")).to_numpy() == 1)
            if n + batch.num_rows >= AT_ONCE and len(first):
                yield from made([*held, batch.slice(0, first[-1])])
                held, n, batch = [], 0, batch.slice(first[-1])
            held.append(batch)
            n += batch.num_rows
        if held:
            yield from made(held)

    return rows.mapInArrow(run, schema)
