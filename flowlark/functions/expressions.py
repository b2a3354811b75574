"""Small column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """The value, or null where it is NaN or infinite: null is the only missing value inside the engine."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clipped(x: Column, low: Column, high: Column) -> Column:
    """The value held within bounds; null stays null, which greatest() and least() would turn into a bound."""
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or either is missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f_log_f(f: Column) -> Column:
    """f * log2 f, 0 at 0."""
    return F.when(f > 0, f * F.log2(f.cast("double"))).otherwise(F.lit(0.0))


def normalized_label(x: Column) -> Column:
    """A label with one kind of dash, ' - ' around dashes and single blanks: replacement characters and long dashes count as dashes."""
    x = F.translate(x, "�–—", "---")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "\\s*-\\s*", " - "), "\\s+", " "))


def mapped(x: Column, table: dict[str, str]) -> Column:
    """A lookup in a small fixed table; null where the value isn't in it."""
    return F.create_map(*[F.lit(v) for pair in table.items() for v in pair])[x]


def group_key(columns: list[str]) -> Column:
    """The grouping columns as one string without collisions; missing values count as a value of their own."""
    return F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("<missing>")).alias(c) for c in columns]))


def reached(x: Column, cuts: list[float]) -> Column:
    """How many of the ascending ``cuts`` are at or below ``x`` (none below a missing one): a binary search of nested
    comparisons, so a row is compared log2(n) times within generated code."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(x < cuts[middle], search(low, middle)).otherwise(search(middle + 1, high))

    return F.when(x.isNotNull(), search(0, len(cuts))).otherwise(F.lit(0))
