"""Cleaning of raw flow tables: names, labels, missing values, duplicate rows, and what a table can be used for."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import finite, mapped, normalized_label
from ..functions.storage import stored

# Other spellings of columns, and their canonical names.
ALIASES = {
    "fwd_packets_length_total": "total_length_of_fwd_packets",
    "bwd_packets_length_total": "total_length_of_bwd_packets",
    "packet_length_min": "min_packet_length",
    "packet_length_max": "max_packet_length",
    "avg_packet_size": "average_packet_size",
    "init_fwd_win_bytes": "init_win_bytes_forward",
    "init_bwd_win_bytes": "init_win_bytes_backward",
    "fwd_act_data_packets": "act_data_pkt_fwd",
    "fwd_seg_size_min": "min_seg_size_forward",
}
# Labels and their attack families.
FAMILIES = {
    "BENIGN": "benign",
    "Benign": "benign",
    "FTP-Patator": "brute_force",
    "FTP - Patator": "brute_force",
    "SSH-Patator": "brute_force",
    "SSH - Patator": "brute_force",
    "DoS slowloris": "dos",
    "DoS Slowhttptest": "dos",
    "DoS Hulk": "dos",
    "DoS GoldenEye": "dos",
    "Heartbleed": "heartbleed",
    "Web Attack - Brute Force": "web_attack",
    "Web Attack - XSS": "web_attack",
    "Web Attack - Sql Injection": "web_attack",
    "Infiltration": "infiltration",
    "Bot": "botnet",
    "PortScan": "portscan",
    "DDoS": "ddos",
}
# Columns that tell rows apart rather than describe them, and those that would give labels away.
KEPT_APART = ("row_id", "label", "original_label", "attack_family", "source_file", "day_of_week")
LEAKAGE = ("flow_id", "source_ip", "destination_ip", "source_port", "destination_port", "timestamp")


def clean_name(name: str) -> str:
    return re.sub("[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def clean_names(names: list[str]) -> list[str]:
    """Normalised, canonical names; a name's second column gets _1, its third _2. A canonical name that is taken stays as it is."""
    seen: Counter[str] = Counter()
    out = []
    for name in map(clean_name, names):
        out.append(name if not seen[name] else f"{name}_{seen[name]}")
        seen[name] += 1
    taken = set(out)
    return [ALIASES[n] if n in ALIASES and ALIASES[n] not in taken else n for n in out]


def dense_ids(df: DataFrame, order: list[str] | None = None, name: str = "row_id") -> DataFrame:
    """A dense number from 0 in the order of the input's partitions and rows; ``order`` sorts the rows first, over the
    whole table. Rows that tie in ``order`` are numbered in any order among themselves.

    The rows are written once, each with its partition and its place there; counts and numbers are both taken from that
    table, since a plan that ran twice could cut or order its partitions another way. The driver gets a count a partition.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(df.withColumn("_at", F.monotonically_increasing_id()), "placed-rows")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    starts, total = [], 0
    for p, n in sorted(placed.groupBy(part.alias("p")).count().collect()):
        starts.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _start long")
    return placed.join(F.broadcast(table), part == F.col("_part")).withColumn(name, F.col("_start") + place).drop("_at", "_part", "_start")


def parse_timestamps(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Day-first text with or without seconds; month-first only if the whole table has no day-first value."""
    ways = lambda a, b: F.coalesce(*[F.try_to_timestamp(F.col(column), F.lit(f"{a}/{b}/yyyy {t}")) for t in ("H:mm:ss", "H:mm")])
    any_day_first = df.select(ways("d", "M").isNotNull().alias("x")).where("x").limit(1).count() > 0
    return df.withColumn(column, ways("d", "M") if any_day_first else ways("M", "d"))


def with_labels(df: DataFrame, families: dict[str, str] = FAMILIES, column: str = "label") -> DataFrame:
    """original_label (normalised) and attack_family; an unknown or missing label stops the query."""
    label = normalized_label(F.col(column))
    # Spaced dashes may be how the table spells a label or may not: both spellings are looked up.
    family = F.coalesce(mapped(label, families), mapped(F.replace(label, F.lit(" - "), F.lit("-")), families))
    known = F.when(family.isNotNull(), family).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))))
    return df.withColumns({"original_label": label, "attack_family": known})


def numeric_columns(df: DataFrame, but: tuple[str, ...] = ("row_id",)) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in but]


def infinities_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN and infinite values become null, the only missing value from here on."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    floats = [c for c in (columns or numeric_columns(df)) if isinstance(kinds[c], (T.FloatType, T.DoubleType))]
    return df.withColumns({c: finite(F.col(c)).cast(kinds[c]) for c in floats}) if floats else df


def negatives_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in columns})


def drop_duplicate_rows(df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """One row of each set of equal rows, whose ids don't count: the one with the smallest id. Missing equals missing."""
    keys = [c for c in df.columns if c != id_col]
    return df.groupBy(*keys).agg(F.min(id_col).alias(id_col)).select(df.columns)


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) of the columns that have any."""
    row = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column", "nulls").where("nulls > 0")


def infinity_counts(df: DataFrame) -> DataFrame:
    """(column, infinities) of the numeric columns that have any."""
    numbers = numeric_columns(df)
    row = df.agg(*[F.sum((F.abs(F.col(c).cast("double")) == float("inf")).cast("long")).alias(c) for c in numbers])
    return row.unpivot([], numbers, "column", "infinities").where("infinities > 0")


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with one distinct value at most, null counted as one. Least and largest value tell, without a distinct count."""
    if not columns:
        return []
    row = df.agg(
        *[F.min(c).alias(f"lo_{c}") for c in columns],
        *[F.max(c).alias(f"hi_{c}") for c in columns],
        *[F.count(c).alias(f"n_{c}") for c in columns],
        F.count(F.lit(1)).alias("rows"),
    ).first()
    same = lambda c: row[f"n_{c}"] == 0 or (row[f"n_{c}"] == row["rows"] and row[f"lo_{c}"] == row[f"hi_{c}"])
    return [c for c in columns if same(c)]


def column_schema(df: DataFrame) -> dict:
    """What each column is for (fixed values: the keys, which are a file's contract): features (numeric and other), and those that are dropped as leakage or as constant."""
    leakage = [c for c in df.columns if c in LEAKAGE]
    candidates = [c for c in df.columns if c not in KEPT_APART and c not in leakage]
    constant = constant_columns(df, candidates)
    features = [c for c in candidates if c not in constant]
    numeric = [c for c in features if c in numeric_columns(df)]
    return {
        "label_column": "label",
        "original_label_column": "original_label",
        "attack_family_column": "attack_family",
        "id_column": "row_id",
        "metadata_columns": ["source_file", "day_of_week"],
        "all_columns": df.columns,
        "dropped_columns": leakage + constant,
        "numerical_features": numeric,
        "categorical_features": [c for c in features if c not in numeric],
        "feature_columns": features,
        "total_features": len(features),
    }


def clean(raw: DataFrame, families: dict[str, str] = FAMILIES) -> DataFrame:
    """Labels, families, missing values, and one of each set of equal rows; expects row_id, source_file and label."""
    return drop_duplicate_rows(infinities_to_null(with_labels(raw, families)))


def quality_report(raw: DataFrame, cleaned: DataFrame) -> dict:
    """Counts before and after cleaning, as a small dictionary (fixed values: the keys, which are a file's contract)."""
    before, after = raw.count(), cleaned.count()
    counts = lambda df, key, value: {r[key]: r[value] for r in df.collect()}
    return {
        "original_rows": before,
        "rows_after_dedup": after,
        "duplicates_dropped": before - after,
        "inf_counts": counts(infinity_counts(raw), "column", "infinities"),
        "nan_counts": counts(null_counts(infinities_to_null(raw)), "column", "nulls"),
        "label_counts": counts(cleaned.groupBy("original_label").count(), "original_label", "count"),
        "attack_family_counts": counts(cleaned.groupBy("attack_family").count(), "attack_family", "count"),
    }
