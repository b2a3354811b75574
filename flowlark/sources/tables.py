"""Reading raw directories and configuration, and writing results."""

from __future__ import annotations

import itertools
import json
import re
from datetime import datetime, timezone
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import FAMILIES, clean_names, column_schema, dense_ids, parse_timestamps, quality_report

try:
    import yaml
except ImportError:  # not everywhere installed
    yaml = None


def _listed(spark: SparkSession, folder: str) -> list[str]:
    """The files of a folder, sorted by name, on any file system that Spark reads; not of folders within."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().toString() for f in fs.listStatus(path) if f.isFile())


def discover(spark: SparkSession, folder: str) -> list[str]:
    """The CSV files of a folder or, if it has none, its Parquet files."""
    files = _listed(spark, folder)
    found = [f for f in files if f.lower().endswith(".csv")] or [f for f in files if f.lower().endswith(".parquet")]
    if not found:
        raise FileNotFoundError(f"no CSV or Parquet files in {folder}")
    return found


def read_table(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV file with a header, its types inferred over the whole file, or a Parquet file; names are cleaned."""
    kind = PurePosixPath(path).suffix.lower()
    if kind == ".parquet":
        df = spark.read.parquet(path)
        return df.toDF(*clean_names(df.columns))
    if kind != ".csv":
        raise ValueError(f"unsupported file type: {path}")
    # Spark renames repeated names after their place, so names come from the header line itself.
    header = spark.read.option("encoding", encoding).option("inferSchema", False).csv(path).first()
    options = {"header": True, "inferSchema": True, "positiveInf": "Infinity", "negativeInf": "-Infinity", "nanValue": "NaN", "encoding": encoding, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    return spark.read.options(**options).csv(path).toDF(*clean_names([x or "" for x in header]))


def load_raw(spark: SparkSession, folder: str) -> DataFrame:
    """All tables of a folder under each other, by name, with source_file, day_of_week and a dense row_id in the order of files and rows."""
    out = None
    for path in discover(spark, folder):
        name = PurePosixPath(path).name
        df = read_table(spark, path)
        if "timestamp" in df.columns and dict(df.dtypes)["timestamp"] == "string":
            df = parse_timestamps(df)
        df = df.withColumns({"source_file": F.lit(name), "day_of_week": F.lit(PurePosixPath(name).stem.split("-")[0].lower())})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return dense_ids(out)


def source_files(df: DataFrame) -> DataFrame:
    return df.select("source_file").where("source_file is not null").distinct().orderBy("source_file")


def read_splits(spark: SparkSession, folder: str, optional: tuple[str, ...] = ("model_selection_val",)) -> DataFrame:
    """(row_id, split) from one CSV folder or file per split; optional ones may be missing."""
    names = {PurePosixPath(p).stem: p for p in [*_listed(spark, folder), *_folders(spark, folder)]}
    wanted = ("train", *optional, "val", "test_seen", "test_zero_day")
    if missing := [n for n in wanted if n not in names and n not in optional]:
        raise FileNotFoundError(f"missing splits: {', '.join(missing)}")
    rows = [spark.read.option("header", True).csv(names[n]).select(F.col("row_id").cast("long"), F.lit(n).alias("split")) for n in wanted if n in names]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def _folders(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().toString() for f in fs.listStatus(path) if f.isDirectory())


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def read_recipe(spark: SparkSession, path: str) -> dict:
    """A recipe from JSON or YAML. Without a YAML library, only scalars, flat lists and one nested level are read, which is
    what recipes use. A file that holds no table is an error."""
    text = spark.read.text(path, wholetext=True).first().value
    if path.endswith(".json"):
        return json.loads(text)
    if yaml is not None:
        found = yaml.safe_load(text)
        if not isinstance(found, dict):
            raise ValueError(f"no table of settings in {path}")
        return found
    return _plain_yaml(text)


def _plain_yaml(text: str) -> dict:
    out: dict = {}
    key = None
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        inner = line.strip()
        if line[0] != " " and not inner.startswith("- "):
            key, _, value = inner.partition(":")
            out[key] = _scalar(value.strip()) if value.strip() else None
        elif inner.startswith("- "):
            out[key] = [*(out[key] or []), _scalar(inner[2:].strip())]
        else:
            name, _, value = inner.partition(":")
            out[key] = {**(out[key] or {}), name.strip(): _scalar(value.strip())}
    return out


def _scalar(text: str):
    if text[:1] == "[":
        return [_scalar(x.strip()) for x in text[1:-1].split(",") if x.strip()]
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text.strip("'\"")


def write_clean(df: DataFrame, path: str) -> None:
    """The clean table, a folder per source file, so that later scans of one file read only that."""
    df.write.mode("overwrite").partitionBy("source_file").parquet(path)


def write_side_cars(spark: SparkSession, raw: DataFrame, clean: DataFrame, folder: str, source: str, families: dict[str, str] = FAMILIES) -> dict:
    """What goes beside a clean table, as JSON: the families of labels, the quality report, and what each column is for
    (fixed values: the files' names). Returns the columns' roles."""
    schema = column_schema(clean) | {"source_data_dir": source}
    for name, data in (("attack_family_mapping", families), ("data_quality_report", quality_report(raw, clean)), ("column_schema", schema)):
        write_json(spark, f"{folder}/{name}.json", data)
    return schema


def write_splits(labelled: DataFrame, folder: str) -> None:
    """row_id, attack_family, original_label and binary_label of each split, as CSV in the order of row_id."""
    columns = ["row_id", "attack_family", "original_label", (F.col("attack_family") != "benign").cast("int").alias("binary_label")]
    for name in [r.split for r in labelled.select("split").distinct().collect()]:
        labelled.where(F.col("split") == name).select(*columns).orderBy("row_id").write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_json(spark: SparkSession, path: str, data: dict) -> None:
    text = json.dumps(data, indent=2, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def checked_counts(df: DataFrame, by: str = "split") -> dict[str, int]:
    """Rows of each split; a split without rows is an error."""
    counts = {r[by]: r["count"] for r in df.groupBy(by).count().collect()}
    if not counts or min(counts.values()) == 0:
        raise ValueError(f"no rows in some {by}")
    return counts


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """A small table as Markdown; floats with six places."""
    cell = lambda v: f"{v:.6f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows)])


def run_name(label: str = "run", taken: set[str] = frozenset(), now: datetime | None = None) -> str:
    """A name for a run's folder: a cleaned label and the time, with a number if it is taken."""
    base = re.sub("[^0-9A-Za-z._-]+", "_", label).strip("_") or "run"
    stamp = f"{base}_{(now or datetime.now(timezone.utc)):%Y%m%d_%H%M%S}"
    return next(x for x in itertools.chain([stamp], (f"{stamp}_{k}" for k in itertools.count(1))) if x not in taken)


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified, sha256) of the files under a path; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def find_prepared(spark: SparkSession, places: list[str | None], table: str = "clean") -> str:
    """The first of the places (an explicit path, one from the environment, usual folders) that holds the table."""
    for place in filter(None, places):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/{table}/_SUCCESS")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return place
    raise FileNotFoundError(f"no {table} table in any of {', '.join(filter(None, places))}")


def drop_tables(spark: SparkSession, folder: str, tables: list[str]) -> list[str]:
    """Deletes the named tables of a run's folder, and nothing else; returns those that were there."""
    gone = []
    for name in tables:
        if not re.fullmatch("[A-Za-z0-9_.-]+", name) or set(name) == {"."}:
            raise ValueError(f"not a table's name: {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True):
            gone.append(name)
    return gone
