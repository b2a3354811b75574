"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct hashed n-grams (3 to 5 symbols) of a text. Learning takes a bounded sample of the labelled rows, ``PER_CLASS`` of
each label at most, chosen by a hash of the id. A first pass counts, for each n-gram, the texts of either
label that hold it; r is the log of the ratio of the two smoothed, normalised counts. A second pass writes each sampled
text's selected n-grams as a sparse vector of x * r, and Spark ML's logistic regression is fitted on these with an L2
penalty: gradients are summed on the executors, the driver holds vectors of the features' number alone, 2**BITS at
most. Every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import chunks, fresh_path, in_chunks, stored
from .ngrams import grams, letters

BITS = 20
WIDTHS = (3, 4, 5)
CHUNK = 1 << 18
#: Tasks that the bounded sample is dealt to.
TASKS = 4
#: The bound of the learning sample: labelled texts of each class.
PER_CLASS = 3000
#: Defaults of what an n-gram needs to be a feature: texts of one class that hold it, and the least log ratio either way.
#: These and the penalty have the least log loss, both labels weighing the same, on a quarter of the learning rows (a
#: remainder of their ids' crc32) that the fit was kept from; labels outside the learning rows had no part in it.
LEAST_TEXTS = 2
LEAST_RATIO = 2.0
#: The L2 penalty of the summed loss, and the most rounds; the fit stops before when it has converged.
PENALTY, ROUNDS, TOL = 10.0, 100, 1e-4
THRESHOLD = 0.7


@dataclass
class Model:
    buckets: np.ndarray  # sorted hashes of the features
    weights: np.ndarray  # of each feature, already times r
    bias: float


def _features(texts: list, mark: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, hash) pairs of the texts' n-grams, in that order; with ``mark``, of the hashes marked in it."""
    codes, starts = letters(texts)
    keys = []
    for width in WIDTHS:
        places, h = grams(codes, width, BITS)
        if mark is not None:
            hit = np.flatnonzero(mark[h])
            places, h = places[hit], h[hit]
        keys.append((np.searchsorted(starts, places, side="right") - 1 << BITS) | h.astype(np.int64))
    keys = np.unique(np.concatenate(keys))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def _mark(buckets: np.ndarray) -> np.ndarray:
    mark = np.zeros(1 << BITS, bool)
    mark[buckets] = True
    return mark


def fit(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "label", id_col: str = "doc_id",
    per_class: int = PER_CLASS, least_texts: int = LEAST_TEXTS, least_ratio: float = LEAST_RATIO,
) -> Model:
    """Learns from the documents with a text and a label of 0 or 1 (``labels``: the id and the label, one row an id).

    The sample is drawn from the labels alone, so that at most 2 * ``per_class`` ids are broadcast to the documents and no
    text is shuffled but the sampled ones'. An n-gram is a feature if ``least_texts`` texts of one label hold it and its
    ratio is ``least_ratio`` or more either way; there is no other bound on them but the hash's. Rows that repeat an id
    are texts of their own, very long texts are learnt from whole. Without documents of both labels no n-gram tells
    anything: the model then has only a bias, the smoothed share of 1.
    """
    spark = docs.sparkSession
    counts, sizes, sample = _counted(docs, labels, text_col, label_col, id_col, per_class)
    prior = (sizes.get(1, 0) + 1) / (sizes.get(0, 0) + sizes.get(1, 0) + 2)
    if not (sizes.get(0) and sizes.get(1)):
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(prior / (1 - prior))))
    strong = _strong(counts, least_texts, least_ratio)
    buckets, ratio = strong["bucket"].to_numpy(np.int64), strong["ratio"].to_numpy(np.float64)
    if not len(buckets):
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0)
    weights, bias = _logistic(_vectors(spark, sample, sizes, buckets, ratio), sum(sizes.values()))
    return Model(buckets, (weights * ratio).astype(np.float32), bias)


def _counted(docs: DataFrame, labels: DataFrame, text_col: str, label_col: str, id_col: str, per_class: int) -> tuple[DataFrame, dict[int, int], DataFrame]:
    """Per n-gram the sampled texts of either label that hold it (bucket, n0, n1); how many texts there are; the texts."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), F.xxhash64(F.col(id_col), F.lit(17)).alias("at")
    )
    drawn = [known.where(F.col("label") == y).orderBy("at", "id").limit(per_class) for y in (0, 1)]
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = stored(texts.join(F.broadcast(drawn[0].union(drawn[1])), "id").select("label", "text"), "toxic-sample").repartition(TASKS)
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}

    def count(batches):
        seen = np.zeros((2, 1 << BITS), np.int32)
        for part in chunks(batches, most=CHUNK):
            of, h = _features(part.column("text").to_pylist())
            label = part.column("label").to_numpy()
            for y in (0, 1):
                own, n = np.unique(h[label[of] == y], return_counts=True)
                seen[y][own] += n.astype(np.int32)
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[0][at]), pa.array(seen[1][at])], ["bucket", "n0", "n1"])

    counted = sample.mapInArrow(count, "bucket int, n0 int, n1 int").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return stored(counted, "toxic-counts"), sizes, sample


def _strong(counts: DataFrame, least_texts: int, least_ratio: float):
    """(bucket, ratio) of the features, by bucket: 2**BITS rows at most. Counts are smoothed by 1, unseen n-grams' too."""
    all0, all1 = counts.agg(F.sum("n0"), F.sum("n1")).first()
    share = lambda n, total: F.log((F.col(n) + 1) / F.lit(float(total + (1 << BITS))))
    found = counts.select("bucket", (share("n1", all1) - share("n0", all0)).alias("ratio"), F.greatest("n0", "n1").alias("most"))
    return found.where((F.col("most") >= least_texts) & (F.abs("ratio") >= least_ratio)).select("bucket", "ratio").orderBy("bucket").toPandas()


def _vectors(spark, sample: DataFrame, sizes: dict[int, int], buckets: np.ndarray, ratio: np.ndarray) -> DataFrame:
    """The sampled texts as rows (features: a sparse vector, label, weight), both labels weighing the same in all."""
    held = spark.sparkContext.broadcast((buckets, ratio))
    total = sum(sizes.values())
    weight = np.array([0.5 * total / sizes[0], 0.5 * total / sizes[1]])

    def listed(batches):
        own, r = held.value
        mark = _mark(own)
        for part in chunks(batches, most=CHUNK):
            of, h = _features(part.column("text").to_pylist(), mark)
            n = part.num_rows
            ends = pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32())
            at = np.searchsorted(own, h)
            indices, values = pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(r[at]))
            sparse = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, len(own), np.int32)), indices, values], ["type", "size", "indices", "values"])
            label = part.column("label").to_numpy()
            yield pa.RecordBatch.from_arrays([sparse, pa.array(label.astype(np.float64)), pa.array(weight[label])], ["features", "label", "weight"])

    path = fresh_path(spark, "toxic-vectors")
    sample.mapInArrow(listed, "features struct<type:tinyint,size:int,indices:array<int>,values:array<double>>, label double, weight double").write.parquet(path)
    # A vector's columns are the struct just written, so the reader makes vectors of it.
    return spark.read.schema(StructType([StructField("features", VectorUDT()), StructField("label", DoubleType()), StructField("weight", DoubleType())])).parquet(path)


def _logistic(rows: DataFrame, n: int) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on the vectors, by L-BFGS until it has converged."""
    fitted = LogisticRegression(weightCol="weight", regParam=PENALTY / n, standardization=False, maxIter=ROUNDS, tol=TOL).fit(rows)
    return fitted.coefficients.toArray(), float(fitted.intercept)


def _scores(texts: list, model: Model, mark: np.ndarray) -> np.ndarray:
    of, h = _features(texts, mark)
    z = np.bincount(of, model.weights[np.searchsorted(model.buckets, h)], minlength=len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def score_column(spark, model: Model, text: Column) -> Column:
    """The score as a column, for filters that keep their rows as they are. Null, empty and letterless texts get the bias'
    score, very long ones are scored whole, repeated rows each; an empty table stays empty."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mark = _mark(held.value.buckets)
        for texts in batches:
            yield pa.array(in_chunks(lambda x: _scores(x, held.value, mark), texts, CHUNK))

    return scored(text)


def score(df: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: the id, score (0 to 1) and predicted (1 from a score of 0.7 on). Null, empty and letterless texts get the
    bias' score; equal texts get equal scores; very long texts are scored whole; repeated ids are rows of their own; an
    empty table gives no rows; other columns are not read."""
    held = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = held.value
        mark = _mark(m.buckets)
        for part in chunks(batches, most=CHUNK):
            p = _scores(part.column("text").to_pylist(), m, mark)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    return src.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
