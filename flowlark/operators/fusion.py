"""Fusing a tree probability with a reconstruction score, as column expressions, and its calibrated classifier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = ("tree_probability", "tree_logit", "memory_score", "memory_log", "product", "larger", "difference", "smaller")


def fusion_columns(tree: Column, memory: Column) -> dict[str, Column]:
    """The eight fusion features: x, its logit (clipped at 1e-6), m, log1p m, x log1p m, max and min of x and
    tanh(log1p(m) / 10), and |x - m|. The last is x's distance to the raw score."""
    edge = 1e-6
    clip = F.least(F.greatest(tree, F.lit(edge)), F.lit(1 - edge))
    grown = F.log1p(F.greatest(memory, F.lit(0.0)))
    squashed = F.tanh(grown / 10)
    values = (tree, F.ln(clip / (1 - clip)), memory, grown, tree * grown, F.greatest(tree, squashed), F.abs(tree - memory), F.least(tree, squashed))
    return dict(zip(NAMES, values, strict=True))


def with_fusion_features(df: DataFrame, tree: str = "tree_score", memory: str = "memory_score") -> DataFrame:
    made = fusion_columns(F.col(tree).cast("double"), F.col(memory).cast("double"))
    return df.withColumns({f"fusion_{name}": value for name, value in made.items()})


def class_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """``df`` with a weight that makes both classes weigh the same (1 where a class is missing)."""
    n, ones = df.agg(F.count(F.lit(1)), F.sum(F.col(y).cast("long"))).first()
    ones = ones or 0
    if not ones or ones == n:
        return df.withColumn("weight", F.lit(1.0))
    return df.withColumn("weight", F.when(F.col(y) == 1, n / (2.0 * ones)).otherwise(n / (2.0 * (n - ones))))


@dataclass
class FusionModel:
    """Logistic models, each with an isotonic map learnt on the rows it hasn't seen; the score is their mean."""

    parts: list

    def transform(self, df: DataFrame, output: str = "fusion_score") -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        out = VectorAssembler(inputCols=[f"fusion_{n}" for n in NAMES], outputCol="_features").transform(with_fusion_features(df))
        for k, (logistic, isotonic) in enumerate(self.parts):
            out = logistic.transform(out).withColumn("_p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
            out = isotonic.transform(out).withColumnRenamed("prediction", f"_s{k}").drop("_p")
        scores = [F.col(f"_s{k}") for k in range(len(self.parts))]
        mean = sum(scores[1:], scores[0]) / len(scores)
        return out.select(*df.columns, mean.alias(output))


def fit_fusion(df: DataFrame, y: str = "y", id_col: str = "row_id", folds: int = 3) -> FusionModel:
    """Folds by a hash of the id. Each fold's isotonic map is learnt on it, its logistic model on the others. Rows of a fold
    that are equal in label and scores are learnt from as one that weighs their number."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    rows = df.select(F.col(y).cast("double").alias("_y"), "tree_score", "memory_score", F.pmod(F.xxhash64(id_col), F.lit(folds)).alias("_fold"))
    data = with_fusion_features(class_weights(rows, "_y").groupBy(*rows.columns, "weight").agg(F.count(F.lit(1)).cast("double").alias("_n")))
    data = VectorAssembler(inputCols=[f"fusion_{n}" for n in NAMES], outputCol="_features").transform(data).select("_features", "_y", (F.col("weight") * F.col("_n")).alias("weight"), "_n", "_fold").cache()
    parts = []
    for k in range(folds):
        logistic = LogisticRegression(featuresCol="_features", labelCol="_y", weightCol="weight", maxIter=200).fit(data.where(F.col("_fold") != k))
        held = logistic.transform(data.where(F.col("_fold") == k)).withColumn("_p", vector_to_array("probability")[1])
        parts.append((logistic, IsotonicRegression(featuresCol="_p", labelCol="_y", weightCol="_n").fit(held.select("_p", "_y", "_n"))))
    data.unpersist()
    return FusionModel(parts)
