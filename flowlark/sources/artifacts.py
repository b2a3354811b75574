"""Fitted models as files that any later session reads: scalers as JSON, arrays as Parquet, Spark ML models in their own format."""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
from pyspark.sql import SparkSession

from ..operators.fusion import FusionModel
from ..operators.models import BoostedTrees, MemoryAutoencoder
from ..operators.scaling import RobustScalerModel
from ..operators.transformer import NumericTransformer
from .tables import read_json, write_json


def save_scaler(spark: SparkSession, model: RobustScalerModel, path: str) -> None:
    write_json(spark, path, {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(model).items()})


def load_scaler(spark: SparkSession, path: str) -> RobustScalerModel:
    """Bounds without an end are kept as JSON's Infinity."""
    held = read_json(spark, path)
    return RobustScalerModel(held["features"], held["stats"], tuple(held["negative_is_missing"]))


def _save_arrays(spark: SparkSession, arrays: dict[str, np.ndarray], path: str) -> None:
    """A row per array: its name, shape and values."""
    rows = [(name, list(map(int, a.shape)), a.astype(float).ravel().tolist()) for name, a in arrays.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, held array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def _load_arrays(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r.name: np.array(r.held).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}


def save_autoencoder(spark: SparkSession, model: MemoryAutoencoder, path: str) -> None:
    """The shrink limit is an array too."""
    _save_arrays(spark, model.weights | {"shrink": np.array([model.shrink])}, path)


def load_autoencoder(spark: SparkSession, path: str) -> MemoryAutoencoder:
    arrays = _load_arrays(spark, path)
    return MemoryAutoencoder({k: v for k, v in arrays.items() if k != "shrink"}, float(arrays["shrink"][0]))


def save_transformer(spark: SparkSession, model: NumericTransformer, path: str) -> None:
    """The weights as arrays, the shape of the model beside them."""
    _save_arrays(spark, model.weights, f"{path}/weights")
    write_json(spark, f"{path}/shape", {"heads": model.heads, "depth": model.depth, "pooling": model.pooling})


def load_transformer(spark: SparkSession, path: str) -> NumericTransformer:
    return NumericTransformer(_load_arrays(spark, f"{path}/weights"), **read_json(spark, f"{path}/shape"))


def save_trees(spark: SparkSession, model: BoostedTrees, path: str) -> None:
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    write_json(spark, f"{path}/rounds", {"rounds": model.rounds})


def load_trees(spark: SparkSession, path: str) -> BoostedTrees:
    from pyspark.ml import PipelineModel

    return BoostedTrees(PipelineModel.load(f"{path}/pipeline"), read_json(spark, f"{path}/rounds")["rounds"])


def save_fusion(spark: SparkSession, model: FusionModel, path: str) -> None:
    write_json(spark, f"{path}/parts", {"parts": len(model.parts)})
    for k, pair in enumerate(model.parts):
        for name, part in zip(("logistic", "isotonic"), pair, strict=True):
            part.write().overwrite().save(f"{path}/{name}-{k}")


def load_fusion(spark: SparkSession, path: str) -> FusionModel:
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.regression import IsotonicRegressionModel

    parts = range(read_json(spark, f"{path}/parts")["parts"])
    return FusionModel([(LogisticRegressionModel.load(f"{path}/logistic-{k}"), IsotonicRegressionModel.load(f"{path}/isotonic-{k}")) for k in parts])
