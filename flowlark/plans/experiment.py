"""One leave-one-family-out experiment as a chain of plans: split, windows, scaling, representation, trees, fusion,
calibration, selection. Every stage's result is a table in the run's folder; a stage whose table is complete is read
instead of run again, unless an earlier stage ran. Fitted models and the feature schema are kept beside the tables, and
``Detector`` scores new flows with them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fusion, metrics, models, sampling, scaling, splits, thresholds, transformer, windows
from ..sources import artifacts
from ..sources.tables import read_json, write_json

STAGES = ("split", "windows", "scale", "representation", "trees", "fusion", "calibration")
# Families with too few rows to be held out, and other spellings of family names.
LOW_SUPPORT = ("heartbleed", "infiltration")
SPELLINGS = {"bot": "botnet", "port_scan": "portscan", "bruteforce": "brute_force"}
HELD_OUT = ("botnet", "brute_force", "ddos", "dos", "portscan", "web_attack")


def family_name(text: str) -> str:
    name = text.strip().lower().replace(" ", "_").replace("-", "_")
    return SPELLINGS.get(name, name)


def families(text: str) -> list[str]:
    """A list of families from text with commas; ``all`` is every family that can be held out."""
    if text.strip().lower() == "all":
        return list(HELD_OUT)
    names = list(dict.fromkeys(family_name(x) for x in text.split(",") if x.strip()))
    if low := [n for n in names if n in LOW_SUPPORT]:
        raise ValueError(f"too few rows to hold out: {', '.join(low)}")
    return names


def experiment_name(target: str, scope: str = "full_source_file") -> str:
    """The name of a run: its target and, where windows aren't the usual ones, their scope."""
    return f"no_{target}" if scope == "full_source_file" else f"no_{target}_{scope}"


def budgets(text: str) -> tuple[float, ...]:
    out = tuple(float(x) for x in text.split(",") if x.strip())
    if not out:
        raise ValueError("no budgets")
    return out


@dataclass
class Experiment:
    """Settings of one run; ``folder`` is a path that Spark can write to. With the scope ``disabled`` rows get no window
    features and the benchmark is a strict one. ``select`` retrains the trees on the features that matter to them. With
    ``transformer``, a table of sizes and training settings for ``fit_transformer``, its score and representation join what
    the trees read. Thresholds come from benign rows of the validation split (``mode``: of it alone, or of test_seen too)."""

    spark: SparkSession
    folder: str
    target: str
    features: list[str]
    recipe: dict | None = None
    scope: str = "full_source_file"
    group_columns: tuple[str, ...] = splits.HOST
    fit_rows: int = 400_000
    latent: int = 48
    slots: int = 128
    epochs: int = 20
    tree_rounds: int = 60
    budgets: tuple[float, ...] = thresholds.BUDGETS
    cap: float = 0.05
    select: bool = False
    diversity: float = 0.0
    transformer: dict | None = None
    mode: str = "val_only"
    jitter: bool = True
    fallback: str = "percentile"
    least_positives: int = 50
    least_families: int = 2
    ran: list[str] = field(default_factory=list)

    def _table(self, stage: str, make) -> DataFrame:
        path = f"{self.folder}/{self.target}/{stage}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        there = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)
        if self.ran or not there:
            make().write.mode("overwrite").parquet(path)
            self.ran.append(stage)
        return self.spark.read.parquet(path)

    @property
    def models(self) -> str:
        return f"{self.folder}/{self.target}/models"

    def feature_schema(self, names: list[str]) -> dict:
        """The features in their order, and how they are made (fixed values: the keys, which are a file's contract)."""
        strict = self.scope == "disabled"
        return {
            "experiment": experiment_name(self.target, self.scope),
            "benchmark_mode": "strict_nowindow" if strict else "contextual_window",
            "feature_order": names,
            "split_names": list(splits.SPLITS),
            "model_selection_split": "model_selection_val",
            "total_features_after_preprocessing": len(names),
            "scaler_type": "StandardScaler",
            "imputation": "median",
            "clip_quantiles": [scaling.LOW, scaling.HIGH],
            "no_clip_features": [n for n in names if scaling.is_indicator(n)],
            "clip_fit_scope": "train split only",
            "fit_scope": "train split only",
            "fit_sample_rows": self.fit_rows,
            "window_features": {"enabled": not strict, "columns": names[len(self.features) :], "config": None if strict else self.recipe or {}, "window_scope": self.scope},
            "latent": self.latent,
            "transformer": self.transformer is not None,
            "representation_width": models.representation_width(len(names), self.latent),
        }

    def _tree_rows(self, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
        """A balanced sample of train with the rows that stop the boosting (_held), and these rows alone: the validation
        split's, or a fifth of each family and class of the sample where that split has too few attacks or families of them."""
        train = sampling.balanced_sample(joined.where("split = 'train'"), 80_000, 2.5)
        held = joined.where(F.col("split") == thresholds.validation_split(joined))
        enough = held.where("y = 1").count() >= self.least_positives and sampling.qualified_families(held, 10).count() >= self.least_families
        if enough:
            both = train.withColumn("_held", F.lit(False)).unionByName(held.withColumn("_held", F.lit(True)))
        else:
            both = sampling.stratified_holdout(train, 0.2, ["family", "y"])
        return both, both.where("_held")

    def run(self, clean: DataFrame) -> dict[str, DataFrame]:
        """All tables by stage, with ``candidates``, ``primary`` (a row) and ``report`` (metrics by split)."""
        strict = self.scope == "disabled"
        names = [*self.features, *([] if strict else windows.feature_names(self.recipe))]

        def split() -> DataFrame:
            made = splits.leave_one_family_out(clean, self.target, self.group_columns).select("row_id", "attack_family", "split")
            return made

        chosen = self._table("split", split)

        def features() -> DataFrame:
            if strict:
                return clean.join(chosen.select("row_id", "split"), "row_id")
            return windows.scoped_window_features(clean, chosen.select("row_id", "split"), self.scope, self.recipe)

        wide = self._table("windows", features)

        def scale() -> DataFrame:
            train = wide.where("split = 'train'")
            share = sampling.sample_fraction_for(train.count(), self.fit_rows)
            model = scaling.fit_robust_scaler(sampling.sample_per_file(train, share), names)
            artifacts.save_scaler(self.spark, model, f"{self.models}/scaler")
            write_json(self.spark, f"{self.models}/feature_schema", self.feature_schema(names))
            keep = [F.col("row_id"), F.col("split"), F.col("attack_family").alias("family"), (F.col("attack_family") != "benign").cast("int").alias("y")]
            return model.transform(wide).select(*keep, *names)

        scaled = self._table("scale", scale)

        def represent() -> DataFrame:
            benign = scaled.where("split = 'train' and family = 'benign'")
            model = models.fit_memory_autoencoder(benign, names, self.latent, self.slots, self.epochs, diversity=self.diversity)
            artifacts.save_autoencoder(self.spark, model, f"{self.models}/autoencoder")
            made = models.flat_blocks(model.represent(scaled, names), len(names), self.latent).withColumn("memory_score", F.col("re_scalar"))
            if self.transformer is None:
                return made
            trained = transformer.fit_transformer(scaled.where("split = 'train'"), names, **self.transformer)
            artifacts.save_transformer(self.spark, trained, f"{self.models}/transformer")
            return made.join(trained.flat(scaled, names), "row_id")

        memory = self._table("representation", represent)
        blocks = [c for c in memory.columns if c not in ("row_id", "memory_score")]
        joined = scaled.join(memory, "row_id")

        def trees() -> DataFrame:
            inputs = [*names, *blocks]
            sample, held = self._tree_rows(joined)
            model = models.fit_trees(sample, inputs, rounds=self.tree_rounds, validation="_held")
            if self.select:
                found = models.permutation_importance(lambda d: models.tree_scores(model, d, "score"), held, inputs)
                kept = models.selected_features(found, 0.0, models.PROTECTED)
                model = models.fit_trees(sample, kept, rounds=self.tree_rounds, validation="_held")
            artifacts.save_trees(self.spark, model, f"{self.models}/trees")
            return models.tree_scores(model, joined).select("row_id", "split", "family", "y", "memory_score", "tree_score")

        scored = self._table("trees", trees)
        check = thresholds.validation_split(scored)

        def fuse() -> DataFrame:
            model = fusion.fit_fusion(scored.where(F.col("split") == check))
            artifacts.save_fusion(self.spark, model, f"{self.models}/fusion")
            return model.transform(scored)

        fused = self._table("fusion", fuse)

        def calibrate() -> DataFrame:
            rows, from_ = [], {"mode": self.mode, "validation": check, "jitter": self.jitter, "fallback": self.fallback}
            for name in ("tree_score", "memory_score", "fusion_score"):
                grid = thresholds.budget_grid(fused, self.budgets, name, model=name, **from_)
                rows.append(thresholds.candidates(grid.withColumn("grid_index", F.rank().over(_by_budget())), ["model_name", "grid_index", "target_fpr", "calibration_fpr"], check))
            either = thresholds.either_grid(fused, self.budgets, **from_)
            rows.append(thresholds.candidates(either, ["model_name", "grid_index", "target_fpr", "calibration_fpr"], check))
            out = rows[0]
            for more in rows[1:]:
                out = out.unionByName(more)
            return out

        found = self._table("calibration", calibrate)
        primary = thresholds.primary_candidate(found.where("model_name = 'or_fusion'"), self.cap)
        return {"split": chosen, "windows": wide, "scale": scaled, "representation": memory, "trees": scored, "fusion": fused, "candidates": found, "primary": primary,
                "report": metrics.metrics_at(fused, 0.5, ["split"], "fusion_score")}


def _by_budget():
    from pyspark.sql import Window as W

    return W.partitionBy("split").orderBy("target_fpr")


def summary(primaries: DataFrame) -> DataFrame:
    """Mean, weighted and worst zero-day detection over the families' primary rows (family, z_dr, support)."""
    return metrics.detection_summary(primaries)


@dataclass
class Detector:
    """A run's fitted models, read from its folder, for flows that it hasn't seen."""

    spark: SparkSession
    schema: dict
    scaler: scaling.RobustScalerModel
    autoencoder: models.MemoryAutoencoder
    trees: models.BoostedTrees
    fusion: fusion.FusionModel
    transformer: transformer.NumericTransformer | None = None

    @staticmethod
    def load(spark: SparkSession, folder: str, target: str) -> Detector:
        at = f"{folder}/{target}/models"
        schema = read_json(spark, f"{at}/feature_schema")
        return Detector(
            spark, schema, artifacts.load_scaler(spark, f"{at}/scaler"),
            artifacts.load_autoencoder(spark, f"{at}/autoencoder"), artifacts.load_trees(spark, f"{at}/trees"), artifacts.load_fusion(spark, f"{at}/fusion"),
            artifacts.load_transformer(spark, f"{at}/transformer") if schema["transformer"] else None,
        )

    def score(self, flows: DataFrame) -> DataFrame:
        """(row_id, memory_score, tree_score, fusion_score) of clean flows; windows look back over these flows alone."""
        made, names = self.schema["window_features"], self.schema["feature_order"]
        wide = windows.add_window_features(flows, made["config"]) if made["enabled"] else flows
        scaled = self.scaler.transform(wide).select("row_id", *names)
        blocks = models.flat_blocks(self.autoencoder.represent(scaled, names), len(names), self.schema["latent"])
        if self.transformer is not None:
            blocks = blocks.join(self.transformer.flat(scaled, names), "row_id")
        scored = models.tree_scores(self.trees, scaled.join(blocks, "row_id").withColumn("memory_score", F.col("re_scalar")))
        return self.fusion.transform(scored.select("row_id", "memory_score", "tree_score"))
