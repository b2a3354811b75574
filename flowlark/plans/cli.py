"""Runs experiments from a shell: ``python -m flowlark.plans.cli --raw FOLDER --out FOLDER --families all``.

Raw tables are read and cleaned, with what is known about them beside the clean table; one experiment is run for each family, and the run's folder gets the primary rows, the
report of each family as tables, and a summary in Markdown.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, metrics
from ..sources import tables
from .experiment import Experiment, budgets, experiment_name, families, summary


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    out.add_argument("--raw", required=True, help="a folder of CSV or Parquet tables")
    out.add_argument("--out", required=True, help="the run's folder, on a file system that Spark writes to")
    out.add_argument("--families", default="all", type=families, help="families to hold out, with commas, or all")
    out.add_argument("--budgets", default="0.001,0.005,0.01,0.02,0.05", type=budgets, help="false-positive budgets")
    out.add_argument("--scope", default="full_source_file", choices=["full_source_file", "split_only", "causal_past_only", "disabled"])
    out.add_argument("--features", help="feature columns with commas; all numeric ones if left out")
    out.add_argument("--recipe", help="a JSON or YAML file of window settings")
    out.add_argument("--cap", default=0.05, type=float, help="the false-positive rate that a primary row may have")
    out.add_argument("--epochs", default=20, type=int)
    out.add_argument("--diversity", default=0.0, type=float, help="the weight of the memory slots' likeness in the loss")
    out.add_argument("--tree-rounds", default=60, type=int)
    out.add_argument("--select", action="store_true", help="retrain the trees on the features that matter")
    out.add_argument("--drop-windows", action="store_true", help="delete the window tables at the end")
    return out


def report(fused: DataFrame, threshold: float, score: str = "fusion_score") -> dict[str, DataFrame]:
    """What is known about a score at a threshold, as small tables: rates by split, confusion matrix, curves and their
    areas, histogram, sensitivity to the threshold, counts by split and family."""
    test = fused.where("split = 'test_zero_day'")
    return {
        "rates": metrics.metrics_at(fused, threshold, ["split"], score),
        "confusion": metrics.confusion_matrix(test, F.col(score) >= threshold),
        "roc": metrics.roc_curve(test, score),
        "precision_recall": metrics.precision_recall_curve(test, score),
        "areas": metrics.areas(test, score),
        "histogram": metrics.histogram(test, score),
        "sensitivity": metrics.at_thresholds(test, [k / 100 for k in range(1, 100)], score=score),
        "reconstruction": metrics.reconstruction_statistics(test),
        "families": fused.groupBy("split", "family").agg(F.count(F.lit(1)).alias("n")),
    }


def run(spark: SparkSession, clean: DataFrame, out: str, targets: list[str], **settings) -> DataFrame:
    """One experiment for each target over clean flows; returns a row for each, which ``out``/summary holds too."""
    rows = []
    for target in targets:
        done = Experiment(spark, out, target, **settings).run(clean)
        best = done["primary"].first()
        support = done["fusion"].where((F.col("split") == "test_zero_day") & (F.col("family") == target)).count()
        for name, table in report(done["fusion"], 0.5).items():
            table.write.mode("overwrite").parquet(f"{out}/{target}/report/{name}")
        made = experiment_name(target, settings.get("scope", "full_source_file"))
        rows.append((made, target, best.target_fpr, best.validation.f1, best.test_zero_day.z_dr, best.test_zero_day.fpr, best.fpr_status, support))
    found = spark.createDataFrame(rows, "experiment string, family string, target_fpr double, validation_f1 double, z_dr double, fpr double, fpr_status string, support long")
    found.write.mode("overwrite").parquet(f"{out}/summary")
    total = summary(found.select("family", "z_dr", "support")).first().asDict()
    text = "\n\n".join(["# Zero-day detection", tables.markdown_table([r.asDict() for r in found.collect()], found.columns), tables.markdown_table([total], list(total))])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/summary_markdown")
    return found


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("flowlark").getOrCreate()
    raw = tables.load_raw(spark, a.raw)
    tables.write_clean(cleaning.clean(raw), f"{a.out}/clean")
    clean = spark.read.parquet(f"{a.out}/clean")
    schema = tables.write_side_cars(spark, raw, clean, f"{a.out}/about", a.raw)
    names = a.features.split(",") if a.features else schema["numerical_features"]
    recipe = tables.read_recipe(spark, a.recipe) if a.recipe else None
    run(
        spark, clean, a.out, a.families, features=names, recipe=recipe, scope=a.scope, budgets=a.budgets, cap=a.cap, epochs=a.epochs, diversity=a.diversity, tree_rounds=a.tree_rounds, select=a.select,
    ).show(truncate=False)
    if a.drop_windows:
        for target in a.families:
            tables.drop_tables(spark, f"{a.out}/{target}", ["windows"])


if __name__ == "__main__":
    main()
