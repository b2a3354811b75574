import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlark.operators import models
from flowlark.plans import cli, experiment
from flowlark.plans.views import EVENT_FLOWS, view
from flowlark.sources.tables import read_json


def test_names():
    assert experiment.families(" Port Scan, bot ") == ["portscan", "botnet"] and len(experiment.families("all")) == 6
    assert experiment.budgets("0.01, 0.05") == (0.01, 0.05)
    for bad in (lambda: experiment.families("heartbleed"), lambda: experiment.budgets(" ")):
        with pytest.raises(ValueError):
            bad()


def test_whole_experiment_and_its_restart(spark, tmp_path):
    flows = view(spark, "/root/testdata/sf0.001", EVENT_FLOWS).withColumns(
        {"original_label": F.col("attack_family"), "source_ip": F.concat("source_ip", F.lit("-"), F.floor(F.col("row_id") / 25)), "total_fwd_packets": F.when(F.col("attack_family") != "benign", 50).otherwise(F.col("total_fwd_packets"))}
    )
    recipe = {"window_sizes": [5], "time_window_seconds": []}
    settings = dict(features=["total_fwd_packets", "syn_flag_count"], recipe=recipe, latent=3, slots=8, epochs=2, tree_rounds=3, budgets=(0.02, 0.05))
    first = experiment.Experiment(spark, f"file://{tmp_path}", "dos", **settings)
    out = first.run(flows)
    assert first.ran == list(experiment.STAGES)
    assert out["primary"].count() == 1 and out["report"].count() == out["split"].select("split").distinct().count()
    assert out["candidates"].select("model_name").distinct().count() == 4
    # A new object with the saved models gives the scores that the run gave.
    detector = experiment.Detector.load(spark, f"file://{tmp_path}", "dos")
    assert detector.schema["benchmark_mode"] == "contextual_window" and detector.schema["representation_width"] == len(models.block_columns(len(detector.schema["feature_order"]), 3))
    scored = detector.score(flows).alias("d").join(out["fusion"].alias("f"), "row_id").select(*[F.abs(F.col(f"d.{c}") - F.col(f"f.{c}")).alias(c) for c in ("memory_score", "tree_score", "fusion_score")])
    assert scored.count() == out["fusion"].count() and max(scored.agg(*[F.max(c) for c in scored.columns]).first()) < 1e-6
    again = experiment.Experiment(spark, f"file://{tmp_path}", "dos", **settings)
    again.run(flows)
    assert again.ran == []


def test_runner_over_two_families_without_windows(spark, tmp_path):
    flows = view(spark, "/root/testdata/sf0.001", EVENT_FLOWS).withColumns(
        {"original_label": F.col("attack_family"), "source_ip": F.concat("source_ip", F.lit("-"), F.floor(F.col("row_id") / 25)), "total_fwd_packets": F.when(F.col("attack_family") != "benign", 50).otherwise(F.col("total_fwd_packets"))}
    )
    flows = flows.withColumn("attack_family", F.when(F.col("row_id") % 30 == 0, "ddos").otherwise(F.col("attack_family")))
    out = f"file://{tmp_path}"
    found = cli.run(spark, flows, out, ["dos", "ddos"], features=["total_fwd_packets", "syn_flag_count"], scope="disabled", latent=3, slots=8, epochs=2, tree_rounds=2, budgets=(0.02, 0.05))
    rows = {r.family: r for r in found.collect()}
    assert rows.keys() == {"dos", "ddos"} and rows["dos"].experiment == "no_dos_disabled" and all(r.support > 0 for r in rows.values())
    assert spark.read.text(f"{out}/summary_markdown").first().value == "# Zero-day detection"
    assert spark.read.parquet(f"{out}/dos/report/rates").count() == spark.read.parquet(f"{out}/dos/split").select("split").distinct().count()
    assert experiment.Detector.load(spark, out, "ddos").schema["benchmark_mode"] == "strict_nowindow"


def test_trees_retrained_on_selected_features(spark, tmp_path):
    """The saved trees read the protected blocks and no column that the run doesn't have, and score new flows alike."""
    flows = view(spark, "/root/testdata/sf0.001", EVENT_FLOWS).withColumns(
        {"original_label": F.col("attack_family"), "source_ip": F.concat("source_ip", F.lit("-"), F.floor(F.col("row_id") / 25)), "total_fwd_packets": F.when(F.col("attack_family") != "benign", 50).otherwise(F.col("total_fwd_packets"))}
    )
    folder = f"file://{tmp_path}"
    out = experiment.Experiment(spark, folder, "dos", ["total_fwd_packets"], scope="disabled", latent=1, slots=2, epochs=2, tree_rounds=2, budgets=(0.05,), select=True, diversity=0.1,
                                transformer={"embed": 8, "heads": 2, "depth": 1, "latent": 2, "epochs": 1, "batches": 1}).run(flows)
    detector = experiment.Detector.load(spark, folder, "dos")
    kept = detector.trees.pipeline.stages[0].getInputCols()
    assert set(models.PROTECTED) <= set(kept) <= {"total_fwd_packets", *models.block_columns(1, 1), "transformer_score", "transformer_0", "transformer_1"}
    assert {"transformer_score", "transformer_1"} <= set(out["representation"].columns) and detector.transformer.depth == 1
    scored = detector.score(flows).alias("d").join(out["trees"].alias("t"), "row_id").select(F.abs(F.col("d.tree_score") - F.col("t.tree_score")).alias("gap"))
    assert scored.count() == out["trees"].count() and scored.agg(F.max("gap")).first()[0] < 1e-6


def test_arguments():
    a = cli.parser().parse_args(["--raw", "x", "--out", "y", "--families", "dos,bot", "--budgets", "0.01"])
    assert (a.families, a.budgets, a.scope, a.select, a.diversity) == (["dos", "botnet"], (0.01,), "full_source_file", False, 0.0)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["--raw", "x", "--out", "y", "--scope", "none"])


def test_main_from_raw_files_with_side_cars(spark, tmp_path):
    """The shell's way: CSV files in, the run's tables and what is known about the clean table out."""
    label = F.when(F.col("row_id") % 10 == 0, "DoS Hulk").when(F.col("row_id") % 17 == 0, "Bot").otherwise("BENIGN")
    host = F.concat("source_ip", F.lit("-"), F.floor(F.col("row_id") / 25))
    flows = view(spark, "/root/testdata/sf0.001", EVENT_FLOWS).select(
        host.alias("Source IP"), F.col("destination_ip").alias("Destination IP"), F.col("source_port").alias("Source Port"), F.col("destination_port").alias("Destination Port"), F.date_format("timestamp", "d/M/yyyy H:mm:ss").alias("Timestamp"),
        F.when(label == "BENIGN", F.col("total_fwd_packets")).otherwise(50).alias("Total Fwd Packets"), F.col("syn_flag_count").alias("SYN Flag Count"), F.lit(0).alias("Idle"), label.alias("Label"),
    )
    raw = tmp_path / "raw"
    raw.mkdir()
    frame = flows.toPandas()
    for day, part in (("Monday", frame[:500]), ("Friday", frame[500:])):
        part.to_csv(raw / f"{day}-flows.csv", index=False)
    out = f"file://{tmp_path}/out"
    cli.main(["--raw", f"file://{raw}", "--out", out, "--families", "dos", "--scope", "disabled", "--epochs", "1", "--tree-rounds", "2", "--budgets", "0.05", "--features", "total_fwd_packets,syn_flag_count"])
    about = {name: read_json(spark, f"{out}/about/{name}.json") for name in ("attack_family_mapping", "data_quality_report", "column_schema")}
    assert about["data_quality_report"]["original_rows"] == 1000 and sum(about["data_quality_report"]["attack_family_counts"].values()) == about["data_quality_report"]["rows_after_dedup"]
    assert "idle" in about["column_schema"]["dropped_columns"] and about["column_schema"]["source_data_dir"] == f"file://{raw}" and "BENIGN" in about["attack_family_mapping"]
    assert spark.read.parquet(f"{out}/summary").count() == 1 and spark.read.parquet(f"{out}/dos/report/rates").count() > 2
