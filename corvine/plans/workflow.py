"""Whole runs: curate a dataset into splits, make frames model-ready, gather the errors of training runs, set data paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tensors import label_and_path
from ..operators import control, lookups, splits
from ..sources import configs, frames, logs, sinks

SPLITS = ["all", "train", "val", "half", "half_train", "half_val"]


def curate(spark: SparkSession, indices: str, dataset: str, output: str, seed: int = 42, fraction: float = 0.8, limit: int | None = None) -> DataFrame:
    """Selected records of a JSON array as frames, in six splits under ``output``: frames, index lists, metadata. Returns split and n."""
    chosen = frames.read_indices(spark, indices, limit)
    records = frames.read_json_array(spark, dataset)
    total = records.count()
    lookups.check_range(chosen, "source_index", total)
    found = frames.records_to_frames(lookups.select_by_index(records, chosen, "source_index"))
    ordered = [r.source_index for r in chosen.select("source_index").distinct().orderBy("source_index").collect()]  # the sample that the user lists
    places = spark.createDataFrame(list(enumerate(ordered)), "position long, source_index long")
    members = splits.exact_splits(spark, len(ordered), fraction, seed).join(places, "position").select("split", "ord", "source_index")
    sinks.write_splits(found, members, f"{output}/frames")
    counts = members.groupBy("split").agg(F.count("*").alias("n"))
    for name, n in counts.collect():  # six rows
        sinks.write_indices(members, name, f"{output}/indices/{name}")
        known = {"output": f"{output}/frames", "sample_indices_file": f"{output}/indices/{name}", "train_fraction": fraction, "seed": seed, "source": dataset, "source_frame_count": total, "record_source": "dataset", "indices_source": indices}
        sinks.write_text(spark, sinks.metadata(name, n, len(ordered), **known), f"{output}/metadata/{name}")
    return counts


def normalize(found: DataFrame, references: DataFrame | None, prefix: str, flat_stress: bool = False) -> DataFrame:
    """Frames with targets under the prefix, checked; with references, n_atoms and residual too."""
    ready = sinks.model_ready(found, prefix, flat_stress)
    sinks.validate_targets(ready, prefix)
    if references is None:
        return ready
    atoms = found.select("source_index", F.explode("numbers").alias("z"))
    return lookups.subtract_references(ready, atoms, references, "source_index", f"{prefix}_energy")


def evaluate(spark: SparkSession, runs: list[str], out: str | None = None) -> DataFrame:
    """The errors of runs, each LABEL=path or a path, as one long table; written as CSV if asked."""
    asked = spark.createDataFrame([(r,) for r in runs], "arg string")
    label, path = label_and_path(F.col("arg"))
    files = None
    for r in asked.select(label.alias("label"), path.alias("path")).collect():  # the user's short list
        part = logs.read_files(spark, r.path).withColumn("label", F.lit(r.label))
        files = part if files is None else files.unionByName(part)
    table = logs.load(files)
    if out:
        sinks.write_metrics(table, out)
    return table


def set_paths(spark: SparkSession, config: str, output: str, train: str, val: str) -> dict:
    """The configuration with the paths of its training and validation data, written to ``output``."""
    changed = configs.read_yaml(spark, config)
    for kind, path in (("train", train), ("val", val)):
        changed = control.set_nested(changed, [f"{kind}_dataset", "splits", kind, "src"], path)
    configs.write_yaml(spark, changed, output)
    return changed
