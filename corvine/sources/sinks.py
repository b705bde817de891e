"""Sinks: splits, index lists, metadata, model-ready frames, metric tables."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tensors import KBAR, voigt_to_matrix, voigt_to_nine


def write_splits(frames: DataFrame, splits: DataFrame, path: str, key: str = "source_index") -> None:
    """Every split's frames with their order, one folder a split, so reading one prunes the others."""
    splits.join(frames, key).write.partitionBy("split").parquet(path)


def write_indices(splits: DataFrame, split: str, path: str, key: str = "source_index") -> None:
    """One integer a line in the split's order. One file, as its readers expect: a list of numbers."""
    splits.where(F.col("split") == split).orderBy("ord").select(F.col(key).cast("string")).coalesce(1).write.text(path)


#: Units and order that a split's metadata states.
UNITS = {
    "output_order": "source-index order for all files; seeded shuffled order for split files",
    "energy_unit": "eV",
    "forces_unit": "eV/Angstrom",
    "stress_input_unit": "kbar",
    "stress_output_unit": "eV/Angstrom^3",
    "stress_conversion_factor": KBAR,
}


def metadata(split: str, count: int, total: int, **more) -> str:
    """A split's provenance as JSON: when, what and how many, then what the caller knows (files, seed, fraction, source), then units."""
    return json.dumps({"created_at_utc": datetime.now(UTC).isoformat(), "split": split, "sample_size": count, "desired_frame_count": total, **more, **UNITS}, indent=2)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small text, such as metadata or a configuration, as a folder of one file."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)


def write_descriptors(descriptors: DataFrame, path: str) -> None:
    """frame and descriptor (array) of each frame."""
    descriptors.write.parquet(path)


def model_ready(frames: DataFrame, prefix: str, flat_stress: bool) -> DataFrame:
    """energy, forces, stress (Voigt, or 3x3) under the prefix; stress as 9 numbers or 3x3; anything calculated is dropped."""
    if dict(frames.dtypes)["stress"].startswith("array<array"):
        stress = F.flatten("stress") if flat_stress else F.col("stress")
    else:
        stress = (voigt_to_nine if flat_stress else voigt_to_matrix)(F.col("stress"))
    drop = [c for c in frames.columns if c.startswith("calc_")]
    return frames.drop(*drop).withColumn("stress", stress).withColumnsRenamed({c: f"{prefix}_{c}" for c in ("energy", "forces", "stress")})


def validate_targets(frames: DataFrame, prefix: str) -> None:
    """Raises unless there are frames, and every one has all targets."""
    names = [f"{prefix}_{c}" for c in ("energy", "forces", "stress")]
    n, *have = frames.agg(F.count("*"), *(F.count(c) for c in names)).first()
    lacking = [c for c, k in zip(names, have, strict=True) if k < n]
    if not n or lacking:
        raise ValueError("no frames" if not n else f"frames lack {', '.join(lacking)}")


def extxyz_text(n: Column, comment: Column, species: Column, positions: Column) -> Column:
    """A frame as extxyz lines."""
    line = lambda s, p: F.concat_ws(" ", s, F.array_join(F.transform(p, lambda x: x.cast("string")), " "))
    return F.concat_ws("\n", n.cast("string"), comment, F.array_join(F.zip_with(species, positions, line), "\n"))


def model_text(prefix: str, info: tuple[str, ...] = ()) -> Column:
    """A model-ready frame (n, species, positions, the prefixed targets) as extxyz lines: its targets and ``info`` columns in the comment, forces beside positions."""
    nine = F.array_join(F.transform(F.flatten(f"{prefix}_stress"), lambda x: x.cast("string")), " ")
    more = [F.concat(F.lit(f" {c}="), F.col(c).cast("string")) for c in info]
    comment = F.concat(F.lit(f"Properties=species:S:1:pos:R:3:{prefix}_forces:R:3 {prefix}_energy="), F.col(f"{prefix}_energy").cast("string"), F.lit(f' {prefix}_stress="'), nine, F.lit('"'), *more)
    return extxyz_text(F.col("n"), comment, F.col("species"), F.zip_with("positions", f"{prefix}_forces", lambda p, f: F.concat(p, f)))


def write_extxyz(frames: DataFrame, prefix: str, path: str, order: list[str], info: tuple[str, ...] = ()) -> None:
    """Model-ready frames (stress 3x3) as text files in the given order, which the files' names follow."""
    frames.orderBy(*order).select(model_text(prefix, info)).write.text(path)


def write_metrics(table: DataFrame, path: str) -> None:
    table.write.csv(path, header=True)
