"""Selections and look-ups that are joins, with the checks that belong to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a reference table (two numbers each) that may be broadcast; beyond, the join shuffles.
SMALL_REFERENCES = 1_000_000


def select_by_index(records: DataFrame, indices: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """The records at the given indices; the limit takes the least indices. Spark picks the join by size."""
    chosen = indices.select(key).distinct()
    return records.join(chosen.orderBy(key).limit(limit) if limit is not None else chosen, key, "left_semi")


def check_range(indices: DataFrame, key: str, count: int) -> None:
    """Raises for an index below 0 or from ``count`` on."""
    low, high = indices.agg(F.min(key), F.max(key)).first()
    if low is None:
        raise ValueError("no indices were selected")
    if low < 0 or high >= count:
        raise IndexError(f"indices run from {low} to {high}, records from 0 to {count - 1}")


def zip_strict(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """Rows of both by ordinal; raises unless each ordinal stands once on either side."""
    sides = left.select(ordinal, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(ordinal, F.lit(0).alias("l"), F.lit(1).alias("r")))
    uneven = sides.groupBy(ordinal).agg(F.sum("l").alias("l"), F.sum("r").alias("r")).where("l != 1 or r != 1")
    if not uneven.isEmpty():
        raise ValueError("the sides differ in length or ordinals")
    return left.join(right, ordinal)


def element_sets(atoms: DataFrame, frame: str, z: str) -> DataFrame:
    """frame, elements: the sorted distinct elements of each frame."""
    return atoms.groupBy(frame).agg(F.sort_array(F.collect_set(z)).alias("elements"))


def element_union(sets: list[DataFrame], z: str) -> DataFrame:
    """The distinct elements of several tables of atoms."""
    every = sets[0].select(z)
    for more in sets[1:]:
        every = every.unionByName(more.select(z))
    return every.distinct()


def subtract_references(frames: DataFrame, atoms: DataFrame, references: DataFrame, frame: str, energy: str) -> DataFrame:
    """frames with n_atoms and residual: energy less the sum of the atoms' reference energies (atoms: frame, z; references: z, e_ref).

    Raises for atoms without a reference, and for elements with two. An energy reference of null counts as none.
    """
    references = references.where("e_ref is not null").select("z", "e_ref")
    n, distinct = references.agg(F.count("*"), F.count_distinct("z")).first()
    if n != distinct:
        raise ValueError("an element has several reference energies")
    lacking = missing_references(atoms, references).limit(20).collect()  # named in the error
    if lacking:
        raise ValueError(f"no reference energy for {', '.join(sorted(str(r.z) for r in lacking))}")
    known = F.broadcast(references) if n <= SMALL_REFERENCES else references
    sums = atoms.join(known, "z").groupBy(frame).agg(F.sum("e_ref").alias("_e"), F.count("*").alias("n_atoms"))
    return frames.join(sums, frame).withColumn("residual", F.col(energy) - F.col("_e")).drop("_e")


def missing_references(atoms: DataFrame, references: DataFrame) -> DataFrame:
    return atoms.select("z").distinct().join(references.select("z"), "z", "left_anti")


def missing_keys(required: list[str], present: DataFrame, column: str) -> DataFrame:
    spark = present.sparkSession
    return spark.createDataFrame([(k,) for k in required], f"{column} string").join(present.select(column).distinct(), column, "left_anti")


def latest(listing: DataFrame, key: list[str], path: str, mtime: str, default: str | None = None) -> DataFrame:
    """The newest path of each key, ties by the greatest path; ``default`` where all paths are null."""
    best = F.max(F.struct(mtime, path))[path].alias(path)
    out = listing.groupBy(*key).agg(best) if key else listing.agg(best)
    return out.withColumn(path, F.coalesce(path, F.lit(default))) if default is not None else out


def with_sibling(files: DataFrame, siblings: DataFrame, parent: str) -> DataFrame:
    """The files whose parent also holds one of ``siblings``."""
    return files.join(siblings.select(parent), parent, "left_semi")


def except_pretrained(listing: DataFrame, path: str, pretrained: str) -> DataFrame:
    """The artifacts that aren't the pretrained one itself."""
    return listing.where(F.col(path) != F.lit(pretrained))


def restart_files(files: DataFrame, options: DataFrame, parent: str, content: str, run: str) -> DataFrame:
    """The files beside an options file whose text holds the run's id."""
    return with_sibling(files, options.where(F.contains(content, F.lit(run))), parent)
