"""Frames and their selections: extxyz text, JSON arrays and records, index lists, artifact listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tensors import atomic_number, reshape_n3, stress_from_kbar

RECORD = "structure string, energy double, forces array<array<double>>, stress string, matpes_id string, formula_pretty string, functional string"
#: What is read of a structure in its dictionary form.
STRUCTURE = "lattice struct<matrix: array<array<double>>>, sites array<struct<species: array<struct<element: string, occu: double>>, xyz: array<double>, abc: array<double>>>"
OPTIONAL = ["matpes_id", "formula_pretty", "functional"]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 0), text of the text files under ``path``. Files are split; a line's number is its place in its block and the lines of the blocks before."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text"))
    counts = rows.groupBy("path", "_block").agg(F.count("*").alias("_n"))  # a row for each block of a file
    before = W.partitionBy("path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("path", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("path", "_block").orderBy("_id")) - 1
    return rows.withColumn("_at", within).join(offsets, ["path", "_block"]).select("path", (F.col("_before") + F.col("_at")).alias("line"), "text")


def read_extxyz(spark: SparkSession, path: str, names: str = r"\.(ext)?xyz$") -> DataFrame:
    """path, file_rank, frame_ord, n, comment, info, species, positions, forces of every frame of the .xyz and .extxyz files under ``path``.

    ``names`` matches the names of other files, such as the .txt ones that ``write_extxyz`` leaves.

    Files are ordered by suffix (.xyz, then .extxyz), then path: file_rank. A line of one integer begins a frame unless it is
    the comment of the frame before; each frame then asks for its lines by number, so no task holds a file.
    """
    lines = numbered_lines(spark, path).where(F.col("path").rlike(names))
    lone = lines.where(F.trim("text").rlike("^[0-9]+$")).select("path", "line", F.trim("text").cast("int").alias("n"))
    by_line = W.partitionBy("path").orderBy("line")
    island = lone.withColumn("_run", F.col("line") - F.row_number().over(by_line))
    starts = island.withColumn("_place", F.row_number().over(W.partitionBy("path", "_run").orderBy("line"))).where("_place % 2 = 1")
    starts = starts.select("path", (F.row_number().over(by_line) - 1).alias("frame_ord"), "n", "line")
    wanted = starts.select("path", "frame_ord", "n", F.posexplode(F.expr("sequence(line + 1, line + 1 + n)")).alias("_at", "line"))
    held = wanted.join(lines, ["path", "line"]).groupBy("path", "frame_ord", "n").agg(F.sort_array(F.collect_list(F.struct("_at", "text"))).alias("_l"))  # the lines of one frame
    rows = held.select("path", F.when(F.col("path").endswith(".extxyz"), 2).otherwise(1).alias("file_rank"), "frame_ord", "n", F.expr("_l[0].text").alias("comment"), F.expr("transform(slice(_l, 2, n), x -> x.text)").alias("atoms"))
    cells = F.transform("atoms", lambda a: F.split(F.trim(a), r"\s+"))
    number = lambda c, i: F.get(c, i).cast("double")
    pairs = F.regexp_extract_all("comment", F.lit(r'([^\s=]+=(?:"[^"]*"|[^\s]+))'), 1)
    info = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1), F.regexp_replace(F.regexp_replace(p, "^[^=]*=", ""), '^"|"$', ""))))
    return rows.select(
        "path", "file_rank", "frame_ord", "n", "comment", info.alias("info"),
        F.transform(cells, lambda c: F.get(c, 0)).alias("species"),
        F.transform(cells, lambda c: F.array(number(c, 1), number(c, 2), number(c, 3))).alias("positions"),
        F.transform(cells, lambda c: F.when(F.size(c) >= 7, F.array(number(c, 4), number(c, 5), number(c, 6)))).alias("forces"),
    )


def in_file_order(frames: DataFrame) -> DataFrame:
    """Frames by suffix, path and place in the file."""
    return frames.orderBy("file_rank", "path", "frame_ord")


def first_frames(frames: DataFrame, n: int) -> DataFrame:
    return frames.where(F.col("frame_ord") < n)


def read_json_array(spark: SparkSession, path: str, record: str = RECORD) -> DataFrame:
    """source_index and the fields of each element of a JSON array file; positions are the array's."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", f"array<struct<{_typed(record)}>>")).alias("source_index", "r")).select(F.col("source_index").cast("long").alias("source_index"), "r.*")


def _typed(fields: str) -> str:
    """"a int, b string" as "a: int, b: string"."""
    return ", ".join(": ".join(f.strip().split(" ", 1)) for f in fields.split(", "))


def decode_structure(structure: Column) -> Column:
    """cell, species, positions of a structure's JSON dictionary; positions not given are those of the cell's fractions. Null, or no sites, raises."""
    read = F.from_json(structure, STRUCTURE)

    def placed(site: Column) -> Column:
        along = lambda i: F.aggregate(F.zip_with(site["abc"], read["lattice"]["matrix"], lambda f, v: f * F.get(v, i)), F.lit(0.0), lambda a, x: a + x)
        return F.coalesce(site["xyz"], F.array(along(0), along(1), along(2)))

    species = F.transform(read["sites"], lambda x: F.get(x["species"], 0)["element"])
    out = F.struct(read["lattice"]["matrix"].alias("cell"), species.alias("species"), F.transform(read["sites"], placed).alias("positions"))
    return F.when(F.coalesce(F.size(read["sites"]), F.lit(-1)) >= 0, out).otherwise(F.raise_error(F.lit("unsupported structure")).cast("struct<cell: array<array<double>>, species: array<string>, positions: array<array<double>>>"))


def records_to_frames(records: DataFrame) -> DataFrame:
    """source_index, n, cell, species, numbers, positions, energy (eV), forces (n x 3), stress (3x3, from kbar) and info of each record.

    info holds source_index and those of the optional fields that are there and not null. A record of another shape raises.
    """
    numbers = F.from_json(F.col("stress"), "array<double>")
    rows = records.withColumn("_s", decode_structure(F.col("structure"))).withColumn("n", F.size("_s.species"))
    has_voigt = F.col("stress").rlike(r"^\s*\[\s*[^\[\s]")
    stress = stress_from_kbar(F.when(has_voigt, numbers), F.when(~has_voigt, F.from_json(F.col("stress"), "array<array<double>>")))
    given = [F.struct(F.lit("source_index").alias("k"), F.col("source_index").cast("string").alias("v"))]
    given += [F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in OPTIONAL if c in records.columns]
    info = F.map_from_entries(F.filter(F.array(*given), lambda x: x["v"].isNotNull()))
    return rows.select("source_index", "n", "_s.cell", "_s.species", F.transform("_s.species", atomic_number).alias("numbers"), "_s.positions", F.col("energy").cast("double").alias("energy"), reshape_n3(F.flatten("forces"), F.col("n")).alias("forces"), stress.alias("stress"), info.alias("info"))


def read_indices(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """source_index, ascending, from a text file of one integer a line; the limit applies after sorting. None raises."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").cast("long").alias("source_index")).orderBy("source_index")
    rows = rows if limit is None else rows.limit(limit)
    if rows.isEmpty():
        raise ValueError("no indices were selected")
    return rows


def choose_source(indices: DataFrame, count: int | None, embedded_valid: bool, wanted: str = "auto") -> str:
    """dataset or index-file: auto takes embedded records only where an index lies beyond the dataset."""
    if wanted != "auto":
        return wanted
    beyond = count is not None and indices.agg(F.max("source_index")).first()[0] >= count
    return "index-file" if beyond and embedded_valid else "dataset"


def artifacts(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """path, parent, mtime, length of files under ``path``; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").endswith(suffix))
    return rows.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("parent"), F.col("modificationTime").alias("mtime"), "length")
