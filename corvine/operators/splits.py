"""Seeded splits and subsamples without replacement.

``exact`` draws all permutations from one NumPy generator on the driver, in a fixed order. ``hashed`` ranks rows by a digest of
seed and key: another membership of the same sizes, with no permutation on the driver. Ranks are found by bins of the
digest: counts of bins give offsets, and rows are ranked within their bin, so no task sorts the whole table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def train_size(n: int, fraction: float) -> int:
    """floor(fraction * n) as float64; raises where a side would be empty."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction must lie between 0 and 1")
    size = math.floor(fraction * n)
    if size < 1 or size >= n:
        raise ValueError(f"{n} rows can't be split by {fraction}")
    return size


def exact_splits(spark: SparkSession, n: int, fraction: float, seed: int) -> DataFrame:
    """split, ord, position for all, train, val, half, half_train, half_val of n rows. Draws: whole, half, split of the half."""
    rng = np.random.default_rng(seed)
    order, cut = rng.permutation(n), train_size(n, fraction)
    half = np.sort(rng.permutation(n)[: n // 2])
    inner, half_cut = rng.permutation(len(half)), train_size(len(half), fraction)
    parts = {"all": np.arange(n), "train": order[:cut], "val": order[cut:], "half": half, "half_train": half[inner[:half_cut]], "half_val": half[inner[half_cut:]]}
    rows = [(name, i, int(p)) for name, positions in parts.items() for i, p in enumerate(positions)]
    return spark.createDataFrame(rows, "split string, ord long, position long")


def digest(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hashed_rank(df: DataFrame, key: str, seed: str, name: str = "rank", total: str | None = None) -> DataFrame:
    """``df`` with each row's rank (from 1) by the digest of seed and key, then key; ``total`` names a column for the number of rows."""
    placed = df.withColumn("_d", digest(F.col(key), seed)).withColumn("_bin", F.substring("_d", 1, 3))  # 4096 bins
    upto = W.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    before = placed.groupBy("_bin").count().select("_bin", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_before"), F.sum("count").over(W.partitionBy()).alias("_total"))
    ranked = placed.join(F.broadcast(before), "_bin")  # at most 4096 rows
    ranked = ranked.withColumn(name, F.col("_before") + F.row_number().over(W.partitionBy("_bin").orderBy("_d", key)))
    return (ranked.withColumn(total, F.col("_total")) if total else ranked).drop("_d", "_bin", "_before", "_total")


def hashed_split(df: DataFrame, key: str, fraction: float, seed: str, rank: str = "rank") -> DataFrame:
    """``df`` with rank and split (train, val); raises, when it runs, where a side would be empty. The rows are counted in the same plan."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction must lie between 0 and 1")
    size = F.floor(F.lit(float(fraction)) * F.col("_n"))
    checked = F.when((size < 1) | (size >= F.col("_n")), F.raise_error(F.lit(f"too few rows to split by {fraction}")).cast("long")).otherwise(size)
    return hashed_rank(df, key, seed, rank, "_n").withColumn("split", F.when(F.col(rank) <= checked, "train").otherwise("val")).drop("_n")


def hashed_half(df: DataFrame, key: str, seed: str) -> DataFrame:
    """Half of the rows, rounded down."""
    return hashed_rank(df, key, seed, "_rank", "_n").where(F.col("_rank") <= F.floor(F.col("_n") / 2)).drop("_rank", "_n")
