"""Error metrics, target statistics and losses as aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tensors import norm


def mae(p: Column, t: Column) -> Column:
    return F.avg(F.abs(p - t))


def per_atom_mae(p: Column, t: Column, atoms: Column) -> Column:
    return F.avg(F.abs(p - t) / atoms)


def mse(p: Column, t: Column) -> Column:
    return F.avg((p - t) * (p - t))


def normalized(x: Column, rmsd: Column, mean: float = 0.0) -> Column:
    return (x - mean) / rmsd


def rmsd(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def l2_norm_loss(p: Column, t: Column) -> Column:
    """The mean length of the difference of two vectors."""
    return F.avg(norm(F.zip_with(p, t, lambda a, b: a.cast("double") - b.cast("double"))))


def weighted_loss(energy: Column, forces: Column, stress: Column, weights: tuple[float, float, float] = (20, 2, 1)) -> Column:
    e, f, s = weights
    return e * energy + f * forces + s * stress


def weighted_vector_sum(latents: DataFrame, frame: str, z: str, h: str) -> DataFrame:
    """frame, dim, value: the sum over atoms of z times the latent vector, unnormalized; long, so that it sums before the shuffle."""
    long = latents.select(frame, z, F.posexplode(h).alias("dim", "_v"))
    return long.groupBy(frame, "dim").agg(F.sum(F.col(z) * F.col("_v").cast("double")).alias("value"))


def descriptors(latents: DataFrame, frame: str, z: str, h: str) -> DataFrame:
    """frame, descriptor (array)."""
    rows = weighted_vector_sum(latents, frame, z, h).groupBy(frame).agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("_r"))
    return rows.select(frame, F.transform("_r", lambda x: x["value"]).alias("descriptor"))


def carried_forward(value: str, by: list[str], order: list[str]) -> Column:
    """The last value that isn't null, up to the row."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def all_valid(condition: Column) -> Column:
    return F.coalesce(F.bool_and(condition), F.lit(False))


def have_all(required: list[str], columns: dict[str, Column]) -> Column:
    """Whether each required column is non-null in some row."""
    out = F.lit(True)
    for name in required:
        out = out & F.coalesce(F.bool_or(columns[name].isNotNull()), F.lit(False))
    return out
