"""The registry of named queries, their SQL, and folders for queries that write and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def read_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """A new folder's path in the place that spark.checkpoint.dir names; with a local master, where it is unset, a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="corvine-")
        atexit.register(shutil.rmtree, made, True)
        place = f"file://{made}"
    return f"{place.rstrip('/')}/corvine-{uuid.uuid4().hex}"
