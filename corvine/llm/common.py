"""What the operators of this package share: scratch tables, size-checked broadcasts, row keys."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Scratch folder of each application and shared place, and the tables made in them.
_folders: dict[tuple[str, str], str] = {}
_made: list[str] = []


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where unset and all runs in one process (tests), a temporary one of our own."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="corvine-")
        atexit.register(shutil.rmtree, place, True)
        spark.sparkContext.setCheckpointDir(f"file://{place}")
        place = spark.sparkContext.getCheckpointDir()
    return place.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the application's scratch folder, which goes when the driver ends."""
    key = spark.sparkContext.applicationId, scratch(spark)
    if key not in _folders:
        _folders[key] = f"{key[1]}/corvine-{uuid.uuid4().hex}"
        files, where = _file_system(spark, _folders[key])
        files.mkdirs(where)
        files.deleteOnExit(where)
    _made.append(f"{_folders[key]}/{uuid.uuid4().hex}")
    return _made[-1]


def drop_scratch(spark: SparkSession, since: int) -> None:
    """Deletes the scratch tables made since ``scratch_mark``; what still reads them fails."""
    for path in _made[since:]:
        files, where = _file_system(spark, path)
        files.delete(where, True)
    del _made[since:]


def scratch_mark() -> int:
    return len(_made)


def keep(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back: lineage is cut, and lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(kept: DataFrame, most_rows: int) -> DataFrame:
    """A broadcast hint behind a count of a written table; beyond ``most_rows`` the join shuffles. ``kept`` holds a few fixed-width columns, so rows bound bytes."""
    return F.broadcast(kept) if kept.count() <= most_rows else kept


def words(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def row_key(id_: Column, text: Column) -> Column:
    """Tells rows apart even where ids are null or repeat; rows alike in id and text have one key, and equal results."""
    return F.xxhash64(id_, text)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, though ``body`` uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
