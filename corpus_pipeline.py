"""A corpus pipeline in five stages, each written as Parquet and read by the next.

Cases, in every stage: an empty table gives an empty one; extra columns, whatever their names, stay as they are up to the
token files; rows alike in doc_id and text share their fate, except that near duplicates keep one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm import decontaminate, mixing, ngram_jaccard, quality_rules, token_files
from corvine.llm.common import broadcast_if_small, drop_scratch, keep, row_key, scratch_mark, scratch_path, table

#: Keys of documents to drop (8 bytes) that may be broadcast; beyond, the join shuffles.
SMALL_ROWS = 1_000_000


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the (doc_id, text) key of each row, and the column's name, which no column of theirs has."""
    name = "k"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.withColumn(name, row_key(F.col("doc_id"), F.col("text"))), name


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, text) keys are in ``keys`` (k)."""
    keyed, k = _keyed(docs)
    gone = broadcast_if_small(keep(keys.distinct()), SMALL_ROWS).withColumnRenamed("k", k)
    return keyed.join(gone, k, "left_anti").select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or the risk-controlled rules reject go; so do null and empty texts, which fail the base."""
    judged = quality_rules.judge(docs, table(spark, sf_dir, "labels"))
    return _without(docs, judged.where("not kept").select("k"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents one row stays: the least doc_id, nulls last, then key; rows without words all stay."""
    found = ngram_jaccard.near_duplicates(docs).where("first_k is not null")
    found = keep(found.select("k", (F.col("k") == F.col("first_k")).alias("stays")))
    left = _without(docs, found.where("not stays").select("k"))
    # rows alike in doc_id and text have one key
    repeated = keep(found.where("stays").groupBy("k").count().where("count > 1").select("k"))
    if repeated.isEmpty():
        return left
    keyed, k = _keyed(left)
    copies = keyed.join(broadcast_if_small(repeated, SMALL_ROWS).withColumnRenamed("k", k), k, "left_semi")
    one = copies.groupBy(k).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return _without(left, repeated).unionByName(one)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark window go; null and empty texts have none and stay."""
    found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("n_hit > 0").select("k"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; null and empty texts are never taken, a null source is one."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and their index: a row for each document as read back; a null text is the end id alone."""
    return token_files.encoded(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]
#: SQL expresses neither the components nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole table of documents; what each stage kept for itself is deleted once it is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch_path(spark)
        mark = scratch_mark()
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_scratch(spark, mark)
        docs = spark.read.parquet(path)
    return docs
