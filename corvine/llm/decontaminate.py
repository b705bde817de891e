"""Benchmark decontamination by winnowing, with DataFrame functions only.

A benchmark window is ``span`` consecutive words of an item, or a whole item of fewer words. A document word inside any
occurrence of a window is hit.

1. Fingerprints. Of every ``span`` consecutive words, the least hash of the k-grams inside is kept. Equal runs of
   ``span`` words have equal fingerprints, so every shared one is found; overlapping runs mostly share theirs. Shorter items
   are their own fingerprint, looked for among the document's runs of that length.
2. Documents and windows are joined on fingerprints. Window tables are broadcast behind a check of their rows, else shuffled.
3. Hits are extended from their places: in the matched documents only runs of ``span`` (or a short item's) words whose
   fingerprint is one of the benchmark's are cut out and compared with the windows, word for word; covered words are merged.

Items alike in words are one class until the end, and a document's windows are made distinct before items join, so neither
a hot window nor copies of an item multiply rows.

Cases: null texts have no words; items without words are ignored; a null item_id reads as ''; rows alike in item_id count
once; doc_id may be null or repeat; extra columns are ignored; an empty benchmark hits nothing; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, keep, let, lower_ascii, row_key, table

SPAN, K = 10, 5
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows (about 100 bytes each) and candidate documents (8 bytes) that may be broadcast; beyond, the joins shuffle.
SMALL_WINDOWS, SMALL_DOCS = 100_000, 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def runs(w: Column, n: int) -> Column:
    """The hash of the n words from each word on."""
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))).otherwise(F.array().cast("array<long>"))


def winnowed(w: Column, span: int, k: int) -> Column:
    """The fingerprint of the span words from each word on: the least hash of their k-grams."""
    width = span - k + 1

    def least(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.array_min(F.slice(h, i, width)))

    return F.when(F.size(w) >= span, let(runs(w, k), least)).otherwise(F.array().cast("array<long>"))


def fingerprints(w: Column, span: int, k: int, short: list[int]) -> Column:
    return F.array_distinct(F.concat(winnowed(w, span, k), *(runs(w, n) for n in short)))


def placed(w: Column, span: int, k: int, short: list[int]) -> Column:
    """Fingerprint f, place and length of each run of words that a window may equal."""
    at = lambda prints, n: F.transform(prints, lambda f, i: F.struct(f.alias("f"), i.alias("at"), F.lit(n).alias("n")))
    return F.concat(at(winnowed(w, span, k), span), *(at(runs(w, n), n) for n in short))


def hits(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """doc_id, k (key of the row), n_words, n_hit, items (sorted strings) of each row of ``docs`` (doc_id, text) against ``benchmark`` (item_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("k", row_key(F.col("doc_id"), F.col("text")))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0").distinct()
    items = keep(items.withColumn("class", F.sha2(F.concat_ws(" ", "w"), 256)))
    windows = items.dropDuplicates(["class"]).select("class", F.explode(F.when(F.size("w") < span, F.array("w")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (span - 1))), lambda i: F.slice("w", i, span)))).alias("win"))
    of_class = keep(windows.distinct())
    windows = keep(of_class.select("win", F.xxhash64("win").alias("id")).distinct())
    short = sorted(r[0] for r in windows.select(F.size("win")).where(F.size("win") < span).distinct().collect())  # under ``span`` values

    prints = keep(windows.select(F.explode(fingerprints(F.col("win"), span, k, [])).alias("f")).unionByName(windows.where(F.size("win") < span).select(F.col("id").alias("f"))).distinct())
    seen = docs.select("k", words(F.col("text")).alias("w")).select("k", F.explode(fingerprints(F.col("w"), span, k, short)).alias("f"))
    matched = keep(seen.join(broadcast_if_small(prints, SMALL_WINDOWS), "f", "left_semi").select("k").distinct())

    closer = keep(docs.join(broadcast_if_small(matched, SMALL_DOCS), "k", "left_semi").select("k", words(F.col("text")).alias("w")).dropDuplicates(["k"]))
    places = closer.select("k", F.explode(placed(F.col("w"), span, k, short)).alias("p")).select("k", "p.f", "p.at", "p.n")
    places = places.join(broadcast_if_small(prints, SMALL_WINDOWS), "f", "left_semi").groupBy("k").agg(F.collect_list(F.struct("at", "n")).alias("places"))  # no more than the document's words
    cut = closer.join(places, "k").select("k", F.explode(F.transform("places", lambda p: F.struct(p["at"].alias("at"), F.slice("w", p["at"] + 1, p["n"]).alias("win")))).alias("r"))
    found = cut.select("k", "r.at", "r.win", F.xxhash64("r.win").alias("id"))
    found = keep(found.join(broadcast_if_small(windows.withColumnRenamed("win", "theirs"), SMALL_WINDOWS), "id").where("win = theirs").select("k", "at", F.size("win").alias("n"), "id").distinct())

    covered = found.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("at", (F.col("at") + F.col("n")).alias("end")))).alias("r"))
    covered = covered.select("k", F.expr("aggregate(r, named_struct('to', 0, 'n', 0L), (a, x) -> named_struct('to', greatest(a.to, x.end), 'n', a.n + greatest(0, x.end - greatest(a.to, x.at))), a -> a.n)").alias("n_hit"))
    by_class = found.select("k", "id").distinct().join(broadcast_if_small(of_class.select("class", F.xxhash64("win").alias("id")), SMALL_WINDOWS), "id").select("k", "class").distinct()
    named = by_class.join(items.select("class", "item_id"), "class").groupBy("k").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    result = docs.select("doc_id", "k", F.size(words(F.col("text"))).cast("long").alias("n_words")).join(covered.join(named, "k"), "k", "left")
    return result.select("doc_id", "k", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, win)),
p AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS q FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""
