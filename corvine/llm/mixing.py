"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Sources share all words by weight: 1, 2, 3, repeating, by code point order of their names, null last. No target exceeds
``LIMIT`` times its source's size; the excess is shared by the weights of the others until none does. Sorted by limit over
weight, the sources at their limit come first, so two running sums over one row for each source give the level in closed form.

A source with target T and size S takes floor(T / S) whole copies of each document, and once more a sample with inclusion
probability p = T / S - floor(T / S). Documents are ranked by their random odds u / (1 - u) divided by their inclusion
odds p / (1 - p) (times a column of relative odds, if asked; without one, as in ``query`` and ``mixed``, inclusion is equal
within a source and the ranks are those of a simple random order), with u from a digest of seed, doc_id and text: reruns agree.
The sample's size is fixed in words: it is the longest prefix in rank order that stays within what the target lacks, and the one
document that brings the source nearest to its target, if one brings it nearer.

Ranks are found without sorting a source: words are summed by source and bin of rank, running sums over at most ``BINS`` bins give
the bin where the target is reached, and only that bin is ranked row by row. Weights and levels are found in one task, over a
row for each source: for up to some ten millions of sources. Decisions are thresholds by source, applied to
rows where they are; a table of one row for each source is broadcast if small.

Cases: null and empty texts have size 0 and are never taken; a source of size 0 has target 0; rows alike in doc_id and text
are taken alike; doc_id may be null or repeat; extra columns stay as they are in ``mixed``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, keep, table, words

WEIGHTS, LIMIT, BINS, SEED = [1, 2, 3], 3, 4096, "mix"
SMALL_SOURCES = 100_000


def _key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))


def _source() -> Column:
    return F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))


def measured(docs: DataFrame, seed: str = SEED, odds: str | None = None) -> DataFrame:
    """doc_id, key, src, size, odds of each row of ``docs`` (doc_id, text, source)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(seed).alias("key"), _source().alias("src"), F.size(words(F.col("text").cast("string"))).cast("long").alias("size"), (F.col(odds).cast("double") if odds else F.lit(1.0)).alias("odds"))


def targets(sizes: DataFrame) -> DataFrame:
    """src, source_size, target of each source in ``sizes`` (src, size)."""
    by = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    ranked = by.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(W.orderBy(F.expr("src = 'null'"), "src")) - 1, len(WEIGHTS)) + 1).cast("int")))
    order = W.orderBy(F.col("source_size") * LIMIT / F.col("w"), "src")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).withColumn("total", F.sum("source_size").over(W.partitionBy()))
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.withColumn("level", (F.col("total") - before("source_size") * LIMIT) / (F.sum("w").over(W.partitionBy()) - before("w")))
    open_ = F.when(F.col("source_size") * LIMIT / F.col("w") >= F.col("level"), F.struct("rank", "level"))
    ranked = ranked.withColumn("level", F.min(open_).over(W.partitionBy())["level"])
    limit = (F.col("source_size") * LIMIT).cast("double")
    return ranked.select("src", "source_size", F.least(limit, F.coalesce(F.col("level") * F.col("w"), limit)).alias("target"))


def _place() -> Column:
    """The rank q as q / (1 + q), between 0 and 1; needs key, p and odds."""
    u = (F.conv(F.substring("key", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    q = (u / (1 - u)) * ((1 - F.col("p")) / F.col("p")) / F.col("odds")
    return F.when((F.col("p") > 0) & (F.col("size") > 0) & (F.col("odds") > 0), q / (1 + q))


def decisions(rows: DataFrame) -> DataFrame:
    """src, source_size, target, base, p, last (place, key) and extra (key): what decides the copies of each row of ``measured``."""
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = targets(rows).withColumn("base", F.floor(share)).withColumn("p", share - F.floor(share)).withColumn("lacks", F.col("target") - F.col("base") * F.col("source_size"))
    sources = keep(sources)
    few = broadcast_if_small(sources, SMALL_SOURCES)
    placed = rows.join(few, "src").withColumn("place", _place()).where("place is not null").select("src", "key", "size", "place", "lacks", F.floor(F.col("place") * BINS).cast("int").alias("bin"))
    upto = W.partitionBy("src").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    sums = placed.groupBy("src", "bin", "lacks").agg(F.sum("size").alias("words")).withColumn("sum", F.sum("words").over(upto))
    bound = sums.groupBy("src").agg(F.min(F.when(F.col("sum") > F.col("lacks"), F.col("bin"))).alias("bound"), F.coalesce(F.max(F.when(F.col("sum") <= F.col("lacks"), F.col("sum"))), F.lit(0)).alias("below"))
    bound = keep(bound)
    ends = broadcast_if_small(bound, SMALL_SOURCES)
    at = placed.join(ends, "src").where("bin = bound").groupBy("src", "place", "key", "lacks", "below").agg(F.sum("size").alias("words"))
    at = at.withColumn("sum", F.col("below") + F.sum("words").over(W.partitionBy("src").orderBy("place", "key").rowsBetween(W.unboundedPreceding, 0))).where("sum <= lacks")
    last = at.groupBy("src").agg(F.max(F.struct("place", "key")).alias("last"), F.max("sum").alias("reached"))
    # without a bound all are taken; with one but nothing taken from its bin, whole bins are
    none = F.when(F.col("bound").isNull(), F.struct(F.lit(2.0).alias("place"), F.lit("").alias("key"))).otherwise(F.struct((F.col("bound") / BINS).alias("place"), F.lit("").alias("key")))
    cut = keep(bound.join(last, "src", "left").select("src", F.coalesce("last", none).alias("last"), F.coalesce("reached", "below").alias("reached")))
    cuts = broadcast_if_small(cut, SMALL_SOURCES)
    rest = placed.join(cuts, "src").where(F.struct("place", "key") > F.col("last")).withColumn("gap", F.col("lacks") - F.col("reached"))
    nearest = rest.groupBy("src", "gap").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "place", "key")).alias("n")).select("src", F.col("n.key").alias("key"), "gap").where("n.off < gap")
    nearest = broadcast_if_small(keep(nearest), SMALL_SOURCES)
    extra = rest.drop("gap").join(nearest, ["src", "key"]).groupBy("src", "key", "gap").agg(F.sum("size").alias("words")).where("abs(words - gap) < gap").select("src", F.col("key").alias("extra"))
    return keep(sources.join(cut, "src", "left").join(extra, "src", "left").select("src", "source_size", "target", "base", "p", "last", "extra"))


def copies(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """``rows`` (src, key, size, odds) with source_size, target and copies."""
    joined = rows.join(broadcast_if_small(decided, SMALL_SOURCES), "src").withColumn("place", _place())
    once = F.coalesce((F.col("place").isNotNull() & (F.struct("place", "key") <= F.col("last"))) | (F.col("key") == F.col("extra")), F.lit(False))
    return joined.withColumn("copies", F.when(F.col("size") > 0, F.col("base") + once.cast("int")).otherwise(0).cast("long")).drop("base", "p", "last", "extra", "place")


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    decided = decisions(keep(measured(docs, seed)))
    rows = docs.withColumn("_row", F.struct(*docs.columns)).select("_row", _source().alias("src"), _key(seed).alias("key"), F.size(words(F.col("text").cast("string"))).cast("long").alias("size"), F.lit(1.0).alias("odds"))
    return copies(rows, decided).where("copies > 0").select("_row", F.explode(F.expr("sequence(1, copies)"))).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keep(measured(table(spark, sf_dir, "documents")))
    return copies(rows, decisions(rows)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


SQL = rf"""
WITH m AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS src, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS key,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM m GROUP BY src),
w AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY src = 'null', src) - 1) % 3 + 1] AS w FROM s),
l AS (SELECT *, row_number() OVER o AS rank, (sum(source_size) OVER () - coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {LIMIT}) / CAST(sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM w WINDOW o AS (ORDER BY source_size * {LIMIT} / CAST(w AS DOUBLE), src)),
f AS (SELECT arg_min(level, rank) AS level FROM l WHERE source_size * {LIMIT} / CAST(w AS DOUBLE) >= level),
t AS (SELECT src, source_size, least(CAST(source_size * {LIMIT} AS DOUBLE), coalesce(f.level * w, CAST(source_size * {LIMIT} AS DOUBLE))) AS target FROM l, f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS share FROM t),
q AS (SELECT *, floor(share) AS base, share - floor(share) AS p, target - floor(share) * source_size AS lacks FROM r),
u AS (SELECT m.*, q.* EXCLUDE (src), (CAST(CAST('0x' || substr(key, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM m JOIN q USING (src)),
v AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS odds FROM u),
g AS (SELECT src, key, odds / (1 + odds) AS place, lacks, sum(size) AS words FROM v WHERE odds IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(words) OVER (PARTITION BY src ORDER BY place, key) AS upto FROM g),
reached AS (SELECT src, lacks, coalesce(max(upto) FILTER (upto <= lacks), 0) AS reached FROM c GROUP BY src, lacks),
n AS (SELECT c.src, arg_min(c.key, (abs(c.words - (c.lacks - reached)), place, c.key)) AS key, min(abs(c.words - (c.lacks - reached))) AS off, any_value(c.lacks - reached) AS gap FROM c JOIN reached USING (src) WHERE upto > c.lacks GROUP BY c.src)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM (
  SELECT v.*, CASE WHEN v.size = 0 THEN 0 ELSE base + CASE WHEN c.upto <= v.lacks OR (n.key = v.key AND n.off < n.gap) THEN 1 ELSE 0 END END AS copies
  FROM v LEFT JOIN c ON c.src = v.src AND c.key = v.key LEFT JOIN n ON n.src = v.src)
"""
