"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

Each rule rejects a document whose measure exceeds the rule's cutoff. Cutoffs are chosen for each stratum (language) from
labelled documents, such that few good ones are rejected:

- For each stratum and rule, fixed cutoffs are tested from the loosest to the strictest. The null hypothesis of a cutoff is
  that it rejects more than ``risk / rules`` of the stratum's good documents; its exact p value is the binomial
  P(X <= k) with k of n labelled good documents rejected.
- Testing stops at the first cutoff that isn't significant (fixed-sequence testing needs no correction within a sequence);
  the level of each sequence is ``delta / (rules * strata)`` (Bonferroni over sequences).

So with probability 1 - delta, in every stratum all rules together reject at most ``risk`` of the good documents that pass
the base; what the base rejects is fixed by its own rules and under no such bound. A stratum with few labels gets no cutoff and rejects by the base rules alone. The cutoffs are fixed beforehand, so all labelled rows
serve as the holdout.

Cases: null or empty texts have zero counts and fail the base; labels of unknown documents, and null ones, are ignored; of
several labels of a document the best counts; a null language is a stratum of its own; doc_id may be null or repeat; extra
columns are ignored; empty tables give no cutoffs, an empty documents table an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import GAP, WORD, broadcast_if_small, keep, let, row_key, table, words

RISK, DELTA = 0.05, 0.05
#: rule: (measure, cutoffs from the loosest to the strictest)
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.9, 0.7, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.05]),
    "long_words": ("word_chars / greatest(n_words, 1)", [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0]),
}
SMALL_ROWS = 100_000
REPEAT, SYMBOLS = 8, "#*$%&|<>"


def repeated_words(w: Column, n: int = REPEAT) -> Column:
    """How many words stand in windows of n words that occur twice or more in ``w``."""

    def covered(h: Column) -> Column:
        def repeats(s: Column) -> Column:
            near = lambda j: F.get(s, j)["h"]
            return F.filter(s, lambda x, j: F.coalesce(near(j - 1) == x["h"], F.lit(False)) | F.coalesce(near(j + 1) == x["h"], F.lit(False)))

        marked = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeats)
        places = F.sort_array(F.transform(marked, lambda x: x["i"]))
        merged = F.aggregate(places, F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")), lambda a, i: F.struct((i + n).alias("to"), (a["n"] + n - F.greatest(F.lit(0), a["to"] - i)).alias("n")), lambda a: a["n"])
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(merged)

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
    return F.when(F.size(w) >= n, let(hashes, covered)).otherwise(0).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, k (key of the row), stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each row of ``docs`` (doc_id, text, lang)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("k"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("lang").isNull().alias("no_lang"), text.alias("text"), words(text).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    return rows.select(
        "doc_id",
        "k",
        F.when(F.col("no_lang"), "null").otherwise(F.concat(F.lit("="), "lang")).alias("stratum"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    ).select("doc_id", "k", "stratum", "n_words", "word_chars", "n_symbols", "lines.n_lines", "lines.n_dup_lines", "n_repeat_words")


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff: the strictest cutoffs that keep the risk."""
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).where("quality >= 1").select("doc_id")
    holdout = measured.join(good, "doc_id").where("not (n_words < 20 or 100 * n_repeat_words > 30 * n_words)")
    # how many cutoffs of each rule reject a document: they are ordered, so it is the first so many loosest to fail last
    counts = F.array(*(F.struct(F.lit(rule).alias("rule"), sum((F.expr(f"cast({of} > {c} as int)") for c in grid), F.lit(0)).alias("rejecting"), F.lit(len(grid)).alias("size")) for rule, (of, grid) in RULES.items()))
    seen = holdout.select("stratum", F.explode(counts).alias("x")).groupBy("stratum", "x.rule", "x.size", "x.rejecting").count()
    total = seen.groupBy("stratum", "rule", "size").agg(F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("rejecting", "count"))).alias("of"))  # at most one entry for each cutoff
    # cutoff number i (from 0, loosest first) rejects what is rejected by size - i cutoffs or more
    tests = total.select("stratum", "rule", "n", F.posexplode(F.expr("transform(sequence(0, size - 1), i -> aggregate(map_values(map_filter(of, (r, c) -> r >= size - i)), 0L, (a, c) -> a + c))")).alias("i", "k"))
    strata = measured.select("stratum").distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("strata"))
    a = risk / len(RULES)
    term = f"t.s + ln((n - j + 1) / j) + ln({a} / (1 - {a}))"
    tail = f"aggregate(sequence(1, k), named_struct('s', n * ln(1 - {a}), 'p', exp(n * ln(1 - {a}))), (t, j) -> named_struct('s', {term}, 'p', t.p + exp({term})), t -> t.p)"
    p = f"case when k > n * {a} then 1.0D when k = 0 then exp(n * ln(1 - {a})) else {tail} end"
    tests = tests.crossJoin(F.broadcast(strata)).withColumn("passes", F.expr(f"{p} <= {delta} / ({len(RULES)} * strata)"))
    passed = tests.withColumn("all", F.min("passes").over(Window.partitionBy("stratum", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).where("all")
    values = F.element_at(F.create_map(*(x for rule, (_, grid) in RULES.items() for x in (F.lit(rule), F.array(*map(F.lit, grid))))), F.col("rule"))
    return passed.groupBy("stratum", "rule").agg(F.max("i").alias("i")).select("stratum", "rule", F.element_at(values, F.col("i") + 1).alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The measures of each row of ``docs`` (doc_id, text, lang) with base_failed, kept and failed_rules."""
    measured = keep(measures(docs))
    chosen = cutoffs(measured, labels, risk, delta).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))  # at most one entry for each rule
    chosen = keep(chosen)
    of = lambda rule: F.element_at("cutoffs", F.lit(rule))
    failed = F.filter(F.array(*(F.when(F.expr(RULES[rule][0]) > of(rule), rule) for rule in RULES)), lambda x: x.isNotNull())
    rows = measured.join(broadcast_if_small(chosen, SMALL_ROWS), "stratum", "left").withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")).withColumn("failed_rules", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("cutoffs")


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(COLUMNS)


def _grid_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule, {i} AS i, CAST({c} AS DOUBLE) AS cutoff" for rule, (_, grid) in RULES.items() for i, c in enumerate(grid))


def _values_sql(frm: str) -> str:
    return " UNION ALL ".join(f"SELECT r, doc_id, stratum, '{rule}' AS rule, CAST({of} AS DOUBLE) AS v FROM {frm}" for rule, (of, _) in RULES.items())


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IS NULL THEN 'null' ELSE '=' || lang END AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY r),
g AS (SELECT r, i, array_to_string(w[i : i + {REPEAT - 1}], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - {REPEAT - 2})) AS i FROM d WHERE len(w) >= {REPEAT})),
rw AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(i, i + {REPEAT})) AS q FROM g WHERE (r, win) IN (SELECT (r, win) FROM g GROUP BY r, win HAVING count(*) > 1)) GROUP BY r),
m AS (SELECT d.r, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{GAP}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN l ON l.r = d.r LEFT JOIN rw ON rw.r = d.r),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
grid AS ({_grid_sql()}),
v AS ({_values_sql("b")}),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) >= 1),
h AS (SELECT v.* FROM v JOIN good USING (doc_id) JOIN b ON b.r = v.r WHERE NOT base_failed),
t AS (SELECT stratum, rule, i, cutoff, count(*) AS n, count(*) FILTER (v > cutoff) AS k FROM h JOIN grid USING (rule) GROUP BY ALL),
p AS (SELECT *, CASE WHEN k > n * {RISK / len(RULES)} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - CASE WHEN j > 0 THEN lgamma(j + 1) ELSE 0 END - CASE WHEN n > j THEN lgamma(n - j + 1) ELSE 0 END + j * ln({RISK / len(RULES)}) + (n - j) * ln(1 - {RISK / len(RULES)})))) END AS p FROM t),
s AS (SELECT *, min(CASE WHEN p <= {DELTA} / ({len(RULES)} * (SELECT greatest(count(DISTINCT stratum), 1) FROM b)) THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, rule ORDER BY i) AS ok FROM p),
c AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM s WHERE ok = 1 GROUP BY stratum, rule),
f AS (SELECT DISTINCT r FROM v JOIN c USING (stratum, rule) WHERE v > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM f) AS kept FROM b
"""
