"""Substring dedup with repeated-phrase automata.

A window is ``window`` consecutive words of one document. Words covered by a window whose word sequence also starts
anywhere else (in another row, or elsewhere in the same one) are removed.

1. Each window has an anchor: the leftmost least-hashed phrase of ``phrase`` words inside it. Equal windows have equal
   anchors at equal places, so a repeated window always has an anchor that occurs twice. One row for about every 12 words,
   with the hash of the anchor's context (all its windows), is counted, after a partial count on the map side.
2. Recurring passages are confirmed: of the contexts of recurring anchors, one document each gives the windows. An anchor
   with one context has it twice; else the windows of its contexts are counted one by one.
3. Documents are dealt into buckets by key. A bucket gets the anchors' phrases and the confirmed windows of its own
   documents, once each however many documents hold them, and compiles them into one Aho-Corasick automaton: its shard.
4. All documents stream through the automaton of their bucket. It locates every occurrence of a confirmed passage's
   phrase; the windows around a hit are looked up among the confirmed ones, and what they cover is removed.

No step gathers a passage's occurrences: hot passages are pre-aggregated, or cost one row for each bucket. A bucket's
automaton holds less text than the bucket's documents.

Cases: a null text has no words; a text shorter than a window stays whole; rows alike in every column are copies of each
other; doc_id may be null or repeat (rows are told apart by id and text); white space is not kept, words are joined by one
space; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, keep, row_key, shuffles, table
from .wordhash import Words, columns, joined, leftmost_minima, lists, longs, pair_hash

WINDOW, PHRASE = 35, 12
#: Text of one bucket, in bytes.
BUCKET_BYTES = 32 << 20


def _anchors(w: Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the phrase from each word on; the anchor of the window from each word on, -1 where a text ends inside."""
    grams = w.grams(phrase)
    at = leftmost_minima(grams, window - phrase + 1)
    return grams, np.where(w.whole(window), at, -1) if len(at) else at


def _runs(w: Words, window: int, phrase: int):
    """Each anchor with its windows: hashes of phrases, the anchors' places, the first and the last window, the hash of the whole context.

    All windows of an anchor hold its phrase, so the first and the last one overlap and with their distance make up the context.
    """
    grams, at = _anchors(w, window, phrase)
    if not len(at):
        return None
    first = np.flatnonzero((at >= 0) & np.r_[True, at[1:] != at[:-1]])
    last = np.r_[np.flatnonzero((at[:-1] != at[1:]) & (at[:-1] >= 0)), [len(at) - 1] if at[-1] >= 0 else []].astype(np.int64)
    wins = w.grams(window)
    return grams, at[first], first, last, pair_hash(wins[first], wins[last], 0) + (last - first).astype(np.uint64)


def _contexts(window: int, phrase: int):
    """Anchor and context of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for i, _, data, offsets in columns(batch, "text"):
                w = Words(data, offsets)
                if (runs := _runs(w, window, phrase)) is not None:
                    grams, anchor, _, _, context = runs
                    yield pa.record_batch([longs(grams[anchor]), longs(context), pa.array(keys[i + w.text[anchor]])], names=["anchor", "ctx", "k"])

    return run


def _details(window: int, phrase: int):
    """Windows' hashes and phrases of the given contexts of each document, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1)
            for i, j, data, offsets in columns(batch, "text"):
                w = Words(data, offsets)
                if (runs := _runs(w, window, phrase)) is None:
                    continue
                grams, anchor, first, last, context = runs
                part = found.slice(i, j - i)
                asked, text = part.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(j - i), part.value_lengths().to_numpy())
                order = np.lexsort((text, asked))
                asked, text = asked[order], text[order]
                # a context asked of its own document: contexts alike in two documents of a slice are asked of one
                at = np.searchsorted(asked, context)
                near = np.minimum(at, max(0, len(asked) - 1))
                wanted = np.flatnonzero((asked[near] == context) & (text[near] == w.text[anchor])) if len(asked) else np.zeros(0, np.int64)
                wanted = wanted[np.unique(context[wanted], return_index=True)[1]]
                anchor, first, size = anchor[wanted], first[wanted], (last - first + 1)[wanted]
                copy, place = joined(w)
                flat = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
                phrases = [copy[place[a] : place[a + phrase] - 1].tobytes() for a in anchor.tolist()]
                yield pa.record_batch(
                    [longs(grams[anchor]), longs(context[wanted]), lists(w.grams(window)[flat] if len(flat) else np.zeros(0, np.uint64), size), pa.array(phrases, pa.binary()).cast(pa.string())],
                    names=["anchor", "ctx", "wins", "phrase"],
                )

    return run


def _locate(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        bucket, automaton, confirmed, gathered = None, None, np.zeros(0, np.uint64), []
        for batch in batches:
            buckets, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (buckets[1:] != buckets[:-1]) | (kinds[1:] != kinds[:-1])]) if len(buckets) else []
            for a, b in zip(cuts, [*cuts[1:], len(buckets)], strict=True):
                if buckets[a] != bucket:
                    bucket, automaton, confirmed, gathered = buckets[a], None, np.zeros(0, np.uint64), []
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    automaton = automaton or ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
                    for p in part.column(4).cast(pa.binary()).to_pylist():
                        automaton.add_word(f" {p.decode('latin-1')} ")
                    gathered.append(part.column(5).flatten().to_numpy().view(np.uint64))
                    continue
                if gathered:
                    automaton.make_automaton()
                    confirmed, gathered = np.unique(np.concatenate(gathered)), []
                yield from _removed(part, automaton, confirmed, window, phrase)

    return run


def _removed(batch: pa.RecordBatch, automaton, confirmed: np.ndarray, window: int, phrase: int) -> Iterator[pa.RecordBatch]:
    for i, j, data, offsets in columns(batch, "text"):
        w = Words(data, offsets)
        n, (copy, place) = len(w.hash), joined(w)
        gone = np.zeros(n + 1, np.int64)
        if automaton is not None and n >= window:
            # bytes as latin-1, so that places in the string are places in ``copy``; a hit ends at the space after its last word
            ends = np.fromiter((e for e, _ in automaton.iter(" " + copy.tobytes().decode("latin-1"))), np.int64)
            p = np.searchsorted(place, ends) - phrase
            near = np.zeros(n + 1, np.int64)
            np.add.at(near, np.maximum(p - (window - phrase), 0), 1)
            np.add.at(near, p + 1, -1)
            s = np.flatnonzero((np.cumsum(near)[: n - window + 1] > 0) & w.whole(window))
            hashes = w.grams(window)[s]
            s = s[confirmed[np.minimum(np.searchsorted(confirmed, hashes), len(confirmed) - 1)] == hashes]
            np.add.at(gone, s, 1)
            np.add.at(gone, s + window, -1)
        covered = np.cumsum(gone)[:n] > 0
        left = copy[np.repeat(~covered, place[1:] - place[:-1])]
        sizes = np.r_[0, np.cumsum(np.where(covered, 0, place[1:] - place[:-1]))][w.bounds]
        total = np.r_[0, np.cumsum(covered)][w.bounds]
        texts = [left[x : max(x, y - 1)].tobytes() for x, y in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)]
        yield pa.record_batch([batch.column(2).slice(i, j - i), longs(np.diff(w.bounds)), longs(np.diff(total)), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("k", row_key(F.col("doc_id"), F.col("text")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 2 * max(shuffles(spark), size // (2 * BUCKET_BYTES) + 1)
    bucket = F.pmod(F.col("k"), F.lit(buckets)).cast("int").alias("bucket")

    anchors = docs.select("k", "text").mapInArrow(_contexts(window, phrase), "anchor long, ctx long, k long")
    # written, so that both sides of joins by anchor are plain shuffles, whose hot partitions Spark splits
    recurring = keep(anchors.groupBy("anchor").count().where("count > 1").select("anchor"))
    contexts = keep(anchors.join(recurring, "anchor"))
    counted = keep(contexts.groupBy("anchor", "ctx").agg(F.count("*").alias("n"), F.min("k").alias("k")))
    asked = counted.groupBy("k").agg(F.collect_list("ctx").alias("ctx"))  # no more than the document's anchors
    details = docs.join(asked, "k").select("text", "ctx").mapInArrow(_details(window, phrase), "anchor long, ctx long, wins array<long>, phrase string")
    several = keep(counted.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1"))
    numbered = counted.select("anchor", "ctx", "n").join(several, "anchor", "left")
    distinct = keep(details.dropDuplicates(["anchor", "ctx"]).join(numbered, ["anchor", "ctx"]).withColumn("contexts", F.coalesce("contexts", F.lit(1))))
    # an anchor of one context has it twice, so all its windows recur
    each = distinct.where("contexts > 1").select("anchor", "ctx", "n", F.explode("wins").alias("win"))
    confirmed = each.groupBy("anchor", "win").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "win")
    some = each.join(confirmed, ["anchor", "win"]).groupBy("anchor", "ctx").agg(F.collect_set("win").alias("wins")).join(distinct.select("anchor", "ctx", "phrase"), ["anchor", "ctx"])
    passages = some.select("anchor", "ctx", "phrase", "wins").unionByName(distinct.where("contexts = 1").select("anchor", "ctx", "phrase", "wins"))
    shards = contexts.select(bucket, "anchor", "ctx").distinct().join(passages, ["anchor", "ctx"])

    kinds = "bucket int, kind int, doc_id long, text string, phrase string, wins array<long>"
    null = F.lit(None)
    rows = shards.select("bucket", F.lit(0).alias("kind"), null.cast("long").alias("doc_id"), null.cast("string").alias("text"), "phrase", "wins").unionByName(
        docs.select(bucket, F.lit(1).alias("kind"), "doc_id", "text", null.cast("string").alias("phrase"), null.cast("array<long>").alias("wins"))
    )
    assert [f.split()[0] for f in kinds.split(", ")] == rows.columns
    dealt = rows.repartition(buckets // 2, "bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(_locate(window, phrase), "doc_id long, n_words long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
hot AS (SELECT win FROM g GROUP BY win HAVING count(*) > 1),
c AS (SELECT DISTINCT r, q FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS q FROM g JOIN hot USING (win))),
k AS (SELECT r, string_agg(word, ' ' ORDER BY q) AS kept FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d) ANTI JOIN c USING (r, q) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r) LEFT JOIN n USING (r)
"""
