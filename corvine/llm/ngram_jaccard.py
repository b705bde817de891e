"""N-gram Jaccard join by set relations: exact links between the shingle sets of documents, and their components.

A document's set holds its distinct shingles of ``n`` words (all its words as one shingle if it has fewer; no words, no
set). Sets link when 100 * |A & B| >= percent * |A | B|. Documents with equal sets form a class, known by two 64-bit
fingerprints of the set; only classes are compared, where one fingerprint names a set.

1. Order. All shingles are counted, in blocks that pass on those met twice or more; the ``HEAVY`` most frequent ones, a
   table of fixed size, are broadcast. Any order gives right results; frequent shingles last gives short index lists.
2. Index lists. Linked sets share a shingle among the first n - ceil(percent * n / 100) + 1 of each in that order.
   Shingles that only one class holds there are dropped after a min/max of fingerprints, partly computed before the shuffle.
3. Pivots. The set of each list with the fewest shingles before the shared one is its pivot: the least edited of a group
   of copies, so that the others' answers follow from it. A set is compared with the pivot it shares most lists with, and in
   lists that these links don't connect with the other pivots that may link; the size of the intersection is kept.
   Links found so far are contracted to components.
4. Skipping. What is left are pairs of one list in different components. Their answers are first derived from the pivot's:
   |A & B| <= |A & P| + |B - P|, both known or bounded (sets that were not compared with P share one shingle at least). A
   list is cut into blocks by set size; pairs of blocks are skipped by the sizes, the positions (of them, what precedes in
   kept lists: dropped shingles match nothing) and the derived bounds of their ends, then single pairs likewise, and by 64
   bits that stand for a set's lists. Of pairs that remain, those that share too few lists for a link are left out, the
   others are compared: first each set with the few next ones in an order that all lists share, then, with the components
   that these links make, all that still lie in different ones.
5. Components of all links, joined back to the classes and their documents.

A list with very many sets is dealt as pairs of salted parts, and the lists of a pivot with very many rows go to different
tasks, so no task gathers either; sets that the derived bound excludes from any link outside their component are left out
before that. Copies cost one row each.

Cases: null, empty and white-space texts have an empty set, n_shingles 0, and are their own component; rows alike in
doc_id and text are one node; a null doc_id stays null and is never the least of a component unless alone; repeated
doc_ids with different texts are separate members with the same number; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD, broadcast_if_small, keep, row_key, table
from .components import components
from .wordhash import Words, columns, longs, mix, pair_hash

N, PERCENT = 5, 80
#: Most rows of the broadcast table of frequent shingles (16 bytes each), and the least count that enters it.
HEAVY, HEAVY_COUNT = 1 << 20, 8
#: Rows of 8 bytes that may be broadcast; beyond, the join shuffles.
SMALL_ROWS = 1_000_000
#: Sets of one list in one task; a longer list is dealt as pairs of parts.
PART, BLOCK = 4096, 128
#: Rows of one pivot's lists in one task, about.
SLOT = 512
#: Next sets in a fixed order that each set is compared with before all that may still link it to another component.
NEAREST = 16
#: Pairs that a task holds to sum them, and that it looks at together.
HELD_PAIRS, AT_ONCE = 1 << 20, 1 << 18
#: Fingerprints that a task remembers, so as not to give the sets of copies again.
SEEN = 1 << 20


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle), sorted, without repeats."""
    grams, whole = w.grams(n), w.whole(n)
    texts, tokens = w.text[: len(grams)][whole], grams[whole]
    few = np.flatnonzero((np.diff(w.bounds) > 0) & (np.diff(w.bounds) < n))
    if len(few):
        whole_text, size = w.hash[w.bounds[few]], np.diff(w.bounds)[few]
        for k in range(1, n - 1):
            more = np.flatnonzero(size > k)
            whole_text[more] = pair_hash(whole_text[more], w.hash[w.bounds[few[more]] + k], -1)
        texts = np.concatenate([texts, few])
        tokens = np.concatenate([tokens, mix(whole_text + size.astype(np.uint64))])
        order = np.argsort(texts, kind="stable")
        texts, tokens = texts[order], tokens[order]
    start = 0
    for end in (np.flatnonzero(texts[1:] != texts[:-1]) + 1).tolist() + [len(texts)]:
        tokens[start:end].sort()  # each text's by itself: far faster than all together by two keys
        start = end
    new = np.r_[True, (tokens[1:] != tokens[:-1]) | (texts[1:] != texts[:-1])] if len(tokens) else np.zeros(0, bool)
    return texts[new], tokens[new]


def _fingerprints(texts: np.ndarray, tokens: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two fingerprints of each text's set; 0 for an empty one."""
    size = np.bincount(texts, minlength=docs)
    some = np.flatnonzero(size)
    starts = (np.cumsum(size) - size)[some]
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sig = np.zeros(docs, np.uint64)
        if len(some):
            sig[some] = mix(np.add.reduceat(mix(tokens ^ np.uint64(salt)), starts) + size[some].astype(np.uint64))
        out.append(sig)
    return size, *out


def _count_shingles(n: int, block: int = 1 << 22):
    def met_twice(parts: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate(parts)
        parts.clear()  # a block is held once while it is sorted in place
        tokens.sort()
        again = tokens[1:] == tokens[:-1]
        first = np.flatnonzero(again & ~np.r_[False, again[:-1]])
        last = np.flatnonzero(again & ~np.r_[again[1:], False])
        return pa.record_batch([longs(tokens[first]), longs(last - first + 2)], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total = [], 0
        for batch in batches:
            for _, _, data, offsets in columns(batch, "text", lower=True):
                parts.append(shingle_sets(Words(data, offsets), n)[1])
                if (total := total + len(parts[-1])) >= block:
                    yield met_twice(parts)
                    parts, total = [], 0
        if parts:
            yield met_twice(parts)

    return run


def _sets(n: int, what: str, percent: int, heavy=None):
    """what: "classes" (doc_id, key, size, fingerprints), "postings" (token, sig, size, pos) or "sets" (sig, size, tokens as bytes).

    The last two leave out sets that the task has just given: ``SEEN`` fingerprints are remembered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def fresh(sig: np.ndarray, size: np.ndarray) -> np.ndarray:
            if len(seen) > SEEN:
                seen.clear()
            out = np.zeros(len(sig), bool)
            for at, one in enumerate(sig.tolist()):
                if size[at] and one not in seen:
                    seen.add(one)
                    out[at] = True
            return out

        for batch in batches:
            for i, j, data, offsets in columns(batch, "text", lower=True):
                w = Words(data, offsets)
                texts, tokens = shingle_sets(w, n)
                size, sig, sig2 = _fingerprints(texts, tokens, j - i)
                if what == "classes":
                    yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), longs(size), longs(sig), longs(sig2)], names=["doc_id", "k", "n_shingles", "sig", "sig2"])
                    continue
                new = fresh(sig, size)
                if what == "sets":
                    ends = np.cumsum(size)
                    raw = [tokens[e - s : e].tobytes() for s, e in zip(size[new].tolist(), ends[new].tolist(), strict=True)]
                    yield pa.record_batch([longs(sig[new]), longs(size[new]), pa.array(raw, pa.binary())], names=["sig", "size", "tokens"])
                elif new.any():
                    mine = new[texts]
                    texts, tokens, size = texts[mine], tokens[mine], np.where(new, size, 0)
                    often, counts = heavy.value
                    weight = np.zeros(len(tokens), np.int64)
                    if len(often):
                        at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
                        weight = np.where(often[at] == tokens, counts[at], 0)
                    # tokens are in order within each text, and stay so where weights tie
                    order = np.argsort((texts.astype(np.int64) << 40) | np.minimum(weight, (1 << 40) - 1), kind="stable")
                    pos = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
                    first = pos < (size - -(-percent * size // 100) + 1)[texts]
                    yield pa.record_batch([longs(tokens[order][first]), longs(sig[texts][first]), pa.array(size[texts][first].astype(np.int32)), pa.array(pos[first].astype(np.int32))], names=["token", "sig", "size", "pos"])

    return run


def _held(column: pa.Array) -> tuple[np.ndarray, list[int]]:
    """The 8-byte values of a binary column, without a copy, and where each row's begin (one more: the end)."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view(np.uint64), ((offsets - offsets[0]) // 8).tolist()


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (a, at), (b, bt) = (_held(batch.column(k)) if batch.num_rows else (np.zeros(0, np.uint64), [0]) for k in (2, 3))
        out = []
        for i in range(batch.num_rows):
            x, y = a[at[i] : at[i + 1]], b[bt[i] : bt[i + 1]]
            small, large = (x, y) if len(x) < len(y) else (y, x)
            place = np.searchsorted(large, small)
            out.append(int(np.count_nonzero(large[np.minimum(place, len(large) - 1)] == small)))
        sizes = [pa.array(np.diff(ends), pa.int64()) for ends in (at, bt)]
        yield pa.record_batch([batch.column(0), batch.column(1), *sizes, pa.array(out, pa.int64())], names=["a", "b", "na", "nb", "both"])


class _Members:
    """Members of lists, one list after another: what is known of each set, and its list's number."""

    NAMES = ("sig", "size", "rank", "rest", "comp", "met", "low", "mask", "spare", "side")

    def __init__(self, columns: list[np.ndarray], where: np.ndarray, same: np.ndarray):
        for name, column in zip(self.NAMES, columns, strict=True):
            setattr(self, name, column)
        self.columns, self.where, self.same = columns, where, same
        self.apart = self.size - self.low  # what the pivot may lack, at most

    def taken(self, order: np.ndarray) -> _Members:
        return _Members([c[order] for c in self.columns], self.where[order], self.same[order])

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each member's list begins, and its members."""
        starts = np.flatnonzero(np.r_[True, self.where[1:] != self.where[:-1]])
        sizes = np.diff(np.r_[starts, len(self.where)])
        return np.repeat(starts, sizes), np.repeat(sizes, sizes)


def _pairs(percent: int, nearest: bool = False):
    """Pairs of a list (rows of one token and two parts, by size) that neither sizes, positions nor the pivot's answers exclude; ``nearest``: of each set only the ``NEAREST`` next ones in an order that all lists share."""

    def need(m, n):
        return -(-percent * (m + n) // (100 + percent))

    def possible(a, b, v: _Members):
        """The pairs that may link, of which the first is the smaller set: fingerprints and sizes, the lower fingerprint first."""
        least = need(v.size[a], v.size[b])
        good = (v.comp[a] != v.comp[b]) & (100 * v.size[a] >= percent * v.size[b])
        good &= np.minimum(v.rank[a], v.rank[b]) + 1 + np.minimum(v.rest[a], v.rest[b]) >= least
        good &= (v.met[a] + v.apart[b] >= least) & (v.met[b] + v.apart[a] >= least)
        good &= v.same[a] | (v.side[a] != v.side[b])
        a, b = a[good], b[good]
        # the lists they share, at most, and what may match behind those
        shared = np.bitwise_count((v.mask[a] & v.mask[b]).view(np.uint64)).astype(np.int64) + np.minimum(v.spare[a], v.spare[b])
        good = shared + -(-percent * v.size[b] // 100) - 1 >= need(v.size[a], v.size[b])
        a, b = a[good], b[good]
        a, b = np.where(v.sig[a] < v.sig[b], a, b), np.where(v.sig[a] < v.sig[b], b, a)
        return v.sig[a], v.sig[b], v.size[a], v.size[b]

    def next_ones(v: _Members):
        """Of many lists at once."""
        v = v.taken(np.lexsort((mix(v.sig.view(np.uint64)), v.where)))
        start, size = v.lists()
        at = np.arange(len(start))
        for step in range(1, min(NEAREST, int(size.max(initial=0)) // 2) + 1):
            a = at[size >= 2 * step]
            b = start[a] + (a - start[a] + step) % size[a]
            yield possible(np.where(v.size[a] <= v.size[b], a, b), np.where(v.size[a] <= v.size[b], b, a), v)

    def all_pairs(v: _Members):
        """Of many short lists at once."""
        v = v.taken(np.lexsort((v.size, v.where)))
        start, size = v.lists()
        after = start + size - 1 - np.arange(len(start))
        ends = np.cumsum(after)
        begin = 0
        while begin < len(after):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + AT_ONCE, "right")))
            some = after[begin:end]
            a = np.repeat(np.arange(begin, end), some)
            yield possible(a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(some) - some, some), v)
            begin = end

    def blocks(v: _Members):
        """Of one long list, block by block."""
        v = v.taken(np.argsort(v.size, kind="stable"))
        for i in range(0, len(v.sig), BLOCK):
            x = slice(i, i + BLOCK)
            for j in range(i, len(v.sig), BLOCK):
                y = slice(j, j + BLOCK)
                if 100 * v.size[x][-1] < percent * v.size[y][0]:
                    break
                least = need(v.size[x][0], v.size[y][0])
                if np.minimum(v.rank[x].max(), v.rank[y].max()) + 1 + np.minimum(v.rest[x].max(), v.rest[y].max()) < least:
                    continue
                if v.met[x].max() + v.apart[y].max() < least or v.met[y].max() + v.apart[x].max() < least:
                    continue
                if v.comp[x].min() == v.comp[x].max() == v.comp[y].min() == v.comp[y].max():
                    continue
                a, b = (g.ravel() for g in np.meshgrid(np.arange(i, min(i + BLOCK, len(v.sig))), np.arange(j, min(j + BLOCK, len(v.sig))), indexing="ij"))
                yield possible(a[a < b], b[a < b], v)

    def of_lists(columns: list[np.ndarray], cuts: np.ndarray, same: np.ndarray):
        sizes = np.diff(np.r_[cuts, len(columns[0])])
        every = _Members(columns, np.repeat(np.arange(len(cuts)), sizes), same)
        if nearest:
            yield from next_ones(every)
            return
        long = np.repeat(sizes > BLOCK, sizes)
        yield from all_pairs(every.taken(np.flatnonzero(~long)))
        for k in np.flatnonzero(sizes > BLOCK).tolist():
            yield from blocks(every.taken(np.arange(cuts[k], cuts[k] + sizes[k])))

    def summed(found: list) -> pa.RecordBatch:
        """One row for each pair, with the number of lists that gave it."""
        columns = list(zip(*found, strict=True))
        found.clear()  # the pieces of each column go as it is joined
        a, b, na, nb = (np.concatenate(columns.pop(0)) for _ in range(4))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
        count, at = np.diff(np.r_[new, len(a)]), order[new]
        return pa.record_batch([longs(c) for c in (a[new], b[new], na[at], nb[at], count)], names=["a", "b", "na", "nb", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, many = None, [], 0
        for batch in _then_none(batches):
            if batch is not None:
                now = [c.to_numpy().astype(np.int64) for c in batch.columns]
                held = now if held is None else [np.concatenate(c) for c in zip(held, now, strict=True)]
            if held is None or not len(held[0]):
                continue
            _, token, i, j, *rest = held
            cuts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            whole = len(token) if batch is None else int(cuts[-1])  # the last list may go on
            if whole:
                for part in of_lists([c[:whole] for c in rest], cuts[cuts < whole], (i == j)[:whole]):
                    found.append(part)
                    many += len(part[0])
                    if many >= HELD_PAIRS:
                        yield summed(found)
                        found, many = [], 0
                held = [c[whole:] for c in held]
        if found:
            yield summed(found)

    return run


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb, both: the sizes of two sets and of what they share, for each pair (a, b) of fingerprints."""
    pairs = keep(pairs.select("a", "b"))
    asked = keep(pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct())
    sets = sets.join(broadcast_if_small(asked, SMALL_ROWS), "sig", "left_semi")  # only these are dealt out
    x, y = (sets.select(F.col("sig").alias(k), F.col("tokens").alias(f"set_{k}")) for k in "ab")
    return keep(pairs.join(x, "a").join(y, "b").select("a", "b", "set_a", "set_b").mapInArrow(_overlaps, "a long, b long, na long, nb long, both long"))


def _need(percent: int, m: str, n: str) -> str:
    """What two sets of m and n shingles share at least if they link."""
    return f"(({percent} * ({m} + {n}) + {99 + percent}) div {100 + percent})"


def _pair(x: str, y: str) -> tuple:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _enough(percent: int) -> str:
    """Whether two sets of na and nb shingles that share ``count`` of their first ones can link: the one whose first ones end earlier has no other match before, and only the rest after."""
    need = _need(percent, "na", "nb")
    rest = f"(({percent} * greatest(na, nb) + 99) div 100 - 1)"
    return f"count + {rest} >= {need}"


def heavy_shingles(docs: DataFrame, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, at most ``HEAVY``, by hash, and their counts."""
    counted = docs.select("text").mapInArrow(_count_shingles(n), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_COUNT)
    top = counted.orderBy(F.desc("n"), "token").limit(HEAVY).toArrow()
    tokens, counts = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def linked(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(a, b), fingerprints of different sets: links enough to connect what is connected, each one exact or between ends of exact ones."""
    spark = docs.sparkSession
    texts = docs.select("text")
    heavy = spark.sparkContext.broadcast(heavy_shingles(docs, n))
    postings = texts.mapInArrow(_sets(n, "postings", percent, heavy), "token long, sig long, size int, pos int")
    shared = postings.groupBy("token").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo != hi").select("token")
    # rank: the set's kept shingles before this one; only they can match before it
    ordered = W.partitionBy("sig").orderBy("pos")
    lists = keep(postings.join(shared, "token").distinct().withColumn("rank", F.row_number().over(ordered) - 1))
    similar = F.expr(f"100 * both >= {percent} * (na + nb - both)")

    pivots = keep(lists.groupBy("token").agg(F.min(F.struct("pos", "size", "sig")).alias("p")).select("token", F.col("p.sig").alias("pivot"), F.col("p.size").alias("pivot_size")))
    member = keep(lists.join(pivots, "token"))
    indexed = broadcast_if_small(keep(lists.select("sig").distinct()), SMALL_ROWS)
    sets = keep(texts.mapInArrow(_sets(n, "sets", percent), "sig long, size long, tokens binary").join(indexed, "sig", "left_semi").dropDuplicates(["sig"]))
    met = member.where(f"sig != pivot and 100 * least(size, pivot_size) >= {percent} * greatest(size, pivot_size)").groupBy("pivot", "sig", F.col("pivot_size").alias("na"), F.col("size").alias("nb")).count()
    star = keep(met.where(_enough(percent)).select("pivot", "sig", "count"))
    # each set first with the pivot it shares most lists with; then, in lists that these links leave mixed, with the others
    best = star.groupBy("sig").agg(F.min(F.struct((-F.col("count")).alias("less"), "pivot")).alias("p")).select(*_pair("sig", "p.pivot")).distinct()
    first = _compare(best, sets)
    joined = components(first.where(similar))
    by_list = member.join(joined.withColumnRenamed("node", "sig"), "sig", "left").groupBy("token").agg(F.min(F.coalesce("component", "sig")).alias("lo"), F.max(F.coalesce("component", "sig")).alias("hi"))
    member = keep(member.join(by_list.where("lo != hi").select("token"), "token"))
    others = member.select("pivot", "sig").distinct().join(star, ["pivot", "sig"]).select(*_pair("sig", "pivot")).distinct()
    first = first.unionByName(_compare(others.join(first, ["a", "b"], "left_anti"), sets))
    contracted = components(first.where(similar))

    # the pivot's answers: what each member shares with it, at most and at least
    answers = first.select("a", "b", "both").unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b"), "both")).select(F.col("a").alias("sig"), F.col("b").alias("pivot"), "both")
    known = member.join(answers, ["sig", "pivot"], "left").join(contracted.withColumnRenamed("node", "sig"), "sig", "left")
    exact = F.when(F.col("sig") == F.col("pivot"), F.col("size")).otherwise(F.col("both"))
    most = F.least("size", "pivot_size")  # they may link: they can share lists that have another pivot
    known = keep(known.select("token", "sig", "size", "rank", (F.col("size") - F.col("pos") - 1).alias("rest"), "pivot", F.coalesce("component", "sig").alias("comp"), F.coalesce(exact, most).alias("met"), F.coalesce(exact, F.lit(1)).alias("low")))
    centre = known.where("sig = pivot").select("token", F.col("comp").alias("centre")).distinct()
    known = known.join(centre, "token")
    mixed = known.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("comp") != F.col("centre"), F.col("met"))).alias("outer_met"), F.count("*").alias("members")).where("lo != hi")
    left = known.join(mixed, "token").where(f"comp != centre or 100 * (outer_met + size - low) >= {percent} * size")
    # a long list is dealt as pairs (i <= j) of parts
    parts = (F.col("members") / PART).cast("int") + 1
    mine = F.pmod(F.xxhash64("sig"), parts).cast("int")
    left = keep(left.select("pivot", "token", "sig", "size", "rank", "rest", "comp", "met", "low", parts.alias("parts"), mine.alias("side")))
    # the lists of a pivot with very many rows are dealt out; a pivot has no more lists than shingles
    filled = left.groupBy("pivot", "token").agg(F.sum("parts").alias("rows"))
    before = F.sum("rows").over(W.partitionBy("pivot").orderBy("token").rowsBetween(W.unboundedPreceding, -1))
    slots = keep(filled.select("token", (F.coalesce(before, F.lit(0)) / SLOT).cast("int").alias("slot")).where("slot > 0"))
    # a set's lists as 64 bits, and how many share a bit with others: they bound what two sets share
    bits = left.groupBy("sig").agg(F.expr("bit_or(shiftleft(1L, cast(pmod(xxhash64(token), 64) as int)))").alias("mask"), F.count("*").alias("n"))
    bits = bits.select("sig", "mask", (F.col("n") - F.bit_count("mask")).alias("spare"))
    left = keep(left.join(broadcast_if_small(slots, SMALL_ROWS), "token", "left").withColumn("slot", F.coalesce("slot", F.lit(0))).join(bits, "sig"))

    def candidates(members: DataFrame, nearest: bool) -> DataFrame:
        dealt = members.select("*", F.explode(F.expr("transform(sequence(0, parts - 1), other -> struct(least(side, other) as i, greatest(side, other) as j))")).alias("at"))
        return (
            dealt.select("pivot", "token", "at.i", "at.j", "sig", "size", "rank", "rest", "comp", "met", "low", "mask", "spare", "side", "slot")
            .repartition("pivot", "slot", "i", "j")  # lists of one pivot mostly give the same pairs
            .sortWithinPartitions("pivot", "slot", "i", "j", "token")
            .drop("slot")
            .mapInArrow(_pairs(percent, nearest), "a long, b long, na long, nb long, count long")
            .groupBy("a", "b", "na", "nb")
            .agg(F.sum("count").alias("count"))
            .where(_enough(percent))
        )

    # links of nearest sets make most other pairs of a group needless
    near = _compare(candidates(left, True).join(first.select("a", "b"), ["a", "b"], "left_anti"), sets)
    compared = first.unionByName(near)
    merged = components(compared.where(similar))
    moved = keep(merged.where("node != component").select(F.col("node").alias("comp"), F.col("component").alias("now")))
    left = left.join(broadcast_if_small(moved, SMALL_ROWS), "comp", "left").withColumn("comp", F.coalesce("now", "comp")).drop("now")
    pairs = candidates(left, False).join(compared.select("a", "b"), ["a", "b"], "left_anti")
    # what the first links connect is known by its component
    known_links = merged.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return known_links.unionByName(_compare(pairs, sets).where(similar).select("a", "b"))


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, k (key of the row), n_shingles, class_id (least doc_id with an equal set), component_id, first_k of each row of ``docs`` (doc_id, text).

    first_k is the key of the row that stands for the component: least doc_id, nulls last, then key; without words it is null.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("k"), F.col("text").cast("string").alias("text"))
    rows = keep(docs.mapInArrow(_sets(n, "classes", percent), "doc_id long, k long, n_shingles long, sig long, sig2 long"))
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k"))
    classes = rows.where("n_shingles > 0").groupBy("sig", "sig2").agg(least_row.alias("first"))
    groups = components(linked(docs, n, percent)).withColumnRenamed("node", "sig")
    named = keep(classes.join(groups, "sig", "left").select("sig", "sig2", "first", F.coalesce("component", "sig").alias("component"), F.col("component").isNull().alias("alone")))
    least = named.where("not alone").groupBy("component").agg(F.min("first").alias("least"))
    ids = named.join(least, "component", "left").withColumn("least", F.coalesce("least", "first"))
    ids = ids.select("sig", "sig2", F.col("first.doc_id").alias("class_id"), F.col("least.doc_id").alias("component_id"), F.col("least.k").alias("first_k"))
    # a third of all rows may be copies: only classes with several documents, or links, are worth a join
    found = rows.join(ids, ["sig", "sig2"], "left")
    return found.select("doc_id", "k", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"), "first_k")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + {N - 1}], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {N - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT r, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS class FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM p JOIN z a ON a.r = x JOIN z b ON b.r = y WHERE 100 * shared >= {PERCENT} * (a.n + b.n - shared)),
reach(r, t) AS (SELECT r, r FROM d UNION SELECT reach.r, l.y FROM reach JOIN l ON l.x = reach.t),
least AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = t GROUP BY reach.r),
same AS (SELECT class, min(doc_id) AS class_id FROM z JOIN d USING (r) GROUP BY class)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, CASE WHEN n IS NULL THEN doc_id ELSE class_id END AS class_id FROM d LEFT JOIN z USING (r) LEFT JOIN least USING (r) LEFT JOIN same USING (class)
"""
