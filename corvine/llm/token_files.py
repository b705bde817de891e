"""Token ids of documents in files of canonical length-limited Huffman codes, and reading them back.

1. Texts are tokenized once, each document's ids followed by the end id, into a table of 16- or 32-bit ids.
2. Ids are counted over all documents (partly before the shuffle: at most one row for each id and task); the counts, one for
   each id of the vocabulary, give one code of at most ``huffman.LIMIT`` bits for all files.
3. Documents are dealt by ranges of doc_id, in order within a range, which makes a part. A part is cut into blocks of whole
   documents with about ``BLOCK_IDS`` ids; a block is one bit string with the bit offset of every ``CHECKPOINT``-th id of
   each document, so it decodes by itself, from any checkpoint on.
4. A file format row is a block: part and number in the part, its ids and those before it in the part, doc_ids and their
   numbers of ids, bits, checkpoints. A second table holds the code's lengths, from which codes and tables follow. Both are
   written by Spark into the folder, so any store works.

Reading sums the parts' totals (one row a part), decodes blocks independently by table look-up, all checkpoints of a block side by side.

Cases: a null text is empty, just the end id; a special token's string in a text is that token, as the library takes it, or
ordinary text if asked; documents of one doc_id keep together in the order of a hash of the text, so reruns agree, and may
lie in several parts, as may copies; a null doc_id comes first; a document longer than a block is a block by itself; extra
columns are ignored; an empty table gives empty files.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import huffman
from .common import broadcast_if_small, keep, scratch_path, shuffles, table

END_ID, BLOCK_IDS, CHECKPOINT = 2, 1 << 18, 256
#: Bytes of text that are tokenized together, and most units that a worker remembers, about 30 bytes each.
CALL_BYTES, MEMORY = 8 << 20, 1 << 21
#: Words that are tokenized as one text.
LINES = 256
SMALL_PARTS = 1_000_000
#: White space of the tokenizer's pattern that isn't ASCII, and what only Python takes for white space.
WIDE = "\x1c-\x1f\x85\xa0  -     　"
#: Letters of common words, and marks after them: the pattern takes a run of the first, and one of the second, as a piece.
LATIN, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", ",.;:!?"
BLOCK_SCHEMA = "part int, block int, n long, first long, doc_ids array<long>, sizes array<int>, bits binary, starts array<long>"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _joined(parts: list[np.ndarray], kind) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, kind), *parts]), np.fromiter(map(len, parts), np.int64, len(parts))


class Tokenizer:
    """The tokenizer with a bounded memory of units, for ids of whole texts.

    A unit is a run of ASCII white space with the word after it. The byte-level pattern never joins a character that isn't
    white space with white space after it, so a text's ids are those of its units one by one. Units are found and numbered
    as Arrow columns; those not met before are tokenized once. Texts for which that doesn't hold (special tokens, wide white
    space before a unit), and all texts of tokenizers with another pattern, are tokenized as they are.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.size = self.library.get_vocab_size()
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.call = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        parts = json.loads(self.library.to_str())
        first = parts["pre_tokenizer"] or {}
        self.by_units = parts["normalizer"] is None and first.get("type") == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"]
        self.special = [] if special_as_text else [t["content"] for t in parts["added_tokens"]]
        self.line = self.ids("\n")
        self.mark = {c: int(self.ids(c)[0]) for c in MARKS}
        #: The characters that stand for bytes in byte-level vocabularies: shown Latin-1 ones for themselves, then the others from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.bytes = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        #: known[i] has the ids flat[start[i]:start[i + 1]].
        self.known, self.flat, self.start = pa.array([], pa.string()), np.zeros(0, self.kind), np.zeros(1, np.int64)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.call([text], add_special_tokens=False)[0].ids, self.kind)

    def _lines(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and the number of each: tokenized as the lines of texts, where each line end is one id."""
        texts = ["\n".join(lines[i : i + LINES]) for i in range(0, len(lines), LINES)]
        ids = [np.array(x.ids, self.kind) for x in self.call(texts, add_special_tokens=False)]
        ids = np.concatenate([np.concatenate([x, self.line]) for x in ids]) if ids else np.zeros(0, self.kind)
        ends = np.flatnonzero(ids == self.line[0])
        if len(self.line) != 1 or len(ends) != len(lines):
            return _joined([self.ids(x) for x in lines], self.kind)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _new(self, units: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of units, and in that order their ids and the number of each: most are a word after one space or line end, or without either."""
        offsets = np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1]
        data = np.frombuffer(bytes(units.buffers()[2]) + b"  ", np.uint8)
        first, second = data[offsets[:-1]], data[offsets[:-1] + 1]
        white = lambda b: (b == 32) | ((b >= 9) & (b <= 13))
        alone = np.diff(offsets) == 1
        odd = pc.match_substring_regex(units, f"[{WIDE}]").to_numpy(zero_copy_only=False) | (white(first) & (alone | white(second) | ((first != 32) & (first != 10))))
        latin, mark = (pc.match_substring_regex(units, rf"^[ \n]?[{LATIN}]+{x}$").to_numpy(zero_copy_only=False) for x in ("", f"[{MARKS}]"))
        kinds = [latin, mark, ~(latin | mark | odd) & (first == 32), ~(latin | mark | odd) & (first == 10), ~(latin | mark | odd) & ~white(first), odd]
        at = [np.flatnonzero(k) for k in kinds]
        names = [units.take(pa.array(k)).to_pylist() for k in at]
        found = [self._latin(names[0]), self._latin([x[:-1] for x in names[1]]), self._lines(names[2]), self._lines([x[1:] for x in names[3]]), self._lines(names[4]), _joined([self.ids(x) for x in names[5]], self.kind)]
        ids, sizes = found[1]
        found[1] = np.insert(ids, np.cumsum(sizes), np.array([self.mark[x[-1]] for x in names[1]], self.kind)), sizes + 1
        ids, sizes = found[3]
        found[3] = np.insert(ids, np.cumsum(sizes) - sizes, self.line[0]), sizes + 1
        return np.concatenate(at), *(np.concatenate(x) for x in zip(*found, strict=True))

    def _latin(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters after one space or line end, or without either: a word is one piece of the pattern, which the library's model takes by itself."""
        of = self.library.model.tokenize
        lines = "\n".join(w.removeprefix("\n") for w in words).encode().decode("latin-1").translate(self.bytes).split(self.bytes[10]) if words else []
        coded = [[t.id for t in of(w)] for w in lines]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.fromiter(chain.from_iterable(coded), self.kind, int(sizes.sum()))
        lined = np.array([w[0] == "\n" for w in words], bool)
        return np.insert(ids, (np.cumsum(sizes) - sizes)[lined], self.line[0]), sizes + lined

    def _of_units(self, units: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after another, and the number of ids of each."""
        coded = units.dictionary_encode()
        names = coded.dictionary
        place = pc.index_in(names, self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = names.take(pa.array(new))
            order, ids, sizes = self._new(fresh)
            place[new[order]] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, fresh.take(pa.array(order))])
            self.flat = np.concatenate([self.flat, ids])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        at = place[coded.indices.to_numpy()]
        sizes = (self.start[1:] - self.start[:-1])[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - (ends - sizes), sizes)]
        if len(self.known) > MEMORY:  # this call's units stay, if they are few enough
            self.known, self.flat, self.start = (pa.array([], pa.string()), np.zeros(0, self.kind), np.zeros(1, np.int64)) if len(names) > MEMORY // 2 else self._only(names, place)
        return ids, sizes

    def _only(self, names: pa.StringArray, place: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        sizes = (self.start[1:] - self.start[:-1])[place]
        ends = np.cumsum(sizes)
        return names, self.flat[np.arange(ends[-1]) + np.repeat(self.start[place] - (ends - sizes), sizes)], np.append(0, ends)

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        whole = np.full(len(texts), not self.by_units)
        for pattern in [*map(re.escape, self.special), f"[{WIDE}][\\x09-\\x0D\\x20]"] if self.by_units else []:
            whole |= pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for i in np.flatnonzero(whole).tolist():
            out[i] = self.ids(texts[i].as_py())
        rest = np.flatnonzero(~whole)
        part = texts.take(pa.array(rest))
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1] if len(part) else np.zeros(1, np.int64)
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(part) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        white = (data == 32) | ((data >= 9) & (data <= 13))
        begins = np.zeros(len(data), bool)
        begins[1:] = white[1:] & ~white[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins)
        cuts = np.append(starts, len(data)).astype(np.int32)
        units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data)))
        ids, sizes = self._of_units(units)
        ends = np.append(0, np.cumsum(sizes))[np.searchsorted(starts, offsets)]
        for i, a, b in zip(rest.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[i] = ids[a:b]
        return out


_loaded: dict[tuple[str, bool], Tokenizer] = {}


def _tokenize(path: str, end_id: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, special_as_text) not in _loaded:
            _loaded[path, special_as_text] = Tokenizer(path, special_as_text)
        tokenizer = _loaded[path, special_as_text]
        end, seen = np.array([end_id], tokenizer.kind).tobytes(), np.zeros(max(tokenizer.size, end_id + 1), np.int64)
        names = ["doc_id", "order", "ids", "counts"]
        for batch in batches:
            bounds = np.append(0, np.cumsum(pc.binary_length(batch.column(1)).to_numpy()))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CALL_BYTES, "right")) - 1)
                coded = tokenizer.encode(batch.column(1).slice(i, j - i))
                seen[end_id] += len(coded)
                seen += np.bincount(np.concatenate(coded), minlength=len(seen))
                rows = pa.array([ids.tobytes() + end for ids in coded], pa.binary())
                yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), rows, pa.nulls(j - i, pa.list_(pa.int64()))], names=names)
                i = j
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.tolist()], pa.list_(pa.int64()))], names=names)

    return run


def _blocks(lengths_, kind, every: int, block_ids: int):
    """Documents' ids, in order, to coded blocks; a partition is a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.frombuffer(lengths_.value, np.uint8)
        codes = huffman.canonical(lengths)
        part, block, first, docs, held, n = TaskContext.get().partitionId(), 0, 0, [], [], 0
        kinds = {"part": pa.int32(), "block": pa.int32(), "n": pa.int64(), "first": pa.int64(), "doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "bits": pa.binary(), "starts": pa.list_(pa.int64())}

        def done() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            marks = -(-sizes // every)
            begins = np.cumsum(sizes) - sizes
            places = np.repeat(begins, marks) + every * (np.arange(marks.sum()) - np.repeat(np.cumsum(marks) - marks, marks))
            bits, starts = huffman.encode(np.concatenate(held), lengths, codes, places)
            row = [part, block, n, first, docs, sizes, bits, starts]
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds.values(), strict=True)], names=list(kinds))

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if n >= block_ids:
                    yield done()
                    block, first, docs, held, n = block + 1, first + n, [], [], 0
                docs.append(doc)
                held.append(np.frombuffer(raw.as_buffer(), kind))
                n += len(held[-1])
        if docs:
            yield done()

    return run


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, every: int = CHECKPOINT, special_as_text: bool = False) -> None:
    """Writes the ids of ``docs`` (doc_id, text) into ``folder``/blocks and ``folder``/code."""
    spark, path = docs.sparkSession, tokenizer or tokenizer_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # about equal ranges of doc_id; where they lie doesn't change the result
    n = max(shuffles(spark), int((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) >> 27))
    coded = keep(docs.select("doc_id", "text", F.xxhash64("text").alias("order")).mapInArrow(_tokenize(path, end_id, special_as_text), "doc_id long, order long, ids binary, counts array<long>"), "zstd")
    counts = coded.where("ids is null").select(F.posexplode("counts").alias("id", "n")).where("n > 0").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # at most one row for each id
    loaded = Tokenizer(path)
    size = max(loaded.size, end_id + 1)
    total = np.zeros(size, np.int64)
    total[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    lengths = huffman.code_lengths(total)
    spark.createDataFrame(pa.table({"id": np.arange(size, dtype=np.int32), "bits": lengths.astype(np.int32)})).coalesce(1).write.parquet(f"{folder}/code")
    shared = spark.sparkContext.broadcast(lengths.tobytes())
    # rows alike in doc_id and text are interchangeable; the third key lets them lie in several parts
    rows = coded.where("ids is not null").select("doc_id", "order", F.monotonically_increasing_id().alias("row"), "ids")
    dealt = rows.repartitionByRange(n, "doc_id", "order", "row").sortWithinPartitions("doc_id", "order", "row")
    dealt.select("doc_id", "ids").mapInArrow(_blocks(shared, loaded.kind, every, block_ids), BLOCK_SCHEMA).write.parquet(f"{folder}/blocks", compression="none")


def _decode(lengths_, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = huffman.decode_table(np.frombuffer(lengths_.value, np.uint8))
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                # a document's checkpoints stand ``every`` ids apart; the last one has what is left
                marks = -(-sizes // every)
                counts = np.full(marks.sum(), every, np.int64)
                counts[np.cumsum(marks) - 1] = sizes - (marks - 1) * every
                ids = huffman.decode(row["bits"], np.array(row["starts"], np.int64), counts, *tables)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                spans = [raw[4 * (e - s) : 4 * e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                base = row["before"] + row["first"]
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(base + ends - sizes), pa.array(sizes), pa.array([s.tobytes() for s in spans], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return run


def read(spark: SparkSession, folder: str, every: int = CHECKPOINT) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of each document in ``folder``."""
    code = spark.read.parquet(f"{folder}/code").toArrow()  # one row for each id of the vocabulary
    lengths = np.zeros(code.num_rows, np.uint8)
    lengths[code.column("id").to_numpy()] = code.column("bits").to_numpy()
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    parts = keep(parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    rows = blocks.join(broadcast_if_small(parts, SMALL_PARTS), "part")
    return rows.select("first", "before", "doc_ids", "sizes", "bits", "starts").mapInArrow(_decode(spark.sparkContext.broadcast(lengths.tobytes()), every), "doc_id long, start long, n_tokens long, ids binary")


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the files written."""
    folder = scratch_path(docs.sparkSession)
    write(docs, folder)
    return read(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
