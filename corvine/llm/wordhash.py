"""Words and word n-grams of whole Arrow columns as numpy arrays: 64-bit hashes without a Python step per word.

Texts are taken as UTF-8 bytes. A word is a run of bytes other than 0x20 and 0x09-0x0D, as ASCII white space never occurs
inside a multi-byte character. A word's hash sums its 8-byte pieces, each mixed with its place in the word; an n-gram's
joins the hashes of two shorter ones, mixed again, by doubling. Mixing is not linear, so no arrangement of letters or words
collides by its form, as Thue-Morse sequences do under polynomials modulo 2**64. Equal words always hash alike, and an
n-gram's hash depends on its words alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
STEP, ODD = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of the splitmix64 generator."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def bytes_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each data[start:end], independent of where it stands."""
    size = end - start
    pieces = (size + 7) >> 3
    of = np.repeat(np.arange(len(size)), pieces)
    place = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = start[of] + 8 * place
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)[at].view("<u8")[:, 0]
    over = np.maximum(at + 8 - end[of], 0).astype(U) * U(8)  # bits of what follows the word
    values = mix((eights & (~U(0) >> over)) + mix((place + 1).astype(U) * STEP))
    out = np.zeros(len(size), U)
    some = np.flatnonzero(pieces)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(pieces) - pieces)[some])
    return mix(out + size.astype(U))


def pair_hash(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix(a * ODD + b + U(salt * int(STEP) % (1 << 64)))


def grams_hash(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n values from each one on, from those of the 1, 2, 4, ... values; the last two may overlap."""
    out, width = values, 1
    while width < n and len(out):
        step = min(width, n - width)
        width += step
        out = pair_hash(out[:-step], out[step:], width) if len(out) > step else out[:0]
    return out[: max(0, len(values) - n + 1)]


class Words:
    """The words of some texts one after another: byte ``start`` and ``end`` in ``data``, ``text`` (index of the text), ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        white = (data == 32) | ((data >= 9) & (data <= 13))
        first = np.ones(len(data), bool)
        first[1:] = white[:-1]
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        self.start = np.flatnonzero(first & ~white)
        last = np.ones(len(data), bool)
        last[:-1] = white[1:]
        last[offsets[1:][offsets[1:] > 0] - 1] = True
        self.end = np.flatnonzero(last & ~white) + 1
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.hash = bytes_hash(data, self.start, self.end)
        #: bounds[i]:bounds[i+1] are the words of text i.
        self.bounds = np.searchsorted(self.start, offsets)

    def grams(self, n: int) -> np.ndarray:
        """Hashes of the n words from each word on, over the ends of texts too; see ``whole``."""
        return grams_hash(self.hash, n)

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from each word on belong to one text."""
        return self.text[n - 1 :] == self.text[: max(0, len(self.text) - n + 1)]


def columns(batch: pa.RecordBatch, name: str, lower: bool = False, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of about ``most`` bytes; a longer text makes a slice of its own. Nulls are empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(column.type):
        wide = np.int64
    else:
        wide, column = np.int32, column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        part = data[offsets[i] : offsets[j]]
        if lower:
            part = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint8)
        yield i, j, part, offsets[i : j + 1] - offsets[i]
        i = j


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the leftmost position of the least of values[i:i+width]."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, step = np.arange(len(values)), 1
    better = lambda a, b: np.where(values[b] < values[a], b, a)
    while step * 2 <= width:
        at = better(at[:-step], at[step:])
        step *= 2
    return better(at[:n], at[width - step : width - step + n])


def joined(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words, each followed by one space, and the place where each word's copy starts (one more: the length)."""
    size = w.end - w.start
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    out = np.full(at[-1], 32, np.uint8)
    shift = np.repeat(at[:-1] - w.start, size)
    source = np.arange(len(shift)) + np.repeat(w.start - (at[:-1] - np.arange(len(size))), size)
    out[source + shift] = w.data[source]
    return out, at


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == U else values, pa.int64())


def lists(values: np.ndarray, sizes: np.ndarray, kind=np.int64) -> pa.Array:
    """A list column: ``values`` cut into pieces of ``sizes``."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), longs(values) if kind is np.int64 else pa.array(values.astype(kind)))
