"""Canonical length-limited Huffman codes of integers, coded and decoded as numpy arrays."""

from __future__ import annotations

import numpy as np

LIMIT = 18


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code lengths of least total length under ``limit`` for symbols with the given counts (package-merge); 0 for a count of 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols have no code of at most {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    packages, is_leaf = np.zeros(0, np.int64), []
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        is_leaf.append(order < len(leaves))
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    taken = 2 * len(leaves) - 2
    for row in reversed(is_leaf):
        n = int(row[:taken].sum())  # the lightest n symbols are in this row's part, each one bit longer
        lengths[used[:n]] += 1
        taken = 2 * (taken - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol: by length, then symbol, counting up."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        if n := int(lengths[s]):
            code <<= n - last
            codes[s], last = code, n
            code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for each value of the next max(lengths) bits."""
    width = max(1, int(lengths.max(initial=0)))
    symbols, sizes = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (width - lengths[order].astype(np.int64))
    filled = int(spans.sum())
    symbols[:filled], sizes[:filled] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return symbols, sizes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, places: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ``ids``, first bit highest in its byte, and the bit where the id at each of ``places`` starts."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    total = int(end[-1]) if len(end) else 0
    words = np.zeros(total // 32 + 2, np.uint64)
    place, shift = start >> 5, (64 - size - (start & 31)).astype(np.uint64)
    value = codes[ids].astype(np.uint64) << shift  # within the two 32-bit words from ``place`` on
    for half, offset in ((value >> np.uint64(32), 0), (value & np.uint64(0xFFFFFFFF), 1)):
        if len(place):
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            words[place[first] + offset] |= np.bitwise_or.reduceat(half, first)
    return words.astype(">u4").tobytes()[: -(-total // 8)], start[places]


def decode(bits: bytes, starts: np.ndarray, counts: np.ndarray, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """counts[k] ids from the bit starts[k] on, for each k, one after another: all k advance together, one table look-up for each step."""
    order = np.argsort(-counts, kind="stable")  # the longest first, so that those under way are a prefix
    at, left = starts[order].astype(np.int64), counts[order]
    out = np.zeros((int(left[0]) if len(left) else 0, len(left)), np.uint32)
    shift, raw = np.uint32(32 - (int(len(symbols)).bit_length() - 1)), np.frombuffer(bits + bytes(8), np.uint8)
    # bytes i..i+3 as one number, for each i
    quads = (raw[:-3].astype(np.uint32) << 24) | (raw[1:-2].astype(np.uint32) << 16) | (raw[2:-1].astype(np.uint32) << 8) | raw[3:]
    under_way = len(left) - np.searchsorted(left[::-1], np.arange(len(out)), "right")
    for step, n in enumerate(under_way.tolist()):
        now = at[:n]
        ahead = (quads[now >> 3] << (now & 7).astype(np.uint32)) >> shift
        out[step, :n] = symbols[ahead]
        now += sizes[ahead]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return out.T[back][np.arange(len(out)) < counts[:, None]] if len(out) else np.zeros(0, np.uint32)
