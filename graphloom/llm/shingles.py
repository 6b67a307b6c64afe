"""Hashes of word shingles for a batch of texts at once, on the UTF-8 buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Fixed odd multipliers.
K1, K2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
#: Bytes whose prefix sums are held at once.
BLOCK = 1 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and each row's bounds in them."""
    column = column.cast(pa.large_string())
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1] if bounds else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of 64-bit values."""
    h = a * K1
    h ^= h >> U(29)
    h += b
    h *= K2
    h ^= h >> U(32)
    h *= K1
    h ^= h >> U(31)
    return h


MULTIPLIER = 0x5851F42D4C957F2D
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def _powers(k: int) -> np.ndarray:
    """k to the powers 0 to BLOCK, modulo 2^64."""
    out = np.full(BLOCK + 1, U(k))
    out[0] = U(1)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


UP, DOWN = _powers(MULTIPLIER), _powers(INVERSE)


def _sums(x: np.ndarray) -> np.ndarray:
    """Prefix sums of the bytes' polynomial, from 0; at most BLOCK bytes."""
    low = x + ((x >= 65) & (x <= 90)) * np.uint8(32)
    p = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + U(1)) * UP[: len(x)], out=p[1:])
    return p


def _long_word(x: np.ndarray) -> np.uint64:
    """The same polynomial for one word beyond BLOCK bytes, block by block from its end."""
    total = U(0)
    step = U(pow(MULTIPLIER, BLOCK, 1 << 64))
    for at in range((len(x) - 1) // BLOCK * BLOCK, -1, -BLOCK):
        total = total * step + _sums(x[at : at + BLOCK])[-1]
    return total


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word [^\\x20\\x09-\\x0D]+ of all rows, A-Z lower-cased, and the bounds of each row's words.

    The bytes form a polynomial with prefix sums over blocks of words; a word's hash is its part of the
    sum, shifted to the word's start, mixed with its length. Memory is bounded by BLOCK, however long a text is.
    """
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = ~space
    first[1:] &= space[:-1]
    last = ~space
    last[:-1] &= space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = ~space[inner]
    last[inner - 1] = ~space[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    del space, first, last
    bounds = np.searchsorted(s, offsets)
    out = np.empty(len(s), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(s):
            end = int(np.searchsorted(e, s[at] + BLOCK, "right"))
            if end > at:
                base = int(s[at])
                p, i, j = _sums(data[base : e[end - 1]]), s[at:end] - base, e[at:end] - base
                out[at:end] = (p[j] - p[i]) * DOWN[i]
            else:
                end = at + 1
                out[at] = _long_word(data[s[at] : e[at]])
            at = end
        return mix(out, (e - s).astype(np.uint64)), bounds


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Each row's distinct shingles of width words as sorted 64-bit hashes. With fewer words the whole
    sequence is the one shingle; without words there is none."""
    words, bounds = word_hashes(*utf8(column))
    out = []
    with np.errstate(over="ignore"):
        h = words.copy()
        for k in range(1, width):
            n = len(words) - k
            if n <= 0:
                break
            h = mix(h[:n] if len(h) > n else h, words[k:])
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if e - s >= width:
                x = np.sort(h[s : e - width + 1])
                new = x[1:] != x[:-1]
                out.append(x if new.all() else x[np.append(True, new)])
            elif e > s:
                short = words[s : s + 1] ^ U(e - s)
                for k in range(s + 1, e):
                    short = mix(short, words[k : k + 1])
                out.append(short)
            else:
                out.append(np.zeros(0, np.uint64))
    return out
