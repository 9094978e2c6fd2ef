"""Words, hashes and n-grams of whole Arrow batches of texts, with numpy.

A batch's texts are looked at as one array of UTF-8 bytes. Blocks of it are worked on one
after the other, cut where no word is cut, so that a text of any length takes bounded memory
besides its own bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
#: Longer words are hashed as a whole: sums of powers modulo 2**64 are equal for certain pairs of
#: words of a thousand characters, whatever the base is.
LONG = 256
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
BASE = 0x9E3779B97F4A7C15 | 1
WRAP = 1 << 64


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix: each bit of the result depends on all of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers that look random."""
    start = (seed * 0xD1342543DE82EF95 + 1) % WRAP
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(start)) | np.uint64(1)


BYTES = multipliers(256, 11)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to ``n`` of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, BLOCK + 1)
        for i, b in enumerate((BASE, pow(BASE, -1, WRAP))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes; ``span_hashes`` has those of any spans from them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hashes(prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = powers(len(prefixes))[1]
    return mix((prefixes[ends] - prefixes[starts]) * inverse[starts])


def whole_hash(word: bytes) -> np.uint64:
    return np.uint64(int.from_bytes(blake2b(word, digest_size=8).digest(), "little"))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and where each begins; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(batch: pa.RecordBatch, column: int, size: int = 4 * BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in slices of rows with about ``size`` bytes of text, one row at least."""
    ends = np.cumsum(np.diff(utf8(batch.column(column))[1]))
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        end = max(int(np.searchsorted(ends, done + size, "right")), at + 1)
        yield batch.slice(at, end - at)
        at = end


@dataclass
class Words:
    """``hashes`` of all words; those of text ``i`` are ``first[i]`` up to ``first[i + 1]``."""

    hashes: np.ndarray
    first: np.ndarray


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that end where a text or a word ends."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + size, n)
        while end < n:
            near = offsets[np.searchsorted(offsets, end, "right") - 1]
            if near > at:
                end = int(near) if near > end - size // 4 else end
            if near == end:
                break
            gap = np.flatnonzero(SPACE[data[max(at + 1, end - 4096) : end]])
            if len(gap):
                end = max(at + 1, end - 4096) + int(gap[-1]) + 1
                break
            following = np.flatnonzero(SPACE[data[end : end + size]])
            if len(following):
                end += int(following[0]) + 1
                break
            end = min(end + size, n)
        yield at, end
        at = end


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Words are runs of anything but ASCII white space; ``lower`` changes A to Z."""
    data, offsets = utf8(texts)
    hashes, begins = [], []
    for lo, hi in blocks(data, offsets):
        part = LOWER[data[lo:hi]] if lower else data[lo:hi]
        ink = ~SPACE[part]
        heads = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        first = ink.copy()
        first[1:] &= ~ink[:-1]
        first[heads] = ink[heads]
        last = ink.copy()
        last[:-1] &= first[1:] | ~ink[1:]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashed = span_hashes(prefix_hashes(part), starts, ends)
        for i in np.flatnonzero(ends - starts > LONG):
            hashed[i] = whole_hash(part[starts[i] : ends[i]].tobytes())
        hashes.append(hashed)
        begins.append(starts + lo)
    if not hashes:
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    return Words(np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offsets))


def shingles(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, a shorter text's whole sequence as one, and where
    each text's begin."""
    n = np.diff(found.first)
    per_text = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    first = np.concatenate([[0], np.cumsum(per_text)])
    factors = multipliers(width, 23)
    sums = np.zeros(len(found.hashes), np.uint64)
    for k in range(width):
        sums[: max(len(sums) - k, 0)] += found.hashes[k:] * factors[k]
    starts = np.repeat(found.first[:-1] - first[:-1], per_text) + np.arange(first[-1])
    out = mix(sums[starts])
    for i in np.flatnonzero((n > 0) & (n < width)):
        own = found.hashes[found.first[i] : found.first[i + 1]]
        # the length takes part: a short sequence is no run of another length
        out[first[i]] = mix((own * factors[: len(own)]).sum(keepdims=True) + np.uint64(len(own)))[0]
    return out, first


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64),
                            np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
