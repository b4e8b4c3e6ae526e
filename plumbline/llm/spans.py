"""Words of whole Arrow text batches as numpy arrays, without a Python loop per word.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. Its hash takes its
bytes eight at a time, each time through a mixing step that isn't linear, so
that no pattern of words collides as it would in a polynomial modulo 2**64.
Windows of words are hashed from word hashes by doubling, with the same steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
ODD = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)  # the lowest k bytes
LONG = 256  # bytes from which a range is hashed on its own


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """The 64-bit finaliser of splitmix, after adding a seed."""
    h = h + U64((0x632BE59BD9B4E019 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def eight(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the end."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    return np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))


def byte_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of raw[start:end] for many ranges at once."""
    view, n = eight(raw), end - start
    out = mix(n.astype(U64), 100 + which)
    todo, at = np.flatnonzero((n > 0) & (n <= LONG)), 0
    while len(todo):
        left = n[todo] - at
        out[todo] = mix(out[todo] * ODD[which] + (view[start[todo] + at] & MASK[np.minimum(left, 8)]), which)
        todo, at = todo[left > 8], at + 8
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] = int.from_bytes(blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([which])).digest(), "little")
    return out


def window_hash(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hashes of h[i:i + n] for all i at which as many follow, from those of
    windows of 1, 2, 4, ... values."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out, got, power, size = None, 0, h, 1
    while True:
        if n & size:
            out = power[:m] if out is None else mix(out * ODD[which] + power[got : got + m], 60 + which)
            got += size
        if got == n:
            return mix(out, 80 + which)
        power = mix(power[:-size] * ODD[which] + power[size:], 20 + which)
        size *= 2


@dataclass
class Words:
    """Words of consecutive documents lo..hi-1 of a batch."""

    lo: int
    hi: int
    raw: np.ndarray  # bytes of these documents
    doc_start: np.ndarray  # byte offsets into raw, one more than documents
    start: np.ndarray  # of words, into raw
    end: np.ndarray
    doc: np.ndarray  # of words, counted from lo
    first: np.ndarray  # index of each document's first word, one more than documents

    def hashes(self, which: int = 0) -> np.ndarray:
        return byte_hash(self.raw, self.start, self.end, which)

    def window_starts(self, n: int) -> np.ndarray:
        """Indices of the words at which a window of n words of one document starts."""
        i = np.arange(len(self.start))
        return i[i + n <= self.first[self.doc + 1]] if len(i) else i


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; a null has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if off and len(texts) else np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words(texts: pa.Array, lower: bool = False, target: int = 1 << 21) -> Iterator[Words]:
    """Words of all texts, in pieces of whole documents of about ``target`` bytes."""
    raw, off = text_buffer(texts)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + target, "right")) - 1)
        part, at = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        if lower:
            part = part.copy()
            part[(part >= 65) & (part <= 90)] += 32
        word = ~is_space(part)
        edge = np.zeros(len(part) + 1, bool)  # a document's first byte starts a word of its own
        edge[at] = True
        before = np.concatenate(([False], word[:-1])) if len(part) else word
        after = np.concatenate((word[1:], [False])) if len(part) else word
        start = np.flatnonzero(word & (~before | edge[:-1]))
        end = np.flatnonzero(word & (~after | edge[1:])) + 1
        doc = np.searchsorted(at, start, "right") - 1
        first = np.searchsorted(start, at, "left")
        yield Words(lo, hi, part, at, start, end, doc, first)
        lo = hi


def normal(w: Words, i: int) -> bytes:
    """Document i of the piece with one space between words."""
    return b" ".join(w.raw[w.doc_start[i] : w.doc_start[i + 1]].tobytes().split())


def pack(keys: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    padded = data + bytes(8)
    return np.ndarray(len(data) // width, "<u8", padded, strides=(width,)) & MASK[width]


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket by the upper 32 bits, evenly for any n below 2**31."""
    return (((h >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values in a sorted array."""
    if len(bucket):
        cut = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip(np.r_[0, cut], np.r_[cut, len(bucket)]):
            yield int(bucket[a]), slice(int(a), int(b))
