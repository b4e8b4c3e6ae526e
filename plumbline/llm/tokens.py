"""Token ids of whole texts, exactly as the tokenizers library gives them.

A byte-level BPE of this family never lets a token span the border between a
character that isn't white space and white space behind it. Texts are cut there
into units (white space, then a word), each distinct unit is encoded once by
the library, and the ids of a text are those of its units in order. No cut is
made where the character before might be white space outside ASCII.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from plumbline.llm import spans
from plumbline.llm.spans import U64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


KEEP = 1_500_000  # distinct units that a worker remembers; beyond it starts afresh
SLOTS = 1 << 22
NEWLINE = 198  # the id of a line feed that stands alone in this vocabulary family


class Encoder:
    """Encodes texts; remembers the ids of units in an open-addressing table
    from a unit's 64-bit hash to its place in one long array of ids, and the
    units' bytes, which are compared at each use. Units of more than
    ``spans.LONG`` bytes, and those whose hash belongs to another unit, are
    encoded each time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.joins = self.tokenizer.encode("a\n b\nc", add_special_tokens=False).ids.count(NEWLINE) == 2
        self.forget()

    def forget(self) -> None:
        self.clear(SLOTS)
        self.at, self.size, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self.raw_at, self.raw_size, self.raw = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint8)
        self.units, self.used, self.raw_used = 0, 0, 0

    def clear(self, slots: int) -> None:
        self.mask, self.key, self.place = slots - 1, np.zeros(slots, U64), np.full(slots, -1, np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 where unknown."""
        out = np.full(len(key), -1, np.int32)
        todo, slot = np.arange(len(key)), (key & U64(self.mask)).astype(np.int64)
        while len(todo):
            place = self.place[slot]
            same = (self.key[slot] == key[todo]) & (place >= 0)
            out[todo[same]] = place[same]
            on = (place >= 0) & ~same
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out

    def put(self, key: np.ndarray, place: np.ndarray) -> None:
        """key: distinct and unknown."""
        slot = (key & U64(self.mask)).astype(np.int64)
        while len(key):
            free = np.flatnonzero(self.place[slot] < 0)
            self.place[slot[free]], self.key[slot[free]] = place[free], key[free]
            on = self.place[slot] != place  # taken before, or by another of these
            key, place, slot = key[on], place[on], (slot[on] + 1) & self.mask

    def ids_of(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units one after another, and how many each has. Units
        without a line feed are joined by one, which no token spans."""
        plain, rest = [], []
        for i, u in enumerate(units):
            # also alone: white space only or more than one, and what may be a special token
            (rest if not self.joins or b"\n" in u or u[1:2] <= b" " or b"<|" in u else plain).append(i)
        found, n, order = [], [], []
        for i in range(0, len(plain), 256):
            some = plain[i : i + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([b"\n".join([units[k] for k in some]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(ids == NEWLINE)
            if len(cut) != len(some) - 1:
                rest += some
                continue
            found.append(ids[ids != NEWLINE])
            n.append(np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1)
            order += some
        if rest:
            alone = [e.ids for e in self.tokenizer.encode_batch_fast([units[k].decode() for k in rest], add_special_tokens=False)]
            found.append(np.array([i for x in alone for i in x], np.uint32))
            n.append(np.array([len(x) for x in alone], np.int64))
        order = np.array(order + rest, np.int64)
        size = np.concatenate(n)
        back = np.argsort(order)
        return gather(np.concatenate(found), (np.cumsum(size) - size)[back], size[back]), size[back]

    def learn(self, key: np.ndarray, units: list[bytes]) -> None:
        ids, size = self.ids_of(units)
        raw, raw_size = np.frombuffer(b"".join(units), np.uint8), np.array([len(u) for u in units], np.int64)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.raw_used + len(raw) + 8 > len(self.raw):
            self.raw = np.concatenate((self.raw, np.zeros_like(self.raw)))
        while self.units + len(key) > len(self.at):
            self.at, self.size, self.raw_at, self.raw_size = (np.concatenate((x, np.zeros_like(x))) for x in (self.at, self.size, self.raw_at, self.raw_size))
        self.ids[self.used : self.used + len(ids)] = ids
        self.raw[self.raw_used : self.raw_used + len(raw)] = raw
        to = slice(self.units, self.units + len(key))
        self.at[to], self.size[to] = self.used + np.cumsum(size) - size, size
        self.raw_at[to], self.raw_size[to] = self.raw_used + np.cumsum(raw_size) - raw_size, raw_size
        if self.units + len(key) > (self.mask + 1) // 2:  # one very long text
            held = self.place >= 0
            old, place = self.key[held], self.place[held]
            self.clear(4 * (self.mask + 1))
            self.put(old, place)
        self.put(key, np.arange(self.units, self.units + len(key), dtype=np.int32))
        self.units, self.used, self.raw_used = self.units + len(key), self.used + len(ids), self.raw_used + len(raw)

    def same(self, part: np.ndarray, start: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the units of a text have the bytes of those at their places."""
        ok = (place >= 0) & (self.raw_size[place] == n)
        mine, known = spans.eight(part), np.ndarray(len(self.raw) - 7, "<u8", self.raw, strides=(1,))
        todo, at = np.flatnonzero(ok), 0
        while len(todo):
            left = n[todo] - at
            equal = (mine[start[todo] + at] ^ known[self.raw_at[place[todo]] + at]) & spans.MASK[np.minimum(left, 8)] == 0
            ok[todo[~equal]] = False
            todo, at = todo[equal & (left > 8)], at + 8
        return ok

    def encode(self, texts: pa.Array, target: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(lo, hi, ids, off): texts lo..hi-1 have ids[off[i]:off[i + 1]]."""
        raw, at = spans.text_buffer(texts)
        lo = 0
        while lo < len(at) - 1:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + target, "right")) - 1)
            part, docs = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            start = unit_starts(part, docs)
            n = np.diff(np.concatenate((start, [len(part)])))
            key = spans.byte_hash(part, start, start + n)
            short = n <= spans.LONG
            place = np.where(short, self.find(key), -1)
            if (short & (place < 0)).any():
                if self.units + len(np.unique(key[place < 0])) > KEEP:
                    self.forget()
                    place[:] = -1
                new = np.flatnonzero(short & (place < 0))
                new = new[np.unique(key[new], return_index=True)[1]]
                text = part.tobytes()
                self.learn(key[new], [text[a : a + k] for a, k in zip(start[new].tolist(), n[new].tolist())])
                place = np.where(short, self.find(key), -1)
            alone = np.flatnonzero(~self.same(part, start, n, place))
            ids, first, size = self.ids, self.at[place], self.size[place]
            if len(alone):
                more, size[alone] = self.ids_of([part[a : a + k].tobytes() for a, k in zip(start[alone].tolist(), n[alone].tolist())])
                first[alone] = self.used + np.cumsum(size[alone]) - size[alone]
                ids = np.concatenate((self.ids[: self.used], more))
            total = np.concatenate(([0], np.cumsum(size)))
            yield lo, hi, gather(ids, first, size), total[np.searchsorted(start, docs, "left")]
            lo = hi


def gather(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[at[i]:at[i] + size[i]] for all i, one after another."""
    total = np.cumsum(size)
    return values[np.arange(total[-1] if len(total) else 0) + np.repeat(at - (total - size), size)]


def unit_starts(part: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where units start: at each text with bytes, and at white space behind a
    character that is surely none."""
    space = spans.is_space(part)
    cut = np.zeros(len(part), bool)
    cut[1:] = space[1:] & ~space[:-1]
    # white space outside ASCII has two bytes from C2 or three from E1, E2 or E3
    doubt = np.zeros(len(part), bool)
    doubt[2:] |= part[:-2] == 0xC2
    for lead in (0xE1, 0xE2, 0xE3):
        doubt[3:] |= part[:-3] == lead
    cut &= ~doubt
    cut[docs[:-1][docs[:-1] < docs[1:]]] = True
    return np.flatnonzero(cut)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
