"""Token files, packing and archives: ids of the library, any id types, awkward rows."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa

from plumbline.llm import packing, spans, token_files, tokens, warc

MORSE = [0]
while len(MORSE) < 4096:
    MORSE += [1 - x for x in MORSE]
AWKWARD = [
    "<|endoftext|> a<|endoftext|>", "don't we'll I'M they've", "a b c　d\u0085e", "  lead and trail  ", "\n\n\na\n b\r\n\tc", "😀 👩‍👩‍👧 é é", "漢字かな交じり文、全角　空白", "1234567890 3.14 1,000", "a" * 3000,
    "\x1c\x1d\x1e\x1f x", "tab\tnew\x0bline\x0c", "", " ", "\n", None, "x" * 257 + " " + "x" * 257, "''' \"\"\" ...", "ﷺ ﻿bom", "".join("ab"[x] for x in MORSE) + " " + "".join("ba"[x] for x in MORSE),
]


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_library(spark):
    own, texts = library(), [*AWKWARD, *AWKWARD[::-1]]
    df = spark.createDataFrame([(f"k{i % 7}" if i % 5 else None, t, 1) for i, t in enumerate(texts)], "doc_id string, text string, start int")
    got = token_files.read(token_files.write(df, end_id=9)).collect()
    want = sorted((f"k{i % 7}" if i % 5 else "", np.array([*own(t), 9], "<u4").tobytes()) for i, t in enumerate(texts))
    assert sorted((r.id or "", bytes(r.ids)) for r in got) == want
    order = sorted(got, key=lambda r: r.start)
    assert [r.id or "" for r in order] == sorted(r.id or "" for r in got)
    assert [r.start for r in order] == np.cumsum([0, *(r.n_tokens for r in order)]).tolist()[:-1]
    assert token_files.read(token_files.write(df.limit(0))).count() == 0


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(spans, "byte_hash", lambda raw, start, end, which=0: np.zeros(len(start), np.uint64))
    texts = ["one two three", "four five", "one two three"]
    own = library()
    flat = [ids[off[i] : off[i + 1]].tolist() for lo, hi, ids, off in tokens.Encoder(tokens.default_path()).encode(pa.array(texts)) for i in range(hi - lo)]
    assert flat == [own(t) for t in texts]


def test_patterns_don_t_collide():
    raw = np.frombuffer("".join("ab"[x] for x in MORSE).encode() + "".join("ba"[x] for x in MORSE).encode(), np.uint8)
    h = spans.byte_hash(raw, np.array([0, 4096]), np.array([4096, 8192]))
    assert h[0] != h[1]
    v = np.array([3, 5], np.uint64)[MORSE]
    assert spans.window_hash(v, 4096)[0] != spans.window_hash(v[::-1] ^ np.uint64(6), 4096)[0]
    rng = np.random.default_rng(0)
    words = rng.integers(0, 4, 3000).astype(np.uint64)
    for n in (1, 2, 5, 18, 35):
        got = spans.window_hash(words, n)
        same = {}
        for i, x in enumerate(got.tolist()):
            assert same.setdefault(tuple(words[i : i + n].tolist()), x) == x
        assert len(set(same.values())) == len(same)


def test_packed_ids(spark):
    own, texts = library(), [*AWKWARD, " ".join(f"word{i}" for i in range(9000)), *AWKWARD[:5]]
    df = spark.createDataFrame([(i if i % 6 else None, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, class string")
    got = packing.pack(df, end_id=1).collect()
    want = sorted(np.array([*own(t), 1], "<u4").tobytes() for t in texts)
    by_document = {}
    for r in got:
        by_document.setdefault((r.doc_id, zlib.crc32(b"") if r.doc_id is not None else r.doc_tokens), []).append(r)
    known = [b"".join(bytes(r.payload) for r in sorted(own_rows, key=lambda r: r.start)) for (i, _), own_rows in by_document.items() if i is not None]
    assert sorted(known) == sorted(np.array([*own(t), 1], "<u4").tobytes() for i, t in enumerate(texts) if i % 6)
    assert sum(len(r.payload) for r in got) == sum(map(len, want))
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        assert [o for o, _ in sorted(pieces)] == np.cumsum([0, *(n for _, n in sorted(pieces))]).tolist()[:-1] and sum(n for _, n in pieces) <= 2048
    assert packing.pack(df.limit(0)).count() == 0


def test_archives_with_awkward_rows(spark):
    big, other = "é" * 800, "x" * 1000
    rows = [("a b", "u", big, 1), ("z>", "u", big, 1), ("z>", "v", big, 1), (None, "u\r\nX: y", big, 1), ("k", None, other, 2), (None, "u", other, 2), ("s", "u", "small", 3), ("t", "u", "small", 3), ("e", "u", None, 3), ("f", "u", "", 3), ("l", "u", "y" * 5_000_000, 4)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string, digest int")
    got = warc.read(warc.write(df)).collect()
    assert len(got) == len(rows)
    seen = sorted((r.id or "", r.record_type, r.refers_to or "", r.payload_bytes) for r in got)
    assert seen == sorted([
        ("a b", "revisit", "z>", 1600), ("z>", "response", "", 1600), ("z>", "response", "", 1600), ("", "revisit", "z>", 1600), ("k", "response", "", 1000), ("", "revisit", "k", 1000),
        ("s", "response", "", 5), ("t", "response", "", 5), ("e", "response", "", 0), ("f", "response", "", 0), ("l", "response", "", 5_000_000),
    ])
    assert all(r.digest == hashlib.sha1(bytes(r.payload)).hexdigest() for r in got if r.record_type == "response")
    assert warc.read(warc.write(df.limit(0))).count() == 0
    index = warc.write(df)
    assert {r.id for r in warc.read(index.where("id = 'k'")).collect()} == {"k"}
