"""Packing and BPE against the tokenizers library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rulewell.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
AWKWARD = [
    None,
    "",
    " ",
    "\n",
    "a  b   c\n d \n\n e ",
    "tab\tand\x0bodd\x1cblanks here there",
    "don't we'll I'm x's 12³½ Ⅷ",
    "<|endoftext|> a <|endoftext|>b <|endoftext|>",
    "naïve Straße 漢字 😀 \u0000 end",
    "word " * 3000,
    "x" * 5000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n):
    draw = random.Random(5)
    parts = list(" \n\t'sdtrevmlabcéß1٣²½x<|.!# \u0085😀漢\r") + ["<|endoftext|>", "  ", "'ll", " the", "ing"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(n)]


def test_ids_and_decoding_equal_the_library(library):
    codec = bpe.ByteBpe(PATH)
    for text in [t or "" for t in AWKWARD] + random_texts(1500):
        want = library.encode(text, add_special_tokens=False).ids
        packed = codec.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == want, text
        assert codec.decode(packed) == library.decode(want, skip_special_tokens=False)


def test_cache_generations_keep_results(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 7)
    codec = bpe.ByteBpe(PATH)
    text = " ".join(f"word{i % 23} other{i % 5}," for i in range(300))
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_stale_entries_are_skipped():
    codec = bpe.ByteBpe(PATH)
    for piece in ("aaaaaaaa", " banana", "ababababa", "mississippi"):
        assert b"".join(codec._strings[i] for i in codec.merge([codec._byte_ids[b] for b in piece.encode()])) == piece.encode()


def test_round_trip_query(docs_of, library):
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(3, "\n"), (None, "no number")]
    out = bpe.round_trip_digests(docs_of(rows))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = out.collect()
    assert len(got) == len(rows) and sum(r.doc_id == 3 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].n_tokens == by_id[1].n_tokens == 0 and by_id[0].ids_sha256 == by_id[1].ids_sha256
    assert all(by_id[i].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(AWKWARD))
    assert bpe.round_trip_digests(docs_of([])).collect() == []
    tokens = {r.doc_id: r for r in bpe.tokenize(docs_of(rows[:5])).collect()}
    assert tokens[4].decoded == AWKWARD[4] and tokens[0].ids == []


def test_chunk_encoder_equals_the_library(library):
    texts = [t or "" for t in AWKWARD] + random_texts(400)
    packed = packing.ChunkEncoder(PATH).encode(texts)
    for text, ids in zip(texts, packed, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_chunks_are_cut_from_one_text_and_let_go(monkeypatch, library):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 60)
    monkeypatch.setattr(packing, "CACHE_CHARS", 500)
    texts = [" ".join(f"{w}{i + k}\n{w}" if k % 9 == 0 else f"{w}{i * k}" for k, w in enumerate("an ünder 漢 \u2028x it's y\t".split(" ") * 6)) for i in range(80)]
    encoder = packing._encoder(PATH)
    asked = []
    monkeypatch.setattr(encoder, "_ids", lambda part, own=encoder._ids: asked.append(len(part)) or own(part))
    got = []
    for i in range(0, len(texts), 8):
        got += encoder.encode(texts[i : i + 8])
        assert len(encoder._known) < 60 + 8 * 36
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(asked) < 1000  # chunks alone would be more
    list(packing._packed(iter([pd.DataFrame({"doc_id": range(80), "text": texts})]), PATH, 0, 2048, 8))
    assert not encoder._known and not encoder._old


def test_a_piece_is_merged_once_whatever_ends_its_chunk(monkeypatch, library):
    words = [f"{a}{b}" for a in ("grün", "слово", "plain", "漢字") for b in ("ing", "ä", "xyzzy")]
    texts = ["the " + " ".join(f"{begin}{w}{end}" for w in words) for begin, end in (("", ""), ("", ","), ("(", ").\nIt's"), ("", "12"))]
    encoder = packing.ChunkEncoder(PATH)
    asked, merged = [], []
    monkeypatch.setattr(encoder, "_ids", lambda part, own=encoder._ids: asked.extend(part) or own(part))
    monkeypatch.setattr(encoder, "_merged", lambda piece, own=getattr(encoder, "_merged", None): merged.append(piece) or own(piece), raising=False)
    got = encoder.encode(texts[:2]) + encoder.encode(texts[2:])
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert asked == ["the"] * 4  # chunks went to the whole tokenizer, one with each ending
    assert len(merged) == len(set(merged)) == 2 * len(words) + 7  # each word with and without its space; and , ( ). line break, It 's 12


def test_letters_and_signs_are_cut_as_the_library_does(library):
    letters = [chr(c) for c in range(0xD800) if packing._is_word(chr(c))]
    assert len(letters) > 30_000
    signs = [chr(c) for c in range(33, 127)] + ["\n", "\n\n", "é", "'re", "²", "\u0301", "\t"]
    draw = random.Random(7)
    texts = [" ".join(f"{c}.{c}1" for c in letters[i : i + 2000]) for i in range(0, len(letters), 2000)]
    texts += [" ".join("".join(draw.choices(signs, k=draw.randint(0, 6))) for _ in range(40)) for _ in range(600)]
    for text, ids in zip(texts, packing.ChunkEncoder(PATH).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_stretches_do_not_change_places(monkeypatch):
    draw = random.Random(2)
    texts = [None if k % 50 == 9 else " ".join(draw.choice(["ab", "c,", "dé\nf", "", "x" * 9]) for _ in range(draw.randint(0, 60))) for k in range(100)]
    frame = pd.DataFrame({"doc_id": range(100), "text": texts})
    found = []
    for small, chars, gathered in ((8, 1, 1), (8, 700, 7), (8, 1 << 22, 1 << 18)):
        for name, value in (("SMALL_BATCH", small), ("ENCODED_CHARS", chars), ("GATHERED", gathered)):
            monkeypatch.setattr(packing, name, value)
        parts = list(packing._packed(iter([frame, frame[:0]]), PATH, 0, 16, 4))
        assert [len(p) for _, p in parts] == [len(rows) for rows, _ in parts] and len(parts) == 13
        found.append((pd.concat([rows for rows, _ in parts]).to_csv(), [p for _, pieces in parts for p in pieces]))
    assert found[0] == found[1] == found[2]


@pytest.mark.parametrize("n,want", [(1, [(0, 1)]), (2048, [(0, 2048)]), (2049, [(0, 1), (1, 2048)]), (4096, [(0, 2048), (2048, 2048)]), (0, [])])
def test_cut(n, want):
    assert packing.cut(n) == want


def test_bins_are_tight_and_never_overfull():
    draw = random.Random(3)
    for most_open in (1, 2, 64):
        bins, used = packing.OpenBins(100, most_open), {}
        for _ in range(2000):
            length = draw.randint(1, 100)
            sequence, offset = bins.place(length)
            assert used.get(sequence, 0) == offset and offset + length <= 100
            used[sequence] = offset + length
            assert bins._open <= most_open
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 4, 3, 8)] == [(0, 0), (1, 0), (0, 6), (1, 7), (2, 0)]
    bins = packing.OpenBins(10, 2)
    bins.place(6), bins.place(8), bins.place(5)  # the fullest, with 8, closes
    assert bins.place(2) == (0, 6)


def test_pieces_hold_every_token_once(docs_of, library):
    draw = random.Random(9)
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(100 + i, "the cat " * draw.randint(0, 900)) for i in range(80)]
    rows += [(5, AWKWARD[5]), (None, "none")]
    got = packing.pack(docs_of(rows), with_ids=True).toPandas()
    want = {d: library.encode(t or "", add_special_tokens=False).ids + [0] for d, t in rows}
    seen = got[got.doc_id.notna()].sort_values(["doc_id", "piece"])
    for doc, part in seen[seen.doc_id != 5].groupby("doc_id"):
        assert part.piece.tolist() == list(range(len(part)))
        assert [i for ids in part.ids for i in ids] == want[doc]
        assert part.start.tolist() == np.cumsum([0, *part.length[:-1]]).tolist()
        assert (part.length.iloc[1:] == 2048).all() or len(part) == 1
    assert (seen.doc_id == 5).sum() == 2 and got.doc_id.isna().sum() == 1
    for ids, crc in zip(got.ids, got.ids_crc32, strict=True):
        assert zlib.crc32(np.asarray(ids, "<u4").tobytes()) == crc
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == np.cumsum([0, *part.length[:-1]]).tolist() and part.length.sum() <= 2048
    assert got.sequence_id.nunique() <= got.length.sum() / 2048 * 1.1 + 3
    assert packing.pack(docs_of([])).collect() == []
