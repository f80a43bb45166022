"""Byte-level BPE encoding and decoding.

Merging works on a doubly linked list of symbols and a priority queue of (rank, position): the best
pair is popped, an entry whose symbols have changed since it was queued is stale and is skipped, a
merge links the neighbours and queues the two new pairs. Decoding concatenates vocabulary strings.

The vocabulary file is read by each worker from a path that is a parameter; it is not copied here.
Spark spreads the documents; one document is encoded by one task. A text is cut at the plain spaces
that always start a new piece, and what a chunk gives is kept in a cache of bounded size.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

# Fixed value: the pattern that splits text into pieces before merging, as the vocabulary's
# pre-tokenizer defines it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 1 << 19
CACHED_CHARS = 48
# A queue entry is one integer: the rank above the place of the left symbol.
PAIR_SHIFT, PLACE_BITS = 20, 40
PLACE_MASK = (1 << PLACE_BITS) - 1


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def printable_bytes() -> list[str]:
    """The character that stands for each byte in the vocabulary file."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Cache(dict):
    """Chunk to packed ids in two generations: a full young one becomes the old one, so that memory
    stays bounded and chunks in use survive."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self._make, self._old = make, {}

    def __missing__(self, chunk: str) -> bytes:
        packed = self._old.get(chunk)
        if packed is None:
            packed = self._make(chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self._old = dict(self)
                self.clear()
            self[chunk] = packed
        return packed


class ByteBpe:
    """Encoder and decoder for one vocabulary file; ids are packed little-endian unsigned 32-bit."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        alphabet = printable_bytes()
        byte_of = {c: b for b, c in enumerate(alphabet)}
        self._byte_ids = [vocab[c] for c in alphabet]
        self._specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self._specials.values()]) + 1
        self._strings: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self._strings[i] = bytes(byte_of[c] for c in token)
        for token, i in self._specials.items():
            self._strings[i] = token.encode()
        # A merge is known by its rank: pairs to ranks, and ranks to the two symbols and their union.
        self._rank: dict[int, int] = {}
        self._left, self._right, self._joined = [], [], []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self._rank[vocab[left] << PAIR_SHIFT | vocab[right]] = rank
            self._left.append(vocab[left])
            self._right.append(vocab[right])
            self._joined.append(vocab[left + right])
        self._split = regex.compile(PIECES)
        self._special_split = regex.compile("(" + "|".join(map(regex.escape, self._specials)) + ")")
        self._unsafe = re.compile(r"\s \s").search
        self._pieces = _Cache(self._encode_piece)
        self._chunks = _Cache(self._encode_spaced)

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges to one piece, lowest rank first, leftmost first among equals."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, lefts, rights, unions = self._rank.get, self._left, self._right, self._joined
        queue = []
        for i in range(n - 1):
            rank = ranks(symbols[i] << PAIR_SHIFT | symbols[i + 1])
            if rank is not None:
                queue.append(rank << PLACE_BITS | i)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            rank, i = entry >> PLACE_BITS, entry & PLACE_MASK
            j = after[i]
            if symbols[i] != lefts[rank] or j >= n or symbols[j] != rights[rank]:
                continue  # stale: one of the two symbols has been merged away
            symbols[i], symbols[j] = union, _ = unions[rank], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks(union << PAIR_SHIFT | symbols[k])
                if rank is not None:
                    heapq.heappush(queue, rank << PLACE_BITS | i)
            h = before[i]
            if h >= 0:
                rank = ranks(symbols[h] << PAIR_SHIFT | union)
                if rank is not None:
                    heapq.heappush(queue, rank << PLACE_BITS | h)
        return [s for s in symbols if s >= 0]

    def _encode_piece(self, piece: str) -> bytes:
        ids = self.merge([self._byte_ids[b] for b in piece.encode("utf-8", "replace")])
        return array("I", ids).tobytes()

    def _encode_spaced(self, chunk: str) -> bytes:
        """Ids of a chunk with the space before it; words are kept once, whatever ends them."""
        if chunk.isalpha():
            return self._encode_piece(" " + chunk)
        return b"".join(
            self._chunks[p[1:]] if p[0] == " " and p[1:].isalpha() else self._pieces[p]
            for p in self._split.findall(" " + chunk)
        )

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text; special strings in it become their ids."""
        if any(s in text for s in self._specials):
            parts = self._special_split.split(text)
            return b"".join(
                np.uint32(self._specials[p]).tobytes() if p in self._specials else self._encode_plain(p)
                for p in parts
            )
        return self._encode_plain(text)

    def _encode_plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self._unsafe(text):  # a space inside a longer run of white space
            return b"".join(map(self._pieces.__getitem__, self._split.findall(text)))
        first, *rest = text.split(" ")
        head = b"".join(map(self._pieces.__getitem__, self._split.findall(first)))
        return head + b"".join(map(self._chunks.__getitem__, rest))

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self._strings.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def load(path: str | None = None) -> ByteBpe:
    """One codec per worker process and file."""
    return ByteBpe(path or default_path())


def tokenize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, ids (array of int) and the decoded text.

    Null text counts as empty and has no ids; repeated rows are encoded each; other columns are
    left out. Works batch by batch, so a task holds one Arrow batch and a bounded cache.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = load(path)
        for batch in batches:
            packed = [codec.encode(t or "") for t in batch["text"]]
            ids = [np.frombuffer(p, "<i4") for p in packed]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids, "decoded": [codec.decode(p) for p in packed]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode, then decode, every text; return counts and SHA-256 digests instead of the ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = load(path)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                packed = codec.encode(text or "")
                decoded = codec.decode(packed).encode("utf-8", "replace")
                rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInPandas(run, schema)
