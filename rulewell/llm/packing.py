"""Bounded-space online best-fit packing of tokenized documents into fixed-length sequences.

Each task packs the documents of its own input partition as they come: a fixed number of sequences
is open at a time, a bitset over the free space tells the tightest open sequence that still has
room, and when too many are open the fullest one closes first. No row is moved between tasks, so
there is no shuffle and no group to skew; a task that is run again packs the same rows the same way.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rulewell.llm.bpe import printable_bytes
from rulewell.llm.common import give_back_memory

SEQUENCE_TOKENS = 2048
OPEN_SEQUENCES = 512
# A generation of the cache: so many chunks, or so many characters of them. A task holds two, and lets them go at its end.
CACHE_ENTRIES, CACHE_CHARS = 1 << 18, 1 << 22
# Documents that are put in order before they are packed, characters encoded together, and chunks whose ids are put in place at once.
SMALL_BATCH, ENCODED_CHARS, GATHERED = 512, 1 << 22, 1 << 18
_TASK_SHIFT = 40
# Letters that every version of Unicode has as letters: Latin, Cyrillic, kana, Han, Hangul.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u0513\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
# A chunk of these; one with ASCII signs and single line breaks inside it too; and the vocabulary's pieces of it behind its space.
_is_word = re.compile(f"[{LETTERS}]+").fullmatch
_is_plain = re.compile(f"[!-~{LETTERS}]+(?:\\n[!-~{LETTERS}]+)*").fullmatch
_pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^ \\n0-9{LETTERS}]+|\\n").findall
_BYTE_NAMES = dict(enumerate(printable_bytes()))


class OpenBins:
    """Open sequences by free space; ``place`` returns (sequence, offset) for a piece."""

    def __init__(self, capacity: int = SEQUENCE_TOKENS, most_open: int = OPEN_SEQUENCES, first_id: int = 0):
        self.capacity, self.most_open = capacity, most_open
        self._by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self._bits, self._open, self._next = 0, 0, first_id

    def _take(self, free: int) -> int:
        bins = self._by_free[free]
        found = bins.pop()
        if not bins:
            self._bits &= ~(1 << free)
        self._open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fits = self._bits >> length << length
        if fits:
            free = (fits & -fits).bit_length() - 1  # the least free space that is enough
            sequence = self._take(free)
        else:
            free, sequence = self.capacity, self._next
            self._next += 1
        left = free - length
        if left:
            if self._open >= self.most_open:
                self._take((self._bits & -self._bits).bit_length() - 1)  # the fullest closes
            self._by_free[left].append(sequence)
            self._bits |= 1 << left
            self._open += 1
        return sequence, self.capacity - free


def cut(n_tokens: int, capacity: int = SEQUENCE_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole, or full pieces after a first one that may be shorter."""
    head = n_tokens % capacity if n_tokens > capacity else n_tokens
    bounds = ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n_tokens, capacity)]
    return bounds


class ChunkEncoder:
    """Token ids by the tokenizers library, asked only for chunks not seen before.

    A plain space between two characters that are not both white space always starts a new piece,
    so that the ids of a text are those of its space-separated chunks; other texts go whole. Chunks of
    common characters are cut into the vocabulary's pieces, and its model merges each piece once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, models, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_padding()
        self._tokenizer.no_truncation()
        # Byte-level names write a space as this letter.
        self._opens = np.zeros(self._tokenizer.get_vocab_size(), bool)
        self._opens[[i for name, i in self._tokenizer.get_vocab().items() if name[0] == "\u0120"]] = True
        self._specials = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._unsafe = re.compile(r" (?=\s)(?<=\s )").search
        # The pieces that are cut here are those of this pre-tokenizer; with any other all chunks go to the whole tokenizer.
        self._model, splits = self._tokenizer.model, self._tokenizer.pre_tokenizer
        known_splits = isinstance(splits, pre_tokenizers.ByteLevel) and splits.use_regex and not splits.add_prefix_space
        self._cuts = known_splits and isinstance(self._model, models.BPE) and self._tokenizer.normalizer is None
        # Two generations: a full young one becomes the old one, so chunks in use survive.
        self._known: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        # Pieces that no space opens, of this generation.
        self._inner: dict[str, bytes] = {}
        self._chars = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = []
        for i in range(0, len(texts), 256):
            encoded = self._tokenizer.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)
            found += [array("I", e.ids).tobytes() for e in encoded]
        return found

    def _merged(self, piece: str) -> bytes:
        """Ids of one piece by the vocabulary's model."""
        if piece.isascii() and piece != "\n":  # other ASCII signs are their own names
            named = piece.replace(" ", "\u0120")
        else:
            named = piece.encode().decode("latin-1").translate(_BYTE_NAMES)
        return array("I", [token.id for token in self._model.tokenize(named)]).tobytes()

    def _add_plain(self, chunks: list[str]) -> list[str]:
        """Look up plain chunks piece by piece, so that a piece met before is not merged again; return the other chunks."""
        known, old, inner, others = self._known, self._old, self._inner, []
        for chunk in chunks:
            if chunk.isascii() and chunk.isalpha() or _is_word(chunk):
                if chunk not in known:
                    known[chunk] = self._merged(" " + chunk)
            elif _is_plain(chunk):
                first, *rest = _pieces(" " + chunk)
                head = first[1:]
                if head not in known:
                    known[head] = old.get(head) or self._merged(first)
                for piece in rest:
                    if piece not in inner:
                        inner[piece] = self._merged(piece)
                        self._chars += len(piece)
                if rest:
                    known[chunk] = known[head] + b"".join([inner[p] for p in rest])
            else:
                others.append(chunk)
        return others

    def _chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks behind a space. Many go to the tokenizer as one text, whose ids are cut where a space opens one."""
        found: dict[str, bytes] = {}
        plain = [c for c in chunks if c and not c[0].isspace() and not c[-1].isspace()]
        runs = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        for run, packed in zip(runs, self._ids([" " + " ".join(r) for r in runs]), strict=True):
            starts = (4 * np.flatnonzero(self._opens[np.frombuffer(packed, "<u4")])).tolist()
            if len(starts) == len(run):
                found.update((c, packed[i:j]) for c, i, j in zip(run, starts, [*starts[1:], len(packed)], strict=True))
        alone = [c for c in chunks if c not in found]
        found.update(zip(alone, self._ids([" " + c for c in alone]), strict=True))
        return [found[c] for c in chunks]

    def forget(self) -> None:
        self._known, self._old, self._inner, self._chars = {}, {}, {}, 0
        pa.default_memory_pool().release_unused()
        give_back_memory()

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        known, old = self._known, self._old
        found = list(map(known.get, chunks))
        missing = [c for c, ids in zip(chunks, found, strict=True) if ids is None]
        if not missing:
            return found
        known.update({c: old[c] for c in missing if c in old})
        new = [c for c in missing if c not in known]
        odd = self._add_plain(new) if self._cuts else new
        known.update(zip(odd, self._chunk_ids(odd), strict=True))
        self._chars += sum(map(len, missing))
        return list(map(known.__getitem__, chunks))

    def _after_spaces(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that each follow a space; equal chunks of all texts are looked up once."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        packed = self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        starts, store = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(packed), "<u4")
        which = coded.indices.to_numpy()
        ends = np.cumsum(lengths[which])
        ids = np.empty(ends[-1] if len(ends) else 0, "<u4")
        for i in range(0, len(which), GATHERED):
            part = which[i : i + GATHERED]
            count, first = lengths[part], ends[i] - lengths[which[i]]
            stop = ends[i + len(part) - 1]
            shift = starts[part] - (ends[i : i + len(part)] - count)
            ids[first:stop] = store[np.repeat(shift, count) + np.arange(first, stop)]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy()].tolist()
        return [ids[i:j].tobytes() for i, j in itertools.pairwise(bounds)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; memory is that of the batch and a cache of bounded size."""
        if len(self._known) + len(self._inner) > CACHE_ENTRIES or self._chars > CACHE_CHARS:
            self._known, self._old, self._inner, self._chars = {}, self._known, {}, 0
        whole, firsts, rests = [], {}, {}
        for i, text in enumerate(texts):
            if self._unsafe(text) or any(s in text for s in self._specials):
                whole.append(i)
            else:
                firsts[i], space, rest = text.partition(" ")
                if space:
                    rests[i] = rest
        out: dict[int, bytes] = dict(zip(whole, self._ids([texts[i] for i in whole]), strict=True))
        out.update(zip(firsts, self._ids(list(firsts.values())), strict=True))
        for i, ids in zip(rests, self._after_spaces(list(rests.values())), strict=True):
            out[i] += ids
        return [out[i] for i in range(len(texts))]


@functools.lru_cache(maxsize=4)
def _encoder(path: str | None) -> ChunkEncoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return ChunkEncoder(path)


def _stretches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(start, stop) of neighbouring small batches that are encoded together, so that a chunk of theirs is looked up once."""
    start = chars = 0
    for stop in range(SMALL_BATCH, len(texts) + SMALL_BATCH, SMALL_BATCH):
        chars += sum(map(len, texts[stop - SMALL_BATCH : stop]))
        if chars >= ENCODED_CHARS or stop >= len(texts):
            yield start, min(stop, len(texts))
            start, chars = stop, 0


def _packed(
    batches: Iterator[pd.DataFrame], path: str | None, end_id: int, capacity: int, most_open: int
) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    encoder, end = _encoder(path), np.uint32(end_id).tobytes()
    context = TaskContext.get()
    bins = OpenBins(capacity, most_open, (context.partitionId() if context else 0) << _TASK_SHIFT)
    for batch in batches:
        ids_of, texts = batch["doc_id"], [t or "" for t in batch["text"]]
        for begin, until in _stretches(texts):
            encoded = encoder.encode(texts[begin:until])
            for start in range(begin, until, SMALL_BATCH):
                part, at_part = ids_of.iloc[start : start + SMALL_BATCH], start - begin
                packed = [p + end for p in encoded[at_part : at_part + SMALL_BATCH]]
                # Within a small batch the longer documents go first, which leaves fewer gaps.
                order = sorted(range(len(packed)), key=lambda i: -len(packed[i]))
                rows, pieces = [], []
                for i in order:
                    for piece, (at, length) in enumerate(cut(len(packed[i]) // 4, capacity)):
                        ids = packed[i][4 * at : 4 * (at + length)]
                        rows.append((part.iat[i], piece, at, length, zlib.crc32(ids), *bins.place(length)))
                        pieces.append(ids)
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
                yield pd.DataFrame(rows, columns=names), pieces
    encoder.forget()  # the worker process outlives its tasks


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(
    docs: DataFrame,
    path: str | None = None,
    end_id: int = 0,
    capacity: int = SEQUENCE_TOKENS,
    most_open: int = OPEN_SEQUENCES,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece, with its place in a sequence; ``with_ids`` adds the ids themselves.

    Null text counts as empty and holds the end id alone; repeated rows are packed each; other
    columns are left out; an empty table gives no rows. ``path`` is the vocabulary file as the
    workers see it, by default that of the installed package.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, pieces in _packed(batches, path, end_id, capacity, most_open):
            if with_ids:
                rows = rows.assign(ids=[np.frombuffer(p, "<i4") for p in pieces])
            yield rows

    return docs.select("doc_id", "text").mapInPandas(run, _PIECE + (", ids array<int>" if with_ids else ""))
