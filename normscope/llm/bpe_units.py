"""Exact BPE over whole batches through a cache of text units.

A merge never crosses a place where a single space stands before a visible character (there a new
pre-token or piece begins). So a text can be cut at such places, each distinct unit be encoded
once by the library and the units' ids be joined. Cutting, hashing and joining are numpy
operations over a batch's UTF-8 bytes; the library only sees units that this worker has not met.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import spans

SEGMENT = 1 << 17  # bytes hashed at once: the arrays stay in cache
LONGEST_KEPT = 512  # bytes of a unit that is worth keeping
TABLE_BITS = 21
POOL_LIMIT = 1 << 24  # ids, or numbers of eight bytes, that are kept

#: Bytes that may follow the space of a cut: visible ASCII, and the first bytes of U+00C0 to
#: U+0FFF, where no white space lies. Elsewhere no cut is made, which is always right.
_SAFE = np.zeros(256, dtype=bool)
_SAFE[0x21:0x7F] = True
_SAFE[0xC3:0xE1] = True

_FIRST_UNIT = np.uint64(0xA24BAED4963EE407)  # tells a text's first unit from the same bytes elsewhere


class UnitEncoder:
    """``encode_units(units, firsts)`` gives the ids of each unit: its text with the space
    in front, or the start of a text (first). ``apart`` also asks that no space or piece mark
    stands before a cut, for vocabularies whose pieces join spaces. Texts that hold one of ``uncut``
    stay whole. Units up to LONGEST_KEPT bytes are kept in an open-addressing table of bounded size; a
    hash finds a unit's place, and then its bytes are compared, so equal hashes never pass for equal units."""

    def __init__(self, encode_units: Callable[[list[str], list[bool]], list[list[int]]], apart: bool = False, whole: bool = False, limit: int = 1_000_000, uncut: tuple[str, ...] = ()):
        self._encode, self._apart, self._whole, self._uncut = encode_units, apart, whole, uncut
        self._limit = min(limit, (1 << TABLE_BITS) * 6 // 10)
        self._reset()

    def _reset(self) -> None:
        self._keys = np.zeros(1 << TABLE_BITS, dtype=np.uint64)  # 0: empty
        self._slots = np.zeros(1 << TABLE_BITS, dtype=np.int32)
        self._start = np.zeros(1024, dtype=np.int64)  # of a slot's ids
        self._size = np.zeros(1024, dtype=np.int32)
        self._pool = np.zeros(8192, dtype=np.uint32)
        self._text_at = np.zeros(1024, dtype=np.int64)  # of a slot's bytes, eight in a number
        self._text_size = np.zeros(1024, dtype=np.int32)
        self._first = np.zeros(1024, dtype=bool)
        self._text = np.zeros(8192, dtype=np.uint64)
        self._used = self._filled = self._written = 0

    def encode_arrow(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the place of each text's first id (n + 1)."""
        if texts.null_count:
            texts = texts.fill_null("")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        blob = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        uncut = np.zeros(len(texts), dtype=bool)
        for sign in self._uncut:
            uncut |= pc.match_substring(texts, sign).to_numpy(zero_copy_only=False)
        return self.encode(blob, at - at[0], uncut)

    def encode(self, blob: np.ndarray, offsets: np.ndarray, uncut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        starts, firsts = self._cut(blob, offsets)
        if uncut is not None and uncut.any():
            keep = firsts | ~uncut[np.searchsorted(offsets, starts, side="right") - 1]
            starts, firsts = starts[keep], firsts[keep]
        ends = np.append(starts[1:], blob.size)
        ids, counts, a = [], [], 0
        while a < starts.size:
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + SEGMENT, side="right")))
            got, n = self._segment(blob, starts[a:b], ends[a:b], firsts[a:b])
            ids.append(got)
            counts.append(n)
            a = b
        upto = np.concatenate([[0], np.cumsum(np.concatenate(counts), dtype=np.int64)]) if counts else np.zeros(1, np.int64)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), upto[np.searchsorted(starts, offsets, side="left")]

    def _cut(self, blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        if self._whole or blob.size < 2:
            return first, np.ones(first.size, dtype=bool)
        at = np.flatnonzero(blob[:-1] == 32)
        at = at[_SAFE[blob[at + 1]]]
        if self._apart:
            before = blob[np.maximum(at - 1, 0)]
            at = at[(before != 32) & (before != 0x81)]
        # not a space that ends a text, and not one that starts a text, which is there anyway
        near = np.searchsorted(first, at, side="right") - 1
        starts_text = first[np.maximum(near, 0)] == at
        ends_text = np.append(first[1:], blob.size)[np.maximum(near, 0)] == at + 1
        at = at[~(starts_text | ends_text)]
        starts = np.concatenate([first, at])
        order = np.argsort(starts, kind="stable")
        return starts[order], order < first.size

    def _segment(self, blob, starts, ends, firsts) -> tuple[np.ndarray, np.ndarray]:
        part = blob[starts[0] : ends[-1]]
        s, size = starts - starts[0], ends - starts
        if self._used > self._limit or max(self._filled, self._written) > POOL_LIMIT:
            self._reset()
        room = spans.padded(part)
        of = np.full(s.size, -1, dtype=np.int64)
        long = size > LONGEST_KEPT
        if long.any():
            of[long] = self._add(room, s, size, firsts, np.flatnonzero(long), None)
        short = np.flatnonzero(~long)
        if short.size:
            key = spans.hashes(part, s[short], s[short] + size[short]) ^ (firsts[short] * _FIRST_UNIT)
            key[key == 0] = 1
            found = self._look_up(key)
            missing = np.flatnonzero(found < 0)
            if missing.size:
                distinct, first_at, inverse = np.unique(key[missing], return_index=True, return_inverse=True)
                found[missing] = self._add(room, s, size, firsts, short[missing[first_at]], distinct)[inverse]
            wrong = self._others(room, s[short], size[short], firsts[short], found)
            if wrong.size:  # equal hashes of different units
                found[wrong] = self._add(room, s, size, firsts, short[wrong], None)
            of[short] = found
        n = self._size[of].astype(np.int64)
        upto = np.cumsum(n)
        place = np.repeat(self._start[of] - upto + n, n)
        place += np.arange(place.size)
        return self._pool[place], n

    def _others(self, room, s, size, firsts, of) -> np.ndarray:
        """The units whose bytes aren't those of their slots."""
        same = (self._text_size[of] == size) & (self._first[of] == firsts)
        going = np.flatnonzero(same)
        at, left, there = s[going], size[going], self._text_at[of[going]]
        while going.size:
            equal = spans.chunks_at(room, at, left) == self._text[there]
            same[going[~equal]] = False
            more = equal & (left > 8)
            going, at, left, there = going[more], at[more] + 8, left[more] - 8, there[more] + 1
        return np.flatnonzero(~same)

    def _look_up(self, key: np.ndarray) -> np.ndarray:
        at = (key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        found = self._keys[at]
        out = np.where(found == key, self._slots[at], -1).astype(np.int64)
        going = np.flatnonzero((found != key) & (found != 0))
        while going.size:
            at[going] = (at[going] + 1) & ((1 << TABLE_BITS) - 1)
            found = self._keys[at[going]]
            same = found == key[going]
            out[going[same]] = self._slots[at[going[same]]]
            going = going[~same & (found != 0)]
        return out

    def _insert(self, key: np.ndarray, slots: np.ndarray) -> None:
        at = (key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        going = np.arange(key.size)
        while going.size:
            free = going[self._keys[at[going]] == 0]
            _, one = np.unique(at[free], return_index=True)  # one key for each free place
            put = free[one]
            self._keys[at[put]] = key[put]
            self._slots[at[put]] = slots[put]
            going = going[self._keys[at[going]] != key[going]]
            at[going] = (at[going] + 1) & ((1 << TABLE_BITS) - 1)

    def _add(self, room, s, size, firsts, which, keys) -> np.ndarray:
        """Slots of units that are encoded now; ``keys``, of units of LONGEST_KEPT bytes at most, are kept."""
        s, size, firsts = s[which], size[which], firsts[which]
        raw = room.tobytes()
        made = self._encode([raw[a:b].decode() for a, b in zip(s.tolist(), (s + size).tolist(), strict=True)], firsts.tolist())
        n, sizes = len(made), np.fromiter(map(len, made), np.int64, len(made))
        chunks = np.where(size <= LONGEST_KEPT, (size + 7) // 8, 0)
        slots = np.arange(self._used, self._used + n)
        for name in ("_start", "_size", "_text_at", "_text_size", "_first"):
            setattr(self, name, _room(getattr(self, name), self._used + n))
        self._pool = _room(self._pool, self._filled + int(sizes.sum()))
        self._text = _room(self._text, self._written + int(chunks.sum()))
        self._size[slots], self._text_size[slots], self._first[slots] = sizes, size, firsts
        self._start[slots] = self._filled + np.cumsum(sizes) - sizes
        self._text_at[slots] = self._written + np.cumsum(chunks) - chunks
        if n:
            self._pool[self._filled : self._filled + int(sizes.sum())] = np.fromiter(chain.from_iterable(made), np.uint32, int(sizes.sum()))
        step = 8 * (np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks))
        self._text[self._written : self._written + step.size] = spans.chunks_at(room, np.repeat(s, chunks) + step, np.repeat(size, chunks) - step)
        self._used += n
        self._filled += int(sizes.sum())
        self._written += step.size
        if keys is not None:
            self._insert(keys, slots)
        return slots


def _room(x: np.ndarray, n: int) -> np.ndarray:
    if n <= x.size:
        return x
    out = np.zeros(max(n, 2 * x.size), dtype=x.dtype)
    out[: x.size] = x
    return out


# ---------------------------------------------------------------- libraries


def byte_level(spec: str) -> UnitEncoder:
    """For the JSON of a ``tokenizers`` file, run by that library: unit by unit where it is a plain byte-level
    BPE, else whole text by whole text. Texts that hold an added token's string are never cut."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel ones
    from tokenizers import Tokenizer

    tokenizer, parts = Tokenizer.from_str(spec), json.loads(spec)
    plain, model, names = _is_plain(parts), tokenizer.model, _byte_names()
    added = tuple(t["content"] for t in parts["added_tokens"])
    direct = plain and not any(_PLAIN.fullmatch(t) for t in added)
    signs: dict[str, list[int]] = {"": []}

    def encode(units: list[str], _: list[bool]) -> list[list[int]]:
        """A unit of Latin letters, or digits, and signs after them is one pre-token or two, which go to the
        library's model at once."""
        out: list = [None] * len(units)
        rest = []
        for k, unit in enumerate(units):
            found = _PLAIN.fullmatch(unit) if direct else None
            if found is None:
                rest.append(k)
                continue
            word, after = found.groups()
            shown = word.replace(" ", names[32]) if word.isascii() else word.encode().decode("latin-1").translate(names)
            if after not in signs:
                if len(signs) > 10_000:
                    signs.clear()
                signs[after] = [t.id for t in model.tokenize(after)] if after else []
            out[k] = [t.id for t in model.tokenize(shown)] + signs[after]
        for k, x in zip(rest, tokenizer.encode_batch_fast([units[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = x.ids
        return out

    return UnitEncoder(encode, whole=not plain, uncut=added)


#: Letters of every Unicode version, or digits, perhaps after a space, then ASCII signs without the apostrophe: the
#: pre-tokenizer's pattern takes all letters or digits, and then all signs.
_PLAIN = re.compile(r"( ?(?:[A-Za-zÀ-ÖØ-öø-ƿ]+|[0-9]+))([!-&(-/:-@\[-`{-~]*)")


def _byte_names() -> dict[int, str]:
    """The sign of each byte in byte-level vocabularies: printable Latin-1 signs name themselves, all other
    bytes are named by the signs from U+0100 on, in order. ``translate`` is slow at what a table lacks: all are in it."""
    others = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD)]
    return {b: chr(b) for b in range(256)} | {b: chr(0x100 + i) for i, b in enumerate(others)}


def _is_plain(parts: dict) -> bool:
    """Whether the byte-level pre-tokenizer alone cuts texts, so that a new pre-token begins at every cut."""
    model, pre = parts["model"], parts.get("pre_tokenizer") or {}
    return (
        model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and parts.get("normalizer") is None
        and not any(parts.get(k) for k in ("truncation", "padding")) and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in parts["added_tokens"])
    )


def sentence_pieces(model: bytes) -> UnitEncoder:
    """For the bytes of a sentencepiece model. Units are used when the normaliser only escapes
    spaces and adds one in front, and no piece has a space mark after another sign."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    spec = pb.ModelProto.FromString(model)
    n = spec.normalizer_spec
    mark = "▁"
    apart = all(mark not in p.piece.lstrip(mark) for p in spec.pieces)
    units_hold = (
        spec.trainer_spec.model_type == pb.TrainerSpec.BPE and apart and not n.precompiled_charsmap and n.add_dummy_prefix
        and n.escape_whitespaces and not n.remove_extra_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix
        and not any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in spec.pieces)
    )

    def encode(units: list[str], firsts: list[bool]) -> list[list[int]]:
        shown = [u if first else u[1:] for u, first in zip(units, firsts, strict=True)]
        return processor.encode(shown, num_threads=1)

    return UnitEncoder(encode, apart=True, whole=not units_hold, limit=250_000)
