"""Vectorised work on the bytes of a batch of texts: words, lines and hashes of byte spans."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEED = np.uint64(0xD6E8FEB86659FD93)
#: Masks that keep the first k bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_LONG = 1024  # bytes of a span from which it is hashed alone


def blob(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes and each text's place (n + 1); null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def words(bytes_: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts; a word never crosses texts."""
    inside = ~SPACE[bytes_]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < bytes_.size]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def chunks_at(padded: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number, those beyond ``left`` as 0; ``padded`` ends with eight spare bytes."""
    eights = np.ndarray((padded.size - 7,), dtype="<u8", buffer=padded, strides=(1,))
    return eights[at] & _FIRST[np.minimum(left, 8)]


def padded(bytes_: np.ndarray) -> np.ndarray:
    out = np.zeros(bytes_.size + 8, np.uint8)
    out[: bytes_.size] = bytes_
    return out


def hashes(bytes_: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes at a time are mixed in, each step through a scrambling that isn't
    linear in any ring, so that no rule of the text (powers, complements) makes spans collide."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * _STEP ^ _SEED)
    room = padded(bytes_)
    of = np.flatnonzero((size > 0) & (size <= _LONG))
    at, left = starts[of], size[of]
    while of.size:
        out[of] = mix(out[of] ^ chunks_at(room, at, left)) + _STEP
        more = left > 8
        of, at, left = of[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > _LONG).tolist():
        digest = hashlib.blake2b(bytes_[starts[k] : ends[k]], digest_size=8).digest()
        out[k] = np.frombuffer(digest, dtype=np.uint64)[0]
    return out


def equal(bytes_: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from each of two places are the same."""
    same, room = np.ones(a.size, dtype=bool), padded(bytes_)
    of = np.flatnonzero(size <= _LONG)
    a_at, b_at, left = a[of], b[of], size[of]
    while of.size:
        alike = chunks_at(room, a_at, left) == chunks_at(room, b_at, left)
        same[of[~alike]] = False
        more = alike & (left > 8)
        of, a_at, b_at, left = of[more], a_at[more] + 8, b_at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > _LONG).tolist():
        same[k] = np.array_equal(bytes_[a[k] : a[k] + size[k]], bytes_[b[k] : b[k] + size[k]])
    return same


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(word_hash: np.ndarray, text_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words inside one text, and the word each starts at."""
    count = word_hash.size - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + mix(word_hash[k : k + count])
    at = np.flatnonzero(text_of[:count] == text_of[n - 1 :])
    return mix(total[at]), at


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of a value per byte (or word) over each text."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return upto[at[1:]] - upto[at[:-1]]
