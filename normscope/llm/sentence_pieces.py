"""SentencePiece encoding and decoding that keeps source offsets.

The model's normaliser is run here: longest-prefix matches in its compiled character map (a double
array of bytes) rewrite the text and record, for each normalised byte, the source byte it came
from. Ids are the library's; every piece is laid on the normalised text by its length and projected
through that record, so pieces tile the source bytes. Byte pieces cover one byte each.

Edge cases: a null or empty text has only the end id, no span beyond it, and decodes to the empty
text; very long texts are encoded whole; repeated rows give repeated rows; an empty table gives an
empty one; other columns are neither read nor returned.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .bpe_units import sentence_pieces

MARK = "▁".encode()


class CharacterMap:
    """The compiled character map: a double-array trie of sources, then NUL-ended targets."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self._units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self._targets = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and target of the longest source that starts at ``at``."""
        units, best = self._units, None
        if not units:
            return None
        node = _offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= _offset(unit)
            if unit >> 8 & 1:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self._targets[best[1] : self._targets.index(b"\0", best[1])]


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


def _character(data: bytes, at: int) -> tuple[int, bytes]:
    """Length and bytes of one character; a broken byte becomes U+FFFD."""
    first = data[at]
    n = 1 if first < 0x80 else 2 if first >> 5 == 6 else 3 if first >> 4 == 14 else 4 if first >> 3 == 30 else 1
    try:
        data[at : at + n].decode()
        return n, data[at : at + n]
    except UnicodeDecodeError:
        return 1, "�".encode()


class Normalizer:
    """The normaliser of a model: ``normalize`` gives the bytes and, for each and the end, the
    source byte."""

    def __init__(self, spec, suffix: bool = False):
        self._map = CharacterMap(spec.precompiled_charsmap)
        self.plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and not suffix
        self._prefix, self._remove, self._suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, suffix
        self._space = MARK if spec.escape_whitespaces else b" "

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        data, at = text.encode(), 0
        if self._remove:
            while at < len(data):
                n, to = self._step(data, at)
                if to != b" ":
                    break
                at += n
        out, source = bytearray(), []
        if at >= len(data):
            return b"", np.array([at])

        def put(piece: bytes) -> None:
            piece = piece.replace(b" ", self._space)
            out.extend(piece)
            source.extend([at] * len(piece))

        if self._prefix and not self._suffix:
            put(b" ")
        after_space = self._remove
        while at < len(data):
            n, to = self._step(data, at)
            if after_space:
                to = to.lstrip(b" ")
            if to:
                put(to)
                after_space = self._remove and to.endswith(b" ")
            at += n
        end = at
        if self._remove:
            while out.endswith(self._space):
                end = source[-len(self._space)]
                del out[-len(self._space) :], source[-len(self._space) :]
        if self._prefix and self._suffix:
            at = end
            put(b" ")
        return bytes(out), np.array([*source, end])

    def _step(self, data: bytes, at: int) -> tuple[int, bytes]:
        return self._map.longest(data, at) or _character(data, at)

    def align(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For a batch: source byte (from the batch's first) of every normalised byte, and where
        each text's normalised bytes start (n + 1)."""
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if self.plain:
            blob = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
            width = np.ones(blob.size, dtype=np.int8)
            width[blob == 32] = len(self._space)
            starts = at[:-1][at[:-1] < at[1:]] - at[0]
            if self._prefix:
                width[starts] += len(self._space)
            source = np.repeat(np.arange(blob.size, dtype=np.int32), width)
            upto = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
            return source, upto[at - at[0]]
        parts, ends = [], [0]
        for text, start in zip(texts.to_pylist(), (at[:-1] - at[0]).tolist(), strict=True):
            _, source = self.normalize(text)
            parts.append(source[:-1] + start)
            ends.append(ends[-1] + source.size - 1)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(ends)


class OffsetEncoder:
    """Ids, piece ends in source bytes and the decoded text for batches of texts."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto.FromString(model)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalizer = Normalizer(spec.normalizer_spec, spec.trainer_spec.treat_whitespace_as_suffix)
        self._encoder = sentence_pieces(model)
        single = {pb.ModelProto.SentencePiece.BYTE}
        self._length = np.array([1 if p.type in single else len(p.piece.encode()) for p in spec.pieces], dtype=np.int64)
        self._end = self.processor.eos_id()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with each text's end id, ends in source bytes of their text, and text offsets."""
        texts = texts.fill_null("") if texts.null_count else texts
        n = len(texts)
        ids, at = self._encoder.encode_arrow(texts)
        source, norm_at = self.normalizer.align(texts)
        length = self._length[ids]
        upto = np.concatenate([[0], np.cumsum(length)])
        if not np.array_equal(upto[at], norm_at):  # a piece of unknown length
            upto = self._by_library(texts, at, norm_at)
        byte_at = np.concatenate([[0], np.cumsum(_byte_lengths(texts))])
        ends = np.append(source, byte_at[-1])[upto[1:]].astype(np.int64)
        nonempty = at[1:] > at[:-1]
        ends[at[1:][nonempty] - 1] = byte_at[1:][nonempty]
        text_of = np.repeat(np.arange(n), np.diff(at))
        ends -= byte_at[text_of]
        out_at = at + np.arange(n + 1)
        out_ids = np.full(ids.size + n, self._end, dtype=np.int32)
        out_ends = np.repeat(np.diff(byte_at), 1)
        place = np.arange(ids.size) + text_of
        out_ids[place] = ids
        all_ends = np.empty(ids.size + n, dtype=np.int32)
        all_ends[place] = ends
        all_ends[out_at[1:] - 1] = out_ends
        return out_ids, all_ends, out_at

    def _by_library(self, texts: pa.Array, at: np.ndarray, norm_at: np.ndarray) -> np.ndarray:
        upto = [0]
        for i, text in enumerate(texts.to_pylist()):
            lengths = [len(p.piece.encode()) if p.id != self.processor.unk_id() or p.piece != "<unk>" else len(p.surface.encode()) for p in self.processor.encode(text, out_type="immutable_proto").pieces]
            upto += (np.cumsum(lengths) + norm_at[i]).tolist() if lengths else []
        return np.minimum(np.array(upto), norm_at[-1])

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        flat = ids.tolist()
        return self.processor.decode([flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], num_threads=1) if at.size > 1 else []


def _byte_lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.binary_length(texts)).astype(np.int64)


def encode(df: DataFrame, id_col: str, text_col: str, model_path: str) -> DataFrame:
    """(id, ids array<int>, ends array<int>, decoded): ids end with the end id; ``ends[k]`` is the
    source byte after piece k, which starts where piece k - 1 ends."""
    model = df.sparkSession.sparkContext.broadcast(base.read_bytes(model_path))  # a model file: some MB at most

    def run(batches):
        encoder = _encoder(model.value)
        for whole in batches:
            for batch in base.cut(whole, 1 << 19):
                text = batch.column(1).fill_null("")
                ids, ends, at = encoder.encode(text)
                offsets = pa.array(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(ends)), pa.array(encoder.decode(ids, at), pa.string())],
                    names=["id", "ids", "ends", "decoded"],
                )

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids array<int>, ends array<int>, decoded string")


_ENCODERS: dict[bytes, OffsetEncoder] = {}


def _encoder(model: bytes) -> OffsetEncoder:
    """One for each Python worker, with its cache of units."""
    if model not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[model] = OffsetEncoder(model)
    return _ENCODERS[model]
