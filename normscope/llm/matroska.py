"""Media columns: a Matroska writer and reader over binary columns.

``mux`` stores a payload losslessly as unsigned 8-bit PCM in one audio track, with clusters,
all lacing forms and cues. ``parse`` walks the EBML tree of any Matroska/WebM bytes and gives
the packet table: track, timestamp, byte range, cluster and lacing of every frame.

Edge cases, for every function on a DataFrame: a null text or payload counts as empty, which
pads to one unit; texts of any length are stored whole, one file each; an empty table gives an empty table; equal inputs give equal outputs whatever
their row; other columns are neither read nor returned, so their names can't clash. ``parse`` of
bytes that are not EBML gives no packets and ``complete`` false; of cut bytes, the packets that
are whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import base

UNIT = 576  # samples (bytes) of a frame: 12 ms at 48 kHz
RATE = 48_000
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 64

# Element ids of the EBML and Matroska specifications.
EBML, EBML_VERSION, EBML_READ, MAX_ID, MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, LACING_FLAG = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
AUDIO, FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACE, XIPH, FIXED, EBML_LACE = 0x00, 0x02, 0x04, 0x06
LACE_NAMES = {NO_LACE: "none", XIPH: "xiph", FIXED: "fixed", EBML_LACE: "ebml"}


# ---------------------------------------------------------------- writing


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length size; the all-ones pattern, which means unknown, is avoided."""
    n = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return ((1 << 7 * n) | value).to_bytes(n, "big")


def _id(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def element(number: int, body: bytes) -> bytes:
    return _id(number) + vint(len(body)) + body


def uint(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes], kind: int) -> bytes:
    """Lacing head: frame count less one, then the sizes in the form of ``kind``."""
    if kind == NO_LACE:
        return b""
    head, sizes = bytes([len(frames) - 1]), [len(f) for f in frames]
    if kind == XIPH:
        return head + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    if kind == EBML_LACE:
        out = vint(sizes[0])
        for before, now in zip(sizes, sizes[1:-1], strict=False):
            d = now - before
            n = next(w for w in range(1, 9) if abs(d) < (1 << (7 * w - 1)) - 1)
            out += vint(d + (1 << (7 * n - 1)) - 1, n)
        return head + out
    return head


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """Payload (a positive multiple of ``unit`` bytes) as Matroska: 8-bit mono PCM, blocks of up to
    eight frames whose lacing goes round fixed, Xiph and EBML, a cue for every cluster."""
    frames = [payload[i : i + unit] for i in range(0, len(payload), unit)]
    ms = unit * 1000 // RATE
    head = element(
        EBML,
        uint(EBML_VERSION, 1) + uint(EBML_READ, 1) + uint(MAX_ID, 4) + uint(MAX_SIZE, 8)
        + element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ, 2),
    )
    info = element(
        INFO,
        uint(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(ms * len(frames))))
        + element(MUXER, b"normscope") + element(WRITER, b"normscope"),
    )
    audio = element(AUDIO, element(FREQUENCY, struct.pack(">d", float(RATE))) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(
        TRACKS,
        element(
            TRACK,
            uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(LACING_FLAG, 1)
            + uint(DEFAULT_DURATION, ms * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + audio,
        ),
    )
    body, cues, at = [info, tracks], [], len(info) + len(tracks)
    per_cluster = FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for start in range(0, len(frames), per_cluster):
        part = [uint(CLUSTER_TIME, start * ms)]
        for k, first in enumerate(range(start, min(start + per_cluster, len(frames)), FRAMES_PER_BLOCK)):
            inside = frames[first : min(first + FRAMES_PER_BLOCK, start + per_cluster)]
            kind = NO_LACE if len(inside) == 1 else (FIXED, XIPH, EBML_LACE)[k % 3]
            block = vint(1) + struct.pack(">hB", (first - start) * ms, kind | (0x80 if k % 3 < 2 else 0)) + _lace(inside, kind) + b"".join(inside)
            # simple blocks, and a block group for every third, so that both forms occur
            part.append(element(SIMPLE_BLOCK, block) if k % 3 < 2 else element(GROUP, element(BLOCK, block) + uint(BLOCK_DURATION, len(inside) * ms)))
        cluster = element(CLUSTER, b"".join(part))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start * ms) + element(CUE_AT, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


# ---------------------------------------------------------------- reading


@dataclass
class Media:
    """What ``parse`` found. Packets are parallel lists; offsets count from the first byte."""

    doc_type: str = ""
    scale_ns: int = 1_000_000
    tracks: dict[int, dict[str, object]] = field(default_factory=dict)
    track: list[int] = field(default_factory=list)
    time_ns: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    cluster: list[int] = field(default_factory=list)
    lacing: list[str] = field(default_factory=list)
    keyframe: list[bool] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time in ns, track, cluster's offset
    complete: bool = False


def _read_id(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    n = 9 - first.bit_length()
    if n > 4:
        raise ValueError("no element id")
    return int.from_bytes(data[at : at + n], "big"), at + n


def _read_vint(data: bytes, at: int) -> tuple[int, int, int]:
    """Value, place after it and width; an unknown size gives -1."""
    first = data[at]
    n = 9 - first.bit_length()
    if n > 8 or at + n > len(data):
        raise ValueError("no size")
    value = int.from_bytes(data[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (-1 if value == (1 << 7 * n) - 1 else value), at + n, n


def _number(data: bytes, kind: str) -> float | int:
    if kind == "f":
        return struct.unpack(">f" if len(data) == 4 else ">d", data)[0] if data else 0.0
    return int.from_bytes(data, "big")


_CONTAINERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE_POINT, CUE_AT}
_TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}


def parse(data: bytes) -> Media:
    """Packet table of Matroska bytes. Elements of unknown size end where an element of their own
    or a higher level starts; unknown elements are skipped; damaged bytes end the walk."""
    out = Media()
    state: dict[str, object] = {"segment": 0, "cluster_time": 0, "cluster": -1, "entry": {}, "cue": [0, 0, 0], "group_key": []}
    try:
        end = _walk(data, 0, len(data), 0, out, state)
        out.complete = end == len(data) and bool(out.doc_type)
    except (ValueError, IndexError, struct.error):
        out.complete = False
    return out


def _walk(data: bytes, at: int, end: int, parent: int, out: Media, state: dict) -> int:
    while at < end:
        began = at
        number, at = _read_id(data, at)
        size, at, _ = _read_vint(data, at)
        if parent == CLUSTER and number in _TOP:
            return began
        stop = end if size < 0 else at + size
        if stop > end:
            if number not in _CONTAINERS:
                raise ValueError("cut")
            stop = end
            state["cut"] = True
        if number in _CONTAINERS:
            if number == SEGMENT:
                state["segment"] = at
            elif number == CLUSTER:
                state["cluster"] = began
                out.clusters.append(began)
            elif number == TRACK:
                state["entry"] = {}
            elif number == CUE_AT:
                state["cue"][1:] = [0, 0]
            got = _walk(data, at, stop, number, out, state)
            stop = got if size < 0 else stop
            if number == TRACK:
                out.tracks[int(state["entry"].get("number", 0))] = state["entry"]
            elif number == CUE_AT:
                time, track, place = state["cue"]
                out.cues.append((time * out.scale_ns, track, state["segment"] + place))
            if state.get("cut"):
                raise ValueError("cut")
        elif number in (SIMPLE_BLOCK, BLOCK):
            _block(data, at, stop, number == SIMPLE_BLOCK, out, state)
        else:
            _leaf(number, data[at:stop], out, state)
        at = stop
    return at


def _leaf(number: int, body: bytes, out: Media, state: dict) -> None:
    if number == CLUSTER_TIME:
        state["cluster_time"] = _number(body, "u")
    elif number == DOC_TYPE:
        out.doc_type = body.rstrip(b"\0").decode("ascii", "replace")
    elif number == SCALE:
        out.scale_ns = int(_number(body, "u"))
    elif number == CUE_TIME:
        state["cue"][0] = _number(body, "u")
    elif number == CUE_TRACK:
        state["cue"][1] = _number(body, "u")
    elif number == CUE_CLUSTER:
        state["cue"][2] = _number(body, "u")
    elif number == CODEC:
        state["entry"]["codec"] = body.decode("ascii", "replace")
    else:
        name = {TRACK_NUMBER: "number", TRACK_TYPE: "type", CHANNELS: "channels", BIT_DEPTH: "bits", DEFAULT_DURATION: "frame_ns", FREQUENCY: "rate"}.get(number)
        if name:
            state["entry"][name] = _number(body, "f" if number == FREQUENCY else "u")


def _block(data: bytes, at: int, stop: int, simple: bool, out: Media, state: dict) -> None:
    track, at, _ = _read_vint(data, at)
    shift, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags & 0x06
    sizes: list[int] = []
    if kind == NO_LACE:
        sizes = [stop - at]
    else:
        n = data[at] + 1
        at += 1
        if kind == XIPH:
            for _ in range(n - 1):
                size = 0
                while data[at] == 255:
                    size += 255
                    at += 1
                sizes.append(size + data[at])
                at += 1
        elif kind == EBML_LACE:
            size, at, _ = _read_vint(data, at)
            sizes.append(size)
            for _ in range(n - 2):
                raw, at, width = _read_vint(data, at)
                raw = (1 << 7 * width) - 1 if raw < 0 else raw
                size += raw - ((1 << (7 * width - 1)) - 1)
                sizes.append(size)
            sizes = sizes[: n - 1]
        else:
            each, rest = divmod(stop - at, n)
            if rest:
                raise ValueError("unequal fixed lacing")
            sizes = [each] * (n - 1)
        sizes.append(stop - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing beyond the block")
    time = (int(state["cluster_time"]) + shift) * out.scale_ns
    frame_ns = int(out.tracks.get(track, {}).get("frame_ns", 0))
    for k, size in enumerate(sizes):
        out.track.append(track)
        out.time_ns.append(time + k * frame_ns)
        out.offset.append(at)
        out.size.append(size)
        at += size
    n = len(sizes)
    out.cluster += [int(state["cluster"])] * n
    out.lacing += [LACE_NAMES[kind]] * n
    out.keyframe += [not simple or bool(flags & 0x80)] * n


# ---------------------------------------------------------------- DataFrame operators

PACKET_SCHEMA = (
    "id long, packet long, track int, time_ns long, byte_offset long, byte_size long, "
    "cluster_offset long, lacing string, keyframe boolean"
)


def pad(payload: bytes, unit: int = UNIT) -> bytes:
    return payload + b"\xff" * (-len(payload) % unit if payload else unit)


def to_media(df: DataFrame, id_col: str, text_col: str, unit: int = UNIT) -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded with 255, as one Matroska file."""

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        raw = [t.encode() for t in base.texts(batch, "text")]
        return {"id": batch.column("id"), "n_bytes": [len(b) for b in raw], "media": [mux(pad(b, unit), unit) for b in raw]}

    return base.map_arrow(df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), rows, "id long, n_bytes long, media binary")


def packets(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per packet of every media value (``PACKET_SCHEMA``)."""

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        for whole in batches:
            for batch in base.cut(whole, 8 << 20):
                cols: dict[str, list] = {k: [] for k in ("id", "packet", "track", "time_ns", "byte_offset", "byte_size", "cluster_offset", "lacing", "keyframe")}
                for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    m = parse(data or b"")
                    n = len(m.track)
                    cols["id"] += [i] * n
                    cols["packet"] += range(n)
                    for name, got in (("track", m.track), ("time_ns", m.time_ns), ("byte_offset", m.offset), ("byte_size", m.size), ("cluster_offset", m.cluster), ("lacing", m.lacing), ("keyframe", m.keyframe)):
                        cols[name] += got
                yield pa.RecordBatch.from_pydict(cols, schema=to_arrow_schema(schema))

    schema = df.sparkSession.createDataFrame([], PACKET_SCHEMA).schema
    return df.selectExpr(f"`{id_col}` AS id", f"`{media_col}` AS media").mapInArrow(run, PACKET_SCHEMA)


def feature_of(m: Media, payload: bytes) -> str:
    """Counts of the container and integer statistics of the samples, in thousandths."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    n = max(1, x.size)
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    hist = np.bincount(x + 128, minlength=256)
    return (
        f"packets={len(m.track)};clusters={len(m.clusters)};cues={len(m.cues)};end_ms={(m.time_ns[-1] if m.time_ns else 0) // 1_000_000};"
        f"mean={int(x.sum()) * 1000 // n};power={int((x * x).sum()) * 1000 // n};crossings={crossings * 1000 // n};values={int(np.count_nonzero(hist))}"
    )


def read_media(df: DataFrame) -> DataFrame:
    """From ``to_media``'s rows: the payload by the packets' byte ranges, digests and features."""

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets", "cues_ok")}
        for media in batch.column("media").to_pylist():
            m = parse(media)
            payload = b"".join([media[o : o + s] for o, s in zip(m.offset, m.size, strict=True)])
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-32:]))
            out["media_bytes"].append(len(media))
            out["media_sha256"].append(hashlib.sha256(media).hexdigest())
            out["feature"].append(feature_of(m, payload))
            out["n_packets"].append(len(m.track))
            out["cues_ok"].append(m.complete and [c[2] for c in m.cues] == m.clusters)
        return {"id": batch.column("id"), "n_bytes": batch.column("n_bytes")} | out

    return base.map_arrow(
        df, rows,
        "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, cues_ok boolean",
    )
