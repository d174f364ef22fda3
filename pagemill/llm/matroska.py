"""Matroska media columns: EBML elements with variable-length ids and sizes, clusters, lacing, cues.

mux() stores bytes as 8-bit PCM samples of one audio track: frames of FRAME samples, LACE frames a
block, CLUSTER blocks a cluster, one cue a cluster. demux() reads any Matroska file of known or
unknown sizes into a packet table (track, timestamp, offset, length, keyframe, lacing), whatever
its lacing: none, Xiph, fixed or EBML.

Defined results: null text is the empty text; a payload is never empty (padding fills at least
one unit); repeated rows each give a row; null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_row, pick

UNIT = 64
RATE = 8000
FRAME, LACE, CLUSTER = 512, 8, 16

# Fixed values of the format: element ids.
EBML, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE = 0x4286, 0x42F7, 0x42F2, 0x42F3
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, FLAG_LACING = 0xE1, 0xB5, 0x9F, 0x6264, 0x9C
CLUSTER_ID, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER_ID, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}


def vint(value: int, width: int = 0) -> bytes:
    """A size: the number of leading zero bits tells the width; all ones are kept for unknown."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def signed_vint(value: int) -> bytes:
    """A difference of sizes in EBML lacing."""
    width = next(w for w in range(1, 9) if abs(value) < (1 << 7 * w - 1) - 1 or w == 8)
    return vint(value + (1 << 7 * width - 1) - 1, width)


def read_vint(data: memoryview | bytes, at: int) -> tuple[int, int]:
    """Value and next offset; -1 for an unknown size."""
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"bad size at {at}")
    value = int.from_bytes(data[at : at + width], "big") ^ 1 << 7 * width
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def read_signed(data: memoryview | bytes, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length()
    value = int.from_bytes(data[at : at + width], "big") ^ 1 << 7 * width
    return value - ((1 << 7 * width - 1) - 1), at + width


def read_id(data: memoryview | bytes, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length()
    if width > 4:
        raise ValueError(f"bad element id at {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], how: str) -> bytes:
    """Frames of a block after its header: their number, sizes and bytes."""
    if how == "none":
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if how == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif how == "ebml":
        head += vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1]))
    elif len(set(sizes)) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return head + b"".join(frames)


LACING = {"none": 0, "xiph": 1, "fixed": 2, "ebml": 3}


def block(track: int, after: int, frames: list[bytes], how: str) -> bytes:
    return element(SIMPLE_BLOCK, vint(track) + after.to_bytes(2, "big", signed=True) + bytes([0x80 | LACING[how] << 1]) + laced(frames, how))


def mux(payload: bytes) -> bytes:
    """A Matroska file whose packets, one after another, are payload. Equal payloads, equal files."""
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"pagemill") + element(WRITING_APP, b"pagemill"))
    audio = element(AUDIO, element(SAMPLING, np.array([RATE], ">f8").tobytes()) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    for c in range(0, len(payload), FRAME * LACE * CLUSTER):
        begin, body = c * 1000 // RATE, []
        for b in range(c, min(len(payload), c + FRAME * LACE * CLUSTER), FRAME * LACE):
            frames = [payload[f : f + FRAME] for f in range(b, min(len(payload), b + FRAME * LACE), FRAME)]
            how = "none" if len(frames) == 1 else "fixed" if len(frames[-1]) == FRAME else ("ebml", "xiph")[b // (FRAME * LACE) % 2]
            body.append(block(1, b * 1000 // RATE - begin, frames, how))
        parts.append(element(CLUSTER_ID, number(TIMESTAMP, begin) + b"".join(body)))
        cues.append(element(CUE_POINT, number(CUE_TIME, begin) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


@dataclass
class Media:
    """What a file holds; a packet is (track, timestamp in ms, offset, length, keyframe, lacing)."""

    doc_type: str = ""
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)


def frame_sizes(data: memoryview, at: int, end: int, how: int) -> tuple[list[int], int]:
    if not how:
        return [end - at], at
    n, at = data[at] + 1, at + 1
    if how == 2:
        return [(end - at) // n] * n, at
    sizes = []
    if how == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
            sizes.append(size)
    elif n > 1:
        size, at = read_vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            step, at = read_signed(data, at)
            sizes.append(sizes[-1] + step)
    return [*sizes, end - at - sum(sizes)], at


def demux(raw: bytes) -> Media:
    """Parse a file; raises ValueError where it is broken."""
    data, out = memoryview(raw), Media()
    state = {"segment": 0, "time": 0, "track": {}, "cue": [0, 0, 0]}

    def packets(at: int, end: int, key: bool) -> None:
        track, at = read_vint(data, at)
        after, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
        how = flags >> 1 & 3
        sizes, at = frame_sizes(data, at + 3, end, how)
        begin = (state["time"] + after) * out.scale // 1_000_000
        done, rate = 0, out.tracks.get(track, {}).get("rate", 0)
        for n in sizes:
            if n < 0 or at + n > end:
                raise ValueError("bad lacing")
            out.packets.append((track, begin + (int(done * 1000 // rate) if rate else 0), at, n, key or bool(flags & 0x80), how))
            at, done = at + n, done + n

    def walk(at: int, end: int, up: int) -> None:
        while at < end:
            first = at
            kind, at = read_id(data, at)
            size, at = read_vint(data, at)
            stop = end if size < 0 else at + size
            if stop > end:
                raise ValueError(f"element at {first} runs over its parent")
            uint = lambda: int.from_bytes(data[at:stop], "big")  # noqa: E731, B023
            if kind == SEGMENT:
                state["segment"] = at
            if kind == CLUSTER_ID:
                out.clusters.append(first - state["segment"])
            if kind == TRACK_ENTRY:
                state["track"] = {}
            if kind in MASTERS:
                walk(at, stop, kind)
                if kind == TRACK_ENTRY:
                    out.tracks[state["track"].get("number", 0)] = state["track"]
                elif kind == CUE_POSITIONS:
                    out.cues.append(tuple(state["cue"]))
            elif kind == DOC_TYPE:
                out.doc_type = bytes(data[at:stop]).decode()
            elif kind == TIMESTAMP_SCALE:
                out.scale = uint()
            elif kind == TRACK_NUMBER:
                state["track"]["number"] = uint()
            elif kind == CODEC_ID:
                state["track"]["codec"] = bytes(data[at:stop]).decode()
            elif kind == SAMPLING:
                state["track"]["rate"] = float(np.frombuffer(data[at:stop], ">f8" if stop - at == 8 else ">f4")[0])
            elif kind == BIT_DEPTH:
                state["track"]["bits"] = uint()
            elif kind == TIMESTAMP:
                state["time"] = uint()
            elif kind in (SIMPLE_BLOCK, BLOCK):
                packets(at, stop, kind == BLOCK)
            elif kind == CUE_TIME:
                state["cue"][0] = uint()
            elif kind == CUE_TRACK:
                state["cue"][1] = uint()
            elif kind == CUE_CLUSTER:
                state["cue"][2] = uint()
            at = stop

    walk(0, len(data), 0)
    if out.doc_type not in ("matroska", "webm"):
        raise ValueError("not a Matroska file")
    return out


def payload_of(raw: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(raw[at : at + n] for t, _, at, n, _, _ in media.packets if t == track)


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of text with zero bytes up to a positive multiple of UNIT, and its length before."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT), len(raw)


def features(payload: bytes, media: Media) -> str:
    """Packets, blocks' lacing, length in ms, mean, deviation and zero crossings of the samples about 128."""
    x = np.frombuffer(payload, np.uint8)
    how = np.bincount([p[5] for p in media.packets], minlength=4)
    sign = x >= 128
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};lacing={'/'.join(map(str, how))};ms={len(x) * 1000 // RATE};mean={x.mean():.4f};std={x.std():.4f};crossings={int((sign[1:] != sign[:-1]).sum())}"


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a Matroska file."""

    def make():
        def one(doc_id, text):
            payload, n = padded(text)
            yield doc_id, n, mux(payload)

        return one

    return by_row(pick(docs, doc_id="long", text="string"), make, "doc_id long, n_bytes long, media binary", 100)


def packet_table(media: DataFrame) -> DataFrame:
    """doc_id, packet, track, ts_ms, byte_offset, byte_length, keyframe, lacing of media (doc_id, media); a null or broken file gives no rows."""

    def make():
        def one(doc_id, raw):
            try:
                found = demux(raw or b"")
            except (ValueError, IndexError):
                return
            for k, (track, ts, at, n, key, how) in enumerate(found.packets):
                yield doc_id, k, track, ts, at, n, key, how

        return one

    return by_row(pick(media, doc_id="long", media="binary"), make, "doc_id long, packet int, track int, ts_ms long, byte_offset long, byte_length long, keyframe boolean, lacing int")


def cue_table(media: DataFrame) -> DataFrame:
    """doc_id, ts_ms, track, cluster_offset (from the segment's data) of media (doc_id, media)."""

    def make():
        def one(doc_id, raw):
            try:
                found = demux(raw or b"")
            except (ValueError, IndexError):
                return
            for ts, track, at in found.cues:
                yield doc_id, ts * found.scale // 1_000_000, track, at

        return one

    return by_row(pick(media, doc_id="long", media="binary"), make, "doc_id long, ts_ms long, track int, cluster_offset long")


def digests(docs: DataFrame) -> DataFrame:
    """The columns of op4, all read back from the stored files."""

    def make():
        def one(doc_id, n_bytes, raw):
            found = demux(raw)
            payload = payload_of(raw, found)
            yield doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), features(payload, found)

        return one

    return by_row(media_column(docs), make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
