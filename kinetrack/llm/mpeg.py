"""MPEG audio as a media column: a lossless carrier of bytes and a reader that measures any Layer III stream.

Writer: an ID3v2 tag with the payload's length, a Xing table frame, then one CRC-protected frame per 192 payload
bytes, silent in the decoder's eyes (empty side information), with the payload in the frame's main-data region.
Bit rates alternate, so the stream is variable-bitrate and its table of contents is not a straight line.

Reader (Layer III): parses ID3v2 and ID3v1 tags, resynchronises on frame headers (out of step, a header counts only
if one of the same version and sampling rate, or the stream's end, stands where it says), reads the Xing, Info or VBRI
table, verifies each frame's CRC-16, and gives the exact duration (each frame by its own sampling rate) and the byte
offset of every frame. Free-format frames (no bit rate in the header) are skipped.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, slices

UNIT = 192
# Fixed values of ISO/IEC 11172-3 and 13818-3: bit rates of Layer III in kbit/s (index 1 to 14), sampling rates in Hz.
RATES_V1 = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
RATES_V2 = [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]
HERTZ = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
SIDE = 17  # bytes of side information, MPEG-1 mono
BODY = 4 + 2 + SIDE


def header(kbps: int, protected: bool = True) -> bytes:
    """Frame header: MPEG-1 Layer III, 48 kHz, mono, no padding."""
    return bytes([0xFF, 0xFA if protected else 0xFB, (RATES_V1.index(kbps) + 1) << 4 | 1 << 2, 0xC0])


def crc16(data: np.ndarray) -> np.ndarray:
    """CRC-16 (polynomial 0x8005, from 0xFFFF) of each row of a byte matrix."""
    crc = np.full(len(data), 0xFFFF, np.uint32)
    for col in range(data.shape[1]):
        crc = (crc << np.uint32(8)) & np.uint32(0xFFFF) ^ CRC_TABLE[(crc >> np.uint32(8)) ^ data[:, col]]
    return crc


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << np.uint32(8)
    for _ in range(8):
        out = np.where(out & 0x8000, out << np.uint32(1) ^ np.uint32(0x8005), out << np.uint32(1)) & np.uint32(0xFFFF)
    return out


CRC_TABLE = _crc_table()
#: The two frame sizes in turn: 80 kbit/s (240 bytes) and 96 kbit/s (288 bytes).
TURN = (80, 96)


def _frame(kbps: int) -> np.ndarray:
    out = np.zeros(144_000 * kbps // 48_000, np.uint8)
    out[:4] = np.frombuffer(header(kbps), np.uint8)
    crc = int(crc16(np.concatenate([out[2:4], out[6:BODY]])[None])[0])
    out[4:6] = crc >> 8, crc & 255
    return out


FRAMES = tuple(map(_frame, TURN))


def pad(payload: bytes) -> bytes:
    """Append spaces up to a positive multiple of 192 bytes."""
    return payload + b" " * ((-len(payload)) % UNIT if payload else UNIT)


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def write_mpeg(payload: bytes) -> bytes:
    """A stream that carries ``payload``, padded, and its true length in an ID3v2.4 TXXX frame."""
    data = np.frombuffer(pad(payload), np.uint8).reshape(-1, UNIT)
    n, pair = len(data), sum(map(len, FRAMES))
    body = np.empty(n // 2 * pair + (n % 2) * len(FRAMES[0]), np.uint8)
    both = body[: n // 2 * pair].reshape(-1, pair)
    both[:] = np.concatenate(FRAMES)
    both[:, BODY : BODY + UNIT] = data[0 : n // 2 * 2 : 2]
    both[:, len(FRAMES[0]) + BODY : len(FRAMES[0]) + BODY + UNIT] = data[1::2]
    if n % 2:
        last = body[n // 2 * pair :]
        last[:] = FRAMES[0]
        last[BODY : BODY + UNIT] = data[-1]
    text = b"\x03bytes\x00" + str(len(payload)).encode()
    tag = b"TXXX" + synchsafe(len(text)) + b"\x00\x00" + text
    tag = b"ID3\x04\x00\x00" + synchsafe(len(tag)) + tag
    table = np.zeros(len(FRAMES[1]), np.uint8)
    table[:4] = np.frombuffer(header(TURN[1], protected=False), np.uint8)
    total = len(table) + len(body)
    ends = np.cumsum(np.resize([len(f) for f in FRAMES], n))
    toc = ((len(table) + np.concatenate([[0], ends])[np.arange(100) * n // 100]) * 256 // total).astype(np.uint8)
    xing = b"Xing" + struct.pack(">III", 7, n, total) + toc.tobytes()
    table[4 + SIDE : 4 + SIDE + len(xing)] = np.frombuffer(xing, np.uint8)
    return tag + table.tobytes() + body.tobytes()


@dataclass
class Stream:
    """What a stream holds; ``offsets`` are the byte positions of the audio frames, for seeking."""

    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    samples: int = 0
    hertz: int = 0  # of the first frame
    seconds: Fraction = Fraction(0)
    tags: dict = field(default_factory=dict)
    table: dict | None = None
    bad_crc: int = 0
    skipped: int = 0

    @property
    def duration(self) -> float:
        return float(self.seconds)


def parse_header(h: int) -> tuple[int, int, int, int, bool] | None:
    """Of a 32-bit header: frame bytes, samples, Hz, side information's bytes, protected. None if it is no Layer III header."""
    version, layer, rate, hz = h >> 19 & 3, h >> 17 & 3, h >> 12 & 15, h >> 10 & 3
    if h >> 21 != 0x7FF or version == 1 or layer != 1 or rate in (0, 15) or hz == 3:
        return None
    hertz = HERTZ[version][hz]
    kbps = (RATES_V1 if version == 3 else RATES_V2)[rate - 1]
    samples, mono = (1152, 17) if version == 3 else (576, 9)
    side = mono if h >> 6 & 3 == 3 else {17: 32, 9: 17}[mono]
    return samples // 8 * 1000 * kbps // hertz + (h >> 9 & 1), samples, hertz, side, not h >> 16 & 1


def read_tags(data: bytes) -> tuple[int, dict]:
    """Where audio begins, and the ID3v2 text frames (all leading tags are read)."""
    at, out = 0, {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        size = sum((b & 127) << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
        k, end, v4 = at + 10, min(at + 10 + size, len(data)), data[at + 3] >= 4
        while k + 10 <= end and data[k : k + 1].isalnum():
            n = sum((b & 127) << s for b, s in zip(data[k + 4 : k + 8], (21, 14, 7, 0), strict=True)) if v4 else int.from_bytes(data[k + 4 : k + 8], "big")
            key, value = data[k : k + 4].decode("latin-1"), data[k + 11 : min(k + 10 + n, end)]
            if key == "TXXX" and b"\x00" in value:
                key, value = key + ":" + value.split(b"\x00")[0].decode("utf-8", "replace"), value.split(b"\x00", 1)[1]
            if key[0] == "T":
                out[key] = value.decode("utf-8", "replace")
            k += 10 + n
        at += 10 + size
    return at, out


def read_id3v1(tag: bytes) -> dict:
    """The fields of a 128-byte ID3v1 trailer that are not empty; version 1.1 keeps a track number in the comment's end."""
    out, at = {}, 3
    for name, n in (("title", 30), ("artist", 30), ("album", 30), ("year", 4), ("comment", 30)):
        out["ID3v1:" + name] = tag[at : at + n].split(b"\x00")[0].decode("latin-1").rstrip()
        at += n
    if tag[125] == 0 and tag[126]:
        out["ID3v1:track"] = str(tag[126])
    if tag[127] != 255:
        out["ID3v1:genre"] = str(tag[127])
    return {k: v for k, v in out.items() if v}


def rate_table(frame: bytes, side: int) -> dict | None:
    """The variable-bitrate table in a stream's first frame: Xing or Info behind the side information, VBRI 32 bytes behind the header."""
    if frame[4 + side : 8 + side] in (b"Xing", b"Info"):
        flags, k, out = int.from_bytes(frame[8 + side : 12 + side], "big"), 12 + side, {}
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[key], k = int.from_bytes(frame[k : k + 4], "big"), k + 4
        if flags & 4:
            out["toc"] = list(frame[k : k + 100])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, step = struct.unpack(">IIHHHH", frame[46:62])
        toc = [int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") * scale for k in range(entries)]
        return {"frames": frames, "bytes": size, "frames_per_entry": step, "entry_bytes": toc}
    return None


def read_mpeg(data: bytes) -> Stream:
    """Measure a stream. Bytes that belong to no frame and no tag are counted as ``skipped``; an empty stream has no frames."""
    out = Stream()
    at, out.tags = read_tags(data)
    end = len(data)
    # an ID3v1 trailer counts only where parsing has come to its start: the same bytes within a frame are the frame's
    trailer = end - 128 if data[-128:-125] == b"TAG" else -1
    known: dict[int, tuple | None] = {}
    offsets, sizes, frames = [], [], []
    synced = False
    while at + 4 <= end:
        if at == trailer:
            out.tags |= read_id3v1(data[at:])
            end = at
            break
        h = int.from_bytes(data[at : at + 4], "big")
        info = known[h] if h in known else known.setdefault(h, parse_header(h))
        ok = info is not None and at + info[0] <= end
        if ok and not synced:  # out of sync: the next header has to stand where this one says
            nxt = at + info[0]
            after = parse_header(int.from_bytes(data[nxt : nxt + 4], "big")) if nxt + 4 <= end else None
            ok = nxt in (end, trailer) or after is not None and after[1:3] == info[1:3]
        if not ok:
            synced = False
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            step = trailer if at < trailer < step else step
            out.skipped += step - at
            at = step
            continue
        synced = True
        if not offsets and out.table is None and (table := rate_table(data[at : at + info[0]], 2 * info[4] + info[3])) is not None:
            out.table = table
        else:
            offsets.append(at)
            sizes.append(info[0])
            frames.append(info)
        at += info[0]
    out.skipped += max(0, end - at)
    out.offsets, out.sizes = np.array(offsets, np.int64), np.array(sizes, np.int64)
    out.samples, out.hertz = sum(f[1] for f in frames), frames[0][2] if frames else 0
    out.seconds = sum((Fraction(f[1] * n, f[2]) for f, n in Counter((0, f[1], f[2]) for f in frames).items()), Fraction(0))
    raw = np.frombuffer(data, np.uint8)
    for side in {f[3] for f in frames if f[4]}:
        at_ = np.array([o for o, f in zip(offsets, frames, strict=True) if f[4] and f[3] == side])
        got = raw[at_[:, None] + np.r_[2, 3, 6 : 6 + side]]
        stored = raw[at_ + 4].astype(np.uint32) << np.uint32(8) | raw[at_ + 5]
        out.bad_crc += int((crc16(got) != stored).sum())
    return out


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The padded payload that ``write_mpeg`` stored."""
    raw = np.frombuffer(data, np.uint8)
    return raw[stream.offsets[:, None] + np.arange(BODY, BODY + UNIT)].tobytes() if len(stream.offsets) else b""


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the text's UTF-8 bytes (null: none) as an MPEG stream: doc_id, media binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([write_mpeg(x) for x in byte_rows(part.column(1))], pa.binary())], ["doc_id", "media"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, media binary")


MEASURED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double, n_frames long, seek_every array<long>"


def measure_media(media: DataFrame, seek_step: int = 1) -> DataFrame:
    """Read a media column back: payload and stream digests, exact duration, the offsets of all frames (of each ``seek_step``-th), features.

    Null media counts as an empty stream: no frames, an empty payload, duration 0.
    """

    def one(doc: int, data: bytes) -> tuple:
        s = read_mpeg(data)
        payload = payload_of(data, s)
        seek = s.offsets.astype("<i8").tobytes()
        feature = f"frames={len(s.offsets)};samples={s.samples};hz={s.hertz};bad_crc={s.bad_crc};skipped={s.skipped};vbr={len(set(s.sizes.tolist())) > 1};table={(s.table or {}).get('frames')};toc_crc={zlib.crc32(bytes((s.table or {}).get('toc', [])))};seek_crc={zlib.crc32(seek)}"
        n = int(s.tags.get("TXXX:bytes", len(payload)))
        return doc, n, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), sha256(data).hexdigest(), feature, s.duration, len(s.offsets), s.offsets[::seek_step].tolist()

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("duration_s", pa.float64()), ("n_frames", pa.int64()), ("seek_every", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = [one(d, x or b"") for d, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return media.select("doc_id", "media").mapInArrow(run, MEASURED)
