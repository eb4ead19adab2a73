"""MPEG audio columns: writing payloads as valid frames, and parsing any stream back.

The writer makes silent MPEG-1 Layer III frames (80 kbit/s, 48 kHz, mono, with
checksums). A frame's granules declare no main data, which leaves the bytes
after the side information to ancillary data; those hold 192 payload bytes each. An
ID3v2 tag and a variable-bitrate table precede the frames.

The parser reads ID3 tags and Xing, Info and VBRI tables, resynchronises on
frame headers of MPEG 1, 2 and 2.5, layers I to III, verifies checksums where
headers announce them, and gives exact durations and frame offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame

from terrane.llm.common import batch_of, id_type, map_batches, schema, slices, stored, texts

UNIT = 192  # payload bytes a frame

# Fixed values of the format: kbit/s by (low sampling rate, layer), sampling rates by version, samples a frame.
BITRATES = {
    (False, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (False, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (False, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (True, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (True, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (True, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(False, 1): 384, (False, 2): 1152, (False, 3): 1152, (True, 1): 384, (True, 2): 1152, (True, 3): 576}


def _crc_table() -> np.ndarray:
    table = np.zeros(256, np.uint16)
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1 & 0xFFFF
        table[b] = c
    return table


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The format's CRC-16 of each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, np.uint16)
    for column in rows.T:
        crc = (crc << np.uint16(8)) ^ _CRC[(crc >> np.uint16(8)).astype(np.uint8) ^ column]
    return crc


def crc16_bits(data: bytes, bits: int, crc: int = 0xFFFF) -> int:
    """The format's CRC-16 of the first bits of data."""
    for i in range(bits):
        top = crc >> 15 ^ data[i >> 3] >> (7 - (i & 7)) & 1
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


@dataclass(frozen=True)
class Header:
    version: int  # as in the bits: 3 is MPEG-1, 2 is MPEG-2, 0 is MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    length: int
    samples: int
    joint: int = 0  # in joint stereo, the subbands that channels do not share; 0 otherwise

    @property
    def side_info(self) -> int:
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


def header_at(data: bytes, at: int) -> Header | None:
    """The frame header at a position; None if these bytes are none (free-format streams included)."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
    version, layer = b1 >> 3 & 3, 4 - (b1 >> 1 & 3)
    rate, bits = b2 >> 2 & 3, b2 >> 4
    if version == 1 or layer == 4 or rate == 3 or bits in (0, 15):
        return None
    low = version != 3
    kbps, hz, samples = BITRATES[low, layer][bits], RATES[version][rate], SAMPLES[low, layer]
    pad = b2 >> 1 & 1
    length = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    joint = 4 * ((b3 >> 4 & 3) + 1) if b3 >> 6 == 1 else 0
    return Header(version, layer, not b1 & 1, kbps, hz, b3 >> 6 == 3, length, samples, joint)


# Fixed values of layer II: runs of (subbands, bits of an allocation) by table.
ALLOCATIONS = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "low": ((4, 4), (7, 3), (19, 2))}


def checked_bits(body: bytes, header: Header) -> int:
    """How many bits after a frame's checksum it covers; -1 if the frame ends before.

    Layer I: the allocations of 32 subbands. Layer II: the allocations and two bits for each that is not zero. Layer III: the side information.
    """
    if header.layer == 3:
        bits = 8 * header.side_info
    elif header.layer == 1:
        shared = 32 if header.mono else header.joint
        bits = 4 * (32 if header.mono else 64 if not shared else shared + 32)
    else:
        each = header.kbps if header.mono else header.kbps // 2
        if header.version != 3:
            table = "low"
        elif each <= 48:
            table = "d" if header.rate == 32000 else "c"
        else:
            table = "a" if header.rate == 48000 or each <= 80 else "b"
        widths = [w for n, w in ALLOCATIONS[table] for _ in range(n)]
        at = used = 0
        word, size = int.from_bytes(body, "big"), 8 * len(body)
        for subband, width in enumerate(widths):
            apart = not header.mono and (not header.joint or subband < header.joint)
            for _ in range(2 if apart else 1):
                if at + width > size:
                    return -1
                value = word >> (size - at - width) & ((1 << width) - 1)
                # A shared allocation has a scale selection for each channel.
                used += (value > 0) * (1 if apart or header.mono else 2)
                at += width
        bits = at + 2 * used
    return bits if bits <= 8 * len(body) else -1


def check_holds(frame: bytes, header: Header) -> bool:
    """Whether a protected frame's checksum is that of its header's last two bytes and the bits it covers."""
    bits = checked_bits(frame[6 : 6 + 128], header)
    return bits >= 0 and crc16_bits(frame[6:], bits, crc16_bits(frame[2:4], 16)) == frame[4] << 8 | frame[5]


@dataclass
class Stream:
    header: Header | None = None
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    duration: Fraction = Fraction(0)
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int | bytes] = field(default_factory=dict)
    checked: int = 0
    bad_checks: int = 0
    resyncs: int = 0


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _tags(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of leading ID3v2 tags, and where the audio may begin."""
    tags, at = {}, 0
    while data[at : at + 3] == b"ID3" and at + 10 <= len(data):
        major, end = data[at + 3], at + 10 + _synchsafe(data[at + 6 : at + 10])
        i = at + 10
        while i + 10 <= min(end, len(data)) and data[i] and major >= 3:
            size = _synchsafe(data[i + 4 : i + 8]) if major == 4 else struct.unpack(">I", data[i + 4 : i + 8])[0]
            name, body = data[i : i + 4].decode("latin-1"), data[i + 10 : i + 10 + size]
            if name[0] == "T" and body:
                text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
                if name == "TXXX":
                    name, _, text = text.partition("\0")
                tags[name] = text.strip("\0")
            i += 10 + size
        at = end + (10 if data[at + 5] & 0x10 else 0)
    return tags, at


def _table(frame: bytes, header: Header) -> dict:
    """The variable-bitrate table in a stream's first frame, if it holds one; of a table cut short, what is there."""
    for shift in (2, 0) if header.protected else (0,):
        i = 4 + shift + header.side_info
        if frame[i : i + 4] in (b"Xing", b"Info") and len(frame) >= i + 8:
            out: dict = {"kind": frame[i : i + 4].decode()}
            flags, i = struct.unpack(">I", frame[i + 4 : i + 8])[0], i + 8
            for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100)):
                if flags & bit and len(frame) >= i + size:
                    out[name], i = frame[i : i + size] if bit == 4 else struct.unpack(">I", frame[i : i + 4])[0], i + size
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 54:
        size, frames = struct.unpack(">II", frame[46:54])
        return {"kind": "VBRI", "bytes": size, "frames": frames}
    return {}


def parse(data: bytes) -> Stream:
    """What a stream holds. Bytes that are no frame are skipped to the next header whose frame ends at
    another header or at the end; a stream without frames has no header and no duration. A trailing ID3v1
    tag is left out, unless its mark lies inside a frame."""
    out = Stream()
    out.tags, at = _tags(data)
    raw = np.frombuffer(data, np.uint8)
    end = len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
    offsets, lengths, sync = [], [], True
    while at < end:
        head = header_at(data, at)
        if head and end < at + head.length and (at + head.length == len(data) or header_at(data, at + head.length)):
            end = len(data)
        if head and at + head.length <= end and (sync or at + head.length == end or header_at(data, at + head.length)):
            if not offsets and not out.table:
                out.header, out.table = head, _table(data[at : at + head.length], head)
                if out.table:
                    out.table["at"] = at
                    at += head.length
                    sync = True
                    continue
            # As many frames at once as go on with the same four header bytes.
            n = (end - at) // head.length
            block = raw[at : at + n * head.length].reshape(n, head.length)
            same = (block[:, :4] == block[0, :4]).all(axis=1)
            n = n if same.all() else int(np.argmin(same))
            offsets.append(at + head.length * np.arange(n))
            lengths.append(np.full(n, head.length))
            out.duration += Fraction(n * head.samples, head.rate)
            if head.protected and head.layer == 3:
                block = block[:n]
                want = block[:, 4].astype(np.uint16) << np.uint16(8) | block[:, 5]
                bad = crc16(np.concatenate([block[:, 2:4], block[:, 6 : 6 + head.side_info]], axis=1)) != want
                out.checked += n
                out.bad_checks += int(bad.sum())
            elif head.protected:
                out.checked += n
                out.bad_checks += sum(not check_holds(data[i : i + head.length], head) for i in range(at, at + n * head.length, head.length))
            out.header = out.header or head
            at += n * head.length
            sync = True
        else:
            if sync:
                out.resyncs += 1
            sync = False
            at = data.find(b"\xff", at + 1, end)
            if at < 0:
                break
    if offsets:
        out.offsets, out.lengths = np.concatenate(offsets).astype(np.int64), np.concatenate(lengths).astype(np.int64)
    return out


_HEAD = b"\xff\xfa\x64\xc0"
_SIDE = 17
_FRAME = 240
_PREFIX = _HEAD + int(crc16(np.frombuffer(_HEAD[2:] + bytes(_SIDE), np.uint8)[None])[0]).to_bytes(2, "big") + bytes(_SIDE)


def padded(raw: bytes) -> bytes:
    return raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def _text_frame(name: bytes, text: bytes) -> bytes:
    body = b"\0" + text
    return name + struct.pack(">I", len(body)) + b"\0\0" + body


def write(raw: bytes) -> bytes:
    """A stream that holds raw, blank-padded to a positive multiple of 192 bytes."""
    payload = np.frombuffer(padded(raw), np.uint8).reshape(-1, UNIT)
    n = len(payload)
    frames = np.zeros((n, _FRAME), np.uint8)
    frames[:, : len(_PREFIX)] = np.frombuffer(_PREFIX, np.uint8)
    frames[:, len(_PREFIX) : len(_PREFIX) + UNIT] = payload
    tag = _text_frame(b"TLEN", b"%d" % (24 * n)) + _text_frame(b"TXXX", b"n_bytes\0%d" % len(raw))
    size = len(tag)
    tag = b"ID3\3\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + tag
    toc = bytes(256 * (_FRAME + (n * p // 100) * _FRAME) // ((n + 1) * _FRAME) for p in range(100))
    table = _PREFIX + b"Xing" + struct.pack(">III", 7, n, (n + 1) * _FRAME) + toc
    return tag + table.ljust(_FRAME, b"\0") + frames.tobytes()


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The ancillary bytes that write() stored, from the frames found by parse()."""
    raw = np.frombuffer(data, np.uint8)
    whole = stream.offsets[stream.lengths == _FRAME]
    body = slice(len(_PREFIX), len(_PREFIX) + UNIT)
    if len(whole) and (np.diff(whole) == _FRAME).all():
        return raw[whole[0] : whole[0] + len(whole) * _FRAME].reshape(-1, _FRAME)[:, body].tobytes()
    return b"".join(data[i + body.start : i + body.stop] for i in whole.tolist())


def seek(stream: Stream, seconds: Fraction | float) -> int:
    """The offset of the frame that plays at a time; frames of one stream have the same number of samples."""
    if stream.header is None or not len(stream.offsets):
        return -1
    i = int(Fraction(seconds) * stream.header.rate / stream.header.samples)
    return int(stream.offsets[min(max(i, 0), len(stream.offsets) - 1)])


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id and media, the texts as MPEG audio (a null text is an empty one: a single frame of blanks)."""
    out = schema(("doc_id", id_type(docs)), ("media", "binary"))

    def encode(batches):
        for batch in batches:
            for rows in slices(batch, 1, rows=500):
                yield batch_of(out, [rows.column(0), [write(t.encode("utf-8", "surrogatepass")) for t in rows.column(1).to_pylist()]])

    return map_batches(texts(docs), encode, out)


PROBED = (
    ("duration_us", "long"), ("frames", "int"), ("sample_rate", "int"), ("mean_kbps", "double"), ("table_frames", "int"),
    ("checked", "int"), ("bad_checks", "int"), ("resyncs", "int"), ("seek_offsets", "array<int>"), ("tags", "map<string,string>"),
)


def probe(media: DataFrame) -> DataFrame:
    """doc_id and what parse() finds in the column media; bytes that hold no frame, or none at all, give zeros."""
    out = schema(("doc_id", id_type(media)), *PROBED)

    def read(batches):
        for batch in batches:
            rows = [_probed(parse(b or b"")) for b in batch.column(1).to_pylist()]
            yield batch_of(out, [batch.column(0), *map(list, zip(*rows))] if rows else [[] for _ in out])

    return map_batches(media.select("doc_id", "media"), read, out)


def _probed(s: Stream) -> tuple:
    us = round(s.duration * 1_000_000)
    kbps = float(Fraction(int(s.lengths.sum()) * 8, 1000) / s.duration) if s.duration else 0.0
    return (us, len(s.offsets), s.header.rate if s.header else 0, kbps, s.table.get("frames", 0), s.checked, s.bad_checks, s.resyncs, s.offsets.astype(np.int32), list(s.tags.items()))


def media_digests(docs: DataFrame) -> DataFrame:
    """Store all texts as audio in the shared folder, read them back, and sum up payload, stream and features.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, duration_us and frames. Equal texts give
    equal values; an empty table gives no rows; other columns are ignored.
    """
    out = schema(
        ("doc_id", id_type(docs)), ("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"),
        ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"), ("duration_us", "long"), ("frames", "long"),
    )

    def digest(batches):
        for batch in batches:
            rows = []
            for data in batch.column(1):
                data = data.as_py()
                s = parse(data)
                payload = payload_of(data, s)
                us, frames, rate, kbps, told, checked, bad, resyncs, offsets, _ = _probed(s)
                seeks = zlib.crc32(offsets.astype("<u4").tobytes())
                feature = f"rate={rate};frames={frames};us={us};kbps={kbps:.3f};table={told};crc={checked - bad}/{checked};resync={resyncs};seek={seeks:08x}"
                rows.append((int(s.tags.get("n_bytes", 0)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, us, frames))
            yield batch_of(out, [batch.column(0), *map(list, zip(*rows))] if rows else [[] for _ in out])

    return map_batches(stored(text_media(docs)), digest, out)
