"""Media columns: an MPEG-1 Layer III stream as a binary column.

write_stream() puts a payload into the ancillary bytes of silent mono frames at 48 kHz. A frame holds one, two or three
units of 192 bytes at 80, 160 or 224 kbit/s, so a stream is of variable bitrate. Ahead of them stand an ID3v2.3 tag with
its CRC-32 and a Xing table of frame count, byte count and seek points. read_stream() knows nothing of the writer: it
parses tags (ID3v1, ID3v2.2 to 2.4 in all their encodings) and variable-bitrate tables (Xing, Info, VBRI), resynchronises
on frame headers (a header counts if the next one follows where it says), checks the CRC-16 of protected frames of all
three layers, and gives exact durations (samples over the rate) and every frame's offset. No bytes make it fail.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.session import ship, written

UNIT = 192
# Fixed values of ISO/IEC 11172-3 and 13818-3: bitrates in kbit/s by (version, layer), sample rates in Hz by version.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 25: (11025, 12000, 8000)}
VERSIONS = {3: 1, 2: 2, 0: 25}
#: kbit/s of the frame that holds so many units, and its length at 48 kHz.
UNITS_KBIT = {1: 80, 2: 160, 3: 224}
SIDE_INFO = {(1, False): 32, (1, True): 17, (2, False): 17, (2, True): 9}
# Fixed values of the standards for Layer II: runs of (sub-bands, bits of an allocation) of the tables of allocation.
ALLOCATIONS = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "low": ((4, 4), (7, 3), (19, 2)),
}
ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


@dataclass
class Header:
    version: int
    layer: int
    kbit: int
    rate: int
    mono: bool
    bound: int  # sub-bands that stereo channels code apart
    protected: bool
    length: int
    samples: int


@dataclass
class Stream:
    """What read_stream() found. offsets[i] is where frame i starts; data frames exclude the one with the table.

    seek is the table of a variable-bitrate header as it stands: 100 bytes of Xing, or byte counts of VBRI.
    """

    payload: bytes = b""
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    kbits: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    table_frames: int = -1
    table_bytes: int = -1
    seek: bytes = b""
    tag_crc_ok: bool | None = None
    crc_checked: int = 0
    crc_bad: int = 0
    skipped: int = 0

    @property
    def duration(self) -> Fraction:
        return Fraction(self.samples, self.rate) if self.rate else Fraction(0)


def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def crc16_bits(data: bytes, bits: int, crc: int = 0xFFFF) -> int:
    """crc16() over the first bits of data."""
    for i in range(bits):
        top = crc >> 15 ^ (data[i >> 3] >> (7 - (i & 7)) & 1)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


def protected_bits(head: Header, body: bytes) -> int | None:
    """How many bits of the audio data (behind the CRC) the CRC covers besides the header; None if body is too short."""
    channels = 1 if head.mono else 2
    if head.layer == 3:
        return 8 * SIDE_INFO[min(head.version, 2), head.mono]
    if head.layer == 1:
        return 4 * (32 if head.mono else head.bound + 32)
    each = head.kbit // channels
    table = "low" if head.version != 1 else ("d" if head.rate == 32000 else "c") if each <= 48 else "a" if each <= 80 or head.rate == 48000 else "b"
    widths = [w for n, w in ALLOCATIONS[table] for _ in range(n)]
    at = used = 0
    value = int.from_bytes(body[:64], "big")
    size = 8 * len(body[:64])
    for band, width in enumerate(widths):
        for channel in range(channels if band < head.bound else 1):
            at += width
            if at > size:
                return None
            if value >> (size - at) & ((1 << width) - 1):
                used += channels if band >= head.bound else 1
    return at + 2 * used


def crc_fits(head: Header, frame: bytes) -> bool:
    """Of a protected frame: 4 bytes of header, 2 of CRC, audio data."""
    bits = protected_bits(head, frame[6:])
    if bits is None or 48 + bits > 8 * len(frame):
        return False
    return crc16_bits(frame[6:], bits, crc16(frame[2:4])) == frame[4] << 8 | frame[5]


_headers: dict[bytes, Header | None] = {}


def parse_header(data: bytes) -> Header | None:
    """Of 4 bytes; None if they are no frame header, or one of free format."""
    if len(data) < 4 or data[0] != 0xFF or data[1] & 0xE0 != 0xE0:
        return None
    if data in _headers:
        return _headers[data]
    version, layer = VERSIONS.get(data[1] >> 3 & 3), 4 - (data[1] >> 1 & 3)
    row, col = data[2] >> 4, data[2] >> 2 & 3
    out = None
    if version and layer < 4 and 0 < row < 15 and col < 3:
        kbit, rate, pad = BITRATES[min(version, 2), layer][row], RATES[version][col], data[2] >> 1 & 1
        samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
        length = (12000 * kbit // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbit // rate + pad
        bound = 4 * (data[3] >> 4 & 3) + 4 if data[3] >> 6 == 1 else 32
        out = Header(version, layer, kbit, rate, data[3] >> 6 == 3, bound, not data[1] & 1, length, samples)
    if len(_headers) < 4096:
        _headers[bytes(data)] = out
    return out


def _frame_head(kbit: int) -> bytes:
    """Header, CRC and empty side information of a protected mono frame at 48 kHz."""
    head = bytes((0xFF, 0xFA, BITRATES[1, 3].index(kbit) << 4 | 1 << 2, 0xC0))
    side = bytes(SIDE_INFO[1, True])
    return head + struct.pack(">H", crc16(head[2:4] + side)) + side


HEADS = {units: _frame_head(kbit) for units, kbit in UNITS_KBIT.items()}
LENGTHS = {units: 144 * kbit * 1000 // 48000 for units, kbit in UNITS_KBIT.items()}


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def pad_payload(data: bytes, unit: int = UNIT) -> bytes:
    """data and spaces up to a positive multiple of unit."""
    return data + b" " * (max(unit, -(-len(data) // unit) * unit) - len(data))


def write_stream(payload: bytes) -> bytes:
    """An MPEG stream that holds payload (a positive multiple of UNIT bytes)."""
    units = len(payload) // UNIT
    full, rest = divmod(units, 3)
    frames = full + (rest > 0)
    body = np.zeros((full, LENGTHS[3]), dtype=np.uint8)
    body[:, : len(HEADS[3])] = np.frombuffer(HEADS[3], dtype=np.uint8)
    body[:, len(HEADS[3]) : len(HEADS[3]) + 3 * UNIT] = np.frombuffer(payload, dtype=np.uint8, count=full * 3 * UNIT).reshape(full, 3 * UNIT)
    tail = (HEADS[rest] + payload[full * 3 * UNIT :]).ljust(LENGTHS[rest], b"\0") if rest else b""
    table_length = LENGTHS[2]
    total = table_length + full * LENGTHS[3] + len(tail)
    seek = bytes(min(255, (table_length + min(frames - 1, i * frames // 100) * LENGTHS[3]) * 256 // total) for i in range(100))
    table = (HEADS[2] + b"Xing" + struct.pack(">III", 7, frames, total) + seek).ljust(table_length, b"\0")
    millis = frames * 1152 * 1000 // 48000
    fields = b"".join(k + struct.pack(">IH", len(v) + 1, 0) + b"\0" + v for k, v in ((b"TLEN", str(millis).encode()), (b"TXXX", b"units\0" + str(units).encode())))
    extended = struct.pack(">IHI", 10, 0x8000, 0) + struct.pack(">I", zlib.crc32(fields))
    tag = b"ID3\x03\0\x40" + _synchsafe(len(extended) + len(fields)) + extended + fields
    return tag + table + body.tobytes() + tail


def _synch(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def _text(value: bytes) -> str:
    return value[1:].decode(ENCODINGS.get(value[0], "latin-1"), errors="replace").lstrip("\ufeff") if value else ""


def _frame_value(value: bytes, version: int, flags: int) -> bytes | None:
    """A tag frame's data without what its flags say was done to it; None if it is encrypted or broken."""
    if version == 3 and flags & 0xC0:
        value = value[4 + bool(flags & 0x20) :]
        compressed, secret = flags & 0x80, flags & 0x40
    elif version == 4:
        compressed, secret = flags & 0x08, flags & 0x04
        value = value[bool(flags & 0x40) + 4 * (flags & 1) :]
        value = value.replace(b"\xff\x00", b"\xff") if flags & 0x02 else value
    else:
        return value[1:] if version == 3 and flags & 0x20 else value
    if secret:
        return None
    try:
        return zlib.decompressobj().decompress(value, 1 << 20) if compressed else value
    except zlib.error:
        return None


def _read_tag(data: bytes, out: Stream) -> int:
    """Parse an ID3v2 tag of version 2 to 4 at the start, if there is one; where the audio starts."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127 or not 2 <= data[3] <= 4:
        return 0
    version, flags, size = data[3], data[5], _synch(data[6:10])
    body, at = data[10 : 10 + size], 0
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    if version == 3 and flags & 0x40 and len(body) >= 10:
        extended, extended_flags, padding = struct.unpack(">IHI", body[:10])
        at = 4 + extended
        if extended_flags & 0x8000 and len(body) >= 14:
            out.tag_crc_ok = zlib.crc32(body[at : max(at, len(body) - padding)]) == struct.unpack(">I", body[10:14])[0]
    elif version == 4 and flags & 0x40 and len(body) >= 6:
        at = max(6, _synch(body[:4]))
        if body[5] & 0x20:
            where = 6 + bool(body[5] & 0x40)
            crc = 0
            for byte in body[where + 1 : where + 6]:
                crc = crc << 7 | byte & 0x7F
            out.tag_crc_ok = zlib.crc32(body[at:]) == crc & 0xFFFFFFFF
    long = 4 if version > 2 else 3
    width = 10 if version > 2 else 6
    while at + width <= len(body) and body[at : at + long].isalnum():
        name, number = body[at : at + long].decode("latin-1"), body[at + long : at + 2 * long]
        n = _synch(number) if version == 4 else int.from_bytes(number, "big")
        value = _frame_value(body[at + width : at + width + n], version, body[at + 9] if version > 2 else 0)
        if name[0] == "T" and value is not None:
            key, _, rest = _text(value).partition("\0") if name in ("TXXX", "TXX") else (name, "", _text(value))
            out.tags.setdefault(key, rest.rstrip("\0"))
        at += width + n
    return 10 + size + (10 if version == 4 and flags & 0x10 else 0)


def _read_last_tag(data: bytes, out: Stream) -> None:
    """Parse an ID3v1 tag of 128 bytes; what ID3v2 says goes before."""
    for key, lo, hi in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97), ("COMM", 97, 125 if data[125] == 0 and data[126] else 127)):
        value = data[lo:hi].split(b"\0")[0].decode("latin-1").strip()
        if value:
            out.tags.setdefault(key, value)
    if data[125] == 0 and data[126]:
        out.tags.setdefault("TRCK", str(data[126]))


def _read_table(data: bytes, at: int, head: Header, out: Stream) -> bool:
    """Parse the variable-bitrate table in the frame at at, if it has one."""
    frame = data[at : at + head.length]
    main = 4 + 2 * head.protected + (SIDE_INFO[min(head.version, 2), head.mono] if head.layer == 3 else 0)
    if frame[main : main + 4] in (b"Xing", b"Info") and len(frame) >= main + 8:
        flags, field_at = struct.unpack(">I", frame[main + 4 : main + 8])[0], main + 8
        for bit, name in ((1, "table_frames"), (2, "table_bytes")):
            if flags & bit:
                setattr(out, name, int.from_bytes(frame[field_at : field_at + 4], "big"))
                field_at += 4
        if flags & 4:
            out.seek = frame[field_at : field_at + 100]
        return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        out.table_bytes, out.table_frames, entries, scale, width = struct.unpack(">IIHHH", frame[46:60])
        toc = frame[62 : 62 + entries * width]
        out.seek = struct.pack(f">{len(toc) // width}Q", *(int.from_bytes(toc[i : i + width], "big") * scale for i in range(0, len(toc) - width + 1, width))) if 0 < width <= 4 else b""
        return True
    return False


def read_stream(data: bytes) -> Stream:
    """Parse any MPEG audio stream; bytes that belong to no frame are skipped and counted, broken ones too."""
    out = Stream()
    at, parts = _read_tag(data, out), []
    end = len(data) - (128 if data[-128:-125] == b"TAG" and len(data) - 128 >= at else 0)
    locked = tabled = False
    while at + 4 <= end:
        head = parse_header(data[at : at + 4])
        after = at + head.length if head else 0
        if head and end < after <= len(data) and (after == len(data) or parse_header(data[after : after + 4])):
            end = len(data)  # a complete frame spans what looked like a trailing tag
        if not head or after > end or not (locked or after == end or parse_header(data[after : after + 4])):
            found = data.find(b"\xff", at + 1, end)
            out.skipped += (found if found >= 0 else end) - at
            at, locked = (found if found >= 0 else end), False
            continue
        locked = True
        if head.protected:
            out.crc_checked += 1
            key = data[at : at + 6 + (SIDE_INFO[min(head.version, 2), head.mono] if head.layer == 3 else 96)]
            if key not in _crcs:
                if len(_crcs) > 4096:
                    _crcs.clear()
                _crcs[key] = crc_fits(head, data[at:after])
            out.crc_bad += not _crcs[key]
        if not out.offsets and not tabled and _read_table(data, at, head, out):
            tabled = True
        else:
            main = at + 4 + 2 * head.protected + (SIDE_INFO[min(head.version, 2), head.mono] if head.layer == 3 else 0)
            out.offsets.append(at)
            out.kbits.append(head.kbit)
            out.samples += head.samples
            out.rate = head.rate
            parts.append(data[main : main + (after - main) // UNIT * UNIT])
        at = after
    out.skipped += max(0, end - at)
    if end < len(data):
        _read_last_tag(data[end:], out)
    out.payload = b"".join(parts)
    return out


_crcs: dict[bytes, bool] = {}


def encode_column(text: Column) -> Column:
    """The MPEG stream of a text's UTF-8 bytes, padded to a positive multiple of UNIT; null counts as empty."""

    @pandas_udf("binary")
    def kernel(texts: pd.Series) -> pd.Series:
        return pd.Series([write_stream(pad_payload((t if isinstance(t, str) else "").encode("utf-8", "surrogatepass"))) for t in texts], dtype=object)

    return kernel(text)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, samples long, rate int, duration_s double, seek_offsets binary, table_ok boolean, crc_checked long, crc_bad long, skipped long"


def features_of(data: bytes) -> tuple:
    """The fields of FEATURES of one stored stream. seek_offsets: the offset of every frame, unsigned 32-bit little-endian."""
    s = read_stream(data)
    table_ok = s.table_frames == len(s.offsets) and s.tag_crc_ok is not False and len(s.seek) == 100
    return (
        len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), len(s.offsets), s.samples, s.rate,
        float(s.duration), np.array(s.offsets, dtype="<u4").tobytes(), table_ok, s.crc_checked, s.crc_bad, s.skipped,
    )


def decode_column(media: Column) -> Column:
    """A struct of FEATURES, read from a stored stream; null media gives what empty bytes give."""

    @pandas_udf(FEATURES)
    def kernel(streams: pd.Series) -> pd.DataFrame:
        names = [f.split()[0] for f in FEATURES.split(", ")]
        return pd.DataFrame([features_of(bytes(x) if x is not None else b"") for x in streams], columns=names)

    return kernel(media)


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and the features of each row's text as stored in an MPEG column and read back.

    The streams are stored as a table in the shared folder, and all features but n_bytes are of the bytes read back from
    there. Null and empty texts give one unit of spaces. Equal texts give equal values; repeated rows stay rows; an empty
    table gives an empty result; other columns do not matter, whatever their names.
    """
    stored = stored_media(df, id_col, text_col)
    return stored.withColumn("media", decode_column(F.col("media"))).select(F.col("media_id").alias(id_col), "n_bytes", "media.*")


def stored_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """media_id, n_bytes and media: the table of streams in the shared folder, read back from it."""
    ship(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return written(df.select(F.col(id_col).alias("media_id"), F.octet_length(text).cast("long").alias("n_bytes"), encode_column(text).alias("media")), "media")
