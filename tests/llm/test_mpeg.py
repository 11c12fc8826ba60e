"""MPEG streams of other writers: tags of all versions, tables, CRCs of all layers, broken bytes."""

import os
import random
import struct
import zlib

import pytest

from tessera.llm import mpeg

CLEAN = mpeg.write_stream(mpeg.pad_payload(b"payload " * 300))
BODY = CLEAN[10 + mpeg._synch(CLEAN[6:10]) :]


def synch(n):
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def tag(version, frames, flags=0):
    return b"ID3" + bytes((version, 0, flags)) + synch(len(frames)) + frames


def frame(version, name, value, flags=0):
    if version == 2:
        return name + len(value).to_bytes(3, "big") + value
    return name + (synch(len(value)) if version == 4 else struct.pack(">I", len(value))) + bytes((0, flags)) + value


TITLES = [b"\0caf\xe9", b"\1" + "café".encode("utf-16"), b"\2" + "café".encode("utf-16-be"), b"\3" + "café".encode()]


@pytest.mark.parametrize("version", [2, 3, 4])
@pytest.mark.parametrize("title", TITLES)
def test_tags_of_all_versions_and_encodings(version, title):
    name, long = (b"TT2", b"TP1") if version == 2 else (b"TIT2", b"TPE1")
    frames = frame(version, name, title) + frame(version, long, b"\0" + b"a" * 201) + bytes(7)
    s = mpeg.read_stream(tag(version, frames) + BODY)
    assert s.tags[name.decode()] == "café" and s.tags[long.decode()] == "a" * 201
    assert s.payload == mpeg.read_stream(CLEAN).payload and s.skipped == 0


def test_tag_extras():
    packed = frame(4, b"TIT2", struct.pack(">I", 5) + zlib.compress(b"\3abcd"), 0x09)
    extended = synch(12) + b"\1\x20" + b"\5"
    crc = zlib.crc32(packed)
    extended += bytes(crc >> s & 0x7F for s in (28, 21, 14, 7, 0))
    s = mpeg.read_stream(tag(4, extended + packed, 0x50) + b"3DI" + bytes((4, 0, 0x50)) + synch(len(extended + packed)) + BODY)
    assert s.tags["TIT2"] == "abcd" and s.tag_crc_ok and s.skipped == 0
    last = b"TAG" + b"Song".ljust(30, b"\0") + b"Singer".ljust(30) + bytes(30) + b"1999" + b"note".ljust(28, b"\0") + b"\0\x07\0"
    s = mpeg.read_stream(CLEAN + last)
    assert (s.tags["TIT2"], s.tags["TPE1"], s.tags["TYER"], s.tags["COMM"], s.tags["TRCK"]) == ("Song", "Singer", "1999", "note", "7") and s.skipped == 0


@pytest.mark.parametrize("bad", [b"\1\xff\xfea", b"\3\xff\xfe\x80", b"\2\0", b"\x09abc", b""])
def test_broken_texts_do_not_fail(bad):
    assert mpeg.read_stream(tag(3, frame(3, b"TIT2", bad)) + BODY).payload == mpeg.read_stream(CLEAN).payload


def test_vbri_table():
    head = bytes((0xFF, 0xFB, 0x90, 0x64))  # 44.1 kHz, 128 kbit/s, joint stereo, no CRC: 417 bytes
    data = head + bytes(413)
    vbri = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 3 * 417, 2, 2, 1, 2, 1) + struct.pack(">HH", 417, 417)
    table = head + (bytes(32) + vbri).ljust(413, b"\0")
    s = mpeg.read_stream(table + data * 2)
    assert (s.table_frames, s.table_bytes, struct.unpack(">2Q", s.seek)) == (2, 1251, (417, 417)) and s.offsets == [417, 834]
    assert s.duration * 44100 == 2 * 1152


def bits_crc(bits):
    crc = 0xFFFF
    for bit in bits:
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ int(bit) else 0)
    return crc


@pytest.mark.parametrize(
    "head, length, covered",
    [
        (bytes((0xFF, 0xFE, 0x44, 0xC0)), 128, lambda body: 4 * 32),  # Layer I, 48 kHz, 128 kbit/s, mono
        (bytes((0xFF, 0xFE, 0x44, 0x00)), 128, lambda body: 4 * 64),  # stereo
        (bytes((0xFF, 0xFE, 0x44, 0x50)), 128, lambda body: 4 * (8 * 2 + 24)),  # joint stereo from sub-band 8
        (bytes((0xFF, 0xFC, 0x44, 0xC0)), 192, None),  # Layer II, 48 kHz, 64 kbit/s, mono: 11 x 4, 12 x 3, 4 x 2 bits and 2 for each that is used
    ],
)
def test_crc_of_layers_one_and_two(head, length, covered):
    body = bytearray(os.urandom(length - 6))
    bits = "".join(f"{x:08b}" for x in body)
    if covered is None:
        at = used = 0
        for width in [4] * 11 + [3] * 12 + [2] * 4:
            used += "1" in bits[at : at + width]
            at += width
        n = at + 2 * used
    else:
        n = covered(body)
    crc = bits_crc("".join(f"{x:08b}" for x in head[2:4]) + bits[:n])
    good = head + struct.pack(">H", crc) + bytes(body)
    s = mpeg.read_stream(good * 3)
    assert (len(s.offsets), s.crc_checked, s.crc_bad) == (3, 3, 0)
    body[3] ^= 1
    assert mpeg.read_stream((head + struct.pack(">H", crc) + bytes(body)) * 2).crc_bad == 2
    body[3] ^= 1
    body[n // 8 + 1] ^= 255
    assert mpeg.read_stream((head + struct.pack(">H", crc) + bytes(body)) * 2).crc_bad == 0


def test_any_bytes_can_be_read():
    rng = random.Random(1)
    for _ in range(300):
        data = bytearray(CLEAN[: rng.randrange(len(CLEAN))] if rng.random() < 0.5 else os.urandom(rng.randrange(3000)))
        for _ in range(rng.randrange(30)):
            if data:
                data[rng.randrange(len(data))] = rng.choice((0, 255, rng.randrange(256)))
        if rng.random() < 0.5:
            data = b"ID3" + bytes(rng.randrange(256) for _ in range(7)) + bytes(data)
        s = mpeg.read_stream(bytes(data))
        assert s.skipped <= len(data) and len(s.payload) <= len(data)


def test_media_are_read_back_from_the_stored_table(spark):
    docs = spark.createDataFrame([(1, "abc", "m"), (2, None, "n")], "doc_id long, text string, media string")
    stored = mpeg.stored_media(docs)
    assert stored.inputFiles() and {bytes(r.media) for r in stored.collect()} == {mpeg.write_stream(mpeg.pad_payload(x)) for x in (b"abc", b"")}
