"""Operator 6: signature sniffing of media columns.

An Aho-Corasick automaton locates the magic bytes of all known formats in one pass over
a value; at each place the format's validator walks the structure and confirms lengths
(and checksums, where the format has them).  What is confirmed corrects the declared
type and is carved out; the search goes on behind it, so media inside media stay whole.

Known: WAV, BMP, PNG, AU, GIF, JPEG.  Whole values are searched.

Nulls: a null value holds no media and has no type; a null declared type is corrected by
what is found.  A value in which nothing is confirmed keeps no type, whatever was declared.
Empty values hold nothing.  Repeated rows each get a row; an empty table gives an empty
table.  Further columns are kept, but for those named like a new column, which give way to it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.shared import table

#: The formats' magic bytes.
MAGIC = {
    b"RIFF": "audio/wav",
    b"BM": "image/bmp",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b".snd": "audio/basic",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
}
ROW = 192


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        out.add_word(magic.decode("latin-1"), (len(magic), kind))
    out.make_automaton()
    return out


# --- validators: length of the medium that begins at ``at``, or 0 -------------


def _wav(data: bytes, at: int) -> int:
    if data[at + 8 : at + 12] != b"WAVE" or len(data) < at + 44:
        return 0
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    place, seen = at + 12, set()
    while place + 8 <= end <= len(data):
        name, size = data[place : place + 4], struct.unpack_from("<I", data, place + 4)[0]
        place += 8 + size + (size & 1)
        seen.add(name)
    return end - at if {b"fmt ", b"data"} <= seen and place == end else 0


def _bmp(data: bytes, at: int) -> int:
    if len(data) < at + 54:
        return 0
    size, reserved, offset, header, width, height, planes, depth, packing = struct.unpack_from("<IIIIiiHHI", data, at + 2)
    if reserved or header not in (40, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or packing or width <= 0 or not height:
        return 0
    body = (width * depth + 31) // 32 * 4 * abs(height)
    return size if 14 + header <= offset and offset + body == size and at + size <= len(data) else 0


def _png(data: bytes, at: int) -> int:
    place, first = at + 8, True
    while place + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, place)
        end = place + 12 + size
        if first != (name == b"IHDR") or end > len(data) or zlib.crc32(memoryview(data)[place + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return 0
        if name == b"IEND":
            return end - at
        place, first = end, False
    return 0


def _au(data: bytes, at: int) -> int:
    if len(data) < at + 24:
        return 0
    offset, size, encoding, rate, channels = struct.unpack_from(">IIIII", data, at + 4)
    ok = offset >= 24 and 1 <= encoding <= 27 and rate and 1 <= channels <= 64 and size != 0xFFFFFFFF
    return offset + size if ok and at + offset + size <= len(data) else 0


def _gif(data: bytes, at: int) -> int:
    if len(data) < at + 14:
        return 0

    def blocks(place: int) -> int:
        while place < len(data) and data[place]:
            place += data[place] + 1
        return place + 1

    flags = data[at + 10]
    place = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    while place < len(data):
        mark = data[place]
        if mark == 0x3B:
            return place + 1 - at
        if mark == 0x21:
            place = blocks(place + 2)
        elif mark == 0x2C and place + 10 < len(data):
            local = data[place + 9]
            place = blocks(place + 10 + (3 << (local & 7) + 1 if local & 0x80 else 0) + 1)
        else:
            return 0
    return 0


def _jpeg(data: bytes, at: int) -> int:
    place, frame = at + 2, False
    while place + 2 <= len(data) and data[place] == 0xFF:
        mark = data[place + 1]
        if mark == 0xD9:
            return place + 2 - at if frame else 0
        if not 0xC0 <= mark <= 0xFE or place + 4 > len(data):
            return 0
        frame |= mark in (0xC0, 0xC1, 0xC2)
        place += 2 + struct.unpack_from(">H", data, place + 2)[0]
        if mark == 0xDA:  # coded data: up to a marker that is neither stuffing nor a restart
            while (place := data.find(b"\xff", place)) >= 0 and place + 1 < len(data) and (data[place + 1] == 0 or 0xD0 <= data[place + 1] <= 0xD7):
                place += 2
            if place < 0:
                return 0
    return 0


VALIDATORS = {"audio/wav": _wav, "image/bmp": _bmp, "image/png": _png, "audio/basic": _au, "image/gif": _gif, "image/jpeg": _jpeg}


def carve(data: bytes, machine: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the media in a value, in order and not overlapping."""
    out, text, at = [], data.decode("latin-1"), 0
    while at < len(data):
        for end, (n, kind) in machine.iter(text, at):
            begin = end - n + 1
            if length := VALIDATORS[kind](data, begin):
                out.append((kind, begin, length))
                at = begin + length
                break
        else:
            break
    return out


FOUND = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))


def sniff(media: DataFrame, data: str = "data", declared: str = "declared", found: str = "found", kind: str = "type") -> DataFrame:
    """``media`` with ``kind``, the type that its bytes confirm (of the first medium, null if none), and
    ``found``, what can be carved: type, offset, length."""
    out = media.withColumns({kind: F.lit(None).cast("string"), found: F.lit(None).cast("array<struct<type:string,offset:bigint,length:bigint>>")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            all_ = [carve(v.as_py(), machine) if v.is_valid else [] for v in batch.column(data)]
            new = {kind: pa.array([x[0][0] if x else None for x in all_], pa.string()), found: pa.array([[dict(zip(("type", "offset", "length"), y)) for y in x] for x in all_], FOUND)}
            yield pa.RecordBatch.from_arrays([new[f.name].cast(f.type) if f.name in new else batch.column(i) for i, f in enumerate(batch.schema)], schema=batch.schema)

    return out.mapInArrow(run, out.schema)


# --- 8-bit samples in four formats ------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def encode(payload: bytes, kind: str) -> bytes:
    """A payload of whole rows of ROW bytes as 8-bit samples."""
    n, rows = len(payload), len(payload) // ROW
    if kind == "audio/wav":
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload
    if kind == "audio/basic":
        return struct.pack(">4sIIIII", b".snd", 24, n, 2, 8000, 1) + payload
    if kind == "image/bmp":
        palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 1078 + n, 0, 1078, 40, ROW, -rows, 1, 8, 0, n, 2835, 2835, 256, 0) + palette + payload
    if kind == "image/png":
        lines = np.zeros((rows, ROW + 1), np.uint8)
        lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
        return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")
    raise ValueError(f"no 8-bit samples in {kind}")


def decode(medium: bytes, kind: str) -> bytes:
    """The samples that ``encode`` stored."""
    if kind == "audio/wav":
        return medium[44 : 44 + struct.unpack_from("<I", medium, 40)[0]]
    if kind == "audio/basic":
        offset, size = struct.unpack_from(">II", medium, 4)
        return medium[offset : offset + size]
    if kind == "image/bmp":
        return medium[struct.unpack_from("<I", medium, 10)[0] :]
    if kind == "image/png":
        place, body = 8, []
        while place < len(medium):
            size, name = struct.unpack_from(">I4s", medium, place)
            if name == b"IDAT":
                body.append(medium[place + 8 : place + 8 + size])
            place += 12 + size
        lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, ROW + 1)
        if lines[:, 0].any():
            raise ValueError("only rows without a filter are stored here")
        return lines[:, 1:].tobytes()
    raise ValueError(f"no 8-bit samples in {kind}")


KINDS = ("audio/wav", "image/bmp", "image/png", "audio/basic")


def attach(text: bytes) -> tuple[bytes, str]:
    """A text's payload as a medium in the middle of a value, and a declared type that need not be right."""
    payload = text + b" " * ((-len(text)) % ROW or (0 if text else ROW))
    code = zlib.crc32(payload)
    medium = encode(payload, KINDS[code % 4])
    return b"attachment %08x\n" % code + medium + b"\nend\n", KINDS[(code >> 8) % 4]


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("declared", pa.string()), ("type", pa.string())])
STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, type string"


def _feature(kind: str, declared: str, payload: bytes) -> str:
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    return f"{kind};{'kept' if kind == declared else 'corrected'};{ROW}x{len(samples) // ROW};mean={samples.mean():.6f};std={samples.std():.6f};entropy={-(share * np.log2(share)).sum():.6f};values={len(share)}"


def _round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's payload stored as a medium, sniffed, carved and read back."""
    machine = automaton()
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            text = text.as_buffer().to_pybytes() if text.is_valid else b""
            value, declared = attach(text)
            (kind, offset, length), *_ = carve(value, machine)
            medium = value[offset : offset + length]
            payload = decode(medium, kind)
            rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), length, hashlib.sha256(medium).hexdigest(), _feature(kind, declared, payload), declared, kind))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], _STORED.field(i + 1).type) for i in range(9))], schema=_STORED)


def store(docs: DataFrame) -> DataFrame:
    """Digests of the texts' payloads as read back from the media that hold them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_round_trip, STORED)


def op6_media_sniffing(spark, sf_dir: str) -> DataFrame:
    return store(table(spark, sf_dir, "documents"))
