import hashlib
import struct
import zlib

from pyspark.sql import functions as F

from tests.llm.cases import DOC, documents, frame
from terrane.llm import media

#: A one-pixel GIF and a minimal JPEG frame, by hand.
GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x05\x08\x00\x01" + b"\xff\xda\x00\x03\x00" + b"ab\xff\x00cd\xff\xd0ef" + b"\xff\xd9"


def test_round_trip_of_every_text(spark):
    rows = documents()
    got = media.store(frame(spark)).collect()
    assert len(got) == len(rows)
    want = {}
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        want[(r[0], len(raw))] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    for r in got:
        assert want[(r.doc_id, r.n_bytes)] == (r.payload_bytes, r.payload_sha256, r.tail_crc32)
        assert r.media_bytes > 0 and r.feature.startswith(r.type + (";kept" if r.type == r.declared else ";corrected"))
    assert {r.type for r in got} == set(media.KINDS) and any(r.type != r.declared for r in got)


def test_every_format_is_carved_and_the_declared_type_corrected(spark):
    kinds = {k: media.encode(bytes(range(192)) * 3, k) for k in media.KINDS} | {"image/gif": GIF, "image/jpeg": JPEG}
    rows = [(k, "image/png", b"noise BM RIFF .snd GIF89a" + m + b"tail") for k, m in kinds.items()]
    rows += [("two", None, GIF + b"--" + JPEG), ("none", "image/png", b"BM" * 50), ("empty", "x", b""), ("null", None, None), ("cut", "audio/wav", kinds["audio/wav"][:-1]), ("broken", "x", kinds["image/png"][:60] + b"?" + kinds["image/png"][61:])]
    docs = spark.createDataFrame(rows, "name string, declared string, data binary").withColumn("extra", F.lit(1))
    got = {r.name: r for r in media.sniff(docs).collect()}
    for k, m in kinds.items():
        assert got[k].type == k and [(x.type, x.offset, x.length) for x in got[k].found] == [(k, 25, len(m))]
    assert [x.type for x in got["two"].found] == ["image/gif", "image/jpeg"] and got["two"].found[1].offset == len(GIF) + 2
    for name in ("none", "empty", "null", "cut", "broken"):
        assert got[name].type is None and got[name].found == []
    assert got["two"].extra == 1


def test_media_inside_media_stay_whole():
    inner = media.encode(b"x" * 192, "audio/wav")
    payload = inner + b" " * (-len(inner) % 192)
    outer = media.encode(payload, "image/bmp")
    assert media.carve(outer, media.automaton()) == [("image/bmp", 0, len(outer))]


def test_empty_table(spark):
    assert media.store(spark.createDataFrame([], DOC)).count() == 0
