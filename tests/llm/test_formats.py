import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallow.llm import media, warc
from tallow.llm.common import new_dir


def test_archive_cases(spark):
    rows = [(1, "http://a", "x" * 2000), (2, None, "x" * 2000), (5, "u", "x" * 2000), (3, "u", None), (None, "n", "x" * 2000), (4, "s", "short"), (6, "s", "short"), (7, "é", "é" * 600), (8, "é", "é" * 600), (2, None, "x" * 2000), (9, "big", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    bases = [new_dir(spark, "w"), new_dir(spark, "w")]
    manifests = [sorted(map(tuple, warc.write(pages, b, roll_bytes=600).collect())) for b in bases]
    assert manifests[0] == manifests[1] and sum(m[1] for m in manifests[0]) == len(rows)
    got = warc.read(spark, bases[0]).collect()
    want = []
    for page_id, _, html in rows:
        p = (html or "").encode()
        same = [r[0] for r in rows if r[0] is not None and (r[2] or "").encode() == p and len(p) >= 1000]
        top = max(same, default=None)
        revisit = page_id is not None and top is not None and page_id < top
        want.append((str(page_id), len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted(map(str, want)) == sorted(str((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert all((bytes(r.payload) if r.payload is not None else None) == (None if r.record_type == "revisit" else next((x[2] or "").encode() for x in rows if x[0] == r.page_id)) for r in got)
    b = new_dir(spark, "w")
    warc.write(pages.limit(0), b)
    assert warc.read(spark, b).count() == 0


def test_a_damaged_record_is_noticed(tmp_path):
    data = warc.record(1, "u", b"hello", None, "1970-01-01T00:00:00Z").replace(b"hello", b"jello")
    with pytest.raises(ValueError):
        warc._parsed(data)


def filtered(rows, kinds, bpp, colour, width):
    out, above = b"", np.zeros(rows.shape[1], int)
    for y, k in enumerate(kinds):
        x = rows[y].astype(int)
        a, c = (np.concatenate([np.zeros(bpp, int), v[:-bpp]]) for v in (x, above))
        p = a + above - c
        da, db, dc = abs(p - a), abs(p - above), abs(p - c)
        guess = [0, a, above, (a + above) // 2, np.where((da <= db) & (da <= dc), a, np.where(db <= dc, above, c))][k]
        out += bytes([k]) + ((x - guess) % 256).astype(np.uint8).tobytes()
        above = x
    header = struct.pack(">IIBBBBB", width, len(rows), 8, colour, 0, 0, 0)
    return media._SIGNATURE + media._chunk(b"IHDR", header) + media._chunk(b"IDAT", zlib.compress(out)) + media._chunk(b"IEND", b"")


@pytest.mark.parametrize("colour,bpp", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_all_filters(colour, bpp):
    rng = np.random.default_rng(colour)
    rows = rng.integers(0, 256, (40, 10 * bpp)).astype(np.uint8)
    assert (media.decode_png(filtered(rows, rng.integers(0, 5, 40).tolist(), bpp, colour, 10)) == rows).all()


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_round_trip(data):
    p = media.padded(data)
    assert len(p) % 64 == 0 and len(p) >= 64 and p.startswith(data)
    image = media.encode_png(p)
    assert media.decode_png(image).tobytes() == p and len(media.cosine_hash(media.decode_png(image))) == 16


@pytest.mark.parametrize("at", [3, 20, 30, 60, -6])
def test_damage_is_noticed(at):
    image = bytearray(media.encode_png(media.padded(b"some text " * 50)))
    image[at] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(image))


def test_media_cases(spark):
    texts = [None, "", "é", "a" * 64, "b" * 500_000, "a" * 64]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    got = media.with_features(media.with_media(docs)).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        p = media.padded((t or "").encode())
        assert (r.features.payload_bytes, r.features.payload_sha256, r.features.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[3].features == got[5].features and got[0].features == got[1].features and got[0].feature == "m"
    assert media.with_features(media.with_media(docs.limit(0))).count() == 0
