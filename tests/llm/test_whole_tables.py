"""The queries over whole tables against plain forms, and against their SQL where they have some."""

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest

from tallow.llm import licenses, media, queries, spotsigs
from test_texts import likeness, slow_signatures

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def shown(rows, columns):
    return Counter(tuple(f"{r[c]:.9f}" if isinstance(r[c], float) else str(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_the_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    found = con.execute(queries.ORACLES[name])
    columns = sorted(c[0] for c in found.description)
    want = [dict(zip((c[0] for c in found.description), row)) for row in found.fetchall()]
    got = [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]
    assert sorted(got[0]) == columns and shown(got, columns) == shown(want, columns)


def test_equal_rows_in_great_number_are_counted_once_each(spark):
    docs = spark.createDataFrame([(None, "cc by x")] * 400 + [(None, "")] * 300 + [(i, "all rights reserved") for i in range(5)], "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.n_base, r.base_labels) for r in licenses.scan(docs).collect())
    assert got == Counter({(None, 1, "cc-by"): 400, (None, 0, ""): 300, **{(i, 1, "reserved"): 1 for i in range(5)}})


def test_op6_stores_every_text_and_reads_it_back(spark, texts):
    got = queries.QUERIES["op6_media"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        data = texts[r.doc_id].encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        stored = media.encode_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_op9_fingerprints_every_text_and_its_edit(spark, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op9_fingerprints"](spark, SF).collect()}
    order = sorted(texts)
    assert sorted(got) == order
    prints = {}
    for i, after in zip(order, order[1:] + order[:1]):
        a, b, r = texts[i], texts[after], got[i]
        e = spotsigs.edited(a, b)
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(e.encode()).hexdigest())
        prints.setdefault(r.fingerprint, set()).add(frozenset(slow_signatures(a)))
        if i % 7 == 0:
            assert r.near_edited == pytest.approx(likeness(a, e)) and r.near_next == pytest.approx(likeness(a, b))
    assert all(len(sets) == 1 for sets in prints.values())


def test_op5_archives_every_page(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    best = {}
    for r in pages:
        best[r.html or ""] = max(best.get(r.html or "", -1), r.page_id)
    want = Counter()
    for r in pages:
        data = (r.html or "").encode()
        revisit = len(data) >= 1000 and r.page_id < best[r.html or ""]
        want[r.page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", best[r.html] if revisit else None] += 1
    got = queries.QUERIES["op5_warc"](spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == want
