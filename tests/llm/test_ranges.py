"""Even parts of keys: archives and ordered texts do not depend on how the rows are dealt, nor on keys with many rows."""

import glob
import hashlib
import os
import random
from collections import Counter

import pytest

from tallow.llm import ranges, spotsigs, warc
from tallow.llm.common import new_dir

rng = random.Random(3)
PAGES = [(i, f"http://h/{i % 7}", ("x%d " % (i % 50)) * rng.randrange(1, 900)) for i in range(300)] + [(None, None, "")] * 400 + [(7777, "u", "same " * 300)] * 500 + [(None, f"n{i}", "") for i in range(200)] + [(9000 + i, f"r{i}", "again " * (200 + i % 3)) for i in range(40)]


def dealt(spark, rows, schema, seed, parts):
    rows = rows[:]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, schema).repartition(parts)


def test_archives_are_the_same_byte_for_byte(spark):
    seen = []
    for seed, parts in ((1, 3), (2, 7)):
        base = new_dir(spark, "w")
        manifest = sorted(map(tuple, warc.write(dealt(spark, PAGES, "page_id long, url string, html string", seed, parts), base, shard_bytes=200_000, roll_bytes=8_000).collect()))
        here = base.removeprefix("file://")
        assert sorted(os.listdir(here)) == sorted({"manifest"} | {m[0] for m in manifest})
        seen.append((manifest, {os.path.basename(f): hashlib.sha256(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{here}/*.gz")}))
    assert seen[0] == seen[1]
    shards = Counter()
    for name, records, *_ in seen[0][0]:
        shards[name[:12]] += records
    assert len(shards) >= 4 and sum(shards.values()) == len(PAGES) and len(seen[0][0]) > len(shards)
    best = {}
    for i, _, h in PAGES:
        if i is not None and len(h) >= 1000:
            best[h] = max(best.get(h, -1), i)
    want = Counter()
    for i, _, h in PAGES:
        revisit = i is not None and len(h) >= 1000 and i < best[h]
        want[i, len(h), hashlib.sha1(h.encode()).hexdigest(), "revisit" if revisit else "response", best[h] if revisit else None] += 1
    got = warc.read(spark, base).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == want


def test_revisits_name_their_records_and_ids_are_unique(spark):
    base = new_dir(spark, "w")
    warc.write(spark.createDataFrame(PAGES, "page_id long, url string, html string"), base, shard_bytes=200_000)
    ids, refers = [], set()
    for f in glob.glob(base.removeprefix("file://") + "/*.gz"):
        with open(f, "rb") as stream:
            found = list(warc.records(stream))
        assert found[0][0]["warc-type"] == "warcinfo" and found[0][0]["warc-filename"] == os.path.basename(f)
        for headers, _ in found:
            ids.append(headers["warc-record-id"])
            if headers["warc-type"] == "revisit":
                refers.add(headers["warc-refers-to"])
    assert len(set(ids)) == len(ids) and refers and refers <= set(ids)


@pytest.mark.parametrize("size", [1 << 20, 3000, 500])
def test_texts_in_order_with_ids_and_texts_of_many_rows(spark, monkeypatch, size):
    whole = spotsigs.in_order
    monkeypatch.setattr(spotsigs, "in_order", lambda d, k="doc_id", t="text": whole(d, k, t, size))
    texts = [" ".join(rng.choice(["the", "of", "cat", "dog", "a", "runs", "x1"]) for _ in range(rng.randrange(80))) for _ in range(60)]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)] + [(33, "the cat runs of old")] * 300 + [(None, None)] * 150
    order = sorted(rows, key=lambda d: (d[0] is not None, d[0] or 0, hashlib.sha1((d[1] or "").encode()).hexdigest()))
    want = Counter()
    for (i, a), (_, b) in zip(order, order[1:] + order[:1]):
        want[i, len(a or ""), hashlib.sha256(spotsigs.edited(a or "", b or "").encode()).hexdigest()] += 1
    got = spotsigs.with_edits(dealt(spark, rows, "doc_id long, text string", 4, 5)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want


def test_parts_are_even(spark):
    keys = spark.createDataFrame([(f"{i:05d}", 1 + i % 13, 1 + (i == 700) * 900) for i in range(2000)], "key string, weight long, copies long")
    parts = ranges.even_parts(keys, 500)
    load = Counter()
    for i in range(2000):
        key = f"{i:05d}"
        for part, _, copies in parts.pieces.get(key, [(int(parts.number[parts.of([key])[0]]), 0, 1 + (i == 700) * 900)]):
            load[part] += copies * (1 + i % 13)
    assert max(load.values()) < 2 * sorted(load.values())[len(load) // 2] and sum(c for _, _, c in parts.pieces["00700"]) == 901
    assert len(ranges.even_parts(keys, 1, most_parts=10).number) <= 10
    assert ranges.even_parts(keys.limit(0), 500).n == 1
