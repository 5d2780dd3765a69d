import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallow.llm import components, jaccard_join, quality, queries, spotsigs


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def shingles(t, k):
    w = [lower(x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def slow_classes(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[max(top(x), top(y))] = min(top(x), top(y))
    least = {}
    for x, (i, _) in enumerate(sets):
        least[top(x)] = min(i, least.get(top(x), i))
    return sorted((i, len(s), least[top(x)]) for x, (i, s) in enumerate(sets))


def variants(rng, base, n, most):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_join_agrees_with_all_pairs(spark, k, percent):
    rng = random.Random(k)
    draw = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    line = draw(12)
    texts = [None, "", "  \n", "one", "One", "two words", "a b c", "a b c d", "A b c d"]
    for n, m in ((60, 4), (150, 8), (400, 20), (1200, 40)):
        texts += variants(rng, draw(n), 25, m)
    texts += [line + " " + draw(rng.randrange(1, 60)) for _ in range(60)]
    common = draw(100)
    texts += variants(rng, common, 120, 6) + [common] * 5
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = sorted(tuple(r) for r in jaccard_join.Join(docs, k=k, percent=percent, tokens_a_bucket=4).classes().collect())
    assert got == slow_classes(rows, k, percent)


def test_join_cases(spark):
    schema = "doc_id long, text string, key string"
    t = "one two three four five six"
    docs = spark.createDataFrame([(5, t, "x"), (5, t, "x"), (None, t, "x"), (2, t, "x"), (None, "alone it stands here", "x"), (9, None, "x")], schema)
    got = sorted((tuple(r) for r in jaccard_join.Join(docs).classes().collect()), key=str)
    assert got == sorted([(5, 3, 2), (5, 3, 2), (None, 3, 2), (2, 3, 2), (None, 1, None), (9, 0, 9)], key=str)
    assert jaccard_join.Join(docs.limit(0)).classes().count() == 0


def test_every_pair_that_links_shares_an_index_key():
    rng = np.random.default_rng(3)
    for n in (5, 30, 64, 130, 300, 700):
        for _ in range(40):
            x = np.unique(rng.integers(0, 1 << 60, n, np.uint64))
            gone = rng.integers(0, jaccard_join.most_missing(len(x), 85) + 1)
            y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 1 << 60, rng.integers(0, 1 + len(x) // 8), np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both < 85 * (len(x) + len(y) - both):
                continue
            often = lambda s: (s % np.uint64(10)) < np.uint64(8)
            sides = []
            for s in (x, y):
                s = s[np.lexsort((s, often(s)))]
                sides.append((len(s), dict(zip(*(v.tolist() for v in jaccard_join.index_keys(s, often(s), 85))))))
            (nx, kx), (ny, ky) = sides
            assert any((nx - kx[k]) * 185 >= 85 * (nx + ny) and (ny - ky[k]) * 185 >= 85 * (nx + ny) for k in kx.keys() & ky.keys())


def test_components(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_signatures(text):
    w = [lower(x) for x in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
    content = [i for i, x in enumerate(w) if x not in spotsigs.ANCHORS]
    out = set()
    for i, x in enumerate(w):
        follow = [w[j] for j in content if j > i][:2]
        if x in spotsigs.ANCHORS and follow:
            out.add((x, *follow))
    return out or {(x, *w[i + 1 : i + 3]) for i, x in enumerate(w)}


def likeness(a, b):
    a, b = slow_signatures(a), slow_signatures(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_agree_with_sets(spark, monkeypatch):
    rng = random.Random(1)
    words = ["the", "of", "cat", "Dog", "été", "runs", "and", "x1", "blue,", "le"]
    texts = [None, "", "!!", "the", "cat", "the of"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(i * 3, t, 0.0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_next double")
    whole = spotsigs.in_order
    for size in (1 << 20, 200):
        monkeypatch.setattr(spotsigs, "in_order", lambda d, k="doc_id", t="text", part_bytes=size: whole(d, k, t, part_bytes))
        got = spotsigs.with_edits(docs).orderBy("doc_id").collect()
        assert [r.doc_id for r in got] == [r[0] for r in rows]
        for i, r in enumerate(got):
            a, b = texts[i] or "", texts[(i + 1) % len(texts)] or ""
            e = spotsigs.edited(a, b)
            assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            assert r.near_edited == pytest.approx(likeness(a, e)) and r.near_next == pytest.approx(likeness(a, b))
    prints = Counter((r.fingerprint, len(slow_signatures(texts[i] or ""))) for i, r in enumerate(got))
    assert all(len(p) == 4 * -(-4 * n // 3) for p, n in prints)
    assert spotsigs.with_edits(docs.limit(0)).count() == 0
    assert spotsigs.with_edits(docs.limit(1)).count() == 1
    assert spotsigs.with_edits(docs.unionByName(docs).withColumn("doc_id", F.when(F.col("doc_id") > 6, F.col("doc_id")))).count() == 2 * len(rows)


def test_classes_join_all_pairs_alike(spark):
    rng = random.Random(5)
    base = " ".join(rng.choice(["the", "of", "and"]) + f" w{i} v{i}" for i in range(60))
    texts = variants(rng, base, 30, 8) + [" ".join(f"the a{rng.randrange(999)} b{rng.randrange(999)}" for _ in range(40)) for _ in range(20)] + [base, base]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in spotsigs.with_classes(spotsigs.fingerprints(docs), docs).collect()}
    up = list(range(len(texts)))
    for x in range(len(texts)):
        for y in range(x):
            if likeness(texts[x], texts[y]) >= 0.8:
                a, b = up[x], up[y]
                up = [min(a, b) if u in (a, b) else u for u in up]
    assert got == dict(enumerate(up)) and len(set(up)) < len(up)


def test_quality_gradients_are_right():
    texts = [(f"word {i} " * (i * 20 + 1)).encode() for i in range(12)] + [b""]
    y = np.arange(13) % 2
    m = quality.AttentionModel().fit(texts, y, epochs=1)
    f, counts = quality.passages(texts)
    f = f.astype(float)
    m.weights = [w.astype(float) for w in m.weights]
    loss = lambda: float(-(y * np.log(m._forward(f, counts)["p"]) + (1 - y) * np.log(1 - m._forward(f, counts)["p"])).mean())
    for w, g in zip(m.weights, m._gradients(f, counts, y)):
        flat, i = w.reshape(-1), w.size // 3
        flat[i] += 1e-5
        up = loss()
        flat[i] -= 2e-5
        down = loss()
        flat[i] += 1e-5
        assert g.reshape(-1)[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_quality_cases(spark):
    rows = [(i, ("fine words here " * 20 if i % 2 else "$$$ ### !! " * 20), i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(90, None, "s"), (91, "", "s"), (92, "x" * 700_000, "s"), (1, rows[1][1], "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(91, None, 0)], "doc_id long, quality int, score int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.quality_score.score for r in quality.with_scores(docs, model).collect()}
    assert got[1] > 0.7 > 0.3 > got[2] and got[90] == got[91] and all(0 <= s <= 1 for s in got.values())
    alike = quality.with_scores(docs, quality.fit(docs, labels.filter("quality = 1"))).select("quality_score.score").distinct().collect()
    assert [r.score for r in alike] == [1.0]
    assert quality.with_scores(docs.limit(0), quality.fit(docs, labels.limit(0))).count() == 0


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    q = queries.QUERIES["op7_quality"](spark, sf).toPandas()
    m = q.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = m[m.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    good, poor = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean([(g > p) for g in good for p in poor]) > 0.95


def test_labels_repeated_often_stay_bounded(spark):
    docs = spark.createDataFrame([(i, f"word {i} here") for i in range(40)] + [(0, "word")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1)] * 3000 + [(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert all(0 <= r.quality_score.score <= 1 for r in quality.with_scores(docs, quality.fit(docs, labels, most_rows=10)).collect())
