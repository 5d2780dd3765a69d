"""Near duplicates by spot signatures against all pairs."""

import random

import numpy as np

from tallow.llm import jaccard_join, queries, spotsigs
from test_texts import slow_signatures, variants


def slow_classes(rows, percent=80):
    sets = [(i, slow_signatures(t or "")) for i, t in rows]
    holders, up = {}, {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets:
        shared = {}
        for x in s:
            for j, n in holders.get(x, ()):
                shared[j] = shared.get(j, 0) + 1
        sizes = dict(holders.get(None, ()))
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + sizes[j] - n):
                up[max(top(i), top(j))] = min(top(i), top(j))
        for x in s:
            holders.setdefault(x, []).append((i, 0))
        holders.setdefault(None, []).append((i, len(s)))
    return {i: top(i) for i, _ in rows}


def test_partners_share_a_range_and_a_token():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 30, 150, 700):
        for _ in range(30):
            x = np.unique(rng.integers(0, 1 << 60, n, np.uint64))
            gone = rng.integers(0, jaccard_join.most_missing(len(x), 80) + 1)
            y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 1 << 60, rng.integers(0, 1 + len(x) // 8), np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both) and both:
                assert set(spotsigs.range_keys(x, 80)[0].tolist()) & set(spotsigs.range_keys(y, 80)[0].tolist())


def test_classes_agree_with_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "of", "and"]) + f" w{rng.randrange(3000)} v{rng.randrange(3000)}"
    texts = [None, "", "!!", "cat", "cat"]
    for n in (12, 60, 200):
        base = " ".join(word() for _ in range(n))
        texts += variants(rng, base, 25, max(2, n // 5))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in spotsigs.with_classes(docs.select("doc_id"), docs).collect()}
    assert got == slow_classes(rows) and len(set(got.values())) < len(got) - 10
    assert spotsigs.with_classes(docs.select("doc_id").limit(0), docs.limit(0)).count() == 0


def test_op9_classes_of_the_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in queries.QUERIES["op9_fingerprints"](spark, sf).select("doc_id", "class_id").collect()}
    assert got == slow_classes(rows)
