"""Ids that several texts share, rows without an id, and joins that broadcast nothing."""

import random

import pytest

from tallow.llm import common, jaccard_join, queries
from test_texts import shingles, slow_classes, variants

corpus_pipeline = pytest.importorskip("corpus_pipeline")

rng = random.Random(9)
draw = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
near = lambda t: t + " tail"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def doc(i, t):
    return (i, t, "en", "s", len(t or ""))


def test_one_id_with_two_texts_links_each_by_its_own(spark):
    q, w = draw(80), draw(80)
    rows = [(1, q), (2, w), (5, near(w)), (5, near(q))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.Join(spark.createDataFrame(rows, "doc_id long, text string")).classes().collect())
    assert got == sorted([(1, 77, 1), (2, 77, 2), (5, 78, 2), (5, 78, 1)])


def test_rows_without_an_id_link_by_their_texts(spark):
    q, w, x = draw(80), draw(80), draw(60)
    rows = [(4, q), (None, near(q)), (None, near(q)), (None, w), (None, near(w)), (7, x), (7, x), (3, near(x))]
    join = jaccard_join.Join(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in join.classes().collect())
    assert got == sorted([("4", 77, "4"), ("None", 78, "4"), ("None", 78, "4"), ("None", 77, "None"), ("None", 78, "None"), ("7", 57, "3"), ("7", 57, "3"), ("3", 58, "3")])


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_links_do_not_depend_on_what_is_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BROADCAST", most)
    texts = variants(rng, draw(120), 30, 10) + variants(rng, draw(300), 20, 20) + [draw(30)] * 3 + [None, "a"]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.Join(docs).classes().collect())
    lasting = slow_classes([(10**6 + j if i is None else i, t) for j, (i, t) in enumerate(rows)], 4, 85)
    plain = lambda i: "None" if i >= 10**6 else str(i)
    assert got == sorted((plain(i), n, plain(c)) for i, n, c in lasting)


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_the_pipeline_loses_no_text(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BROADCAST", most)
    a, b, c, d = draw(80), draw(80), draw(80), draw(80)
    docs = rows_of(spark, [doc(1, a), doc(5, a), doc(5, b), doc(None, near(a)), doc(None, c), doc(None, c), doc(6, d), doc(6, d), doc(6, d.upper()), doc(8, near(d)), doc(9, None), doc(9, None)])
    got = sorted((str(r.doc_id), str(r.text)) for r in corpus_pipeline.duplicate_stage(spark, docs, "").collect())
    assert got == sorted([("1", a), ("5", b), ("None", c), ("6", d.upper()), ("9", "None"), ("9", "None")])


def test_only_rows_without_an_id(spark):
    a, b = draw(80), draw(80)
    docs = rows_of(spark, [doc(None, a), doc(None, near(a)), doc(None, b), doc(None, b)])
    kept = [r.text for r in corpus_pipeline.duplicate_stage(spark, docs, "").collect()]
    assert len(kept) == 2 and b in kept and (a in kept) != (near(a) in kept)


def test_op8_agrees_with_all_pairs_of_the_documents(spark):
    """Every row of the table; candidate pairs of the slow side by any shared shingle."""
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    sets = {i: shingles(t, 4) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        shared = {}
        for x in sets[a]:
            for b in holders[x]:
                if b < a:
                    shared[b] = shared.get(b, 0) + 1
        for b, n in shared.items():
            if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                up[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op8_jaccard_join"](spark, sf).collect()}
    assert got == {i: (len(s), top(i)) for i, s in sets.items()}
