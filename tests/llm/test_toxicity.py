"""The chain's marginals and gradients against enumeration, tagging of planted words, and held-out labels of the query."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallow.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def enumerated(e, edges, starts):
    """Marginals of the toxic tag of one chain, from all taggings."""
    total, out = 0.0, np.zeros(len(e))
    for tags in itertools.product((0, 1), repeat=len(e)):
        weight = np.exp(starts[tags[0]] + sum(edges[a, b] for a, b in zip(tags, tags[1:])) + sum(x for x, t in zip(e, tags) if t))
        total += weight
        out += weight * np.array(tags)
    return out / total


def test_marginals_of_chains_side_by_side():
    rng = np.random.default_rng(0)
    edges, starts = rng.normal(size=(2, 2)), rng.normal(size=2)
    chains = [rng.normal(0, 3, n) for n in (1, 2, 9, 3, 12, 1, *[7] * 40)]
    begins = np.cumsum([0, *map(len, chains)])[:-1]
    got = toxicity.marginals(np.exp(np.concatenate(chains)), begins, np.exp(edges), np.exp(starts))
    np.testing.assert_allclose(got, np.concatenate([enumerated(e, edges, starts) for e in chains]), rtol=1e-9)
    # a long chain: the same in one piece and word by word
    e = np.append(rng.normal(0, 3, 700), [30.0] * 300)
    got, a, x = toxicity.marginals(np.exp(e), np.array([0]), np.exp(edges), np.exp(starts)), np.exp(edges), np.exp(e)
    ahead, back = [np.exp(starts) * (1, x[0])], [np.ones(2)]
    for k in range(1, len(e)):
        ahead.append(ahead[-1] @ a * (1, x[k]))
        ahead[-1] /= ahead[-1].sum()
    for k in range(len(e) - 1, 0, -1):
        back.append(a @ ((1, x[k]) * back[-1]))
        back[-1] /= back[-1].sum()
    both = np.array(ahead) * np.array(back[::-1])
    np.testing.assert_allclose(got, both[:, 1] / both.sum(axis=1), rtol=1e-9)


def test_gradients_are_those_of_the_likelihood():
    rng = np.random.default_rng(1)
    m = toxicity.ToxicTagger()
    m.weights, m.edges, m.starts = rng.normal(0, 0.3, 1 << toxicity._BITS), rng.normal(size=(2, 2)), rng.normal(size=2)
    features = rng.integers(0, 50, (3, 6, toxicity.N_FEATURES))
    there = np.arange(6) < np.array([6, 3, 1])[:, None]
    tags = (rng.random((3, 6)) < 0.4) & there
    steps = m.gradients(features, there, tags)
    for values, gradient in zip((m.weights, m.edges, m.starts), steps):
        for at in list(np.ndindex(values.shape))[:50]:
            was, d = values[at], 1e-5
            values[at] = was + d
            up = m.likelihood(features, there, tags)
            values[at] = was - d
            down = m.likelihood(features, there, tags)
            values[at] = was
            assert gradient[at] == pytest.approx((up - down) / (2 * d), abs=1e-4)


def made(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    out = []
    for i in range(n):
        text, label = [rng.choice(words) for _ in range(rng.randrange(3, 60))], int(rng.random() < 0.2)
        for _ in range(rng.randrange(1, 4) if label else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["Vile", "rotten", "écœurant"]))
        out.append((i, " ".join(text), label if rng.random() > 0.03 else 1 - label))
    return out


def test_planted_words_are_tagged_with_their_offsets():
    rows = made(1)
    m = toxicity.ToxicTagger().fit([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows]))
    texts = ["é w1 w2 écœurant, w3 rotten vile w4", "w1 w2 w3", "", "rotten"]
    score, spans = m.score([t.encode() for t in texts])
    assert [[t[a:b] for a, b, _ in s] for t, s in zip(texts, spans)] == [["écœurant", "rotten vile"], [], [], ["rotten"]]
    assert score[0] > 0.5 > score[1] and score[3] > 0.5 and score[2] < 0.3
    more = toxicity.ToxicTagger().fit([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows]))
    assert np.array_equal(more.score([t.encode() for t in texts])[0], score)


def test_copies_of_one_document_teach_no_words(spark):
    rows = made(2) + [(1000 + i, f"peculiar story about harmless things {i}", 1) for i in range(30)]
    texts, y = [t.encode() for _, t, _ in rows], np.array([float(x) for *_, x in rows])
    _, bounds, hashes, *_ = toxicity.tokens(texts)
    from tallow.llm.wordhash import word

    found = set(toxicity.offending_words(hashes, bounds, y).tolist())
    assert {word("vile"), word("rotten")} <= found and not found & {word("peculiar"), word("story"), word("harmless")}


def test_nulls_ties_odd_columns_and_few_labels(spark):
    rows = [(None, None, 1), (1, "", 0), (1, "a b", 1), (1, "a b", None), (2, "x " * 3000, 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumns({c: F.lit(7) for c in ("score", "key", "y", "toxicity", "ok")})
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int").withColumn("text", F.lit("other"))
    scored = toxicity.with_scores(docs, toxicity.fit(docs, labels))
    got = scored.select("doc_id", "text", "toxicity.score").collect()
    assert scored.columns == docs.columns and len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.text == "a b"}) == 1
    assert [r.toxicity.score for r in toxicity.with_scores(docs, toxicity.fit(docs, labels.filter("toxic = 1"))).collect()] == [1.0] * 5
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.toxicity.score for r in toxicity.with_scores(docs, none).collect()} == {0.5}
    assert toxicity.with_scores(docs.limit(0), none).count() == 0


def test_held_out_labels_of_the_query(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None}
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    got = queries.QUERIES["op13_toxicity"](spark, SF).collect()
    assert len(got) == docs and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in got)
    told = [(labels[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in labels]
    toxic, clean = [s for y, s in told if y], [s for y, s in told if not y]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.9
    assert np.mean([s >= 0.3 for s in toxic]) > 0.85 and np.mean([s < 0.3 for s in clean]) > 0.97
