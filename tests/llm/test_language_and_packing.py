import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallow.llm import language_id, packing, queries

EN, FR = "the cat sat on the mat and the dog ran", "le chat est sur la table et le chien court"


def slow_bits(samples, order, text):
    """Code length of a text in one language, straight from counts."""
    counts = [{} for _ in range(order + 1)]
    for t in samples:
        for i in range(len(t)):
            for k in range(min(order, i) + 1):
                row = counts[k].setdefault(t[i - k : i], {})
                row[t[i]] = row.get(t[i], 0) + 1
    bits = 0.0
    for i in range(len(text)):
        for k in range(min(order, i), -1, -1):
            row = counts[k].get(text[i - k : i])
            if row is None:
                continue
            n, d = sum(row.values()), len(row)
            if text[i] in row:
                bits -= np.log2(row[text[i]] / (n + d))
                break
            bits -= np.log2(d / (n + d))
        else:
            bits += 8
    return bits


@given(st.lists(st.text("abc é", max_size=30), min_size=1, max_size=4), st.text("abcd é", max_size=40))
@settings(max_examples=60, deadline=None)
def test_code_lengths_are_exact(samples, text):
    own = {"x": [s.encode() for s in samples], "y": [b"bca abc"]}
    trees = language_id.ContextTrees(own, 3)
    got = trees.code_lengths([text.encode()])[0]
    for i, l in enumerate(trees.languages):
        assert got[i] == pytest.approx(slow_bits(own[l], 3, text.encode()), abs=1e-2)


def test_long_texts_go_in_blocks(monkeypatch):
    trees = language_id.ContextTrees({"en": [EN.encode()], "fr": [FR.encode()]}, 4)
    text = (EN + " " + FR).encode() * 50
    whole = trees.code_lengths([text])
    monkeypatch.setattr(language_id, "_BLOCK", 97)
    np.testing.assert_allclose(trees.code_lengths([text]), whole, rtol=1e-4)


def test_language_cases(spark):
    rows = [(1, EN * 3, "en", "s"), (2, FR * 3, "fr", None), (None, FR, None, "s"), (4, None, "en", "s"), (5, "", None, "s"), (6, "123 !!", None, "s"), (7, EN, None, "s"), (7, EN, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language_id.identify(docs, language_id.fit(docs)).collect()
    by = {(r.doc_id, r.text): r.language for r in got}
    assert by[7, EN].lang_pred == "en" and by[None, FR].lang_pred == "fr" and len(got) == 8 and got[0].score == "s"
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in ((4, None), (5, ""), (6, "123 !!")))
    empty = docs.limit(0)
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert language_id.identify(docs, language_id.fit(docs.withColumn("lang", docs.lang.substr(9, 0)).filter("false"))).filter("language.lang_pred <> 'und'").count() == 0


def test_held_out_accuracy(spark):
    q = queries.QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    m = q.merge(lang, on="doc_id")
    held = m[m.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (held.lang_pred == held.lang).mean() > 0.98


@given(st.lists(st.integers(1, 50), max_size=80))
@settings(max_examples=100, deadline=None)
def test_best_fit_and_its_bound(sizes):
    where, offset, left = packing.best_fit(sizes, 50)
    used = np.zeros(len(left), int)
    for i in sorted(range(len(sizes)), key=lambda i: (where[i], offset[i])):
        assert offset[i] == used[where[i]]
        used[where[i]] += sizes[i]
    assert (used <= 50).all() and (50 - used).tolist() == left
    assert packing.lower_bound(np.bincount(sizes, minlength=51).astype(int)) <= len(left)


def test_bound_of_items_that_cannot_pair():
    assert packing.lower_bound(np.bincount([26] * 7, minlength=51)) == 7
    assert packing.lower_bound(np.bincount([17] * 6, minlength=51)) == 3


def test_only_long_documents_are_cut():
    assert [p[:2] for p in packing.cut(np.arange(4096, dtype="<u4"), 2048, 0)] == [(0, 1), (1, 2048), (2049, 2048)]
    assert [p[:2] for p in packing.cut(np.arange(2047, dtype="<u4"), 2048, 0)] == [(0, 2048)]
    assert packing.cut(np.zeros(0, "<u4"), 2048, 0) == [(0, 1, zlib.crc32(b"\0\0\0\0"))]


def test_packing_cases(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    slow = packing.tokenizer(path)[0]
    for t in ("", "a  b\n\n c", "<|endoftext|> x", "日本語 ½ x²", "don't 'll\t1234"):
        assert packing.encode(t, path).tolist() == slow.encode(t, add_special_tokens=False).ids
    texts = [None, "", EN, EN, "word " * 6000, "日本 " * 50, *[EN * (i % 40 + 1) for i in range(200)]]
    rows = [(i if i != 2 else None, t, 1.0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length double")
    whole = packing.pieces(docs, path)
    got = packing.pack(whole, rows_a_partition=50).toPandas()
    assert len(got) == whole.count() and got.groupby("sequence_id").length.sum().max() <= 2048
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length.to_numpy())[:-1].tolist()]
    c = packing.certificate(packing.pack(whole))
    assert c["bound"] <= c["bins"] <= got.sequence_id.nunique() <= c["bound"] + 1
    assert set(got.bins) == {got.sequence_id.nunique()} and set(got.bound) == {c["bound"]}
    assert packing.pack(packing.pieces(docs.limit(0), path)).count() == 0


def test_exchange_ends_at_the_bound_however_small_the_partitions(spark):
    rng = np.random.default_rng(1)
    sizes = np.concatenate([rng.integers(1, 700, 3000), rng.integers(1, 40, 1000), [2048] * 20]).tolist()
    rows = spark.createDataFrame([(i, 0, 0, s, i) for i, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    for least, most in ((400, 1.005), (60, 1.03)):
        got = packing.pack(rows, rows_a_partition=least).toPandas()
        assert sorted(got.length) == sorted(sizes) and (got.groupby("sequence_id").length.sum() <= 2048).all()
        assert got.sequence_id.nunique() == got.bins[0] <= most * got.bound[0]
    # no two of these fit together, so that the bound is met; of those below it is not, and the rounds end all the same
    for sizes, bins in (([1100] * 50, 50), ([1024 + 1, 1023 - 300, 301 + 20] * 30, None), ([800, 700, 548, 549] * 40, None)):
        rows = spark.createDataFrame([(i, 0, 0, s, i) for i, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
        got = packing.pack(rows, rows_a_partition=20).toPandas()
        assert got.sequence_id.nunique() == got.bins[0] == (bins or got.bins[0]) >= got.bound[0]


def test_both_encoders_agree():
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    slow, fast = packing.tokenizer(path)
    assert fast is not None
    rng = np.random.default_rng(5)
    alphabet = list(" \t\n'.,;:!?0123456789abcdefghijklmnopqrstuvwxyzABCXYZéüßñøæČłŐ-_/\\()[]{}<>|@#$%^&*+=~`\"") + ["the ", "ing", "'s", "n't", " and", "http://", "\r\n", "  ", "\x00", "\u00a0", "\u0085"]
    for n in (3, 12, 60):
        for _ in range(4000):
            t = "".join(rng.choice(alphabet, rng.integers(1, n)))
            assert packing.encode(t, path).tolist() == slow.encode(t, add_special_tokens=False).ids, t


def test_merges_out_of_order_take_the_library(tmp_path):
    P = pytest.importorskip("public_tokenizers")
    spec = json.load(open(P.path("byte_bpe_50k.json"), encoding="utf-8"))
    spec["model"]["merges"][10], spec["model"]["merges"][4000] = spec["model"]["merges"][4000], spec["model"]["merges"][10]
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    slow, fast = packing.tokenizer(str(other))
    assert fast is None and packing.encode("some plain words", str(other)).tolist() == slow.encode("some plain words", add_special_tokens=False).ids


def test_op2_gives_every_piece_of_every_document(spark):
    P = pytest.importorskip("public_tokenizers")
    slow = packing.tokenizer(P.path("byte_bpe_50k.json"))[0]
    got = queries.QUERIES["op2_best_fit_packing"](spark, "/root/testdata/sf0.01").toPandas().sort_values(["doc_id", "piece"])
    want = []
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect():
        ids = np.array(slow.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        end, piece = len(ids) % 2048 or 2048, 0
        start = 0
        while start < len(ids):
            want.append((r.doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            start, end, piece = end, end + 2048, piece + 1
    assert list(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length.to_numpy())[:-1].tolist()] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() == got.bins.iloc[0] == got.bound.iloc[0]
