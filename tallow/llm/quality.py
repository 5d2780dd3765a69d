"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE`` bytes of its UTF-8 text each). Every passage is described by
the shares of its bytes by kind and of its pairs of neighbouring kinds, and encoded by a learned layer.
Gated attention, learned from the documents' labels alone, weighs the passages; the weighted mean of
their codes is the document's representation, which a logistic unit scores.

Fitting: a bounded sample of labelled rows (``most_rows`` rows, chosen by hash; of them at most
``most_bytes`` of text, whole texts). Scoring covers every passage of every row.

Cases: null and empty text is one passage without bytes and gets a score; labels that are null are left
out; equal texts get equal scores; without labels of both kinds the score is the labels' mean (0.5 where
there is none); an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import release, ship

PASSAGE = 512
_BLOCK = 1 << 20


def _kinds() -> tuple[np.ndarray, np.ndarray, int]:
    """Per byte: its kind (letters, punctuation marks and white space apart; other bytes in groups), and its coarse kind."""
    kind = np.zeros(256, np.int64)
    coarse = np.full(256, 7, np.int64)
    n = 0

    def put(codes, as_one: bool, group: int) -> None:
        nonlocal n
        for c in codes:
            kind[c], coarse[c] = n, group
            n += not as_one
        n += as_one

    put(range(ord("a"), ord("z") + 1), False, 0)
    put(range(ord("A"), ord("Z") + 1), True, 1)
    put(range(ord("0"), ord("9") + 1), True, 2)
    put(b" ", False, 3)
    put(b"\n\r", True, 4)
    put(b".,;:?'\"()-", False, 5)
    put(b"!#$%&*+/<=>@[\\]^_`{|}~", False, 6)
    put(range(128, 192), True, 7)
    put(range(192, 256), True, 7)
    put([c for c in range(32) if c not in b"\n\r"] + [127], True, 6)
    return kind, coarse, n


_KIND, _COARSE, _N_KINDS = _kinds()
N_FEATURES = _N_KINDS + 64


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and how many each text has (one at least)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    out = np.zeros((int(counts.sum()), N_FEATURES), np.float32)
    first = np.cumsum(counts) - counts
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + sizes[end] <= _BLOCK):
            size += sizes[end]
            end += 1
        data = np.frombuffer(b"".join(texts[begin:end]), np.uint8)
        own = sizes[begin:end]
        place = np.arange(len(data)) - np.repeat(np.cumsum(own) - own, own)
        owner = np.repeat(first[begin:end] - first[begin], own) + place // PASSAGE
        n = int(counts[begin:end].sum())
        single = np.bincount(owner * _N_KINDS + _KIND[data], minlength=n * _N_KINDS).reshape(n, _N_KINDS)
        c = _COARSE[data]
        same = owner[1:] == owner[:-1]
        pair = np.bincount((owner[1:] * 64 + c[:-1] * 8 + c[1:])[same], minlength=n * 64).reshape(n, 64)
        part = out[first[begin] : first[begin] + n]
        part[:, :_N_KINDS] = np.sqrt(single / np.maximum(1, single.sum(axis=1, keepdims=True)))
        part[:, _N_KINDS:] = np.sqrt(pair / np.maximum(1, pair.sum(axis=1, keepdims=True)))
        begin = end
    return out, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Passage encoder, gated attention and the unit that scores; plain numpy, fitted by Adam."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.weights = prior, None

    def _forward(self, f: np.ndarray, counts: np.ndarray) -> dict:
        w1, b1, v, u, w, c, b = self.weights
        first = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(counts)), counts)
        h = np.tanh(f @ w1 + b1)
        t, g = np.tanh(h @ v), _sigmoid(h @ u)
        e = (t * g) @ w
        e = np.exp(e - np.maximum.reduceat(e, first)[owner])
        a = e / np.add.reduceat(e, first)[owner]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"first": first, "owner": owner, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ c + b[0])}

    def fit(self, texts: list[bytes], y: np.ndarray, hidden: int = 32, gates: int = 16, epochs: int = 25, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> AttentionModel:
        y = np.asarray(y, np.float64)
        self.prior = float(y.mean()) if len(y) else 0.5
        if len(y) == 0 or y.min() == y.max():
            return self
        rng = np.random.default_rng(seed)
        f, counts = passages(texts)
        self.mean, self.scale = f.mean(axis=0), f.std(axis=0) + 1e-2
        f = (f - self.mean) / self.scale
        draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
        self.weights = [draw(N_FEATURES, hidden), np.zeros(hidden), draw(hidden, gates), draw(hidden, gates), draw(gates), draw(hidden), np.array([np.log(self.prior / (1 - self.prior))])]
        m, s = [np.zeros_like(x) for x in self.weights], [np.zeros_like(x) for x in self.weights]
        first, step = np.cumsum(counts) - counts, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                rows = order[i : i + batch]
                at = np.concatenate([np.arange(first[r], first[r] + counts[r]) for r in rows])
                step += 1
                for k, g in enumerate(self._gradients(f[at], counts[rows], y[rows])):
                    g = g + decay * self.weights[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.weights[k] = self.weights[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        self.weights = [x.astype(np.float32) for x in self.weights]
        return self

    def _gradients(self, f: np.ndarray, counts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w1, b1, v, u, w, c, b = self.weights
        x = self._forward(f, counts)
        h, t, g, a, owner = x["h"], x["t"], x["g"], x["a"], x["owner"]
        ds = (x["p"] - y) / len(y)
        dz = (ds[:, None] * c)[owner]
        da = (h * dz).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, x["first"])[owner])
        gate = de[:, None] * w
        dt, dg = gate * g * (1 - t * t), gate * t * g * (1 - g)
        dh = a[:, None] * dz + dt @ v.T + dg @ u.T
        pre = dh * (1 - h * h)
        return [f.T @ pre, pre.sum(axis=0), h.T @ dt, h.T @ dg, (t * g).T @ de, x["z"].T @ ds, np.array([ds.sum()])]

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Probability of label 1, and the largest attention weight of a passage."""
        if not texts or self.weights is None:
            return np.full(len(texts), self.prior), np.ones(len(texts))
        f, counts = passages(texts)
        x = self._forward((f - self.mean.astype(np.float32)) / self.scale.astype(np.float32), counts)
        return x["p"].astype(np.float64), np.maximum.reduceat(x["a"], x["first"]).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", where: Column | None = None, most_rows: int = 4000, most_bytes: int = 32 << 20) -> AttentionModel:
    """A model from a sample of the labelled rows for which `where` (over `key`) holds: about most_rows ids by hash (an id
    with both labels counts with each, repeated labels once), most_bytes of text, twice most_rows texts at most."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"), (where if where is not None else F.lit(True)).alias("ok")).filter("ok and y is not null").select("key", "y").distinct()
    n = known.count()
    chosen = known.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.lit(min(1.0, most_rows / max(1, n)) * 1_000_000))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).join(F.broadcast(chosen), "key")
    texts, y, size = [], [], 0
    for r in rows.orderBy(F.xxhash64("key"), "key", "text", "y").toLocalIterator():
        t = bytes(r.text or b"")
        if size >= most_bytes or len(texts) >= 2 * most_rows:
            break
        if size + len(t) <= most_bytes or not texts:
            texts.append(t)
            y.append(r.y)
            size += len(t)
    return AttentionModel().fit(texts, np.array(y, float))


def with_scores(docs: DataFrame, model: AttentionModel, text: str = "text", out: str = "quality_score") -> DataFrame:
    """docs and a struct column: score, attention (the largest weight of a passage)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score:double,attention:double>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [b or b"" for b in batch.to_pylist()]
            p, a = [], []
            begin, size = 0, 0
            for i, t in enumerate([*texts, None]):
                if t is None or (i > begin and size + len(t) > 2 * _BLOCK):
                    x, y = shared.value.score(texts[begin:i])
                    p.append(x)
                    a.append(y)
                    begin, size = i, 0
                size += len(t or b"")
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(p)), pa.array(np.concatenate(a))], ["score", "attention"])
        release()

    return docs.withColumn(out, scored.asNondeterministic()(F.col(text).cast("binary")))
