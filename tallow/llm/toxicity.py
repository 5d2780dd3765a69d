"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals add up to a document's score.

Words (letters and digits of any script) are tagged toxic or not. A word's evidence is learned weights of the word, its
neighbours, its first (three, five, seven) and last bytes, its length and case; neighbouring tags weigh on each other. Forward-backward gives each
word's marginal exactly, over whole texts: a two-state chain's messages are ratios, and their steps are 2 x 2 matrices, so that
many texts go through as one chain that forgets at their borders, in chunks side by side. A text's score is a logistic
function, fitted to the documents' labels, of the probability that any word is toxic and of the expected number; offending
spans are runs of words with marginals of a half or more.

Labels mark documents, so tagged words are won from them first: those surely (by Z standard errors of the log odds) more
frequent among documents labelled toxic, and in more of them than of others. A word counts as often as it has different
neighbours there, so that copies of one document say no more than one. These words are the toxic tokens of the toxic
documents; all others are not.

Fitting: a bounded sample (about most_rows labelled ids by hash, most_bytes of whole texts), of which the field itself sees
most_windows windows of WINDOW words. Scoring covers every word of every text.

Cases: null and empty text has no word and gets the score of no evidence; labels that are null are left out; equal texts have
equal scores; without labels of both kinds the score is the labels' mean (0.5 where there is none); an empty table gives an empty
result; other columns are kept, whatever their names but that of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import release, ship
from .wordhash import NOT_ALNUM, mixed, placed

_BITS = 18
WINDOW = 64
#: Standard errors above zero that make a word's log odds sure, and documents it must be in.
Z, LEAST_DOCS = 3.5, 4
_CHUNK = 128
_BLOCK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += np.uint64(32)
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
N_FEATURES = 9


def _neighbours(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words before and behind each word of its text; 1 and 2 where there is none."""
    before, behind = np.roll(hashes, 1), np.roll(hashes, -1)
    begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    before[begins] = 1
    behind[np.append(begins[1:], len(hashes)) - 1] = 2
    return before, behind


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (places in the weights, N_FEATURES a word), bounds of the texts' words, word hashes, first and last byte, bytes."""
    hashes, bounds, first, after, data = placed(texts, NOT_ALNUM)
    n = len(hashes)
    if not n:
        return np.zeros((0, N_FEATURES), np.int32), bounds, hashes, first, after, data
    before, behind = _neighbours(hashes, bounds)
    at = lambda places: _LOWER[data[places]]
    last = after - 1
    three = np.uint64(65536)
    head, heads = np.zeros(n, np.uint64), []
    for k in range(7):
        head = head * np.uint64(257) + np.where(first + k <= last, at(np.minimum(first + k, last)) + np.uint64(1), np.uint64(0))
        if k in (2, 4, 6):
            heads.append(head)
    foot = at(last) * three + at(np.maximum(last - 1, first)) * np.uint64(256) + at(np.maximum(last - 2, first))
    shape = np.minimum(after - first, 20).astype(np.uint64) * np.uint64(4) + _UPPER[data[first]] * np.uint64(2) + _UPPER[data[last]]
    out = np.empty((n, N_FEATURES), np.int32)
    for k, value in enumerate((hashes, before, behind, *heads, foot, shape)):
        out[:, k] = mixed(value + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - _BITS)
    out[:, N_FEATURES - 1] = 0  # weighs how common toxic words are
    return out, bounds, hashes, first, after, data


def marginals(x: np.ndarray, begins: np.ndarray, a: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Probability of the toxic tag for every word of the chains that begin at `begins`. x: exp of a word's evidence; a:
    factors [tag before, tag]; s: factors of a chain's first tag."""
    n = len(x)
    if not n:
        return np.zeros(0)
    rows = -(-n // _CHUNK)
    pad = rows * _CHUNK - n
    new = np.zeros(n, bool)
    new[begins] = True
    grid = lambda v, fill: np.append(v, np.full(pad, fill)).reshape(rows, _CHUNK).T.copy()
    # steps of the messages: v -> v M with M[b, t] = (a or, at a beginning, s)[b, t] * (1, x)[t]
    m = [[grid(np.where(new, s[t], a[b, t]) * (x if t else 1.0), 1.0 if b == t else 0.0) for t in (0, 1)] for b in (0, 1)]
    product = [[np.ones(rows), np.zeros(rows)], [np.zeros(rows), np.ones(rows)]]
    for j in range(_CHUNK):
        product = [[p[0] * m[0][t][j] + p[1] * m[1][t][j] for t in (0, 1)] for p in product]
        scale = 1.0 / np.maximum(np.maximum(product[0][0], product[0][1]), np.maximum(product[1][0], product[1][1]))
        product = [[p * scale for p in row] for row in product]
    (p00, p01), (p10, p11) = ([p.tolist() for p in row] for row in product)
    ahead, back = np.empty((2, rows)), np.empty((2, rows))
    u, v = 0.5, 0.5
    for i in range(rows):  # messages at the chunks' borders, forward and backward
        ahead[:, i] = u, v
        u, v = u * p00[i] + v * p10[i], u * p01[i] + v * p11[i]
        u, v = u / (u + v), v / (u + v)
    u, v = 0.5, 0.5
    for i in range(rows - 1, -1, -1):
        back[:, i] = u, v
        u, v = p00[i] * u + p01[i] * v, p10[i] * u + p11[i] * v
        u, v = u / (u + v), v / (u + v)
    alpha = np.empty((2, _CHUNK, rows))
    u, v = ahead
    for j in range(_CHUNK):
        u, v = u * m[0][0][j] + v * m[1][0][j], u * m[0][1][j] + v * m[1][1][j]
        total = u + v
        u, v = u / total, v / total
        alpha[0, j], alpha[1, j] = u, v
    out = np.empty((_CHUNK, rows))
    u, v = back
    for j in range(_CHUNK - 1, -1, -1):
        toxic, not_toxic = alpha[1, j] * v, alpha[0, j] * u
        out[j] = toxic / (toxic + not_toxic)
        u, v = m[0][0][j] * u + m[0][1][j] * v, m[1][0][j] * u + m[1][1][j] * v
        total = u + v
        u, v = u / total, v / total
    return out.T.reshape(-1)[:n]


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts of about _BLOCK bytes together; a longer one is alone."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > _BLOCK:
            yield texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield texts[begin:]


def offending_words(hashes: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hashes of the words that tell the documents labelled 1: surely more frequent there, and in more of them than of others."""
    n = len(hashes)
    if not n:
        return hashes
    owner = np.repeat(np.arange(len(y)), np.diff(bounds))
    before, behind = _neighbours(hashes, bounds)
    around = mixed(before) ^ behind
    names, word = np.unique(hashes, return_inverse=True)

    def counted(by: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Distinct values of `by` of every word."""
        w, v = word[use], by[use]
        order = np.lexsort((v, w))
        w, v = w[order], v[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (v[1:] != v[:-1])
        return np.bincount(w[new], minlength=len(names)).astype(float)

    marked = y[owner] > 0
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    toxic = np.minimum(counted(owner, marked), counted(around, marked))
    clean = counted(owner, ~marked)
    odds = np.log((toxic + 0.5) / (n1 - toxic + 0.5)) - np.log((clean + 0.5) / (n0 - clean + 0.5))
    error = np.sqrt(1 / (toxic + 0.5) + 1 / (n1 - toxic + 0.5) + 1 / (clean + 0.5) + 1 / (n0 - clean + 0.5))
    return names[(toxic >= LEAST_DOCS) & (odds >= Z * error) & (toxic > clean)]


class ToxicTagger:
    """The field's weights and the logistic function of a text's marginals."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.weights = prior, None

    def fit(self, texts: list[bytes], y: np.ndarray, most_windows: int = 6000, epochs: int = 8, seed: int = 3) -> ToxicTagger:
        y = np.asarray(y, float)
        self.prior = float(y.mean()) if len(y) else 0.5
        if len(y) == 0 or y.min() == y.max():
            return self
        parts = [placed(b, NOT_ALNUM)[:2] for b in _blocks(texts)]
        hashes = np.concatenate([h for h, _ in parts])
        sizes = np.concatenate([np.diff(b) for _, b in parts])
        del parts
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        tag = np.isin(hashes, offending_words(hashes, bounds, y)) & np.repeat(y > 0, sizes)
        self.weights, self.edges, self.starts = np.zeros(1 << _BITS), np.zeros((2, 2)), np.zeros(2)
        places = self._windows(bounds, tag, most_windows, seed)
        features = np.zeros((*places.shape, N_FEATURES), np.int32)
        first = 0
        for block in _blocks(texts):  # features of the windows' words alone are held
            own = tokens(block)[0]
            here = (places >= first) & (places < first + len(own))
            features[here] = own[places[here] - first]
            first += len(own)
        self._field(features, places >= 0, np.where(places >= 0, np.append(tag, False)[places], False), epochs, seed)
        self._calibrated(np.concatenate([self._evidence(*tokens(b)[:2])[1] for b in _blocks(texts)]), y)
        return self

    @staticmethod
    def _windows(bounds: np.ndarray, tag: np.ndarray, most: int, seed: int) -> np.ndarray:
        """Places of words (-1 beyond a text's end) of windows: those with toxic words first, then others by chance."""
        first = np.concatenate([np.arange(a, b, WINDOW) for a, b in zip(bounds, bounds[1:])]) if len(tag) else np.zeros(0, np.int64)
        end = np.minimum(first + WINDOW, bounds[np.searchsorted(bounds, first, side="right")])
        sums = np.concatenate([[0], np.cumsum(tag)])
        has = sums[end] > sums[first]
        rng = np.random.default_rng(seed)
        some, none = rng.permutation(np.flatnonzero(has))[: most // 2], rng.permutation(np.flatnonzero(~has))
        use = rng.permutation(np.append(some, none[: most - len(some)]))
        places = first[use][:, None] + np.arange(WINDOW)
        return np.where(places < end[use][:, None], places, -1)

    def _field(self, features: np.ndarray, there: np.ndarray, tags: np.ndarray, epochs: int, seed: int, batch: int = 96, rate: float = 0.3, decay: float = 1e-5) -> None:
        rng = np.random.default_rng(seed)
        squares = [np.full_like(p, 1e-8) for p in (self.weights, self.edges, self.starts)]
        for _ in range(epochs):
            order = rng.permutation(len(features))
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                steps = self.gradients(features[rows], there[rows], tags[rows])
                for p, g, s in zip((self.weights, self.edges, self.starts), steps, squares):
                    g = g - decay * p
                    s += g * g
                    p += rate * g / np.sqrt(s)

    def likelihood(self, features: np.ndarray, there: np.ndarray, tags: np.ndarray) -> float:
        """Log likelihood of the tags of windows (there: words that exist)."""
        e = np.where(there, self.weights[features].sum(axis=2), 0.0)
        total = 0.0
        for row, ok, t in zip(e, there, tags):
            n, t = int(ok.sum()), t.astype(int)
            path = self.starts[t[0]] + (row[:n] * t[:n]).sum() + sum(self.edges[a, b] for a, b in zip(t[: n - 1], t[1:n]))
            v = self.starts + np.array([0, row[0]])
            for k in range(1, n):
                v = np.logaddexp(v[0] + self.edges[0], v[1] + self.edges[1]) + np.array([0, row[k]])
            total += path - np.logaddexp(*v)
        return total

    def gradients(self, features: np.ndarray, there: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
        """Of likelihood(), by forward-backward over all windows at once."""
        n, w = there.shape
        e = self.weights[features].sum(axis=2)
        x = np.exp(np.clip(e, -30, 30))
        a, s = np.exp(self.edges), np.exp(self.starts)
        emit = np.stack([np.ones_like(x), x], axis=2)
        alpha, beta = np.empty((n, w, 2)), np.ones((n, w, 2))
        alpha[:, 0] = s * emit[:, 0]
        for k in range(w):
            if k:
                step = (alpha[:, k - 1] @ a) * emit[:, k]
                alpha[:, k] = np.where(there[:, k, None], step, alpha[:, k - 1])
            alpha[:, k] /= alpha[:, k].sum(axis=1, keepdims=True)
        pairs = np.zeros((2, 2))
        seen = np.zeros((2, 2))
        for k in range(w - 1, 0, -1):
            ok = there[:, k]
            joint = alpha[:, k - 1, :, None] * a * (emit[:, k] * beta[:, k])[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pairs += joint[ok].sum(axis=0)
            np.add.at(seen, (tags[ok, k - 1].astype(int), tags[ok, k].astype(int)), 1.0)
            back = (emit[:, k] * beta[:, k]) @ a.T
            beta[:, k - 1] = np.where(ok[:, None], back / back.sum(axis=1, keepdims=True), beta[:, k])
        m = alpha * beta
        m /= m.sum(axis=2, keepdims=True)
        miss = np.where(there, tags - m[:, :, 1], 0.0)
        weights = np.bincount(features.ravel(), weights=np.repeat(miss.ravel(), N_FEATURES), minlength=1 << _BITS)
        first = np.stack([1.0 - tags[:, 0], tags[:, 0]], axis=1) - m[:, 0]
        return [weights, seen - pairs, first.sum(axis=0)]

    def _evidence(self, features: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words, and per text: the probability of any toxic word, and log(1 + expected number of them)."""
        x = np.exp(np.clip(self.weights[features].sum(axis=1), -30, 30))
        some = np.diff(bounds) > 0
        begins = bounds[:-1][some]
        m = np.clip(marginals(x, begins, np.exp(self.edges), np.exp(self.starts)), 1e-12, 1 - 1e-12)
        told = np.zeros((len(bounds) - 1, 2))
        if len(m):
            told[some, 0] = -np.expm1(np.add.reduceat(np.log1p(-m), begins))
            told[some, 1] = np.log1p(np.add.reduceat(m, begins))
        return m, told

    def _calibrated(self, told: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        """Logistic regression by Newton steps."""
        design = np.column_stack([told, np.ones(len(told))])
        c = np.zeros(3)
        keep = np.diag([ridge, ridge, 1e-6])
        for _ in range(30):
            p = 1 / (1 + np.exp(-design @ c))
            c += np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + keep, design.T @ (y - p) - keep @ c)
        self.unit = c

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Score of each text, and its offending spans: first character, character behind, highest marginal in it."""
        if not texts or self.weights is None:
            return np.full(len(texts), self.prior), [[] for _ in texts]
        features, bounds, _, first, after, data = tokens(texts)
        m, told = self._evidence(features, bounds)
        score = 1 / (1 + np.exp(-np.column_stack([told, np.ones(len(told))]) @ self.unit))
        spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        hit = np.flatnonzero(m >= 0.5)
        if len(hit):
            owner = np.searchsorted(bounds, hit, side="right") - 1
            new = np.ones(len(hit), bool)
            new[1:] = (hit[1:] != hit[:-1] + 1) | (owner[1:] != owner[:-1])
            group = np.flatnonzero(new)
            top = np.maximum.reduceat(m[hit], group)
            last = hit[np.append(group[1:], len(hit)) - 1]
            starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
            for i in np.unique(owner).tolist():  # characters are bytes that do not continue one
                letters = np.concatenate([[0], np.cumsum((data[starts[i] : starts[i + 1] - 1] & 0xC0) != 0x80)])
                for g in np.flatnonzero(owner[group] == i).tolist():
                    a, b = first[hit[group[g]]] - starts[i], after[last[g]] - starts[i]
                    spans[i].append((int(letters[a]), int(letters[b]), float(top[g])))
        return score, spans


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", where: Column | None = None, most_rows: int = 6000, most_bytes: int = 16 << 20, most_windows: int = 6000) -> ToxicTagger:
    """A tagger from a sample of the labelled rows for which `where` (over `key`) holds: about most_rows ids by hash, whole texts of most_bytes and twice
    most_rows texts at most; texts that several ids share count once, with the mean of their labels rounded up."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"), (where if where is not None else F.lit(True)).alias("ok")).filter("ok and y is not null").select("key", "y").distinct()
    n = known.count()
    chosen = known.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.lit(min(1.0, most_rows / max(1, n)) * 1_000_000))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).join(F.broadcast(chosen), "key")
    found: dict[bytes, list[int]] = {}
    size = 0
    for r in rows.select("key", "text", "y").orderBy(F.xxhash64("key"), "key", "text", "y").toLocalIterator():
        t = bytes(r.text)
        if size >= most_bytes or len(found) >= 2 * most_rows:
            break
        if t in found or size + len(t) <= most_bytes or not found:
            size += 0 if t in found else len(t)
            found.setdefault(t, []).append(r.y)
    return ToxicTagger().fit(list(found), np.array([float(2 * sum(y) >= len(y)) for y in found.values()]), most_windows)


_SCORED = "struct<score:double,spans:array<struct<begin:int,end:int,probability:double>>>"
_SCORED_KIND = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])))])


def with_scores(docs: DataFrame, model: ToxicTagger, text: str = "text", out: str = "toxicity") -> DataFrame:
    """docs and a struct `out` (in the place of one of that name): score, spans (begin, end in characters, probability)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_SCORED)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        name = lambda s: dict(zip(("begin", "end", "probability"), s))
        for batch in batches:
            rows = []
            for texts in _blocks([b or b"" for b in batch.to_pylist()]):
                rows += [{"score": float(p), "spans": [name(s) for s in spans]} for p, spans in zip(*shared.value.score(texts))]
            yield pa.array(rows, _SCORED_KIND)
        release()

    return docs.withColumn(out, scored.asNondeterministic()(F.col(text).cast("binary")))
