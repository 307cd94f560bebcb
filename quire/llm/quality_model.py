"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage of the whole text is encoded: shares of byte classes,
word and line lengths, distinct words, three-word windows that its text repeats, and a hashed projection of its words,
through a dense tanh layer. Gated attention, learned from document labels, weighs the passages; the weighted sum is
scored by a logistic layer. Neither labels nor lang, source or doc_id are inputs of a score.

Training uses TRAIN_DOCS labelled documents at most (those of least hash of doc_id among the rows that are not held
out; one text of each doc_id), with every passage of each; what the driver holds grows with their length only, 88 bytes a passage. Scoring reads
every passage of every text: texts are encoded in pieces of about PIECE bytes that end with a passage, and attention sums
run along. The words that repeat are found over the whole text first, from a hash per word, so that the pieces change no
score and memory is some 40 bytes a word at most.

Nulls: a null text is an empty one: one empty passage, scored like any other; a null doc_id counts as held out (its
text is ''). Labels that are null do not count; a document with several labels has the least. Repeated rows get equal
scores. Without labels all scores are 0.5. Further columns pass through scored() in a struct, so that no name clashes; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, staged, table, whole

PASSAGE = 64
PIECE = 1 << 20
HASHED = 8
TRAIN_DOCS = 4000
HIDDEN = 16
GATE = 8
EPOCHS = 40
THRESHOLD = 0.3
FOLDS = 5

CLASSES = (
    bytes(range(65, 91)),  # capitals
    bytes(range(97, 123)),  # small letters
    bytes(range(48, 58)),  # digits
    b"#*$%&|<>",
    b"!?",
    b".,;:",
    b"=+-_/\\@^~`'\"()[]{}",
    bytes(range(128, 256)),
)
N_STATS = len(CLASSES) + 6
FEATURES = N_STATS + HASHED


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Byte classes and the projection of hashed words."""
    of = np.full(256, len(CLASSES), np.int64)
    for i, c in enumerate(CLASSES):
        of[np.frombuffer(c, np.uint8)] = i
    return of, np.random.default_rng(7).standard_normal((4096, HASHED)).astype(np.float32)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers and inverse powers of an odd base mod 2^64."""
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x)])) for x in (base, inverse))


def _words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, wherever it stands."""
    up, down = _powers(max(PIECE, 1 << (len(b)).bit_length()))
    with np.errstate(over="ignore"):
        p = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
        h = (p[ends] - p[starts]) * down[starts]
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)


def _repeated(h: np.ndarray) -> np.ndarray:
    """Whether each word is in a three-word window that its text repeats."""
    n = len(h)
    twice = np.zeros(n, bool)
    if n < 4:
        return twice
    with np.errstate(over="ignore"):
        tri = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)
    order = np.argsort(tri, kind="stable")
    same = tri[order][1:] == tri[order][:-1]
    hit = np.zeros(len(tri), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    for k in range(3):
        twice[k : n - 2 + k] |= hit
    return twice


def encode_piece(data: bytes, twice: np.ndarray | None = None) -> np.ndarray:
    """The passages' feature vectors of a piece of text. twice: whether each word is repeated, if the piece is not the whole text."""
    b = np.frombuffer(data, np.uint8)
    starts, ends = _words(b)
    n = len(starts)
    if not n:
        return np.zeros((1, FEATURES), np.float32)
    of, projection = _tables()
    first = np.arange(0, n, PASSAGE)
    last = np.minimum(first + PASSAGE, n) - 1
    words = (last - first + 1).astype(np.float64)
    lo, hi = starts[first], ends[last]
    out = np.empty((len(first), FEATURES), np.float32)
    kinds = of[b]
    length = (hi - lo).astype(np.float64)
    for i in range(len(CLASSES)):
        c = np.concatenate([[0], np.cumsum(kinds == i)])
        out[:, i] = (c[hi] - c[lo]) / length
    h = _hashes(b, starts, ends)
    if twice is None:
        twice = _repeated(h)
    passage = np.arange(n) // PASSAGE
    order = np.lexsort((h, passage))
    new = np.ones(n, bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order], weights=new, minlength=len(first))
    lens = (ends - starts).astype(np.float64)
    at = len(CLASSES)
    out[:, at] = distinct / words
    out[:, at + 1] = np.bincount(passage, weights=twice) / words
    out[:, at + 2] = np.bincount(passage, weights=lens) / words / 10
    out[:, at + 3] = np.sqrt(np.maximum(np.bincount(passage, weights=lens**2) / words - (np.bincount(passage, weights=lens) / words) ** 2, 0)) / 10
    c = np.concatenate([[0], np.cumsum(b == 10)])
    out[:, at + 4] = (c[hi] - c[lo]) / words
    out[:, at + 5] = np.log(words) / 4
    vec = projection[(h >> np.uint64(40)).astype(np.int64) & 4095]
    out[:, N_STATS:] = np.add.reduceat(vec, first, axis=0) / words[:, None]
    return out


def pieces(data: bytes) -> Iterator[bytes]:
    """Pieces of about PIECE bytes that end with a whole passage; a longer one if a passage is longer."""
    at, size = 0, PIECE
    while at < len(data) or at == 0:
        to = min(len(data), at + size)
        if to == len(data):
            piece = data[at:]
            if at == 0 or piece.strip():
                yield piece
            return
        _, ends = _words(np.frombuffer(data, np.uint8, to - at, at))
        whole = (len(ends) - 1) // PASSAGE * PASSAGE  # the last word may go on
        if whole < 1:
            size *= 2
            continue
        yield data[at : at + int(ends[whole - 1])]
        at, size = at + int(ends[whole - 1]), PIECE


def encode_text(text: str | None) -> Iterator[np.ndarray]:
    """The feature vectors of all passages of a text, piece by piece."""
    data = (text or "").encode()
    if len(data) <= PIECE:
        yield encode_piece(data)
        return
    found = []
    for p in pieces(data):
        b = np.frombuffer(p, np.uint8)
        found.append(_hashes(b, *_words(b)))
    twice, at = _repeated(np.concatenate(found)), 0
    for p, h in zip(pieces(data), found, strict=True):
        yield encode_piece(p, twice[at : at + len(h)])
        at += len(h)


class AttentionModel:
    """Gated attention over encoded passages."""

    SHAPES = (("w1", (FEATURES, HIDDEN)), ("b1", (HIDDEN,)), ("v", (HIDDEN, GATE)), ("u", (HIDDEN, GATE)), ("w", (GATE,)), ("c", (HIDDEN,)), ("c0", (1,)))

    def __init__(self, params: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray) -> None:
        self.p, self.mean, self.scale = params, mean, scale

    @classmethod
    def fresh(cls, mean: np.ndarray, scale: np.ndarray, seed: int = 3) -> AttentionModel:
        rng = np.random.default_rng(seed)
        return cls({n: rng.standard_normal(s) * (0.0 if n in ("b1", "c0") else 1 / np.sqrt(s[0])) for n, s in cls.SHAPES}, mean, scale)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        p = self.p
        h = np.tanh((x - self.mean) / self.scale @ p["w1"] + p["b1"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        return h, t, g, np.clip((t * g) @ p["w"], -30, 30)

    def score(self, text: str | None) -> float:
        top, bottom = np.zeros(HIDDEN), 0.0
        for x in encode_text(text):
            h, _, _, a = self._forward(x)
            e = np.exp(a)
            top += e @ h
            bottom += e.sum()
        return float(1 / (1 + np.exp(-(top / bottom @ self.p["c"] + self.p["c0"][0]))))

    def train(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, batch: int = 128, seed: int = 5) -> None:
        """Adam on the logistic loss of whole bags."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                g = self._gradient([bags[i] for i in pick], labels[pick])
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def _gradient(self, bags: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = np.concatenate(bags).astype(np.float64)
        lens = np.array([len(b) for b in bags])
        first = np.concatenate([[0], np.cumsum(lens)[:-1]])
        bag = np.repeat(np.arange(len(bags)), lens)
        xs = (x - self.mean) / self.scale
        h, t, g, a = self._forward(x)
        e = np.exp(a)
        alpha = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(alpha[:, None] * h, first)
        prob = 1 / (1 + np.exp(-(z @ p["c"] + p["c0"][0])))
        d = (prob - y) / len(bags)
        dz = d[:, None] * p["c"]
        dalpha = (dz[bag] * h).sum(1)
        da = alpha * (dalpha - np.add.reduceat(alpha * dalpha, first)[bag])
        dh = alpha[:, None] * dz[bag]
        dtg = da[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
        dh += dt @ p["v"].T + dg @ p["u"].T
        dpre = dh * (1 - h**2)
        grads = {"w1": xs.T @ dpre, "b1": dpre.sum(0), "v": h.T @ dt, "u": h.T @ dg, "w": (t * g).T @ da, "c": z.T @ d, "c0": np.array([d.sum()])}
        return {k: v + 1e-4 * p[k] for k, v in grads.items()}


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_DOCS) -> AttentionModel | None:
    """A model of docs (doc_id, text) and labels (doc_id, label), from rows that are not held out."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = own.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def encode(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            parts = np.concatenate(list(encode_text(t)))
            out.append(np.round(parts.ravel(), 6))
        return pa.array(out, pa.list_(pa.float32()))

    # most rows at most: broadcast.
    found = docs.select("doc_id", "text").join(F.broadcast(staged(chosen, "mil_labels")), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    bags = found.select("doc_id", "y", F.arrow_udf(encode, "array<float>")(F.col("text").cast("string")).alias("x")).toArrow().sort_by([("doc_id", "ascending")])
    if not bags.num_rows:
        return None
    x = [np.array(v, np.float32).reshape(-1, FEATURES) for v in bags["x"].to_pylist()]
    y = bags["y"].to_numpy().astype(np.float64)
    everything = np.concatenate(x)
    model = AttentionModel.fresh(everything.mean(0), everything.std(0) + 0.02)
    model.train(x, y)
    return model


def score_column(model: AttentionModel | None, text: str = "text") -> Column:
    def scores(text: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for t in text.to_pylist()], pa.float64())

    return F.lit(0.5) if model is None else F.arrow_udf(scores, "double")(F.col(text).cast("string"))


def scored(docs: DataFrame, model: AttentionModel | None, text: str = "text") -> DataFrame:
    """_doc (docs' columns, whatever their names) and score."""
    bounded_batches(docs.sparkSession)
    return docs.select(whole(docs), score_column(model, text).alias("score"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    rows = scored(docs, model).select("_doc.doc_id", "score").select("doc_id", held_out().alias("held_out"), "score")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
