"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 4 characters within words, word ends counting as a space, of the
lower-case text. A feature's value is its share of the text's n-grams times its inverse document
frequency, which is counted over all rows that may be learned from. Weights are trained by FTRL with
elastic-net penalties, each coordinate with its own rate; a temperature, fitted on rows set aside,
calibrates the probabilities. As values are sums over n-grams, so is the score of a text over its
words: a worker keeps the class sums of words it has met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sample import by_class
from .scratch import freed, packed, remainder, ship, trimmed

BITS = 15
#: Bytes that the texts drawn for training hold at most.
SAMPLE_BYTES = 64_000_000
N_GRAMS = (1, 2, 3, 4)
#: Multiplies the values, so that the steps of training are of a usual size.
SCALE = 50.0
#: Words that a worker keeps, and the longest of them.
KEPT, KEPT_BYTES = 80_000, 48
LETTER = regex.compile(r"\p{L}")


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of words, and where those of each word begin (one entry more than words)."""
    text = (" " + " ".join(w.decode("utf-8", "replace") for w in words) + " ").encode("utf-32-le", "replace")
    c = np.frombuffer(text, "<u4").astype(np.uint32)
    blank = c == 32
    at = np.cumsum(blank)
    found, owner = [], []
    h = np.zeros(len(c), np.uint32)
    for n in N_GRAMS:
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(16777619) ^ (c[n - 1 :] * np.uint32(2654435761)) if n > 1 else c * np.uint32(2654435761)
        own = ~blank if n == 1 else at[n - 2 : n - 2 + m] == at[:m]
        x = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        found.append((x[own] >> np.uint32(32 - BITS)).astype(np.int32))
        owner.append(at[:m][own] - 1)
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(owners[order], np.arange(len(words) + 1))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split() if text else []


class Lexicon:
    """Numbers for words, with a row of values for each; the oldest are forgotten in bulk."""

    def __init__(self, make, width: int):
        self.make, self.rows, self.number, self.n = make, np.zeros((1024, width), np.float32), {}, 0

    def numbers(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Row numbers of each text's words; good until the next call."""
        if self.n > KEPT:
            self.number, self.n = {}, 0
        fresh = list(set().union(*texts).difference(self.number))
        if fresh:
            need = self.n + len(fresh)
            if need > len(self.rows):
                self.rows = np.concatenate([self.rows[: self.n], np.zeros((max(need, 2 * len(self.rows)) - self.n, self.rows.shape[1]), np.float32)])
            self.rows[self.n : need] = self.make(fresh)
            self.number.update(zip(fresh, range(self.n, need), strict=True))
            self.n = need
        get = self.number.__getitem__
        out = [np.fromiter(map(get, ws), np.int32, len(ws)) for ws in texts]
        for w in fresh:
            if len(w) > KEPT_BYTES:
                del self.number[w]
        return out


def slices(texts: list, chars: int = 2_000_000) -> Iterator[slice]:
    start = 0
    while start < len(texts):
        stop, n = start, 0
        while stop < len(texts) and (stop == start or n < chars):
            n += len(texts[stop] or "")
            stop += 1
        yield slice(start, stop)
        start = stop


def document_frequency(rows: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Of each feature the rows that have it, over all rows, and the number of rows."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        known: dict[bytes, np.ndarray] = {}
        for b in batches:
            texts = b.column(0).to_pylist()
            for s in slices(texts):
                docs = [set(words_of(t)) for t in texts[s]]
                if len(known) > KEPT // 2:
                    known = {}
                fresh = list(set().union(*docs).difference(known))
                if fresh:
                    f, at = features(fresh)
                    f = f.astype(np.uint16 if BITS <= 16 else np.int32)
                    known.update((w, f[i:j].copy()) for w, i, j in zip(fresh, at[:-1].tolist(), at[1:].tolist(), strict=True))
                for ws in docs:
                    n += 1
                    if ws:
                        has = np.zeros(1 << BITS, bool)
                        has[np.concatenate([known[w] for w in ws])] = True
                        df += has
                known = {w: x for w, x in known.items() if len(w) <= KEPT_BYTES} if any(len(w) > KEPT_BYTES for w in fresh) else known
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], names=["f", "n"])

    found = rows.select(text).mapInArrow(lambda b: trimmed(run(b)), "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << BITS, np.int64)
    total = 0
    for r in found:
        if r["f"] < 0:
            total = r["n"]
        else:
            out[r["f"]] = r["n"]
    return out, total


class Ftrl:
    """Multinomial logistic regression; z and n are the sums that follow-the-regularised-leader keeps."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = x @ w
        p = np.exp(p - p.max())
        p /= p.sum()
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


class Model:
    """Class names and feature weights; ``weights`` hold the inverse document frequency and the scale."""

    def __init__(self, classes: list[str], weights: np.ndarray, temperature: float):
        self.classes, self.weights, self.temperature = classes, weights.astype(np.float32), temperature

    def lexicon(self) -> Lexicon:
        def make(words: list[bytes]) -> np.ndarray:
            f, at = features(words)
            n = np.diff(at).astype(np.float32)
            sums = np.add.reduceat(self.weights[f], np.minimum(at[:-1], len(f) - 1), axis=0)
            return np.concatenate([np.where(n[:, None] > 0, sums, 0), n[:, None]], axis=1)

        return Lexicon(make, len(self.classes) + 1)

    def scores(self, lexicon: Lexicon, texts: list[str | None]) -> np.ndarray:
        """Uncalibrated scores of whole texts."""
        out = np.zeros((len(texts), len(self.classes)))
        for s in slices(texts):
            for i, at in enumerate(lexicon.numbers([words_of(t) for t in texts[s]]), s.start):
                if len(at):
                    total = lexicon.rows[at].sum(axis=0, dtype=np.float64)
                    out[i] = total[:-1] / max(1.0, total[-1])
        return out


def probabilities(scores: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp((scores - scores.max(axis=1, keepdims=True)) / temperature)
    return e / e.sum(axis=1, keepdims=True)


def train(rows: DataFrame, label: str, key: str = "doc_id", text: str = "text", per_class: int = 600, epochs: int = 3, seed: int = 5) -> Model | None:
    """A model from rows with text and a label; None without any.

    Document frequencies are counted over all rows; weights are fitted on ``per_class`` rows of each
    class at most, whole texts of ``SAMPLE_BYTES`` in all, a fifth of them set aside for the
    temperature. Over 2,000 classes are refused with ValueError.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    drawn = by_class(rows, label, key, text, per_class, SAMPLE_BYTES)
    classes = sorted({c for c, _ in drawn})
    if not classes:
        return None
    df, n = document_frequency(rows, text)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    made = []
    while drawn:
        c, t = drawn.pop(0)
        f, _ = features(words_of(t)) if words_of(t) else (np.zeros(0, np.int32), None)
        if len(f):
            at, tf = np.unique(f, return_counts=True)
            made.append((classes.index(c), at, tf / len(f) * idf[at] * SCALE))
    aside = made[::5] if len(made) >= 20 else []
    used = [m for i, m in enumerate(made) if i % 5 or not aside]
    fit, order = Ftrl(len(classes)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(used)):
            y, at, x = used[i]
            fit.step(at, x, y)
    w = fit.weights()
    temperature = 1.0
    if aside:
        s, y = np.array([x @ w[at] for _, at, x in aside]), np.array([m[0] for m in aside])
        tried = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        temperature = float(min(tried, key=lambda t: -np.log(np.maximum(probabilities(s, t)[np.arange(len(y)), y], 1e-12)).mean()))
    return Model(classes, w * idf[:, None] * SCALE, temperature)


def predict(rows: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """row, a struct of all columns of rows, lang_pred and score of every whole text.

    score: the calibrated probability of the class. Null texts and texts without a letter are ``und``
    with score 0, and so is every text if there was nothing to learn. Of equal probabilities the first
    class by name is taken. Repeated rows stay.
    """
    spark = rows.sparkSession
    ship(spark)
    at = rows.columns.index(text)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        lexicon = model.lexicon() if model else None
        for b in batches:
            texts = b.column(0).field(at).cast(pa.string()).to_pylist()
            known = np.array([bool(model and t and LETTER.search(t)) for t in texts], bool)
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if known.any():
                p = probabilities(model.scores(lexicon, texts), model.temperature)
                best = p.argmax(axis=1)
                lang = [model.classes[k] if on else "und" for k, on in zip(best.tolist(), known.tolist(), strict=True)]
                score = np.where(known, p[np.arange(len(texts)), best], 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    whole = rows.select(packed(rows))
    return whole.mapInArrow(lambda b: trimmed(run(b)), T.StructType([*whole.schema.fields]).add("lang_pred", "string").add("score", "double"))


def learned(docs: DataFrame) -> Model | None:
    """From text and language of documents whose crc32 remainder by 3 isn't 1."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(rows.where(remainder("doc_id", 3) != 1), "lang")
    freed()
    return model


def digests(docs: DataFrame) -> DataFrame:
    out = predict(docs.select("doc_id", "text"), learned(docs))
    return out.select("row.doc_id", (remainder("row.doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
