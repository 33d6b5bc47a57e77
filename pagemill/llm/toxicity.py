"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word is given by an embedding of itself, if it is common, and the mean of embeddings of its hashed
character n-grams. A text is cut into overlapping windows of words; both recurrences run over each,
attention pools their states, and the text's score is that of its highest window. Training joins the
windows of a text by log-sum-exp, so gradients reach the windows that speak for the label. As input
projections depend on the word alone, a worker keeps those of words that it has met. Training runs a
batch's windows in slices, so its memory doesn't follow the longest text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .langid import BITS, Lexicon, features, slices, words_of
from .sample import of_keys
from .scratch import freed, packed, remainder, ship, trimmed

#: Words in a window, and from the start of one to that of the next: 17 words in a row are in some window whole.
WINDOW, STRIDE = 32, 16
H, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 8, 8
CHAR_ROWS = 1 << 12
EDGE = b".,;:!?\"'()[]{}*#$%&-_"
#: Windows scored at once, windows trained at once, and steps of training at least.
BATCH, SLICE, STEPS = 4096, 1024, 400
#: Bytes that the texts drawn for training hold at most.
SAMPLE_BYTES = 32_000_000


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by their number at, n of them."""
    return np.stack([np.bincount(at, c, n) for c in rows.T], axis=1).astype(rows.dtype)


def cut(numbers: np.ndarray) -> np.ndarray:
    """Overlapping windows over all of a text's words, -1 beyond its end; none for no words."""
    n = len(numbers)
    if not n:
        return np.zeros((0, WINDOW), np.int32)
    count = 1 + max(0, -(-(n - WINDOW) // STRIDE))
    padded = np.full((count - 1) * STRIDE + WINDOW, -1, np.int32)
    padded[:n] = numbers
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


class Words:
    """Distinct words with the rows of their vocabulary entries and of their n-grams, made once for training."""

    def __init__(self, words: list[bytes], vocabulary: dict[bytes, int]):
        self.at = np.fromiter((vocabulary.get(w.strip(EDGE), 0) for w in words), np.int32, len(words))
        parts = [features(words[i : i + 8192]) for i in range(0, len(words), 8192)]
        self.f = np.concatenate([np.zeros(0, np.uint16), *((f >> (BITS - 12)).astype(np.uint16) for f, _ in parts)])
        self.start = np.cumsum(np.concatenate([[0], *(np.diff(start) for _, start in parts)]), dtype=np.int64)

    def some(self, ids: np.ndarray) -> Words:
        """Of the words with these numbers."""
        out, n = object.__new__(Words), np.diff(self.start)[ids]
        out.at, out.start = self.at[ids], np.concatenate(([0], np.cumsum(n)))
        out.f = self.f[np.repeat(self.start[ids] - out.start[:-1], n) + np.arange(out.start[-1])]
        return out


class Network:
    """Parameters by name; ``vocabulary`` numbers the common words from 1. ``wordless``: the score of texts without words."""

    def __init__(self, vocabulary: dict[bytes, int], seed: int = 3):
        g = np.random.default_rng(seed)
        d = WORD_DIM + CHAR_DIM
        shapes = {"word": (len(vocabulary) + 1, WORD_DIM), "char": (CHAR_ROWS, CHAR_DIM), "w": (d, 6 * H), "uf": (H, 3 * H), "ub": (H, 3 * H), "wa": (2 * H, ATTENTION), "va": (ATTENTION,), "wo": (2 * H,)}
        scale = {"word": 0.3, "char": 0.3, "w": d**-0.5, "uf": H**-0.5, "ub": H**-0.5, "wa": (2 * H) ** -0.5, "va": 0.5, "wo": 0.5}
        self.p = {k: (g.standard_normal(s) * scale[k]).astype(np.float32) for k, s in shapes.items()}
        self.p |= {"b": np.zeros(6 * H, np.float32), "bo": np.zeros(1, np.float32)}
        self.p["word"][0] = 0
        self.vocabulary, self.shift, self.wordless = vocabulary, 0.0, 0.0

    def inputs(self, words: Words) -> np.ndarray:
        """Input vectors of words."""
        n = np.diff(words.start)
        if len(words.f):
            sums = np.add.reduceat(self.p["char"][words.f], np.minimum(words.start[:-1], len(words.f) - 1), axis=0)
            mean = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], 0).astype(self.p["char"].dtype)
        else:
            mean = np.zeros((len(n), CHAR_DIM), self.p["char"].dtype)
        return np.concatenate([self.p["word"][words.at], mean], axis=1)

    def lexicon(self) -> Lexicon:
        return Lexicon(lambda words: self.inputs(Words(words, self.vocabulary)) @ self.p["w"] + self.p["b"], 6 * H)

    def run(self, x: np.ndarray, on: np.ndarray, keep: bool = False):
        """Window logits from projections x (steps, windows, 6H) and on (steps, windows, 1): word or beyond."""
        steps, n, _ = x.shape
        hs = np.zeros((steps, n, 2 * H), np.float32)
        tape = []
        for side, u in ((0, self.p["uf"]), (1, self.p["ub"])):
            h = np.zeros((n, H), np.float32)
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                a, m = h @ u, on[t]
                xt = x[t, :, side * 3 * H : (side + 1) * 3 * H]
                zr = 1 / (1 + np.exp(-np.clip(xt[:, : 2 * H] + a[:, : 2 * H], -30, 30)))
                z, r = zr[:, :H], zr[:, H:]
                c = np.tanh(xt[:, 2 * H :] + r * a[:, 2 * H :])
                new = c + z * (h - c)
                if keep:
                    tape.append((side, t, h, z, r, c, a[:, 2 * H :]))
                h = np.where(m, new, h) if not m.all() else new
                hs[t, :, side * H : (side + 1) * H] = h
        k = np.tanh(hs @ self.p["wa"])
        e = np.where(on[:, :, 0], k @ self.p["va"], -1e9)
        e = np.exp(e - e.max(axis=0))
        att = e / e.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", att, hs)
        logit = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logit, hs, tape, k, att, pooled) if keep else logit

    def windows(self, idx: np.ndarray, proj: np.ndarray) -> np.ndarray:
        """Logits of windows (a row each) of word numbers, -1 beyond the end."""
        out = np.empty(len(idx))
        for i in range(0, len(idx), BATCH):
            part = idx[i : i + BATCH].T
            out[i : i + BATCH] = self.run(proj[np.maximum(part, 0)], (part >= 0)[:, :, None])
        return out

    def logits(self, lexicon: Lexicon, texts: list[str | None]) -> np.ndarray:
        """Of whole texts, that of the highest window; NaN for a text without words."""
        out = np.full(len(texts), np.nan)
        for s in slices(texts):
            cuts = [cut(n) for n in lexicon.numbers([words_of(t) for t in texts[s]])]
            counts = np.array([len(c) for c in cuts])
            if not counts.sum():
                continue
            found = self.windows(np.concatenate(cuts), lexicon.rows)
            some = np.flatnonzero(counts)
            starts = np.concatenate(([0], np.cumsum(counts[some])[:-1]))
            out[s.start + some] = np.maximum.reduceat(found, starts)
        return out - self.shift

    def scores(self, lexicon: Lexicon, texts: list[str | None]) -> np.ndarray:
        z = self.logits(lexicon, texts)
        return np.where(np.isnan(z), self.wordless, sigmoid(np.nan_to_num(z)))

    def gradients(self, texts: list[list[bytes]], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of texts, given as their words."""
        words = sorted(set().union(*texts))
        number = {w: i for i, w in enumerate(words)}
        return self.gradients_of([np.array([number[w] for w in ws], np.int32) for ws in texts], Words(words, self.vocabulary), labels)

    def gradients_of(self, texts: list[np.ndarray], words: Words, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of texts, given as numbers of words; a text's windows are joined by log-sum-exp.

        Windows run in slices: the first pass finds each text's share in its windows, the second their
        gradients, so the tape holds ``SLICE`` windows however long the texts are.
        """
        cuts = [cut(n) for n in texts]
        owner = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
        every = np.concatenate(cuts)
        p, xs = self.p, self.inputs(words)
        proj = xs @ p["w"] + p["b"]
        one = None
        if len(every) <= SLICE:
            one = self.forward(every, proj)
            logit = one[2]
        else:
            logit = self.windows(every, proj)
        top = np.full(len(cuts), -np.inf)
        np.maximum.at(top, owner, logit)
        e = np.exp(logit - top[owner])
        total = np.bincount(owner, e, len(cuts))
        doc = top + np.log(total)
        d_logit = ((sigmoid(doc) - labels)[owner] * e / total[owner] / len(cuts)).astype(proj.dtype)
        g = {k: np.zeros_like(p[k]) for k in ("bo", "wo", "va", "wa", "uf", "ub")}
        dproj = np.zeros_like(proj)
        for i in range(0, len(every), SLICE):
            self.backward(one or self.forward(every[i : i + SLICE], proj), d_logit[i : i + SLICE], g, dproj)
        g["b"], g["w"] = dproj.sum(axis=0), xs.T @ dproj
        dxs = dproj @ p["w"].T
        g["word"] = summed(words.at, dxs[:, :WORD_DIM], len(p["word"]))
        g["word"][0] = 0
        n = np.diff(words.start)
        g["char"] = summed(words.f, np.repeat(dxs[:, WORD_DIM:] / np.maximum(n, 1)[:, None], n, axis=0), CHAR_ROWS)
        return g

    def forward(self, windows: np.ndarray, proj: np.ndarray) -> tuple:
        idx = windows.T
        on = (idx >= 0)[:, :, None]
        return idx, on, *self.run(proj[np.maximum(idx, 0)], on, keep=True)

    def backward(self, kept: tuple, d_logit: np.ndarray, g: dict[str, np.ndarray], dproj: np.ndarray) -> None:
        """Adds the gradients of the windows kept by forward to g, and those of their words' projections to dproj."""
        idx, on, _, hs, tape, k, att, pooled = kept
        p = self.p
        g["bo"] += d_logit.sum(keepdims=True)
        g["wo"] += pooled.T @ d_logit
        d_pool = d_logit[:, None] * p["wo"]
        d_att = np.einsum("tbh,bh->tb", hs, d_pool)
        d_e = att * (d_att - (att * d_att).sum(axis=0))
        dk = (d_e[:, :, None] * p["va"]) * (1 - k * k)
        g["va"] += np.einsum("tba,tb->a", k, d_e)
        g["wa"] += np.einsum("tbh,tba->ha", hs, dk, optimize=True)
        d_hs = att[:, :, None] * d_pool + dk @ p["wa"].T
        dx = np.zeros((*idx.shape, 6 * H), dproj.dtype)
        carry = {0: 0.0, 1: 0.0}
        for side, t, h, z, r, c, an in reversed(tape):
            dh = d_hs[t, :, side * H : (side + 1) * H] + carry[side]
            m = on[t]
            dn = np.where(m, dh, 0)
            dc = dn * (1 - z) * (1 - c * c)
            dz = dn * (h - c) * z * (1 - z)
            dr = dc * an * r * (1 - r)
            da = np.concatenate([dz, dr, dc * r], axis=1)
            dx[t, :, side * 3 * H : (side + 1) * 3 * H] = np.concatenate([dz, dr, dc], axis=1)
            name = "uf" if side == 0 else "ub"
            g[name] += h.T @ da
            carry[side] = da @ p[name].T + dn * z + np.where(m, 0, dh)
        flat = np.maximum(idx, 0).reshape(-1)
        order = np.argsort(flat, kind="stable")
        present, first = np.unique(flat[order], return_index=True)
        dproj[present] += np.add.reduceat(dx.reshape(-1, 6 * H)[order], first, axis=0)


def train(docs: DataFrame, marks: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", clean: int = 2500, toxic: int = 700, epochs: int = 4, batch: int = 25, rate: float = 0.02, decay: float = 0.05, most_words: int = 16384, seed: int = 3) -> Network | None:
    """A network from docs and marks: a label of 0 or 1 for each key; None unless texts have both labels.

    At most ``clean`` and ``toxic`` whole texts of the two labels are drawn, of ``SAMPLE_BYTES`` in all.
    Few texts are gone through more often, so that training has ``STEPS`` steps. ``shift`` is set so
    that a logit of 0 best parts their labels, each text counting by its label's share of all rows;
    ``wordless`` is the share of toxic labels, under a half.
    """
    ship(docs.sparkSession)
    texts, counts = of_keys(docs, marks.where(F.col(label).isin(0, 1)), label, key, text, {0: clean, 1: toxic}, SAMPLE_BYTES)
    number: dict[bytes, int] = {}
    drawn = []
    while texts:
        c, t = texts.pop(0)
        if ws := words_of(t):
            drawn.append((c, np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int32, len(ws))))
    if {c for c, _ in drawn} != {0, 1}:
        return None
    every = list(number)
    del number
    bare = [w.strip(EDGE) for w in every]
    seen = Counter(w for _, ws in drawn for w in {bare[i] for i in np.unique(ws).tolist()})
    common = sorted((w for w, n in seen.items() if n >= 6 and w), key=lambda w: (-seen[w], w))[:most_words]
    net = Network({w: i + 1 for i, w in enumerate(common)}, seed)
    words = Words(every, net.vocabulary)
    del every, bare, seen
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    order, step = np.random.default_rng(seed), 0
    epochs = max(epochs, -(-STEPS // -(-len(drawn) // batch)))
    for epoch in range(epochs):
        perm = order.permutation(len(drawn))
        for i in range(0, len(perm), batch):
            part = [drawn[j] for j in perm[i : i + batch]]
            ids, at = np.unique(np.concatenate([ws for _, ws in part]), return_inverse=True)
            own = np.split(at.astype(np.int32), np.cumsum([len(ws) for _, ws in part])[:-1])
            g = net.gradients_of(own, words.some(ids), np.array([c for c, _ in part], np.float32))
            step += 1
            size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            now = rate * (0.3 if epoch >= 0.75 * epochs else 1.0)
            for k, v in g.items():
                v = v * min(1.0, 5 / max(size, 1e-9))
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v * v
                if k in ("word", "char"):
                    net.p[k] *= 1 - now * decay
                net.p[k] -= (now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    y = np.array([c for c, _ in drawn])
    proj = net.inputs(words) @ net.p["w"] + net.p["b"]
    z = np.array([net.windows(cut(ws), proj).max() for _, ws in drawn])
    w = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    at = np.argsort(z, kind="stable")
    # Right below a cut after i texts: the clean among the first i and the toxic among the rest.
    right = np.concatenate(([0], np.cumsum(np.where(y[at] == 0, w[at], -w[at]))))
    best = np.flatnonzero(right >= right.max() - 1e-9)
    edges = np.concatenate(([z[at[0]] - 1], z[at], [z[at[-1]] + 1]))
    middle = best[np.argmax(edges[best + 1] - edges[best])]
    net.shift = float((edges[middle] + edges[middle + 1]) / 2)
    net.wordless = min(0.49, counts[1] / (counts[0] + counts[1]))
    return net


def score(rows: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """row, a struct of all columns of rows, and score (0 to 1) of every whole text; higher: likelier toxic.

    Null texts and texts without words get the share of toxic labels, under a half. If there was
    nothing to learn, every score is 0. Repeated rows stay.
    """
    spark = rows.sparkSession
    ship(spark)
    at = rows.columns.index(text)
    held = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        lexicon = net.lexicon() if net else None
        for b in batches:
            texts = b.column(0).field(at).cast(pa.string()).to_pylist()
            out = net.scores(lexicon, texts) if net else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["row", "score"])

    whole = rows.select(packed(rows))
    return whole.mapInArrow(lambda b: trimmed(run(b)), T.StructType([*whole.schema.fields]).add("score", "double"))


def learned(docs: DataFrame, labels: DataFrame) -> Network | None:
    """From labelled documents whose crc32 remainder by 5 isn't 0; a doc_id with both labels is toxic."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(remainder("doc_id", 5) != 0)
    net = train(rows, marks)
    freed()
    return net


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), learned(docs, labels))
    return out.select("row.doc_id", (remainder("row.doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
