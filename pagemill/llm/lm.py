"""Language-model scoring: a gated recurrent network with a class-factored output, in numpy.

The commonest words and the end are the network's own types, the more of them the more words there are
to learn from; they are dealt, by frequency, to classes of about equal size, and one more class holds
every other word. The network gives the chance of the class and of the word in it; in the last class
words have their corpus frequencies, smoothed, with one share for all unseen words. The state runs
through a whole document, from window to window, in training (truncated backpropagation) and in scoring.

The network learns from every row to learn from. It starts on the driver from a small drawn sample; then,
in rounds, each task goes once through its part of the round's rows from the weights of the round before,
and the tasks' weights are averaged by their tokens, in blocks, by a shuffle.

Words are counted over all documents. Frequent words' counts are held by every worker (``HOT`` at most);
the others' are joined by word, a row for each document and word. Arrays have a column for each token.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import freed, remainder, ship, trimmed, written

#: Words whose counts every worker holds; a word of more bytes than LONG stands as its digest.
HOT, LONG = 100_000, 64
#: The network's own types (the end among them): at least, at most, and between them so many of the root of all tokens.
TYPES, MOST_TYPES, ROOT_SHARE = 1024, 16384, 0.15
H = 16
WINDOW = 32
#: Rounds over all rows to learn from, streams of a task at most, and tokens laid out in streams at once.
ROUNDS, STREAMS, LAID = 2, 512, 1 << 20
#: Tokens scored at once, distinct words counted before they are handed on, and bytes of text split at once.
CHUNK, COUNTED, SPLIT = 1 << 17, 250_000, 1 << 20
ALPHA = 0.1
#: Numbers in a block of weights, and groups in which the tasks' blocks are added up first.
BLOCK, GROUPS = 8192, 64


def pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """Words in lower case (A to Z only), as bytes, of a text's parts of about ``SPLIT`` bytes."""
    if not text:
        return
    start = 0
    while start < len(text):
        stop = start + SPLIT
        while stop < len(text) and text[stop] not in b" \t\n\v\f\r":
            stop += 1
        yield text[start:stop].lower().split()
        start = stop


def tokens(text: bytes | None) -> list[bytes]:
    return [w for part in pieces(text) for w in part]


def name_of(word: bytes) -> bytes:
    """The word, or for a long one a blank, which no word has, and its digest."""
    return word if len(word) <= LONG else b" " + hashlib.sha256(word).digest()


def counts(rows: DataFrame, text: str = "t", learn: str = "learn") -> DataFrame:
    """word binary, c long (in rows to learn from), every long (in all rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taught, others, held = Counter(), Counter(), 0

        def out() -> Iterator[pa.RecordBatch]:
            for found, on in ((taught, 1), (others, 0)):
                if found:
                    n = np.fromiter(found.values(), np.int64, len(found))
                    yield pa.RecordBatch.from_arrays([pa.array([name_of(w) for w in found], pa.binary()), pa.array(n * on), pa.array(n)], names=["word", "c", "every"])
                    found.clear()

        for b in batches:
            for t, on in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                t = t.as_py()
                held += len(t)
                for ws in pieces(t):
                    (taught if on else others).update(ws)
                    if len(taught) + len(others) > COUNTED or held > 256 * SPLIT:
                        yield from out()
                        held = 0
        yield from out()

    ship(rows.sparkSession)
    each = rows.select(F.col(text).cast("binary").alias("t"), learn).mapInArrow(lambda b: trimmed(run(b)), "word binary, c long, every long")
    return each.groupBy("word").agg(F.sum("c").alias("c"), F.sum("every").alias("every"))


class Model:
    """Network, classes and the counts of frequent words. Type 0 is the end, the last class the rest."""

    def __init__(self, own: list[bytes], ends: int, hot: dict[bytes, int], total: int, types: int, seed: int = 11):
        self.own, self.total, self.types, self.ends = len(own), total, types, ends
        rank = {w: i + 1 for i, w in enumerate(own)}
        names = [*own, *(w for w in hot if w not in rank)]
        #: Numbers of frequent words, the network's own first; their counts; and the number of all others.
        self.hot = {w: i for i, w in enumerate(names)}
        #: Types of the network's own words, and whether a long one is among them.
        self.own_type = rank
        self.own_long = any(w[:1] == b" " for w in own)
        self.c = np.array([*(hot[w] for w in names), 0], np.int64)
        self.rest_total = total - ends - int(self.c[: self.own].sum())
        self.rest_types = max(0, types - 1 - self.own)
        n = self.own + 1
        self.size = math.ceil(n / max(1, round(math.sqrt(n))))
        classes = math.ceil(n / self.size)
        self.class_of = np.append(np.arange(n) // self.size, classes).astype(np.int32)
        self.place = np.append(np.arange(n) % self.size, 0).astype(np.int32)
        g = np.random.default_rng(seed)
        s = 1 / math.sqrt(H)
        shapes = {"e": (3 * H, n + 2), "u": (3 * H, H), "c": (classes + 1, H), "cb": (classes + 1, 1), "w": (classes, self.size, H), "wb": (classes, self.size, 1)}
        self.p = {k: (g.standard_normal(x) * (s if k in "eu" else 0.1)).astype(np.float32) for k, x in shapes.items()}
        self.p["e"] *= 0.5
        freq = np.array([ends, *self.c[: self.own], max(self.rest_total, 1)], float) + ALPHA
        by_class = np.bincount(self.class_of, freq, classes + 1)
        self.p["cb"][:, 0] = np.log(by_class / by_class.sum())
        self.p["wb"][:] = -30
        self.p["wb"][self.class_of[:-1], self.place[:-1], 0] = np.log(freq[:-1] / by_class[self.class_of[:-1]])

    @property
    def start(self) -> int:
        return self.own + 2

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].reshape(-1) for k in sorted(self.p)])

    def unflat(self, values: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = values[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of frequent words, len(self.hot) for all others."""
        found = np.fromiter(map(self.hot.get, words, repeat(len(self.hot))), np.int32, len(words))
        cold = np.flatnonzero(found == len(self.hot))
        for i in cold.tolist():
            if len(words[i]) > LONG:
                found[i] = self.hot.get(name_of(words[i]), len(self.hot))
        return found

    def typed(self, numbers: np.ndarray) -> np.ndarray:
        """Types of words by their numbers; words that aren't the network's own are one type."""
        return np.minimum(numbers, self.own) + 1

    def text(self, words: bytes | None) -> np.ndarray:
        """Types of a text's words, then the end."""
        other, found = self.own + 1, []
        for ws in pieces(words):
            found.append(np.fromiter(map(self.own_type.get, ws, repeat(other)), np.int32, len(ws)))
            if self.own_long:
                for i in np.flatnonzero(found[-1] == other).tolist():
                    if len(ws[i]) > LONG:
                        found[-1][i] = self.own_type.get(name_of(ws[i]), other)
        return np.concatenate([*found, np.zeros(1, np.int32)])

    def step(self, x: np.ndarray, h: np.ndarray):
        a = self.p["u"] @ h
        zr = x[: 2 * H] + a[: 2 * H]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:H], zr[H:]
        c = r * a[2 * H :]
        c += x[2 * H :]
        np.tanh(c, out=c)
        new = h - c
        new *= z
        new += c
        return new, (z, r, c, a[2 * H :])

    def grouped(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """Targets' order by class, and each class but the rest with its part of that order."""
        own = self.class_of[target].astype(np.uint16)
        order = np.argsort(own, kind="stable")
        edges = np.searchsorted(own[order], np.arange(len(self.p["w"]) + 1)).tolist()
        return order, [(k, slice(a, b)) for k, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]

    def output(self, hs: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log chances of types after states; of the rest, of their class alone."""
        e = self.p["c"] @ hs
        e += self.p["cb"]
        np.minimum(e, 60, out=e)
        out = e[self.class_of[target], np.arange(len(target))]
        out -= np.log(np.exp(e, out=e).sum(axis=0))
        order, groups = self.grouped(target)
        place, hs, inner = self.place[target[order]], hs.take(order, axis=1), np.zeros(len(order), out.dtype)
        for k, at in groups:
            e = self.p["w"][k] @ hs[:, at]
            e += self.p["wb"][k]
            np.minimum(e, 60, out=e)
            inner[at] = e[place[at], np.arange(at.stop - at.start)]
            inner[at] -= np.log(np.exp(e, out=e).sum(axis=0))
        out[order] += inner
        return out

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log chance of each text, given as types with the end; the state runs through it whole."""
        total = np.zeros(len(texts))
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        flat = np.concatenate([texts[i] for i in order])
        base = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        h = np.zeros((H, len(order)), self.p["u"].dtype)
        before = np.full(len(order), self.start)
        kept, aims, owners, held = [], [], [], 0
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        every = np.arange(len(order))
        for t, n in enumerate(alive.tolist()):
            h, _ = self.step(self.p["e"].take(before[:n], axis=1), h[:, :n])
            before = flat[base[:n] + t]
            kept.append(h)
            aims.append(before)
            owners.append(every[:n])
            held += n
            if held >= CHUNK or t + 1 == len(alive):
                got = self.output(np.concatenate(kept, axis=1), np.concatenate(aims))
                total += np.bincount(np.concatenate(owners), got, len(order))
                kept, aims, owners, held = [], [], [], 0
        out = np.empty(len(texts))
        out[order] = total
        return out

    def gradients(self, before: np.ndarray, target: np.ndarray, h: np.ndarray, fresh: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Of the mean loss over a window (steps, streams); state after it. fresh: a document starts here."""
        p, (steps, n) = self.p, before.shape
        kind = p["u"].dtype
        old = ~fresh
        xs = p["e"].take(before.reshape(-1), axis=1).reshape(3 * H, steps, n)
        hs, tape = np.empty((H, steps, n), kind), []
        for t in range(steps):
            h = h * old[t]
            new, parts = self.step(xs[:, t], h)
            tape.append((h, *parts))
            hs[:, t] = h = new
        flat, aim = hs.reshape(H, -1), target.reshape(-1)
        d = p["c"] @ flat
        d += p["cb"]
        d -= d.max(axis=0)
        np.exp(d, out=d)
        d /= d.sum(axis=0)
        own, every = self.class_of[aim], np.arange(len(aim))
        loss = -float(np.log(d[own, every] + 1e-12).sum())
        d[own, every] -= 1
        d /= len(aim)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["c"], g["cb"] = d @ flat.T, d.sum(axis=1, keepdims=True)
        d_hs = p["c"].T @ d
        order, groups = self.grouped(aim)
        by_class, places, d_own = flat.take(order, axis=1), self.place[aim[order]], np.zeros_like(flat)
        for k, at in groups:
            part = by_class[:, at]
            q = p["w"][k] @ part
            q += p["wb"][k]
            q -= q.max(axis=0)
            np.exp(q, out=q)
            q /= q.sum(axis=0)
            place = places[at], np.arange(at.stop - at.start)
            loss -= float(np.log(q[place] + 1e-12).sum())
            q[place] -= 1
            q /= len(aim)
            g["w"][k], g["wb"][k] = q @ part.T, q.sum(axis=1, keepdims=True)
            d_own[:, at] = p["w"][k].T @ q
        back = np.empty_like(order)
        back[order] = every
        d_hs += d_own.take(back, axis=1)
        d_hs = d_hs.reshape(H, steps, n)
        carry, dx, da = np.zeros((H, n), kind), np.empty((3 * H, steps, n), kind), np.empty((3 * H, n), kind)
        for t in range(steps - 1, -1, -1):
            h0, z, r, c, an = tape[t]
            dh = d_hs[:, t] + carry
            dc = dh * (1 - z) * (1 - c * c)
            da[:H] = dh * (h0 - c) * z * (1 - z)
            da[H : 2 * H] = dc * an * r * (1 - r)
            da[2 * H :] = dc * r
            dx[: 2 * H, t], dx[2 * H :, t] = da[: 2 * H], dc
            g["u"] += da @ h0.T
            carry = (p["u"].T @ da + dh * z) * old[t]
        x = before.reshape(-1).astype(np.uint16)
        order = np.argsort(x, kind="stable")
        some, first = np.unique(x[order], return_index=True)
        g["e"][:, some] = np.add.reduceat(dx.reshape(3 * H, -1).take(order, axis=1), first, axis=1)
        return g, h, loss / len(aim)

    def fit(self, texts: list[np.ndarray], streams: int = 48, rate: float = 0.01, last: float = 0.2, seed: int = 11) -> float:
        """Goes once through texts, laid end to end in streams; returns the mean loss. The last half has the ``last`` of the rate."""
        order = np.random.default_rng(seed)
        perm = [texts[i] for i in order.permutation(len(texts))]
        target = np.concatenate(perm)
        fresh = np.zeros(len(target), bool)
        fresh[np.concatenate(([0], np.cumsum([len(t) for t in perm])[:-1]))] = True
        before = np.where(fresh, self.start, np.concatenate(([0], target[:-1])))
        wide = max(1, min(streams, len(target) // (8 * WINDOW)))
        steps = len(target) // wide
        # What is left over after even streams goes through them as well, in a last short window of its own.
        left = [x[steps * wide :].reshape(1, -1).T for x in (target, before, fresh)]
        target, before, fresh = (x[: steps * wide].reshape(wide, steps).T for x in (target, before, fresh))
        h, seen = np.zeros((H, wide), self.p["u"].dtype), []
        for t in range(0, steps, WINDOW):
            g, h, loss = self.gradients(before[t : t + WINDOW], target[t : t + WINDOW], h, fresh[t : t + WINDOW])
            seen.append(loss)
            self.moved(g, rate * (last if t > steps // 2 else 1.0))
        if len(left[0]):
            self.moved(self.gradients(left[1], left[0], h[:, -1:], left[2])[0], rate * last)
        return float(np.mean(seen))

    def moved(self, g: dict[str, np.ndarray], rate: float) -> None:
        """One step of Adam along gradients, whose size is bounded by 1."""
        if not hasattr(self, "moments"):
            self.moments = ({k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()})
            self.steps = 0
        m1, m2 = self.moments
        self.steps += 1
        size = math.sqrt(sum(float(np.vdot(v, v)) for v in g.values()))
        for k, v in g.items():
            v *= min(1.0, 1 / max(size, 1e-9))
            m1[k] *= 0.9
            m1[k] += 0.1 * v
            v *= v
            m2[k] *= 0.99
            m2[k] += 0.01 * v
            self.p[k] -= (rate / (1 - 0.9**self.steps)) * m1[k] / (np.sqrt(m2[k] / (1 - 0.99**self.steps)) + 1e-6)

    def settled(self) -> None:
        """Forgets what only training needs."""
        self.__dict__.pop("moments", None)

    def rest(self, c: np.ndarray) -> np.ndarray:
        """log10 chance of words that aren't the network's own, within their class."""
        return np.log10((c + ALPHA) / (self.rest_total + ALPHA * (self.rest_types + 1)))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + ALPHA) / (self.total + ALPHA * (self.types + 1)))


def counted(rows: DataFrame, found: DataFrame) -> Model:
    """A model with the corpus counts of rows (t, learn) and a network as it starts."""
    docs = rows.where("learn").count()
    totals = found.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum("every"), F.lit(0))).first()
    # Words of at least total / HOT occurrences are HOT at most; the line is halved while that holds.
    line = max(1, -(-totals[2] // HOT))
    steps = sorted({max(1, line >> k) for k in range(line.bit_length() + 1)}, reverse=True)
    over = found.agg(*(F.count_if(F.col("every") >= s) for s in steps)).first()
    line = min(s for s, n in zip(steps, over, strict=True) if n <= HOT or s == steps[0])
    hot = {bytes(r["word"]): r["c"] for r in found.where(F.col("every") >= line).select("word", "c").collect()}
    total = totals[0] + docs
    most = min(MOST_TYPES, max(TYPES, round(ROOT_SHARE * math.sqrt(total))))
    own = sorted((w for w in hot if hot[w]), key=lambda w: (-hot[w], w))[: most - 1]
    return Model(own, docs, hot, total, totals[1] + (1 if docs else 0))


def begun(model: Model, rows: DataFrame, key: str, text: str, sample: int = 2000, sample_bytes: int = 6_000_000, epochs: int = 2) -> None:
    """Gives the network a start from ``sample`` whole texts and ``sample_bytes`` at most; all rows follow in rounds.

    Texts of over a tenth of ``sample_bytes`` are left to the rounds.
    """
    share = min(1.0, (1.1 * sample + 20) / max(1, model.ends))
    draw = F.pmod(F.xxhash64(F.lit("lm"), F.col(key), F.col(text)), F.lit(1 << 30))
    drawn = rows.where((draw < int(share * (1 << 30))) & (F.octet_length(text) <= sample_bytes // 10)).select(draw.alias("draw"), F.col(text).cast("binary").alias("t")).collect()
    drawn = [bytes(r["t"]) for r in sorted(drawn, key=lambda r: (r["draw"], bytes(r["t"])))[:sample]]
    upto = int(np.searchsorted(np.cumsum([len(t) for t in drawn]), sample_bytes, side="right")) if drawn else 0
    texts = [model.text(t) for t in drawn[:upto]]
    del drawn
    for epoch in range(epochs if texts else 0):
        model.fit(texts, last=0.2 if epoch == epochs - 1 else 1.0, seed=epoch)
    model.settled()


def taught(model: Model, rows: DataFrame, key: str, text: str, rate: float = 0.004) -> None:
    """Rounds over all rows: each row is in one of them, where the task that reads it learns from it once.

    The weights after a round are the tasks' weights, averaged by their tokens. Blocks of weights are
    added up in groups of tasks first, so no task gathers those of all.
    """
    spark = rows.sparkSession
    names = [F.pmod(F.xxhash64(F.lit("round"), F.col(key), F.col(text)), F.lit(ROUNDS)) == k for k in range(ROUNDS)]
    for k, own in enumerate(names):
        held = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], held=held, rate=rate / (1 + k)) -> Iterator[pa.RecordBatch]:
            model, texts, laid, seen = held.value, [], 0, 0
            start = {x: v.copy() for x, v in model.p.items()}
            for batch in batches:
                for t in batch.column(0):
                    texts.append(model.text(t.as_py()))
                    laid += len(texts[-1])
                    if laid >= LAID:
                        model.fit(texts, STREAMS, rate, 1.0)
                        texts, laid, seen = [], 0, seen + laid
            if texts:
                model.fit(texts, STREAMS, rate, 1.0)
            seen += laid
            if seen:
                every = model.flat().astype(np.float64) * seen
                parts = [every[i : i + BLOCK] for i in range(0, len(every), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array([float(seen)] * len(parts)), pa.array([x.tobytes() for x in parts], pa.binary())], names=["block", "n", "v"])
            model.p = start
            model.settled()

        def add(part: pd.DataFrame) -> pd.DataFrame:
            v = sum(np.frombuffer(x) for x in part["v"])
            return pd.DataFrame({"block": part["block"].iloc[:1], "n": part["n"].sum(), "v": [v.tobytes()]})

        kinds = "block int, n double, v binary"
        each = rows.where(own).select(F.col(text).cast("binary").alias("t")).mapInArrow(lambda b, run=run: trimmed(run(b)), kinds)
        some = each.withColumn("task", F.pmod(F.spark_partition_id(), F.lit(GROUPS))).groupBy("block", "task").applyInPandas(add, kinds)
        found = some.groupBy("block").applyInPandas(add, kinds).orderBy("block").collect()
        held.destroy()
        if found:
            model.unflat(np.concatenate([np.frombuffer(r["v"]) / r["n"] for r in found]))


def gathered(batches: Iterator[pa.RecordBatch], model: Model, rows: int = 8192, most: int = 1 << 21) -> Iterator[tuple[pa.Array, list[np.ndarray], list[list[bytes]]]]:
    """Keys, words' numbers and other words of rows, up to so many rows or words: the more, the fuller each step."""
    ids, texts, others, held = [], [], [], 0
    for b in batches:
        start = 0
        for i, t in enumerate(b.column(1)):
            found, cold = [np.zeros(0, np.int32)], []
            for ws in pieces(t.as_py()):
                found.append(model.numbers(ws))
                cold += [name_of(ws[k]) for k in np.flatnonzero(found[-1] == len(model.hot)).tolist()]
            texts.append(np.concatenate(found))
            others.append(cold)
            held += len(texts[-1])
            if len(texts) >= rows or held >= most:
                ids.append(b.column(0).slice(start, i + 1 - start))
                yield pa.concat_arrays(ids), texts, others
                ids, texts, others, held, start = [], [], [], 0, i + 1
        ids.append(b.column(0).slice(start))
    if texts:
        yield pa.concat_arrays(ids), texts, others


def score(docs: DataFrame, learn, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score (log10) of every whole text.

    learn: a condition on the rows to learn from. Null texts are empty: their one token is the end.
    Without a row to learn from nothing is known, and the network is as it starts. Words of equal counts
    are ranked by their bytes. Repeated rows are scored, and learned from, one by one; a null key stays.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), F.coalesce(learn, F.lit(False)).alias("learn"))
    found = written(counts(rows), "counts")
    model = counted(rows, found)
    begun(model, rows.where("learn"), "k", "t")
    taught(model, rows.where("learn"), "k", "t")
    freed()
    held = spark.sparkContext.broadcast(model)
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        every = len(model.hot)
        base, rest = model.base(model.c), model.rest(model.c)
        # Of the words joined later nothing is added here; of the network's own, nothing but the network's score.
        base[every], rest[every], rest[: model.own] = 0, 0, 0
        known, end, log10 = model.c > 0, model.base(np.array([model.ends]))[0], 1 / math.log(10)
        for ids, texts, others in gathered(batches, model):
            net = model.score([np.append(model.typed(t), np.int32(0)) for t in texts]) * log10
            flat = np.concatenate(texts)
            lengths = np.array([len(t) for t in texts])
            owner = np.repeat(np.arange(len(texts)), lengths)
            sums = [np.bincount(owner, v[flat], len(texts)) for v in (known, base, rest)]
            cold = [Counter(ws) for ws in others]
            yield pa.RecordBatch.from_arrays([ids, pa.array(lengths + 1, pa.int64()), pa.array(sums[0].astype(np.int64) + int(model.ends > 0)), pa.array(sums[1] + end), pa.array(net + sums[2]), pa.array([list(c) for c in cold], pa.list_(pa.binary())), pa.array([list(c.values()) for c in cold], pa.list_(pa.int32()))], names=["k", "n", "known", "base", "score", "words", "times"])

    each = rows.select("k", F.col("t").cast("binary")).mapInArrow(lambda b: trimmed(run(b)), f"k {kind}, n long, known long, base double, score double, words array<binary>, times array<int>")
    each = written(each.withColumn("rid", F.monotonically_increasing_id()), "scored")
    rare = each.select("rid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("rid", F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    c = F.coalesce("c", F.lit(0))
    base = F.log10((c + ALPHA) / F.lit(model.total + ALPHA * (model.types + 1)))
    rest = F.log10((c + ALPHA) / F.lit(model.rest_total + ALPHA * (model.rest_types + 1)))
    more = rare.join(found.select("word", "c"), "word", "left").groupBy("rid").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known2"), F.sum(F.col("n") * base).alias("base2"), F.sum(F.col("n") * rest).alias("score2"))
    both = each.drop("words", "times").join(more, "rid", "left")
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return both.select(F.col("k").alias(key), F.col("n").alias("n_tokens"), add("known", "known2").cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), add("base", "base2").alias("base_score"), add("score", "score2").alias("score"))


def digests(docs: DataFrame) -> DataFrame:
    """Learns from documents whose crc32 remainder by 10 isn't 0."""
    out = score(docs, remainder("doc_id", 10) != 0)
    return out.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
