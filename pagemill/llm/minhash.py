"""Near-duplicate documents by DartMinHash signatures of word shingles.

A document is the weighted set of its shingles of five words, a shingle weighing its number of
occurrences. Darts are a Poisson process over (shingle, weight, rank) that depends on the shingle
alone: the weights of a shingle are cut into regions [0, 1), [1, 2), [2, 4), ..., and in each region
darts arrive along the rank at the rate of the region's width. A document gets the darts that lie
below its weight and below rank t / (all its weight), about t of them; a hash gives each dart a
coordinate, and the earliest dart of each coordinate is kept. A document with an empty coordinate
throws again up to twice the rank. Coordinates of two documents agree with the chance of their weighted
Jaccard similarity. Bands of coordinates are joined; a pair is a link if its exact similarity, computed
from the texts, is high enough.

Equal texts are one class from the start. In each band's bucket every member meets one leader, that
with the most neighbours in its buckets. Where members of a bucket are still in different components,
each such text is at home in a chunk of the largest of these buckets that it is in. A text that isn't of
its bucket's largest component visits the chunks where the bucket's members are at home: a pair of
different components that shares a band and whose signatures agree is compared there, exactly, until its
components are linked. Only links leave the task, so no bucket makes all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import dropped, packed, ship, trimmed, written

SHINGLE = 5
COORDINATES, ROWS = 120, 5
BANDS = COORDINATES // ROWS
#: Expected darts of a document.
DARTS = COORDINATES * (math.log(COORDINATES) + 2)
#: Agreement of signatures below which a pair isn't compared exactly; over five deviations under 0.8.
AGREE = 0.6
#: Buckets whose leaders are broadcast; words in a chunk of texts that meet; links of a compared text to one copy of it.
HOT, WORDS, COPIES = 50_000, 200_000, 256
#: Digests of texts that are broadcast, counted first, to fetch the texts; more of them are joined by shuffle.
WANTED = 100_000
KEPT, KEPT_BYTES = 200_000, 64

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A scrambled 64-bit number for each."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)


class Words:
    """Hashes of words; the oldest are forgotten in bulk."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            pass
        if len(known) > KEPT:
            known.clear()
        fresh = set(words).difference(known)
        known.update((w, xxhash.xxh64_intdigest(w)) for w in fresh)
        out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        for w in fresh:
            if len(w) > KEPT_BYTES:
                del known[w]
        return out


def shingles(words: Words, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a whole text, sorted, and their numbers. Under five words make one shingle."""
    ws = text.split() if text else []
    if not ws:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words.hashes(ws)
    n = max(1, len(h) - SHINGLE + 1)
    s = np.full(n, np.uint64(min(len(h), SHINGLE)))
    for k in range(min(SHINGLE, len(h))):
        s = s * _M2 + h[k : k + n]
    return np.unique(mixed(s), return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of 16-bit coordinates for each weighted set; zeros for an empty one."""
    out = np.zeros((len(sets), COORDINATES), np.uint16)
    todo = np.array([i for i, (s, _) in enumerate(sets) if len(s)], np.int64)
    times = 1.0
    while len(todo):
        ids = np.concatenate([sets[i][0] for i in todo])
        weight = np.concatenate([sets[i][1] for i in todo])
        doc = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        limit = DARTS * times / np.bincount(doc, weight, len(todo))
        found, ranks, cells = [], [], []
        low, width, region = 0, 1, 0
        at = np.arange(len(ids))
        while len(at):
            key = mixed(ids[at] ^ mixed(np.full(1, region + 1, np.uint64) * _GOLD))
            own, rank, n = at, np.zeros(len(at)), 0
            while len(own):
                n += 1
                dart = mixed(key + np.uint64(n * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
                rank = rank - np.log(uniform(dart)) / width
                on = rank < limit[doc[own]]
                own, rank, key, dart = own[on], rank[on], key[on], dart[on]
                more = mixed(dart ^ _GOLD)
                hit = low + width * ((more >> np.uint64(40)).astype(np.float64) / float(1 << 24)) < weight[own]
                found.append((more[hit] & np.uint64(0xFFFF)).astype(np.uint16))
                ranks.append(rank[hit])
                cells.append(doc[own[hit]] * COORDINATES + (dart[hit] % np.uint64(COORDINATES)).astype(np.int64))
            low, width, region = (1, 1, 1) if region == 0 else (2 * low, 2 * width, region + 1)
            at = at[weight[at] > low]
        value, rank, cell = np.concatenate(found), np.concatenate(ranks), np.concatenate(cells)
        last = np.argsort(-rank)
        part = np.zeros(len(todo) * COORDINATES, np.uint16)
        full = np.zeros(len(part), bool)
        part[cell[last]] = value[last]
        full[cell] = True
        out[todo] = part.reshape(-1, COORDINATES)
        todo = todo[~full.reshape(-1, COORDINATES).all(axis=1)]
        times *= 2
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit number for each band of each signature."""
    rows = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD), rows.shape[:2])
    for k in range(ROWS):
        h = mixed(h ^ (rows[:, :, k] + np.uint64((k + 1) * int(_M1) & 0xFFFFFFFFFFFFFFFF)))
    return h.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    every = int(a[1].sum() + b[1].sum()) - shared
    return shared / every if every else 0.0


def signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """rid, k, same (digest of the text), words, sig binary (null without words), bands array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            texts = b.column(2).to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size < 1_000_000):
                    size += len(texts[stop])
                    stop += 1
                sets = [shingles(words, t) for t in texts[start:stop]]
                got = signatures(sets)
                some = [len(s) > 0 for s, _ in sets]
                size = [int(n.sum()) for _, n in sets]
                keys = bands(got)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), b.column(1).slice(start, stop - start), pa.array(size, pa.int64()), pa.array([r.tobytes() if on else None for r, on in zip(got, some, strict=True)], pa.binary()), pa.array([r if on else None for r, on in zip(keys, some, strict=True)], pa.list_(pa.int64()))], names=["k", "same", "words", "sig", "bands"])
                start = stop

    ship(docs.sparkSession)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), F.unhex(F.sha2(t, 256)).alias("same"), t.cast("binary").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(lambda b: trimmed(run(b)), f"k {kind}, same binary, words long, sig binary, bands array<long>").withColumn("rid", F.monotonically_increasing_id())


def few_of(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows whose key is wanted (once each); up to ``WANTED`` keys are broadcast, counted first."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= WANTED else wanted, key, "left_semi")


def fetched(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """same, t of the wanted digests, once each."""
    return written(few_of(texts, written(wanted.distinct(), "wanted"), "same").dropDuplicates(["same"]), "texts")


def linked(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b), given as digests of texts, those whose exact similarity is ``least`` or more.

    texts: same, t. The first text of a pair comes once for every ``COPIES`` of its pairs, and the others
    stream past it, so a text with many pairs is neither gathered nor compared in one task.
    """
    spark = pairs.sparkSession
    # A table of its own, so that the join with a text of very many pairs can be split.
    counts = written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / COPIES).cast("int").alias("copies")), "copies")
    held = fetched(texts, pairs.select(F.col("a").alias("same")).union(pairs.select("b")))
    salted = pairs.join(counts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
    first = salted.select("a", "salt").distinct().join(held.withColumnRenamed("same", "a"), "a").select("a", "salt", F.lit(None).cast("binary").alias("b"), "t")
    rest = salted.select("a", "salt", "b").join(held.withColumnRenamed("same", "b"), "b").select("a", "salt", "b", "t")
    rows = first.unionByName(rest).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = Words(), None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            on = []
            for i, (other, t) in enumerate(zip(b, batch.column(2).to_pylist(), strict=True)):
                got = shingles(words, t)
                if other is None:
                    own = got
                elif similarity(own, got) >= least - 1e-12:
                    on.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in on], pa.binary()), pa.array([b[i] for i in on], pa.binary())], names=["a", "b"])

    return rows.select("a", "b", "t").mapInArrow(run, "a binary, b binary")


def meet(least: float):
    """A function from rows (home, chunk, probe, component, id, sig, t), sorted, to links a, b.

    Rows of a chunk come first, then probes, one at a time past them. A probe and a row are compared if
    they are of different components, here so far too, share a band and agree by signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, group = Words(), None
        root: dict[int, int] = {}
        held: dict[str, list] = {}
        tables: tuple = ()

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            out = []
            for home, chunk, probe, component, i, sig, t in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if (home, chunk) != group:
                    group, root, tables = (home, chunk), {}, ()
                    held = {"id": [], "component": [], "sig": [], "set": []}
                if not probe:
                    for k, v in (("id", i), ("component", component), ("sig", sig), ("set", shingles(words, t))):
                        held[k].append(v)
                    continue
                if not held["id"]:
                    continue
                if not tables:
                    sigs = np.frombuffer(b"".join(held["sig"]), np.uint16).reshape(-1, COORDINATES)
                    tables = (np.array(held["id"]), np.array(held["component"]), sigs, bands(sigs))
                ids, parts, sigs, keys = tables
                at = np.flatnonzero(parts != component)
                mine = np.frombuffer(sig, np.uint16)[None, :]
                at = at[(keys[at] == bands(mine)).any(axis=1)]
                agree = (sigs[at] == mine).mean(axis=1)
                own = None
                for k in at[np.argsort(-agree, kind="stable")][: int((agree >= AGREE).sum())].tolist():
                    x, y = find(component), find(held["component"][k])
                    if x == y:
                        continue
                    own = own or shingles(words, t)
                    if similarity(own, held["set"][k]) >= least - 1e-12:
                        root[max(x, y)] = min(x, y)
                        out.append((i, int(ids[k])))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return run


def apart(own: DataFrame, rows: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between the components of members (h, n, id, component) of buckets that hold several."""
    spark = own.sparkSession
    ids = written(own.groupBy("id").agg(F.max(F.struct("n", "h"))["h"].alias("home"), F.first("component").alias("component")), "ids")
    # Signatures, which are rows of their own, are fetched for these texts alone.
    ids = written(ids.join(few_of(rows.select(F.col("rid").alias("id"), "same", "words", "sig"), ids.select("id"), "id"), "id"), "signed_ids")
    chunks = ids.groupBy("home").agg(F.ceil(F.sum("words") / WORDS).cast("int").alias("chunks"))
    homes = written(ids.select("id", "component", "home").join(chunks, "home").select("id", "component", "home", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk")), "homes")
    members = own.join(ids.select("id", "words"), "id")
    top = members.groupBy("h", "component").agg(F.sum("words").alias("words")).groupBy("h").agg(F.max(F.struct("words", "component"))["component"].alias("top"))
    places = own.select("h", "id").join(homes.select("id", "home", "chunk"), "id").select("h", "home", "chunk").distinct()
    visits = own.join(top, "h").where("component <> top").select("h", "id").join(places, "h").select("id", "home", "chunk").distinct()
    kind = lambda probe: ("home", "chunk", F.lit(probe).alias("probe"), "component", "id")
    every = homes.select(*kind(False)).unionByName(visits.join(homes.select("id", "component"), "id").select(*kind(True)))
    every = every.join(ids.select("id", "same", "sig"), "id")
    held = fetched(texts, ids.select("same"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = every.join(held, "same").select("home", "chunk", "probe", "component", "id", "sig", "t").repartition(parts, "home", "chunk").sortWithinPartitions("home", "chunk", "probe", "id")
    return written(sorted_rows.mapInArrow(meet(least), "a long, b long"), "apart")


def classes(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id, kept, same: the class of near-duplicates of every row.

    Links join texts of weighted Jaccard similarity ``least`` or more over shingles of five words
    (under five words: one shingle of them all); classes are what links connect. class_id: the least
    key of the class; kept: one row of each class, the first with the least key. Null texts are empty,
    and texts without words are in a class only with equal texts. A null key comes after all others.
    Repeated rows are in one class. No rows give no rows.
    """
    spark = docs.sparkSession
    rows = written(signed(docs, key, text), "signed")
    # A text's rows share its least rid, the text's number from here on.
    texts = docs.select(F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)).alias("same"), F.col(text).cast("string").cast("binary").alias("t"))
    firsts = written(rows.groupBy("same").agg(F.min("rid").alias("id")), "firsts")
    one = written(rows.where("sig is not null").select(F.col("rid").alias("id"), "same", "bands").join(firsts.select("id"), "id", "left_semi"), "firsts_banded")
    names = one.select("id", "same")
    in_bands = one.select("id", F.explode("bands").alias("h"))
    counts = written(in_bands.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    line = max(1, total // HOT)
    hot = F.broadcast(counts.where(F.col("n") > line))
    other = in_bands.join(hot, "h", "left_anti").join(counts.where(F.col("n") <= line), "h")
    members = written(in_bands.join(hot, "h").unionByName(other), "members")
    near = members.groupBy("id").agg(F.sum("n").alias("near"))
    ranked = members.join(near, "id")
    leaders = written(ranked.groupBy("h").agg(F.max(F.struct("near", (-F.col("id")).alias("o")))["o"].alias("o")).select("h", (-F.col("o")).alias("first")), "leaders")
    big = F.broadcast(leaders.join(hot.select("h"), "h", "left_semi"))
    led = members.where(F.col("n") > line).join(big, "h").unionByName(members.where(F.col("n") <= line).join(leaders, "h"))
    stars = written(led.where("id <> first").select(F.col("first").alias("x"), F.col("id").alias("y")).distinct(), "stars")

    def compared(pairs: DataFrame) -> DataFrame:
        named = pairs.join(names.select(F.col("id").alias("x"), F.col("same").alias("a")), "x").join(names.select(F.col("id").alias("y"), F.col("same").alias("b")), "y")
        got = linked(named.select("a", "b"), texts, least)
        back = got.join(names.select(F.col("same").alias("a"), F.col("id").alias("x")), "a").join(names.select(F.col("same").alias("b"), F.col("id").alias("y")), "b")
        return written(back.select(F.col("x").alias("a"), F.col("y").alias("b")), "linked")

    links = compared(stars)
    found = components(links)
    own = members.join(found, "id", "left").select("h", "n", "id", F.coalesce("component", "id").alias("component"))
    split = own.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h")
    own = written(own.join(split, "h"), "split")
    if own.limit(1).count():
        links = links.unionByName(apart(own, rows, texts, least))
        found = components(links)

    least_key = F.min(F.struct(F.col("k").isNull().alias("none"), F.col("k"), F.col("rid")))
    ids = rows.select("rid", "k", "same").join(firsts, "same").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    ids = written(ids.select("rid", "k", "same", "component"), "classed")
    # A class of one row is its own; the others' least rows are a table, so that a large class can be split in the join.
    best = written(ids.groupBy("component").agg(least_key.alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component", F.col("m.k").alias("least"), F.col("m.rid").alias("best")), "classes")
    dropped(rows, firsts, one, counts, members, leaders, stars, own)
    alone = F.col("best").isNull()
    return ids.join(best, "component", "left").select(F.col("k").alias(key), F.when(alone, F.col("k")).otherwise(F.col("least")).alias("class_id"), (alone | (F.col("rid") == F.col("best"))).alias("kept"), "same")


def deduplicated(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each class: that with its least key (the other columns' least, if it repeats).

    The columns of docs are packed in one, so they may have any names.
    """
    kept = classes(docs, least, key, text).where("kept").select(F.col(key).alias("k"), F.col("same").alias("s"))
    same = F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))
    rows = docs.select(packed(docs), F.col(key).alias("own_k"), same.alias("own_s"))
    both = rows.join(kept, F.col("own_k").eqNullSafe(F.col("k")) & (F.col("own_s") == F.col("s")), "left_semi")
    return both.groupBy("own_k", "own_s").agg(F.min("row").alias("row")).select("row.*")


def digests(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "class_id", "kept")
