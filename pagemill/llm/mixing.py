"""Mixing sources to target weights by Sainte-Laguë apportionment.

Words are dealt in blocks of equally many. The blocks of the whole mix are apportioned to sources by
the highest quotients target / (2 * seats + 1); each source's blocks are apportioned in the same way
to the shards by the words that it has in each, none over what two passes hold. Where a source lies too
thinly for whole blocks, its words are dealt in proportion, so that all of its quota is placed. Every
shard gets integer quotas. In a shard the rows of a source, in seeded order, are one stream of words
that is cut into blocks. A quota is met by as many whole passes over the stream as it holds, then by
blocks in seeded order, the last one cut.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import WORD, packed, repeats, ship, written

#: Sources by code point, null last, weigh these in turn.
WEIGHTS = (5, 2, 1)
#: A catalogue of more sources than this is refused, as it is held by the driver.
MOST_SOURCES = 200_000


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int] | None = None) -> np.ndarray:
    """Seats by highest quotients votes / (2 * seats + 1), ties to the first; none gets over ``most``.

    A bisected divisor gives all seats but those at the margin, which are dealt one by one.
    """
    v = np.asarray(votes, float)
    cap = np.full(len(v), np.inf) if most is None else np.asarray(most, float)
    cap = np.where(v > 0, cap, 0)
    seats = int(min(seats, cap.sum()))
    if seats <= 0 or not len(v):
        return np.zeros(len(v), np.int64)

    def dealt(d: float) -> np.ndarray:
        return np.minimum(cap, np.floor(v / d + 0.5))

    low, high = v[v > 0].min() / (4.0 * seats + 4), 3 * v.max()
    while dealt(low).sum() < seats:
        low /= 2
    for _ in range(200):
        mid = math.sqrt(low * high)
        if not low < mid < high:
            break
        low, high = (mid, high) if dealt(mid).sum() > seats else (low, mid)
    got = dealt(high)
    while got.sum() < seats:
        got[int(np.argmax(np.where(got < cap, v / (2 * got + 1), -1)))] += 1
    return got.astype(np.int64)


def targets(sizes: Sequence[int], weights: Sequence[float], times: float = 1.5, most: float = 2.0) -> np.ndarray:
    """Shares by weight of ``times`` all sizes; none over ``most`` its size, the excess reshared by weight."""
    size, w = np.asarray(sizes, float), np.asarray(weights, float)
    cap, out = most * size, np.zeros(len(size))
    free, rest = np.ones(len(size), bool), min(times, most) * size.sum()
    while free.any():
        share = rest * w / w[free].sum()
        over = free & (share > cap)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = cap[over]
        rest -= cap[over].sum()
        free &= ~over
    return out


def shard_words(sizes: Sequence[int], seats: int, block: int) -> np.ndarray:
    """Words that each shard takes of a source with ``sizes`` words there: ``seats`` blocks in all, or two passes if less.

    Whole blocks by highest quotients, none over twice a shard's words. If those can't hold all seats,
    words in proportion instead, rounded down in running sums, so the total is exact and no shard gets
    over twice its own.
    """
    own = np.asarray(sizes, np.int64)
    got = sainte_lague(own, seats, 2 * own // block)
    if got.sum() >= seats:
        return got * block
    whole = int(own.sum())
    total = min(seats * block, 2 * whole)
    upto = [total * int(x) // whole for x in np.cumsum(own)] if whole else [0] * len(own)
    return np.diff(np.array([0, *upto], np.int64))


def seeded(n: int, *seed: int) -> np.ndarray:
    """A fixed scrambled order of 0 to n - 1."""
    x = np.arange(n, dtype=np.uint64)
    for s in seed:
        x = (x ^ np.uint64(s & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return np.argsort(x, kind="stable")


def take(sizes: np.ndarray, words: int, block: int, *seed: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Passes over a stream of rows; then the words taken of each block, and of each row by blocks."""
    whole = int(sizes.sum())
    if not whole:
        return 0, np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
    passes, rest = divmod(min(words, 2 * whole), whole)
    lengths = np.full(math.ceil(whole / block), block, np.int64)
    lengths[-1] = whole - block * (len(lengths) - 1)
    order = seeded(len(lengths), *seed)
    upto = np.cumsum(lengths[order])
    chosen = np.zeros(len(lengths), np.int64)
    chosen[order] = np.clip(rest - (upto - lengths[order]), 0, lengths[order])
    before = np.concatenate(([0], np.cumsum(chosen)))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    at = np.minimum(ends // block, len(lengths) - 1)
    covered = before[at] + np.minimum(chosen[at], ends - at * block)
    return passes, chosen, np.diff(covered)


def ranges(start: int, end: int, chosen: np.ndarray, block: int) -> list[dict[str, int]]:
    """Of a row whose words are start to end of the stream, those that chosen blocks cover, from its own 0."""
    out: list[dict[str, int]] = []
    for b in range(start // block, -(-end // block)):
        a, z = max(start, b * block), min(end, b * block + int(chosen[b]))
        if z > a:
            if out and out[-1]["hi"] == a - start:
                out[-1]["hi"] = z - start
            else:
                out.append({"lo": a - start, "hi": z - start})
    return out


def mix(docs: DataFrame, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, times: float = 1.5, shard_rows: int = 2048, most_shards: int = 65536, block: int = 1024, rid: str | None = None) -> DataFrame:
    """key, text_hash, source, size, source_size, target, taken, passes, ranges, rid: what the mix takes of each row.

    size: words of the text (null: 0). target: the source's. taken: passes * size plus the words in
    ``ranges``, which are the row's own word numbers [lo, hi). A null source is a source, the last.
    Blocks hold ``block`` words, fewer (8 at least) where the least target is under 100 blocks. A
    source of no words has target 0. Rows with a null key, empty texts and repeated rows are ordinary
    rows; no rows give no rows. Over 200,000 sources are refused with ValueError, none is dropped. rid
    is a column of docs that numbers its rows, or else made here; it parts rows that repeat key and
    text, each of which has its own share, and deals them to several shards where they are very many.
    """
    spark = docs.sparkSession
    ship(spark)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.col(key).alias("k"), F.col(source).cast("string").alias("source"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(t).alias("text_hash"), (F.col(rid) if rid else F.monotonically_increasing_id()).alias("rid"))
    slim = written(slim, "sizes")
    found = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    target = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], times)
    least = min((x for x in target if x > 0), default=0)
    block = int(max(8, min(block, least // 100)))
    quota = sainte_lague(target, round(target.sum() / block))
    shards = max(1, min(most_shards, math.ceil(sum(r["n"] for r in found) / shard_rows)))
    catalogue = spark.createDataFrame([(i, r["source"], int(r["size"]), float(target[i]), int(quota[i])) for i, r in enumerate(found)], "sid int, source string, source_size long, target double, quota long")

    rows = repeats(slim, ["k", "text_hash"]).join(F.broadcast(catalogue.select(F.col("source").alias("s"), "sid")), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    rows = rows.withColumn("shard", F.pmod(F.when(F.col("salt") == 0, F.xxhash64(F.lit(seed), "k", "text_hash")).otherwise(F.col("salt")), F.lit(shards)).cast("int")).drop("salt")

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shard")
        got = shard_words(part["words"].to_numpy(np.int64), int(part["quota"].iloc[0]), block)
        return pd.DataFrame({"shard": part["shard"].to_numpy(), "sid": part["sid"].to_numpy(), "words": got})

    held = rows.groupBy("shard", "sid").agg(F.sum("size").alias("words"))
    quotas = held.join(F.broadcast(catalogue.select("sid", "quota")), "sid").groupBy("sid").applyInPandas(deal, "shard int, sid int, words long")

    def choose(own: pd.DataFrame, quotas: pd.DataFrame) -> pd.DataFrame:
        words = dict(zip(quotas["sid"], quotas["words"], strict=True))
        out = []
        for sid, part in own.sort_values(["sid", "at", "text_hash", "size", "rid"], kind="stable").groupby("sid", sort=True):
            size = part["size"].to_numpy(np.int64)
            shard = int(part["shard"].iloc[0])
            passes, chosen, some = take(size, int(words.get(sid, 0)), block, seed, shard, int(sid))
            ends = np.cumsum(size)
            cut = [[{"lo": 0, "hi": int(n)}] if n and s == n else [] if not s else ranges(int(e - n), int(e), chosen, block) for s, n, e in zip(some, size, ends, strict=True)]
            out.append(pd.DataFrame({"k": part["k"], "text_hash": part["text_hash"], "sid": part["sid"], "size": size, "passes": passes, "taken": passes * size + some, "ranges": cut, "rid": part["rid"]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("k", "text_hash", "sid", "size", "passes", "taken", "ranges", "rid")})

    kind = slim.schema["k"].dataType.simpleString()
    own = rows.withColumn("at", F.xxhash64(F.lit(seed + 1), "k", "text_hash")).groupBy("shard")
    got = own.cogroup(quotas.groupBy("shard")).applyInPandas(choose, f"k {kind}, text_hash long, sid int, size long, passes int, taken long, ranges array<struct<lo: long, hi: long>>, rid long")
    got = got.join(F.broadcast(catalogue.drop("quota")), "sid")
    return got.select(F.col("k").alias(key), "text_hash", "source", "size", "source_size", "target", "taken", "passes", "ranges", "rid")


def mixed_texts(docs: DataFrame, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source", times: float = 1.5) -> DataFrame:
    """docs as the mix has them: a row for each pass over a text, and one with the words of its ranges.

    The columns of docs stay, packed in one on the way, so they may have any names; a null text, which
    has no words, isn't taken, nor is any other text without words. Of a range the text runs from its
    first word's first character to its last's last. Rows that repeat key and text each have their own
    share. ``n_chars``, where docs has it as a whole number, is counted anew.
    """
    rows = written(docs.select(packed(docs), F.monotonically_increasing_id().alias("rid")), "rows")
    of = lambda c: F.col("row")[c]
    whole = of(text).cast("string")
    got = mix(rows.select(of(key).alias("k"), whole.alias("t"), of(source).alias("source"), "rid"), seed, "k", "t", "source", times=times, rid="rid")
    got = got.where((F.col("size") > 0) & ((F.col("passes") > 0) | (F.size("ranges") > 0))).select("rid", "size", "passes", "ranges")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, parts: pd.Series) -> pd.Series:
        import re

        out = []
        for t, rs in zip(texts, parts, strict=True):
            at = [] if t is None else [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
            out.append(None if t is None else "\n".join(t[at[r["lo"]][0] : at[r["hi"] - 1][1]] for r in rs))
        return pd.Series(out)

    # Texts move once, and only those that are cut go to Python.
    times_taken = F.col("passes") + F.when(F.size("ranges") > 0, 1).otherwise(0)
    each = rows.join(got, "rid").withColumn("copy", F.explode(F.sequence(F.lit(1), times_taken)))
    first = F.get("ranges", F.lit(0))
    entire = (F.size("ranges") == 1) & (first["lo"] == 0) & (first["hi"] == F.col("size"))
    each = each.withColumn("part", (F.col("copy") > F.col("passes")) & ~entire)
    each = each.withColumn("t", F.coalesce(cut(F.when(F.col("part"), whole), F.when(F.col("part"), F.col("ranges"))), whole))
    counted = "n_chars" in docs.columns and docs.schema["n_chars"].dataType.typeName() in ("long", "integer")
    made = {text: F.col("t")} | ({"n_chars": F.length("t").cast(docs.schema["n_chars"].dataType)} if counted else {})
    return each.select(*(made.get(c, of(c)).alias(c) for c in docs.columns))


def digests(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
