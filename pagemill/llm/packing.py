"""Sharding by vector bin packing over bytes, tokens and rows.

A group is the rows of equal text (null counts as empty). Each group, a vector (bytes, tokens, rows),
goes to the shard where the dot product of that vector with the shard's residual capacity is highest;
capacities are even shares. Groups are placed in falling order of their largest share.

At scale the placement has two levels. A group of over ``heavy_share`` of an even shard in any of the
three is heavy: there are at most ``3 * shards / heavy_share`` of them, and they are placed first, in
one list. A heavy group of over ``whole_share`` of a shard is cut by a hash of the key (and, where one
key has very many of its rows, of the row) into pieces of about that size: sizes can't be near equal if
a text with a third of all rows sits in one shard. Groups of that share or less stay whole. All others
are dealt by hash into buckets, and each bucket is packed by itself into its part of the capacity
that the heavy groups left.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import WORD, repeats, ship, written


#: In the dot product bytes count so much, tokens and rows so much: sizes in bytes are to be near equal.
LAW = np.array([32.0, 1.0, 1.0])


def place(vectors: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """A bin for each vector, in the order given; residual (bins x dimensions) is changed."""
    out = np.empty(len(vectors), np.int32)
    for i, (v, w) in enumerate(zip(vectors, vectors * LAW, strict=True)):
        b = int(np.argmax(residual @ w))
        out[i] = b
        residual[b] -= v
    return out


def in_order(vectors: np.ndarray, names: list) -> list[int]:
    """Falling by largest share, then by name."""
    size = vectors.max(axis=1) if len(vectors) else np.zeros(0)
    return sorted(range(len(vectors)), key=lambda i: (-size[i], names[i]))


def assign(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", whole_share: float = 0.5, heavy_share: float = 0.01, bucket_groups: int = 2048) -> DataFrame:
    """key, size, tokens, text_crc32, text_sha, shard, slot: a shard and a place in it for every row.

    size: UTF-8 bytes of the text (null: none) plus 16. slot counts the rows of a shard from 0 without
    gaps. Null and empty texts are one group. A null key is an ordinary key. Repeated rows each get a
    slot. No rows give no rows. Fewer groups than shards leave shards empty. Of equal dot products the
    first shard is taken; groups of equal shares go by their digest.
    """
    spark = docs.sparkSession
    ship(spark)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.col(key).alias("k"), t.alias("t"), F.monotonically_increasing_id().alias("rid"))
    slim = slim.select("rid", "k", (F.octet_length("t") + 16).cast("long").alias("size"), F.regexp_count("t", F.lit(WORD)).cast("long").alias("tokens"), F.crc32(F.col("t").cast("binary")).alias("text_crc32"), F.unhex(F.sha2("t", 256)).alias("g"))
    slim = written(slim, "slim")
    groups = written(slim.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.max("tokens").alias("tokens")), "groups")
    total = groups.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("n") * F.col("size"), F.col("n") * F.col("tokens"), F.col("n"), F.lit(1)))).first()
    even = np.array([max(1.0, x / shards) for x in total[:3]])
    share = F.greatest(F.col("n") * F.col("size") / F.lit(float(even[0])), F.col("n") * F.col("tokens") / F.lit(float(even[1])), F.col("n") / F.lit(float(even[2])))
    groups = groups.withColumn("share", share)

    most = math.ceil(3 * shards / heavy_share)
    heavy = groups.where(F.col("share") > heavy_share).collect()
    if len(heavy) > most:
        raise AssertionError(f"{len(heavy)} groups are over {heavy_share} of an even shard; {most} can be")
    cut = {bytes(r["g"]): max(1, math.ceil(r["share"] / whole_share)) if r["share"] > whole_share else 1 for r in heavy}
    cuts = F.broadcast(spark.createDataFrame([(bytearray(g), k) for g, k in cut.items()], "g binary, pieces int"))
    rows = repeats(slim, ["k", "g"]).drop("rid").join(cuts, "g", "left")
    rows = rows.withColumn("piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("k", "salt"), "pieces").cast("int")).when(F.col("pieces") == 1, 0))

    counted = {(bytes(r["g"]), 0): (r["n"] * r["size"], r["n"] * r["tokens"], r["n"]) for r in heavy if cut[bytes(r["g"])] == 1}
    for r in rows.where("pieces > 1").groupBy("g", "piece").agg(F.sum("size").alias("b"), F.sum("tokens").alias("w"), F.count(F.lit(1)).alias("n")).collect():
        counted[bytes(r["g"]), r["piece"]] = (r["b"], r["w"], r["n"])
    names = list(counted)
    vectors = np.array([counted[x] for x in names], float).reshape(-1, 3) / even
    residual = np.ones((shards, 3))
    order = in_order(vectors, names)
    chosen = place(vectors[order], residual)
    placed = F.broadcast(spark.createDataFrame([(bytearray(names[i][0]), names[i][1], int(b)) for i, b in zip(order, chosen, strict=True)], "g binary, piece int, shard int"))
    heavy_rows = rows.where("pieces is not null").join(placed, ["g", "piece"]).drop("pieces", "piece")

    left = np.maximum(residual, 0)
    left = np.divide(left, left.sum(axis=0), out=np.full_like(left, 1 / shards), where=left.sum(axis=0) > 0)
    buckets = max(1, math.ceil((total[3] - len(heavy)) / bucket_groups))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        n = part["n"].to_numpy(float)
        v = np.stack([n * part["size"].to_numpy(float), n * part["tokens"].to_numpy(float), n], axis=1)
        whole = np.maximum(v.sum(axis=0), 1)
        v = v / whole
        order = in_order(v, [bytes(g) for g in part["g"]])
        bins = place(v[order], left.copy())
        return pd.DataFrame({"g": part["g"].to_numpy()[order], "shard": bins})

    light = groups.where(F.col("share") <= heavy_share).select("g", "n", "size", "tokens", F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("bucket"))
    light = light.groupBy("bucket").applyInPandas(pack, "g binary, shard int")
    light_rows = rows.where("pieces is null").drop("pieces", "piece").join(light, "g")
    both = written(heavy_rows.unionByName(light_rows), "assigned")

    parts = max(1, math.ceil(total[2] / (bucket_groups * 4)))
    both = both.withColumn("part", F.pmod(F.xxhash64("k", "g", "salt"), F.lit(parts)))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = both.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    slot = F.row_number().over(Window.partitionBy("shard", "part").orderBy("k", "g")) - 1
    both = both.withColumn("at", slot).join(starts, ["shard", "part"])
    return both.select(F.col("k").alias(key), "size", "tokens", "text_crc32", F.col("g").alias("text_sha"), "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, key: str = "doc_id", text: str = "text", files: int = 1) -> None:
    """The rows of docs in folders shard=0, shard=1, ..., each in the given number of files.

    Rows that repeat both key and text are written once for each.
    """
    at = assign(docs, shards, key, text).groupBy(F.col(key).alias("_k"), F.col("text_sha").alias("_g")).agg(F.min("shard").alias("shard"))
    own = docs.withColumn("_g", F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)))
    out = own.join(at, own[key].eqNullSafe(F.col("_k")) & (own["_g"] == at["_g"])).drop("_k", "_g")
    out.repartition(shards * files, "shard", F.pmod(F.xxhash64(key), F.lit(files))).write.partitionBy("shard").parquet(path)


def digests(docs: DataFrame) -> DataFrame:
    """The law is ``bytes``: sizes of the shards are near equal."""
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
