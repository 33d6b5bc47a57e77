"""Links of near vectors: an exact metric range join by pivots.

Cosine of at least c means a distance of at most e = sqrt(2 - 2c) between unit vectors. Drawn pivots
partition the vectors of a label: each is at home in the cell of its nearest pivot. If x, at home with
q, is within e of y, whose nearest pivot is p, then d(y, q) <= d(x, y) + d(x, q) <= e + d(x, p) <= 2e +
d(y, p), and d(y, q) <= e + radius of q; y is copied to every cell q that meets both. So each cell has
all neighbours of those at home in it. A cell that is still large is split again, by pivots of its own,
unless that wouldn't halve its comparisons. Cells are joined independently, the vectors at home in
chunks of bounded size past which the cell's vectors stream; cosines are computed in double precision.
Equal vectors are one row there, with their number.

Pivots travel with the rows they are for, before them in the stream, so none are gathered or broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import dropped, ship, written

#: Rows that a cell is meant to have, pivots of a cell at most, rows of a stream, and vectors at home in a chunk.
CELL, FAN, STREAM, CHUNK = 2048, 64, 20_000, 2048
#: Added to distances against rounding, and to the names of parts that aren't split any more.
SLACK, LEAF = 1e-6, "!"


def usable(vector: str):
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(raw: np.ndarray) -> np.ndarray:
    big = np.abs(raw).max(axis=1, keepdims=True)
    x = raw / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def join_block(home: np.ndarray, other: np.ndarray, ids: np.ndarray, others: np.ndarray, weights: np.ndarray, least: float) -> pd.DataFrame:
    """id, links, root of unit vectors: neighbours of each home row among others, by weight, and the least id of its part here."""
    a, b = np.nonzero(home @ other.T >= least)
    apart = ids[a] != others[b]
    a, b = a[apart], b[apart]
    links = np.bincount(a, weights[b], len(ids)).astype(np.int64)
    names, at = np.unique(np.concatenate([ids[a], others[b]]), return_inverse=True)
    p, q = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while len(p):
        low = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    linked, moved = np.flatnonzero(links), np.flatnonzero(names[root] != names)
    return pd.DataFrame({"id": np.concatenate([ids[linked], names[moved]]), "links": np.concatenate([links[linked], np.zeros(len(moved), np.int64)]), "root": np.concatenate([ids[linked], names[root][moved]])})


def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = pa.array([v.values.to_numpy().tobytes() for v in b.column(3)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), raw], names=["id", "n", "part", "v"])


def sizes(spread: DataFrame) -> DataFrame:
    """part, rows, homes."""
    return spread.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.count_if("home").alias("homes"))


def matrix(vectors: list[bytes]) -> np.ndarray:
    return unit(np.frombuffer(b"".join(vectors)).reshape(len(vectors), -1))


def split(spread: DataFrame, wide: DataFrame, level: int, reach: float) -> DataFrame:
    """spread with the wide parts in cells of their own, or as leaves where cells wouldn't halve the comparisons."""
    spark = spread.sparkSession
    want = F.least(F.lit(FAN), F.ceil(1.5 * F.col("rows") / CELL)) + 8
    draw = F.pmod(F.xxhash64(F.lit("pivot"), F.lit(level), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    body = spread.join(wide, "part")
    pivots = body.where(draw < want / F.col("rows")).groupBy("part").agg(F.slice(F.collect_list("v"), 1, 2 * FAN + 16).alias("pivots"))
    pivots = written(pivots.join(wide.select("part", F.ceil(F.col("rows") / STREAM).cast("int").alias("streams")), "part"), "pivots")
    lead = pivots.select("part", F.explode(F.sequence(F.lit(0), F.col("streams") - 1)).alias("stream"), "pivots")
    body = spread.join(pivots.select("part", "streams"), "part").withColumn("stream", F.pmod(F.xxhash64("id"), F.col("streams")).cast("int")).drop("streams")
    rows = lead.unionByName(body, allowMissingColumns=True).select("part", "stream", "pivots", "id", "n", "v", "home")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part", "stream").sortWithinPartitions("part", "stream", F.col("id").asc_nulls_first())

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, None
        for b in batches:
            names = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            ids, start = b.column(3).to_pylist(), 0
            for stop in [i for i in range(1, len(ids) + 1) if i == len(ids) or ids[i] is None]:
                if ids[start] is None:
                    held, own, start = names[start], matrix(b.column(2)[start].as_py()), start + 1
                if start == stop:
                    continue
                assert names[start] == names[stop - 1] == held
                part = b.slice(start, stop - start)
                d = np.sqrt(np.maximum(0, 2 - 2 * (matrix(part.column(5).to_pylist()) @ own.T)))
                at = d.argmin(axis=1)
                ok = d <= d.min(axis=1, keepdims=True) + 2 * reach
                ok[np.arange(len(d)), at] = True
                i, q = np.nonzero(ok)
                got = part.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([got.column(0), got.column(3), got.column(4), got.column(5), got.column(6), pa.array(q.astype(np.int32)), pa.array(d[i, q]), pa.array(at[i] == q)], names=["part", "id", "n", "v", "home", "cell", "d", "nearest"])
                start = stop

    cells = written(rows.mapInArrow(near, "part string, id long, n long, v binary, home boolean, cell int, d double, nearest boolean"), "cells")
    radii = cells.where("home and nearest").groupBy("part", "cell").agg(F.max("d").alias("radius"))
    at_home = F.col("home") & F.col("nearest")
    made = cells.join(radii, ["part", "cell"]).where(at_home | (F.col("d") <= F.col("radius") + reach))
    made = written(made.select("id", "n", F.col("part").alias("parent"), F.concat_ws(".", "part", F.col("cell").cast("string")).alias("part"), "v", at_home.alias("home")), "made")
    work = F.sum(F.col("rows") * F.col("homes").cast("double"))
    after = made.groupBy("parent", "part").agg(F.count(F.lit(1)).alias("rows"), F.count_if("home").alias("homes")).groupBy("parent").agg(work.alias("work"))
    better = written(after.join(wide.withColumnRenamed("part", "parent"), "parent").where(F.col("work") <= 0.5 * F.col("rows") * F.col("homes").cast("double")).select(F.col("parent").alias("part")), "better")
    names = ["id", "n", "part", "v", "home"]
    whole = spread.join(better, "part", "left_anti").join(wide.select("part", F.lit(LEAF).alias("leaf")), "part", "left")
    whole = whole.withColumn("part", F.concat("part", F.coalesce("leaf", F.lit(""))))
    out = made.join(better.withColumnRenamed("part", "parent"), "parent", "left_semi").select(names).unionByName(whole.select(names))
    out = written(out, "spread")
    dropped(cells, made, pivots, wide, better)
    return out


def joined(spread: DataFrame, least: float) -> DataFrame:
    """id, links, root: of each part the neighbours of those at home, by number, and ids joined to the least they are linked with."""
    spark = spread.sparkSession
    chunks = sizes(spread).select("part", F.ceil(F.col("homes") / CHUNK).cast("int").alias("chunks")).where("chunks > 0")
    rows = spread.join(chunks, "part")
    lead = rows.where("home").select("part", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), F.lit(0).alias("side"), "id", "n", "v")
    rest = rows.select("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("side"), "id", "n", "v")
    both = lead.unionByName(rest).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part", "chunk").sortWithinPartitions("part", "chunk", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, vectors, home = None, [], [], None
        for b in batches:
            names = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for start, stop in zip(edges, edges[1:], strict=False):
                part, chunk, side = names[start]
                own, v = b.column(3).slice(start, stop - start).to_numpy(), b.column(5).slice(start, stop - start).to_pylist()
                if (part, chunk) != group:
                    group, ids, vectors, home = (part, chunk), [], [], None
                if side == 0:
                    ids.append(own)
                    vectors += v
                elif vectors or home is not None:
                    if home is None:
                        ids, home, vectors = np.concatenate(ids), matrix(vectors), []
                    got = join_block(home, matrix(v), ids, own, b.column(4).slice(start, stop - start).to_numpy(), least)
                    yield pa.RecordBatch.from_pandas(got, preserve_index=False)

    return both.mapInArrow(run, "id long, links long, root long")


def near_links(vectors: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, n_links, component_id, kept of every vector, over links of equal labels and cosine >= least.

    n_links: other vectors linked directly; component_id: the least key reachable; kept: key is its own
    component_id. A vector that is null, zero, empty or holds a null, NaN or infinite component, or
    whose label or key is null, links with nothing and is kept. Vectors of unlike lengths don't link.
    Rows that repeat key, label and vector are one vector and one row; rows that share a key alone are
    a row each. No rows give no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v")).distinct()
    rows = rows.withColumn("ok", usable("v") & F.col("label").isNotNull() & F.col("id").isNotNull())
    rows = written(rows.withColumn("part", F.concat_ws("/", "label", F.size("v").cast("string"))).withColumn("same", F.sha2(F.concat_ws(",", "part", F.col("v").cast("array<string>")), 256)), "vectors")
    good = rows.where("ok")
    alike = written(good.groupBy("same").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("part").alias("part"), F.first("v").alias("v")), "alike")

    reach = math.sqrt(max(0.0, 2 - 2 * least)) + SLACK
    spread = written(alike.select("id", "n", "part", "v").mapInArrow(as_bytes, "id long, n long, part string, v binary").withColumn("home", F.lit(True)), "spread")
    level = 0
    while (wide := sizes(spread).where((F.col("rows") > CELL) & ~F.col("part").endswith(LEAF))).limit(1).count():
        before, spread = spread, split(spread, written(wide, "wide"), level, reach)
        dropped(before)
        level += 1
    found = written(joined(spread, least), "found")
    dropped(spread)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    result = alike.select("same", "id", "n").join(links, "id", "left").join(parts, "id", "left")
    result = result.select("same", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = good.select("id", "same").join(result, "same").select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
