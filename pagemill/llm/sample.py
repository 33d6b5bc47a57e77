"""Bounded samples of labelled rows for training: bounded in rows of each class and in bytes.

First the candidates' lengths come to the driver, drawn by a threshold on a hash, so their number is
bounded; in the order of the hash they are taken while rows and bytes allow. Only then are the texts of
those taken fetched, whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(counts: dict, most: int | dict) -> tuple[dict, dict]:
    """For each class the rows wanted and the share to draw, with a margin for the spread of the draw."""
    bound = {c: most[c] if isinstance(most, dict) else most for c in counts}
    return bound, {c: min(1.0, (1.1 * bound[c] + 20) / n) for c, n in counts.items()}


def counted(rows: DataFrame, label: str, classes: int = 2000) -> dict:
    found = rows.groupBy(label).count().limit(classes + 1).collect()
    if len(found) > classes:
        raise ValueError(f"over {classes} classes")
    return {r[label]: r["count"] for r in found}


def chosen(got: list[tuple], bound: dict, most_bytes: int) -> list[tuple]:
    """Of (draw, name, class, bytes) in order: while its class has rows and its equal share of bytes left.

    A text that its class's bytes can't hold any more is passed over; shorter ones may still follow.
    """
    out, n, used = [], dict.fromkeys(bound, 0), dict.fromkeys(bound, 0)
    for x in sorted(got):
        c, size = x[2], x[3]
        if n[c] < bound[c] and used[c] + size <= most_bytes // len(bound):
            n[c] += 1
            used[c] += size
            out.append(x)
    return out


def drawn(*columns) -> Column:
    """A number from 0 to 1 by a hash."""
    return F.pmod(F.xxhash64(F.lit("sample"), *columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def by_class(rows: DataFrame, label: str, key: str, text: str, most: int | dict, most_bytes: int, classes: int = 2000) -> list[tuple]:
    """(label, text) of ``most`` rows of each class at most (or of a class's own number), by a hash of key and text.

    All texts together have ``most_bytes`` at most, an equal share for each class. The classes are
    counted over all rows; over ``classes`` of them are refused with ValueError. Rows are drawn by a
    threshold on the hash, so no task sees more than its part of the sample. Rows that repeat key, text
    and label are drawn once; a row that is there very often may leave its class with few.
    """
    counts = counted(rows, label, classes)
    if not counts:
        return []
    bound, share = bounds(counts, most)
    share = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))
    near = rows.select(label, text, drawn(key, text).alias("draw")).where(F.col("draw") < F.try_element_at(share, F.col(label)))
    sizes = near.select(label, "draw", F.octet_length(text).alias("n"), F.xxhash64(text).alias("h")).distinct()
    taken = chosen([(r["draw"], r["h"], r[label], r["n"]) for r in sizes.collect()], bound, most_bytes)
    if not taken:
        return []
    wanted = rows.sparkSession.createDataFrame([(d, h, c) for d, h, c, _ in taken], f"own_draw double, own_h long, own_label {rows.schema[label].dataType.simpleString()}")
    met = (F.col("draw") == F.col("own_draw")) & (F.xxhash64(text) == F.col("own_h")) & (F.col(label) == F.col("own_label"))
    got = near.join(F.broadcast(wanted), met, "left_semi").distinct().collect()
    return [(c, t) for _, t, c in sorted((r["draw"], r[text], r[label]) for r in got)]


def of_keys(docs: DataFrame, marks: DataFrame, label: str, key: str, text: str, most: dict, most_bytes: int) -> tuple[list[tuple], dict]:
    """(label, text) as by_class, where the labels are in a table of their own, one for a key; and their numbers.

    Labels meet the keys of docs alone; the sample's keys, which are bounded, are broadcast to fetch the
    texts, so no text is shuffled but the sample's. Of texts with one key the least of the shortest is taken.
    """
    met = docs.where(F.col(text).isNotNull()).select(key).distinct().join(marks, key).select(key, label)
    counts = counted(met, label)
    if not counts:
        return [], counts
    bound, share = bounds(counts, most)
    share = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))
    keys = met.withColumn("draw", drawn(key)).where(F.col("draw") < F.try_element_at(share, F.col(label))).collect()
    kinds = f"`{key}` {docs.schema[key].dataType.simpleString()}, draw double, `{label}` int"
    rows = docs.select(key, text).where(F.col(text).isNotNull())

    def of(some: list[tuple]) -> DataFrame:
        return rows.join(F.broadcast(docs.sparkSession.createDataFrame(some, kinds)), key).groupBy(key, "draw", label)

    sizes = of([(r[key], r["draw"], r[label]) for r in keys]).agg(F.min(F.octet_length(text)).alias("n")).collect()
    taken = chosen([(r["draw"], r[key], r[label], r["n"]) for r in sizes], bound, most_bytes)
    if not taken:
        return [], counts
    got = of([(k, d, c) for d, k, c, _ in taken]).agg(F.min(F.struct(F.octet_length(text).alias("n"), F.col(text).alias("t")))["t"].alias(text)).collect()
    return [(c, t) for _, t, c in sorted((r["draw"], r[text], r[label]) for r in got)], counts
