"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, written


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id reached) of each id in links of columns a and b.

    Each round takes the least component of the neighbours and then that one's own component, until
    nothing changes; each round's table is written, and the one before removed. Links of an id to itself
    keep it as its own component; nulls are left out. Ids with many links, and large components, stand on
    the side of a join that adaptive execution splits; the other side has a row for each id.
    """
    links = links.where("a is not null and b is not null").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    found = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "components")
    while True:
        near = both.join(found.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        step = found.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        step, before = written(step, "step"), found
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("next"))
        found = written(step.join(jump, "component", "left").select("id", "old", F.least("component", "next").alias("component")), "components")
        dropped(step, before)
        if not found.where("component <> old").limit(1).count():
            dropped(both)
            return found.select("id", "component")
        path = found.scratch
        found = found.select("id", "component")
        found.scratch = path
