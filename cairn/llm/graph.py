"""Connected components of a link table, without any node's links meeting in one task's memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cairn.llm.common import Scratch


def _written(edges: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, tuple]:
    """The edges as a table, and what tells two sets of them apart."""
    seen = Observation()
    out = scratch.write(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")), name)
    return out, (seen.get["n"], seen.get["h"])


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of every node of links (u, v); a component is named by its smallest id.

    Large-star and small-star steps (Kiveris et al. 2014) in turn until the edges are stars. A hub's minimum is taken by
    map-side sums and joined back from a table, so that a join on the hub's key can be split; in small-star steps a node
    has no more rows than it has smaller neighbours.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges, state = _written(edges, scratch, f"{name}-0")
    step = 0
    while state[0]:
        step += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.write(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"{name}-{step}-low")
        large = both.join(low, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges, now = _written(after, scratch, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-{step}-low")
        if now == state:
            break
        state = now
    centres = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(centres)
