"""Sharding by sampled splitters, with DataFrame functions only.

Law: `bytes`, shards of near-equal size. The range key is a hash of the text, so equal texts lie side by side and
share a range. A sample of keys, drawn with probability in proportion to a row's share of bytes and rows, gives
quantile boundaries of many small ranges; each range is then measured exactly, ranges that are overfull (one large
group of equal texts) are subdivided by a number that every row has of its own, and runs of ranges make the shards.
Nothing sorts or counts a whole shard in one task: slots come from a rank within a chunk of a range and the exact
offsets of chunk and range.

Defined cases: a null text has size 1 and the crc32 of the empty text; ids of any type, equal rows and repeated or null
ids each get a slot of their own, and any number of them is split like other rows; an empty table gives no rows. Texts
are read once; what moves afterwards is about 48 bytes a row.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, read_table

RANGES_PER_SHARD = 48
SAMPLE_ROWS = 40_000
CHUNK_ROWS = 1_000_000
SEED = 8


def _range_of(key: str, bounds: Iterable[int]):
    """The number of boundaries that are at most key, by a two-level search over the sorted boundaries."""
    bounds = list(bounds)
    step = 24
    heads = F.array(*[F.lit(b) for b in bounds[::step]]) if bounds else None
    if heads is None:
        return F.lit(0)
    groups = F.array(*[F.array(*[F.lit(b) for b in bounds[i : i + step]]) for i in range(0, len(bounds), step)])
    g = F.size(F.filter(heads, lambda b: b <= F.col(key)))
    return F.when(g == 0, F.lit(0)).otherwise((g - 1) * step + F.size(F.filter(F.element_at(groups, F.greatest(g, F.lit(1))), lambda b: b <= F.col(key))))


def shard(docs: DataFrame, n_shards: int = 8, ranges_per_shard: int = RANGES_PER_SHARD, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    text = F.coalesce(F.col("text"), F.lit(""))
    # the row's number is written with its key, and so stays with its row whatever is computed again
    keys = scratch.write(
        docs.select("doc_id", F.monotonically_increasing_id().alias("row"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.lit(seed)).alias("key")),
        "keys",
    )
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).head()
    parts = n_shards * ranges_per_shard
    # a row's weight: its share of the bytes and of the rows, half each, so that neither can fill a range unseen
    weight = F.col("size") / F.lit(2.0 * max(total, 1)) + F.lit(0.5 / max(rows, 1))
    draw = F.pmod(F.xxhash64("row", "key", F.lit(seed + 1)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sampled = keys.filter(draw < weight * sample_rows)
    quantiles = [i / parts for i in range(1, parts)]
    bounds = sorted(set(sampled.agg(F.percentile_approx("key", quantiles, 20 * parts)).head()[0] or []))
    # a boundary also opens right behind each key that the quantiles hit, which leaves a large group alone in its range
    bounds = sorted({b for b in bounds} | {b + 1 for b in bounds if b < (1 << 63) - 1})
    ranged = keys.withColumn("range", _range_of("key", bounds))
    measured = {r["range"]: (r["n"], r["b"]) for r in ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    # overfull ranges: subdivided by quantiles of the row number, from a mergeable sketch and so without gathering a group
    over = {k: max(n * parts // max(rows, 1), b * parts // max(total, 1)) + 1 for k, (n, b) in measured.items() if n * parts > 2 * rows or b * parts > 2 * total}
    ranged = ranged.withColumn("sub", F.lit(0))
    if over:
        cuts = {}
        for r in ranged.filter(F.col("range").isin(list(over))).groupBy("range").agg(F.percentile_approx("row", [i / parts for i in range(1, parts)], 20 * parts).alias("q")).collect():
            q, want = sorted(set(r["q"] or [])), min(parts, over[r["range"]])
            cuts[r["range"]] = q[:: max(1, len(q) // want)]
        sub = F.lit(0)
        for k, q in cuts.items():
            sub = F.when(F.col("range") == k, _range_of("row", q)).otherwise(sub)
        ranged = ranged.withColumn("sub", F.coalesce(sub, F.lit(0)))
    ranged = ranged.withColumn("part", F.struct("range", "sub"))
    counted = sorted(ranged.groupBy("range", "sub").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect())
    # runs of ranges: a range goes where the middle of its bytes falls, and the shards stay in key order
    before, slots, placed = 0, [0] * n_shards, []
    edges = [total * (i + 1) / n_shards for i in range(n_shards - 1)]
    for r in counted:
        s = bisect_right(edges, before + r["b"] / 2)
        placed.append((r["range"], r["sub"], s, slots[s], -(-r["n"] // CHUNK_ROWS)))
        before += r["b"]
        slots[s] += r["n"]
    # one row for each range: at most a few times parts, whatever the input's size
    where = spark.createDataFrame(placed, "range int, sub int, shard int, slot0 long, chunks long")
    dealt = ranged.join(F.broadcast(where), ["range", "sub"]).withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(seed + 2)), F.col("chunks")))
    # a range is ranked in chunks, which start where the chunks before them end
    ends = dealt.groupBy("range", "sub", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("range", "sub").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("range", "sub", "chunk", F.coalesce(before, F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("range", "sub", "chunk").orderBy("key", "row")).cast("long")
    ranked = dealt.withColumn("rank", rank).join(ends, ["range", "sub", "chunk"])
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("base") + F.col("rank") - 1).cast("long").alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law `bytes`; see the module for the defined cases."""
    out = shard(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_sharding": op8_sharding}
ORACLES: dict[str, str] = {}
