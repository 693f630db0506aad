"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are range-partitioned by length into sections and packed into buckets of similar length. A first pass over each
dimension's longest buckets gives every query a lower bound of its k-th row. Queries are packed into blocks, and those into
groups that a task can hold; a group meets only the sections whose longest vector can still reach a query's bound, and
keeps its best rows while their buckets stream by, longest first, so that bounds rise. Within a bucket the bound and the
bucket's longest vector give a local cosine threshold, and each query prunes by it: a threshold above one ends the bucket,
a high one prunes by coordinate (the query's largest one confines the same coordinate of every vector within the angle)
where that leaves few vectors, else length prunes. What is left of a block and a bucket is one exact integer product.

Defined cases: vectors that are null or hold null or non-finite components take no part; a query meets vectors of
its own dimension only and never its own row number; empty vectors score 0; equal vectors and repeated ids are rows of
their own, ties go to the smaller id; null ids take no part; an empty table gives no rows. Components are read as
doubles, multiplied by 256 and rounded down; products that floats of 32 or 64 bits hold exactly use them, larger ones exact
integers, and a product beyond 64 bits counts as the largest or smallest such number.

Equal lengths are split by id, so no bucket or task grows with the number of equal vectors. Query blocks times
buckets is work that the contract asks for; what moves is each section once for a group and each group once for a section.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, read_table, small_batches

BUCKET = 1_024
QUERY_BLOCK = 1_024
SECTION_BUCKETS = 256  # at most, so a task's input is bounded
GROUP_BYTES = 32 << 20  # of a group's queries as 32-bit floats
CELLS = 64
PARTITIONS = 2_000
K = 5
SALTS = 16
SEEDS = 16  # buckets of each dimension that the first pass meets
COSINE = 0.6
SLACK = 1e-9
_FLOOR, _LAST = -(1 << 63), (1 << 63) - 1
_ROWS = "id long, x binary, q boolean, dim int, norm double"
_PACKED = "part int, bucket long, dim int, most double, ids binary, vectors binary"
_BOUNDED = "part int, block long, dim int, most double, ids binary, vectors binary, lows binary, least_norm double"
_CELLS = "cell long, is_bucket boolean, part int, no long, dim int, ids binary, vectors binary, lows binary"
_EXACT_32, _EXACT = float(1 << 24), float(1 << 53)


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector, q) as integer components, 16 bits each where those of the batch fit, with dimension and length."""
    for b in batches:
        vector = b.column(1)
        sizes = np.asarray(vector.value_lengths().fill_null(0)).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        flat = vector.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        odd = ~np.isfinite(flat)
        odds = np.concatenate([[0], np.cumsum(odd)])
        keep = np.asarray(vector.is_valid()) & (odds[at[1:]] == odds[at[:-1]])
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(np.where(odd, 0.0, flat) * 256), -float(1 << 63), float(1 << 63))
        norm, some = np.zeros(len(sizes)), sizes > 0
        if some.any():
            norm[some] = np.sqrt(np.add.reduceat(x * x, at[:-1][some]))
        x = x.astype(np.int16) if np.abs(x).max(initial=0) < 1 << 15 else x
        raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
        cols = [b.column(0), raw, b.column(2), pa.array(sizes.astype(np.int32)), pa.array(norm)]
        yield pa.RecordBatch.from_arrays(cols, names=_names(_ROWS)).filter(pa.array(keep))


def _packed(rows: DataFrame, parts: int, size: int) -> DataFrame:
    """Rows (id, x, dim, norm) as buckets of at most size vectors of one dimension, longest first within a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, no = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, xs, dims, norms = b.column(0).to_numpy(), b.column(1), b.column(2).to_numpy(), b.column(3).to_numpy()
            wide = np.asarray(pc.binary_length(xs)) != 2 * dims
            ends = np.append(np.flatnonzero(np.diff(dims)) + 1, len(dims))
            lo = 0
            while lo < len(dims):
                hi = int(min(lo + size, ends[np.searchsorted(ends, lo, side="right")]))
                if wide[lo:hi].any():
                    x = b"".join(np.frombuffer(v, np.float64 if w else np.int16).astype(np.float64).tobytes() for v, w in zip(xs[lo:hi].to_pylist(), wide[lo:hi], strict=True))
                else:
                    x = b"".join(xs[lo:hi].to_pylist())
                cols = [[here], [(here << 32) | no], [int(dims[lo])], [float(norms[lo:hi].max())], [ids[lo:hi].tobytes()], [x]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary()), strict=True)], names=_names(_PACKED))
                lo, no = hi, no + 1

    ordered = rows.repartitionByRange(parts, "dim", F.desc("norm"), "id").sortWithinPartitions("dim", F.desc("norm"), "id")
    return ordered.select("id", "x", "dim", "norm").mapInArrow(run, _PACKED)


class Vectors:
    """Packed vectors of one dimension, longest first, equal lengths by id."""

    def __init__(self, ids: bytes, vectors: bytes, dim: int):
        i = np.frombuffer(ids, dtype=np.int64)
        x = np.frombuffer(vectors, dtype=np.int16 if len(vectors) == 2 * dim * len(i) else np.float64).reshape(len(i), dim).astype(np.float64)
        norm = np.sqrt((x * x).sum(axis=1))
        order = np.lexsort((i, -norm))
        self.ids, self.norm, self.dim = i[order], norm[order], dim
        self.most = float(self.norm[0]) if len(i) else 0.0
        # 32-bit floats where they hold every component
        self.x = x[order].astype(np.float32 if self.most < _EXACT_32 else np.float64)


def _products(q: np.ndarray, v: np.ndarray, reach: float) -> np.ndarray:
    """Exact integer inner products (queries, vectors); reach: the largest product of their lengths. No sum of some of a
    product's terms is beyond it, so floats that hold it are exact in any order."""
    if reach < _EXACT_32 and q.dtype == v.dtype == np.float32:
        return q @ v.T
    if reach < _EXACT * (1 - SLACK):
        return q.astype(np.float64) @ v.T.astype(np.float64)
    as_ints = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return np.clip(as_ints(q) @ as_ints(v).T, _FLOOR, _LAST).astype(np.int64)


class Bucket(Vectors):
    """A bucket's vectors with what its local pruning needs, made when first used."""

    def __init__(self, ids: bytes, vectors: bytes, dim: int):
        super().__init__(ids, vectors, dim)
        self.least_id = int(self.ids.min())
        self._unit: np.ndarray | None = None
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of coordinate f of the unit vectors, ascending, and the order that sorts them."""
        if f not in self._lists:
            if self._unit is None:
                self._unit = self.x / np.maximum(self.norm, 1e-300)[:, None]
            order = np.argsort(self._unit[:, f], kind="stable")
            self._lists[f] = self._unit[order, f], order
        return self._lists[f]

    def within(self, f: np.ndarray, a: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of queries with largest coordinate f, a of the unit vector: from where to where the lists of f hold what is within
        the angle of cosine local."""
        local = np.minimum(local, 1.0)
        spread = np.sqrt((1 - local * local) * np.maximum(0.0, 1 - a * a)) + SLACK
        # beyond the angle's own reach every value on that side is allowed
        high = np.where(a >= local - SLACK, np.inf, a * local + spread)
        low = np.where(a <= -local + SLACK, -np.inf, a * local - spread)
        start, end = np.zeros(len(f), dtype=np.int64), np.zeros(len(f), dtype=np.int64)
        for c in np.unique(f).tolist():
            values, at = self.by_coordinate(c)[0], f == c
            start[at], end[at] = np.searchsorted(values, low[at], side="left"), np.searchsorted(values, high[at], side="right")
        return start, end


class Block(Vectors):
    """A block of queries with the best k rows met so far. A row counts where its score is above low, or is low with an id
    of at most low_id."""

    def __init__(self, ids: bytes, vectors: bytes, dim: int, k: int, lows: bytes | None = None):
        packed = np.frombuffer(ids, dtype=np.int64)
        super().__init__(ids, vectors, dim)
        n, self.k = len(packed), k
        self.low, self.low_id = np.full(n, _FLOOR), np.full(n, _LAST)
        if lows:
            self.low, self.low_id = np.frombuffer(lows, dtype=np.int64).reshape(2, n).copy()
        self.free, self.score, self.row = np.ones((n, k), dtype=bool), np.full((n, k), _FLOOR), np.full((n, k), _LAST)
        self.focus = np.abs(self.x).argmax(axis=1) if dim else np.zeros(n, dtype=np.int64)
        self.share = self.x[np.arange(n), self.focus] / np.maximum(self.norm, 1e-300) if dim else np.zeros(n)

    def least_norm(self) -> float:
        """No vector shorter than this counts for any of the queries."""
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where((self.low > 0) & (self.norm > 0), self.low / self.norm, 0.0)
        return float(need.min(initial=np.inf)) * (1 - SLACK)

    def add(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows (query's place, id, score) that may be among the best."""
        fine = (ids != self.ids[who]) & ((scores > self.low[who]) | (scores == self.low[who]) & (ids <= self.low_id[who]))
        if not fine.any():
            return
        u, inv = np.unique(who[fine], return_inverse=True)
        r = np.concatenate([np.repeat(np.arange(len(u)), self.k), inv])
        free = np.concatenate([self.free[u].ravel(), np.zeros(len(inv), dtype=bool)])
        i, s = np.concatenate([self.row[u].ravel(), ids[fine]]), np.concatenate([self.score[u].ravel(), scores[fine]])
        order = np.lexsort((i, ~s, free, r))  # ~s falls as s grows, and never overflows
        place = np.arange(len(r)) - np.searchsorted(r[order], np.arange(len(u)))[r[order]]
        best = order[place < self.k].reshape(len(u), self.k)
        self.free[u], self.row[u], self.score[u] = free[best], i[best], s[best]
        full = u[~self.free[u, -1]]
        self.low[full], self.low_id[full] = self.score[full, -1], self.row[full, -1]

    def meet(self, bucket: Bucket) -> None:
        reach, low = self.norm * bucket.most, self.low.astype(np.float64)
        alive = (low <= reach * (1 + SLACK)) | (low <= 0)
        if not alive.any():
            return
        local = np.divide(low, reach, out=np.zeros_like(low), where=reach > 0)
        sharp = np.flatnonzero(alive & (low > 0) & (local >= COSINE))
        if len(sharp) and self.most * bucket.most < _EXACT * (1 - SLACK):
            start, end = bucket.within(self.focus[sharp], self.share[sharp].astype(np.float64), local[sharp])
            few = np.flatnonzero((end - start) * 32 <= len(bucket.ids))  # else the whole product is cheaper
            alive[sharp[few]] = False
            n = (end - start)[few]
            if n.sum():
                who, at = np.repeat(sharp[few], n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[few], n)
                focus, rows = self.focus[who], np.empty(len(who), dtype=np.int64)
                for c in np.unique(focus).tolist():
                    rows[focus == c] = bucket.by_coordinate(c)[1][at[focus == c]]
                long = bucket.norm[rows] * self.norm[who] * (1 + SLACK) >= low[who]
                who, rows = who[long], rows[long]
                self.add(who, bucket.ids[rows], np.einsum("ij,ij->i", self.x[who].astype(np.float64), bucket.x[rows].astype(np.float64)).astype(np.int64))
        who = np.flatnonzero(alive)
        if not len(who):
            return
        # vectors too short for every query that is left are a bucket's end
        need = np.divide(low[who], self.norm[who], out=np.zeros(len(who)), where=(low[who] > 0) & (self.norm[who] > 0)).min()
        longest = int(np.searchsorted(-bucket.norm, -need * (1 - SLACK), side="right"))
        if not longest:
            return
        s = _products(self.x if len(who) == len(self.x) else self.x[who], bucket.x[:longest], self.most * bucket.most)
        best, low = s.max(axis=1), self.low[who].astype(s.dtype)
        hit = np.flatnonzero((best > low) | (best == low) & (self.low_id[who] >= bucket.least_id))
        if not len(hit):
            return
        s, who, low, ids = s[hit] if len(hit) < len(s) else s, who[hit], low[hit], bucket.ids[:longest]
        above = s >= low[:, None]
        if np.count_nonzero(above) > 16 * len(hit):
            # of a query without a bound yet, or of equal scores, only the best leave the bucket
            s = s.astype(np.int64)
            c = _tops(ids, s, self.ids[who], self.k)
            r = np.repeat(np.arange(len(c)), c.shape[1])
            c = c.ravel()
        else:
            r, c = _places(above)
        self.add(who[r], ids[c], s[r, c].astype(np.int64))


def _places(above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true values: eight are looked at at once."""
    if above.shape[1] % 8:
        return np.nonzero(above)
    words = np.flatnonzero(above.view(np.uint64))
    w, c = np.nonzero(above.reshape(-1, 8)[words])
    at = words[w] * 8 + c
    return at // above.shape[1], at % above.shape[1]


def _tops(ids: np.ndarray, scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k best scores, ties by id; a row's own id comes last."""
    n = len(ids)
    by_id = np.argsort(ids, kind="stable")
    if n <= k:
        return np.tile(np.arange(n), (len(scores), 1))
    if np.abs(scores.astype(np.float64)).max(initial=0) < float(1 << 62) / n:
        place = np.empty(n, dtype=np.int64)
        place[by_id] = np.arange(n)
        key = scores * n - place
        key[ids[None, :] == own[:, None]] = _FLOOR
        return np.argpartition(key, n - k, axis=1)[:, n - k :]
    return np.array([np.lexsort((ids, ~s, ids == i))[:k] for s, i in zip(scores, own, strict=True)])


def _met(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[list[Block]]:
    """The blocks of each cell, after they met its buckets. A cell's rows are its query blocks followed by its buckets."""
    cell, blocks = None, {}
    for b in batches:
        for i in range(b.num_rows):
            here, is_bucket, part, no, dim, ids, vectors, lows = (b.column(c)[i].as_py() for c in _names(_CELLS))
            if here != cell:
                yield [x for same in blocks.values() for x in same]
                cell, blocks = here, {}
            if is_bucket:
                bucket = Bucket(ids, vectors, dim)
                for block in blocks.get(dim, []):
                    block.meet(bucket)
            else:
                blocks.setdefault(dim, []).append(Block(ids, vectors, dim, k, lows))
                blocks[dim][-1].name = part, no
    yield [x for same in blocks.values() for x in same]


def _bounded(cells: DataFrame, k: int) -> DataFrame:
    """Query blocks with their queries' k-th rows in the buckets of their cells as bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (x for blocks in _met(batches, k) for x in blocks):
            v = x.x.astype(np.int16) if np.abs(x.x).max(initial=0) < 1 << 15 else x.x.astype(np.float64)
            cols = [[x.name[0]], [x.name[1]], [x.dim], [x.most], [x.ids.tobytes()], [v.tobytes()], [np.stack([x.low, x.low_id]).tobytes()], [x.least_norm()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.float64()), strict=True)], names=_names(_BOUNDED))

    return cells.mapInArrow(run, _BOUNDED)


def _meet(cells: DataFrame, k: int) -> DataFrame:
    """The best k rows of each query in the buckets of each of its cells."""
    schema = "query_id long, vec_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (x for blocks in _met(batches, k) for x in blocks):
            who, at = np.nonzero(~x.free)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x.ids[who], x.row[who, at], x.score[who, at])], names=_names(schema))

    return cells.mapInArrow(run, schema)


def top_k(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row that is_query holds for."""
    spark = vectors.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "topk")
    x = F.col(vector_col) if vectors.schema[vector_col].dataType.simpleString() in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = scratch.write(rows.mapInArrow(_integers, _ROWS), "rows")
    n, query_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("q"), 4 * F.col("dim").cast("long"))), F.lit(0))).first()
    # a group's queries and a section's buckets don't grow with the table; a section is moved once for each group, and a group for each section
    groups = max(1, -(-query_bytes // GROUP_BYTES))
    n_buckets = max(1, -(-n // BUCKET))
    sections = -(-n_buckets // max(1, min(SECTION_BUCKETS, n_buckets * groups // CELLS)))
    buckets = scratch.write(_packed(rows, sections, BUCKET), "buckets")
    queries = scratch.write(_packed(rows.filter("q"), max(groups, min(CELLS, -(-query_bytes // (1 << 20)))), QUERY_BLOCK), "queries").withColumnRenamed("bucket", "block")
    scratch.drop("rows")
    # the first pass: each dimension's longest buckets
    longest = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("most"), "bucket"))
    first = buckets.select("dim", "bucket", "most").withColumn("at", longest).filter(F.col("at") <= min(SEEDS, -(-n_buckets // SEEDS)))
    seeds = buckets.join(first.select("bucket"), "bucket", "left_semi")
    salts = SALTS * groups  # few dimensions are no few tasks
    none, salted = F.lit(None).cast("binary"), lambda salt: (F.col("dim").cast("long") * salts + salt).alias("cell")
    cells = queries.select(salted(F.pmod(F.xxhash64("block"), F.lit(salts))), F.lit(False).alias("is_bucket"), "part", F.col("block").alias("no"), "dim", "ids", "vectors", none.alias("lows"))
    cells = cells.union(seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(salted(F.col("salt")), F.lit(True), "part", "bucket", "dim", "ids", "vectors", none))
    cells = cells.repartitionById(salts, F.pmod("cell", F.lit(salts)).cast("int")).sortWithinPartitions("cell", "is_bucket", "no")
    bounded = scratch.write(_bounded(cells, k), "bounded")
    parts = bounded.agg(F.max("part")).first()[0] or 0
    blocks = bounded.withColumn("group", F.floor(F.col("part") * groups / (parts + 1)).cast("int"))
    # a group meets the sections whose longest vector reaches the least bound of its queries, and of these the buckets that do
    asks = blocks.groupBy("group", "dim").agg(F.min("least_norm").alias("least"))
    reach = buckets.groupBy(F.col("part").alias("section"), "dim").agg(F.max("most").alias("section_most"))
    near = lambda most, least: F.col(most) * (1 + SLACK) >= F.col(least)
    cell = (F.col("group").cast("long") * sections + F.col("section")).alias("cell")
    asking = blocks.join(F.broadcast(reach), "dim").filter(near("section_most", "least_norm"))
    asked = buckets.withColumnRenamed("part", "section").join(F.broadcast(asks), "dim").filter(near("most", "least"))
    cells = asking.select(cell, F.lit(False).alias("is_bucket"), "part", F.col("block").alias("no"), "dim", "ids", "vectors", "lows").union(
        asked.select(cell, F.lit(True), "section", "bucket", "dim", "ids", "vectors", none)
    )
    tasks = min(PARTITIONS, groups * sections)
    cells = cells.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int")).sortWithinPartitions("cell", "is_bucket", "no")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return _meet(cells, k).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of each query (vec_id divisible by 50); see the module for the defined cases."""
    return top_k(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


QUERIES = {"op7_topk": op7_topk}
ORACLES = {
    "op7_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(generate_series(1, len(q.x)), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""
}
