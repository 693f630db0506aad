"""Near-duplicates: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

1. Document frequencies of five-word shingles, over all documents, in a sketch of SKETCH_ROWS rows of SKETCH counters: what
   a counter holds beyond its row's mean load, the least of the rows. The load's spread falls against N as the corpus
   grows, so the estimates get better with size. A shingle's weight is (1 + ln tf) * (1 + IDF * ln(1 + N / df) / ln(1 + N)):
   between 1 + IDF for a shingle of one document and nearly 1 for one of all documents, at every N.
2. One pass signs each text: improved consistent weighted sampling (Ioffe 2010) of its shingles by the weight that
   decides in 4, BANDS bands of ROWS samples, so that two texts share a sample as often as they are similar. A shingle's
   random numbers come from fixed tables by hash, a place of 2^DRAW_BITS and a fraction of it, and ties go to the smaller
   shingle, so equal weights give equal samples everywhere.
3. Exact copies (two 64-bit hashes of the text) are one node from here on: the copy with the smallest id.
4. Nodes that share a band's key and a level of total weight are a bucket; each is compared with the bucket's smallest
   id. The similarity is the weighted Jaccard similarity; 0.8 or more makes a link.
5. What that leaves open is settled exactly. Nodes of a bucket with several components list their prefix: their rarest
   shingles, up to 1 - 0.8 of their weight. Two texts of similarity 0.8 have their rarest common shingle in both prefixes,
   and within the first ninth of the lighter text's weight, as all they share lies behind it; so nodes of different
   components that share such a shingle are compared, if their weights and what lies behind it allow the similarity. Where
   more than PAIRED nodes share it (large groups of nearly equal texts) they are compared with the node that has least of
   its own before it, the cleanest copy. What is still of several components is settled in packed blocks: a task gets two,
   discards pairs by a bound from one matrix product, and returns a link of each node to each component.
6. Components of the links are the classes, named by their smallest id.

Defined cases: a null text counts as empty; texts without words are alike only if they are equal; texts of one to four
words have one shingle; rows of one id are one document and stay or go together, and a null id follows the copies of
its text (the pipeline's stage tells rows apart by a key of its own); an empty table gives no rows; other columns are not read. Texts are read whole, two times, and move once: those
with candidates, by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, read_table, small_batches
from cairn.llm.graph import components
from cairn.llm.textnum import _BASE, WORD, Texts, blocks, mix, ragged, raw_texts, stream, text_map, uniform

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
SKETCH_ROWS, SKETCH, SLAB_SIZE = 2, 1 << 19, 1 << 13
IDF = 0.5
PAIRED = 32
BLOCK_NODES, BLOCK_BYTES = 128, 4 << 20
SLAB = 4_096
SEED = 2
DRAW_BITS = 13  # texts with more shingles have equal draws among them: ties, which are broken the same way everywhere
_U = np.uint64
_LOW48 = _U((1 << 48) - 1)
_TF = np.log(1 + np.log(np.maximum(np.arange(1 << 16), 1))).astype(np.float32)  # ln of the tf part; counts beyond are computed
_random: list[tuple] = []


def shingles(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, 48-bit shingle and count, by text and shingle."""
    s, e, doc = t.spans(WORD)
    h = t.hashes(s, e)
    mult = stream(31, WIDTH) | _U(1)
    m = len(h) - WIDTH + 1
    parts, owners = [], []
    if m > 0:
        key = np.zeros(m, dtype=np.uint64)
        for k in range(WIDTH):
            key += h[k : k + m] * mult[k]
        at = np.flatnonzero(doc[:m] == doc[WIDTH - 1 :])
        parts.append(key[at])
        owners.append(doc[at])
    n = np.bincount(doc, minlength=t.n)
    first = np.cumsum(n) - n
    for size in range(1, WIDTH):  # short texts: one shingle of all words
        few = np.flatnonzero(n == size)
        if len(few):
            parts.append(sum(h[first[few] + k] * mult[k] for k in range(size)) + stream(41 + size, 1))
            owners.append(few)
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none
    both = (np.concatenate(owners).astype(np.uint64) << _U(48)) | (mix(np.concatenate(parts)) >> _U(16))
    both, count = np.unique(both, return_counts=True)
    return (both >> _U(48)).astype(np.int64), both & _LOW48, count


def _places(shingle: np.ndarray) -> list[np.ndarray]:
    """The shingles' counters in each row of the sketch."""
    m = mix(shingle)
    return [((m >> _U(32 * i)) & _U(SKETCH - 1)).astype(np.int64) for i in range(SKETCH_ROWS)]


def ln_tf(count: np.ndarray) -> np.ndarray:
    out = _TF[np.minimum(count, len(_TF) - 1)]
    more = count >= len(_TF)
    if more.any():
        out[more] = np.log(1 + np.log(count[more])).astype(np.float32)
    return out


def _packed(counts: np.ndarray) -> bytes:
    """Counters in as few bytes each as the largest needs, with that number before them."""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max()) < 1 << (8 * w - 1))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype(np.int64)


def frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """The sketch of document frequencies (SKETCH_ROWS, SKETCH) and the number of texts with shingles.

    Tasks send packed slabs of counters, which are summed slab by slab as they come in."""
    slabs = SKETCH // SLAB_SIZE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, texts = np.zeros((SKETCH_ROWS, SKETCH), dtype=np.int64), 0
        for b in batches:
            for _, _, t in blocks(b.column(0)):
                doc, sh, _ = shingles(t)
                for row, place in zip(sketch, _places(sh), strict=True):
                    row += np.bincount(place, minlength=SKETCH)
                texts += int((np.diff(doc, prepend=-1) > 0).sum())
        parts = sketch.reshape(SKETCH_ROWS * slabs, SLAB_SIZE)
        some = np.flatnonzero(parts.any(axis=1)).tolist()
        rows = [(i, _packed(parts[i])) for i in some] + [(-1, _packed(np.array([texts])))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["slab", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for slab, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[slab] = total.get(slab, 0) + _unpacked(raw.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_packed(c) for c in total.values()], pa.binary())], names=["slab", "counts"])

    schema = "slab int, counts binary"
    got = docs.select(text_col).mapInArrow(count, schema).repartition("slab").mapInArrow(add, schema).toArrow()
    sketch, n = np.zeros((SKETCH_ROWS * slabs, SLAB_SIZE), dtype=np.int64), 0
    for slab, raw in zip(got["slab"].to_pylist(), got["counts"].to_pylist(), strict=True):
        if slab < 0:
            n += int(_unpacked(raw)[0])
        else:
            sketch[slab] += _unpacked(raw)
    return sketch.reshape(SKETCH_ROWS, SKETCH), n


class Weights:
    """The idf part of the shingles' weights."""

    def __init__(self, sketch: np.ndarray, n: int, idf: float = IDF):
        load = (sketch.sum(axis=1, keepdims=True) - sketch) / (SKETCH - 1)
        df = np.clip(sketch - load, 1, max(n, 1))
        # logarithms come from the driver's table, so that they are the same in every task
        self.table = np.log(1 + idf * np.log1p(max(n, 1) / df) / np.log1p(max(n, 1))).astype(np.float32)

    def ln(self, shingle: np.ndarray) -> np.ndarray:
        """Of the rows' estimates the least frequency counts, which is the largest weight."""
        out, *rest = (row[p] for row, p in zip(self.table, _places(shingle), strict=True))
        for x in rest:
            out = np.maximum(out, x)
        return out

    def of(self, shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.exp((ln_tf(count) + self.ln(shingle)).astype(np.float64))


def _draws() -> list[tuple]:
    """For each sample: hash multiplier, and by table place r ~ Gamma(2, 1), ln c with c ~ Gamma(2, 1), beta ~ U(0, 1)."""
    if not _random:
        for k in range(BANDS * ROWS):
            u = [uniform(stream(10_000 * SEED + 10 * k + i, 1 << DRAW_BITS)) for i in range(5)]
            r, c = -np.log(u[0] * u[1]), -np.log(u[2] * u[3])
            _random.append((stream(777 + k, 1)[0] | _U(1), r.astype(np.float32), np.log(c).astype(np.float32), u[4].astype(np.float32)))
    return _random


def signatures(t: Texts, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of the texts in a row, and their number by text (none for a text without words).

    Similar texts have similar total weights: their ratio is no less than the similarity. So each band's key is given
    twice, with the text's own level of weight and with the next; texts of linked weights share a level, and others
    that happen to share samples (of a common passage) mostly don't meet.
    """
    doc, sh, count = shingles(t)
    n_keys = np.zeros(t.n, dtype=np.int64)
    if not len(doc):
        return np.zeros(0, dtype=np.int64), n_keys
    weight = ln_tf(count) + weights.ln(sh)
    head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    size = np.diff(np.append(head, len(doc)))
    own = np.repeat(np.arange(len(head)), size)
    base = mix(sh)
    keys = np.empty((len(head), BANDS), dtype=np.uint64)
    for k, (mult, r_all, lc_all, beta_all) in enumerate(_draws()):
        place = ((base * mult) >> _U(64 - DRAW_BITS)).astype(np.int32)
        r, beta = r_all[place], beta_all[place]
        step = np.floor(weight / r + beta)
        rank = lc_all[place] - r * (step - beta + np.float32(1))
        least = np.minimum.reduceat(rank, head)
        at = np.flatnonzero(rank == least[own])
        at = at[np.append(True, own[at][1:] != own[at][:-1])]
        sample = mix(sh[at] * _BASE + (step[at].astype(np.int64) + (1 << 20)).astype(np.uint64) + (_U(k) << _U(40)))
        band = k // ROWS
        keys[:, band] = sample if k % ROWS == 0 else mix(keys[:, band] * _BASE + sample)
    total = np.add.reduceat(np.exp(weight.astype(np.float64)), head)
    level = np.floor(np.log(total) / (-np.log(SIMILARITY) * (1 + 1e-6))).astype(np.int64) + 1_000
    both = [mix(keys + (level + i).astype(np.uint64)[:, None] * _BASE) for i in (0, 1)]
    n_keys[doc[head]] = 2 * BANDS
    return np.concatenate(both, axis=1).ravel().astype(np.int64), n_keys


def similarities(a: Texts, b: Texts, weights: Weights) -> np.ndarray:
    """Weighted Jaccard similarity of the texts of two blocks, row by row."""
    out = []
    for t in (a, b):
        doc, sh, count = shingles(t)
        w = weights.of(sh, count)
        out.append(((doc.astype(np.uint64) << _U(48)) | sh, w, np.bincount(doc, w, minlength=t.n)))
    (ka, wa, ta), (kb, wb, tb) = out
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = np.bincount((ka[ia] >> _U(48)).astype(np.int64), np.minimum(wa[ia], wb[ib]), minlength=a.n)
    return both / np.maximum(ta + tb - both, 1e-12)


def verify(pairs: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """(id, pivot, sim) of pairs (id, pivot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, left in blocks(b.column(2)):
                for i, j, right in blocks(b.column(3).slice(lo, hi - lo)):
                    part = left if j - i == hi - lo else Texts(raw_texts(b.column(2).slice(lo + i, j - i)))
                    sim = similarities(part, right, weights)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo + i, j - i), b.column(1).slice(lo + i, j - i), pa.array(sim)], names=["id", "pivot", "sim"])

    texts = texts.select("id", "text")
    left = pairs.join(texts, "id").withColumnRenamed("text", "a")
    right = left.join(texts.select(F.col("id").alias("pivot"), F.col("text").alias("b")), "pivot")
    return right.select("id", "pivot", "a", "b").mapInArrow(run, "id long, pivot long, sim double")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "minhash")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    weights = Weights(*frequencies(rows))

    def sign(t: Texts) -> dict:
        keys, count = signatures(t, weights)
        return {"bands": ragged(keys, count)}

    hashed = rows.select("id", "text", F.xxhash64("text", F.lit(1)).alias("h1"), F.xxhash64("text", F.lit(2)).alias("h2"))
    signed = scratch.write(text_map(hashed, ["id", "h1", "h2"], "text", "bands array<long>", sign), "signed")
    first = scratch.write(signed.groupBy("h1", "h2").agg(F.min("id").alias("node")), "first")
    # the copies' map, and the bands of the first copies alone
    mapped = signed.join(first, ["h1", "h2"]).select("id", "node", F.when(F.col("id") == F.col("node"), F.col("bands")).alias("bands"))
    mapped = scratch.write(mapped, "mapped")
    scratch.drop("signed", "first")
    banded = mapped.filter("bands IS NOT NULL").select("id", F.explode("bands").alias("key"))
    pivots = banded.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("pivot < last").select("key", "pivot")
    pivots = scratch.write(pivots, "pivots")
    members = scratch.write(banded.join(pivots, "key").filter("id <> pivot").distinct(), "members")
    involved = members.select("id").unionByName(members.select(F.col("pivot").alias("id"))).distinct()
    texts = scratch.write(rows.join(mapped.filter("bands IS NOT NULL").select("id").join(involved, "id", "left_semi").hint("shuffle_hash"), "id"), "texts")
    known = _judged(members.select("id", "pivot").distinct(), texts, weights, scratch)
    # components of the first links tell what is settled already; later links only add to that
    label = scratch.write(components(_links(known, similarity), scratch, "graph-first"), "label-first")
    near, many, opened = _left_open(members, pivots, label, texts, weights, similarity, scratch)
    links = _links(known, similarity).unionByName(near)
    label = scratch.write(components(links, scratch, "graph-near"), "label-near")
    found = scratch.write(_settled(many, label, opened, weights, similarity), "found")
    if not found.isEmpty():
        label = scratch.write(components(links.unionByName(found), scratch, "graph"), "label")
    scratch.drop("pivots", "members", "texts", "judged", "open", "prefixes", "near", "found")
    return mapped.join(label.withColumnRenamed("id", "node"), "node", "left").select(F.col("id").alias(id_col), F.coalesce("component", "node").alias("class_id"))


def _judged(pairs: DataFrame, texts: DataFrame, weights: Weights, scratch: Scratch) -> DataFrame:
    """Pairs with their similarity; where rows repeat an id, the largest of its texts'."""
    return scratch.write(verify(pairs, texts, weights).groupBy("id", "pivot").agg(F.max("sim").alias("sim")), "judged")


def _links(judged: DataFrame, similarity: float) -> DataFrame:
    return judged.filter(F.col("sim") >= similarity).select(F.col("id").alias("u"), F.col("pivot").alias("v"))


def _prefixes(nodes: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """(id, c, total, rest, short, shingle) of the prefix of each node (id, c, text): its rarest shingles, up to where the rest
    (a shingle and all behind it) weighs less than the similarity's part of the total. Short: the rest is enough for the
    lighter one of two texts, which shares 2s / (1 + s) of its weight at least."""
    lighter = 2 * similarity / (1 + similarity) - 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in blocks(b.column(2)):
                doc, sh, count = shingles(t)
                idf, w = weights.ln(sh), weights.of(sh, count)
                order = np.lexsort((sh, -idf, doc))
                doc, sh, w = doc[order], sh[order], w[order]
                total = np.bincount(doc, w, minlength=t.n)
                before = np.cumsum(w) - w
                before -= before[np.searchsorted(doc, doc)]
                rest = total[doc] - before
                at = np.flatnonzero(rest >= (similarity - 1e-6) * total[doc])
                ids, comps = (b.column(i).slice(lo, hi - lo).take(pa.array(doc[at])) for i in (0, 1))
                short = rest[at] >= lighter * total[doc[at]]
                yield pa.RecordBatch.from_arrays([ids, comps, pa.array(total[doc[at]]), pa.array(rest[at]), pa.array(short), pa.array(sh[at].astype(np.int64))], names=["id", "c", "total", "rest", "short", "shingle"])

    return nodes.select("id", "c", "text").mapInArrow(run, "id long, c long, total double, rest double, short boolean, shingle long")


def _left_open(members: DataFrame, pivots: DataFrame, label: DataFrame, texts: DataFrame, weights: Weights, similarity: float, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (u, v) between nodes of one bucket that the first comparisons left in different components; and, for what
    these links leave open, the prefixes of shingles of many nodes, and the nodes' texts."""
    nodes = members.select("key", "id").unionByName(pivots.select("key", F.col("pivot").alias("id")))
    nodes = _with_component(nodes, label, "id", "c")
    several = nodes.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key")
    ids = nodes.join(several, "key", "left_semi").select("id", "c").distinct()
    opened = scratch.write(texts.select("id", "text").join(ids.hint("shuffle_hash"), "id"), "open")
    prefixes = scratch.write(_prefixes(opened, weights, similarity), "prefixes")
    sizes = prefixes.groupBy("shingle").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"), F.max("short").alias("any")).filter("low <> high AND any")
    few = prefixes.join(sizes.filter(F.col("n") <= PAIRED).select("shingle"), "shingle")
    other = few.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("id", "c", "total", "rest")])
    lighter = (F.col("total") < F.col("total2")) | ((F.col("total") == F.col("total2")) & (F.col("id") < F.col("id2")))
    enough = F.least("rest", "rest2") >= (F.col("total") + F.col("total2")) * (similarity / (1 + similarity) - 1e-6)
    pairs = few.filter("short").join(other, "shingle").filter(lighter & enough & (F.col("c") != F.col("c2")))
    pairs = pairs.select(F.greatest("id", "id2").alias("id"), F.least("id", "id2").alias("pivot"))
    many = prefixes.join(sizes.filter(F.col("n") > PAIRED).select("shingle"), "shingle")
    cleanest = many.groupBy("shingle").agg(F.max_by(F.struct("id", "c", "total", "rest"), F.struct(F.col("rest") / F.col("total"), -F.col("id"))).alias("best"))
    best = cleanest.select("shingle", *[F.col(f"best.{c}").alias(f"{c}2") for c in ("id", "c", "total", "rest")])
    pairs = pairs.unionByName(many.join(best, "shingle").filter(enough & (F.col("c") != F.col("c2"))).select("id", F.col("id2").alias("pivot")))
    return scratch.write(_links(verify(pairs.distinct(), opened, weights), similarity).distinct(), "near"), many, opened


def _settled(many: DataFrame, label: DataFrame, opened: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """Links between the nodes of each shingle whose nodes are still of several components, but for those within its largest
    one, in blocks of about BLOCK_NODES nodes and BLOCK_BYTES bytes."""
    many = _with_component(many.drop("c"), label, "id", "c")
    sizes = many.groupBy("shingle", "c").agg(F.count("*").alias("n"), F.max("short").alias("any"), F.min("total").alias("least"))
    main = sizes.groupBy("shingle").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count("*").alias("components"), F.max("any").alias("any"), F.min("least").alias("least"))
    full = many.join(main.filter("components > 1 AND any").select("shingle", "main", "least"), "shingle")
    # what a node can share must be enough with the lightest of the others at least
    full = full.filter(F.col("rest") >= (F.col("total") + F.col("least")) * (similarity / (1 + similarity) - 1e-6)).select("shingle", "id", "c", "main")
    full = full.join(opened.select("id", "text"), "id")

    def packed(rows: DataFrame, side: str) -> DataFrame:
        parts = F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("long")
        dealt = rows.join(rows.groupBy("shingle").agg(parts.alias("parts")), "shingle").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        return dealt.groupBy("shingle", "part").agg(F.collect_list(F.struct("id", "c", "text")).alias(side)).drop("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                u, v = linked(batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), weights, similarity)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    pairs = packed(full.filter("c <> main"), "a").join(packed(full, "b"), "shingle").select("a", "b")
    return pairs.mapInArrow(run, "u long, v long").distinct()


def linked(a: list[dict], b: list[dict], weights: Weights, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of two blocks, of different components: for each node and other component one."""
    ids, comps = (np.array([x[k] for x in a + b], dtype=np.int64) for k in ("id", "c"))
    n = len(a)
    want = comps[:n, None] != comps[n:]
    if not want.any():
        return ids[:0], ids[:0]
    t = Texts([x["text"].encode() for x in a + b])
    doc, sh, count = shingles(t)
    w = weights.of(sh, count)
    total = np.bincount(doc, w, minlength=t.n)
    uniq, inverse, times = np.unique(sh, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    shared = times[inverse] > 1
    doc, col, root = doc[shared], place[inverse[shared]], np.sqrt(w[shared])
    bound = np.zeros((n, len(b)))
    order = np.argsort(col, kind="stable")
    doc, col, root = doc[order], col[order], root[order]
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, SLAB):  # sqrt(x * y) is no less than the smaller of x and y
        i, j = np.searchsorted(col, (lo, lo + SLAB))
        dense = np.zeros((t.n, SLAB), dtype=np.float32)
        dense[doc[i:j], col[i:j] - lo] = root[i:j]
        bound += dense[:n] @ dense[n:].T
    bound /= np.maximum(total[:n, None] + total[n:] - bound, 1e-12)
    x, y = np.nonzero(want & (bound >= similarity - 1e-3))
    keep = []
    for lo in range(0, len(x), 256):
        i, j = x[lo : lo + 256], y[lo : lo + 256]
        left, right = (Texts([side[k]["text"].encode() for k in rows.tolist()]) for side, rows in ((a, i), (b, j)))
        keep.append(similarities(left, right, weights) >= similarity)
    ok = np.concatenate(keep) if keep else np.zeros(0, dtype=bool)
    x, y = x[ok], n + y[ok]
    _, one = np.unique(np.stack([ids[x], comps[y]]), axis=1, return_index=True)
    return ids[x[one]], ids[y[one]]


def _with_component(rows: DataFrame, label: DataFrame, col: str, name: str) -> DataFrame:
    named = label.select(F.col("id").alias(col), F.col("component").alias(name))
    return rows.join(named, col, "left").withColumn(name, F.coalesce(name, col))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document, and whether it is the one of its class that stays."""
    out = classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()))


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, with all its columns: that of the smallest id; rows without an id come last."""
    names = docs.columns
    # renamed on the way in and out, lest the documents have columns of the names used here
    inner = docs.toDF(*[f"d{i}" for i in range(len(names))])
    keyed = Scratch(spark, "minhash-rows").write(inner.withColumn("row", F.monotonically_increasing_id()), "rows")
    rows = keyed.select("row", F.col(f"d{names.index('doc_id')}").alias("doc_id"), F.col(f"d{names.index('text')}").alias("text"))
    out = classes(rows.select("row", "text"), "row").join(rows.select("row", "doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    keep = out.groupBy("class_id").agg(first).select("first.row")
    return keyed.join(keep.hint("shuffle_hash"), "row", "left_semi").select(*inner.columns).toDF(*names)


QUERIES = {"op2_minhash": op2_minhash}
ORACLES: dict[str, str] = {}
