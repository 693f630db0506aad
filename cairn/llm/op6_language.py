"""Language ID: a linear-chain conditional random field labels the words of code-switched text.

Features of a word are hashed byte n-grams with the word's edges marked (those at an edge are its affixes) and the
word itself, if the training texts hold it often enough (the lexicon). Transition weights are learned with them, on
sequences spliced from spans of texts of different languages. Forward-backward gives each word's label
distribution; a text's language is the one with the largest mean over its words, and that mean is the score.

The recursion is exact over whole texts: segments of SEGMENT words are reduced to transfer matrices, which chain the
segments of a text, so that long texts need no long loops. Features are made once for each distinct word of a block, and
a long text is taken in pieces between words, so that memory is a few times its size.

Defined cases: `und` with score 0 if the text is null or has no letter; equal texts get equal results, repeated rows
stay repeated; without any labelled row every text is `und`; other columns are not read. Training takes windows of words
from at most TRAIN_ROWS texts outside the fold crc32(doc_id) mod 5 = 0 (of rows that repeat an id, one), WINDOWS of WIDTH
words and WINDOW_BYTES bytes each; more than LANGUAGES languages there are an error; lang, source and doc_id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import fold, one_of_id, read_table
from cairn.llm.textnum import BLOCK, Texts, distinct, lowered, mix, stream, table, text_map, uniform

TRAIN_ROWS = 1_500
WINDOWS, WIDTH, WINDOW_BYTES = 12, 24, 1_024
LANGUAGES = 500  # memory of the model grows with them; more are an error
SEQUENCES = 2_500
LENGTH = 40
SEGMENT = 64
BUCKETS = 1 << 16
NGRAMS = 4
LETTERS = table((65, 90), (97, 122), (128, 255))
_CHAR = stream(61, 256)
_U = np.uint64


@dataclass
class Words:
    """The words of a block: text and distinct word of each; n-gram buckets and lexicon key of the distinct ones."""

    doc: np.ndarray
    of: np.ndarray
    at: np.ndarray  # first place of each distinct word in grams
    grams: np.ndarray  # (NGRAMS, places)
    lex: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        """The distinct word of each place in grams."""
        return np.repeat(np.arange(len(self.at)), np.diff(np.append(self.at, self.grams.shape[1])))


def words_of(t: Texts) -> Words:
    """Words are maximal runs of letters; a word's n-grams may begin at the mark before it and end at the mark after it."""
    low = t.with_buf(lowered(t.buf))
    s, e, doc = low.spans(LETTERS)
    lex, _, first, of = distinct(low, s, e)
    s, e = s[first], e[first]
    buf = np.concatenate(([0], np.where(low.flags(LETTERS), low.buf, 0).astype(np.uint8), [0, 0]))  # word at s..e-1 lies at s+1..e
    code = _CHAR[buf]
    n = len(buf)
    gram = np.zeros(n, dtype=np.uint64)
    at = np.zeros(len(s) + 1, dtype=np.int64)
    # each word owns the n-grams that end within it or at the mark behind it: e - s + 1 places, NGRAMS each
    size = e - s + 1
    np.cumsum(size, out=at[1:])
    place = np.repeat(s + 1 - at[:-1], size) + np.arange(at[-1])
    begin = np.repeat(s, size)  # the mark before the word
    out = np.empty((NGRAMS, len(place)), dtype=np.int32)
    for k in range(NGRAMS):
        gram = gram * _U(0x9E3779B97F4A7C15)
        gram[k:] += code[: n - k]
        b = (mix(gram[place] + _U(k)) >> _U(48)).astype(np.int32) & (BUCKETS - 1)
        out[k] = np.where(place - k >= begin, b, BUCKETS)  # beyond the word: the bucket without weight
    return Words(doc, of, at[:-1], out, lex)


@dataclass
class Crf:
    labels: list[str]
    gram: np.ndarray  # (BUCKETS + 1, labels)
    lex: np.ndarray  # sorted keys of the lexicon
    lex_weight: np.ndarray
    trans: np.ndarray
    first: np.ndarray

    def known(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words in the lexicon, and their places there."""
        i = np.minimum(np.searchsorted(self.lex, w.lex), max(len(self.lex) - 1, 0))
        hit = np.flatnonzero(self.lex[i] == w.lex) if len(self.lex) else np.zeros(0, dtype=np.int64)
        return hit, i[hit]

    def emissions(self, w: Words) -> np.ndarray:
        """Label scores of the distinct words."""
        if not len(w.at):
            return np.zeros((0, len(self.labels)))
        total = self.gram[w.grams[0]]
        for row in w.grams[1:]:
            total += self.gram[row]
        out = np.add.reduceat(total, w.at, axis=0).astype(np.float64)
        hit, i = self.known(w)
        out[hit] += self.lex_weight[i]
        return out


def posteriors(emit: np.ndarray, doc: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label distribution of each word, by its whole chain and by the words up to it; doc (ascending) tells the chains apart."""
    n, k = emit.shape
    if not n:
        return emit, emit
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    a = np.exp(trans - trans.max())
    start = np.exp(first - first.max())
    # segments: within a text, every SEGMENT words
    head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    chain = np.cumsum(np.append(True, doc[1:] != doc[:-1])) - 1
    within = np.arange(n) - head[chain]
    seg_head = np.flatnonzero(within % SEGMENT == 0)
    seg_len = np.diff(np.append(seg_head, n))
    seg_no = within[seg_head] // SEGMENT
    m = len(seg_head)
    # transfer of each segment: product of (a * e_t); a masked step leaves it as it is
    p = np.broadcast_to(np.eye(k), (m, k, k)).copy()
    order = np.argsort(-seg_len, kind="stable")  # the longest first, so that a step works on a prefix
    longest = seg_len[order]
    for t in range(int(longest[0])):
        live = order[: np.searchsorted(-longest, -t, side="left")]
        q = (p[live].reshape(-1, k) @ a).reshape(-1, k, k)
        if t == 0:  # a text's first word has no word before it
            q[seg_no[live] == 0] = start * np.eye(k)
        q = q * e[seg_head[live] + t][:, None, :]
        p[live] = q / q.sum(axis=(1, 2), keepdims=True)
    # chain the segments: forward into each and backward out of each
    fwd = np.empty((m, k))
    bwd = np.ones((m, k))
    by_no = np.argsort(seg_no, kind="stable")
    cuts = np.searchsorted(seg_no[by_no], np.arange(int(seg_no.max()) + 2))
    for no in range(len(cuts) - 1):
        rows = by_no[cuts[no] : cuts[no + 1]]
        if no == 0:
            fwd[rows] = 1.0
        else:
            v = np.einsum("nk,nkj->nj", fwd[rows - 1], p[rows - 1])
            fwd[rows] = v / v.sum(axis=1, keepdims=True)
    for no in range(len(cuts) - 2, 0, -1):
        rows = by_no[cuts[no] : cuts[no + 1]]
        v = np.einsum("nkj,nj->nk", p[rows], bwd[rows])
        bwd[rows - 1] = v / v.sum(axis=1, keepdims=True)
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    v = fwd.copy()
    for t in range(int(longest[0])):
        live = order[: np.searchsorted(-longest, -t, side="left")]
        w = v[live] @ a
        if t == 0:
            w[seg_no[live] == 0] = start
        w = w * e[seg_head[live] + t]
        v[live] = w / w.sum(axis=1, keepdims=True)
        alpha[seg_head[live] + t] = v[live]
    v = bwd.copy()
    for t in range(int(longest[0]) - 1, -1, -1):
        live = order[: np.searchsorted(-longest, -t, side="left")]
        beta[seg_head[live] + t] = v[live]
        w = (v[live] * e[seg_head[live] + t]) @ a.T
        v[live] = w / w.sum(axis=1, keepdims=True)
    post = alpha * beta
    return post / post.sum(axis=1, keepdims=True), alpha


def gradients(model: Crf, w: Words, seq: np.ndarray, chain: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the log likelihood of labels y, by the n-gram, lexicon, transition and start weights. seq holds the distinct word
    of each place of the sequences, chain (ascending) their number."""
    k, n = len(model.labels), len(w.at)
    post, alpha = posteriors(model.emissions(w)[seq], chain, model.trans, model.first)
    diff = -post
    diff[np.arange(len(y)), y] += 1
    by_word = np.stack([np.bincount(seq, diff[:, j], minlength=n) for j in range(k)], axis=1)
    owner = w.owner
    gram = np.stack([sum(np.bincount(row, by_word[owner, j], minlength=BUCKETS + 1) for row in w.grams) for j in range(k)], axis=1)
    gram[BUCKETS] = 0
    lex = np.zeros(model.lex_weight.shape)
    hit, i = model.known(w)
    lex[i] = by_word[hit]
    # neighbours' joint distribution: forward probability, transition, and what the next word's distribution adds to it
    same = chain[1:] == chain[:-1]
    a = np.exp(model.trans - model.trans.max())
    before, after, left, right = alpha[:-1][same], post[1:][same], y[:-1][same], y[1:][same]
    expected = a * (before.T @ (after / np.maximum(before @ a, 1e-300)))
    trans = np.bincount(left * k + right, minlength=k * k).reshape(k, k) - expected
    return [gram, lex, trans, diff[np.append(True, ~same)].sum(axis=0)]


def fit_crf(windows: list[bytes], langs: list[str], n_seq: int = SEQUENCES, length: int = LENGTH, steps: int = 25, rate: float = 0.3, lex_least: int = 8, seed: int = 6) -> Crf | None:
    """Adagrad on the likelihood of spliced sequences: spans of several windows, each word labelled by its window's language."""
    labels = sorted(set(langs))
    k = len(labels)
    t = Texts(windows)
    w = words_of(t)
    if not len(w.doc):
        return None
    lo, hi = np.searchsorted(w.doc, np.arange(t.n)), np.searchsorted(w.doc, np.arange(t.n), side="right")
    y_doc = np.searchsorted(np.array(labels), np.array(langs))
    by_label = [np.flatnonzero((y_doc == j) & (hi > lo)) for j in range(k)]
    by_label = [x for x in by_label if len(x)]
    lexicon = w.lex[np.bincount(w.of, minlength=len(w.lex)) >= lex_least]
    rng = np.random.default_rng(seed)
    picked, seq = [], []
    for i in range(n_seq):
        left = length
        while left > 0:
            d = rng.choice(by_label[rng.integers(len(by_label))])
            span = min(left, int(rng.integers(6, 25)), int(hi[d] - lo[d]))
            begin = int(rng.integers(lo[d], hi[d] - span + 1))
            picked.append(np.arange(begin, begin + span))
            seq.append(np.full(span, i))
            left -= span
    at, chain = np.concatenate(picked), np.concatenate(seq)
    y = y_doc[w.doc[at]]
    same = chain[1:] == chain[:-1]
    pair = np.bincount(y[:-1][same] * k + y[1:][same], minlength=k * k).reshape(k, k) + 1.0
    zeros = lambda *shape: np.zeros(shape, dtype=np.float32)
    model = Crf(labels, zeros(BUCKETS + 1, k), lexicon, zeros(len(lexicon), k), np.log(pair / pair.sum(axis=1, keepdims=True)), np.zeros(k))
    pars = [model.gram, model.lex_weight, model.trans, model.first]
    acc = [np.full(x.shape, 1e-8) for x in pars]
    for _ in range(steps):
        for par, grad, c in zip(pars, gradients(model, w, w.of[at], chain, y), acc, strict=True):
            grad = grad / n_seq - 1e-5 * par
            c += grad**2
            par += (rate * grad / np.sqrt(c)).astype(par.dtype)
    return model


def windows_of(t: Texts) -> dict:
    """At most WINDOWS windows of WIDTH words of each text, at places drawn by the text's hash: all its words, if so many fit."""
    s, e, doc = t.spans(LETTERS)
    lo, hi = np.searchsorted(doc, np.arange(t.n)), np.searchsorted(doc, np.arange(t.n), side="right")
    draw = uniform(mix(t.hashes(t.start, t.end)[:, None] + stream(7, WINDOWS)))
    out = []
    for i in range(t.n):
        n = int(hi[i] - lo[i])
        starts = range(0, n, WIDTH) if n <= WINDOWS * WIDTH else sorted((draw[i] * (n - WIDTH + 1)).astype(int).tolist())
        cuts = []
        for k in starts:
            a, z = lo[i] + k, min(lo[i] + k + WIDTH, hi[i])
            z = a + int(np.searchsorted(e[a:z], s[a] + WINDOW_BYTES, side="right"))
            if z > a:
                cuts.append(t._padded[int(s[a]) : int(e[z - 1])])
        out.append(cuts)
    return {"windows": pa.array(out, pa.list_(pa.binary()))}


def training_windows(docs: DataFrame, n: int = TRAIN_ROWS, most: int = LANGUAGES) -> tuple[list[bytes], list[str]]:
    """Windows of at most n labelled texts outside the held-out fold, as many texts of each language as there are, and
    their languages. The windows are cut where the texts are read."""
    rows = docs.select("doc_id", "text", "lang").filter((fold("doc_id", 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).limit(most + 1).collect()}
    if len(counts) > most:
        raise ValueError(f"the training fold has more than {most} languages; none is dropped, so the model can't be fitted")
    if not counts:
        return [], []
    each = max(1, n // len(counts))
    # a hash of the id draws a few times the rows that are wanted of each language, so that few are ranked
    share = F.element_at(F.create_map(*[F.lit(x) for lang, c in counts.items() for x in (lang, min(1.0, 4 * each / max(c, 1)))]), F.col("lang"))
    h = F.xxhash64(F.col("doc_id"), F.lit(6))
    drawn = rows.filter(F.pmod(h, F.lit(1 << 30)) < share * (1 << 30)).select("doc_id", "lang").distinct().withColumn("h", h)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    sample = drawn.withColumn("rank", rank).filter(F.col("rank") <= each).select("doc_id").distinct()
    cut = text_map(rows.join(F.broadcast(sample), "doc_id"), ["doc_id", "lang"], "text", "windows array<binary>", windows_of)
    got = one_of_id(cut).withColumn("h", h).toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    lists, langs = got["windows"].to_pylist(), got["lang"].to_pylist()
    return [x for part in lists for x in part], [lang for part, lang in zip(lists, langs, strict=True) for _ in part]


def pieces(t: Texts) -> Iterator[Texts]:
    """The block itself, or its one long text cut between words."""
    if len(t.buf) <= 2 * BLOCK:
        yield t
        return
    stop, at, size = np.flatnonzero(~t.flags(LETTERS)), 0, len(t.buf)
    while at < size:
        i = np.searchsorted(stop, at + BLOCK)
        end = int(stop[i]) if i < len(stop) else size
        yield Texts([t._padded[at:end]])
        at = end + 1


def label_words(t: Texts, model: Crf) -> tuple[np.ndarray, np.ndarray]:
    """Text number of each word and its label distribution."""
    doc, emit = [], []
    for part in pieces(t):
        w = words_of(part)
        doc.append(w.doc)
        emit.append(model.emissions(w)[w.of])
    doc = np.concatenate(doc)
    return doc, posteriors(np.concatenate(emit), doc, model.trans, model.first)[0]


def has_letter(t: Texts) -> np.ndarray:
    out = t.per_text(t.flags(table((65, 90), (97, 122)))) > 0
    for i in np.flatnonzero(~out & (t.per_text(t.flags(table((128, 255)))) > 0)):
        out[i] = any(c.isalpha() for c in t.raw(i).decode("utf-8", "replace"))
    return out


def identify(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def fn(t: Texts) -> dict:
        if model is None:
            return {"lang_pred": pa.array(["und"] * t.n), "score": np.zeros(t.n)}
        doc, post = label_words(t, model)
        k = len(model.labels)
        total = np.stack([np.bincount(doc, post[:, j], minlength=t.n) for j in range(k)], axis=1)
        n = np.maximum(np.bincount(doc, minlength=t.n), 1)
        ok, best = has_letter(t), total.argmax(axis=1)
        names = np.array([*model.labels, "und"], dtype=object)
        return {"lang_pred": pa.array(names[np.where(ok, best, k)], pa.string()), "score": np.where(ok, np.clip(total.max(axis=1) / n, 0, 1), 0.0)}

    return text_map(docs, [id_col], text_col, "lang_pred string, score double", fn)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; see the module for the defined cases."""
    docs = read_table(spark, sf_dir, "documents")
    out = identify(docs, fit_crf(*training_windows(docs)))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language": op6_language}
ORACLES: dict[str, str] = {}
