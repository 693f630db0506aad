"""Toxicity: cumulative-link ordinal regression over sparse text features, giving an expected severity.

The labels tell toxic rows from clean ones, not how bad they are. Grades to learn from are therefore made of the labels:
0 for a clean row; 1, 2 or 3 for a toxic one, by thirds of a score that a two-grade model, fitted on the other half of the
sample, gives it. They are an estimate of severity and no labels. P(grade <= k) = sigmoid(theta_k - w.x) with one weight
vector for all ordered thresholds; x holds 1 + log(count) of the TERMS terms (words, and beginnings of words) whose shares
in toxic and in clean rows differ most, in either direction, and the weights are held small by L2. The expected severity
is the sum of P(grade > k). A row is toxic from the severity that separates the training labels best (F1).

Defined cases: a null or empty text has no features and is clean by the thresholds alone; equal texts get equal
results and repeated rows stay repeated; of labelled rows that repeat an id one counts; without labels of both kinds
nothing is toxic; other columns are not read. Words are runs of ASCII letters, digits and all other characters, in lower
case; every text is read whole. Training takes at most TRAIN_ROWS labelled rows, outside the fold crc32(doc_id) mod 4 = 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, fold, labelled, one_of_id, read_table
from cairn.llm.textnum import _BASE, ALNUM, Texts, lowered, mix, ragged, text_map

TRAIN_ROWS = 8_000
TERMS = 400
PREFIXES = (4, 5, 6, 7, 8)
LEAST_ROWS = 5
GRADES = 4
L2 = 1e-3


def terms(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every term: words and, of longer words, their first bytes."""
    low = t.with_buf(lowered(t.buf))
    s, e, doc = low.spans(ALNUM)
    docs, hashes = [doc], [low.hashes(s, e)]
    for k in PREFIXES:
        long = e - s > k
        docs.append(doc[long])
        hashes.append(low.hashes(s[long], s[long] + k) ^ np.uint64(k))
    return np.concatenate(docs), np.concatenate(hashes)


def term_counts(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each distinct term of each text, in order of the texts."""
    doc, h = terms(t)
    _, first, count = np.unique(mix(h + doc.astype(np.uint64) * _BASE), return_index=True, return_counts=True)
    order = np.argsort(doc[first], kind="stable")
    first = first[order]
    return doc[first], h[first], count[order]


@dataclass
class Ordinal:
    term: np.ndarray  # sorted hashes
    weight: np.ndarray
    theta: np.ndarray
    cut: float

    def severity(self, t: Texts) -> np.ndarray:
        doc, h = terms(t)
        z = np.zeros(t.n)
        if len(self.term) and len(h):
            i = np.minimum(np.searchsorted(self.term, h), len(self.term) - 1)
            hit = self.term[i] == h
            pair, n = np.unique(doc[hit] * len(self.term) + i[hit], return_counts=True)
            z = np.bincount(pair // len(self.term), (1 + np.log(n)) * self.weight[pair % len(self.term)], minlength=t.n)
        return self.expected(z)

    def expected(self, z: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(-np.clip(z[:, None] - self.theta, -30, 30)))).sum(axis=1)


@dataclass
class Sparse:
    """A matrix by its values: row and column of each."""

    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], minlength=self.shape[0])

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * v[self.row], minlength=self.shape[1])

    def part(self, rows: np.ndarray) -> Sparse:
        """The rows that a mask holds."""
        number, here = np.cumsum(rows) - 1, rows[self.row]
        return Sparse(number[self.row[here]], self.col[here], self.value[here], (int(rows.sum()), self.shape[1]))


def fit_cumulative(x: Sparse, y: np.ndarray, grades: int, l2: float = L2, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the likelihood; gaps between thresholds are exponentials."""
    n, v = x.shape
    k = grades - 1
    above = np.array([(y > i).mean() for i in range(k)]).clip(1e-4, 1 - 1e-4)
    start = -np.log(above / (1 - above))
    par = np.concatenate([np.zeros(v), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, s = np.zeros_like(par), np.zeros_like(par)
    hi = np.minimum(y, k - 1)  # theta index above the grade
    lo = np.maximum(y - 1, 0)
    for i in range(1, steps + 1):
        w, gaps = par[:v], np.exp(np.clip(par[v + 1 :], -20, 5))
        theta = par[v] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = x.times(w)
        top = np.where(y < k, 1 / (1 + np.exp(-np.clip(theta[hi] - z, -30, 30))), 1.0)
        bottom = np.where(y > 0, 1 / (1 + np.exp(-np.clip(theta[lo] - z, -30, 30))), 0.0)
        p = np.maximum(top - bottom, 1e-12)
        dt, db = np.where(y < k, top * (1 - top), 0) / p, np.where(y > 0, bottom * (1 - bottom), 0) / p
        dz = (dt - db) / n  # of the mean negative log likelihood
        dtheta = np.bincount(hi, -dt / n, minlength=k) + np.bincount(lo, db / n, minlength=k)
        grad = np.concatenate([x.back(dz) + l2 * w, [dtheta.sum()], np.cumsum(dtheta[::-1])[::-1][1:] * gaps])
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        par -= rate * (m / (1 - 0.9**i)) / (np.sqrt(s / (1 - 0.999**i)) + 1e-8)
    return par[:v], par[v] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(par[v + 1 :], -20, 5)))])


def telling_terms(rows: DataFrame, n: int, pos: int) -> np.ndarray:
    """Sorted hashes of the TERMS terms whose shares of toxic and of clean rows (toxic, words) differ most, by their z."""
    term = rows.select("toxic", F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("rows"), F.sum("toxic").alias("hits"))
    p1, p0 = F.col("hits") / F.lit(pos), (F.col("rows") - F.col("hits")) / F.lit(n - pos)
    share = F.col("rows") / F.lit(n)
    z = F.abs(p1 - p0) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)))
    got = term.filter(F.col("rows") >= LEAST_ROWS).orderBy(F.desc(z), "term").limit(TERMS).select("term").toArrow()
    return np.sort(got["term"].to_numpy().astype(np.uint64))


def crossed_grades(x: Sparse, toxic: np.ndarray) -> np.ndarray:
    """Grades of the rows: thirds of a score that comes from the other half of them."""
    half, score = np.arange(len(toxic)) % 2 == 0, np.zeros(len(toxic))
    for here in (half, ~half):
        w, _ = fit_cumulative(x.part(~here), toxic[~here].astype(int), 2)
        score[here] = x.part(here).times(w)
    third = np.quantile(score[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + np.searchsorted(third, score, side="left"), 0)


def fit_ordinal(doc: np.ndarray, word: np.ndarray, count: np.ndarray, toxic: np.ndarray, term: np.ndarray) -> Ordinal:
    """The model of rows' counts (doc, word, count) of the terms, which are sorted."""
    n, pos = len(toxic), int(toxic.sum())
    x = Sparse(doc, np.searchsorted(term, word), 1 + np.log(count), (n, len(term)))
    model = Ordinal(term, *fit_cumulative(x, crossed_grades(x, toxic), GRADES), 1.0)
    sev = model.expected(x.times(model.weight))
    order = np.argsort(-sev, kind="stable")
    tp = np.cumsum(toxic[order])
    f1 = 2 * tp / (np.arange(1, n + 1) + pos)
    last = np.append(sev[order][1:] < sev[order][:-1], True)  # a cut can't part equal severities
    i = int(np.argmax(np.where(last, f1, -1)))
    below = sev[order][i + 1] if i + 1 < n else 0.0
    model.cut = float((sev[order][i] + below) / 2)
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, n: int = TRAIN_ROWS) -> Ordinal:
    """Terms are counted and chosen where the sample lies; the driver gets counts of TERMS terms in n rows at most."""
    rows = labelled(docs, labels.filter(F.col("toxic").isNotNull()).select("doc_id", "toxic"), n, 5, fold("doc_id", 4) != 2)
    scratch = Scratch(docs.sparkSession, "toxicity")

    def fn(t: Texts) -> dict:
        doc, word, count = term_counts(t)
        each = np.bincount(doc, minlength=t.n)
        return {"words": ragged(word.astype(np.int64), each), "counts": ragged(count.astype(np.int32), each)}

    rows = text_map(rows.withColumn("toxic", F.col("toxic").cast("int")), ["doc_id", "toxic"], "text", "words array<long>, counts array<int>", fn)
    rows = scratch.write(one_of_id(rows), "terms")
    total, pos = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).head()
    none = Ordinal(np.zeros(0, dtype=np.uint64), np.zeros(0), np.full(GRADES - 1, 30.0), 1.0)
    term = telling_terms(rows, total, pos) if 1 < pos < total else none.term
    if not len(term):
        scratch.drop()
        return none

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, counts = b.column(2), b.column(3)
            hit = np.isin(words.flatten().to_numpy().astype(np.uint64), term)
            each = np.bincount(np.repeat(np.arange(b.num_rows), words.value_lengths().to_numpy())[hit], minlength=b.num_rows)
            cols = [b.column(0), b.column(1), ragged(words.flatten().to_numpy()[hit], each), ragged(counts.flatten().to_numpy()[hit], each)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "toxic", "words", "counts"])

    got = rows.mapInArrow(chosen, rows.schema).toArrow().sort_by("doc_id")
    scratch.drop()
    words, counts = got["words"].combine_chunks(), got["counts"].combine_chunks()
    doc = np.repeat(np.arange(got.num_rows), words.value_lengths().to_numpy())
    return fit_ordinal(doc, words.flatten().to_numpy().astype(np.uint64), counts.flatten().to_numpy(), got["toxic"].to_numpy().astype(float), term)


def score_toxicity(docs: DataFrame, model: Ordinal, keep: list[str], text_col: str = "text") -> DataFrame:
    def fn(t: Texts) -> dict:
        s = model.severity(t)
        return {"severity": s, "grade": np.floor(s + 0.5).astype(np.int32), "toxic": s >= model.cut}

    return text_map(docs, keep, text_col, "severity double, grade int, toxic boolean", fn)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity (0 to 3), rounded grade and verdict of every document."""
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")), ["doc_id"])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic; text and verdict leave one pass together, so nothing is shuffled."""
    names = docs.columns
    # the result columns are renamed on the way in and out, lest the documents have columns of these names
    inner = docs.toDF(*[f"d{i}" for i in range(len(names))])
    out = score_toxicity(inner, fit_toxicity(docs, read_table(spark, sf_dir, "labels")), inner.columns, f"d{names.index('text')}")
    return out.filter(~F.col("toxic")).select(*inner.columns).toDF(*names)


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
