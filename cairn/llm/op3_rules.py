"""Quality rules: gradient-boosted trees over document statistics, flattened into numpy node arrays.

The base rules are fixed counts over whole texts; the trees decide on what passes them. They are fitted on at most
TRAIN_ROWS labelled rows with monotonic constraints (more symbols, repeats or doubled lines never raise a score) and
are then laid out as flat arrays, so that a batch is scored level by level with array look-ups.

Defined cases: a null text counts as empty and fails the base rules; of labelled rows that repeat an id one counts; equal texts get equal verdicts and repeated
rows stay repeated; without labels of both kinds the trees keep all that passes the base rules; other columns of
the input are not read. Every text is read whole, a block of texts at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import fold, labelled, one_of_id, read_table
from cairn.llm.textnum import FEATURES, Texts, features, ragged, text_map

TRAIN_ROWS = 6_000
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "pipe_share": -1, "mark_share": -1}
KEEP_FROM = 0.5
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass
class Forest:
    """Trees as node arrays: tree i starts at node root[i]; a leaf points to itself on both sides."""

    root: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of a good text for each row of x."""
        at = np.broadcast_to(self.root, (len(x), len(self.root)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.bias + self.value[at].sum(axis=1))))


def fit_forest(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 1.0, least: int = 5) -> Forest:
    """Second-order boosting of the logistic loss on histograms.

    A split on a constrained feature must order its children's values; the middle of the two then bounds all values
    below either child, which keeps the whole tree monotonic in that feature.
    """
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    feature, cut, left, right, value, root = [], [], [], [], [], []

    def node(v: float) -> int:
        i = len(value)
        feature.append(0)
        cut.append(np.inf)
        left.append(i)
        right.append(i)
        value.append(v)
        return i

    if len(y) == 0 or y.min() == y.max():
        root.append(node(0.0))
        n_trees = 0
        bias = 6.0
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])] if n_trees else []
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n_trees else None
    raw = np.full(len(y), bias)
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)

        def grow(rows: np.ndarray, lo: float, hi: float, level: int, g: np.ndarray = g, h: np.ndarray = h) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            v = float(np.clip(-gs / (hs + l2), lo, hi))
            me, best = node(v * rate), None
            if level == depth or len(rows) < 2 * least:
                raw[rows] += v * rate
                return me
            gain0 = -(gs * v + 0.5 * (hs + l2) * v * v)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                c = code[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(c, w, minlength=len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-(gs - gl) / (hs - hl + l2), lo, hi)
                gain = -(gl * vl + 0.5 * (hl + l2) * vl**2) - ((gs - gl) * vr + 0.5 * (hs - hl + l2) * vr**2) - gain0
                gain[(nl < least) | (len(rows) - nl < least) | (monotone[j] * (vr - vl) < 0)] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, k, vl[k], vr[k])
            if best is None:
                raw[rows] += v * rate
                return me
            _, j, k, vl, vr = best
            mid, down = (vl + vr) / 2, code[rows, j] <= k
            bound = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[int(monotone[j])]
            feature[me], cut[me] = j, edges[j][k]
            left[me] = grow(rows[down], *bound[0], level + 1)
            right[me] = grow(rows[~down], *bound[1], level + 1)
            return me

        root.append(grow(np.arange(len(y)), -np.inf, np.inf, 0))
    a = np.array
    return Forest(a(root), a(feature), a(cut), a(left), a(right), a(value, dtype=float), bias, depth)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, n: int, seed: int, mod: int, held: int) -> tuple[np.ndarray, np.ndarray]:
    """FEATURES and labels of a bounded sample outside the held-out fold; n rows at most come to the driver."""
    rows = labelled(docs, labels.filter(F.col(label).isNotNull()).select("doc_id", label), n, seed, fold("doc_id", mod) != held)

    def fn(t: Texts) -> dict:
        x = features(t)[1]
        return {"x": ragged(x.ravel(), np.full(t.n, x.shape[1]))}

    got = one_of_id(text_map(rows.withColumn(label, F.col(label).cast("int")), ["doc_id", label], "text", "x array<double>", fn)).toArrow().sort_by("doc_id")
    x = got["x"].combine_chunks().values.to_numpy().reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    return x, got[label].to_numpy().astype(float)


def fit_rules(docs: DataFrame, labels: DataFrame, n: int = TRAIN_ROWS) -> Forest:
    x, y = training_rows(docs, labels, "quality", n, 3, 4, 2)
    return fit_forest(x, y, np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def apply_rules(docs: DataFrame, forest: Forest, keep_from: float = KEEP_FROM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the base counts, base_failed, kept and the trees' score of every row."""

    def fn(t: Texts) -> dict:
        b, x = features(t)
        b["score"] = forest.score(x)
        b["base_failed"] = (b["n_words"] < 20) | (100 * b["n_repeat_words"] > 30 * b["n_words"])
        b["kept"] = ~b["base_failed"] & (b["score"] >= keep_from)
        return b

    return text_map(docs, [id_col], text_col, BASE + ", base_failed boolean, kept boolean, score double", fn)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document; see the module for the defined cases."""
    docs = read_table(spark, sf_dir, "documents")
    return apply_rules(docs, fit_rules(docs, read_table(spark, sf_dir, "labels")))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass; text and verdict leave one pass together, so nothing is shuffled."""
    forest = fit_rules(docs, read_table(spark, sf_dir, "labels"))
    names = docs.columns
    # renamed on the way in and out, lest the documents have a column of the verdict's name
    inner = docs.toDF(*[f"d{i}" for i in range(len(names))])

    def fn(t: Texts) -> dict:
        b, x = features(t)
        failed = (b["n_words"] < 20) | (100 * b["n_repeat_words"] > 30 * b["n_words"])
        return {"kept": ~failed & (forest.score(x) >= KEEP_FROM)}

    return text_map(inner, inner.columns, f"d{names.index('text')}", "kept boolean", fn).filter("kept").select(*inner.columns).toDF(*names)


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES: dict[str, str] = {}
