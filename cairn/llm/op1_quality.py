"""Quality classifier: Bradley-Terry ranking from preference pairs, thresholded by a score quantile.

Each pair sets a row of label 1 above a row of label 0; the score is linear in piecewise-linear terms of document
statistics, and its weights minimise the logistic loss of the pairs' feature differences by Newton steps. A quantile
of the training scores becomes the threshold, which maps to 0.7 on the scale from 0 to 1.

Defined cases: a null or empty text is scored by its (zero) statistics; equal texts get equal scores and repeated
rows stay repeated; without labels of both kinds every score is 0.5; other columns are not read. Labels are learned
only from rows whose crc32(doc_id) mod 4 is not 2, TRAIN_ROWS at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import fold, read_table
from cairn.llm.op3_rules import training_rows
from cairn.llm.textnum import FEATURES, Texts, features, text_map

TRAIN_ROWS = 8_000
PAIRS = 60_000
LEVEL = 0.7


@dataclass
class Ranker:
    centre: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weight: np.ndarray
    cut: float
    slope: float

    def terms(self, x: np.ndarray) -> np.ndarray:
        """Scaled statistics and their hinges at the knots."""
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.concatenate([z] + [np.maximum(z - k, 0) for k in self.knots], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.terms(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.slope * (self.raw(x) - self.cut)
        return 1 / (1 + np.exp(-np.clip(at + np.log(LEVEL / (1 - LEVEL)) * (self.slope > 0), -30, 30)))


def fit_ranker(x: np.ndarray, y: np.ndarray, n_pairs: int = PAIRS, l2: float = 1e-3, seed: int = 1) -> Ranker:
    f = x.shape[1]
    model = Ranker(np.zeros(f), np.ones(f), np.zeros((0, f)), np.zeros(f), 0.0, 0.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    model.centre, spread = x.mean(axis=0), x.std(axis=0)
    model.scale = np.where(spread > 1e-9, spread, 1.0)
    z = np.clip((x - model.centre) / model.scale, -6, 6)
    model.knots = np.quantile(z, [0.03, 0.1, 0.5, 0.9, 0.97], axis=0)
    t = model.terms(x)
    rng = np.random.default_rng(seed)
    d = t[rng.choice(good, n_pairs)] - t[rng.choice(bad, n_pairs)]
    w = np.zeros(t.shape[1])
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / n_pairs + l2 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / n_pairs + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    model.weight = w
    raw = t @ w
    # the quantile level starts at the share of label 0 and is settled by balanced accuracy around it
    share = len(bad) / len(y)
    levels = np.clip(share * np.linspace(0.5, 1.5, 41), 0.001, 0.999)
    cuts = np.quantile(raw, levels)
    gain = [(raw[good] >= c).mean() + (raw[bad] < c).mean() for c in cuts]
    best = np.flatnonzero(np.array(gain) >= max(gain) - 1e-9)
    model.cut = float(cuts[best[len(best) // 2]])
    model.slope = float(4 / max(raw[good].mean() - raw[bad].mean(), 1e-6))
    return model


def score_quality(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def fn(t: Texts) -> dict:
        return {"score": model.score(features(t)[1])}

    return text_map(docs, [id_col], text_col, "score double", fn)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document; see the module for the defined cases."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit_ranker(*training_rows(docs, read_table(spark, sf_dir, "labels"), "quality", TRAIN_ROWS, 1, 4, 2))
    out = score_quality(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= LEVEL, 1).otherwise(0).alias("predicted"))


QUERIES = {"op1_quality": op1_quality}
ORACLES: dict[str, str] = {}
