"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Per class: mean and covariance of the statistics, the covariance shrunk towards the pooled one and that towards its
diagonal; both shrinkages are those of GRID with the greatest likelihood of left-out labels (FOLDS parts of the sample).
A score is the posterior from log priors and Gaussian log densities, whose Mahalanobis terms come from one forward
substitution with the Cholesky factor kept for each class. The model (a few kB) is fitted on the driver from a
bounded sample (labelled.MAX_ROWS rows, labelled.MAX_BYTES bytes) and broadcast; every text is scored by itself.

Defined results: null and empty texts have the statistics of an empty text and so a score; if the sample lacks a class,
every score is the share of label 1 in it, 0.5 without a sample; a null label or id isn't learned from; repeated rows
are scored each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from recurra.llm import labelled
from recurra.llm import quality_rules as rules
from recurra.llm import textnum as tn

#: Shares of the pooled covariance in a class's, and of the diagonal in that; parts of the sample that are left out in turn.
GRID, FOLDS = [(p, d) for p in (0.05, 0.2, 0.4, 0.6, 0.8, 0.95) for d in (0.02, 0.1, 0.3)], 5
CUT = 0.3
_UPPER = tn.byte_set((65, 90))
_ALPHA = tn.byte_set((65, 90), (97, 122), (128, 255))
_DIGIT = tn.byte_set((48, 57))
_ENDS = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_BANG = np.isin(np.arange(256), np.frombuffer(b"!", np.uint8))
_PUNCT = ~(_ALPHA | _DIGIT | tn.BLANKS)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Transformed statistics, one row for each text."""
    n = len(off) - 1
    w = tn.words(data, off, tn.BLANKS)
    size = np.maximum(np.diff(off), 1)
    words = np.maximum(w.counts(), 1)
    share = lambda table: rules.per_text(table[data], off) / size
    salt = tn.mix(np.arange(1, n + 1, dtype=np.uint64))
    fresh = np.bincount(w.doc, ~_again(w, salt), n) / words
    length = (w.end - w.start).astype(float)
    mean = np.bincount(w.doc, length, n) / words
    spread = np.sqrt(np.maximum(np.bincount(w.doc, length**2, n) / words - mean**2, 0))
    tail = _PUNCT[data[w.end - 1]] if len(w.end) else np.zeros(0, bool)
    head = _UPPER[data[w.start]] if len(w.start) else np.zeros(0, bool)
    lines = rules.per_text(data == 10, off) + 1
    dup5 = np.bincount(w.doc, rules.covered(w, 5, salt), n) / words
    dup2 = np.bincount(w.doc, rules.covered(w, 2, salt), n) / words
    root = np.sqrt
    return np.stack(
        [
            np.log1p(w.counts()),
            np.log1p(mean),
            np.log1p(spread),
            root(share(rules.SYMBOLS)),
            root(share(_UPPER)),
            root(share(_DIGIT)),
            root(share(_BANG)),
            root(share(_PUNCT)),
            root(share(_ENDS)),
            np.bincount(w.doc, tail, n) / words,
            np.bincount(w.doc, head, n) / words,
            np.log1p(words / lines),
            fresh,
            root(dup5),
            root(dup2),
        ],
        1,
    )


def _again(w: tn.Words, salt: np.ndarray) -> np.ndarray:
    """Which words were in their text before."""
    key = w.hash ^ salt[w.doc]
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:][key[order][1:] == key[order][:-1]]] = True
    return out


@dataclass
class Discriminant:
    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray  # Cholesky factors of the covariances
    offsets: np.ndarray  # log prior minus half the log determinant
    constant: float | None = None
    shrinkage: tuple[float, float] | None = None

    def __call__(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return self.posterior(statistics(data, off))

    def posterior(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        x = (x - self.center) / self.scale
        log = [o - 0.5 * (solved(f, x - m) ** 2).sum(1) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def solved(low: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows y with low @ y = x for a lower triangular matrix, by forward substitution over all rows of x."""
    y = np.empty_like(x)
    for k in range(len(low)):
        y[:, k] = (x[:, k] - y[:, :k] @ low[k, :k]) / low[k, k]
    return y


def fit(x: np.ndarray, y: np.ndarray, shrinkage: tuple[float, float] | None = None) -> Discriminant:
    d = x.shape[1]
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    if n.min() < 2:
        none = np.zeros(0)
        return Discriminant(none, none, none, none, none, float(y.mean()) if len(y) else 0.5)
    pooled, diagonal = shrinkage or best_shrinkage(x, y)
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    x = (x - center) / scale
    means = np.stack([x[y == k].mean(0) for k in (0, 1)])
    within = [np.cov(x[y == k], rowvar=False, bias=True).reshape(d, d) for k in (0, 1)]
    common = (n[0] * within[0] + n[1] * within[1]) / n.sum()
    factors, offsets = [], []
    for k in (0, 1):
        c = (1 - pooled) * within[k] + pooled * common
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-4 * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(low)
        offsets.append(np.log(n[k] / n.sum()) - np.log(np.diag(low)).sum())
    return Discriminant(center, scale, means, np.stack(factors), np.array(offsets), shrinkage=(pooled, diagonal))


def best_shrinkage(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Of GRID the shares with the greatest mean log likelihood of the labels of left-out rows; of equals the last. The sample's order is by hash, so its parts are random."""
    part = np.arange(len(y)) % FOLDS
    score = []
    for shares in GRID:
        total = 0.0
        for k in range(FOLDS):
            model, out = fit(x[part != k], y[part != k], shares), part == k
            p = np.clip(model.posterior(x[out]), 1e-9, 1 - 1e-9)
            total += np.log(np.where(y[out] == 1, p, 1 - p)).sum()
        score.append((total, shares))
    return max(score)[1]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", **bounds) -> Discriminant:
    texts, y = labelled.sample(docs, labels, label, **bounds)
    parts = [statistics(data, off) for _, _, data, off in tn.blocks(texts)]
    return fit(np.concatenate(parts) if parts else np.zeros((0, 15)), y)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labelled.scored(docs, train(docs, labels), CUT)
