"""Toxicity by weak supervision.

Voters say toxic, say clean or abstain. Lexicon voters: a seed lexicon a language, and lexicons by kind and strength of
the terms (words and word beginnings of several lengths) much more frequent in the sample's toxic texts. Pattern voters
read the text itself: insults addressed to the reader, by language; shouting; repeated marks; masked letters. The given
label is one more voter, which abstains on unlabelled rows and may be wrong.

A generative model with a hidden label estimates by EM how each voter answers given the label and given the voter that
it depends on most (a maximum spanning tree over conditional mutual information, estimated anew), so that correlated
voters don't count twice; the accuracy of the given label too, from LABEL_PRIOR answers of LABEL_RIGHT on. It is fitted
on labelled rows and on unlabelled ones (a bounded sample of each, none of them held out). Its posterior labels train a
linear (logistic) classifier over term counts, which scores every text.

The model is fitted on the driver (labelled.MAX_ROWS labelled and as many unlabelled rows, labelled.MAX_BYTES bytes of
each) and broadcast: at most N_TERMS hashes and weights. Every text is scored by itself, whole: no shuffle.

Defined results: null and empty texts score as texts without terms; without a toxic labelled row every score is 0; a
null label or id isn't learned from; repeated rows are scored each; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from recurra.llm import labelled
from recurra.llm import textnum as tn

#: Lengths in bytes of word beginnings; 0 stands for whole words.
KINDS = (0, 4, 5, 6, 7, 8)
N_TERMS = 512
#: Seed lexicons and patterns of direct insults, a language each.
SEEDS = {
    "en": "stupid idiot moron loser scum trash pathetic worthless disgusting clown dumb ugly filthy hateful",
    "de": "idiot dumm trottel abschaum widerlich erbärmlich wertlos ekelhaft hässlich versager",
    "fr": "idiot stupide imbécile ordure dégueulasse minable pathétique abruti crétin",
    "es": "idiota estúpido imbécil basura asqueroso patético inútil tonto payaso",
}
PATTERNS = [
    *(re.compile(rf"(?i)\b(?:{you})\b\W+(?:\w+\W+){{0,2}}(?:{'|'.join(SEEDS[k].split())})") for k, you in (("en", "you|you're|your|u r"), ("de", "du|ihr|dein|euer"), ("fr", "tu|vous|toi|espèce"), ("es", "eres|tú|vosotros|usted"))),
    re.compile(r"(?:\b[A-Z]{3,}\b\W+){4}"),  # shouting
    re.compile(r"[!?]{3,}"),
    re.compile(r"\b\w+[*@#$%]{2,}\w*\b"),  # masked letters
]
LABEL_RIGHT, LABEL_PRIOR = 0.97, 300
#: Weight of an unlabelled row: terms are chosen on labelled rows, so votes are surer there, and rows of full weight would draw the model to them.
UNLABELLED = 0.1
RIDGE = 1.0
CUT = 0.5


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of every word and word beginning, and the words of each text."""
    data = tn.LOWER[data]
    start, end = tn.runs(~tn.PUNCTUATION[data], off)
    doc = np.searchsorted(off, start, "right") - 1
    docs, hashes = [], []
    for n in KINDS:
        on = np.flatnonzero(end - start > n) if n else np.arange(len(start))
        docs.append(doc[on])
        hashes.append(tn.mix(tn.span_hashes(data, start[on], start[on] + n if n else end[on]) + np.uint64(n)))
    return np.concatenate(docs), np.concatenate(hashes), np.bincount(doc, minlength=len(off) - 1)


class Lookup:
    """Positions of known hashes."""

    BITS = 20

    def __init__(self, known: np.ndarray):
        self.known = np.sort(known)
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(self.known >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of hashes are known, and where."""
        on = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, hashes[on]), max(len(self.known) - 1, 0))
        ok = self.known[at] == hashes[on] if len(self.known) else np.zeros(len(on), bool)
        return on[ok], at[ok]


@dataclass
class Linear:
    lookup: Lookup
    weights: np.ndarray  # of log(1 + count) of each term, of log(1 + words), and the intercept

    def counts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        doc, h, n_words = terms(data, off)
        on, at = self.lookup.find(h)
        k, n = len(self.lookup.known), len(off) - 1
        x = np.bincount(doc[on] * k + at, minlength=n * k)[: n * k].reshape(n, k)
        return np.log1p(np.concatenate([x, n_words[:, None]], 1))

    def __call__(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return sigmoid(self.counts(data, off) @ self.weights[:-1] + self.weights[-1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def choose_terms(blocks: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms that speak most for label 1, and their log odds. blocks: (text, hash) pairs, each once."""
    h = np.concatenate([b[1] for b in blocks])
    label = y[np.concatenate([b[0] for b in blocks])]
    order = np.argsort(h)
    h, label = h[order], label[order]
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    both = np.diff(np.append(head, len(h)))
    pos = np.add.reduceat(label, head)
    n1, n0 = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    p, q = (pos + 0.5) / (n1 + 1), (both - pos + 0.5) / (n0 + 1)
    odds = np.log(p / q)
    gain = pos * np.log(p / q) - pos + q * n1  # log likelihood ratio of a Poisson count among toxic texts
    ok = np.flatnonzero((pos >= max(3, 0.003 * n1)) & (odds > np.log(2.5)))
    best = ok[np.argsort(-gain[ok], kind="stable")[:N_TERMS]]
    best = best[np.argsort(h[head[best]])]
    return h[head[best]], odds[best]


def votes(counts: np.ndarray, odds: np.ndarray, kind: np.ndarray, seed: np.ndarray, pattern: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """One row a text, one column a voter: 1 toxic, 2 clean, 0 abstains. seed, pattern: found or not, a column each."""
    out = []

    def say(yes: np.ndarray, no: np.ndarray) -> None:
        out.append(np.where(yes, 1, np.where(no, 2, 0)))

    strong = np.quantile(odds, 0.5) if len(odds) else 0.0
    hits = counts.sum(1)
    for column in (*seed.T, *pattern.T):
        say(column > 0, np.zeros(len(column), bool))
    for k in KINDS:
        mine = counts[:, kind == k]
        say((mine[:, odds[kind == k] > strong] > 0).any(1), (mine == 0).all(1))
    say((counts > 0).sum(1) >= 4, hits == 0)
    say(hits >= 6, hits == 0)
    say(hits > 0.02 * np.maximum(n_words, 1) * len(KINDS), hits < 0.001 * np.maximum(n_words, 1) * len(KINDS))
    say(counts @ odds > 12, counts @ odds < 1)
    return np.stack(out, 1)


class LabelModel:
    """P(label) and P(vote | label, vote of its parent) for voters with three answers, by EM."""

    def __init__(self, v: np.ndarray, start: np.ndarray, weight: np.ndarray | None = None, rounds: int = 25):
        """v: votes, the given label last (0: none); start: first posteriors; weight: of each row."""
        n, m = v.shape
        weight = np.ones(n) if weight is None else weight
        p = np.clip(start, 0.05, 0.95)
        for k in range(rounds):
            no, yes = weight * (1 - p), weight * p
            if k % 5 == 0:
                self.parent = self.tree(v, no, yes)
            self.prior = np.clip((yes.sum() + 1) / (weight.sum() + 2), 1e-3, 1 - 1e-3)
            self.tables = np.zeros((m, 2, 3, 3))
            for j in range(m):
                up = v[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(n, int)
                alone = np.stack([np.bincount(v[:, j], w, 3) + 0.5 for w in (no, yes)])
                alone /= alone.sum(1, keepdims=True)
                if j == m - 1:  # the given label depends on no other voter, and that a row has none says nothing
                    given = np.stack([np.bincount(v[:, j], w, 3) for w in (no, yes)])
                    right = (np.array([given[0, 2], given[1, 1]]) + LABEL_RIGHT * LABEL_PRIOR) / (given[:, 1:].sum(1) + LABEL_PRIOR)
                    self.parent[j] = -1
                    self.tables[j] = np.array([[[1.0, 1 - right[0], right[0]]] * 3, [[1.0, right[1], 1 - right[1]]] * 3])
                    self.label_right = right
                    continue
                for y, w in enumerate((no, yes)):
                    t = np.bincount(up * 3 + v[:, j], w, 9).reshape(3, 3) + 5 * alone[y]
                    self.tables[j, y] = t / t.sum(1, keepdims=True)
            p = self.posterior(v)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        z = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for j, up in enumerate(self.parent):
            u = v[:, up] if up >= 0 else np.zeros(len(v), int)
            z += np.log(self.tables[j, 1, u, v[:, j]]) - np.log(self.tables[j, 0, u, v[:, j]])
        return sigmoid(z)

    @staticmethod
    def tree(v: np.ndarray, no: np.ndarray, yes: np.ndarray) -> list[int]:
        """Parents of a maximum spanning tree over the voters' mutual information given the label; -1 at its root."""
        m = v.shape[1]
        info = np.zeros((m, m))
        for a in range(m):
            for b in range(a):
                for w in (no, yes):
                    t = (np.bincount(v[:, a] * 3 + v[:, b], w, 9).reshape(3, 3) + 1e-6) / max(no.sum() + yes.sum(), 1e-9)
                    info[a, b] += (t * np.log(t * t.sum() / (t.sum(1, keepdims=True) * t.sum(0, keepdims=True)))).sum()
        info += info.T
        parent, inside = [-1] * m, [0]
        while len(inside) < m:
            a, b = max(((a, b) for a in inside for b in range(m) if b not in inside), key=lambda x: info[x])
            parent[b] = a
            inside.append(b)
        return parent


def logistic(x: np.ndarray, p: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> np.ndarray:
    """Weights and intercept of the ridge logistic regression on soft labels, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        s = sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * np.maximum(s * (1 - s), 1e-6))[:, None]).T @ x + np.diag(keep), x.T @ (weight * (s - p)) + keep * w)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: pa.Array, y: np.ndarray, more: pa.Array | None = None) -> Linear:
    """texts with labels y, and unlabelled ones."""
    empty = Linear(Lookup(np.zeros(0, np.uint64)), np.array([0.0, -1e3]))
    if not len(y) or not y.any():
        return empty
    pairs = []
    for i, _, data, off in tn.blocks(texts):
        doc, h, _ = terms(data, off)
        key = h ^ tn.mix(doc.astype(np.uint64) + np.uint64(1))
        _, at = np.unique(key, return_index=True)
        pairs.append((doc[at] + i, h[at]))
    known, odds = choose_terms(pairs, y)
    if not len(known):
        return empty
    model = Linear(Lookup(known), np.zeros(len(known) + 2))
    every = [texts, more] if more is not None and len(more) else [texts]
    x = np.concatenate([model.counts(data, off) for t in every for _, _, data, off in tn.blocks(t)])
    counts = np.rint(np.expm1(x)).astype(int)
    seed, pattern = (np.concatenate([f(t) for t in every]) for f in (seeds_found, patterns_found))
    given = np.concatenate([np.where(y == 1, 1, 2), np.zeros(len(x) - len(y), int)])
    v = np.concatenate([votes(counts[:, :-1], odds, _kinds(known, texts), seed, pattern, counts[:, -1]), given[:, None]], 1)
    start = np.where(given == 1, 0.9, np.where(given == 2, 0.1, y.mean()))
    weight = np.where(given == 0, UNLABELLED, 1.0)
    model.weights = logistic(x, LabelModel(v, start, weight).posterior(v), weight)
    return model


def seeds_found(texts: pa.Array) -> np.ndarray:
    """Words of each language's seed lexicon in each text."""
    out = []
    look = [Lookup(tn.words(*tn.buffers(pa.array([s])), tn.PUNCTUATION, lower=True).hash) for s in SEEDS.values()]
    for _, _, data, off in tn.blocks(texts):
        w = tn.words(data, off, tn.PUNCTUATION, lower=True)
        out.append(np.stack([np.bincount(w.doc[k.find(w.hash)[0]], minlength=len(off) - 1) for k in look], 1))
    return np.concatenate(out) if out else np.zeros((0, len(SEEDS)), int)


def patterns_found(texts: pa.Array) -> np.ndarray:
    """Whether each pattern occurs in each text."""
    return np.array([[p.search(t) is not None for p in PATTERNS] for t in texts.to_pylist()]).reshape(len(texts), len(PATTERNS))


def _kinds(known: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Which of KINDS each term is."""
    out, look = np.zeros(len(known), np.int64), Lookup(known)
    for _, _, data, off in tn.blocks(texts):
        low = tn.LOWER[data]
        start, end = tn.runs(~tn.PUNCTUATION[low], off)
        for n in KINDS[1:]:
            on = end - start > n
            _, at = look.find(tn.mix(tn.span_hashes(low, start[on], start[on] + n) + np.uint64(n)))
            out[at] = n
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", **bounds) -> Linear:
    texts, y = labelled.sample(docs, labels, label, **bounds)
    return fit(texts, y, labelled.unlabelled(docs, labels, label, **bounds) if y.any() else None)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labelled.scored(docs, train(docs, labels), CUT)
