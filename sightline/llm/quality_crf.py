r"""Document quality from a linear-chain conditional random field over lines.

Every \n-split line gets features of its own and of its neighbours; a two-state chain (bad, good)
with a transition table scores label sequences; forward-backward gives each line's marginal; the
length-weighted marginals of a document are turned into its quality by a fitted logistic curve.

Only documents are labelled. Line labels are found by rounds: lines of good documents are good; a bad
document starts with its lines bad as far as a line classifier holds them likelier bad than good
(its likeliest line always), and each fitted chain labels them again. The fit reads a bounded,
documented sample; scoring reads every whole text, its chains in parallel over the documents of a
batch; a batch is bounded by bytes, so a long document costs no more memory than its own lines.

Defined results: a null or empty text is one empty line and gets the score of such a line; repeated
rows and null ids each give their own row; with no labelled rows all scores are 0.5; other columns
of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import labelled_sample, slices

#: Bounds of the fit: labelled rows per class, whole ones, and their bytes together.
SAMPLE_ROWS = 1200
SAMPLE_BYTES = 6_000_000
ROUNDS = 3
SYMBOLS = b"#*$%&|<>^~=_{}[]\\@"
DIGITS = b"0123456789"
PUNCT = b".,;:!?\"'()-"
_BASE = 17
#: Base features whose neighbours' values count as well.
_NEIGHBOUR = slice(0, 10)
N_FEATURES = _BASE + 2 * (_NEIGHBOUR.stop - _NEIGHBOUR.start) + 3


def line_values(line: str) -> list[float]:
    """Features of one line by itself, each 0 to 1."""
    raw = line.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, k = len(raw), len(words)
    if not k:
        return [0.0] * 13 + [1.0, 0.0, 0.0, 0.0]
    symbols = (n - len(raw.translate(None, SYMBOLS))) / n
    digits = (n - len(raw.translate(None, DIGITS))) / n
    bangs = raw.count(b"!!")
    upper = sum(map(str.isupper, line.split())) / k
    repeat = 1 - len(set(words)) / k
    pipes = raw.count(b" | ")
    length = n / k
    return [
        min(1.0, 8 * symbols), float(symbols > 0.04), min(1.0, bangs / k), float(bangs > 1), min(1.0, 4 * pipes / k),
        upper, float(k > 3 and upper > 0.6), repeat, float(k > 6 and repeat > 0.6), min(1.0, 4 * digits),
        float(length < 2.5), float(length > 14), float(k < 3), 0.0, min(1.0, np.log1p(k) / 6), float(raw.rstrip()[-1:] in b".!?"),
        min(1.0, (n - len(raw.translate(None, PUNCT))) / n * 4),
    ]


def text_matrix(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all lines of a text, and the lines' lengths in characters (1 at least)."""
    lines = (text or "").split("\n")
    known: dict[str, list[float]] = {}
    base = np.empty((len(lines), _BASE))
    again = np.zeros(len(lines))
    for i, line in enumerate(lines):
        if line in known:
            again[i] = float(bool(line))
        else:
            known[line] = line_values(line)
        base[i] = known[line]
    near = base[:, _NEIGHBOUR]
    before, after = np.zeros_like(near), np.zeros_like(near)
    before[1:], after[:-1] = near[:-1], near[1:]
    extra = np.stack([again, np.ones(len(lines)), np.full(len(lines), float(len(lines) == 1))], 1)
    return np.concatenate([base, before, after, extra], 1), np.array([max(1, len(x)) for x in lines], float)


@dataclass
class LineCRF:
    """state[f, y] weighs features, chain[y, y'] transitions; y: 0 bad, 1 good."""

    state: np.ndarray
    chain: np.ndarray

    def marginals(self, mats: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """P(good) of every line of every document, and the expected transition counts over all.

        Documents are sorted by length; step t handles the t-th line of all that have one.
        """
        order = np.argsort([-len(m) for m in mats], kind="stable")
        sizes = np.array([len(mats[i]) for i in order])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        x = np.concatenate([mats[i] for i in order]) @ self.state
        alpha, beta = np.empty_like(x), np.zeros_like(x)
        top = int(sizes[0])
        live = np.searchsorted(-sizes, -np.arange(1, top + 1), side="right")  # documents with at least t lines
        at = starts[:-1]
        alpha[at] = x[at]
        for t in range(1, top):
            here = at[: live[t]] + t
            alpha[here] = x[here] + _log_sum(alpha[here - 1][:, :, None] + self.chain[None], 1)
        for t in range(top - 2, -1, -1):
            here = at[: live[t + 1]] + t
            beta[here] = _log_sum(self.chain[None] + (x[here + 1] + beta[here + 1])[:, None, :], 2)
        z = _log_sum(alpha + beta, 1)
        good = np.exp(alpha[:, 1] + beta[:, 1] - z)
        inner = np.ones(len(x), bool)
        inner[starts[1:] - 1] = False
        i = np.flatnonzero(inner)
        pair = np.exp(alpha[i][:, :, None] + self.chain[None] + (x[i + 1] + beta[i + 1])[:, None, :] - z[i][:, None, None]).sum(0) if len(i) else np.zeros((2, 2))
        out: list[np.ndarray] = [None] * len(mats)  # type: ignore[list-item]
        for j, i in enumerate(order):
            out[i] = good[starts[j] : starts[j + 1]]
        return out, pair


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp(x.take(0, axis), x.take(1, axis))


def fit_chain(mats: list[np.ndarray], labels: list[np.ndarray], start: LineCRF, steps: int = 40, l2: float = 1e-3) -> LineCRF:
    """Maximise the conditional likelihood of the line labels by Adam steps on exact gradients."""
    x, y = np.concatenate(mats), np.concatenate(labels).astype(int)
    want = np.zeros((2, 2))
    for lab in labels:
        lab = lab.astype(int)
        np.add.at(want, (lab[:-1], lab[1:]), 1)
    n = len(y)
    hot = np.stack([1 - y, y], 1)
    p = [start.state.copy(), start.chain.copy()]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        good, pair = LineCRF(*p).marginals(mats)
        g = np.concatenate(good)
        grads = [x.T @ (hot - np.stack([1 - g, g], 1)) / n - l2 * p[0], (want - pair) / n - l2 * p[1]]
        for k, grad in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad**2
            p[k] = p[k] + 0.15 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return LineCRF(*p)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60, l2: float = 1e-3) -> np.ndarray:
    """Weights of a small logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    mass = weight / weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (mass * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (mass * (y - p)) - l2 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _summary(good: np.ndarray, length: np.ndarray) -> list[float]:
    """What the logistic curve reads of a document: length-weighted bad share, bad characters."""
    bad = float(((1 - good) * length).sum())
    return [1.0, np.log(bad / length.sum() + 1e-3), np.log1p(bad), float((1 - good).max())]


@dataclass
class QualityModel:
    crf: LineCRF | None
    curve: np.ndarray | None

    def scores(self, texts: list[str | None]) -> list[float]:
        """Quality of whole texts, 0 to 1."""
        if self.crf is None or not texts:
            return [0.5] * len(texts)
        pairs = [text_matrix(t) for t in texts]
        good, _ = self.crf.marginals([m for m, _ in pairs])
        x = np.array([_summary(g, n) for g, (_, n) in zip(good, pairs, strict=True)])
        return (1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))).tolist()

    def line_marginals(self, text: str | None) -> list[tuple[str, float]]:
        """(line, P(good)) of a whole text."""
        lines = (text or "").split("\n")
        if self.crf is None:
            return [(x, 0.5) for x in lines]
        return list(zip(lines, self.crf.marginals([text_matrix(text)[0]])[0][0].tolist(), strict=True))


def fit(rows: list[tuple[str, int]]) -> QualityModel:
    """Fit on (text, quality) rows."""
    y = np.array([q for _, q in rows])
    if len(set(y.tolist())) < 2:
        return QualityModel(None, None)
    pairs = [text_matrix(t) for t, _ in rows]
    mats, lengths = [m for m, _ in pairs], [n for _, n in pairs]
    x = np.concatenate(mats)
    doc = np.concatenate([np.full(len(m), q) for m, q in zip(mats, y, strict=True)])
    share = doc.mean()
    first = _logistic(x, doc.astype(float), np.where(doc == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)))
    crf = LineCRF(np.stack([np.zeros(N_FEATURES), first], 1), np.zeros((2, 2)))
    good = [1 / (1 + np.exp(-np.clip(m @ first, -30, 30))) for m in mats]
    for _ in range(ROUNDS):
        labels = []
        for g, q in zip(good, y, strict=True):
            lab = np.ones(len(g)) if q else (g >= 0.5).astype(float)
            if not q:
                lab[np.argmin(g)] = 0
            labels.append(lab)
        crf = fit_chain(mats, labels, crf)
        good = crf.marginals(mats)[0]
    s = np.array([_summary(g, n) for g, n in zip(good, lengths, strict=True)])
    return QualityModel(crf, _logistic(s, y.astype(float), np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = SAMPLE_ROWS, class_bytes: int = SAMPLE_BYTES,
          fold: tuple[int, int] | None = None) -> QualityModel:
    """Fit on at most ``per_class`` labelled rows and ``class_bytes`` bytes of each class, whole texts."""
    return fit(labelled_sample(docs, labels, label_col, per_class, class_bytes, fold=fold))


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text; narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(part.column(1).to_pylist()), pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")
