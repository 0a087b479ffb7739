"""Toxicity by weak supervision.

Many voters look at a text: fixed lexicons by language and kind, patterns around lexicon words, and
stems found in labelled rows. A generative label model (latent class, one voter matrix) estimates
each voter's accuracy by EM, the share of toxic rows, and the correlations that are left between voters given the class; a
voter's evidence is divided by how many others it repeats. Most rows of a corpus have no label, and EM needs
only how many rows vote alike: Spark counts the vote patterns of all rows without a label, whole texts, and there are
at most 2^(voters that can say yes) patterns, whatever the corpus. A known label is one more vote for its row. A linear
classifier over words and word beginnings is trained on the posterior labels of the labelled rows, weighted to the
corpus's share, and scores texts by one weighted lookup per word.

Labelled rows are a bounded, documented sample; patterns are counted, and scores given, over every row.

Defined results: a null or empty text has no features and gets the classifier's base score;
repeated rows and null ids each give their own row; with no labelled rows the lexicons alone vote;
other columns of the input are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, labelled_sample, slices

#: Bounds of the fit: labelled rows per class, whole ones, and the bytes of each class together.
SAMPLE_ROWS = 2500
SAMPLE_BYTES = 8_000_000
#: How often a known label is taken to be right.
LABEL_ACCURACY = 0.999
#: The least weight of known rows in the label model, in proportion to that of the unlabelled rows of their class.
ANCHOR = 0.25
#: Beginnings of words that are features beside the words.
STEMS = (4, 5, 6)
MAX_FEATURES = 4000
#: A feature must differ between the classes by so many standard errors.
MIN_Z = 5.0
#: Words whose features a worker remembers.
MEMO_WORDS = 300_000
DISCOVERED_VOTERS = 6
#: Terms are dealt to the voters from so many stems at most.
DISCOVERED_STEMS = 960
#: Terms say something where chance gives that many of them to so many words less often than this.
CHANCE = 0.001

#: General terms of abuse, by language and kind.
LEXICONS = {
    "en_stupid": "idiot idiots moron morons stupid imbecile dumb dumbass fool fools retard cretin dimwit halfwit",
    "en_worth": "loser losers worthless pathetic useless failure nobody coward",
    "en_filth": "scum trash garbage filth vermin parasite pig pigs rat rats",
    "en_disgust": "disgusting vile repulsive revolting gross sickening",
    "en_mock": "clown clowns joke freak weirdo creep jerk",
    "en_swear": "fuck fucking shit bitch bastard asshole cunt whore slut damn crap",
    "en_threat": "kill die hang burn hate hurt",
    "de_abuse": "idiot trottel dummkopf arschloch schlampe hurensohn abschaum drecksau vollidiot depp wichser",
    "fr_abuse": "idiot imbécile connard connasse salope abruti crétin ordure merde débile putain",
    "es_abuse": "idiota imbécil estúpido estúpida cabrón puta mierda gilipollas basura payaso asqueroso",
}
_WORD = re.compile(r"[^\W\d_]+")
_AT_PERSON = re.compile(r"\b(?:you|your|he|she|they|this|that|these|du|ihr|tu|vous|toi|eres|usted)\W+(?:\w+\W+){0,2}?(%s)\b" % "|".join(sorted({w for v in LEXICONS.values() for w in v.split()})), re.I)


def word_counts(text: str | None) -> Counter:
    """Lower-case words of letters and their counts."""
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def features(words: Counter | set) -> set[str]:
    """Words, and word beginnings marked by their length."""
    out = set(words)
    for n in STEMS:
        out.update(f"{n}:{w[:n]}" for w in words if len(w) > n)
    return out


# --- voters -----------------------------------------------------------------------------------------


def beyond_chance(hits: int, mean: float) -> bool:
    """``hits`` or more come up by chance (Poisson with ``mean``) less often than CHANCE."""
    term, below = math.exp(-mean), 0.0
    for i in range(hits):
        below += term
        term *= mean / (i + 1)
    return 1 - below < CHANCE


@dataclass
class Voters:
    """Votes are 1 (toxic), -1 (not) or 0 (no opinion).

    ``rates``: how many terms of all lexicons, and of each group of stems, chance gives to a distinct word.
    """

    discovered: list[set[str]] = field(default_factory=list)
    rates: list[float] = field(default_factory=lambda: [0.001])

    def names(self) -> list[str]:
        return [*LEXICONS, "at_person", "many_terms", "no_term", *(f"stems_{i}" for i in range(len(self.discovered)))]

    def votes(self, text: str | None) -> list[int]:
        words = set(word_counts(text))
        found = features(words)
        return self.decide(*lexicon_hits(text, found, len(words)), [len(found & group) for group in self.discovered])

    def decide(self, hits: list[int], at_person: bool, words: int, stems: list[int]) -> list[int]:
        """Votes from the terms of each lexicon, whether one is said of a person, the number of distinct words and the stems of each group."""
        total = sum(hits)
        many = total >= 2 and beyond_chance(total, self.rates[0] * words)
        dense = [h > 0 and beyond_chance(h, r * words) for h, r in zip(stems, self.rates[1:], strict=True)]
        return [int(h > 0) for h in hits] + [int(at_person), int(many), -int(total + sum(stems) == 0)] + [int(x) for x in dense]


def lexicon_hits(text: str | None, found: set[str], words: int) -> tuple[list[int], bool, int]:
    hits = [len(found & terms) for terms in _TERMS]
    return hits, bool(sum(hits) and text and _AT_PERSON.search(text)), words


_TERMS = [set(v.split()) for v in LEXICONS.values()]


class FeatureRows:
    """The distinct features of rows as numbers, four bytes each: sets of words would be many times as large."""

    def __init__(self, texts: Iterable[str]):
        self.numbers: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.hits: list[tuple[list[int], bool, int]] = []
        for text in texts:
            words = set(word_counts(text))
            found = features(words)
            self.rows.append(np.fromiter((self.numbers.setdefault(f, len(self.numbers)) for f in found), np.int32, len(found)))
            self.hits.append(lexicon_hits(text, found, len(words)))
        self.names = list(self.numbers)

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """How many of the chosen rows hold each feature."""
        some = [r for r, take in zip(self.rows, rows, strict=True) if take]
        return np.bincount(np.concatenate(some), minlength=len(self.names)) if some else np.zeros(len(self.names), np.int64)

    def held(self, group: set[str]) -> list[int]:
        """How many features of a group each row holds."""
        inside = np.zeros(len(self.names) + 1, bool)
        inside[[self.numbers[f] for f in group if f in self.numbers]] = True
        return [int(inside[r].sum()) for r in self.rows]


def discover(found: FeatureRows, known: np.ndarray, groups: int = DISCOVERED_VOTERS) -> list[set[str]]:
    """Features that toxic rows hold far more often than others, dealt to ``groups`` voters by rank."""
    yes, no = found.counts(known == 1), found.counts(known == 0)
    n_yes, n_no = max(1, int((known == 1).sum())), max(1, int((known == 0).sum()))
    odds = ((yes + 0.5) / (n_yes + 1)) / ((no + 0.5) / (n_no + 1))
    best = sorted(np.flatnonzero((yes >= 5) & (odds >= 20)), key=lambda i: (-odds[i], found.names[i]))[:DISCOVERED_STEMS]
    names = [found.names[i] for i in best]
    return [g for i in range(groups) if (g := set(names[i::groups]))]


# --- label model ------------------------------------------------------------------------------------


@dataclass
class LabelModel:
    """Latent class model of a voter matrix with estimated accuracies and correlations."""

    prior: float
    rates: np.ndarray  # [2 classes, voters, 3 votes]: P(vote | class)
    accuracy: np.ndarray  # of each voter, where it votes
    correlation: np.ndarray  # between voters, given the class
    weight: np.ndarray  # share of its evidence that a voter brings anew

    def posterior(self, votes: np.ndarray, clamp: np.ndarray | None = None) -> np.ndarray:
        at = votes + 1
        logs = np.log(self.rates)
        evidence = sum(self.weight[j] * (logs[1, j, at[:, j]] - logs[0, j, at[:, j]]) for j in range(votes.shape[1]))
        z = np.log(self.prior / (1 - self.prior)) + evidence
        if clamp is not None:  # a known label is one more voter
            z = z + np.where(clamp >= 0, (2 * clamp - 1) * np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY)), 0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_label_model(votes: np.ndarray, known: np.ndarray, prior: float | None, rounds: int = 25, counts: np.ndarray | None = None, anchor: float = 0.0) -> LabelModel:
    """EM over the rows, of which each stands for ``counts`` equal ones; ``known`` holds 0, 1 or -1 (unlabelled).

    Without a ``prior`` it is the share of toxic rows among the unlabelled ones, or the known ones if there are no others.
    With an ``anchor`` known rows of both classes hold them: EM starts from their rates, and in each class they weigh at least that
    share of the unlabelled rows in it, so a habit of many rows (a word of one language that is a term of another) is not taken for the class.
    """
    k = votes.shape[1]
    counts = np.ones(len(votes)) if counts is None else counts.astype(float)
    n, learn = counts.sum(), prior is None
    of = counts * (known < 0) if (known < 0).any() else counts
    score = np.clip(votes, -1, 1).sum(1)
    post = np.where(known >= 0, known * 0.94 + 0.03, np.where(score > 0, 0.9, 0.05)).astype(float)
    anchored = anchor > 0 and (known == 0).any() and (known == 1).any() and (known < 0).any()
    weight = np.ones(k)
    model = None
    for step in range(rounds):
        if learn:
            prior = float(np.clip((of * post).sum() / of.sum(), 0.005, 0.5))
        rates = np.empty((2, k, 3))
        for y, w in ((0, counts * (1 - post)), (1, counts * post)):
            if anchored:
                own = known == y
                w = np.where(known < 0, w * (step > 0), np.where(own, max(1.0, anchor * w[known < 0].sum() / (own * counts).sum()) * counts, 0))
            for v in (-1, 0, 1):
                rates[y, :, v + 1] = ((votes == v) * w[:, None]).sum(0) + 0.5
        rates /= rates.sum(2, keepdims=True)
        # Correlations given the class: of the residuals of each vote from its expectation.
        values = np.array([-1, 0, 1])
        mean = rates @ values
        resid = votes - (post[:, None] * mean[1] + (1 - post)[:, None] * mean[0])
        sd = np.sqrt((counts[:, None] * resid**2).sum(0) / n) + 1e-9
        corr = (resid.T @ (counts[:, None] * resid)) / n / np.outer(sd, sd)
        np.fill_diagonal(corr, 1)
        weight = 1 / np.maximum(1, (np.clip(corr, 0, 1) ** 2).sum(0))
        says = np.stack([rates[1, :, 2] * prior, rates[0, :, 2] * (1 - prior), rates[0, :, 0] * (1 - prior), rates[1, :, 0] * prior])
        accuracy = (says[0] + says[2]) / says.sum(0)
        model = LabelModel(prior, rates, accuracy, corr, weight)
        new = model.posterior(votes, known)
        if np.abs(new - post).max() < 1e-4:
            break
        post = new
    return model


# --- classifier -------------------------------------------------------------------------------------


class _WordFeatures(dict):
    """Word -> those of its features that have a weight, remembered for a bounded number of words."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = out = tuple(f for f in features({word}) if f in self.weights)
        return out


@dataclass
class LinearModel:
    bias: float
    weights: dict[str, float]

    def __post_init__(self) -> None:
        self._memo = _WordFeatures(self.weights)

    def __reduce__(self):
        return LinearModel, (self.bias, self.weights)

    def score(self, words: set[str]) -> float:
        """Of a text with these distinct words."""
        found: set[str] = set()
        for own in map(self._memo.__getitem__, words):
            if own:
                found.update(own)
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-max(-40.0, min(40.0, z)))))


def fit_linear(found: FeatureRows, target: np.ndarray, row_weight: np.ndarray, rounds: int = 300, l2: float = 0.1) -> LinearModel:
    """L2-regularised logistic regression on soft labels by accelerated gradient steps."""
    n, n_yes = len(found.rows), max(1.0, float((target > 0.5).sum()))
    counts, toxic = found.counts(np.ones(n, bool)), found.counts(target > 0.5)
    p, q, share = toxic / n_yes, (counts - toxic) / max(1.0, n - n_yes), counts / n
    lift = np.abs(p - q) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n_yes + 1 / max(1.0, n - n_yes)))
    best = sorted(np.flatnonzero((counts >= 4) & (lift >= MIN_Z)), key=lambda i: (-lift[i], found.names[i]))[:MAX_FEATURES]
    vocab = {found.names[i]: j for j, i in enumerate(best)}
    column = np.full(len(found.names), -1)
    column[best] = np.arange(len(best))
    cols = [c[c >= 0] for c in (column[r] for r in found.rows)]
    rows = np.repeat(np.arange(n), [len(c) for c in cols])
    cols = np.concatenate(cols) if cols else np.zeros(0, np.int64)

    w, b, k = np.zeros(len(vocab)), 0.0, len(vocab)
    mass = row_weight / row_weight.sum()
    # Each feature's step suits its own curvature, as long texts hold many features.
    per_row = np.bincount(rows, minlength=n) + 1.0
    curve = np.bincount(cols, weights=(mass * per_row)[rows], minlength=k) / 4 + l2 / n
    vw, vb, pw, pb = w, b, w, b
    for t in range(rounds):
        z = np.bincount(rows, weights=vw[cols], minlength=n) + vb
        err = mass * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target)
        w = vw - (np.bincount(cols, weights=err[rows], minlength=k) + l2 / n * vw) / curve
        b = vb - err.sum() / max(1e-9, (mass * per_row).sum() / 4)
        m = t / (t + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        pw, pb = w, b
    return LinearModel(b, {f: float(w[i]) for f, i in vocab.items() if abs(w[i]) > 1e-4})


@dataclass
class ToxicityModel:
    voters: Voters
    labels: LabelModel
    linear: LinearModel

    def score(self, text: str | None) -> float:
        return self.linear.score(set(_WORD.findall(text.lower())) if text else set())


@dataclass
class Evidence:
    """Labelled rows, the voters made from them, and their votes."""

    found: FeatureRows
    known: np.ndarray
    voters: Voters
    votes: np.ndarray


def evidence(rows: list[tuple[str, int]]) -> Evidence:
    """Voters of (text, label) rows; chance is what rows of label 0 hold."""
    rows = rows or [("", 0), ("idiot", 1)]
    known = np.array([y for _, y in rows])
    found = FeatureRows(t for t, _ in rows)
    groups = discover(found, known)
    stems = list(zip(*map(found.held, groups), strict=True)) or [()] * len(rows)
    words, hits = 1000, np.ones(1 + len(groups))
    for (own, _, n), held, y in zip(found.hits, stems, known, strict=True):
        if y == 0:
            words += n
            hits += [sum(own), *held]
    voters = Voters(groups, (hits / words).tolist())
    return Evidence(found, known, voters, np.array([voters.decide(*h, list(x)) for h, x in zip(found.hits, stems, strict=True)]))


def fit(rows: list[tuple[str, int]], prior: float | None = None) -> ToxicityModel:
    """Fit voters, label model and classifier on labelled (text, label) rows alone."""
    return finish(evidence(rows), [], prior)


def finish(seen: Evidence, patterns: list[tuple[list[int], int]], prior: float | None = None) -> ToxicityModel:
    """The model from labelled rows and the (votes, rows) of unlabelled ones."""
    votes = np.concatenate([seen.votes, np.array([v for v, _ in patterns], np.int64).reshape(-1, seen.votes.shape[1])])
    known = np.concatenate([seen.known, np.full(len(patterns), -1)])
    counts = np.concatenate([np.ones(len(seen.known)), [n for _, n in patterns]])
    model = fit_label_model(votes, known, prior, counts=counts, anchor=ANCHOR)
    post = model.posterior(seen.votes, seen.known)
    share = post.mean()
    weight = np.where(post > 0.5, model.prior / max(share, 1e-6), (1 - model.prior) / max(1 - share, 1e-6))
    return ToxicityModel(seen.voters, model, fit_linear(seen.found, post, weight))


def vote_patterns(docs: DataFrame, voters: Voters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pattern) of every whole text: its votes as bytes, each one more than the vote; narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)  # bounded by DISCOVERED_STEMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = shared.value.votes
        for part in slices(batches):
            made = [bytes(v + 1 for v in votes(t)) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["_id", "pattern"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "_id long, pattern binary")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = SAMPLE_ROWS, class_bytes: int = SAMPLE_BYTES,
          fold: tuple[int, int] | None = None) -> ToxicityModel:
    """Fit on at most ``per_class`` labelled rows of each class, whole texts, and the votes of all rows of the fold that have no label."""
    seen = evidence(labelled_sample(docs, labels, label_col, per_class, class_bytes, fold=fold))
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    if fold:
        rows = rows.where(crc_mod(F.col("doc_id").cast("long"), fold[0]) != fold[1])
    labelled = labels.where(F.col(label_col).isNotNull()).select(F.col("doc_id").cast("long").alias("_id")).distinct()
    counted = vote_patterns(rows, seen.voters).join(labelled, "_id", "left_anti").groupBy("pattern").count().collect()
    return finish(seen, sorted(([v - 1 for v in r[0]], r[1]) for r in counted))


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text; narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([score(t) for t in part.column(1).to_pylist()], pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")
