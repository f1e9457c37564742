"""Toxicity: non-negative positive-unlabelled learning of a linear classifier.

Training sees confirmed toxic documents (P) and unlabelled ones (U), a sample of the documents themselves drawn without a
look at any label: rows labelled 0 are never read. The risk ``prior * R_P+ + max(0, R_U- - prior * R_P-)`` is minimised
over a logistic model of word presence by gradient steps in numpy; where the bracket turns negative, the step goes the
other way, so that the model can't profit from it.

The class prior is estimated from P and U: over every region A, U(A) = prior P(A) + (1 - prior) N(A), so U(A) / P(A) never
falls below the prior and comes near it where only toxic texts are. The regions are the upper scores of models that tell P
from U, each half of the rows scored by a model of the other half.

Words, and their first letters, enter as features if a share of at least LEAST of P has them, at least LIFT times as large a
share as of U, and surely so (SURE deviations).

Defined results: null and empty texts have no words and score by the bias alone; whole texts are read; repeated rows get
equal scores; a score of THRESHOLD itself is predicted toxic; rows with a null id are not held out; with no confirmed
document every score is near 0; no rows give no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, hash_sample, labelled_sample, map_rows, only
from .quality_knn import model_of

#: Confirmed and unlabelled documents that are learned from, at most.
CONFIRMED, UNLABELLED = 6_000, 6_000
BUCKETS = 1 << 22
FEATURES = 3_000
LEAST = 0.03
#: Share of P that a region for the estimate of the prior holds at least.
REGION = 0.3
STEMS = (4, 5, 6)
LIFT = 2.0
#: Deviations, of a count like U's, by which P's share must be larger.
SURE = 4.0
PARTS, HELD = 3, 1
THRESHOLD = 0.7

_words = regex.compile(r"\p{L}+").findall


def features(word: str) -> list[int]:
    """Buckets of a word and of its first letters: many languages inflect what follows."""
    crc = zlib.crc32(word.encode("utf-8", "replace"))
    return [crc & (BUCKETS - 1)] + [zlib.crc32(b"-" + word[:n].encode("utf-8", "replace")) & (BUCKETS - 1) for n in STEMS if len(word) >= n]


def words(text: str | None) -> set[str]:
    return set(_words((text or "").lower()))


def buckets(text: str | None) -> np.ndarray:
    return np.unique(np.array([f for w in words(text) for f in features(w)], np.int32))


def weights_of_copies(rows: list[np.ndarray], marks: int = 3) -> np.ndarray:
    """One over the number of texts with the same few smallest buckets: near copies nearly always agree in them."""
    keys = [r[:marks].tobytes() for r in rows]
    n = Counter(keys)
    return np.array([1.0 / n[k] if k else 1.0 for k in keys])


class Rows:
    """Texts as sorted buckets, with weights: near copies share a row's worth, so that the words of one often copied text
    don't pass for toxic ones."""

    def __init__(self, rows: list[np.ndarray]):
        self.rows, share = rows, weights_of_copies(rows)
        self.share = share / max(share.sum(), 1e-12)
        self.mass = float(share.sum())

    def part(self, start: int, step: int) -> Rows:
        return Rows(self.rows[start::step])

    def shares(self) -> np.ndarray:
        """The share of rows that have each bucket."""
        out = np.zeros(BUCKETS)
        for r, v in zip(self.rows, self.share, strict=True):
            out[r] += v
        return out

    def over(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and feature of each one that a row has."""
        own = [p[p >= 0] for p in (place[r] for r in self.rows)]
        owner = np.repeat(np.arange(len(own)), [len(r) for r in own])
        return owner, np.concatenate(own).astype(np.int64) if own else np.zeros(0, np.int64)


def risk_and_slopes(z_p: np.ndarray, z_u: np.ndarray, share_p: np.ndarray, share_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk for scores of P and U under logistic loss, and the slopes that a step follows: those of the
    risk, or, where R_U- - prior R_P- is under zero, those that bring it back."""
    s_p, s_u = 1 / (1 + np.exp(-z_p)), 1 / (1 + np.exp(-z_u))
    loss = lambda z: np.logaddexp(0, z)
    bracket = float(share_u @ loss(z_u) - prior * share_p @ loss(z_p))
    risk = prior * float(share_p @ loss(-z_p)) + max(0.0, bracket)
    if bracket >= 0:
        return risk, prior * share_p * (s_p - 1) - prior * share_p * s_p, share_u * s_u
    return risk, prior * share_p * s_p, -share_u * s_u


class NonNegativePU:
    """weights of buckets and a bias; ``prior``: the estimated share of positives among unlabelled rows."""

    def __init__(self):
        self.weights: dict[int, float] = {}
        self.bias, self.prior = -20.0, 0.0
        self._of: dict[str, tuple[int, ...]] = {}

    def fit(self, confirmed: Rows, unlabelled: Rows, prior: float | None = None, steps: int = 2500, rate: float = 0.1, l2: float = 0.03) -> NonNegativePU:
        if not confirmed.rows or not unlabelled.rows:
            return self
        self.prior = float(np.clip(estimated_prior(confirmed, unlabelled) if prior is None else prior, 1e-3, 0.9))
        self._descend(confirmed, unlabelled, self.prior, steps, rate, l2)
        return self

    def _descend(self, confirmed: Rows, unlabelled: Rows, prior: float | None, steps: int, rate: float = 0.1, l2: float = 0.03) -> None:
        """Gradient steps on the risk; without a prior, on the plain loss of telling P from U, which weigh alike."""
        in_p, in_u = confirmed.shares(), unlabelled.shares()
        lift = in_p - in_u
        chance = np.maximum(in_u, 1 / unlabelled.mass)  # a share that few rows show by chance says nothing
        sure = lift > SURE * np.sqrt(chance / confirmed.mass)
        lift[(in_p < max(min(2.0, confirmed.mass) / confirmed.mass, LEAST)) | (in_p < LIFT * in_u) | ~sure] = 0
        chosen = np.argsort(-lift, kind="stable")[:FEATURES]
        chosen = chosen[lift[chosen] > 0]
        place = np.full(BUCKETS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        (own_p, at_p), (own_u, at_u) = confirmed.over(place), unlabelled.over(place)
        first = 0.5 if prior is None else prior
        w, b = np.zeros(len(chosen)), float(np.log(first / (1 - first)))
        m1, m2 = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
        for step in range(1, steps + 1):
            z_p = b + np.bincount(own_p, w[at_p], minlength=len(confirmed.rows))
            z_u = b + np.bincount(own_u, w[at_u], minlength=len(unlabelled.rows))
            if prior is None:
                g_p, g_u = confirmed.share * (1 / (1 + np.exp(-z_p)) - 1), unlabelled.share / (1 + np.exp(-z_u))
            else:
                _, g_p, g_u = risk_and_slopes(z_p, z_u, confirmed.share, unlabelled.share, prior)
            slope = np.bincount(at_p, g_p[own_p], minlength=len(chosen)) + np.bincount(at_u, g_u[own_u], minlength=len(chosen))
            g = np.append(slope + l2 / confirmed.mass * w, g_p.sum() + g_u.sum())
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        self.weights = {int(c): float(v) for c, v in zip(chosen, w, strict=True) if abs(v) > 1e-3}
        self.bias = float(b)

    def raw(self, rows: Rows) -> np.ndarray:
        place = np.full(BUCKETS, -1, np.int32)
        place[list(self.weights)] = np.arange(len(self.weights))
        owner, at = rows.over(place)
        return self.bias + np.bincount(owner, np.array(list(self.weights.values()))[at], minlength=len(rows.rows)) if self.weights else np.full(len(rows.rows), self.bias)

    def known(self, word: str) -> tuple[int, ...]:
        """The word's buckets that have a weight; kept, as most words come again and have none."""
        got = self._of.get(word)
        if got is None:
            if len(self._of) > 300_000:
                self._of.clear()
            got = self._of[word] = tuple(f for f in features(word) if f in self.weights)
        return got

    def score(self, texts: list) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for k, t in enumerate(texts):
            found = {f for w in words(t) if (own := self.known(w)) for f in own}
            z[k] += sum(sorted(self.weights[f] for f in found))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def estimated_prior(confirmed: Rows, unlabelled: Rows, steps: int = 300) -> float:
    """The least U(A) / P(A) over the upper scores that REGION of P reach at least, halves scored by each other's model."""
    if len(confirmed.rows) < 4 or len(unlabelled.rows) < 4:
        return confirmed.mass / (confirmed.mass + unlabelled.mass)
    z_p, z_u, share_p, share_u = [], [], [], []
    for own in (0, 1):
        m = NonNegativePU()
        m._descend(confirmed.part(1 - own, 2), unlabelled.part(1 - own, 2), None, steps)
        p, u = confirmed.part(own, 2), unlabelled.part(own, 2)
        z_p.append(m.raw(p))
        z_u.append(m.raw(u))
        share_p.append(p.share / 2)
        share_u.append(u.share / 2)
    z_p, z_u, share_p, share_u = map(np.concatenate, (z_p, z_u, share_p, share_u))
    least = 1.0
    for cut in np.unique(z_p):
        of_p, of_u = share_p[z_p >= cut].sum(), share_u[z_u >= cut].sum()
        if of_p >= REGION:
            least = min(least, of_u / of_p)
    return float(least)


def fit(docs: DataFrame, labels: DataFrame, limit: int = CONFIRMED, unlabelled: int = UNLABELLED, prior: float | None = None) -> NonNegativePU:
    """P: at most ``limit`` rows labelled 1 outside the held-out fold. U: at most ``unlabelled`` other rows of docs outside
    it, by hash, whatever their labels. Only their buckets, as bytes, come to the driver."""

    def make():
        return lambda b: {"h": b["h"], "at": [buckets(t).tobytes() for t in b["text"]]}

    def rows(df: DataFrame) -> Rows:
        got = map_rows(df.select("h", "text"), "h long, at binary", make).toArrow().to_pylist()
        got.sort(key=lambda r: (r["h"], r["at"]))
        return Rows([np.frombuffer(r["at"], np.int32) for r in got])

    confirmed = labelled_sample(docs, labels.where("toxic = 1"), "toxic", limit, PARTS, HELD).select(F.xxhash64("doc_id").alias("h"), "text")
    free = docs.select("doc_id", "text").where(F.coalesce(fold("doc_id", PARTS), F.lit(0)) != HELD)
    return NonNegativePU().fit(rows(confirmed), rows(hash_sample(free, ["doc_id", "text"], unlabelled)), prior)


def classify(docs: DataFrame, model: NonNegativePU, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text. No shuffle."""
    held = model_of(docs, model)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        m = held.value

        def batch(b):
            s = m.score(b["text"])
            return {"doc_id": b["doc_id"], "score": s, "predicted": (s >= threshold).astype(int)}

        return batch

    out = map_rows(only(docs, doc_id=id_col, text=text_col), f"doc_id {kind}, score double, predicted int", make)
    return out.select("doc_id", (F.coalesce(fold("doc_id", PARTS), F.lit(0)) == HELD).alias("held_out"), "score", "predicted")
