"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Each text becomes counts of terms in two families of one space: its words (hashed, times ln(1 + N / df) over the labelled
rows), and its forms (shapes of words, pairs of shapes, words that repeat the one before, words said before). Counts are
damped, each family has its share of the unit vector, and a truncated SVD of the labelled rows, by subspace iteration over
the sparse counts, gives the latent space. The labelled vectors, at most SAMPLE of DIMS numbers, are broadcast; every
document's cosines with all of them are computed exactly, in blocks, and the NEIGHBOURS nearest vote with their similarity
as weight.

Defined results: a text without words, null or empty, scores 0: it says nothing, so it can't be good; a text none of whose
terms a labelled row has, and every text if nothing is labelled, gets the share of label 1 among the labelled rows (0.5
without any). Cosines are rounded to five digits, and ties go to the labelled row of smaller doc_id. Repeated rows get equal
results; rows with a null id are not held out; a labelled id counts once; no rows give no rows; other columns, whatever
their names, are left out.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, map_rows, only

SAMPLE = 6_000
#: Buckets of words, and after them those of forms; the forms' share of a unit vector's square.
WORDS, FORMS = 1 << 15, 1 << 12
FORM_SHARE = 0.7
DIMS = 32
ROUNDS = 4
NEIGHBOURS = 25
POWER = 8
PARTS, HELD = 5, 0
THRESHOLD = 0.3

EDGES = ".,;:!?\"'()[]{}«»„“”…"
_RUNS = re.compile(r"[^\W\d_]+|\d+|(\W)\1*", re.S)
#: Longer words, and words of more marks, are several shapes, one after another.
CHARS, MARKS = 200, 6
_shapes: dict[str, list[str]] = {}


def shapes_of(word: str) -> list[str]:
    """Letters by case, digits, and runs of one symbol, each as one mark: 'The' -> 'Aa', 'end###' -> 'a#+'. The whole word counts."""
    if len(word) > CHARS:
        return [s for at in range(0, len(word), CHARS) for s in shapes_of(word[at : at + CHARS])]
    got = _shapes.get(word)
    if got is None:
        marks = []
        for m in _RUNS.finditer(word):
            run = m.group()
            if run[0].isalpha():
                marks.append("a" if run.islower() else "A" if run.isupper() and len(run) > 1 else "Aa" if run[0].isupper() else "x")
            elif run[0].isdigit():
                marks.append("0")
            else:
                marks.append(run[0] + "+" * (len(run) > 1))
        got = ["".join(marks[at : at + MARKS]) for at in range(0, max(len(marks), 1), MARKS)]
        if len(_shapes) > 200_000:
            _shapes.clear()
        _shapes[word] = got
    return got


def shape(word: str) -> str:
    """The first shape of a word."""
    return shapes_of(word)[0]


_ids: dict[tuple, int] = {}


def _bucket(*term: str) -> int:
    """One string: a word; more: a form."""
    got = _ids.get(term)
    if got is None:
        if len(_ids) > 100_000:
            _ids.clear()
        crc = zlib.crc32("\x1f".join(term).encode("utf-8", "replace"))
        got = _ids[term] = crc % WORDS if len(term) == 1 else WORDS + crc % FORMS
    return got


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and damped counts of a whole text, both families of unit length."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    shapes = [s for w in words for s in shapes_of(w)]
    found = [_bucket("shape", s) for s in shapes]
    found += [_bucket("pair", a, b) for a, b in zip(shapes, shapes[1:], strict=False)]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    found += [_bucket("", "same")] * (3 * same)
    # the share of new words falls where a text says the same again and again
    found += [_bucket("", "seen")] * (len(words) - len(set(words)))
    found += [_bucket(w.strip(EDGES).lower()) for w in words]
    at, n = np.unique(np.array(found, np.int32), return_counts=True)
    w = np.sqrt(n.astype(np.float32))
    form = at >= WORDS
    for part in (form, ~form):
        w[part] /= np.sqrt(n[part].sum())
    return at, w


class Voter:
    """base: share of label 1; scale, axes: from terms to the latent space; vectors, y: the labelled rows in it (unit length)."""

    def __init__(self, base: float = 0.5):
        self.base, self.scale, self.axes, self.vectors, self.y = base, None, None, None, None

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Voter:
        """rows: the terms of labelled texts, in the order that decides ties."""
        if not len(y):
            return self
        self.base = float(y.mean())
        full = [k for k, (at, _) in enumerate(rows) if len(at)]
        rows, y = [rows[k] for k in full], y[full]
        if not len(y):
            return self
        df = np.bincount(np.concatenate([at for at, _ in rows]), minlength=WORDS + FORMS)
        self.scale = np.where(df > 0, np.log1p(len(rows) / np.maximum(df, 1)), 0).astype(np.float32)
        self.scale[WORDS:] = df[WORDS:] > 0
        scaled = [self._scaled(at, w) for at, w in rows]
        ends = np.cumsum([0] + [len(w) for w in scaled])
        at, w = np.concatenate([a for a, _ in rows]), np.concatenate(scaled)
        owner = np.repeat(np.arange(len(rows)), np.diff(ends))
        used, place = np.unique(at, return_inverse=True)
        dims = min(DIMS, len(used), len(rows))

        def times(axes: np.ndarray) -> np.ndarray:
            return np.stack([np.bincount(owner, w * axes[place, d], minlength=len(rows)) for d in range(dims)], axis=1)

        axes = np.linalg.qr(np.random.default_rng(1).standard_normal((len(used), dims)))[0]
        for _ in range(ROUNDS):
            z = times(axes)
            axes = np.linalg.qr(np.stack([np.bincount(place, w * z[owner, d], minlength=len(used)) for d in range(dims)], axis=1))[0]
        # the singular directions within the space found
        _, turn = np.linalg.eigh((z := times(axes)).T @ z)
        self.axes = np.zeros((WORDS + FORMS, dims), np.float32)
        self.axes[used] = axes @ turn[:, ::-1]
        self.vectors = np.stack([self.project(a, v) for a, v in rows])
        self.y = y.astype(np.float32)
        return self

    def _scaled(self, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Weights of terms: each family scaled to its share; those that no labelled row has count 0."""
        w = w * self.scale[at]
        form = at >= WORDS
        for part, share in ((form, FORM_SHARE), (~form, 1 - FORM_SHARE)):
            w[part] *= np.sqrt(share / max(float((w[part] ** 2).sum()), 1e-12))
        return w

    def project(self, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """A text's unit vector; zero if the labelled rows have none of its terms."""
        z = self._scaled(at, w) @ self.axes[at]
        return z / max(float(np.linalg.norm(z)), 1e-9)

    def nearest(self, cos: np.ndarray) -> np.ndarray:
        """Of each row of cosines the places of the NEIGHBOURS largest, the first of equal ones first."""
        k = min(NEIGHBOURS, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(cos, near, axis=1).min(axis=1, keepdims=True)
        for row in np.flatnonzero((cos >= least).sum(axis=1) > k):
            over = np.flatnonzero(cos[row] > least[row])
            near[row] = np.append(over, np.flatnonzero(cos[row] == least[row])[: k - len(over)])
        return near

    def score(self, texts: list, block: int = 128) -> np.ndarray:
        found = [terms(t) for t in texts]
        out = np.array([self.base if len(at) else 0.0 for at, _ in found], float)
        if self.axes is None:
            return out
        for start in range(0, len(texts), block):
            some = [k for k in range(start, min(len(texts), start + block)) if len(found[k][0])]
            z = np.array([self.project(*found[k]) for k in some], np.float32).reshape(len(some), -1)
            known = z.any(axis=1)
            some, z = np.array(some, int)[known], z[known]
            if len(some):
                cos = np.round(z @ self.vectors.T, 5)
                near = self.nearest(cos)
                w = np.maximum(np.take_along_axis(cos, near, axis=1), 1e-6) ** POWER
                out[some] = (w * self.y[near]).sum(axis=1) / w.sum(axis=1)
        return out


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Voter:
    """From at most ``limit`` labelled rows outside the held-out fold; only their terms, as bytes, come to the driver."""
    rows = labelled_sample(docs, labels, "quality", limit, PARTS, HELD)

    def make():
        def batch(b):
            got = [terms(t) for t in b["text"]]
            return {"doc_id": b["doc_id"], "y": b["y"], "at": [a.tobytes() for a, _ in got], "w": [w.tobytes() for _, w in got]}

        return batch

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = map_rows(rows, f"doc_id {kind}, y int, at binary, w binary", make).toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["at"]))
    return Voter().fit([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["w"], np.float32)) for r in got], np.array([r["y"] for r in got], np.float32))


def classify(docs: DataFrame, model: Voter, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text. No shuffle; the model is broadcast (bounded above)."""
    held = model_of(docs, model)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        m = held.value

        def batch(b):
            s = m.score(b["text"])
            return {"doc_id": b["doc_id"], "score": s, "predicted": (s >= threshold).astype(int)}

        return batch

    out = map_rows(only(docs, doc_id=id_col, text=text_col), f"doc_id {kind}, score double, predicted int", make)
    return out.select("doc_id", (F.coalesce(fold("doc_id", PARTS), F.lit(1)) == HELD).alias("held_out"), "score", "predicted")


def model_of(docs: DataFrame, model):
    return docs.sparkSession.sparkContext.broadcast(model)
