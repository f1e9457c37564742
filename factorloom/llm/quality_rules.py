"""Quality rules: document statistics, two hard rules, and gradient-boosted trees over the statistics.

The trees are grown here, in numpy, on a bounded sample of labelled documents; splits on features with a monotone
constraint are taken only where they keep its direction. The forest is flattened into node arrays (feature, threshold,
left, right, value) and scores whole batches by stepping all documents down all levels at once.

Defined results: a null or empty text has no words and fails the base rules; whole texts are read; repeated rows get
equal results; with no labelled documents (or labels of one kind) the trees reject nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACES, labelled_sample, map_rows, only, slices, trim

#: Labelled documents that the trees are grown on, at most.
SAMPLE = 20_000
#: Documents whose estimated chance of label 1 is under this are rejected.
KEEP_FROM = 0.5
SYMBOLS = "#*$%&|<>"
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))

#: Feature -> direction of its constraint: -1 where more of it may only lower the score.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "upper": -1, "exclaim": -1, "digits": -1, "distinct": 0, "bars": -1,
}


def _repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words that lie in a 3-word window found twice or more; distinct words."""
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if n < 4:
        return 0, len(seen)
    pair = np.unique(ids[:-2] * len(seen) + ids[1:-1], return_inverse=True)[1]
    _, where, count = np.unique(pair * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[where] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum()), len(seen)


def document_stats(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features of the trees."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(raw.count(bytes((c,))) for c in SPACES)
    symbols = sum(map(text.count, SYMBOLS))
    dup, lines, filled = 0, set(), 0
    for line in raw.split(b"\n"):
        if line.strip(SPACES):
            filled += 1
            dup += line in lines
            lines.add(line)
    repeat, distinct = _repeat_words(words)
    per, size = max(n, 1), max(len(raw), 1)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    digits = len(raw) - len(raw.translate(None, _DIGITS))
    x = (np.log1p(n), chars / per, symbols / per, dup / max(filled, 1), repeat / per, upper / size, text.count("!") / per, digits / size, distinct / per, text.count("|") / per)
    return (n, chars, symbols, dup, repeat), x


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


class BoostedTrees:
    """Logistic gradient boosting over quantile bins, with monotone constraints, as flat node arrays."""

    def __init__(self, constraints, rounds: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 32, least: int = 10, shrink: float = 1.0):
        self.constraints = np.asarray(constraints)
        self.rounds, self.depth, self.rate, self.bins, self.least, self.shrink = rounds, depth, rate, bins, least, shrink
        self.prior = 40.0  # nothing to learn from: keep
        self.roots = np.zeros(0, np.int64)
        self.nodes: dict[str, np.ndarray] = {}

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        if len(y) == 0 or y.min() == y.max():
            if len(y) and y.max() == 0:
                self.prior = -40.0
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.prior = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.prior)
        flat: list[list] = []
        roots = []
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            roots.append(len(flat))
            self._grow(flat, binned, cuts, prob - y, np.maximum(prob * (1 - prob), 1e-6), np.arange(len(y)), 0, -np.inf, np.inf, score)
        self.roots = np.array(roots)
        feature, threshold, left, right, value = map(np.array, zip(*flat, strict=True))
        self.nodes = {"feature": feature.astype(np.int64), "threshold": threshold, "left": left.astype(np.int64), "right": right.astype(np.int64), "value": value}
        return self

    def _grow(self, flat, binned, cuts, g, h, rows, level, low, high, score) -> int:
        """Adds the node of these rows and all below it; values stay within [low, high]. Rows with x <= threshold go left."""
        at = len(flat)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-total_g / (total_h + self.shrink), low, high))
        flat.append([0, np.inf, at, at, value * self.rate])
        best = None
        if level < self.depth and len(rows) >= 2 * self.least:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, j]
                cg, ch, cn = (np.cumsum(np.bincount(b, weights=w, minlength=len(c) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                vl = np.clip(-cg / (ch + self.shrink), low, high)
                vr = np.clip(-(total_g - cg) / (total_h - ch + self.shrink), low, high)
                gain = -(cg * vl + 0.5 * (ch + self.shrink) * vl**2) - ((total_g - cg) * vr + 0.5 * (total_h - ch + self.shrink) * vr**2)
                gain[(cn < self.least) | (len(rows) - cn < self.least) | (self.constraints[j] * (vr - vl) < 0)] = -np.inf
                k = int(np.argmax(gain))
                if np.isfinite(gain[k]) and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, k, vl[k], vr[k])
        none = -(total_g * value + 0.5 * (total_h + self.shrink) * value**2)
        if best is None or best[0] <= none + 1e-6:
            score[rows] += value * self.rate
            return at
        _, j, k, vl, vr = best
        mid, way = (vl + vr) / 2, self.constraints[j]
        goes = binned[rows, j] <= k
        left = self._grow(flat, binned, cuts, g, h, rows[goes], level + 1, mid if way < 0 else low, mid if way > 0 else high, score)
        right = self._grow(flat, binned, cuts, g, h, rows[~goes], level + 1, mid if way > 0 else low, mid if way < 0 else high, score)
        flat[at] = [j, float(cuts[j][k]), left, right, 0.0]
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 of each row: every document steps down every tree, a level at a time."""
        out = np.full(len(x), self.prior)
        if len(self.roots) and len(x):
            at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
            rows = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                f = self.nodes["feature"][at]
                at = np.where(x[rows, f] <= self.nodes["threshold"][at], self.nodes["left"][at], self.nodes["right"][at])
            out += self.nodes["value"][at].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> BoostedTrees:
    """Trees from at most ``limit`` labelled documents; only their statistics come to the driver."""
    rows = labelled_sample(docs, labels, "quality", limit)
    k = len(FEATURES)

    def make():
        return lambda b: {"y": b["y"], "x": [list(map(float, document_stats(t)[1])) for t in b["text"]]}

    got = map_rows(rows.select("text", "y"), "y int, x array<double>", make).collect()
    got.sort(key=lambda r: (r["y"], r["x"]))  # the same trees from the same rows in any order
    x = np.array([r["x"] for r in got], float).reshape(len(got), k)
    return BoostedTrees(list(FEATURES.values())).fit(x, np.array([r["y"] for r in got], float))


def judge(docs: DataFrame, model: BoostedTrees, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def batch(b):
            stats = [document_stats(t) for t in b["text"]]
            score = model.score(np.array([s[1] for s in stats], float).reshape(len(stats), len(FEATURES)))
            n, chars, symbols, dup, repeat = ([s[0][k] for s in stats] for k in range(5))
            failed = [base_failed(a, r) for a, r in zip(n, repeat, strict=True)]
            return {
                "doc_id": b["doc_id"], "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat,
                "base_failed": failed, "kept": [not f and bool(s >= keep_from) for f, s in zip(failed, score, strict=True)], "score": score,
            }

        return batch

    longs = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return map_rows(only(docs, doc_id=id_col, text=text_col), f"doc_id {kind}, {longs}, base_failed boolean, kept boolean, score double", make)


def keep_good(docs: DataFrame, model: BoostedTrees, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of docs, all columns as they are, that pass: texts are judged where they lie."""
    at = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column(at).to_pylist()
                stats = [document_stats(t) for t in texts]
                score = model.score(np.array([s[1] for s in stats], float).reshape(len(stats), len(FEATURES)))
                yield batch.filter(pa.array([not base_failed(s[0][0], s[0][4]) and bool(v >= keep_from) for s, v in zip(stats, score, strict=True)]))
        trim()

    return docs.mapInArrow(run, docs.schema)
