import math
import random
import zlib

import numpy as np

from factorloom.llm import toxicity as T


def corpus(n=400, seed=1):
    r = random.Random(0)
    words = ["".join(r.choice("aeioustrn") for _ in range(r.randrange(3, 8))) for _ in range(300)]
    r = random.Random(seed)
    rows = []
    for k in range(n):
        bad = k % 8 == 0
        t = [r.choice(words) for _ in range(60)] + ([f"vilest{r.choice(['', 'ly', 'ness'])}", "horrid"] if bad else [])
        r.shuffle(t)
        rows.append((k, " ".join(t), int(bad)))
    return rows


def rows_of(texts):
    return T.Rows([T.buckets(t) for t in texts])


def test_risk_by_brute_force():
    r = np.random.default_rng(2)
    log_loss = lambda z, y: math.log1p(math.exp(-y * z))
    negative = 0
    for _ in range(40):
        z_p, z_u = r.normal(r.normal(0, 3), 2, 6), r.normal(r.normal(0, 3), 2, 9)
        share_p, share_u = (x / x.sum() for x in (r.random(6), r.random(9)))
        prior = float(r.uniform(0.05, 0.8))

        def parts(z_p, z_u):
            plus = prior * sum(v * log_loss(z, 1) for v, z in zip(share_p, z_p))
            return plus, sum(v * log_loss(z, -1) for v, z in zip(share_u, z_u)) - prior * sum(v * log_loss(z, -1) for v, z in zip(share_p, z_p))

        plus, bracket = parts(z_p, z_u)
        risk, g_p, g_u = T.risk_and_slopes(z_p, z_u, share_p, share_u, prior)
        assert abs(risk - (plus + max(0, bracket))) < 1e-9
        target = (lambda a, b: sum(parts(a, b))) if bracket >= 0 else (lambda a, b: -parts(a, b)[1])
        negative += bracket < 0
        for z, g, swap in ((z_p, g_p, 0), (z_u, g_u, 1)):
            for k in range(len(z)):
                up, down = z.copy(), z.copy()
                up[k] += 1e-5
                down[k] -= 1e-5
                slope = (target(*((z_p, up) if swap else (up, z_u))) - target(*((z_p, down) if swap else (down, z_u)))) / 2e-5
                assert abs(slope - g[k]) < 1e-6
    assert 5 < negative < 35


def test_learns_from_positives_and_unlabelled():
    rows = corpus()
    m = T.NonNegativePU().fit(rows_of([t for _, t, y in rows if y]), rows_of([t for _, t, _ in corpus(seed=3)]))
    assert 0.06 < m.prior < 0.25
    fresh = corpus(seed=2)
    s = m.score([t for _, t, _ in fresh])
    assert all((v >= 0.7) == bool(y) for v, (*_, y) in zip(s, fresh))
    assert (m.score(["", None]) < 0.5).all()
    assert T.NonNegativePU().fit(rows_of([]), rows_of(["a"])).score(["a"])[0] < 1e-6


def test_scores_by_brute_force():
    m = T.NonNegativePU()
    m.bias, m.weights = -1.0, {f: 0.25 * (k + 1) for k, f in enumerate(T.features("horrid") + T.features("words"))}
    for t in ["horrid words", "horrid horrid", "horridly wordy", "", None, "x " * 60_000 + "horrid"]:
        present = {f for w in T.words(t) for f in T.features(w)}
        assert abs(m.score([t])[0] - 1 / (1 + math.exp(1 - sum(m.weights.get(f, 0) for f in present)))) < 1e-12
        assert abs(m.raw(rows_of([t]))[0] - (-1 + sum(m.weights.get(f, 0) for f in present))) < 1e-9


def test_copies_weigh_as_one():
    rows = [T.buckets("one long text of some words")] * 5 + [T.buckets("another text")]
    assert np.allclose(T.weights_of_copies(rows), [0.2] * 5 + [1])


def test_query(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, 1.0, "c") for k, t, _ in rows] + [(1000, None, 1.0, "c"), (1001, "", 1.0, "c"), (None, "horrid", 1.0, "c"), (0, rows[0][1], 1.0, "c"), (1002, "fine " * 50_000, 1.0, "c")], "doc_id long, text string, score double, h string")
    labels = spark.createDataFrame([(k, y, "c") for k, _, y in rows] + [(None, 1, "c"), (3, None, "c")], "doc_id long, toxic int, text string")
    out = T.classify(docs, T.fit(docs, labels))
    got = out.collect()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and len(got) == 405
    of = {r["doc_id"]: r for r in got}
    assert all(of[k]["predicted"] == y for k, _, y in rows) and len({r["score"] for r in got if r["doc_id"] == 0}) == 1
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in of.items() if k is not None) and not of[None]["held_out"]
    # a label 0 is never read
    flipped = T.fit(docs, labels.where("toxic = 1"))
    assert [r["score"] for r in T.classify(docs, flipped).collect()] == [r["score"] for r in got]
    assert T.classify(docs.limit(0), T.fit(docs, labels.limit(0))).count() == 0
