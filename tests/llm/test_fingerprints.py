import hashlib
import random

import numpy as np
import pytest

from factorloom.llm import fingerprints as FP


def plain_inverse(texts):
    df = np.zeros(FP.BUCKETS)
    for t in texts:
        for b in {FP.bucket(w) for w in FP.split(t)}:
            df[b] += 1
    return np.log1p(len(texts) / np.maximum(df, 1))


def weighted_jaccard(a, b, inverse):
    of = [{w: t.count(w) * inverse[FP.bucket(w)] for w in t} for t in (a, b)]
    keys = set(of[0]) | set(of[1])
    return sum(min(x.get(k, 0) for x in of) for k in keys) / sum(max(x.get(k, 0) for x in of) for k in keys)


def test_collision_rate_is_generalised_jaccard_at_the_queries_size():
    r = random.Random(3)
    words = [f"w{k}".encode() for k in range(300)]
    inverse = np.log1p(np.random.default_rng(5).uniform(0.5, 400, FP.BUCKETS))
    s, off = FP.Sampler(inverse), []
    for k in range(120):
        pool = r.sample(words, 120)
        x = [w for w in pool[:100] for _ in range(r.choice((1, 1, 2, 5)))]
        y = [w for w in pool[k % 90 :] for _ in range(r.choice((1, 1, 2, 5)))]
        off.append(FP.likeness(s.marks(x), s.marks(y)) - weighted_jaccard(x, y, inverse))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.035 and np.abs(off).max() < 0.13


def test_draws_follow_their_distributions():
    s = FP.Sampler(samples=64)
    h, value, t = s.samples_of([f"x{k}".encode() for k in range(4000)])
    assert len(set(h.tolist())) == 4000 and (t == 0).all()  # ln 1 = 0: t = floor(b)
    r, c, b = (x.astype(float) for x in s.draws(h))
    assert np.allclose(value, np.log(c) - r * (1 - b), atol=1e-4)
    for x in (r, c):  # Gamma(2, 1)
        assert abs(x.mean() - 2) < 0.02 and abs(x.var() - 2) < 0.05
    assert abs(b.mean() - 0.5) < 0.005 and abs(b.var() - 1 / 12) < 0.002
    for x, y in ((r, c), (r, b), (c, b)):
        assert abs(np.corrcoef(x.ravel(), y.ravel())[0, 1]) < 0.01
    # nor do the draws know of one another
    over = np.corrcoef(value.T) - np.eye(64)
    assert np.abs(over).max() < 0.09 and abs(over.mean()) < 0.002


def test_kept_terms_do_not_change_samples(monkeypatch):
    r = random.Random(1)
    texts = [[f"w{r.randrange(900)}".encode() for _ in range(200)] for _ in range(30)]
    whole = FP.Sampler()
    want = [whole.marks(t) for t in texts]
    monkeypatch.setattr(FP, "KEPT", 64)
    monkeypatch.setattr(FP, "PART", 32)
    small = FP.Sampler()
    assert all((small.marks(t) == w).all() for t, w in zip(texts, want, strict=True))


@pytest.mark.parametrize("n", [1, 2, 300])
def test_next_documents(spark, n):
    r = random.Random(n)
    docs = [(r.randrange(10**6) if n > 2 else k, " ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(r.randrange(0, 30)))) for k in range(n)]
    if n > 2:
        docs += [(docs[0][0], docs[0][1]), (10**7, None), (10**12, "far away"), (-(10**12), "far before"), (5, "long " * 40_000)]
        docs += [(None, f"null id {k} " * (k % 4)) for k in range(200)] + [(777, f"same id {k}") for k in range(200)]
    df = spark.createDataFrame([(*d, "c", 1) for d in docs], "doc_id long, text string, part string, h int")
    got = FP.compare(df).collect()
    inverse = plain_inverse([t for _, t in docs])
    assert np.allclose(inverse, FP.inverse_frequency(df))
    s = FP.Sampler(FP.inverse_frequency(df))
    keyed = spark.createDataFrame([(k, t or "") for k, (_, t) in enumerate(docs)], "k int, t string").selectExpr("k", "xxhash64(t) as h").collect()
    h = {x["k"]: x["h"] % 2**64 for x in keyed}
    order = [docs[k] for k in sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0, h[k], docs[k][1] or ""))]
    want = []
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        e = FP.edited(t, after)
        a, b, c = s.of(t), s.of(e), s.of(after)
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), FP.as_hex(a), FP.as_hex(b), FP.likeness(a, b), FP.likeness(a, c)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_rows_without_or_of_one_id_are_parted(spark):
    docs = spark.range(4000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 5, id)) as doc_id", "concat('text ', id) as text")
    sizes = [x["count"] for x in FP._parted(docs).groupBy("part").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 4000 / 4


def test_edges(spark):
    s = FP.Sampler()
    assert not s.of("").any() and FP.likeness(s.of(""), s.of(" \n")) == 1.0 and s.of("a").all()
    assert FP.edited("abcde", "xyz") == "abcxy" and FP.edited("abcd", "x") == "abx" and FP.edited("", "x") == ""
    assert FP.compare(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = FP.fingerprint(spark.createDataFrame([("x", None, "c")], "doc_id string, text string, fingerprint string")).first()
    assert got["doc_id"] == "x" and got["fingerprint"] == "0" * 4 * FP.SAMPLES
    with pytest.raises(TypeError):
        FP.compare(spark.createDataFrame([("x", "t")], "doc_id string, text string"))


def test_terms_that_come_again_are_kept_and_texts_go_together(monkeypatch):
    drawn, plain = [], FP.Sampler.draws
    monkeypatch.setattr(FP.Sampler, "draws", lambda self, h: drawn.append(len(h)) or plain(self, h))
    words = [f"w{k}".encode() for k in range(30_000)]
    texts = [words[k : k + 300] for k in range(0, len(words), 300)]
    s = FP.Sampler()
    first = [s.marks(t) for t in texts]
    assert sum(drawn) == len(words)
    again = [s.marks(t) for t in texts]
    assert all((a == b).all() for a, b in zip(first, again, strict=True))
    # all but those whose row another term has
    assert sum(drawn) < 1.5 * len(words)
    drawn.clear()
    both = FP.Sampler().marks_of([texts[0], [], texts[0][100:] + texts[1][:100] * 2])
    assert sum(drawn) == 400  # 300 terms, and 100 more that the last text has twice
    assert (both[0] == first[0]).all() and not both[1].any() and (both[2] == FP.Sampler().marks(texts[0][100:] + texts[1][:100] * 2)).all()
