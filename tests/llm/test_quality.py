import random
import re

import numpy as np

from factorloom.llm import quality_knn as K
from factorloom.llm import quality_rules as Q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside |= {i, i + 1, i + 2}
    dup, seen = 0, set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(["a", "b", "é", " ", " ", "\n", "a b a b ", "#", "\x1c", " ", "x y\n", "|"]) for _ in range(r.randrange(0, 60))) for _ in range(n)]


def test_statistics():
    for t in [None, "", "a b c", "a b c a b c", "a\n a\na\n\n\na", *texts(400)]:
        assert Q.document_stats(t)[0] == plain(t), repr(t)


def test_trees_learn_and_keep_directions():
    r = np.random.default_rng(2)
    x = r.random((2000, len(Q.FEATURES)))
    y = ((x[:, 2] < 0.5) ^ (r.random(2000) < 0.05)).astype(float)
    m = Q.BoostedTrees(list(Q.FEATURES.values())).fit(x, y)
    assert ((m.score(x) > 0.5) == (x[:, 2] < 0.5)).mean() > 0.97
    for j, way in enumerate(Q.FEATURES.values()):
        if way:
            grid = np.repeat(x[:50], 20, axis=0)
            grid[:, j] = np.tile(np.linspace(0, 1, 20), 50)
            s = m.score(grid).reshape(50, 20)
            assert (np.diff(s, axis=1) * way >= -1e-12).all()


def test_rules_query(spark):
    good = " ".join(f"w{k}" for k in range(80))
    docs = spark.createDataFrame([(k, good if k % 2 else good.replace(" ", "### "), "c") for k in range(60)] + [(60, None, "c"), (61, "", "c"), (62, "a b c " * 40, "c"), (1, good, "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    rows = Q.judge(docs, model).collect()
    assert len(rows) == 64
    for r in rows:
        assert r["kept"] == (r["doc_id"] < 60 and r["doc_id"] % 2 == 1), r
    assert {r["doc_id"] for r in rows if r["base_failed"]} == {60, 61, 62}
    assert Q.keep_good(docs, model).columns == docs.columns and Q.keep_good(docs, model).count() == 31
    none = Q.fit(docs, labels.limit(0))
    assert Q.judge(docs, none).where("kept").count() == 61 and Q.judge(docs.limit(0), none).count() == 0


def test_scores_by_a_walk_from_node_to_node():
    r = np.random.default_rng(6)
    x = r.random((1500, len(Q.FEATURES)))
    y = ((x[:, 2] + x[:, 4] * x[:, 0] < 0.7) ^ (r.random(1500) < 0.1)).astype(float)
    m = Q.BoostedTrees(list(Q.FEATURES.values())).fit(x, y)
    n = m.nodes
    x[:20, 2] = n["threshold"][n["left"] != np.arange(len(n["left"]))][0]  # ties with a threshold go left
    for row, got in zip(x[:200], m.score(x[:200]), strict=True):
        total = m.prior
        for at in m.roots:
            while n["left"][at] != at:
                at = n["left"][at] if row[n["feature"][at]] <= n["threshold"][at] else n["right"][at]
            total += n["value"][at]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-12


def test_rules_of_long_texts_and_null_ids(spark):
    long = " ".join(f"word{k}" for k in range(60_000)) + "\nsame line\nsame line"
    docs = spark.createDataFrame([(None, long, 1.0), (None, None, 1.0), (7, "a b c " * 30_000, 1.0)], "doc_id long, text string, kept double")
    none = Q.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    out = Q.judge(docs, none)
    assert sorted((r["n_words"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in out.collect()) == [(0, 0, 0, True, False), (60_004, 1, 0, False, True), (90_000, 0, 90_000, True, False)]
    assert out.columns.count("kept") == 1 and Q.keep_good(docs, none).collect()[0]["text"] == long


def voter(texts, y):
    return K.Voter().fit([K.terms(t) for t in texts], np.array(y, np.float32))


def test_votes_by_brute_force():
    r = random.Random(4)
    good = [" ".join("".join(r.choice("abcde") for _ in range(5)) for _ in range(40)) for _ in range(60)]
    all_texts = good + [t.replace(" ", "%%% ") for t in good]
    # copies among the labelled rows, labelled otherwise: ties that the smaller place decides
    y = [1] * 60 + [0] * 60
    v = voter(all_texts + all_texts[:30] * 2, y + [0] * 60)
    some = all_texts[::7] + ["", None]
    got = v.score(some, block=5)
    for k, t in enumerate(some):
        if not t:
            assert got[k] == 0
            continue
        z = v.project(*K.terms(t))
        cos = [round(float(c), 5) for c in np.round(v.vectors @ z, 5)]
        near = sorted(range(len(cos)), key=lambda j: (-cos[j], j))[: K.NEIGHBOURS]
        w = np.maximum(np.array([cos[j] for j in near]), 1e-6) ** K.POWER
        assert abs(got[k] - (w * v.y[near]).sum() / w.sum()) < 1e-3
    assert ((got[:-2] >= 0.3) == np.array([k * 7 < 60 for k in range(len(some) - 2)])).all()


def test_ties_go_to_the_first():
    v = K.Voter()
    r = np.random.default_rng(8)
    for _ in range(50):
        cos = np.round(r.random((3, 80)), 1)
        for row, near in zip(cos, v.nearest(cos), strict=True):
            assert set(near.tolist()) == set(sorted(range(80), key=lambda j: (-row[j], j))[: K.NEIGHBOURS])


def test_space_is_that_of_the_largest_singular_values():
    r = random.Random(5)
    texts_ = [" ".join(r.choice(["red", "blue", "green"] if k % 2 else ["one", "two", "three"]) for _ in range(30)) for k in range(80)]
    rows = [K.terms(t) for t in texts_]
    v = K.Voter().fit(rows, np.ones(80, np.float32))
    dense = np.zeros((80, K.WORDS + K.FORMS))
    for k, (at, w) in enumerate(rows):
        dense[k, at] = v._scaled(at, w)
    want = np.linalg.svd(dense[:, dense.any(axis=0)], compute_uv=False)[:2]
    assert np.allclose(np.linalg.norm(dense @ v.axes[:, :2], axis=0), want, rtol=1e-3)
    # texts on one matter lie together, whatever their words
    z = np.stack([v.project(*t) for t in rows])
    assert (z[::2] @ z[::2].T).mean() > (z[::2] @ z[1::2].T).mean() + 0.1


def test_knn_query(spark):
    docs = spark.createDataFrame([(k, ("word other Third " if k % 2 else "w### o$$$ ") * 20, 1, "c") for k in range(100)] + [(100, None, 1, "c"), (101, "", 1, "c"), (None, "word", 1, "c"), (3, "word other Third " * 20, 1, "c"), (102, "word other Third " * 30_000, 1, "c")], "doc_id long, text string, score int, at string")
    labels = spark.createDataFrame([(k, k % 2, "c") for k in range(100)] + [(None, 1, "c"), (4, None, "c"), (5, 1, "c")], "doc_id long, quality int, text string")
    out = K.classify(docs, K.fit(docs, labels))
    rows = out.collect()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == 105
    assert all(r["predicted"] == r["doc_id"] % 2 for r in rows if r["doc_id"] is not None and r["doc_id"] < 100)
    of = {r["doc_id"]: r for r in rows}
    assert of[100]["score"] == of[101]["score"] == 0 and of[102]["predicted"] == 1 and len({r["score"] for r in rows if r["doc_id"] == 3}) == 1
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None) and not of[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in K.classify(docs, K.fit(docs, labels.limit(0))).collect())
    assert K.classify(docs.limit(0), K.Voter()).count() == 0


def test_texts_without_spaces_count_whole():
    same = lambda a, b: [v.tolist() for v in K.terms(a)] == [v.tolist() for v in K.terms(b)]
    assert not same("词语，" * 2000, "词语，" * 1000 + "Ab1;" * 1000)
    assert not same("a,b;c.d", "a,b;c.!") and not same("x" * 200 + "y" * 100, "x" * 200 + "#" * 100)
    assert K.shapes_of("end###") == ["a#+"] and len(K.shapes_of("a" * 450)) == 3
    assert K.shapes_of("a" * 200 + "###999") != K.shapes_of("a" * 200) and K.shapes_of("a1a1a1###") != K.shapes_of("a1a1a1")
