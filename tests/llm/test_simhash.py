import random

import numpy as np
import xxhash

from factorloom.llm import simhash as S


def plain_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) <= 3 else [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius=3):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    some = sorted(set(fps))
    for i, a in enumerate(some):
        for b in some[i + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for d, f in zip(ids, fps):
        least[find(f)] = min(d, least.get(find(f), d))
    return [least[find(f)] for f in fps]


def near(rng, f, most=3):
    for k in rng.integers(0, 64, rng.integers(1, most + 1)):
        f ^= 1 << int(k)
    return f


def test_fingerprints():
    r = random.Random(2)
    for n in (0, 1, 2, 3, 4, 30, 500):
        t = " ".join(r.choice(["Ab", "É", "c", "D\t", "e f"]) for _ in range(n))
        assert S.fingerprint(t) == plain_fingerprint(t)
    assert S.fingerprint(None) == 0


def test_trees_find_every_link():
    rng = np.random.default_rng(5)
    value = np.unique(np.array([near(rng, int(b)) for b in rng.integers(0, 2**63, 60) for _ in range(12)], np.uint64))
    shard = np.sort(rng.integers(0, 3, len(value)))
    got = {tuple(sorted((int(i), int(j)))) for a, b in S.Forest(shard, value).links(3) for i, j in zip(a, b)}
    want = {(i, j) for i in range(len(value)) for j in range(i + 1, len(value)) if shard[i] == shard[j] and bin(int(value[i]) ^ int(value[j])).count("1") <= 3}
    assert got == want


def link(spark, ids, fps):
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(zip(ids, signed)), "doc_id long, fp long")
    rows = {r["doc_id"]: r["component_id"] for r in S.link(df).collect()}
    return [rows[d] for d in ids]


def test_components_with_chains(spark):
    rng = np.random.default_rng(8)
    fps = [int(x) for x in rng.integers(0, 2**63, 80)]
    for f in fps[:10]:  # chains: each link within the radius, the ends far apart
        for _ in range(25):
            f = near(rng, f)
            fps.append(f)
    fps += fps[:30] + [0, 0, 1]
    ids = rng.permutation(len(fps)).tolist()
    assert link(spark, ids, fps) == plain_components(ids, fps)


def test_hot_shards_go_to_finer_keys(spark, monkeypatch):
    monkeypatch.setattr(S, "TREE", 20)
    rng = np.random.default_rng(9)
    fps = list({near(rng, 0x123456789ABCDEF, 6) for _ in range(300)}) + [int(x) for x in rng.integers(0, 2**63, 100)]
    ids = rng.permutation(len(fps)).tolist()
    assert link(spark, ids, fps) == plain_components(ids, fps)


def test_query(spark):
    base = " ".join(f"word{k}" for k in range(300))
    rows = [(5, base), (3, base.upper()), (9, base + " end"), (7, "something else"), (8, None), (2, ""), (7, "something else")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fp string")
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.near_duplicates(df).collect())
    want = sorted((d, f"{plain_fingerprint(t):016x}", c) for (d, t), c in zip(rows, plain_components([d for d, _ in rows], [plain_fingerprint(t) for _, t in rows])))
    assert got == want
    assert sorted(r["doc_id"] for r in S.keep_one(df).collect()) == [2, 3, 7]
    assert S.near_duplicates(df.limit(0)).count() == 0
