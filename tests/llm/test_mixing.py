import hashlib
import math
import random
from collections import defaultdict

import pytest

from factorloom.llm import mixing as M


def brute(rows):
    """taken of each row, by sorting all of a source."""
    size = [len((t or "").split()) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    goal, left, open_ = {}, 1.5 * sum(total.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not over:
            goal |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            goal[s] = 2.0 * total[s]
            left -= goal[s]
        open_ -= over
    taken = [0] * len(rows)
    for s in order:
        if not total[s]:
            continue
        r = goal[s] / total[s]
        whole = min(int(r), 2)
        f = r - whole if whole < 2 else 0
        groups = defaultdict(list)
        for k, (d, t, src) in enumerate(rows):
            if src == s:
                taken[k] = whole * size[k]
                if size[k]:
                    groups[hashlib.md5(f"{'' if d is None else d}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()].append(k)
        if f <= 0:
            continue
        mean = total[s] / sum(size[k] > 0 for k, row in enumerate(rows) if row[2] == s)
        odds = lambda key: f / (1 - f) * math.sqrt(size[groups[key][0]] / mean)  # noqa: B023, E731
        rank = lambda key: ((u := (int(key[:13], 16) + 0.5) / 16**13) / (1 - u)) / odds(key)  # noqa: B023, E731
        room, out = goal[s] - whole * total[s], []
        for g in sorted(groups, key=lambda key: (rank(key), key)):
            mass = sum(size[k] for k in groups[g])
            if mass <= room and room > goal[s] / 1000:
                room -= mass
                for k in groups[g]:
                    taken[k] += size[k]
            else:
                out.append((mass, len(out), g))
        if room > goal[s] / 1000 and out and min(out)[0] < 2 * room:
            for k in groups[min(out)[2]]:
                taken[k] += size[k]
    return size, total, goal, taken


def make(n, seed):
    r = random.Random(seed)
    rows = [(k, " ".join("w" * r.randrange(1, 4) for _ in range(r.choice((0, 3, 5, 8, 300)) if seed != 2 else r.randrange(1, 5))), r.choice(["a", "b", "c", "ü", None, "a", "a"])) for k in range(n)]
    return rows + rows[:5] + [(None, "x y z", "b"), (n + 1, None, "c"), (n + 2, "", "empty")]


@pytest.mark.parametrize("n,seed", [(30, 1), (6000, 2), (1500, 3)])
def test_against_sorting(spark, n, seed):
    rows = make(n, seed)
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, source string, size string")
    size, total, goal, taken = brute(rows)
    got = sorted((r["doc_id"] or -1, r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in M.mix(df).collect())
    want = sorted((d or -1, n, total[s], round(goal[s], 6), t) for (d, _, s), n, t in zip(rows, size, taken))
    assert got == want
    by = defaultdict(int)
    for (_, _, s), t in zip(rows, taken):
        by[s] += t
    assert all(t <= 2 * n for n, t in zip(size, taken))
    if n > 1000:
        assert all(abs(by[s] - goal[s]) <= 0.01 * goal[s] for s in by if total[s] > 1000)
    made = M.apply_mix(df)
    assert made.columns == df.columns and made.count() == sum(t // n for n, t in zip(size, taken) if n) + made.where("size(split(trim(coalesce(text, '')), ' ')) < 1 or coalesce(text, '') = ''").count()


def targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    return {r["source"]: r["target"] for r in M.targets(df).collect()}


def test_targets(spark):
    t = targets(spark, {"a": 100, "b": 100, "c": 100})
    assert t == {"a": 200.0, "b": pytest.approx(250 / 3), "c": pytest.approx(500 / 3)}
    assert sum(targets(spark, {"a": 1, "b": 1000, None: 3}).values()) == pytest.approx(1506)
    assert targets(spark, {}) == {} and targets(spark, {"a": 0}) == {"a": 0.0}
    many = {f"s{k:05d}": 1 + k * 7919 % 1000 for k in range(5000)}
    assert sum(targets(spark, many).values()) == pytest.approx(1.5 * sum(many.values()))


def test_odds_are_unequal(spark):
    # of many short and long documents of one chance, the long ones come again more often, and less so than they are longer
    rows = [(k, "w " * (4 if k % 2 else 64), s) for k in range(4000) for s in ("a", "b", "c")]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("size", "target").avg("copies").collect()
    share = {(r["target"], r["size"]): r["avg(copies)"] % 1 for r in got}
    for goal in {t for t, _ in share}:
        if 0.05 < share[(goal, 4)] < 0.95:
            odds = [share[(goal, n)] / (1 - share[(goal, n)]) for n in (4, 64)]
            assert 2.5 < odds[1] / odds[0] < 6  # the square root of 16 is 4


def test_repeated_rows_reach_the_target(spark):
    rows = [(1, "w " * 50, "b")] * 300 + [(k, "w " * 20, "b") for k in range(2, 2000)] + [(k, "w " * 9, "a") for k in range(9000)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source_size", "target").agg({"taken": "sum"}).collect()
    assert len(got) == 2 and all(abs(r["sum(taken)"] - r["target"]) < 0.01 * r["target"] for r in got)


def test_very_long_text(spark):
    rows = [(k, "w " * 300_000 if k == 7 else "w x", "a") for k in range(50)] + [(None, "w", "b")] * 40
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["size"] for r in got if r["doc_id"] == 7} == {300_000} and all(r["taken"] <= 2 * r["size"] for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(df).count() == 0 and M.apply_mix(df).count() == 0
