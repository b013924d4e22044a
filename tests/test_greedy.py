import random
from collections import Counter

import pytest

from corvane.operators import evidence, packing

EVIDENCE = "run_id long, goal_id long, requirement_id long, parent_id long, score double, tokens long"


def rows_of(seed, runs=6, n=60):
    r = random.Random(seed)
    size = {p: r.randint(5, 120) for p in range(25)}
    return [(r.choice([None, *range(runs)]), r.choice([0, 1, 2, None]), r.choice([0, 1, 2, 3, None]), p := r.randint(0, 24), r.choice([0.1, 0.5, 0.5, 0.9]), None if p == 24 else size[p]) for _ in range(runs * n)]


def parents(rows, run):
    """Parents of a run in order: (parent, score, tokens, goals, needs)."""
    got = {}
    for k, g, q, p, s, t in rows:
        if k == run and t is not None:
            x = got.setdefault(p, [p, s, t, set(), set()])
            x[1] = max(x[1], s)
            if g is not None:
                x[3].add(g)
                if q is not None:
                    x[4].add((g, q))
    return sorted(got.values(), key=lambda x: (-x[1], x[2], str(x[0])))


def covered(rows, run, budget):
    rest, chosen, goals, needs, used = parents(rows, run), [], set(), set(), 0
    if not rest:
        return []
    while True:
        best = max(((8 * len(x[3] - goals) + 3 * len(x[4] - needs), -i) for i, x in enumerate(rest) if used + x[2] <= budget), default=(0, 0))
        if best[0] == 0:
            break
        x = rest.pop(-best[1])
        chosen.append(x)
        goals, needs, used = goals | x[3], needs | x[4], used + x[2]
    for x in rest:
        if used + x[2] <= budget:
            chosen.append(x)
            used += x[2]
    return [x[0] for x in chosen or [min(rest, key=lambda x: x[2])]]


def trimmed(rows, run, budget):
    rest = parents(rows, run)
    while sum(x[2] for x in rest) > budget:
        held = Counter(q for x in rest for q in x[4])
        spare = [i for i, x in enumerate(rest) if all(held[q] > 1 for q in x[4])]
        if not spare:
            break
        rest.pop(spare[-1])
    return [x[0] for x in rest]


def lists(df, column="parent_id", group="run_id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.position):
        out.setdefault(r[group], []).append(r[column])
    return out


@pytest.mark.parametrize("budget", [3, 90, 300, 5000])
def test_packs_are_the_greedy_ones(spark, budget):
    rows = rows_of(budget)
    df = spark.createDataFrame(rows, EVIDENCE)
    runs = {r[0] for r in rows}
    assert lists(packing.pack_for_coverage(df, budget)) == {k: covered(rows, k, budget) for k in runs}
    assert lists(packing.trim_packs(df, budget)) == {k: trimmed(rows, k, budget) for k in runs if trimmed(rows, k, budget)}


def test_varied_choices_are_the_greedy_ones(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, "x", "y", "z"]), r.sample("abcdefgh", r.randint(0, 5)), r.randint(0, 3), r.random()) for i in range(200)]
    rows = [(*x[:3], x[3] or None, *x[4:]) for x in rows]
    got = lists(packing.diversify(spark.createDataFrame(rows, "group_id string, item_id long, kind string, pairs array<string>, documents int, quality double"), 7, 0.5), "item_id", "group_id")
    for g in ("a", "b", None):
        own, chosen = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[4], -x[5], x[1])), []
        near = lambda x: any(len(set(x[3] or ()) & set(c[3] or ())) >= 0.5 * len(set(x[3] or ()) | set(c[3] or ())) for c in chosen)
        for fresh in (True, False):
            for x in own:
                if len(chosen) < 7 and x not in chosen and not (fresh and x[2] in {c[2] for c in chosen}) and not near(x):
                    chosen.append(x)
        assert got[g] == [x[1] for x in chosen]


def test_balanced_picks_from_many_sets_of_documents(spark):
    r = random.Random(6)
    rows = [("g", i, r.choice("ab"), r.sample([f"d{j}" for j in range(40)], r.choice([0, 1, 1, 2, 5])), i // 3) for i in range(500)]
    got = evidence.balanced_pick(spark.createDataFrame(rows, "group_id string, item_id long, kind string, documents array<string>, rank int"), 12)
    rest, kinds, used, want = list(rows), Counter(), Counter(), []
    while len(want) < 12:
        x = min(rest, key=lambda x: (kinds[x[2]], sum(used[d] for d in x[3]), x[4], x[1]))
        rest.remove(x)
        kinds[x[2]] += 1
        used.update(x[3])
        want.append(x[1])
    assert lists(got, "item_id", "group_id")["g"] == want


def test_pools_stand_null_keys(spark):
    rows = [(None, 1, None, 5, 1, "A"), (None, 2, None, 5, 1, "A"), (None, 3, None, 6, None, "A"), (None, 4, None, 7, None, "A"), (None, 5, None, 8, None, None), (1, 1, None, 5, 1, "A"), (1, 2, 2, 5, 1, "A"), (1, 3, 2, None, 1, "A"), (1, 4, 2, None, 1, "A")]
    df = spark.createDataFrame(rows, "run_id long, seq long, goal_id long, span_id long, parent_id long, phase string")
    got = {(r.run_id, r.seq): r.decision for r in packing.accept_within_quotas(df, 3, 2, 1).collect()}
    want = {1: "ACCEPTED", 2: "REPEAT", 3: "ACCEPTED", 4: "QUOTA", 5: "QUOTA"}
    assert got == {(None, k): v for k, v in want.items()} | {(1, 1): "ACCEPTED", (1, 2): "ACCEPTED", (1, 3): "QUOTA", (1, 4): "QUOTA"}


def test_what_fits_in_order(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, None), (1, 3, 6), (1, 4, 5), (None, 1, 11), (None, 2, 10)], "run_id long, n long, tokens long")
    got = packing.fit_in_order(df, "run_id", ["n"], 10).collect()
    assert sorted(((r.run_id, r.n, r.position) for r in got), key=repr) == sorted([(1, 1, 1), (1, 4, 2), (None, 2, 1)], key=repr)
