import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import variants
from corvane.operators import counters, fairness, traces
from corvane.sources.layout import page_order, reading_order


@pytest.mark.parametrize("limit", [0, 1, 5, 7, 30, 1000])
def test_shares_are_max_min_fair(spark, limit):
    r = random.Random(limit)
    supply = {None: 3, "a": 2, "b": 4, "c": 4, "d": 0} | {f"x{i}": r.randint(0, 9) for i in range(6)}
    got = {x.base: x.allotted for x in fairness.allotments(spark.createDataFrame(list(supply.items()), "base string, supply long"), limit).collect()}
    want, left = dict.fromkeys(supply, 0), limit
    while left and any(want[b] < n for b, n in supply.items()):  # one at a time to those with least, first by name
        open_ = sorted((b for b, n in supply.items() if want[b] < n), key=lambda b: (want[b], b is not None, b or ""))
        want[open_[0]] += 1
        left -= 1
    assert got == {b: n for b, n in want.items() if supply[b]}


def test_fair_choice_takes_two_of_a_document(spark):
    rows = [("a", d, i, 10 - i) for d in (1, 2) for i in range(5)] + [("b", 3, 0, 1), (None, 4, 0, 1)]
    df = spark.createDataFrame(rows, "base string, document_id long, item long, score int")
    got = fairness.select_fairly(df, 100, [F.desc("score"), "item", "document_id"]).collect()
    assert sorted(((r.base, r.document_id, r.item, r.position) for r in got), key=repr) == sorted([("a", 1, 0, 1), ("a", 2, 0, 2), ("a", 1, 1, 3), ("a", 2, 1, 4), ("b", 3, 0, 1), (None, 4, 0, 1)], key=repr)
    assert len(fairness.select_fairly(df, 3, [F.desc("score"), "item", "document_id"]).collect()) == 3
    assert fairness.select_fairly(df.limit(0), 3, ["item"]).count() == 0


def test_spans_by_a_loop(spark):
    r = random.Random(1)
    rows = [(run, i, i * r.randint(8, 12), r.choice([None, "a", "b", "c"]), r.choice(["START", "START", "END", "FAIL", "OTHER"])) for run in (1, 2, None) for i in range(120)]
    got = sorted((tuple(x) for x in traces.spans(spark.createDataFrame(rows, "run_id long, seq long, at long, stage string, kind string").repartition(5)).collect()), key=repr)
    want = []
    for run in (1, 2, None):
        stack, seen = [], {}
        for _, _, at, stage, kind in sorted((x for x in rows if x[0] == run), key=lambda x: x[1]):
            if kind == "START":
                seen[stage] = seen.get(stage, 0) + 1
                stack.append([stage, seen[stage], at, []])
            elif kind != "OTHER":
                depths = [i for i, s in enumerate(stack) if s[0] == stage]
                if not depths:
                    want.append((run, stage, None, len(stack), None, at, "UNMATCHED", None, None))
                while depths and len(stack) > depths[-1]:
                    name, attempt, start, inside = stack.pop()
                    status = "ABANDONED" if len(stack) > depths[-1] else "DONE" if kind == "END" else "FAILED"
                    want.append((run, name, attempt, len(stack), start, at, status, at - start, at - start - sum(inside)))
                    if stack:
                        stack[-1][3].append(at - start)
        want += [(run, s[0], s[1], i, s[2], None, "OPEN", None, None) for i, s in enumerate(stack)]
    assert got == sorted(want, key=repr)


def test_reading_order_of_pages():
    def page(layout, seed):
        order = np.random.default_rng(seed).permutation(len(layout))
        read = page_order(np.array(layout, float)[order], 15, 25)
        assert [int(order[i]) for i in read] == list(range(len(layout)))

    heading, line = (50, 40, 550, 52), lambda x, y, w=230: (x, y, x + w, y + 12)
    two = [heading, *[line(50, 80 + 20 * i, 100 + 30 * (i % 5)) for i in range(9)], *[line(320, 80 + 20 * i) for i in range(7)]]
    banded = [*two, (60, 300, 560, 312), *[line(50, 340 + 20 * i) for i in range(5)], *[line(320, 340 + 20 * i) for i in range(5)]]
    three = [line(20 + 200 * c, 50 + 20 * i, 150) for c in range(3) for i in range(6)]
    one = [line(50, 40 + 16 * i, 200 + 50 * (i % 3)) for i in range(12)]
    words = [(50 + 40 * c, 40 + 20 * i, 85 + 40 * c, 52 + 20 * i) for i in range(4) for c in range(6)]
    aside = [line(50, 40, 480), *[line(50, 90 + 20 * i) for i in range(4)], *[line(320, 200 + 20 * i) for i in range(4)]]
    for seed in range(5):
        for layout in (two, banded, three, one, words, aside, [heading], []):
            if layout:
                page(layout, seed)
    assert page_order(np.zeros((0, 4)), 15, 25) == []


def test_boxes_without_edges_come_last(spark):
    rows = [(1, 0, 5, None, 0.0, 9.0, 9.0), (1, 0, 6, 0.0, 50.0, 9.0, 60.0), (1, 0, 7, 0.0, 0.0, 9.0, 9.0), (1, 1, 8, float("nan"), 0.0, 9.0, 9.0), (2, None, 9, 0.0, 0.0, 1.0, 1.0)]
    got = reading_order(spark.createDataFrame(rows, "document_id long, page long, box_id long, x0 double, y0 double, x1 double, y1 double")).collect()
    assert sorted((r.box_id, r.position) for r in got) == [(5, 2), (6, 1), (7, 0), (8, 0), (9, 0)]


def test_rates_by_loops(spark):
    r = random.Random(3)
    rows, want = [], {}
    for s in ("x", "y"):
        at, value, own = 0, 0.0, []
        for _ in range(80):
            at, value = at + r.choice([5, 10, 10, 15, 120]), r.choice([value + r.randint(0, 5)] * 9 + [float(r.randint(0, 2))])
            own.append((at, value))
        rows += [(s, a, v) for a, v in own]
        for end in range(0, at + 200, 20):
            seen = [(a, v) for a, v in own if end - 100 < a <= end]
            if len(seen) < 2:
                continue
            delta = sum(v - u if v >= u else v for (_, u), (_, v) in zip(seen, seen[1:]))
            span = seen[-1][0] - seen[0][0]
            mean = span / (len(seen) - 1)
            edge = lambda gap: gap if gap < 1.1 * mean else mean / 2
            back = edge(seen[0][0] - end + 100)
            if delta > 0:
                back = min(back, span * seen[0][1] / delta)
            want[s, end] = delta * (span + back + edge(end - seen[-1][0])) / span
    rows += [("x", 7, None), (None, 7, 1.0), ("x", None, 1.0), ("x", 8, float("nan")), ("z", 5, 1.0)]
    got = {(x.series, x.end): x.increase for x in counters.rates(spark.createDataFrame(rows, "series string, at long, value double"), 100, 20).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_quantiles_of_buckets(spark):
    inf = float("inf")
    rows = [("a", 1.0, 2), ("a", 2.0, 6), ("a", inf, 8), ("b", 1.0, 0), ("b", inf, 5), ("c", 1.0, 0), ("c", inf, 0), ("d", 1.0, 4), ("e", -1.0, 3), ("e", inf, 3), ("f", inf, 2), ("g", 1.0, 3), ("g", 2.0, 2), ("g", inf, 4), (None, inf, 1)]
    df = spark.createDataFrame(rows, "key string, bound double, count long")
    values = lambda q: {r.key: round(r.quantile, 9) for r in counters.bucket_quantile(df, q).collect()}
    assert values(0.5) == {"a": 1.5, "b": 1.0, "e": -1.0, "g": round(2 / 3, 9)}
    assert values(0.95) == {"a": 2.0, "b": 1.0, "e": -1.0, "g": 2.0}


VALUES = ['{"a": 1, "b": {"c": [1, {"d": null}]}}', '{"a": 1}', '{"b": {"c": [{}]}}', "[1, 2, [3]]", "[2, 1]", "2", '"x"', '["x", null]', "null", "true", "1.0", "{}", "[]", None, "not json"]


def holds(a, b, top=True):
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and holds(a[k], v, False) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(holds(x, v, False) for x in a) for v in b)
    if isinstance(a, list):
        return top and any(holds(x, b, False) for x in a if not isinstance(x, (dict, list)))
    return json.dumps(a) == json.dumps(b) or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and bool not in (type(a), type(b)) and a == b)


def test_variants(spark):
    pairs = spark.createDataFrame([(a, b) for a in VALUES for b in VALUES], "a string, b string")
    v = pairs.select("a", "b", variants.parse(F.col("a")).alias("va"), variants.parse(F.col("b")).alias("vb"))
    got = v.select("a", "b", variants.type_of(F.col("va")).alias("kind"), variants.has_key(F.col("va"), F.lit("a")).alias("key"), variants.has_key(F.col("va"), F.lit("x")).alias("x"), variants.merged(F.col("va"), F.col("vb")).alias("m"), variants.contains(F.col("va"), F.col("vb")).alias("holds"), variants.at(F.col("va"), "$.b.c[0]", "int").alias("deep")).collect()
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}
    for r in got:
        known = [None if x in (None, "not json") else (json.loads(x),) for x in (r.a, r.b)]
        if known[0] is None:
            assert r.kind is None and r.key is None and r.m is None and r.holds is None
            continue
        a = known[0][0]
        assert r.kind == kinds[type(a)]
        assert r.key == ("a" in a if isinstance(a, dict) else False) and r.x == ("x" in a if isinstance(a, list) else False), r
        assert r.deep == (1 if r.a == VALUES[0] else None)
        if known[1] is None:
            assert r.m is None and r.holds is None
            continue
        b = known[1][0]
        assert r.holds == holds(a, b), r
        assert (None if r.m is None else json.loads(r.m)) == (a | b if isinstance(a, dict) and isinstance(b, dict) else None)
