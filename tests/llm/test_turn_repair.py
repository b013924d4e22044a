import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import pytest

from corvane.llm import queries
from corvane.llm.turn_repair import flagged, repair, repaired_turns, repairs


def faults(turns):
    """(role, text, fault) of turns in order."""
    out, seen = [], set()
    for role, text in turns:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else None if shown[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(turns):
    """Cost, audit and repaired lines by a search over all edits, cheapest and then ASCII-least first."""
    rows = faults(turns)
    moves = {("e", "s"): "s", ("e", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    name = {"u": "user", "a": "assistant"}
    heap, best = [(0, "", 0, "e", ())], None
    done = set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if i == len(rows) and state in "ea" and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, lines)
        if (cost, audit, i, state) in done:
            continue
        done.add((cost, audit, i, state))
        for r in "ua":
            if (state, r) in moves and audit.count("I") < len(rows) + 3:
                heapq.heappush(heap, (cost + 5, audit + "I", i, moves[state, r], (*lines, f"{name[r]}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if (state, role[:1]) in moves:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, moves[state, role[:1]], (*lines, f"{role}:{text}")))
                for r in "ua":
                    if (state, r) in moves:
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, moves[state, r], (*lines, f"{name[r]}:{text}")))
    return best


def want(numbered):
    """Rows of one conversation: (turn, role, text), in order."""
    turns = [(r, t) for _, r, t in numbered]
    kinds = [f for _, _, f in faults(turns)]
    known = [n for n, _, _ in numbered if n is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(turns, turns[1:]))
    cost, audit, lines = cheapest(turns)
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def got(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r[c] for c in names) for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string, idx string, fault int"


@pytest.fixture(scope="module")
def every(spark):
    """All sequences of up to three turns, and random longer ones."""
    kinds = [("system", "a."), ("user", "b."), ("assistant", "c!"), ("user", "cut"), ("tool", "x."), ("assistant", " \t")]
    talks = [list(x) for n in range(1, 4) for x in product(kinds, repeat=n)]
    r = random.Random(5)
    talks += [[(r.choice(["system", "user", "assistant", "u", ""]), r.choice(["", " ", "one.", "two?", "three", "four!", "é.", "five"])) for _ in range(r.randint(4, 11))] for _ in range(120)]
    return {i: [(r.choice([t, t, t, t + 1]) if i % 5 == 0 else t, role, text) for t, (role, text) in enumerate(x)] for i, x in enumerate(talks)}


def in_order(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest())
    return sorted(rows, key=key)


@pytest.mark.parametrize("part", [256, 3, 1])
def test_against_a_search_over_all_edits(spark, every, part):
    df = spark.createDataFrame([(c, *x, "clash", 1) for c, rows in every.items() for x in rows], SCHEMA)
    made = got(repair(df, part))
    assert made == {c: want(in_order(rows)) for c, rows in every.items()}


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, "user", "first."), (1, None, None, "odd."), (1, 4, "assistant", None), (None, 0, "user", "who."), (None, 0, "user", "who."), (None, 1, "assistant", "me."), (2, 0, None, None)]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], SCHEMA)
    clean = lambda c: in_order([(t, " " if r is None else r, " " if x is None else x) for k, t, r, x in rows if k == c])
    assert got(repair(df)) == {c: want(clean(c)) for c in (1, None, 2)}
    assert repair(df.limit(0)).count() == 0


def test_long_conversation_in_parts_equals_one_fold(spark):
    r = random.Random(9)
    lines = [(7, i, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["yes.", f"turn {i}.", f"cut {i}", ""]), None, None) for i in range(700)]
    lines += [(8, 0, "user", "word " * 200_000 + ".", None, None), (8, 1, "assistant", "ok.", None, None)]
    df = spark.createDataFrame(lines, SCHEMA)
    assert got(repair(df, 64)) == got(repair(df, 1000))


def test_repaired_turns_follow_the_grammar(spark, every):
    df = spark.createDataFrame([(c, *x, "clash", 1) for c, rows in every.items() for x in rows], SCHEMA)
    made = repairs(flagged(df))
    talks = {}
    for row in repaired_turns(df, made.select("conv", "audit")).collect():
        talks.setdefault(row.conv, []).append(row)
    for rows in talks.values():
        assert [x.pos for x in rows] == list(range(len(rows)))
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[:1] for x in rows))
        assert all(x.text == "" for x in rows if x.edit == "I")


def test_query_over_all_conversations(spark):
    sf = "/root/testdata/sf0.001"
    talks = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        kept = talks.setdefault(r.conv_id, [])
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", r.text) if kind == 2 else r.text
        kept += [(r.turn, "user" if kind == 4 else r.role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got(queries.op12_conversation_repair(spark, sf)) == {c: want(in_order(rows)) for c, rows in talks.items()}
