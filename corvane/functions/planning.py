"""Planning of queries as Column expressions: keyword queries, and the pairing of goals with targets."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import let, pairs_of


def keyword_query(query: Column, goal: Column, generic: list[str] | None = None, synonyms: dict[str, str] | None = None, most: int = 4) -> Column:
    """A search box's query of at most ``most`` units, generic ones left out, known phrases replaced.

    The goal's title, what stands before ``中的`` in it, is added as a branch of
    its own, since the words of one branch must all occur. A query of generic
    words only keeps its first; a null or blank one gives null.
    """
    spaced = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    text = spaced(F.regexp_replace(query, "[\"'“”‘’]", " "))
    for phrase, better in (synonyms or {}).items():
        text = F.replace(text, F.lit(phrase), F.lit(better))
    known = F.array(*[F.lit(g) for g in generic or []]).cast("array<string>")

    def step(s: Column, unit: Column) -> Column:
        joins = F.upper(unit) == "OR"
        room = F.when(joins, (F.size(s["kept"]) > 0) & (F.element_at(s["kept"], -1) != "OR")).otherwise(~F.array_contains(known, unit) & (s["n"] < most))
        kept = F.when(F.coalesce(room, F.lit(False)), F.concat(s["kept"], F.array(F.when(joins, "OR").otherwise(unit)))).otherwise(s["kept"])
        return F.struct(kept.alias("kept"), (s["n"] + (F.coalesce(room, F.lit(False)) & ~joins).cast("int")).alias("n"))

    begin = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"))
    end = lambda kept: F.when(F.try_element_at(kept, F.lit(-1)) == "OR", F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
    bare = lambda c: F.lower(F.regexp_replace(c, r"\s", ""))
    title = F.split(spaced(goal), "中的", 2)
    anchor = F.when(F.size(title) > 1, F.trim(F.regexp_replace(title[0], "^.*[；;：:]", ""))).otherwise("")

    def with_anchor(out: Column) -> Column:
        held = F.transform(F.split(out, r"(?i)\s+or\s+"), bare)
        adds = (anchor != "") & (F.length(anchor) <= 40) & ~F.array_contains(held, bare(anchor))
        return F.when(adds, F.concat(out, F.lit(" OR "), anchor)).otherwise(out)

    def planned(t: Column) -> Column:
        units = F.split(t, " ")
        kept = end(F.aggregate(units, begin, step)["kept"])
        return let(F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(units[0]), with_anchor)

    return F.when(text != "", let(text, planned))


def target_score(target: Column, goal: Column) -> Column:
    """How much of a target a goal's text holds: ten for each character of a part it holds whole, one for each character pair."""
    squeeze = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    have = squeeze(goal)
    parts = F.transform(F.split(target, "中的", 2), squeeze)
    whole = F.aggregate(F.filter(parts, lambda p: (F.length(p) >= 2) & have.contains(p)), F.lit(0), lambda n, p: n + 10 * F.length(p))
    pairs = F.filter(pairs_of(squeeze(target)), lambda p: (F.length(p) == 2) & have.contains(p))
    return whole + F.size(pairs)


def align_targets(targets: Column, goals: Column) -> Column:
    """The order of an array of targets that suits an array of goals best (the first of equals); null unless there are as many, and three at most."""
    choices = {n: F.array(*[F.array(*[F.lit(i) for i in p]) for p in permutations(range(n))]) for n in (1, 2, 3)}
    orders = F.when(F.size(targets) == 1, choices[1]).when(F.size(targets) == 2, choices[2]).when(F.size(targets) == 3, choices[3])
    placed = lambda p: F.transform(p, lambda i: F.get(targets, i))
    score = lambda p: F.aggregate(F.zip_with(placed(p), goals, target_score), F.lit(0), lambda n, x: n + x)
    best = F.array_max(F.transform(orders, lambda p, i: F.struct(score(p).alias("score"), (-i).alias("first"), p.alias("order"))))["order"]
    return F.when(F.size(targets) == F.size(goals), placed(best))
