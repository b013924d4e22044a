"""Greedy choices over groups of any size, as streams of sorted rows.

A group's rows meet in one task in order, and a chooser takes them one by one. It holds no
more than its choice needs: what could still be chosen, and what has been. Choices that
look at a group twice are two streams, and the first one's result comes before the rows of the second.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


class Chooser:
    """Takes a group's rows (dicts) in order; both methods give rows of the result."""

    def take(self, row: dict) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []


def streamed(rows: DataFrame, group: str, order: list[str | Column], start: Callable[[], Chooser], schema: str) -> DataFrame:
    """What a chooser for each group makes of its rows in order. A null group is a group."""
    out_type = StructType.fromDDL(schema)
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in out_type.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = None, None

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=pa.schema(fields))

        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if held is None or row[group] != now:
                    out += held.end() if held is not None else []
                    held, now = start(), row[group]
                out += held.take(row)
            if out:
                yield batch_of(out)
        if held is not None and (out := held.end()):
            yield batch_of(out)

    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, out_type)


class Cover(Chooser):
    """The items that fit a budget and gain most, by a heap of stale gains.

    A gain only falls as goals and needs are covered, and what doesn't fit never will: so an item whose gain,
    counted anew, is still what the heap says is the best. Of items alike in goals and needs one can be chosen
    that is smaller than all before it only, as an earlier one would fit too: no others are held.
    """

    def __init__(self, budget: int, goal_gain: int, need_gain: int):
        self.budget, self.goal_gain, self.need_gain = budget, goal_gain, need_gain
        self.items: list[dict] = []
        self.least: dict[tuple, int] = {}
        self.smallest: dict | None = None

    def take(self, row: dict) -> list[tuple]:
        if self.smallest is None or row["tokens"] < self.smallest["tokens"]:
            self.smallest = row
        alike = (tuple(row["goals"]), tuple(row["needs"]))
        if row["tokens"] <= self.budget and row["tokens"] < self.least.get(alike, self.budget + 1):
            self.least[alike] = row["tokens"]
            self.items.append(row)
        return []

    def end(self) -> list[tuple]:
        goals, needs, used = set(), set(), 0
        gain = lambda x: self.goal_gain * len(set(x["goals"]) - goals) + self.need_gain * len(set(x["needs"]) - needs)
        heap = [(-gain(x), i) for i, x in enumerate(self.items)]
        heapify(heap)
        chosen = []
        while heap:
            stale, i = heappop(heap)
            x = self.items[i]
            now = gain(x)
            if not now or used + x["tokens"] > self.budget:
                continue
            if now < -stale:
                heappush(heap, (-now, i))
                continue
            chosen.append(x["parent_id"])
            goals, needs, used = goals | set(x["goals"]), needs | set(x["needs"]), used + x["tokens"]
        if self.smallest["tokens"] > self.budget:
            chosen, used = [self.smallest["parent_id"]], self.smallest["tokens"]
        return [(self.smallest["run_id"], chosen, used)]


class Fill(Chooser):
    """First what was chosen before, at its place, then in order what still fits."""

    def __init__(self, budget: int):
        self.budget, self.used, self.place, self.next = budget, 0, {}, 1

    def take(self, row: dict) -> list[tuple]:
        if row["chosen"] is not None:
            self.place, self.used = {p: i for i, p in enumerate(row["chosen"], 1)}, row["used"]
            self.next = len(self.place) + 1
            return []
        if row["parent_id"] in self.place:
            at = self.place[row["parent_id"]]
        elif self.used + row["tokens"] <= self.budget:
            at, self.next, self.used = self.next, self.next + 1, self.used + row["tokens"]
        else:
            return []
        return [(row["run_id"], at, row["parent_id"], row["tokens"], row["score"])]


class Trim(Chooser):
    """What stays when items that others cover go, from the end, until the rest fits.

    What can't go can't go later either, as cover only falls: one pass from the end decides. It holds how often each need is covered.
    """

    def __init__(self, budget: int):
        self.budget, self.total, self.held = budget, 0, {}

    def take(self, row: dict) -> list[tuple]:
        if row["cover"] is not None:
            self.total, self.held = row["total"], {x["need"]: x["times"] for x in row["cover"]}
            return []
        if self.total > self.budget and all(self.held[n] > 1 for n in row["needs"]):
            self.total -= row["tokens"]
            for n in row["needs"]:
                self.held[n] -= 1
            return []
        return [(row["run_id"], row["parent_id"], row["tokens"], row["score"])]


class Varied(Chooser):
    """Items none of which is near one chosen before; with ``fresh``, of a kind of its own only. It holds the ``limit`` chosen at most."""

    def __init__(self, limit: int, threshold: float, fresh: bool):
        self.limit, self.threshold, self.fresh = limit, threshold, fresh
        self.kinds, self.pairs, self.ids = set(), [], set()

    def _keep(self, row: dict) -> None:
        self.kinds.add(row["kind"])
        self.pairs.append(set(row["pairs"] or ()))
        self.ids.add(row["item_id"])

    def take(self, row: dict) -> list[tuple]:
        if row["place"] is not None:
            self._keep(row)
            return []
        if len(self.pairs) >= self.limit or row["item_id"] in self.ids or (self.fresh and row["kind"] in self.kinds):
            return []
        own = set(row["pairs"] or ())
        if any(len(own & x) >= self.threshold * len(own | x) for x in self.pairs):
            return []
        self._keep(row)
        return [(row["group_id"], len(self.pairs), row["item_id"], row["kind"], row["pairs"])]


class Spread(Chooser):
    """``count`` items, of the kinds and then with the documents that were taken least, in order.

    Each kind has a heap of its items by how often their documents were taken when the item was last looked at. That only
    grows, so a kind's first is right once its number, counted anew, hasn't changed. Kinds wait in a heap by how
    many of them were taken. Once a kind has more items without a common document than others can touch (``widest`` documents
    each, the group's most), one of them stays untouched to the end, and later ones have no chance and aren't held.
    """

    def __init__(self, count: int):
        self.count, self.group = count, None
        self.heaps: dict = defaultdict(list)
        self.apart: dict = defaultdict(lambda: [set(), 0])
        self.seen = 0

    def take(self, row: dict) -> list[tuple]:
        self.group = row["group_id"]
        documents = tuple(row["documents"])
        known = self.apart[row["kind"]]
        if known[1] > (self.count - 1) * row["widest"]:
            return []
        if not known[0] & set(documents):
            known[0] |= set(documents)
            known[1] += 1
        self.heaps[row["kind"]].append((0, self.seen, row["item_id"], documents))
        self.seen += 1
        return []

    def end(self) -> list[tuple]:
        taken, used = [], Counter()
        waiting = defaultdict(list)  # kinds by how many of them were taken
        for kind, heap in self.heaps.items():
            heapify(heap)
            waiting[0].append(kind)
        while len(taken) < self.count and (level := min((n for n, kinds in waiting.items() if kinds), default=None)) is not None:
            first = min(waiting[level], key=lambda kind: self._first(self.heaps[kind], used))
            _, _, item, documents = heappop(self.heaps[first])
            used.update(documents)
            taken.append((self.group, len(taken) + 1, item))
            waiting[level].remove(first)
            if self.heaps[first]:
                waiting[level + 1].append(first)
        return taken

    @staticmethod
    def _first(heap: list, used: Counter) -> tuple[int, int]:
        """The true first of a kind's heap."""
        while True:
            stale, place, item, documents = heap[0]
            now = sum(used[d] for d in documents)
            if now == stale:
                return now, place
            heappop(heap)
            heappush(heap, (now, place, item, documents))


class Fits(Chooser):
    """In order, what fits what is left of a budget; a row of unknown size doesn't."""

    def __init__(self, budget: int, columns: list[str]):
        self.left, self.columns, self.n = budget, columns, 0

    def take(self, row: dict) -> list[tuple]:
        if row["tokens"] is None or row["tokens"] > self.left:
            return []
        self.left, self.n = self.left - row["tokens"], self.n + 1
        return [(*[row[c] for c in self.columns], self.n)]
