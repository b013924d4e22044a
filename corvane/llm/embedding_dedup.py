"""Near-duplicate vectors by sorted projection passes.

Each pass sorts the vectors into runs by leading bits of random hyperplanes and
compares all pairs of a run, however long it is. The bits are chosen by the
runs that the table's own vectors make. Verified pairs of all passes are
united; inside a united group all pairs are then compared in tiles, so that
each link is counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import map_groups, materialize, matrix, tiles, union_find
from corvane.llm.graph import components

#: Hyperplanes of a pass; a run has at most as many bits.
BITS = 32


def passes_needed(n: int, window: int, threshold: float, recall: float) -> int:
    """Passes after which a pair at the threshold has been in a window with probability ``recall``, by the bits that a window tells apart."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(1.0, math.log2(max(2, n / window)))
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - min(0.999, agree**bits))))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by the largest component first, so that no square leaves the range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def vector_classes(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows as (vec_id, h1, h2), and the distinct valid vectors as (h1, h2, rep, copies, dim, vector)."""
    x, kind = F.col("vector"), df.schema[vector_col].dataType.elementType.simpleString()
    kind = "float" if kind == "float" else "double"  # vectors move in their own type
    own = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))
    own = own.withColumn("vector", F.when(good, F.transform(x, lambda v: v + F.lit(0.0).cast(kind))))
    own = own.withColumns({"h1": F.when(x.isNotNull(), F.xxhash64("vector")), "h2": F.when(x.isNotNull(), F.xxhash64(F.lit(1), "vector"))})
    classes = own.where(x.isNotNull()).groupBy("h1", "h2").agg(F.coalesce(F.min("vec_id"), F.lit(-(1 << 62))).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    return own.select("vec_id", "h1", "h2"), classes.withColumn("dim", F.size("vector").cast("long"))


def codes(classes: DataFrame, passes: int, seed: int) -> DataFrame:
    """Each class's hyperplane bits in each pass: pass, dim, code, h1, h2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((passes, int(dim), BITS))
                x = unit(matrix(part.column(3)))
                for p in range(passes):
                    value = (x @ planes[dim][p] > 0) @ (1 << np.arange(BITS, dtype=np.int64)[::-1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p)), part.column(0), pa.array(value), part.column(1), part.column(2)], names=["pass", "dim", "code", "h1", "h2"])

    return classes.select("dim", "h1", "h2", "vector").mapInArrow(run, "pass long, dim long, code long, h1 long, h2 long")


def plan_passes(classes: DataFrame, threshold: float, window: int, recall: float, seed: int, probes: int = 2) -> tuple[int, int]:
    """(bits of a run, passes) of the least work, by the runs that all rows make in ``probes`` passes.

    Two vectors at the threshold agree in a random bit with a probability that
    no other vector changes, so the passes follow from the bits alone, and what
    the data decide is only how many comparisons the runs then cost. No bits
    are one pass over all pairs.
    """
    full = codes(classes, probes, seed).groupBy("pass", "dim", "code").agg(F.count(F.lit(1)).alias("n"))
    each = full.select("pass", "dim", "code", "n", F.explode(F.sequence(F.lit(0), F.lit(BITS))).alias("bits"))
    runs = each.groupBy("bits", "pass", "dim", F.floor(F.col("code") / F.pow(F.lit(2.0), BITS - F.col("bits"))).alias("run")).agg(F.sum("n").cast("double").alias("n"))
    work = {r.bits: r.work for r in runs.groupBy("bits").agg(F.sum(F.col("n") * F.greatest("n", F.lit(2.0 * window))).alias("work")).collect()}
    passes = {b: passes_needed(2**b, 1, threshold, recall) if b else 1 for b in work}
    best = min(work, key=lambda b: (work[b] * passes[b], b), default=0)
    return best, passes.get(best, 1)


def run_links(classes: DataFrame, threshold: float, window: int, recall: float, block: int, seed: int) -> DataFrame:
    """Links (src, dst) between classes that suffice to unite what the passes verify: in each, all pairs of a run of equal leading bits, in tiles."""
    bits, passes = plan_passes(classes, threshold, window, recall, seed)
    coded = materialize(codes(classes, passes, seed).withColumn("code", F.shiftright("code", BITS - bits)))
    dealt = tiles(coded, ["pass", "dim", "code"], ["h1", "h2"], block).join(classes.select("h1", "h2", "rep", "vector"), ["h1", "h2"])

    def one_tile(key: dict, t: pa.Table) -> dict | None:
        own, rep = t["own"].to_numpy(), t["rep"].to_numpy()
        x = unit(matrix(t["vector"]))
        if key["tile_a"] == key["tile_b"]:
            a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        else:
            left, right = np.flatnonzero(own == key["tile_a"]), np.flatnonzero(own != key["tile_a"])
            a, b = np.nonzero(x[left] @ x[right].T >= threshold)
            a, b = left[a], right[b]
        if not len(a):
            return None
        root = union_find(len(rep), a, b)
        far = np.flatnonzero(root != np.arange(len(rep)))
        return {"src": rep[far], "dst": rep[root[far]]}

    keys = ["pass", "dim", "code", "tile_a", "tile_b"]
    return map_groups(dealt.select(*keys, "own", "rep", "vector"), keys, one_tile, "src long, dst long").distinct()


def near_duplicates(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", window: int = 64, recall: float = 0.999, block: int = 256, seed: int = 3) -> DataFrame:
    """One row for each row of ``df``: vec_id, n_links, component_id, kept.

    ``n_links`` counts the other rows with a cosine of at least ``threshold``
    that were found, ``component_id`` is the smallest vec_id that links reach
    and ``kept`` whether it is the row's own. Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing, nor do
    vectors of different lengths. Equal vectors are one class from the start:
    a group of copies of any size costs a row. Rows that share an id are one
    node of the links. In some pass a pair just at the threshold is in one run
    with probability ``recall``, however the vectors lie; runs shorter than
    twice ``window`` aren't worth further passes. Repeated rows are copies; an
    empty table gives no rows; other columns play no part, whatever their names.
    """
    rows, classes = vector_classes(df, id_col, vector_col)
    rows, classes = materialize(rows), materialize(classes)
    links = run_links(classes, threshold, window, recall, block, seed)
    groups = materialize(components(links))
    members = classes.join(groups, classes["rep"] == groups["node"]).drop("node")

    def one_tile(key: dict, t: pa.Table) -> dict | None:
        own, copies = t["own"].to_numpy(), t["copies"].to_numpy()
        x = unit(matrix(t["vector"]))
        first = own == key["tile_a"]
        if key["tile_a"] == key["tile_b"]:
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            found = near @ copies
        else:
            near = x[first] @ x[~first].T >= threshold
            found = np.zeros(len(own), np.int64)
            found[first], found[~first] = near @ copies[~first], near.T @ copies[first]
        return {"h1": t["h1"].to_numpy(), "h2": t["h2"].to_numpy(), "component": np.full(len(own), key["component"]), "links": found}

    dealt = tiles(members, ["component", "dim"], ["h1", "h2"], block)
    dealt = dealt.select("component", "dim", "tile_a", "tile_b", "own", "h1", "h2", "copies", "vector")
    counted = map_groups(dealt, ["component", "dim", "tile_a", "tile_b"], one_tile, "h1 long, h2 long, component long, links long")
    linked = counted.groupBy("h1", "h2").agg(F.sum("links").alias("links"), F.min("component").alias("component"))
    facts = classes.select("h1", "h2", "copies", "rep").join(linked, ["h1", "h2"], "left")
    facts = facts.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(facts, ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
