"""N-gram Jaccard self-join by a MinHash LSH forest.

A document is the set of its shingles of five words. Each tree of the forest
is a prefix trie of signatures of ``max_depth`` minimum hashes, held as a table
sorted by tree and prefix. Documents are matched by their longest prefixes
first; level by level the matched prefix is then shortened by one hash, and what
the levels have found tells how much they still miss, until the target recall is
reached. Plausible pairs are united, and compared exactly, on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batches_by_bytes, map_groups, materialize, tiles, union_find
from corvane.llm.graph import components

MIX = np.uint64(0x9E3779B97F4A7C15)


#: Stands for a null id where ids are compared: greater than all others.
NO_ID = (1 << 63) - 1


def met(similarity: np.ndarray | float, depth: int, trees: int) -> np.ndarray | float:
    """The probability that two documents of a similarity share a prefix of ``depth`` in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def estimated_recall(found: np.ndarray, depth: int, trees: int, threshold: float, band: float = 0.05) -> float:
    """How much of what lies just above the threshold has been found at ``depth``.

    ``found[i]`` counts the pairs met so far of whose signature values i agree.
    A pair that is met with probability p stands for 1 / p pairs; the estimate
    is that of the hardest, the pairs within ``band`` above the threshold, and one
    pair at the threshold itself is always among them, so that a table that
    shows none is searched until such a pair would be found.
    """
    similarity = np.arange(len(found)) / (len(found) - 1)
    hard = (similarity >= threshold) & (similarity < threshold + band)
    count = found[hard].sum() + 1.0
    stands_for = (found[hard] / met(similarity[hard], depth, trees)).sum() + 1.0 / met(threshold, depth, trees)
    return float(count / stands_for)


def shortest_prefix(threshold: float, trees: int, max_depth: int, recall: float) -> int:
    """The depth at which the estimate is enough whatever is found: no level is shorter."""
    depth = max_depth
    while depth > 1 and met(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all of it."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Whether each code point is a letter, a digit or an underscore."""
    return np.frombuffer(bytes(chr(i).isalnum() or i == 95 for i in range(0x110000)), np.uint8).astype(bool)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the lower-case texts, and how many words each text has.

    A word's hash is that of its code points times powers of an odd number,
    taken from running sums modulo 2^64 and brought to one power.
    """
    joined = "\n".join(t.lower() for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = letter_table()[points]
    edge = np.diff(letter.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = powers(len(points))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mixed(points.astype(np.uint64) + MIX) * power, out=total[1:])
    hashes = mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    lengths = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))
    return hashes, np.diff(np.searchsorted(start, np.cumsum(lengths)), prepend=0)


@lru_cache(maxsize=1)
def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x5851F42D4C957F2D
    back = pow(base, -1, 1 << 64)
    out = []
    for b in (base, back):
        x = np.ones(n, np.uint64)
        done = 1
        while done < n:
            step = min(done, n - done)
            x[done : done + step] = x[:step] * np.uint64(pow(b, done, 1 << 64))
            done += step
        out.append(x)
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = _power_table(1 << max(19, (n - 1).bit_length()))
    return a[:n], b[:n]


def shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, which text each belongs to, and two digests of each text's words.

    A text of fewer words than ``size`` has one shingle of all of them; one
    without words has none.
    """
    words, counts = word_hashes(texts)
    n = len(words)
    owner = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(counts)
    starts = ends - counts
    place = np.arange(n) - starts[owner]
    short = counts < size
    value = np.zeros(n, np.uint64)
    for j in range(min(size, n)):
        part = words[j:] * np.uint64(pow(int(MIX) | 1, j + 1, 1 << 64))
        value[: n - j] += part
    keep = place + size <= counts[owner]
    digest = np.zeros((2, len(texts)), np.uint64)
    full = counts > 0
    for k, salt in enumerate((0x2545F4914F6CDD1D, 0x27D4EB2F165667C5)):
        term = mixed(words * np.uint64(salt) + mixed(place.astype(np.uint64) + np.uint64(salt)))
        if n:
            digest[k, full] = np.add.reduceat(term, starts[full])
    got, whose = mixed(value[keep]), owner[keep]
    small = np.flatnonzero(short & full)
    if len(small):
        got, whose = np.concatenate([got, digest[0, small]]), np.concatenate([whose, small])
        order = np.argsort(whose, kind="stable")
        got, whose = got[order], whose[order]
    return got, whose, digest


def signatures(values: np.ndarray, whose: np.ndarray, n: int, count: int, seed: int) -> np.ndarray:
    """``count`` minimum hashes of each of n texts, each kept as 16 mixed bits; what texts without shingles have means nothing."""
    out = np.full((n, count), np.iinfo(np.uint32).max, np.uint32)
    if not len(values):
        return out.astype(np.uint16)
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    starts = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])
    for j in range(count):
        out[whose[starts], j] = np.minimum.reduceat(((values * a[j]) >> np.uint64(32)).astype(np.uint32), starts)
    return (mixed(out.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def slices(texts: pa.Array, limit: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes in all; a longer text is a range of its own."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``df``: doc_id, class_id, n_links, component_id, kept.

    Words are runs of letters, digits and underscores, in lower case. Documents
    with equal words are a class (``class_id``: its smallest id), whatever its
    size; ``n_links`` counts the other rows whose shingle sets have a Jaccard
    similarity of ``threshold`` or more, ``component_id`` is the smallest
    doc_id that links reach and ``kept`` whether the row is the one that stays:
    it has that id, and of rows that share the id the component's first class.
    Texts that are null or without words link with nothing and stay. Rows that
    share an id but not their words are apart. A null id comes after all
    others. Repeated rows are copies; an empty table gives no rows; other
    columns play no part, whatever their names.
    """
    rows, facts = resolved(df, id_col, text_col, **options)
    out = rows.select("doc_id", "h1", "h2").join(facts, ["h1", "h2"], "left")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    own = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    return out.select(
        "doc_id",
        F.when(F.col("h1").isNull(), F.col("doc_id")).otherwise(known("rep")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("h1").isNull(), F.col("doc_id")).otherwise(known("component_id")).alias("component_id"),
        (F.col("h1").isNull() | ((own == F.col("component_id")) & (F.col("cid") == F.col("first_class")))).alias("kept"),
    )


def signed(narrow: DataFrame, size: int, n_hashes: int, seed: int) -> DataFrame:
    """Each (doc_id, x, t) as doc_id, x, two digests of its words and its signature; null where it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                n = hi - lo
                values, whose, digest = shingles(batch.column(1).slice(lo, n).to_pylist(), size)
                sig = signatures(values, whose, n, n_hashes, seed)
                full = np.bincount(whose, minlength=n) > 0
                sig_bytes = [row.tobytes() if ok else None for row, ok in zip(sig, full, strict=True)]
                h1, h2 = (pa.array(d.view(np.int64), mask=~full) for d in digest)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), h1, h2, pa.array(sig_bytes, pa.binary())], names=["doc_id", "x", "h1", "h2", "sig"])

    return narrow.mapInArrow(run, "doc_id long, x long, h1 long, h2 long, sig binary")


def prefixes(classes: DataFrame, trees: int, max_depth: int, depth: int) -> DataFrame:
    """(node, tree, cid) of each class in each tree; node is a digest of the tree and its first ``depth`` hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(batch.num_rows, trees, max_depth)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(node_of(sig[:, t], t, depth).view(np.int64)), pa.array(np.full(len(sig), t, np.int32)), batch.column(0)], names=["node", "tree", "cid"])

    return classes.select("cid", "sig").mapInArrow(run, "node long, tree int, cid long")


def node_of(prefix: np.ndarray, tree: int, depth: int) -> np.ndarray:
    node = np.full(len(prefix), tree + 1, np.uint64)
    for d in range(depth):
        node = mixed(node * MIX + prefix[:, d].astype(np.uint64) + np.uint64(1))
    return node


def forest(classes: DataFrame, trees: int, max_depth: int, floor: int) -> DataFrame:
    """The tries of the classes that share a prefix of ``floor`` hashes with another one: tree, prefix, cid, sig, sorted by tree and prefix.

    ``prefix`` is the tree's part of the signature, greatest byte first, so that its
    leading bytes are a node's path. Classes alone at the floor meet nobody at
    any level and stay out.
    """
    near = prefixes(classes, trees, max_depth, floor)
    shared = near.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("node")
    inside = near.join(shared, "node").select("tree", "cid").join(classes.select("cid", "sig"), "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(batch.num_rows, trees, max_depth)
            own = sig[np.arange(len(sig)), batch.column(0).to_numpy()].astype(">u2")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in own], pa.binary()), batch.column(1), batch.column(2)], names=["tree", "prefix", "cid", "sig"])

    tries = inside.select("tree", "cid", "sig").mapInArrow(run, "tree int, prefix binary, cid long, sig binary")
    return materialize(tries.repartitionByRange("tree", "prefix").sortWithinPartitions("tree", "prefix"))


def level_pairs(tries: DataFrame, depth: int, trees: int, max_depth: int, screen: float, block: int) -> DataFrame:
    """What the nodes at ``depth`` add: links (src, dst) that unite plausible pairs, and in ``seen`` counts of new pairs by agreeing values.

    A node's members whose prefixes part exactly at this depth are compared by their
    whole signatures; those that go on together met at a longer prefix. A pair
    counts as seen once, in the first tree where it meets.
    """
    node = F.xxhash64("tree", F.substring("prefix", 1, 2 * depth))
    members = tries.withColumn("node", node)
    full = members.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("prefix").alias("kinds")).where(F.col("n") > 1)
    if depth < max_depth:
        full = full.where(F.col("kinds") > 1)
    dealt = tiles(members.join(full.select("node"), "node"), ["node"], ["cid"], block).select("node", "tile_a", "tile_b", "own", "tree", "cid", "sig")

    def compared(key: dict, t: pa.Table) -> dict | None:
        own, cid, tree = t["own"].to_numpy(), t["cid"].to_numpy(), int(t["tree"][0].as_py())
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2").reshape(len(cid), trees, max_depth)
        left, right, seen = [], [], np.zeros(trees * max_depth + 1, np.int64)
        for i in range(len(cid)):
            j = np.arange(i + 1, len(cid)) if key["tile_a"] == key["tile_b"] else np.flatnonzero(own > own[i])
            if depth < max_depth:
                j = j[sig[j, tree, depth] != sig[i, tree, depth]]
            if not len(j):
                continue
            same = sig[j] == sig[i]
            agree = same.sum(axis=(1, 2))
            likely = agree >= screen * trees * max_depth
            j, same, agree = j[likely], same[likely], agree[likely]
            shared = np.logical_and.accumulate(same, axis=2).sum(2)  # the common prefix in each tree
            new = (shared.max(1, initial=0) == depth) & (np.argmax(shared >= depth, axis=1) == tree)
            seen += np.bincount(agree[new], minlength=len(seen))
            left.append(np.full(len(j), i))
            right.append(j)
        links = spanning(cid, np.concatenate([cid[:0], *left]), np.concatenate([cid[:0], *right])) or {"src": cid[:0], "dst": cid[:0]}
        kinds = np.flatnonzero(seen)
        none = np.full(len(kinds), -1)
        n = len(links["src"])
        return {
            "src": np.r_[links["src"], none], "dst": np.r_[links["dst"], none],
            "agree": np.r_[np.full(n, -1), kinds], "seen": np.r_[np.zeros(n, np.int64), seen[kinds]],
        }

    return map_groups(dealt, ["node", "tile_a", "tile_b"], compared, "src long, dst long, agree long, seen long")


def plausible_links(classes: DataFrame, threshold: float, trees: int, max_depth: int, recall: float, screen: float, block: int) -> tuple[DataFrame, list[tuple[int, float]]]:
    """Links between classes that may be near, level by level, and each level's depth and estimated recall."""
    floor = shortest_prefix(threshold, trees, max_depth, recall)
    tries = forest(classes, trees, max_depth, floor)
    found, levels, links = np.zeros(trees * max_depth + 1, np.int64), [], None
    for depth in range(max_depth, floor - 1, -1):
        level = materialize(level_pairs(tries, depth, trees, max_depth, screen, block))
        for r in level.where(F.col("agree") >= 0).groupBy("agree").agg(F.sum("seen").alias("n")).collect():  # at most a row for each signature value
            found[r.agree] += r.n
        own = level.where(F.col("agree") < 0).select("src", "dst")
        links = own if links is None else links.unionByName(own)
        levels.append((depth, estimated_recall(found, depth, trees, threshold)))
        if levels[-1][1] >= recall:
            break
    return links.distinct(), levels


def resolved(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, size: int = 5, trees: int = 16, max_depth: int = 6, recall: float = 0.999, screen: float = 0.5, block: int = 256, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, x, h1, h2; x is a digest of the text), and what is known of each class of equal words (h1, h2).

    Of a class: cid, rep (smallest id), n_links, component (smallest cid),
    component_id (smallest id) and first_class (the class of that id).

    Candidates whose whole signatures agree in less than ``screen`` of their
    values are let go: for a pair at the threshold that is many standard
    deviations away. Groups of any size are compared whole, in tiles.
    """
    batches_by_bytes(df.sparkSession)
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    narrow = narrow.withColumn("x", F.xxhash64("t"))
    rows = materialize(signed(narrow, size, trees * max_depth, seed))
    full = rows.where(F.col("h1").isNotNull())
    some = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("rep"), F.col("x")))
    classes = full.groupBy("h1", "h2").agg(some.alias("first"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), "h1", "h2", "first.rep", "first.x", "copies", "sig"))
    plausible, _ = plausible_links(classes, threshold, trees, max_depth, recall, screen, block)
    groups = materialize(components(plausible))
    members = materialize(classes.drop("sig").join(groups, F.col("cid") == groups["node"]).drop("node"))

    # the texts of grouped classes' first documents alone are read again, whole
    wanted = members.select("cid", "copies", "component", F.col("rep").alias("rep_"), F.col("x").alias("x_"))
    # both sides grow with the table, so they are dealt by key at every size
    texts = maybe_among(narrow, wanted).join(wanted.hint("merge"), (F.coalesce(F.col("doc_id"), F.lit(NO_ID)) == F.col("rep_")) & (F.col("x") == F.col("x_")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.schema.get_field_index("t")
            for lo, hi in slices(batch.column(body)):
                part = batch.slice(lo, hi - lo)
                values, whose, _ = shingles(part.column(body).to_pylist(), size)
                cut = np.searchsorted(whose, np.arange(hi - lo + 1))
                packed = [np.unique(values[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in (0, 1, 2)), pa.array(packed, pa.binary())], names=["cid", "copies", "component", "set"])

    exact = texts.select("cid", "copies", "component", "t").mapInArrow(sets, "cid long, copies long, component long, set binary").dropDuplicates(["cid"])
    dealt = tiles(materialize(exact), ["component"], ["cid"], block).select("component", "tile_a", "tile_b", "own", "cid", "copies", "set")

    def compared(key: dict, t: pa.Table) -> dict | None:
        own, cid, copies = t["own"].to_numpy(), t["cid"].to_numpy(), t["copies"].to_numpy()
        each = [np.frombuffer(x, "<u8") for x in t["set"].to_pylist()]
        counts = np.array([len(x) for x in each])
        common = common_values(each)
        near = common >= threshold * (counts[:, None] + counts[None, :] - common) - 1e-9
        np.fill_diagonal(near, False)
        if key["tile_a"] != key["tile_b"]:
            near &= own[:, None] != own[None, :]
        a, b = np.nonzero(np.triu(near))
        return {"cid": cid, "links": near @ copies, "root": cid[union_find(len(cid), a, b)]}

    counted = materialize(map_groups(dealt, ["component", "tile_a", "tile_b"], compared, "cid long, links long, root long"))
    joined = components(counted.select(F.col("cid").alias("src"), F.col("root").alias("dst")))
    linked = counted.groupBy("cid").agg(F.sum("links").alias("links"))
    facts = classes.select("cid", "h1", "h2", "copies", "rep").join(linked, "cid", "left").join(joined, F.col("cid") == F.col("node"), "left")
    facts = facts.select("cid", "h1", "h2", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    facts = materialize(facts)
    first = facts.groupBy("component").agg(F.min(F.struct("rep", "cid")).alias("first"))
    return rows.drop("sig"), facts.join(first, "component").select("cid", "h1", "h2", "rep", "n_links", "component", F.col("first.rep").alias("component_id"), F.col("first.cid").alias("first_class"))


def maybe_among(narrow: DataFrame, wanted: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """The rows of ``narrow`` whose ``x`` may be an ``x_`` of ``wanted``, so that few other texts are shuffled.

    Digests are marked in a table of ``bits`` bits, 32 a row, whatever the sizes
    of both, which is broadcast (8 MB). Where a bit is set for another digest, the row
    stays; none that is wanted goes.
    """
    place = lambda c: F.pmod(F.col(c), F.lit(bits))
    word = lambda c: F.shiftright(place(c), 5)
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod({c}, 32) as int))")
    marks = wanted.select(word("x_").alias("word"), bit("x_").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("marks"))
    return narrow.join(F.broadcast(marks), word("x") == F.col("word")).where(F.col("marks").bitwiseAND(bit("x")) != 0).drop("word", "marks")


def spanning(rep: np.ndarray, left: np.ndarray, right: np.ndarray) -> dict | None:
    """Links of each node to its component's first, for the nodes that have any."""
    if not len(left):
        return None
    root = union_find(len(rep), left, right)
    far = np.flatnonzero(root != np.arange(len(rep)))
    return {"src": rep[far], "dst": rep[root[far]]}


def common_values(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share.

    The sets' values are laid out by value; each value that several sets hold adds
    one to each two of its holders. Values are taken in blocks of bounded
    size, as products of 0/1 matrices of the shared values alone.
    """
    n = len(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    values, column, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = holders > 1
    keep = shared[column]
    column, row = (np.cumsum(shared) - 1)[column[keep]], row[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    total = np.zeros((n, n), np.float32)
    width = int(shared.sum())
    step = max(1, 4_000_000 // n)
    for lo in range(0, width, step):
        a, b = np.searchsorted(column, [lo, lo + step])
        one = np.zeros((n, min(step, width - lo)), np.float32)
        one[row[a:b], column[a:b] - lo] = 1
        total += one @ one.T
    total[np.arange(n), np.arange(n)] = [len(x) for x in sets]
    return total.astype(np.int64)


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents of ``docs`` that stay: one of each group, all that link with nothing, with their own columns, whatever their names.

    Of a group the document with the smallest id stays (see :func:`near_duplicates`).
    Rows that repeat id and text are copies, so one of them stays; rows with one
    id and different words are documents of their own.
    """
    rows, facts = resolved(docs, id_col, text_col, **options)
    whole = rows.join(facts.select("h1", "h2", "component"), ["h1", "h2"], "left")
    own = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    # of each component one id and text; a text without words is a component of its own
    stays = whole.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(own.alias("id"), "x")).alias("first")).select("first.id", "first.x")
    wordless = whole.where("component IS NULL").select(own.alias("id"), "x").distinct()
    per = rows.groupBy(own.alias("id"), F.col("x")).agg(F.count(F.lit(1)).alias("n"))
    stay = materialize(per.join(stays.unionByName(wordless).distinct().withColumn("stays", F.lit(True)), ["id", "x"], "left"))
    body = docs.toDF(*[f"k{i}" for i in range(len(docs.columns))])
    at = {c: F.col(f"k{i}") for i, c in enumerate(docs.columns)}
    ident, digest = F.coalesce(at[id_col].cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(at[text_col], F.lit("")))
    goes = stay.where("stays IS NULL OR n > 1").select("id", "x")
    kept = body.join(goes, (ident == goes["id"]) & (digest == goes["x"]), "left_anti")
    again = stay.where("stays AND n > 1").select("id", "x")
    if not again.isEmpty():
        once = body.join(again, (ident == again["id"]) & (digest == again["x"]), "left_semi")
        kept = kept.unionByName(once.withColumns({"i_": ident, "x_": digest}).dropDuplicates(["i_", "x_"]).drop("i_", "x_"))
    return kept.select(*[at[c].alias(c) for c in docs.columns])
