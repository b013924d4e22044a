"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents become token pieces that fit a sequence. Pieces are dealt at random
into groups of bounded size; each group is evolved on several islands: a child
takes whole well-filled bins from one parent, what the other parent holds of
their pieces is removed, and the pieces of its broken bins are put back by best
fit. Between epochs each island's elite moves on to the next island. What the
groups' emptiest sequences hold is then packed together, so that no group leaves one of its own.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batches_by_bytes, map_groups, materialize

#: Texts below this code point are split alike by both libraries (tests check every one); others go to the first.
SHARED_BELOW = 0x250


@lru_cache(maxsize=2)
def load_encoder(path: str, ranks_path: str | None, pattern: str | None):
    """A function from a text to its ids as ``tokenizers`` gives them.

    Where the same vocabulary is at hand as ranks, plain Latin texts are encoded
    by the faster library, whose ids are equal there.
    """
    import regex
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path)
    special = regex.compile("|".join(regex.escape(t.content) for t in full.get_added_tokens_decoder().values()) or r"(?!)")

    def slow(text: str) -> np.ndarray:
        return np.array(full.encode(text, add_special_tokens=False).ids, "<u4")

    if not ranks_path:
        return slow
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    other = regex.compile(f"[^\\x00-\\u{SHARED_BELOW - 1:04x}]")

    def encode(text: str) -> np.ndarray:
        if (not text.isascii() and other.search(text)) or special.search(text):
            return slow(text)
        return quick.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4", copy=False)

    return encode


def token_pieces(df: DataFrame, path: str, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The documents' pieces: doc_id, piece, start, length, ids_crc32 (and ids, if asked for).

    A document is its text's ids and then ``end_id``; a null text is empty, so
    that it is ``end_id`` alone. Only a document beyond ``capacity`` is cut,
    into full pieces but for the first, which takes what is over.
    """
    batches_by_bytes(df.sparkSession)
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(path, ranks_path, pattern)
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py()), np.array([end_id], "<u4")).astype("<u4", copy=False)
                first = len(ids) % capacity
                cuts = [*([0] if first else []), *range(first, len(ids), capacity), len(ids)]
                for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    row = [doc.as_py(), piece, a, b - a, zlib.crc32(ids[a:b].tobytes())]
                    for column, x in zip(columns, row + [ids[a:b].astype("i4")] * with_ids, strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids, strict=True)], names=names)

    return narrow.mapInArrow(run, schema)


def fullest_pair(rest: np.ndarray, room: int) -> tuple[int, int]:
    """Places of the two of ``rest`` (ascending) that fill ``room`` best, without passing it; one or both may be -1."""
    if not len(rest) or rest[0] > room:
        return -1, -1
    larger = np.arange(np.searchsorted(rest, room, "right"))
    smaller = np.minimum(np.searchsorted(rest, room - rest[larger], "right"), larger) - 1
    best = int(np.argmax(rest[larger] + np.where(smaller >= 0, rest[smaller], 0)))
    return best, int(smaller[best])


def best_fit(lengths: list[int], items: list[int], assign: np.ndarray, free: list[int], capacity: int, tight: bool = False) -> None:
    """Puts ``items``, in their order, each into the fullest bin that takes it; else into a new one.

    ``assign`` (bin of each item) and ``free`` (room of each bin) are changed.
    Bins are found by their room: a bit for each amount that some bin has. If
    ``tight``, a new bin takes along the two later items that fill it best.
    """
    if tight:
        order = np.array(items[::-1], np.int64)
        ascending = np.array(lengths)[order]
        put = np.zeros(len(order), bool)
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, room in enumerate(free):
        if 0 < room < capacity:
            at[room].append(b)
            mask |= 1 << room
    for k, i in enumerate(items):
        n = lengths[i]
        if tight and put[len(items) - 1 - k]:
            continue
        above = mask >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = at[room].pop()
            if not at[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        assign[i] = b
        room -= n
        if tight and room + n == capacity:
            later = np.flatnonzero(~put[: len(items) - 1 - k])
            for j in fullest_pair(ascending[later], room):
                if j >= 0:
                    put[later[j]] = True
                    assign[order[later[j]]] = b
                    room -= int(ascending[later[j]])
        free[b] = room
        if room:
            at[room].append(b)
            mask |= 1 << room


def fitness(assign: np.ndarray, lengths: np.ndarray, capacity: int) -> float:
    """Few bins first; then bins of uneven fill, which leave room that can be used."""
    fill = np.bincount(assign, weights=lengths)
    return -len(fill) + float(np.mean((fill / capacity) ** 2))


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, as_list: list[int], capacity: int, rng: np.random.Generator, share: float, tight: bool = False) -> np.ndarray:
    """A child of parent ``a`` with whole bins of ``b``, the fullest first with some chance."""
    fill_b = np.bincount(b, weights=lengths)
    n = max(1, int(share * len(fill_b)))
    chosen = np.zeros(len(fill_b), bool)
    chosen[np.argsort(-(fill_b + rng.random(len(fill_b)) * capacity * 0.2))[:n]] = True
    injected = chosen[b]
    fill_a = np.bincount(a, weights=lengths)
    broken = np.zeros(len(fill_a), bool)
    broken[a[injected]] = True
    if not broken.all():
        kept = np.flatnonzero(~broken)
        poor = kept[np.argsort(fill_a[kept])[: 1 + len(kept) // 50]]  # some of the emptiest bins are opened too
        broken[poor] = True
    number = np.cumsum(~broken) - 1
    child = np.full(len(a), -1, np.int32)
    stay = ~broken[a]
    child[stay] = number[a[stay]]
    free = (capacity - fill_a[~broken]).astype(int).tolist()
    renumber = np.cumsum(chosen) - 1 + len(free)
    child[injected] = renumber[b[injected]]
    free += (capacity - fill_b[chosen]).astype(int).tolist()
    loose = np.flatnonzero(child < 0)
    loose = loose[np.argsort(-lengths[loose], kind="stable")]
    best_fit(as_list, loose.tolist(), child, free, capacity, tight)
    return child


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, seed: int, size: int, generations: int) -> list[np.ndarray]:
    """The island's population after ``generations``, best first; an empty one is begun by best fit in decreasing order."""
    rng = np.random.default_rng(seed)
    as_list = lengths.tolist()
    least = -(-int(lengths.sum()) // capacity)
    while len(population) < size:
        noise = 1 + (0 if not population else 0.15) * rng.random(len(lengths))
        assign, free = np.full(len(lengths), -1, np.int32), []
        best_fit(as_list, np.argsort(-lengths * noise, kind="stable").tolist(), assign, free, capacity)
        population.append(assign)
    scored = sorted(((fitness(p, lengths, capacity), i, p) for i, p in enumerate(population)), key=lambda x: (-x[0], x[1]))
    for g in range(generations):
        if scored[0][2].max() + 1 <= least:
            break  # no packing has fewer bins
        children = []
        for c in range(max(1, size // 2)):
            i, j = sorted(rng.choice(len(scored), 2, replace=False)) if len(scored) > 1 else (0, 0)
            child = crossover(scored[i][2], scored[j][2], lengths, as_list, capacity, rng, float(rng.uniform(0.05, 0.4)), tight=(g + c) % 2 == 0)
            children.append((fitness(child, lengths, capacity), (g + 1) * size + c, child))
        scored = sorted([*scored, *children], key=lambda x: (-x[0], x[1]))[:size]
    return [p for _, _, p in scored]


def pack_pieces(pieces: DataFrame, capacity: int = 2048, group: int = 4096, islands: int = 2, epochs: int = 2, generations: int = 6, population: int = 4, seed: int = 11) -> DataFrame:
    """``pieces`` (long column length, 1 to ``capacity``) with sequence_id and offset.

    Other columns go along untouched; repeated rows are separate pieces, and an
    empty table gives no rows. A full piece is a sequence of its own. A group's
    sequences that are at most half full are pieces of a further packing, in
    which ``group`` times fewer groups take part, until there is one.
    """
    rows = materialize(pieces.withColumn("rid", F.monotonically_increasing_id()))
    n = rows.where(F.col("length") < capacity).count()
    n_groups = max(1, -(-n // group))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(n_groups)))

    def gather(key: dict, t: pa.Table) -> dict:
        lengths, rid = t["length"].to_numpy(), t["rid"].to_numpy()
        order = np.lexsort((rid, -lengths))
        return {"grp": [key["grp"]], "lengths": [lengths[order].astype("<i4").tobytes()], "rids": [rid[order].astype("<i8").tobytes()]}

    gathered = materialize(map_groups(rows.where(F.col("length") < capacity).select("grp", "rid", "length"), ["grp"], gather, "grp long, lengths binary, rids binary", 4))
    state = gathered.select("grp", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", F.array().cast("array<binary>").alias("bins"))

    def epoch(e: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    lengths = np.frombuffer(row["lengths"], "<i4")
                    start = [np.frombuffer(x, "<i4").copy() for x in row["bins"]]
                    grown = evolve(lengths, start, capacity, hash((seed, row["grp"], row["island"], e)) & 0x7FFFFFFF, population + row["island"] % 2, generations)
                    row["bins"] = [x.astype("<i4").tobytes() for x in grown]
                    row["score"] = fitness(grown[0], lengths, capacity)
                    yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("grp", pa.int64()), ("island", pa.int32()), ("lengths", pa.binary()), ("bins", pa.list_(pa.binary())), ("score", pa.float64())]))

        return run

    spread = rows.sparkSession.sparkContext.defaultParallelism * 3
    for e in range(epochs):
        state = materialize(state.repartition(max(1, min(n_groups * islands, max(spread, n_groups // 8))), "grp", "island").mapInArrow(epoch(e), "grp long, island int, lengths binary, bins array<binary>, score double"))
        if e + 1 < epochs:
            elite = state.select("grp", ((F.col("island") + 1) % islands).cast("int").alias("island"), F.element_at("bins", 1).alias("elite"))
            state = state.join(elite, ["grp", "island"]).select("grp", "island", "lengths", F.concat(F.array("elite"), F.slice("bins", 1, population - 1)).alias("bins"))

    best = state.groupBy("grp").agg(F.max_by("bins", F.struct("score", -F.col("island"))).alias("bins"))
    chosen = gathered.join(best, "grp").select("grp", "lengths", "rids", F.element_at("bins", 1).alias("assign"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, rid, assign = (np.frombuffer(row[k], t) for k, t in (("lengths", "<i4"), ("rids", "<i8"), ("assign", "<i4")))
                order = np.argsort(assign, kind="stable")
                total = np.cumsum(lengths[order]) - lengths[order]
                first = np.r_[True, assign[order][1:] != assign[order][:-1]]
                offset = total - np.maximum.accumulate(np.where(first, total, 0))
                fill = np.bincount(assign, weights=lengths)[assign[order]]
                yield pa.RecordBatch.from_arrays([pa.array(rid[order]), pa.array(assign[order].astype("i8") + (row["grp"] << 20)), pa.array(offset.astype("i8")), pa.array(fill.astype("i8"))], names=["rid", "sequence_id", "offset", "fill"])

    placed = chosen.mapInArrow(place, "rid long, sequence_id long, offset long, fill long")
    if n_groups > 1:
        placed = materialize(placed)
        loose = placed.where((F.col("offset") == 0) & (F.col("fill") <= capacity // 2)).select(F.col("sequence_id").alias("from_id"), F.col("fill").alias("length"))
        joint = materialize(pack_pieces(loose, capacity, group, islands, epochs, generations, population, seed + 1))
        named = joint.groupBy("sequence_id").agg(F.min("from_id").alias("to_id"))  # a sequence takes over one of the ids that it unites
        moved = joint.join(named, "sequence_id").select(F.col("from_id").alias("sequence_id"), "to_id", F.col("offset").alias("base"))
        placed = placed.join(moved, "sequence_id", "left")
        placed = placed.select("rid", F.coalesce("to_id", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
    out = rows.drop("grp").join(placed.drop("fill"), "rid", "left")
    return out.withColumns({"sequence_id": F.coalesce("sequence_id", F.col("rid") + (n_groups << 20)), "offset": F.coalesce("offset", F.lit(0).cast("long"))}).drop("rid")


def pack_documents(df: DataFrame, path: str, ranks_path: str | None = None, pattern: str | None = None, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, **options) -> DataFrame:
    """Documents packed into sequences: :func:`token_pieces`, then :func:`pack_pieces`.

    Null and empty texts are one-token pieces; documents with the same id, or
    without one, are packed each on its own. Columns other than the two play
    no part, whatever their names; an empty table gives no rows.
    """
    pieces = token_pieces(df, path, ranks_path, pattern, id_col, text_col, capacity, with_ids=with_ids)
    return pack_pieces(pieces, capacity, **options)
