"""Repair of the structure of conversations at least cost.

Windows and native expressions flag each turn's fault. A conversation's turns, as
small structs in order, are folded by ``aggregate()``, which carries the cheapest
(cost, audit) for each of four states of the grammar ``(s?(ua)+)?``: nothing yet, after
s, after u, after a. A long conversation is folded in parts of bounded length, once for each
state that a part may begin in, and the parts are joined two by two.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import batches_by_bytes, materialize
from corvane.llm.merkle_manifest import numbered

#: Edits' initials and costs (fixed values); an undeleted truncated turn adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 1), ("D", 2), ("I", 5)
TRUNCATED = 5
#: States: nothing yet, after a system, user and assistant turn.
STATES = ("e", "s", "u", "a")
#: Adjacent role initials that are legal.
LEGAL = ("su", "ua", "au")
STATE_TYPE = "struct<cost:bigint,audit:string>"
SHOWN = r"[^\x20\x09-\x0D]"


def _read(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text and their digest; null roles and texts are one space."""
    own = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    return own.withColumn("digest", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))


def flagged(turns: DataFrame, **columns) -> DataFrame:
    """conv, turn, role, idx (place in the conversation), n (its turns) and fault of each turn; texts stay behind.

    A turn's fault is the first of blank (nothing but spaces, \\t to \\r), duplicate (role and text occur
    earlier in the conversation) and truncated (the last other character is none of ``.!?``), else null.
    Turns stand by turn (null first), then role and the digest of role and text.
    """
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    small = _read(turns, **columns).select("conv", "turn", "role", "digest", F.col("text").rlike(SHOWN).alias("shown"), end.isin(".", "!", "?").alias("ended"))
    placed = materialize(numbered(materialize(small), "conv", ["turn", "role", "digest"]))
    first = placed.groupBy(F.col("conv").alias("c_"), F.col("digest").alias("d_")).agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)
    seen = placed.join(first, F.col("conv").eqNullSafe(F.col("c_")) & (F.col("digest") == F.col("d_")), "left")
    fault = F.when(~F.col("shown"), "blank").when(F.col("idx") > F.col("first"), "duplicate").when(~F.col("ended"), "truncated")
    return seen.select("conv", "turn", "role", "idx", "n", fault.alias("fault"))


def _plus(state: Column, edit: tuple[str, int], more: Column | int = 0) -> Column:
    """A state's struct after one more edit; null stays null."""
    return F.when(state.isNotNull(), F.struct((state["cost"] + edit[1] + more).alias("cost"), F.concat(state["audit"], F.lit(edit[0])).alias("audit")))


def _inserted(acc: Column) -> Column:
    """Of the states in ``acc``, those that inserts before the next turn reach more cheaply."""
    u = F.least(acc["u"], _plus(acc["e"], INSERT), _plus(acc["s"], INSERT), _plus(acc["a"], INSERT))
    half = F.struct(acc["e"].alias("e"), acc["s"].alias("s"), u.alias("u"), acc["a"].alias("a"))
    return _let(half, lambda x: F.struct(x["e"].alias("e"), x["s"].alias("s"), x["u"].alias("u"), F.least(x["a"], _plus(x["u"], INSERT)).alias("a")))


def _let(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once."""
    return F.transform(F.array(value), use)[0]


def _step(acc: Column, turn: Column) -> Column:
    """The four states after one more turn, from those before it with their inserts."""

    def moved(g: Column) -> Column:
        stays, more = ~turn["must_go"], F.when(turn["cut"], TRUNCATED).otherwise(0)

        def kept(initial: str, before: Column) -> Column:
            return F.when(stays & (turn["initial"] == initial), _plus(before, KEEP, more))

        def reroled(before: Column) -> Column:
            return F.when(stays, _plus(before, REROLE, more))

        start = F.least(g["e"], g["s"], g["a"])  # what a user turn may follow
        return F.struct(
            _plus(g["e"], DELETE).alias("e"),
            F.least(_plus(g["s"], DELETE), kept("s", g["e"])).alias("s"),
            F.least(_plus(g["u"], DELETE), kept("u", start), reroled(start)).alias("u"),
            F.least(_plus(g["a"], DELETE), kept("a", g["u"]), reroled(g["u"])).alias("a"),
        )

    return _let(_inserted(acc), moved)


def _from(start: Column) -> Column:
    """The four states before the first turn of a part that begins in ``start``."""
    zero = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    return F.struct(*[F.when(start == s, zero).alias(s) for s in STATES])


def _counted(fault: str) -> Column:
    return F.sum(F.when(F.col("fault") == fault, 1).otherwise(0)).alias(fault)


def fold_parts(rows: DataFrame, part: int) -> DataFrame:
    """conv, part, parts, start, e, s, u, a, counts of faults and of illegal pairs, first and last initial of each part of ``rows``.

    The first part of a conversation begins in ``e``, others may begin in any state.
    """
    small = rows.select("conv", F.floor(F.col("idx") / part).alias("part"), F.ceil(F.col("n") / part).alias("parts"), "idx", "fault", F.substring("role", 1, 1).alias("initial"))
    inside = Window.partitionBy("conv", "part", "parts").orderBy("idx")
    small = small.withColumn("pair", F.concat(F.lag("initial").over(inside), F.col("initial")))
    turn = F.struct("idx", "initial", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("must_go"), F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("cut"))
    per = small.groupBy("conv", "part", "parts").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"),  # at most ``part`` of them
        _counted("blank"), _counted("duplicate"), _counted("truncated"),
        F.sum(F.when(F.col("pair").isNotNull() & ~F.col("pair").isin(*LEGAL), 1).otherwise(0)).alias("illegal"),
    )
    starts = F.when(F.col("part") == 0, F.array(F.lit("e"))).otherwise(F.array(*[F.lit(s) for s in STATES]))
    per = per.withColumn("start", F.explode(starts))
    folded = F.aggregate("turns", _from(F.col("start")), _step, _inserted)
    out = per.withColumn("states", folded)
    return out.select("conv", "part", "parts", "start", *[F.col(f"states.{s}").alias(s) for s in STATES], "blank", "duplicate", "truncated", "illegal", F.element_at("turns", 1)["initial"].alias("first"), F.element_at("turns", -1)["initial"].alias("last"))


def join_parts(parts: DataFrame) -> DataFrame:
    """Every two neighbouring parts as one: of the states between them, the cheapest, then the ASCII-least."""
    half, odd = F.floor(F.col("part") / 2), F.col("part") % 2 == 1
    left = parts.where(~odd).withColumn("half", half)
    right = parts.where(odd).select(F.col("conv").alias("c_"), half.alias("h_"), "start", F.struct(*STATES, "blank", "duplicate", "truncated", "illegal", "first", "last").alias("r"))
    by_start = right.groupBy("c_", "h_").pivot("start", list(STATES)).agg(F.first("r"))
    by_start = by_start.select("c_", "h_", *[F.col(s).alias(f"from_{s}") for s in STATES])
    both = left.join(by_start, left["conv"].eqNullSafe(by_start["c_"]) & (F.col("half") == F.col("h_")), "left")
    single = F.col("from_e").isNull()

    def through(end: str) -> Column:
        ways = [F.when(F.col(mid).isNotNull() & F.col(f"from_{mid}.{end}").isNotNull(), F.struct((F.col(mid)["cost"] + F.col(f"from_{mid}.{end}.cost")).alias("cost"), F.concat(F.col(mid)["audit"], F.col(f"from_{mid}.{end}.audit")).alias("audit"))) for mid in STATES]
        return F.when(single, F.col(end)).otherwise(F.least(*ways)).alias(end)

    across = F.when(single | F.concat(F.col("last"), F.col("from_e.first")).isin(*LEGAL), 0).otherwise(1)
    sums = [(F.col(c) + F.coalesce(F.col(f"from_e.{c}"), F.lit(0)) + (across if c == "illegal" else 0)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    return both.select("conv", F.col("half").alias("part"), F.ceil(F.col("parts") / 2).alias("parts"), "start", *[through(s) for s in STATES], *sums, "first", F.when(single, F.col("last")).otherwise(F.col("from_e.last")).alias("last"))


def repairs(rows: DataFrame, part: int = 256) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation of ``rows`` (see :func:`flagged`).

    ``audit`` is the initials of the cheapest edits in order, of equals the ASCII-least. Of paths that cost the
    same and have consumed the same turns none is another's beginning, so the least beginning stays the least.
    Pairs of initials are illegal unless they are su, ua or au; gaps are the numbers missing between the
    least and the greatest turn. The tree of parts is as high as the longest conversation needs, which is all that reaches the driver.
    """
    parts = fold_parts(rows, part)
    most = rows.agg(F.max("n")).first()[0] or 0
    most = -(-most // part)
    while most > 1:
        parts = join_parts(materialize(parts))
        most = (most + 1) // 2
    best = F.least("e", "a")
    turns = rows.groupBy("conv", "turn").agg(F.lit(1)).groupBy(F.col("conv").alias("c_")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    both = parts.join(turns, F.col("conv").eqNullSafe(F.col("c_")))
    return both.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"))


def repaired_turns(turns: DataFrame, made: DataFrame, **columns) -> DataFrame:
    """conv, pos, edit, role, text of the turns that the audits of ``made`` (conv, audit) keep, rerole and insert, in order.

    A conversation's audit and then its turns meet, in order, in one task, which
    streams through them and holds no more than the audit and a batch. A conversation's turns come one after another.
    """
    lines = _read(turns, **columns).select("conv", F.lit(None).cast("string").alias("audit"), "turn", "role", "digest", "text")
    nothing = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in lines.schema.fields}
    audits = made.select("conv", "audit", *[nothing[c] for c in ("turn", "role", "digest", "text")])
    both = audits.unionByName(lines).withColumns({"key": F.coalesce(F.col("conv").cast("string"), F.lit("")), "none": F.col("conv").isNull()})
    dealt = both.repartition("key", "none").sortWithinPartitions("none", "key", F.col("audit").isNull(), "turn", "role", "digest")
    batches_by_bytes(turns.sparkSession)
    kind = lines.schema["conv"].dataType.simpleString()
    names = ["conv", "pos", "edit", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, pos, last = "", 0, 0, ""
        for batch in batches:
            out: list[tuple] = []

            def insert(conv, out=out) -> None:
                """The inserts that stand next in the audit."""
                nonlocal at, pos, last
                while audit[at : at + 1] == INSERT[0]:
                    last = "assistant" if last[:1] == "u" else "user"
                    out.append((conv, pos, INSERT[0], last, ""))
                    at, pos = at + 1, pos + 1

            for conv, letters, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if letters is not None:
                    audit, at, pos, last = letters, 0, 0, ""
                    insert(conv)
                    continue
                edit, at = audit[at], at + 1
                if edit != DELETE[0]:
                    last = role if edit == KEEP[0] else "assistant" if last[:1] == "u" else "user"
                    out.append((conv, pos, edit, last, text))
                    pos += 1
                insert(conv)
            if out:
                types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return dealt.select("conv", "audit", "role", "text").mapInArrow(run, f"conv {kind}, pos long, edit string, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """conv and repaired_sha256: of ``role:text``, joined by newlines, of each conversation that has turns. Takes :func:`repaired_turns` as they come."""
    import hashlib

    kind = repaired.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, arrow = None, None, None
        for batch in batches:
            arrow = batch.schema.field("conv").type
            done: list[tuple] = []
            for c, pos, role, text in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("conv", "pos", "role", "text")), strict=True):
                if pos == 0:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256()
                digest.update(f"{'' if pos == 0 else chr(10)}{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], arrow), pa.array([x[1] for x in done])], names=["conv", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], arrow), pa.array([digest.hexdigest()])], names=["conv", "repaired_sha256"])

    return repaired.mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def repair(turns: DataFrame, part: int = 256, **columns) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation of ``turns``.

    Keep costs 0, a new role (user or assistant) 1, deletion 2 (blank and duplicate turns must go), an inserted
    empty user or assistant turn 5; a truncated turn that stays adds 5. A conversation whose turns all go has the digest of
    an empty text. Null roles and texts are one space, a null conversation is a conversation, a null
    turn comes first; repeated rows are duplicates. An empty table gives no rows; other columns play no part, whatever
    their names. Texts of any length are read whole; only digests, flags and letters enter the fold.
    """
    rows = materialize(flagged(turns, **columns))
    made = materialize(repairs(rows, part))
    sums = digests(repaired_turns(turns, made.select("conv", "audit"), **columns)).withColumnRenamed("conv", "c_")
    out = made.join(sums, F.col("conv").eqNullSafe(F.col("c_")), "left")
    return out.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))
