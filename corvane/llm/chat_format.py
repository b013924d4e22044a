"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, and its text alone trainable. Turns are rendered once, in parallel;
a conversation's rendered turns are then joined in chunks to the examples.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: The template's control strings (fixed values).
TURN_START = "### "
ROLE_END = ": "
TURN_END = "</turn>"
AFTER_TURN = "\n"

_TURN = regex.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", regex.S)
_ESCAPED = regex.compile(r"\\(.)", regex.S)


def escape(text: Column) -> Column:
    """The text with a backslash before each backslash and each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("###"), F.lit("\\###")), F.lit(TURN_END), F.lit("\\" + TURN_END))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted text; the inverse of the formatting."""
    turns, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError("the text is not a sequence of turns")
        turns.append((_ESCAPED.sub(r"\1", m[1]), _ESCAPED.sub(r"\1", m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("the text is not a sequence of turns")
    return turns


def expand(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trainable: str = "assistant", chunk: int = 64) -> DataFrame:
    """One row for each assistant turn: conv_id, example (its last turn's place), n_turns, text, loss_start, loss_end, final.

    ``text`` is the conversation up to and with that turn, and code points
    [``loss_start``, ``loss_end``) are the reply's (escaped) text: the only
    trainable part. What follows the last assistant turn, or a conversation
    without one, is a last row with the whole conversation and an empty loss.
    ``final`` marks the conversation's longest example.

    Turns are ordered by turn (null first), then role and text, so repeated
    rows stay and are turns. Null texts and roles are empty; a null conv_id is
    a conversation, and ids may be of any type that can be grouped. An empty table gives no rows;
    other columns play no part, whatever their names. A conversation of any length is spread by ``chunk`` turns
    over tasks: a task holds the text before its chunk, which each of its
    examples must hold in any case, and writes them one by one.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    own = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("body"))
    head = F.concat(F.lit(TURN_START), escape_role(F.col("role")), F.lit(ROLE_END))
    own = own.withColumns({"head": head, "inner": escape(F.col("body"))})
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    own = own.withColumns({"at": F.row_number().over(order) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("conv_id"))})
    own = own.select("conv_id", "at", F.floor(F.col("at") / chunk).alias("part"), F.floor((F.col("n") - 1) / chunk).alias("last"), (F.col("role") == trainable).alias("train"), "head", "inner")
    line = F.struct("at", "train", "head", "inner")
    rendered = own.groupBy("conv_id", "part", "last").agg(F.array_sort(F.collect_list(line)).alias("lines"))  # at most ``chunk`` turns
    joined = F.array_join(F.transform("lines", lambda x: F.concat(x["head"], x["inner"], F.lit(TURN_END + AFTER_TURN))), "")
    rendered = rendered.withColumn("whole", joined)
    # each part goes to itself and to those after it
    sent = rendered.select("conv_id", F.col("part").alias("from_part"), F.explode(F.sequence("part", "last")).alias("part"), "last", "lines", "whole")
    mine = F.col("from_part") == F.col("part")
    gathered = sent.groupBy("conv_id", "part").agg(
        F.max("last").alias("last"),
        F.array_sort(F.collect_list(F.when(~mine, F.struct("from_part", "whole")))).alias("before"),
        F.first(F.when(mine, F.col("lines")), ignorenulls=True).alias("lines"),
    )
    chunks = gathered.select("conv_id", "part", "last", F.array_join(F.transform("before", lambda x: x["whole"]), "").alias("context"), "lines")
    kind, first = turns.schema[conv_col].dataType.simpleString(), to_arrow_type(turns.schema[conv_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made, size, text, train = [], 0, row["context"], False
                for x in row["lines"]:
                    start = len(text) + len(x["head"])
                    text = f"{text}{x['head']}{x['inner']}{TURN_END}{AFTER_TURN}"
                    train = x["train"]
                    if train:
                        made.append((row["conv_id"], x["at"], x["at"] + 1, text, start, start + len(x["inner"]), row["part"] == row["last"] and x is row["lines"][-1]))
                        size += len(text)
                    if size > 4_000_000:
                        yield batch_of(made, first)
                        made, size = [], 0
                if row["part"] == row["last"] and not train:
                    made.append((row["conv_id"], row["lines"][-1]["at"] + 1, row["lines"][-1]["at"] + 1, text, len(text), len(text), True))
                if made:
                    yield batch_of(made, first)

    examples = chunks.mapInArrow(run, f"conv_id {kind}, example long, n_turns long, text string, loss_start long, loss_end long, final boolean")
    return examples


def batch_of(rows: list[tuple], first: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "example", "n_turns", "text", "loss_start", "loss_end", "final"]
    types = [first, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation as its formatted examples give it back.

    The turns come from the final example, which holds them all, the trainable
    texts from every example's loss span; both are unescaped. ``formatted_chars`` counts all
    examples' code points. Each example is read where it is made, and only
    its loss text and digests move.
    """
    import hashlib

    kind = examples.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, n, text, start, end, final = (batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "n_turns", "text", "loss_start", "loss_end", "final"))
            digest, loss, chars, count = [], [], [], []
            for i in range(batch.num_rows):
                t = text[i].as_py()
                turns = parse(t) if final[i].as_py() else None
                count.append(None if turns is None else len(turns))
                h = hashlib.sha256()
                for role, body in turns or []:
                    h.update(f"{role}\n{body}\n".encode())
                digest.append(None if turns is None else h.hexdigest())
                loss.append(_ESCAPED.sub(r"\1", t[start[i].as_py() : end[i].as_py()]))
                chars.append(len(t))
            yield pa.RecordBatch.from_arrays([conv, n, pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(loss, pa.string()), pa.array(chars, pa.int64())], names=["conv_id", "n", "n_turns", "sha", "loss", "chars"])

    read = examples.select("conv_id", "n_turns", "text", "loss_start", "loss_end", "final").mapInArrow(run, f"conv_id {kind}, n long, n_turns long, sha string, loss string, chars long")
    per = read.groupBy("conv_id").agg(
        F.max(F.struct("n_turns", "sha")).alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return per.select("conv_id", "whole.n_turns", F.col("whole.sha").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
