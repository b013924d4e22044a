"""Token counts: lengths of whole texts under a public sub-word model.

The encoder runs in Arrow batches and returns lengths only. Batches are cut by
bytes, not rows, and a text beyond ``split_bytes`` is encoded in parts that are
cut where no vocabulary piece can span the cut, so that the parts' lengths add
up to the length of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batches_by_bytes

#: The mark that the model writes for a space.
SPACE_MARK = "▁"


@lru_cache(maxsize=2)
def load_model(path: str):
    """The encoder and whether a cut before a space is safe under it."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = SentencePieceProcessor(model_file=path)
    spec = pb.ModelProto()
    spec.ParseFromString(model.serialized_model_proto())
    plain = spec.normalizer_spec.add_dummy_prefix and not spec.normalizer_spec.remove_extra_whitespaces and not spec.normalizer_spec.precompiled_charsmap
    user_defined = any(p.type == 4 for p in spec.pieces)
    spans = any(SPACE_MARK in p.piece.lstrip(SPACE_MARK) for p in spec.pieces)
    safe = plain and not user_defined and not spans
    return model, safe, touching(model) if safe and spec.trainer_spec.byte_fallback else None


def touching(model) -> set[str]:
    """Every two characters that stand side by side in a piece: no token spans a cut between two others."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}


def split_text(text: str, limit: int, pairs: set[str] | None = None) -> list[tuple[str, int]]:
    """Parts of ``text`` of about ``limit`` characters, and the tokens by which each part's own count is too great.

    A cut is made between a character that isn't a space and a space: the space
    itself goes, as the encoder puts one before every part. Where no space comes within
    ``limit`` characters (Chinese, Japanese, Thai, base64), a cut is made between two
    characters that stand side by side in no piece, of which the second doesn't
    follow a space in one either: the space that the encoder puts before
    the part is then a token of its own, and counts as one too many. A stretch without
    a cut stays whole, whatever its length.
    """
    parts, start, extra = [], 0, 0
    while len(text) - start > limit:
        cut = text.find(" ", start + limit)
        while cut != -1 and text[cut - 1] in (" ", SPACE_MARK):
            cut = text.find(" ", cut + 1)
        if cut == -1 or cut + 1 == len(text):
            cut = len(text)
        inner = None
        if pairs is not None and cut - start > 2 * limit:
            spots = range(start + limit, cut - 1)
            inner = next((i for i in spots if text[i - 1] not in " ▁" and text[i] not in " ▁" and text[i - 1 : i + 1] not in pairs and SPACE_MARK + text[i] not in pairs), None)
        if inner is not None:
            parts.append((text[start:inner], extra))
            start, extra = inner, 1
            continue
        if cut == len(text):
            break
        parts.append((text[start:cut], extra))
        start, extra = cut + 1, 0
    parts.append((text[start:], extra))
    return parts


def count_tokens(
    df: DataFrame,
    model_path: str,
    text_col: str = "text",
    keep: list[str] | None = None,
    limit: int = 4096,
    batch_bytes: int = 4_000_000,
    split_bytes: int = 200_000,
) -> DataFrame:
    """``keep`` columns of ``df`` with n_bytes, n_tokens and over_limit of each whole text.

    No begin, end or added special tokens, no truncation; strings like ``<s>``
    inside a text are ordinary text, the library's default. A null text counts
    as empty: 0 bytes and 0 tokens. Repeated rows stay, and an empty table gives
    no rows. Only ``keep`` and the text reach Python; clashing names in other
    columns don't matter. One narrow stage, no shuffle.
    """
    batches_by_bytes(df.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    own = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    narrow = df.select(*own, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    fields = [*narrow.schema.fields[:-1]]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in fields] + ["n_bytes long", "n_tokens long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, safe, pairs = load_model(model_path)

        def lengths(texts: list[str]) -> list[int]:
            return [len(x) for x in model.encode(texts, num_threads=1)]

        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            sizes = pc.binary_length(text).to_pylist()
            counts, held, held_bytes = [0] * len(sizes), [], 0

            def encode(rows: list[int], text=text, counts=counts) -> None:
                for i, n in zip(rows, lengths([text[i].as_py() for i in rows]), strict=True):
                    counts[i] = n

            for i, size in enumerate(sizes):
                if size > split_bytes and safe:
                    counts[i] = sum(lengths([part])[0] - extra for part, extra in split_text(text[i].as_py(), split_bytes, pairs))
                    continue
                if held and held_bytes + size > batch_bytes:
                    encode(held)
                    held, held_bytes = [], 0
                held.append(i)
                held_bytes += size
            if held:
                encode(held)
            arrays = [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "n_bytes", "n_tokens"])

    out = narrow.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
