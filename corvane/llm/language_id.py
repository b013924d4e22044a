"""Language identification by compression.

Each language has a raw-content dictionary of a bounded sample of its labelled
texts. A text goes to the language under whose dictionary its blocks compress
smallest; it is rejected where the second smallest comes too near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import batches_by_bytes

UNKNOWN = "und"
#: Bytes that are compressed at once: what a dictionary saves is bounded, so in one long piece it would sink below any share.
BLOCK = 16_384
#: Passages of a language behind which a short text is compressed, their bytes, and the short pieces of each language by which they are levelled.
PASSAGES, PASSAGE, PROBES = 4, 4096, 12
PREDICTED = ["lang_pred", "score", "margin", "rejected"]


def fit_dictionaries(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", docs_per_lang: int = 200, dict_bytes: int = 60_000, seed: int = 5) -> dict[str, bytes]:
    """A dictionary for each language from at most ``docs_per_lang`` of its texts, ``dict_bytes`` in all.

    The sample is the texts first in the order of a digest of themselves, so it
    depends on the text and its label alone and is the same in each run. It is
    bounded however large the table is: each task keeps ``docs_per_lang`` texts
    of a language, and ``dict_bytes`` of each language reach the driver. Null, empty and letterless
    texts and null labels teach nothing. Copies of a text count once. A line
    for each language reaches the driver: languages are taken to be few. The
    languages come in the order of how many texts they have.
    """
    good = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).cast("string").alias("lang"), F.substring(F.col(text_col), 1, dict_bytes).alias("text"))
    good = good.withColumn("h", F.xxhash64("text", F.lit(seed)))
    counts = {r.lang: r.n for r in good.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return {}
    chance = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, 4.0 * docs_per_lang / max(n, 1))])
    drawn = good.where(F.pmod("h", F.lit(1 << 40)) / float(1 << 40) < chance[F.col("lang")]).dropDuplicates(["lang", "h"])
    first = drawn.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= docs_per_lang)
    texts: dict[str, list[bytes]] = {}
    # every text gives its share at most, and what short ones leave goes to the others: no more than that reaches the driver
    by_size = Window.partitionBy("lang").orderBy("size", "h")
    before = F.coalesce(F.sum("size").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = Window.partitionBy("lang")
    room = first.withColumn("size", F.octet_length("text")).withColumn("share", (F.lit(dict_bytes) - before) / (F.count(F.lit(1)).over(every) - F.row_number().over(by_size) + 1))
    level = F.ceil(F.max("share").over(every)).cast("int")
    for row in room.withColumn("level", level).select("lang", "level", "size", "h", F.substring(F.col("text"), F.lit(1), F.col("level")).alias("part")).orderBy("lang", "size", "h").collect():
        texts.setdefault(row.lang, []).append(row.part.encode()[: row.level])
    return {lang: b" ".join(texts[lang])[:dict_bytes] for lang in sorted(texts, key=lambda x: (-counts[x], x))}


def classify(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """``keep`` columns of ``df`` (doc_id) with lang_pred, score, margin and rejected: see :func:`predictions`."""
    keep = ["doc_id"] if keep is None else keep
    out = predictions(df, dictionaries, text_col, keep, **options)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *PREDICTED)


def identified(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that aren't rejected, with their own columns, whatever their names."""
    out = predictions(df, dictionaries, text_col, df.columns, **options).where(~F.col("rejected"))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(df.columns)])


def predictions(df: DataFrame, dictionaries: dict[str, bytes], text_col: str, keep: list[str], level: int = 6, margin: float = 0.002, least_bytes: int = 48) -> DataFrame:
    """The ``keep`` columns as k0, k1, ... with lang_pred, score, margin and rejected.

    The whole text is compressed once for each language, in blocks of ``BLOCK``
    bytes whose sizes are added up, so that the margin doesn't sink with the
    length. ``score`` is the share of the best language when each weighs two to
    the minus its compressed bits, ``margin`` how many bytes fewer the best
    needs than the second, by the second's. A text is rejected if its margin is below ``margin`` or it is
    ``und``: null, empty or without a letter (score and margin 0). With one
    language nothing is narrow.

    No dictionary shortens a text of a few words, so all sizes are equal there. A text of less than ``least_bytes``
    bytes is compressed behind passages of each language (the dictionary's end), and counts as what it adds to
    them, beside what short pieces of all languages add on average; a narrow margin doesn't reject it, as it is too short to tell: it keeps its best guess. Ties go to the first of ``dictionaries``.
    Repeated rows stay; an empty table gives no rows; other columns play no
    part, whatever their names. One narrow stage.
    """
    narrow = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"), *([] if text_col in keep else [F.col(text_col).alias("t")]))
    batches_by_bytes(df.sparkSession)
    shape = narrow.schema.fields[: len(keep)]
    at = keep.index(text_col) if text_col in keep else len(keep) + 1
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in shape] + ["lang_pred string", "score double", "margin double", "rejected boolean"])
    shared = df.sparkSession.sparkContext.broadcast([(k, v.decode("utf-8", "ignore").lower().encode()) for k, v in dictionaries.items()])  # languages times dict_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zs

        langs = [k for k, _ in shared.value]
        primed: list[tuple] = []

        def added(data: bytes) -> np.ndarray:
            """What each language's passages grow by when ``data`` follows them, above the average of short pieces of all languages."""
            if not primed:
                probes = [v[at : at + 8 + 3 * i] for _, v in shared.value for i in range(PROBES) for at in [i * (len(v) // 2) // PROBES]]
                for _, v in shared.value:
                    size = min(PASSAGE, len(v) // (2 * PASSAGES))
                    cut = len(v) - size * PASSAGES
                    before = zs.ZstdCompressionDict(v[:cut], dict_type=zs.DICT_TYPE_RAWCONTENT)
                    before.precompute_compress(level=level)
                    coder = zs.ZstdCompressor(level=level, dict_data=before, write_content_size=False, write_checksum=False, write_dict_id=False)
                    passages = [v[cut + i * size : cut + (i + 1) * size] for i in range(PASSAGES)]
                    primed.append((coder, passages, np.mean([sum(len(coder.compress(p + x)) for p in passages) for x in probes])))
            return np.array([sum(len(c.compress(p + data)) for p in passages) - mean for c, passages, mean in primed]) / PASSAGES

        coders = [zs.ZstdCompressor(level=level, dict_data=zs.ZstdCompressionDict(v, dict_type=zs.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for _, v in shared.value]
        for batch in batches:
            pred, score, gap, few = [], [], [], []
            for x, letters in zip(batch.column(at), batch.column(len(keep)).to_pylist(), strict=True):
                if not letters or not langs:
                    pred.append(UNKNOWN), score.append(0.0), gap.append(0.0), few.append(False)
                    continue
                data = f" {x.as_py().lower()} ".encode()
                blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
                short = len(data) - 2 < least_bytes
                sizes = added(data) if short else np.array([sum(len(c.compress(b)) for b in blocks) for c in coders], float)
                best = int(sizes.argmin())
                pred.append(langs[best])
                score.append(float(1 / np.exp2(np.maximum(-1000, 8 * (sizes[best] - sizes))).sum()))
                second = np.partition(sizes, 1)[1] if len(sizes) > 1 else np.inf
                gap.append(1.0 if np.isinf(second) else float((second - sizes[best]) / (len(data) if short else second)))
                few.append(short)
            rejected = [p == UNKNOWN or (g < margin and not f) for p, g, f in zip(pred, gap, few, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names[: len(keep)], "lang_pred", "score", "margin", "rejected"])

    return narrow.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether the id's digest keeps a document out of the fit."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, fit_on: DataFrame | None = None, id_col: str = "doc_id", **options) -> DataFrame:
    """Languages of ``docs`` by dictionaries of ``fit_on`` (``docs``, if none) that aren't held out.

    Of a row, only the text decides its prediction.
    """
    labelled = (docs if fit_on is None else fit_on).where(~held_out(id_col))
    fit = {k: options.pop(k) for k in ("docs_per_lang", "dict_bytes") if k in options}
    return classify(docs, fit_dictionaries(labelled, **fit), keep=[id_col], **options).withColumn("held_out", held_out(id_col))
