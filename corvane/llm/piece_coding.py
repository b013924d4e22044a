"""SentencePiece encoding and decoding with merge-type vocabularies.

A text is cut into words, at its spaces, and a word into units that no piece can span. A unit's characters are merged
by an agenda of adjacent pairs: the pair whose piece has the highest score goes
first, the leftmost of equals, until no pair makes a piece. What has no piece
falls back to its UTF-8 bytes. All of it runs in Arrow batches: a batch's distinct
words are coded once, where units of one length are merged side by side, each by its own
agenda; and the sentencepiece library, which codes the same batch, says whether both agree.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batches_by_bytes
from corvane.llm.token_count import SPACE_MARK, load_model, split_text

#: Kinds of pieces in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What the library writes for the unknown id (a fixed value).
UNKNOWN_TEXT = " ⁇ "
#: Words, and characters in them, beyond which a worker forgets the ids that it keeps.
KEPT_UNITS, KEPT_CHARS = 1 << 20, 1 << 24
#: Characters of a word whose units are found at once; words that are coded, or put into texts, at once.
TEXT_AT_ONCE, UNITS_AT_ONCE = 1 << 20, 1 << 18
#: Bits of a symbol's number; an agenda's entry is a rank above a place.
WIDTH, PLACE_BITS = 24, 32
PLACE = (1 << PLACE_BITS) - 1
RANK = ~PLACE
NEVER = 1 << 62
#: Symbols up to which a list is the quicker agenda.
SHORT = 40
#: Units of one length from which they are merged side by side, and symbols of such units at once.
FEW, SYMBOLS_AT_ONCE = 32, 1 << 17


class Numbers(dict):
    """Words or units and their numbers, in the order in which they are met; ``fresh`` has those whose ids aren't known yet."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.fresh.append(unit)
        self[unit] = n = len(self)
        return n


def runs(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of ``values``, one behind the other."""
    ends = np.cumsum(counts)
    return values[np.repeat(starts - ends + counts, counts) + np.arange(counts.sum())]


class MergeVocabulary:
    """Encoder and decoder of a merge-type model file.

    Models of other types, with symbols of the user's own or with a normalizer that
    rewrites characters raise ValueError: their rules aren't those of this agenda.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rules, trainer = spec.normalizer_spec, spec.trainer_spec
        kinds = {p.type for p in spec.pieces}
        if trainer.model_type != trainer.BPE or kinds & {USER_DEFINED, UNUSED} or rules.precompiled_charsmap or rules.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix or not rules.escape_whitespaces:
            raise ValueError("not a plain merge-type vocabulary")
        self.prefix = SPACE_MARK if rules.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in spec.pieces if p.type == NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == UNKNOWN)
        self.end = next((i for i, p in enumerate(spec.pieces) if p.piece == (trainer.eos_piece or "</s>")), -1)
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.controls = np.array([p.type == CONTROL for p in spec.pieces])
        shown = {UNKNOWN: UNKNOWN_TEXT, CONTROL: ""}
        self.raw = [bytes([self.byte_of[i]]) if p.type == BYTE else shown.get(p.type, p.piece.replace(SPACE_MARK, " ")).encode() for i, p in enumerate(spec.pieces)]
        self.raw_of = np.array(self.raw, object)
        self.names = np.array([f"{i} ".encode() for i in range(len(spec.pieces))])
        long = [p for p in self.ids if len(p) > 1]
        self.touching = {p[i : i + 2] for p in long for i in range(len(p) - 1)}
        self.units = self._units(long)
        self._pairs(long)
        self._forget()

    def _pairs(self, long: list[str]) -> None:
        """What pairs of symbols make, by rank of score. A symbol is a piece's id; characters that are no piece but stand in one have numbers after the pieces'."""
        scores = sorted({self.scores[p] for p in long}, reverse=True)
        rank = {x: i for i, x in enumerate(scores)}
        times = Counter(self.scores[p] for p in long)
        self.tied = {rank[x] for x, n in times.items() if n > 1}
        self.parts = sorted(set("".join(long)) - self.ids.keys())
        self.symbols = self.ids | {c: len(self.names) + i for i, c in enumerate(self.parts)}
        self.made: dict[int, int] = {}
        for p in long:
            for i in range(1, len(p)):
                a, b = self.symbols.get(p[:i]), self.symbols.get(p[i:])
                if a is not None and b is not None:
                    self.made[a << WIDTH | b] = rank[self.scores[p]] << PLACE_BITS | self.ids[p]
        # the same as arrays, whose last entry is for pairs that make nothing; and symbols by code point
        made = np.array([*self.made.values(), NEVER], np.int64)
        self.pairs, self.made_rank, self.made_id = pd.Index(np.array(list(self.made), np.int64)), made & RANK, (made & PLACE).astype(np.int32)
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for c, x in self.symbols.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = x

    def _units(self, long: list[str]) -> re.Pattern:
        """Matches a text's units: a character that stands in no longer piece is one, and where no piece has a space after another character, spaces begin one."""
        joined = sorted(set("".join(long)) - {SPACE_MARK})
        inner = "".join(map(re.escape, joined))
        self.spaced = spaced = any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in long)
        if not inner:
            return re.compile(f"{SPACE_MARK}+|[^{SPACE_MARK}]", re.S)
        if spaced:
            return re.compile(f"[{SPACE_MARK}{inner}]+|[^{SPACE_MARK}{inner}]", re.S)
        return re.compile(f"{SPACE_MARK}+[{inner}]*|[{inner}]+|[^{SPACE_MARK}{inner}]", re.S)

    def merged(self, symbols: list[int]) -> list[int]:
        """The symbols that are left of ``symbols`` when the agenda is empty; it is used up."""
        n, made = len(symbols), self.made.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            if (pair := made(symbols[i] << WIDTH | symbols[i + 1])) is not None:
                agenda.append(pair & RANK | i)
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            i = entry & PLACE
            j = after[i]
            if symbols[i] < 0 or j == n:
                continue  # merged into the one before, or nothing is left after it
            pair = made(symbols[i] << WIDTH | symbols[j])
            if pair is None or pair & RANK != entry & RANK:
                continue  # one of the two has grown since
            symbols[i], symbols[j] = pair & PLACE, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (pair := made(symbols[i] << WIDTH | symbols[k])) is not None:
                    heappush(agenda, pair & RANK | i)
            if (h := before[i]) >= 0 and (pair := made(symbols[h] << WIDTH | symbols[i])) is not None:
                heappush(agenda, pair & RANK | h)
        return [s for s in symbols if s >= 0]

    def merged_short(self, symbols: list[int]) -> list[int]:
        """As :meth:`merged`, for a few symbols: the agenda is a list beside them, whose least entry is the next."""
        made, tied = self.made.get, self.tied
        agenda = [made(a << WIDTH | b, NEVER) for a, b in pairwise(symbols)]
        while agenda and (least := min(agenda)) != NEVER:
            rank = least >> PLACE_BITS
            i = next(i for i, x in enumerate(agenda) if x >> PLACE_BITS == rank) if rank in tied else agenda.index(least)
            symbols[i] = s = agenda[i] & PLACE
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = made(s << WIDTH | symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = made(symbols[i - 1] << WIDTH | s, NEVER)
        return symbols

    def merged_all(self, symbols: np.ndarray) -> np.ndarray:
        """As :meth:`merged`, for many units of equal length side by side, a unit a column: merged symbols are where their first one was, -1 is where the others were."""
        n, m = symbols.shape
        # two more rows stand for what is after a unit and, found by -1, before it
        places = np.arange((n + 2) * m).reshape(n + 2, m)
        before, after = np.roll(places, 1, 0).ravel(), np.roll(places, -1, 0).ravel()
        left = np.full((n + 2) * m, -1, np.int32)
        left[: n * m] = symbols.ravel()
        agenda, makes = np.full((n + 2) * m, NEVER, np.int64), np.zeros((n + 2) * m, np.int32)

        def pair(at: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            got = self.pairs.get_indexer(a.astype(np.int64) << WIDTH | b)
            agenda[at], makes[at] = self.made_rank[got] | at, self.made_id[got]

        pair(places[: n - 1].ravel(), left[: (n - 1) * m], left[m : n * m])
        firsts = agenda[: (n - 1) * m].reshape(n - 1, m)
        while len(i := (least := firsts.min(0))[least < NEVER] & PLACE):
            j, h = after[i], before[i]
            k = after[j]
            grown = makes[i]
            left[i], left[j], agenda[j] = grown, -1, NEVER
            after[i], before[k] = k, i
            pair(i, grown, left[k])
            pair(h, left[h], grown)
        return left[: n * m].reshape(n, m)

    def fallback(self, char: str) -> tuple[int, ...]:
        """The ids of a character that is no piece."""
        return tuple(self.byte_ids[x] for x in char.encode()) if self.byte_ids else (self.unknown,)

    def unit_ids(self, unit: str) -> tuple[int, ...]:
        """The ids of a unit."""
        out: list[int] = []
        for s in self._symbols(unit):
            if s < len(self.names):
                out.append(s)
            else:
                out += self.fallback(self.parts[s - len(self.names)])
        return tuple(out) if out else self.fallback(unit)

    def _forget(self) -> None:
        self.numbers, self.chars = Numbers(), 0
        self.starts, self.counts, self.coded = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self) -> None:
        """Codes the fresh words. Where a word's ids begin among all, and how many they are, is kept by its number."""
        units, numbers, ends = Numbers(), array("q"), array("q", [0])
        for word in self.numbers.fresh:
            found = self.units.findall(word) if len(word) <= TEXT_AT_ONCE else (m[0] for m in self.units.finditer(word))
            numbers.extend(map(units.__getitem__, found))
            ends.append(len(numbers))
            self.chars += len(word)
        starts, counts, coded = self._coded(units.fresh)
        numbers = np.array(numbers, np.int64)
        until = np.append(0, np.cumsum(counts[numbers]))[np.array(ends)]
        self.starts, self.counts = np.append(self.starts, len(self.coded) + until[:-1]), np.append(self.counts, np.diff(until))
        self.coded = np.append(self.coded, runs(coded, starts[numbers], counts[numbers]))
        self.numbers.fresh = []

    def _coded(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each of ``fresh`` units begin, how many they are, and the ids: short units of one length are merged side by side, others one by one."""
        if not fresh:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        lengths = np.fromiter(map(len, fresh), np.int64, len(fresh))
        symbols = self.symbol_of[np.frombuffer("".join(fresh).encode("utf-32-le"), "<u4")]
        begin = np.cumsum(lengths) - lengths
        alone = np.add.reduceat((symbols < 0) | (symbols >= len(self.names)), begin, dtype=np.int64) > 0
        alone |= lengths > SHORT
        starts, counts = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        coded, end = [], 0

        def keep(units: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
            nonlocal end
            starts[units], counts[units] = end + np.cumsum(n) - n, n
            coded.append(ids)
            end += len(ids)

        for n in np.unique(lengths[~alone]):
            units = np.flatnonzero((lengths == n) & ~alone)
            if n > 1 and len(units) < FEW:
                alone[units] = True
                continue
            for some in np.array_split(units, len(units) * n // SYMBOLS_AT_ONCE + 1):
                left = symbols[begin[some] + np.arange(n)[:, None]]
                left = (self.merged_all(left) if n > 1 else left).T
                keep(some, left[left >= 0], (left >= 0).sum(1))
        for u in np.flatnonzero(alone):
            ids = np.array(self.unit_ids(fresh[u]), np.int32)
            keep(np.array([u]), ids, np.array([len(ids)]))
        return starts, counts, np.concatenate(coded)

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`_coded`, for words; the ids of those met before are kept."""
        counts, coded = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for at in range(0, len(words), UNITS_AT_ONCE):
            some = words.slice(at, UNITS_AT_ONCE).to_numpy(zero_copy_only=False).tolist()
            try:
                numbers = np.fromiter(map(self.numbers.__getitem__, some), np.int64, len(some))
                self._learn()
            except BaseException:
                self._forget()  # numbers without ids would put later ones out of step
                raise
            counts.append(self.counts[numbers])
            coded.append(runs(self.coded, self.starts[numbers], counts[-1]))
            if len(self.numbers) > KEPT_UNITS or self.chars > KEPT_CHARS:
                self._forget()
        n = np.concatenate(counts)
        return np.cumsum(n) - n, n, np.concatenate(coded)

    def _symbols(self, unit: str) -> list[int]:
        """What is left of a unit's symbols; nothing of a character that stands in no piece, which is a unit of its own."""
        symbols = list(map(self.symbols.get, unit))
        if len(symbols) <= SHORT:
            return [] if symbols == [None] else self.merged_short(symbols)
        # a long unit is cut where no piece can span the cut, so that an agenda is no longer than it must be
        cuts = [0, *(i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in self.touching), len(unit)]
        return [s for a, b in pairwise(cuts) for s in self.merged(symbols[a:b])]

    def _words(self, texts: pa.Array) -> pa.Array:
        """The words of each text, spaces as marks before them: a cut is where a mark follows another character, if no piece spans that."""
        cut = "" if self.spaced else " "
        marked = pc.replace_substring(pc.replace_substring(texts, SPACE_MARK, " "), " ", cut + SPACE_MARK)
        if self.prefix:
            marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(self.prefix, texts.type), marked, pa.scalar("", texts.type)))
        for _ in range(2):  # a replacement takes every other cut of a run of marks
            marked = pc.replace_substring(marked, SPACE_MARK + " " + SPACE_MARK, SPACE_MARK * 2)
        return pc.split_pattern(marked, " ")

    def _whole(self, ids: np.ndarray, end: bool) -> np.ndarray:
        """A text's ids from those of its words."""
        if not self.byte_ids and len(ids):  # without bytes, neighbours that are unknown share one id
            unknown = ids == self.unknown
            ids = ids[~(unknown & np.append(False, unknown[:-1]))]
        return np.append(ids, np.int32(self.end)) if end else ids

    def encode_all(self, texts: Sequence[str] | pa.Array, end: bool = False) -> Iterator[np.ndarray]:
        """The ids of each of ``texts``, without begin id, with ``end`` with the end id."""
        lists = self._words(pa.array(texts, pa.large_string()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_string()))
        words = lists.flatten().dictionary_encode()
        starts, counts, coded = self._table(words.dictionary)
        numbers = words.indices.to_numpy()
        ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        first, n = 0, len(lists)
        while first < n:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + UNITS_AT_ONCE, "right")) - 1)
            some = numbers[ends[first] : ends[last]]
            until = np.append(0, np.cumsum(counts[some]))[ends[first : last + 1] - ends[first]]
            ids = runs(coded, starts[some], counts[some])
            for a, b in pairwise(until):
                yield self._whole(ids[a:b], end)
            first = last

    def encode(self, text: str, end: bool = False) -> list[int]:
        """The ids of ``text``, as :meth:`encode_all` has them."""
        return next(self.encode_all([text], end)).tolist()

    def digits(self, ids: np.ndarray) -> bytes:
        """The decimals of ``ids``, joined by a space."""
        return self.names[ids].tobytes().translate(None, b"\0")[:-1]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ``ids``: control ids are nothing, bytes that aren't UTF-8 one U+FFFD each, and the space that encoding puts first goes."""
        body = next((i for i in ids if self.raw[i]), None)
        ids = np.asarray(ids, np.int32)
        try:
            text = b"".join(self.raw_of[ids].tolist()).decode() if not self.controls[ids[:-1]].any() else self._by_runs(ids.tolist())
        except UnicodeDecodeError:
            text = self._by_runs(ids.tolist())
        drop = self.prefix and body is not None and body not in self.byte_of and body != self.unknown and text.startswith(" ")
        return text[1:] if drop else text

    def _by_runs(self, ids: list[int]) -> str:
        """As :meth:`decode`, with the space: each run of bytes' ids is read for itself, so that other ids part them."""
        out: list[str] = []
        run = bytearray()

        def close() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
            else:
                close()
                out.append(self.raw[i].decode())
        close()
        return "".join(out)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> MergeVocabulary:
    return MergeVocabulary(path)


def library_ids(model_path: str, text: str, split_bytes: int) -> np.ndarray:
    """The library's ids of ``text``, a long one coded in parts cut where no piece can span the cut."""
    model, safe, pairs = load_model(model_path)
    if len(text) <= split_bytes or not safe:
        return model.encode(text, return_type="numpy")
    return np.concatenate([model.encode(part, return_type="numpy")[extra:] for part, extra in split_text(text, split_bytes, pairs)])


def _mapped(df: DataFrame, keep: list[str], value: F.Column, made: str, names: list[str], code) -> DataFrame:
    """``keep`` columns of ``df`` with what ``code`` makes of each batch of ``value``."""
    batches_by_bytes(df.sparkSession)
    narrow = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], value.alias("v"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]] + [made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *code(batch.column(batch.num_columns - 1))], names=[*batch.schema.names[:-1], *names])

    out = narrow.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names)


def encode(df: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None, end: bool = True) -> DataFrame:
    """``keep`` columns (doc_id) of ``df`` with ids: those of each whole text, a null text's being an empty text's.

    No begin id, ``end`` adds the end id; strings like ``<s>`` in a text are ordinary text.
    Repeated rows stay, an empty table gives no rows, and other columns play no part, whatever their names.
    """

    def code(texts: pa.Array) -> list[pa.Array]:
        v = vocabulary(model_path)
        return [pa.array(list(v.encode_all(texts, end)), pa.list_(pa.int32()))]

    return _mapped(df, keep or ["doc_id"], F.coalesce(F.col(text_col), F.lit("")), "ids array<int>", ["ids"], code)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id) of ``df`` with text: what its ids say; null ids give null, null members are left out."""

    def code(lists: pa.Array) -> list[pa.Array]:
        v = vocabulary(model_path)
        return [pa.array([None if x is None else v.decode([i for i in x if i is not None]) for x in lists.to_pylist()], pa.string())]

    return _mapped(df, keep or ["doc_id"], F.col(ids_col), "text string", ["text"], code)


def round_trip(df: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None, check: bool = True, split_bytes: int = 200_000) -> DataFrame:
    """``keep`` columns (doc_id) of ``df`` with n_tokens, ids_sha256, decoded_sha256 and agrees of each whole text.

    The ids are those of :func:`encode` with the end id, as decimals joined by a space;
    the decoded text is :func:`decode`'s of them. ``agrees`` says whether the
    sentencepiece library, given the same text, has the same ids and the same decoded text (null without
    ``check``). A null text is an empty one: the end id alone, and nothing decoded.
    Repeated rows stay, an empty table gives no rows, other columns play no part, whatever their names.
    One narrow stage; only digests leave a task. A stretch of one unit
    (base64, say) is merged at once, in memory in proportion to its length.
    """

    def code(texts: pa.Array) -> list[pa.Array]:
        v = vocabulary(model_path)
        model = load_model(model_path)[0] if check else None
        counts, digests, decoded, agrees = [], [], [], []
        for x, coded in zip(texts, v.encode_all(texts, end=True), strict=True):
            text, back = x.as_py(), v.decode(coded)
            counts.append(len(coded))
            digests.append(hashlib.sha256(v.digits(coded)).hexdigest())
            decoded.append(hashlib.sha256(back.encode()).hexdigest())
            agrees.append(None if model is None else np.array_equal(coded[:-1], library_ids(model_path, text, split_bytes)) and back == model.decode(coded))
        return [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())]

    names = ["n_tokens", "ids_sha256", "decoded_sha256", "agrees"]
    return _mapped(df, keep or ["doc_id"], F.coalesce(F.col(text_col), F.lit("")), "n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean", names, code)
