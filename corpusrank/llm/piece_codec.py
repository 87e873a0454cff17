"""SentencePiece encoding and decoding through a table of distinct words.

No piece of the vocabulary holds a whitespace marker after another character, so no piece crosses the start
of a marked word and the words of a text are segmented independently. Each task cuts its texts into marked
words, segments every distinct word once and joins the ids back by position (a numpy gather). The table of
distinct words belongs to a slice of texts of bounded size: a single table for the whole corpus would move
every word position through two shuffles.

Ids are exactly those of the library for the whole text, with the end id appended and no sampling.

Defined cases: a null text counts as empty; an empty text has the end id alone and decodes to an empty text; a very
long text is a slice of its own; repeated rows are coded each; all other columns stay, but for those named as the
result's, which are replaced.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import drop_columns, releasing, slices

#: Text of a slice, in bytes, and distinct words that a task remembers between slices.
SLICE_CHARS = 500_000
WORDS_KEPT = 120_000
_MARK = "▁"


def _processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def check_model(sp) -> None:
    """Raise unless pieces cannot cross the start of a marked word and normalisation leaves texts alone."""
    for i in range(sp.get_piece_size()):
        if _MARK in sp.id_to_piece(i).lstrip(_MARK):
            raise ValueError(f"piece {sp.id_to_piece(i)!r} crosses a whitespace marker")
    if sp.decode(sp.encode(" ½  x ")) != " ½  x ":
        raise ValueError("the model normalises its input; words would not be independent")


def words_of(text: str) -> list[str]:
    """The marked words of a text, each without its first marker and with blanks for the further ones.

    The lone marker that a single last blank leaves is given as the marker itself.
    """
    if not text:
        return []
    parts = text.replace(_MARK, " ").split(" ")
    if "" not in parts:
        return parts
    out, run = [], 0
    for p in parts:
        if p:
            out.append(" " * run + p)
            run = 0
        else:
            run += 1
    if run:
        out.append(" " * (run - 1) or _MARK)
    return out


class WordTable:
    """Ids of distinct words, each segmented once."""

    def __init__(self, sp):
        self.sp, self.lone, self.end = sp, sp.piece_to_id(_MARK), sp.eos_id()
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.lens: list[int] = []

    def encode(self, texts: list[str]) -> pa.ListArray:
        if len(self.place) > WORDS_KEPT:
            self.clear()
        words = [words_of(t) for t in texts]
        new = list(set().union(*words).difference(self.place)) if words else []
        self.place.update(zip(new, range(len(self.lens), len(self.lens) + len(new)), strict=True))
        got = self.sp.encode(new, num_threads=1) if new else []
        got = [[self.lone] if w == _MARK else g for w, g in zip(new, got, strict=True)]
        self.lens += map(len, got)
        self.parts.append(np.fromiter(chain.from_iterable(got), np.int32))
        self.parts = [np.concatenate(self.parts)]
        # an end id for each text stands as one more word after its last
        ids, lens = np.append(self.parts[0], np.int32(self.end)), np.array([*self.lens, 1])
        starts = np.cumsum(lens) - lens
        counts = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(words)), np.int64, counts.sum())
        at = np.insert(at, np.cumsum(counts), len(self.lens))
        n = lens[at]
        ends = np.cumsum(n)
        flat = ids[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.cumsum(counts + 1) - 1
        offsets = np.concatenate([[0], ends[last]]) if words else np.zeros(1)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def _lists(column: pa.ListArray) -> list[list[int]]:
    """Python lists of a list column (to_pylist makes an object for each value first)."""
    flat, ends = column.flatten().to_numpy().tolist(), np.cumsum(column.value_lengths().fill_null(0).to_numpy())
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def encode(df: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with ids_col array<int>: the ids of text_col and the end id. model: a path that every executor can open."""
    return _coded(df, model, text_col, {ids_col: T.ArrayType(T.IntegerType())})


def decode(df: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with text_col: the text that the library decodes from ids_col (null ids: empty)."""

    def run(batches):
        sp = _processor(model)
        for batch in batches:
            for part in slices(batch, ids_col, SLICE_CHARS // 2):
                yield pa.RecordBatch.from_arrays([*part.columns, _texts(sp, part.column(ids_col))], [*part.schema.names, text_col])

    plain = drop_columns(df, text_col)
    return plain.mapInArrow(releasing(run), T.StructType([*plain.schema, T.StructField(text_col, T.StringType())]))


def round_trip(df: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """encode and decode in one pass over the texts: df with ids_col and decoded_col."""
    return _coded(df, model, text_col, {ids_col: T.ArrayType(T.IntegerType()), decoded_col: T.StringType()})


def _texts(sp, ids: pa.ListArray) -> pa.Array:
    lists = _lists(ids)
    return pa.array(sp.decode(lists, num_threads=1) if lists else [], pa.string())


def _coded(df: DataFrame, model: str, text_col: str, added: dict[str, T.DataType]) -> DataFrame:
    """df with the ids and, if two columns are to be added, the decoded text."""
    check_model(_processor(model))
    if text_col.lower() in {c.lower() for c in added}:
        raise ValueError(f"the result cannot replace the text column {text_col}")

    def run(batches):
        tab = WordTable(_processor(model))
        for batch in batches:
            for part in slices(batch, text_col, SLICE_CHARS):
                ids = tab.encode([t or "" for t in part.column(text_col).to_pylist()])
                more = [ids] if len(added) == 1 else [ids, _texts(tab.sp, ids)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, *added])

    plain = drop_columns(df, *added)
    return plain.mapInArrow(releasing(run), T.StructType([*plain.schema, *(T.StructField(n, k) for n, k in added.items())]))
