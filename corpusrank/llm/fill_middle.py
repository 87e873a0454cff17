"""Fill-in-middle transformation by displacement scatter.

A text is cut at ends of lines into prefix, middle and suffix, which are written in another order with a mark before
each. All texts of a batch lie one after the other in one array of bytes. A scan finds the line ends, the cuts of a
text follow from its hash, and each part gets the distance that its bytes move. These distances are entered as a
difference array (three entries a text), whose running sum is the shift of every byte of the batch, and one scatter
writes all outputs. `restore` scans outputs for marks and gathers the bytes back by the inverse shifts.

Forms: psm is `<P>`prefix`<S>`suffix`<M>`middle, spm is `<S>`suffix`<P>`prefix`<M>`middle, plain is the text itself.
Since no text with a mark in it is changed, and no mark can begin inside another, an output has each mark once.

How it runs: one pass over the texts and no shuffle; hashes are computed by Spark. A task holds a slice of about
SLICE_BYTES of texts (or one longer text), its output, and the shifts of WINDOW bytes at a time.

Defined cases: null and empty texts are plain with an empty output and no lines; a null id counts as an empty one;
texts with a mark stay plain; rows that repeat an id and a text get equal outputs; a text without a line break is one
line; all other columns stay, but for those named as the result's, which are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, drop_columns, releasing, slices, unused_names

MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 7, 100, 50
SLICE_BYTES, WINDOW = 2_000_000, 1_000_000
FORMS = np.array(["plain", "psm", "spm"])
RESULT = {"output": "string", "form": "string", "n_lines": "long", "prefix_chars": "long", "middle_chars": "long"}
_WIDE = 3  # bytes of a mark
_MARK = np.array([list(m.encode()) for m in MARKS], np.uint8)
_KIND = np.full(256, -1, np.int8)
_KIND[_MARK[:, 1]] = np.arange(3)


def texts_of(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    out = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(data))
    return out.cast(pa.string())


def marks_in(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, kind) of every mark, in order of place; none reaches over the end of its row."""
    at = np.flatnonzero(data[:-2] == _MARK[0, 0])
    at = at[(data[at + 2] == _MARK[0, 2]) & (_KIND[data[at + 1]] >= 0)]
    row = np.searchsorted(ends, at, "right") - 1
    inside = at + _WIDE <= ends[row + 1]
    return row[inside], at[inside], _KIND[data[at[inside] + 1]]


def displaced(total: int, at: np.ndarray, shift: np.ndarray, window: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(low, high, places + shifts of the bytes low to high) for all of total bytes, where shift[i] holds from at[i] (in order) on."""
    window = window or WINDOW
    step, carry = np.diff(shift, prepend=0), 0
    for low in range(0, total, window):
        high = min(total, low + window)
        a, b = np.searchsorted(at, [low, high])
        change = np.zeros(high - low, np.int64)
        np.add.at(change, at[a:b] - low, step[a:b])
        moved = np.cumsum(change) + carry
        carry = moved[-1]
        yield low, high, moved + np.arange(low, high)


def _in_order(*parts: np.ndarray) -> np.ndarray:
    """Values of one row after the other."""
    return np.stack(parts, 1).ravel()


def arrange(texts: pa.Array, hashes: np.ndarray, rate: int = RATE, spm: int = SPM) -> list[pa.Array]:
    """The columns RESULT of texts; hashes has four numbers a row: two cuts, whether to change the text, which form."""
    data, ends = bytes_of(texts)
    start, end = ends[:-1], ends[1:]
    breaks = np.append(np.flatnonzero(data == 10), 0)  # the last is never used
    first = np.searchsorted(breaks[:-1], start)
    full = np.searchsorted(breaks[:-1], end) - first
    n = full + ((end > start) & (np.append(data, 0)[end - 1] != 10))
    low, high = np.sort(np.stack([hashes[:, 0] % (n + 1), hashes[:, 1] % (n + 1)]), axis=0)
    after = lambda k: np.where(k == 0, start, np.where(k > full, end, breaks[np.minimum(first + np.maximum(k, 1) - 1, len(breaks) - 1)] + 1))
    p, m = after(low), after(high)
    form = np.where(hashes[:, 3] % 100 < spm, 2, 1)
    form[(end == start) | (hashes[:, 2] % 100 >= rate)] = 0
    form[marks_in(data, ends)[0]] = 0
    is_spm, changed = form == 2, form > 0

    prefix, suffix = p - start, end - m
    new = np.concatenate([[0], np.cumsum(end - start + 3 * _WIDE * changed)])
    base = new[:-1]
    to_prefix = base + np.where(is_spm, 2 * _WIDE + suffix, _WIDE)
    to_suffix = base + np.where(is_spm, _WIDE, 2 * _WIDE + prefix)
    to_middle = base + 3 * _WIDE + prefix + suffix
    shifts = [np.where(changed, to - old, base - start) for to, old in ((to_prefix, start), (to_middle, p), (to_suffix, m))]
    out = np.empty(new[-1], np.uint8)
    for lo, hi, to in displaced(len(data), _in_order(start, p, m), _in_order(*shifts)):
        out[to] = data[lo:hi]
    for mark, to in zip(_MARK, (to_prefix, to_suffix, to_middle), strict=True):
        out[(to[changed] - _WIDE)[:, None] + np.arange(_WIDE)] = mark

    leads = (data & 0xC0) != 0x80  # one for each code point
    chars = [[int(np.count_nonzero(leads[a:b])) if c else None for a, b, c in zip(x, y, changed, strict=True)] for x, y in ((start, p), (p, m))]
    return [texts_of(out, new), pa.array(FORMS[form], pa.string()), pa.array(n, pa.int64()), *[pa.array(c, pa.int64()) for c in chars]]


def arranged_back(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts of outputs; raises where the marks of an output do not agree with its form."""
    data, ends = bytes_of(outputs)
    start, end = ends[:-1], ends[1:]
    form = np.array([0 if f is None else FORMS.tolist().index(f) for f in forms.to_pylist()], np.int64)
    changed, is_spm = form > 0, form == 2
    row, at, kind = marks_in(data, ends)
    at, kind = at[changed[row]], kind[changed[row]]
    order = np.where(is_spm[changed][:, None], [1, 0, 2], [0, 1, 2])
    if kind.tolist() != order.ravel().tolist():
        raise ValueError("the marks of an output differ from its form")
    one, two, three = (np.zeros(len(form), np.int64) for _ in range(3))  # ends of the marks, in order
    one[changed], two[changed], three[changed] = at.reshape(-1, 3).T + _WIDE
    from_prefix, from_suffix = np.where(is_spm, two, one), np.where(is_spm, one, two)
    n_first, n_second, n_middle = two - one - _WIDE, three - two - _WIDE, np.where(changed, end - three, 0)
    n_prefix = np.where(changed, np.where(is_spm, n_second, n_first), end - start)
    new = np.concatenate([[0], np.cumsum(end - start - 3 * _WIDE * changed)])
    base = new[:-1]
    middle, suffix = base + n_prefix, base + n_prefix + n_middle
    shifts = _in_order(np.where(changed, from_prefix, start) - base, np.where(changed, three - middle, start - base), np.where(changed, from_suffix - suffix, start - base))
    out = np.empty(new[-1], np.uint8)
    for lo, hi, source in displaced(len(out), _in_order(base, middle, suffix), shifts):
        out[lo:hi] = data[source]
    return texts_of(out, new)


def fill_in_middle(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """df with the columns RESULT: output, form, n_lines, prefix_chars and middle_chars (code points; null if plain).

    rate: of a hundred texts, how many are changed; spm: of a hundred changed ones, how many get the form spm.
    """
    plain = drop_columns(df, *(c for c in RESULT if c.lower() not in (text_col.lower(), id_col.lower())))
    if clash := {text_col.lower(), id_col.lower()} & set(RESULT):
        raise ValueError(f"columns of the result: {sorted(clash)}")
    (own,) = unused_names(df, "hash")
    rows = plain.withColumn(own, F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 32))
    cols, schema = plain.columns, T.StructType([*plain.schema])
    for name, kind in RESULT.items():
        schema = schema.add(name, kind)

    def run(batches):
        for part in (p for b in batches for p in slices(b, text_col, SLICE_BYTES)):
            hashes = np.frombuffer(bytes.fromhex("".join(part.column(own).to_pylist())), ">u4").reshape(-1, 4).astype(np.int64)
            got = arrange(part.column(text_col), hashes, rate, spm)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in cols), *got], schema.names)

    return rows.mapInArrow(releasing(run), schema)


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form", restored_col: str = "restored") -> DataFrame:
    """df with restored_col: the text that output_col was made of. A null form counts as plain, a null output as empty."""
    plain = drop_columns(df, restored_col)

    def run(batches):
        for part in (p for b in batches for p in slices(b, output_col, SLICE_BYTES)):
            got = arranged_back(part.column(output_col), part.column(form_col))
            yield pa.RecordBatch.from_arrays([*part.columns, got], [*part.schema.names, restored_col])

    return plain.mapInArrow(releasing(run), T.StructType([*plain.schema]).add(restored_col, "string"))
