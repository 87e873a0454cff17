"""Quality rules by line sequence labelling: a linear-chain conditional random field marks lines as content or boilerplate.

A document's lines (those with a word) are a sequence. Each line is described by FEATURES: its size, its shares of
capitals, digits, symbols and marks, how it begins and ends, and how much of it is repeated within the line and the
document. Every figure falls in one of a few bins with a weight each; the sum of weights says how much likelier content
is, and transition weights tie neighbours together. Viterbi decoding gives the likeliest labels of all lines together.
The share of content among the characters of words decides: under CONTENT_LEAST a document is not kept.

The field is trained here. Labels are known for documents only, so lines first get the label of their document; after a
first fit, lines of rejected documents that the field holds for content with 0.9 or more are relabelled (never the
least likely line of a run), and it is fitted again. Every second run goes on with lines of another document, since no
document by itself shows the field a change of label. It is fitted on at most about MAX_FIT runs of up to RUN lines of
labelled documents (all below that; above it those whose hash is lowest), which go to the driver as some 14 bytes a line;
documents of fold 0 (by crc32 of the id) are never read. Gradients are exact (forward and backward recursions).

How it runs: one pass over the texts and no shuffle. A slice of about SLICE_BYTES of texts (or one longer text) is one array
of bytes, in which characters are counted by line; words are compared as they are, not by hash.

Defined cases: null and empty texts have no words and fail the base rules, as do texts without a word (content share 0);
repeated rows get equal results; without labelled documents, or with one label only, all lines count as content; rows with
a null id or label are not fitted; of several labels of an id their mean counts, rounded up at a half; all other columns
stay, but for those named as the result's, which are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, drop_columns, materialize, releasing, slices, unused_names
from .quality import fold_of

LEAST_WORDS, REPEAT_PERCENT = 50, 50
CONTENT_LEAST = 0.5
MAX_FIT, RUN = 8_000, 64
RIDGE, STEPS, RATE = 1.0, 80, 0.2
SURE = 0.9
SLICE_BYTES = 2_000_000
RESULT = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean",
    "content_share": "double", "line_labels": "string", "kept": "boolean",
}

#: Of a line: what is measured, and the upper ends of its bins.
FEATURES = {
    "words": (1, 2, 4, 8, 16, 32, 64, 128),
    "chars a word": (2, 3, 4, 5, 6, 8, 12),
    "capitals": (0, 0.03, 0.06, 0.12, 0.3, 0.6),
    "digits": (0, 0.02, 0.1, 0.3),
    "symbols a word": (0, 0.02, 0.1, 0.3, 0.8),
    "exclamations a word": (0, 0.05, 0.2, 0.6),
    "stops a word": (0, 0.05, 0.1, 0.2, 0.5),
    "equal neighbours": (0, 0.05, 0.2, 0.5),
    "repeated windows": (0, 0.1, 0.3, 0.6),
    "distinct words": (0.2, 0.4, 0.6, 0.8, 0.9),
    "repeats a line": (0,),
    "begins with": (0, 1, 2, 3),
    "ends with": (0, 1, 2, 3),
}
WIDTH = max(map(len, FEATURES.values())) + 1


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SPACE = _table(" \t\n\x0b\x0c\r")
_UPPER, _LOWER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz")
_DIGIT, _SYMBOL, _LOUD, _STOP = _table("0123456789"), _table("#*$%&|<>"), _table("!?"), _table(".,;:")
_OTHER = np.zeros(256, np.int8)  # classes of a line's first and last byte: 0 letter, 1 capital, 2 digit, 3 stop or mark, 4 other
for _i, _of in ((1, _UPPER), (2, _DIGIT), (3, _STOP | _LOUD), (4, ~(_LOWER | _UPPER | _DIGIT | _STOP | _LOUD) & (np.arange(256) < 128))):
    _OTHER[_of] = _i


@dataclass
class Lines:
    """Lines with a word of some texts: the row of each, its number in the text, characters in words, features as bins; figures of each text."""

    row: np.ndarray
    number: np.ndarray
    chars: np.ndarray
    bins: np.ndarray
    rows: dict[str, np.ndarray]
    n_lines: np.ndarray


def repeated_windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a window of three that is found twice or more; ids are numbers below size."""
    out = np.zeros(len(ids), bool)
    if len(ids) < 4:
        return out
    if size < 1 << 20:
        key = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        key = pairs[:-1] * size + ids[2:]
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    twice = n[at] > 1
    for k in range(3):
        out[k : len(out) - 2 + k] |= twice
    return out


def lines_of(texts: pa.Array) -> Lines:
    data, ends = bytes_of(texts)
    count, total = len(ends) - 1, len(data)
    held = ends[:-1] < ends[1:]
    breaks = np.flatnonzero(data == 10)
    first = np.zeros(total + 1, bool)  # where a line begins
    first[breaks + 1] = True
    first[ends[:-1][held]] = True
    start = np.flatnonzero(first[:total])
    row = np.searchsorted(ends, start, "right") - 1
    n_lines = np.bincount(row, minlength=count)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1] | first[1:total]
    word_at = np.flatnonzero(begins)
    line = np.searchsorted(start, word_at, "right") - 1
    by_line = lambda flags: np.add.reduceat(flags, start, dtype=np.int64) if total else np.zeros(0, np.int64)
    chars = by_line(((data & 0xC0) != 0x80) & ~space)
    symbols = by_line(_SYMBOL[data])
    words = np.bincount(line, minlength=len(start))

    ids, covered = np.zeros(len(word_at), np.int64), np.zeros(len(word_at), bool)
    again = np.zeros(len(start), bool)
    raw, at, at_line = data.tobytes(), 0, 0
    for r in np.flatnonzero(held).tolist():
        text = raw[ends[r] : ends[r + 1]]
        found, known = text.split(), {}
        ids[at : at + len(found)] = got = np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found))
        covered[at : at + len(found)] = repeated_windows(got, len(known))
        at += len(found)
        seen = set()
        for i, x in enumerate(text.split(b"\n")[: n_lines[r]], at_line):
            if words[i]:
                again[i] = x in seen
                seen.add(x)
        at_line += n_lines[r]

    of_row = lambda x: np.bincount(row, x, minlength=count).astype(np.int64)
    repeats = np.bincount(line, covered, minlength=len(start))
    rows = {"n_words": of_row(words), "word_chars": of_row(chars), "n_symbols": of_row(symbols), "n_dup_lines": of_row(again), "n_repeat_words": of_row(repeats)}

    full = np.flatnonzero(words)
    new_line = np.diff(line, prepend=-1) > 0
    beside = np.zeros(len(word_at), bool)
    beside[1:] = (ids[1:] == ids[:-1]) & ~new_line[1:]
    equal = np.bincount(line, beside, minlength=len(start))
    order = np.lexsort((ids, line))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (ids[order][1:] != ids[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order], fresh, minlength=len(start))
    last = np.flatnonzero(~space & np.append(space[1:] | first[1:total], True)) if total else np.zeros(0, np.int64)  # ends of words
    head, tail = word_at[new_line], last[np.append(new_line[1:], True)] if len(last) else last
    n, c = words[full], np.maximum(chars[full], 1)
    figures = [
        n, c / n, by_line(_UPPER[data])[full] / c, by_line(_DIGIT[data])[full] / c, symbols[full] / n, by_line(_LOUD[data])[full] / n,
        by_line(_STOP[data])[full] / n, equal[full] / n, repeats[full] / n, distinct[full] / n, again[full], _OTHER[data[head]], _OTHER[data[tail]],
    ]
    bins = np.stack([np.searchsorted(edges, x) for edges, x in zip(FEATURES.values(), figures, strict=True)], 1).astype(np.uint8)
    number = np.arange(len(start)) - (np.cumsum(n_lines) - n_lines)[row] if len(start) else row
    return Lines(row[full], number[full], chars[full], bins, rows, np.diff(np.searchsorted(breaks, ends)) + 1)


@dataclass
class LineField:
    """Weights of a chain of two labels, 0 boilerplate and 1 content."""

    weights: np.ndarray  # of content, by feature and bin
    moves: np.ndarray  # from label, to label
    begin: np.ndarray

    @classmethod
    def blank(cls) -> LineField:
        return cls(np.zeros((len(FEATURES), WIDTH)), np.zeros((2, 2)), np.array([0.0, 1.0]))

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """How much likelier content is than boilerplate, of each line by itself."""
        return self.weights[np.arange(len(FEATURES)), bins].sum(-1)

    def decode(self, scores: list[float]) -> list[int]:
        """The likeliest labels of a sequence (Viterbi); of equal ones content."""
        if not scores:
            return []
        (b0, b1), ((m00, m01), (m10, m11)) = self.begin.tolist(), self.moves.tolist()
        zero, one, back = b0, b1 + scores[0], []
        for s in scores[1:]:
            from_one = (one + m10 >= zero + m00, one + m11 >= zero + m01)
            back.append(from_one)
            zero, one = (one + m10 if from_one[0] else zero + m00), (one + m11 if from_one[1] else zero + m01) + s
        label = int(one >= zero)
        out = [label]
        for from_one in reversed(back):
            label = int(from_one[label])
            out.append(label)
        return out[::-1]


def _log_add(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def chain_marginals(field: LineField, scores: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log of the partition sum, label marginals, sums of move marginals) of sequences with `size` lines, padded to one width."""
    count, width = scores.shape
    emit = np.stack([np.zeros_like(scores), scores], 2)
    ahead = np.zeros((count, width, 2))
    ahead[:, 0] = field.begin + emit[:, 0]
    for i in range(1, width):
        ahead[:, i] = _log_add(ahead[:, i - 1, :, None] + field.moves, 1) + emit[:, i]
    total = _log_add(ahead[np.arange(count), size - 1], 1)
    behind, moved = np.zeros((count, width, 2)), np.zeros((2, 2))
    for i in range(width - 2, -1, -1):
        step = field.moves + (emit[:, i + 1] + behind[:, i + 1])[:, None, :]
        inside = i + 1 < size
        behind[:, i] = np.where(inside[:, None], _log_add(step, 2), 0)
        joint = np.exp(ahead[inside, i, :, None] + step[inside] - total[inside, None, None])
        moved += joint.sum(0)
    there = np.arange(width) < size[:, None]
    return total, np.exp(ahead + behind - total[:, None, None]) * there[..., None], moved


def gradient(field: LineField, bins: np.ndarray, labels: np.ndarray, size: np.ndarray) -> tuple[float, LineField, np.ndarray]:
    """(log-likelihood of labels, its gradient, marginal of content of each line)."""
    there = np.arange(bins.shape[1]) < size[:, None]
    lines, scores = bins[there], np.zeros(there.shape)
    scores[there] = field.scores(lines)
    total, marginal, moved = chain_marginals(field, scores, size)
    y = labels[..., None] == np.arange(2)
    pairs = y[:, :-1, :, None] & y[:, 1:, None, :] & there[:, 1:, None, None]
    seen = pairs.sum((0, 1))
    likely = (scores * labels * there).sum() + (seen * field.moves).sum() + field.begin[labels[:, 0]].sum() - total.sum()
    off = np.where(there, labels - marginal[..., 1], 0)
    weights = np.stack([np.bincount(lines[:, f], off[there], minlength=WIDTH) for f in range(len(FEATURES))])
    return float(likely), LineField(weights, seen - moved, (y[:, 0] - marginal[:, 0]).sum(0)), marginal[..., 1]


def ascend(bins: np.ndarray, labels: np.ndarray, size: np.ndarray, steps: int = STEPS) -> tuple[LineField, np.ndarray]:
    """(field of largest penalised likelihood, marginals of content), by Adam steps over groups of sequences of like length."""
    field = LineField.blank()
    groups = [g for g in (np.flatnonzero((size > a) & (size <= b)) for a, b in ((0, 4), (4, 16), (16, RUN))) if len(g)]
    widths = [int(size[g].max()) for g in groups]
    mean = [0.0] * 3
    square = [0.0] * 3
    for t in range(1, steps + 1):
        parts = [gradient(field, bins[g, :w], labels[g, :w], size[g])[1] for g, w in zip(groups, widths, strict=True)]
        for k, name in enumerate(("weights", "moves", "begin")):
            now = getattr(field, name)
            g = (sum(getattr(p, name) for p in parts) - RIDGE * now) / len(bins)
            mean[k], square[k] = 0.9 * mean[k] + 0.1 * g, 0.99 * square[k] + 0.01 * g * g
            setattr(field, name, now + RATE * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-9))
    likely = np.zeros(bins.shape[:2])
    for g, w in zip(groups, widths, strict=True):
        likely[g, :w] = gradient(field, bins[g, :w], labels[g, :w], size[g])[2]
    return field, likely


def runs(df: DataFrame, labels: DataFrame, label_col: str, text_col: str, id_col: str, max_fit: int) -> DataFrame:
    """(bins, n, y) of at most about max_fit runs of lines of labelled documents outside fold 0."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold_of(id_col) != 0))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.avg(label_col).alias("_y"))
    total = known.count()
    if total > max_fit:  # each document has a run or more
        known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * max_fit / total))
    # at most about max_fit rows of two numbers
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")

    def run(batches):
        for part in (p for b in batches for p in slices(b, "_text", SLICE_BYTES)):
            lines, y, ids = lines_of(part.column("_text")), part.column("_y").to_pylist(), part.column("_id").to_pylist()
            ends = np.searchsorted(lines.row, np.arange(part.num_rows + 1))
            cut = [(r, a, min(a + RUN, ends[r + 1])) for r in range(part.num_rows) for a in range(ends[r], ends[r + 1], RUN)]
            cols = [[lines.bins[a:b].tobytes() for _, a, b in cut], [b - a for _, a, b in cut], [int(y[r] >= 0.5) for r, _, _ in cut], [f"{ids[r]}:{a - ends[r]}" for r, a, _ in cut]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["bins", "n", "y", "name"])

    found = materialize(rows.select("_id", "_text", "_y").mapInArrow(releasing(run), "bins binary, n int, y int, name string"), "line-runs")
    total = found.count()
    if total > max_fit:
        found = found.where(F.pmod(F.xxhash64("name"), F.lit(1_000_000)) < int(1_000_000 * max_fit / total))
    return found.orderBy("name")  # the order of sums does not depend on tasks


def spliced(parts: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, labels, size) of runs, every second one cut at the half and continued with lines of another run."""
    other = np.random.Generator(np.random.PCG64(5)).permutation(len(parts))
    bins, y, size = np.zeros((len(parts), RUN, len(FEATURES)), np.uint8), np.zeros((len(parts), RUN), np.int64), []
    for i, own in enumerate(parts):
        joined = [(own, labels[i])]
        if i % 2:
            joined = [(own[: RUN // 2], labels[i]), (parts[other[i]][: RUN // 2], labels[other[i]])]
        at = 0
        for x, label in joined:
            bins[i, at : at + len(x)], y[i, at : at + len(x)] = x, label
            at += len(x)
        size.append(at)
    return bins, y, np.array(size)


def fit(df: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", max_fit: int = MAX_FIT) -> LineField:
    """The field fitted to labelled documents outside fold 0 (by crc32 of the id)."""
    found = runs(df, labels, label_col, text_col, id_col, max_fit).toPandas()  # at most about max_fit rows of RUN lines
    if found.y.nunique() < 2:
        return LineField.blank()
    bins, y, size = spliced([np.frombuffer(x, np.uint8).reshape(-1, len(FEATURES)) for x in found.bins], found.y.tolist())
    _, likely = ascend(bins, y, size)
    bad = (np.arange(RUN) < size[:, None]) & (y == 0)
    changed = bad & (likely >= SURE)
    changed[np.arange(len(y)), np.where(bad, likely, 2).argmin(1)] = False
    return ascend(bins, np.where(changed, 1, y), size)[0]


def judge(df: DataFrame, field: LineField, text_col: str = "text", content_least: float = CONTENT_LEAST) -> DataFrame:
    """df with the columns RESULT; line_labels has a letter for each line (split at \\n): C content, B boilerplate, - no word."""
    if text_col.lower() in RESULT:
        raise ValueError(f"a column of the result: {text_col}")
    plain = drop_columns(df, *RESULT)
    cols, schema = plain.columns, T.StructType([*plain.schema])
    for name, kind in RESULT.items():
        schema = schema.add(name, kind)

    def run(batches):
        for part in (p for b in batches for p in slices(b, text_col, SLICE_BYTES)):
            lines = lines_of(part.column(text_col))
            scores = field.scores(lines.bins).tolist()
            ends = np.searchsorted(lines.row, np.arange(part.num_rows + 1))
            labels = np.array([x for r in range(part.num_rows) for x in field.decode(scores[ends[r] : ends[r + 1]])], np.int64)
            chars = np.bincount(lines.row, lines.chars * labels, minlength=part.num_rows)
            share = chars / np.maximum(lines.rows["word_chars"], 1)
            letters = [np.full(n, ord("-"), np.uint8) for n in lines.n_lines]
            for r, letter in enumerate(letters):
                own = slice(ends[r], ends[r + 1])
                letter[lines.number[own]] = np.where(labels[own] == 1, ord("C"), ord("B"))
            names = [x.tobytes().decode() for x in letters]
            n = lines.rows["n_words"]
            failed = (n < LEAST_WORDS) | (100 * lines.rows["n_repeat_words"] > REPEAT_PERCENT * n)
            kept = ~failed & (share >= content_least)
            out = [*(pa.array(x, pa.int64()) for x in lines.rows.values()), pa.array(failed), pa.array(share), pa.array(names, pa.string()), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in cols), *out], schema.names)

    return plain.mapInArrow(releasing(run), schema)


def content_only(df: DataFrame, text_col: str = "text", labels_col: str = "line_labels", content_col: str = "content") -> DataFrame:
    """df (of judge) with content_col: the text without its boilerplate lines."""
    (own,) = unused_names(df, "lines")
    lines = drop_columns(df, content_col).withColumn(own, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
    content = F.filter(own, lambda _, i: F.substring(labels_col, i + 1, F.lit(1)) != "B")
    return lines.withColumn(content_col, F.array_join(content, "\n")).drop(own)
