"""Words of Chinese text: a dictionary learned from the corpus, and the path of largest probability through each run.

Words are character sequences that occur often and whose parts go together: a sequence of n characters is a word if it
occurs LEAST times or more and COHESION times as often as chance would put its two parts side by side, wherever it is
cut. Its weight is its count; single characters are words too. Counts come from one pass over the corpus, summed by task.

A run of Han characters is a graph: an edge from each place to the end of each word that begins there. Costs are
-1000 ln p, rounded, so that every engine adds the same integers; dynamic programming from the end finds the path of least
cost, of equal ones that with the longer first word. A character that the corpus lacks costs as much as one seen once.

The dictionary (at most MOST_WORDS words of two characters or more, the commonest, and the characters) is broadcast.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize

LONGEST, LEAST, COHESION, MOST_WORDS = 4, 5, 8.0, 200_000
_HAN = r"\p{IsHan}+"
_MARK = "\x00"  # before a run of Han characters
_RUNS = _MARK + r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"
RUNS = 100_000


def grams(df: DataFrame, text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(gram, n): how often each sequence of 1 to `longest` Han characters occurs; different runs of a batch are cut once, in its task."""

    def run(batches):
        for b in batches:
            found = b.column(0).flatten().value_counts()
            if not len(found):
                continue
            runs, times = found.field(0).to_pylist(), found.field(1).to_numpy()
            for k in range(0, len(runs), RUNS):
                for words, n in _counts(runs[k : k + RUNS], times[k : k + RUNS], longest):
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["gram", "n"])

    runs = df.select(F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(_HAN), F.lit(0)).alias("r"))
    return runs.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _counts(runs: list[str], times: np.ndarray, longest: int):
    """(sequences, how often they occur) of each length, in runs that occur so many times."""
    codes = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters to the end of the run
    weight = np.repeat(times, sizes)
    names, one = np.unique(codes, return_inverse=True)
    ids = one  # of the sequence that begins here, one character shorter than is counted next
    for m in range(1, longest + 1):
        at = np.flatnonzero(left >= m)
        if not len(at):
            return
        key = ids[at] * len(names) + one[at + m - 1] if m > 1 else ids[at]
        _, first, name = np.unique(key, return_index=True, return_inverse=True)
        ids = np.zeros(len(codes), np.int64)
        ids[at] = name
        places = at[first]
        yield np.ascontiguousarray(codes[places[:, None] + np.arange(m)]).view(f"<U{m}").ravel().tolist(), np.bincount(name, weight[at]).astype(np.int64)


def learn(df: DataFrame, text_col: str = "text", known: tuple[str, ...] = (), longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION, most: int = MOST_WORDS) -> DataFrame:
    """(word, cost) of a corpus. known: words whatever their counts (those that the corpus lacks count once)."""
    counts = materialize(grams(df, text_col, longest), "grams")
    total = counts.where(F.length("gram") == 1).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    some = counts.where((F.length("gram") > 1) & (F.col("n") >= least))
    cuts = some.select("gram", "n", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("at"))
    cuts = cuts.select("gram", "n", F.substring("gram", F.lit(1), F.col("at")).alias("a"), F.substring("gram", F.col("at") + 1, F.lit(longest)).alias("b"))
    one = counts.select(F.col("gram").alias("a"), F.col("n").alias("na"))
    two = counts.select(F.col("gram").alias("b"), F.col("n").alias("nb"))
    cuts = cuts.join(one, "a").join(two, "b").groupBy("gram", "n").agg(F.min(F.col("n").cast("double") * total / (F.col("na").cast("double") * F.col("nb"))).alias("tied"))
    words = cuts.where(F.col("tied") >= cohesion).select("gram", "n").orderBy(F.desc("n"), "gram").limit(most)
    words = words.unionByName(counts.where(F.length("gram") == 1))
    if known:
        listed = df.sparkSession.createDataFrame([(w,) for w in sorted({w.lower() for w in known}) if re.fullmatch(r"[㐀-䶿一-鿿]{2,}", w)], "gram string")
        words = words.join(listed, "gram", "left_anti").unionByName(listed.join(counts, "gram", "left").select("gram", F.coalesce("n", F.lit(1)).alias("n")))
    cost = F.round(1000 * (F.log(F.lit(float(max(total, 1)))) - F.log(F.col("n").cast("double")))).cast("long")
    return materialize(words.select(F.col("gram").alias("word"), cost.alias("cost")).unionByName(_unknown(df, total)), "words")


def _unknown(df: DataFrame, total: int) -> DataFrame:
    """The cost of a character that the corpus lacks, under the empty word."""
    return df.sparkSession.range(1).select(F.lit("").alias("word"), F.round(1000 * F.log(F.lit(float(max(total, 1))))).cast("long").alias("cost"))


def best_path(run: str, costs: dict[str, int], longest: int) -> list[str]:
    """The words of the path of least cost through a run."""
    n, unknown = len(run), costs.get("", 0)
    best, step = [0] * (n + 1), [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        best[i] = costs.get(run[i], unknown) + best[i + 1]
        for m in range(2, min(longest, n - i) + 1):
            if (c := costs.get(run[i : i + m])) is not None and c + best[i + m] <= best[i]:  # of equal ones the longer
                best[i], step[i] = c + best[i + m], m
    out, i = [], 0
    while i < n:
        out.append(run[i : i + step[i]])
        i += step[i]
    return out


def inner_pairs(costs: dict[str, int]) -> set[str]:
    """Pairs of characters that stand side by side inside a word."""
    return {w[i : i + 2] for w in costs for i in range(len(w) - 1)}


def pieces(run: str, inner: set[str]) -> list[str]:
    """A run cut where no word can cross; the best path of a run is those of its pieces, one after the other."""
    ends = [i for i in range(1, len(run)) if run[i - 1 : i + 1] not in inner]
    return [run[a:b] for a, b in zip([0, *ends], [*ends, len(run)], strict=True)]


def segmenter(words: DataFrame, stop_words: tuple[str, ...] = (), least: int = 1):
    """A tokenizer (a function of columns): Han runs cut into words, lower-case runs of other letters and digits whole."""
    costs = {r.word: r.cost for r in words.toLocalIterator()}  # at most MOST_WORDS words and the characters
    longest = max(map(len, costs), default=1)
    shared = words.sparkSession.sparkContext.broadcast((costs, inner_pairs(costs)))

    known: dict[str, list[str]] = {}  # of a task
    cut_pieces: dict[str, list[str]] = {}

    def path(r: str) -> list[str]:
        if r[0] != _MARK:
            return [r] if kept(r) else []
        if r not in known:
            if len(known) >= RUNS:
                known.clear()
            known[r] = [w for x in pieces(r[1:], shared.value[1]) for w in piece(x)]
        return known[r]

    def piece(x: str) -> list[str]:
        if x not in cut_pieces:
            if len(cut_pieces) >= RUNS:
                cut_pieces.clear()
            cut_pieces[x] = [w for w in best_path(x, shared.value[0], longest) if kept(w)]
        return cut_pieces[x]

    def kept(w: str) -> bool:
        return len(w) >= least and w not in stop_words

    @F.arrow_udf("array<string>")
    def cut(lists: pa.Array) -> pa.Array:
        full = lists.fill_null([])
        runs = full.flatten().dictionary_encode()  # different runs of a batch are cut once
        paths = [path(r) for r in runs.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, paths), np.int64, len(paths))
        starts, at = np.cumsum(sizes) - sizes, runs.indices.to_numpy()
        after = np.concatenate([[0], np.cumsum(sizes[at])])
        places = np.arange(after[-1]) + np.repeat(starts[at] - after[:-1], sizes[at])
        offsets = full.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array(after[offsets - offsets[0]], pa.int32()), pa.array([w for p in paths for w in p], pa.string()).take(pa.array(places)))

    def tokens(c: Column) -> Column:
        marked = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"({_HAN})", f"{_MARK}$1")
        return cut(F.regexp_extract_all(marked, F.lit(_RUNS), F.lit(0)))

    return tokens
