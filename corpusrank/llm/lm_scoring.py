"""Language-model scores of whole texts: subword lattice likelihood under unigram piece scores.

The pieces are those of an existing vocabulary; their scores are trained, since the vocabulary at hand holds ranks of
merges and no probabilities: each distinct word of the training texts is segmented once, greedily, and its pieces
count as often as the word (one hard step of expectation-maximisation). A text's probability sums over all
segmentations of all its words into pieces, times one end; a forward recursion in log space gives each
distinct word's sum. A character that no piece holds is spelled by its byte pieces.

How it runs: tasks count words over slices of text before anything is shuffled; each distinct word is scored
once, in a table. Words of up to HOT_BYTES with at least 1 / HOT_SHARE of all tokens (at most HOT_SHARE of them, so the
broadcast is bounded) are added up where the text is; the others go through one join by word, in which no
word is common. Nothing of a text but its rare words is moved.

Defined cases: a null text counts as empty, and an empty text is one end; rows with a null id are training
rows; repeated rows count as often as they appear; a very long text is a slice of its own; of a very long word the recursion keeps only what the longest piece can reach; other columns do not
matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, releasing, slices

HOT_SHARE, HOT_BYTES = 400_000, 64
SLICE_CHARS = 4_000_000
_LN10 = math.log(10)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, A-Z lower-cased (bytes split and lower in ASCII only)."""
    return text.encode().lower().split() if text else []


def held_out(id_col: str, folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def _processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def word_counts(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """word binary, seen long (in all texts), trained long (in training texts)."""
    rows = df.select(F.col(text_col).alias("_t"), held_out(id_col).alias("_h"))

    def count(batches):
        for part in (p for b in batches for p in slices(b, "_t", SLICE_CHARS)):
            texts, held = part.column("_t").to_pylist(), part.column("_h").to_pylist()
            train, test = Counter(), Counter()
            for t, h in zip(texts, held, strict=True):
                (test if h else train).update(words_of(t))
            both = train.keys() | test.keys()
            cols = [pa.array(list(both), pa.binary()), pa.array([train[w] + test[w] for w in both], pa.int64()), pa.array([train[w] for w in both], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["word", "seen", "trained"])

    parts = rows.mapInArrow(releasing(count), "word binary, seen long, trained long")
    return materialize(parts.groupBy("word").agg(F.sum("seen").alias("seen"), F.sum("trained").alias("trained")), "lm-words")


def piece_scores(words: DataFrame, model: str, ends: int) -> tuple[dict[str, float], list[float], float]:
    """Natural logs of the probabilities of pieces, of the 256 byte pieces, and of the end."""

    def count(batches):
        sp = _processor(model)
        total = Counter()
        for b in batches:
            ws = [w.decode() for w in b.column("word").to_pylist()]
            for ids, n in zip(sp.encode(ws, num_threads=1) if ws else [], b.column("trained").to_pylist(), strict=True):
                for i in ids:
                    total[i] += n
        cols = [pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["piece", "n"])

    counts = words.where("trained > 0").select("word", "trained").mapInArrow(releasing(count), "piece int, n long")
    got = {r.piece: r.n for r in counts.groupBy("piece").agg(F.sum("n").alias("n")).collect()}  # at most the vocabulary
    sp = _processor(model)
    normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))]
    total = math.log(sum(got.values()) + ends + 0.5 * (len(normal) + 1))
    score = {i: math.log(got.get(i, 0) + 0.5) - total for i in normal}
    pieces = {sp.id_to_piece(i): score[i] for i in normal if not sp.is_byte(i)}
    by_byte = {int(sp.id_to_piece(i)[3:5], 16): score[i] for i in normal if sp.is_byte(i)}
    return pieces, [by_byte[b] for b in range(256)], math.log(ends + 0.5) - total


def lattice(word: str, pieces: dict[str, float], spelled: list[float], longest: int | None = None) -> float:
    """Natural log of the summed probability of all segmentations of the marked word. longest: the length of the longest piece."""
    longest = longest or max(map(len, pieces), default=0)
    s = "▁" + word
    a, first = [0.0], 0  # of places first and on; no piece reaches back more than `longest`
    for j in range(1, len(s) + 1):
        paths = [a[i - first] + p for i in range(max(0, j - longest), j) if (p := pieces.get(s[i:j])) is not None]
        if s[j - 1] not in pieces:
            paths.append(a[-1] + sum(spelled[b] for b in s[j - 1].encode()))
        top = max(paths)
        a.append(top + math.log(sum(math.exp(p - top) for p in paths)) if len(paths) > 1 else top)
        if len(a) > 2 * longest + 64:
            drop = len(a) - longest - 1
            del a[:drop]
            first += drop
    return a[-1]


class WordModel:
    """Scores of every distinct word of a table, and the figures that a text's scores need."""

    def __init__(self, df: DataFrame, model: str, text_col: str = "text", id_col: str = "doc_id"):
        self.cols = (text_col, id_col)
        words = word_counts(df, text_col, id_col)
        held, rows = held_out(id_col), df.select(id_col)
        self.ends = rows.where(~held).count()
        seen, trained, distinct = words.agg(
            F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0)), F.count(F.when(F.col("trained") > 0, 1))
        ).first()
        self.tokens = trained + self.ends
        self.distinct = distinct + (self.ends > 0)
        pieces, spelled, end = piece_scores(words, model, self.ends)
        self.end_score = end / _LN10
        self.end_base = self._log(self.ends)

        longest = max(map(len, pieces), default=0)

        def run(batches):
            for b in batches:
                got = [lattice(w.decode(), pieces, spelled, longest) / _LN10 for w in b.column("word").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], [*b.schema.names, "score"])

        # the table of words is small for its work, so its tasks are not those of its files
        words = words.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        scored = words.mapInArrow(releasing(run), "word binary, seen long, trained long, score double")
        total = self.tokens + 0.5 * (self.distinct + 1)
        base = F.log10((F.col("trained") + 0.5) / F.lit(float(total)))
        self.words = materialize(scored.select("word", "seen", (F.col("trained") > 0).alias("known"), base.alias("base"), "score"), "lm-scores")
        self.hot_least = max(2, seen // HOT_SHARE + 1)

    def _log(self, c: int) -> float:
        return math.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def score(self, df: DataFrame) -> DataFrame:
        """One row for each row of df: the id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
        text_col, id_col = self.cols
        is_hot = (F.col("seen") >= self.hot_least) & (F.octet_length("word") <= HOT_BYTES)
        hot = self.words.where(is_hot).select("word", "known", "base", "score").toArrow()  # at most HOT_SHARE words of HOT_BYTES
        shared = df.sparkSession.sparkContext.broadcast(
            (hot.column("word").to_pylist(), *[hot.column(c).to_numpy().astype(np.float64) for c in ("known", "base", "score")])
        )

        rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

        def run(batches):
            common, *values = shared.value
            place = dict(zip(common, range(len(common)), strict=True))
            values = np.vstack([np.append(v, 0.0) for v in values])  # the last stands for rare words
            none = len(common)
            for part in (p for b in batches for p in slices(b, "_t", SLICE_CHARS)):
                sums, tokens, rare = [], [], []
                for t in part.column("_t").to_pylist():
                    ws = words_of(t)
                    at = np.fromiter((place.get(w, none) for w in ws), np.int64, len(ws))
                    sums.append(values[:, at].sum(1))
                    tokens.append(len(ws))
                    few = Counter(ws[i] for i in np.flatnonzero(at == none))
                    rare.append([{"word": w, "n": n} for w, n in few.items()])
                s = np.array(sums).reshape(-1, 3)
                cols = [pa.array(tokens, pa.int64()), *(pa.array(s[:, k]) for k in range(3)), pa.array(rare, rare_type)]
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_h"), *cols], ["_id", "_h", "_n", "_k", "_b", "_s", "_rare"])

        rows = df.select(F.col(id_col).alias("_id"), held_out(id_col).alias("_h"), F.col(text_col).alias("_t"))
        schema = T.StructType([*rows.schema][:2]).add("_n", "long").add("_k", "double").add("_b", "double").add("_s", "double")
        schema = schema.add("_rare", T.ArrayType(T.StructType().add("word", T.BinaryType()).add("n", T.LongType())))
        # the table fixes each row's number, so a task that runs again cannot change it
        rows = materialize(rows.mapInArrow(releasing(run), schema).withColumn("_row", F.monotonically_increasing_id()), "lm-rows")
        rest = self.words.where(~is_hot)
        rare = rows.select("_row", F.explode("_rare").alias("r")).select("_row", F.col("r.word").alias("word"), F.col("r.n").alias("_times"))
        times = F.col("_times")
        more = rare.join(rest, "word").groupBy("_row").agg(
            F.sum(times * F.col("known").cast("double")).alias("_k2"), F.sum(times * F.col("base")).alias("_b2"), F.sum(times * F.col("score")).alias("_s2")
        )
        out = rows.drop("_rare").join(more, "_row", "left")
        both = lambda x: F.col(x) + F.coalesce(F.col(f"{x}2"), F.lit(0.0))
        return out.select(
            F.col("_id").alias(id_col), F.col("_h").alias("held_out"), (F.col("_n") + 1).alias("n_tokens"),
            (both("_k").cast("long") + F.lit(int(self.ends > 0))).alias("n_known"), F.lit(int(self.tokens)).cast("long").alias("train_tokens"),
            (both("_b") + F.lit(self.end_base)).alias("base_score"), (both("_s") + F.lit(self.end_score)).alias("score"),
        )
