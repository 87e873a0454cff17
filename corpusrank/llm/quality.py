"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics describe a whole text (shares of character classes, repetition of words and lines, lengths,
entropy). Random Fourier features approximate a Gaussian kernel over the standardised statistics; each
partition sums its part of the normal equations; the driver adds FIT_PARTITIONS of these and solves. The
scores of other rows than those fitted are counted in bins and made monotone probabilities by pooling
adjacent violators.

Bound: the fit uses at most about MAX_FIT labelled rows (all below that; above it those whose id's hash is
lowest). Scoring reads every whole text once and shuffles nothing.

Defined cases: null and empty texts have all-zero statistics and get a score like any other; without
labelled rows every score is 0.5; rows with a null label or id are not fitted; of several labels for one id
their mean counts; without labelled rows in the calibration fold the map is fitted on the rows that the weights were
fitted on (scores are then too sure of themselves); without any in the other folds every score is 0.5; repeated
rows get one score each; all other columns stay, but for one named as the score's, which is replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_columns, materialize, releasing

MAX_FIT = 200_000
FIT_PARTITIONS = 16
FEATURES = 320
RIDGE = 1.0
SCORE_BINS = 400
SEED = 7
_FOLDS = 5


def statistics(text: str | None) -> list[float]:
    """Statistics of one text; all zero for an empty one."""
    if not text:
        return [0.0] * N_STATS
    raw = text.encode()
    words, n = raw.split(), len(raw)
    if not words:
        return [0.0] * (N_STATS - 1) + [1.0]
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = hist / n
    used = share[share > 0]
    m, counts = len(words), Counter(words)
    top = counts.most_common(3)
    once = sum(c == 1 for c in counts.values())
    lens = np.fromiter(map(len, words), np.float64, m)
    lines = [x for x in raw.split(b"\n") if x]
    marks = lambda s: float(sum(share[c] for c in s))
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, m - 1)
    return [
        np.log1p(m), np.log1p(n), lens.mean(), lens.std(), np.log1p(lens.max()),
        float(share[65:91].sum()), float(share[97:123].sum()), float(share[48:58].sum()), float(share[128:].sum()),
        marks(b"!?"), marks(b"*#$%&@^~"), marks(b"|<>{}[]\\/=_+"), marks(b".,;:"), marks(b"\"'()-"), marks(b"\n"), marks(b" \t"),
        float(-(used * np.log2(used)).sum()),
        len(counts) / m, once / m, top[0][1] / m, sum(c for _, c in top) / m, sum(map(eq, words, words[1:])) / m, pairs,
        np.log1p(len(lines)), np.log1p(n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)),
        sum(w[-1] in b".!?" for w in words) / m, sum(w[-1] in b"*#$%&!|" for w in words) / m,
        0.0,
    ]


N_STATS = 29


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.omega + self.phase) * np.sqrt(2 / self.omega.shape[1])
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def _stats_of(batch: pa.RecordBatch, text_col: str) -> np.ndarray:
    return np.array([statistics(t) for t in batch.column(text_col).to_pylist()], np.float64).reshape(-1, N_STATS)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over x in order: the mean x and mean y of each pool."""
    pools: list[list[float]] = []
    for a, b, n in zip(x, y, w, strict=True):
        pools.append([a * n, b * n, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], top, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fold_of(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % _FOLDS


def labelled_statistics(df: DataFrame, labels: DataFrame, label_col: str, text_col: str, id_col: str, max_fit: int) -> DataFrame:
    """stats, y and fold of at most about max_fit labelled rows outside fold 0."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold_of(id_col) != 0))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.avg(label_col).alias("_y"))
    total = known.count()
    if total > max_fit:
        known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * max_fit / total))
    # at most about max_fit rows of two numbers
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")
    rows = rows.select("_text", "_y", fold_of("_id").cast("int").alias("_fold"))

    def run(batches):
        for b in batches:
            stats = pa.array(list(_stats_of(b, "_text")), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([stats, b.column("_y"), b.column("_fold")], ["stats", "y", "fold"])

    return materialize(rows.mapInArrow(releasing(run), "stats array<double>, y double, fold int"), "quality-stats")


def fit(df: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", max_fit: int = MAX_FIT) -> QualityModel:
    """Fit on folds 1 to 3 of the labelled rows (by crc32 of the id), calibrate on fold 4; fold 0 is never read."""
    rows = labelled_statistics(df, labels, label_col, text_col, id_col, max_fit)
    blank = np.zeros(0)
    model = QualityModel(np.zeros(N_STATS), np.ones(N_STATS), np.zeros((N_STATS, FEATURES)), np.zeros(FEATURES), np.zeros(FEATURES + 1), blank, blank)
    train = rows.where("fold < 4").repartition(FIT_PARTITIONS)

    def moments(batches):
        n, s, q = 0, np.zeros(N_STATS), np.zeros(N_STATS)
        for p in batches:
            if len(p):
                x = np.stack(p["stats"])
                n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "q": [q.tolist()]})

    got = train.mapInPandas(releasing(moments), "n long, s array<double>, q array<double>").collect()
    n = sum(r.n for r in got)
    if not n:
        return model
    model.mean = np.sum([r.s for r in got], 0) / n
    var = np.sum([r.q for r in got], 0) / n - model.mean**2
    model.scale = np.sqrt(np.maximum(var, 1e-12))
    rng = np.random.Generator(np.random.PCG64(SEED))
    model.omega = rng.normal(0, 1 / np.sqrt(N_STATS), (N_STATS, FEATURES))
    model.phase = rng.uniform(0, 2 * np.pi, FEATURES)

    def normal_equations(batches):
        gram, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for p in batches:
            if len(p):
                f = model.features(np.stack(p["stats"]))
                gram, right = gram + f.T @ f, right + f.T @ p["y"].to_numpy()
        yield pd.DataFrame({"gram": [gram.tobytes()], "right": [right.tobytes()]})

    parts = train.mapInPandas(releasing(normal_equations), "gram binary, right binary").collect()
    gram = np.sum([np.frombuffer(r.gram) for r in parts], 0).reshape(FEATURES + 1, -1)
    right = np.sum([np.frombuffer(r.right) for r in parts], 0)
    model.weights = np.linalg.solve(gram + RIDGE * np.eye(FEATURES + 1), right)

    def raw(batches):
        for p in batches:
            x = np.stack(p["stats"]) if len(p) else np.zeros((0, N_STATS))
            yield pd.DataFrame({"raw": model.raw(x), "y": p["y"]})

    held = rows.where("fold = 4")
    held = rows if held.isEmpty() else held
    bins = held.mapInPandas(releasing(raw), "raw double, y double").groupBy(F.floor(F.least(F.greatest("raw", F.lit(-2.0)), F.lit(3.0)) * SCORE_BINS).alias("bin"))
    table = bins.agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()  # at most 5 x SCORE_BINS rows
    model.knots, model.values = isotonic(table.x.to_numpy(), table.y.to_numpy(), table.n.to_numpy())
    return model


def score(df: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with score_col: the calibrated probability of label 1."""

    def run(batches):
        for b in batches:
            got = pa.array(model.score(_stats_of(b, text_col)), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*b.schema.names, score_col])

    plain = drop_columns(df, score_col)
    return plain.mapInArrow(releasing(run), T.StructType([*plain.schema, T.StructField(score_col, T.DoubleType())]))
