"""Filter interaction audit: what five filters remove in every order, from additive counts of failure masks.

A document's mask says which filters it fails: A few words, B few distinct words, C many capitals, D odd symbols,
E a copy of a document with a smaller id. How many documents a filter removes at any step of any order depends only on
how many have each of the 32 masks, so one count of masks for each part (source) gives all 120 orders.

E is found with a counting-Bloom prepass. Each task adds the hashes of its texts to sketches of counters that stop at
two; sketches are cut into segments of COUNTERS counters by hash and merged by segment, and there is a segment for every
SEGMENT_TEXTS texts, so that the share of texts that it cannot clear stays the same at every size. A text with a counter
under two is unique. Only the others are shuffled, whole, for the smallest id of each text. Ids are joined back by hash;
hashes that more than one text has are done again by their texts, so no result depends on the hash.

How it runs: one pass over the texts for masks (written as a narrow table), one for the texts that may repeat. Up to
BROADCAST_SEGMENTS segments of merged bits (32 MB) are broadcast. Beyond, narrow rows and segments are dealt out by segment
(hot ones over several tasks), sorted so that a segment comes before its rows, and read as a stream; the texts that may
repeat are then found by a join. A text in a third of all rows is pre-aggregated before the shuffle and met by broadcast.

Defined cases: a null text counts as empty (fails A only, and E as a copy of another empty one); a null source is part
''; a null id is no copy and has no label, nor makes a copy of another; rows that repeat an id and a text are no copies
of each other but of smaller ids; of several labels of an id the largest counts; an empty table gives no rows; columns
beyond text, id, source and labels are not read, whatever their names.
"""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, hot_keys, join_hot, materialize, releasing, scratch_scope, text_of

LETTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
COPY = 1 << LETTERS.index("E")

COUNTERS, SEGMENT_TEXTS, PROBES = 1 << 20, 1 << 17, 3
BROADCAST_SEGMENTS = 256
FLUSH = 4_000_000
SALTS = 32


def mask_of(text: str | None) -> int:
    """The failures of one text by itself, as bits in the order of LETTERS."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # at ASCII white space
    few = len(words) < LEAST_WORDS
    repeats = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    odd = len(raw.translate(None, SYMBOLS)) < len(raw)
    return few | repeats << 1 | (100 * capitals > CAPITAL_PERCENT * len(text)) << 2 | odd << 3


def counters_of(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment of each hash, its PROBES counters in the segment as columns)."""
    x = hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    segment = (x % np.uint64(segments)).astype(np.int64)
    y = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    step = (y >> np.uint64(32)) | np.uint64(1)
    return segment, np.stack([((y + np.uint64(i) * step) >> np.uint64(7)) % np.uint64(COUNTERS) for i in range(PROBES)], 1).astype(np.int64)


def _sketches(segments: int):
    """Of batches of hashes: (segment, counters), a counter that reached two as its complement."""

    def flushed(keys: list[np.ndarray]):
        places, n = np.unique(np.concatenate(keys), return_counts=True)
        segment, place = places // COUNTERS, places % COUNTERS
        code = np.where(n > 1, ~place, place).astype(np.int32)
        ends = np.append(np.flatnonzero(np.diff(segment, prepend=-1)), len(segment))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(segment[ends[:-1]], pa.int64()), lists], ["_segment", "_codes"])

    def run(batches):
        keys, held = [], 0
        for b in batches:
            segment, places = counters_of(b.column("_h").to_numpy(zero_copy_only=False), segments)
            # a hash that a batch has twice or more counts twice
            _, index, n = np.unique(b.column("_h").to_numpy(zero_copy_only=False), return_index=True, return_counts=True)
            rows = np.concatenate([index, index[n > 1]])
            keys.append((segment[rows, None] * COUNTERS + places[rows]).ravel())
            held += keys[-1].size
            if held > FLUSH:
                yield flushed(keys)
                keys, held = [], 0
        if held:
            yield flushed(keys)

    return run


def _merged(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """One segment: bits of the counters that reached two. A task gave each counter once at most a flush."""
    count = np.zeros(COUNTERS, np.int32)
    for codes in group.column("_codes").chunks:
        x = codes.flatten().to_numpy(zero_copy_only=False)
        count += np.bincount(np.where(x < 0, ~x, x), minlength=COUNTERS).astype(np.int32)
        count[~x[x < 0]] = 2
    return pa.table({"_segment": pa.array([key[0].as_py()], pa.int64()), "_bits": pa.array([np.packbits(count > 1).tobytes()], pa.binary())})


def sketch(hashes: DataFrame, segments: int) -> DataFrame:
    """(_segment, _bits) of a table of hashes (_h); a segment's counters come from all tasks, each of which sums its own first."""
    parts = hashes.select("_h").mapInArrow(releasing(_sketches(segments)), "_segment long, _codes array<int>")
    return parts.groupBy("_segment").applyInArrow(_merged, "_segment long, _bits binary")


def _bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1


def _broadcast_probe(spark, sketches: DataFrame, segments: int):
    """h -> whether a text with that hash may repeat."""
    bits = np.zeros((segments, COUNTERS // 8), np.uint8)
    for r in sketches.toLocalIterator():  # at most BROADCAST_SEGMENTS rows
        bits[r[0]] = np.frombuffer(r[1], np.uint8)
    known = spark.sparkContext.broadcast(bits.ravel())

    @F.pandas_udf("boolean")
    def may_repeat(h: pd.Series) -> pd.Series:
        segment, places = counters_of(h.to_numpy(), segments)
        return pd.Series(_bit(known.value, segment[:, None] * COUNTERS + places).all(1))

    return may_repeat


def _stream_probe(narrow: DataFrame, sketches: DataFrame, segments: int) -> DataFrame:
    """narrow with _maybe; each task reads a segment's bits and then the rows of that segment."""

    @F.pandas_udf("long")
    def segment_of(h: pd.Series) -> pd.Series:
        return pd.Series(counters_of(h.to_numpy(), segments)[0])

    cols = narrow.columns
    rows = materialize(narrow.withColumn("_segment", segment_of("_h")), "audit-segments")
    hot = hot_keys(rows, "_segment", least=4 * SEGMENT_TEXTS)  # segments with a text that many rows have
    is_hot = F.col("_segment").isin(hot) if hot else F.lit(False)
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salt = F.when(is_hot, F.pmod(F.xxhash64("_id"), F.lit(SALTS))).otherwise(0).cast("int")
    both = rows.withColumn("_salt", salt).unionByName(sketches.withColumn("_salt", F.explode(salts)), allowMissingColumns=True)
    both = both.repartition("_segment", "_salt").sortWithinPartitions("_segment", "_salt", F.col("_bits").isNull())

    def run(batches):
        bits = None
        for b in batches:
            heads = np.flatnonzero(b.column("_bits").is_valid().to_numpy(zero_copy_only=False)).tolist()
            for low, high in zip([-1, *heads], [*heads, b.num_rows], strict=True):
                if low >= 0:
                    bits = np.frombuffer(b.column("_bits")[low].as_py(), np.uint8)
                part = b.slice(low + 1, high - low - 1)
                if part.num_rows:
                    maybe = _bit(bits, counters_of(part.column("_h").to_numpy(zero_copy_only=False), segments)[1]).all(1)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in cols), pa.array(maybe)], [*cols, "_maybe"])

    schema = narrow.schema.add("_maybe", "boolean")
    return both.mapInArrow(releasing(run), schema)


def _masks(rows: DataFrame) -> DataFrame:
    """rows (_text and others) with _mask instead of _text."""
    cols = [c for c in rows.columns if c != "_text"]
    schema = rows.select(*cols).schema.add("_mask", "integer")

    def run(batches):
        for b in batches:
            masks = pa.array([mask_of(t) for t in b.column("_text").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), masks], schema.names)

    return rows.mapInArrow(releasing(run), schema)


def masks(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "source", hash_of: Column | None = None, broadcast_segments: int = BROADCAST_SEGMENTS) -> DataFrame:
    """(_id, _part, _mask) of every row. hash_of: a long of the text (xxhash64; tests give a worse one)."""
    spark = df.sparkSession
    bound_batches(spark)
    body = text_of(text_col)
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), part.alias("_part"), (F.xxhash64(body) if hash_of is None else hash_of).alias("_h"), body.alias("_text"))
    with scratch_scope(spark) as keep:
        narrow = materialize(_masks(rows), "audit-masks")
        segments = max(1, math.ceil(narrow.count() / SEGMENT_TEXTS))
        sketches = materialize(sketch(narrow, segments), "audit-sketch")
        if segments <= broadcast_segments:
            probe = _broadcast_probe(spark, sketches, segments)
            probed = materialize(narrow.withColumn("_maybe", probe("_h")), "audit-probed")
            repeated = rows.where(probe("_h"))
        else:
            probed = materialize(_stream_probe(narrow, sketches, segments), "audit-probed")
            repeated = rows.join(probed.where("_maybe").select("_h").distinct(), "_h", "left_semi")
        texts = materialize(repeated.groupBy("_h", "_text").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).select("_h", "_first", "_n"), "audit-texts")
        by_hash = materialize(texts.groupBy("_h").agg(F.min("_first").alias("_first"), F.count("*").alias("_texts"), F.sum("_n").alias("_n")).where("_n > 1"), "audit-hashes")
        shared, own = by_hash.where("_texts > 1").select("_h"), by_hash.where("_texts = 1").select("_h", "_first")
        is_copy = F.coalesce(F.col("_id") > F.col("_first"), F.lit(False))
        flagged = lambda found: found.select("_id", "_part", F.col("_mask").bitwiseOR(F.when(is_copy, COPY).otherwise(0)).alias("_mask"))
        maybe = probed.where("_maybe")
        out = probed.where("not _maybe").select("_id", "_part", "_mask")
        if shared.isEmpty():
            return keep(materialize(out.unionByName(flagged(join_hot(maybe, own, "_h", "left"))), "audit-flags"))
        # several texts have one hash: their rows are told apart by the texts themselves
        alone = materialize(maybe.join(shared, "_h", "left_anti"), "audit-alone")
        out = out.unionByName(flagged(join_hot(alone, own, "_h", "left")))
        mixed = materialize(rows.join(shared, "_h", "left_semi"), "audit-mixed")
        first = mixed.groupBy("_text").agg(F.min("_id").alias("_first"))
        told = _masks(mixed.join(first, "_text"))
        return keep(materialize(out.unionByName(flagged(told)), "audit-flags"))


ORDERS = ["".join(p) for p in permutations(LETTERS)]


def _bits(letters: Column) -> Column:
    """The mask of a string of letters."""
    out = F.lit(0)
    for i, letter in enumerate(LETTERS):
        out = out + F.when(F.instr(letters, letter) > 0, 1 << i).otherwise(0)
    return out


def report(counts: DataFrame) -> DataFrame:
    """One row for each part, order and step, of counts (_part, _mask, n, good, toxic), at most 32 rows a part."""
    parts = counts.groupBy("_part").agg(F.collect_list(F.struct("_mask", "n", "good", "toxic")).alias("_m"))
    rows = parts.select("_part", "_m", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    rows = rows.select("*", _bits(F.substring("filter_order", F.col("step"), F.lit(1))).alias("_bit"), _bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)).alias("_before"))
    bit, before = F.col("_bit"), F.col("_before")

    def total(of: str, fits) -> Column:
        return F.aggregate("_m", F.lit(0).cast("long"), lambda s, m: s + F.when(fits(m["_mask"]), m[of]).otherwise(0))

    fails = lambda m: m.bitwiseAND(bit) > 0
    gone = lambda m: m.bitwiseAND(before) > 0
    removed = lambda m: fails(m) & ~gone(m)
    # of the orders of all filters, a document's failed ones come first equally often
    share = F.aggregate("_m", F.lit(0).cast("long"), lambda s, m: s + F.when(fails(m["_mask"]), m["n"] * len(ORDERS) / F.bit_count(m["_mask"])).otherwise(0).cast("long"))
    return rows.select(
        F.col("_part").alias("part"), "filter_order", "step", total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"), total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), share.alias("shapley"),
    )


def audit(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "source", quality_col: str = "quality", toxic_col: str = "toxic", **how) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part."""
    flags = masks(df, text_col, id_col, part_col, **how)
    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).cast("long")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(is_one(quality_col).alias("_good"), is_one(toxic_col).alias("_toxic"))
    counts = flags.join(known, "_id", "left").groupBy("_part", "_mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("_good"), F.lit(0)).alias("good"), F.coalesce(F.sum("_toxic"), F.lit(0)).alias("toxic")
    )
    return report(counts)
