"""Jaccard self-join of word shingles by universe partition and pigeonhole, with exact verification.

Sets of similar size share a size band and so one partition of the universe: the hash of a shingle names its
segment. Two sets of Jaccard similarity 0.8 differ in at most H shingles, so if the universe has more than H
segments they agree on a segment (an index key is the subset of a set in a segment). Wide segments are
indexed together with their one-deletion neighbourhoods and then account for two differences each. Of the
other segments a set indexes the H + 1 - 2 x wide rarest keys in one global order; because both sets of a
pair follow the same order, their prefixes must share a key (proof in `Band`). The allocation is by cost: how
many wide segments a band has is chosen by the keys it costs and the chance pairs it is expected to give, and
the order puts keys with most uncommon shingles first, then those with most shingles, so empty and
frequent subsets are indexed only by sets that have nothing better.

Links are needed to find components, so a group of n sets that share a key is never expanded into all pairs:
1. Each set of a key is paired with the key's smallest id (tasks combine their own sets first, so a key that
   a third of all sets share is a few rows for each task). Verified pairs give components.
2. Keys that still join different components are paired across components only, behind exact upper bounds
   (sizes, shingles that no other component has, and counts by classes of shingles). Verified pairs join those components.
Every pair that shares a key is then verified, or in one component already, so no component is missed.

Verification intersects the whole sets. Shingles stand for their words by 64-bit hashes; two of the
shingles of a pair collide with a chance under 1e-10 even for texts of 20,000 words.

Defined cases: a text of fewer words than a shingle is one shingle of all its words; null, empty and blank
texts have an empty set and link with nothing; rows that repeat an id are one document, linked if one of its
sets is; rows with a null id link with nothing and have a null component; equal sets link; a very long text is a slice
of its own; an empty table gives an empty result; other columns do not matter and stay in keep_one. Ids are whole
numbers; others are refused.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_salted, materialize, releasing, scratch_scope, slices, unused_names
from .components import connected_components

WORDS = 5
PERCENT = 80
SLICE_BYTES = 8_000_000
#: Shingles in at least 1 / COMMON_SHARE of all places count as common; so at most COMMON_SHARE of them are broadcast.
COMMON_SHARE = 500_000
#: Chance that a shingle of one set is in another set, as the cost model assumes it.
REPEAT = 0.01
#: Tables of at most three numbers a row are broadcast up to so many rows (12 MB).
BROADCAST_ROWS = 500_000
#: Shingles (or segments) that a task indexes at once.
INDEX_ROWS = 250_000
#: Keys of more open sets than this are first relieved of sets that can have no partner there.
LARGE_KEY = 48
FAMILY_BLOCK = 1024
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(2024))
_BYTES = _RNG.integers(0, 1 << 63, 256, _U) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = _RNG.integers(0, 1 << 63, WORDS, _U) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[_U(1)], np.full(size, _BASE)]), dtype=_U)
        down = np.cumprod(np.concatenate([[_U(1)], np.full(size, _BASE_INV)]), dtype=_U)
    return up, down


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a text given as bytes; A-Z count as a-z."""
    space = _SPACE[raw]
    edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, _U)
    up, down = _powers(1 << max(16, int(len(raw)).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[_U(0)], np.cumsum(_BYTES[_LOW[raw]] * up[: len(raw)], dtype=_U)])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    h = word_hashes(np.frombuffer((text or "").encode(), np.uint8)) if text else np.zeros(0, _U)
    with np.errstate(over="ignore"):
        n = min(WORDS, len(h))
        if not n:
            return h
        total = np.full(len(h) - n + 1, _U(n))
        for k in range(n):
            total = total + h[k : len(h) - n + 1 + k] * _PLACES[k]
        return np.unique(mix(total))


@dataclass(frozen=True)
class Band:
    """Sets of sizes low to high: those under next_low, and their partners of up to 1/0.8 times as many.

    With m segments, of which the first w are wide, and a pair that differs in at most H shingles: if no wide
    segment of one set is equal to, or one deletion from, that of the other, each holds two differences or
    more and H - 2w at most are left for the other m - w segments, of which therefore m - w - (H - 2w) or more
    are equal. Two sets of m - w keys each with so many in common share one among the first H - 2w + 1 of
    each in any common order.
    """

    number: int
    low: int
    next_low: int
    high: int
    segments: int = 1
    wide: int = 0

    def most_differences(self, size):
        """The largest symmetric difference of a set of this size with a partner in the band (also for arrays).

        100 |shared| >= 80 |union| gives difference * 80 <= size * 20 and difference * 180 <= (size + partner's size) * 20;
        partners of sets of next_low and more are under next_low.
        """
        by_own = size * (100 - PERCENT) // PERCENT
        by_both = (size + self.next_low - 1) * (100 - PERCENT) // (100 + PERCENT)
        return np.where(np.asarray(size) < self.next_low, by_own, np.minimum(by_own, by_both))


def _chance(size: int, segments: int, keep: float, deletions: bool) -> tuple[float, float]:
    """(keys, chance pairs for each other set) of one of the segments of a set, of which the fullest share `keep` is indexed."""
    if segments == 1:
        return (size + 1 if deletions else 1), REPEAT**size + (size * REPEAT ** (size - 1) if deletions else 0)
    keys = pairs = 0.0
    p = (1 - 1 / segments) ** size
    below = 1.0 - keep  # the emptiest segments are passed over
    for n in range(min(size, 64) + 1):
        here = max(0.0, p - below)
        below = max(0.0, below - p)
        keys += here * (n + 1 if deletions else 1)
        pairs += here * (REPEAT**n + (n * REPEAT ** (n - 1) if deletions and n else 0))
        p *= (size - n) / ((n + 1) * (segments - 1))
    return keys, pairs


def allocate(band: Band, docs: int) -> Band:
    """The band with its cheapest plan by cost: keys that sets of its sizes index, and chance pairs that they give."""
    sizes = sorted({band.low, (band.low + band.next_low) // 2, band.next_low - 1, band.high})
    needs = {n: int(band.most_differences(n)) for n in sizes}
    most, best = max(int(band.most_differences(n)) for n in (band.next_low - 1, band.high)), None
    for wide in range(0, min((most + 2) // 2, 64) + 1):
        exact = max(0, most + 1 - 2 * wide)
        for spare in (0.1, 0.2, 0.35, 0.5, 0.8) if exact else (0.0,):
            segments = wide + exact + math.ceil(exact * spare)
            cost = 0.0
            for size, need in needs.items() if segments else ():
                k, c = _chance(size, segments, 1.0, True)
                share = max(0, need + 1 - 2 * wide) / max(1, segments - wide)
                ke, ce = _chance(size, segments, share, False)
                cost += wide * (k + docs * c) + (segments - wide) * (ke + docs * ce)
            if segments and (best is None or cost < best[0]):
                best = (cost, segments, wide)
    return replace(band, segments=best[1], wide=best[2])


def bands_for(counts: dict[int, int]) -> list[Band]:
    """Bands of doubling sizes for the counts of sets by floor(log2(size))."""
    out = []
    for e in range(max(counts, default=-1) + 1):
        low, next_low = 1 << e, 1 << (e + 1)
        high = max(low, (next_low - 1) * 100 // PERCENT)
        docs = counts.get(e, 0) + counts.get(e + 1, 0)
        if docs:
            out.append(allocate(Band(e, low, next_low, high), docs))
    return out


def _index_keys(sets: list[np.ndarray], band: Band, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the set, key) of everything that the sets index in a band."""
    m, w = band.segments, band.wide
    sizes = np.array([len(s) for s in sets])
    of, h = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    with np.errstate(over="ignore"):
        seg = ((mix(h ^ _U(0x5851F42D4C957F2D)) >> _U(11)) % _U(m)).astype(np.int64)
        salt = mix(np.arange(m, dtype=_U) + _U((band.number + 1) << 40))
        at = of * m + seg
        mixed = mix(h)
        sums = np.zeros(len(sets) * m, _U)
        np.add.at(sums, at, mixed)
        held = np.bincount(at, minlength=len(sums))
        keys = mix(sums + np.tile(salt, len(sets)))
        docs, out = [], []
        if w:
            whole = np.flatnonzero(np.arange(len(sums)) % m < w)
            docs.append(whole // m)
            out.append(keys[whole])
            mine = seg < w
            docs.append(of[mine])
            out.append(mix(sums[at[mine]] - mixed[mine] + salt[seg[mine]]))
        need = band.most_differences(sizes) + 1 - 2 * w
        if m > w and (need > 0).any():
            rare = np.bincount(at[~_found(h, common)], minlength=len(sums))
            doc, part = np.divmod(np.arange(len(sums)), m)
            order = np.lexsort((keys, -held, -rare, doc))
            order = order[part[order] >= w]
            rank = np.arange(len(order)) % (m - w)
            take = order[rank < need[doc[order]]]
            docs.append(take // m)
            out.append(keys[take])
    return np.concatenate(docs), np.concatenate(out)


def _found(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    i = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return table[i] == h


def index_keys(sets: list[np.ndarray], bands: list[Band], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the set, key) over all bands that hold a set."""
    sizes = np.array([len(s) for s in sets])
    docs, keys = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    for b in bands:
        mine = np.flatnonzero((sizes >= b.low) & (sizes <= b.high))
        step = max(1, INDEX_ROWS // max(b.segments, b.high))
        for i in range(0, len(mine), step):
            part = mine[i : i + step]
            d, k = _index_keys([sets[j] for j in part], b, common)
            docs.append(part[d])
            keys.append(k)
    return np.concatenate(docs), np.concatenate(keys)


def sketch(s: np.ndarray) -> bytes | None:
    """Counts of the shingles by their first bits, one byte for each of about as many classes as shingles; None if a count needs more."""
    bits = min(12, max(5, len(s).bit_length() - 1))
    counts = np.bincount((s >> _U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def shared_at_most(one: list[bytes | None], two: list[bytes | None], n: np.ndarray) -> np.ndarray:
    """Upper bounds of the intersections of pairs by their sketches; n: the bounds of pairs that lack one."""
    out = n.astype(np.int64)
    for i, (a, b) in enumerate(zip(one, two, strict=True)):
        if a is not None and b is not None:
            x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            if len(x) > len(y):
                x, y = y, x
            if len(x) < len(y):
                y = y.reshape(len(x), -1).sum(1)
            out[i] = np.minimum(x, y).sum(dtype=np.int64)
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _tables(batches, col):
    return (p for b in batches for p in slices(b, col, SLICE_BYTES))


def measure(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """One table of two kinds of rows: (id, n) of every row of df, and (shingle, places) of shingles that a task met in several sets."""
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))

    def run(batches):
        for part in _tables(batches, "_t"):
            sets = [shingle_set(t) for t in part.column("_t").to_pylist()]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("_id"), sizes, none, none], ["id", "n", "shingle", "places"])
            values, counts = np.unique(np.concatenate([*sets, np.zeros(0, _U)]), return_counts=True)
            twice = counts > 1
            none = pa.nulls(int(twice.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, _signed(values[twice]), pa.array(counts[twice].astype(np.int64))], ["id", "n", "shingle", "places"])

    return materialize(rows.mapInArrow(releasing(run), "id long, n long, shingle long, places long"), "jaccard-measured")


def _local_stars(docs: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Combine a task's own rows: (key, smallest id) once for each key, and (id, smallest id) for the others of the key."""
    mine = ids[docs]
    order = np.lexsort((mine, keys))
    k, d = keys[order], mine[order]
    first = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    heads = np.flatnonzero(first)
    head = d[heads][np.cumsum(first) - 1] if len(k) else d
    pairs = np.unique(np.stack([d, head], 1)[d != head], axis=0) if len(k) else np.zeros((0, 2), np.int64)
    return k[heads], d[heads], pairs[:, 0], pairs[:, 1]


def star_pairs(df: DataFrame, text_col: str, id_col: str, bands: list[Band], common: np.ndarray) -> DataFrame:
    """Distinct (a, b), a > b: each document with the smallest of a key that both index."""
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t")).where("_id is not null")
    shared = df.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for part in _tables(batches, "_t"):
            sets = [shingle_set(t) for t in part.column("_t").to_pylist()]
            docs, keys = index_keys(sets, bands, shared.value)
            k, d, a, b = _local_stars(docs, keys, part.column("_id").to_numpy())
            cols = [np.concatenate([k.view(np.int64), a]), np.concatenate([d, b]), np.concatenate([np.ones(len(k), bool), np.zeros(len(a), bool)])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["x", "id", "is_key"])

    # one table holds both kinds, so that texts are cut once
    made = rows.mapInArrow(releasing(run), "x long, id long, is_key boolean")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = made.repartition(n, "is_key", "x").sortWithinPartitions("is_key", "x", "id")

    def stars(batches):
        last, head = None, 0
        for b in batches:
            x, ids = b.column("x").to_numpy(), b.column("id").to_numpy()
            key = b.column("is_key").to_numpy(zero_copy_only=False)
            a, h = [x[~key]], [ids[~key]]
            x, ids = x[key], ids[key]
            if len(x):
                first = np.concatenate([[last is None or x[0] != last], x[1:] != x[:-1]])
                group = np.cumsum(first)
                heads = np.concatenate([[head], ids[first]])[group]
                a.append(ids[ids != heads])
                h.append(heads[ids != heads])
                last, head = x[-1], heads[-1]
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(h)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return materialize(dealt.mapInArrow(releasing(stars), "a long, b long").distinct(), "jaccard-stars")


def _sized(x: DataFrame) -> DataFrame:
    return F.broadcast(x) if x.count() <= BROADCAST_ROWS else x


def active_sets(df: DataFrame, ids: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """id, n, shingles and sketch of the documents in ids."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t")).join(_sized(ids), "id", "left_semi")

    def run(batches):
        for part in _tables(batches, "_t"):
            sets = [shingle_set(t) for t in part.column("_t").to_pylist()]
            cols = [part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n", "shingles", "sketch"])

    out = rows.mapInArrow(releasing(run), "id long, n long, shingles array<long>, sketch binary")
    return materialize(out, "jaccard-sets")  # rows that repeat an id give a pair several times; pairs are made distinct


def _may_link(na: Column, nb: Column) -> Column:
    return (na * 100 >= nb * PERCENT) & (nb * 100 >= na * PERCENT)


def _oriented(pairs: DataFrame) -> tuple[DataFrame, list]:
    """The pairs, turned so that a hot document (in a third of all pairs, say) is b; and the hot ones. pairs: a table."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    hot = hot_keys(ends, "id")
    if not hot:
        return pairs, hot
    turn = F.col("a").isin(hot) & ~F.col("b").isin(hot)
    return pairs.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b")), hot


def _sketched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that sizes and sketches do not rule out."""
    pairs, hot = _oriented(pairs)
    small = sets.select("id", "n", "sketch")
    one, two = small.toDF("a", "_na", "_ka"), small.toDF("b", "_nb", "_kb")
    both = join_salted(pairs, two, "b", hot).join(one, "a").where(_may_link(F.col("_na"), F.col("_nb")))

    def run(batches):
        for p in batches:
            n = p.column("_na").to_numpy() + p.column("_nb").to_numpy()
            most = shared_at_most(p.column("_ka").to_pylist(), p.column("_kb").to_pylist(), n)
            yield p.filter(pa.array(most * 100 >= (n - most) * PERCENT)).select(["a", "b"])

    return both.mapInArrow(releasing(run), "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), a > b, with intersection * 100 >= union * 80, by intersecting the whole sets.

    Cheap exact bounds come first. The pairs of a hot document (the centre of a large star) are spread over tasks,
    each with a copy of its set.
    """
    pairs = materialize(_sketched(pairs, sets), "jaccard-maybe")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = sets.join(_sized(materialize(ids, "jaccard-needed")), "id", "left_semi")
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("_na"), F.col("shingles").alias("_sa"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("_nb"), F.col("shingles").alias("_sb"))
    pairs, hot = _oriented(pairs)
    both = join_salted(pairs, two, "b", hot).join(one, "a")
    shared = F.size(F.array_intersect("_sa", "_sb"))
    good = shared * 100 >= (F.col("_na") + F.col("_nb") - shared) * PERCENT
    return both.where(good).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def cross_pairs(sets: DataFrame, labels: DataFrame, bands: list[Band], common: np.ndarray) -> DataFrame:
    """Distinct (a, b), a > b, of documents that share a key, are in different components and may link."""
    shared = sets.sparkSession.sparkContext.broadcast(common)
    labels = labels.select(F.col("node").alias("id"), "component")
    rows = sets.join(_sized(labels), "id", "left").select("id", F.coalesce("component", "id").alias("component"), "shingles")

    def run(batches):
        for part in _tables(batches, "shingles"):
            sets = [np.sort(s.to_numpy(zero_copy_only=False).view(_U)) for s in (part.column("shingles")[i].values for i in range(part.num_rows))]
            docs, keys = index_keys(sets, bands, shared.value)
            cols = [_signed(keys), pa.array(part.column("id").to_numpy()[docs]), pa.array(part.column("component").to_numpy()[docs])]
            yield pa.RecordBatch.from_arrays(cols, ["key", "id", "component"])

    keyed = materialize(rows.mapInArrow(releasing(run), "key long, id long, component long"), "jaccard-keyed")
    open_ = materialize(_open_keys(keyed), "jaccard-open")
    if open_.isEmpty():
        return sets.sparkSession.createDataFrame([], "a long, b long")
    large = materialize(open_.groupBy("key").count().where(F.col("count") > LARGE_KEY).select("key"), "jaccard-large")
    pairs = _pairs_of_keys(open_.join(_sized(large), "key", "left_anti"), sets)
    if large.isEmpty():
        return pairs
    # only shingles that sets of several components have can be shared across components
    crowd = open_.join(_sized(large), "key", "left_semi")
    ids = materialize(crowd.select("id", "component").distinct(), "jaccard-crowd")
    each = sets.join(_sized(ids), "id").select("id", "component", F.explode("shingles").alias("s"))
    wide = each.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("s")
    m = each.join(wide, "s", "left_semi").groupBy("id").agg(F.count("*").alias("m"))
    facts = sets.select("id", "n", "sketch").join(m, "id")
    facts = materialize(facts.where(F.col("m") * 100 >= F.col("n") * PERCENT), "jaccard-facts")
    crowd = materialize(_open_keys(crowd.join(_sized(facts.select("id")), "id", "left_semi")), "jaccard-crowded")
    return pairs.unionByName(_pairs_of_families(crowd, facts)).distinct()


def _open_keys(keyed: DataFrame) -> DataFrame:
    """Rows (key, id, component) of the keys that hold several components."""
    several = keyed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return keyed.join(_sized(materialize(several, "jaccard-several")), "key", "left_semi").distinct()


def _pairs_of_keys(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct (a, b), a > b, of rows of a key in different components that may link by their sizes. Keys are small here."""
    left = rows.join(_sized(sets.select("id", "n")), "id")
    other = left.select("key", *[F.col(c).alias(f"o_{c}") for c in ("id", "component", "n")])
    on = (F.col("component") != F.col("o_component")) & (F.col("id") > F.col("o_id")) & _may_link(F.col("n"), F.col("o_n"))
    return left.join(other, "key").where(on).select(F.col("id").alias("a"), F.col("o_id").alias("b")).distinct()


def _pairs_of_families(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct (a, b), a > b, of sets that large keys connect, in different components, that no upper bound rules out.

    A family (sets connected by keys) is dealt into blocks, and a task compares two blocks of at most about
    FAMILY_BLOCK sets: each pair is met once however many keys it shares, and only what may link is returned.
    """
    least = rows.groupBy("key").agg(F.min("id").alias("b"))
    stars = rows.join(least, "key").select(F.col("id").alias("a"), "b").where("a <> b").distinct()
    family = connected_components(stars).select(F.col("node").alias("id"), F.col("component").alias("family"))
    members = rows.select("id", "component").distinct().join(family, "id").join(facts, "id")
    members = materialize(members, "jaccard-members")
    blocks = members.groupBy("family").agg(F.ceil(F.count("*") / FAMILY_BLOCK).alias("blocks"))
    dealt = members.join(_sized(blocks), "family").withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})

    def compare(key, g):
        ids, part, n, m = (g[c].to_numpy() for c in ("id", "component", "n", "m"))
        mine = np.flatnonzero(g["own"].to_numpy() == key[1])
        theirs = mine if key[1] == key[2] else np.flatnonzero(g["own"].to_numpy() == key[2])
        most = np.minimum(m[mine][:, None], m[theirs][None, :])
        total = n[mine][:, None] + n[theirs][None, :]
        may = (part[mine][:, None] != part[theirs][None, :]) & (most * 100 >= (total - most) * PERCENT)
        if key[1] == key[2]:
            may &= ids[mine][:, None] > ids[theirs][None, :]
        x, y = np.nonzero(may)
        x, y, sketches = mine[x], theirs[y], g["sketch"].tolist()
        most = shared_at_most([sketches[i] for i in x], [sketches[i] for i in y], np.minimum(m[x], m[y]))
        keep = most * 100 >= (n[x] + n[y] - most) * PERCENT
        a, b = ids[x[keep]], ids[y[keep]]
        return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return dealt.groupBy("family", "p", "q").applyInPandas(compare, "a long, b long")


class JaccardJoin:
    """Sizes, components and spanning links of a table of documents, made once.

    spanning_links: verified links that reach every component from each of its documents; links inside a component
    that components do not need are not looked for.
    """

    def __init__(self, df: DataFrame, text_col: str = "text", id_col: str = "doc_id"):
        if dict(df.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
            raise TypeError(f"{id_col} is not a column of whole numbers")
        self.id_col = id_col
        with scratch_scope(df.sparkSession) as keep:
            measured = keep(measure(df, text_col, id_col))
            self.sizes = measured.where("shingle is null").select("id", "n")
            by_size = self.sizes.where("n > 0").groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count("*").alias("c"), F.sum("n").alias("s")).collect()
            bands = bands_for({r.e: r.c for r in by_size})
            places = sum(r.s for r in by_size)
            least = max(3, places // COMMON_SHARE + 1)
            frequent = measured.where("shingle is not null").groupBy("shingle").agg(F.sum("places").alias("p")).where(F.col("p") >= least)
            common = np.sort(frequent.select("shingle").toArrow().column(0).to_numpy().astype(np.int64).view(_U))
            stars = star_pairs(df, text_col, id_col, bands, common)
            ids = stars.select(F.col("a").alias("id")).unionByName(stars.select(F.col("b").alias("id"))).distinct()
            sets = active_sets(df, materialize(ids, "jaccard-active"), text_col, id_col)
            links = keep(materialize(verified(stars, sets), "jaccard-links"))
            first = keep(connected_components(links))
            more = verified(materialize(cross_pairs(sets, first, bands, common), "jaccard-cross"), sets)
            more = keep(materialize(more, "jaccard-more"))
            self.spanning_links = links.unionByName(more)
            self.components = first if more.isEmpty() else keep(connected_components(self.spanning_links))

    def classes(self) -> DataFrame:
        """One row for each row of the table: the id, n_shingles and component_id (the smallest id it reaches)."""
        c = self.components.select(F.col("node").alias("id"), "component")
        out = self.sizes.join(c, "id", "left")
        return out.select(F.col("id").alias(self.id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """df with one document of each component: that with the smallest id. Rows without an id stay."""
    (own,) = unused_names(df, "gone")
    with scratch_scope(df.sparkSession) as keep:
        found = JaccardJoin(df, text_col, id_col).components
        gone = keep(materialize(found.where("node <> component").select(F.col("node").alias(own)), "jaccard-gone"))
    return df.join(_sized(gone), F.col(id_col) == F.col(own), "left_anti")
