"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are dealt by hash into blocks of about BLOCK_WORDS words, which are so a random
permutation of the source. Its target says how many whole passes over its blocks the mix takes and how many
words of one more pass: a walk over the whole source, by block and hash, picks each document that fits in what
is left. If more than half of the pass is wanted, the walk picks what it leaves out. At the end one more document
is picked if that is nearer. So a long document is stepped over and the documents of later blocks fill its room.
Each pass over a block is a draw. The exact draw counts of all sources are then split among output shards by a
binary tree: a node gives its left half a multivariate-hypergeometric draw of its blocks. Each shard so gets
disjoint draws in the mix's proportions, and its rows are shuffled within the shard. A document is taken as often
as draws of its block were dealt to shards (once less if the last draw of the block is a part without it).

Targets: sources in code-point order, null last, weigh 3, 1, 2, repeating, and share SHARE of all words; no
target exceeds CAP times its source's words, and what is cut is shared among the others by weight.

How it runs: documents are only counted once (a narrow table of ids and sizes). Blocks number at most
MAX_BLOCKS plus one for each source, so windows over blocks stay small; targets come from a few aggregates over
a table of sources. A block that the walk takes whole is known from sums of blocks; documents are walked only in the block
where the room ends and in the next ones that hold some that fit, a few blocks a round. The tree runs as Spark stages: a
row is a node's count of one source, a task halves a node down to FAN children, and counts of zero have no row, so there
are never more rows than draws. Beyond BUCKET_SOURCES sources a node is first split by buckets of sources, and then each
bucket by its own quotas. Shards grow in number with the words, and beyond TASK_WORDS several tasks share a shard. A hot
source is spread over its blocks and is never in one task. The driver sees counts of tables only.

Defined cases: a null text has size 0; documents of size 0 follow their block and take 0 words; rows that
repeat an id and a text are drawn together; ties of the walk go by hash, then key; an empty table gives an empty
mix; sources of size 0 have target 0; all columns of the table stay as they are, whatever their names (but for one
named as shard_col, which is replaced). A text of any length is one row and is never split.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop_columns, hot_keys, join_salted, materialize, packed, scratch_scope, text_of, unpacked

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
BLOCK_WORDS, MAX_BLOCKS = 65_536, 16_000_000
SHARD_WORDS, LEAST_SHARDS, TASK_WORDS = 8_000_000, 16, 2_000_000
FAN, BUCKET_SOURCES = 64, 65_536
WALK_BLOCKS = 8
BROADCAST_BYTES, ROW_BYTES = 32_000_000, 120
SEED = 20_240_601


def targets(words: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Shares of `share` times all words by weight, none above `cap` times its own words."""
    left, out, free = share * sum(words), [0.0] * len(words), list(range(len(words)))
    while free:
        level = left / sum(weights[i] for i in free)
        over = [i for i in free if level * weights[i] > cap * words[i]]
        if not over:
            for i in free:
                out[i] = level * weights[i]
            break
        for i in over:
            out[i] = cap * words[i]
            left -= out[i]
        gone = set(over)
        free = [i for i in free if i not in gone]
    return out


def _targeted(docs: DataFrame, weights, share: float, cap: float) -> DataFrame:
    """(_source, _words, _target, _passes) of every source: `targets` as aggregates, whatever the number of sources."""
    sums = docs.groupBy("_source").agg(F.sum("_size").alias("_words")).orderBy("_source")
    # the place of a source in the order of all: its place in its range, after the sources of the ranges before
    placed = materialize(sums.withColumn("_i", F.monotonically_increasing_id()), "mix-order")
    part = F.shiftrightunsigned("_i", 33)
    before, offset = [], 0
    for p, n in sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect()):  # one row for each range
        before += [F.lit(p).cast("long"), F.lit(offset).cast("long")]
        offset += n
    place = (F.create_map(*before)[part] if before else F.lit(0)) + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.array(*map(F.lit, map(float, weights)))[(place % len(weights)).cast("int")]
    rows = placed.select("_source", "_words", weight.alias("_w"))
    left, free = rows.agg(F.coalesce(F.sum("_words"), F.lit(0)) * F.lit(float(share)), F.coalesce(F.sum("_w"), F.lit(0.0))).first()
    over, known = F.lit(False), 0
    while free > 0:
        level = left / free
        over = F.lit(level) * F.col("_w") > cap * F.col("_words")
        n, capped, rest, total = rows.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, cap * F.col("_words"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0.0)), F.sum("_words") * F.lit(float(share))
        ).first()
        if n == known:
            break
        known, left, free = n, total - capped, rest
    target = F.when(over, cap * F.col("_words")).otherwise(F.lit(left / free if free > 0 else 0.0) * F.col("_w"))
    passes = F.when(F.col("_words") > 0, F.floor(F.col("_target") / F.col("_words"))).otherwise(0)
    rows = rows.withColumn("_target", target.cast("double")).withColumn("_p", passes)
    return rows.select("_source", "_words", "_target", (F.col("_p") - F.when(F.col("_p") * F.col("_words") > F.col("_target"), 1).otherwise(0)).cast("int").alias("_passes"))


def quotas_of(total: int, widths: list[int]) -> list[int]:
    """total in parts by widths, each within one of its share."""
    ends = [total * x // sum(widths) for x in np.cumsum(widths).tolist()]
    return np.diff([0, *ends]).tolist()


def split_counts(counts: np.ndarray, quotas: list[int], seed=SEED) -> np.ndarray:
    """counts (one for each source) split into rows that sum to quotas; rows sum to counts. A binary tree of draws without replacement."""
    rng = np.random.Generator(np.random.PCG64(seed))

    def split(c: np.ndarray, q: list[int]) -> list[np.ndarray]:
        if len(q) == 1:
            return [c]
        half = len(q) // 2
        take = sum(q[:half])
        left = rng.multivariate_hypergeometric(c, take, method="marginals") if take else np.zeros_like(c)
        return split(left, q[:half]) + split(c - left, q[half:])

    return np.array(split(np.asarray(counts, np.int64), list(quotas))).reshape(len(quotas), -1)


def child_widths(width: int) -> list[int]:
    """The shards of a node dealt to at most FAN children."""
    n = min(width, FAN)
    return [width // n + (i < width % n) for i in range(n)]


def _children(g: pd.DataFrame) -> pd.DataFrame:
    """The rows of one node (or of one bucket of its sources, with that bucket's quotas) as rows of its children."""
    g = g.sort_values("_source", ignore_index=True)
    node, width, bucket = (int(g[c].iat[0]) for c in ("_node", "_width", "_bucket"))
    widths = child_widths(width)
    counts = g["_c"].to_numpy(np.int64)
    quotas = g["_quotas"].iat[0].tolist() if "_quotas" in g else quotas_of(int(counts.sum()), widths)
    child, at = np.nonzero(cut := split_counts(counts, quotas, [SEED, node, width, bucket]))
    starts = node + np.cumsum([0, *widths[:-1]])
    return pd.DataFrame({"_node": starts[child], "_width": np.array(widths)[child], "_bucket": np.full(len(at), bucket), "_source": g["_source"].to_numpy()[at], "_c": cut[child, at]})


def _bucket_quotas(g: pd.DataFrame) -> pd.DataFrame:
    """What each bucket of a node's sources gives to each child."""
    g = g.sort_values("_bucket", ignore_index=True)
    node, width = int(g["_node"].iat[0]), int(g["_width"].iat[0])
    cut = split_counts(g["_c"].to_numpy(np.int64), quotas_of(int(g["_c"].sum()), child_widths(width)), [SEED, node, width])
    return pd.DataFrame({"_node": g["_node"], "_bucket": g["_bucket"], "_quotas": [x.tolist() for x in cut.T]})


def deal_counts(counts: DataFrame, shards: int, sources: int) -> DataFrame:
    """(_source, _shard, _c): the draws (_source, _c) of each source by shard, none of zero. sources: about how many there are."""
    buckets = max(1, math.ceil(sources / BUCKET_SOURCES))
    bucket = F.pmod(F.xxhash64("_source"), F.lit(buckets)).cast("long")
    nodes = counts.select(F.lit(0).cast("long").alias("_node"), F.lit(shards).cast("long").alias("_width"), bucket.alias("_bucket"), "_source", F.col("_c").cast("long"))
    kinds = "_node long, _width long, _bucket long, _source string, _c long"
    width = shards
    while width > 1:
        if buckets > 1:
            totals = nodes.groupBy("_node", "_width", "_bucket").agg(F.sum("_c").alias("_c"))
            quotas = totals.groupBy("_node").applyInPandas(_bucket_quotas, "_node long, _bucket long, _quotas array<long>")
            nodes = nodes.join(quotas, ["_node", "_bucket"])
        nodes = materialize(nodes.groupBy("_node", "_bucket").applyInPandas(_children, kinds), "mix-nodes")
        width = max(child_widths(width))
    return nodes.select("_source", F.col("_node").alias("_shard"), "_c")


def _source_key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t"))  # null sorts last


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.lit(SEED), text_of(text_col))


def _is_small(x: DataFrame) -> bool:
    """Whether a table of sources, blocks or keys may be broadcast: its strings and arrays are measured."""
    draws = F.sum(F.size("_shards")) if "_shards" in x.columns else F.lit(0)
    n, chars, entries = x.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_source")), F.lit(0)), F.coalesce(draws, F.lit(0))).first()
    return n * ROW_BYTES + chars + 8 * entries <= BROADCAST_BYTES


def _sized(x: DataFrame) -> DataFrame:
    return F.broadcast(x) if _is_small(x) else x


def _walk(g: pd.DataFrame) -> pd.DataFrame:
    """The documents of a source's blocks that fit in its room, one after the other."""
    g = g.sort_values(["_block", "_h", "_key"])
    room, taken = float(g["_room"].iat[0]), []
    for n in g["_n"].tolist():
        taken.append(n <= room)
        room -= n if taken[-1] else 0
    return g.loc[taken, ["_source", "_block", "_key", "_n"]]


class Mix:
    """What a mix takes: tables for documents, blocks and sources, made once for a table of documents."""

    def __init__(self, df: DataFrame, text_col="text", id_col="doc_id", source_col="source", shards: int | None = None, weights=WEIGHTS, share=SHARE, cap=CAP):
        self.cols = (text_col, id_col, source_col)
        with scratch_scope(df.sparkSession) as keep:
            self._make(df, shards, weights, share, cap)
            for table in (self.docs, self.sources, self.blocks, self.edge):
                keep(table)

    def _make(self, df: DataFrame, shards: int | None, weights, share: float, cap: float) -> None:
        text_col, id_col, source_col = self.cols
        spark = df.sparkSession
        self.docs = materialize(
            df.select(
                F.col(id_col).alias("_id"), _source_key(source_col).alias("_source"), _row_key(id_col, text_col).alias("_key"),
                F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("_size"),
            ),
            "mix-docs",
        )
        self.sources = _targeted(self.docs, weights, share, cap)
        n, words = self.sources.agg(F.count("*"), F.coalesce(F.sum("_words"), F.lit(0))).first()
        self.shards = shards or max(LEAST_SHARDS, math.ceil(share * words / SHARD_WORDS))
        self.tasks_a_shard = max(1, math.ceil(share * words / self.shards / TASK_WORDS))
        unit = max(BLOCK_WORDS, math.ceil(words / MAX_BLOCKS))
        rest = F.col("_target") - F.col("_passes") * F.col("_words")
        out = rest > F.col("_words") / 2
        # _left: words to pick of one more pass; _out: the pass takes what is not picked
        self.sources = materialize(
            self.sources.select(
                "_source", "_words", "_target", F.greatest(F.lit(1), F.bround(F.col("_words") / unit, 0)).cast("long").alias("_blocks"), "_passes",
                F.when(out, F.col("_words") - rest).otherwise(rest).alias("_left"), out.alias("_out"),
            ),
            "mix-sources",
        )
        self._sources_small = _is_small(self.sources)
        self.in_blocks = self._with_source(self.docs).withColumn("_block", F.pmod("_key", "_blocks"))
        blocks = self.in_blocks.groupBy("_source", "_block", "_passes", "_out", "_left").agg(F.sum("_size").alias("_n"))
        before = F.sum("_n").over(Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
        blocks = blocks.withColumn("_room", F.col("_left") - F.coalesce(before, F.lit(0)))
        blocks = materialize(blocks.withColumn("_full", (F.col("_left") > 0) & (F.col("_n") <= F.col("_room"))), "mix-sums")
        picked = self._picked(blocks)
        some = picked.groupBy("_source", "_block").agg(F.sum("_n").alias("_p"))
        blocks = blocks.join(_sized(some), ["_source", "_block"], "left")
        blocks = blocks.withColumn("_p", F.when(F.col("_full"), F.col("_n")).otherwise(F.coalesce("_p", F.lit(0))))
        edge = F.when(F.col("_p") == 0, F.when(F.col("_out"), "whole").otherwise("none"))
        edge = edge.when(F.col("_p") == F.col("_n"), F.when(F.col("_out"), "none").otherwise("whole")).otherwise("part")
        blocks = materialize(blocks.withColumn("_edge", edge), "mix-blocks")
        self.blocks = self._dealt(blocks, n)
        part = blocks.where("_edge = 'part'").select("_source", "_block")
        self.edge = materialize(picked.join(_sized(part), ["_source", "_block"]).select("_source", "_key", F.lit(True).alias("_in")), "mix-edge")

    def _with_source(self, rows: DataFrame) -> DataFrame:
        """rows (_source, ...) with the columns of their sources; a source may have a third of the rows."""
        if self._sources_small:
            return rows.join(F.broadcast(self.sources), "_source")
        return join_salted(rows, self.sources, "_source", hot_keys(self.docs, "_source"))

    def _picked(self, blocks: DataFrame) -> DataFrame:
        """(_source, _block, _key, _n) of the documents that one more pass picks outside the blocks that it picks whole (_full).

        The walk goes on document by document in the block where the room ends, then in the next WALK_BLOCKS blocks
        that hold a document for what is left, and so on. Documents that were stepped over never fit later.
        """
        ends = blocks.where("_room > 0 and not _full").groupBy("_source").agg(F.min(F.struct("_block", "_room")).alias("_m"))
        open_ = materialize(ends.select("_source", "_m._block", "_m._room"), "mix-open")
        rooms = [open_.drop("_block")]
        docs = self.in_blocks.where("_size > 0").select("_source", "_block", "_key", "_size")
        found, chosen, self.rounds = [], open_, 0
        while not chosen.isEmpty():
            self.rounds += 1
            rows = docs.join(_sized(chosen), ["_source", "_block"]).where("_size <= _room")
            rows = rows.groupBy("_source", "_block", "_key", "_room").agg(F.sum("_size").alias("_n")).withColumn("_h", F.xxhash64("_key", F.lit(1)))
            rows = rows.groupBy("_source").applyInPandas(_walk, "_source string, _block long, _key long, _n long")
            found.append(materialize(rows, "mix-walk"))
            used = found[-1].groupBy("_source").agg(F.sum("_n").alias("_used"))
            # only sources that went through blocks have room for more
            last = chosen.groupBy("_source").agg(F.max("_block").alias("_last"), F.first("_room").alias("_room"))
            left = last.join(used, "_source", "left").withColumn("_room", F.col("_room") - F.coalesce("_used", F.lit(0))).drop("_used")
            left = materialize(left, "mix-left")
            rooms.append(left.drop("_last"))
            near = docs.join(_sized(left.where("_room > 0")), "_source").where("_block > _last and _size <= _room")
            near = near.groupBy("_source", "_block", "_room").agg(F.count("*").alias("_some"))
            place = F.row_number().over(Window.partitionBy("_source").orderBy("_block"))
            chosen = materialize(near.withColumn("_place", place).where(F.col("_place") <= WALK_BLOCKS).select("_source", "_block", "_room"), "mix-open")
        picked = blocks.limit(0).select("_source", "_block", F.lit(0).cast("long").alias("_key"), "_n")
        for r in found:
            picked = picked.unionByName(r)
        # one more, if going over by it is nearer than what is left
        left = rooms[0]
        for r in rooms[1:]:
            left = left.unionByName(r)
        left = left.groupBy("_source").agg(F.min("_room").alias("_room")).where("_room > 0")
        near = docs.join(_sized(left), "_source").where("_size < 2 * _room").groupBy("_source", "_block", "_key", "_room").agg(F.sum("_size").alias("_n"))
        near = near.where("_n < 2 * _room").join(picked, ["_source", "_block", "_key"], "left_anti")
        near = near.join(_sized(blocks.where("_full").select("_source", "_block")), ["_source", "_block"], "left_anti")
        near = near.groupBy("_source").agg(F.min(F.struct("_n", "_key", "_block")).alias("_m"))
        return materialize(picked.unionByName(near.select("_source", "_m._block", "_m._key", "_m._n")), "mix-picked")

    def _dealt(self, blocks: DataFrame, sources: int) -> DataFrame:
        """blocks with _shards: array<int>, the shard of each draw of the block (the last may be a part)."""
        draws = F.col("_passes") + F.when(F.col("_edge") == "none", 0).otherwise(1)
        drawn = blocks.withColumn("_draws", draws).where("_draws > 0")
        cells = deal_counts(drawn.groupBy("_source").agg(F.sum("_draws").alias("_c")), self.shards, sources)
        # a source's draws, in the order of a hash, go to its shards one after the other
        end = F.sum("_c").over(Window.partitionBy("_source").orderBy("_shard"))
        cells = cells.withColumn("_end", end).select("_source", "_shard", F.explode(F.sequence(F.col("_end") - F.col("_c") + 1, "_end")).alias("_rank"))
        one = drawn.select("_source", "_block", F.explode(F.sequence(F.lit(1), "_draws")).alias("_draw"))
        order = ["_block", "_draw"]
        rank = F.row_number().over(Window.partitionBy("_source").orderBy(F.xxhash64(*order, F.lit(SEED)), *order)).cast("long")
        one = one.withColumn("_rank", rank).join(cells, ["_source", "_rank"])
        dealt = one.groupBy("_source", "_block").agg(F.sort_array(F.collect_list(F.struct("_draw", "_shard"))).alias("_d"))
        dealt = dealt.select("_source", "_block", F.transform("_d", lambda d: d["_shard"].cast("int")).alias("_shards"))
        return materialize(
            blocks.select("_source", "_block", "_passes", "_edge").join(dealt, ["_source", "_block"], "left"), "mix-dealt"
        )

    def _decided(self, rows: DataFrame) -> DataFrame:
        """rows (_source, _key, ...) with source columns and _taken: array<int>, the shards that a row was dealt to, one for each draw."""
        rows = self._with_source(rows).drop("_passes", "_left").withColumn("_block", F.pmod("_key", "_blocks"))
        rows = rows.join(_sized(self.blocks.select("_source", "_block", "_edge", "_shards")), ["_source", "_block"], "left")
        rows = rows.join(_sized(self.edge), ["_source", "_key"], "left")
        without = (F.col("_edge") == "part") & (F.coalesce("_in", F.lit(False)) == F.col("_out"))
        draws = F.size("_shards") - F.when(without, 1).otherwise(0)
        none = F.array().cast("array<int>")
        return rows.withColumn("_taken", F.when(F.col("_shards").isNull(), none).otherwise(F.slice("_shards", F.lit(1), draws)))

    def taken(self) -> DataFrame:
        """One row for each document: the id, size, source_size, target (its source's), taken, and shards (one for each time it is taken)."""
        out = self._decided(self.docs)
        return out.select(
            F.col("_id").alias(self.cols[1]), F.col("_size").alias("size"), F.col("_words").alias("source_size"),
            F.col("_target").alias("target"), (F.col("_size") * F.size("_taken")).alias("taken"), F.array_join(F.col("_taken").cast("array<string>"), ",").alias("shards"),
        )

    def rows(self, df: DataFrame, shard_col: str | None = "shard") -> DataFrame:
        """The mix itself: rows of df as often as they are taken, dealt to shards and shuffled within them."""
        text_col, id_col, source_col = self.cols
        plain = drop_columns(df, shard_col) if shard_col else df
        if shard_col and shard_col.lower() in {c.lower() for c in self.cols}:
            raise ValueError(f"the shard column cannot be named {shard_col}")
        rows = packed(plain, _source=_source_key(source_col), _key=_row_key(id_col, text_col))
        rows = self._decided(rows).select("_row", "_key", F.explode("_taken").alias("_shard"))
        place = F.xxhash64("_key", "_shard", F.lit(SEED))
        rows = rows.repartition("_shard", F.pmod(place, F.lit(self.tasks_a_shard))).sortWithinPartitions("_shard", place)
        return unpacked(rows, **({shard_col: F.col("_shard")} if shard_col else {}))
