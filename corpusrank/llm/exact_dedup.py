"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Equal blocks get equal integer names by sorting the
blocks; then adjacent names are paired and the pairs named in the same way, level by level, until one name
stands for each document. Names come from comparing whole values, never from a digest alone, so two
documents share an identity only if they are byte for byte the same. Rows that share an id (or have none) are told
apart by the SHA-256 of their text, which then stands beside the id.

How it runs: a level is one shuffle of its blocks (of the text itself only once, on level 0). Blocks go to
2^24 ranges of their hash and are ranked by value within a range, so ranges stay small at any input size.
The up to HOT_KEYS commonest blocks, which could otherwise fill one task, are named from a broadcast table.

Defined cases: a null text counts as empty; empty texts equal each other; rows that repeat an id and a text
are copies of each other and one of them stays; rows with a null id are documents whose id loses to any other;
a very long text is cut into as many blocks as it needs; an empty table gives an empty result; all other columns
stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, join_hot, materialize, packed, scratch_scope, text_of, unpacked

BLOCK_BYTES = 4096
RANGE_BITS = 24
#: Dropped rows up to this number are broadcast (about 50 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
_KEY = ["_id", "_fp", "_len"]


def _print(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def _named(occurrences: DataFrame, value: list[str], name: str) -> DataFrame:
    """Adds `name`: equal for rows with equal `value` columns, different for all others."""
    occurrences = occurrences.withColumn("_h", F.xxhash64(*value))
    hot = hot_keys(occurrences.select("_h"), "_h")
    is_hot = F.col("_h").isin(hot) if hot else F.lit(False)
    rng = F.shiftrightunsigned("_h", 64 - RANGE_BITS)
    rank = F.dense_rank().over(Window.partitionBy("_range").orderBy(*value)).cast("long")
    cold = occurrences.where(~is_hot).withColumn("_range", rng)
    out = cold.withColumn(name, F.shiftleft("_range", 32).bitwiseOR(rank)).drop("_range", "_h", *value)
    if hot:
        few = occurrences.where(is_hot).select("_h", *value).distinct()
        number = F.row_number().over(Window.orderBy(*value)).cast("long")
        few = few.withColumn(name, F.lit(1 << 56).bitwiseOR(number))
        some = occurrences.where(is_hot).join(F.broadcast(few), ["_h", *value]).drop("_h", *value)
        out = out.unionByName(some)
    return out


def _gathered(named: DataFrame, carry: list[str]) -> DataFrame:
    seq = F.sort_array(F.collect_set(F.struct("_pos", "_name")))
    return named.groupBy(*_KEY).agg(
        F.transform(seq, lambda x: x["_name"]).alias("_names"),
        *[F.first(c).alias(c) for c in carry],
    )


def block_identities(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    carry: dict[str, Column] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each distinct (id, text): _id, _fp, _len, _copies, identity (long), and the carry columns.

    carry: further columns computed from a row, kept beside its identity.
    """
    with scratch_scope(df.sparkSession) as keep:
        return keep(_named_levels(df, text_col, id_col, carry or {}, block_bytes))


def _named_levels(df: DataFrame, text_col: str, id_col: str, carry: dict[str, Column], block_bytes: int) -> DataFrame:
    rows = df.select(
        F.col(id_col).alias("_id"), text_of(text_col).cast("binary").alias("_b"), *[c.alias(n) for n, c in carry.items()]
    )
    rows = rows.withColumns({"_fp": _print(F.col("_b")), "_len": F.octet_length("_b")})
    cut = F.expr(
        f"transform(sequence(0, (_len - 1) div {block_bytes}), i -> substring(_b, cast(i as int) * {block_bytes} + 1, {block_bytes}))"
    )
    occurrences = rows.select(*_KEY, *carry, F.posexplode(cut).alias("_pos", "_block"))
    named = _named(occurrences, ["_block"], "_name")
    # a row repeated as it is gives each of its blocks several times: the first block counts the copies
    first = F.sum((F.col("_pos") == 0).cast("long")).alias("_copies")
    seq = F.sort_array(F.collect_set(F.struct("_pos", "_name")))
    level = materialize(
        named.groupBy(*_KEY).agg(
            F.transform(seq, lambda x: x["_name"]).alias("_names"), first, *[F.first(c).alias(c) for c in carry]
        ),
        "names-0",
    )
    kept = ["_copies", *carry]
    done, depth = [], 0
    longest = level.agg(F.max(F.size("_names"))).first()[0] or 1
    while True:
        one = level.where(F.size("_names") == 1)
        identity = F.lit(depth << 57).bitwiseOR(F.col("_names")[0])
        done.append(one.select(*_KEY, *kept, identity.alias("identity")))
        if longest <= 1:
            break
        pairs = F.expr(
            "transform(sequence(0, (size(_names) - 1) div 2), i -> struct(_names[2 * i] as _a, coalesce(get(_names, 2 * i + 1), 0L) as _z))"
        )
        occurrences = (
            level.where(F.size("_names") > 1)
            .select(*_KEY, *kept, F.posexplode(pairs).alias("_pos", "_pair"))
            .select(*_KEY, *kept, "_pos", "_pair._a", "_pair._z")
        )
        depth, longest = depth + 1, (longest + 1) // 2
        level = materialize(_gathered(_named(occurrences, ["_a", "_z"], "_name"), kept), f"names-{depth}")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return materialize(out, "identities")


def duplicate_report(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", carry: dict[str, Column] | None = None
) -> DataFrame:
    """One row for each row of df: the id, keep_id, group_size, kept, identity and the carry columns.

    Of equal texts the row with the largest id stays; of rows that repeat that id and text, one.
    """
    ids = block_identities(df, text_col, id_col, carry)
    groups = ids.groupBy("identity").agg(F.max("_id").alias("keep_id"), F.sum("_copies").alias("group_size"))
    joined = join_hot(ids, groups, "identity")
    each = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    kept = F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)
    return each.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "identity", "_fp", "_len", "_copies", *(carry or {})
    )


def drop_copies(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """df without the rows whose text another row with a larger id has; all columns stay as they are."""
    key = [F.col(id_col).alias("_k_id"), F.col("_fp").alias("_k_fp")]
    with scratch_scope(df.sparkSession) as keep:
        report = duplicate_report(df, text_col, id_col)
        gone = report.where(~F.col("kept") & ~(F.col(id_col).eqNullSafe(F.col("keep_id")))).select(*key)
        again = report.where(F.col("kept") & (F.col("_copies") > 1)).select(*key)
        gone, again = keep(materialize(gone, "gone")), keep(materialize(again, "again"))
    rows = packed(df, _r_id=F.col(f"`{id_col}`"), _r_fp=_print(text_of(text_col).cast("binary")))
    same = F.col("_r_id").eqNullSafe(F.col("_k_id")) & (F.col("_r_fp") == F.col("_k_fp"))

    def sized(x: DataFrame) -> DataFrame:
        return F.broadcast(x) if x.count() <= BROADCAST_ROWS else x

    kept = rows.join(sized(gone), same, "left_anti")
    if not again.isEmpty():
        repeated = kept.join(sized(again), same, "left_semi").dropDuplicates(["_r_id", "_r_fp"])
        kept = kept.join(sized(again), same, "left_anti").unionByName(repeated)
    return unpacked(kept)
