"""Shared pieces: scratch tables in the cluster's shared folder and joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialize, scratch_path, scratch_scope, shared_dir

#: Words, as every operator here counts them.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys that are routed by themselves because many rows may share them. Every other key holds less than 1/HOT_KEYS of the rows.
HOT_KEYS = 256
HOT_LEAST = 1000


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def hot_keys(df: DataFrame, key: str, most: int = HOT_KEYS, least: int = HOT_LEAST) -> list:
    """The at most `most` commonest values of `key` with `least` rows or more, counted over all rows."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return [r[0] for r in counts.where(F.col("_n") >= least).orderBy(F.desc("_n"), key).limit(most).collect()]


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", least: int = HOT_LEAST) -> DataFrame:
    """left join right on key, where right has one row a key at most and left may hold a key in a third of its rows.

    Rows of the commonest keys meet a broadcast of at most HOT_KEYS rows; the others are shuffled.
    left should be a table (it is read up to three times). The key's nulls only stay with how="left".
    """
    hot = hot_keys(left, key, least=least)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    some = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    rest = left.where(~is_hot | F.col(key).isNull()).join(right.where(~is_hot), key, how)
    return some.unionByName(rest)


def join_salted(left: DataFrame, right: DataFrame, key: str, hot: list, salts: int = 32) -> DataFrame:
    """left join right on key, where right has few rows a key and may be wide, and left may hold the keys `hot` in a third of its rows.

    Rows of hot keys are spread over `salts` tasks, each with its own copy of the right rows; nothing is broadcast.
    """
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)
    spread = F.when(is_hot, F.pmod(F.xxhash64(*[F.col(c) for c in left.columns if c != key][:1]), F.lit(salts))).otherwise(0).cast("int")
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    one, two = left.withColumn("_salt", spread), right.withColumn("_salt", F.explode(copies))
    return one.join(two, [key, "_salt"]).drop("_salt")


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add (its output replaces them)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of df has, for columns that an operator needs for itself."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        own = f"_{name}"
        while own.lower() in taken:
            own += "_"
        taken.add(own.lower())
        out.append(own)
    return out


def packed(df: DataFrame, **own: Column) -> DataFrame:
    """The row of df as one column `_row` (null-safe for any column names) beside an operator's own columns; undone by unpacked."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(row.alias("_row"), *[c.alias(n) for n, c in own.items()])


def unpacked(df: DataFrame, **more: Column) -> DataFrame:
    return df.select("_row.*", *[c.alias(n) for n, c in more.items()])


def release() -> None:
    """Give freed memory back to the machine."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def releasing(run):
    """run (of mapInArrow), after which its Python worker, which lives on and serves later stages, holds no freed memory."""

    def task(batches):
        yield from run(batches)
        release()

    return task


def slices(batch, col: str, most: int):
    """Slices of an Arrow batch of at most about `most` bytes (or list entries, or the sum of a column of integers), so that memory stays bounded."""
    import pyarrow as pa
    import pyarrow.compute as pc

    values = batch.column(col)
    if pa.types.is_integer(values.type):
        lengths = values
    else:
        lengths = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    start = total = 0
    for i, n in enumerate(pc.fill_null(lengths, 0).to_pylist()):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def bytes_of(texts):
    """(bytes of all texts, where each begins and the last one ends); nulls are empty. An Arrow array of strings is read as it lies."""
    import numpy as np
    import pyarrow as pa

    texts = texts.cast(pa.large_string()).fill_null("")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


__all__ = ["ascii_lower", "bound_batches", "bytes_of", "drop_columns", "hot_keys", "join_hot", "join_salted", "materialize", "packed", "release", "releasing", "scratch_path", "scratch_scope", "shared_dir", "slices", "table", "text_of", "unpacked", "unused_names"]


#: Python workers get batches of at most so many bytes, where the session leaves Spark's default of 64 MB.
BATCH_BYTES = "8m"


def bound_batches(spark: SparkSession) -> None:
    """A batch of long texts is held several times, in the JVM and in Python, for each task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:  # not set by the session
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
