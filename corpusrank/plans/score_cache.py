"""Reranker scores that are kept: parts in buckets of keys, a bitmap of keys beside each, versions by manifest.

`append` writes a new part and commits a version that lists it, so two writers at once lose nothing and a reader never
sees half a part. `lookup` joins the keys asked for with the bitmaps first; only the buckets of parts whose bitmap has a
key's bit are listed and read. A bitmap can name a bucket in vain, never leave one out, so the result
is exact. `compact` merges small parts into one.

Defined cases: a null key is never stored nor found; a path without a version is an empty cache; the same
(key, chunk) in several parts is one row, that of the largest score.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions
from .scratch import discard

ROWS = "cache_key string, chunk_id string, ce_score double"
STORED = f"{ROWS}, part string, bucket string"
BUCKETS = 64
#: Bits of a part's bucket, kept in segments of 32,768; segments without a key are not stored.
SLOTS, SEGMENT = 1 << 20, 1 << 15
#: Keys asked for and buckets they hit are broadcast up to so many (some 60 bytes each); beyond that nearly all buckets are hit.
BROADCAST_KEYS = 200_000
#: Parts of fewer rows are small; so many of them are merged.
SMALL_ROWS, SMALL_PARTS = 1_000_000, 4
ATTEMPTS = 50


def _addressed(df: DataFrame) -> DataFrame:
    """df with the bucket, segment and bit of its cache_key. Names of buckets begin with a letter, so that no reader takes them for numbers."""
    slot = F.pmod(F.xxhash64("cache_key"), F.lit(SLOTS)).cast("int")
    return df.withColumns({"bucket": F.concat(F.lit("b"), F.pmod(F.crc32("cache_key"), F.lit(BUCKETS)).cast("string")), "segment": F.floor(slot / SEGMENT).cast("int"), "bit": (slot % SEGMENT).cast("int")})


def _has_bit(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, bit % 8) == 1


def _commit(spark: SparkSession, path: str, change) -> bool:
    """Commit change(parts); None gives up. Another writer's version is built upon."""
    for _ in range(ATTEMPTS):
        last = versions.read(spark, path) or {"version": 0, "parts": []}
        parts = change(last["parts"])
        if parts is None:
            return False
        try:
            versions.commit(spark, path, {"version": last["version"] + 1, "parts": parts})
            return True
        except versions.CommitConflict:
            continue
    raise versions.CommitConflict(f"no version of {path} could be committed in {ATTEMPTS} attempts")


def _write(rows: DataFrame, path: str) -> dict:
    """A new part of rows and its bitmaps, in no version yet."""
    spark, name = rows.sparkSession, f"p{uuid.uuid4().hex}"
    own = rows.where("cache_key is not null").selectExpr("cache_key", "chunk_id", "cast(ce_score AS double) AS ce_score")
    own = _addressed(own).drop("segment", "bit")
    # a folder of its own: writers of one folder would share, and delete, its temporary files
    own.repartition("bucket").sortWithinPartitions("bucket", "cache_key").write.partitionBy("bucket").parquet(f"{path}/scores/part={name}")
    stored = spark.read.schema(STORED).option("basePath", f"{path}/scores").parquet(f"{path}/scores/part={name}")
    bits = _addressed(stored.select("cache_key")).groupBy("bucket", "segment").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits.coalesce(1).write.parquet(f"{path}/keys/part={name}")
    return {"name": name, "rows": stored.count()}


def _scores(spark: SparkSession, path: str, parts: list[str]) -> DataFrame | None:
    folders = [f"{path}/scores/part={p}" for p in parts]
    if not folders:
        return None
    return spark.read.schema(STORED).option("basePath", f"{path}/scores").parquet(*folders)


def _parts(spark: SparkSession, path: str) -> list[dict]:
    return (versions.read(spark, path) or {"parts": []})["parts"]


def append(rows: DataFrame, path: str) -> None:
    """Keep rows (cache_key, chunk_id, ce_score)."""
    part = _write(rows, path)
    if part["rows"]:
        _commit(rows.sparkSession, path, lambda parts: [*parts, part])


def load(spark: SparkSession, path: str) -> DataFrame:
    """All (cache_key, chunk_id, ce_score) of the last version."""
    found = _scores(spark, path, [p["name"] for p in _parts(spark, path)])
    return spark.createDataFrame([], ROWS) if found is None else _once(found)


def _once(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cache_key", "chunk_id").agg(F.max("ce_score").alias("ce_score"))


def hits(keys: DataFrame, path: str) -> DataFrame | None:
    """(part, bucket, cache_key): where the bitmaps say that the keys asked for may be; None for an empty cache."""
    spark = keys.sparkSession
    parts = [p["name"] for p in _parts(spark, path)]
    if not parts:
        return None
    maps = spark.read.schema("bucket string, segment int, bits binary, part string").option("basePath", f"{path}/keys").parquet(*[f"{path}/keys/part={p}" for p in parts])
    asked = _addressed(keys.select("cache_key").where("cache_key is not null").distinct())
    near = F.broadcast if asked.count() <= BROADCAST_KEYS else lambda df: df
    return maps.join(near(asked), ["bucket", "segment"]).where(_has_bit(F.col("bits"), F.col("bit"))).select("part", "bucket", "cache_key")


def lookup(keys: DataFrame, path: str) -> DataFrame:
    """(cache_key, chunk_id, ce_score) of the keys that are kept. keys: (cache_key)."""
    spark = keys.sparkSession
    found = hits(keys, path)
    if found is None:
        return spark.createDataFrame([], ROWS)
    folders = [f"{path}/scores/part={r.part}/bucket={r.bucket}" for r in found.select("part", "bucket").distinct().orderBy("part", "bucket").collect()]  # at most BUCKETS a part
    if not folders:
        return spark.createDataFrame([], ROWS)
    stored = spark.read.schema(STORED).option("basePath", f"{path}/scores").parquet(*folders)
    near = F.broadcast if found.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else lambda df: df
    return _once(stored.join(near(found), ["part", "bucket", "cache_key"]))


def compact(spark: SparkSession, path: str, small: int = SMALL_ROWS, least: int = SMALL_PARTS) -> bool:
    """Merge the parts of fewer than `small` rows into one, if there are `least` of them; whether it was done.

    Parts that other writers add meanwhile stay; if one of the merged parts is gone (another compaction), nothing is done.
    """
    merged = [p["name"] for p in _parts(spark, path) if p["rows"] < small]
    if len(merged) < least:
        return False
    part = _write(_once(_scores(spark, path, merged)), path)

    def change(parts: list[dict]) -> list[dict] | None:
        if not set(merged) <= {p["name"] for p in parts}:
            return None
        return [p for p in parts if p["name"] not in merged] + [part]

    return _commit(spark, path, change)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the parts that were in a version and are in none of the last `keep`; their names. Parts in no version yet belong to writers and stay."""
    numbers = versions.numbers(spark, path)
    names = lambda n: {p["name"] for p in versions.read(spark, path, n)["parts"]}
    alive = set().union(*map(names, numbers[-keep:])) if numbers else set()
    there = {n.removeprefix("part=") for n in versions.names_in(spark, f"{path}/scores")}
    dead = sorted((set().union(*map(names, numbers[:-keep])) if numbers[:-keep] else set()) & there - alive)
    for name in dead:
        discard(spark, f"{path}/scores/part={name}")
        discard(spark, f"{path}/keys/part={name}")
    return dead
