"""Media columns by content-defined payload chunking.

A payload is cut where a rolling gear hash of the last 16 bytes has its low bits clear, so equal passages
give equal chunks wherever they stand. Chunks are known by their SHA-256. A chunk that occurs more than once
in the corpus is stored once, in the chunk table; the others stay inside their media row, so that only
repeated chunks are moved. A media row holds the ordered chunk list, and reading follows it: repeated chunks
are joined back by digest and every chunk and length is verified.

The stored form of a media is its head (magic, payload bytes, chunk count, and length and digest of each chunk
in order), which is written beside the row, and the chunks as 8-bit samples, which are written once each. Reading
takes head and chunks from the tables, checks every length and digest, and digests exactly the bytes that it read.
The form depends on the payload alone.

How it runs: one pass counts digests (a narrow shuffle), one stores repeated chunks (only those are
shuffled), one writes the media table. Rows learn which of their chunks repeat by a map-side join with the repeated
digests; if there are more than BROADCAST_DIGESTS of them, by a shuffled join. A chunk in a third of all rows is
pre-aggregated by slices on the way in and met by broadcast on the way out.

Defined cases: a null text counts as empty; an empty payload is one chunk of 64 zero bytes; a very long text is a
slice of its own in every pass; equal texts have equal forms; repeated rows are stored each (their repeated chunks
once); all other columns of a row are kept, whatever their names, but for those named as the result's, which are
replaced; an empty table gives an empty store. Reading a store that lacks a chunk, or whose chunk differs, raises.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_columns, join_hot, materialize, releasing, scratch_path, slices

PAD = 64
LEAST, MEAN_BITS, MOST = 2048, 13, 65536
SLICE_CHARS = 4_000_000
BROADCAST_DIGESTS = 400_000
MAGIC = b"CDC1"
_GEAR = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 32, 256, np.uint32)
_STORED = ["_m_bytes", "_m_head", "_m_bodies"]
_HEAD, _ENTRY = "<4sQI", "<I32s"
_HEAD_SIZE, _ENTRY_SIZE = struct.calcsize(_HEAD), struct.calcsize(_ENTRY)
_DIGESTS = f"transform(sequence(0, size(_m_bodies) - 1), i -> substring(_m_head, {_HEAD_SIZE + 5} + {_ENTRY_SIZE} * i, 32)) AS _m_digests"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the text as UTF-8 with zero bytes up to a positive multiple of PAD)."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % PAD if raw else PAD)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i-k]] << k for k < 16: doubled four times instead of rolled byte by byte."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def chunks_of(payload: bytes) -> list[bytes]:
    """The payload cut after hash matches, no chunk under LEAST (but the last) or over MOST."""
    if len(payload) <= LEAST:
        return [payload]
    h = gear_hashes(np.frombuffer(payload, np.uint8))
    ends = np.flatnonzero((h >> np.uint32(3)) & np.uint32((1 << MEAN_BITS) - 1) == 0) + 1
    out, start, n = [], 0, len(payload)
    while n - start > LEAST:
        i = np.searchsorted(ends, start + LEAST)
        cut = min(int(ends[i]) if i < len(ends) else n, start + MOST, n)
        out.append(payload[start:cut])
        start = cut
    if start < n:
        out.append(payload[start:])
    return out


def _digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def head_of(chunks: list[bytes]) -> bytes:
    """The head of a stored form: magic, payload bytes and chunk count, then length and digest of each chunk."""
    return struct.pack(_HEAD, MAGIC, sum(map(len, chunks)), len(chunks)) + b"".join(struct.pack(_ENTRY, len(c), _digest(c)) for c in chunks)


def payload_from(head: bytes, bodies: list[bytes | None]) -> bytes:
    """The payload of a head and its chunks; raises where they do not agree."""
    magic, size, count = struct.unpack_from(_HEAD, head)
    entries = list(struct.iter_unpack(_ENTRY, head[_HEAD_SIZE:]))
    if magic != MAGIC or count != len(entries) or entries != [(len(b or b""), _digest(b or b"")) for b in bodies]:
        raise ValueError("a stored chunk differs from its head")
    out = b"".join(bodies)
    if len(out) != size:
        raise ValueError("a stored payload differs from its head")
    return out


def _parts(batches, col):
    return (p for b in batches for p in slices(b, col, SLICE_CHARS))


class MediaStore:
    """Tables `media` (the other columns as one, and the heads) and `chunks` (digest, body: each repeated chunk once)."""

    def __init__(self, media: DataFrame, chunks: DataFrame):
        self.media, self.chunks = media, chunks

    @classmethod
    def write(cls, df: DataFrame, text_col: str = "text", root: str | None = None, broadcast_digests: int = BROADCAST_DIGESTS) -> MediaStore:
        """Store text_col of every row under root (by default in the shared folder)."""
        spark = df.sparkSession
        root = root or scratch_path(spark, "media")
        texts = df.select(F.col(text_col).alias("_t"))

        def count(batches):
            for part in _parts(batches, "_t"):
                seen = Counter(_digest(c) for t in part.column("_t").to_pylist() for c in chunks_of(payload_of(t)[1]))
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["digest", "n"])

        counted = texts.mapInArrow(releasing(count), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
        again = materialize(counted.where("n > 1").select("digest"), "media-repeated")
        few = again.count() <= broadcast_digests
        known = spark.sparkContext.broadcast(frozenset(bytes(r[0]) for r in again.collect())) if few else None
        others = [F.col(f"`{c}`") for c in drop_columns(df, text_col).columns] or [F.lit(True).alias("_none")]
        rows_in = df.select(F.struct(*others).alias("_row"), F.col(f"`{text_col}`").alias("_t"))
        schema = T.StructType([rows_in.schema["_row"]])
        for name, kind in zip(_STORED, (T.LongType(), T.BinaryType(), T.ArrayType(T.BinaryType())), strict=True):
            schema = schema.add(name, kind)

        def rows(batches):
            repeated = known.value if known else frozenset()
            for part in _parts(batches, "_t"):
                size, heads, bodies = [], [], []
                for t in part.column("_t").to_pylist():
                    n, payload = payload_of(t)
                    cut = chunks_of(payload)
                    head = head_of(cut)
                    size.append(n)
                    heads.append(head)
                    digests = (d for _, d in struct.iter_unpack(_ENTRY, head[_HEAD_SIZE:]))
                    bodies.append([None if d in repeated else c for d, c in zip(digests, cut, strict=True)])
                cols = [pa.array(size, pa.int64()), pa.array(heads, pa.binary()), pa.array(bodies, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column("_row"), *cols], ["_row", *_STORED])

        def bodies(batches):
            repeated = known.value if known else None
            for part in _parts(batches, "_t"):
                found = {_digest(c): c for t in part.column("_t").to_pylist() for c in chunks_of(payload_of(t)[1])}
                found = {d: c for d, c in found.items() if repeated is None or d in repeated}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["digest", "body"])

        shared = texts.mapInArrow(releasing(bodies), "digest binary, body binary")
        if not few:
            shared = shared.join(again, "digest", "left_semi")
        shared.groupBy("digest").agg(F.first("body").alias("body")).write.option("compression", "zstd").parquet(f"{root}/chunks")
        media = rows_in.mapInArrow(releasing(rows), schema).withColumn("_m_row", F.monotonically_increasing_id())
        if not few:
            media = cls._without(materialize(media, "media-whole"), again)
        media.write.option("compression", "zstd").parquet(f"{root}/media")
        return cls(spark.read.schema(media.schema).parquet(f"{root}/media"), spark.read.schema("digest binary, body binary").parquet(f"{root}/chunks"))

    @staticmethod
    def _without(media: DataFrame, again: DataFrame) -> DataFrame:
        """media without the bodies of repeated chunks, found by a join."""
        at = media.selectExpr("_m_row", _DIGESTS).select("_m_row", F.posexplode("_m_digests").alias("_pos", "digest"))
        hits = join_hot(at, again, "digest").groupBy("_m_row").agg(F.collect_set("_pos").alias("_hits"))
        out = media.join(hits, "_m_row", "left").withColumn("_hits", F.coalesce("_hits", F.array().cast("array<int>")))
        body = F.transform("_m_bodies", lambda b, i: F.when(~F.array_contains("_hits", i), b))
        return out.withColumn("_m_bodies", body).drop("_hits").select(*media.columns)

    def read(self) -> DataFrame:
        """_row (the other columns), _m_bytes, _m_head and _m_bodies with every chunk in its place."""
        lacks = F.exists("_m_bodies", lambda b: b.isNull())
        whole, part = self.media.where(~lacks), self.media.where(lacks)
        at = part.selectExpr("_m_row", _DIGESTS, "transform(_m_bodies, b -> b IS NULL) AS _gone")
        at = at.select("_m_row", F.posexplode(F.arrays_zip("_m_digests", "_gone")).alias("_pos", "_z"))
        at = at.where(F.col("_z._gone")).select("_m_row", "_pos", F.col("_z._m_digests").alias("digest"))
        found = join_hot(at, self.chunks, "digest").groupBy("_m_row").agg(F.map_from_entries(F.collect_list(F.struct("_pos", "body"))).alias("_found"))
        part = part.join(found, "_m_row", "left").withColumn("_m_bodies", F.transform("_m_bodies", lambda b, i: F.coalesce(b, F.col("_found")[i])))
        return whole.unionByName(part.drop("_found")).drop("_m_row")

    def payloads(self, payload_col: str = "payload", media_col: str = "media") -> DataFrame:
        """The other columns, n_bytes, payload_col (read back and verified), media_col (the stored form as read) and n_chunks."""
        added = {"n_bytes": "long", payload_col: "binary", media_col: "binary", "n_chunks": "integer"}
        rows = self.read()
        schema = T.StructType([rows.schema["_row"]])
        for i, kind in enumerate(added.values()):
            schema = schema.add(f"_{i}", kind)

        def run(batches):
            for part in (p for b in batches for p in slices(b, "_m_bytes", SLICE_CHARS)):
                heads, bodies = part.column("_m_head").to_pylist(), part.column("_m_bodies").to_pylist()
                payloads = [payload_from(h, b) for h, b in zip(heads, bodies, strict=True)]
                forms = [h + p for h, p in zip(heads, payloads, strict=True)]
                cols = [part.column("_m_bytes"), pa.array(payloads, pa.binary()), pa.array(forms, pa.binary()), pa.array([len(b) for b in bodies], pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column("_row"), *cols], schema.names)

        out = rows.mapInArrow(releasing(run), schema)
        low, fields = {c.lower() for c in added}, rows.schema["_row"].dataType.fields
        filler = [(f.name, f.dataType.simpleString()) for f in fields] == [("_none", "boolean")]  # there were no other columns
        others = [F.col("_row").getField(f.name).alias(f.name) for f in fields if f.name.lower() not in low and not filler]
        return out.select(*others, *[F.col(f"_{i}").alias(n) for i, n in enumerate(added)])


def feature(payload: bytes, n_chunks: int) -> str:
    """Figures of the samples: chunk count, mean, deviation, entropy of their histogram, mean step."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64)
    p = np.bincount(x.astype(np.int64), minlength=256) / len(x)
    p = p[p > 0]
    step = np.abs(np.diff(x)).mean()
    return f"chunks={n_chunks};mean={x.mean():.4f};std={x.std():.4f};entropy={-(p * np.log2(p)).sum() + 0.0:.4f};step={step:.4f}"


def with_feature(df: DataFrame, payload_col: str = "payload", feature_col: str = "feature") -> DataFrame:
    """df (of MediaStore.payloads) with feature_col."""
    plain = drop_columns(df, feature_col)

    def run(batches):
        for b in batches:
            got = [feature(p, n) for p, n in zip(b.column(payload_col).to_pylist(), b.column("n_chunks").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], [*b.schema.names, feature_col])

    return plain.mapInArrow(releasing(run), T.StructType([*plain.schema]).add(feature_col, "string"))
