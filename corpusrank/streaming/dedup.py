"""Near-duplicate clean-up of documents that arrive as a stream, by the greedy rule of the batch path.

A document stays if it is similar to none that stayed before it: those of earlier micro-batches, and those of its own with
a smaller key. What stayed is a folder of tables in versions: the documents, and their sets of n-grams, which later
arrivals are compared with. A micro-batch is committed with its number by one manifest, so one that runs again after a
failure adds nothing twice, and readers see whole micro-batches. If keys grow from micro-batch to micro-batch, the result
equals `operators.dedup.content_dedup` of all documents, however they are split.

Arrivals are broadcast in portions of at most BATCH_GRAMS n-grams and met by the kept sets in one pass a portion, without
a shuffle of either. With a horizon, kept sets of micro-batches that ended more than so long before the first arrival are
no longer read; documents within the horizon of each other are always compared.

Defined cases: documents without n-grams (null, empty or shorter texts) stay; rows of one micro-batch with one key are
one document; a micro-batch with a null time never expires, and one whose times are all null is compared with everything.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import dedup
from ..plans import versions
from ..plans.scratch import materialize, scratch_scope


def kept(spark: SparkSession, folder: str, what: str = "documents", since: float | None = None) -> DataFrame | None:
    """What stayed so far, or None before the first commit. since: leave out what ended before (seconds)."""
    parts = (versions.read(spark, folder) or {"parts": []})["parts"]
    paths = [f"{folder}/{what}/{p['name']}" for p in parts if since is None or p["last"] is None or p["last"] >= since]
    return spark.read.schema(spark.read.parquet(paths[0]).schema).parquet(*paths) if paths else None


def drop_similar(
    docs: DataFrame, folder: str, checkpoint: str, threshold: float = dedup.THRESHOLD, text_col: str = "text", key: str = "doc_id",
    head: int | None = None, time_col: str | None = None, horizon: float | None = None,
) -> StreamingQuery:
    """Keep of the stream docs what is similar to nothing that stayed, once for all that has arrived. horizon: seconds of time_col."""
    if (horizon is None) != (time_col is None):
        raise ValueError("a horizon needs a time column, and a time column a horizon")

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = versions.read(spark, folder)
        if last and last["batches"].get(checkpoint, -1) >= number:
            return  # was committed before a failure
        with scratch_scope(spark):
            _add(batch, number)

    def _add(batch: DataFrame, number: int) -> None:
        spark, since, end = batch.sparkSession, None, None
        if time_col is not None:
            seconds = F.col(time_col).cast("timestamp").cast("double")
            first, latest, nulls = batch.agg(F.min(seconds), F.max(seconds), F.count_if(seconds.isNull())).first()
            since, end = None if first is None else first - horizon, None if nulls else latest
        own, members = dedup.gram_sets(batch, text_col, key, head=head)
        if threshold < dedup.CONTAINED_AS:
            before = kept(spark, folder, "sets", since)
            fresh = own if before is None else materialize(_unlike(own, before, threshold), "stream-fresh")
            stay = materialize(dedup.kept_sets(fresh, threshold), "stream-kept")
            gone = members.join(stay, "id", "left_anti").select(F.col("id").alias(key))
            sets, rows = own.join(stay, "id", "left_semi"), batch.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in batch.columns])
        else:  # no similarity is over it
            sets, rows = own, batch
        name = uuid.uuid4().hex
        sets.write.parquet(f"{folder}/sets/{name}")
        rows.write.parquet(f"{folder}/documents/{name}")
        _commit(spark, number, {"name": name, "last": end})

    def _commit(spark: SparkSession, number: int, part: dict) -> None:
        last = versions.read(spark, folder) or {"version": 0, "batches": {}, "parts": []}
        # one stream writes a folder: another one's commit in between raises, and this micro-batch runs again against what that kept
        versions.commit(spark, folder, {"version": last["version"] + 1, "batches": last["batches"] | {checkpoint: number}, "parts": [*last["parts"], part]})

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _unlike(own: DataFrame, before: DataFrame, threshold: float) -> DataFrame:
    """The sets of own that are similar to none of before."""
    spark, kind = own.sparkSession, dict(own.dtypes)["id"]
    left, found = own, None
    while True:
        head = left.orderBy("id").limit(dedup.BATCH_ROWS).select("id", "n").toPandas()
        if not len(head):
            return own if found is None else own.join(found, "id", "left_anti")
        some = max(1, int((head["n"].cumsum() <= dedup.BATCH_GRAMS).sum()))
        last = head["id"].iloc[some - 1]
        last = last.item() if hasattr(last, "item") else last
        portion = left.where(F.col("id") <= F.lit(last)).orderBy("id").toPandas()  # BATCH_ROWS rows of BATCH_GRAMS grams at most
        asked = spark.sparkContext.broadcast([np.frombuffer(g, np.int64) for g in portion["grams"]])

        def run(batches, asked=asked):
            open_ = list(range(len(asked.value)))
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    known = dedup._sets(b.slice(at, 512).column("grams"))
                    like = dedup._similar_to_any([asked.value[i] for i in open_], known, threshold) if open_ else np.zeros(0, bool)
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, x in zip(open_, like, strict=True) if x], pa.int32())], ["place"])
                    open_ = [i for i, x in zip(open_, like, strict=True) if not x]

        places = [r.place for r in before.select("grams").mapInArrow(run, "place int").distinct().collect()]  # BATCH_ROWS at most
        if places:
            like = spark.createDataFrame([(i,) for i in portion["id"].iloc[places].tolist()], f"id {kind}")
            found = like if found is None else found.unionByName(like)
        left = left.where(F.col("id") > F.lit(last))
