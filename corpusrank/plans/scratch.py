"""Tables in the folder that driver and executors share, to cut lineage and to compute once."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session that names none gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("corpusrank.scratch", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="corpusrank-")
    spark.conf.set("corpusrank.scratch", own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: The tables of the scopes that are open in this thread (or task), innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("corpusrank_scopes", default=())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, computes once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if scopes := _OPEN.get():
        scopes[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes the tables that are materialized inside when it ends, but for those given to the function it yields (what still reads them must be among these)."""
    made: list[str] = []
    kept: list[str] = []
    around = _OPEN.get()
    token = _OPEN.set((*around, made))

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._scratch_path)
        return df

    try:
        yield keep
    finally:
        _OPEN.reset(token)
        for path in made:
            if path not in kept:
                discard(spark, path)
        if around:  # the scope around may delete them
            around[-1].extend(kept)
