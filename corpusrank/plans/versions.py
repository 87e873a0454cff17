"""Versions of a folder of tables: each is a small manifest, committed by a rename that fails if its number is taken.

Writers put new tables under new names and then commit a manifest that lists what belongs to the version. A reader takes
the manifest of the largest number, so it sees a whole version or none, also while the next one is being written.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class CommitConflict(Exception):
    """Another writer committed this version first."""


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, oldest first."""
    p, fs = _place(spark, f"{path}/_versions")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read(spark: SparkSession, path: str, number: int | None = None) -> dict | None:
    """The manifest of a version (by default the last), or None if there is none."""
    found = numbers(spark, path)
    if not found:
        return None
    return json.loads(spark.read.option("wholetext", True).text(f"{path}/_versions/{found[-1] if number is None else number:012d}.json").first().value)


def commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """Write manifest under its number (its "version"); raises CommitConflict if that exists."""
    aside, fs = _place(spark, f"{path}/_versions/.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    target, _ = _place(spark, f"{path}/_versions/{manifest['version']:012d}.json")
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE  # never over another file
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(target), options)
    except Exception as e:
        fs.delete(aside, False)
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            raise CommitConflict(f"version {manifest['version']} exists") from e
        raise


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The folders under path."""
    p, fs = _place(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
