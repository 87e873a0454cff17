"""Chunking: recursive splitting into pieces of bounded size, parent windows, positions and chapters of chunks.

Chunks partition the cleaned text without loss, so a chunk's position is the length of those before it.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as P

from ..functions import text as T
from ..functions.profiles import ZH, Profile
from ..plans.scratch import materialize
from .filters import is_low_quality_of
from .lines import chapters
from .refine import pack

SIZES = {"small": (600, 100), "large": (1200, 200)}
PARENT, LEAST_CHUNK, HELD = 2000, 30, 8_000_000


def split_text(text: str, size: int, separators: tuple[str, ...]) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that the text has; an oversize piece is cut on its own at finer ones."""
    level = next((i for i, s in enumerate(separators) if not s or s in text), len(separators))
    mark = separators[level] if level < len(separators) else ""
    if not mark:
        return [text[i : i + size] for i in range(0, len(text), size)]
    out, room = [], 0
    for piece in _keeping(text, mark):
        if len(piece) > size:
            out += split_text(piece, size, separators[level + 1 :])
            room = 0
        elif piece and len(piece) <= room:
            out[-1] += piece
            room -= len(piece)
        elif piece:
            out.append(piece)
            room = size - len(piece)
    return out


def _keeping(text: str, mark: str) -> list[str]:
    *parts, last = text.split(mark)
    return [p + mark for p in parts] + [last]


def by_separator(c: Column, mark: str) -> Column:
    """c cut after every mark, nothing lost, empties dropped."""
    return F.filter(F.split(c, f"(?<=\\Q{mark}\\E)" if mark else ""), lambda p: p != "")


def packed_sentences(c: Column, size: int, profile: Profile = ZH) -> Column:
    """One level of splitting in the JVM: sentences packed to at most `size` characters (a longer sentence stands alone)."""
    return pack(F.filter(F.split(c, f"(?<={profile.sentence})"), lambda p: p != ""), size)


def fixed_windows(df: DataFrame, size: int, step: int, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, window_no, content): windows of `size` characters every `step`; none for an empty text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    last = F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / step).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return df.where(F.length(text) > 0).select(key, F.posexplode(cuts).alias("window_no", "content"))


def parents(df: DataFrame, overlap: int, text_col: str = "text", key: str = "doc_id", size: int = PARENT) -> DataFrame:
    """(key, parent_idx, parent_content): overlapping windows that chunks point to."""
    return fixed_windows(df, size, max(size - overlap, 1), text_col, key).toDF(key, "parent_idx", "parent_content")


def chunks(df: DataFrame, size: int, profile: Profile = ZH, text_col: str = "text", key: str = "doc_id", cleaned: bool = False) -> DataFrame:
    """(key, chunk_index, position, content) of every chunk of the cleaned text, short and poor ones included. cleaned: it is clean already."""
    rows = df.select(F.col(key), (F.col(text_col) if cleaned else T.clean_text(F.col(text_col))).alias("_t"))
    separators = profile.separators

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                cut = [split_text(t, size, separators) for t in part.column("_t").to_pylist()]
                index = pa.array([j for j, c in enumerate(cut) for _ in c], pa.int64())
                starts = [0] * len(index)
                k = 0
                for c in cut:
                    at = 0
                    for x in c:
                        starts[k] = at
                        at += len(x)
                        k += 1
                cols = [part.column(key).take(index), pa.array([j for c in cut for j in range(len(c))], pa.int32()), pa.array(starts, pa.int64()), pa.array([x for c in cut for x in c], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [key, "chunk_index", "position", "content"])

    schema = P.StructType([rows.schema[key]]).add("chunk_index", "integer").add("position", "long").add("content", "string")
    return rows.mapInArrow(run, schema)


def positions(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """chunks with position from the lengths of those before (for chunks that come without one)."""
    order = Window.partitionBy(key).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("position", F.coalesce(F.sum(F.length("content")).over(order), F.lit(0)).cast("long"))


def with_chapter(df: DataFrame, heads: DataFrame, key: str = "doc_id") -> DataFrame:
    """df with chapter: the title of the last heading at or before its position ('' before the first). An as-of join by window."""
    mark = heads.select(key, F.col("start").alias("position"), F.lit(0).alias("_is_row"), F.col("title").alias("_title"))
    rows = df.withColumns({"_is_row": F.lit(1), "_title": F.lit(None).cast("string")})
    both = rows.unionByName(mark, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("position", "_is_row").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("chapter", F.coalesce(F.last("_title", ignorenulls=True).over(order), F.lit("")))
    return found.where("_is_row = 1").drop("_is_row", "_title")


def chunks_with_parents(df: DataFrame, granularity: str = "small", profile: Profile = ZH, text_col: str = "text", key: str = "doc_id", source_col: str = "source") -> DataFrame:
    """chunk_id, key, source_doc, granularity, chunk_index, position, chapter, content and parent_content of the chunks worth keeping."""
    clean = df.select(key, F.col(source_col).cast("string").alias("source_doc"), T.clean_text(F.col(text_col)).alias("_t"))
    return _cut(clean, chapters(clean, profile, "_t", key), (granularity,), profile, key)


def _cut(clean: DataFrame, heads: DataFrame, granularities: tuple[str, ...], profile: Profile, key: str) -> DataFrame:
    """The chunks of cleaned texts (key, source_doc, _t) with chapters heads: a text is cut, and its chunks get chapter and parent, where it is read."""
    marks = heads.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "title"))).alias("_h"))
    rows = clean.select(key, "source_doc", "_t").join(marks, key, "left").select(key, "source_doc", "_t", F.col("_h.start").alias("_starts"), F.col("_h.title").alias("_titles"))
    made = P.StructType([rows.schema[key]]).add("source_doc", "string").add("granularity", "string").add("chunk_index", "integer").add("position", "long")
    made = made.add("chapter", "string").add("content", "string").add("parent_content", "string").add("_n", "integer").add("_distinct", "integer")

    def run(batches):
        for b in batches:
            out, held = [], 0
            for i, (source, text, starts, titles) in enumerate(zip(*(b.column(c).to_pylist() for c in ("source_doc", "_t", "_starts", "_titles")), strict=True)):
                for g in granularities:
                    for x in _placed(text, g, profile.separators, starts or [], titles or []):
                        out.append((i, source, g, *x))
                        held += len(x[3]) + len(x[4])
                if held > HELD:
                    yield batch(b.column(key), out)
                    out, held = [], 0
            if out:
                yield batch(b.column(key), out)

    def batch(keys: pa.Array, out: list[tuple]) -> pa.RecordBatch:
        at, *cols = zip(*out, strict=True)
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], made.names)

    cut = rows.mapInArrow(run, made)
    # white space is of no script and no digit, so the content counts as its stripped text
    cut = cut.where(~is_low_quality_of(F.col("content"), F.col("_n"), F.col("_distinct"), profile))
    name = F.concat_ws("_", F.col("source_doc"), F.col(key).cast("string"), F.col("granularity"), F.lit("chunk"), F.col("chunk_index").cast("string"))
    return cut.select(name.alias("chunk_id"), key, "source_doc", "granularity", "chunk_index", "position", "chapter", "content", "parent_content")


def _placed(text: str, granularity: str, separators: tuple[str, ...], starts: list[int], titles: list[str]):
    """(chunk_index, position, chapter, content, parent_content, characters and different characters of the stripped content) of the chunks that are long enough."""
    size, overlap = SIZES[granularity]
    step = max(PARENT - overlap, 1)
    last, position = (max(len(text), 1) - 1) // step, 0
    for index, content in enumerate(split_text(text, size, separators)):
        body = content.strip(T.WHITE_SPACE)
        if len(body) >= LEAST_CHUNK:
            head = bisect_right(starts, position)
            first = step * min((position + max(len(content) // 2, 1)) // step, last)
            yield index, position, titles[head - 1] if head else "", content, text[first : first + PARENT], len(body), len(set(body))
        position += len(content)


def both_granularities(df: DataFrame, profile: Profile = ZH, text_col: str = "text", key: str = "doc_id", source_col: str = "source") -> DataFrame:
    """chunks_with_parents of both sizes; texts are cleaned and headings found once, in as many tasks as a shuffle has."""
    clean = df.select(key, F.col(source_col).cast("string").alias("source_doc"), F.col(text_col).alias("_t")).repartition(key)
    clean = materialize(clean.withColumn("_t", T.clean_text(F.col("_t"))), "clean")
    heads = materialize(chapters(clean, profile, "_t", key), "heads")
    return _cut(clean, heads, tuple(SIZES), profile, key)
