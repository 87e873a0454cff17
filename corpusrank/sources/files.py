"""Readers and writers: files of a knowledge base, qa pairs, vector tables, results and evaluations.

Paths go to Spark's readers and writers as they are, so any store that Spark reaches works. Parsers of binary
formats are functions bytes -> text, run in tasks next to the file's bytes; a file that fails to parse keeps
its error and is left out of the documents.
"""

from __future__ import annotations

import io
import json
import re
import time
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.profiles import ZH, Profile
from ..operators import dedup, filters, lines, refine

MAX_BYTES = 500 << 20
SCANNED_IMAGES = 50
#: Least characters that a parse must give: of a Word file, and of a scanned one.
LEAST_TEXT, LEAST_SCANNED = 100, 500
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

Parser = Callable[[bytes], str]


def parse_text(data: bytes) -> str:
    return data.decode("utf-8")


def check_zip(data: bytes, most: int = MAX_BYTES) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    if sum(i.file_size for i in z.infolist()) > most:
        raise ValueError("the archive unpacks to too many bytes")
    return z


def is_scanned(data: bytes) -> bool:
    """More than SCANNED_IMAGES embedded images."""
    return sum(n.startswith("word/media/image") for n in check_zip(data).namelist()) > SCANNED_IMAGES


def parse_docx(data: bytes) -> str:
    """Paragraphs of a Word file separated by blank lines; tables one row a line with cells between bars."""
    body = ElementTree.fromstring(check_zip(data).read("word/document.xml")).find(f"{_WORD}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t"))
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{_WORD}tbl":
            out += [" | ".join(words(c).strip() for c in r.iter(f"{_WORD}tc")) for r in e.iter(f"{_WORD}tr")]
        elif e.tag == f"{_WORD}p":
            out.append(words(e))
    return "\n\n".join(t for t in out if t.strip())


def _no_parser(data: bytes) -> str:
    raise ValueError("no parser for this format is given")


#: Extension -> parser. A parser for .pdf (and one for scanned .docx, under ".docx:scanned") is a plug-in.
PARSERS: dict[str, Parser] = {".md": parse_text, ".txt": parse_text, ".docx": parse_docx, ".pdf": _no_parser, ".docx:scanned": _no_parser}


def check_path(path: str, root: str | None = None, spark: SparkSession | None = None) -> str:
    """The path, if it is not empty, never goes up and, with root, lies in it; with spark it must also exist."""
    if not path or ".." in re.split(r"[/\\]", path):
        raise ValueError(f"not a usable path: {path!r}")
    if root is not None and not f"{path.rstrip('/')}/".startswith(f"{root.rstrip('/')}/"):
        raise ValueError(f"{path!r} is not in {root!r}")
    if spark is not None and not exists(spark, path):
        raise FileNotFoundError(path)
    return path


def parse_word(data: bytes, table: dict[str, Parser]) -> str:
    """A Word file by the parser for scanned ones if it is one and that gives enough, else by the plain one if that gives enough, else an error."""
    errors = []
    scanned = table[".docx:scanned"] is not _no_parser and is_scanned(data)
    for kind, least in ((".docx:scanned", LEAST_SCANNED),) * scanned + ((".docx", LEAST_TEXT),):
        try:
            text = table[kind](data)
            if len(text.strip()) > least:
                return text
            errors.append(f"{kind}: {len(text.strip())} characters")
        except Exception as e:
            errors.append(f"{kind}: {type(e).__name__}: {e}")
    raise ValueError("; ".join(errors))


def list_files(spark: SparkSession, folder: str, most: int = MAX_BYTES) -> DataFrame:
    """(path, filename, length, content) of the files of known formats that are not too long."""
    files = spark.read.format("binaryFile").load(check_path(folder))
    files = files.withColumn("filename", F.regexp_replace(F.url_decode(F.element_at(F.split("path", "/"), -1)), "^.*/", ""))
    return files.where(lines.extension(F.col("filename")).isin(*lines.PRIORITY) & (F.col("length") <= most))


def parse_files(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """files with text and error instead of content."""
    table = PARSERS | (parsers or {})

    @F.pandas_udf("text string, error string")
    def parsed(names: pd.Series, data: pd.Series) -> pd.DataFrame:
        out = []
        for name, raw in zip(names, data, strict=True):
            try:
                ext = "." + name.rsplit(".", 1)[-1].lower()
                out.append((parse_word(bytes(raw), table) if ext == ".docx" else table[ext](bytes(raw)), None))
            except Exception as e:
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["text", "error"], dtype=object)

    rows = files.withColumn("_p", parsed("filename", "content"))
    return rows.select(*[c for c in files.columns if c != "content"], "_p.text", "_p.error")


def load_documents(spark: SparkSession, folder: str, profile: Profile = ZH, parsers: dict[str, Parser] | None = None, least: int = filters.LEAST_DOCUMENT,
                   simplify: Callable[[Column], Column] | None = None, refined: bool = True, max_chars: int = refine.MAX_CHARS, head: int | None = 2000) -> DataFrame:
    """(doc_id, doc_name, text): one file for each name by format, parsed, cleaned, long enough, not like an earlier one, condensed.

    head: compare only so many first characters with earlier documents (None: whole texts)."""
    picked = lines.pick_variants(list_files(spark, folder), name=lines.clean_doc_name(F.col("filename"), simplify or (lambda c: c)))
    good = parse_files(picked, parsers).where("error is null").select(F.xxhash64("filename").alias("doc_id"), "filename", "doc_name", "text")
    clean = lines.preprocess(good, profile, simplify=simplify, out_col="clean").join(good.drop("text"), "doc_id")
    clean = filters.long_enough(clean, "clean", least)
    unlike = dedup.content_dedup(clean.withColumn("_order", F.struct("filename", "doc_id")), text_col="clean", key="filename", head=head).drop("_order")
    if not refined:
        return unlike.select("doc_id", "doc_name", F.col("clean").alias("text"))
    short = refine.refine(unlike, profile, max_chars, "clean")
    return short.join(unlike.select("doc_id", "doc_name"), "doc_id").select("doc_id", "doc_name", F.col("refined").alias("text"))


# -- tables and JSON -----------------------------------------------------------------------------------------

QA_SCHEMA = "qa_id string, question string, answer string, qa_type string, source_doc string, chunk_id string, gold_source string, generated_by string, generated_at string"
CHUNK = "array<struct<rank: int, chunk_id: string, source_doc: string, chapter: string, content: string, rrf_score: double, match_type: string, cross_encoder_score: double>>"
RESULTS_SCHEMA = (
    f"query_id string, query string, query_type string, difficulty string, retrieved_chunks {CHUNK}, source_docs array<string>, merged_context string, retrieval_time_ms double, "
    "qa_hits array<struct<rank: int, question: string, answer: string, source_doc: string, qa_type: string, score: double>>"
)
EVALUATION_SCHEMA = (
    "query_id string, query string, query_type string, difficulty string, context_relevance_score int, is_sufficient boolean, "
    "chunk_evaluations array<struct<rank: int, chunk_id: string, is_relevant: boolean, relevance_score: int, reason: string>>"
)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(check_path(path))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_json(spark: SparkSession, path: str, schema: str, missing_ok: bool = True, whole: bool = False) -> DataFrame:
    """A JSON array or JSON lines (whole: one document a file); a missing path gives no rows (or an error)."""
    if not exists(spark, check_path(path)):
        if missing_ok:
            return spark.createDataFrame([], schema)
        raise FileNotFoundError(path)
    return spark.read.schema(schema).json(path, multiLine=whole or path.endswith(".json"))


def load_qa_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, QA_SCHEMA)


def save_qa_pairs(pairs: DataFrame, path: str, generated_by: str = "corpusrank") -> None:
    """Pairs as JSON lines, with a gold source and where and when they were made."""
    gold = F.coalesce("gold_source", "source_doc") if "gold_source" in pairs.columns else F.col("source_doc")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pairs.withColumns({"gold_source": gold, "generated_by": F.lit(generated_by), "generated_at": now}).write.mode("overwrite").json(check_path(path))


def envelope_results(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a results file {..., "results": [...]}."""
    rows = read_json(spark, path, f"results array<struct<{_fields(RESULTS_SCHEMA)}>>", missing_ok=False, whole=True)
    return rows.select(F.inline("results"))


def envelope_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an evaluation file {..., "evaluations": [...]}, with chunks for the metrics; none if the file is missing."""
    rows = read_json(spark, path, f"evaluations array<struct<{_fields(EVALUATION_SCHEMA)}>>", whole=True)
    return rows.select(F.inline("evaluations")).withColumnRenamed("chunk_evaluations", "chunks")


def _fields(schema: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema))


def pick(results: DataFrame, query_type: str | None = None, difficulty: str | None = None, query_id: str | None = None) -> DataFrame:
    """Results (or evaluations) of a type, of a difficulty, of an id."""
    for name, value in (("query_type", query_type), ("difficulty", difficulty), ("query_id", query_id)):
        if value is not None:
            results = results.where(F.col(name) == value)
    return results


def save_results(results: DataFrame, path: str) -> None:
    """Nested rows as JSON lines, one for each query."""
    results.write.mode("overwrite").json(check_path(path))


def results_of(found: DataFrame, queries: DataFrame, answers: DataFrame, hits: DataFrame | None = None, elapsed_ms: float | None = None) -> DataFrame:
    """The rows of a results file: found (of engine.search), queries (query_id, query, query_type, difficulty), answers (of engine.answer), hits (of engine.qa_hits)."""
    item = F.struct(
        "rank", "chunk_id", "source_doc", "chapter", "content", F.round("rrf", 6).alias("rrf_score"), "match_type", F.round("score", 4).alias("cross_encoder_score")
    )
    chunks = found.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("retrieved_chunks"))
    rows = queries.select("query_id", "query", "query_type", "difficulty").join(chunks, "query_id", "left").join(answers, "query_id", "left")
    if hits is not None:
        one = F.struct("rank", "question", "answer", "source_doc", "qa_type", "score")
        rows = rows.join(hits.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("qa_hits")), "query_id", "left")
    rows = rows.withColumn("retrieval_time_ms", F.lit(elapsed_ms).cast("double"))
    return rows.withColumn("retrieved_chunks", F.coalesce("retrieved_chunks", F.array().cast(dict(chunks.dtypes)["retrieved_chunks"])))


def save_envelope(rows: DataFrame, path: str, field: str, **head) -> None:
    """One JSON document {head..., field: [rows]} in the folder path. A single file is written by a single task, row after row."""
    start = json.dumps(head, ensure_ascii=False)[:-1] + (", " if head else "") + json.dumps(field) + ": ["
    body = rows.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).withColumn("_n", F.monotonically_increasing_id())
    body = body.select(F.concat(F.when(F.col("_n") == 0, "").otherwise(","), "value").alias("value"), "_n", F.lit(1).alias("_part"))
    ends = rows.sparkSession.createDataFrame([(start, 0, 0), ("]}", 0, 2)], "value string, _n long, _part int")
    whole = ends.unionByName(body).coalesce(1).sortWithinPartitions("_part", "_n").select("value")
    whole.write.mode("overwrite").text(check_path(path))


def save_results_envelope(rows: DataFrame, path: str, top_k: int = 15, config: dict | None = None, version: str = "1.0") -> None:
    """The results file that envelope_results reads."""
    total = rows.count()
    save_envelope(rows, path, "results", version=version, method="ragas_style", created=time.strftime("%Y-%m-%d"), total_queries=total, top_k=top_k, system_config=config or {})


def save_evaluations_envelope(evaluations: DataFrame, path: str, evaluator: str = "corpusrank") -> None:
    """The evaluation file that envelope_evaluations reads. evaluations: of engine.evaluate."""
    item = lambda c: F.struct(c["rank"].alias("rank"), c["chunk_id"].alias("chunk_id"), c["is_relevant"].alias("is_relevant"), c["relevance_score"].alias("relevance_score"))
    rows = evaluations.select("query_id", "query", "query_type", "difficulty", "context_relevance_score", "is_sufficient", F.transform("chunks", item).alias("chunk_evaluations"))
    save_envelope(rows, path, "evaluations", method="ragas_style", evaluator=evaluator, total_evaluated=evaluations.count())


def save_report(report: DataFrame, path: str) -> None:
    """A report (of operators.metrics.report) as one JSON document."""
    report.coalesce(1).write.mode("overwrite").json(check_path(path))


def save_vectors(vectors: DataFrame, path: str, append: bool = False) -> None:
    """Vectors with their chunks, by granularity; append adds them to those that are stored."""
    vectors.write.mode("append" if append else "overwrite").partitionBy("granularity").parquet(check_path(path))


def count_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(granularity, n) of stored vectors."""
    return load_vectors(spark, path).groupBy("granularity").agg(F.count("*").alias("n"))


def load_vectors(spark: SparkSession, path: str, granularity: str | None = None) -> DataFrame:
    if not exists(spark, check_path(path)):
        raise FileNotFoundError(path)
    rows = spark.read.parquet(path)
    return rows.where(F.col("granularity") == granularity) if granularity else rows
