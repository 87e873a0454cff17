"""Query understanding: types, comparison entities and ordered variants of a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.profiles import ZH, Profile
from .lexical import tokenizer

EXPAND, MMR = 4, {"comparison": 0.30, "definition": 0.60, None: 0.45}


def _has_any(q: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | q.contains(w)
    return out


def query_type(q: Column, profile: Profile = ZH) -> Column:
    """The first type of which the query has a word, or null."""
    out = F.lit(None).cast("string")
    for name, words in reversed(profile.question_types.items()):
        out = F.when(_has_any(q, words), name).otherwise(out)
    return out


def is_comparison(q: Column, profile: Profile = ZH) -> Column:
    """Independent of query_type: a query may be of another type and still compare."""
    return _has_any(q, profile.question_types["comparison"])


def comparison_entities(q: Column, profile: Profile = ZH) -> Column:
    """array<string>: the first two parts of two characters or more around the words that compare."""
    body = T.strip(F.regexp_replace(q, profile.comparison_tail, ""))
    parts = F.transform(F.split(body, profile.comparison_split), lambda p: T.strip(F.regexp_replace(T.strip(p), profile.question_lead, "")))
    return F.slice(F.filter(parts, lambda p: F.length(p) >= 2), 1, 2)


def mmr_lambda(q: Column, profile: Profile = ZH) -> Column:
    definition = _has_any(q, profile.question_types["definition"])
    return F.when(is_comparison(q, profile), MMR["comparison"]).when(definition, MMR["definition"]).otherwise(MMR[None])


def understand(queries: DataFrame, profile: Profile = ZH, query_col: str = "query") -> DataFrame:
    """queries with query_type, is_comparison, entities and mmr_lambda."""
    q = F.col(query_col)
    return queries.withColumns(
        {"query_type": query_type(q, profile), "is_comparison": is_comparison(q, profile), "entities": comparison_entities(q, profile), "mmr_lambda": mmr_lambda(q, profile)}
    )


def _expansions(q: Column, profile: Profile) -> Column:
    """array<struct<syn, word>>: up to three synonyms of each word of the table that the query has, first use of each."""
    pairs = [(w, s) for w, syns in profile.synonyms.items() for s in syns[:3]]
    if not pairs:
        return F.array().cast("array<struct<syn:string,word:string>>")
    table = F.array(*[F.struct(F.lit(s).alias("syn"), F.lit(w).alias("word")) for w, s in pairs])
    hits = F.filter(table, lambda p: q.contains(p["word"]) & ~q.contains(p["syn"]))
    return F.filter(hits, lambda p, i: F.array_position(F.transform(hits, lambda h: h["syn"]), p["syn"]) == i + 1)


def variants(queries: DataFrame, profile: Profile = ZH, query_cols: tuple[str, ...] = ("query_id",), query_col: str = "query", names: DataFrame | None = None, tokens=None) -> DataFrame:
    """(query_cols, variant_no from 0, text): the query, its keywords, synonym forms, a shortened form, a domain form,
    names of documents (table names: doc_name) that share tokens with it, and a form for its type; distinct, at most
    EXPAND + 2, then the parts that a comparison compares, at most EXPAND + 4."""
    q = F.col(query_col)
    cut = tokens or tokenizer(profile, 2)
    rows = queries.select(*query_cols, q.alias("_q"), cut(q).alias("_k"), _expansions(q, profile).alias("_e"))
    q, k, e = F.col("_q"), F.col("_k"), F.col("_e")
    none = F.array().cast("array<string>")
    if_ = lambda cond, *xs: F.when(cond, F.array(*xs)).otherwise(none)
    syns = F.transform(e, lambda x: x["syn"])
    table = F.create_map(*[x for w, s in profile.synonyms.items() for x in (F.lit(w), F.array(*map(F.lit, s[:2])))]) if profile.synonyms else None
    pairs = none
    if table is not None:
        of = lambda w: F.coalesce(F.try_element_at(table, w), none)
        pairs = F.flatten(F.transform(F.slice(k, 1, 3), lambda w: F.transform(F.filter(of(w), lambda s: ~q.contains(s)), lambda s: F.concat_ws(" ", w, s))))
    found = none
    if names is not None:
        shared = rows.select(*query_cols, F.size("_k").alias("_nk"), F.explode(F.array_distinct("_k")).alias("t")).join(
            names.select("doc_name", F.explode(F.array_distinct(cut(F.col("doc_name")))).alias("t")).distinct(), "t"
        )
        hits = shared.groupBy(*query_cols, "doc_name").agg(F.count("*").alias("c"), F.max("_nk").alias("_nk"))
        hits = hits.where((F.col("c") >= 2) | (F.col("_nk") <= 3))
        best = Window.partitionBy(*query_cols).orderBy(F.desc("c"), "doc_name")
        hits = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= EXPAND + 2)  # no more can be used
        named = hits.groupBy(*query_cols).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "doc_name"))), lambda x: x["doc_name"]).alias("_n"))
        rows = rows.join(named, list(query_cols), "left")
        found = F.coalesce("_n", none)
    kind = query_type(q, profile)
    suffix = F.lit(None).cast("string")
    for name, words in profile.type_suffix.items():
        suffix = F.when(kind == name, words).otherwise(suffix)
    every = F.concat(
        F.array(q),
        if_(F.size(k) >= 2, F.array_join(k, " ")),
        if_(F.size(e) > 0, F.concat_ws(" ", q, F.array_join(F.slice(syns, 1, 4), " "))),
        F.transform(F.slice(e, 1, 3), lambda x: F.replace(q, x["word"], x["syn"])),
        if_(F.size(k) >= 3, F.array_join(F.slice(k, F.lit(1), F.floor(F.size(k) / 2).cast("int") + 1), " ")),
        pairs,
        if_(~_has_any(q, profile.domain_words), F.concat_ws(" ", q, F.lit(profile.domain_suffix))),
        found,
        F.when(suffix.isNotNull(), F.array(F.concat_ws(" ", q, suffix))).otherwise(none),
    )
    first = F.slice(F.array_distinct(every), 1, EXPAND + 2)
    entities = F.when(is_comparison(q, profile), comparison_entities(q, profile)).otherwise(none)
    return rows.select(*query_cols, F.posexplode(F.slice(F.array_distinct(F.concat(first, entities)), 1, EXPAND + 4)).alias("variant_no", "text"))
