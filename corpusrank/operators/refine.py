"""Budgeted extraction: a long document is condensed chapter by chapter to its best-scoring paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.profiles import ZH, Profile
from ..plans.scratch import materialize

MAX_CHARS = 30_000
LONG_PARAGRAPH, PACKED, LEAST_PARAGRAPH = 1500, 800, 10
SECTION_WINDOW = 5000


def pack(pieces: Column, size: int) -> Column:
    """Adjacent pieces joined while the result has at most `size` characters; a longer piece stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(a: Column, p: Column) -> Column:
        fits = F.length(a["cur"]) + F.length(p) <= size
        full = F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"])))
        return F.struct(F.when(fits, a["done"]).otherwise(full).alias("done"), F.when(fits, F.concat(a["cur"], p)).otherwise(p).alias("cur"))

    return F.aggregate(pieces, start, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))


def paragraphs(c: Column, profile: Profile = ZH) -> Column:
    """array<string>: blocks between blank lines of ten characters or more; long ones re-packed by sentence."""
    blocks = F.filter(F.transform(F.split(c, profile.paragraph), T.strip), lambda p: F.length(p) >= LEAST_PARAGRAPH)

    def cut(p: Column) -> Column:
        sentences = F.filter(F.split(p, f"(?<={profile.sentence})"), lambda s: s != "")
        return F.when(F.length(p) > LONG_PARAGRAPH, F.transform(pack(sentences, PACKED), T.strip)).otherwise(F.array(p))

    return F.flatten(F.transform(blocks, cut))


def paragraph_score(p: Column, after_heading: Column, profile: Profile = ZH) -> Column:
    add = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    n = F.length(p)
    score = (
        F.lit(0.3) + add(after_heading, 0.30) + add(p.rlike(T.quick(profile.definition)), 0.35) + add(p.rlike(T.quick(profile.framework)), 0.25)
        + add(p.rlike(T.quick(profile.conclusion)), 0.20) + F.least(F.lit(0.20), T.term_density(p, profile.terms) * 0.05)
        + add(T.is_heading(p, profile), 0.15) - add(p.rlike(T.quick(profile.lead_in)), 0.15) - add(n < 30, 0.10)
        - add((n > 0) & (F.regexp_count(p, F.lit(r"\d")) / F.greatest(n, F.lit(1)) > 0.3), 0.15)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def score_paragraphs(df: DataFrame, profile: Profile = ZH, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, para_no, n_chars, score) of every paragraph."""
    ps = df.select(key, paragraphs(F.coalesce(F.col(text_col), F.lit("")), profile).alias("_p"))
    heads = F.transform("_p", lambda p: T.is_heading(p, profile))
    rows = ps.withColumn("_h", heads).select(key, F.posexplode(F.arrays_zip("_p", F.concat(F.array(F.lit(False)), F.slice("_h", 1, F.size("_h"))).alias("_b"))).alias("para_no", "z"))
    rows = rows.where(F.col("z._p").isNotNull())
    return rows.select(key, "para_no", F.length("z._p").alias("n_chars"), F.round(paragraph_score(F.col("z._p"), F.col("z._b"), profile), 6).alias("score"))


def _with(value: Column, f) -> Column:
    """f(value), where value is computed once: a transform over one entry binds it."""
    return F.transform(F.array(value), f)[0]


def _parts_at(text: Column, pattern: str) -> Column:
    """array of (part_no, title, content) between heading lines; a heading without lines of its own is lost."""

    def is_head(line: Column) -> Column:
        return _with(T.strip_value(line), lambda s: (F.length(s) < 80) & s.rlike(T.quick(pattern)))

    def cut(x: Column) -> Column:
        """x: the lines, and the places from 1 of the headings with 0 before and the end after them."""
        ends = lambda k: F.get(x["h"], k + 1)
        parts = F.transform(
            F.filter(F.sequence(F.lit(0), F.size(x["h"]) - 2), lambda k: ends(k) - F.get(x["h"], k) > 1),
            lambda k: F.struct(
                k.cast("long").alias("part_no"), F.when(k > 0, T.strip(F.get(x["l"], F.get(x["h"], k) - 1))).otherwise("").alias("title"),
                F.array_join(F.slice(x["l"], F.get(x["h"], k) + 1, ends(k) - F.get(x["h"], k) - 1), "\n").alias("content"),
            ),
        )
        return parts

    def heads(l: Column) -> Column:
        flags = F.transform(l, lambda x, i: F.when(is_head(x), i + 1).otherwise(0))
        found = F.filter(flags, lambda i: i > 0)
        return F.struct(l.alias("l"), F.concat(F.array(F.lit(0)), found, F.array(F.size(l) + 1)).alias("h"))

    return _with(_with(F.split(text, "\n"), heads), cut)


def split_chapters(df: DataFrame, profile: Profile = ZH, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, part_no, title, content): chapters; without any heading, sections; without those, windows of 5000 characters.

    A document is cut where it is read; nothing is shuffled.
    """
    step = SECTION_WINDOW

    def windows(t: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor(F.greatest(F.length(t) - 1, F.lit(0)) / step).cast("int"))
        cuts = F.transform(places, lambda i: F.struct(i.cast("long").alias("part_no"), F.lit("").alias("title"), F.substring(t, i * step + 1, F.lit(step)).alias("content")))
        return F.filter(cuts, lambda c: c["content"] != "")

    def of_plain(t: Column) -> Column:
        return _with(_parts_at(t, profile.section), lambda s: F.when(F.size(s) > 0, s).otherwise(windows(t)))

    plain = lambda p: (F.size(p) == 1) & (F.get(p, 0)["title"] == "")
    parts = _with(_parts_at(F.coalesce(F.col(text_col), F.lit("")), profile.chapter), lambda p: F.when(plain(p), of_plain(F.get(p, 0)["content"])).otherwise(p))
    rows = df.select(key, F.explode(parts).alias("_p"))
    return rows.select(key, "_p.part_no", "_p.title", "_p.content")


def refine_part(content: Column, budget: Column, profile: Profile = ZH) -> Column:
    """A chapter's first fifth and last tenth of paragraphs, and of the others the best that still fit, in their order.

    Each step is bound before the next, so that it is computed once for a chapter and not once for each paragraph.
    """

    def scored(x: Column) -> Column:
        n = F.size(x["p"])
        score = lambda p, i: -paragraph_score(p, F.when(i > 0, F.get(x["h"], i - 1)).otherwise(False), profile)
        return F.struct(
            x["p"].alias("p"), F.greatest(F.lit(1), F.floor(n * 0.2).cast("int")).alias("head"), (n - F.greatest(F.lit(1), F.floor(n * 0.1).cast("int"))).alias("tail"),
            F.transform(x["p"], lambda p, i: F.struct(score(p, i).alias("s"), i.alias("i"), (F.length(p) + 1).alias("n"))).alias("z"),
        )

    def chosen(x: Column) -> Column:
        forced = lambda z: (z["i"] < x["head"]) | (z["i"] >= x["tail"])
        used = F.aggregate(F.filter(x["z"], forced), F.lit(0), lambda a, z: a + z["n"])
        middle = F.sort_array(F.filter(x["z"], lambda z: ~forced(z)))
        start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("i"))
        pick = lambda room: F.aggregate(
            middle, start,
            lambda a, z: F.when(a["n"] + z["n"] <= room, F.struct((a["n"] + z["n"]).alias("n"), F.concat(a["i"], F.array(z["i"])).alias("i"))).otherwise(a),
        )["i"]
        picked = _with(F.greatest(F.lit(0), budget - used), pick)
        return F.struct(x["p"].alias("p"), F.concat(picked, F.transform(F.filter(x["z"], forced), lambda z: z["i"])).alias("i"))

    def joined(x: Column) -> Column:
        return F.array_join(F.filter(x["p"], lambda p, i: F.array_contains(x["i"], i)), "\n\n")

    def condensed(p: Column) -> Column:
        heads = F.transform(p, lambda q: T.is_heading(q, profile))
        return F.when(F.size(p) == 0, F.left(content, budget)).otherwise(_with(_with(_with(F.struct(p.alias("p"), heads.alias("h")), scored), chosen), joined))

    return F.when(F.length(content) <= budget, content).otherwise(_with(paragraphs(content, profile), condensed))


def refine(df: DataFrame, profile: Profile = ZH, most: int = MAX_CHARS, text_col: str = "text", key: str = "doc_id", out_col: str = "refined") -> DataFrame:
    """(key, out_col): texts over `most` characters condensed to about that; others as they are."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    long = df.where(F.length(text) > most).select(key, text.alias("_t"))
    parts = split_chapters(long, profile, "_t", key).withColumn("_n", F.length("content"))
    parts = materialize(parts.withColumn("_total", F.sum("_n").over(Window.partitionBy(key))), "refine-parts")  # read by both passes

    def condensed(rows: DataFrame, least: int, ratio: Column) -> DataFrame:
        budget = F.greatest(F.lit(least), F.floor(F.lit(most) * F.col("_n") / F.col("_total") * ratio).cast("int"))
        body = refine_part(F.col("content"), budget, profile)
        one = F.when(F.col("title") == "", body).otherwise(F.concat_ws("\n", "title", body))
        return rows.groupBy(key).agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part_no", one.alias("x")))), lambda x: x["x"]), "\n\n").alias("_r"), F.max("_total").alias("_total")
        )

    once = materialize(condensed(parts, 500, F.lit(1.0)), "refined-once")
    over = once.where((F.length("_r") > most * 1.1) & (F.col("_total") > most)).select(key, (F.lit(most) / F.length("_r")).alias("_ratio"))
    twice = condensed(parts.join(over, key), 300, F.col("_ratio")).select(key, F.col("_r").alias("_r2"))
    out = df.select(key, text.alias("_t")).join(once, key, "left").join(twice, key, "left")
    refined = F.when(F.length("_t") <= most, F.col("_t")).when(F.col("_total") <= most, F.col("_t"))
    return out.select(key, refined.otherwise(F.coalesce("_r2", "_r", F.left("_t", F.lit(most)))).alias(out_col))
