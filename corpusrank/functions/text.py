"""Column functions on text: normalisation, counts and cues. All run in the JVM."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .profiles import Profile

_PUNCTUATION = r"""[，。！？；：、（）《》“”‘’【】…—·,.!?;:()"'\[\]<>{}\-]"""


#: What (?U)\s matches.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def strip_value(c: Column) -> Column:
    """strip of a column or variable (no expression: it is read three times); only what has white space at an end is searched for it."""
    return F.when(F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1))).rlike(r"(?U)\s"), strip(c)).otherwise(c)


def _alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between its outermost bars."""
    out, depth, in_class, i, first = [], 0, 0, 0, 0
    while i < len(pattern):
        x = pattern[i]
        if x == "\\":
            i += 1
        elif x == "[":
            in_class += 1
        elif x == "]":
            in_class -= 1
        elif not in_class and x in "()":
            depth += 1 if x == "(" else -1
        elif x == "|" and not depth and not in_class:
            out.append(pattern[first:i])
            first = i + 1
        i += 1
    return [*out, pattern[first:]]


@lru_cache(maxsize=256)
def quick(pattern: str) -> str:
    """A pattern that is found in the same texts, for `rlike`.

    Alternatives that begin with ^ are tried at the start only, those that begin with a known character only where one of these stands.
    """
    flags = re.match(r"(\(\?[a-z]+\))?", pattern)[0]
    parts = _alternatives(pattern[len(flags) :])
    if len(parts) < 3 or any(re.search(r"\(\?[a-zA-Z]+\)", p) for p in parts):
        return pattern
    anchored, known, other, firsts = [], [], [], {}
    for p in parts:
        m = re.fullmatch(r"\(\?:(.*)\)(?:\(\?!.*\))?", p, re.S)
        body = m[1] if m and _closes_last(p) else ""
        if body and len(_alternatives(body)) == 1 and body[0] == "^":
            anchored.append(p)
        elif body and len(_alternatives(body)) == 1 and (m := re.match(r"(\w|\\\[)(?![?*{])", body)):
            known.append(p)
            firsts[m[1]] = 0
        else:
            other.append(p)
    out = [f"^(?:{'|'.join(anchored)})"] if anchored else []
    out += [f"(?=[{''.join(firsts)}])(?:{'|'.join(known)})"] if known else []
    return flags + "|".join([*out, *other])


def _closes_last(p: str) -> bool:
    """Whether the group that opens p is closed at its end, or before a last lookahead."""
    depth, in_class, i = 0, 0, 0
    while i < len(p):
        x = p[i]
        if x == "\\":
            i += 1
        elif x == "[":
            in_class += 1
        elif x == "]":
            in_class -= 1
        elif not in_class and x in "()":
            depth += 1 if x == "(" else -1
            if not depth:
                return p[i + 1 :] == "" or p[i + 1 :].startswith("(?!")
        i += 1
    return False


def to_simplified(c: Column, singles: dict[str, str], phrases: dict[str, str] | None = None) -> Column:
    """Left-to-right longest match over a table of phrases and single characters; what is replaced is not looked at again."""
    words = singles | (phrases or {})
    if not words:
        return c
    if all(len(w) == 1 and len(v) == 1 for w, v in words.items()):
        return F.translate(c, "".join(words), "".join(words.values()))
    quoted = lambda w: "\\Q" + w + "\\E"
    firsts = "".join(f"\\x{{{ord(w[0]):x}}}" for w in {w[0]: w for w in words}.values())
    pattern = "|".join([*(quoted(w) for w in sorted(words, key=len, reverse=True)), f"[^{firsts}]+", "(?s:.)"])
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    # a transform over one entry binds the table, so that it is made once
    cut = F.struct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("p"), table.alias("m"))
    return F.transform(F.array(cut), lambda s: F.array_join(F.transform(s["p"], lambda w: F.coalesce(F.try_element_at(s["m"], w), w)), ""))[0]


def clean_text(c: Column) -> Column:
    c = F.translate(F.coalesce(c, F.lit("")), "\r\t", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), " {2,}", " ")
    return strip(c)


def normalize_text(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), _PUNCTUATION, ""), r"(?U)\s+", " "))


def characters_of(c: Column, pattern: str) -> Column:
    """How many characters of c match the class. Runs of them are found, not each one."""
    return F.length(c) - F.length(F.regexp_replace(c, f"(?:{pattern})+", ""))


def share(c: Column, pattern: str) -> Column:
    """Characters of c that match the class, as a share of all (0 for an empty text)."""
    return characters_of(c, pattern) / F.greatest(F.length(c), F.lit(1))


def distinct_characters(c: Column) -> Column:
    return F.size(F.array_distinct(F.split(c, "")))


def terms_in(c: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms occur in c."""
    hits = [F.contains(c, F.lit(t)).cast("int") for t in terms]
    out = F.lit(0)
    for h in hits:
        out = out + h
    return out


def term_density(c: Column, terms: tuple[str, ...]) -> Column:
    """Distinct terms for each hundred characters (at least one hundred)."""
    return terms_in(c, terms) / F.greatest(F.length(c) / 100.0, F.lit(1.0))


def is_heading(c: Column, profile: Profile) -> Column:
    s = strip(c)
    return (F.length(s) <= 60) & s.rlike(quick(f"{profile.chapter}|{profile.section}"))


def is_noise_line(c: Column, profile: Profile) -> Column:
    hit = c.rlike(quick(profile.noise))
    return hit | F.rtrim(c).isin(*profile.headers) if profile.headers else hit


def tokens(c: Column, stop_words: tuple[str, ...] = (), least: int = 1) -> Column:
    """Lower-case runs of letters and digits, in order and with repeats."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    keep = lambda w: (F.length(w) >= least) & (~w.isin(*stop_words) if stop_words else F.lit(True))
    return F.filter(words, keep)


def han_tokens(c: Column, stop_words: tuple[str, ...] = (), least: int = 1, dictionary: tuple[str, ...] = ()) -> Column:
    """Adjacent pairs of Han characters and lower-case runs of other letters and digits, in order. Words of the dictionary are kept whole."""
    words = [w.lower() for w in sorted(dictionary, key=len, reverse=True)]
    whole = "|".join(f"\\Q{w}\\E" for w in words)
    other = r"[\p{L}\p{N}&&[^\p{IsHan}]]"
    pattern = f"{whole}|(?:(?!{whole})\\p{{IsHan}})+|(?:(?!{whole}){other})+" if words else f"\\p{{IsHan}}+|{other}+"
    runs = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0))
    paired = lambda r: r.rlike(r"^\p{IsHan}{2,}$") & (~r.isin(*words) if words else F.lit(True))
    pairs = lambda r: F.when(paired(r), F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array(r))
    keep = lambda w: (F.length(w) >= least) & (~w.isin(*stop_words) if stop_words else F.lit(True))
    return F.filter(F.flatten(F.transform(runs, pairs)), keep)


def char_ngrams(c: Column, n: int = 3, head: int | None = None) -> Column:
    """Distinct character n-grams (none if the text is shorter), of the first `head` characters or the whole text."""
    c = F.coalesce(c, F.lit(""))
    c = F.left(c, F.lit(head)) if head else c

    def grams(x: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(x) - (n - 1), F.lit(1)))
        made = F.transform(at, lambda i: F.array_join(F.slice(x, i, n), ""))
        return F.when(F.size(x) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))

    # a transform over one entry binds the characters, so that they are split once
    return F.transform(F.array(F.filter(F.split(c, ""), lambda x: x != "")), grams)[0]


def truncate_at_boundary(c: Column, most: Column | int, marks: tuple[str, ...] = ("\n", "。", "；", "！", "？")) -> Column:
    """The first `most` characters, cut after the last mark if that lies beyond 60 % of them."""
    most = F.lit(most) if isinstance(most, int) else most
    head = F.left(c, most)
    back = F.reverse(head)
    last = F.greatest(*[F.when(F.locate(m, back) > 0, F.length(head) - F.locate(m, back)).otherwise(-1) for m in marks])
    return F.when(F.length(c) <= most, c).when(last > most * 0.6, F.left(c, last + 1)).otherwise(head)
