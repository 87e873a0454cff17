"""Secret scans in Spark SQL functions only: fixed patterns, and a battery of randomness tests for the rest.

Patterns (kinds assign, access, hex) are matched leftmost and non-overlapping; matches that are too short are
dropped after matching, so they still consume their characters.

Kind random is sought outside what the patterns took (assign, then access, then hex in what is left): runs of
20 or more encoding characters, where = only ends a run, so NAME=value is two. A run is tested whole and, if it
holds separators, in three cuts: the parts of 20 or more characters between - and _, between + and /, and between
all four. Each span for which an encoding can be inferred (hex, base32, base36, base62, base64, and with - or _
also hex in groups, base38 of one case, url-safe base64) is tested against the hypothesis of independent uniform
draws from its alphabet: chi-squared uniformity of the letters, the number of runs above and below the middle,
and serial correlation. The least of the three p-values, times three, is the span's p-value. Benjamini-Hochberg
control within each band of lengths (powers of two), over the spans of all rows, decides which are rejected as
not random. Of a run that cut is reported whose remaining spans hold most characters (the first of equals).
The control's p-values are counted in bins, so it needs one small aggregate whatever the number of spans, and
rejects with the bin's upper edge (never more than exactly). It bounds the share of true random spans among the
rejected ones, so it bounds what is lost.

With false_rate a second control bounds what is falsely reported. Names (identifiers, paths, slugs) are a chain: steps
between kinds of characters (NAME_STEPS), and of letters the pairs that the different words of the table have, so the
table's own language counts. The likelihood of uniform draws from the inferred alphabet over that of a name is the span's
odds: its mean over names of the chain is at most one, so rejecting where the odds are at least n / (false_rate * k), for the largest k
such that k of the band's n spans have them, bounds the expected share of names among the reported spans, whatever
depends on what. Odds are rounded down to whole powers of e.

There is no shuffle of texts: the table is read once for the aggregate and once for the result. Work grows with
a run's length: letters are counted by string functions, and only the serial test visits letters, in pieces.

Defined cases: a null text counts as empty and has no spans; spans are code points, end exclusive; equal texts
have equal spans; all other columns stay, but for one named secrets, which is replaced; U+0001 to U+0003 count as
characters of no pattern.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop_columns, text_of, unused_names

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST = 20
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST},}}(?:=++(?![A-Za-z0-9+/_-]))?"
#: A run's cuts: none, and at these separators.
SEPARATORS = ("[_-]", "[+/]", "[+/_-]")
FALSE_DISCOVERY_RATE = 0.05
BINS_PER_DECADE, MAX_BIN = 20, 2000
#: Of a name's next character: chance of a small letter, a capital, a digit and a separator after each of these.
NAME_STEPS = ((0.84, 0.05, 0.04, 0.07), (0.45, 0.40, 0.05, 0.10), (0.15, 0.10, 0.60, 0.15), (0.57, 0.23, 0.15, 0.05))
#: Share of letters that follow no pairs of words (abbreviations, other languages).
NAME_UNKNOWN = 0.2
WORD_MOST = 64
SERIAL_PIECE = 4096
_OPEN, _CLOSE, _MID = "\x01", "\x02", "\x03"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEPARATORS = "-_+/"
_CODES = _LOWER + _UPPER + _DIGITS + _SEPARATORS


def _bind(f, **values: Column) -> Column:
    """f of a struct of the values, each computed once (a column used twice in an expression is computed twice)."""
    return F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), f)[0]


def _sums_of(lengths: Column) -> Column:
    """What stands before each entry of an array of ints; two levels, so that long arrays stay cheap."""

    def fold(xs: Column, first: Column) -> Column:
        run = F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(run, 1, F.size(xs))

    def of(v: Column) -> Column:
        totals = F.transform(v["groups"], lambda g: F.aggregate(g, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(v["groups"], fold(totals, F.lit(0)), fold))

    count = F.floor((F.size(lengths) - 1) / 256).cast("int")
    groups = F.transform(F.sequence(F.lit(0), count), lambda k: F.slice(lengths, k * 256 + 1, 256))
    return F.when(F.size(lengths) <= 256, fold(lengths, F.lit(0))).otherwise(_bind(of, groups=groups))


def _marked(text: Column, pattern: str, replacement: str = "$0") -> Column:
    """The text cut at the matches: entries of odd places are matches."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_OPEN}{replacement}{_CLOSE}")), f"[{_OPEN}{_CLOSE}]")


def _keep(value: Column, kind: int) -> Column:
    return F.length(value) - F.locate(_MID, value) >= ASSIGN_LEAST if kind == 0 else F.lit(True)


def _spans(parts: Column, kind: int) -> Column:
    """array<struct<start, kind, end, value>> of the matches in a cut text."""

    def of(s: Column) -> Column:
        full = F.zip_with(s["parts"], _sums_of(s["n"]), lambda v, at: F.struct(v.alias("v"), at.alias("at")))
        odd = F.filter(full, lambda x, i: (i % 2 == 1) & _keep(x["v"], kind))
        return F.transform(odd, lambda x: F.struct(
            x["at"].alias("start"), F.lit(kind).alias("kind"),
            (x["at"] + F.length(F.replace(x["v"], F.lit(_MID)))).alias("end"), F.replace(x["v"], F.lit(_MID)).alias("value"),
        ))

    n = F.transform(parts, lambda x: F.length(F.replace(x, F.lit(_MID))))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return F.when(F.size(parts) > 1, _bind(of, parts=parts, n=n)).otherwise(none)


def _covered(parts: Column, kind: int) -> Column:
    """The text again, with a blank for every character of a match that counts."""
    return F.array_join(F.transform(parts, lambda v, i: F.when((i % 2 == 1) & _keep(v, kind), F.call_function("repeat", F.lit(" "), F.length(F.replace(v, F.lit(_MID)))))
        .otherwise(F.replace(v, F.lit(_MID)))), "")


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution (rational approximation, error under 1e-7), z >= 0."""

    def of(v: Column) -> Column:
        t = v["t"]
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.least(F.lit(1.0), F.greatest(F.lit(1e-300), poly * F.exp(-v["z"] * v["z"] / 2) / 2.5066282746310002))

    return F.transform(F.transform(F.array(z), lambda x: F.struct(x.alias("z"), (1 / (1 + 0.2316419 * x)).alias("t"))), of)[0]


def _alphabet(token: Column) -> Column:
    """The alphabet of the inferred encoding, or null. All have an even number of letters."""
    digit, low, up = token.rlike("[0-9]"), token.rlike("[a-z]"), token.rlike("[A-Z]")
    return (
        F.when(token.rlike("^[0-9a-f]+$") & digit & low, _DIGITS + "abcdef")
        .when(token.rlike("^[0-9A-F]+$") & digit & up, _DIGITS + "ABCDEF")
        .when(token.rlike("^[A-Z2-7]+$") & digit & up, _UPPER + "234567")
        .when(token.rlike("^[0-9a-z]+$") & digit & low, _DIGITS + _LOWER)
        .when(token.rlike("^[0-9A-Z]+$") & digit & up, _DIGITS + _UPPER)
        .when(token.rlike("^[0-9A-Za-z]+$") & digit & low & up, _UPPER + _LOWER + _DIGITS)
        .when(token.rlike("^[0-9A-Za-z+/]+$") & digit & low & up, _UPPER + _LOWER + _DIGITS + "+/")
        .when(token.rlike("^[0-9A-Za-z_-]+$") & digit & low & up, _UPPER + _LOWER + _DIGITS + "-_")
        .when(token.rlike("^[0-9a-z_-]+$") & digit & low, _DIGITS + _LOWER + "-_")
        .when(token.rlike("^[0-9A-Z_-]+$") & digit & up, _DIGITS + _UPPER + "-_")
    )


def _p_value(token: Column, alphabet: Column) -> Column:
    """The battery's p-value of a token whose letters are all in the alphabet."""
    string = lambda name, *args: F.call_function(name, *args)

    def halves(v: Column) -> Column:
        """The token with L and H for letters of the lower and the upper half of the alphabet."""
        half = (F.length(v["alphabet"]) / 2).cast("int")
        return string("translate", v["token"], v["alphabet"], F.concat(string("repeat", F.lit("L"), half), string("repeat", F.lit("H"), half)))

    def times(text: Column, what: Column, size: int) -> Column:
        return (F.length(text) - F.length(F.replace(text, what, F.lit("")))).cast("double") / size

    def squares(v: Column) -> Column:
        counts = F.transform(F.split(v["alphabet"], ""), lambda c: times(v["token"], c, 1))
        return F.aggregate(counts, F.lit(0.0), lambda a, n: a + n * n)

    def cross(v: Column) -> Column:
        """The sum of products of neighbours' distances from the middle."""
        mid = (F.length(v["alphabet"]).cast("double") - 1) / 2
        first = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("last"))
        pieces = F.regexp_extract_all(v["token"], F.lit(f".{{1,{SERIAL_PIECE}}}"), F.lit(0))

        def add(acc: Column, piece: Column) -> Column:
            x = F.transform(F.split(piece, ""), lambda c: F.instr(v["alphabet"], c).cast("double") - 1 - mid)
            return F.aggregate(x, acc, lambda a, d: F.struct((a["sum"] + a["last"] * d).alias("sum"), d.alias("last")))

        return F.aggregate(pieces, first, add)["sum"]

    def scores(v: Column) -> Column:
        n, k, high = v["n"], v["k"], times(v["halves"], F.lit("H"), 1)
        chi, df = v["squares"] * k / n - n, k - 1
        z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        turns = times(v["halves"], F.lit("LH"), 2) + times(v["halves"], F.lit("HL"), 2) + 1
        z_serial = F.abs(v["cross"] / F.sqrt(n - 1) / ((k * k - 1) / 12))
        return _bind(last, n=n, chi=z_chi, both=2 * high * (n - high), turns=turns, serial=z_serial)

    def last(v: Column) -> Column:
        n, both = v["n"], v["both"]
        spread = F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9)))
        z_runs = F.when(both <= n, 9.0).otherwise(F.abs(v["turns"] - (both / n + 1)) / spread)
        p_chi = F.when(v["chi"] > 0, _tail(v["chi"])).otherwise(0.5)
        return F.least(F.lit(1.0), 3 * F.least(p_chi, 2 * _tail(z_runs), 2 * _tail(v["serial"])))

    def start(v: Column) -> Column:
        length = lambda c: F.length(c).cast("double")
        return _bind(scores, n=length(v["token"]), k=length(v["alphabet"]), halves=halves(v), squares=squares(v), cross=cross(v))

    return _bind(start, token=token, alphabet=alphabet)


def letter_pairs(df: DataFrame, text_col: str = "text") -> dict[str, int]:
    """How often the different words (of 2 to 19 letters, in at most WORD_MOST characters with what surrounds them) of all texts hold each pair of neighbours."""
    word = F.explode(F.split(ascii_lower(text_of(text_col)), r"[\x20\x09-\x0D]+"))
    bare = df.select(word.alias("w")).where(F.length("w") <= WORD_MOST).select(F.regexp_replace("w", "^[^a-z]+|[^a-z]+$", "").alias("w"))
    words = bare.where(F.col("w").rlike(f"^[a-z]{{2,{LEAST - 1}}}$")).distinct()
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("p"))
    return {r.p: r["count"] for r in pairs.groupBy("p").count().collect()}  # at most 676 rows


def name_costs(pairs: dict[str, int]) -> list[float]:
    """-log of the chance of each character of _CODES after each other in a name, row by row."""
    after = {a: sum(pairs.get(a + b, 0) for b in _LOWER) for a in _LOWER}
    kinds = (_LOWER, _UPPER, _DIGITS, _SEPARATORS)
    kind = {c: k for k, some in enumerate(kinds) for c in some}

    def chance(a: str, b: str) -> float:
        x, y = a.lower(), b.lower()
        if kind[a] < 2 and kind[b] < 2:
            within = (1 - NAME_UNKNOWN) * (pairs.get(x + y, 0) + 1) / (after[x] + 26) + NAME_UNKNOWN / 26
        else:
            within = 1 / len(kinds[kind[b]])
        return NAME_STEPS[kind[a]][kind[b]] * within

    return [-math.log(chance(a, b)) for a in _CODES for b in _CODES]


def _odds(token: Column, alphabet: Column, costs: Column) -> Column:
    """log of the likelihood of uniform draws over that of a name, given the first character, in whole numbers; capitals without small letters count as small."""

    def sum_of(v: Column) -> Column:
        pieces = F.regexp_extract_all(v["one"], F.lit(f".{{1,{SERIAL_PIECE}}}"), F.lit(0))
        first = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"))

        def step(acc: Column, code: Column) -> Column:
            cost = F.when(acc["last"] < 0, 0.0).otherwise(F.get(costs, acc["last"] * len(_CODES) + code))
            return F.struct((acc["sum"] + cost).alias("sum"), code.alias("last"))

        def add(acc: Column, piece: Column) -> Column:
            return F.aggregate(F.transform(F.split(piece, ""), lambda c: F.instr(F.lit(_CODES), c) - 1), acc, step)

        return F.aggregate(pieces, first, add)["sum"] - (F.length(v["one"]) - 1) * F.log(F.length(v["alphabet"]).cast("double"))

    one = F.when(token.rlike("[a-z]"), token).otherwise(F.lower(token))
    found = _bind(sum_of, one=one, alphabet=alphabet)
    return F.greatest(F.lit(-1), F.least(F.floor(found), F.lit(MAX_BIN))).cast("int")


def _tested(span: Column, costs: Column | None) -> Column:
    """An array of the span with band and bin of its p-value and its odds, or an empty one without an encoding."""

    def token(v: Column) -> Column:
        return F.when(v["bare"].rlike("^([0-9a-f]{20,}|[0-9A-F]{20,})$"), v["bare"]).otherwise(v["plain"])

    def of(v: Column) -> Column:
        p = _bind(lambda q: F.least(F.floor(-F.log10(q["p"]) * BINS_PER_DECADE), F.lit(MAX_BIN)).cast("int"), p=_p_value(v["token"], v["alphabet"]))
        return F.struct(
            span["start"].alias("start"), F.lit(3).alias("kind"), span["end"].alias("end"), span["value"].alias("value"),
            F.floor(F.log2(F.length(v["token"]).cast("double"))).cast("int").alias("band"), p.alias("bin"),
            (F.lit(0) if costs is None else _odds(v["token"], v["alphabet"], costs)).alias("odds"),
        )

    plain = F.regexp_replace(span["value"], "=+$", "")
    bare = F.translate(plain, "-_", "")  # groups of hex, as in UUIDs
    named = F.transform(F.transform(F.array(F.struct(plain.alias("plain"), bare.alias("bare"))), token), lambda t: F.struct(t.alias("token"), _alphabet(t).alias("alphabet")))
    return F.transform(F.filter(named, lambda v: v["alphabet"].isNotNull()), of)


def _pieces(run: Column, separators: str) -> Column:
    """The parts of a run between separators that are long enough."""

    def of(v: Column) -> Column:
        at = _sums_of(F.transform(v["parts"], lambda x: F.length(x) + 1))
        full = F.zip_with(v["parts"], at, lambda x, a: F.struct((a + run["start"]).alias("start"), F.lit(3).alias("kind"), (a + run["start"] + F.length(x)).alias("end"), x.alias("value")))
        return F.filter(full, lambda x: F.length(F.regexp_replace(x["value"], "=+$", "")) >= LEAST)

    return _bind(of, parts=F.split(run["value"], separators))


def _cuts(run: Column, costs: Column | None) -> Column:
    """array of a run's cuts: each an array of tested spans."""
    test = lambda spans: F.flatten(F.transform(spans, lambda x: _tested(x, costs)))
    cuts = F.flatten(F.array(F.array(F.array(run)), F.when(run["value"].rlike("[+/_-]"), F.array(*[_pieces(run, s) for s in SEPARATORS])).otherwise(F.array())))
    return F.transform(cuts, test)


def _found(df: DataFrame, text_col: str, base: str, runs: str, costs: Column | None = None) -> DataFrame:
    """df with the base spans and, for each run outside them, its cuts. Each step is a column of its own, so it is computed once."""
    text, a, b, c, left = unused_names(df, "text", "assign", "access", "hex", "left")
    df = df.withColumn(text, F.translate(text_of(text_col), _OPEN + _CLOSE + _MID, "�" * 3))
    df = df.withColumns({a: _marked(F.col(text), ASSIGN, f"$1{_MID}$2"), b: _marked(F.col(text), ACCESS), c: _marked(F.col(text), HEX)})
    took = (F.size(a) > 1) | (F.size(b) > 1) | (F.size(c) > 1)
    less = _covered(F.col(a), 0)
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        less = _covered(_marked(less, pattern), kind)
    df = df.withColumn(left, _marked(F.when(took, less).otherwise(F.col(text)), CANDIDATE))
    df = df.withColumn(base, F.sort_array(F.concat(_spans(F.col(a), 0), _spans(F.col(b), 1), _spans(F.col(c), 2))))
    none = F.array().cast("array<array<array<struct<start:int,kind:int,end:int,value:string,band:int,bin:int,odds:int>>>>")
    df = df.withColumn(runs, F.when(F.size(left) > 1, F.transform(_spans(F.col(left), 3), lambda run: _cuts(run, costs))).otherwise(none))
    return df.drop(text, a, b, c, left)


def _distinct(spans: Column) -> Column:
    """Each span once, by sorting (array_distinct compares all pairs)."""
    return _bind(lambda v: F.filter(v["s"], lambda x, i: (i == 0) | (x != F.get(v["s"], i - 1))), s=F.sort_array(spans))


def _counts(df: DataFrame, text_col: str, what: str, costs: Column | None = None) -> dict[int, dict[int, int]]:
    """How many spans of each band have each bin, or odds."""
    found = _found(df.select(F.col(text_col).alias("t")), "t", "base", "runs", costs)
    spans = found.select(F.explode(_distinct(F.flatten(F.flatten("runs")))).alias("r")).select("r.band", f"r.{what}")
    counts: dict[int, dict[int, int]] = {}
    for band, at, n in spans.groupBy("band", what).count().collect():  # at most 31 x (MAX_BIN + 2) rows
        counts.setdefault(band, {})[at] = n
    return counts


def least_odds(counts: dict[int, dict[int, int]], false_rate: float) -> dict[int, int]:
    """For each band the least odds from which spans are held for random; more than MAX_BIN if there are none."""
    out = {}
    for band, by_odds in counts.items():
        total, above, out[band] = sum(by_odds.values()), 0, MAX_BIN + 1
        for b in sorted(by_odds, reverse=True):
            above += by_odds[b]
            if b >= math.log(total / (false_rate * above)):
                out[band] = b
    return out


def rejection_bins(df: DataFrame, text_col: str = "text", rate: float = FALSE_DISCOVERY_RATE) -> dict[int, int]:
    """For each band of lengths the least bin from which spans are rejected as not random."""
    counts, out = _counts(df, text_col, "bin"), {}
    for band, by_bin in counts.items():
        total, above, out[band] = sum(by_bin.values()), 0, MAX_BIN + 1
        for b in sorted(by_bin, reverse=True):
            above += by_bin[b]
            if 10 ** (-b / BINS_PER_DECADE) <= rate * above / total:
                out[band] = b
    return out


def _best(cuts: Column, limit: Column, odds: Column | None) -> Column:
    """The cut whose spans that are not rejected hold most characters, and these spans."""

    def rated(stay: Column, place: Column) -> Column:
        held = F.aggregate(stay, F.lit(0), lambda a, s: a + s["end"] - s["start"])
        return F.struct(held.alias("held"), (-place).alias("place"), F.transform(stay, lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"])).alias("spans"))

    def stays_random(s: Column) -> Column:
        return s["bin"] < limit[s["band"]] if odds is None else (s["bin"] < limit[s["band"]]) & (s["odds"] >= odds[s["band"]])

    stays = F.transform(cuts, lambda cut: F.filter(cut, stays_random))
    return F.array_max(F.transform(stays, rated))["spans"]


def find_secrets(df: DataFrame, text_col: str = "text", rate: float = FALSE_DISCOVERY_RATE, false_rate: float | None = None) -> DataFrame:
    """df with secrets: array<struct<start int, kind int, end int, value string>>, sorted; kind counts in KINDS.

    rate bounds the share of random spans among those rejected, false_rate that of names among those reported (None: no bound).
    """
    limits = rejection_bins(df, text_col, rate)
    plain = drop_columns(df, "secrets")
    if text_col.lower() == "secrets":
        raise ValueError("the text column cannot be named secrets")
    by_band = lambda of: F.create_map(*[F.lit(x) for kv in (of or {-1: 0}).items() for x in kv])
    costs = odds = None
    if false_rate is not None and limits:  # without a tested span there is nothing to weigh
        costs = F.expr(f"array({', '.join(f'{c!r}D' for c in name_costs(letter_pairs(df, text_col)))})")
        odds = by_band(least_odds(_counts(df, text_col, "odds", costs), false_rate))
    base, runs = unused_names(plain, "base", "runs")
    found = _found(plain, text_col, base, runs, costs)
    limit = by_band(limits)
    added = F.flatten(F.transform(runs, lambda cuts: _best(cuts, limit, odds)))
    return found.withColumn("secrets", F.when(F.size(runs) > 0, F.sort_array(F.concat(base, added))).otherwise(F.col(base))).drop(base, runs)


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
