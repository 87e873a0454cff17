"""Secrets told from names: the share of names among what is reported is bounded, and the odds equal a loop."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from corpusrank.llm import secret_scan

#: Words of the texts, and words that names alone have.
KNOWN = """report summary table of contents user profile picture thumbnail account balance system network request response message handler
service client server window button image payment customer order product category language version update download upload
folder document chapter paragraph sentence number value return function method object class string buffer memory process
thread session cookie header footer page title author public private release candidate build test result error warning""".split()
UNSEEN = "kubernetes postgres qemu cfg tmp idx ctx impl http json xml utf srv gtk libx mgr quartz vortex whisky xylophone fjord bzip nginx ffmpeg".split()


def names(rng, n):
    """Identifiers, paths, slugs and file names of 20 characters or more, many with numbers in them."""
    def one():
        w = [rng.choice(KNOWN if rng.random() < 0.8 else UNSEEN) for _ in range(rng.randint(2, 6))]
        number = lambda: rng.choice([str(rng.randint(0, 9)), str(rng.randint(1990, 2030)), f"{rng.randint(10, 2000)}x{rng.randint(10, 2000)}", f"v{rng.randint(1, 20)}", f"{rng.randint(1, 12):02d}"])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w.insert(rng.randint(1, len(w)), number())
        return rng.choice([
            lambda: "_".join(w), lambda: "-".join(w), lambda: "_".join(w).upper(), lambda: "".join(x.capitalize() for x in w), lambda: w[0] + "".join(x.capitalize() for x in w[1:]),
            lambda: "/" + "/".join(w), lambda: f"CVE{rng.randint(1999, 2030)}" + "".join(x.capitalize() for x in w), lambda: "/".join(w[:2]) + "/" + "_".join(w[2:]),
            lambda: "".join(w), lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}-" + "-".join(w),
        ])()
    out = set()
    while len(out) < n:
        x = one()
        if len(x) >= secret_scan.LEAST:
            out.add(x)
    return sorted(out)


def secrets(rng, n):
    low, hexa = "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    draw = lambda letters, k: "".join(rng.choices(letters, k=k))
    forms = [lambda: draw(b64[:62], rng.randint(24, 60)), lambda: "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: draw(low, 36), lambda: draw(b64, 44), lambda: draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32)]
    return [forms[i % len(forms)]() for i in range(n)]


def table(spark, rng, named, planted):
    texts = [" ".join(rng.choices(KNOWN, k=30)) for _ in range(50)]
    rows = [("text", t) for t in texts] + [("name", f"see {x} there") for x in named] + [("secret", f"see {x} there") for x in planted]
    return spark.createDataFrame(rows, "kind string, text string")


def shares(df, **how):
    got = secret_scan.find_secrets(df, **how).collect()
    count = lambda kind: (sum(r.kind == kind and bool(r.secrets) for r in got), sum(r.kind == kind for r in got))
    assert all(s.value == r.text[s.start : s.end] for r in got for s in r.secrets)
    return count("name"), count("secret"), count("text")


def test_names_are_a_bounded_share(spark):
    rng = random.Random(12)
    df = table(spark, rng, names(rng, 3000), secrets(rng, 300)).repartition(4).cache()
    before, (found, planted), _ = shares(df)
    (false, total), (still, _), (texts, _) = shares(df, false_rate=0.05)
    assert texts == 0 and total == 3000
    assert false <= 0.05 * (false + still) and before[0] > 100
    assert still >= 0.95 * planted and still <= found


def test_only_names(spark):
    rng = random.Random(13)
    (false, total), _, _ = shares(table(spark, rng, names(rng, 1500), []).repartition(4), false_rate=0.05)
    assert false <= 0.002 * total


def test_odds_equal_a_loop(spark):
    rng = random.Random(14)
    words = [" ".join(rng.choices(KNOWN, k=20)) + ' ("quoted"), ' + "x" * 70 + " a1b2 " for _ in range(40)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in words], "text string")
    seen = {w for t in words if t for w in [*t.split()[:20], "quoted"] if 2 <= len(w) <= 19}
    pairs = Counter(a + b for w in seen for a, b in zip(w, w[1:], strict=False))
    got = secret_scan.letter_pairs(df)
    assert got == dict(pairs)
    costs = secret_scan.name_costs(got)
    codes = secret_scan._CODES
    for a in codes:  # a chain: chances after each character sum to one
        assert abs(sum(math.exp(-costs[codes.index(a) * len(codes) + codes.index(b)]) for b in codes) - 1) < 1e-9

    def odds(token, k):
        one = token if any(map(str.islower, token)) else token.lower()
        total = sum(costs[codes.index(a) * len(codes) + codes.index(b)] for a, b in zip(one, one[1:], strict=False))
        return max(-1, min(secret_scan.MAX_BIN, math.floor(total - (len(one) - 1) * math.log(k))))

    tokens = [x.replace("=", "") for x in names(rng, 60) + secrets(rng, 60)] + ["aB3" * 4000]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secret_scan._alphabet(F.col("t")).alias("a")).where("a is not null")
    array = F.expr(f"array({', '.join(f'{c!r}D' for c in costs)})")
    compared = rows.withColumn("o", secret_scan._odds(F.col("t"), F.col("a"), array)).collect()
    assert len(compared) > 60
    assert [r.o for r in compared] == [odds(r.t, len(r.a)) for r in compared]


def test_least_odds():
    counts = {4: {30: 5, 2: 10, -1: 985}, 5: {-1: 7}, 6: {3: 1}}
    # 1000 / (0.05 * 5) = e^8.3: odds of 30 pass; 1000 / (0.05 * 15) = e^7.2: odds of 2 do not; one span of odds e^3 passes 1 / 0.05 = e^2.996
    assert secret_scan.least_odds(counts, 0.05) == {4: 30, 5: secret_scan.MAX_BIN + 1, 6: 3}
