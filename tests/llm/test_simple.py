"""op3, op4, op6, op7 and op8 against brute force on the smallest tables and on odd rows."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pandas as pd
import pytest

from corpusrank.llm import exact_dedup, mixing, piece_codec, queries, secret_scan, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "", "en", "a", 0), (2, None, "en", None, 0), (3, " a  b ", None, "a", 6), (4, "x" * 20000 + " y", "en", "b", 1),
    (5, "x" * 20000 + " y", "en", "b", 1), (5, "x" * 20000 + " y", "en", "b", 1), (6, "x" * 20000 + " z", "en", "b", 1),
    (None, "one two", "en", "c", 7), (None, "one two", "en", "c", 7), (7, "a▁b\tc\nd é漢字😀 ", "en", "c", 9),
    (8, "\x01\x02token = \"abcd1234efgh\"\x03 password:short API_KEY=0123456789abcdef0123456789abcdef", "en", None, 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_url_lookup_equals_scan_of_rules():
    rng = random.Random(1)
    labels, segments = ["a", "b", "org"], ["", "x", "xy", "1"]
    rules = [
        url_filter.Rule(rng.choice(["allow", "block"]), ".".join(rng.choices(labels, k=rng.randint(1, 3))), "/" + "/".join(rng.choices(segments, k=rng.randint(0, 3))))
        for _ in range(60)
    ]
    trie = url_filter.build_trie(rules)
    for _ in range(3000):
        host = ".".join(rng.choices(labels, k=rng.randint(1, 4)))
        path = "/".join(["", *rng.choices(segments, k=rng.randint(0, 4))])
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: (r.host.count("."), len(r.path), r.verdict), default=None)
        assert url_filter.lookup(trie, host, path) == (best and (best.host + best.path, best.verdict))


def test_urls_odd(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/x"), (4, "HTTP://EX.ORG?x://y"), (5, "a://b://c/d#e"), (6, "x://m.example.org/es/"), (6, "x://m.example.org/es/"), (7, "x://org")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'mine' as rule")
    got = sorted(tuple(r) for r in url_filter.judge_urls(df, queries.URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "ex.org", "", None, "allow"), (5, "b:", "//c/d", None, "allow"),
        (6, "m.example.org", "/es/", "example.org/es/", "block"), (6, "m.example.org", "/es/", "example.org/es/", "block"), (7, "org", "", None, "allow"),
    ]
    assert url_filter.judge_urls(df.limit(0), queries.URL_RULES).count() == 0


@pytest.mark.parametrize("as_table", [False, True])
def test_urls_beyond_the_trie(spark, monkeypatch, as_table):
    rng = random.Random(2)
    labels, segments = ["a", "b", "org", ""], ["", "x", "xy", "1"]
    host, path = (lambda n: ".".join(rng.choices(labels, k=rng.randint(1, n)))), (lambda n: "/".join(["", *rng.choices(segments, k=rng.randint(0, n))]))
    rules = [url_filter.Rule(rng.choice(["allow", "block"]), host(3), path(3)) for _ in range(80)]
    rules += [url_filter.Rule("block", "b", "x"), url_filter.Rule("block", "b/x", ""), url_filter.Rule("block", "b/x", "/x"), url_filter.Rule("block", "org", "/x")]
    urls = [(i, f"s://{host(4)}{path(4)}{rng.choice(['', '?q', '#f'])}", "mine", "mine") for i in range(600)]
    urls += [(i, "s://a.org/x/y", "hot", "hot") for i in range(1500)] + [(1, None, None, None), (1, "none", None, None)]
    df = spark.createDataFrame(urls, "page_id long, url string, address string, _key string")
    rows = lambda of: sorted(map(repr, of.collect()))
    given = spark.createDataFrame(rules, url_filter.RULE) if as_table else rules
    want = rows(url_filter.judge_urls(df, given, default="block"))
    monkeypatch.setattr(url_filter, "MAX_RULES", 3)
    got = url_filter.judge_urls(df, given, default="block")
    assert rows(got) == want and len(want) == len(urls)
    assert rows(url_filter.judge_urls(df.limit(0), given)) == []
    monkeypatch.setattr(url_filter, "MAX_RULES", -1)
    assert {r.verdict for r in url_filter.judge_urls(df, spark.createDataFrame([], url_filter.RULE)).collect()} == {"allow"}
    with pytest.raises(Exception, match="unknown verdict"):
        url_filter.judge_urls(df, [url_filter.Rule("maybe", "a", "/")]).collect()


def _codec(df, model):
    coded = piece_codec.decode(piece_codec.encode(df.select("doc_id", "text"), model), model)
    return coded.collect()


def test_codec_is_the_library(spark, docs, odd):
    import sentencepiece

    model = queries.piece_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = _codec(docs.unionByName(odd), model)
    assert len(rows) == docs.count() + len(ODD)
    for r in rows:
        ids = sp.encode(r.text or "", add_eos=True)
        assert r.ids == ids
        assert r.decoded == sp.decode(ids)
    assert _codec(odd.limit(0), model) == []
    both = piece_codec.round_trip(docs.unionByName(odd), model).collect()
    key = lambda r: (str(r.doc_id), r.text or "", r.ids, r.decoded)
    assert sorted(map(key, both)) == sorted(map(key, rows))


def test_words_join_to_the_text():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    table, rng = piece_codec.WordTable(sp), random.Random(2)
    texts = ["".join(rng.choices(" ▁ab\n\t.é漢", k=rng.randint(0, 30))) for _ in range(3000)]
    assert table.encode(texts).to_pylist() == [sp.encode(t, add_eos=True) for t in texts]


_ASSIGN = re.compile(
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets_base(spark, docs, odd):
    rng = random.Random(3)
    parts = ["token", "=", ":", " ", "'", "AKIA", "ABCD1234", "0123456789abcdef" * 2, "é😀", "secret", "pAssword", "xyz", ".", "\n", "api_key"]
    made = [(i, "".join(rng.choices(parts, k=rng.randint(0, 40)))) for i in range(700)] + [(1000, "token=abcdefgh1 " * 2000)]
    df = spark.createDataFrame(made, "doc_id long, text string").unionByName(docs.unionByName(odd).select("doc_id", "text"))
    n = 0
    for r in secret_scan.find_secrets(df).collect():
        got = [(s.start, s.kind, s.end) for s in r.secrets if s.kind < 3]
        assert got == base_spans(r.text or ""), r.text
        assert all(s.value == (r.text or "")[s.start : s.end] for s in r.secrets if "\x01" not in (r.text or ""))
        n += len(got)
    assert n > 3000
    assert secret_scan.find_secrets(df.limit(0)).count() == 0


def test_random_runs_are_told_from_ordinary_ones(spark):
    rng, rows = random.Random(4), []
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for i in range(300):
        rows.append((i, "see " + "".join(rng.choices(alphabet, k=40)) + " end"))
        rows.append((1000 + i, "see " + ("Aa1" * 20)[: 40 + i % 9] + " end"))
    found = {r.doc_id: r.secrets for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(bool(found[i]) for i in range(300)) >= 280
    assert not any(found[1000 + i] for i in range(300))


def test_random_runs_in_names_values_and_groups(spark):
    rng, rows = random.Random(6), []
    low, hexa = "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    draw = lambda letters, n: "".join(rng.choices(letters, k=n))
    forms = {
        "name=value": lambda: ("AWS_KEY=", draw(b64, 40), ""), "long_name=value": lambda: ("AWS_DEFAULT_REGION_SIGNATURE=", draw(b64, 42), "=="),
        "uuid": lambda: ("", "-".join(draw(hexa, n) for n in (8, 4, 4, 4, 12)), ""), "prefix_key": lambda: ("ghp_", draw(low, 36), ""),
        "name-base64": lambda: ("data-key-", draw(b64, 44), ""), "groups": lambda: ("xoxb-111111111111-222222222222-", draw(low, 40), ""),
    }
    for f, make in forms.items():
        rows += [(f"{f} {i}", *make()) for i in range(50)]
        rows += [(f"plain {f} {i}", "see-", "aa1-" * (8 + i % 5), "") for i in range(5)]
    df = spark.createDataFrame([(k, f"see {a}{b}{c} end", 4 + len(a), 4 + len(a + b)) for k, a, b, c in rows], "k string, text string, a int, b int")
    got = secret_scan.find_secrets(df).collect()
    for f in forms:
        whole = [any(s.start <= r.a and r.b <= s.end for s in r.secrets) for r in got if r.k.startswith(f + " ")]
        assert len(whole) == 50 and sum(whole) >= 40, (f, sum(whole))
    assert not any(r.secrets for r in got if r.k.startswith("plain"))
    assert all(x.end <= y.start for r in got for x, y in zip(r.secrets, r.secrets[1:]))
    assert all(s.value == r.text[s.start : s.end] for r in got for s in r.secrets)


def random_spans(text, base):
    """Runs outside the base spans, each as a list of cuts of (start, end, token, alphabet)."""
    took = list(text)
    for kind, pattern in enumerate((_ASSIGN, re.compile("AKIA[A-Z0-9]{12,}"), re.compile("[0-9a-f]{32,}"))):
        for m in pattern.finditer("".join(took)):
            if kind or len(m[1]) >= 8:
                took[m.start() : m.end()] = "\x02" * (m.end() - m.start())
    digits, low, up = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    encodings = [
        (digits + "abcdef", "dl"), (digits + "ABCDEF", "du"), (up + "234567", "du"), (digits + low, "dl"), (digits + up, "du"), (up + low + digits, "dlu"),
        (up + low + digits + "+/", "dlu"), (up + low + digits + "-_", "dlu"), (digits + low + "-_", "dl"), (digits + up + "-_", "du"),
    ]

    def tested(start, value):
        token = value.rstrip("=")
        bare = token.replace("-", "").replace("_", "")
        if re.fullmatch("[0-9a-f]{20,}|[0-9A-F]{20,}", bare):
            token = bare
        has = {k for k, letters in (("d", digits), ("l", low), ("u", up)) if set(token) & set(letters)}
        fit = next((a for a, need in encodings if set(token) <= set(a) and set(need) <= has), None)
        return [(start, start + len(value), token, fit)] if fit else []

    for m in re.finditer("[A-Za-z0-9+/_-]{20,}", "".join(took)):
        pad = re.match("=+(?![A-Za-z0-9+/_=-])", "".join(took)[m.end() :])
        run = m[0] + (pad[0] if pad else "")
        cuts = [tested(m.start(), run)]
        if re.search("[+/_-]", run):
            for sep in ("[_-]", "[+/]", "[+/_-]"):
                parts, at = [], m.start()
                for x in re.split(sep, run):
                    parts += tested(at, x) if len(x.rstrip("=")) >= 20 else []
                    at += len(x) + 1
                cuts.append(parts)
        yield cuts


def p_value(token, alphabet):
    """Chi-squared, runs and serial correlation, written out plainly."""
    n, k = len(token), len(alphabet)
    x = [alphabet.index(c) for c in token]
    chi = sum((token.count(c) - n / k) ** 2 / (n / k) for c in alphabet)
    z_chi = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    high = [v >= k / 2 for v in x]
    a, b, turns = sum(high), n - sum(high), 1 + sum(p != q for p, q in zip(high, high[1:]))
    z_runs = 9.0 if 2 * a * b <= n else abs(turns - (2 * a * b / n + 1)) / math.sqrt(2 * a * b * (2 * a * b - n) / (n * n * (n - 1)))
    mid = (k - 1) / 2
    z_serial = abs(sum((p - mid) * (q - mid) for p, q in zip(x, x[1:])) / math.sqrt(n - 1) / ((k * k - 1) / 12))
    tail = lambda z: max(math.erfc(z / math.sqrt(2)) / 2, 1e-300)
    return min(1.0, 3 * min(tail(z_chi) if z_chi > 0 else 0.5, 2 * tail(z_runs), 2 * tail(z_serial)))


def test_random_spans_equal_brute_force(spark, docs):
    rng, letters = random.Random(8), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda a, n: "".join(rng.choices(a, k=n))
    bits = [
        lambda: draw(letters, rng.randint(15, 90)), lambda: draw("0123456789abcdef", rng.randint(10, 50)), lambda: draw("ab1", rng.randint(18, 60)),
        lambda: draw(letters + "+/", 44) + "=" * rng.randint(0, 2), lambda: draw(letters, 22) + "-" + draw("AAAb1", 30), lambda: "token=" + draw(letters, rng.randint(5, 30)),
        lambda: "AKIA" + draw("ABCDEFGHIJ0123456789", rng.randint(8, 24)), lambda: draw(["a/b/", "some-path/", "x_1", draw(letters, 25)], 6), lambda: "words é😀",
    ]
    made = [(i, "".join(rng.choice(bits)() + rng.choice([" ", "", "=", "_", "\n", '"']) for _ in range(rng.randint(0, 6)))) for i in range(1500)]
    made += [(5000, draw(letters, 9000)), (5001, draw("abcde12345", 9000)), (5002, "-".join(draw(letters, 24) for _ in range(400))), (5003, None), (5004, made[3][1])]
    df = spark.createDataFrame(made, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    runs = [list(random_spans(t, base_spans(t))) for _, t in rows]
    bins, levels = defaultdict(list), {}
    level = lambda s: (math.floor(math.log2(len(s[2]))), min(math.floor(-math.log10(p_value(*s[2:])) * 20), 2000))
    for cuts in runs:
        for s in {s for cut in (c for r in cuts for c in r) for s in cut}:
            levels[s] = level(s)
            bins[levels[s][0]].append(levels[s][1])
    limit = {}
    for band, bs in bins.items():
        ok = [b for b in set(bs) if 10 ** (-b / 20) <= 0.05 * sum(x >= b for x in bs) / len(bs)]
        limit[band] = min(ok, default=2001)
    assert secret_scan.rejection_bins(df) == limit
    want = {}
    for (i, t), cuts in zip(rows, runs, strict=True):
        out = []
        for r in cuts:
            stay = [[s for s in cut if levels[s][1] < limit[levels[s][0]]] for cut in r]
            out += max(stay, key=lambda ss: sum(e - b for b, e, _, _ in ss))
        want.setdefault((i, t), sorted([(a, k, e) for a, k, e in base_spans(t)] + [(b, 3, e) for b, e, _, _ in out]))
    got = secret_scan.find_secrets(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [(s.start, s.kind, s.end) for s in r.secrets] == want[r.doc_id, r.text or ""], r.text
    assert 100 < sum(s.kind == 3 for r in got for s in r.secrets) and max(limit.values()) < 2001


def test_very_long_runs_end(spark):
    rng, letters = random.Random(9), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(1, "x" * 1_000_000), (2, "".join(rng.choices(letters, k=1_000_000))), (3, "-".join("".join(rng.choices(letters, k=30)) for _ in range(20_000))), (4, "token=abcdefgh1 " * 20_000)]
    got = {r.doc_id: r.secrets for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == [] and [(s.start, s.end) for s in got[2]] == [(0, 1_000_000)] and len(got[4]) == 20_000
    assert sum(s.end - s.start for s in got[3]) > 500_000


def test_exact_report(spark, docs, odd):
    df = docs.unionByName(odd.withColumn("doc_id", odd.doc_id + 100_000))
    rows = df.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    got = exact_dedup.duplicate_report(df).collect()
    assert len(got) == len(rows)
    ids = {r.doc_id: r.text or "" for r in rows}
    for r in got:
        g = groups[ids[r.doc_id]] if r.doc_id is not None else groups["one two"]
        assert (r.keep_id, r.group_size) == (max((i for i in g if i is not None), default=None), len(g))
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_copies(df).collect()
    assert sorted(r.text or "" for r in kept) == sorted(groups)
    assert exact_dedup.drop_copies(df.limit(0)).count() == 0


def test_blocks_at_all_depths_and_hot_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "hot_keys", lambda df, key: [r[0] for r in df.groupBy(key).count().where("count > 3").collect()])
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 60))) for _ in range(200)]
    texts += [rng.choice(texts) for _ in range(100)] + ["a" * k for k in (4, 8, 12, 16, 17)] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = exact_dedup.block_identities(df, block_bytes=4).collect()
    by = defaultdict(set)
    for r in ids:
        by[r.identity].add(texts[r._id])
    assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(texts))


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets():
    assert mixing.targets([10, 10, 10], [3, 1, 2]) == [20.0, 25 / 3, 50 / 3]
    assert mixing.targets([], []) == [] and mixing.targets([0, 5], [3, 1]) == [0.0, 7.5]


def test_mix(spark, docs, odd):
    df = docs.unionByName(odd.withColumn("doc_id", odd.doc_id + 100_000))
    mix = mixing.Mix(df, shards=5)
    got = mix.taken().collect()
    rows = df.select("doc_id", "text", "source").collect()
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r.doc_id), words(r.text)) for r in rows)
    size = defaultdict(int)
    for r in rows:
        size[r.source] += words(r.text)
    names = [*sorted(s for s in size if s is not None), None]
    goal = dict(zip(names, mixing.targets([size[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True))
    src = {r.doc_id: r.source for r in rows if r.doc_id is not None}
    taken = defaultdict(int)
    for r in got:
        assert r.taken <= 2 * r["size"]
        s = src.get(r.doc_id, "c")
        assert r.source_size == size[s] and r.target == pytest.approx(goal[s])
        taken[s] += r.taken
    largest = {s: max(words(r.text) for r in rows if r.source == s) for s in size}
    for s in size:  # documents are taken whole, so a source of a few documents can miss by half of one
        assert abs(taken[s] - goal[s]) <= max(0.05 * goal[s], 20, largest[s] / 2), s
    again = sorted((str(r.doc_id), r.taken) for r in mixing.Mix(df.repartition(3), shards=5).taken().collect())
    assert again == sorted((str(r.doc_id), r.taken) for r in got)
    out = mix.rows(df).toPandas()
    assert sum(map(words, out.text)) == sum(taken.values())
    per = pd.crosstab(out.shard, out.source)
    assert set(out.columns) == {*df.columns, "shard"} and len(per) <= 5
    assert mixing.Mix(df.limit(0)).taken().count() == 0


@pytest.mark.parametrize("shards", [5, 16])
def test_taken_and_shards_equal_brute_force(spark, docs, odd, shards, monkeypatch):
    """Walk each source one document after the other; draw shards for all blocks in one go."""
    import numpy as np
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "BLOCK_WORDS", 900)
    df = docs.unionByName(odd.where("doc_id is not null").withColumn("doc_id", F.monotonically_increasing_id() + 100_000))
    mix = mixing.Mix(df, shards=shards)
    rows = mix.in_blocks.withColumn("_h", F.xxhash64("_key", F.lit(1))).collect()
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["_source"]].append(r)
    want, draws = {}, {}
    for source, rs in by_source.items():
        left, out, passes = rs[0]["_left"], rs[0]["_out"], rs[0]["_passes"]
        size, walk = defaultdict(int), {}
        for r in rs:
            size[r["_key"]] += r["_size"]
            walk[r["_key"]] = (r["_block"], r["_h"], r["_key"])
        picked = set()
        for k in sorted((k for k in size if size[k]), key=walk.get):
            if left > 0 and size[k] <= left:
                picked.add(k)
                left -= size[k]
        rest = [(size[k], k) for k in size if size[k] and k not in picked and size[k] < 2 * left]
        if left > 0 and rest:
            picked.add(min(rest)[1])
        for r in rs:
            want[r["_id"]] = r["_size"] * (passes + (rs[0]["_left"] > 0 and (r["_key"] in picked) != out))
        n = defaultdict(int)
        for b in {walk[k][0] for k in size}:
            inside = {k for k in size if size[k] and walk[k][0] == b}
            n[b] = passes + (rs[0]["_left"] > 0 and any((k in picked) != out for k in inside) or bool(not inside and out))
        draws[source] = sum(n.values())
    got = mix.taken().collect()
    assert {r.doc_id: r.taken for r in got} == want and len(got) == len(rows)
    assert all(r.taken == r["size"] * len(r.shards.split(",") if r.shards else []) for r in got)
    # every draw of a block went to the shard that the tree gave its source
    names = sorted(draws)
    counts = np.array([draws[s] for s in names])
    tree = mixing.split_counts(counts, mixing.quotas_of(int(counts.sum()), [1] * shards), [mixing.SEED, 0, shards, 0])
    dealt = np.zeros_like(tree)
    for r in mix.blocks.where("_shards is not null").collect():
        for shard in r["_shards"]:
            dealt[shard, names.index(r["_source"])] += 1
    assert (dealt == tree).all() and (tree > 0).sum() > shards
    monkeypatch.setattr(mixing, "split_counts", lambda c, q, seed=0: np.vstack([c, np.zeros((len(q) - 1, len(c)), np.int64)]))
    cells = mixing._children(pd.DataFrame({"_node": 0, "_width": shards, "_bucket": 0, "_source": names, "_c": counts}))
    assert set(cells["_node"]) == {0} and mix.rounds <= 4  # what the tree says is what a task deals; the walk ends in a few rounds


@pytest.mark.parametrize("weights", [(3, 1, 2), (1, 50)])
def test_mix_of_more_sources_than_a_bucket(spark, weights, monkeypatch):
    """Targets of any number of sources equal the loop; the tree splits buckets of sources and shards keep the mix's size."""
    monkeypatch.setattr(mixing, "BUCKET_SOURCES", 3)
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 5)
    monkeypatch.setattr(mixing, "WALK_BLOCKS", 1)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 60)
    rng = random.Random(11)
    rows = [(i, "w " * rng.randint(0, 9), f"s{rng.randint(0, 40)}" if i % 3 else "hot") for i in range(900)] + [(901, None, None), (902, "", "zero")]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), shards=4, weights=weights)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += words(t)
    names = [*sorted(s for s in size if s), None]
    goal = dict(zip(names, mixing.targets([size[s] for s in names], [weights[i % len(weights)] for i in range(len(names))]), strict=True))
    src, taken, shards = {i: s for i, _, s in rows}, defaultdict(int), defaultdict(int)
    for r in mix.taken().collect():
        s = src[r.doc_id]
        assert r.target == pytest.approx(goal[s]) and r.source_size == size[s]
        taken[s] += r.taken
        for x in r.shards.split(",") if r.shards else ():
            shards[x] += r["size"]
    assert all(abs(taken[s] - goal[s]) <= 9 for s in names)
    assert set(shards) == set("0123") and max(shards.values()) < 1.5 * min(shards.values())


@pytest.mark.parametrize("share", [0.5, 0.8])
def test_mix_fills_the_room_of_a_long_document(spark, share):
    rows = [(1000 * k + i, "w " * (100_000 if i == 0 else 500), f"s{k}") for k in range(8) for i in range(201)]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,), share=share)
    taken = defaultdict(int)
    for r in mix.taken().collect():
        taken[r.doc_id // 1000] += r.taken
        assert r.target == pytest.approx(200_000 * share)
    for k in range(8):
        assert abs(taken[k] - 200_000 * share) <= 0.05 * 200_000 * share, k


def test_split_counts():
    import numpy as np

    c = np.array([7, 0, 100, 33])
    q = mixing.quotas_of(140, [1] * 6)
    s = mixing.split_counts(c, q)
    assert s.sum(1).tolist() == q and max(q) - min(q) <= 1
    assert (s.sum(0) == c).all() and s.sum(1).max() - s.sum(1).min() <= 3 and (s >= 0).all()
    assert (s == mixing.split_counts(c, q)).all()


@pytest.mark.parametrize("buckets", [100_000, 4096])
def test_many_sources_are_dealt_to_many_shards(spark, buckets, monkeypatch):
    """30,000 sources, one of them hot, and 2,000 shards: every draw is dealt once, shards are equal, a source is spread as chance has it."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "BUCKET_SOURCES", buckets)
    counts = spark.range(30_000).select(F.col("id").cast("string").alias("_source"), F.when(F.col("id") == 7, 40_000).otherwise(1 + F.col("id") % 5).alias("_c"))
    got = mixing.deal_counts(counts, 2000, 30_000)
    by_source = got.groupBy("_source").agg(F.sum("_c").alias("_s")).join(counts, "_source", "full_outer")
    assert by_source.where("_s is null or _c is null or _s <> _c").isEmpty() and by_source.count() == 30_000
    assert got.groupBy("_source", "_shard").count().where("count > 1").isEmpty() and got.where("_c = 0").isEmpty()
    sums = [r[0] for r in got.groupBy("_shard").agg(F.sum("_c")).select("sum(_c)").collect()]
    assert len(sums) == 2000 and max(sums) - min(sums) <= 2
    hot = [r["_c"] for r in got.where("_source = '7'").collect()]
    assert len(hot) == 2000 and max(abs(c - 20) for c in hot) <= 5 * 20**0.5  # 20 on average, as chance has it


def test_tasks_share_a_shard(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TASK_WORDS", 500)
    rows = [(i, "w " * 9, f"s{i % 3}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(df, shards=2)
    out = mix.rows(df)
    assert mix.tasks_a_shard > 5 and out.count() == sum(r.taken // 9 for r in mix.taken().collect())
