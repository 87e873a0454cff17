"""op11 and op12 against brute force on the smallest tables and on odd rows."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusrank.llm import fill_middle, filter_audit
from corpusrank.llm.common import join_hot as _join_hot

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text):
    t = text or ""
    w = WORDS.findall(t)
    return (len(w) < 50) | (100 * len(set(w)) < 65 * len(w)) << 1 | (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) << 2 | bool(re.search(r"[#$%&*|]", t)) << 3


def brute_masks(rows):
    out = []
    for i, text, source in rows:
        copy = any(i is not None and j is not None and j < i and (t or "") == (text or "") for j, t, _ in rows)
        out.append((i, source or "", fails(text) | copy << 4))
    return sorted(out, key=repr)


def brute_audit(masked, good, toxic):
    out = set()
    for part in {p for _, p, _ in masked}:
        rows, steps, removed_by = [(i, m) for i, p, m in masked if p == part], [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left, gone = rows, []
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                removed = [r for r in left if r[1] & bit]
                redundant = sum(1 for r in gone if r[1] & bit)
                left = [r for r in left if not r[1] & bit]
                gone = gone + removed
                removed_by[letter] += len(removed)
                steps.append((part, order, step, len(left), len(removed), redundant, sum(m == bit for _, m in rows), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)))
        out |= {(*s, removed_by[s[1][s[2] - 1]]) for s in steps}
    return out


LONG = " ".join(f"w{i}" for i in range(60))
ODD = [
    (1, "", "a"), (2, None, "a"), (3, "", None), (4, LONG, "a"), (5, LONG, "b"), (5, LONG, "b"), (6, LONG + " ", ""), (None, LONG, "b"), (None, None, None),
    (7, "A" * 30 + LONG, "a"), (8, LONG + " #", "a"), (9, "x " * 500, "c"), (10, "é" * 200000, "c"), (11, LONG * 500, "c"), (12, LONG * 500, "a"), (0, LONG * 500, "b"),
]


@pytest.mark.parametrize("how", [{}, {"broadcast_segments": 0}, {"hash_of": "length(text) % 5"}, {"broadcast_segments": 0, "hash_of": "3"}])
def test_masks_equal_brute_force(spark, how, monkeypatch):
    monkeypatch.setattr(filter_audit, "SEGMENT_TEXTS", 6)
    monkeypatch.setattr(filter_audit, "join_hot", lambda *a, **k: _join_hot(*a, **k, least=3))
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string").repartition(3)
    how = how | {k: F.coalesce(F.expr(v), F.lit(0)).cast("long") for k, v in how.items() if k == "hash_of"}
    got = filter_audit.masks(df, **how)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_masks(ODD)


def test_audit_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, s, "x") for i, t, s in ODD], "doc_id long, text string, source string, _mask string")
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, 1, 0), (8, 1, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in filter_audit.audit(df, labels).collect()]
    assert len(got) == 600 * 4 and set(got) == brute_audit(brute_masks(ODD), {4, 5, 8}, {5, 8})
    assert filter_audit.audit(df.limit(0), labels).count() == 0
    assert filter_audit.audit(df, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_sketch_clears_texts_that_stand_once(spark, sf_dir):
    """Of unique texts few stay; of repeated ones all do."""
    rng = np.random.default_rng(1)
    once, twice = rng.integers(-(1 << 62), 1 << 62, (2, 60_000))
    hashes = np.concatenate([once, twice, twice, np.full(50_000, 7)])
    df = spark.createDataFrame([(int(h),) for h in rng.permutation(hashes)], "_h long").repartition(5)
    segments = 2
    bits = np.stack([np.frombuffer(r[1], np.uint8) for r in sorted(filter_audit.sketch(df, segments).collect())]).ravel()

    def kept(h):
        segment, places = filter_audit.counters_of(h, segments)
        return filter_audit._bit(bits, segment[:, None] * filter_audit.COUNTERS + places).all(1)

    assert kept(np.append(twice, 7)).all() and kept(once).mean() < 0.05


def brute_fill(i, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(units), hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return text, "plain", n, None, None
    if h[3] % 100 < spm:
        return f"<S>{s}<P>{p}<M>{m}", "spm", n, len(p), len(m)
    return f"<P>{p}<S>{s}<M>{m}", "psm", n, len(p), len(m)


def texts(n, rng):
    pieces = ["\n", "a", "é", "😀", "<", "P>", "S", "M>", "<S", ">", "line of words\n", "\r\n", " "]
    return ["".join(rng.choices(pieces, weights=[3, 3, 2, 1, 1, 0.3, 1, 0.3, 0.3, 1, 5, 1, 1], k=rng.randint(0, 40))) for _ in range(n)] + [None, "", "\n", "\n\n", "no break", "<P>", "<S>x\n", "x\n<M>", "x<", "P>\n"]


@pytest.mark.parametrize("window", [1, 7, 1_000_000])
def test_arrays_equal_strings(window, monkeypatch):
    monkeypatch.setattr(fill_middle, "WINDOW", window)
    rng = random.Random(window)
    got_texts = texts(60 if window == 1 else 400, rng)
    ids = list(range(len(got_texts)))
    hashes = np.array([[int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)] for i in ids])
    array = pa.array(["skipped", *got_texts], pa.string()).slice(1)  # an array that begins inside its buffers
    cols = fill_middle.arrange(array, hashes, 70, 30)
    want = [brute_fill(i, t, 70, 30) for i, t in zip(ids, got_texts, strict=True)]
    assert list(zip(*(c.to_pylist() for c in cols), strict=True)) == want
    assert fill_middle.arranged_back(cols[0], cols[1]).to_pylist() == [t or "" for t in got_texts]
    assert {w[1] for w in want} == {"plain", "psm", "spm"}


def test_wrong_forms_raise():
    for output, form in (("<P>a<S>b<M>c", "spm"), ("<P>a<M>c", "psm"), ("abc", "psm"), ("<P>a<S>b<M>c<M>", "psm")):
        with pytest.raises(ValueError, match="marks"):
            fill_middle.arranged_back(pa.array([output, "x"]), pa.array([form, "plain"]))


def test_fill_keeps_rows_and_columns(spark, sf_dir):
    rng = random.Random(3)
    rows = [(i, t, "mine", 1) for i, t in enumerate(texts(50, rng))] + [(None, "a\nb\n", "mine", 2), (3, "y\n" * 100_000, "mine", 3), (3, "y\n" * 100_000, "mine", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, _hash long").repartition(3)
    got = fill_middle.restore(fill_middle.fill_in_middle(df)).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    for r, (i, t, _, h) in zip(sorted(got, key=lambda r: (str(r.doc_id), str(r.text))), sorted(rows, key=key), strict=True):
        assert (r.output, r.form, r.n_lines, r.prefix_chars, r.middle_chars) == brute_fill(i, t)
        assert r.restored == (t or "") and r["_hash"] == h
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for r in fill_middle.restore(fill_middle.fill_in_middle(docs)).collect():
        assert (r.output, r.form, r.n_lines, r.prefix_chars, r.middle_chars, r.restored) == (*brute_fill(r.doc_id, r.text), r.text or "")
