"""op1, op2, op5, op9 and op10 against brute force, an exact round trip or held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusrank.llm import components, jaccard_join, lm_scoring, media, quality, queries, sharding
from corpusrank.llm.common import scratch_path

from .test_simple import DOCS, ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def key(r):
    return tuple(map(str, r))


# -- sharding ------------------------------------------------------------------------------------------------


def test_store_keeps_all_rows_through_merges(spark, docs, odd):
    df = docs.unionByName(odd).withColumnRenamed("lang", "shard")  # a column named like one of the manifest's
    store = sharding.ShardStore(spark, scratch_path(spark, "store"), target_bytes=1 << 20, fanout=3)
    parts = df.randomSplit([1.0] * 5, 3)
    for p in parts:
        store.append(p.repartition(2))
    assert store.versions() == [1, 2, 3, 4, 5] and len(store.manifest()["runs"]) == 5
    before = store.manifest()["version"]
    store.compact()
    after = store.manifest()
    assert after["version"] > before and len(after["runs"]) < 5
    want = sorted(map(key, df.collect()))
    assert sorted(map(key, store.read().select(*df.columns).collect())) == want
    assert sorted(map(key, store.read(before).select(*df.columns).collect())) == want  # old versions stay readable
    assert store.shards().selectExpr("sum(rows)").first()[0] == len(want)
    assert store.vacuum() == 0  # the runs are young: a writer may be about to commit them
    assert store.vacuum(grace_seconds=0) > 0 and sorted(map(key, store.read().select(*df.columns).collect())) == want


def test_store_merges_in_tiers(spark, docs, odd):
    df = docs.unionByName(odd).repartition(16).cache()
    store = sharding.ShardStore(spark, scratch_path(spark, "store"), fanout=4)
    for i, p in enumerate(df.randomSplit([1.0] * 16, 5)):
        store.append(p.repartition(2))
        if i % 4 < 3:
            assert store.compact() == store.manifest()["version"] and len(store.manifest()["runs"]) == i // 4 + i % 4 + 1
        else:
            store.compact()  # four arrivals are one run; four such runs are one again
            assert len(store.manifest()["runs"]) == (i // 4 + 1 if i < 15 else 1)
    assert sorted(map(key, store.read().collect())) == sorted(map(key, df.collect()))


def test_store_commits_on_top_of_other_writers(spark, odd, monkeypatch):
    root = scratch_path(spark, "store")
    one, two = sharding.ShardStore(spark, root, fanout=2), sharding.ShardStore(spark, root, fanout=2)
    write = sharding.ShardStore._write_run
    turns = [True, True]

    def slow(self, df, **options):
        run = write(self, df, **options)
        if self is one and turns:
            turns.pop()
            two.append(odd.limit(2))
        return run

    monkeypatch.setattr(sharding.ShardStore, "_write_run", slow)
    one.append(odd)  # the other store commits between this append's run and its manifest
    assert [r["rows"] for r in one.manifest()["runs"]] == [2, len(ODD)] and one.read().count() == len(ODD) + 2
    one.compact()  # and between the merge and its manifest
    assert one.read().count() == len(ODD) + 4
    with pytest.raises(ValueError):
        one.append(odd.drop("lang"))


def test_store_refuses_a_taken_version_and_takes_empty_arrivals(spark, odd):
    store = sharding.ShardStore(spark, scratch_path(spark, "store"))
    store.append(odd.limit(0))
    assert store.read().count() == 0 and store.manifest()["runs"] == []
    store.append(odd)
    with pytest.raises(sharding.CommitConflict):
        store._commit(store.manifest())
    assert store.read().count() == len(ODD)


# -- quality -------------------------------------------------------------------------------------------------


def test_statistics_have_one_length():
    assert {len(quality.statistics(t)) for t in (None, "", " \n", "a", "A b! c\nd", "é" * 50)} == {quality.N_STATS}


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0.0, 1.0, 0.0, 1.0, 1.0]), np.ones(5))
    assert x.tolist() == [0.0, 1.5, 3.5] and y.tolist() == [0.0, 0.5, 1.0]


def test_quality_equals_a_direct_solution(spark):
    """Weights against least squares on all rows at once, the calibration against every monotone fit's optimality."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = docs.join(labels.where("quality is not null"), "doc_id").select("doc_id", "text", "quality").collect()
    fold = np.array([zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows])
    x, y = np.array([quality.statistics(r.text) for r in rows]), np.array([float(r.quality) for r in rows])
    train = (fold > 0) & (fold < 4)
    assert np.allclose(model.mean, x[train].mean(0)) and np.allclose(model.scale, np.maximum(x[train].std(0), 1e-6), rtol=1e-3, atol=1e-5)
    f = model.features(x)
    # ridge is least squares on rows extended by sqrt(RIDGE) times the identity
    wide = np.vstack([f[train], np.sqrt(quality.RIDGE) * np.eye(f.shape[1])])
    direct = np.linalg.lstsq(wide, np.concatenate([y[train], np.zeros(f.shape[1])]), rcond=None)[0]
    assert np.allclose(f @ model.weights, f @ direct, atol=1e-6)
    # pools of binned scores: increasing, each the mean of its rows
    raw, yy = (f @ direct)[fold == 4], y[fold == 4]
    bins = np.floor(np.clip(raw, -2, 3) * quality.SCORE_BINS)
    keys = np.unique(bins)
    means = [raw[bins == b].mean() for b in keys], [yy[bins == b].mean() for b in keys], [(bins == b).sum() for b in keys]
    best = np.array([min(max(np.average(means[1][i : j + 1], weights=means[2][i : j + 1]) for i in range(k + 1)) for j in range(k, len(keys))) for k in range(len(keys))])
    got = np.interp(means[0], model.knots, model.values)
    pools = np.interp(model.knots, means[0], best)
    assert np.all(np.diff(model.values) > 0) and np.allclose(model.values, pools, atol=0.05) and np.abs(got - best).mean() < 0.05


def test_quality_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.op2_quality(spark, d).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.9


def test_quality_odd(spark, odd):
    none = quality.fit(odd, spark.createDataFrame([(1, None)], "doc_id long, quality int"))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}
    one = quality.fit(odd, spark.createDataFrame([(i, 1) for i in range(1, 9)] * 2, "doc_id long, quality int"))
    got = quality.score(odd.withColumnRenamed("lang", "score"), one).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(odd.limit(0), one).count() == 0


# -- Jaccard join --------------------------------------------------------------------------------------------


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    n = min(5, len(w))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if n else frozenset()


def classes(rows):
    """doc_id -> (size, smallest id reached) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root(i), root(j)
                    up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rng, words, share):
    return [rng.choice("abcdefgh") * 3 + str(rng.random()) if rng.random() < share else w for w in words]


def families(seed, n=12, size=14):
    """Copies with different shares of edits around the threshold, short texts and a passage that many share."""
    rng, out = random.Random(seed), []
    passage = [f"p{i}" for i in range(60)]
    for f in range(n):
        base = [f"w{f}_{rng.randint(0, 400)}" for _ in range(rng.choice([3, 6, 9, 14, 30, 80, 300]))]
        for _ in range(size):
            out.append(" ".join(edited(rng, base, rng.choice([0, 0.005, 0.02, 0.04, 0.08]))))
    for _ in range(60):
        out.append(" ".join(passage + [f"o{rng.random()}" for _ in range(rng.randint(1, 40))]))
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_equal_all_pairs(spark, seed, monkeypatch):
    if seed == 2:  # the paths for large keys and several blocks of a family
        monkeypatch.setattr(jaccard_join, "LARGE_KEY", 2)
        monkeypatch.setattr(jaccard_join, "FAMILY_BLOCK", 4)
    rows = families(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.JaccardJoin(df).classes().collect()}
    assert got == classes(rows)


def test_jaccard_on_tables_and_odd_rows(spark, docs, odd):
    df = docs.unionByName(odd.withColumn("doc_id", odd.doc_id + 100_000)).select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None]
    want = classes(rows)
    got = jaccard_join.JaccardJoin(df).classes().collect()
    assert len(got) == df.count()
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert jaccard_join.JaccardJoin(df.limit(0)).classes().count() == 0
    kept = jaccard_join.keep_one(df).collect()
    assert {r.doc_id for r in kept if r.doc_id is not None} == {c for _, c in want.values()}


@pytest.mark.parametrize("wide", [0, 1, 2, 3])
def test_every_pair_over_the_threshold_shares_a_key(wide):
    """The pigeonhole argument, with and without one-deletion neighbourhoods."""
    rng = np.random.default_rng(wide)
    for _ in range(300):
        n = int(rng.integers(4, 60))
        band = next(b for b in jaccard_join.bands_for({e: 9 for e in range(8)}) if b.low <= n < b.next_low)
        most = int(max(band.most_differences(x) for x in (band.next_low - 1, band.high)))
        w = min(wide, (most + 2) // 2)
        band = jaccard_join.replace(band, wide=w, segments=w + max(0, most + 1 - 2 * w) + (2 if most + 1 > 2 * w else 0) or 1)
        a = rng.integers(1, 1 << 62, n).astype(np.uint64)
        drop = int(rng.integers(0, n // 4 + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(1, 1 << 62, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both) or len(b) > band.high or len(b) < band.low:
            continue
        d, k = jaccard_join._index_keys([a, b], band, np.zeros(0, np.uint64))
        assert set(k[d == 0]) & set(k[d == 1])


def test_allocation_uses_deletions_where_they_pay():
    assert any(b.wide for b in jaccard_join.bands_for({e: 30_000 for e in range(6)}))


def test_components(spark):
    rng, edges = random.Random(3), []
    for base in range(0, 400, 20):
        edges += [(base + i, base + rng.randint(0, i - 1)) for i in range(1, 15)]
    edges += [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: (1000 if n >= 1000 else n // 20 * 20) for e in edges for n in e}


# -- media ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [media.BROADCAST_DIGESTS, 0])
def test_media_round_trip(spark, docs, odd, most):
    rng = random.Random(5)
    big = "".join(rng.choices("abcdefghij \n", k=150_000))
    more = spark.createDataFrame([(900 + i, big + str(i) * i, "en", "a", 1) for i in range(3)], DOCS)
    df = docs.unionByName(odd).unionByName(more)
    store = media.MediaStore.write(df, broadcast_digests=most)
    rows = store.payloads().collect()
    want = Counter(media.payload_of(r.text) for r in df.select("text").collect())
    assert Counter((r.n_bytes, bytes(r.payload)) for r in rows) == want
    assert {(r.doc_id, r.source) for r in rows} == {(r.doc_id, r.source) for r in df.collect()}
    assert store.chunks.count() == store.chunks.select("digest").distinct().count() > 10  # the long texts share chunks
    forms = {}
    for r in rows:
        assert forms.setdefault(bytes(r.payload), bytes(r.media)) == bytes(r.media)
    assert media.MediaStore.write(df.limit(0)).payloads().count() == 0


def test_gear_hash_is_the_rolled_one():
    data = np.random.default_rng(1).integers(0, 256, 300).astype(np.uint8)
    got = media.gear_hashes(data)
    for i in range(300):
        want = sum(int(media._GEAR[data[i - k]]) << k for k in range(min(16, i + 1))) % (1 << 32)
        assert int(got[i]) == want


def test_chunks_join_and_follow_content():
    rng = random.Random(6)
    text = bytes(rng.choices(range(256), k=200_000))
    cut = media.chunks_of(text)
    assert b"".join(cut) == text and all(media.LEAST <= len(c) <= media.MOST for c in cut[:-1])
    moved = media.chunks_of(b"some new start" + text)
    assert len(set(cut) & set(moved)) >= len(cut) - 3


def test_media_digest_is_of_bytes_that_were_stored(spark, docs):
    store = media.MediaStore.write(docs.select("doc_id", "text"))
    heads = {r["_row"].doc_id: bytes(r["_m_head"]) for r in store.media.collect()}
    bodies = {bytes(r.digest): bytes(r.body) for r in store.chunks.collect()}
    bodies |= {hashlib.sha256(b).digest(): bytes(b) for r in store.media.collect() for b in r["_m_bodies"] if b is not None}
    for r in store.payloads().collect():
        head, chunks = heads[r.doc_id], b""
        for i in range(r.n_chunks):
            at = 16 + 36 * i
            chunks += bodies[head[at + 4 : at + 36]]
        assert bytes(r.media) == head + chunks and chunks == bytes(r.payload)
    broken = store.media.withColumn("_m_head", F.overlay("_m_head", F.lit(b"\x00" * 8), F.lit(30)))
    with pytest.raises(Exception, match="differs"):
        media.MediaStore(broken, store.chunks).payloads().collect()


def plain_feature(x, chunks):
    n = len(x)
    p = [x.count(b) / n for b in set(x)]
    mean = sum(x) / n
    std = math.sqrt(sum((b - mean) ** 2 for b in x) / n)
    step = sum(abs(a - b) for a, b in zip(x, x[1:])) / (n - 1)
    return {"chunks": chunks, "mean": mean, "std": std, "entropy": -sum(q * math.log2(q) for q in p), "step": step}


def test_media_store_without_a_chunk_raises(spark):
    shared = "".join(f"line {i} of a passage that two texts share\n" for i in range(2000))
    df = spark.createDataFrame([(1, shared), (2, shared + "more"), (3, "alone")], "doc_id long, text string")
    store = media.MediaStore.write(df)
    assert store.chunks.count() > 1 and store.payloads().count() == 3
    for chunks in (store.chunks.limit(0), store.chunks.limit(1), store.chunks.withColumn("body", F.expr("cast('other' as binary)"))):
        with pytest.raises(Exception, match="differs from its head"):
            media.MediaStore(store.media, chunks).payloads().collect()


def test_media_query(spark, sf_dir, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op9_media(spark, sf_dir).collect():
        n, payload = media.payload_of(texts[r.doc_id])
        cut = media.chunks_of(payload)
        form = media.head_of(cut) + payload
        assert (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
        got = {k: float(v) for k, v in (x.split("=") for x in r.feature.split(";"))}
        assert got == pytest.approx(plain_feature(payload, len(cut)), abs=1e-3)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (n, len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.feature.startswith("chunks=")


# -- language model ------------------------------------------------------------------------------------------


def test_lattice_of_a_very_long_word_forgets_what_no_piece_reaches():
    pieces, spelled = {"a": -1.0, "ab": -1.5, "b": -2.0, "▁a": -0.5}, [-3.0] * 256
    word = "abéa" * 3000
    s, every = "▁" + word, [0.0]
    for j in range(1, len(s) + 1):  # the whole recursion, nothing dropped
        paths = [every[i] + pieces[s[i:j]] for i in range(max(0, j - 2), j) if s[i:j] in pieces]
        if s[j - 1] not in pieces:
            paths.append(every[j - 1] - 3.0 * len(s[j - 1].encode()))
        top = max(paths)
        every.append(top + math.log(sum(math.exp(p - top) for p in paths)))
    assert lm_scoring.lattice(word, pieces, spelled) == pytest.approx(every[-1], rel=1e-12)


def test_long_words_are_joined_and_not_broadcast(spark):
    long = "x" * 3000
    docs = spark.createDataFrame([(i, f"{long} a b {long}" if i % 2 else "a b c", "mine") for i in range(40)], "doc_id long, text string, n_tokens string")
    m = lm_scoring.WordModel(docs, queries.piece_model())
    got = {r.doc_id: r.score for r in m.score(docs).collect()}
    known = {bytes(r.word): r.score for r in m.words.collect()}
    want = lambda i: sum(known[w] for w in lm_scoring.words_of(f"{long} a b {long}" if i % 2 else "a b c")) + m.end_score
    assert all(got[i] == pytest.approx(want(i)) for i in range(40))


def test_lattice_sums_all_segmentations():
    pieces = {"▁": -3.0, "▁a": -2.0, "a": -1.0, "b": -1.5, "ab": -0.7, "▁ab": -2.5}
    spelled = [-4.0] * 256

    def brute(s):
        if not s:
            return 1.0
        total = sum(math.exp(p) * brute(s[len(x) :]) for x, p in pieces.items() if s.startswith(x))
        if s[0] not in pieces:
            total += math.exp(sum(spelled[b] for b in s[0].encode())) * brute(s[1:])
        return total

    for word in ("", "a", "ab", "abab", "aéb", "bab漢a"):
        assert lm_scoring.lattice(word, pieces, spelled) == pytest.approx(math.log(brute("▁" + word)))


def lm_base(rows):
    tok = [(i, WORD.findall((t or "").translate(LOW)), i is not None and zlib.crc32(str(i).encode()) % 5 == 1) for i, t in rows]
    c = Counter()
    for _, w, held in tok:
        if not held:
            c.update(w)
            c["\0"] += 1
    n, v = sum(c.values()), len(c)
    for i, w, held in tok:
        f = [c[x] for x in w] + [c["\0"]]
        yield str(i), held, len(f), sum(x > 0 for x in f), n, round(sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in f), 5)


@pytest.mark.parametrize("share", [lm_scoring.HOT_SHARE, 50])
def test_lm_counts_and_scores(spark, docs, odd, share, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HOT_SHARE", share)  # at 50, most words go through the join
    df = docs.unionByName(odd).select("doc_id", "text")
    got = lm_scoring.WordModel(df, queries.piece_model()).score(df).collect()
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = sorted(lm_base(rows))
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [x[:5] for x in have] == [x[:5] for x in want]
    assert [x[5] for x in have] == pytest.approx([x[5] for x in want], abs=1e-4)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_lm_scores_equal_brute_force(spark, docs, odd):
    """The whole model in plain Python: pieces counted over all training words, all segmentations of each word summed by recursion."""
    import sentencepiece
    from functools import cache

    df = docs.limit(40).unionByName(odd.limit(8)).select("doc_id", "text")
    rows = [(r.doc_id, lm_scoring.words_of(r.text)) for r in df.collect()]
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = [w.decode() for i, ws in rows if not is_held(i) for w in ws if len(w) < 10_000]
    train += [w.decode() for i, ws in rows if not is_held(i) for w in ws if len(w) >= 10_000]
    counts = Counter(p for w in train for p in sp.encode(w))
    ends = sum(not is_held(i) for i, _ in rows)
    normal = [i for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)]
    total = sum(counts.values()) + ends + 0.5 * (len(normal) + 1)
    score = {sp.id_to_piece(i): math.log((counts[i] + 0.5) / total) for i in normal}
    longest = max(map(len, score))

    def word(w):
        s = "▁" + w

        @cache
        def rest(i):  # the summed probability of s[i:]
            if i == len(s):
                return 1.0
            out = sum(math.exp(score[s[i:j]]) * rest(j) for j in range(i + 1, min(len(s), i + longest) + 1) if s[i:j] in score and not s[i:j].startswith("<0x"))
            if s[i] not in score:
                out += math.exp(sum(score[f"<0x{b:02X}>"] for b in s[i].encode())) * rest(i + 1)
            return out

        return math.log10(rest(0))

    known = {w: word(w.decode()) for _, ws in rows for w in ws if len(w) < 300}
    got = lm_scoring.WordModel(df, queries.piece_model()).score(df).collect()
    want = Counter()
    for i, ws in rows:
        if all(w in known for w in ws):
            want[str(i), round(sum(known[w] for w in ws) + math.log10((ends + 0.5) / total), 6)] += 1
    have = Counter((str(r.doc_id), round(r.score, 6)) for r in got)
    assert len(want) > 40 and all(any(k[0] == h[0] and abs(k[1] - h[1]) < 1e-4 for h in have) for k in want)


def test_lm_is_better_than_uniform_and_takes_empty_tables(spark, docs):
    df = docs.select("doc_id", "text")
    model = lm_scoring.WordModel(df, queries.piece_model())
    got = model.score(df).toPandas()
    letters = {r.doc_id: len(r.text) for r in df.collect()}
    held = got[got.held_out]
    assert (held.score / held.doc_id.map(letters)).mean() > math.log10(1 / 40)
    empty = df.limit(0)
    assert lm_scoring.WordModel(empty, queries.piece_model()).score(empty).count() == 0
