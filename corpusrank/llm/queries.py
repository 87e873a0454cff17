"""The registered queries of this subpackage, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fill_middle, filter_audit, jaccard_join, line_rules, lm_scoring, media, mixing, piece_codec, quality, secret_scan, sharding, url_filter
from .common import scratch_path, table, text_of

URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


QUALITY_LEAST = 0.3
#: Arrivals of op1: twelve of 3 and four of 7 parts in 64, by the id's CRC.
ARRIVALS = [3, 3, 3, 7] * 4


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, scratch_path(spark, "shards"))
    part, low = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % sum(ARRIVALS), 0
    for size in ARRIVALS:  # every row arrives in one of the appends
        store.append(docs.where((part >= low) & (part < low + size)))
        low += size
        store.compact()
        store.vacuum(grace_seconds=0)  # this query is the store's one writer
    rows = sum(r["rows"] for r in store.manifest()["runs"])
    body = text_of("text")
    return store.read().select(
        "doc_id", "lang", "source", "n_chars", F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("text_sha256"),
        F.lit(rows).cast("long").alias("manifest_rows"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(quality.fold_of("doc_id") == 0, F.lit(False))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = piece_codec.round_trip(docs, piece_model())
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.JaccardJoin(table(spark, sf_dir, "documents").select("doc_id", "text")).classes()


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs, false_rate=secret_scan.FALSE_DISCOVERY_RATE).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.span_list(base), 256).alias("base_sha256"), secret_scan.span_list(F.col("secrets")).alias("spans"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    report = exact_dedup.duplicate_report(docs, carry={"text_sha256": F.sha2(text_of("text"), 256)})
    return report.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).taken()


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = media.MediaStore.write(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = media.with_feature(store.payloads())
    return rows.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scoring.WordModel(docs, piece_model()).score(docs)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = fill_middle.restore(fill_middle.fill_in_middle(docs))
    return both.select(
        "doc_id", F.col("n_lines").alias("n"), "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = line_rules.judge(docs, line_rules.fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "line_labels")


_ALL = (
    op1_sharding, op2_quality, op3_url_filter, op4_piece_codec, op5_jaccard_join, op6_secret_scan, op7_exact_dedup, op8_mixing, op9_media, op10_lm_scoring,
    op11_filter_audit, op12_fill_middle, op13_quality_rules,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_HOST = "coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '')"


def _under(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


def _url_sql() -> str:
    longest = sorted(URL_RULES, key=lambda r: (-r.host.count("."), -len(r.path)))
    rule = " ".join(f"WHEN {_under(r.host, r.path)} THEN '{r.host}{r.path}'" for r in longest)
    verdict = " ".join(f"WHEN {_under(r.host, r.path)} THEN '{r.verdict}'" for r in longest)
    return f"""
        SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict
        FROM (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages)"""


_AUDIT = """
    WITH labelled AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    words AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM texts),
    flags AS (
        SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 50)::INT AS a, (100 * len(list_distinct(w)) < 65 * len(w))::INT AS b,
               (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT AS c, regexp_matches(t, '[#$%&*|]')::INT AS d,
               coalesce(doc_id > first, false)::INT AS e
        FROM words LEFT JOIN labelled USING (doc_id)),
    counted AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
    orders AS (
        SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
        FROM letters p, letters q, letters r, letters s, letters t
        WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
    steps AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS prior FROM orders, range(1, 6) AS s(step)),
    results AS (
        SELECT part, filter_order, step, bit, sum(n) FILTER (WHERE mask & (prior | bit) = 0) AS kept, sum(n) FILTER (WHERE mask & bit > 0 AND mask & prior = 0) AS removed,
               sum(n) FILTER (WHERE mask & bit > 0 AND mask & prior > 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
               sum(good) FILTER (WHERE mask & bit > 0 AND mask & prior = 0) AS good_lost, sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & prior = 0) AS toxic_lost
        FROM counted, steps GROUP BY ALL)
    SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
           coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
           coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
    FROM results"""

_FILL = """
    WITH lines AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s
        FROM documents),
    hashed AS (
        SELECT *, len(u) AS n, ('0x' || s[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || s[9:16])::BIGINT % (len(u) + 1) AS c2,
               CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') THEN 'plain' WHEN ('0x' || s[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
        FROM lines),
    cut AS (
        SELECT doc_id, t, n, form, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
               array_to_string(u[greatest(c1, c2) + 1:], '') AS s
        FROM hashed)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM cut"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": """
            SELECT doc_id, lang, source, n_chars, strlen(coalesce(text, '')) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256,
                   count(*) OVER () AS manifest_rows
            FROM documents""",
        "op3_url_filter": _url_sql(),
        "op7_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
        "op11_filter_audit": _AUDIT,
        "op12_fill_middle": _FILL,
    }
