"""The registered query of each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.llm import (
    byte_bpe, chunk_dedup, curve_packing, host_reputation, host_rules, importance_resampling, minhash_forest, phrase_bitmaps, rare_feature_digest, suffix_dedup, token_count, token_files, whitening,
)
from loreline.llm.common import scratch_path, table
from loreline.llm.tokenizer_files import public_path


def op1_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def target_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target documents are those labelled of quality and not toxic."""
    return table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("target"))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), target_labels(spark, sf_dir))


URL_RULES = [
    host_reputation.Rule("allow", "com/"),
    host_reputation.Rule("block", "example.com/en/"),
    host_reputation.Rule("allow", "www.example.com/en/"),
    host_reputation.Rule("block", "net/es/"),
    host_reputation.Rule("block", "net/fr/"),
]


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label that carries its id: good if of quality and not toxic."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    out = host_reputation.filter_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op4_rare_feature_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rare_feature_digest.fingerprint_neighbours(table(spark, sf_dir, "documents"))


def op5_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.tiktoken"))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_path("word_bpe_49k.json"))
    return token_files.checksums(token_files.read_token_files(spark, path))


def op10_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op11_phrase_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_bitmaps.collocations(table(spark, sf_dir, "documents"))


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of a document is its domain."""
    return host_rules.judge(table(spark, sf_dir, "documents")).drop("domain_rejected")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_chunk_dedup": op1_chunk_dedup,
    "op2_importance_resampling": op2_importance_resampling,
    "op3_host_reputation": op3_host_reputation,
    "op4_rare_feature_digest": op4_rare_feature_digest,
    "op5_minhash_forest": op5_minhash_forest,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_token_files": op8_token_files,
    "op9_token_count": op9_token_count,
    "op10_curve_packing": op10_curve_packing,
    "op11_phrase_bitmaps": op11_phrase_bitmaps,
    "op12_host_rules": op12_host_rules,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL = {
    "op1_chunk_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM d
        WINDOW w AS (PARTITION BY text)
    """,
    "op3_host_reputation": r"""
        WITH p AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
            FROM pages
        ), rules(action, host, path) AS (
            VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
        ), fit AS (
            SELECT p.page_id, p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.action, length(r.host || r.path)) AS action
            FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
            GROUP BY ALL
        ), l AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels GROUP BY doc_id
        ), h AS (
            SELECT host, n, good, array_to_string(x[greatest(len(x) - k + 1, 1):], '.') AS s, array_to_string(x[greatest(len(x) - k, 1):], '.') AS d
            FROM (SELECT *, CASE WHEN array_to_string(x[greatest(len(x) - 1, 1):], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'co.nz', 'com.br', 'co.in', 'co.za') THEN 2 ELSE 1 END AS k
                  FROM (SELECT host, string_split(host, '.') AS x, count(good) AS n, coalesce(sum(good), 0) AS good FROM p LEFT JOIN l ON p.page_id = l.doc_id GROUP BY host))
        ), d AS (SELECT d, s, sum(n) AS n, sum(good) AS good FROM h GROUP BY d, s
        ), s AS (SELECT s, sum(n) AS n, sum(good) AS good FROM h GROUP BY s
        ), sums AS (
            SELECT lvl, parent, count(*) AS k, sum(n) AS n, sum(good) / sum(n) AS p, sum(n * n) AS n2, sum(good * good / n) AS y2
            FROM (SELECT 'h' AS lvl, d AS parent, n, good FROM h UNION ALL SELECT 'd', s, n, good FROM d UNION ALL SELECT 's', '', n, good FROM s) WHERE n > 0 GROUP BY lvl, parent
        ), spread AS (SELECT lvl, sum(y2 - n * p * p - p * (1 - p) * (k - 1)) AS between_, sum(p * (1 - p) * (n - n2 / n - (k - 1))) AS most FROM sums GROUP BY lvl
        ), strength AS (
            SELECT lvl, CASE WHEN most > 1e-9 THEN 1 / least(greatest(between_ / most, 1 / 1001.0::DOUBLE), 0.5) - 1 ELSE 1000.0 END AS c FROM spread
        ), k AS (
            SELECT (SELECT c FROM strength WHERE lvl = 'h') AS kh, (SELECT c FROM strength WHERE lvl = 'd') AS kd, (SELECT c FROM strength WHERE lvl = 's') AS ks,
                   (SELECT sum(good) / sum(n) FROM h) AS base
        ), ms AS (SELECT s, (good + ks * base) / (n + ks) AS m FROM s, k
        ), md AS (SELECT d.d, (d.good + kd * ms.m) / (d.n + kd) AS m FROM d JOIN ms USING (s), k
        ), ab AS (SELECT host, h.good + kh * m AS a, h.n - h.good + kh * (1 - m) AS b FROM h JOIN md USING (d), k
        ), v AS (SELECT host, CASE WHEN a / (a + b) + 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) < 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM ab
        )
        SELECT page_id, host, path, rule, coalesce(action, verdict) AS verdict FROM fit JOIN v USING (host)
    """,
    "op11_phrase_bitmaps": r"""
        WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), p AS (SELECT d, lang, unnest(list_zip(x, range(len(x)))) AS x FROM (SELECT d, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS x FROM d)
        ), q AS (SELECT d, lang, x[2] AS piece, regexp_extract_all(x[1], '[^\x20\x09]+') AS ws FROM p
        ), w AS (SELECT d, lang, piece, ws, unnest(range(1, len(ws) + 1)) AS i FROM q
        ), g AS MATERIALIZED (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM w, range(1, 5) AS r(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL
        ), n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang
        ), c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 30
        ), cuts AS (
            SELECT lang, phrase, a, j AS cut, array_to_string(ws[1:j], ' ') AS front, array_to_string(ws[j + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM c)
        ), s AS (
            SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
            FROM cuts JOIN g AS x ON x.lang = cuts.lang AND x.phrase = front JOIN g AS y ON y.lang = cuts.lang AND y.phrase = rest
        ), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
        ), inside AS (
            SELECT c.lang, array_to_string(c.ws[i:i + m - 1], ' ') AS phrase, max(c.a) AS longer
            FROM c, range(1, 4) AS s(i), range(2, 4) AS t(m) WHERE m < c.k AND i + m - 1 <= c.k GROUP BY ALL
        ), kept AS (SELECT b.* FROM b LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
    """,
    "op12_host_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS d, doc_id, source, coalesce(text, '') AS t FROM documents
        ), x AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
        ), l AS (
            SELECT d, sum(n - 1)::BIGINT AS n_dup_lines
            FROM (SELECT d, line, count(*) AS n FROM (SELECT d, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY d
        ), g AS (SELECT d, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT d, ws, unnest(range(1, len(ws) - 3)) AS i FROM x)
        ), twice AS (SELECT d, i FROM g QUALIFY count(*) OVER (PARTITION BY d, gram) > 1
        ), r AS (SELECT d, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(5) AS s(j) GROUP BY d
        ), f AS (
            SELECT doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM x LEFT JOIN l USING (d) LEFT JOIN r USING (d)
        ), e AS (
            SELECT *, n_words < 10 AS few, 100 * n_repeat_words > 20 * n_words AS repeats, word_chars < n_words * 2 OR word_chars > n_words * 12 AS odd, n_symbols * 10 > n_words AS symbols, n_dup_lines * 10 > n_words AS dup FROM f
        ), h AS (
            SELECT source, rule, count(*) AS n, sum(fails::INT) AS k
            FROM (SELECT source, unnest([{'rule': 1, 'fails': few}, {'rule': 2, 'fails': repeats}, {'rule': 3, 'fails': odd}, {'rule': 4, 'fails': symbols}, {'rule': 5, 'fails': dup}], recursive := true) FROM e WHERE source IS NOT NULL)
            GROUP BY ALL
        ), s AS (SELECT rule, count(*) AS m, sum(n) AS n, sum(k) / sum(n) AS p, sum(n::DOUBLE * n) AS n2, sum(k::DOUBLE * k / n) AS y2 FROM h GROUP BY rule
        ), c AS (
            SELECT rule, p, CASE WHEN most > 1e-9 THEN 1 / least(greatest(between_ / most, 1 / 1001.0::DOUBLE), 0.5) - 1 ELSE 1000.0 END AS strength
            FROM (SELECT rule, p, y2 - n * p * p - p * (1 - p) * (m - 1) AS between_, p * (1 - p) * (n - n2 / n - (m - 1)) AS most FROM s)
        ), v AS (
            SELECT source, max(rate - 1.645 * sqrt(rate * (1 - rate) / (n + strength + 1))) > 0.5 AS rejected
            FROM (SELECT source, n, strength, (k + strength * p) / (n + strength) AS rate FROM h JOIN c USING (rule)) GROUP BY source
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few OR repeats AS base_failed, NOT (few OR repeats OR coalesce(rejected, false)) AS kept
        FROM e LEFT JOIN v USING (source)
    """,
}
