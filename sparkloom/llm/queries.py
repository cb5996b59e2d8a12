"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, once Spark's Python workers can import this package."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    if ROOT not in sys.path:
        sys.path.insert(0, ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicate_report

    return near_duplicate_report(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hpylm import train_and_score

    return train_and_score(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination_report

    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def list_events(pages: DataFrame) -> DataFrame:
    """Dated list entries for the hosts of pages, made by a fixed rule from a host's MD5.

    The tables hold no filter list.  A host without its first "m." or "blog."
    is a pattern; its digest says whether it is listed, from when to when, and
    whether it is listed again.
    """
    from .urlfilter import host_of

    pattern = F.regexp_replace(host_of(F.col("url")), r"^(m|blog)\.", "")
    hosts = pages.select(pattern.alias("pattern")).where("pattern IS NOT NULL").distinct()
    hosts = hosts.withColumn("n", F.conv(F.substring(F.md5("pattern"), 1, 4), 16, 10).cast("int")).where("n % 4 = 0")
    start = F.to_date(F.lit("2024-01-01"))
    gone = F.expr("n % 200 + 30 + n % 90")
    moves = F.array(
        F.struct(F.lit("add").alias("action"), F.date_add(start, F.expr("n % 200")).alias("date")),
        F.struct(F.lit("remove").alias("action"), F.date_add(start, gone).alias("date")),
        F.struct(F.when(F.expr("n % 8 = 0"), "add").otherwise("remove").alias("action"), F.date_add(start, gone + 40).alias("date")),
    )
    return hosts.select("pattern", F.when(F.expr("n % 3 = 0"), "spam").otherwise("ads").alias("list"), F.explode(moves).alias("e")).select("pattern", "list", "e.action", "e.date")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no time of fetching: it is 2024-01-01 and page_id modulo 366 days."""
    from .urlfilter import verdicts

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") % 366).cast("int")))
    return verdicts(captures, list_events(pages)).select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "lists", "blocked")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_report

    return archive_report(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import substring_report

    return substring_report(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import section_tokens

    return section_tokens(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_report

    return language_report(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprint_report

    return fingerprint_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op7_warc": op7_warc,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op3_decontamination": op3_decontamination,
    "op6_url_filters": op6_url_filters,
    "op2_token_counts": op2_token_counts,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_language_id": op10_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op11_source_divergence": op11_source_divergence,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_fingerprints": op13_fingerprints,
}

SQL: dict[str, str] = {
    "op6_url_filters": r"""
WITH hosts AS (
  SELECT page_id, url, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
         DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS fetched
  FROM pages),
patterns AS (
  SELECT DISTINCT regexp_replace(host, '^(m|blog)\.', '') AS pattern FROM hosts WHERE host IS NOT NULL),
numbered AS (
  SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 4) AS INT) AS n FROM patterns),
listed AS (
  SELECT pattern, n, CASE WHEN n % 3 = 0 THEN 'spam' ELSE 'ads' END AS list,
         n % 200 AS a, n % 200 + 30 + n % 90 AS r
  FROM numbered WHERE n % 4 = 0),
valid AS (
  SELECT pattern, list, DATE '2024-01-01' + a AS since, DATE '2024-01-01' + r AS until FROM listed
  UNION ALL
  SELECT pattern, list, DATE '2024-01-01' + r + 40, NULL FROM listed WHERE n % 8 = 0),
hit AS (
  SELECT h.page_id, string_agg(DISTINCT v.list, ',' ORDER BY v.list) AS lists
  FROM hosts h JOIN valid v ON (h.host = v.pattern OR ends_with(h.host, '.' || v.pattern))
   AND v.since <= h.fetched AND (v.until IS NULL OR h.fetched < v.until)
  GROUP BY h.page_id)
SELECT h.page_id, h.host, CAST(h.fetched AS VARCHAR) AS fetched, coalesce(hit.lists, '') AS lists, hit.lists IS NOT NULL AS blocked
FROM hosts h LEFT JOIN hit USING (page_id)
""",
    "op11_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
w AS (SELECT doc, lang, source, unnest(ws) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
wide AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v.v,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) AS n_lang,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS total_lang
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (
  SELECT lang, source, term, n, CAST(1 + 1000000000 * CAST(n + 1 AS HUGEINT) // CAST(total + v AS HUGEINT) AS BIGINT) AS p,
         CAST(1 + 1000000000 * CAST(n_lang + 1 AS HUGEINT) // CAST(total_lang + v AS HUGEINT) AS BIGINT) AS q
  FROM wide),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
most AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM s WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pairs
UNION ALL
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM most
QUALIFY rank <= 200
""",
    # DuckDB has no CRC-32: it is folded over the bits of each distinct word
    "op12_importance_resampling": r"""
WITH texts AS (SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark),
w AS (
  SELECT kind, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM texts),
n AS (SELECT kind, id, word, count(*) AS n FROM w GROUP BY ALL),
bytes AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM n)),
crc AS (
  SELECT word, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS crc
  FROM bytes),
hits AS (SELECT kind, id, crc % 10000 AS bucket, n FROM n JOIN crc USING (word)),
b AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t FROM hits GROUP BY bucket),
totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM b),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000)))) AS BIGINT) AS gain FROM b, totals),
weighed AS (SELECT id AS doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM hits JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY id),
scored AS (
  SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN weighed USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM placed
""",
}
