"""One registered query per operator of this subpackage, with production parameters, over
its whole table; and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import (
    bpe, chat, divergence, htmlcrf, langid, maxent, outliers, packing, quality, simhash, spelling, topk, urls)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out third."""
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by a model trained on a sample of them."""
    pages = read(spark, sf_dir, "pages")
    return htmlcrf.extract(pages, htmlcrf.train(pages))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's turns with repaired roles and their rendering."""
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows outside the held-out fifth."""
    return langid.identify(read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens packed into sequences of at most 2048."""
    return packing.packed_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows, by integer inner product, of every 50th vector."""
    vectors = topk.quantised(read(spark, sf_dir, "embeddings"))
    return topk.nearest(vectors.filter(F.pmod("key", F.lit(50)) == 0), vectors, 5)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and the text decoded from them."""
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                       public_tokenizers.PATTERN)


#: Fixed values of the query's contract: (host, path, block).
URL_RULES = [("com", "/", False), ("example.com", "/en/", True), ("www.example.com", "/en/", False),
             ("net", "/es/", True), ("net", "/fr/", True)]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the rule list on every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, block boolean")
    return urls.judge(read(spark, sf_dir, "pages"), rules)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust multivariate outliers over every document."""
    return outliers.judge(read(spark, sf_dir, "documents"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learned from the rows outside the held-out seventh."""
    return maxent.score(read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents, each with its form and root."""
    return spelling.variants(read(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of each language's sources from each other, and their most raised terms."""
    return divergence.audit(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_simhash_near_dedup, op3_html_extraction, op4_chat_formatting, op5_language_id,
    op6_packing, op7_topk_search, op8_byte_bpe, op9_url_filters, op10_quality_rules, op11_lm_scoring,
    op12_spelling_variants, op13_source_divergence)}

SQL: dict[str, str] = {}

SQL["op7_topk_search"] = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

SQL["op9_url_filters"] = """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://')
    THEN regexp_replace(substr(url, instr(url, '://') + 3), '(?s)[?#].*', '') ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
    translate(CASE WHEN contains(rest, '/') THEN substr(rest, 1, instr(rest, '/') - 1) ELSE coalesce(rest, '') END,
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN contains(rest, '/') THEN substr(rest, instr(rest, '/')) ELSE '' END AS path
  FROM cut
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fitting AS (
  SELECT page_id, host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         max_by(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id, host, path
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p JOIN fitting f ON p.page_id IS NOT DISTINCT FROM f.page_id AND p.host = f.host AND p.path = f.path
"""

SQL["op13_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), occurring AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), counted AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM occurring GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n) AS n FROM counted GROUP BY lang, term HAVING sum(docs) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM d
), of_kept AS (
  SELECT c.lang, c.source, c.term, c.n FROM counted c JOIN kept k ON c.lang = k.lang AND c.term = k.term
), totals AS (
  SELECT lang, source, sum(n) AS total FROM of_kept GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, k.n AS n_lang, l.v, l.total AS total_lang,
    1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 1)) // (coalesce(t.total, 0) + l.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v)::HUGEINT AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
  LEFT JOIN totals t ON g.lang = t.lang AND g.source = t.source
  LEFT JOIN of_kept o ON g.lang = o.lang AND g.source = o.source AND k.term = o.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
