"""DuckDB SQL for each registered query (the independent oracle of the correctness gate).

Shared CTE fragments mirror the DataFrame definitions in ``rankloom.sources.tables``.
"""

from __future__ import annotations

TOK = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def tok(x: str) -> str:
    return TOK.format(x=x)


# BM25 over documents; queries from benchmark. Produces CTEs post, st, tm, qt, sc.
BM25_CTES = f"""
dt AS (SELECT doc_id AS key, {tok('text')} AS toks FROM documents),
post AS (SELECT term, key, dl, count(*) AS tf
         FROM (SELECT key, len(toks) AS dl, unnest(toks) AS term FROM dt) GROUP BY term, key, dl),
st AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n,
              (SELECT coalesce(sum(tf), 0) FROM post)::DOUBLE / (SELECT count(*) FROM documents)::DOUBLE AS avgdl),
tm0 AS (SELECT p.term, count(*) AS df,
               ln(any_value(st.n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS idf0
        FROM post p, st GROUP BY p.term),
tm AS (SELECT term, df, idf0,
              CASE WHEN idf0 < 0 THEN 0.25::DOUBLE * (SELECT avg(idf0) FROM tm0) ELSE idf0 END AS idf FROM tm0),
qt AS (SELECT query_id, term, count(*) AS qtf
       FROM (SELECT item_id AS query_id, unnest({tok('text')}) AS term FROM benchmark) GROUP BY query_id, term),
sc AS (SELECT q.query_id, p.key,
              sum(q.qtf * t.idf * (p.tf * 2.5::DOUBLE)
                  / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / st.avgdl))) AS score
       FROM qt q JOIN tm t ON q.term = t.term JOIN post p ON p.term = q.term, st
       GROUP BY q.query_id, p.key)
"""


def topk(src: str, group: str, score: str, key: str, k: int, rank: str = "rank") -> str:
    return (f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {group} "
            f"ORDER BY round({score}, 9) DESC, {key} ASC) AS {rank} FROM {src}) WHERE {rank} <= {k})")


HASH_DIM = 262144

# Hashing-encoder vectors of documents (hd) and benchmark passages (hq); dense scores (ds).
HV_CTES = f"""
hd0 AS (SELECT key, cast('0x' || substr(md5(t), 1, 8) AS BIGINT) % {HASH_DIM} AS bucket
        FROM (SELECT doc_id AS key, unnest({tok('text')}) AS t FROM documents)),
hd1 AS (SELECT key, bucket, count(*)::DOUBLE AS c FROM hd0 GROUP BY key, bucket),
hd AS (SELECT key, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY key)) AS weight FROM hd1),
hq0 AS (SELECT query_id, cast('0x' || substr(md5(t), 1, 8) AS BIGINT) % {HASH_DIM} AS bucket
        FROM (SELECT item_id AS query_id, unnest({tok('text')}) AS t FROM benchmark)),
hq1 AS (SELECT query_id, bucket, count(*)::DOUBLE AS c FROM hq0 GROUP BY query_id, bucket),
hq AS (SELECT query_id, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY query_id)) AS weight FROM hq1),
ds AS (SELECT q.query_id, d.key, sum(q.weight * d.weight) AS score
       FROM hq q JOIN hd d ON q.bucket = d.bucket GROUP BY q.query_id, d.key)
"""


def hybrid_ctes(n: int, alpha: float, name: str = "hy") -> str:
    """Fusion of ds (dense) and sc (BM25) into CTE {name}: top n by fused score."""
    a, b = repr(float(alpha)), repr(1.0 - float(alpha))
    return f"""
{name}_sem AS {topk('ds', 'query_id', 'score', 'key', 2 * n)},
{name}_bm AS {topk('(SELECT * FROM sc WHERE score > 0)', 'query_id', 'score', 'key', 2 * n)},
{name}_st AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM {name}_bm GROUP BY query_id),
{name}_fu AS (SELECT coalesce(s.query_id, b.query_id) AS query_id, coalesce(s.key, b.key) AS key,
                     s.score AS dense, b.score AS bm25
              FROM {name}_sem s FULL OUTER JOIN {name}_bm b ON s.query_id = b.query_id AND s.key = b.key),
{name}_fs AS (SELECT f.query_id, f.key, f.dense, f.bm25,
                     {a}::DOUBLE * coalesce(f.dense, 0::DOUBLE)
                     + {b}::DOUBLE * ((coalesce(f.bm25, 0::DOUBLE) - coalesce(t.lo, 0::DOUBLE))
                                      / CASE WHEN t.hi > t.lo THEN t.hi - t.lo ELSE 1::DOUBLE END) AS score
              FROM {name}_fu f LEFT JOIN {name}_st t ON f.query_id = t.query_id),
{name} AS {topk(f'{name}_fs', 'query_id', 'score', 'key', n)}
"""


def diversity_sql(src: str, group: str, category: str, k: int, m: int, rank: str = "rank") -> str:
    """Greedy diversity in its plain window form: tier = category rank > m; first k by tier, score."""
    return f"""(SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY {group}
                   ORDER BY CASE WHEN rc <= {m} THEN 0 ELSE 1 END, round(score, 9) DESC, key) AS {rank}
        FROM (SELECT *, row_number() OVER (PARTITION BY {group}, {category}
                         ORDER BY round(score, 9) DESC, key) AS rc FROM {src}))
      WHERE {rank} <= {k})"""


PART_CATALOG = """
pc AS (SELECT p_partkey AS key, p_name AS assessment_name,
              'https://catalog.example.com/view/' || replace(p_name, ' ', '-') || '-' || p_partkey::VARCHAR || '/' AS url,
              p_name || ' from ' || p_brand || ', a ' || lower(p_type) || ' item of size ' || p_size::VARCHAR AS description,
              CASE WHEN p_size > 45 THEN NULL ELSE p_size END::INTEGER AS duration_minutes,
              p_type AS test_type,
              CASE WHEN p_size % 3 = 0 THEN 'Yes' WHEN p_size % 3 = 1 THEN 'No' ELSE 'Unknown' END AS adaptive_support,
              CASE WHEN p_size = 1 THEN 'No' ELSE 'Yes' END AS remote_support,
              p_brand AS brand, p_retailprice AS price
       FROM part)
"""

# Documents as catalog rows (category = source; duration/adaptive by the page rules).
DOC_CATALOG = r"""
dc AS (SELECT doc_id AS key, 'https://docs.example.com/doc/' || doc_id::VARCHAR AS url, source AS test_type,
              CASE WHEN regexp_matches(text, '(?i)(\d+)\s*(?:minutes?|mins?)')
                     THEN try_cast(regexp_extract(text, '(?i)(\d+)\s*(?:minutes?|mins?)', 1) AS INTEGER)
                   WHEN regexp_matches(text, '(?i)Duration[:\s]+(\d+)')
                     THEN try_cast(regexp_extract(text, '(?i)Duration[:\s]+(\d+)', 1) AS INTEGER)
                   WHEN regexp_matches(text, '(?i)Time[:\s]+(\d+)')
                     THEN try_cast(regexp_extract(text, '(?i)Time[:\s]+(\d+)', 1) AS INTEGER) END AS duration_minutes,
              CASE WHEN contains(lower(text), 'adaptive') THEN 'Yes' ELSE 'No' END AS adaptive_support,
              'Yes' AS remote_support
       FROM documents)
"""


def or_default(x: str, default: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '{default}')"


RICH_TEXT = ("trim('Assessment Name: ' || {n} || '\nTitle: ' || {n} || '\nDescription: ' || "
             "substr({d}, 1, 600) || '\nType: ' || {t} || '\nCategory: ' || {t} || "
             "'\nDuration: ' || {m} || ' minutes\nRemote Testing Support: ' || {r} || "
             "'\nAdaptive Assessment (IRT): ' || {a} || '\nKeywords: ' || {n} || ', ' || {t} || "
             "', talent assessment, product catalog')").format(
    n=or_default("assessment_name", ""), d=or_default("description", ""), t=or_default("test_type", "N/A"),
    m=or_default("duration_minutes", "N/A"), r=or_default("remote_support", "No"), a=or_default("adaptive_support", "No"))

SQL = {
    "token_counts": f"""
        SELECT doc_id, len({tok('text')}) AS n_tokens, len(list_distinct({tok('text')})) AS n_distinct
        FROM documents""",
    "corpus_stats": f"""WITH {BM25_CTES}
        SELECT n::BIGINT AS n, round(avgdl, 6) AS avgdl, round((SELECT avg(idf0) FROM tm0), 6) AS avg_idf FROM st""",
    "term_idf": f"""
        WITH d AS (SELECT unnest(list_distinct({tok('text')})) AS term FROM documents),
        c AS (SELECT term, count(*) AS df FROM d GROUP BY term),
        n AS (SELECT count(*)::DOUBLE AS n FROM documents),
        i AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf0 FROM c, n),
        a AS (SELECT 0.25::DOUBLE * avg(idf0) AS least FROM i)
        SELECT term, df, round(CASE WHEN idf0 < 0 THEN least ELSE idf0 END, 6) AS idf FROM i, a""",
    "bm25_scores": f"""WITH {BM25_CTES} SELECT query_id, key AS doc_id, round(score, 6) AS score FROM sc""",
    "bm25_topk": f"""WITH {BM25_CTES}
        SELECT query_id, key AS doc_id, round(score, 6) AS score, rank
        FROM {topk('(SELECT * FROM sc WHERE score > 0)', 'query_id', 'score', 'key', 10)}""",
    "hash_vectors": f"""WITH {HV_CTES} SELECT key AS doc_id, bucket, round(weight, 6) AS weight FROM hd""",
    "hashed_similarity": f"""WITH {HV_CTES} SELECT query_id, key AS doc_id, round(score, 6) AS score FROM ds""",
    "l2_normalized": """
        WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
        n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e),
        x AS (SELECT vec_id, norm, unnest(v) AS c, generate_subscripts(v, 1) - 1 AS pos FROM n)
        SELECT vec_id, pos, round(CASE WHEN norm > 0 THEN c / norm ELSE c END, 6) AS value FROM x""",
    "vector_topk": f"""
        WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS key,
                          list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
                   FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
        SELECT query_id, key, round(score, 6) AS score, rank FROM {topk('p', 'query_id', 'score', 'key', 10)}""",
    "vector_manifest": """
        SELECT 'given-embeddings' AS model_name, max(len(embedding))::INTEGER AS dimension,
               count(*)::INTEGER AS num_assessments, 'exact_inner_product' AS index_type FROM embeddings""",
    "hybrid_topk": f"""WITH {BM25_CTES}, {HV_CTES}, {hybrid_ctes(30, 0.5)}
        SELECT query_id, key AS doc_id, round(dense, 6) AS dense, round(bm25, 6) AS bm25,
               round(score, 6) AS score, rank FROM hy""",
    "semantic_only_topk": f"""WITH {BM25_CTES}, {HV_CTES}, {hybrid_ctes(30, 1.0)}
        SELECT query_id, key AS doc_id, round(score, 6) AS score, rank FROM hy""",
    "retrieve_pipeline": f"""WITH {BM25_CTES}, {HV_CTES}, {hybrid_ctes(40, 0.6)}, {DOC_CATALOG},
        c AS (SELECT h.query_id, h.key, h.score, coalesce(dc.test_type, 'General Assessment') AS test_type
              FROM hy h JOIN dc ON h.key = dc.key)
        SELECT query_id, key AS doc_id, test_type AS category, round(score, 4) AS relevance_score, rank
        FROM {diversity_sql('c', 'query_id', 'test_type', 10, 4)}""",
    "diverse_topk": f"""WITH {PART_CATALOG},
        c AS (SELECT brand AS query_id, key, test_type, price AS score FROM pc)
        SELECT query_id AS brand, key, test_type, round(score, 6) AS score, rank
        FROM {diversity_sql('c', 'query_id', 'test_type', 15, 2)}""",
    "duration_filter": f"""WITH {PART_CATALOG}
        SELECT key, duration_minutes FROM pc
        WHERE duration_minutes IS NULL OR (duration_minutes <= 30 AND duration_minutes >= 10)""",
    "rich_text": f"""WITH {PART_CATALOG} SELECT key, {RICH_TEXT} AS text FROM pc""",
    "keyword_text": f"""WITH {PART_CATALOG}
        SELECT key, coalesce(assessment_name, '') || ' ' || coalesce(description, '') || ' ' || coalesce(test_type, '') AS text
        FROM pc""",
}


# ---- request side ------------------------------------------------------------------------
# Expected values, written out here so that the oracle shares nothing with the engine.
DURATIONS = [("(\\d+)\\s*min", 1), ("(\\d+)\\s*minute", 1), ("under\\s*(\\d+)", 1), ("less than\\s*(\\d+)", 1),
             ("within\\s*(\\d+)", 1), ("max.*?(\\d+)", 1), ("maximum.*?(\\d+)", 1), ("(\\d+)\\s*(?:hours?|hrs?)", 60)]
DOMAINS = ("cognitive personality behavioral situational technical aptitude skills java python sql sales leadership "
           "management english verbal numerical reasoning").split()
PROMPT = (
    "A request and a numbered catalog excerpt follow. Choose the {top_k} entries that serve the "
    "request best and answer with their numbers, best first, as one JSON array such as [4, 0, 7].\n\n"
    "Request:\n{query}\n\nCatalog excerpt:\n{candidates}\nJSON array of {top_k} numbers:")


def filters_sql(q: str) -> dict[str, str]:
    """Constraint expressions over the lower-cased text expression q."""
    whens = []
    for p, minutes in DURATIONS:
        v = f"(try_cast(regexp_extract({q}, '{p}', 1) AS INTEGER) * {minutes})"
        whens.append(f"WHEN regexp_matches({q}, '{p}') THEN {v}")
    dom = " ".join(f"WHEN contains({q}, '{k}') THEN '{k}'" for k in DOMAINS)
    return {"dl": "CASE " + " ".join(whens) + " END",
            "rt": f"CASE WHEN regexp_matches({q}, 'remote|online|virtual|home|proctor') THEN true END",
            "at": f"CASE WHEN regexp_matches({q}, 'adaptive|irt|item response|ai-powered') THEN true END",
            "tt": f"CASE {dom} END"}


def hard_filter_where(f: str, c: str) -> str:
    return (f"(coalesce({f}.dl, 0) = 0 OR {c}.duration_minutes IS NULL OR {c}.duration_minutes <= {f}.dl) "
            f"AND (NOT coalesce({f}.rt, false) OR coalesce({c}.remote_support = 'Yes', false)) "
            f"AND (NOT coalesce({f}.at, false) OR coalesce({c}.adaptive_support = 'Yes', false))")


ORDER_REQUESTS = """
orq AS (SELECT o_orderkey AS query_id,
               concat_ws(' ', lower(substr(o_orderpriority, 3, 100)),
                  ['java developer', 'sales lead', 'verbal reasoning', 'leadership', 'python and sql',
                   'customer service'][(o_custkey % 6) + 1],
                  'test',
                  ['within ' || d || ' min', 'under ' || d, d || ' minutes', 'max' || chr(10) || d,
                   ((o_custkey % 3) + 1)::VARCHAR || ' hours', 'about an hour'][(o_orderkey % 6) + 1],
                  CASE WHEN o_custkey % 4 = 0 THEN '' WHEN o_orderstatus = 'O' THEN 'remote'
                       WHEN o_orderstatus = 'F' THEN 'adaptive' ELSE 'virtual' END) AS query_text
        FROM (SELECT *, ((trunc(o_totalprice)::BIGINT % 90) + 10)::VARCHAR AS d FROM orders))
"""

ORDER_CANDIDATES = """
oc AS (SELECT l_orderkey AS query_id, l_partkey AS key, l_extendedprice AS score,
              row_number() OVER (PARTITION BY l_orderkey
                                 ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, l_suppkey) - 1 AS pos
       FROM lineitem)
"""

ORDER_REPLIES = """
orp AS (SELECT i.query_id,
               CASE WHEN o.o_orderstatus = 'P' THEN 'I could not rank these candidates.'
                    WHEN o.o_custkey % 5 = 0 THEN '[1, "a", ' || i.lst || ']'
                    ELSE 'Sure:' || chr(10) || '[' || i.lst || ', ' || i.p0::VARCHAR || ', 99]' END AS reply
        FROM (SELECT query_id, string_agg(pos::VARCHAR, ', ' ORDER BY key DESC, pos) AS lst, min(pos) AS p0
              FROM oc WHERE pos < 20 GROUP BY query_id) i
        JOIN orders o ON i.query_id = o.o_orderkey),
prs AS (SELECT query_id, regexp_extract(reply, '(?s)\\[.*?\\]', 0) AS s FROM orp),
pl AS (SELECT query_id,
              CASE WHEN regexp_full_match(s, '\\[\\s*\\]') THEN []::BIGINT[]
                   WHEN regexp_full_match(s, '\\[\\s*-?\\d+\\s*(,\\s*-?\\d+\\s*)*\\]')
                   THEN list_transform(string_split(regexp_replace(s, '[\\[\\]\\s]', '', 'g'), ','),
                                       lambda x: x::BIGINT) END AS idx
       FROM prs),
pex AS (SELECT query_id, ipos, idx FROM
          (SELECT query_id, unnest(idx) AS idx, generate_subscripts(idx, 1) - 1 AS ipos FROM pl WHERE idx IS NOT NULL))
"""


# The character references of the given pages, with or without their semicolon; '&' comes last.
REFERENCES = [("&copy;?", "©"), ("&middot;?", "·"), ("&quot;?", '"'), ("&lt;?", "<"), ("&gt;?", ">"), ("&amp;?", "&")]


def decoded_sql(x: str) -> str:
    for pattern, ch in REFERENCES:
        x = f"regexp_replace({x}, '{pattern}', '{ch}', 'g')"
    return x


def shown_sql(x: str) -> str:
    return (f"regexp_replace(regexp_replace({x}, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g'), "
            f"'(?s)<!--.*?-->', '', 'g')")


def strip_tags_sql(x: str) -> str:
    return decoded_sql(f"regexp_replace({shown_sql(x)}, '(?s)<[^>]*>', '', 'g')")


def html_to_text_sql(x: str, limit: int = 5000) -> str:
    lines = (f"string_split_regex({strip_tags_sql(x)}, "
             f"'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')")
    phr = f"flatten(list_transform({lines}, lambda l: string_split(trim(l), '  ')))"
    kept = f"list_filter(list_transform({phr}, lambda p: trim(p)), lambda p: length(p) > 0)"
    return f"substr(array_to_string({kept}, ' '), 1, {limit})"


CONV_REQUESTS = f"""
cr0 AS (SELECT c.conv_id::VARCHAR || '-' || c.turn::VARCHAR AS request_id, c.role = 'assistant' AS use_llm,
               CASE WHEN c.role = 'user' THEN c.text END AS query,
               CASE WHEN c.role = 'assistant' THEN c.text END AS jd_text,
               CASE WHEN c.role = 'system'
                    THEN coalesce(p.url, 'https://missing.example.com/' || c.conv_id::VARCHAR) END AS jd_url,
               ((c.conv_id + c.turn) % 22 + 1)::INTEGER AS top_k
        FROM conversations c LEFT JOIN pages p ON c.conv_id = p.page_id),
pgt AS (SELECT url AS jd_url, {html_to_text_sql('html')} AS page_text
        FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
cr1 AS (SELECT r.*, CASE WHEN r.jd_url IS NOT NULL AND length(r.jd_url) > 0 THEN coalesce(t.page_text, '')
                         ELSE coalesce(nullif(r.jd_text, ''), r.query) END AS final_text,
               CASE WHEN r.jd_url IS NOT NULL AND length(r.jd_url) > 0 THEN 'url'
                    WHEN length(coalesce(r.jd_text, '')) > 0 THEN 'jd_text' ELSE 'query' END AS source
        FROM cr0 r LEFT JOIN pgt t ON r.jd_url = t.jd_url),
cr AS (SELECT *, CASE WHEN final_text IS NULL OR length(final_text) = 0 THEN 'no input'
                      WHEN top_k IS NULL OR top_k < 1 OR top_k > 20 THEN 'top_k out of range' END AS reject_reason
       FROM cr1)
"""


def trunc_sql(x: str, n: int, collapse: bool = False) -> str:
    body = f"trim(regexp_replace({x}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))" if collapse else x
    return f"(substr({body}, 1, {n}) || CASE WHEN length({x}) > {n} THEN '...' ELSE '' END)"


def prompt_sql(query: str, context: str, top_k: int) -> str:
    parts = PROMPT.split("{")
    out = ["'" + parts[0].replace("'", "''") + "'"]
    for p in parts[1:]:
        key, rest = p.split("}", 1)
        out.append({"top_k": f"'{top_k}'", "query": f"substr({query}, 1, 1000)", "context": context,
                    "candidates": context}[key])
        out.append("'" + rest.replace("'", "''") + "'")
    return " || ".join(out)


_BF = filters_sql("lower(text)")
RECOMMEND_CTES = f"""{BM25_CTES}, {HV_CTES}, {hybrid_ctes(60, 0.6)}, {DOC_CATALOG},
rc AS (SELECT h.query_id, h.key, h.score, coalesce(dc.test_type, 'General Assessment') AS test_type,
              dc.duration_minutes, dc.adaptive_support, dc.remote_support, dc.url
       FROM hy h JOIN dc ON h.key = dc.key),
rt AS {diversity_sql('rc', 'query_id', 'test_type', 40, 4)},
bf AS (SELECT item_id AS query_id, {_BF['dl']} AS dl, {_BF['rt']} AS rt, {_BF['at']} AS at FROM benchmark),
rk AS (SELECT rt.*, round(rt.score, 4) AS relevance_score,
              row_number() OVER (PARTITION BY rt.query_id ORDER BY rt.rank) AS rank2
       FROM rt JOIN bf ON rt.query_id = bf.query_id WHERE {hard_filter_where('bf', 'rt')}),
rec AS (SELECT query_id, rank2 AS rank, key, relevance_score, url FROM rk WHERE rank2 <= 10)
"""

# The request path over conversations: the same retrieval with the valid requests as queries.
ANSWER_CTES = f"""{CONV_REQUESTS},
reqq AS (SELECT request_id AS item_id, final_text AS text, top_k, use_llm FROM cr WHERE reject_reason IS NULL),
{RECOMMEND_CTES.replace('benchmark', 'reqq')},
ans0 AS (SELECT rk.query_id, rk.key, rk.url, rk.relevance_score, rk.rank2 - 1 AS pos, q.top_k, q.text,
                CASE WHEN q.use_llm THEN list_position([q.top_k, 0, 3], rk.rank2 - 1) END AS place
         FROM rk JOIN reqq q ON rk.query_id = q.item_id),
ans1 AS (SELECT *, CASE WHEN place > 0 AND pos < 20
                        THEN row_number() OVER (PARTITION BY query_id, place > 0 AND pos < 20 ORDER BY place) - 1 END AS new_pos
         FROM ans0),
ans AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY new_pos ASC NULLS LAST, pos) AS rank FROM ans1)
"""
ANSWERS = f"""WITH {ANSWER_CTES}
    SELECT query_id AS request_id, {trunc_sql('text', 200)} AS query, rank, key AS doc_id, url,
           round(CASE WHEN new_pos IS NULL THEN relevance_score ELSE 0.99::DOUBLE - 0.01::DOUBLE * new_pos END, 6) AS relevance_score,
           new_pos IS NOT NULL AS reranked
    FROM ans WHERE rank <= top_k"""

TRUTH_CTES = """
tr AS (SELECT DISTINCT b.item_id AS query_id, d.doc_id AS item
       FROM benchmark b JOIN documents d ON instr(d.text, b.text) > 0),
gt AS (SELECT query_id, count(*) AS total_gt, count(DISTINCT item) AS gtd FROM tr GROUP BY query_id),
hits AS (SELECT p.query_id, count(*) AS found
         FROM (SELECT DISTINCT query_id, key AS item FROM rec) p
         WHERE EXISTS (SELECT 1 FROM tr t WHERE t.query_id = p.query_id AND t.item = p.item)
         GROUP BY p.query_id),
pq AS (SELECT gt.query_id, CASE WHEN gtd = 0 THEN 0::DOUBLE ELSE coalesce(found, 0) / gtd END AS recall,
              coalesce(found, 0) / 10 AS precision, coalesce(found, 0)::BIGINT AS found, total_gt::BIGINT AS total_gt
       FROM gt LEFT JOIN hits ON gt.query_id = hits.query_id)
"""

_OF = filters_sql("lower(query_text)")
SQL.update({
    "query_filters": f"""WITH {ORDER_REQUESTS}
        SELECT query_id, {_OF['dl']} AS duration_limit, {_OF['rt']} AS remote_testing,
               {_OF['at']} AS adaptive_testing, {_OF['tt']} AS test_type FROM orq""",
    "hard_filter": f"""WITH {PART_CATALOG}, {ORDER_REQUESTS}, {ORDER_CANDIDATES},
        f AS (SELECT query_id, {_OF['dl']} AS dl, {_OF['rt']} AS rt, {_OF['at']} AS at FROM orq),
        c AS (SELECT oc.query_id, oc.key, oc.pos, pc.duration_minutes, pc.remote_support, pc.adaptive_support
              FROM oc JOIN pc ON oc.key = pc.key)
        SELECT c.query_id, c.key, c.pos FROM c JOIN f ON c.query_id = f.query_id WHERE {hard_filter_where('f', 'c')}""",
    "request_choice": f"""WITH {CONV_REQUESTS}
        SELECT request_id, source, length(final_text) AS n_chars, {trunc_sql('final_text', 200)} AS query
        FROM cr WHERE reject_reason IS NULL""",
    "request_reject": f"""WITH {CONV_REQUESTS} SELECT request_id, reject_reason FROM cr WHERE reject_reason IS NOT NULL""",
    "prompt_context": f"""WITH {PART_CATALOG}, {ORDER_CANDIDATES},
        ln AS (SELECT oc.query_id, oc.pos,
                      '[' || oc.pos::VARCHAR || '] Name: ' || coalesce(pc.assessment_name, 'None') || ' | Type: '
                      || coalesce(pc.test_type, 'N/A') || ' | Desc: '
                      || replace(substr(coalesce(pc.description, ''), 1, 200), chr(10), ' ') || chr(10) AS line
               FROM oc JOIN pc ON oc.key = pc.key WHERE oc.pos < 20)
        SELECT query_id, string_agg(line, '' ORDER BY pos) AS context FROM ln GROUP BY query_id""",
    "parse_rankings": f"""WITH {ORDER_CANDIDATES}, {ORDER_REPLIES} SELECT query_id, ipos, idx FROM pex""",
    "apply_rankings": f"""WITH {ORDER_CANDIDATES}, {ORDER_REPLIES},
        acc AS (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY ipos) - 1 AS new_pos
                FROM (SELECT e.query_id, e.idx AS pos, min(e.ipos) AS ipos
                      FROM pex e JOIN (SELECT DISTINCT query_id, pos FROM oc WHERE pos < 20) p
                        ON e.query_id = p.query_id AND e.idx = p.pos
                      GROUP BY e.query_id, e.idx)),
        r AS (SELECT c.query_id, c.key, a.new_pos IS NOT NULL AS reranked,
                     CASE WHEN a.new_pos IS NOT NULL THEN 0.99::DOUBLE - 0.01::DOUBLE * a.new_pos ELSE c.score END AS score,
                     row_number() OVER (PARTITION BY c.query_id ORDER BY a.new_pos ASC NULLS LAST, c.pos ASC) AS rank
              FROM oc c LEFT JOIN acc a ON c.query_id = a.query_id AND c.pos = a.pos)
        SELECT query_id, rank, key, round(score, 6) AS score, reranked FROM r WHERE rank <= 5""",
    "recommend_batch": f"""WITH {RECOMMEND_CTES}
        SELECT query_id, rank, key AS doc_id, round(relevance_score, 6) AS relevance_score FROM rec""",
    "stream_recommend": f"""WITH {RECOMMEND_CTES}
        SELECT query_id, rank, key AS doc_id, round(relevance_score, 6) AS relevance_score FROM rec""",
    "recommend_requests": ANSWERS,
    "stream_requests": ANSWERS,
    "containment_truth": """SELECT DISTINCT b.item_id AS query_id, d.doc_id
        FROM benchmark b JOIN documents d ON instr(d.text, b.text) > 0""",
    "recall_at_k": f"""WITH {RECOMMEND_CTES}, {TRUTH_CTES}
        SELECT query_id, round(recall, 6) AS recall, found, total_gt FROM pq""",
    "precision_at_k": f"""WITH {RECOMMEND_CTES}, {TRUTH_CTES}
        SELECT query_id, round(precision, 6) AS precision FROM pq""",
    "eval_summary": f"""WITH {RECOMMEND_CTES}, {TRUTH_CTES}
        SELECT round(avg(recall), 6) AS mean_recall, round(avg(precision), 6) AS mean_precision,
               sum(found)::BIGINT AS total_found, sum(total_gt)::BIGINT AS total_ground_truth,
               count(*) AS num_queries FROM pq""",
    "query_split": """
        WITH u AS (SELECT text AS query_text, conv_id, turn FROM conversations),
        f AS (SELECT query_text, conv_id, turn
              FROM (SELECT *, row_number() OVER (PARTITION BY query_text ORDER BY conv_id, turn) AS rn FROM u)
              WHERE rn = 1),
        h AS (SELECT query_text FROM f ORDER BY conv_id, turn LIMIT 10)
        SELECT query_text, conv_id, turn,
               CASE WHEN (SELECT count(*) FROM f) > 10 AND query_text IN (SELECT query_text FROM h)
                    THEN 'train' ELSE 'test' END AS split
        FROM f""",
    "prediction_rows": f"""WITH {RECOMMEND_CTES},
        bq AS (SELECT text AS query_text, min(item_id) AS first_id FROM benchmark GROUP BY text),
        tq AS (SELECT query_text FROM bq
               WHERE (SELECT count(*) FROM bq) <= 10
                  OR query_text NOT IN (SELECT query_text FROM bq ORDER BY first_id LIMIT 10))
        SELECT {trunc_sql('b.text', 150, collapse=True)} AS "Query", rec.url AS "Assessment_url"
        FROM rec JOIN benchmark b ON rec.query_id = b.item_id WHERE b.text IN (SELECT query_text FROM tq)""",    "prediction_preview": f"""WITH {RECOMMEND_CTES},
        bq AS (SELECT text AS query_text, min(item_id) AS first_id FROM benchmark GROUP BY text),
        tq AS (SELECT query_text FROM bq
               WHERE (SELECT count(*) FROM bq) <= 10
                  OR query_text NOT IN (SELECT query_text FROM bq ORDER BY first_id LIMIT 10))
        SELECT {trunc_sql('b.text', 150, collapse=True)} AS "Query", rec.url AS "Assessment_url"
        FROM rec JOIN benchmark b ON rec.query_id = b.item_id WHERE b.text IN (SELECT query_text FROM tq)
        ORDER BY rec.query_id, rec.rank LIMIT 5""",
})
SQL["prompt_text"] = f"""WITH {PART_CATALOG}, {ORDER_REQUESTS}, {ORDER_CANDIDATES},
        ln AS (SELECT oc.query_id, oc.pos,
                      '[' || oc.pos::VARCHAR || '] Name: ' || coalesce(pc.assessment_name, 'None') || ' | Type: '
                      || coalesce(pc.test_type, 'N/A') || ' | Desc: '
                      || replace(substr(coalesce(pc.description, ''), 1, 200), chr(10), ' ') || chr(10) AS line
               FROM oc JOIN pc ON oc.key = pc.key WHERE oc.pos < 20),
        cx AS (SELECT query_id, string_agg(line, '' ORDER BY pos) AS context FROM ln GROUP BY query_id)
        SELECT orq.query_id, {prompt_sql('orq.query_text', 'cx.context', 10)} AS prompt
        FROM orq JOIN cx ON orq.query_id = cx.query_id"""


# ---- pages -----------------------------------------------------------------------------
CATEGORIES = [("Technical Skills", "java|python|javascript|sql|coding|programming|developer|software"),
              ("Personality Assessment", "personality|opq|behavioral|behavior"),
              ("Leadership", "leadership|manager|executive|director|supervisor"),
              ("Cognitive Ability", "verbal|numerical|reasoning|cognitive|aptitude|logic"),
              ("Behavioral Skills", "sales|communication|customer|service")]
DEFAULT_CATEGORY = "General Assessment"
PAGE_DURATIONS = ["(?i)(\\d+)\\s*(?:minutes?|mins?)", "(?i)Duration[:\\s]+(\\d+)", "(?i)Time[:\\s]+(\\d+)"]


def title_sql(x: str) -> str:
    """Each run of letters that have case: first upper, rest lower."""
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+'), "
            f"lambda w: CASE WHEN substr(w, 1, 1) = 'ß' THEN 'Ss' ELSE upper(substr(w, 1, 1)) END "
            f"|| lower(substr(w, 2))), '')")


def slug_sql(x: str, lower: bool = True) -> str:
    s = f"regexp_extract(regexp_replace({x}, '/+$', ''), '[^/]*$', 0)"
    return f"coalesce({'lower(' + s + ')' if lower else s}, '')"


def slug_name_sql(x: str, scraper: bool = True) -> str:
    s = title_sql(f"translate({slug_sql(x, False)}, '-_', '  ')")
    if scraper:
        s = f"trim(replace(replace(replace({s}, '%28', '('), '%29', ')'), ' New', ''))"
    return s


def category_sql(name: str, text: str) -> str:
    whens = []
    for cat, pat in CATEGORIES:
        whens.append(f"WHEN coalesce(regexp_matches(lower({name}), '{pat}'), false) "
                     f"OR coalesce(regexp_matches(lower({text}), '{pat}'), false) THEN '{cat}'")
    return "CASE " + " ".join(whens) + f" ELSE '{DEFAULT_CATEGORY}' END"


def text_duration_sql(t: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({t}, '{p}') THEN try_cast(regexp_extract({t}, '{p}', 1) AS INTEGER)"
                     for p in PAGE_DURATIONS)
    return f"CASE {whens} END"


def element_text_sql(h: str, tag: str) -> str:
    inner = f"regexp_extract({h}, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1)"
    return f"CASE WHEN regexp_matches({h}, '(?is)<{tag}\\b') THEN trim({strip_tags_sql(inner)}) END"


_KLASS = "regexp_extract(html, '(?is)<[a-z0-9]+\\b[^>]*class=\"[^\"]*\\bproduct-title\\b[^\"]*\"[^>]*>(.*?)</', 1)"
_CHOSEN = (f"CASE WHEN regexp_matches(html, '(?is)<h1\\b') THEN {element_text_sql('html', 'h1')} "
           f"WHEN regexp_matches(html, '(?is)class=\"[^\"]*\\bproduct-title\\b') THEN trim({strip_tags_sql(_KLASS)}) "
           f"WHEN regexp_matches(html, '(?is)<title\\b') THEN trim(split_part({element_text_sql('html', 'title')}, '|', 1)) END")
_PARAS = (f"list_transform(regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p\\s*>', 1), "
          f"lambda p: trim({strip_tags_sql('p')}))")
_META = "regexp_extract(html, '(?is)<meta\\b[^>]*name=\"description\"[^>]*content=\"([^\"]*)\"', 1)"

PAGE_RECORDS = f"""
pr0 AS (SELECT page_id, url, html, {strip_tags_sql('html')} AS ptext, {_CHOSEN} AS chosen FROM pages),
pr1 AS (SELECT page_id, url, html, ptext,
               CASE WHEN coalesce(length(chosen), 0) > 0 THEN chosen ELSE {slug_name_sql('url')} END AS nm
        FROM pr0),
precs AS (SELECT page_id,
                 CASE WHEN ok THEN nm ELSE {slug_name_sql('url')} END AS assessment_name, url,
                 CASE WHEN ok THEN coalesce(nullif({_META}, ''),
                                           substr(list_filter({_PARAS}, lambda p: length(p) > 50)[1], 1, 500),
                                           'Talent assessment for evaluating candidate capabilities')
                      ELSE 'Error extracting details' END AS description,
                 CASE WHEN ok THEN {text_duration_sql('ptext')} END AS duration_minutes,
                 CASE WHEN ok THEN {category_sql('nm', 'ptext')} ELSE '{DEFAULT_CATEGORY}' END AS test_type,
                 CASE WHEN ok THEN (CASE WHEN contains(lower(ptext), 'adaptive') THEN 'Yes' ELSE 'No' END)
                      ELSE 'Unknown' END AS adaptive_support,
                 'Yes' AS remote_support,
                 CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status
          FROM (SELECT *, html IS NOT NULL AND contains(html, '<') AS ok FROM pr1))
"""

# The given pages' links are double-quoted hrefs of <a> elements that start at the site's root.
PAGE_LINKS = f"""
hr AS (SELECT page_id, url AS page_url,
              unnest(regexp_extract_all({shown_sql('html')}, '(?i)<a [^>]*href="([^"]*)"', 1)) AS href FROM pages),
pl AS (SELECT DISTINCT page_id, regexp_extract(page_url, '^[a-z]+://[^/?#]+', 0) || {decoded_sql('href')} AS url
       FROM hr WHERE starts_with(href, '/'))
"""

CATS = ", ".join(["assessment_name", "url", "description", "duration_minutes", "test_type",
                  "adaptive_support", "remote_support"])

SQL.update({
    "page_links": f"WITH {PAGE_LINKS} SELECT page_id, url FROM pl",
    "new_links_per_page": f"""WITH {PAGE_LINKS},
        f AS (SELECT url, min(page_id) AS first_page FROM pl GROUP BY url)
        SELECT pl.page_id, count(*) AS n_links, count(*) FILTER (WHERE pl.page_id = f.first_page) AS n_new
        FROM pl JOIN f ON pl.url = f.url GROUP BY pl.page_id""",
    "crawl_cutoff": """
        WITH cl AS (SELECT user_id AS type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page,
                           (floor(value)::BIGINT % 4) AS n_links FROM events),
        e AS (SELECT *, sum(CASE WHEN n_links = 0 THEN 1 ELSE 0 END)
                        OVER (PARTITION BY type ORDER BY page ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run3 FROM cl),
        s AS (SELECT type, min(page) AS stop_page FROM e WHERE run3 = 3 GROUP BY type)
        SELECT cl.type, cl.page, cl.n_links FROM cl LEFT JOIN s ON cl.type = s.type
        WHERE s.stop_page IS NULL OR cl.page <= s.stop_page""",
    "page_records": f"WITH {PAGE_RECORDS} SELECT page_id, {CATS}, status FROM precs",
    "page_text": f"SELECT page_id, {html_to_text_sql('html')} AS text FROM pages",
    "keyword_category": f"SELECT doc_id, {category_sql(chr(39) * 2, 'text')} AS test_type FROM documents",
    "url_slugs": f"SELECT page_id, {slug_sql('url')} AS slug FROM pages",
    "slug_names": f"SELECT page_id, {slug_name_sql('url')} AS name FROM pages",
    "merge_catalog": f"""WITH {PAGE_RECORDS}, {PAGE_LINKS},
        du AS (SELECT DISTINCT url FROM pl),
        ms AS (SELECT url FROM du WHERE url NOT IN (SELECT url FROM precs WHERE url IS NOT NULL)),
        allr AS (SELECT {CATS}, 0 AS prio, page_id::BIGINT AS ord FROM precs
                 UNION ALL
                 SELECT {slug_name_sql('url', False)} AS assessment_name, url, 'Talent assessment' AS description,
                        NULL::INTEGER AS duration_minutes, '{DEFAULT_CATEGORY}' AS test_type,
                        'Unknown' AS adaptive_support, 'Yes' AS remote_support, 1 AS prio, 0::BIGINT AS ord FROM ms)
        SELECT {CATS}, CASE WHEN prio = 0 THEN 'current_scrape' ELSE 'dataset_urls' END AS source
        FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY prio, ord) AS rn FROM allr) WHERE rn = 1""",
    "source_counts": f"""WITH {PAGE_RECORDS}, {PAGE_LINKS}
        SELECT 'current_scrape' AS source, count(*) AS n FROM precs
        UNION ALL SELECT 'dataset_urls' AS source, count(DISTINCT url) AS n FROM pl""",
    "catalog_profile": f"""WITH {PART_CATALOG}
        SELECT count(*) AS total, count(DISTINCT url) AS unique_urls,
               count(*) FILTER (WHERE duration_minutes IS NOT NULL AND duration_minutes <> 0) AS with_duration,
               count(*) FILTER (WHERE adaptive_support = 'Yes') AS adaptive_yes,
               count(*) FILTER (WHERE remote_support = 'Yes') AS remote_yes FROM pc""",
    "category_counts": f"WITH {PART_CATALOG} SELECT test_type, count(*) AS count FROM pc GROUP BY test_type",
    "threshold_check": f"""WITH {PART_CATALOG}, n AS (SELECT count(*) AS total FROM pc)
        SELECT total, 377 AS required, CASE WHEN total >= 377 THEN 'ok' ELSE 'gap' END AS status,
               CASE WHEN total >= 377 THEN total - 377 ELSE 0 END AS surplus,
               CASE WHEN total < 377 THEN 377 - total ELSE 0 END AS gap,
               round(total / 377 * 100, 1) AS percent FROM n""",
    "head_sample": f"""WITH {PART_CATALOG}
        SELECT key, assessment_name, url, test_type FROM pc ORDER BY key LIMIT 5""",
    "extraction_counts": f"""WITH {PAGE_RECORDS}
        SELECT count(*) FILTER (WHERE status = 'ok') AS successful,
               count(*) FILTER (WHERE status = 'failed') AS failed FROM precs""",
    "display_rows": f"""WITH {PART_CATALOG}
        SELECT key, CASE WHEN duration_minutes IS NULL OR duration_minutes = 0 THEN 'N/A'
                         ELSE duration_minutes::VARCHAR || ' min' END AS duration,
               printf('%.3f', price) AS score FROM pc""",
    "result_sizes": f"""WITH {RECOMMEND_CTES},
        n AS (SELECT query_id, count(*) AS c FROM rec GROUP BY query_id)
        SELECT b.item_id AS query_id, coalesce(n.c, 0) AS total_results
        FROM benchmark b LEFT JOIN n ON b.item_id = n.query_id""",
})


# ---- labelled evaluation, catalog search, written and reread tables ------------------------
LABELLED_CTES = f"""{RECOMMEND_CTES},
tr AS (SELECT DISTINCT b.item_id, b.text, d.doc_id FROM benchmark b JOIN documents d ON instr(d.text, b.text) > 0),
firsts AS (SELECT text, row_number() OVER (ORDER BY min(item_id)) AS query_id, min(item_id) AS item_id FROM tr GROUP BY text
           ORDER BY min(item_id) LIMIT 10),
la AS (SELECT f.query_id, tr.text, tr.doc_id FROM tr JOIN firsts f ON tr.text = f.text),
pos AS (SELECT f.query_id, rk.key, CASE rk.rank2 WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS tier, rk.rank2
        FROM rk JOIN firsts f ON rk.query_id = f.item_id),
best AS (SELECT query_id, key FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank2) AS r FROM pos) WHERE r <= 10),
lpq AS (SELECT la.query_id, any_value(la.text) AS text, count(*) AS total_gt, count(DISTINCT la.doc_id) AS distinct_gt,
               count(DISTINCT best.key) AS found
        FROM la LEFT JOIN best ON la.query_id = best.query_id AND la.doc_id = best.key GROUP BY la.query_id),
lev AS (SELECT query_id, substr(text, 1, 80) || CASE WHEN length(text) > 80 THEN '...' ELSE '' END AS query,
               found / distinct_gt AS recall, found / 10 AS precision, found, total_gt FROM lpq)
"""
LABELLED_URLS = """
    SELECT b.text AS "Query", CASE d.doc_id % 3 WHEN 0 THEN u || '/' WHEN 1 THEN upper(u) ELSE u END AS "Assessment_url"
    FROM (SELECT *, 'https://docs.example.com/doc/' || doc_id::VARCHAR AS u FROM documents) d
    JOIN benchmark b ON instr(d.text, b.text) > 0"""
CATALOG_CTES = f"""{PART_CATALOG},
brand_q AS (SELECT min(p_partkey) AS item_id, arg_min(p_name, p_partkey) || ' ' || p_brand || ' ' || arg_min(p_type, p_partkey) AS text
            FROM part GROUP BY p_brand),
kw_docs AS (SELECT key AS doc_id, coalesce(assessment_name, '') || ' ' || coalesce(description, '') || ' ' || coalesce(test_type, '') AS text
            FROM pc),
rich_docs AS (SELECT key AS doc_id, {RICH_TEXT} AS text FROM pc),
{BM25_CTES.replace('documents', 'kw_docs').replace('benchmark', 'brand_q')},
{HV_CTES.replace('documents', 'rich_docs').replace('benchmark', 'brand_q')}, {hybrid_ctes(10, 0.5)}
"""
SQL.update({
    "label_evaluation": f"""WITH {LABELLED_CTES} SELECT query_id, query, round(recall, 6) AS recall,
        round(precision, 6) AS precision, found, total_gt FROM lev""",
    "label_summary": f"""WITH {LABELLED_CTES},
        m AS (SELECT round(avg(recall), 6) AS mean_recall, round(avg(precision), 6) AS mean_precision, sum(found)::BIGINT AS total_found,
                     sum(total_gt)::BIGINT AS total_ground_truth, count(*) AS num_queries FROM lev)
        SELECT *, CASE WHEN mean_recall >= 0.6 THEN 'success' WHEN mean_recall >= 0.5 THEN 'good' ELSE 'warning' END AS band FROM m""",
    "evaluation_report": f"""WITH {LABELLED_CTES} SELECT (SELECT count(*) FROM lev) AS num_queries, query,
        round(recall, 6) AS recall, found, total_gt FROM lev""",
    "catalog_search": f"""WITH {CATALOG_CTES}
        SELECT query_id, key, round(dense, 6) AS dense, round(bm25, 6) AS bm25, round(score, 6) AS score, rank FROM hy""",
    "catalog_json": f"""WITH {PART_CATALOG} SELECT {CATS} FROM pc""",
    "labelled_csv": LABELLED_URLS,
    "vector_table": """SELECT vec_id AS key, len(embedding) AS dimension,
        round(list_sum([x::DOUBLE for x in embedding]), 5) AS total FROM embeddings""",
    "encoder_vectors": """WITH c AS (SELECT doc_id, (length(text) - length(replace(text, 'a', '')))::DOUBLE AS a,
            (length(text) - length(replace(text, 'e', '')))::DOUBLE AS e,
            (length(text) - length(replace(text, 'n', '')) + 1)::DOUBLE AS n FROM documents)
        SELECT doc_id, round(a / sqrt(a*a + e*e + n*n), 4) AS v0, round(e / sqrt(a*a + e*e + n*n), 4) AS v1,
               round(n / sqrt(a*a + e*e + n*n), 4) AS v2 FROM c""",
    "index_reload": SQL["bm25_topk"],
    "display_recommendations": f"""WITH {RECOMMEND_CTES}
        SELECT rec.query_id, rec.rank, rec.url, CASE WHEN dc.duration_minutes IS NULL OR dc.duration_minutes = 0 THEN 'N/A'
               ELSE dc.duration_minutes::VARCHAR || ' min' END AS duration, printf('%.3f', rec.relevance_score) AS score
        FROM rec JOIN dc ON rec.key = dc.key""",
    "catalog_build": SQL["merge_catalog"].replace(f"SELECT {CATS}, CASE WHEN prio = 0 THEN 'current_scrape' ELSE 'dataset_urls' END AS source",
                                                  f"SELECT {CATS}"),
})

# ---- the same rows by another way --------------------------------------------------------
CRAWL = f"""
ct AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]+)', 1) AS type FROM pages),
cl AS (SELECT type, page_id, row_number() OVER (PARTITION BY type ORDER BY page_id) AS page FROM ct WHERE type <> ''),
hr AS (SELECT page_id, url AS page_url,
              unnest(regexp_extract_all({shown_sql('html')}, '(?i)<a [^>]*href="([^"]*)"', 1)) AS href FROM pages),
mk AS (SELECT DISTINCT page_id, regexp_extract(page_url, '^[a-z]+://[^/?#]+', 0) || {decoded_sql('href')} AS url
       FROM hr WHERE starts_with(href, '/') AND contains({decoded_sql('href')}, 't')),
nl AS (SELECT cl.type, cl.page, cl.page_id, count(mk.url) AS n_links
       FROM cl LEFT JOIN mk ON cl.page_id = mk.page_id GROUP BY ALL),
rd AS (SELECT type, page, page_id, n_links, CASE WHEN n_links = 0 THEN 1 ELSE 0 END AS run FROM nl WHERE page = 1
       UNION ALL
       SELECT nl.type, nl.page, nl.page_id, nl.n_links, CASE WHEN nl.n_links = 0 THEN rd.run + 1 ELSE 0 END
       FROM rd JOIN nl ON nl.type = rd.type AND nl.page = rd.page + 1 WHERE rd.run < 3)
"""
CRAWL_ROUND = "floor(log2((page - 1) / 8.0 + 1))::INTEGER"
SQL.update({
    "pruned_topk": SQL["bm25_topk"],
    "cell_topk": SQL["vector_topk"],
    "parsed_text": SQL["page_text"],
    "crawl_reads": f"""WITH RECURSIVE {CRAWL}
        SELECT type, page::INTEGER AS page, page_id, n_links, {CRAWL_ROUND} AS round FROM rd""",
    "crawl_rounds": f"""WITH RECURSIVE {CRAWL},
        fi AS (SELECT url, min(struct_pack(page := page, type := type)) AS f
               FROM rd JOIN mk ON rd.page_id = mk.page_id GROUP BY url),
        fp AS (SELECT url, f.type AS type, f.page AS page FROM fi)
        SELECT url, type, page::INTEGER AS page, {CRAWL_ROUND} AS round FROM fp""",
    "ranker_replies": f"""SELECT query_id, 'I choose [' || (length(prompt) % 20)::VARCHAR || '].' AS reply
        FROM ({SQL['prompt_text']})""",
})
