"""DuckDB SQL for every registered query (the correctness oracle).

The SQL is written independently of the Spark plans: windows instead of partial
aggregates, ``row_number`` instead of ``min(struct)``, DuckDB's JSON functions
instead of the VARIANT parsers, a recursive CTE instead of pointer doubling.
Only the fixed regular-expression classes are shared (RE2 and Java agree on them).
"""

from __future__ import annotations

from threadscope.functions.labels import LABEL_NAMES
from threadscope.functions.text import EMOJI_PATTERN, URL_PATTERN, WS_CLASS

WS = WS_CLASS


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def clean(x: str) -> str:
    return collapse(f"lower(regexp_replace(regexp_replace(coalesce({x}, ''), '{URL_PATTERN}', ' ', 'g'), "
                    f"'{EMOJI_PATTERN}', ' ', 'g'))")


def one_line(x: str) -> str:
    return trim_ws(f"replace(coalesce({x}, ''), chr(10), ' ')")


def shorten(x: str, w: int, always: bool) -> str:
    s = collapse(f"coalesce({x}, '')")
    head = f"regexp_extract(substring({s}, 1, {w - 3}), '^(.*) ', 1)"
    short = f"(CASE WHEN length({s}) <= {w} THEN {s} WHEN {head} = '' THEN '(…)' ELSE {head} || ' (…)' END)"
    if always:
        return short
    return f"(CASE WHEN length(coalesce({x}, '')) <= {w} THEN coalesce({x}, '') ELSE {short} END)"


ENG = ("coalesce(value, 0) + ln(1 + coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0))")


def high_signal(group: str, min_rows: int) -> str:
    return f"""
WITH e AS (
  SELECT {group} AS g, event_id, {ENG} AS engagement
  FROM events
  WHERE lower(coalesce(CAST(user_id AS VARCHAR), '')) NOT IN ('[deleted]', '[removed]', '')
), r AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY engagement DESC, event_id) AS rn,
         count(*) OVER (PARTITION BY g) AS n
  FROM e)
SELECT g AS {group}, event_id, round(engagement, 6) AS engagement
FROM r WHERE n >= {min_rows} AND rn <= least(20, greatest(1, ceil(n * 10 / 100)))"""


LATENCY_CTE = """
c AS (SELECT l_orderkey, min(CAST(epoch(l_shipdate) AS BIGINT)) AS f, max(CAST(epoch(l_shipdate) AS BIGINT)) AS l
      FROM lineitem GROUP BY l_orderkey),
x AS (SELECT o.o_orderkey, o.o_orderpriority, o.o_orderstatus, CAST(epoch(o.o_orderdate) AS BIGINT) AS created, c.f, c.l,
             CASE WHEN c.f IS NOT NULL AND c.f <> 0 THEN c.f - CAST(epoch(o.o_orderdate) AS BIGINT) END AS latency_sec,
             CASE WHEN c.f IS NOT NULL AND c.f <> 0
                  THEN CAST(c.f - CAST(epoch(o.o_orderdate) AS BIGINT) AS DOUBLE) / 60 END AS latency_min
      FROM orders o LEFT JOIN c ON o.o_orderkey = c.l_orderkey)"""

LABEL_SETS_CTE = f"""
va AS (SELECT d.source, d.doc_id,
              concat_ws(';', CASE WHEN l.quality = 1 THEN 'clinical' END, CASE WHEN l.toxic = 1 THEN 'off_topic' END)
              AS labels
       FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
vb AS (SELECT source, doc_id, CASE WHEN n_chars < 500 THEN 'experience' WHEN n_chars < 2000 THEN 'clinical;news'
                                   WHEN n_chars < 4000 THEN 'news;news' ELSE '' END AS labels
       FROM documents),
vc AS (SELECT source, doc_id, CASE lang WHEN 'en' THEN 'clinical' WHEN 'fr' THEN 'off_topic;clinical'
                                        WHEN 'de' THEN 'experience; clinical' END AS labels FROM documents),
long AS (SELECT source, doc_id, labels, 'A' AS model FROM va UNION ALL
         SELECT source, doc_id, labels, 'B' FROM vb UNION ALL
         SELECT source, doc_id, labels, 'C' FROM vc),
present AS (SELECT source, doc_id FROM long GROUP BY source, doc_id HAVING count(DISTINCT model) = 3),
votes AS (SELECT source, doc_id, {trim_ws('x')} AS label
          FROM (SELECT source, doc_id, unnest(string_split(coalesce(labels, ''), ';')) AS x FROM long)),
counted AS (SELECT source, doc_id, label, count(*) AS n FROM votes WHERE label <> '' GROUP BY source, doc_id, label),
winners AS (SELECT source, doc_id, string_agg(label, ';' ORDER BY label) AS consensus_labels
            FROM counted WHERE n >= 2 GROUP BY source, doc_id),
cons AS (SELECT p.source, p.doc_id, coalesce(w.consensus_labels, '') AS consensus_labels
         FROM present p LEFT JOIN winners w ON p.source = w.source AND p.doc_id = w.doc_id)"""

ALLOWED = "[" + ", ".join(f"'{x}'" for x in LABEL_NAMES) + "]"

REPLIES_CTE = """
base AS (SELECT l.doc_id, l.quality, l.toxic, d.lang, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
lst AS (SELECT *,
          concat_ws(', ', CASE WHEN quality = 1 THEN '"clinical"' END, CASE WHEN toxic = 1 THEN '"off_topic"' END,
                    '"spam"', CASE WHEN n_chars > 2000 THEN '"news", "community", "lifestyle", "advice_giving"' END)
            AS l2,
          concat_ws(', ', CASE WHEN quality = 1 THEN '''clinical''' END, CASE WHEN toxic = 1 THEN '''off_topic''' END,
                    '''spam''', CASE WHEN n_chars > 2000
                                     THEN '''news'', ''community'', ''lifestyle'', ''advice_giving''' END) AS l1
        FROM base),
r AS (SELECT doc_id,
        CASE WHEN lang = 'en' AND n_chars > 15000 THEN '{"result": {"labels": [' || l2 || ']}}'
             WHEN lang = 'en' THEN '{"labels": [' || l2 || ']}'
             WHEN lang = 'fr' THEN 'Sure! {"labels": [' || l2 || ']} Hope it helps.'
             WHEN lang = 'de' THEN '{''labels'': [' || l1 || ']}'
             WHEN toxic = 1 THEN '{"labels": "clinical"}'
             ELSE '```json' || chr(10) || '{"labels": [' || l2 || ']}' || chr(10) || '```' END AS reply
      FROM lst)"""


def strict_sql(x: str) -> str:
    return (f"(CASE WHEN json_valid({x}) AND json_type({x}) = 'OBJECT' AND json_type({x}, '$.labels') = 'ARRAY' "
            f"THEN CAST(json_extract({x}, '$.labels') AS VARCHAR[]) END)")


def allowed_cap(arr: str, cap: int) -> str:
    return f"list_filter({arr}, lambda z: list_contains({ALLOWED}, z))[1:{cap}]"


FENCE = "(?s)```json" + WS + r"*(\{.*?\})" + WS + "*```"

FENCED_SQL = f"""
WITH base AS (SELECT l.doc_id, d.source, l.quality, l.toxic, d.lang, d.n_chars
              FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
v AS (SELECT *, CASE WHEN toxic = 1 THEN 'not_disease' WHEN quality = 1 THEN 'yes' ELSE 'unsure' END AS isr,
             '~ 1 / ' || CAST(n_chars AS VARCHAR) || ' 000' AS prev FROM base),
r AS (SELECT doc_id, source,
        CASE WHEN lang = 'es' THEN 'I think it is rare.'
             WHEN lang = 'de' THEN '```json' || chr(10) || '{{"is_rare":"' || upper(isr) || '","prevalence":"' || prev
                                   || '"}}' || chr(10) || '```'
             ELSE 'Here you go:' || chr(10) || '```json' || chr(10) || '{{"is_rare":"' || isr || '","prevalence":"'
                  || prev || '"}}' || chr(10) || '```' END AS reply
      FROM v),
p AS (SELECT doc_id, source, regexp_extract(reply, '{FENCE}', 1) AS obj FROM r),
q AS (SELECT doc_id, source, obj, (obj <> '' AND json_valid(obj)) AS ok FROM p),
t AS (SELECT doc_id, source, CASE WHEN ok THEN coalesce(json_extract_string(obj, '$.is_rare'), '') END AS isr,
             CASE WHEN ok THEN coalesce(json_extract_string(obj, '$.prevalence'), '') END AS prev FROM q),
k AS (SELECT doc_id, source, CASE WHEN lower(isr) = 'yes' THEN 'yes' WHEN lower(isr) IN ('no', 'not_disease') THEN 'no'
                                  ELSE 'error' END AS keep, prev FROM t)
SELECT doc_id, source, keep, CASE WHEN keep = 'error' THEN '' ELSE prev END AS prevalence_est FROM k"""

FLAT_FROM_CONVERSATIONS = f"""
SELECT 'conversations' AS subreddit, CAST(conv_id AS VARCHAR) AS post_id,
       CASE WHEN turn = 0 THEN '' ELSE CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) END AS comment_id,
       CASE WHEN turn <= 1 THEN 't3_' || CAST(conv_id AS VARCHAR)
            ELSE 't1_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn - 1 AS VARCHAR) END AS parent_id,
       turn = 0 AS is_post, coalesce(role, '[deleted]') AS author, CAST(turn AS BIGINT) AS created_utc,
       CAST(turn AS BIGINT) AS score,
       CAST(CASE WHEN turn = 0 THEN count(*) OVER (PARTITION BY conv_id) - 1 ELSE 0 END AS BIGINT) AS num_comments,
       {one_line('text')} AS body
FROM conversations"""

UNIFY_SQL = f"""
WITH RECURSIVE obj AS (
  SELECT turn = 0 AS is_post,
         CASE WHEN turn = 0 THEN CAST(conv_id AS VARCHAR)
              ELSE CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) END AS id,
         CASE WHEN turn = 0 THEN NULL WHEN turn = 1 THEN 't3_' || CAST(conv_id AS VARCHAR)
              ELSE 't1_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn - 1 AS VARCHAR) END AS parent_id,
         role, turn, text
  FROM conversations),
walk(id, cur) AS (
  SELECT id, parent_id FROM obj WHERE NOT is_post
  UNION ALL
  SELECT w.id, o.parent_id FROM walk w JOIN obj o
    ON starts_with(w.cur, 't1_') AND o.id = substring(w.cur, 4) AND NOT o.is_post),
roots AS (SELECT id, substring(cur, 4) AS post_id FROM walk WHERE starts_with(cur, 't3_'))
SELECT 'conversations' AS subreddit,
       CASE WHEN o.is_post THEN o.id ELSE r.post_id END AS post_id,
       CASE WHEN o.is_post THEN '' ELSE o.id END AS comment_id,
       CASE WHEN o.is_post THEN 't3_' || o.id ELSE coalesce(o.parent_id, '') END AS parent_id,
       o.is_post, coalesce(o.role, '[deleted]') AS author, CAST(o.turn AS BIGINT) AS created_utc,
       CAST(o.turn AS BIGINT) AS score, CAST(0 AS BIGINT) AS num_comments, {one_line('o.text')} AS body
FROM obj o LEFT JOIN roots r ON o.id = r.id"""


ORACLE: dict[str, str] = {
    "high_signal_events": high_signal("event_type", 10),
    "high_signal_users": high_signal("user_id", 60),
    "signal_audit": f"SELECT event_type, count(*) AS n_posts FROM ({high_signal('event_type', 10)}) GROUP BY event_type",
    "drop_report": """
WITH f AS (SELECT conv_id, lower(coalesce(role, '')) NOT IN ('system') AS k FROM conversations),
g AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE k) AS kk FROM f GROUP BY conv_id)
SELECT CAST(sum(n) AS BIGINT) AS rows_before, CAST(sum(kk) AS BIGINT) AS rows_after,
       CAST(sum(n) - sum(kk) AS BIGINT) AS rows_dropped, count(*) AS groups_before,
       count(*) FILTER (WHERE kk > 0) AS groups_after, count(*) - count(*) FILTER (WHERE kk > 0) AS groups_dropped
FROM g""",
    "engagement_score": f"SELECT event_id, round({ENG}, 6) AS engagement FROM events",
    "filter_authors": "SELECT conv_id, turn, role FROM conversations WHERE lower(coalesce(role, '')) NOT IN ('system')",
    "since_date": """
SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS created_utc, CAST(year(o_orderdate) AS BIGINT) AS year
FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'""",
    "min_length": f"""
SELECT doc_id, CAST(length(c) AS BIGINT) AS n_clean FROM (SELECT doc_id, {clean('text')} AS c FROM documents)
WHERE length(c) >= 20""",
    "nonempty_body": f"""
WITH b AS (SELECT d.doc_id, d.source,
                  CASE WHEN l.toxic = 1 THEN ' ' || chr(9) || ' ' || chr(10) WHEN l.quality = 0 THEN NULL
                       ELSE d.text END AS body
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, source FROM b WHERE {trim_ws("coalesce(body, '')")} <> ''""",
    "clean_text": f"SELECT page_id, {clean("coalesce(url, '') || ' ' || coalesce(html, '')")} AS clean_text FROM pages",
    "one_line": f"SELECT doc_id, {one_line('text')} AS line, substring({one_line('text')}, 1, 300) AS line_300 "
                "FROM documents",
    "shorten_text": f"SELECT doc_id, {shorten('text', 200, True)} AS short_a, {shorten('text', 4000, False)} AS short_b "
                    "FROM documents",
    "render_prompt": """
SELECT doc_id, 'Community r/' || coalesce(source, '') || ' (' || coalesce(lang, '') || ')' || chr(10) || 'Length: '
       || coalesce(CAST(n_chars AS VARCHAR), '') || chr(10) || 'Post:' || chr(10) || coalesce(text, '')
       AS prompt
FROM documents""",
    "term_match": """
WITH t AS (SELECT DISTINCT lower(text) AS term FROM benchmark WHERE text IS NOT NULL AND text <> ''),
m AS (SELECT d.doc_id, t.term, row_number() OVER (PARTITION BY d.doc_id ORDER BY length(t.term) DESC, t.term) AS rn
      FROM documents d JOIN t ON contains(lower(d.text), t.term))
SELECT doc_id, term AS matched_term FROM m WHERE rn = 1""",
    "term_match_qgram": """
WITH t AS (SELECT DISTINCT lower(term) AS term
           FROM (SELECT text AS term FROM benchmark UNION ALL SELECT unnest(string_split(text, ' ')) FROM benchmark)
           WHERE term IS NOT NULL AND term <> ''),
m AS (SELECT d.doc_id, t.term, row_number() OVER (PARTITION BY d.doc_id ORDER BY length(t.term) DESC, t.term) AS rn
      FROM documents d JOIN t ON contains(lower(d.text), t.term))
SELECT doc_id, term AS matched_term FROM m WHERE rn = 1""",
    "term_match_words": f"""
WITH v AS (SELECT DISTINCT {collapse('t')} AS term
           FROM (SELECT lower(p_type) AS t FROM part UNION ALL SELECT lower(p_name) FROM part)
           WHERE {collapse('t')} <> ''),
mx AS (SELECT max(len(string_split(term, ' '))) AS m FROM v),
w AS (SELECT p_partkey, string_split({collapse("lower(coalesce(p_name, ''))")}, ' ') AS ws FROM part),
g AS (SELECT DISTINCT w.p_partkey, array_to_string(w.ws[s.i : s.i + n.n - 1], ' ') AS gram
      FROM w CROSS JOIN mx CROSS JOIN LATERAL (SELECT unnest(generate_series(1, mx.m)) AS n) n
           CROSS JOIN LATERAL (SELECT unnest(generate_series(1, len(w.ws))) AS i) s
      WHERE s.i + n.n - 1 <= len(w.ws)),
m AS (SELECT g.p_partkey, v.term,
             row_number() OVER (PARTITION BY g.p_partkey ORDER BY length(v.term) DESC, v.term) AS rn
      FROM g JOIN v ON g.gram = v.term)
SELECT p_partkey, term AS matched_term FROM m WHERE rn = 1""",
    "acronym_match": """
WITH t AS (SELECT n.n_nationkey, concat_ws(' ', n.n_name, r.r_name) AS txt
           FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
v AS (SELECT r_name AS term FROM region),
acr AS (SELECT term FROM v WHERE upper(term) = term AND lower(term) <> term AND length(term) BETWEEN 3 AND 6),
v1 AS (SELECT DISTINCT lower(term) AS term FROM v
       WHERE term IS NOT NULL AND term <> '' AND term NOT IN (SELECT term FROM acr)),
m1 AS (SELECT t.n_nationkey, v1.term,
              row_number() OVER (PARTITION BY t.n_nationkey ORDER BY length(v1.term) DESC, v1.term) AS rn
       FROM t JOIN v1 ON contains(lower(t.txt), v1.term)),
hit AS (SELECT n_nationkey, term AS matched_term, 'term' AS match_kind FROM m1 WHERE rn = 1),
rest AS (SELECT * FROM t WHERE n_nationkey NOT IN (SELECT n_nationkey FROM hit)),
tok AS (SELECT DISTINCT n_nationkey, unnest(regexp_split_to_array(coalesce(txt, ''), '[^A-Za-z0-9]+')) AS tk FROM rest),
m2 AS (SELECT tok.n_nationkey, tok.tk,
              row_number() OVER (PARTITION BY tok.n_nationkey ORDER BY length(tok.tk) DESC, tok.tk) AS rn
       FROM tok JOIN (SELECT DISTINCT term FROM acr) a ON tok.tk = a.term)
SELECT n_nationkey, matched_term, match_kind FROM hit
UNION ALL SELECT n_nationkey, tk AS matched_term, 'acronym' AS match_kind FROM m2 WHERE rn = 1""",
    "acronym_match_parity": """
WITH t AS (SELECT n.n_nationkey, concat_ws(' ', n.n_name, r.r_name) AS txt
           FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
v AS (SELECT r_name AS term FROM region),
acr AS (SELECT term FROM v WHERE upper(term) = term AND lower(term) <> term AND length(term) BETWEEN 3 AND 6),
v1 AS (SELECT DISTINCT lower(term) AS term FROM v WHERE term IS NOT NULL AND term <> ''),
m1 AS (SELECT t.n_nationkey, v1.term,
              row_number() OVER (PARTITION BY t.n_nationkey ORDER BY length(v1.term) DESC, v1.term) AS rn
       FROM t JOIN v1 ON contains(lower(t.txt), v1.term)),
hit AS (SELECT n_nationkey, term AS matched_term, 'term' AS match_kind FROM m1 WHERE rn = 1),
rest AS (SELECT * FROM t WHERE n_nationkey NOT IN (SELECT n_nationkey FROM hit)),
m2 AS (SELECT rest.n_nationkey, a.term,
              row_number() OVER (PARTITION BY rest.n_nationkey ORDER BY length(a.term) DESC, lower(a.term), a.term) AS rn
       FROM rest JOIN acr a ON contains(lower(rest.txt), lower(a.term)))
SELECT n_nationkey, matched_term, match_kind FROM hit
UNION ALL SELECT n_nationkey, term AS matched_term, 'acronym' AS match_kind FROM m2 WHERE rn = 1""",
    "numeric_terms": f"""
WITH raw AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS term FROM orders
  UNION ALL SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) FROM orders
  UNION ALL SELECT concat_ws('/', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR)) FROM orders
  UNION ALL SELECT p_name FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region),
t AS (SELECT {trim_ws('term')} AS term FROM raw)
SELECT DISTINCT term FROM t WHERE term <> '' AND NOT regexp_full_match(term, '(?:[0-9/.,-]|{WS})+')""",
    "lookup_exact": """
WITH t AS (SELECT DISTINCT term FROM (SELECT upper(p_name) AS term FROM part UNION ALL SELECT p_type FROM part)),
h AS (SELECT p.p_name, p.p_partkey, t.term AS matched_term,
             row_number() OVER (PARTITION BY lower(p.p_name) ORDER BY t.term, p.p_partkey) AS rn
      FROM t JOIN part p ON lower(t.term) = lower(p.p_name))
SELECT p_name, p_partkey, matched_term FROM h WHERE rn = 1""",
    "lookup_fallback": """
WITH names AS (SELECT DISTINCT p_name AS term FROM part),
words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part),
terms AS (SELECT term FROM names UNION SELECT term FROM words),
exact AS (SELECT t.term AS matched_term, p.p_partkey FROM terms t JOIN part p ON lower(t.term) = lower(p.p_name)),
missing AS (SELECT term FROM terms WHERE term NOT IN (SELECT matched_term FROM exact)),
fb AS (SELECT m.term AS matched_term, p.p_partkey,
              row_number() OVER (PARTITION BY m.term ORDER BY p.p_retailprice DESC, p.p_partkey) AS hit_rank
       FROM missing m JOIN part p
         ON contains(lower(concat_ws(' ', coalesce(p.p_name, ''), coalesce(p.p_type, ''))), lower(m.term)))
SELECT matched_term, p_partkey, 'exact' AS hit_kind, CAST(1 AS BIGINT) AS hit_rank FROM exact
UNION ALL
SELECT matched_term, p_partkey, 'fallback' AS hit_kind, CAST(hit_rank AS BIGINT) AS hit_rank FROM fb WHERE hit_rank <= 3""",
    "only_new": """
SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "restrict_to": """
SELECT doc_id, source FROM documents
WHERE source IN (SELECT d.source FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1)""",
    "union_terms": "SELECT n_name AS term FROM nation UNION SELECT r_name AS term FROM region",
    "intersect_keys": """
SELECT d.source, d.doc_id FROM labels l JOIN documents d ON l.doc_id = d.doc_id
INTERSECT SELECT source, doc_id FROM documents
INTERSECT SELECT source, doc_id FROM documents""",
    "first_last_reply": f"""
WITH {LATENCY_CTE}
SELECT o_orderkey, 't3_' || CAST(o_orderkey AS VARCHAR) AS post_fullname, f AS first_comment_utc,
       l AS last_comment_utc FROM x""",
    "reply_latency": f"WITH {LATENCY_CTE} SELECT o_orderkey, latency_sec, round(latency_min, 6) AS latency_min FROM x",
    "fastest_20": f"""
WITH {LATENCY_CTE}
SELECT o_orderkey, round(latency_min, 6) AS latency_min FROM x WHERE latency_min IS NOT NULL
ORDER BY latency_min, o_orderkey LIMIT 20""",
    "slowest_20": f"""
WITH {LATENCY_CTE}
SELECT o_orderkey, round(latency_min, 6) AS latency_min FROM x WHERE latency_min IS NOT NULL
ORDER BY latency_min DESC, o_orderkey LIMIT 20""",
    "latency_by_label": f"""
WITH {LATENCY_CTE},
e AS (SELECT {trim_ws('lab')} AS label, latency_min AS v
      FROM (SELECT unnest(string_split(concat_ws(';', o_orderpriority, o_orderstatus), ';')) AS lab, latency_min FROM x))
SELECT label, count(*) AS n_posts, round(quantile_cont(v, 0.5), 6) AS median_min,
       round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr_min
FROM e WHERE label <> '' GROUP BY label""",
    "label_consensus": f"WITH {LABEL_SETS_CTE} SELECT source, doc_id, consensus_labels FROM cons",
    "consensus_attached": f"""
WITH {LABEL_SETS_CTE}
SELECT va.source, va.doc_id, va.labels, c.consensus_labels
FROM va LEFT JOIN cons c ON va.source = c.source AND va.doc_id = c.doc_id""",
    "annotated_posts": f"""
WITH {LABEL_SETS_CTE}
SELECT d.doc_id, d.source, d.lang, c.consensus_labels
FROM documents d LEFT JOIN cons c ON d.source = c.source AND d.doc_id = c.doc_id""",
    "label_summary": f"""
WITH {LABEL_SETS_CTE},
a AS (SELECT va.source, va.doc_id, c.consensus_labels
      FROM va LEFT JOIN cons c ON va.source = c.source AND va.doc_id = c.doc_id),
ls AS (SELECT DISTINCT {trim_ws('x')} AS l
       FROM (SELECT unnest(string_split(coalesce(consensus_labels, ''), ';')) AS x FROM a))
SELECT count(*) AS n_rows, count(*) FILTER (WHERE consensus_labels = '') AS n_empty,
       count(*) FILTER (WHERE consensus_labels IS NULL) AS n_null,
       (SELECT count(*) FROM ls WHERE l <> '') AS n_distinct,
       (SELECT coalesce(string_agg(l, ';' ORDER BY l), '') FROM ls WHERE l <> '') AS labels
FROM a""",
    "label_frequency": f"""
WITH {LABEL_SETS_CTE},
a AS (SELECT c.consensus_labels FROM documents d LEFT JOIN cons c ON d.source = c.source AND d.doc_id = c.doc_id),
e AS (SELECT {trim_ws('x')} AS label FROM (SELECT unnest(string_split(coalesce(consensus_labels, ''), ';')) AS x FROM a))
SELECT label, count(*) AS n FROM e WHERE label <> '' GROUP BY label""",
    "label_parse_strict": f"""
WITH {REPLIES_CTE}
SELECT doc_id, array_to_string(coalesce({allowed_cap(strict_sql(trim_ws('reply')), 5)}, ['off_topic']), ';') AS labels
FROM r""",
    "label_parse_first_object": f"""
WITH {REPLIES_CTE}, b AS (SELECT doc_id, regexp_extract(reply, '(?s)\\{{.*?\\}}', 0) AS blk FROM r)
SELECT doc_id, array_to_string(coalesce({allowed_cap(strict_sql('blk'), 3)}, []), ';') AS labels FROM b""",
    "label_parse_fallback": f"""
WITH {REPLIES_CTE}, b AS (SELECT doc_id, reply, regexp_extract(reply, '(?s)\\{{.*\\}}', 0) AS blk FROM r)
SELECT doc_id,
       array_to_string(coalesce({allowed_cap(f"coalesce({strict_sql('reply')}, {strict_sql('blk')})", 3)}, []), ';')
       AS labels
FROM b""",
    "fenced_verdict": FENCED_SQL,
    "kept_names": f"SELECT doc_id, source FROM ({FENCED_SQL}) WHERE keep = 'yes'",
    "keyword_verdict": f"""
WITH r AS (SELECT CASE WHEN toxic = 1 THEN ' Not_Disease' WHEN quality = 1 THEN 'RARE' || chr(10) ELSE 'common.' END
                  AS reply FROM labels),
v AS (SELECT lower({trim_ws('reply')}) AS k FROM r)
SELECT CASE WHEN k IN ('rare') THEN 'yes' WHEN k IN ('common', 'not_disease') THEN 'no' ELSE 'error' END AS verdict,
       count(*) AS n
FROM v GROUP BY 1""",
    "yield_curve": """
WITH o AS (SELECT row_number() OVER (ORDER BY doc_id) AS processed,
                  sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING
                                                                     AND CURRENT ROW) AS positives,
                  count(*) OVER () AS n
           FROM labels)
SELECT CAST(processed AS BIGINT) AS processed, CAST(positives AS BIGINT) AS positives FROM o
WHERE processed % 50 = 0 OR processed = n""",
    "keep_first": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       CAST(epoch(l_shipdate) AS BIGINT) AS ship_utc
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                   ORDER BY l_shipdate NULLS FIRST, l_partkey NULLS FIRST, l_suppkey NULLS FIRST,
                                            l_quantity NULLS FIRST, l_extendedprice NULLS FIRST, l_discount NULLS FIRST,
                                            l_tax NULLS FIRST, l_returnflag NULLS FIRST, l_linestatus NULLS FIRST) AS rn
      FROM lineitem)
WHERE rn = 1""",
    "duplicate_rows": """
SELECT CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "flatten_threads": FLAT_FROM_CONVERSATIONS,
    "unify_flat": UNIFY_SQL,
    "label_batch": f"""
SELECT doc_id, CASE WHEN {shorten('text', 4000, False)} LIKE '% (…)' THEN 'news' ELSE 'experience' END AS labels
FROM documents""",
    "crosscheck_batch": """
SELECT doc_id, source,
       CASE WHEN source IS NULL THEN NULL WHEN right(source, 1) IN ('0', '2', '4', '6', '8') THEN 'yes' ELSE 'no' END
       AS keep,
       CASE WHEN source IS NULL THEN NULL ELSE '~ 1 / ' || CAST(length(source) AS VARCHAR) || '0 000' END
       AS prevalence_est
FROM documents""",
    "preprocess_posts": f"""
WITH c AS (SELECT l_orderkey, min(CAST(epoch(l_shipdate) AS BIGINT)) AS f FROM lineitem GROUP BY l_orderkey),
p AS (SELECT o.o_orderkey, o.o_orderpriority AS title, cu.c_name AS selftext, o.o_orderstatus AS author,
             CAST(epoch(o.o_orderdate) AS BIGINT) AS created, o.o_totalprice / 1000.0 AS score
      FROM orders o LEFT JOIN customer cu ON o.o_custkey = cu.c_custkey
      WHERE o.o_orderdate >= TIMESTAMP '1998-01-01'),
x AS (SELECT p.*, c.f, {clean("coalesce(title, '') || ' ' || coalesce(selftext, '')")} AS clean_text
      FROM p LEFT JOIN c ON p.o_orderkey = c.l_orderkey)
SELECT o_orderkey, clean_text, round(coalesce(score, 0) + ln(1 + 0) + 0, 6) AS engagement,
       round(CASE WHEN f IS NOT NULL AND f <> 0 THEN CAST(f - created AS DOUBLE) / 60 END, 6) AS latency_min
FROM x WHERE author IS NOT NULL AND author NOT IN ('[deleted]') AND length(clean_text) >= 20""",
}

ORACLE.update({
    "catalog_broken_bytes": """
SELECT p_name AS name, p_type || chr(65533) AS title, CAST(p_partkey AS BIGINT) AS subscribers, false AS corrupt FROM part""",
    "ontology_terms": """
SELECT DISTINCT term FROM (
  SELECT n_name AS term FROM nation
  UNION ALL SELECT concat_ws(' ', n.n_name, r.r_name) FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  UNION ALL SELECT r_name FROM region)""",
    "term_list_roundtrip": f"""
SELECT DISTINCT term FROM (SELECT {trim_ws('p_name')} AS term FROM part UNION ALL SELECT {trim_ws('n_name')} FROM nation)
WHERE term <> ''""",
    "catalog_csv_roundtrip": "SELECT doc_id, source, text FROM documents",
    "objects_roundtrip": f"""
SELECT CAST(event_id AS VARCHAR) AS id, event_type AS subreddit, coalesce(CAST(user_id AS VARCHAR), '[deleted]') AS author,
       CAST(floor(epoch(ts)) AS BIGINT) AS created_utc, coalesce(CAST(floor(value) AS BIGINT), 0) AS score,
       coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS num_comments,
       coalesce(event_type, '') AS title, coalesce(props, '') AS body
FROM events""",
    "label_files_roundtrip": f"WITH {LABEL_SETS_CTE} SELECT source, doc_id, consensus_labels FROM cons",
    "period_pruning": """
SELECT event_id, event_type, value FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-07'""",
    "ingest_stream": "SELECT event_id, event_type, value FROM events",
    "first_last_stream": """
SELECT l_orderkey AS o_orderkey, min(CAST(epoch(l_shipdate) AS BIGINT)) AS first_comment_utc,
       max(CAST(epoch(l_shipdate) AS BIGINT)) AS last_comment_utc
FROM lineitem GROUP BY l_orderkey""",
})

ORACLE.update({
    "discovery_candidates": f"""
WITH cat AS (SELECT p_partkey, p_name AS name, p_type AS title, p_brand AS public_description FROM part),
vocab AS (SELECT DISTINCT term FROM (SELECT unnest(string_split(p_name, ' ')) AS term FROM part
                                     UNION ALL SELECT p_type FROM part UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part)
          WHERE NOT regexp_full_match(term, '(?:[0-9/.,-]|{WS})+')),
v1 AS (SELECT DISTINCT lower(term) AS t FROM vocab WHERE term IS NOT NULL AND term <> ''),
m AS (SELECT c.p_partkey, c.name, c.public_description, v1.t,
             row_number() OVER (PARTITION BY c.p_partkey ORDER BY length(v1.t) DESC, v1.t) AS rn
      FROM cat c JOIN v1 ON contains(lower(concat_ws(' ', coalesce(c.name, ''), coalesce(c.title, ''),
                                                     coalesce(c.public_description, ''))), v1.t)),
hit AS (SELECT p_partkey, name, public_description, t AS matched_term FROM m WHERE rn = 1),
w AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY matched_term, p_partkey) AS rn FROM hit),
fresh AS (SELECT * FROM w WHERE rn = 1 AND name NOT IN (SELECT p_name FROM part WHERE p_size = 50 AND p_type = 'PROMO'))
SELECT p_partkey, name, matched_term,
       CASE WHEN contains(name || ': ' || public_description, 'ring') THEN 'yes'
            WHEN contains(name || ': ' || public_description, 'bolt') THEN 'no' ELSE 'error' END AS gpt_label,
       CASE WHEN length(matched_term) % 2 = 1 THEN 'yes' ELSE 'no' END AS keep,
       '1 in ' || CAST(length(matched_term) AS VARCHAR) || '000' AS prevalence_est
FROM fresh""",
    "study_latency_by_label": """
WITH c AS (SELECT l_orderkey, min(CAST(epoch(l_shipdate) AS BIGINT)) AS f FROM lineitem GROUP BY l_orderkey),
p AS (SELECT o.o_orderkey AS post_id, o.o_orderpriority AS g, o.o_orderstatus AS st, cu.c_mktsegment AS author,
             o.o_totalprice / 1000.0 AS score, CAST(epoch(o.o_orderdate) AS BIGINT) AS created
      FROM orders o LEFT JOIN customer cu ON o.o_custkey = cu.c_custkey),
e AS (SELECT p.*, CASE WHEN c.f IS NOT NULL AND c.f <> 0 THEN CAST(c.f - p.created AS DOUBLE) / 60 END AS latency_min,
             coalesce(score, 0) + ln(1 + 0) + 0 AS eng
      FROM p LEFT JOIN c ON p.post_id = c.l_orderkey
      WHERE lower(coalesce(author, '')) NOT IN ('[deleted]', '[removed]', '')),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY eng DESC, post_id) AS rn,
             count(*) OVER (PARTITION BY g) AS n FROM e),
s AS (SELECT * FROM r WHERE n >= 10 AND rn <= least(20, greatest(1, ceil(n * 10 / 100)))),
lab AS (SELECT latency_min,
               concat_ws(';', CASE WHEN author IN ('BUILDING', 'MACHINERY') THEN 'clinical' END,
                         CASE WHEN author NOT IN ('BUILDING', 'MACHINERY') AND st <> 'F' THEN 'experience' END,
                         CASE WHEN st = 'F' THEN 'news' END) AS consensus_labels
        FROM s),
x AS (SELECT unnest(string_split(consensus_labels, ';')) AS label, latency_min FROM lab)
SELECT label, count(*) AS n_posts, round(quantile_cont(latency_min, 0.5), 6) AS median_min,
       round(quantile_cont(latency_min, 0.75) - quantile_cont(latency_min, 0.25), 6) AS iqr_min
FROM x WHERE label <> '' GROUP BY label""",
})

ORACLE.update({
    "catalog_dump_roundtrip": """
SELECT p_name AS name, CASE WHEN p_size > 25 THEN p_type ELSE '' END AS title,
       CASE WHEN p_size > 10 THEN p_brand ELSE '' END AS public_description, p_partkey AS subscribers
FROM part""",
    "flat_csv_roundtrip": UNIFY_SQL,
    "candidates_append": ORACLE["term_match"],
    "snapshot_versions": ORACLE["consensus_attached"],
    "preview_replies": f"WITH {REPLIES_CTE} SELECT doc_id, reply FROM r ORDER BY doc_id LIMIT 3",
    "label_incremental": f"""
SELECT doc_id, CASE WHEN {shorten('text', 4000, False)} LIKE '% (…)' THEN 'news' ELSE 'experience' END AS labels
FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
})

ORACLE.update({
    "discovery_lookup": f"""
WITH terms AS (SELECT DISTINCT term FROM (SELECT p_name AS term FROM part
                                          UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part
                                          UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part)
               WHERE NOT regexp_full_match(term, '(?:[0-9/.,-]|{WS})+')),
exact AS (SELECT t.term AS matched_term, p.p_partkey, p.p_name AS name, 'exact' AS hit_kind, 1 AS hit_rank
          FROM terms t JOIN part p ON lower(t.term) = lower(p.p_name) AND p.p_size < 45),
missing AS (SELECT term FROM terms WHERE term NOT IN (SELECT matched_term FROM exact)),
fb AS (SELECT m.term AS matched_term, p.p_partkey, p.p_name AS name, 'fallback' AS hit_kind,
              row_number() OVER (PARTITION BY m.term ORDER BY CASE WHEN p.p_size % 3 > 0 THEN p.p_size END DESC NULLS LAST, p.p_partkey) AS hit_rank
       FROM missing m JOIN part p
         ON contains(lower(concat_ws(' ', coalesce(p.p_name, ''), coalesce(p.p_type, ''))), lower(m.term))),
hits AS (SELECT * FROM exact UNION ALL SELECT * FROM fb WHERE hit_rank <= 3),
w AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY matched_term, hit_rank, p_partkey) AS rn
      FROM hits)
SELECT name, w.p_partkey, matched_term, hit_kind, substring(p_type, 1, 6) AS public_description,
       coalesce(CASE WHEN p_size % 3 > 0 THEN p_size END, 0) AS subscribers
FROM w JOIN part ON w.p_partkey = part.p_partkey
WHERE rn = 1 AND name NOT IN (SELECT p_name FROM part WHERE p_size = 50 AND p_type = 'PROMO')""",
})

ORACLE["catalog_months"] = """
SELECT p_name AS name, p_type AS title, p_partkey AS subscribers FROM part WHERE p_size <= 16 OR p_size > 33"""


ORACLE.update({
    "threads_file_roundtrip": """
SELECT post_id, comment_id, parent_id, is_post FROM (
  SELECT CAST(conv_id AS VARCHAR) AS post_id,
         CASE WHEN turn = 0 THEN '' ELSE CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) END AS comment_id,
         CASE WHEN turn <= 1 THEN 't3_' || CAST(conv_id AS VARCHAR)
              ELSE 't1_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn - 1 AS VARCHAR) END AS parent_id, turn = 0 AS is_post
  FROM conversations
  UNION ALL
  SELECT DISTINCT 'chain' || CAST(p_partkey // 1500 AS VARCHAR), '', 't3_chain' || CAST(p_partkey // 1500 AS VARCHAR), true FROM part
  UNION ALL
  SELECT 'chain' || CAST(p_partkey // 1500 AS VARCHAR), 'p' || CAST(p_partkey AS VARCHAR),
         coalesce('t1_p' || CAST(lag(p_partkey) OVER (PARTITION BY p_partkey // 1500 ORDER BY p_partkey) AS VARCHAR),
                  't3_chain' || CAST(p_partkey // 1500 AS VARCHAR)), false FROM part
  UNION ALL
  SELECT NULL, '{"id": "' || r_name, NULL, NULL FROM region)""",
    "label_files_mixed_headers": ORACLE["label_files_roundtrip"],
    "unify_flat_duplicates": f"""
WITH u AS (SELECT * FROM ({UNIFY_SQL}))
SELECT * FROM u UNION ALL SELECT * FROM u WHERE NOT is_post AND created_utc <= 2
UNION ALL
SELECT r_name, NULL, 'cycle' || CAST(r_regionkey AS VARCHAR) || '_' || CAST(k AS VARCHAR),
       't1_cycle' || CAST(r_regionkey AS VARCHAR) || '_' || CAST((k + 1) % 3 AS VARCHAR), false, '[deleted]', 0, 0, 0, ''
FROM region, (SELECT unnest([0, 1, 2]) AS k)""",
    "label_batch_with_failures": """
SELECT doc_id, CASE WHEN doc_id % 101 <> 7 THEN 'news' END AS labels, doc_id % 101 = 7 AS failed FROM documents""",
    "clean_by_lang": "SELECT doc_id, lang, n_chars FROM documents",
    "name_list": "SELECT n_name AS name FROM nation",
    "comment_objects": f"""
SELECT false AS is_post, 'conversations' AS subreddit, CASE WHEN turn = 1 THEN 't3_' || CAST(conv_id AS VARCHAR)
       ELSE 't1_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn - 1 AS VARCHAR) END AS parent_id,
       CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id, coalesce(nullif(role, 'user'), '[deleted]') AS author,
       CAST(turn AS BIGINT) AS created_utc, CASE WHEN turn % 2 = 0 THEN CAST(turn AS BIGINT) ELSE 0 END AS score, coalesce(text, '') AS body
FROM conversations WHERE turn > 0""",
    "defaults": """
SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0.0) AS score, 0 AS num_comments FROM customer""",
    "strip_links": f"""
SELECT page_id, regexp_replace(coalesce(html, ''), '{URL_PATTERN}', ' ', 'g') AS no_links,
       regexp_replace(coalesce(html, ''), '{EMOJI_PATTERN}', ' ', 'g') AS no_emoji FROM pages""",
})
