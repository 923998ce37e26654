"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadscope.session import scratch_path

from . import alignment, decontam, hmm, huffman, license_scan, mixing, ngram_join, packing, topk, toxicity, url_filter, warc, whitening
from .common import read_table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op1_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_links(read_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), unnamed=True)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents")).drop("blocks")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(read_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("dig")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(read_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.measure(read_table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages, fetched on a day of 2024 that their id gives; the dated list is made
    from the hosts of the pages: of every host and its parent domain some enter a category on a day
    of their digest and some of those leave it again."""
    pages = read_table(spark, sf_dir, "pages").select(
        "page_id", "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id * 7919, 366) as int))").alias("fetched"))
    entries = derived_entries(pages)
    return url_filter.evaluate(pages, entries, "page_id", "url", "fetched").withColumnRenamed("id", "page_id")


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list from the hosts seen in ``pages``: (pattern, category, at, active)."""
    patterns = pages.select(F.explode(url_filter.suffixes(url_filter.host_of(F.col("url")))).alias("pattern")).where(
        "pattern like '%.%'").distinct().withColumn(
        "h", F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 8), 16, 10).cast("long"))
    listed = patterns.where("h % 3 = 0").select(
        "pattern", "h", F.expr("element_at(array('adult','malware','spam'), cast(h % 7 % 3 + 1 as int))").alias("category"),
        F.expr("date_add(date'2024-01-01', cast(h % 200 as int))").alias("since"))
    added = listed.select("pattern", "category", F.col("since").alias("at"), F.lit(True).alias("active"))
    left = listed.where("h % 2 = 0").select(
        "pattern", "category", F.expr("date_add(since, cast(h % 60 + 1 as int))").alias("at"), F.lit(False).alias("active"))
    return added.unionByName(left)


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.token_files(read_table(spark, sf_dir, "documents"), scratch_path(spark, "token-files"), tokenizer_path())


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op1_ngram_links": op1_ngram_links,
    "op2_decontamination": op2_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_warc": op4_warc,
    "op5_hmm": op5_hmm,
    "op6_toxicity": op6_toxicity,
    "op7_top_k": op7_top_k,
    "op8_mixing": op8_mixing,
    "op9_url_filter": op9_url_filter,
    "op10_token_ids": op10_token_ids,
    "op11_whitening": op11_whitening,
    "op12_packing": op12_packing,
    "op13_alignment": op13_alignment,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op1_ngram_join": rf"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN []
        WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, e.y FROM r JOIN e ON e.x = r.m)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.m) AS component_id
FROM documents d JOIN r ON r.d = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op1_ngram_links": rf"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN []
        WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, e.y FROM r JOIN e ON e.x = r.m)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.m) AS component_id,
  (SELECT count(*) FROM e WHERE e.x = d.doc_id)::BIGINT AS n_links
FROM documents d JOIN r ON r.d = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op7_top_k": """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s)
SELECT query_id, rk::INTEGER AS rank, vec_id, score FROM r WHERE rk <= 5
""",
    "op8_mixing": r"""
WITH m AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
      -ln((('0x' || substr(md5(doc_id::VARCHAR || ':0'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / ((length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) + 1.0) / (strlen(coalesce(text, '')) + 1.0)) AS key
      FROM documents),
t AS (SELECT source, sum(size)::DOUBLE AS total, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM m GROUP BY source),
c AS (SELECT *, row_number() OVER (ORDER BY 3 * total / w, source NULLS FIRST) AS pos FROM t),
l AS (SELECT *, ((SELECT sum(total) FROM t) - coalesce(sum(3 * total) OVER before, 0)) / ((SELECT sum(w) FROM t) - coalesce(sum(w) OVER before, 0)) AS level
      FROM c WINDOW before AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(pos) AS pos0 FROM l WHERE level <= 3 * total / w),
g AS (SELECT source, total, CASE WHEN pos < coalesce((SELECT pos0 FROM f), pos + 1) THEN 3 * total
      ELSE least(3 * total, w * (SELECT level FROM l WHERE pos = (SELECT pos0 FROM f))) END AS target FROM l),
o AS (SELECT m.*, g.total, g.target, coalesce(sum(size) OVER (PARTITION BY m.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
      CASE WHEN total > 0 THEN floor(target / total) ELSE 1 END AS epochs FROM m JOIN g ON m.source IS NOT DISTINCT FROM g.source),
x AS (SELECT *, (epochs + (ahead + size / 2 < target - epochs * total)::INT)::BIGINT AS copies FROM o)
SELECT doc_id, size, total::BIGINT AS source_size, target, copies * size AS taken, copies FROM x
""",
    "op9_url_filter": r"""
WITH p AS (SELECT page_id, url, (DATE '2024-01-01' + (page_id * 7919 % 366)::INT)::DATE AS fetched,
      lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', '')) AS host FROM pages),
x AS (SELECT page_id, host, fetched, unnest(CASE WHEN host = '' THEN [] ELSE 
      [array_to_string(string_split(host, '.')[i:], '.') for i in range(1, len(string_split(host, '.')) + 1)] END) AS pattern FROM p),
h AS (SELECT DISTINCT pattern, ('0x' || substr(md5(pattern), 1, 8))::BIGINT AS h FROM x WHERE pattern LIKE '%.%'),
e AS (SELECT pattern, (['adult', 'malware', 'spam'])[1 + h % 7 % 3] AS category, (DATE '2024-01-01' + (h % 200)::INT)::DATE AS since,
      CASE WHEN h % 2 = 0 THEN (DATE '2024-01-01' + (h % 200)::INT + (h % 60 + 1)::INT)::DATE END AS until FROM h WHERE h % 3 = 0),
v AS (SELECT page_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories
      FROM x JOIN e USING (pattern) WHERE since <= fetched AND (until IS NULL OR fetched < until) GROUP BY 1)
SELECT p.page_id, p.host, p.fetched, v.categories IS NOT NULL AS blocked, coalesce(v.categories, '') AS categories FROM p LEFT JOIN v USING (page_id)
""",
}
