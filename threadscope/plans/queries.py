"""Registered queries: one per operator group, each ``(spark, sf_dir) -> DataFrame`` over the
whole driver tables. Computed columns are aliased to the names used by the DuckDB
oracle (``threadscope.plans.oracle``); doubles are rounded to 6 decimals.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadscope.functions.labels import join_labels, parse_labels_fallback, parse_labels_first_object
from threadscope.functions.labels import parse_labels_strict
from threadscope.functions.text import (
    clean_text,
    epoch_seconds,
    fullname,
    one_line,
    post_text,
    render_prompt,
    shorten,
    strip_emoji,
    strip_urls,
    truncate_chars,
    utc_year,
)
from threadscope.functions.verdicts import fenced_verdict, verdict_from_keyword
from threadscope.operators import (
    batch,
    consensus,
    filters,
    latency,
    matching,
    ordering,
    relations,
    report,
    sampling,
    threads,
)
from threadscope.operators.sizing import with_computed
from threadscope.plans import fixtures as fx
from threadscope.plans.fixtures import table

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ["source", "doc_id"]


def _r6(c):
    return F.round(c, 6)


# --- sampling -------------------------------------------------------------------


def high_signal_events(spark, d):
    s = sampling.select_high_signal(fx.events_as_objects(spark, d), by="subreddit", tiebreak=["post_id"])
    return s.select(F.col("subreddit").alias("event_type"), F.col("post_id").alias("event_id"),
                    _r6(F.col("engagement")).alias("engagement"))


def high_signal_users(spark, d):
    s = sampling.select_high_signal(fx.events_as_objects(spark, d), by="user_id", tiebreak=["post_id"],
                                    min_rows=60)
    return s.select("user_id", F.col("post_id").alias("event_id"), _r6(F.col("engagement")).alias("engagement"))


def signal_audit(spark, d):
    s = sampling.select_high_signal(fx.events_as_objects(spark, d), by="subreddit", tiebreak=["post_id"])
    return sampling.group_counts(s, "subreddit").withColumnRenamed("subreddit", "event_type")


def drop_report(spark, d):
    c = table(spark, d, "conversations")
    keep = ~F.lower(F.coalesce(F.col("role"), F.lit(""))).isin("system")
    return sampling.drop_report(c, keep, "conv_id")


def engagement_score(spark, d):
    e = sampling.with_engagement(fx.events_as_objects(spark, d))
    return e.select(F.col("post_id").alias("event_id"), _r6(F.col("engagement")).alias("engagement"))


def filter_authors(spark, d):
    c = filters.drop_deleted_authors(table(spark, d, "conversations"), "role", sentinels=["system"])
    return c.select("conv_id", "turn", "role")


def since_date(spark, d):
    o = filters.since(table(spark, d, "orders"), "o_orderdate", "1998-01-01")
    created = epoch_seconds("o_orderdate")
    return o.select("o_orderkey", created.alias("created_utc"), utc_year(created).alias("year"))


# --- text -----------------------------------------------------------------------


def min_length(spark, d):
    docs = with_computed(fx.text_table(spark, d, "documents"), "clean", clean_text("text"))
    return filters.min_text_length(docs, "clean", 20).select(
        "doc_id", F.length("clean").cast("bigint").alias("n_clean"))


def _moderated_documents(spark, d):
    """Documents whose body was blanked (toxic) or is missing (low quality, not toxic)."""
    docs = fx.text_table(spark, d, "documents")
    lab = table(spark, d, "labels")
    body = (F.when(F.col("toxic") == 1, F.lit(" \t \n"))
            .when(F.col("quality") == 0, F.lit(None).cast("string")).otherwise(F.col("text")))
    return docs.join(lab, "doc_id", "left").select("doc_id", "source", body.alias("body"))


def nonempty_body(spark, d):
    return filters.drop_empty_body(_moderated_documents(spark, d), "body").select("doc_id", "source")


def clean_text_q(spark, d):
    p = fx.text_table(spark, d, "pages")
    return p.select("page_id", clean_text(post_text("url", "html")).alias("clean_text"))


def one_line_q(spark, d):
    docs = fx.text_table(spark, d, "documents")
    line = one_line("text")
    return docs.select("doc_id", line.alias("line"), truncate_chars(line, 300).alias("line_300"))


def shorten_text(spark, d):
    docs = fx.text_table(spark, d, "documents")
    return docs.select("doc_id", shorten("text", 200, always=True).alias("short_a"),
                       shorten("text", 4000, always=False).alias("short_b"))


PROMPT_TEMPLATE = "Community r/{source} ({lang})\nLength: {n_chars}\nPost:\n{post}"


def render_prompt_q(spark, d):
    docs = table(spark, d, "documents")
    p = render_prompt(PROMPT_TEMPLATE, {"post": F.col("text")})
    return docs.select("doc_id", p.alias("prompt"))


# --- matching -------------------------------------------------------------------


def term_match(spark, d):
    docs = fx.text_table(spark, d, "documents").select("doc_id", "text")
    terms = table(spark, d, "benchmark").select(F.col("text").alias("term"))
    return matching.match_terms(docs, "text", terms, ["doc_id"]).select("doc_id", "matched_term")


def term_match_qgram(spark, d):
    """J1 with a vocabulary of passages and all their words ."""
    docs = fx.text_table(spark, d, "documents").select("doc_id", "text")
    b = table(spark, d, "benchmark")
    vocab = b.select(F.col("text").alias("term")).unionByName(
        b.select(F.explode(F.split("text", " ")).alias("term")))
    return matching.match_terms(docs, "text", vocab, ["doc_id"]).select("doc_id", "matched_term")


def _word_vocab(spark, d):
    part = table(spark, d, "part")
    return part.select(F.lower("p_type").alias("term")).unionByName(
        part.select(F.col("p_name").alias("term")))


def term_match_words(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    return matching.match_words(part, "p_name", _word_vocab(spark, d), ["p_partkey"]).select(
        "p_partkey", "matched_term")


def _nation_texts(spark, d):
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        "n_nationkey", F.concat_ws(" ", "n_name", "r_name").alias("txt"))


def acronym_match(spark, d):
    vocab = table(spark, d, "region").select(F.col("r_name").alias("term"))
    m = matching.find_candidates(_nation_texts(spark, d), "txt", vocab, ["n_nationkey"],
                                 acronym_case="upper", acronyms_in_substring_pass=False)
    return m.select("n_nationkey", "matched_term", "match_kind")


def acronym_match_parity(spark, d):
    vocab = table(spark, d, "region").select(F.col("r_name").alias("term"))
    m = matching.find_candidates(_nation_texts(spark, d), "txt", vocab, ["n_nationkey"])
    return m.select("n_nationkey", "matched_term", "match_kind")


def numeric_terms(spark, d):
    o = table(spark, d, "orders")
    raw = relations.union_inputs(
        o.select(F.col("o_orderkey").cast("string").alias("term")),
        o.select(F.col("o_orderdate").cast("date").cast("string").alias("term")),
        o.select(F.concat_ws("/", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("term")),
        table(spark, d, "part").select(F.col("p_name").alias("term")),
        table(spark, d, "nation").select(F.col("n_name").alias("term")),
        table(spark, d, "region").select(F.col("r_name").alias("term")),
    )
    return filters.drop_numeric_terms(relations.distinct_terms(raw, "term"), "term")


def lookup_exact(spark, d):
    part = table(spark, d, "part")
    terms = (part.select(F.upper("p_name").alias("term"))
             .unionByName(part.select(F.col("p_type").alias("term"))).distinct())
    hits = matching.lookup_by_name(terms, part, "term", "p_name")
    w = matching.first_writer_wins(hits, "p_name", ["matched_term", "p_partkey"])
    return w.select("p_name", "p_partkey", "matched_term")


def lookup_fallback(spark, d):
    part = table(spark, d, "part")
    names = part.select(F.col("p_name").alias("term")).distinct()
    words = part.select(F.explode(F.split("p_name", " ")).alias("term")).distinct()
    terms = names.unionByName(words).distinct()
    out = matching.lookup_with_fallback(terms, part, "term", "p_name", "p_type",
                                        relevance=[F.col("p_retailprice").desc()], tiebreak="p_partkey")
    return out.select("matched_term", "p_partkey", "hit_kind", F.col("hit_rank").cast("bigint").alias("hit_rank"))


# --- relations ------------------------------------------------------------------


def only_new(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return relations.only_new(docs, table(spark, d, "labels"), "doc_id")


def restrict_to(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    lab = table(spark, d, "labels").where(F.col("toxic") == 1)
    names = docs.join(lab, "doc_id", "left_semi").select("source")
    return relations.restrict_to(docs, names, "source")


def union_terms(spark, d):
    return relations.union_terms(table(spark, d, "nation").select("n_name"),
                                 table(spark, d, "region").select("r_name"))


def intersect_keys(spark, d):
    return relations.intersect_keys(list(fx.label_sets(spark, d).values()), KEYS)


# --- latency --------------------------------------------------------------------


def _posts_with_latency(spark, d):
    posts = fx.order_posts(spark, d)
    enriched = latency.enrich_first_last(posts, fx.line_comments(spark, d))
    return latency.with_latency(enriched)


def first_last_reply(spark, d):
    e = latency.enrich_first_last(fx.order_posts(spark, d), fx.line_comments(spark, d))
    return e.select(F.col("post_id").alias("o_orderkey"), fullname("t3_", "post_id").alias("post_fullname"),
                    "first_comment_utc", "last_comment_utc")


def reply_latency(spark, d):
    e = _posts_with_latency(spark, d)
    return e.select(F.col("post_id").alias("o_orderkey"), "latency_sec", _r6(F.col("latency_min")).alias("latency_min"))


def fastest_20(spark, d):
    r = latency.latency_rank(_posts_with_latency(spark, d), 20, fastest=True)
    return r.select(F.col("post_id").alias("o_orderkey"), _r6(F.col("latency_min")).alias("latency_min"))


def slowest_20(spark, d):
    r = latency.latency_rank(_posts_with_latency(spark, d), 20, fastest=False)
    return r.select(F.col("post_id").alias("o_orderkey"), _r6(F.col("latency_min")).alias("latency_min"))


def latency_by_label(spark, d):
    e = _posts_with_latency(spark, d).select(
        F.concat_ws(";", "subreddit", "o_orderstatus").alias("labels"),
        F.col("latency_min").cast("string").alias("latency_min"))
    r = report.latency_by_label(e, "labels", "latency_min")
    return r.select("label", "n_posts", _r6(F.col("median_min")).alias("median_min"),
                    _r6(F.col("iqr_min")).alias("iqr_min"))


# --- labels and consensus ---------------------------------------------------------


def _consensus(spark, d):
    sets = fx.label_sets(spark, d)
    long = consensus.label_long(sets, KEYS)
    return consensus.consensus_labels(long, KEYS, len(sets))


def label_consensus(spark, d):
    return _consensus(spark, d).select(*KEYS, "consensus_labels")


def consensus_attached(spark, d):
    base = fx.label_va(spark, d)
    return consensus.attach_consensus(base, _consensus(spark, d), KEYS).select(
        *KEYS, "labels", "consensus_labels")


def annotated_posts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return report.annotate_posts(docs, _consensus(spark, d), KEYS).select(
        "doc_id", "source", "lang", "consensus_labels")


def label_summary(spark, d):
    base = consensus_attached(spark, d)
    return consensus.label_summary(base, "consensus_labels")


def label_frequency(spark, d):
    return report.label_frequency(annotated_posts(spark, d), "consensus_labels")


def label_parse_strict(spark, d):
    r = fx.label_replies(spark, d)
    return r.select("doc_id", join_labels(parse_labels_strict("reply")).alias("labels"))


def label_parse_first_object(spark, d):
    r = fx.label_replies(spark, d)
    return r.select("doc_id", join_labels(parse_labels_first_object("reply")).alias("labels"))


def label_parse_fallback(spark, d):
    r = fx.label_replies(spark, d)
    return r.select("doc_id", join_labels(parse_labels_fallback("reply")).alias("labels"))


def fenced_verdict_q(spark, d):
    r = fx.verdict_replies(spark, d)
    v = fenced_verdict("reply")
    return r.select("doc_id", "source", v["keep"].alias("keep"), v["prevalence_est"].alias("prevalence_est"))


def kept_names(spark, d):
    v = fenced_verdict_q(spark, d)
    return filters.kept(v, "keep", "yes").select("doc_id", "source")


def keyword_verdict(spark, d):
    r = fx.keyword_replies(spark, d).withColumn("verdict", verdict_from_keyword("reply"))
    return report.verdict_breakdown(r, "verdict")


def yield_curve(spark, d):
    lab = table(spark, d, "labels")
    return ordering.yield_curve(lab, F.col("quality") == 1, ["doc_id"], 50)


def keep_first(spark, d):
    li = table(spark, d, "lineitem")
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus"]
    k = consensus.keep_first(li, ["l_orderkey", "l_linenumber"], order)
    return k.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                    epoch_seconds("l_shipdate").alias("ship_utc"))


def duplicate_rows(spark, d):
    return consensus.duplicate_count(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# --- trees ----------------------------------------------------------------------


def flatten_threads(spark, d):
    return threads.flatten_threads(fx.conversation_threads(spark, d), "thread")


def unify_flat(spark, d):
    return threads.unify_flat_objects(fx.conversation_objects(spark, d))


# --- caller-supplied model functions (offline rules) ------------------------------


def offline_labeller(prompts: list[str]) -> list[str]:
    """A deterministic stand-in for a model: 'news' (+ an unknown label) for cut posts,
    'experience' otherwise; German posts get prose around the JSON."""
    out = []
    for p in prompts:
        labels = ["news", "spam"] if p.endswith(" (…)") else ["experience"]
        reply = json.dumps({"labels": labels})
        out.append("Answer: " + reply if "ü" in p else reply)
    return out


def offline_prevalence(terms: list[str]) -> list[str]:
    """A deterministic stand-in for the prevalence model: fenced JSON verdicts."""
    out = []
    for t in terms:
        rare = "yes" if t[-1:] in "02468" else "not_disease"
        body = json.dumps({"is_rare": rare, "prevalence": f"~ 1 / {len(t)}0 000"})
        out.append(f"```json\n{body}\n```")
    return out


def label_batch(spark, d):
    docs = fx.text_table(spark, d, "documents").select("doc_id", "text")
    out = batch.label_posts(docs, offline_labeller, text_col="text", parser="fallback", shorten_always=False)
    return out.select("doc_id", "labels")


def crosscheck_batch(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    out = batch.crosscheck_terms(docs, offline_prevalence, term_col="source")
    return out.select("doc_id", "source", "keep", "prevalence_est")


# --- composed plans -------------------------------------------------------------


def preprocess_posts(spark, d):
    from threadscope.plans.preprocess import clean_posts

    o = table(spark, d, "orders")
    c = table(spark, d, "customer")
    posts = o.join(c, o["o_custkey"] == c["c_custkey"], "left").select(
        F.col("o_orderkey").alias("post_id"), F.col("o_orderpriority").alias("title"),
        F.col("c_name").alias("selftext"), F.col("o_orderstatus").alias("author"),
        epoch_seconds("o_orderdate").alias("created_utc"), "o_orderdate",
        (F.col("o_totalprice") / 1000.0).alias("score"), F.lit(None).cast("bigint").alias("num_comments"))
    out = clean_posts(posts, fx.line_comments(spark, d), since_date="1998-01-01", since_col="o_orderdate")
    return out.select(F.col("post_id").alias("o_orderkey"), "clean_text", _r6(F.col("engagement")).alias("engagement"),
                      _r6(F.col("latency_min")).alias("latency_min"))


QUERIES: dict[str, Query] = {
    "high_signal_events": high_signal_events,
    "high_signal_users": high_signal_users,
    "signal_audit": signal_audit,
    "drop_report": drop_report,
    "engagement_score": engagement_score,
    "filter_authors": filter_authors,
    "since_date": since_date,
    "min_length": min_length,
    "nonempty_body": nonempty_body,
    "clean_text": clean_text_q,
    "one_line": one_line_q,
    "shorten_text": shorten_text,
    "render_prompt": render_prompt_q,
    "term_match": term_match,
    "term_match_qgram": term_match_qgram,
    "term_match_words": term_match_words,
    "acronym_match": acronym_match,
    "acronym_match_parity": acronym_match_parity,
    "numeric_terms": numeric_terms,
    "lookup_exact": lookup_exact,
    "lookup_fallback": lookup_fallback,
    "only_new": only_new,
    "restrict_to": restrict_to,
    "union_terms": union_terms,
    "intersect_keys": intersect_keys,
    "first_last_reply": first_last_reply,
    "reply_latency": reply_latency,
    "fastest_20": fastest_20,
    "slowest_20": slowest_20,
    "latency_by_label": latency_by_label,
    "label_consensus": label_consensus,
    "consensus_attached": consensus_attached,
    "annotated_posts": annotated_posts,
    "label_summary": label_summary,
    "label_frequency": label_frequency,
    "label_parse_strict": label_parse_strict,
    "label_parse_first_object": label_parse_first_object,
    "label_parse_fallback": label_parse_fallback,
    "fenced_verdict": fenced_verdict_q,
    "kept_names": kept_names,
    "keyword_verdict": keyword_verdict,
    "yield_curve": yield_curve,
    "keep_first": keep_first,
    "duplicate_rows": duplicate_rows,
    "flatten_threads": flatten_threads,
    "unify_flat": unify_flat,
    "label_batch": label_batch,
    "crosscheck_batch": crosscheck_batch,
    "preprocess_posts": preprocess_posts,
}


# --- sources and sinks, as round trips through the session's shared scratch folder ---


def _xml_text(c):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


_NS = ('xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" '
       'xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:oboInOwl="http://www.geneontology.org/formats/oboInOwl#"')


def ontology_terms(spark, d):
    """Nations and regions written as ontology XML documents, read back as terms.

    The XML source needs one root element per file, so each region becomes one complete
    document (its subjects aggregated, bounded by the nations of a region) and the
    write is partitioned by region: every file holds exactly one document, written in
    parallel.
    """
    from threadscope.session import scratch_path
    from threadscope.sources.readers import read_ontology_terms

    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    # subjects: a start tag over two lines, a node without a name, and the usual one; regions have a kind without prefix
    start = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit('<owl:Class\n    rdf:about="n'), F.col("n_nationkey").cast("string"), F.lit('">'))) \
        .when(F.col("n_nationkey") % 3 == 1, F.lit("<owl:Class>")) \
        .otherwise(F.concat(F.lit('<owl:Class rdf:about="n'), F.col("n_nationkey").cast("string"), F.lit('">')))
    nations = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("r_regionkey", F.concat(
        start,
        F.lit('<rdfs:label xml:lang="en">'), _xml_text(F.col("n_name")), F.lit("</rdfs:label>"),
        F.lit('<rdfs:label xml:lang="fr">'), _xml_text(F.lower("n_name")), F.lit("</rdfs:label>"),
        F.lit('<oboInOwl:hasExactSynonym xml:lang="fr">'), _xml_text(F.concat_ws(" ", "n_name", "r_name")),
        F.lit("</oboInOwl:hasExactSynonym></owl:Class>")).alias("element"))
    regions = r.select("r_regionkey", F.concat(
        F.lit('<Region xmlns="urn:regions" rdf:about="r'), F.col("r_regionkey").cast("string"), F.lit('">'),
        F.lit("<rdfs:label\n> "), _xml_text(F.col("r_name")), F.lit(" </rdfs:label></Region>"))
        .alias("element"))
    docs = nations.unionByName(regions).groupBy("r_regionkey").agg(F.concat(
        F.lit(f'<?xml version="1.0"?>\n<rdf:RDF {_NS}>\n'),
        F.array_join(F.array_sort(F.collect_list("element")), "\n"), F.lit("\n</rdf:RDF>")).alias("value"))
    path = scratch_path(spark, "ontology")
    docs.write.partitionBy("r_regionkey").text(path)
    return read_ontology_terms(spark, path).orderBy("term")


def term_list_roundtrip(spark, d):
    """K1 + S2: a sorted term file written and read back."""
    from threadscope.session import scratch_path
    from threadscope.sources.readers import read_term_list
    from threadscope.sources.sinks import write_term_list

    terms = relations.union_inputs(
        table(spark, d, "part").select(F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")).alias("term")),
        table(spark, d, "nation").select(F.col("n_name").alias("term")))
    path = scratch_path(spark, "terms")
    write_term_list(terms, path)
    return read_term_list(spark, path)


def catalog_csv_roundtrip(spark, d):
    """K5 + S6: multi-line, quoted text through CSV and back."""
    from threadscope.session import scratch_path
    from threadscope.sources.readers import read_catalog_csv
    from threadscope.sources.sinks import write_csv

    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    path = scratch_path(spark, "csv")
    write_csv(docs, path)
    return read_catalog_csv(spark, path, docs.schema)


def objects_roundtrip(spark, d):
    """P1 + K3 + S5 + F7: events as submission objects, gzip JSON per community, read back."""
    from threadscope.session import scratch_path
    from threadscope.sources.readers import read_flat_objects
    from threadscope.sources.sinks import write_objects

    e = table(spark, d, "events")
    objs = threads.project_submission(e.select(
        F.col("event_type").alias("subreddit"), F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("author"), epoch_seconds("ts").alias("created_utc"),
        F.floor("value").cast("bigint").alias("score"),
        F.get_json_object("props", "$.k").cast("bigint").alias("num_comments"),
        F.col("event_type").alias("title"), F.col("props").alias("selftext")))
    path = scratch_path(spark, "objects")
    write_objects(objs, path)
    back = filters.posts_only(read_flat_objects(spark, path))
    return back.select("id", "subreddit", "author", "created_utc", "score", "num_comments", "title", "body")


def label_files_roundtrip(spark, d):
    """K5 + S8 + A5: the three label sets as per-model CSV folders, read back and voted."""
    from threadscope.session import scratch_path
    from threadscope.sources.readers import read_label_files
    from threadscope.sources.sinks import write_csv

    root = scratch_path(spark, "labels")
    paths = []
    for model, f in fx.label_sets(spark, d).items():
        p = f"{root}/labels_{model}"
        write_csv(f.select(F.col("source").alias("subreddit"), F.col("doc_id").alias("post_id"), "labels"), p)
        paths.append(p)
    long = read_label_files(spark, paths, keys=["subreddit", "post_id"])
    cons = consensus.consensus_labels(long, ["subreddit", "post_id"], len(paths))
    return cons.select(F.col("subreddit").alias("source"), F.col("post_id").cast("bigint").alias("doc_id"),
                       "consensus_labels")


def period_pruning(spark, d):
    """Events partitioned by day; only the first week is read (partition pruning)."""
    from threadscope.session import scratch_path
    from threadscope.sources.readers import read_by_period

    e = table(spark, d, "events")
    path = scratch_path(spark, "by_day")
    e.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).write.partitionBy("day").parquet(path)
    days = [f"2024-01-0{i}" for i in range(1, 8)]
    return read_by_period(spark, path, days, col="day").select("event_id", "event_type", "value")


# --- incremental runs ---------------------------------------------------------------


def ingest_stream(spark, d):
    """I1 + I3: events arrive as two file batches; two available-now runs each take only new files."""
    from threadscope.session import scratch_path
    from threadscope.streaming.incremental import dedupe_stream, ingest_new_files

    e = table(spark, d, "events").select("event_id", "event_type", "value")
    root = scratch_path(spark, "ingest")
    src, sink, ck = f"{root}/src", f"{root}/sink", f"{root}/ck"
    first = F.col("event_type").isin("view", "click")
    e.where(first).write.parquet(f"{src}/batch=1")
    dedupe = lambda s: dedupe_stream(s.withColumn("_k", F.col("event_id").cast("string")), "_k").drop("_k")  # noqa
    ingest_new_files(spark, f"{src}/*", sink, ck, e.schema, transform=dedupe)
    e.where(~first).write.parquet(f"{src}/batch=2")
    e.where(first).write.parquet(f"{src}/batch=3")  # replayed batch: every key already seen
    ingest_new_files(spark, f"{src}/*", sink, ck, e.schema, transform=dedupe)
    return spark.read.parquet(sink)


def first_last_stream(spark, d):
    """I4: running first/last reply per post over two batches of line items."""
    from threadscope.session import scratch_path
    from threadscope.streaming.incremental import compact_first_last, first_last_reply_stream, latest_first_last

    c = fx.line_comments(spark, d)
    root = scratch_path(spark, "firstlast")
    src, sink, ck = f"{root}/src", f"{root}/sink", f"{root}/ck"
    early = F.col("created_utc") < F.lit(epoch_seconds(F.lit("1998-01-01 00:00:00")))
    c.where(early).write.parquet(f"{src}/batch=1")
    first_last_reply_stream(spark, f"{src}/*", c.schema, sink, ck)
    compact_first_last(spark, sink, f"{root}/snapshots")
    c.where(~early).write.parquet(f"{src}/batch=2")
    first_last_reply_stream(spark, f"{src}/*", c.schema, sink, ck)
    return latest_first_last(spark, sink, snapshots=f"{root}/snapshots").select(F.col("post_id").alias("o_orderkey"), "first_comment_utc",
                                                 "last_comment_utc")


QUERIES.update({
    "ontology_terms": ontology_terms,
    "term_list_roundtrip": term_list_roundtrip,
    "catalog_csv_roundtrip": catalog_csv_roundtrip,
    "objects_roundtrip": objects_roundtrip,
    "label_files_roundtrip": label_files_roundtrip,
    "period_pruning": period_pruning,
    "ingest_stream": ingest_stream,
    "first_last_stream": first_last_stream,
})


# --- composed plans -------------------------------------------------------------


def _keyword_model(prompts):
    return ["rare" if "ring" in p else ("common" if "bolt" in p else "not sure") for p in prompts]


def _prevalence_model(terms):
    return [f'```json\n{{"is_rare": "{"yes" if len(t) % 2 else "no"}", "prevalence": "1 in {len(t)}000"}}\n```'
            for t in terms]


def discovery_candidates(spark, d):
    """Discovery plan on the part catalogue: candidates, both verdicts."""
    from threadscope.plans.discovery import find_communities, verify_communities

    part = table(spark, d, "part")
    catalog = part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("title"),
                          F.col("p_brand").alias("public_description"), F.col("p_size").alias("subscribers"))
    vocab = relations.union_inputs(part.select(F.explode(F.split("p_name", " ")).alias("term")),
                                   part.select(F.col("p_type").alias("term")),
                                   part.select(F.col("p_size").cast("string").alias("term")))
    done = part.where((F.col("p_size") == 50) & (F.col("p_type") == "PROMO")).select(F.col("p_name").alias("name"))
    cands = find_communities(catalog, vocab, order=["matched_term", "p_partkey"], done=done)
    prompt = F.concat(F.col("name"), F.lit(": "), F.col("public_description"))
    out = verify_communities(cands, _keyword_model, _prevalence_model, prompt)
    return out.select("p_partkey", "name", "matched_term", "gpt_label", "keep", "prevalence_est")


def _model_a(prompts):
    return [json.dumps({"labels": ["clinical"] + (["news"] if "status=F" in p else [])}) for p in prompts]


def _model_b(prompts):
    out = []
    for p in prompts:
        lab = ["clinical"] if ("segment=BUILDING" in p or "segment=MACHINERY" in p) else ["experience"]
        out.append("Sure: " + json.dumps({"labels": lab}) + " ok")
    return out


def _model_c(prompts):
    return [json.dumps({"labels": ["news"] if "status=F" in p else ["experience", "spam"]}) for p in prompts]


def study_latency_by_label(spark, d):
    """The study plan on orders/line items: sample, three labellers, vote, latency by label."""
    from threadscope.plans.study import Labeller, run_study

    o = table(spark, d, "orders")
    c = table(spark, d, "customer")
    posts = o.join(c, o["o_custkey"] == c["c_custkey"], "left").select(
        F.col("o_orderpriority").alias("subreddit"), F.col("o_orderkey").alias("post_id"),
        F.col("c_mktsegment").alias("author"), F.col("o_orderstatus").alias("status"),
        (F.col("o_totalprice") / 1000.0).alias("score"), epoch_seconds("o_orderdate").alias("created_utc"))
    labellers = {"A": Labeller(_model_a, "strict"), "B": Labeller(_model_b, "first_object"),
                 "C": Labeller(_model_c, "fallback")}
    prompt = lambda _body: F.concat(F.lit("status="), F.col("status"), F.lit(" segment="), F.col("author"))  # noqa
    res = run_study(posts, fx.line_comments(spark, d), labellers, prompt=prompt, text_col="status")
    return res.latency.select("label", "n_posts", _r6(F.col("median_min")).alias("median_min"),
                              _r6(F.col("iqr_min")).alias("iqr_min"))


def discovery_lookup(spark, d):
    """Discovery search path on the part catalogue: exact name hits, top-3 fallback, first writer wins."""
    from threadscope.plans.discovery import lookup_communities

    part = table(spark, d, "part")
    catalog = part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("public_description"),
                          F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("subscribers"),
                          (F.col("p_size") >= 45).alias("over18"))
    vocab = relations.union_inputs(part.select(F.col("p_name").alias("term")),
                                   part.select(F.explode(F.split("p_name", " ")).alias("term")),
                                   part.select(F.col("p_size").cast("string").alias("term")))
    done = part.where((F.col("p_size") == 50) & (F.col("p_type") == "PROMO")).select(F.col("p_name").alias("name"))
    out = lookup_communities(vocab, catalog, relevance=[F.col("subscribers").desc()], tiebreak="p_partkey",
                             done=done, exclude_exact=F.col("over18"), max_description=6)
    return out.select("name", "p_partkey", "matched_term", "hit_kind", "public_description", "subscribers")


QUERIES.update({
    "discovery_lookup": discovery_lookup,
    "discovery_candidates": discovery_candidates,
    "study_latency_by_label": study_latency_by_label,
})


# --- remaining sources, sinks and incremental steps -------------------------------


def catalog_dump_roundtrip(spark, d):
    """S3: the part catalogue as gzip JSON lines (title/description sometimes absent), read back."""
    from threadscope.session import scratch_path
    from threadscope.sources.readers import read_catalog_dump

    part = table(spark, d, "part")
    cat = part.select(F.col("p_name").alias("name"),
                      F.when(F.col("p_size") > 25, F.col("p_type")).alias("title"),
                      F.when(F.col("p_size") > 10, F.col("p_brand")).alias("public_description"),
                      F.col("p_partkey").alias("subscribers"))
    path = scratch_path(spark, "catalog")
    cat.write.option("compression", "gzip").json(path)
    return read_catalog_dump(spark, path).select("name", "title", "public_description", "subscribers")


def flat_csv_roundtrip(spark, d):
    """K5 + S7: the unified flat table through CSV with a blank-named column, read back."""
    from threadscope.session import scratch_path
    from threadscope.sources.readers import read_flat_csv
    from threadscope.sources.sinks import write_csv

    flat = threads.unify_flat_objects(fx.conversation_objects(spark, d))
    path = scratch_path(spark, "flatcsv")
    write_csv(flat.select("subreddit", F.lit("").alias(" "), *[c for c in flat.columns if c != "subreddit"]), path)
    back = read_flat_csv(spark, path)
    return back.select(
        "subreddit", "post_id", F.coalesce("comment_id", F.lit("")).alias("comment_id"), "parent_id",
        (F.col("is_post").cast("int") == 1).alias("is_post"), "author",
        *[F.col(c).cast("bigint").alias(c) for c in ("created_utc", "score", "num_comments")],
        F.coalesce("body", F.lit("")).alias("body"))


def candidates_append(spark, d):
    """K2: matches of two runs (English, all others and no language) appended to one candidate folder, read back."""
    from threadscope.session import scratch_path
    from threadscope.sources.readers import read_catalog_csv
    from threadscope.sources.sinks import append_candidates

    path = scratch_path(spark, "candidates")
    terms = table(spark, d, "benchmark").select(F.col("text").alias("term"))
    docs = fx.text_table(spark, d, "documents").select("doc_id", "lang", "text")
    english = F.col("lang").eqNullSafe("en")
    for run in (english, ~english):
        hits = matching.match_terms(docs.where(run), "text", terms, ["doc_id"])
        append_candidates(hits.select("doc_id", "matched_term"), path)
    return read_catalog_csv(spark, path, "doc_id bigint, matched_term string")


def snapshot_versions(spark, d):
    """K6: two versions of the verified table; the latest read back equals the second write."""
    from threadscope.session import scratch_path
    from threadscope.sources.sinks import read_latest, snapshot_then_replace

    path = scratch_path(spark, "verified")
    snapshot_then_replace(fx.label_va(spark, d), path)
    snapshot_then_replace(consensus_attached(spark, d), path)
    return read_latest(spark, path)


def preview_replies(spark, d):
    """T4: the first three model replies in key order (a debugging preview)."""
    return ordering.preview(fx.label_replies(spark, d), ["doc_id"], 3)


def label_incremental(spark, d):
    """Only documents without a label row go through the labeller."""
    from threadscope.streaming.incremental import label_incremental as incremental

    docs = fx.text_table(spark, d, "documents").select("doc_id", "text")
    done = table(spark, d, "labels").select("doc_id")
    out = incremental(docs, done, ["doc_id"], lambda new: batch.label_posts(
        new, offline_labeller, text_col="text", parser="fallback", shorten_always=False))
    return out.select("doc_id", "labels")


QUERIES.update({
    "catalog_dump_roundtrip": catalog_dump_roundtrip,
    "flat_csv_roundtrip": flat_csv_roundtrip,
    "candidates_append": candidates_append,
    "snapshot_versions": snapshot_versions,
    "preview_replies": preview_replies,
    "label_incremental": label_incremental,
})


def catalog_broken_bytes(spark, d):
    """S3: a dump whose names and titles hold bytes that are not UTF-8; every row keeps its fields."""
    from threadscope.session import scratch_path
    from threadscope.sources.readers import read_catalog_dump

    part = table(spark, d, "part")
    raw = lambda x: (F.lit(x) if isinstance(x, str) else x).cast("binary")
    line = F.concat(raw('{"name": "'), F.expr("X'FFC3'"), raw(F.col("p_name")), F.expr("X'E282'"), raw('", "title": "'), raw(F.col("p_type")),
                    raw("\ufffd"), F.expr("X'80'"), raw('", "subscribers": '), raw(F.col("p_partkey").cast("string")), raw("}"))
    path = scratch_path(spark, "catalog")
    part.select(line.cast("string").alias("value")).write.text(path)
    return read_catalog_dump(spark, path).select("name", "title", "subscribers", F.col("_corrupt_record").isNotNull().alias("corrupt"))


def catalog_months(spark, d):
    """S3 + S9: catalogue dumps named by month; only two of three months are read."""
    from threadscope.session import scratch_path
    from threadscope.sources.readers import period_paths, read_catalog_dump

    part = table(spark, d, "part")
    month = (F.when(F.col("p_size") <= 16, F.lit("2024-01")).when(F.col("p_size") <= 33, F.lit("2024-02"))
             .otherwise(F.lit("2024-03")))
    cat = part.select(month.alias("m"), F.col("p_name").alias("name"), F.col("p_type").alias("title"),
                      F.col("p_partkey").alias("subscribers"))
    root = scratch_path(spark, "dumps")
    for m in ("2024-01", "2024-02", "2024-03"):
        cat.where(F.col("m") == m).drop("m").write.option("compression", "gzip").json(f"{root}/RS_{m}")
    back = read_catalog_dump(spark, period_paths(root, ["2024-01", "2024-03"]))
    return back.select("name", "title", "subscribers")


QUERIES["catalog_months"] = catalog_months
QUERIES["catalog_broken_bytes"] = catalog_broken_bytes


# --- files and edge cases ---------------------------------------------------------


def threads_file_roundtrip(spark, d):
    """S4 + G1: thread files with chains of 1,500 replies and malformed lines; no line is lost."""
    from threadscope.session import scratch_path
    from threadscope.sources.readers import read_threads

    path = scratch_path(spark, "threads")
    broken = table(spark, d, "region").select(F.concat(F.lit('{"id": "'), F.col("r_name")).alias("value"))
    fx.conversation_lines(spark, d).unionByName(fx.part_chain_lines(spark, d)).unionByName(broken).write.text(path)
    back = read_threads(spark, path)
    flat = threads.flatten_threads(back, "thread").select("post_id", "comment_id", "parent_id", "is_post")
    bad = back.where(F.col("_corrupt_record").isNotNull()).select(
        F.lit(None).cast("string").alias("post_id"), F.col("_corrupt_record").alias("comment_id"),
        F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("boolean").alias("is_post"))
    return flat.unionByName(bad)


def label_files_mixed_headers(spark, d):
    """S8 + W2: files with another column order, an extra column and keys that repeat."""
    from threadscope.session import scratch_path
    from threadscope.sources.readers import read_label_files
    from threadscope.sources.sinks import write_csv

    root, paths = scratch_path(spark, "labels"), []
    for model, f in fx.label_sets(spark, d).items():
        p = f"{root}/labels_{model}"
        f = f.select(F.col("source").alias("subreddit"), F.col("doc_id").alias("post_id"), "labels")
        if model == "B":
            again = f.withColumn("labels", F.lit("news;clinical"))
            f = f.withColumn("copy", F.lit(1)).unionByName(again.withColumn("copy", F.lit(2))).orderBy("post_id", "subreddit", "copy")
            f = f.select("post_id", F.lit("some text").alias("body"), "subreddit", "labels")
        elif model == "C":
            f = f.select("labels", "subreddit", "post_id")
        write_csv(f, p)
        paths.append(p)
    cons = consensus.consensus_labels(read_label_files(spark, paths), ["subreddit", "post_id"], len(paths))
    return cons.select(F.col("subreddit").alias("source"), F.col("post_id").cast("bigint").alias("doc_id"), "consensus_labels")


def unify_flat_duplicates(spark, d):
    """Repeated comments stay as many as they are, and comments on a cycle have no post."""
    objs = fx.conversation_objects(spark, d)
    cycle = table(spark, d, "region").select("r_name", "r_regionkey", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    name = lambda k: F.concat(F.lit("cycle"), F.col("r_regionkey").cast("string"), F.lit("_"), k.cast("string"))
    rings = cycle.select(F.lit(False).alias("is_post"), F.col("r_name").alias("subreddit"), name(F.col("k")).alias("id"),
                         F.concat(F.lit("t1_"), name((F.col("k") + 1) % 3)).alias("parent_id"), F.lit(0).alias("created_utc"))
    again = objs.where(~F.col("is_post") & (F.col("created_utc") <= 2))
    return threads.unify_flat_objects(objs.unionByName(again).unionByName(rings, allowMissingColumns=True))


def _touchy_model(prompts):
    if any(int(p.split("|")[0]) % 101 == 7 for p in prompts):
        raise ValueError("a prompt that the model refuses")
    return ['{"labels": ["news"]}' for _ in prompts]


def label_batch_with_failures(spark, d):
    """Y1 + Y3: a prompt that always fails loses its own reply only."""
    docs = fx.text_table(spark, d, "documents").select("doc_id", "text")
    out = batch.label_posts(docs, _touchy_model, text_col="text", policy=batch.RetryPolicy(2, 0.0),
                            prompt=lambda body: F.concat(F.col("doc_id").cast("string"), F.lit("|"), body))
    return out.select("doc_id", "labels", F.col("reply_error").isNotNull().alias("failed"))


def clean_by_lang(spark, d):
    """K4: documents written as Parquet per language, read back."""
    from threadscope.session import scratch_path
    from threadscope.sources.sinks import write_clean

    path = scratch_path(spark, "clean")
    write_clean(table(spark, d, "documents"), path, by="lang")
    return spark.read.parquet(path).select("doc_id", "lang", "n_chars")


def name_list(spark, d):
    """K7: names written one per line in input order, read back."""
    from threadscope.session import scratch_path
    from threadscope.sources.sinks import write_name_list

    path = scratch_path(spark, "names")
    write_name_list(table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("input_order")), path)
    return spark.read.text(path).select(F.col("value").alias("name"))


def comment_objects(spark, d):
    """Conversation turns as comment objects (absent authors and scores take defaults)."""
    c = fx.conversation_objects(spark, d).where("not is_post")
    raw = c.withColumn("author", F.when(F.col("author") != "user", F.col("author"))).withColumn(
        "score", F.when(F.col("score") % 2 == 0, F.col("score")))
    return threads.project_comment(raw)


def defaults(spark, d):
    """Null and absent counters take their defaults."""
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("score"))
    return sampling.with_defaults(c, {"score": 0.0, "num_comments": 0})


def strip_links(spark, d):
    """X1 + X2: URLs and emoji of whole pages, each replaced on its own."""
    return table(spark, d, "pages").select("page_id", strip_urls("html").alias("no_links"), strip_emoji("html").alias("no_emoji"))


QUERIES.update({
    "threads_file_roundtrip": threads_file_roundtrip,
    "label_files_mixed_headers": label_files_mixed_headers,
    "unify_flat_duplicates": unify_flat_duplicates,
    "label_batch_with_failures": label_batch_with_failures,
    "clean_by_lang": clean_by_lang,
    "name_list": name_list,
    "comment_objects": comment_objects,
    "defaults": defaults,
    "strip_links": strip_links,
})
