"""Community discovery: vocabulary -> candidate communities -> two verdicts -> kept names.

S1/S2 -> F4 -> P6 -> J1 (+J3) -> P5 -> W3 -> J11 -> Y2 (keyword verdict) -> Y2 (prevalence
verdict per distinct term) -> F8 -> K7. Model calls happen once per row / distinct
term and are materialised before anything reads them twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadscope.functions.text import searchable_blob, truncate_chars
from threadscope.operators.batch import ReplyFn, RetryPolicy, crosscheck_terms, verify_candidates
from threadscope.operators.filters import drop_numeric_terms, kept
from threadscope.operators.matching import find_candidates, first_writer_wins
from threadscope.operators.relations import only_new
from threadscope.session import reliable_checkpoint


def find_communities(catalog: DataFrame, vocabulary: DataFrame, name: str = "name",
                     text_cols: Sequence[str] = ("name", "title", "public_description"),
                     order: Sequence[str | Column] = ("matched_term",), done: DataFrame | None = None,
                     acronym_case: str = "exact", acronyms_in_substring_pass: bool = True,
                     description: str = "public_description", max_description: int = 300) -> DataFrame:
    """Candidate communities: catalogue rows whose text contains a vocabulary term.

    Numeric terms are dropped first. Rows are matched one by one (keyed by a digest of all their
    columns, so rows that share a name stay apart); then one row per case-folded name survives,
    the earliest by ``order`` and, among equals, by the remaining columns. Names already in
    ``done`` are skipped. The description is cut to ``max_description`` characters.
    """
    vocab = drop_numeric_terms(vocabulary.select(F.col(vocabulary.columns[0]).alias("term")))
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in catalog.columns]), {"ignoreNullFields": "false"})
    staged = catalog.withColumn("_blob", searchable_blob(*text_cols)).withColumn("_row", F.md5(whole.cast("binary")))
    cands = find_candidates(staged, "_blob", vocab, ["_row"], acronym_case=acronym_case,
                            acronyms_in_substring_pass=acronyms_in_substring_pass).drop("_blob", "_row")
    if description in cands.columns:
        cands = cands.withColumn(description, truncate_chars(description, max_description))
    cands = first_writer_wins(cands, name, list(order))
    if done is not None:
        cands = only_new(cands, done.select(F.col(done.columns[0]).alias(name)), [name])
    return cands


def verify_communities(cands: DataFrame, keyword_fn: ReplyFn, prevalence_fn: ReplyFn, prompt: Column,
                       term_prompt=None, policy: RetryPolicy = RetryPolicy(), partitions: int | None = None,
                       strict_parity: bool = False) -> DataFrame:
    """Both verdicts: ``gpt_label`` (keyword reply per row) and ``keep`` /
    ``prevalence_est`` (fenced JSON reply per distinct matched term)."""
    first = reliable_checkpoint(verify_candidates(cands, keyword_fn, prompt, policy=policy, partitions=partitions))
    return crosscheck_terms(first, prevalence_fn, "matched_term", prompt=term_prompt, policy=policy,
                            partitions=partitions, strict_parity=strict_parity)


def kept_names(verified: DataFrame, name: str = "name", order: Sequence[str] = ("name",)) -> DataFrame:
    """F8 + K7 input: names with both verdicts yes, in a stated order."""
    both = kept(kept(verified, "gpt_label", "yes"), "keep", "yes")
    return both.select(name, *[c for c in order if c != name]).orderBy(*order)


def lookup_communities(vocabulary: DataFrame, catalog: DataFrame, name: str = "name",
                       description: str | None = "public_description", relevance: Sequence[Column] | None = None,
                       tiebreak: str = "name", k: int = 3, done: DataFrame | None = None,
                       exclude_exact: Column | None = None, max_description: int = 300,
                       subscribers: str = "subscribers") -> DataFrame:
    """Search path: numeric terms dropped, exact case-insensitive name hits (J4, without rows that
    ``exclude_exact`` names, e.g. ``F.col("over18")``), top-k relevance hits for terms without one
    (J5), one row per case-folded name with the earliest term winning (W3), names already collected
    skipped (J11). The description is cut to ``max_description`` characters and a missing
    ``subscribers`` count is 0, where the catalogue has these columns."""
    from threadscope.operators.matching import lookup_with_fallback

    vocab = drop_numeric_terms(vocabulary.select(F.col(vocabulary.columns[0]).alias("term"))).distinct()
    hits = lookup_with_fallback(vocab, catalog, "term", name, description, relevance=relevance,
                                tiebreak=tiebreak, k=k, exclude_exact=exclude_exact)
    if description in hits.columns:
        hits = hits.withColumn(description, truncate_chars(description, max_description))
    if subscribers in hits.columns:
        hits = hits.withColumn(subscribers, F.coalesce(F.col(subscribers), F.lit(0)))
    first = first_writer_wins(hits, name, ["matched_term", "hit_rank", tiebreak])
    if done is not None:
        first = only_new(first, done.select(F.col(done.columns[0]).alias(name)), [name])
    return first
