"""Vocabulary matching against community text.

J1 ``match_terms``: exact substring matching; terms anchored on their rarest word
are hash-joined to each text's words and verified.
J2 ``match_words``: word n-gram equi-join (scales with any vocabulary size).
J3 ``match_acronyms``: acronyms over rows J1 left unmatched.
J4/J5 name lookups and W3 first-writer-wins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadscope.functions.text import collapse_ws, searchable_blob
from threadscope.operators.filters import acronyms as acronym_filter
from threadscope.session import scratch_path

# --- fixed values -------------------------------------------------------------
# Characters that delimit an upper-case acronym as a word.
ACRONYM_DELIMITER = "[^A-Za-z0-9]+"
# Number of relevance hits a term without an exact name hit may add.
FALLBACK_K = 3
# Substring matching: length of the anchors inside words.
QGRAM = 5
# Counters of the sketch and of the filter of anchors, and texts that the sketch counts.
CELLS = 1 << 20
SKETCH_TEXTS = 500
# Terms, and characters of them, up to which their anchors are broadcast; beyond, the texts' words are filtered and shuffled.
SENT_ANCHORS = 200_000
SENT_CHARS = 1 << 24
# Word n-grams longer than this are found by their first words and verified.
ANCHOR_WORDS = 8
# -----------------------------------------------------------------------------


def _best_term(pairs: DataFrame, keys: Sequence[str], carry: Sequence[str], term: str,
               out: str) -> DataFrame:
    """One term per row: longest first, then the smallest code point order.

    ``row_number() <= 1`` per row key plans a partial WindowGroupLimit before the
    shuffle, so each task forwards one match per row however many terms hit it.
    """
    w = Window.partitionBy(*keys).orderBy(F.length(term).desc(), F.col(term).asc())
    best = pairs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 1)
    return best.select(*keys, *[F.col(f"`{c}`") for c in carry], F.col(term).alias(out))


def _terms(terms: DataFrame, term_col: str, fold: bool) -> DataFrame:
    t = F.col(term_col)
    t = F.lower(t) if fold else t
    return terms.select(t.alias("_term")).where(F.col("_term").isNotNull() & (F.col("_term") != "")).distinct()


def _cell(word: str) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(CELLS))


def _words(left: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys..., _word)``: the distinct words between blanks of every text."""
    return left.select(*keys, F.explode(F.array_distinct(F.split("_text", " "))).alias("_word")).where("_word != ''")


def _terms_by_part(vocab: DataFrame) -> DataFrame:
    """``(_rank, _term, _inner, _piece)``, ranked longest first, then by code points. A text that holds the
    term has every word between the term's first and last blank (``_inner``) as a word of its own; its
    words at the ends may go on. ``_piece`` is the longest part without blanks, which stands inside one
    word (null: the term is blanks alone)."""
    parts = F.split("_term", " ")
    inner = F.when(F.size(parts) > 2, F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(1))), lambda p: p != "")).otherwise(
        F.array().cast("array<string>"))
    longest = F.array_max(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))
    # the ids of a sorted frame rise from partition to partition: a rank without one task that numbers all
    ranked = vocab.orderBy(F.length("_term").desc(), F.col("_term")).select(F.monotonically_increasing_id().alias("_rank"), "_term")
    return ranked.select("_rank", "_term", inner.alias("_inner"), longest["p"].alias("_piece"))


def _rarest_words(terms: DataFrame, left: DataFrame) -> DataFrame:
    """``(_rank, _term, _word)``: each term with the inner word that the fewest texts hold, by a count sketch
    (``CELLS`` counters) over the first ``SKETCH_TEXTS`` texts; the longest of equals. The sketch steers the
    work only: any inner word finds all texts."""
    sketch = _words(left.limit(SKETCH_TEXTS), []).groupBy(_cell("_word").alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    words = terms.select("_rank", "_term", F.explode("_inner").alias("_word")).withColumn("_cell", _cell("_word"))
    counted = words.join(sketch, "_cell", "left")
    return counted.groupBy("_rank", "_term").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)), -F.length("_word"), "_word")).alias("_a")).select(
        "_rank", "_term", F.col("_a._word").alias("_word"))


def _runs(df: DataFrame, column: str, lengths: Sequence[int]) -> DataFrame:
    """``df`` with a row per run of characters (``_gram``) of the given lengths, at every place."""
    placed = df.select("*", F.explode(F.sequence(F.lit(1), F.length(column))).alias("_at"))
    here = F.length(column) - F.col("_at") + 1
    grams = [F.when(here >= n, F.substring(F.col(column), F.col("_at"), F.lit(n))) for n in sorted(lengths)]
    return placed.select("*", F.explode(F.array(*grams)).alias("_gram")).where(F.col("_gram").isNotNull()).drop("_at")


def _inside_words(words: DataFrame, pieces: DataFrame, lengths: Sequence[int], q: int, few: bool) -> DataFrame:
    """``(_word, _piece, _rank)`` for every one of the distinct ``words`` that contains a piece. A piece is
    anchored on the one of its q-character runs that the fewest pieces have; ``few`` anchors are broadcast."""
    grams = _runs(pieces.where(F.length("_piece") >= q), "_piece", [q]).distinct().unionByName(
        pieces.where(F.length("_piece") < q).withColumn("_gram", F.col("_piece")))
    shared = grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    anchors = grams.join(shared, "_gram").groupBy("_piece", "_rank").agg(F.min(F.struct("_n", "_gram")).alias("_a")).select(
        "_piece", "_rank", F.col("_a._gram").alias("_gram"))
    return _runs(words, "_word", lengths).join(F.broadcast(anchors) if few else anchors, "_gram").where(F.col("_word").contains(F.col("_piece"))).select("_word", "_piece", "_rank")


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: the planner then knows its size and broadcasts it or not by the
    session's threshold."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _contained(left: DataFrame, keys: Sequence[str], vocab: DataFrame, q: int, best: bool = False,
               sent_anchors: int = SENT_ANCHORS) -> DataFrame:
    """``(keys..., _term)`` for every row whose ``_text`` contains the term (``best``: its longest term only).

    Texts are taken apart into distinct words, about a tenth of the rows that their character runs would
    be, and one word of each term leads to the texts that may hold it:

    * a term with inner words by the rarest of them, which must be a whole word of the text. Beyond
      ``sent_anchors`` such words a filter of hash cells (at most ``CELLS``, so broadcast) drops the other
      words of the texts before they are shuffled. The texts found are checked for the whole term;
    * other terms by their longest part, looked up inside the distinct words of all texts.

    A common word is no anchor where the term has a rarer one. Where it is the term itself, its texts are
    the result; the join on it is an inner one, which adaptive execution splits. Matches travel as ranks of
    their terms, so the best of a text is a plain minimum, taken before the shuffle.
    """
    terms = _written(_terms_by_part(vocab), "terms")
    inner, alone = F.size("_inner") > 0, F.col("_piece") == F.col("_term")
    kinds = terms.groupBy(inner.alias("inner"), F.when(F.col("_piece").isNotNull(), F.least(F.length("_piece"), F.lit(q))).alias("n"), alone.alias("alone")).agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.length("_term")).alias("size")).collect()  # a row per length up to q, times four at most
    few = {of: all(sum(r[c] for r in kinds if r["inner"] == of) <= most for c, most in (("count", sent_anchors), ("size", SENT_CHARS)))
           for of in (True, False)}  # with inner words, and without: whether their anchors may be broadcast
    sure, unsure = [], []
    if any(r["inner"] for r in kinds):
        anchors, probes = _rarest_words(terms.where(inner), left), _words(left, keys)
        if few[True]:
            anchors = F.broadcast(anchors)
        else:
            anchors = _written(anchors, "anchors")
            cells = F.broadcast(anchors.select(_cell("_word").alias("_cell")).distinct())  # at most CELLS numbers
            probes = probes.withColumn("_cell", _cell("_word")).join(cells, "_cell", "left_semi").drop("_cell")
        unsure.append(probes.join(anchors, "_word"))
    lengths = sorted({r["n"] for r in kinds if not r["inner"] and r["n"]})
    if lengths:
        own = terms.where(~inner & F.col("_piece").isNotNull())
        # a part that is a term has that term's rank
        pieces = own.groupBy("_piece").agg(F.min(F.when(alone, F.col("_rank"))).alias("_rank"))
        # few bytes, much work: adaptive execution would leave them to a task or two
        words = _words(left, []).distinct().repartition(left.sparkSession.sparkContext.defaultParallelism)
        hits = _inside_words(words, pieces, lengths, q, few[False])
        of_word = hits.where(F.col("_rank").isNotNull()).select("_word", "_rank")
        if best:  # of the terms inside a word only the best can be its text's best
            of_word = of_word.groupBy("_word").agg(F.min("_rank").alias("_rank"))
        sure.append(_words(left, keys).join(_written(of_word, "word-terms"), "_word").select(*keys, "_rank"))
        if any(not r["inner"] and r["n"] and not r["alone"] for r in kinds):
            longer = own.where(~alone).select("_rank", "_term", "_piece")
            unsure.append(_words(left, keys).join(hits.select("_word", "_piece").join(longer, "_piece"), "_word"))
    if any(not r["inner"] and r["n"] is None for r in kinds):
        blanks = left.select(*keys, F.explode(F.sequence(F.lit(1), F.array_max(F.transform(
            F.regexp_extract_all("_text", F.lit(" +"), 0), lambda b: F.length(b))))).alias("_n"))
        sure.append(blanks.join(terms.where(F.col("_piece").isNull()).select("_rank", F.length("_term").alias("_n")), "_n").select(*keys, "_rank"))
    for pairs in unsure:
        # the pairs go to the text once; its other columns stay behind
        sure.append(pairs.select(*keys, "_rank", "_term").distinct().join(left.select(*keys, "_text"), list(keys)).where(
            F.col("_text").contains(F.col("_term"))).select(*keys, "_rank"))
    if not sure:
        return left.select(*keys).limit(0).withColumn("_term", F.lit(None).cast("string"))
    found = reduce(DataFrame.unionByName, sure)
    found = found.groupBy(*keys).agg(F.min("_rank").alias("_rank")) if best else found.distinct()
    return found.join(terms.select("_rank", "_term"), "_rank").select(*keys, "_term")


def match_terms(df: DataFrame, text_col: str, terms: DataFrame, keys: Sequence[str],
                term_col: str = "term", out: str = "matched_term", fold: bool = True, q: int = QGRAM) -> DataFrame:
    """Rows whose (lower-cased) text contains a term, with one matched term each.

    Unmatched rows are dropped. ``keys`` must identify a row of ``df``. The matched
    term is the lower-cased term; the longest wins, then code-point order (the
    choice is deterministic). Anchored equi-joins for any vocabulary (``_contained``).
    """
    keys = list(keys)
    vocab = _terms(terms, term_col, fold)
    text = F.lower(F.col(text_col)) if fold else F.col(text_col)
    left = df.select(*keys, text.alias("_text"))
    return df.join(_contained(left, keys, vocab, q, best=True).withColumnRenamed("_term", out), keys, "inner")


def word_ngrams(text: Column, lengths: Sequence[int]) -> Column:
    """Distinct space-delimited word n-grams (n in ``lengths``) of whitespace-collapsed text.

    One linear regex pass per n: a lookahead anchored at each word start captures the
    next n words (no per-element higher-order function over the word array).
    """
    s = collapse_ws(text)
    runs = [F.regexp_extract_all(s, F.lit("(?<![^ ])(?=([^ ]+" + "(?: [^ ]+)" * (n - 1) + "))"), 1)
            for n in lengths]
    return F.array_distinct(F.concat(*runs) if len(runs) > 1 else runs[0])


def match_words(df: DataFrame, text_col: str, terms: DataFrame, keys: Sequence[str],
                term_col: str = "term", out: str = "matched_term", fold: bool = True) -> DataFrame:
    """Word-boundary matching as an equi-join on word n-grams.

    Text and terms are lower-cased (``fold``) and whitespace-collapsed; a term
    matches when it equals a run of consecutive words. Each row explodes into its
    distinct n-grams, only of lengths that terms have, and joins the vocabulary on
    equality — a hash join that needs no broadcast to scale. Terms of more than
    ``ANCHOR_WORDS`` words join on their first words and are verified after. Best term as in J1.
    """
    keys = list(keys)
    t = F.col(term_col)
    norm = collapse_ws(F.lower(t) if fold else t)
    vocab = terms.select(norm.alias("_term")).where(F.col("_term") != "").distinct()
    n = F.size(F.split("_term", " "))
    lengths = [r[0] for r in vocab.select(F.least(n, F.lit(ANCHOR_WORDS)).alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return df.limit(0).withColumn(out, F.lit(None).cast("string"))
    text = F.lower(F.col(text_col)) if fold else F.col(text_col)
    # only keys travel with the exploded n-grams; matched rows are joined back once
    grams = df.select(*keys, F.explode(word_ngrams(F.coalesce(text, F.lit("")), lengths)).alias("_anchor"))
    anchored = vocab.withColumn("_anchor", F.array_join(F.slice(F.split("_term", " "), 1, ANCHOR_WORDS), " "))
    hits = grams.join(anchored, "_anchor", "inner")
    if lengths[-1] == ANCHOR_WORDS:
        body = df.select(*keys, collapse_ws(F.coalesce(text, F.lit(""))).alias("_body"))
        long = hits.where(n > ANCHOR_WORDS).join(body, keys, "inner").where(
            F.concat(F.lit(" "), "_body", F.lit(" ")).contains(F.concat(F.lit(" "), "_term", F.lit(" ")))).drop("_body")
        hits = hits.where(n <= ANCHOR_WORDS).unionByName(long)
    best = _best_term(hits, keys, [], "_term", out)
    return df.join(best, keys, "inner")


def match_acronyms(df: DataFrame, text_col: str, acronym_terms: DataFrame, keys: Sequence[str],
                   term_col: str = "term", case: str = "exact", out: str = "matched_term") -> DataFrame:
    """Acronym matches.

    ``case='exact'``: substring of the lower-cased text (what a >=95 partial-ratio
    test reduces to for 3-6 letter acronyms). ``case='upper'``: the acronym as a
    whole word of the original-case text (equi-join on word tokens).
    The matched term is the acronym as written.
    """
    keys = list(keys)
    acr = acronym_filter(acronym_terms.select(F.col(term_col).alias("term")), "term")
    if case == "exact":
        m = match_terms(df, text_col, acr.select(F.lower("term").alias("_t"), "term"),
                        keys, term_col="_t", out="_lower")
        # map the lower-case hit back to the acronym's spelling (smallest when several)
        spell = acr.groupBy(F.lower("term").alias("_lower")).agg(F.min("term").alias(out))
        return m.join(spell, "_lower", "inner").drop("_lower")
    if case != "upper":
        raise ValueError("case must be 'exact' or 'upper'")
    tokens = df.select(*keys, F.explode(F.array_distinct(
        F.split(F.coalesce(F.col(text_col), F.lit("")), ACRONYM_DELIMITER))).alias("_term"))
    pairs = tokens.join(acr.select(F.col("term").alias("_term")).distinct(), "_term", "inner")
    return df.join(_best_term(pairs, keys, [], "_term", out), keys, "inner")


def find_candidates(df: DataFrame, text_col: str, terms: DataFrame, keys: Sequence[str],
                    term_col: str = "term", acronym_case: str = "exact",
                    acronyms_in_substring_pass: bool = True) -> DataFrame:
    """J1 then J3 on the rows J1 left unmatched; adds ``match_kind`` ('term'/'acronym').

    Parity setting (``acronym_case='exact'``, acronyms in the substring pass): the
    acronym pass cannot add rows. ``acronym_case='upper'`` with
    ``acronyms_in_substring_pass=False`` matches acronyms only as whole upper-case
    words, so "ALS" no longer hits "also".
    """
    keys = list(keys)
    vocab = terms.select(F.col(term_col).alias("term"))
    first_vocab = vocab
    if not acronyms_in_substring_pass:
        first_vocab = vocab.join(acronym_filter(vocab, "term"), "term", "left_anti")
    hit = match_terms(df, text_col, first_vocab, keys).withColumn("match_kind", F.lit("term"))
    if acronyms_in_substring_pass and acronym_case == "exact":
        return hit  # an acronym is a term too: the first pass found all that the second could
    rest = df.join(hit.select(*keys), keys, "left_anti")
    acr = match_acronyms(rest, text_col, vocab, keys, case=acronym_case).withColumn(
        "match_kind", F.lit("acronym"))
    return hit.unionByName(acr)


def lookup_by_name(terms: DataFrame, catalog: DataFrame, term_col: str = "term",
                   name_col: str = "name", exclude: Column | None = None) -> DataFrame:
    """Catalogue rows whose name equals a term, case-insensitively (equi-join).

    ``exclude`` drops catalogue rows first (e.g. ``F.col('over18')``).
    """
    cat = catalog if exclude is None else catalog.filter(~F.coalesce(exclude, F.lit(False)))
    t = terms.select(F.col(term_col).alias("matched_term"), *[c for c in terms.columns if c != term_col])
    return t.join(cat, F.lower(t["matched_term"]) == F.lower(cat[name_col]), "inner")


def first_writer_wins(df: DataFrame, name_col: str = "name", order: Sequence[str | Column] = ("term_rank",)
                      ) -> DataFrame:
    """One row per case-folded name, the earliest by ``order`` (a total order)."""
    from threadscope.operators.consensus import keep_first

    staged = df.withColumn("_name_key", F.lower(F.col(name_col)))
    return keep_first(staged, ["_name_key"], list(order)).drop("_name_key")


def lookup_with_fallback(terms: DataFrame, catalog: DataFrame, term_col: str = "term",
                         name_col: str = "name", desc_col: str | None = "public_description",
                         relevance: Sequence[Column] | None = None, tiebreak: str = "name",
                         k: int = FALLBACK_K, exclude_exact: Column | None = None) -> DataFrame:
    """Exact name hits (J4); terms without one get their top-k relevance hits.

    Fallback hits are catalogue rows whose ``name + description`` contains the term
    (case-folded, J1's anchored join), ranked by ``relevance``, ``tiebreak`` and then a digest of the whole
    row, so the answer does not depend on the order of the input; ``row_number() <= k`` is a
    constant limit so Spark trims each term's hits per task before the shuffle.
    Adds ``hit_kind`` ('exact'/'fallback') and ``hit_rank``.
    """
    exact = lookup_by_name(terms, catalog, term_col, name_col, exclude_exact)
    exact = exact.withColumn("hit_kind", F.lit("exact")).withColumn("hit_rank", F.lit(1))
    missing = terms.join(exact.select(F.col("matched_term").alias(term_col)).distinct(), term_col, "left_anti")
    blob = searchable_blob(name_col, desc_col) if desc_col else F.col(name_col)
    vocab = missing.select(F.lower(F.col(term_col)).alias("_term"), F.col(term_col).alias("matched_term"))
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in catalog.columns]), {"ignoreNullFields": "false"})
    cat = catalog.withColumn("_row", F.md5(whole.cast("binary")))
    found = _contained(cat.select("_row", F.lower(blob).alias("_text")).distinct(), ["_row"],
                       vocab.select("_term").where("_term != ''").distinct(), QGRAM)
    pairs = found.join(vocab, "_term").join(cat, "_row")
    rel = list(relevance) if relevance else []
    w = Window.partitionBy("matched_term").orderBy(*rel, F.col(tiebreak).asc(), F.col("_row").asc())
    fb = (pairs.drop("_term").withColumn("hit_rank", F.row_number().over(w)).drop("_row")
          .filter(F.col("hit_rank") <= k).withColumn("hit_kind", F.lit("fallback")))
    return exact.unionByName(fb, allowMissingColumns=True)
