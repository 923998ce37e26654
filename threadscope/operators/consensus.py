"""Multi-labeller consensus: dedupe (W2), alignment (J7), votes (A5), summaries (A6, A8), attach."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadscope.functions.labels import LABEL_SEPARATOR, split_labels

# --- fixed values -------------------------------------------------------------
# Votes needed for a label to enter the consensus.
DEFAULT_THRESHOLD = 2
# Key columns of a labelled row (the post/comment identity).
DEFAULT_KEYS = ("subreddit", "post_id", "comment_id")
# -----------------------------------------------------------------------------


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first by ``order`` (ascending, nulls first).

    ``row_number() <= 1`` over the key lets Spark insert a partial WindowGroupLimit
    before the shuffle: each map task forwards at most one row per key, so a key
    repeated millions of times does not pile up in one task. Remaining (orderable)
    columns are appended to ``order`` so the choice is deterministic.
    """
    keys = list(keys)
    named = {o for o in order if isinstance(o, str)}
    rest = [F.col(f"`{f.name}`") for f in df.schema.fields
            if f.name not in keys and f.name not in named and not isinstance(f.dataType, T.MapType)]
    w = Window.partitionBy(*keys).orderBy(*[F.col(o) if isinstance(o, str) else o for o in order], *rest)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 1).drop("_rn")


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of rows whose key occurs more than once (all copies counted)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0))
                       .cast("bigint").alias("duplicate_rows"))


def select_labels_only(df: DataFrame, keys: Sequence[str], model: str, labels: str = "labels") -> DataFrame:
    """Key columns plus one labels column named after the model (wide form)."""
    return df.select(*keys, F.col(labels).alias(model))


def label_long(frames: Mapping[str, DataFrame], keys: Sequence[str], labels: str = "labels",
               dedupe_order: Sequence[str | Column] | None = None) -> DataFrame:
    """P9 + U2: per-model frames -> one long table ``(keys..., model, labels)``.

    Each model's duplicate keys are reduced to the first row (W2) by ``dedupe_order``, or by the
    labels where no order is given, so no key votes twice for one model.
    """
    parts = []
    for model, f in frames.items():
        part = f.select(*keys, F.col(labels).alias("labels"), *(
            [F.col(o) if isinstance(o, str) else o for o in dedupe_order] if dedupe_order else []))
        part = keep_first(part, keys, [c for c in part.columns if c not in keys and c != "labels"]
                          ).select(*keys, "labels")
        parts.append(part.withColumn("model", F.lit(model)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*keys, "model", "labels")


def consensus_labels(long: DataFrame, keys: Sequence[str], n_models: int,
                     threshold: int = DEFAULT_THRESHOLD, distinct_per_model: bool = False,
                     out: str = "consensus_labels", sep: str = LABEL_SEPARATOR) -> DataFrame:
    """J7 + A5: keys present in every model, with the labels that got ``threshold`` votes.

    One shuffle on the keys: each group holds one row per model, so group size is
    bounded by the number of models. Votes are a multiset (``a;a`` from one model
    counts twice) unless ``distinct_per_model``. The result is sorted and joined with
    ``;``; a key with no label at the threshold gets ''.
    """
    if n_models < 2:
        raise ValueError("a consensus needs at least two label sets")
    votes = split_labels("labels")
    if distinct_per_model:
        votes = F.array_distinct(votes)
    g = long.groupBy(*keys).agg(
        F.size(F.collect_set("model")).alias("_m"),
        F.flatten(F.collect_list(votes)).alias("_v"),
    ).filter(F.col("_m") == n_models)
    winners = F.filter(F.array_distinct(F.col("_v")),
                       lambda x: F.size(F.filter(F.col("_v"), lambda y: y == x)) >= threshold)
    return g.select(*keys, F.array_join(F.array_sort(winners), sep).alias(out))


def align_models(long: DataFrame, keys: Sequence[str], n_models: int) -> DataFrame:
    """Keys present in all ``n_models`` label sets (one shuffle)."""
    return (long.groupBy(*keys).agg(F.size(F.collect_set("model")).alias("_m"))
            .filter(F.col("_m") == n_models).select(*keys))


def attach_consensus(base: DataFrame, consensus: DataFrame, keys: Sequence[str],
                     col: str = "consensus_labels") -> DataFrame:
    """Every base row with its consensus (NULL when the key is not aligned)."""
    return base.join(consensus.select(*keys, col), list(keys), "left")


def label_summary(df: DataFrame, col: str = "consensus_labels", sep: str = LABEL_SEPARATOR) -> DataFrame:
    """Rows, '' rows, NULL rows, distinct labels and their sorted list.

    The counts are one aggregate over the rows. Labels are made distinct by a shuffle of
    their own first; only the vocabulary, the answer itself, is gathered.
    """
    c = F.col(col)
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(c == "").alias("n_empty"),
                    F.count_if(c.isNull()).alias("n_null"))
    labels = df.select(F.explode(split_labels(col, sep)).alias("_l")).distinct().agg(
        F.count("_l").alias("n_distinct"), F.array_join(F.array_sort(F.collect_list("_l")), sep).alias("labels"))
    both = counts.unionByName(labels, allowMissingColumns=True)  # two rows
    return both.agg(*[F.max(x).alias(x) for x in ("n_rows", "n_empty", "n_null", "n_distinct", "labels")])
