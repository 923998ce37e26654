"""The study: flat posts -> reply latency -> high-signal sample -> several labellers ->
majority vote -> annotated posts -> label frequency and latency by label.

A1 -> J6 -> X6 -> F2 -> X5 -> F9 -> W1 -> Y1 (x N, each materialised once) -> J7/A5 -> J9
-> G3 -> A3/A4. Shuffles: post id (A1/J6), community (W1), keys (A5), label (A3/A4).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from threadscope.operators.batch import ReplyFn, RetryPolicy, label_posts
from threadscope.operators.consensus import DEFAULT_THRESHOLD, consensus_labels, label_long
from threadscope.operators.latency import enrich_first_last, with_latency
from threadscope.operators.report import annotate_posts, label_frequency, latency_by_label
from threadscope.operators.sampling import select_high_signal
from threadscope.session import reliable_checkpoint


@dataclass(frozen=True)
class Labeller:
    """One labelling set-up: the model function and the reply parser it needs."""

    fn: ReplyFn
    parser: str = "strict"          # 'strict' | 'first_object' | 'fallback'
    cap: int | None = None


@dataclass
class StudyResult:
    sample: DataFrame
    annotated: DataFrame
    frequency: DataFrame
    latency: DataFrame


def run_study(posts: DataFrame, comments: DataFrame, labellers: Mapping[str, Labeller],
              keys: Sequence[str] = ("subreddit", "post_id"), community: str = "subreddit",
              tiebreak: Sequence[str] = ("post_id",), prompt: Callable[[Column], Column] | None = None,
              text_col: str = "body", threshold: int = DEFAULT_THRESHOLD, policy: RetryPolicy = RetryPolicy(),
              partitions: int | None = None) -> StudyResult:
    """Run the study end to end; every labeller's output is checkpointed so no model is
    called twice for a row."""
    posts = with_latency(enrich_first_last(posts, comments))
    # the sample is small (at most cap rows per community); materialise it once so every
    # labeller sees the same rows and the upstream joins are not recomputed per labeller
    sample = reliable_checkpoint(select_high_signal(posts, by=community, tiebreak=list(tiebreak)))
    frames = {}
    for model, lab in labellers.items():
        labelled = label_posts(sample, lab.fn, text_col=text_col, parser=lab.parser, prompt=prompt, cap=lab.cap,
                               policy=policy, partitions=partitions)
        frames[model] = reliable_checkpoint(labelled)
    long = label_long(frames, list(keys))
    cons = consensus_labels(long, list(keys), len(frames), threshold)
    annotated = annotate_posts(sample, cons, list(keys))
    return StudyResult(sample, annotated, label_frequency(annotated), latency_by_label(annotated))
