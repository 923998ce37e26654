"""Caller-supplied batch inference over rows.

The library ships the distributed job, not an API client: ``fn`` maps a list of
prompts to a list of replies (``None`` for a missing reply). It runs inside
an iterator pandas UDF — one client per task, prompts in and replies out as Arrow batches —
with retries and pacing per call. A prompt that still fails keeps its row with an error value;
no row is lost. Replies are parsed by the JVM-side parsers of ``functions.labels``.
"""

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadscope.functions.labels import (
    CAP_FALLBACK,
    CAP_FIRST_OBJECT,
    CAP_STRICT,
    LABEL_NAMES,
    join_labels,
    parse_labels_fallback,
    parse_labels_first_object,
    parse_labels_strict,
)
from threadscope.functions.text import shorten
from threadscope.functions.verdicts import fenced_verdict, verdict_from_keyword
from threadscope.operators.call_log import CallLog, Pacer, PartitionLog, prompt_digest
from threadscope.session import reliable_checkpoint, ship_package

ReplyFn = Callable[[list[str]], Sequence[str | None]]


@dataclass(frozen=True)
class RetryPolicy:
    """``tries`` attempts; waits ``delay`` seconds, multiplied by ``factor`` each time.

    ``RetryPolicy(3, 1.5)`` = three tries 1.5 s apart; ``RetryPolicy(4, 1.0, 2.0)`` =
    four tries with exponential back-off. ``rate`` bounds the calls a second of all tasks together, tries included.
    """

    tries: int = 3
    delay: float = 1.5
    factor: float = 1.0
    min_interval: float = 0.0  # pause between consecutive calls of one task
    rate: float | None = None

    def call(self, fn: ReplyFn, prompts: list[str], pacer: Pacer | None = None) -> tuple[list[str | None], str | None]:
        wait = self.delay
        last: Exception | None = None
        for attempt in range(max(1, self.tries)):
            if pacer:
                pacer.wait()
            try:
                replies = list(fn(prompts))
                if len(replies) != len(prompts):
                    raise ValueError(f"reply count {len(replies)} != prompt count {len(prompts)}")
                return replies, None
            except Exception as exc:  # noqa: BLE001 - any client error is retried
                last = exc
                if attempt + 1 < self.tries:
                    time.sleep(wait)
                    wait *= self.factor
        return [None] * len(prompts), f"{type(last).__name__}: {last}"


PARSERS = {
    "strict": (parse_labels_strict, CAP_STRICT),
    "first_object": (parse_labels_first_object, CAP_FIRST_OBJECT),
    "fallback": (parse_labels_fallback, CAP_FALLBACK),
}


def _ask(chunk: list[tuple[str, str]], fn: ReplyFn, policy: RetryPolicy, pacer: Pacer, log: PartitionLog | None
         ) -> dict[str, tuple[str | None, str | None]]:
    """(reply, error) by digest for a batch of (digest, prompt); logged replies are not asked for again."""
    out = {d: (log.replies[d], None) for d, _ in chunk if log and d in log.replies}
    todo = [(d, p) for d, p in chunk if d not in out]
    if not todo:
        return out
    got, err = policy.call(fn, [p for _, p in todo], pacer)
    if err and len(todo) > 1:  # one bad prompt costs its own reply alone
        for one in todo:
            out |= _ask([one], fn, policy, pacer, log)
        return out
    if log:
        log.add({d: r for (d, _), r in zip(todo, got) if r is not None})
    return out | {d: (r, err or (None if r is not None else "no reply")) for (d, _), r in zip(todo, got)}


def run_batches(df: DataFrame, prompt: Column, fn: ReplyFn, batch_size: int = 32,
                policy: RetryPolicy = RetryPolicy(), partitions: int | None = None,
                reply_col: str = "reply", error_col: str = "reply_error", log: str | None = None) -> DataFrame:
    """Y1 core: add ``reply`` and ``reply_error`` by calling ``fn`` on prompt batches.

    Only the prompt column goes to Python (an iterator pandas UDF); all others stay in the JVM.
    A batch that fails after the last try is asked again prompt by prompt, so one bad prompt
    costs its own reply alone. ``partitions`` bounds the concurrent callers by a round-robin
    repartition; left out, the rows stay where they are and every running task is a caller.

    ``log`` names a folder that all executors see (``call_log``). Replies are written there batch by
    batch; a retried task, or a later run with the same log, asks only what has no reply yet.

    With ``policy.rate`` each distinct prompt is asked once, by ``partitions`` tasks (by default as many
    as the session has cores) of a barrier stage that share the rate; the replies are checkpointed now and joined back.
    """
    ship_package(df.sparkSession)
    spark = df.sparkSession
    names = [F.col(f"`{c}`") for c in df.columns]
    staged = df.withColumns({"_prompt": F.coalesce(prompt.cast("string"), F.lit("")), "_digest": prompt_digest(prompt)})
    calls = CallLog(log) if log else None
    known = calls.known(spark) if calls else None
    if known is not None:
        # a known prompt does not go to Python: its reply comes from the table
        staged = staged.join(known.select(F.col("digest").alias("_digest"), F.col("reply").alias("_known")), "_digest", "left")
        staged = staged.withColumn("_prompt", F.when(F.col("_known").isNull(), F.col("_prompt")))
    else:
        staged = staged.withColumn("_known", F.lit(None).cast("string"))
    if policy.rate:
        return _paced(staged, names, fn, batch_size, policy, partitions, reply_col, error_col, calls)
    staged = staged.repartition(partitions) if partitions else staged
    reply = T.StructType([T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])

    @F.pandas_udf(reply)
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pacer = Pacer(policy.min_interval)
        done = calls.of_partition(TaskContext.get().partitionId()) if calls else None
        for digests, prompts in batches:
            rows = list(zip(digests, prompts))
            got: list[tuple[str | None, str | None]] = []
            for start in range(0, len(rows), batch_size):
                chunk = rows[start:start + batch_size]
                found = _ask([r for r in dict(chunk).items() if r[1] is not None], fn, policy, pacer, done)
                got += [found.get(d, (None, None)) for d, _ in chunk]
            yield pd.DataFrame({"reply": pd.Series([r for r, _ in got], dtype=object), "error": pd.Series([e for _, e in got], dtype=object)})

    # a model may answer differently each time: the call is never duplicated or moved by the optimizer
    answered = staged.withColumn("_answer", ask.asNondeterministic()("_digest", "_prompt"))
    return answered.select(*names, F.coalesce("_known", F.col("_answer.reply")).alias(reply_col),
                           F.col("_answer.error").alias(error_col))


def _paced(staged: DataFrame, names: list[Column], fn: ReplyFn, batch_size: int, policy: RetryPolicy, partitions: int | None,
           reply_col: str, error_col: str, calls: CallLog | None) -> DataFrame:
    spark = staged.sparkSession
    tasks = partitions or spark.sparkContext.defaultParallelism

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pacer = Pacer.of_barrier_task(policy.rate)
        done = calls.of_partition(TaskContext.get().partitionId()) if calls else None
        for frame in frames:
            rows = list(zip(frame["_digest"], frame["_prompt"]))
            for start in range(0, len(rows), batch_size):
                found = _ask(rows[start:start + batch_size], fn, policy, pacer, done)
                yield pd.DataFrame([(d, *r) for d, r in found.items()], columns=["_digest", "_reply", "_error"], dtype=object)

    # dealt by digest: a retried stage finds the same prompts in the same partition, and so its log
    todo = staged.where(F.col("_prompt").isNotNull()).groupBy("_digest").agg(F.min("_prompt").alias("_prompt")).repartition(tasks, "_digest")
    # the shuffle behind it makes the barrier stage one that Spark can run again; a result stage it would give up
    answered = todo.mapInPandas(ask, "_digest string, _reply string, _error string", barrier=True).repartition(tasks, "_digest")
    replies = reliable_checkpoint(answered)
    return staged.join(replies, "_digest", "left").select(
        *names, F.coalesce("_known", "_reply").alias(reply_col), F.col("_error").alias(error_col))


def label_posts(df: DataFrame, fn: ReplyFn, text_col: str = "body", parser: str = "strict",
                prompt: Callable[[Column], Column] | None = None, allowed: Sequence[str] = LABEL_NAMES,
                cap: int | None = None, batch_size: int = 32, policy: RetryPolicy = RetryPolicy(),
                partitions: int | None = None, out: str = "labels", width: int = 4000,
                shorten_always: bool = True, log: str | None = None) -> DataFrame:
    """Label every row with a caller-supplied model function.

    The prompt is the body shortened to ``width`` characters, or what ``prompt`` makes of it (X8;
    ``shorten_always=False`` leaves bodies within the width untouched). Replies are
    parsed with ``parser`` ('strict' X10, 'first_object' X11, 'fallback' X12), filtered
    to ``allowed`` and capped, and stored as an ``a;b`` string; a row whose call
    failed keeps a NULL label and the error text.

    The result is lazy: checkpoint or write it before using it more than once, or a
    recomputation calls the model again; a retried task too, unless ``log`` names a folder for the
    replies (``run_batches``). ``plans.study.run_study`` checkpoints every labeller.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    short = shorten(body, width, always=shorten_always)
    p = prompt(short) if prompt else short
    replied = run_batches(df, p, fn, batch_size, policy, partitions, log=log)
    parse, default_cap = PARSERS[parser]
    parsed = parse(F.col("reply"), allowed, cap or default_cap)
    return replied.withColumn(out, F.when(F.col("reply").isNotNull(), join_labels(parsed)))


def crosscheck_terms(df: DataFrame, fn: ReplyFn, term_col: str = "matched_term",
                     prompt: Callable[[Column], Column] | None = None, strict_parity: bool = False,
                     batch_size: int = 32, policy: RetryPolicy = RetryPolicy(),
                     partitions: int | None = None, log: str | None = None) -> DataFrame:
    """Y2 (second verdict): ask once per **distinct** term, then join the verdict back.

    Adds ``keep`` (yes/no/error) and ``prevalence_est`` from a fenced JSON reply (X13,
    X15); ``strict_parity`` stores errors as ``no``.
    """
    terms = df.select(F.col(term_col).alias("_t")).where(F.col("_t").isNotNull()).distinct()
    p = prompt(F.col("_t")) if prompt else F.col("_t")
    replied = run_batches(terms, p, fn, batch_size, policy, partitions, log=log)
    v = fenced_verdict(F.col("reply"), strict_parity)
    verdicts = replied.select("_t", v["keep"].alias("keep"), v["prevalence_est"].alias("prevalence_est"))
    verdicts = reliable_checkpoint(verdicts)  # once: a retried join must not call the model again
    return df.join(verdicts, df[term_col] == verdicts["_t"], "left").drop("_t")


def verify_candidates(df: DataFrame, fn: ReplyFn, prompt: Column, out: str = "gpt_label",
                      batch_size: int = 32, policy: RetryPolicy = RetryPolicy(),
                      partitions: int | None = None, log: str | None = None) -> DataFrame:
    """Y2 (first verdict): one keyword reply per row -> yes / no / error."""
    replied = run_batches(df, prompt, fn, batch_size, policy, partitions, log=log)
    return replied.withColumn(out, verdict_from_keyword(F.col("reply"))).drop("reply", "reply_error")
