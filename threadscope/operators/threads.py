"""Reply trees to flat rows: projections (P1, P2), nested flattening (G1), flat unification.

The flat row has ten columns: subreddit, post_id, comment_id, parent_id, is_post,
author, created_utc, score, num_comments, body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadscope.functions.text import COMMENT_PREFIX, POST_PREFIX, one_line, strip_fullname
from threadscope.session import reliable_checkpoint

# --- fixed values -------------------------------------------------------------
FLAT_COLUMNS = ("subreddit", "post_id", "comment_id", "parent_id", "is_post",
                "author", "created_utc", "score", "num_comments", "body")
DELETED_AUTHOR = "[deleted]"
# -----------------------------------------------------------------------------


def _flat(subreddit: Column, post_id: Column, comment_id: Column, parent_id: Column, is_post: bool,
          author: Column, created: Column, score: Column, num_comments: Column, body: Column) -> list[Column]:
    return [
        subreddit.cast("string").alias("subreddit"),
        post_id.cast("string").alias("post_id"),
        comment_id.cast("string").alias("comment_id"),
        parent_id.cast("string").alias("parent_id"),
        F.lit(is_post).alias("is_post"),
        F.coalesce(author.cast("string"), F.lit(DELETED_AUTHOR)).alias("author"),
        created.cast("bigint").alias("created_utc"),
        F.coalesce(score.cast("bigint"), F.lit(0).cast("bigint")).alias("score"),
        F.coalesce(num_comments.cast("bigint"), F.lit(0).cast("bigint")).alias("num_comments"),
        one_line(body).alias("body"),
    ]


def project_submission(df: DataFrame, body_col: str = "selftext") -> DataFrame:
    """Canonical submission object (null author -> [deleted], null body -> '')."""
    c = df.columns
    get = lambda name, default=None: F.col(name) if name in c else F.lit(default)
    return df.select(
        F.lit(True).alias("is_post"),
        get("subreddit").cast("string").alias("subreddit"),
        get("id").cast("string").alias("id"),
        F.coalesce(get("author").cast("string"), F.lit(DELETED_AUTHOR)).alias("author"),
        get("created_utc").cast("bigint").alias("created_utc"),
        F.coalesce(get("score").cast("bigint"), F.lit(0).cast("bigint")).alias("score"),
        F.coalesce(get("num_comments").cast("bigint"), F.lit(0).cast("bigint")).alias("num_comments"),
        F.coalesce(get("title").cast("string"), F.lit("")).alias("title"),
        F.coalesce(get(body_col).cast("string"), F.lit("")).alias("body"),
        get("url").cast("string").alias("url"),
    )


def project_comment(df: DataFrame) -> DataFrame:
    """Canonical comment object, same defaults."""
    c = df.columns
    get = lambda name, default=None: F.col(name) if name in c else F.lit(default)
    return df.select(
        F.lit(False).alias("is_post"),
        get("subreddit").cast("string").alias("subreddit"),
        get("parent_id").cast("string").alias("parent_id"),
        get("id").cast("string").alias("id"),
        F.coalesce(get("author").cast("string"), F.lit(DELETED_AUTHOR)).alias("author"),
        get("created_utc").cast("bigint").alias("created_utc"),
        F.coalesce(get("score").cast("bigint"), F.lit(0).cast("bigint")).alias("score"),
        F.coalesce(get("body").cast("string"), F.lit("")).alias("body"),
    )


def flatten_threads(threads: DataFrame, col: str = "thread", checkpoint: bool = True,
                    checkpoint_every: int = 4) -> DataFrame:
    """G1: nested threads (VARIANT) -> one post row plus one row per comment at any depth.

    The post row is its own parent (``t3_<id>``) with an empty ``comment_id``.
    Comments are reached level by level: each level explodes the ``replies`` array of
    the previous level (a narrow, shuffle-free step) until a level is empty. Every
    ``checkpoint_every`` levels the frontier is cut with a reliable checkpoint, so a
    level never re-explodes more than that many levels; there is no recursion limit,
    unlike a recursive CTE. Fragments of a deep thread (``read_threads``) give comments
    but no post, and rows without a thread give nothing.
    """
    v = F.col(col)
    threads = threads.where(v.isNotNull())

    def get(node: Column, field: str, t: str) -> Column:
        return F.try_variant_get(node, f"$.{field}", t)

    posts = threads.select(
        get(v, "subreddit", "string").alias("subreddit"),
        get(v, "id", "string").alias("post_id"),
        get(v, "author", "string").alias("_author"),
        get(v, "created_utc", "bigint").alias("_created"),
        get(v, "score", "bigint").alias("_score"),
        get(v, "num_comments", "bigint").alias("_nc"),
        get(v, "selftext", "string").alias("_body"),
        get(v, "comments", "array<variant>").alias("_kids"),
        F.coalesce(get(v, "_fragment", "boolean"), F.lit(False)).alias("_fragment"),
    )
    levels = [posts.where(~F.col("_fragment")).select(*_flat(F.col("subreddit"), F.col("post_id"), F.lit(""),
                                  F.concat(F.lit(POST_PREFIX), F.col("post_id")), True,
                                  F.col("_author"), F.col("_created"), F.col("_score"), F.col("_nc"),
                                  F.col("_body")))]
    frontier = posts.select("subreddit", "post_id", F.explode("_kids").alias("_node"))
    depth = 0
    while True:
        if not checkpoint or depth % max(1, checkpoint_every) == 0:
            if checkpoint:
                frontier = reliable_checkpoint(frontier)
            if frontier.isEmpty():
                break
        n = F.col("_node")
        levels.append(frontier.select(*_flat(
            F.col("subreddit"), F.col("post_id"), get(n, "id", "string"),
            F.coalesce(get(n, "parent_id", "string"), F.lit("")), False,
            get(n, "author", "string"), get(n, "created_utc", "bigint"), get(n, "score", "bigint"),
            F.lit(0), get(n, "body", "string"))))
        frontier = frontier.select("subreddit", "post_id",
                                   F.explode(get(n, "replies", "array<variant>")).alias("_node"))
        depth += 1
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out


def resolve_roots(comments: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """Root submission of every distinct comment id by pointer doubling: ``(id, post_id)``.

    A ``t3_`` parent is the root; a ``t1_`` parent is followed. Of several rows with one id the first by
    parent counts. Each round joins the open comments with all pointers and doubles the distance they
    look ahead, so a chain of depth d takes about log2(d) rounds. The table is written once per round
    (checkpoint) in a fixed number of partitions. The rounds end when no comment is open, or when a
    round leaves as many open as before the distance could have crossed all of them: those lie on a
    cycle. They, and chains that reach a missing parent, keep ``post_id`` NULL.
    """
    from threadscope.operators.consensus import keep_first

    pid = F.col(parent_col)
    parts = int(comments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = keep_first(comments.select(F.col(id_col).cast("string").alias("_id"), pid.alias("_parent")).where(
        F.col("_id").isNotNull()), ["_id"], ["_parent"])
    state = one.select(
        "_id", F.when(F.col("_parent").startswith(POST_PREFIX), strip_fullname(F.col("_parent"))).alias("_root"),
        F.when(F.col("_parent").startswith(COMMENT_PREFIX), strip_fullname(F.col("_parent"))).alias("_ptr"))
    open_ = F.col("_root").isNull() & F.col("_ptr").isNotNull()
    state = reliable_checkpoint(state.repartition(parts, "_id"))
    pending, reach = state.where(open_).count(), 1
    while pending:
        other = state.select(F.col("_id").alias("_bid"), F.col("_root").alias("_broot"), F.col("_ptr").alias("_bptr"))
        stepped = state.join(other, open_ & (F.col("_ptr") == F.col("_bid")), "left").select(
            "_id", F.coalesce("_root", "_broot").alias("_root"),
            F.when(open_ & F.col("_broot").isNull(), F.col("_bptr")).alias("_ptr"))
        state = reliable_checkpoint(stepped.repartition(parts, "_id"))
        left, reach = state.where(open_).count(), 2 * reach
        if left == pending and reach > left:
            break  # a path of open comments longer than their number repeats one
        pending = left
    return state.select(F.col("_id").alias(id_col), F.col("_root").alias("post_id"))


def unify_flat_objects(objs: DataFrame) -> DataFrame:
    """Flat submission + comment objects -> the ten-column flat table.

    Submissions map directly; a comment's ``post_id`` comes from its parent chain
    (``resolve_roots``, one row per distinct id, so repeated objects stay as many as
    they are). ``is_post`` missing means submission.
    """
    is_post = F.coalesce(F.col("is_post"), F.lit(True))
    posts = objs.filter(is_post)
    comments = objs.filter(~is_post)
    nc = F.col("num_comments") if "num_comments" in objs.columns else F.lit(0)
    post_rows = posts.select(*_flat(
        F.col("subreddit"), F.col("id"), F.lit(""), F.concat(F.lit(POST_PREFIX), F.col("id")), True,
        F.col("author"), F.col("created_utc"), F.col("score"), nc, F.col("body")))
    roots = resolve_roots(comments.select("id", "parent_id"))
    comment_rows = comments.join(roots, "id", "left").select(*_flat(
        F.col("subreddit"), F.col("post_id"), F.col("id"), F.coalesce(F.col("parent_id"), F.lit("")), False,
        F.col("author"), F.col("created_utc"), F.col("score"), F.lit(0), F.col("body")))
    return post_rows.unionByName(comment_rows)
