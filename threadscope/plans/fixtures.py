"""Driver tables mapped onto corpus roles (used by the registered queries and tests).

Role mapping: orders = submissions, lineitem = comments (``l_orderkey`` -> post,
``l_shipdate`` -> time), events = flat objects (``event_type``/``user_id`` =
community, ``value`` = score, ``props.k`` = num_comments), documents = bodies
(``source`` = community), conversations = threads (turn 0 = post, turn n+1
replies to turn n), benchmark passages and part names = vocabularies. The three
label sets VA/VB/VC are derived from ``labels`` and ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadscope.functions.text import epoch_seconds
from threadscope.operators.sizing import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows carry long text, for per-row regex work: spread over the
    cores when the file has fewer splits than the session has cores."""
    return spread(table(spark, sf_dir, name))


def events_as_objects(spark: SparkSession, d: str) -> DataFrame:
    """Events as flat objects: community = event_type, score = value, num_comments = props.k."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_type").alias("subreddit"),
        F.col("user_id"),
        F.col("event_id").alias("post_id"),
        F.col("user_id").cast("string").alias("author"),
        F.col("value").alias("score"),
        F.get_json_object("props", "$.k").cast("bigint").alias("num_comments"),
    )


def order_posts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as submissions: ``post_id``, ``created_utc`` (epoch seconds) and community."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("post_id"), epoch_seconds("o_orderdate").alias("created_utc"),
                    F.col("o_orderpriority").alias("subreddit"), "o_orderstatus", "o_totalprice",
                    "o_custkey", "o_orderdate")


def line_comments(spark: SparkSession, d: str) -> DataFrame:
    """Line items as comments of their order: ``post_id``, ``created_utc``."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("post_id"), epoch_seconds("l_shipdate").alias("created_utc"))


# --- label sets derived from labels and documents ---------------------------------


def label_va(spark: SparkSession, d: str) -> DataFrame:
    """VA: labelled documents; clinical if quality, off_topic if toxic."""
    lab = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "source")
    return lab.join(docs, "doc_id").select(
        "source", "doc_id",
        F.concat_ws(";", F.when(F.col("quality") == 1, F.lit("clinical")),
                    F.when(F.col("toxic") == 1, F.lit("off_topic"))).alias("labels"))


def label_vb(spark: SparkSession, d: str) -> DataFrame:
    """VB: every document, labelled by length band (one band votes twice)."""
    docs = table(spark, d, "documents")
    n = F.col("n_chars")
    lab = (F.when(n < 500, F.lit("experience")).when(n < 2000, F.lit("clinical;news"))
           .when(n < 4000, F.lit("news;news")).otherwise(F.lit("")))
    return docs.select("source", "doc_id", lab.alias("labels"))


def label_vc(spark: SparkSession, d: str) -> DataFrame:
    """VC: every document, labelled by language (untidy separators, NULL for es)."""
    docs = table(spark, d, "documents")
    lang = F.col("lang")
    lab = (F.when(lang == "en", F.lit("clinical")).when(lang == "fr", F.lit("off_topic;clinical"))
           .when(lang == "de", F.lit("experience; clinical")))
    return docs.select("source", "doc_id", lab.alias("labels"))


def label_sets(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"A": label_va(spark, d), "B": label_vb(spark, d), "C": label_vc(spark, d)}


# --- replies built from labels (for the parsers) ---------------------------------


def _label_list(quote: str = '"') -> Column:
    q = lambda s: F.lit(f"{quote}{s}{quote}")
    return F.concat_ws(
        ", ",
        F.when(F.col("quality") == 1, q("clinical")),
        F.when(F.col("toxic") == 1, q("off_topic")),
        q("spam"),
        F.when(F.col("n_chars") > 2000, F.concat_ws(", ", q("news"), q("community"), q("lifestyle"),
                                                     q("advice_giving"))),
    )


def label_replies(spark: SparkSession, d: str) -> DataFrame:
    """Model replies of several shapes, chosen by document language and length."""
    lab = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    base = lab.join(docs, "doc_id")
    lst = _label_list()
    obj = F.concat(F.lit('{"labels": ['), lst, F.lit("]}"))
    reply = (
        F.when((F.col("lang") == "en") & (F.col("n_chars") > 15000),
               F.concat(F.lit('{"result": {"labels": ['), lst, F.lit("]}}")))
        .when(F.col("lang") == "en", obj)
        .when(F.col("lang") == "fr", F.concat(F.lit("Sure! "), obj, F.lit(" Hope it helps.")))
        .when(F.col("lang") == "de", F.concat(F.lit("{'labels': ["), _label_list("'"), F.lit("]}")))
        .when(F.col("toxic") == 1, F.lit('{"labels": "clinical"}'))
        .otherwise(F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
    )
    return base.select("doc_id", reply.alias("reply"))


def verdict_replies(spark: SparkSession, d: str) -> DataFrame:
    """Fenced JSON verdict replies (and a few unusable ones) built from labels."""
    lab = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    base = lab.join(docs, "doc_id")
    is_rare = (F.when(F.col("toxic") == 1, F.lit("not_disease")).when(F.col("quality") == 1, F.lit("yes"))
               .otherwise(F.lit("unsure")))
    prev = F.concat(F.lit("~ 1 / "), F.col("n_chars").cast("string"), F.lit(" 000"))

    def obj(v: Column) -> Column:
        return F.concat(F.lit('{"is_rare":"'), v, F.lit('","prevalence":"'), prev, F.lit('"}'))

    reply = (F.when(F.col("lang") == "es", F.lit("I think it is rare."))
             .when(F.col("lang") == "de", F.concat(F.lit("```json\n"), obj(F.upper(is_rare)), F.lit("\n```")))
             .otherwise(F.concat(F.lit("Here you go:\n```json\n"), obj(is_rare), F.lit("\n```"))))
    return base.select("doc_id", "source", reply.alias("reply"))


def keyword_replies(spark: SparkSession, d: str) -> DataFrame:
    """Keyword verdict replies built from labels."""
    lab = table(spark, d, "labels")
    kw = (F.when(F.col("toxic") == 1, F.lit(" Not_Disease")).when(F.col("quality") == 1, F.lit("RARE\n"))
          .otherwise(F.lit("common.")))
    return lab.select("doc_id", kw.alias("reply"))


# --- threads from conversations ----------------------------------------------------


def conversation_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation nested to one JSON thread, as text (turn n+1 in the replies of turn n)."""
    c = table(spark, d, "conversations")
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    cid = F.col("conv_id").cast("string")

    def opened(x: Column) -> Column:
        """The node without its end: every node is closed after the last one has begun."""
        parent = F.when(x["turn"] == 1, F.concat(F.lit("t3_"), cid)).otherwise(
            F.concat(F.lit("t1_"), cid, F.lit("_"), (x["turn"] - 1).cast("string")))
        node = F.to_json(F.struct(
            F.concat(cid, F.lit("_"), x["turn"].cast("string")).alias("id"), parent.alias("parent_id"),
            x["role"].alias("author"), x["turn"].alias("created_utc"), x["turn"].alias("score"),
            x["text"].alias("body")))
        return F.concat(F.regexp_replace(node, r"\}$", ""), F.lit(',"replies":['))

    comments = F.filter(F.col("t"), lambda x: x["turn"] > 0)
    post = F.element_at(F.col("t"), 1)
    head = F.to_json(F.struct(F.lit("conversations").alias("subreddit"), cid.alias("id"),
                              post["role"].alias("author"), post["turn"].alias("created_utc"),
                              post["turn"].alias("score"), (F.size(F.col("t")) - 1).alias("num_comments"),
                              post["text"].alias("selftext")))
    return turns.select(_nested(head, F.transform(comments, opened)).alias("value"))


def _nested(head: Column, opened: Column) -> Column:
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"comments":['), F.array_join(opened, ""),
                    F.repeat(F.lit("]}"), F.size(opened)), F.lit("]}"))


def conversation_threads(spark: SparkSession, d: str) -> DataFrame:
    return conversation_lines(spark, d).select(F.parse_json("value").alias("thread"))


# Replies in one chain of the deep threads.
CHAIN = 1500


def part_chain_lines(spark: SparkSession, d: str) -> DataFrame:
    """Parts as threads of CHAIN replies, each the reply to the one before."""
    part = table(spark, d, "part").select(F.floor(F.col("p_partkey") / CHAIN).cast("string").alias("g"), "p_partkey", "p_name")
    threads = part.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))).alias("t"))

    def opened(x: Column, i: Column) -> Column:
        parent = F.when(i == 0, F.concat(F.lit("t3_chain"), F.col("g"))).otherwise(
            F.concat(F.lit("t1_p"), F.get(F.col("t"), i - 1)["p_partkey"].cast("string")))
        node = F.to_json(F.struct(F.concat(F.lit("p"), x["p_partkey"].cast("string")).alias("id"), parent.alias("parent_id"),
                                  x["p_name"].alias("body")))
        return F.concat(F.regexp_replace(node, r"\}$", ""), F.lit(',"replies":['))

    head = F.to_json(F.struct(F.lit("parts").alias("subreddit"), F.concat(F.lit("chain"), F.col("g")).alias("id")))
    return threads.select(_nested(head, F.transform(F.col("t"), opened)).alias("value"))


def conversation_objects(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as flat objects: turn 0 a submission, later turns comments."""
    c = table(spark, d, "conversations")
    cid = F.col("conv_id").cast("string")
    is_post = F.col("turn") == 0
    parent = (F.when(is_post, F.lit(None).cast("string"))
              .when(F.col("turn") == 1, F.concat(F.lit("t3_"), cid))
              .otherwise(F.concat(F.lit("t1_"), cid, F.lit("_"), (F.col("turn") - 1).cast("string"))))
    return c.select(
        is_post.alias("is_post"), F.lit("conversations").alias("subreddit"),
        F.when(is_post, cid).otherwise(F.concat(cid, F.lit("_"), F.col("turn").cast("string"))).alias("id"),
        parent.alias("parent_id"), F.col("role").alias("author"), F.col("turn").alias("created_utc"),
        F.col("turn").alias("score"), F.lit(None).cast("bigint").alias("num_comments"),
        F.col("text").alias("body"))
