"""Text functions against plain-Python statements of the same rules."""

import re
import textwrap

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadscope.functions import text as T
from threadscope.operators import filters
from tests.conftest import plan_text

PY_WS = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())

URL_RE = re.compile(r"https?://\S+")
EMOJI_RE = re.compile("[\U0001F600-\U0001F64F\U0001F300-\U0001F5FF\U0001F680-\U0001F6FF\U0001F1E0-\U0001F1FF]+")


def py_clean(s):
    s = URL_RE.sub(" ", s or "")
    s = EMOJI_RE.sub(" ", s)
    return re.sub(r"\s+", " ", s.lower()).strip()


HOSTILE = [
    "See https://x.org/a\u00a0next word",          # NBSP ends a URL (not for Java's \\s)
    "Run \U0001F600\U0001F600 fast \U0001F680 ok \u2640 \u2642",  # emoji runs; symbols kept
    "A\u001cB C\u3000D\u0085E\u2028F",              # exotic whitespace
    "HTTP://UPPER.example stays",                     # scheme is case-sensitive before lower()
    "emoji\U0001F600http://inside.url\U0001F600tail and \U0001F1EB\U0001F1F7 flag",
    "  \t lead and trail \n ",
    "",
    "\u03a9\u03bc\u03ad\u03b3\u03b1 \u00c7A \u00e7a \u00dcber stra\u00dfe",
]


def test_whitespace_class_matches_python(spark):
    chars = [chr(i) for i in range(0, 0x3001)] + [" ", " "]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    got = {r["c"] for r in df.where(F.col("c").rlike("^" + T.WS_CLASS + "$")).collect()}
    want = {c for c in chars if c.isspace()}
    assert got == want
    assert set(PY_WS) == want | {c for c in PY_WS if ord(c) > 0x3000}


def test_clean_text_matches_python(spark):
    df = spark.createDataFrame([(s,) for s in HOSTILE] + [(None,)], "s string")
    got = [r[0] for r in df.select(T.clean_text("s")).collect()]
    assert got == [py_clean(s) for s in HOSTILE] + [""]


def test_clean_text_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", "text", T.clean_text("text").alias("c")).collect()
    assert all(r["c"] == py_clean(r["text"]) for r in rows)


def test_trim_and_one_line(spark):
    df = spark.createDataFrame([(s,) for s in HOSTILE], "s string")
    got = [tuple(r) for r in df.select(T.trim_ws("s"), T.one_line("s")).collect()]
    assert got == [(s.strip(), s.replace("\n", " ").strip()) for s in HOSTILE]


@pytest.mark.parametrize("width", [12, 30, 200, 1000, 4000])
def test_shorten_matches_textwrap(spark, width):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    extra = ["one two three four five six seven", "supercalifragilistic word", "a" * 50, "  x  ", ""]
    df = docs.unionByName(spark.createDataFrame([(s,) for s in extra], "text string"))
    rows = df.select("text", T.shorten("text", width, always=True).alias("a"),
                     T.shorten("text", width, always=False).alias("b")).collect()
    bad = 0
    for r in rows:
        want_a = textwrap.shorten(r["text"], width, placeholder=" (…)")
        want_b = r["text"] if len(r["text"]) <= width else want_a
        bad += (r["a"] != want_a) + (r["b"] != want_b)
    assert bad == 0


def test_truncate_fullname_post_text(spark):
    df = spark.createDataFrame([("abc", None, "t3_xyz")], "t string, s string, f string")
    r = df.select(T.truncate_chars("t", 2), T.post_text("t", "s"), T.post_text("s", "s"),
                  T.fullname("t1_", "t"), T.strip_fullname("f"), T.searchable_blob("t", "s", "t")).first()
    assert tuple(r) == ("ab", "abc ", " ", "t1_abc", "xyz", "abc  abc")


def test_to_utc_and_epoch_are_time_zone_free(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(1420070400,)], "e long")  # 2015-01-01T00:00:00Z
        r = df.select(T.utc_year("e"), T.epoch_seconds(T.to_utc("e"))).first()
        assert tuple(r) == (2015, 1420070400)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_render_prompt(spark):
    df = spark.createDataFrame([("als", None, 5)], "name string, d string, n int")
    r = df.select(T.render_prompt("r/{name}: {{raw}} {d}|{n}|{x}", {"x": F.lit("X")})).first()[0]
    assert r == "r/als: {raw} |5|X"


def test_model_and_safe_name(spark):
    df = spark.createDataFrame([("/a/b/labels_gpt-4o.csv", "org/model")], "p string, m string")
    r = df.select(T.model_name_from_path("p"), T.safe_name("m")).first()
    assert tuple(r) == ("gpt-4o", "org_model")


def test_numeric_terms_and_acronyms(spark):
    terms = ["123", "12/3", "1.5", "1 - 2", "4 5", "ALS", "Als", "X1Y", "ALSXYZW", "AB", "H2O", "ß", "SMA ", "abc"]
    df = spark.createDataFrame([(t,) for t in terms], "term string")
    num_re = re.compile(r"^[0-9\s/.,-]+$")
    kept = {r[0] for r in filters.drop_numeric_terms(df).collect()}
    assert kept == {t for t in terms if not num_re.fullmatch(t)}
    acr = {r[0] for r in filters.acronyms(df).collect()}
    assert acr == {t for t in terms if t.isupper() and 3 <= len(t) <= 6}


def test_since_pushes_integer_and_timestamp_literals(spark):
    o = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    plan = plan_text(filters.since(o, "o_orderdate", "1998-01-01"))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate,1998-01-01T00:00)]" in plan
    df = spark.createDataFrame([(1420070399,), (1420070400,)], "created_utc long")
    assert [r[0] for r in filters.since(df).collect()] == [1420070400]


def test_author_filters(spark):
    df = spark.createDataFrame([(a,) for a in ["[deleted]", "[Removed]", "", None, "None", "NA", "bob"]], "author string")
    loose = sorted(r[0] for r in filters.drop_deleted_authors(df).collect())
    strict = sorted(str(r[0]) for r in filters.drop_deleted_authors(df, case_insensitive=False).collect())
    assert loose == ["NA", "None", "bob"]
    assert strict == sorted(["[Removed]", "", "None", "NA", "bob"])


def test_since_timestamp_instant_is_zone_free(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        df = spark.createDataFrame([("2014-12-31T23:59:59Z",), ("2015-01-01T00:00:00Z",)], "s string") \
            .select(F.col("s").cast("timestamp").alias("t"))
        assert filters.since(df, "t").count() == 1
        ntz = spark.createDataFrame([("2015-01-01 00:00:00",), ("2014-12-31 23:59:59",)], "s string") \
            .select(F.col("s").cast("timestamp_ntz").alias("t"))
        assert filters.since(ntz, "t").count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


ALPHABET = ("abcXYZ éÉçÇüÜßΩω019 .,-/:" + "\t\n\x0b\x0c\r\x1c\x1f\x85\xa0  　"
            + "\U0001F600\U0001F680\U0001F1EB♀" + "h")
PIECES = ["http://", "https://x.y/", "HTTP://", "www", "😀", " "]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=ALPHABET, max_size=12), st.sampled_from(PIECES)), max_size=8))
def test_text_functions_match_python_on_random_strings(spark, parts):
    s = "".join(parts)
    df = spark.createDataFrame([(s,)], "s string")
    r = df.select(T.clean_text("s"), T.trim_ws("s"), T.one_line("s"), T.collapse_ws("s")).first()
    assert r[0] == py_clean(s)
    assert r[1] == s.strip()
    assert r[2] == s.replace("\n", " ").strip()
    assert r[3] == " ".join(s.split())
