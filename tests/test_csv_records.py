"""Splittable quoted CSV equals Spark's own multiLine reader, whatever the split size."""

import csv
import io
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadscope.sources import csv_records as C
from threadscope.sources import readers as R

KEY = "spark.sql.files.maxPartitionBytes"


@pytest.fixture()
def split_bytes(spark):
    before = spark.conf.get(KEY)
    yield lambda n: spark.conf.set(KEY, n)
    spark.conf.set(KEY, before)


@given(st.text(alphabet='a,"\n', max_size=60))
@settings(max_examples=500, deadline=None)
def test_states_equal_one_walk_over_the_characters(text):
    def walk(text, inside):
        start, closing = not inside, False
        for c in text:
            if inside:
                if closing and c != '"':
                    inside = closing = False
                elif c == '"':
                    closing = not closing
                    continue
                else:
                    continue
            if c == "\n":
                start = True
            elif c == ",":
                start = True
            elif c == '"' and start:
                inside, start = True, False
            else:
                start = False
        return inside and not closing

    for inside in (False, True):
        state = inside
        for line in text.split("\n"):
            state = C.inside_after(line, state)
        assert state == walk(text, inside)


def _file(path, rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(out.getvalue())


def _random_rows(seed, n):
    rng = random.Random(seed)
    piece = ["a", "é", '"', '""', ",", "\n", "\n\n", " ", "日本", '",', ',"', "x y"]
    cell = lambda: "".join(rng.choice(piece) for _ in range(rng.choice([0, 1, 3, 30])))
    return [["id", "text", "more,\nnames"]] + [[str(i), cell(), cell()] for i in range(n)]


@pytest.mark.parametrize("size", [40, 333, 100_000])
def test_equals_the_multiline_reader(spark, tmp_dir, split_bytes, size):
    folder = os.path.join(tmp_dir, "in")
    os.makedirs(folder)
    for k in range(3):
        _file(os.path.join(folder, f"f{k}.csv"), _random_rows(k, 150))
    options = {"escape": '"', "quote": '"'}
    want = spark.read.option("header", True).option("multiLine", True).options(**options).csv(folder)
    want_rows = sorted(map(str, want.collect()))
    split_bytes(size)
    got = R.read_catalog_csv(spark, folder)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == want_rows
    placed = C.read_quoted_csv(spark, folder, options, place=True).orderBy("file", "start", "at").collect()
    ids = [int(r["id"]) for r in placed if r["file"].endswith("f1.csv")]
    assert ids == list(range(150))
    if size < 1000:
        assert C._lines(spark, folder).rdd.getNumPartitions() > 3


def test_one_record_over_many_splits(spark, tmp_dir, split_bytes):
    p = os.path.join(tmp_dir, "long.csv")
    long = "\n".join(f'line {i} "quoted", more' for i in range(300))
    _file(p, [["id", "text"], ["1", long], ["2", "b"], ["3", long + "!"]], end="\r\n")
    split_bytes(200)
    got = sorted(tuple(r) for r in R.read_flat_csv(spark, p).collect())
    assert got == [("1", long), ("2", "b"), ("3", long + "!")]


def test_open_quote_blank_lines_and_types(spark, tmp_dir, split_bytes):
    p = os.path.join(tmp_dir, "odd.csv")
    with open(p, "w") as f:
        f.write('id,text\n1,a"b\n\n2,"c\n"\n3,"never closed\nto the end')
    for size in (12, 10_000):
        split_bytes(size)
        got = R.read_catalog_csv(spark, p, "id bigint, text string").collect()
        assert sorted((r["id"], r["text"].strip('"')) for r in got) == [(1, 'a"b'), (2, "c\n"), (3, "never closed\nto the end")]


def test_first_row_of_a_key_wins_over_splits(spark, tmp_dir, split_bytes):
    for m in ("a", "b"):
        _file(os.path.join(tmp_dir, f"labels_{m}.csv"), [["subreddit", "post_id", "body", "labels"]] + [["s", str(i % 50), "x\ny", f"l{i}"] for i in range(400)])
    split_bytes(256)
    long = R.read_label_files(spark, [os.path.join(tmp_dir, f"labels_{m}.csv") for m in ("a", "b")])
    assert sorted((r["model"], int(r["post_id"]), r["labels"]) for r in long.collect()) == [(m, i, f"l{i}") for m in ("a", "b") for i in range(50)]


def test_other_splits_than_surveyed_are_an_error(spark, tmp_dir, split_bytes):
    p = os.path.join(tmp_dir, "x.csv")
    _file(p, _random_rows(9, 100))
    split_bytes(300)
    records = C.csv_records(spark, p)
    split_bytes(7)
    with pytest.raises(Exception, match="surveyed"):
        spark.createDataFrame(records.collect(), records.schema)


def test_small_files_are_left_to_the_own_reader(spark, tmp_dir, split_bytes):
    p = os.path.join(tmp_dir, "x.csv")
    _file(p, _random_rows(9, 100))
    split_bytes("64kb")
    assert not C.cuts_files(spark, p) and C._bytes("128MB") == 1 << 27 and C._bytes("77") == 77 and C._bytes("9b") == 9
    assert [int(r["id"]) for r in C.read_quoted_csv(spark, p, {"escape": '"'}, place=True).orderBy("file", "start", "at").collect()] == list(range(100))
    split_bytes("1k")
    assert C.cuts_files(spark, p)


def test_empty_files(spark, tmp_dir):
    p = os.path.join(tmp_dir, "none.csv")
    open(p, "w").write("id,text\n")
    assert R.read_catalog_csv(spark, p).count() == 0
