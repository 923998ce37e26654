import base64
import hashlib

import pytest
import zstandard

from threadscope.llm import warc


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


PAGES = [(1, "http://a.example/x y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b.example/\r\n", None), (4, "u", ""), (5, "u", "é" * 5000),
         (None, "u", "<p>one</p>"), (None, "u", "alone"), (6, "u", "<p>six</p>"), (6, "u", "<p>six</p>"), (7, "u", "x" * 3_000_000), (-8, "u", "neg\r\n\r\nX: 1")]
SCHEMA = "page_id long, url string, html string, payload string, sha1 string, refers_to long, last long"


def expected():
    last = {}
    for i, _, html in PAGES:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    out = []
    for i, _, html in PAGES:
        p = (html or "").encode()
        best = last.get(html or "")
        again = best is not None and i != best
        out.append((i, len(p), digest(p), "revisit" if again else "response", best if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([(*p, "p", "s", 1, 2) for p in PAGES], SCHEMA)
    got = warc.round_trip(df, f"{tmp_dir}/warc").collect()
    assert all(r["error"] is None for r in got)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected()
    assert {bytes(r["payload"]) for r in got if r["payload"] is not None} == {(h or "").encode() for _, _, h in PAGES}
    assert {r["url"] for r in got if r["page_id"] in (1, 2, 3)} == {"http://a.example/x%20y", None, "http://b.example/%0D%0A"}


def test_empty_table(spark, tmp_dir):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA), f"{tmp_dir}/none").count() == 0


def archive(dictionary, records, packed=True):
    plain = zstandard.ZstdCompressionDict(dictionary)
    body = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
    return warc._skippable(warc.DICTIONARY_MAGIC, body) + b"".join(zstandard.ZstdCompressor(dict_data=plain).compress(r) for r in records)


@pytest.mark.parametrize("packed", [True, False])
def test_dictionary_in_the_leading_frame(packed):
    dictionary = warc.train_dictionary([f"<html><body>page {i} of the site</body></html>".encode() * 3 for i in range(400)], 4096)
    records = [warc.record(i, "u", b"<html>%d" % i, None) for i in range(5)]
    rows = list(warc._rows(archive(dictionary, records, packed)))
    assert [r["page_id"] for r in rows] == list(range(5)) and not any(r["error"] for r in rows)


def test_bad_records_are_reported_and_the_rest_is_read():
    good = warc.record(1, "u", b"payload", None)
    bad = [good.replace(b"Content-Length: 7\r\n", b"Content-Length: 8\r\n"), good.replace(b"payload\r\n", b"PAYLOAD\r\n"), good[:-2],
           good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Date", b"X-Date"), b""]
    rows = list(warc._rows(archive(b"some dictionary", [*bad, good])))
    assert [r["error"] is None for r in rows] == [False] * len(bad) + [True]
    whole = archive(b"some dictionary", [good, good])
    rows = list(warc._rows(whole[:-5]))
    assert rows[0]["page_id"] == 1 and rows[1]["error"]
