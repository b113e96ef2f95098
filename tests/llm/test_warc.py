import base64
import collections
import gzip
import io
import hashlib

import pytest

from inkstrata.llm import warc
from inkstrata.llm.common import fresh_path


def brute(rows, least=0):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    by = collections.defaultdict(list)
    for k, _, h in rows:
        by[digest(h)].append(k)
    out = []
    for k, _, h in rows:
        size = len((h or "").encode())
        most = max((x for x in by[digest(h)] if x is not None), default=None)
        again = size >= least and most is not None and k != most
        out.append((k, size, digest(h), "revisit" if again else "response", most if again else None))
    return sorted(out, key=str)


def rows(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=str)


ODD = [(1, "http://a/b c", "hé"), (2, None, "hé"), (3, "u", None), (4, "u", ""), (None, "u", "hé"), (4, "u", ""), (7, "u\r\nX: y", "a\r\n\r\nWARC/1.1\r\n\r\n"), (None, "q", "only"), (8, "u", "\x1f\x8b" + "x" * 300_000)]
DDL = "page_id long, url string, html string"


@pytest.mark.parametrize("least", [0, 3])
def test_round_trip(spark, least):
    assert rows(warc.archive(spark.createDataFrame(ODD, DDL), least_bytes=least)) == brute(ODD, least)


def test_payloads_and_urls_come_back(spark):
    out = {r.page_id: r for r in warc.archive(spark.createDataFrame(ODD, DDL).where("page_id in (2, 7, 8)")).collect()}
    assert out[2].html == "hé" and out[7].html == ODD[6][2] and out[8].html == ODD[8][2]
    assert out[7].url == "u%20%20X:%20y"


def test_hot_payload(spark):
    many = [(i, "u", "same") for i in range(500)] + [(i, "u", f"own {i}") for i in range(500, 700)]
    assert rows(warc.archive(spark.createDataFrame(many, DDL))) == brute(many)


def test_archives_are_gzip_of_warc_and_the_index_cuts_them(spark):
    path = fresh_path(spark, "warc-test")
    warc.write_monolithic(spark.createDataFrame(ODD, DDL), f"{path}/mono", records_a_file=3)
    index = warc.normalise(spark, f"{path}/mono", f"{path}/members").collect()
    assert len(index) == len(ODD)
    for name in {r.archive for r in index}:
        content = open(name.removeprefix("file://").removeprefix("file:"), "rb").read()
        whole = gzip.decompress(content)
        parts = [gzip.decompress(content[r.offset : r.offset + r.length]) for r in sorted((r for r in index if r.archive == name), key=lambda r: r.offset)]
        assert b"".join(parts) == whole and all(p.startswith(b"WARC/1.1\r\n") and p.endswith(b"\r\n\r\n") for p in parts)


def test_damage_is_an_error():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert list(warc.records(iter([good[:9], good[9:] + good]))) == [good, good]
    for bad in (good[:-2], b"x" + good, good.replace(b"Content-Length: 3", b"X: 3")):
        with pytest.raises(ValueError):
            list(warc.records(iter([bad])))
    two = warc.member(good) + warc.member(good)
    assert b"".join(warc.inflated(io.BytesIO(two), 7)) == good * 2


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], DDL)).count() == 0


def test_string_keys_and_clashing_names(spark):
    rows_ = [("b >%+", "http://x/", "same"), ("a", None, "same"), (None, "u", "same"), ("null", "u", "own")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows_], "page_id string, url string, html string, digest string, salt int")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive(docs).collect()}
    assert got == {"b >%+": ("response", None), "a": ("revisit", "b >%+"), None: ("revisit", "b >%+"), "null": ("response", None)}


def test_a_long_record_among_short_ones(spark):
    long = "0123456789abcdef" * 200_000
    given = [(1, "u", "short"), (2, "u", long), (3, "u", "short too")]
    assert rows(warc.archive(spark.createDataFrame(given, DDL))) == brute(given)
