import hashlib
import random

import pytest

from strandline.llm.common import fresh_path
from strandline.llm.files import whole_file
from strandline.llm.warc import MAGIC, read_warc, record, write_warc

NESTED = record(99, "http://inner/", b"payload", "2020-01-01T00:00:00Z").decode()
BIG = "é" * 600
PAGES = [
    (1, "http://a/", "<html>one</html>"),
    (2, "http://b/\r\nX: y", None),
    (3, None, BIG),
    (4, "http://c/", BIG),
    (5, "http://d/", NESTED * 3 + "x"),
    (6, "http://e/", "WARC/1.0\r\nContent-Length: 5\r\n\r\n" * 50),
    (7, "http://f/", "<html>one</html>"),
    (8, "http://g/", BIG),
    (9, "http://h/", "WARC/1.0\r\n"),
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def want(rows, least=1000):
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        kept = max(j for j, _, g in rows if (g or "") == (h or ""))
        again = len(p) >= least and i < kept
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", kept if again else None))
    return sorted(out)


@pytest.mark.parametrize(("split", "most", "compress"), [(1 << 23, 1 << 28, True), (1 << 23, 1 << 28, False), (64, 1 << 28, False), (100, 2000, True)])
def test_round_trip(spark, split, most, compress):
    uri = fresh_path(spark, "test-warc")
    files = write_warc(pages(spark, PAGES), uri, most=most, compress=compress)
    got = read_warc(spark, uri, files, split).collect()
    assert sorted(tuple(r) for r in got) == want(PAGES)


def test_many_records(spark):
    r = random.Random(1)
    rows = [(i, f"http://x/{i}", r.choice([NESTED, "abc", MAGIC.decode() * 200]) * r.randrange(3)) for i in range(120)]
    uri = fresh_path(spark, "test-warc")
    got = read_warc(spark, uri, write_warc(pages(spark, rows).repartition(1), uri, compress=False), 500).collect()
    assert sorted(tuple(r) for r in got) == want(rows)


def test_edges(spark):
    uri = fresh_path(spark, "test-warc")
    assert read_warc(spark, uri, write_warc(pages(spark, []), uri)).count() == 0
    uri = fresh_path(spark, "test-warc")
    rows = [(None, "u", BIG), (1, "u", BIG), (1, "u", BIG)]
    got = sorted((str(r.page_id), r.record_type) for r in read_warc(spark, uri, write_warc(pages(spark, rows), uri)).collect())
    assert got == [("1", "response"), ("1", "response"), ("None", "revisit")]


def test_damage_is_told(spark):
    uri = fresh_path(spark, "test-warc")
    data = record(1, "u", b"abc", "d") + b"garbage"
    with whole_file(uri, "x.warc", 0) as f:
        f.write(data)
    with pytest.raises(ValueError, match="end at"):
        read_warc(spark, uri, [("x.warc", len(data))])


def test_compressed_record_inside_a_stored_one(spark):
    import gzip

    inner = gzip.compress(record(99, "u", b"inner", "d"), 0, mtime=0)
    data = gzip.compress(record(1, "u", inner, "d"), 0, mtime=0) + gzip.compress(record(2, "u", b"x", "d"), mtime=0)
    uri = fresh_path(spark, "test-warc")
    with whole_file(uri, "x.warc.gz", 0) as f:
        f.write(data)
    assert data.count(bytes([0x1F, 0x8B, 8])) == 3
    assert sorted(r.page_id for r in read_warc(spark, uri, [("x.warc.gz", len(data))]).collect()) == [1, 2]


@pytest.mark.parametrize("compress", [True, False])
def test_ids_of_any_type_and_long_headers(spark, compress):
    rows = [("a/1 é>", "http://x/" + "y" * 70000, BIG), ("zz", "u", BIG), (None, "u", "short"), ("5", None, None)]
    uri = fresh_path(spark, "test-warc")
    files = write_warc(spark.createDataFrame(rows, "page_id string, url string, html string"), uri, compress=compress)
    got = {r.page_id: (r.record_type, r.refers_to) for r in read_warc(spark, uri, files, id_type="string").collect()}
    assert got == {"a/1 é>": ("revisit", "zz"), "zz": ("response", None), None: ("response", None), "5": ("response", None)}
