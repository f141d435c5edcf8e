"""Archives: exact round trip, revisits, assembly of odd transactions."""

import base64
import gzip
import hashlib

import pytest

from quire.llm import queries, warc
from tests.conftest import SF_SMALL


def brute(pages, least=0):
    """Expected digest rows of (page_id, html)."""
    first, out = {}, []
    for i, h in pages:
        b = (h or "").encode()
        if len(b) >= least and i is not None:
            first[b] = min(first.get(b, i), i)
    for i, h in pages:
        b = (h or "").encode()
        again = b in first and i != first[b]
        d = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out.append((i, len(b), d, "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=repr)


def test_query(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()]
    assert sorted(map(tuple, queries.op10_warc(spark, SF_SMALL).collect()), key=repr) == brute(pages)


@pytest.mark.parametrize("least", [0, 4])
def test_edge_rows(spark, least):
    trap = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    texts = [None, "", trap, trap, "é漢😀", "\r\n\r\n", "x" * 300000, "hot", "hot", "hot", "hot!", "hot!", None, "", "\x00\x01"]
    pages = [(i, t) for i, t in enumerate(texts)] + [(None, "hot!"), (None, "alone"), (2, trap), (14, "other"), (5, "\r\n\r\n")]
    urls = [None, "http://a.b/c\r\nX: y", "", "no scheme", "http://h"]
    rows = [(i, urls[k % 5], t, "q") for k, (i, t) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = sorted(map(tuple, warc.captures(df, least=least).collect()), key=repr)
    assert got == brute(pages, least)
    assert warc.captures(df.limit(0)).collect() == []


def test_files_are_archives(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.b/c?d#e", "<p>\r\n\r\n</p>"), (2, "http://a.b/2", "<p>\r\n\r\n</p>")], "page_id long, url string, html string")
    warc.write_archives(df.coalesce(1), str(tmp_path / "w"), records_per_file=4)
    files = sorted((tmp_path / "w").glob("*.gz"))
    assert len(files) == 2
    records = [r for f in files for r in warc.parse(gzip.decompress(f.read_bytes()))]
    assert sorted(h["warc-type"] for h, _ in records) == ["metadata", "metadata", "request", "request", "response", "revisit"]
    assert len({h["warc-record-id"] for h, _ in records}) == 6
    by = {h["warc-type"]: (h, b) for h, b in records}
    assert by["response"][1].endswith(b"\r\n\r\n<p>\r\n\r\n</p>") and by["response"][1].startswith(b"HTTP/1.1 200 OK")
    rows = warc.read_archives(spark, str(tmp_path / "w"), payloads=True).collect()
    assert [bytes(r.payload) for r in rows if r.kind == "response"] == [b"<p>\r\n\r\n</p>"]
    whole = warc.assemble(warc.read_archives(spark, str(tmp_path / "w"), payloads=True)).collect()
    assert len(whole) == 2 and all(r.request.target_uri == r.response.target_uri for r in whole)


def test_assembly_of_partial_and_chained_records(spark):
    rows = [
        ("a", "response", None), ("b", "request", "a"), ("c", "metadata", "b"),  # a chain
        ("d", "request", "e"), ("e", "response", "d"),  # each names the other
        ("f", "response", None), ("g", "metadata", "gone"),
    ]
    df = spark.createDataFrame([(i, k, c) for i, k, c in rows], "record_id string, kind string, concurrent_to string")
    from pyspark.sql import functions as F

    for name, kind in (("target_uri", "string"), ("date", "string"), ("digest", "string"), ("payload_bytes", "long"), ("payload", "binary"), ("fields", "map<string,string>")):
        df = df.withColumn(name, F.lit(None).cast(kind))
    rows = warc.assemble(df).collect()
    got = sorted((tuple(x and x.record_id for x in (r.request, r.response, r.metadata)) for r in rows), key=repr)
    assert got == sorted([("b", "a", "c"), ("d", "e", None), (None, "f", None), (None, None, "g")], key=repr)


def test_parse_refuses_cut_records():
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    with pytest.raises(ValueError):
        list(warc.parse(b"HTTP/1.1 200\r\nContent-Length: 1\r\n\r\nabc"))
    two = gzip.compress(b"WARC/1.1\r\nContent-Length: 1\r\n\r\na\r\n\r\n") * 2
    assert [b for _, b in warc.parse(warc._inflate(memoryview(two)))] == [b"a", b"a"]
