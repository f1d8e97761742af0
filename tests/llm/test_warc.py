"""Archives read back as they were written, and refused when they are damaged."""
import hashlib
import random

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from vacanta.llm import queries, warc
from vacanta.llm.common import new_path

DATE = "2024-01-01T00:00:00Z"
PAGES = "page_id long, url string, html string, record string, same string, payload string, first long"


def pages(spark, rows):
    """pages with clashing extra columns."""
    return spark.createDataFrame([(*r, "r", "s", "p", 1) for r in rows], PAGES)


def archived(spark, rows, **kw):
    path = new_path(spark, "warc")
    warc.write(pages(spark, rows), path, DATE, **kw)
    return path, warc.read(spark, path).collect()


def odd_pages():
    rng = random.Random(9)
    trap = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 40  # looks like the ends of records
    long = "".join(rng.choice("ab é🙂\r\n<>") for _ in range(300_000))
    return [(1, "http://a/", trap), (2, "http://b/x y\r\nX-Page-ID: 9", trap), (3, None, trap), (3, None, trap), (None, "u", trap),
            (4, "u", None), (5, "u", ""), (6, "u", "x" * 999), (7, "u", "x" * 999), (8, "u", "x" * 1000), (9, "u", "x" * 1000),
            (10, "é", long), (11, "é", long + "."), (None, None, "y" * 2000), (None, None, "y" * 2000), (-5, "", "\n" * 1200), (-6, "", "\n" * 1200)]


def test_pages_come_back(spark):
    rows = odd_pages()
    _, got = archived(spark, rows)
    assert len(got) == len(rows)
    left = [(str(i) if i is not None else None, (h or "").encode()) for i, _, h in rows]
    for r in got:
        if r["record_type"] == "response":
            left.remove((r["page_id"], bytes(r["payload"])))
            assert r["refers_to"] is None
        else:
            assert r["payload"] is None
            payload = next(h for i, h in left if i == r["page_id"] and hashlib.sha1(h).hexdigest() == r["payload_digest"])
            left.remove((r["page_id"], payload))
            assert r["payload_bytes"] == len(payload)
    assert not left
    found = {(r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit"}
    assert found == {("1", "3"), ("2", "3"), (None, "3"), ("8", "9"), ("-6", "-5")}


@pytest.mark.parametrize("size", [1, 7, 100, 4096])
def test_segments_of_any_size(spark, size):
    rows = [(k, "u", "z" * n + str(k)) for k, n in enumerate([0, 1, 5, 90, 200, 777, 1500 if size > 1 else 30])]
    path, got = archived(spark, rows, segment_bytes=size)
    assert {(int(r["page_id"]), bytes(r["payload"])) for r in got} == {(i, h.encode()) for i, _, h in rows}
    kinds = [f["warc-type"] for d in spark.read.format("binaryFile").load(path).collect() for f, _ in warc.records(bytes(d["content"]))]
    assert kinds.count("response") == len(rows) and (size >= 4096 or kinds.count("continuation") > 0)


def test_chunks():
    rng = random.Random(1)
    for n in (0, 1, 9, 10, 11, 5000):
        payload = rng.randbytes(n)
        assert warc.unchunked(warc.chunked(payload, 10)) == payload
    assert warc.unchunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nplain") == b"plain"
    for bad in (b"", b"3\r\nabcd\r\n0\r\n\r\n", b"x\r\n", b"-1\r\n\r\n", b"3\r\nab", b"1\r\na\r\n", b"1\r\na\r\n0\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def rewritten(spark, path, change):
    """The archive with its records changed, all in one file."""
    found = [r for d in spark.read.format("binaryFile").load(path).collect() for r in warc.records(bytes(d["content"]))]
    out = [warc._record(f["warc-type"], [(k, v) for k, v in f.items() if k not in ("warc-type", "content-length")], b) for f, b in change(found)]
    new = new_path(spark, "damaged")
    spark.createDataFrame([(bytearray(r),) for r in out], "record binary").coalesce(1).select(F.col("record").cast("string")) \
        .write.option("lineSep", "\r\n\r\n").text(new)
    return new


def test_damage_is_refused(spark):
    rows = [(k, "u", str(k) * 3000) for k in range(4)]
    path, _ = archived(spark, rows, segment_bytes=1000)
    rng = random.Random(3)

    def shuffled(found):
        rng.shuffle(found)
        return found
    back = warc.read(spark, rewritten(spark, path, shuffled)).collect()
    assert {(int(r["page_id"]), bytes(r["payload"])) for r in back} == {(i, h.encode()) for i, _, h in rows}

    def is_part(f, number):
        return f.get("warc-segment-number") == str(number)
    damages = [lambda x: [r for r in x if not is_part(r[0], 2)],                                  # a segment is lost
               lambda x: [r for r in x if not is_part(r[0], 1)],                                  # the origin is lost
               lambda x: [r for r in x if "warc-segment-total-length" not in r[0]],               # the last is lost
               lambda x: x + [r for r in x if is_part(r[0], 2)][:1],                              # one comes twice
               lambda x: [(f, b[:-1] if is_part(f, 2) else b) for f, b in x],                     # bytes are lost
               lambda x: [(f, b.replace(b"1", b"7")) for f, b in x]]                              # bytes are changed
    for change in damages:
        with pytest.raises(Exception, match="segment|payload|bytes|chunk"):
            warc.read(spark, rewritten(spark, path, lambda x: change([(dict(f), b) for f, b in x]))).collect()
    with pytest.raises(ValueError):
        list(warc.records(b"no archive\r\n\r\n"))


def test_revisits_need_their_response(spark):
    rows = [(1, "u", "a" * 2000), (2, "u", "a" * 2000), (3, "u", "a" * 2000)]
    path, _ = archived(spark, rows)
    warc.verify_revisits(warc.read(spark, path))
    with pytest.raises(ValueError):
        warc.verify_revisits(warc.read(spark, path).where("page_id <> '3'"))


def test_no_pages(spark):
    assert archived(spark, [])[1] == []


def test_warc_query(spark, tmp_path):
    given = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url", "html")
    given = given.unionByName(given.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 100_000))
    given.write.parquet(str(tmp_path / "pages.parquet"))
    rows = [tuple(r) for r in given.collect()]
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(i, largest.get(h or "", i))
    expected = set()
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 1000 and largest[h or ""] != i
        expected.add((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", largest[h or ""] if again else None))
    got = queries.QUERIES["op13_warc"](spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert {tuple(r) for r in got.collect()} == expected and got.count() == len(rows)
