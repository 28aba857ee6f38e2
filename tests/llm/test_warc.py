import gzip
import random

import pytest

from docketry.llm import warc as w
from tests.llm.conftest import key

ROWS = [
    (1, "http://a", "é" * 20000), (2, "u", "é" * 20000), (3, None, None), (4, "x y\n", ""), (5, "y", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n\r\n\r\n0\r\n\r\n"),
    (6, "y", "ab\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n" * 3000), (7, "z", "é" * 20000), (None, "n", "alone"), (8, "s", "small"), (9, "s", "small"),
    (None, "n", "twice"), (None, "n", "twice"), (10, "t", "again"), (10, "t", "again"), (None, "t", "again"), (11, "http://x/WARC/1.0", "WARC/1."), (12, "e", "WARC/1.WARC/1."),
]


def brute(rows, least=0):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = min((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        revisit = page != first and len(data) >= least
        out.append((page, len(data), w.base32_sha1(data), "revisit" if revisit else "response", first if revisit else None))
    return out


@pytest.mark.parametrize("least, segment, broadcast", [(0, 16 << 10, 10), (6, 1000, 0)])
def test_round_trip(spark, monkeypatch, least, segment, broadcast):
    from pyspark.sql import functions as F

    monkeypatch.setattr(w, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(w, "VALUE_BYTES", 5000)
    monkeypatch.setattr(w, "ARCHIVE_VALUES", 2)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").select("*", F.lit(1).alias("payload"), F.lit(2).alias("n"), F.lit(3).alias("digest"))
    assert key(w.archive_round_trip(pages, least, segment).collect()) == key(brute(ROWS, least))


def test_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    w.write_archives(pages, f"file://{tmp_path}/out", segment_bytes=1000)
    found = {r["page_id"]: bytes(r["payload"]) for r in w.read_archives(spark, f"file://{tmp_path}/out").where("record_type = 'response'").collect() if r["page_id"]}
    assert found[1] == ("é" * 20000).encode() and found[6] == ROWS[5][2].encode() and found[12] == b"WARC/1.WARC/1."


def test_records_are_members_of_their_own(spark, tmp_path):
    """Each gzip member holds one record; names are those of archives; ids of records are unique uuids."""
    import zlib

    w.write_archives(spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/out", segment_bytes=1000)
    (path,) = (tmp_path / "out").glob("*.warc.gz")
    data, members = path.read_bytes(), []
    while data:
        unpack = zlib.decompressobj(31)
        members.append(unpack.decompress(data))
        data = unpack.unused_data
    assert members.pop() == b"" and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)
    ids = [line for m in members for line in m.partition(b"\r\n\r\n")[0].split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(ids) == len(members) == len(set(ids)) and all(b"<urn:uuid:" in x for x in ids)


def test_broken_segments(spark, tmp_path):
    records = w.records_of(5, "http://a", b"x" * 5000, None, False, "a", 1000)
    lost = w.records_of(6, "http://a", b"y" * 5000, None, False, "b", 1000)
    del lost[2]
    mixed = [*records[::-1], *lost]
    (tmp_path / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in mixed[:4]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in mixed[4:]))
    rows = {r["page_id"]: r for r in w.read_archives(spark, f"file://{tmp_path}").collect()}
    assert bytes(rows[5]["payload"]) == b"x" * 5000 and rows[5]["error"] is None
    assert rows[6]["payload"] is None and "segments" in rows[6]["error"]


def foreign(kind, number, block, **fields):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:00000000-0000-0000-0000-{number:012d}>", "WARC-Date": "2020-01-01T00:00:00Z", "Content-Length": len(block)} | {k.replace("_", "-"): v for k, v in fields.items()}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("form", ["plain", "whole", "members"])
def test_archives_of_others(spark, tmp_path, form):
    """Records of other types are skipped, ids are strings, digests of other kinds are let be, broken records are named."""
    html = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>caf\xe9</p>"
    records = [
        foreign("warcinfo", 1, b"software: other\r\n"), foreign("request", 2, b"GET / HTTP/1.1\r\n\r\n"), foreign("response", 3, html, WARC_Target_URI="http://a/", WARC_Payload_Digest="sha1:" + w.base32_sha1(b"<p>caf\xe9</p>")),
        foreign("revisit", 4, b"HTTP/1.1 200 OK\r\n\r\n", WARC_Refers_To="<urn:uuid:00000000-0000-0000-0000-000000000003>"), foreign("response", 5, html, WARC_Payload_Digest="sha256:00ff"),
        foreign("response", 6, html, WARC_Payload_Digest="sha1:" + "A" * 32), foreign("metadata", 7, b"x: WARC/1.0\r\n" * 50), foreign("response", 8, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n"),
        foreign("response", 9, html)[:-20],
    ]
    if form == "plain":
        (tmp_path / "a.warc").write_bytes(b"".join(records))
    else:
        (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(records)) if form == "whole" else b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(b"no archive at all")
    (tmp_path / "c.warc").write_bytes(b"")
    rows = w.read_archives(spark, f"file://{tmp_path}").collect()
    by = {r["record_id"][-2:-1]: r for r in rows if r["record_id"]}
    assert sorted(by) == ["3", "4", "5", "6", "8"] and all(r["page_id"] is None for r in rows)
    assert bytes(by["3"]["payload"]) == bytes(by["5"]["payload"]) == b"<p>caf\xe9</p>" and by["4"]["refers_to"].endswith("0003>") and by["4"]["payload"] is None
    assert "digest" in by["6"]["error"] and by["8"]["error"] and sorted(r["error"][:10] for r in rows if r["record_type"] == "unreadable") == ["a record w", "no record:"]


def test_reader_whatever_blocks_hold():
    """Blocks and heads made of the version line and line ends, cut at every version line."""
    rng = random.Random(2)
    for _ in range(300):
        blocks = [b"".join(rng.choice([b"WARC/1.", b"1", b"\r\n", b"\r\n\r\n", b"a", b"Content-Length: 3\r\n"]) for _ in range(rng.randrange(8))) for _ in range(4)]
        data = b"".join(foreign("response", i, b, WARC_Target_URI="http://a/WARC/1.1" * (i % 2)) for i, b in enumerate(blocks))
        reader, found = w.RecordReader(), []
        for piece in data.split(b"WARC/1."):
            found += list(reader.add("f", piece))
        found += list(reader.end())
        assert [b for _, b in found] == blocks


def test_chunks():
    for n in (0, 1, 4096, 4097, 10000):
        assert w.unchunked(w.chunked(b"a" * n)) == b"a" * n
    with pytest.raises(ValueError):
        w.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_empty(spark):
    assert w.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
