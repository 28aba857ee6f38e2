"""Pages to WARC archives and back, with segmented records and revisits of equal payloads.

Every record is a gzip member of its own. Members are put together in a task, up to a bounded
size, and are values of Spark's text sink, so files go through Spark's commit protocol to any
file system; the sink's separator is an empty gzip member. Archives, plain or gzipped, are read by
Spark's text source, cut at the version line that starts a record, so a file streams through a
task whatever its size.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import prepare, read, shared_path, stored

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 0
#: Block bytes of a record; longer blocks continue in further records.
SEGMENT_BYTES = 16 << 10
#: Bytes of members in one value, and values in one archive, so an archive has 1 GB or little more.
VALUE_BYTES, ARCHIVE_VALUES = 16 << 20, 64
#: Different payloads with more than one page that are broadcast (about 60 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 200_000
CHUNK_BYTES = 4096
CRLF = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: What every record starts with; what is between two of them is a piece.
VERSION = "WARC/1."

_LEAD = "page_id long, record_id string, record_type string, refers_to string, refers_to_page long, payload_digest string"
PARSED = _LEAD + ", payload binary, n long, error string, origin string, segment int, total long, block binary"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for i in range(0, len(payload), size) if (p := payload[i : i + size])]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if its framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != CRLF:
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + n])
        at += n + 2


def _member(data: bytes) -> bytes:
    """A gzip member without name or time."""
    pack = zlib.compressobj(1, wbits=31)
    return pack.compress(data) + pack.flush()


def _record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("Content-Length", len(block))])
    return f"{VERSION}1\r\n{head}\r\n".encode() + block


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, parts)))}>"


def records_of(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, row: str, segment_bytes: int) -> list[bytes]:
    """The records of one page: a revisit, or a response and its continuations; ``row`` makes their ids different from those of other rows.

    The page's id, and that of the page that a revisit repeats, are fields of our own.
    """
    origin = _record_id(row, 1)
    uri = " ".join((url or "").split()) or "about:blank"
    named = [("WARC-Record-ID", origin), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    named += [("X-Page-ID", page_id)] * (page_id is not None)
    if revisit:
        return [_record("revisit", [*named, ("WARC-Profile", PROFILE)] + [("X-Refers-To-Page-ID", refers_to)] * (refers_to is not None), HTTP)]
    block = HTTP + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        return [_record("response", named, block)]
    out = [_record("response", [*named, ("WARC-Segment-Number", 1)], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        fields = [("WARC-Record-ID", _record_id(row, i)), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", i)]
        out.append(_record("continuation", fields + [("WARC-Segment-Total-Length", len(block))] * (i == len(parts)), part))
    return out


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write every row of ``pages`` (page_id, url, html; null html: empty) to archives in ``path``.

    Of rows with equal payloads of ``min_revisit_bytes`` or more, that with the smallest page_id
    is a response and the others revisit it; rows that repeat that page_id are responses too. If
    all ids of a payload are null, all its rows are responses. Payloads that repeat are found on
    their digests alone; payloads are not shuffled unless very many different ones repeat. A very
    long payload is one row of Spark's and must fit a task; its records are SEGMENT_BYTES each.
    """
    prepare(pages.sparkSession)
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    keyed = keyed.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("n", F.length("payload"))
    many = keyed.where(F.col("n") >= min_revisit_bytes).groupBy("digest", "n").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("rows"))
    many = stored(many.where("rows > 1").select("digest", "n", "refers_to"), "repeated-payloads")
    many = F.broadcast(many) if many.count() <= MOST_BROADCAST else many
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    rows = keyed.join(many, ["digest", "n"], "left").select("page_id", "url", "payload", "refers_to", revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, members, held = TaskContext.get().partitionId(), 0, [], 0
        archive = lambda parts: pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["archive"])
        for batch in batches:
            for i in range(batch.num_rows):
                n += 1
                for record in records_of(*(batch.column(k)[i].as_py() for k in range(5)), f"{path}:{task}:{n}", segment_bytes):
                    members.append(_member(record + CRLF + CRLF))
                    held += len(members[-1])
                if held >= VALUE_BYTES:
                    yield archive(members)
                    members, held = [], 0
        if members:
            yield archive(members)

    archives = rows.mapInArrow(write, "archive binary").select(F.col("archive").cast("string").alias("value"))
    last = _member(b"").decode("latin-1")
    archives.write.option("lineSep", last).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", ARCHIVE_VALUES).text(path)
    _name_archives(pages.sparkSession, path)


def _name_archives(spark: SparkSession, path: str) -> None:
    """Give the sink's files the names of gzipped archives: one step on the file system for each archive, and none on its bytes."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc.gz"))


def _headers(head: bytes) -> dict[str, str]:
    """The fields of a record's head by lower-case name; lines that start with white space continue the one before."""
    lines = head.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


class RecordReader:
    """Records from pieces, given in order of a file: what stands after one VERSION and before the next.

    A block may hold VERSION itself; the length of the block says how many pieces it spans. A
    piece that is no record, or a record that the file ends in, gives a record of type
    ``unreadable`` with its error.
    """

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.file: str | None = None
        self.missing, self.headed = 0, False

    def add(self, file: str, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        if file != self.file:
            yield from self.end()
            self.file = file
            if not piece.strip():
                return  # before the first record
        if self.missing > 0 and self.parts:
            self.parts.append(VERSION.encode() + piece)
            self.missing -= len(VERSION) + len(piece)
        else:
            self.parts, self.missing = [piece], 0
        if not self.headed:
            head, mark, _ = (piece if len(self.parts) == 1 else b"".join(self.parts)).partition(b"\r\n\r\n")
            length = _headers(head).get("content-length", "") if mark else ""
            self.headed = bool(mark) or not re.match(rb"\d\s*\r\n", head)
            self.missing = len(head) + 4 + int(length) - sum(map(len, self.parts)) if length.isdigit() else 0 if self.headed else 1 << 62
        if self.missing <= 0:
            yield from self.end()

    def end(self) -> Iterator[tuple[dict[str, str], bytes]]:
        if self.parts:
            data, cut = b"".join(self.parts), self.missing > 0
            self.parts, self.missing, self.headed = [], 0, False
            head, mark, rest = data.partition(b"\r\n\r\n")
            headers = _headers(head)
            length = headers.get("content-length", "")
            if not mark or cut or not length.isdigit():
                yield {"warc-type": "unreadable", "error": "a record without its end" if cut else f"no record: {data[:40]!r}"}, b""
            else:
                yield headers, rest[: int(length)]


def payload_of(blocks: list[bytes], total: int | None, digest: str | None) -> tuple[bytes | None, str | None]:
    """The payload of a record's segments in order, or what is wrong with them; digests other than base32 SHA-1 are not compared."""
    block = b"".join(blocks)
    if total is not None and total != len(block):
        return None, f"{len(block)} bytes of {total}"
    try:
        head, _, body = block.partition(b"\r\n\r\n")
        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError as e:
        return None, str(e)
    return (payload, None) if digest is None or len(digest) != 32 or digest == base32_sha1(payload) else (None, "the payload has another digest")


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def parsed(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each response, revisit, continuation and unreadable record of the archives in ``path``, read once (columns PARSED).

    Records of other types are skipped. Whole records have their payload (without ``payloads``
    only its length n) or an error; segments have their block.
    """
    prepare(spark)
    pieces = spark.read.option("lineSep", VERSION).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows, held = RecordReader(), [], 0

        def row(h: dict[str, str], block: bytes) -> dict | None:
            kind, n = h.get("warc-type", "").lower(), _number(h.get("warc-segment-number"))
            if kind not in ("response", "revisit", "continuation", "unreadable"):
                return None
            digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
            out = {"page_id": _number(h.get("x-page-id")), "record_id": h.get("warc-record-id"), "record_type": kind, "refers_to": h.get("warc-refers-to"),
                   "refers_to_page": _number(h.get("x-refers-to-page-id")), "payload_digest": digest, "error": h.get("error")}
            if n is not None and kind in ("response", "continuation"):
                return out | {"origin": h.get("warc-segment-origin-id", h.get("warc-record-id")), "segment": n, "total": _number(h.get("warc-segment-total-length")), "block": block}
            if kind == "response":
                payload, error = payload_of([block], None, digest)
                return out | {"payload": payload if payloads else None, "n": None if payload is None else len(payload), "error": error}
            return out if kind != "continuation" else out | {"error": "a continuation without a segment number"}

        def records() -> Iterator[tuple[dict[str, str], bytes]]:
            for batch in batches:
                for file, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield from reader.add(file, piece.as_py())
            yield from reader.end()

        for headers, block in records():
            if new := row(headers, block):
                rows.append(new)
                held += len(block) + 200
                if held > 4 << 20:
                    yield _batch(rows, PARSED)
                    rows, held = [], 0
        yield _batch(rows, PARSED)

    return pieces.mapInArrow(parse, PARSED)


def _batch(rows: list[dict], fields: str) -> pa.RecordBatch:
    kinds = [(x.split()[0], _KINDS[x.split()[1]]) for x in fields.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kind) for name, kind in kinds], names=[name for name, _ in kinds])


READ = _LEAD + ", payload binary, n long, error string"


def assembled(records: DataFrame, payloads: bool = True) -> DataFrame:
    """Columns READ of ``parsed`` records (stored, as they are read twice here): segments are put together.

    Continuations are grouped by origin, wherever they stand, and put in order of their segment
    numbers; a missing segment or a wrong total length or digest gives a null payload and an
    error. The group of one record is as large as its payload. Only segments are shuffled.
    """
    names = [x.split()[0] for x in READ.split(", ")]
    lead = [F.first(c, ignorenulls=True).alias(c) for c in ("page_id", "payload_digest")]
    parts = records.where("segment IS NOT NULL").groupBy("origin").agg(*lead, F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("segments"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                numbers = [s["segment"] for s in r["segments"]]
                if r["total"] is None or numbers != list(range(1, len(numbers) + 1)):
                    payload, error = None, f"segments {numbers[:20]} of a record without its end"
                else:
                    payload, error = payload_of([s["block"] for s in r["segments"]], r["total"], r["payload_digest"])
                found = {"page_id": r["page_id"], "record_id": r["origin"], "record_type": "response", "payload_digest": r["payload_digest"], "error": error}
                yield _batch([found | {"payload": payload if payloads else None, "n": None if payload is None else len(payload)}], READ)

    return records.where("segment IS NULL").select(*names).unionByName(parts.mapInArrow(join, READ))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in ``path``, ours or others': columns READ, one row for each response, revisit or unreadable record.

    Ids of records are strings; page ids are there where the archive has them. A revisit has no
    payload of its own. Archives are plain or gzipped (in one member or one a record) and may be
    of any size: a gzipped one streams through one task, a plain one is split. Of a plain one, a
    record that holds an archive itself and lies on a split's border is unreadable.
    """
    return assembled(stored(parsed(spark, path), "records"))


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Archive ``pages`` in the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Every row gives one row. A revisit's bytes are those of the response it refers to. Null ids
    come back as null; an empty table gives no rows; columns but page_id, url and html are not read.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, min_revisit_bytes, segment_bytes)
    narrow = stored(assembled(stored(parsed(spark, path, payloads=False), "records"), payloads=False).drop("payload"), "pages-read")
    responses = narrow.where("record_type = 'response' AND error IS NULL").select(F.col("page_id").alias("of"), F.col("payload_digest").alias("d"), F.col("n").alias("of_n")).distinct()
    out = narrow.join(responses, (narrow["record_type"] == "revisit") & (narrow["refers_to_page"] == F.col("of")) & (narrow["payload_digest"] == F.col("d")), "left")
    return out.select("page_id", F.coalesce("n", "of_n").alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read(spark, sf_dir, "pages"))


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 32),
    lambda i: substr('{_BASE32}', CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) % 32 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first OR n < {MIN_REVISIT_BYTES} THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first AND n >= {MIN_REVISIT_BYTES} THEN first END AS refers_to FROM q
"""
