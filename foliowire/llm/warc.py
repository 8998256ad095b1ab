"""Web archives from a chunked record table: payloads travel as rows of record and chunk number, never whole.

``chunk_table`` cuts each payload into chunks and carries its digest from chunk to chunk. ``decided`` names, per digest, the first
record a response and the others its revisits. ``write_archives`` brings the chunks of a record together in order and streams
them as WARC 1.1 records whose HTTP bodies are in chunked transfer coding, one HTTP chunk per row, so no line of an archive is
longer than a chunk. ``read_archives`` streams the lines back into chunk rows, digests carried along. Archives are compressed text
files of the cluster's file system, each a whole number of records behind a warcinfo record; a task reads one from its start.

Defined results: a null payload is an empty one; a null identifier is kept and comes after all others in the choice of the
response; of rows equal in identifier and payload one is the response; a null address leaves its header out, blanks and controls in
addresses are percent-encoded; payloads of any length and content come back byte by byte; an empty table writes no record; other
columns are ignored. Identifiers are whole numbers.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliowire.llm.common import materialise
from foliowire.session import scratch_path

CHUNK_BYTES = 64 * 1024
#: Payload bytes of one archive file, unless one record is larger.
ARCHIVE_BYTES = 512 * 1024 * 1024
#: Parts in which the records of one digest look for their response.
SALTS = 32

CHUNKS = "row long, id long, url string, payload_bytes long, chunk_no int, chunk binary, digest string"
RECORDS = ("record_id string, record_type string, target_uri string, refers_to string, chunk_no long, chunk binary, payload_bytes long, "
           "payload_digest string, intact boolean")

_LINE = b"\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_END = b"0\r\n\r\n"


def base32_digest(sha) -> str:
    return base64.b32encode(sha.digest()).decode()


def chunk_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk of each payload, in order within a task; the last of a record carries the digest of them all.

    ``row`` tells records apart; write the table before using it twice. An empty payload has one empty chunk.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    last = F.greatest(F.ceil(F.col("payload_bytes") / chunk_bytes), F.lit(1)).cast("int") - 1
    cut = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    cut = cut.select("row", "id", "url", "payload_bytes", "chunk_no", F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, done = hashlib.sha1(), 0
        for batch in batches:
            digests = []
            for total, chunk in zip(batch.column("payload_bytes").to_pylist(), batch.column("chunk"), strict=True):
                data = chunk.as_buffer()
                sha.update(data)
                done += data.size
                digests.append(base32_digest(sha) if done == total else None)
                if done == total:
                    sha, done = hashlib.sha1(), 0
            yield batch.append_column("digest", pa.array(digests, pa.string()))

    return cut.mapInArrow(digested, CHUNKS)


def decided(chunks: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(row, id, url, payload_bytes, digest, record_type, first_id, first_row) per record; the last two for revisits.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the smallest identifier is the response. The
    records of a digest are dealt to parts that find their first one each, so no task meets all copies.
    """
    records = chunks.where("digest is not null").select("row", "id", "url", "payload_bytes", "digest", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    first = records.where(F.col("payload_bytes") >= least_bytes).groupBy("digest", "salt").agg(F.min(rank).alias("first"))
    whole = first.groupBy("digest").agg(F.min("first").alias("first"), F.collect_list("salt").alias("salts")).select(
        "digest", "first", F.explode("salts").alias("salt"))
    again = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    return records.join(whole, ["digest", "salt"], "left").select(
        "row", "id", "url", "payload_bytes", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first.id")).alias("first_id"), F.when(again, F.col("first.row")).alias("first_row"))


def _record_id(page: int | None, row: int) -> str:
    return f"<urn:page:{'' if page is None else page}:{row}>"


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _head(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None).encode() + _LINE


def _record_head(r: dict, date: str, chunk_bytes: int) -> bytes:
    """All of a record before its first chunk. A line break follows it, which ends the HTTP header."""
    response, total = r["record_type"] == "response", r["payload_bytes"]
    http = _HTTP + (b"Transfer-Encoding: chunked\r\n" if response else b"Content-Length: %d\r\n" % total)
    whole, rest = divmod(total, chunk_bytes)
    body = whole * (len(b"%x" % chunk_bytes) + chunk_bytes + 4) + (len(b"%x" % rest) + rest + 4 if rest else 0) + len(_END) if response else 0
    return _head([
        ("WARC-Type", r["record_type"]), ("WARC-Record-ID", _record_id(r["id"], r["row"])), ("WARC-Date", date),
        ("WARC-Target-URI", None if r["url"] is None else _uri(r["url"])), ("WARC-Payload-Digest", f"sha1:{r['digest']}"),
        ("WARC-Refers-To", None if response else _record_id(r["first_id"], r["first_row"])),
        ("WARC-Profile", None if response else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + 2 + body),
    ]) + http


def write_archives(chunks: DataFrame, decisions: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write one WARC record per record of a written ``chunk_table``, below ``path``.

    Chunks and decisions meet by record in one shuffle, sorted by chunk number; each row becomes a piece of an archive at once.
    """
    spark = chunks.sparkSession
    total = decisions.agg(F.sum("payload_bytes")).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // ARCHIVE_BYTES + 1)
    heads = decisions.withColumn("chunk_no", F.lit(-1))
    bodies = chunks.select("row", "chunk_no", "chunk")
    ordered = heads.unionByName(bodies, allowMissingColumns=True).repartition(files, "row").sortWithinPartitions("row", "chunk_no")
    names = [c for c in ordered.columns if c not in ("chunk", "chunk_no")]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, response, started = 0, False, False
        for batch in batches:
            lines = []
            heads = batch.select(names).to_pylist()
            for number, chunk, head in zip(batch.column("chunk_no").to_pylist(), batch.column("chunk"), heads, strict=True):
                if number < 0:
                    if not started:
                        about = b"software: foliowire\r\nformat: WARC File Format 1.1\r\n"
                        lines.append(_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:warcinfo:{head['row']}>"), ("WARC-Date", date),
                                            ("Content-Type", "application/warc-fields"), ("Content-Length", len(about))]) + about + _LINE)
                        started = True
                    left, response = head["payload_bytes"], head["record_type"] == "response"
                    lines.append(_record_head(head, date, chunk_bytes))
                    if not response:
                        lines.append(_LINE)  # the blank lines after a record
                elif response:
                    data = chunk.as_py()
                    left -= len(data)
                    if data:
                        lines.append(b"%x\r\n%b" % (len(data), data))
                    if not left:
                        lines.append(_END + _LINE)
            yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.binary())})

    lines = ordered.mapInArrow(pieces, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


class _Records:
    """Turns the lines of an archive, without their breaks, into chunk rows; holds one chunk."""

    def __init__(self):
        self.step = self.start

    def start(self, line: bytes):
        if line.startswith(b"WARC/"):
            self.fields, self.step = {}, self.field
        elif line:
            raise ValueError(f"not the start of a record: {line[:80]!r}")

    def field(self, line: bytes):
        if line:
            name, _, value = line.partition(b":")
            self.fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
            return
        self.left, self.sha, self.number, self.total, self.parts = int(self.fields[b"content-length"]), hashlib.sha1(), 0, 0, []
        self.chunked, self.length = False, None
        self.step = self.http if self.fields.get(b"content-type", "").startswith("application/http") else self.raw
        if not self.left:
            yield self.closed()

    def http(self, line: bytes):
        self.left -= len(line) + 2
        name, _, value = line.lower().partition(b":")
        self.chunked |= name == b"transfer-encoding" and value.strip() == b"chunked"
        if name == b"content-length":
            self.length = int(value)
        if not line:
            self.step = self.size if self.chunked else self.raw
        if self.left <= 0:
            yield self.closed()

    def size(self, line: bytes):
        self.left -= len(line) + 2
        self.need = int(line.partition(b";")[0], 16)
        self.step = self.data if self.need else self.trailer

    def data(self, line: bytes):
        self.left -= len(line) + 2
        self.parts.append(line)
        self.need -= len(line)
        if self.need:  # the break belongs to the chunk
            self.parts.append(_LINE)
            self.need -= 2
            return
        self.step = self.size
        yield self.piece(b"".join(self.parts))
        self.parts = []

    def trailer(self, line: bytes):
        self.left -= len(line) + 2
        if self.left <= 0:
            yield self.closed()

    def raw(self, line: bytes):
        data = (line + _LINE)[:self.left]
        self.left -= len(data)
        yield self.piece(data)
        if not self.left:
            yield self.closed()

    def piece(self, data: bytes):
        self.sha.update(data)
        self.total += len(data)
        self.number += 1
        return (*self.names(), self.number - 1, data, None, None, None)

    def names(self):
        f = self.fields
        return f.get(b"warc-record-id"), f.get(b"warc-type"), f.get(b"warc-target-uri"), f.get(b"warc-refers-to")

    def closed(self):
        self.step = self.start
        stated = self.fields.get(b"warc-payload-digest", "").removeprefix("sha1:") or None
        if self.fields.get(b"warc-type") == "revisit":  # its payload is elsewhere
            return (*self.names(), self.number, None, self.length, stated, None)
        digest = base32_digest(self.sha)
        return (*self.names(), self.number, None, self.total, digest, None if stated is None else stated == digest)


def read_archives(spark: SparkSession, path: str, chunks: bool = True) -> DataFrame:
    """Rows (record, chunk number, chunk) of all records below ``path``, and per record a closing row without a chunk.

    The closing row has the payload's bytes and digest, computed from what was read; for a revisit, which holds no payload,
    they are the stated ones. ``intact`` compares with the stated digest. Without ``chunks`` only closing rows come.
    """
    # compressed files are not split, so a task meets the lines of an archive from its first to its last
    lines = spark.read.option("lineSep", "\r\n").text(path).select(F.col("value").cast("binary").alias("value"))
    names = [part.split()[0] for part in RECORDS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Records()
        for batch in batches:
            found = [r for line in batch.column(0) for r in state.step(line.as_py()) or () if chunks or r[5] is None]
            columns = list(zip(*found, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return lines.mapInArrow(records, RECORDS)


def archived(pages: DataFrame, path: str | None = None, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> str:
    """Write pages as archives below ``path`` (a fresh folder in the shared one if not given) and return it."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archives")
    chunks = materialise(chunk_table(pages, chunk_bytes=chunk_bytes), "warc-chunks", compression="zstd")
    write_archives(chunks, materialise(decided(chunks, least_bytes), "warc-records"), path, chunk_bytes=chunk_bytes)
    return path


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per archived page: identifier, payload size and digest, kind of record, the identifier it refers to, whether it is intact."""
    def page(column: str):
        return F.expr(f"try_cast(nullif(regexp_extract({column}, '^<urn:page:(-?[0-9]*):[0-9]+>$', 1), '') AS bigint)")

    closing = read_archives(spark, path, chunks=False).where("record_type in ('response', 'revisit')")
    return closing.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "intact")
