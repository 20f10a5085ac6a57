"""WARC archives: writing whole-file gzip streams, and normalising them to one member a record.

write_monolithic() writes each partition's records as one gzip stream, as a plain `gzip` of a WARC
would. normalise() inflates such a stream once, in pieces, finds the record borders from
Content-Length, writes each record as a gzip member of its own and, beside the new archive, a
sidecar index (one JSON line a record: offset, length, type, ids, digest). read_records() fetches
records through the index: it seeks to each offset and inflates one member.

A record's id has the page_id and the row's number, so rows that repeat a page_id, or have none, have
records of their own, and a revisit names the very record it refers to.

Files are opened with pyarrow's file systems (file, hdfs, s3, gs) on the executors, in the folder
all of them share. A file is written under a name of the task's attempt and then renamed to a name
that only depends on its input, so a task that runs again replaces its own output.

Payloads: of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest
page_id is a response, and the others are revisits without payload, that bear its digest, its size
and the page they refer to. Defined results: a null html is an empty payload, a null url an empty
URI. A row with null page_id is never referred to and comes after all others in its group; if a
group has none but such rows, all of them are responses. Of repeated rows of the smallest page_id
one is the response. Columns besides page_id, url and html are ignored. An empty table gives empty
archives and an empty result.
"""

from __future__ import annotations

import hashlib
import io
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import fresh_path, stored

MIN_REVISIT = 100
LEVEL = 4
PIECE = 1 << 20
READ_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:/") else path)


class Output:
    """A file that takes its name only when it is complete."""

    def __init__(self, path: str):
        self.fs, self.path = open_fs(path)
        context = TaskContext.get()
        self.temporary = f"{self.path}.{context.taskAttemptId() if context else 0}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream, self.size = self.fs.open_output_stream(self.temporary, compression=None), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        from pyarrow import fs

        self.stream.close()
        # not every file system replaces a file: what an earlier attempt left goes first
        if self.fs.get_file_info(self.path).type != fs.FileType.NotFound:
            self.fs.delete_file(self.path)
        self.fs.move(self.temporary, self.path)


def urn(page_id: int | None, rid: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{rid}>"


def record(page_id: int | None, rid: int, url: str, kind: str, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page_id, rid)}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + " ".join(url.split()), f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
        f"Content-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def decisions(pages: DataFrame) -> DataFrame:
    """page_id, rid, url, html, digest, size, refers_to (page_id and rid of the response, null for a response) for every row.

    The places of the rows of pages must not change between two readings. Only digests and ids are grouped; the html is shuffled once, by digest and row, so a payload that
    many rows share is spread out. Rows without partners are not in the side that is joined to them.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"),
        F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size"), F.monotonically_increasing_id().alias("rid"))
    narrow = stored(rows.where(F.col("size") >= MIN_REVISIT).select("digest", "page_id", "rid"), "payloads")
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "rid")).alias("first")
    groups = narrow.groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1 and not first.no_id")
    # (digest, page_id) and the row's number tell apart repeated rows; they are the join's spread key
    again = narrow.join(groups.hint("merge"), "digest").where("rid <> first.rid").select("digest", "rid", F.struct("first.page_id", "first.rid").alias("refers_to"))
    return rows.join(again.hint("merge"), ["digest", "rid"], "left").select("page_id", "rid", "url", "html", "digest", "size", F.col("refers_to.page_id").alias("to_page"), F.col("refers_to.rid").alias("to_rid"))


def write_monolithic(rows: DataFrame, path: str) -> DataFrame:
    """One gzip stream a partition; rows as from decisions(). Returns (path, records), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n = f"{path}/part-{TaskContext.get().partitionId():05d}.warc.gz", 0
        out, gz = Output(name), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "rid", "url", "html", "digest", "size", "to_page", "to_rid")]
            for row in zip(*cols, strict=True):
                page_id, rid, url, html, digest, size, to_page, to_rid = (x.as_py() for x in row)
                again = to_rid is not None
                body = b"" if again else html.encode("utf-8", "surrogatepass")
                out.write(gz.compress(record(page_id, rid, url, "revisit" if again else "response", body, digest, size, urn(to_page, to_rid) if again else None)))
                n += 1
        out.write(gz.flush())
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["path", "records"])

    return stored(rows.mapInArrow(run, "path string, records long"), "archives")


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file in pieces, whatever number of members it has."""
    gz = zlib.decompressobj(31)
    while data := stream.read(PIECE):
        while data:
            if piece := gz.decompress(data, PIECE):
                yield piece
            data = gz.unconsumed_tail
            if gz.eof:
                data, gz = gz.unused_data, zlib.decompressobj(31)


class Records:
    """Splits a stream of bytes into records; holds one record and one piece."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.buffer = pieces, bytearray()

    def need(self, n: int) -> bool:
        while len(self.buffer) < n:
            piece = next(self.pieces, None)
            if piece is None:
                return False
            self.buffer += piece
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """(headers in lower case, the whole record)."""
        while True:
            seen = 0
            while (end := self.buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
                seen = len(self.buffer)
                if not self.need(seen + 1):
                    if self.buffer.strip():
                        raise ValueError("the archive ends inside a record's header")
                    return
            head = headers(bytes(self.buffer[:end]))
            size = end + 4 + int(head["content-length"]) + 4
            if not self.need(size):
                raise ValueError("the archive ends inside a record")
            yield head, bytes(self.buffer[:size])
            del self.buffer[:size]


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].strip().startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def page_of(name: str | None) -> int | None:
    """The page_id in a record's id."""
    digits = (name or "").removeprefix("<urn:page:").partition(":")[0]
    return int(digits) if digits else None


INDEX = "path string, offset long, length long, page_id long"


def normalise(archives: DataFrame, path: str) -> DataFrame:
    """Rewrite archives(path) with a member a record and a sidecar index each; returns the index."""
    spark = archives.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("path").to_pylist():
                name = f"{path}/{source.rpartition('/')[2]}"
                fs, at = open_fs(source)
                rows, out, side = [], Output(name), Output(name + ".idx")
                with fs.open_input_stream(at, compression=None) as stream:
                    for head, raw in Records(inflated(stream)):
                        gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = gz.compress(raw) + gz.flush()
                        page = page_of(head.get("warc-record-id"))
                        side.write(json.dumps({"offset": out.size, "length": len(member), "type": head.get("warc-type"), "id": head.get("warc-record-id"), "digest": head.get("warc-payload-digest")}).encode() + b"\n")
                        rows.append((name, out.size, len(member), page))
                        out.write(member)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["path", "offset", "length", "page_id"])
                            rows = []
                out.close()
                side.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["path", "offset", "length", "page_id"])

    # a few rows of a stored table, dealt out one by one
    return stored(archives.select("path").repartition(2 * spark.sparkContext.defaultParallelism).mapInArrow(run, INDEX), "index")


def read_records(index: DataFrame) -> DataFrame:
    """Fetch each record of index(path, offset, length) by its offset: RECORD, digests from the payloads themselves.

    Tasks follow the bytes to read: each run of READ_BYTES of an archive is read in order by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, stream = None, None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if path != opened:
                    fs, at = open_fs(path)
                    opened, stream = path, fs.open_input_file(at)
                stream.seek(offset)
                head, raw = next(iter(Records(inflated(io.BytesIO(stream.read(length))))))
                kind, size = head["warc-type"], int(head["content-length"])
                payload = raw[len(raw) - 4 - size : len(raw) - 4]
                if kind == "revisit":
                    rows.append((page_of(head["warc-record-id"]), int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha256:"), kind, page_of(head["warc-refers-to"])))
                else:
                    rows.append((page_of(head["warc-record-id"]), size, hashlib.sha256(payload).hexdigest(), kind, None))
            if rows:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(2 * index.sparkSession.sparkContext.defaultParallelism, 2 * -(-total // READ_BYTES))
    runs = index.select("path", "offset", "length").repartition(tasks, "path", F.floor(F.col("offset") / READ_BYTES))
    return runs.sortWithinPartitions("path", "offset").mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame, as_read: bool = False) -> DataFrame:
    """Write pages as monolithic archives, normalise them and read every record back.

    Rows are numbered by their place and read twice. as_read says that pages is a table as Spark reads it, whose
    places do not change; anything else is stored first.
    """
    pages = pages if as_read else stored(pages.select("page_id", "url", "html"), "pages")
    base = fresh_path(pages.sparkSession, "warc")
    archives = write_monolithic(decisions(pages), base + "/whole")
    return read_records(normalise(archives, base + "/members"))
