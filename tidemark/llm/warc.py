"""WARC archives of web pages, written and read as a chunked record table.

A payload travels as rows (record, chunk_no, data) of at most ``CHUNK`` bytes, cut from the page by built-in functions before
it comes to Python. Each task streams its rows into one archive, a gzip member a record; neither side ever holds a whole
record. Where an archive's segments lie is the task's result, written as a table: an archive of a task that failed or ran twice is in
no row of it and is never read. Segments start at records, so that large archives are read by many tasks.

Reading gives chunk rows again. Each carries the SHA-1 of the payload up to its end, computed as the bytes pass, so the last
chunk's is that of the payload; it must be the one that the record's header promises.

Of pages with equal payloads of at least ``LEAST_REVISIT`` bytes, that with the largest key is stored, the others are revisits of it. Which
those are is a small table of digests that occur more than once; pages join it, and skew of a common payload is split by AQE.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK, BLOCK, SEGMENT, BATCH = 262_144, 1_048_576, 8_388_608, 8_388_608
LEAST_REVISIT = 1000
DATE = "2000-01-01T00:00:00Z"
"""The capture date of pages that have none."""
PREFIX = "urn:x-page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL, GZIP = 1, 31
CHUNK_ROWS = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, "
    "chunk_no int, last boolean, position long, data binary, sha1 string"
)


def record_id(key: Column) -> Column:
    """A key as a record's name; that of a null key has nothing after its prefix."""
    return F.concat(F.lit(PREFIX), F.coalesce(key.cast("string"), F.lit("")))


def to_records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(record_id, record_type, target_uri, refers_to, payload_bytes, payload_digest, payload) of every page.

    A null payload is an empty one. Pages that are alike in key and payload are alike here: all of them responses, or all revisits.
    A null key is never referred to while another page with the payload has a key.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("__key"), F.col(url).cast("string").alias("target_uri"), body.alias("payload"), F.sha1(body).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    seen = rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest")
    first = seen.agg(F.max("__key").alias("__first"), F.count("*").alias("__n")).where("__n > 1").select("payload_digest", "__first")
    found = rows.join(first, "payload_digest", "left")
    again = F.col("__first").isNotNull() & ~F.col("__first").eqNullSafe(F.col("__key"))
    return found.select(
        record_id(F.col("__key")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(again, record_id(F.col("__first"))).alias("refers_to"), "payload_bytes", "payload_digest", F.when(~again, F.col("payload")).alias("payload"),
    )


def _chunked(records: DataFrame) -> DataFrame:
    """The records with their payload in rows (chunk_no, last, data), in order within each; a revisit has one, without data."""
    stored = F.coalesce(F.octet_length("payload"), F.lit(0))
    last = F.floor(F.greatest(stored - 1, F.lit(0)) / CHUNK).cast("int")
    head = [c for c in records.columns if c != "payload"]
    rows = records.select(*head, "payload", last.alias("__last"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    piece = F.substring(F.coalesce("payload", F.lit(b"")), F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK))
    return rows.select(*head, "chunk_no", (F.col("chunk_no") == F.col("__last")).alias("last"), piece.alias("data"))


def _line(value: str) -> str:
    """A header's value without characters that would end it or its line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _heads(row: dict, date: str) -> bytes:
    """The header of a record and that of the response in it."""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_line(row['record_id'])}>", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_line(row['target_uri'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    if revisit:
        lines += [f"WARC-Refers-To: <{_line(row['refers_to'])}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    length = len(http) + (0 if revisit else row["payload_bytes"])
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {length}"]
    return "\r\n".join([*lines, "", ""]).encode() + http


def _writer(path: str, date: str):
    """Streams chunk rows into one archive and gives its segments (file, at, size, records)."""
    heads = ("record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, files, out, packer = f"{uuid.uuid4().hex}.warc.gz", None, None, None
        at = start = records = 0
        segments: list[tuple[str, int, int, int]] = []
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                if out is None:
                    files, base = FileSystem.from_uri(path)
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(f"{base}/{name}", compression=None)  # else the name would compress it again
                if columns["chunk_no"][i].as_py() == 0:
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                    out.write(packer.compress(_heads({h: columns[h][i].as_py() for h in heads}, date)))
                out.write(packer.compress(columns["data"][i].as_py()))
                if columns["last"][i].as_py():
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    at, records = out.tell(), records + 1
                    if at - start >= SEGMENT:
                        segments.append((name, start, at - start, records))
                        start, records = at, 0
        if out is not None:
            out.close()
            if records:
                segments.append((name, start, at - start, records))
        kinds = (("file", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("records", pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([s[j] for s in segments], t) for j, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    return run


def write(records: DataFrame, path: str, date: str = DATE) -> None:
    """Writes records as archives below ``path``/archives and the table of their segments to ``path``/segments.

    ``path`` must be one that all executors reach, a local one or one of a store that Arrow knows.
    """
    segments = _chunked(records).mapInArrow(_writer(f"{path}/archives", date), "file string, at long, size long, records long")
    segments.write.parquet(f"{path}/segments")


class _Stream:
    """The bytes of a segment, unpacked as they are asked for; holds a block at a time."""

    def __init__(self, source: pa.NativeFile, size: int) -> None:
        self.pieces, self.piece, self.at = self._unpacked(source, size), b"", 0

    @staticmethod
    def _unpacked(source: pa.NativeFile, size: int) -> Iterator[bytes]:
        unpacker = zlib.decompressobj(GZIP)
        while size > 0:
            block = source.read(min(size, BLOCK))
            if not block:
                raise ValueError("an archive ends before its segment does")
            size -= len(block)
            while True:
                piece = unpacker.decompress(block, BLOCK)
                if piece:
                    yield piece
                if unpacker.eof:
                    block, unpacker = unpacker.unused_data, zlib.decompressobj(GZIP)
                else:
                    block = unpacker.unconsumed_tail
                if not block and len(piece) < BLOCK:
                    break

    def _more(self) -> bool:
        self.piece, self.at = self.piece[self.at :] + next(self.pieces, b""), 0
        return bool(self.piece)

    def head(self) -> list[bytes]:
        """The lines up to an empty one; none at the end."""
        while (end := self.piece.find(b"\r\n\r\n", self.at)) < 0:
            size = len(self.piece) - self.at
            self._more()
            if len(self.piece) == size:
                if size:
                    raise ValueError("a record's header has no end")
                return []
        lines = self.piece[self.at : end].split(b"\r\n")
        self.at = end + 4
        return lines

    def chunks(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes in chunks of ``CHUNK``; at least one, which may be empty."""
        while True:
            want = min(size, CHUNK)
            while len(self.piece) - self.at < want:
                had = len(self.piece) - self.at
                self._more()
                if len(self.piece) == had:
                    raise ValueError("a record ends before its length")
            yield self.piece[self.at : self.at + want]
            self.at += want
            size -= want
            if not size:
                return


def _fields(lines: list[bytes]) -> dict[str, str]:
    """A header's fields by their names in lower case."""
    return {n.strip().lower(): v.strip() for n, _, v in (x.decode("utf-8").partition(":") for x in lines[1:])}


def _records(stream: _Stream) -> Iterator[tuple]:
    """The chunk rows of all records of a segment."""
    while lines := stream.head():
        fields = _fields(lines)
        kind, length = fields["warc-type"], int(fields["content-length"])
        http_lines = stream.head()
        http = sum(len(x) + 2 for x in http_lines) + 2
        promised = fields["warc-payload-digest"].removeprefix("sha1:")
        names = [fields[n].strip("<>") if n in fields else None for n in ("warc-record-id", "warc-target-uri", "warc-refers-to")]
        head = (names[0], kind, names[1], names[2], int(_fields(http_lines)["content-length"]), promised)
        digest, position, left = hashlib.sha1(), 0, length - http
        for n, chunk in enumerate(stream.chunks(left)):
            digest.update(chunk)
            last = position + len(chunk) == left
            if last and kind != "revisit" and digest.hexdigest() != promised:
                raise ValueError(f"the payload of {names[0]} is not the one its header names")
            yield (*head, n, last, position, chunk, digest.hexdigest() if kind != "revisit" else None)
            position += len(chunk)
        if any(stream.head()):
            raise ValueError(f"the record {names[0]} is longer than its length")


def _reader(path: str):
    names = [f.split()[0] for f in CHUNK_ROWS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segments in batches:
            for file, at, size in zip(*(segments.column(c).to_pylist() for c in ("file", "at", "size")), strict=True):
                files, base = FileSystem.from_uri(path)
                with files.open_input_file(f"{base}/{file}") as source:
                    source.seek(at)
                    rows, held = [], 0
                    for row in _records(_Stream(source, size)):
                        rows.append(row)
                        held += len(row[9]) + 200
                        if held >= BATCH:
                            yield batch(rows)
                            rows, held = [], 0
                    yield batch(rows)

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of all records of the archives below ``path``; of a record's chunks, ``last`` marks the last one.

    ``payload_bytes`` and ``payload_digest`` are those of the header, ``sha1`` is that of the bytes read up to the chunk's end; a
    revisit has no bytes and so none. A broken archive raises.
    """
    segments = spark.read.parquet(f"{path}/segments")
    n = segments.count()
    return segments.repartition(max(1, n), "file", "at").mapInArrow(_reader(f"{path}/archives"), CHUNK_ROWS)


def records(chunks: DataFrame) -> DataFrame:
    """(record_id, record_type, target_uri, refers_to, payload_bytes, payload_digest): a row a record, digest and size of what was read.

    A revisit has those of the payload that it refers to.
    """
    size = F.when(F.col("record_type") == "revisit", F.col("payload_bytes")).otherwise(F.col("position") + F.octet_length("data"))
    return chunks.where("last").select(
        "record_id", "record_type", "target_uri", "refers_to", size.alias("payload_bytes"), F.coalesce("sha1", "payload_digest").alias("payload_digest")
    )


def archived(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of every page, read back from the archives it is written to."""
    write(to_records(pages, key, url, payload), path)
    kind = pages.schema[key].dataType

    def as_key(name: str) -> Column:
        return F.substr(F.col(name), F.lit(len(PREFIX) + 1)).try_cast(kind)

    found = records(read(pages.sparkSession, path))
    return found.select(as_key("record_id").alias(key), "payload_bytes", "payload_digest", "record_type", as_key("refers_to").alias("refers_to"))
