"""Content-addressed WARC archive (operator 11): each payload is stored once, record headers apart from it, both exactly.

An archive is a folder of two tables:

* ``records``: one row per WARC record: record_id, header (the exact bytes ahead of the payload: the WARC header and, of
  HTTP records, the HTTP header too, each with its blank line), address, parts, whole (whether the record holds its payload;
  a revisit doesn't).
* ``payloads``: address, payload, parts, each address once.

An address is the SHA-256 of the payload and its length, so what is stored can be verified, and is verified each time it
is read. A record's bytes are its header, its payload if it is ``whole``, and two line ends: a join by address brings back
every record byte by byte. A payload that many records share is dealt into ``parts`` copies in that join, as many as the
count of its records asks for, so that no task gets all of them.

``page_records`` makes such records of a table of pages; ``read_warc`` and ``write_warc`` take them from and to WARC files
of one gzip member per record.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bitmap_of, maybe_among, new_folder, salted_join, write, written

#: Payloads of fewer bytes are never told as revisits.
LEAST_REVISITED = 1000
#: Records that share a payload and meet one copy of it in a task.
RECORDS_A_PART = 512
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
LINE_END = "\r\n"
#: What each record ends with.
RECORD_END = b"\r\n\r\n"
HTTP_HEADER = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: Bytes of a header that a reader takes before it gives a file up as no WARC file.
MOST_HEADER = 1 << 20


def address(payload: Column) -> Column:
    return F.concat_ws("-", F.sha2(payload, 256), F.octet_length(payload).cast("string"))


def payload_of(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def addressed(pages: DataFrame) -> DataFrame:
    """page_id, url, address, sha1, n_bytes, copies: pages that agree in all of these are one row with their number."""
    payload = payload_of(F.col("html"))
    rows = pages.select("page_id", "url", address(payload).alias("address"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("n_bytes"))
    return rows.groupBy("page_id", "url", "address", "sha1", "n_bytes").agg(F.count(F.lit(1)).alias("copies"))


def field(name: str, value: Column) -> Column:
    """A header line; null values give none. Line ends can't get into a header: they are escaped, other control characters
    become spaces."""
    safe = F.regexp_replace(F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), "[\\x00-\\x1F\\x7F]", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(LINE_END)), F.lit(""))


def record_id(page_id: Column, url: Column, number: Column, of: Column) -> Column:
    """A URN made of what tells a record: the same page gets the same id in each run."""
    digest = F.md5(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), number.cast("string"), of))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def page_records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Record rows of ``pages`` (page_id, url, html): page_id, record_id, header, address, parts, whole.

    Of pages with equal payloads of LEAST_REVISITED bytes or more, the one with the largest page_id is a response, the
    others are revisits that name it; all smaller ones are responses. Ties: the largest url, then one of the rows that
    agree in both. Nulls come first. Only digests are shuffled here, never payloads.
    """
    told = written(addressed(pages), "addressed")
    order = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", F.col("url").isNotNull().alias("named"), "url")
    per_address = told.groupBy("address").agg(F.max(order).alias("last"), F.sum("copies").alias("sharing"))
    joined = salted_join(told, per_address, "address", "page_id")
    parts = F.ceil(F.col("sharing") / RECORDS_A_PART).cast("int")
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("number")
    rows = joined.select("page_id", "url", "address", "sha1", "n_bytes", "last", parts.alias("parts"), number)
    last = F.col("page_id").eqNullSafe(F.col("last.page_id")) & F.col("url").eqNullSafe(F.col("last.url")) & (F.col("number") == 1)
    rows = rows.withColumn("whole", last | (F.col("n_bytes") < LEAST_REVISITED))
    http = F.concat(F.lit(HTTP_HEADER), F.col("n_bytes").cast("string"), F.lit(LINE_END * 2))
    block = F.octet_length(http) + F.when(F.col("whole"), F.col("n_bytes")).otherwise(0)
    refers = F.when(~F.col("whole"), record_id(F.col("last.page_id"), F.col("last.url"), F.lit(1), F.col("address")))
    own = record_id(F.col("page_id"), F.col("url"), F.col("number"), F.col("address"))
    header = F.concat(
        F.lit("WARC/1.1" + LINE_END), field("WARC-Type", F.when(F.col("whole"), F.lit("response")).otherwise(F.lit("revisit"))), field("WARC-Record-ID", own),
        field("WARC-Target-URI", F.col("url")), field("WARC-Date", F.lit(date)), field("WARC-Refers-To", refers),
        field("WARC-Profile", F.when(~F.col("whole"), F.lit(REVISIT_PROFILE))), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        field("WARC-Page-ID", F.col("page_id").cast("string")), field("Content-Type", F.lit("application/http;msgtype=response")),
        field("Content-Length", block.cast("string")), F.lit(LINE_END), http,
    )
    return rows.select("page_id", own.alias("record_id"), header.cast("binary").alias("header"), "address", "parts", "whole")


def stored_payloads(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """address, payload, parts, each address once, of ``rows`` (address, payload); ``counts``: address, parts, sharing.

    Payloads of addresses that surely have one row stay where they lie; of the others, equal ones of a task go first.
    """
    hashed = F.xxhash64("address")
    many = bitmap_of(counts.where("sharing > 1"), hashed)
    once = maybe_among(rows, hashed, many, among=False).withColumn("parts", F.lit(1))
    again = maybe_among(rows, hashed, many).groupBy("address").agg(F.first("payload").alias("payload"))
    return once.unionByName(again.join(counts.select("address", "parts").hint("merge"), "address").select("address", "payload", "parts"))


def write_archive(pages: DataFrame, folder: str, date: str = DATE) -> None:
    """Archive ``pages`` below ``folder``; a table is there when all of it is."""
    records = page_records(pages, date)
    write(records.select("record_id", "header", "address", "parts", "whole"), f"{folder}/records")
    _write_payloads(pages.sparkSession, pages.select(payload_of(F.col("html")).alias("payload")), folder)


def archive_records(records: DataFrame, folder: str) -> None:
    """Archive any WARC records (record_id, header, payload, whole), as ``read_warc`` gives them, below ``folder``.

    ``payload`` is what is kept once; where ``whole`` is false, the record doesn't hold it.
    """
    rows = records.withColumn("address", address(F.col("payload")))
    counts = rows.groupBy("address").agg(F.ceil(F.count(F.lit(1)) / RECORDS_A_PART).cast("int").alias("parts"))
    narrow = written(rows.select("record_id", "header", "address", "whole"), "narrow")
    write(salted_join(narrow, written(counts, "counts"), "address", "header").select("record_id", "header", "address", "parts", "whole"), f"{folder}/records")
    _write_payloads(records.sparkSession, records.select("payload"), folder)


def _write_payloads(spark: SparkSession, payloads: DataFrame, folder: str) -> None:
    counts = spark.read.parquet(f"{folder}/records").groupBy("address").agg(F.max("parts").alias("parts"), F.count(F.lit(1)).alias("sharing"))
    rows = payloads.select(address(F.col("payload")).alias("address"), "payload")
    write(stored_payloads(rows, written(counts, "counts")), f"{folder}/payloads")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, header, payload (of revisits too), record (the exact bytes of the WARC record) of every record.

    Stored payloads are verified by their addresses; damage raises an error.
    """
    records, payloads = spark.read.parquet(f"{folder}/records"), spark.read.parquet(f"{folder}/payloads")
    broken = F.raise_error(F.concat(F.lit("the payload stored under this address is damaged: "), F.col("address"))).cast("binary")
    sound = payloads.select("address", F.when(address(F.col("payload")) == F.col("address"), F.col("payload")).otherwise(broken).alias("payload"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = records.withColumn("part", F.pmod(F.xxhash64("record_id", "header"), F.col("parts")).cast("int"))
    joined = dealt.hint("merge").join(sound, ["address", "part"])
    body = F.when(F.col("whole"), F.col("payload")).otherwise(F.lit(b""))
    return joined.select("record_id", "header", "payload", F.concat("header", body, F.lit(RECORD_END)).alias("record"))


def parsed(records: DataFrame) -> DataFrame:
    """record_id, record_type, page_id, refers_to_id, payload_bytes, payload_digest of ``read_archive``'s rows.

    The fields are read from each record's own bytes. Of responses, the payload is what stands in the record behind its
    two headers, as its Content-Length says; of revisits, what their address keeps.
    """
    latin = F.decode("record", "ISO-8859-1")  # a character for each byte
    ends = F.split(latin, LINE_END * 2, 3)
    head, http = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
    value = lambda name: F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)\r?$", 1), F.lit(""))
    from_ = F.length(head) + F.length(http) + 8
    inside = F.substr(F.col("record"), from_ + 1, value("Content-Length").cast("int") - F.length(http) - 4)
    payload = F.when(value("WARC-Type") == "response", inside).otherwise(F.col("payload"))
    rows = records.select(
        value("WARC-Record-ID").alias("record_id"), value("WARC-Type").alias("record_type"), value("WARC-Page-ID").cast("long").alias("page_id"),
        value("WARC-Refers-To").alias("refers_to_id"), value("WARC-Payload-Digest").alias("named"), payload.alias("_payload"),
    )
    digest = F.sha1("_payload")
    broken = F.raise_error(F.concat(F.lit("the payload isn't what its record names: "), F.col("record_id")))
    return rows.select("record_id", "record_type", "page_id", "refers_to_id", F.octet_length("_payload").cast("long").alias("payload_bytes"), F.when(F.concat(F.lit("sha1:"), digest) == F.col("named"), digest).otherwise(broken).alias("payload_digest"))


def archived_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Per archived page: page_id, payload_bytes, payload_digest, record_type, refers_to (a revisit's response's page_id).

    Null payloads were archived as empty ones; repeated pages give repeated rows, one of which is the response; a page
    without a page_id is the response of no other; an empty table gives no rows; other columns aren't archived.
    """
    rows = written(parsed(read_archive(spark, folder)), "parsed")
    responses = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    revisits = rows.where("record_type = 'revisit'")
    # of responses, only those that a revisit names are dealt into parts
    named = responses.hint("merge").join(revisits.select("refers_to_id").distinct(), "refers_to_id", "left_semi")
    found = salted_join(revisits, named, "refers_to_id", "record_id")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return rows.where("record_type = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(found.select(*columns, "refers_to"))


def archive_and_read(pages: DataFrame) -> DataFrame:
    """``archived_pages`` of ``pages``, archived in a new folder."""
    folder = new_folder(pages.sparkSession, "archive")
    write_archive(pages, folder)
    return archived_pages(pages.sparkSession, folder)


def write_warc(records: DataFrame, folder: str, name: str = "pages") -> DataFrame:
    """Write the ``record`` bytes as WARC files below ``folder``, one gzip member per record; path, records, bytes per file.

    A retried task writes its file under another name first and then puts it in the first one's place.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        path, part = f"{root}/{name}-{task.partitionId():06d}.warc.gz", f"{root}/.{name}-{task.partitionId():06d}-{task.taskAttemptId()}"
        stream, n, size = None, 0, 0
        for batch in batches:
            for record in batch.column(0):
                if stream is None:
                    store.create_dir(root, recursive=True)
                    stream = store.open_output_stream(part, compression=None)
                member = gzip.compress(record.as_py(), 6, mtime=0)
                stream.write(member)
                n, size = n + 1, size + len(member)
        if stream is not None:
            stream.close()
            store.move(part, path)
            yield pa.RecordBatch.from_pylist([{"path": path, "records": n, "bytes": size}])

    return written(records.select("record").mapInArrow(save, "path string, records long, bytes long"), "manifest")


def read_warc(paths: DataFrame) -> DataFrame:
    """record_id, header, payload, whole of every record of the WARC files that ``paths`` (path) names, in gzip or plain.

    A task reads a file from front to back and holds one record at a time. HTTP headers of responses belong to ``header``.
    Records that lack a record id have a null one; a file that breaks off within a record raises an error.
    """
    columns = "record_id string, header binary, payload binary, whole boolean"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
                with store.open_input_stream(place, compression=None) as source:
                    for header, payload in warc_records(source):
                        found = [x.split(b":", 1)[1].strip().decode() for x in header.split(RECORD_END, 1)[0].split(b"\r\n") if x.lower().startswith(b"warc-record-id:")]
                        yield pa.RecordBatch.from_pylist([{"record_id": found[0] if found else None, "header": header, "payload": payload, "whole": True}], pa.schema([("record_id", pa.string()), ("header", pa.binary()), ("payload", pa.binary()), ("whole", pa.bool_())]))

    return paths.select("path").repartition("path").mapInArrow(load, columns)


def plain_bytes(source: pa.NativeFile) -> Iterator[bytes]:
    """A stream's bytes in pieces, unpacked where they are gzip members."""
    unpacker, first = None, True
    while data := source.read(1 << 20):
        if first:
            unpacker, first = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None, False
        if unpacker is None:
            yield data
            continue
        while data:
            yield unpacker.decompress(data)
            data = unpacker.unused_data
            if unpacker.eof:
                unpacker = zlib.decompressobj(31)


def warc_records(source: pa.NativeFile) -> Iterator[tuple[bytes, bytes]]:
    """(header, payload) of each record of a WARC stream; the two joined, and two line ends, are the record."""
    pieces, held = plain_bytes(source), b""

    def until(enough) -> bool:
        nonlocal held
        while not enough():
            piece = next(pieces, None)
            if piece is None:
                return False
            held += piece
        return True

    while True:
        until(lambda: len(held.lstrip(b"\r\n")) > 0)
        held = held.lstrip(b"\r\n")
        if not held:
            return
        if not held.startswith(b"WARC/"[: len(held)]) or not until(lambda: RECORD_END in held or len(held) > MOST_HEADER) or RECORD_END not in held:
            raise ValueError("no WARC header where a record should begin")
        head, held = held.split(RECORD_END, 1)
        fields = dict(x.split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
        fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
        size = int(fields[b"content-length"])
        if not until(lambda: len(held) >= size):
            raise ValueError("a WARC record breaks off")
        block, held = held[:size], held[size:]
        header = head + RECORD_END
        if fields.get(b"content-type", b"").startswith(b"application/http") and RECORD_END in block:
            http, payload = block.split(RECORD_END, 1)
            header, block = header + http + RECORD_END, payload
        yield header, block
