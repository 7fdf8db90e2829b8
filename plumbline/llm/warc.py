"""WARC archives of pages: written with one gzip member a record, read back record by record.

Equal payloads of some length are stored once: the record of the largest page id is the response, the
others are revisits that name it. Archives are files in the shared folder. Each task streams its
records into one archive under a name of its own attempt and reports it in a manifest that Spark
commits, so a retried or lost task leaves at most a file that no manifest names.

Reading goes through an archive sequentially with bounded memory: bytes are fed to one decompressor a
member, headers end at the blank line, the block is framed by Content-Length, and its digest must match.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.ship import ship
from plumbline.session import scratch_path

LEAST_SHARED = 1000
FEED = 1 << 16
LEVEL = 3
MANIFEST = "archive string, records long, bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_RECORD = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
    ]
)


class DamagedArchive(ValueError):
    """An archive whose framing, length or digest does not hold."""


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int) -> bytes:
    """One record as a gzip member. A revisit has an empty block and names the record that has it."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{_base32(digest)}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {url.replace('%', '%25').replace(chr(13), '%0D').replace(chr(10), '%0A')}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).hexdigest())}", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + pack.flush()


def members(feed: Iterable[bytes]) -> Iterator[bytes]:
    """The contents of consecutive gzip members, decompressed a piece at a time."""
    unpack, out, started = zlib.decompressobj(31), [], False
    for data in feed:
        while data:
            started = True
            out.append(unpack.decompress(data))
            data = unpack.unused_data if unpack.eof else b""
            if unpack.eof:
                yield b"".join(out)
                unpack, out, started = zlib.decompressobj(31), [], False
    if started:
        raise DamagedArchive("the archive ends within a record")


def parsed(content: bytes) -> tuple:
    """A record's fields, checked: framing, length and digests."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise DamagedArchive("a record without a WARC header")
    fields = {name.lower(): value for name, value in (line.split(": ", 1) for line in lines[1:])}
    size = int(fields["content-length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise DamagedArchive(f"{fields['warc-record-id']}: the block does not have {size} bytes")
    found = hashlib.sha1(block).hexdigest()
    if fields["warc-block-digest"] != f"sha1:{_base32(found)}":
        raise DamagedArchive(f"{fields['warc-record-id']}: the block's digest differs")
    kind = fields["warc-type"]
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response" and digest != found:
        raise DamagedArchive(f"{fields['warc-record-id']}: the payload's digest differs")
    number = lambda name: int(x) if (x := fields[name].removeprefix("<urn:page:").removesuffix(">")) else None
    url = fields.get("warc-target-uri")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return (
        number("warc-record-id"), url, kind, number("warc-refers-to") if "warc-refers-to" in fields else None, digest,
        int(fields["x-payload-length"]), block if kind == "response" else None,
    )


def planned(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """Pages with the digest and length of their payload, and the page that a revisit refers to."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    long_ones = F.col("size") >= least
    first = rows.where(long_ones).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1")
    # Digests that occur once are not joined at all: the left side's other rows find no partner.
    joined = rows.join(first.select("digest", "kept"), "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", "size", F.when(long_ones & (F.col("kept") > F.col("page_id")), F.col("kept")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives below ``folder``; returns the manifest, as stored.

    Null html is an empty payload, null urls have no target; short payloads and rows without a page id
    are never revisits; of repeated rows with the same page id each is a response. An empty table
    writes an empty manifest. Other columns are not stored. ``folder`` may be any store that
    ``pyarrow.fs`` reaches by its address, such as file: or hdfs:.
    """
    spark = pages.sparkSession
    ship(spark)

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(root, recursive=True)
        name, out, records = "", None, 0
        context = TaskContext.get()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "size"))):
                if out is None:
                    name = f"archive-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member(*row))
                records += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [records], "bytes": [size]})

    manifest = f"{folder}/manifest"
    planned(pages).mapInArrow(write, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives that the manifest of ``folder`` names; revisits have a null payload."""
    ship(spark)
    named = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    named = named.repartition(F.col("archive"))

    def read(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            for name, expected in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist()):
                rows, held, count = [], 0, 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for content in members(iter(lambda: stream.read(FEED), b"")):
                        rows.append(parsed(content))
                        count += 1
                        held += len(content)
                        if held > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _RECORD.types)], schema=_RECORD)
                            rows, held = [], 0
                if count != expected:
                    raise DamagedArchive(f"{name}: {count} records instead of {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _RECORD.types)], schema=_RECORD)

    return named.mapInArrow(read, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` written to new archives in the shared folder and read back."""
    folder = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, folder)
    return read_archives(pages.sparkSession, folder)
