"""WARC archives: written with an index first, read back by coalesced byte ranges.

Writing: each page becomes one WARC record, a gzip member of its own, appended to a file of the task in the shared folder. While
writing, the task puts out the index row of each record: file, offset, length, URL and digest. A file gets a new name on every attempt, and
only the rows of committed attempts reach the index, so files of lost or repeated tasks are never read.

Reading: the index rows of the selected records are dealt by file and block of offsets, sorted, and neighbouring ranges are joined
to one read of bounded size. Only the selected ranges are read, each payload is checked against its digest.

Of records with equal payloads of at least 100 bytes, the one with the smallest page id is a response, the others are
revisits without payload that name it. Digests are grouped without the payloads.

Edge cases: a null html is an empty payload; a null URL is left out; control characters and blanks in a URL are percent-encoded;
rows with the same smallest page id are all responses; a null page id is larger than any other; a record larger than the
block is read alone; an empty table gives an empty index and no records.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlens.session import new_path, write_stage

LEAST_REVISIT_BYTES = 100
BLOCK_BYTES = 8_000_000
GAP_BYTES = 64_000
TASK_BYTES = 4_000_000
FILE_BYTES = 256_000_000

INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, record_type string"
RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
)


def decide(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to); revisits have no payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        "page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
    )
    groups = (
        rows.filter(F.col("payload_bytes") >= LEAST_REVISIT_BYTES)
        .groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1").drop("n")
    )
    # Written, so that a frequent digest meets a plain table and adaptive execution can split its pages.
    groups = write_stage(groups, "warc-groups")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(groups, "payload_digest", "left").select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"),
    )


def _record(page_id, url, payload, n_bytes, digest, kind, refers_to) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id if page_id is not None else ''}>"]
    if url is not None:
        quoted = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {quoted}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {n_bytes}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if kind == "revisit":
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload or b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse(data: bytes) -> tuple[dict, bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _write_files(folder: str, file_bytes: int):
    def run(parts):
        store, root = fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        for part in parts:
            rows = []
            for r in part.to_pylist():
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = gzip.compress(_record(*r.values()), 6, mtime=0)
                out.write(member)
                rows.append((r["page_id"], name, at, len(member), r["url"], r["payload_digest"], r["record_type"]))
                at += len(member)
                if at >= file_bytes:
                    out.close()
                    out = None
            columns = ["page_id", "file", "offset", "length", "url", "payload_digest", "record_type"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], columns)
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Write all ``pages`` (page_id, url, html); returns the folder of the archives and the written index."""
    folder = new_path(pages.sparkSession, "warc")
    decided = decide(pages)
    # pyarrow makes missing folders of local stores only here, once, before tasks write to them.
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    ordered = decided.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return folder, write_stage(ordered.mapInArrow(_write_files(folder, file_bytes), INDEX), "warc-index")


def _read_ranges(folder: str, block_bytes: int, gap_bytes: int):
    def fetch(store, root, ranges):
        """Records of neighbouring ranges of one file by one read."""
        name, start = ranges[0][0], ranges[0][1]
        stop = ranges[-1][1] + ranges[-1][2]
        with store.open_input_file(f"{root}/{name}") as f:
            data = f.read_at(stop - start, start)
        out = []
        for _, offset, length in ranges:
            fields, payload = _parse(gzip.decompress(data[offset - start : offset - start + length]))
            kind = fields["WARC-Type"]
            digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
            n_bytes = int(fields["WARC-Payload-Length"])
            if kind == "response":
                n_bytes, found = len(payload), hashlib.sha256(payload).hexdigest()
                if found != digest:
                    raise ValueError(f"record at {offset} of {name}: payload and digest differ")
            page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
            refers = fields.get("WARC-Refers-To", "<urn:page:>")[len("<urn:page:") : -1]
            out.append((
                int(page) if page else None, fields.get("WARC-Target-URI"), kind, int(refers) if refers else None,
                payload if kind == "response" else None, n_bytes, digest,
            ))
        return out

    def batch(rows):
        names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names)

    def run(parts):
        store, root = fs.FileSystem.from_uri(folder)
        ranges, end = [], 0
        for part in parts:
            for name, offset, length in zip(*(part.column(c).to_pylist() for c in ("file", "offset", "length"))):
                joins = ranges and ranges[0][0] == name and 0 <= offset - end <= gap_bytes and offset + length - ranges[0][1] <= block_bytes
                if ranges and not joins:
                    yield batch(fetch(store, root, ranges))
                    ranges = []
                ranges.append((name, offset, length))
                end = offset + length
        if ranges:
            yield batch(fetch(store, root, ranges))

    return run


def read_records(folder: str, index: DataFrame, block_bytes: int = BLOCK_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The records of the selected ``index`` rows, read from the archives and checked against their digests.

    The index rows are small, what they point at is not: the number of tasks follows the bytes to read, ``TASK_BYTES`` each.
    """
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    dealt = (
        index.select("file", "offset", "length")
        .withColumn("block", F.floor(F.col("offset") / min(block_bytes, TASK_BYTES)))
        .repartition(tasks, "file", "block").sortWithinPartitions("file", "offset").drop("block")
    )
    return dealt.mapInArrow(_read_ranges(folder, block_bytes, gap_bytes), RECORD)
