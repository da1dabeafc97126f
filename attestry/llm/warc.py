"""WARC archives with an index: records by byte ranges (operator 11)."""

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.shared import join_split, tidy

#: Payloads of fewer bytes are written again and again, as a revisit record would be about as long.
LEAST_REVISIT = 1000
#: Bytes after which a file is closed. A record is never divided.
FILE_BYTES = 256 << 20
#: Ranges of one file with at most GAP bytes between them are read together, until READ bytes are; a longer record is one read.
GAP, READ = 64 << 10, 8 << 20
#: Groups of equal payloads that are broadcast, some 100 bytes each; beyond that only the hot ones are.
GROUPS = 100_000

_INDEX = "file string, at long, length long, page_id long, url string, record_id string, record_type string, refers_to string, digest string, payload_bytes long"


def _record_id(page_id: int | None, sha256: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{sha256.hex()}')}>"


def _escaped(text: str) -> str:
    """A header's value: controls as percent signs and digits, so that no value ends its line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {_escaped(str(v))}\r\n" for k, v in fields if v is not None)
    return gzip.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", 6, mtime=0)


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, sha256, first): first is the page_id of the response that the page revisits; null for a response.

    Of equal payloads of `least` bytes or more the largest page_id is the response; all rows that share that id are responses. A null page_id is smaller than
    any. A null html is an empty payload. Payloads are equal if SHA-256 and length are; only digests are grouped, and a payload moves only if
    there are more than GROUPS groups of copies.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    keys = rows.filter(F.octet_length("payload") >= least).select("sha256", "page_id")
    groups = keys.groupBy(F.col("sha256").alias("g_sha")).agg(F.count("*").alias("n"), F.max("page_id").alias("first")).filter("n > 1")
    met = join_split(rows, groups, F.col("sha256") == F.col("g_sha"), "n", "left", GROUPS)
    return met.select("page_id", "url", "payload", "sha256", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))


def write_warc(records: DataFrame, path: str, index: str, date: str | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Writes records of plan_records as WARC 1.1 files below `path`, each record a gzip member of its own, and the table `index`: file, at, length and what a search needs of each record.

    Path and index are in a store that pyarrow and Spark both reach. Every task attempt writes files under names of its own, and its index rows are
    committed by Spark after them: what a lost or repeated task left behind is in no index, and so is never read.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        part, out, at, name = TaskContext.get().partitionId(), None, 0, ""
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, sha, first in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "sha256", "first"))):
                    page_id, url, payload, sha, first = page_id.as_py(), url.as_py(), payload.as_py(), sha.as_py(), first.as_py()
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                        at += out.write(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    digest, kind, old = hashlib.sha1(payload).digest(), "response", None
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    if first is not None:
                        kind, old = "revisit", _record_id(first, sha)
                    own = _record_id(page_id, sha)
                    fields = [
                        ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{base64.b32encode(digest).decode()}"), ("WARC-Refers-To", old),
                        ("WARC-Profile", old and "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Page-ID", page_id), ("Content-Type", "application/http; msgtype=response"),
                    ]
                    n = out.write(_record(fields, http if old else http + payload))
                    rows.append((name, at, n, page_id, url, own, kind, old, digest.hex(), len(payload)))
                    at += n
                yield pa.RecordBatch.from_pydict({f.split()[0]: list(c) for f, c in zip(_INDEX.split(", "), zip(*rows))} if rows else {f.split()[0]: [] for f in _INDEX.split(", ")}, schema=_SCHEMA)
        finally:
            if out is not None:
                out.close()

    records.mapInArrow(tidy(run), _INDEX).write.parquet(index)


_SCHEMA = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64()}[f.split()[1]]) for f in _INDEX.split(", ")])


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """The index table; filter it by url, digest or page_id, and give what is left to read_records."""
    return spark.read.schema(_INDEX).parquet(index)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields in lower case, and its payload: what follows the HTTP head of its block."""
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def read_records(selected: DataFrame, path: str, payload: bool = False, gap: int = GAP, most: int = READ) -> DataFrame:
    """(page_id, url, record_id, record_type, refers_to, payload_bytes, payload_digest), and the payload if asked for, of selected rows of the index, each from its own bytes.

    Rows are dealt out by ranges of (file, offset), and consecutive ones of a file become one read as long as `gap` and `most` allow. A payload that
    isn't what its header's digest says raises an error. A revisit has no payload of its own: its three last columns are null.
    """

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        file, run = None, []
        for batch in batches:
            for f, at, length in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "length"))):
                if run and (f != file or at - sum(run[-1]) > gap or at + length - run[0][0] > most):
                    yield file, run
                    run = []
                file = f
                run.append((at, length))
        if run:
            yield file, run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        opened, name = None, None
        for file, run in spans(batches):
            if file != name:
                if opened is not None:
                    opened.close()
                opened, name = store.open_input_file(f"{base}/{file}"), file
            start = run[0][0]
            raw, rows = opened.read_at(sum(run[-1]) - start, start), []
            for at, length in run:
                fields, body = parse_record(raw[at - start : at - start + length])
                digest, own = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")), fields["warc-type"] == "response"
                if own and hashlib.sha1(body).digest() != digest:
                    raise ValueError(f"{file} at {at}: the payload is not what its digest says")
                page = fields.get("page-id")
                rows.append((page and int(page), fields.get("warc-target-uri"), fields["warc-record-id"], fields["warc-type"], fields.get("warc-refers-to"), len(body) if own else None, digest.hex() if own else None, body if own else None))
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*(r[: len(schema)] for r in rows)))), schema=schema)
        if opened is not None:
            opened.close()

    fields = "page_id long, url string, record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * payload
    schema = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in fields.split(", ")])
    order = ["file", "at"]
    return selected.select("file", "at", "length").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(read), fields)


def resolved(records: DataFrame) -> DataFrame:
    """Rows of read_records with refers_to as the response's page_id, and each revisit's payload_bytes and payload_digest from that response's record."""
    seen = records.filter("record_type = 'response'").groupBy(F.col("record_id").alias("r_id")).agg(F.max("page_id").alias("r_page"), F.max("payload_bytes").alias("r_bytes"), F.max("payload_digest").alias("r_digest"))
    asked = records.filter("record_type = 'revisit'").groupBy(F.col("refers_to").alias("a_id")).agg(F.count("*").alias("n"))
    first = seen.join(asked, F.col("r_id") == F.col("a_id")).drop("a_id")
    met = join_split(records, first, F.col("refers_to") == F.col("r_id"), "n", "left")
    return met.select(
        "page_id", F.coalesce("payload_bytes", "r_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "r_digest").alias("payload_digest"), "record_type", F.col("r_page").alias("refers_to"), "url", "record_id")
