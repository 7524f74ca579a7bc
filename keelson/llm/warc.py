"""WARC archives: written by Spark's text sink, read by a Python data source.

Writing: each record is one string (header block, blank line, payload), and
the sink's record separator is the two line breaks that end a WARC record.
So archives are committed like any other Spark output, on any file system
that Spark writes.  Of records with equal payloads (SHA-1 and length) that
have at least ``revisit_from`` bytes, the one with the smallest id is a
response and the others revisit it without a payload.

Reading: ``spark.read.format("warc")``.  The plan is one partition per run of
archive files; the record type and header equalities of the query are pushed
down; a record's header block is parsed first, and its payload is skipped
by its Content-Length, neither read nor decoded, unless the record passes
and the ``payload`` option asks for it.  Payloads are bytes.  Header names
count in any case, with or without a blank after the colon, and may go on in
lines that begin with one; ids of other writers come as they are, without
their brackets; ``.gz`` archives (a member a record, or any other cut) are
read as streams.  ``path`` is a local path or any URI that ``pyarrow.fs`` opens;
``s3a`` and ``s3n`` are read as ``s3``.

Defined results: a null html is an empty payload; a null URL has no target
header; rows with a null id are written without an id header and are never
pointed at unless all equal ones lack it; repeated rows of the smallest id
are responses each; an empty table gives archives without records; other
columns are ignored.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from keelson.llm.common import scratch, temporary

EOL = "\r\n"
SCHEMA = ("record_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
          "payload_length long, content_length long, payload binary")
# The header of each column.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
           "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length",
           "content_length": "Content-Length"}
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each 5 of the 40 hexadecimal digits are 4 characters."""
    digits = F.sha1(payload)
    out = []
    for i in range(8):
        n = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("long")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(BASE32), (F.shiftright(n, shift).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


def records(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """``(page_id, url, html, payload_digest, payload_length, refers_to)``; ``refers_to`` is null for a response."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = (rows.withColumn("payload_digest", sha1_base32(F.col("html").cast("binary")))
            .withColumn("payload_length", F.octet_length("html").cast("long")))
    # Only digests that repeat are joined; the small side is stored, so that the join shuffles
    # both sides and AQE can split a digest that a third of the rows share.
    first = scratch(rows.where(F.col("payload_length") >= revisit_from).groupBy("payload_digest", "payload_length")
                    .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-first")
    return (rows.join(first, ["payload_digest", "payload_length"], "left")
            .withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")),
                                            F.col("first")))
            .select("page_id", "url", "html", "payload_digest", "payload_length", "refers_to"))


def record_text(date: str = "2024-01-01T00:00:00Z") -> Column:
    """The record as one string, without the line breaks that end it."""
    is_revisit = F.col("refers_to").isNotNull()
    body = F.when(is_revisit, F.lit("")).otherwise(F.col("html"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit(""))

    page = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    clean_url = F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")
    return F.concat(
        F.lit(f"WARC/1.1{EOL}"), line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", page("page_id")), F.lit(f"WARC-Date: {date}{EOL}"), line("WARC-Target-URI", clean_url),
        line("WARC-Refers-To", page("refers_to")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_length").cast("string")),
        F.when(is_revisit, F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{EOL}"))
        .otherwise(F.lit("")),
        F.lit(f"Content-Type: text/html; charset=utf-8{EOL}"),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit(EOL), body)


def write_warc(pages: DataFrame, path: str, revisit_from: int = 0) -> None:
    """Write ``pages(page_id, url, html)`` as archives under ``path`` (a new folder)."""
    with temporary():
        records(pages, revisit_from).select(record_text().alias("value")).write.option("lineSep", EOL + EOL).text(path)


class ArchiveFiles(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcSource(DataSource):
    """``path``; ``payload`` (``true``): read payloads; ``partition_bytes``: bytes of files a partition takes at least."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", 32 << 20))
        self.wanted: dict[str, str] = {}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802 - the interface's name
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in HEADERS and f.value is not None \
                    and f.attribute[0] not in self.wanted:
                self.wanted[f.attribute[0]] = str(f.value)
            else:
                yield f

    def _open(self):
        import pyarrow.fs as fs

        path = re.sub("^s3[an]://", "s3://", self.path)
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs as fs

        store, root = self._open()
        one = store.get_file_info(root)
        found = [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        plan: list[list[str]] = [[]]
        held = 0
        for info in sorted((x for x in found if x.type == fs.FileType.File and x.size
                            and not x.base_name.startswith(("_", "."))), key=lambda x: x.path):
            if plan[-1] and held + info.size > self.partition_bytes:
                plan.append([])
                held = 0
            plan[-1].append(info.path)
            held += info.size
        return [ArchiveFiles(files) for files in plan]

    def read(self, partition: ArchiveFiles) -> Iterator[tuple]:
        store, _ = self._open()
        for name in partition.files:
            with store.open_input_file(name) as f:
                yield from self.records(gzip.GzipFile(fileobj=f) if name.endswith(".gz") else f)

    def records(self, f) -> Iterator[tuple]:
        """Records of one archive: the header block, then the payload or a skip.

        ``buffer`` holds the bytes from ``base`` on, and the file stands at its end.
        """
        at, buffer, base = 0, b"", 0
        while True:
            while (stop := buffer.find(b"\r\n\r\n", at - base)) < 0 or not buffer[at - base:stop].strip():
                if stop >= 0:  # blank lines between records
                    at = base + stop + 4
                    continue
                buffer, base = buffer[at - base:], at
                more = f.read(max(1 << 16, len(buffer)))
                if not more:
                    if buffer.strip():
                        raise ValueError(f"a WARC record at byte {at} has no end of its header")
                    return
                buffer += more
            head = headers(buffer[at - base:stop])
            if not head.get("content-length", "").isdigit():
                raise ValueError(f"the WARC record at byte {at} has no Content-Length")
            start, length = base + stop + 4, int(head["content-length"])
            at, held = start + length, base + len(buffer)
            payload = None
            if row := self.row(head):
                if self.payload:
                    payload = buffer[start - base:at - base]
                    if at > held:
                        payload += f.read(at - held)
                        held = at
                    if len(payload) < length:
                        raise ValueError(f"the WARC record at byte {start} ends before its {length} bytes")
                yield (*row, payload)
            if at >= base + len(buffer):
                if at > held:
                    f.seek(at)
                buffer, base = b"", at

    def row(self, head: dict[str, str]) -> tuple | None:
        number = lambda x: int(x) if x is not None and x.isdigit() else None
        values = {c: head.get(h.lower()) for c, h in HEADERS.items()}
        for c in ("record_id", "refers_to"):
            if values[c] is not None:
                values[c] = values[c].removeprefix("<").removesuffix(">").removeprefix("urn:page:")
        if values["payload_digest"]:
            values["payload_digest"] = values["payload_digest"].removeprefix("sha1:")
        if any(values[c] != v for c, v in self.wanted.items()):
            return None
        for c in ("payload_length", "content_length"):
            values[c] = number(values[c])
        return tuple(values[c] for c in HEADERS)


def headers(block: bytes) -> dict[str, str]:
    """The fields of a header block by their names in lower case; of repeated ones the first."""
    lines: list[str] = []
    for line in block.decode("utf-8", "replace").strip("\r\n").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    out: dict[str, str] = {}
    for line in lines:
        name, _, value = line.partition(":")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives under ``path`` (columns of ``SCHEMA``).

    Registers the source, and allows Python sources to take filters: a session
    setting, which stays, as Spark pushes filters down only when a query runs.
    """
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def verified(spark: SparkSession, path: str) -> DataFrame:
    """``(record_id, payload_length, payload_digest, record_type, refers_to)`` of the archives' records.

    Length and digest of responses are worked out from the payloads that are
    read; revisits are read by their headers alone, by a pushed-down type.
    """
    responses = read_warc(spark, path).where("record_type = 'response'").select(
        "record_id", F.octet_length("payload").cast("long").alias("payload_length"), sha1_base32(F.col("payload")).alias("payload_digest"),
        "record_type", "refers_to")
    revisits = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    return responses.unionByName(revisits.select(*responses.columns))
