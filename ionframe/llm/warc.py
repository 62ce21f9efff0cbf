"""WARC archives: writing one gzip member per record, and a splittable reader.

Writing: rows go to files in the shared folder, one per task, each under a temporary name that is moved into place, so
a task run twice leaves one whole file. Records with payloads of at least ``min_bytes`` bytes that are equal to another's
become revisits of the one with the largest page_id.

Reading: files are cut into byte ranges. A task scans its range for the gzip magic, accepts a candidate only if it
decodes to a WARC header, then reads member after member; it owns the records that start inside its range, whatever
their length. A range that begins inside a stored payload may find the records of an archive embedded there; as the
record around them, owned by an earlier range, spans their places, a window over each file's places drops them. Revisits
get the size of the payload they refer to by a join.

Defined results: a null html is an empty payload; a null url is an empty target; of equal payloads every row with the
largest page_id is a response (so are repeated rows of it); a null page_id is smaller than any other; extra columns are
ignored; an empty table gives no records and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ionframe.storage import materialise, new_path, table

MIN_BYTES, SPLIT_BYTES, LEVEL, STEP = 0, 8 << 20, 3, 1 << 16
MAGIC, CRLF = b"\x1f\x8b\x08", b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: The WARC format's profile of a revisit by equal payload, and the date all records carry.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(page_id: int | None, url: str, payload: bytes, sha1_hex: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One gzip member."""
    block = HTTP if is_revisit else HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{base32(sha1_hex)}",
        *([f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Profile: {PROFILE}"] if is_revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(CRLF.join(h.encode("utf-8", "replace") for h in head) + CRLF + CRLF) + deflate.compress(block) + deflate.compress(CRLF + CRLF) + deflate.flush()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{context.partitionId():05d}.warc.gz"
        draft = f"{root}/.{name}.{context.taskAttemptId()}"
        size = 0
        with store.open_output_stream(draft) as out:
            for batch in batches:
                columns = [batch.column(i) for i in range(batch.num_columns)]
                for row in range(batch.num_rows):
                    page_id, url, payload, sha1_hex, keeper, revisit = (c[row].as_py() for c in columns)
                    member = record(page_id, url, payload, sha1_hex, keeper, revisit)
                    out.write(member)
                    size += len(member)
        if size:
            store.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64())], names=["file", "bytes"])
        else:
            store.delete_file(draft)

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes every row of (page_id, url, html); returns the manifest (file, bytes)."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    hashed = keyed.withColumn("sha", F.sha1("payload"))
    stamps = materialise(hashed.select("page_id", "sha", F.octet_length("payload").alias("n")), "warc-digests")
    keepers = stamps.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("same")).where("same > 1")
    keepers = materialise(keepers.select(F.col("sha").alias("_sha"), "keeper"), "warc-keepers")
    revisits = stamps.join(keepers.hint("merge"), F.col("sha") == F.col("_sha")).where(~F.col("page_id").eqNullSafe(F.col("keeper"))).select(F.col("page_id").alias("_id"), "_sha", "keeper").distinct()
    rows = (
        hashed.join(revisits.hint("merge"), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")
        .select("page_id", "url", F.when(F.col("_sha").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "sha", "keeper", F.col("_sha").isNotNull().alias("revisit"))
    )
    return materialise(rows.mapInArrow(_write(folder), "file string, bytes long"), "warc-manifest")


class Range:
    """A file from ``start`` on, read in steps as far as it is needed."""

    def __init__(self, file: str, start: int):
        store, path = pafs.FileSystem.from_uri(file)
        self.source = store.open_input_file(path)
        self.size, self.base, self.data = self.source.size(), start, b""
        self.source.seek(start)

    def more(self) -> bool:
        got = self.source.read(STEP)
        self.data += got
        return bool(got)

    def trim(self, to: int) -> None:
        """Forget what lies before ``to``."""
        if to - self.base > 16 * STEP:
            self.data, self.base = self.data[to - self.base :], to

    def magic(self, at: int, end: int) -> int:
        """The first place of the magic at or after ``at`` and before ``end``, or -1."""
        while True:
            found = self.data.find(MAGIC, at - self.base)
            if found >= 0:
                return self.base + found if self.base + found < end else -1
            at = max(at, self.base + len(self.data) - len(MAGIC) + 1)
            if at >= end:
                return -1
            self.trim(at)
            if not self.more():
                return -1

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The content of the gzip member at ``at`` and where it ends, or None unless it decodes to a WARC record."""
        inflate, out, place = zlib.decompressobj(31), [], at
        seen = b""
        try:
            while not inflate.eof:
                if place - self.base >= len(self.data) and not self.more():
                    return None
                piece = self.data[place - self.base : place - self.base + STEP]
                place += len(piece)
                out.append(inflate.decompress(piece))
                if len(seen) < 7:
                    seen = (seen + out[-1])[:7]
                    if not b"WARC/1.".startswith(seen):
                        return None
        except zlib.error:
            return None
        return b"".join(out), place - len(inflate.unused_data)


def parse(content: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (by lower-case name) and block of a record, or None."""
    head, gap, rest = content.partition(CRLF + CRLF)
    fields = dict((k.strip().lower(), v.strip()) for k, v in (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line))
    length = fields.get("content-length", "")
    return (fields, rest[: int(length)]) if gap and length.isdigit() and len(rest) >= int(length) else None


def _page(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def read_range(file: str, start: int, end: int, whole: bool) -> Iterator[tuple]:
    """The records that start in [start, end): page_id, url, type, digest, payload bytes, refers_to, payload (if ``whole``), file, place, end."""
    data, at = Range(file, start), start
    while (at := data.magic(at, end)) >= 0:
        got = data.member(at)
        found = parse(got[0]) if got else None
        if not found:
            at += 1
            continue
        fields, block = found
        payload = block.partition(CRLF + CRLF)[2]
        kind = fields.get("warc-type", "")
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "response":
            digest = base32(hashlib.sha1(payload).hexdigest())
        refers = fields.get("warc-refers-to")
        yield (_page(fields.get("warc-record-id", "")), fields.get("warc-target-uri", ""), kind, digest, len(payload) if kind == "response" else None, _page(refers) if refers else None, payload if whole else None, file, at, got[1])
        at = got[1]
        data.trim(at)


READ = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary, file string, place long, stop long"


def _read(whole: bool):
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        for batch in batches:
            for cut in batch.to_pylist():
                rows: list[tuple] = []
                for row in read_range(cut["file"], cut["start"], cut["end"], whole):
                    rows.append(row)
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, whole: bool = False) -> DataFrame:
    """The records of the files in (file, bytes), read by ranges of ``split_bytes``; with payloads if ``whole``."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    cuts = manifest.where("bytes > 0").select("file", starts.alias("start")).withColumn("end", F.col("start") + split_bytes)
    # a task per range: left to itself, adaptive execution would put the few small rows into one task
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    found = cuts.repartition(int(n)).mapInArrow(_read(whole), READ)
    before = F.max("stop").over(W.partitionBy("file").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    return found.withColumn("_before", before).where("_before IS NULL OR _before <= place").drop("_before", "file", "place", "stop")


def resolved(records: DataFrame) -> DataFrame:
    """Revisits with the size of the payload they refer to."""
    responses = records.where("record_type = 'response'").select(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).distinct()
    size: Column = F.coalesce("payload_bytes", "_bytes")
    return records.join(responses, F.col("payload_digest") == F.col("_digest"), "left").select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return resolved(materialise(read_archives(manifest).drop("url", "payload"), "warc-records"))


_CHARS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
ORACLE_SQL = rf"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS sha FROM pages
), x AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha, max(page_id) OVER (PARTITION BY sha) AS keeper,
         [CAST('0x' || substr(sha, i * 5 + 1, 5) AS BIGINT) for i in range(8)] AS v
  FROM p
)
SELECT page_id, payload_bytes,
       list_aggregate([{' || '.join(f"substr({_CHARS}, CAST((i >> {b}) & 31 AS BIGINT) + 1, 1)" for b in (15, 10, 5, 0))} for i in v], 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM x
"""
