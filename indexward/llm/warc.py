"""WARC archives, and revisit records for equal payloads.

``write_warc`` writes one response record per page. ``resolve_revisits``
shuffles the headers of these records, not their payloads, by payload digest and
joins each record to the one that keeps the payload. ``write_deduplicated``
writes new archives with fresh headers, in which all others are revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexward.sources.scratch import materialize, qualified, scratch_path

from .common import Batches, one_task_each, slices
from .files import new_file, open_file

#: A new archive is begun after so many bytes, so that no task of a later step gets more than about that.
ARCHIVE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_ENTRY = "path string, offset bigint, length bigint"


def digest_of(payload: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value) -> str:
    return str(value).replace("\r", " ").replace("\n", " ")


def record(kind: str, headers: dict[str, object], block: bytes, level: int = 3) -> bytes:
    """A compressed record; headers without a value are left out, line breaks in values become spaces."""
    lines = [f"{k}: {_one_line(v)}" for k, v in {"WARC-Type": kind, **headers, "Content-Length": len(block)}.items() if v is not None]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    head = "\r\n".join(["WARC/1.1", *lines]).encode() + b"\r\n\r\n"
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP headers of a block."""
    return block.partition(b"\r\n\r\n")[2]


class _Archives:
    """Writes records to archives in a folder and remembers where they are."""

    def __init__(self, folder: str, size: int):
        self.folder, self.size, self.out, self.path, self.at = folder, size, None, "", 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= self.size:
            self.close()
            self.out, self.path = new_file(self.folder, "archive", ".warc.gz")
            self.at = 0
        place = (self.path, self.at, len(data))
        self.out.write(data)
        self.at += len(data)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write_warc(
    pages: DataFrame, key: str = "page_id", url: str | None = "url", payload: str = "html", folder: str | None = None,
    archive_bytes: int = ARCHIVE_BYTES, date: str | None = None,
) -> DataFrame:
    """One response record per row; returns the index of the records, their headers and places.

    Columns: ``key`` (text), ``url``, ``record_id``, ``date``, ``payload_bytes``, ``payload_digest``, ``path``, ``offset``,
    ``length``. Null payloads are empty, null keys and addresses are left out of the headers, repeated rows get records of
    their own, an empty table gives no archive.
    """
    folder = qualified(pages.sparkSession, folder or scratch_path(pages.sparkSession, "warc"))
    at = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    address = F.col(url).cast("string") if url else F.lit(None).cast("string")
    picked = pages.select(F.col(key).cast("string").alias("key"), address.alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))

    def write(batches: Batches) -> Batches:
        archives = _Archives(folder, archive_bytes)
        for batch in slices(batches):
            rows = []
            for k, u, text in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "payload"))):
                body = text.encode("utf-8", "replace")
                name, digest = f"<urn:uuid:{uuid.uuid4()}>", digest_of(body)
                headers = {
                    "WARC-Record-ID": name, "WARC-Date": at, "WARC-Target-URI": u, "WARC-Payload-Digest": f"sha1:{digest}",
                    "Content-Type": "application/http; msgtype=response", "X-Record-Key": k,
                }
                rows.append((k, u, name, at, len(body), digest, *archives.add(record("response", headers, _HTTP + body))))
            columns = [pa.array(v, t) for v, t in zip(zip(*rows), (pa.string(),) * 4 + (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "url", "record_id", "date", "payload_bytes", "payload_digest", "path", "offset", "length"])
        archives.close()

    schema = f"key string, url string, record_id string, date string, payload_bytes bigint, payload_digest string, {_ENTRY}"
    return materialize(picked.mapInArrow(write, schema), "warc-index")


def resolve_revisits(index: DataFrame, key_type: str = "bigint", min_bytes: int = 0) -> DataFrame:
    """The index with ``record_type`` and, for revisits, the record they refer to.

    Of the records with one payload digest and at least ``min_bytes`` bytes, the one with the largest key (then record id)
    keeps its payload; the others revisit it. Only headers are shuffled: the kept record of each digest is found with
    partial aggregates, and the join back is on a side that has each digest once, so a digest that many records share is split.
    """
    mine = F.struct(F.col("key").cast(key_type).alias("k"), F.col("record_id").alias("id"), F.col("url").alias("u"), F.col("date").alias("d"))
    kept = (
        index.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
        .agg(F.max(mine).alias("r"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("payload_digest", F.col("r.id").alias("refers_to"), F.col("r.u").alias("refers_url"), F.col("r.d").alias("refers_date"))
    )
    is_revisit = F.col("refers_to").isNotNull() & (F.col("refers_to") != F.col("record_id")) & (F.col("payload_bytes") >= min_bytes)
    joined = index.join(kept, "payload_digest", "left")
    return joined.withColumn("record_type", F.when(is_revisit, "revisit").otherwise("response"))


def write_deduplicated(resolved: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """New archives from those that ``resolved`` indexes; returns the places of the records, ``path, offset, length``.

    Records are read by archive and place. A revisit record has the headers of its own capture, the digest, and where the
    payload is; its block holds the HTTP headers only.
    """
    folder = qualified(resolved.sparkSession, folder or scratch_path(resolved.sparkSession, "warc-deduplicated"))
    at = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    needed = resolved.select("path", "offset", "length", "record_type", "refers_to", "refers_url", "refers_date")

    def write(batches: Batches) -> Batches:
        archives, source, opened = _Archives(folder, archive_bytes), None, None
        for batch in slices(batches):
            rows = []
            for path, offset, length, kind, to, to_url, to_date in zip(*(c.to_pylist() for c in batch.columns)):
                if path != opened:
                    if source is not None:
                        source.close()
                    source, opened = open_file(path), path
                source.seek(offset)
                headers, block = parse(zlib.decompress(source.read(length), 31))
                fresh: dict[str, object] = {k: v for k, v in headers.items() if k not in ("WARC-Type", "Content-Length")}
                fresh["X-Written"] = at
                if kind == "revisit":
                    fresh |= {"WARC-Profile": PROFILE, "WARC-Refers-To": to, "WARC-Refers-To-Target-URI": to_url, "WARC-Refers-To-Date": to_date}
                    block = block[: len(block) - len(payload_of(block))]
                rows.append(archives.add(record(kind, fresh, block)))
            columns = [pa.array(v, t) for v, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "offset", "length"])
        if source is not None:
            source.close()
        archives.close()

    ordered = one_task_each(needed, "path").sortWithinPartitions("path", "offset")
    return materialize(ordered.mapInArrow(write, _ENTRY), "warc-places")


def read_warc(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archives in ``paths`` (column ``path``, each archive once), in any order.

    ``key, url, record_id, record_type, payload_digest, payload_bytes, refers_to`` and, on request, ``payload`` (binary).
    Payload columns are null for revisits. A payload that does not meet its digest is an error.
    """

    def records(path: str):
        with open_file(path) as source:
            data, unpack, parts = source.read(1 << 20), zlib.decompressobj(31), []
            while data:
                parts.append(unpack.decompress(data))
                if unpack.eof:
                    yield parse(b"".join(parts))
                    data, parts, unpack = unpack.unused_data or source.read(1 << 20), [], zlib.decompressobj(31)
                else:
                    data = source.read(1 << 20)

    def read(batches: Batches) -> Batches:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
            names = ["key", "url", "record_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
            width = len(names) - (not with_payload)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in list(zip(zip(*rows), types))[:width]], names[:width])

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for h, block in records(path):
                    kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                    body = payload_of(block) if kind == "response" else None
                    if body is not None and digest_of(body) != digest:
                        raise ValueError(f"payload of {h['WARC-Record-ID']} does not meet its digest")
                    size = None if body is None else len(body)
                    rows.append((h.get("X-Record-Key"), h.get("WARC-Target-URI"), h["WARC-Record-ID"], kind, digest, size, h.get("WARC-Refers-To"), body if with_payload else None))
                    if len(rows) >= 256:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    schema = "key string, url string, record_id string, record_type string, payload_digest string, payload_bytes bigint, refers_to string"
    return one_task_each(paths.select("path").distinct(), "path").mapInArrow(read, schema + (", payload binary" if with_payload else ""))


def resolved_records(records: DataFrame, key_type: str = "bigint") -> DataFrame:
    """Records with the bytes of the payload and the key of the original filled in for revisits."""
    originals = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("key").cast(key_type).alias("_key")
    )
    revisits = records.where("record_type = 'revisit'").join(originals, "refers_to")
    shape = lambda size, key: [F.col("key").cast(key_type).alias("key"), size.alias("payload_bytes"), "payload_digest", "record_type", key.alias("refers_to")]
    direct = records.where("record_type = 'response'").select(*shape(F.col("payload_bytes"), F.lit(None).cast(key_type)))
    return direct.unionByName(revisits.select(*shape(F.col("_bytes"), F.col("_key"))))


#: Base 32 of a hex SHA-1 in SQL: five hex digits are four characters.
_BASE32 = """array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
  lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(sha1(payload), 5 * i + 1, 5) AS BIGINT) >> s) & 31 AS INTEGER) + 1, 1)), '')), '')"""

REVISITS_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS original FROM pages)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to
FROM p
"""
