"""WARC archives: a deterministic sharded writer and its reader.

Records are sorted by page and cut into shards of a fixed number of pages, so which
records a file holds, and its bytes, depend on the pages only. Each shard is written
by one task as a stream of gzip members, and goes on in a new file when one has grown
to its size. Files get temporary names of their own for each attempt; a second job moves
those that count to their final names, then a manifest lists them, and a marker that is
written last makes the archive valid.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.partition import numbered
from ..sources.ship import ship
from ..sources.tables import shared_folder
from . import _files
from ._spark import checkpointed

#: Digests with copies are broadcast up to so many (about 100 bytes each); beyond, they are joined by shuffle.
BROADCAST_DIGESTS = 50_000
#: In that join, digests of more than one in HOT of all rows are broadcast still; there are fewer than HOT of them.
HOT = 500
#: Bytes of payload that a reading task holds before it passes them on.
READ_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID(int=0)
FILES = "shard long, seq long, file string, temporary string, records long, responses long, bytes long, sha256 string"
RECORDS = "file string, record_id string, record_type string, page_id long, url string, date string, payload binary, payload_bytes long, payload_sha1 string, refers_to long, refers_to_id string"


def _key() -> Column:
    """A string whose order is that of the records: by page_id, null first, and then by payload digest."""
    page = F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(page, F.lit("!")), F.col("digest"))


def _rows(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, bytes, key); a null html is an empty payload."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    return rows.withColumn("key", _key())


def _repeated(rows: DataFrame, revisit_from: int) -> DataFrame:
    """(digest, last, n): payloads of at least ``revisit_from`` bytes that several rows have, and their response (page_id, url)."""
    last = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("last")
    return rows.where(F.col("bytes") >= revisit_from).groupBy("digest").agg(last, F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null")


def with_responses(rows: DataFrame, revisit_from: int, most: int = BROADCAST_DIGESTS) -> DataFrame:
    """Rows with ``refers_to`` and ``refers_url``, null for responses.

    Few digests are broadcast. Of many, those of more than one in HOT of all rows are broadcast, so that no task
    of the join by digest gets more rows than that.
    """
    repeated = checkpointed(_repeated(rows.select("page_id", "url", "digest", "bytes"), revisit_from))
    found = repeated.withColumnRenamed("digest", "_digest").select("_digest", "last", "n")
    if repeated.count() <= most:
        joined = rows.join(F.broadcast(found), F.col("digest") == F.col("_digest"), "left")
    else:
        edge = repeated.agg(F.sum("n")).first()[0] // HOT
        hot = rows.join(F.broadcast(found.where(F.col("n") > edge)), F.col("digest") == F.col("_digest"), "left")
        cold = hot.where("_digest is null").drop("_digest", "last", "n").join(found.where(F.col("n") <= edge), F.col("digest") == F.col("_digest"), "left")
        joined = hot.where("_digest is not null").unionByName(cold)
    older = F.col("page_id").isNull() | (F.col("page_id") < F.col("last.page_id"))
    refers = lambda name: F.when(older, F.col("last")[name])
    return joined.select(*rows.columns, refers("page_id").alias("refers_to"), refers("url").alias("refers_url"))


def _sharded(rows: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """Rows dealt out by shard and sorted within it, and the number of shards.

    Keys alone are range-sorted and numbered; rows find their shard among the first keys.
    """
    seats = numbered(rows.select("key"), "key")
    first = [r.key for r in seats.where(F.col("row") % shard_rows == 0).select("key").orderBy("key").collect()]
    firsts = np.array(first[1:], dtype="S56")

    @F.pandas_udf("int")
    def shard(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(firsts, key.to_numpy().astype("S56"), "right").astype(np.int32))

    dealt = rows.withColumn("shard", shard("key")).repartitionById(max(1, len(first)), F.col("shard"))
    return dealt.sortWithinPartitions("shard", "key", F.col("url").asc_nulls_first()), len(first)


def _uri(page: int | None, url: str | None) -> str:
    """The record's target; blanks and control characters of a url are escaped, a null one is named after its page."""
    if url is None:
        return f"urn:page:{'' if page is None else page}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _record_id(page: int | None, url: str | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, json.dumps([page, url, digest, copy]))}>"


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", _base32(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, date: str, copy: int = 0) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page, url, digest, copy)), ("WARC-Date", date), ("WARC-Target-URI", _uri(page, url))]
    fields += [("WARC-Payload-Digest", _base32(bytes.fromhex(digest))), ("Content-Type", "application/http; msgtype=response")]
    if page is not None:
        fields.append(("Page-ID", str(page)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, refers_url, digest)), ("WARC-Refers-To-Target-URI", _uri(refers_to, refers_url)), ("WARC-Refers-To-Date", date), ("Refers-To-Page-ID", str(refers_to))]
    return _record(fields, http + payload if refers_to is None else http)


def info_record(name: str, date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return _record(fields, block)


class _Out:
    """One file under a temporary name of its own."""

    def __init__(self, folder: str, shard: int, seq: int, date: str, level: int):
        self.shard, self.seq, self.level = shard, seq, level
        self.file = f"shard-{shard:06d}-{seq:04d}.warc.gz"
        self.temporary = f"{folder}/{self.file}.{uuid.uuid4().hex}"
        store, path = _files.opened(self.temporary)
        self.stream, self.hash, self.bytes, self.records, self.responses = store.open_output_stream(path, compression=None), hashlib.sha256(), 0, 0, 0
        self.add(info_record(self.file, date), False)
        self.records = 0

    def add(self, record: bytes, response: bool) -> None:
        squeeze = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = squeeze.compress(record) + squeeze.flush()
        self.stream.write(member)
        self.hash.update(member)
        self.bytes += len(member)
        self.records += 1
        self.responses += response

    def row(self) -> tuple:
        self.stream.close()
        return (self.shard, self.seq, self.file, self.temporary, self.records, self.responses, self.bytes, self.hash.hexdigest())


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split(" ") for f in FILES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _writer(folder: str, roll_bytes: int, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: _Out | None = None
        before, copy = None, 0
        for batch in batches:
            columns = [batch[c] for c in ("shard", "page_id", "url", "payload", "digest", "refers_to", "refers_url")]
            for i in range(batch.num_rows):
                shard, page, url, payload, digest, to, to_url = (c[i].as_py() for c in columns)
                copy = copy + 1 if before == (page, url, digest) else 0
                before = (page, url, digest)
                if out is not None and (out.shard != shard or out.bytes >= roll_bytes):
                    yield _listed([out.row()])
                    out = _Out(folder, shard, out.seq + 1 if out.shard == shard else 0, date, level)
                elif out is None:
                    out = _Out(folder, shard, 0, date, level)
                out.add(page_record(page, url, payload, digest, to, to_url, date, copy), to is None)
        if out is not None:
            yield _listed([out.row()])

    return run


def _mover(folder: str):
    """Files get their final names; one that a lost attempt has moved already is left where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, temporary, n in zip(batch["file"].to_pylist(), batch["temporary"].to_pylist(), batch["bytes"].to_pylist(), strict=True):
                target = f"{folder}/{name}"
                try:
                    _files.move(temporary, target)
                except OSError:
                    if _files.size(target) != n:
                        raise
            yield batch

    return run


def write(pages: DataFrame, path: str, shard_rows: int = 65_536, roll_bytes: int = 1 << 30, revisit_from: int = 1000, date: str = "1970-01-01T00:00:00Z", level: int = 6, most_broadcast: int = BROADCAST_DIGESTS) -> DataFrame:
    """Archive pages (page_id, url, html) under ``path``, a folder that all machines share; returns its manifest.

    Records are in the order of page_id (null first), payload digest and url, ``shard_rows`` to a shard; a file that has
    reached ``roll_bytes`` compressed is followed by another. Of records with equal payloads of at least
    ``revisit_from`` bytes, those of the largest page_id are responses and the others revisit them (if none has a
    page_id, all are responses). A null html is an empty payload; a null url is kept as such; rows that repeat a page_id stay in
    one shard, and those equal in all three columns get a record each. No pages give an archive without files. Further columns are not written.
    A folder that holds an archive already is an error. Equal pages give equal files, byte for byte.
    """
    spark = pages.sparkSession
    ship(spark)
    if _files.exists(f"{path}/MANIFEST.json"):
        raise FileExistsError(f"{path} holds an archive")
    job = f"{path}/_temporary/{uuid.uuid4().hex}"
    _files.make(f"{job}/files")
    rows = _rows(pages)
    dealt, _ = _sharded(with_responses(rows, revisit_from, most_broadcast).select("key", "page_id", "url", "payload", "digest", "refers_to", "refers_url"), shard_rows)
    dealt.select("shard", "page_id", "url", "payload", "digest", "refers_to", "refers_url").mapInArrow(_writer(f"{job}/files", roll_bytes, date, level), FILES).write.parquet(f"{job}/written")
    written = spark.read.parquet(f"{job}/written")
    written.mapInArrow(_mover(path), FILES).drop("temporary").write.mode("overwrite").parquet(f"{path}/manifest")
    _files.drop(f"{path}/_temporary")
    listed = spark.read.parquet(f"{path}/manifest")
    total = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    _files.write(f"{path}/MANIFEST.json", json.dumps({"files": total[0], "records": total[1], "bytes": total[2]}).encode())
    return listed


def _line(f: io.BufferedIOBase, name: str) -> bytes:
    line = f.readline()
    if not line.endswith(b"\n"):
        raise ValueError(f"{name}: a record breaks off")
    return line.rstrip(b"\r\n")


def records(f: io.BufferedIOBase, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of an unpacked archive; records that break off or differ from their block digest are errors."""
    while True:
        line = f.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no record where one should begin")
        fields = {}
        while held := _line(f, name):
            k, _, v = held.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        n = int(fields["content-length"])
        block = f.read(n)
        if len(block) != n:
            raise ValueError(f"{name}: a record breaks off")
        want = fields.get("warc-block-digest")
        if want and want.startswith("sha1:") and want != _base32(hashlib.sha1(block).digest()):
            raise ValueError(f"{name}: {fields.get('warc-record-id')} differs from its block digest")
        yield fields, block


def _payload(fields: dict[str, str], block: bytes) -> tuple[bytes, int, str | None]:
    """(payload, its full length, its SHA-1 in hex): a revisit's length and digest are those of its head."""
    if not fields.get("content-type", "").startswith("application/http"):
        return block, len(block), hashlib.sha1(block).hexdigest()
    head, _, payload = block.partition(b"\r\n\r\n")
    said = fields.get("warc-payload-digest", "")
    if fields["warc-type"] == "revisit":
        length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
        return b"", length, base64.b32decode(said[5:]).hex() if said.startswith("sha1:") else None
    digest = hashlib.sha1(payload).digest()
    if said.startswith("sha1:") and said != _base32(digest):
        raise ValueError(f"{fields.get('warc-record-id')} differs from its payload digest")
    return payload, len(payload), digest.hex()


def _reader(folder: str, with_payload: bool):
    fields_of = [f.split(" ") for f in RECORDS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields_of)], names=[n for n, _ in fields_of])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for name, n, size in zip(files["file"].to_pylist(), files["records"].to_pylist(), files["bytes"].to_pylist(), strict=True):
                store, path = _files.opened(f"{folder}/{name}")
                if size is not None and _files.size(f"{folder}/{name}") != size:
                    raise ValueError(f"{name}: not the {size} bytes of the manifest")
                rows, held, seen = [], 0, 0
                with store.open_input_stream(path, compression=None) as raw, gzip.open(raw) as f:
                    for fields, block in records(f, name):
                        if fields["warc-type"] == "warcinfo":
                            continue
                        seen += 1
                        payload, length, digest = _payload(fields, block)
                        page, to, url = fields.get("page-id"), fields.get("refers-to-page-id"), fields.get("warc-target-uri")
                        url = None if url and url.startswith("urn:page:") else url
                        rows.append((name, fields.get("warc-record-id"), fields["warc-type"], page and int(page), url, fields.get("warc-date"), payload if with_payload else None, length, digest, to and int(to), fields.get("warc-refers-to")))
                        held += len(payload) * with_payload + 512
                        if held >= READ_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                if n is not None and seen != n:
                    raise ValueError(f"{name}: {seen} records, not the {n} of the manifest")
                if rows:
                    yield batch(rows)

    return run


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of an archive, a file to a task, streamed; see RECORDS for columns.

    Block and payload digests, sizes and counts are compared with what headers and manifest say; differences are
    errors, as is an archive that was not finished. Revisits have no payload, and length and digest of the full one.
    """
    ship(spark)
    if not _files.exists(f"{path}/MANIFEST.json"):
        raise FileNotFoundError(f"{path}: no archive, or one that was not finished")
    said = json.loads(_files.read(f"{path}/MANIFEST.json"))
    files = spark.read.parquet(f"{path}/manifest").select("file", "records", "bytes")
    total = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if tuple(total) != (said["files"], said["records"], said["bytes"]):
        raise ValueError(f"{path}: the manifest is not the one that was committed")
    # a row a file: numbering them deals each to a task of its own
    place = F.row_number().over(W.orderBy("file")) - 1
    dealt = files.withColumn("place", place).repartitionById(max(1, said["files"]), F.col("place").cast("int")).drop("place")
    return dealt.mapInArrow(_reader(path, with_payload), RECORDS)


def dangling(found: DataFrame) -> DataFrame:
    """(refers_to_id, payload_sha1, payload_bytes) of revisits whose response is absent or has another payload."""
    responses = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), "payload_sha1", "payload_bytes")
    asked = found.where("record_type = 'revisit'").select("refers_to_id", "payload_sha1", "payload_bytes").distinct()
    # a row a response is no small side, though the manifest that it comes from is a small table
    return asked.join(responses.hint("merge"), ["refers_to_id", "payload_sha1", "payload_bytes"], "left_anti")


def round_trip(pages: DataFrame, shard_rows: int = 65_536, roll_bytes: int = 1 << 30, revisit_from: int = 1000) -> DataFrame:
    """Write an archive into the shared folder, read it back, check it, and remove it: the records without payloads."""
    path = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    try:
        write(pages, path, shard_rows, roll_bytes, revisit_from)
        found = checkpointed(read(pages.sparkSession, path, with_payload=False).drop("payload"))
    finally:
        _files.drop(path)
    if not dangling(found).isEmpty():
        raise ValueError("a revisit has no response")
    return found


#: DuckDB form of the query; {pages} names the table.
SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM {pages}
), d AS (
  SELECT page_id, payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND last IS NOT NULL AND (page_id IS NULL OR page_id < last) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND last IS NOT NULL AND (page_id IS NULL OR page_id < last) THEN last END AS refers_to
FROM d
"""
