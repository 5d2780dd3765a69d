"""WARC archives: a deterministic sharded writer and its reader.

Of records with equal payloads of at least ``least_revisit`` bytes, the one with the largest id holds
the payload, the others are revisit records that refer to it. Records are range-sorted by id, then by digest and
address, into shards of even size whose borders follow from exact sums, not from a sample; each shard rolls to a new
file once its compressed size passes ``roll_bytes``. Headers and digests are made anew for every record, a gzip
member each; a file begins with a warcinfo record. A file is written under a temporary name and renamed when whole; the
manifest, written last, names the files that count, with their sizes and digests. The same rows give the same files,
however they are dealt over tasks, so that a task run twice does no harm.

Files go through pyarrow's file systems (local and mounted folders, HDFS, object stores) by the URI of
the folder, which must be shared by driver and executors.

Cases: null html is an empty payload; null url a urn; a null id sorts first, is never referred to and is
always a response; repeated rows are a record each, with record ids of their own (rows alike in id, payload and address
that make more than a shard are dealt over several by number), and of equal records with the largest id all are
responses; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import discard, remove, stored
from .ranges import Parts, even_parts, id_key

_CRLF = b"\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


#: Bytes that a record's headers take, about.
_HEAD = 512


def record_keys(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """pages with page_id, url, payload, digest and the sort key of its record."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    out = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    out = out.withColumn("digest", F.sha1("payload"))
    return out.withColumn("key", F.concat(id_key("page_id"), "digest", F.md5(F.coalesce("url", F.lit("")))))


def revisits(records: DataFrame, least_revisit: int = 1000) -> DataFrame:
    """key, weight, copies of every record, and refers_to, refers_url of those that only refer to another. No payload moves."""
    narrow = records.select("key", "page_id", "url", "digest", F.octet_length("payload").alias("size"))
    keys = stored(narrow.groupBy("key").agg(*(F.first(c).alias(c) for c in ("page_id", "url", "digest", "size")), F.count("*").alias("copies")), "records")
    named = keys.filter("page_id is not null").filter(F.col("size") >= least_revisit)
    best = named.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("best"), F.min("page_id").alias("least"))
    best = stored(best.filter("least < best.page_id").select("digest", "best"), "digests")  # right after the aggregation the join could not be split at a digest with many records
    met = named.join(best, "digest").filter("page_id < best.page_id").select("key", F.col("best.page_id").alias("refers_to"), F.col("best.url").alias("refers_url"))
    out = stored(keys.join(met, "key", "left").select("key", (F.col("size") + _HEAD).alias("weight"), "copies", "refers_to", "refers_url"), "noted")
    discard(keys, best)
    return out


def _digest(data: bytes) -> bytes:
    return b"sha1:" + base64.b32encode(hashlib.sha1(data).digest())


def _record_id(page_id: int | None, url: str | None, digest: bytes, copy: int = 0) -> bytes:
    named = f"{'null' if page_id is None else page_id}\n{url or ''}\n{digest.decode()}\n{copy or ''}"
    return b"<urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, named)).encode() + b">"


def _target(page_id: int | None, url: str | None) -> bytes:
    return (url or f"urn:page:{'null' if page_id is None else page_id}").replace("\r", "").replace("\n", "").encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, refers_url: str | None = None, copy: int = 0) -> bytes:
    """One record, not yet compressed. copy: its number among equal ones."""
    http = _HTTP % len(payload)
    block = http if refers_to is not None else http + payload
    digest = _digest(payload)
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: " + _record_id(page_id, url, digest, copy),
        b"WARC-Target-URI: " + _target(page_id, url),
        b"WARC-Date: " + date.encode(),
        b"WARC-Page-ID: " + (b"null" if page_id is None else b"%d" % page_id),
        b"WARC-Payload-Digest: " + digest,
        b"WARC-Payload-Length: %d" % len(payload),
        b"WARC-Block-Digest: " + _digest(block),
    ]
    if refers_to is not None:
        head += [
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            b"WARC-Refers-To: " + _record_id(refers_to, refers_url, digest),
            b"WARC-Refers-To-Target-URI: " + _target(refers_to, refers_url),
            b"WARC-Refers-To-Date: " + date.encode(),
            b"WARC-Refers-To-Page-ID: %d" % refers_to,
        ]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return _CRLF.join(head) + _CRLF * 2 + block + _CRLF * 2


def _file_info(name: str, date: str) -> bytes:
    """The record that begins a file."""
    block = b"software: tallow\r\nformat: WARC File Format 1.1\r\n"
    head = [b"WARC/1.1", b"WARC-Type: warcinfo", b"WARC-Record-ID: " + _record_id(None, name, b""), b"WARC-Date: " + date.encode(), b"WARC-Filename: " + name.encode(), b"WARC-Block-Digest: " + _digest(block), b"Content-Type: application/warc-fields", b"Content-Length: %d" % len(block)]
    return _CRLF.join(head) + _CRLF * 2 + block + _CRLF * 2


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Shard:
    """The files of one shard: each under a temporary name until it is whole."""

    def __init__(self, base: str, shard: int, roll_bytes: int, date: str):
        self.fs, self.root = pafs.FileSystem.from_uri(base)
        self.shard, self.roll_bytes, self.date, self.n, self.out = shard, roll_bytes, date, 0, None
        self.attempt = TaskContext.get().taskAttemptId()
        self.done: list[dict] = []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha1.update(data)
        self.size += len(data)

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.n:04d}.warc.gz"
            self.temporary = f"{self.root}/_temporary/{self.attempt}-{self.name}"
            self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
            self.out, self.sha1, self.size, self.records, self.first = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha1(), 0, 0, page_id
            self._write(_gzip(_file_info(self.name, self.date)))
        self._write(_gzip(data))
        self.records, self.last = self.records + 1, page_id
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        final = f"{self.root}/{self.name}"
        if self.fs.get_file_info(final).type == pafs.FileType.NotFound:
            self.fs.move(self.temporary, final)
        else:
            self.fs.delete_file(self.temporary)  # another attempt of this task was there before; its file is the same
        self.out, self.n = None, self.n + 1
        self.done.append({"file": self.name, "records": self.records, "bytes": self.size, "sha1": self.sha1.hexdigest(), "first_id": self.first, "last_id": self.last})


_MANIFEST = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())])
_SENT = "part bigint, key string, kind int, page_id bigint, url string, payload binary, refers_to bigint, refers_url string, copy bigint, copies bigint"


def _sender(parts):
    """Rows (as in _SENT) of records and notes, each to its shard; keys that lie in several shards are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Parts = parts.value
        for batch in batches:
            keys = batch.column("key").to_pylist()
            if keys and p.pieces:
                batch = batch.take(pa.array([i for i, k in enumerate(keys) if k not in p.pieces], pa.int64()))
                keys = batch.column("key").to_pylist()
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(p.number[p.of(keys)], pa.int64()), *batch.columns], ["part", *batch.schema.names])

    return run


def _dealt(records: DataFrame, noted: DataFrame, parts: Parts) -> DataFrame:
    """All rows of _SENT: records, before them what is noted on revisits, so that payloads are shuffled once."""
    shared = records.sparkSession.sparkContext.broadcast(parts)
    none = lambda kind: F.lit(None).cast(kind)
    one = [F.lit(0).cast("bigint").alias("copy"), F.lit(1).cast("bigint").alias("copies")]
    whole = records.select("key", F.lit(1).alias("kind"), "page_id", "url", "payload", none("bigint").alias("refers_to"), none("string").alias("refers_url"), *one)
    notes = noted.filter("refers_to is not null").select("key", F.lit(0).alias("kind"), none("bigint").alias("page_id"), none("string").alias("url"), none("binary").alias("payload"), "refers_to", "refers_url", *one)
    sent = whole.unionByName(notes).mapInArrow(_sender(shared), _SENT)
    if parts.pieces:
        listed = records.sparkSession.createDataFrame([(k, *piece) for k, pieces in parts.pieces.items() for piece in pieces], "key string, part bigint, copy bigint, copies bigint")
        wanted = F.broadcast(listed.select("key").distinct())  # of most_parts keys at most
        once = records.join(wanted, "key").groupBy("key").agg(*(F.first(c).alias(c) for c in ("page_id", "url", "payload")))
        once = once.join(noted.join(wanted, "key").select("key", "refers_to", "refers_url"), "key").join(F.broadcast(listed), "key").withColumn("kind", F.lit(1))
        sent = sent.unionByName(once.select(*sent.columns))
    return sent.repartitionById(parts.n, F.col("part").cast("int")).sortWithinPartitions("part", "key", "kind")


def write(pages: DataFrame, base: str, key: str = "page_id", url: str = "url", html: str = "html", least_revisit: int = 1000, shard_bytes: int = 32 << 20, roll_bytes: int = 16 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes an archive below the folder `base` and returns its manifest. shard_bytes: a shard's records before
    compression; beyond 65,536 shards they grow."""
    spark = pages.sparkSession
    ship(spark)
    records = record_keys(pages, key, url, html)
    noted = revisits(records, least_revisit)
    rows = _dealt(records, noted, even_parts(noted, shard_bytes))

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last, number, note = None, None, 0, (None, None)
        for batch in batches:
            columns = [batch.column(c) for c in ("part", "key", "kind", "page_id", "url", "payload", "refers_to", "refers_url", "copy", "copies")]
            for i in range(batch.num_rows):
                part, own, kind, page_id, address, payload, refers_to, refers_url, copy, copies = (c[i].as_py() for c in columns)
                if shard is None or shard.shard != part:
                    if shard is not None:
                        shard.close()
                        yield pa.RecordBatch.from_pylist(shard.done, _MANIFEST)
                    shard, last = _Shard(base, part, roll_bytes, date), None
                if own != last:
                    last, number, note = own, copy, (refers_to, refers_url)
                if kind:
                    for _ in range(copies):
                        shard.add(page_id, record(page_id, address, payload, note[0], date, note[1], number))
                        number += 1
        if shard is not None:
            shard.close()
            yield pa.RecordBatch.from_pylist(shard.done, _MANIFEST)

    made = rows.mapInArrow(archived, "file string, records bigint, bytes bigint, sha1 string, first_id bigint, last_id bigint")
    made.write.parquet(f"{base}/manifest")
    remove(spark, f"{base}/_temporary")  # what failed attempts left
    discard(noted)
    return spark.read.parquet(f"{base}/manifest")


def records(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file, member by member."""
    held, z, out = b"", zlib.decompressobj(31), []
    while True:
        if not held and not (held := stream.read(chunk)):
            if out and any(out):
                raise ValueError("archive cut short")
            return
        out.append(z.decompress(held))
        held = z.unused_data if z.eof else b""
        if z.eof:
            yield _parsed(b"".join(out))
            z, out = zlib.decompressobj(31), []


def _parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(_CRLF * 2)
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != _CRLF * 2 or headers.get("warc-block-digest", "").encode() not in (b"", _digest(block)):
        raise ValueError("damaged record " + headers.get("warc-record-id", ""))
    return headers, block


def read(spark: SparkSession, base: str) -> DataFrame:
    """A row a record of the files in the manifest: page_id, url, record_type, refers_to, payload (null for
    revisits), payload_bytes and payload_digest (of the payload itself where it is there, else as recorded)."""
    ship(spark)
    files = spark.read.parquet(f"{base}/manifest").select("file", "bytes", "sha1")
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload binary, payload_bytes bigint, payload_digest string"
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for headers, block in records(stream):
                        if headers["warc-type"] not in ("response", "revisit"):
                            continue
                        revisit = headers["warc-type"] == "revisit"
                        payload = None if revisit else block.partition(_CRLF * 2)[2]
                        recorded = headers["warc-payload-digest"].removeprefix("sha1:")
                        if payload is not None and _digest(payload) != b"sha1:" + recorded.encode():
                            raise ValueError(f"payload differs from its digest in {name}")
                        page, target = headers["warc-page-id"], headers.get("warc-refers-to-page-id")
                        rows.append({
                            "page_id": None if page == "null" else int(page), "url": headers["warc-target-uri"], "record_type": headers["warc-type"], "refers_to": int(target) if target else None,
                            "payload": payload, "payload_bytes": int(headers["warc-payload-length"]) if revisit else len(payload), "payload_digest": base64.b32decode(recorded).hex() if revisit else hashlib.sha1(payload).hexdigest(),
                        })
                        size += len(block)
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kind)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    n = max(1, files.count())
    return files.repartition(n).mapInArrow(restored, schema)
