"""Deterministic sharded WARC writer, and its reader.

Records are range-sorted by page_id.  The bounds of the shards come from a sample of ids picked by their hash, so they
depend on the data alone.  Each shard's task streams its sorted records into files, one gzip member per record, rolls a
file when its compressed size is reached, and renames it from a temporary name when it is whole; the same task run
again makes the same bytes under the same name.  A manifest table lists the files, and readers open those only.

Of equal payloads one record is the response and the others are revisits of it.  That is decided on ids and digests
alone, and the verdicts travel to the shards as rows of their own that sort next to their pages, so payloads are
read twice (for the digests, and to be written), shuffled once and never joined.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.shared import file_system, settle

_NAMES = uuid.UUID("7d1c3f0e-5a54-4c8e-9b1b-0c6d2f1f8a11")
#: Fixed: the profile of a revisit of an equal payload.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SAMPLES = 64
#: Archives are read in as many tasks as there are shards, up to these; a task holds a record at a time.
_MOST_TASKS = 20_000
_MANIFEST = "file string, shard int, roll int, records bigint, bytes bigint, sha1 string, first_id bigint, last_id bigint"
_RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string"


def digests(pages: DataFrame, html: str = "html", page_id: str = "page_id") -> DataFrame:
    """(page_id, digest, n): SHA-1 and bytes of every payload."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    return pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("bigint").alias("n"))


def revisits(digested: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(page_id, digest, target) of ``digests``: pages whose payload a page with a larger id has too.

    Groups of equal payloads are counted before the shuffle; joins carry ids and digests only, and a digest that very
    many pages have is split by adaptive execution.
    """
    large = digested.where(F.col("n") >= least_bytes).select("page_id", "digest")
    same = large.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("target")).where("copies > 1").select("digest", "target")
    return large.join(same, "digest").where("page_id <> target").select("page_id", "digest", "target").distinct()


def _bounds(digested: DataFrame, rows: int, shards: int) -> list[int]:
    """Ids at which shards begin, from at most a few hundred sampled ids a shard."""
    every = max(1, rows // (_SAMPLES * shards))
    keys = np.sort(digested.where("page_id IS NOT NULL").select("page_id").where(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0).toArrow().column("page_id").to_numpy())
    at = (np.arange(1, shards) * len(keys)) // shards
    return sorted({int(k) for k in keys[at]}) if len(keys) else []


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("WARC-Block-Digest", _digest(block)), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(page: int | None, hexdigest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page}:{hexdigest}' + (f':{copy}' if copy else ''))}>"


def page_record(page: int | None, url: str | None, payload: bytes, target: int | None, date: str, copy: int = 0) -> bytes:
    """The bytes of a page's record before compression: a revisit if there is a target, else a response.

    ``copy`` counts rows of one page_id and payload, whose records have ids of their own; a revisit refers to the first.
    """
    hexdigest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", _id(page, hexdigest, copy)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    fields += [("WARC-Payload-Digest", _digest(payload)), ("Content-Type", "application/http; msgtype=response")]
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    if target is None:
        return _record("response", fields, http + payload)
    fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _id(target, hexdigest)), ("X-Refers-To-Page-Id", str(target))]
    return _record("revisit", fields, http)


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Roller:
    """Writes members to files of one shard under temporary names."""

    def __init__(self, folder: str, shard: int, attempt: str, roll_bytes: int, date: str):
        self.system, self.at = file_system(folder)
        self.shard, self.attempt, self.roll_bytes, self.date, self.roll, self.out = shard, attempt, roll_bytes, date, 0, None

    def add(self, page: int | None, data: bytes) -> list | None:
        if self.out is None:
            self.name = f"shard-{self.shard:05d}-{self.roll:05d}.warc.gz"
            self.temporary = f"{self.at}/_temporary-{self.attempt}-{self.name}"
            self.out, self.sha1, self.size, self.records, self.first = self.system.open_output_stream(self.temporary, compression=None), hashlib.sha1(), 0, 0, page
            about = b"software: clausewright\r\nformat: WARC File Format 1.1\r\n"
            self._put(_member(_record("warcinfo", [("WARC-Record-ID", _id(None, self.name)), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], about)))
        self._put(_member(data))
        self.records, self.last = self.records + 1, page
        return self.close() if self.size >= self.roll_bytes else None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha1.update(data)
        self.size += len(data)

    def close(self) -> list | None:
        """The manifest's row of the open file, which gets its name."""
        if self.out is None:
            return None
        self.out.close()
        self.system.move(self.temporary, f"{self.at}/{self.name}")
        row = [self.name, self.shard, self.roll, self.records, self.size, self.sha1.hexdigest(), self.first, self.last]
        self.out, self.roll = None, self.roll + 1
        return row


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 1000, shard_bytes: int = 16 << 20, roll_bytes: int = 64 << 20, most_shards: int = 20_000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes ``pages`` into ``folder`` and returns the manifest.

    Null html is an empty payload, a null url leaves out the target URI, a null page_id sorts first and is a response.
    Rows with the same id and payload are written each, as records of the same kind.  No rows give an empty manifest.
    Extra columns are ignored, whatever their names.
    A shard is sorted on disk and streamed, so its size isn't bound to memory: there is one for ``shard_bytes`` of html
    up to ``most_shards``, as many as a shuffle can have without its own bookkeeping becoming the load, and with more
    html than that shards are larger and have more files, each of ``roll_bytes``.
    """
    spark = pages.sparkSession
    digested = settle(digests(pages, html, page_id))
    rows, size = digested.agg(F.count("page_id"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bounds = _bounds(digested, rows, int(min(most_shards, max(1, -(-size // shard_bytes)))))
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.sha1(F.encode(payload, "UTF-8")).alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("target"), F.col(url).alias("url"), payload.alias("html"))
    flags = revisits(digested, least_bytes).select("page_id", "digest", F.lit(0).alias("kind"), "target", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    both = rows.unionByName(flags)
    edges = np.array(bounds, np.int64)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("page_id").fill_null(-(2**63)).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.searchsorted(edges, keys, side="right").astype(np.int32))], names=[*b.schema.names, "shard"])

    dealt = both.mapInArrow(deal, "page_id bigint, digest string, kind int, target bigint, url string, html string, shard int")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(F.asc_nulls_first("page_id"), "digest", "kind", "url")
    system, at = file_system(folder)
    system.create_dir(at, recursive=True)

    def save(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, roller, verdict, done = uuid.uuid4().hex[:12], None, (None, None, None), []
        last, copy = None, 0
        for b in batches:
            for page, digest, kind, target, address, text, shard in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 0:
                    verdict = (page, digest, target)
                    continue
                if roller is None:
                    roller = _Roller(folder, shard, attempt, roll_bytes, date)
                to = verdict[2] if verdict[:2] == (page, digest) else None
                copy = copy + 1 if last == (page, digest) else 0
                last = (page, digest)
                if row := roller.add(page, page_record(page, address, text.encode(), to, date, copy)):
                    done.append(row)
        if roller and (row := roller.close()):
            done.append(row)
        if done:
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _MANIFEST.split(", ")])

    dealt.mapInArrow(save, _MANIFEST).write.parquet(f"{folder}/manifest")
    for left in system.get_file_info(fs.FileSelector(at)):  # what attempts that failed began
        if left.base_name.startswith("_temporary-"):
            system.delete_file(left.path)
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, each whole."""
    z, parts, rest = zlib.decompressobj(31), [], stream.read(size)
    while rest:
        parts.append(z.decompress(rest))
        rest = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
        rest = rest or stream.read(size)
    if any(parts):
        raise ValueError("the archive ends within a record")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, whose length and digest are checked."""
    head, _, body = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = body[: int(fields["Content-Length"])]
    if not lines[0].startswith("WARC/") or body[len(block) :] != b"\r\n\r\n" or _digest(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    return fields, block


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row per page record of the files in the manifest; a payload that doesn't fit its digest is an error."""

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _RECORD.split(", ")])

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = file_system(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with system.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    rows = []
                    for record in members(stream):
                        fields, block = parse(record)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(http.decode().rpartition("Content-Length: ")[2])
                        if fields["WARC-Type"] == "response" and (len(payload) != n or _digest(payload) != fields["WARC-Payload-Digest"]):
                            raise ValueError(f"broken payload in {name}")
                        page, to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].partition(":")[2]).hex()
                        rows.append((page and int(page), n, digest, fields["WARC-Type"], to and int(to), name))
                        if len(rows) == 10_000:
                            yield as_batch(rows)
                            rows = []
                    if rows:
                        yield as_batch(rows)

    files = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").select("shard", "file")
    tasks = min(_MOST_TASKS, (files.agg(F.max("shard")).first()[0] or 0) + 1)
    return files.repartitionById(tasks, F.pmod("shard", F.lit(tasks))).select("file").mapInArrow(load, _RECORD)
