"""Web archives: a sharded writer whose files do not depend on the cluster, and their reader.

Records are put in the order of their page_id and dealt into shards by bounds that a sample of the page_ids gives; the sample is the rows
of smallest hash, so it is the same wherever the job runs. A shard is one task: it sorts its records, makes their headers and digests anew
and appends each as a gzip member of its own to a file, which it closes for the next when its compressed size is reached. Files are written
under a name of the attempt. What an attempt returns goes to a manifest; a second job renames the files that the manifest names, and only
then is the manifest itself put in its place. Readers open nothing but what a manifest in place names, so a failed or repeated task leaves
no trace in an archive.

Of pages with equal payloads one is a response and the others are revisits of it, without a payload of their own. Who revisits whom is decided
on digests alone; that decision meets the page in the sort that orders the records, so payloads are shuffled once.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import pick
from .scratch import Scratch, small_batches

#: Payload bytes of a shard, and compressed bytes after which a file is closed.
SHARD_BYTES, ROLL_BYTES = 64 << 20, 16 << 20
#: page_ids in the sample for each shard, and at most.
SAMPLE, MOST = 64, 1_000_000
#: Bytes of payloads that the reader puts into one batch, and bytes that it asks a file for at once.
BATCH_BYTES, BLOCK = 4 << 20, 1 << 20
_MANIFEST = "file string, temporary string, records long, bytes long, sha256 string"
_RECORD = "page_id {0}, url string, record_type string, payload_bytes long, payload_digest string, refers_to {0}, payload binary"
_EMPTY_SHA1 = hashlib.sha1(b"").digest()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass(frozen=True)
class Page:
    """What a record says of its page. ``revisits`` and ``first`` say whether it revisits another page, and which."""

    page_id: int | str | None
    url: str | None
    payload: bytes
    revisits: bool = False
    first: int | str | None = None

    def identity(self, page_id) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{base32_sha1(self.payload)}')}>"

    def target(self) -> str:
        """The page's address with whatever cannot stand in a header escaped; pages without one have a name instead."""
        return quote(self.url, safe="!#$%&'()*+,/:;=?@[]~-._") if self.url else f"urn:page:{self.page_id}"

    def record(self, date: str) -> bytes:
        digest = base32_sha1(self.payload)
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(self.payload)}\r\n\r\n".encode()
        block = head if self.revisits else head + self.payload
        lines = ["WARC/1.1", f"WARC-Type: {'revisit' if self.revisits else 'response'}", f"WARC-Record-ID: {self.identity(self.page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {self.target()}"]
        if self.page_id is not None:
            lines.append(f"X-Page-ID: {quote(str(self.page_id), safe='')}")
        if self.url is not None:
            lines.append(f"X-Page-URL: {quote(self.url, safe='')}")
        if self.revisits:
            lines += [f"WARC-Refers-To: {self.identity(self.first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
            if self.first is not None:
                lines.append(f"X-Refers-To-Page-ID: {quote(str(self.first), safe='')}")
        lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(body: bytes) -> bytes:
    """The body as a gzip member that has no time and no name, so that equal bodies give equal bytes."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = bytearray(c.compress(body) + c.flush())
    out[4:10] = b"\0\0\0\0\0\xff"
    return bytes(out)


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    found, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return found, path


class _Files:
    """A shard's files, each closed when ``roll`` compressed bytes are in it."""

    def __init__(self, root: str, shard: int, roll: int):
        self.root, self.shard, self.roll, self.n, self.out = root, shard, roll, 0, None
        self.done: list[tuple] = []
        self.attempt = uuid.uuid4().hex

    def add(self, member: bytes) -> None:
        if self.out is None:
            store, path = _store(self.root)
            self.name, self.temporary = f"part-{self.shard:06d}-{self.n:05d}.warc.gz", f"_temporary/{self.attempt}-{self.shard:06d}-{self.n:05d}"
            store.create_dir(f"{path}/_temporary", recursive=True)
            self.out, self.bytes, self.records, self.sum = store.open_output_stream(f"{path}/{self.temporary}", compression=None), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.sum.update(member)
        self.bytes += len(member)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self.done.append((self.name, self.temporary, self.records, self.bytes, self.sum.hexdigest()))
            self.n += 1

    def batch(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], ["file", "temporary", "records", "bytes", "sha256"])


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, sha, first): the pages, each once, whose payload another page with a smaller page_id has too."""
    seen = pages.where(F.col("_size") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    slim = pages.where(F.col("_size") >= least_bytes).select("page_id", "sha").distinct()
    return slim.join(seen.select("sha", "first").hint("merge"), "sha").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "sha", "first")


def _bounds(pages: DataFrame, shard_bytes: int) -> list:
    """page_ids at which a new shard begins. They depend on the rows alone: the sample is those of smallest hash of page_id and payload."""
    total = pages.agg(F.sum("_size")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    if shards == 1:
        return []
    size = min(MOST, SAMPLE * shards)
    sample = pages.where("page_id IS NOT NULL").orderBy(F.xxhash64("page_id", "sha"), "page_id", "sha").limit(size).select("page_id", "_size").collect()
    sample.sort(key=lambda r: r[0])
    sums = np.cumsum([r[1] for r in sample])
    cuts = np.searchsorted(sums, sums[-1] * np.arange(1, shards) / shards) if len(sums) else []
    return sorted({sample[min(int(c) + 1, len(sample) - 1)][0] for c in cuts})


def write_warc(pages: DataFrame, root: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) to an archive below ``root``, and return its manifest.

    The payload is the html in UTF-8, null is empty. Of pages with equal payloads of at least ``least_bytes`` bytes the one with the smallest
    page_id is a response and the others revisit it; rows that repeat that page_id are responses as well. Pages without a page_id come
    first; they revisit others, and are responses where none of their payload has a page_id. Null addresses are replaced by a name made of
    the page_id, and characters that headers cannot hold are escaped. Other columns are not read. Empty tables give an empty archive.
    The same pages give the same files, byte by byte. A root that holds a manifest is refused.
    """
    spark = small_batches(pages.sparkSession)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = lambda name: jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    store = place("x").getFileSystem(conf)
    if store.exists(place("manifest")):
        raise FileExistsError(f"{root} holds an archive")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pick(pages, "page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    rows = rows.select("page_id", "url", body.alias("body"), F.sha2(body, 256).alias("sha"), F.octet_length(body).cast("long").alias("_size"))
    scratch = Scratch(spark)
    slim = scratch.write("slim", rows.select("page_id", "sha", "_size"))
    again = scratch.write("again", revisits(slim, least_bytes))
    bounds = _bounds(slim, shard_bytes)

    @F.udf("int", useArrow=True)
    def shard_of(page_id):
        import bisect

        return 0 if page_id is None else bisect.bisect_right(bounds, page_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, decided = None, None
        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                shard, page_id, sha, is_page, first, url, payload = (c[i].as_py() for c in cols)
                if files is None or files.shard != shard:
                    if files is not None:
                        files.close()
                        yield files.batch()
                    files = _Files(root, shard, roll_bytes)
                if not is_page:  # stands before the pages that it is about
                    decided = (page_id, sha, first)
                    continue
                known = decided is not None and decided[:2] == (page_id, sha)
                files.add(gzip_member(Page(page_id, url, payload, known, decided[2] if known else None).record(date)))
            if files is not None and files.done:
                yield files.batch()
        if files is not None:
            files.close()
            yield files.batch()

    page_rows = rows.select("page_id", "sha", F.lit(True).alias("is_page"), F.lit(None).cast(kind).alias("first"), "url", "body")
    both = page_rows.unionByName(again.withColumn("is_page", F.lit(False)), allowMissingColumns=True)
    both = both.select(shard_of("page_id").alias("shard"), *both.columns)
    dealt = both.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "page_id", "sha", "is_page", "url")
    manifest = scratch.write("manifest", dealt.mapInArrow(write, _MANIFEST))

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _store(root)
        for batch in batches:
            for r in batch.to_pylist():
                # a repeated task finds what it has renamed before
                if files.get_file_info(f"{path}/{r['file']}").type == pafs.FileType.NotFound:
                    files.move(f"{path}/{r['temporary']}", f"{path}/{r['file']}")
            yield batch

    placed = manifest.mapInArrow(publish, _MANIFEST).drop("temporary")
    placed.write.mode("overwrite").parquet(f"{root}/_manifest")
    store.rename(place("_manifest"), place("manifest"))
    store.delete(place("_temporary"), True)
    scratch.clear()
    return spark.read.parquet(f"{root}/manifest")


# ---- reading ----------------------------------------------------------------------------------------------------------------


def members(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The bodies of the gzip members of a file that comes in blocks."""
    d, out, rest = None, [], b""
    for block in blocks:
        rest += block
        while rest:
            d = d or zlib.decompressobj(31)
            out.append(d.decompress(rest))
            rest = d.unused_data if d.eof else b""
            if d.eof:
                yield b"".join(out)
                d, out = None, []
    if d is not None:
        raise ValueError("the file ends within a record")


def parse_record(body: bytes) -> dict:
    """A record's headers by lower-cased name, with its kind, HTTP headers and payload; lengths and digests are checked."""
    head, found, rest = body.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("not a record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    if headers.get("warc-block-digest", sha := f"sha1:{base32_sha1(block)}") != sha:
        raise ValueError("a record's block is not the one that was written")
    http, _, payload = block.partition(b"\r\n\r\n")
    headers["http"] = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    headers["payload"] = payload
    if headers["warc-type"] == "response" and headers.get("warc-payload-digest", sha := f"sha1:{base32_sha1(payload)}") != sha:
        raise ValueError("a record's payload is not the one that was written")
    return headers


def read_warc(spark: SparkSession, root: str, payloads: bool = True, page_type: str = "bigint") -> DataFrame:
    """A row per record of the archive below ``root``: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    Files are opened by the tasks, a record at a time in memory; each must have the records, bytes and digest that the manifest says, each
    record the lengths and digests that it says itself, else the job fails. Revisits have no payload. Without ``payloads`` they are left
    out. An archive without a manifest does not exist.
    """
    from urllib.parse import unquote

    small_batches(spark)
    manifest = spark.read.parquet(f"{root}/manifest")

    def as_id(v: str | None):
        return None if v is None else unquote(v) if page_type == "string" else int(v)

    def of(r: dict) -> tuple:
        size = int(r["http"]["content-length"])
        return (
            as_id(r.get("x-page-id")), unquote(r["x-page-url"]) if "x-page-url" in r else None, r["warc-type"], size, r["warc-payload-digest"].removeprefix("sha1:"),
            as_id(r.get("x-refers-to-page-id")), r["payload"] if payloads and r["warc-type"] == "response" else None,
        )

    kinds = [pa.string() if page_type == "string" else pa.int64()]
    kinds = [kinds[0], pa.string(), pa.string(), pa.int64(), pa.string(), kinds[0], pa.binary()]
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(root)
        for batch in batches:
            for f in batch.to_pylist():
                total, seen, digest, rows, held = 0, 0, hashlib.sha256(), [], 0
                with store.open_input_stream(f"{path}/{f['file']}", compression=None) as file:

                    def blocks(file=file, digest=digest) -> Iterator[bytes]:
                        nonlocal total
                        while block := file.read(BLOCK):
                            digest.update(block)
                            total += len(block)
                            yield block

                    for body in members(blocks()):
                        rows.append(of(parse_record(body)))
                        seen += 1
                        held += len(body) if payloads else 200
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if (seen, total, digest.hexdigest()) != (f["records"], f["bytes"], f["sha256"]):
                    raise ValueError(f"{f['file']} is not the file that the manifest names")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = max(1, manifest.count())
    out = manifest.repartition(min(files, 100_000), "file").mapInArrow(read, _RECORD.format(page_type))
    return out if payloads else out.drop("payload")
