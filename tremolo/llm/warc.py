"""WARC archives: a deterministic sharded writer with payload deduplication, and a reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.llm.base import Workspace

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

#: Bytes of records that make a shard, shards at most, and groups sampled for each bound between them.
SHARD_BYTES, MAX_SHARDS, PER_BOUND = 8 << 20, 4096, 64

MANIFEST = "shard int, file string, records bigint, bytes bigint, sha256 string"
RECORDS = "page_id {kind}, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to {kind}, payload binary, block_ok boolean, file string"


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _hex(base32: str) -> str:
    return base64.b32decode(base32).hex()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record with its headers and digests made anew: a response, or a revisit of refers_to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = uuid.uuid5(NAMESPACE, f"{page_id} {url} {digest}")
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join(c for c in url if c not in "\r\n") if url is not None else None),
        ("WARC-Page-Id", page_id),
        ("WARC-Payload-Digest", f"sha1:{_base32(digest)}"),
        ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).hexdigest())}"),
        ("WARC-Refers-To-Page-Id", refers_to),
        ("WARC-Profile", PROFILE if refers_to is not None else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None).encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """One gzip member without a time stamp, so that equal records give equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Files:
    """Files of one task, rolled by compressed size; they get their names once they are whole."""

    def __init__(self, uri: str, roll_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(uri)
        self.shard, self.roll, self.attempt = -1, roll_bytes, uuid.uuid4().hex
        self.done: list[tuple[int, str, int, int, str]] = []
        self.out = None

    def add(self, shard: int, member: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        if self.out is None:
            self.temp = f"{self.root}/_temporary/{shard:06d}-{self.number:05d}-{self.attempt}"
            self.out, self.records, self.bytes, self.sha = self.fs.open_output_stream(self.temp), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.sha.update(member)
        self.records, self.bytes = self.records + 1, self.bytes + len(member)
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
        self.number += 1
        # A second attempt writes the same bytes under the same name.
        self.fs.move(self.temp, f"{self.root}/{name}")
        self.done.append((self.shard, name, self.records, self.bytes, self.sha.hexdigest()))


def _bounds(source: DataFrame, shard_bytes: int) -> tuple[list[str], list[str]]:
    """The (key, digest) at which each shard but the first begins, all as text.

    They are quantiles, by bytes, of a sample of (key, digest) groups that is taken by hash: the same
    for the same rows, however they are partitioned. The driver gets PER_BOUND * MAX_SHARDS groups
    or so at most, whatever the input, as the sampled share falls with the number of rows.
    """
    size = F.octet_length("body") + 700
    n, total = source.agg(F.count(F.lit(1)), F.sum(size)).first()
    shards = min(MAX_SHARDS, -(-(total or 0) // shard_bytes))
    if shards < 2:
        return [], []
    share = min(1.0, PER_BOUND * shards / n)
    taken = F.pmod(F.xxhash64(F.lit(5), "k", "d"), F.lit(1 << 30)) < int(share * (1 << 30))
    groups = source.where(taken).groupBy("k", "d").agg(F.sum(size).alias("bytes")).orderBy("k", "d").collect()
    keys, digests, seen, whole = [], [], 0, sum(g.bytes for g in groups)
    for i, g in enumerate(groups):
        before, seen = seen, seen + g.bytes
        if i and g.k is not None and seen * shards // whole > before * shards // whole and len(keys) < shards - 1:  # a null key bounds nothing
            keys.append(str(g.k))
            digests.append(g.d)
    return keys, digests


def _shard(keys: list[str], digests: list[str], kind: str) -> Column:
    """How many bounds are at or before a row's (k, d), by binary search over two constant arrays."""
    if not keys:
        return F.lit(0)
    ks, ds = F.split(F.lit(",".join(keys)), ",").cast(f"array<{kind}>"), F.split(F.lit(",".join(digests)), ",")
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(keys).bit_length()))))

    def step(at: Column, by: Column) -> Column:
        i = at + by
        k = F.get(ks, i - 1)
        here = (F.col("k") > k) | ((F.col("k") == k) & (F.col("d") >= F.get(ds, i - 1)))
        return F.when((i <= len(keys)) & here, i).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def write_warc(pages: DataFrame, uri: str, *, html: str = "html", url: str = "url", key: str = "page_id", least_bytes: int = 1000, shard_bytes: int = SHARD_BYTES, roll_bytes: int = 128 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes one record per row below ``uri``, sorted by key over the shards; returns the manifest.

    Of records with equal payloads of at least ``least_bytes`` bytes, that with the largest key is a
    response and the others are revisits of it; rows that repeat that largest key too are responses.
    Smaller payloads are always responses. Null html is an empty payload; null urls get no target
    header; a null key comes first and never is what others refer to. Other columns are ignored,
    whatever their names. An empty table gives an empty manifest.

    The same rows give the same files, whatever their order and partitions: shards are ranges of
    (key, payload digest) of about ``shard_bytes`` each, MAX_SHARDS at most, and a file ends with its
    shard or at ``roll_bytes`` compressed. Rows that repeat key and payload share a shard.

    Each call writes to a folder of its own. Its manifest is written by Spark's committer and names
    only files of tasks that ended; then the file CURRENT is replaced by a rename and names the
    folder. A reader sees the archive before or after that, and leftovers of lost tasks never.
    """
    spark = pages.sparkSession
    commit = f"commit-{uuid.uuid4().hex}"
    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(f"{root}/{commit}/_temporary", recursive=True)
    body = F.coalesce(pages[html], F.lit("")).cast("binary")
    source = pages.select(pages[key].alias("k"), pages[url].alias("u"), body.alias("body")).withColumn("d", F.sha1("body"))
    kind = source.schema["k"].dataType.simpleString()
    keys, digests = _bounds(source, shard_bytes)
    big = source.where(F.octet_length("body") >= least_bytes).select("k", "d")
    first = big.groupBy("d").agg(F.max("k").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1 and rep is not null").select("d", "rep")
    first = Workspace(spark).save(first, "first")  # a table of its own, so that the join can split a payload that many pages have
    marks = big.distinct().join(first, "d").where("k is null or k < rep").select("k", "d", F.lit(0).alias("has"), F.lit(None).cast("string").alias("u"), F.lit(None).cast("binary").alias("body"), "rep")
    rows = marks.unionByName(source.select("k", "d", F.lit(1).alias("has"), "u", "body", F.lit(None).cast(kind).alias("rep")))
    # A mark and its pages share key and digest, so one shard has both, the mark first.
    rows = rows.withColumn("shard", _shard(keys, digests, kind))
    rows = rows.repartitionById(len(keys) + 1, F.col("shard")).sortWithinPartitions("shard", "k", "d", "has", "u").select("shard", "k", "d", "has", "u", "body", "rep")

    def run(batches):
        files = _Files(f"{uri}/{commit}", roll_bytes)
        mark, rep = None, None
        for batch in batches:
            for shard, k, d, has, u, payload, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not has:
                    mark, rep = (k, d), to
                    continue
                files.add(shard, gzip_member(record(k, u, payload, d, rep if mark == (k, d) else None, date)))
        files.close()
        cols = list(zip(*files.done, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["shard", "file", "records", "bytes", "sha256"])

    rows.mapInArrow(run, MANIFEST).write.parquet(f"{uri}/{commit}/manifest.parquet")
    temp = f"{root}/CURRENT-{commit}"
    with fs.open_output_stream(temp) as f:
        f.write(commit.encode())
    fs.move(temp, f"{root}/CURRENT")
    return manifest(spark, uri)


def current(uri: str) -> str:
    """The folder of the archive's last commit."""
    fs, root = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(f"{root}/CURRENT") as f:
        return f"{uri}/{f.read().decode()}"


def manifest(spark: SparkSession, uri: str) -> DataFrame:
    """The files of the last commit: shard, file (its name there), records, bytes and sha256."""
    return spark.read.schema(MANIFEST).parquet(f"{current(uri)}/manifest.parquet")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record of a gzip stream, holding one record at a time."""
    z, buf, raw = zlib.decompressobj(31), b"", b""

    def more() -> bool:
        nonlocal z, buf, raw
        while True:
            if z.eof:
                raw, z = z.unused_data, zlib.decompressobj(31)
            if not raw and not (raw := stream.read(1 << 20)):
                return False
            out, raw = z.decompress(raw), b""
            if out:
                buf += out
                return True

    while True:
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not more():
                if buf:
                    raise ValueError("the archive ends within a record")
                return
        lines = buf[:end].decode("utf-8").split("\r\n")
        if lines[0].encode() != VERSION:
            raise ValueError(f"not a record: {lines[0]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        while len(buf) < end + 8 + size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield head, buf[end + 4 : end + 4 + size]
        buf = buf[end + 8 + size :]


def read_warc(spark: SparkSession, uri: str, kind: str = "bigint") -> DataFrame:
    """One row per record of the last commit's manifest; block_ok tells whether its digests hold.

    payload is null for revisits, whose payload_bytes and payload_digest describe the full payload.
    An archive without records gives an empty result.
    """
    folder = current(uri)

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, root = pafs.FileSystem.from_uri(folder)
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for head, block in parse(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        revisit = head["WARC-Type"] == "revisit"
                        digest = _hex(head["WARC-Payload-Digest"].removeprefix("sha1:"))
                        ok = _hex(head["WARC-Block-Digest"].removeprefix("sha1:")) == hashlib.sha1(block).hexdigest() and (revisit or hashlib.sha1(payload).hexdigest() == digest)
                        ids = [int(head[k]) if k in head else None for k in ("WARC-Page-Id", "WARC-Refers-To-Page-Id")]
                        rows.append((ids[0], head.get("WARC-Target-URI"), head["WARC-Type"], size, digest, ids[1], None if revisit else payload, ok, name))
                        held += len(block)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    number = {"bigint": pa.int64(), "int": pa.int32()}[kind]
    kinds = (number, pa.string(), pa.string(), pa.int64(), pa.string(), number, pa.binary(), pa.bool_(), pa.string())
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest.parquet")
    return files.select("file").repartition(shards, "file").mapInArrow(run, RECORDS.format(kind=kind))
