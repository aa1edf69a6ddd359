"""URL judgements from a sorted digest array that every Python worker maps into memory."""

from __future__ import annotations

import os
import re
import shutil
import struct
import tempfile
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAGIC = b"SDA1"
#: The index is a file on each executor, not a broadcast; beyond this many rules it is refused.
MAX_RULES = 50_000_000
_CAPITALS = re.compile("[A-Z]+")


def ascii_lower(s: str) -> str:
    return _CAPITALS.sub(lambda m: m[0].lower(), s)


def split_rule(rule: str) -> tuple[str, str]:
    """'example.org/es/' -> ('example.org', '/es/'); a rule without a slash fits every path."""
    host, slash, path = rule.partition("/")
    return ascii_lower(host), slash + path


def build_index(rules: Iterable[tuple[str, str]], path: str) -> str:
    """Writes (rule, verdict) pairs as sorted 64-bit xxhash keys, offsets and the full strings.

    A repeated rule keeps 'block' over 'allow'. Layout: magic, counts, path lengths in use, keys,
    offsets, then one verdict byte and the host and path of each rule.
    """
    best: dict[str, bool] = {}
    for rule, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r} of rule {rule!r}")
        text = "".join(split_rule(rule))
        best[text] = best.get(text, False) or verdict == "block"
    if len(best) > MAX_RULES:
        raise ValueError(f"{len(best)} rules; an index holds at most {MAX_RULES}")
    keyed = sorted((xxhash.xxh64_intdigest(r.encode()), r, v) for r, v in best.items())
    blob = [bytes([v]) + r.encode() for _, r, v in keyed]
    lengths = sorted({len(split_rule(r)[1]) for r in best})
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<III", len(keyed), len(lengths), 0))
        f.write(np.array(lengths + [0] * (len(lengths) % 2), "<u4").tobytes())
        f.write(np.array([k for k, _, _ in keyed], "<u8").tobytes())
        f.write(np.cumsum([0, *map(len, blob)], dtype="<u8").tobytes())
        f.write(b"".join(blob))
    return path


def write_index(rules: DataFrame, path: str) -> str:
    """As build_index, from a table (entry, verdict) of any size up to MAX_RULES; nulls don't count.

    Spark sorts the entries by key; the driver streams them into the file and holds none.
    """
    known = rules.where("entry is not null").select("entry", F.col("verdict").alias("v"))
    bad = known.where("v is null or v not in ('allow', 'block')").first()
    if bad:
        raise ValueError(f"verdict {bad.v!r} of rule {bad.entry!r}")

    def keyed(batches):
        for batch in batches:
            texts = ["".join(split_rule(r)) for r in batch.column(0).to_pylist()]
            keys = np.fromiter((xxhash.xxh64_intdigest(t.encode()) for t in texts), np.uint64, len(texts))
            lengths = [len(split_rule(t)[1]) for t in texts]
            # Flipping the top bit gives signed numbers the order of unsigned ones.
            order = (keys ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(order), pa.array(texts, pa.string()), pa.array(lengths, pa.int32()), pa.array([v == "block" for v in batch.column(1).to_pylist()], pa.bool_())], ["key", "text", "length", "block"])

    sorted_rows = known.mapInArrow(keyed, "key bigint, text string, length int, block boolean").groupBy("key", "text", "length").agg(F.max("block").alias("block"))
    lengths = [r.length for r in sorted_rows.select("length").distinct().orderBy("length").collect()]  # path lengths, few
    n = 0
    with open(path + ".keys", "wb") as keys, open(path + ".offsets", "wb") as offsets, open(path + ".blob", "wb") as blob:
        at = 0
        for r in sorted_rows.orderBy("key", "text").toLocalIterator(prefetchPartitions=True):
            n += 1
            if n > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules; an index holds no more")
            keys.write(struct.pack("<Q", (r.key & (1 << 64) - 1) ^ 1 << 63))
            offsets.write(struct.pack("<Q", at))
            at += blob.write(bytes([r.block]) + r.text.encode())
        offsets.write(struct.pack("<Q", at))
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<III", n, len(lengths), 0))
        f.write(np.array(lengths + [0] * (len(lengths) % 2), "<u4").tobytes())
        for part in ("keys", "offsets", "blob"):
            with open(f"{path}.{part}", "rb") as x:
                shutil.copyfileobj(x, f)
            os.remove(f"{path}.{part}")
    return path


class DigestArray:
    """The mapped index: vectorised binary search on keys, then the stored string decides."""

    def __init__(self, path: str):
        self.data = np.memmap(path, np.uint8, "r")
        if bytes(self.data[:4]) != MAGIC:
            raise ValueError(f"{path} is not a digest array")
        n, k, _ = struct.unpack("<III", bytes(self.data[4:16]))
        at = 16
        self.lengths = [int(x) for x in np.frombuffer(self.data, "<u4", k, at)]
        at += 4 * (k + k % 2)
        self.keys = np.frombuffer(self.data, "<u8", n, at)
        self.offsets = np.frombuffer(self.data, "<u8", n + 1, at + 8 * n)
        self.blob = self.data[at + 8 * n + 8 * (n + 1) :]

    def probe(self, texts: list[str]) -> list[bool | None]:
        """For each text the rule's verdict (True: block), or None where no rule is that text."""
        out: list[bool | None] = [None] * len(texts)
        if not texts or not len(self.keys):
            return out
        want = np.fromiter((xxhash.xxh64_intdigest(t.encode()) for t in texts), np.uint64, len(texts))
        at = np.searchsorted(self.keys, want, "left")
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == want):
            j, raw = int(at[i]), texts[i].encode()
            while j < len(self.keys) and self.keys[j] == want[i]:  # equal keys lie side by side
                entry = bytes(self.blob[int(self.offsets[j]) : int(self.offsets[j + 1])])
                if entry[1:] == raw:
                    out[i] = bool(entry[0])
                    break
                j += 1
        return out

    def judge(self, hosts: Iterable[str], paths: Iterable[str]) -> list[tuple[str | None, bool | None]]:
        """The longest rule of each (host, path) and its verdict."""
        texts: list[str] = []
        spans: list[int] = [0]
        for host, path in zip(hosts, paths, strict=True):
            labels = host.split(".") if host else []
            for i in range(len(labels)):
                suffix = ".".join(labels[i:])
                texts += [suffix + path[:k] for k in self.lengths if k <= len(path)]
            spans.append(len(texts))
        # The same text can come from two cuts of host and path only with a slash at the same place.
        found = self.probe(texts)
        out: list[tuple[str | None, bool | None]] = []
        for a, b in zip(spans, spans[1:], strict=False):
            fits = [(len(texts[i]), texts[i], found[i]) for i in range(a, b) if found[i] is not None]
            out.append(max(fits)[1:] if fits else (None, None))
        return out


@lru_cache(4)
def _open(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' without '://'."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] | DataFrame, blocklist: Iterable[str] | DataFrame = (), *, url: str = "url", key: str = "page_id") -> DataFrame:
    """One row per input row: key as page_id, host, path, rule, verdict and listed.

    ``rules`` are (host and path prefix, 'allow' or 'block'); the longest that fits decides and is
    named in ``rule``. Where none fits, ``blocklist`` (the same form, all blocking) decides, and what
    is on neither is allowed; ``listed`` is the entry of the blocklist that fits best, if any. Null
    urls and urls without '://' have empty host and path, fit nothing and are allowed. Repeated rows
    and null keys stay. Other columns are ignored; an empty table gives an empty result.

    Rules and blocklist can be tables too, (entry, verdict) and (entry). Both indexes have MAX_RULES
    entries at most and reach each executor once as files; a new executor fetches them again.
    """
    spark = pages.sparkSession
    folder = tempfile.mkdtemp(prefix="digests-")
    names = []
    listed = blocklist.select("entry", F.lit("block").alias("verdict")) if isinstance(blocklist, DataFrame) else ((x, "block") for x in blocklist)
    for kind, entries in (("rules", rules), ("listed", listed)):
        path = (write_index if isinstance(entries, DataFrame) else build_index)(entries, os.path.join(folder, kind))
        name = f"{kind}-{xxhash.xxh3_128_hexdigest(np.memmap(path, np.uint8, 'r'))}.sda"
        os.rename(path, os.path.join(folder, name))
        if not os.path.exists(SparkFiles.get(name)):
            spark.sparkContext.addFile(os.path.join(folder, name))
        names.append(name)

    def run(batches):
        by_rule, listed = map(_open, names)
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rule, hit = by_rule.judge(hosts, paths), listed.judge(hosts, paths)
            block = [bool(h) if r is None else bool(v) for (r, v), (_, h) in zip(rule, hit, strict=True)]
            more = [[r for r, _ in rule], ["block" if b else "allow" for b in block], [r for r, _ in hit]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.string()) for x in more)], ["page_id", "host", "path", "rule", "verdict", "listed"])

    source = pages.select(pages[key].alias("page_id"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    kind = source.schema["page_id"].dataType.simpleString()
    return source.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, listed string")
