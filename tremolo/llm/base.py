"""Shared pieces of the text operators: word splitting, hashing and shared-folder tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text; ``bytes.split`` cuts at exactly the six characters of SPACES."""
    return text.encode("utf-8").split() if text else []


#: Entries that a Python worker remembers at most, of the one operator that it works for.
MEMO = 600_000
_IN_USE: list[tuple] = []


def give_back() -> None:
    """Returns freed memory of this process to the system, as workers idle between their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def claim(*memos: dict, forget: Callable[[], object] | None = None) -> None:
    """Called as a task starts, with all memos of its operator: what the worker remembers for others is forgotten.

    Workers live on from stage to stage, and their memos would add up. forget: called when another operator
    takes over, to let go of what can be loaded again.
    """
    for others, drop in _IN_USE:
        if others[0] is not memos[0]:
            for other in others:
                other.clear()
            if drop:
                drop()
    _IN_USE[:] = [(memos, forget)]
    give_back()


def tidy(batches: Iterator) -> Iterator:
    """The batches of a task; when they end, memory that is free goes back to the system."""
    yield from batches
    give_back()


class WordHasher(dict):
    """word -> 64-bit hash, remembering at most ``limit`` words."""

    def __init__(self, limit: int = MEMO):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def hash(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive word hashes: a polynomial modulo 2**64, then mixed."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out *= _MULT
        out += h[i : i + m]
    return mix(out)


def let(value: Column, use) -> Column:
    """``use(value)`` with value computed once, inside one expression."""
    return F.transform(F.array(value), use)[0]


def train_fold(doc_id: Column) -> Column:
    """True where labels may be learnt from: crc32 of the id as text leaves 0 or 2 modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


class Workspace:
    """Tables written to the folder all executors share, to cut lineage.

    The folder is the session's ``spark.checkpoint.dir``; only a local master without that setting
    gets a temporary folder. A written table survives the loss of any executor.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="tremolo-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/tremolo-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        """Lets Spark remove the shuffle files of plans that are no longer referenced."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
