"""Near-duplicate classes: universal hash minima, banding, verification, large-star and small-star."""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm.base import WordHasher, Workspace, claim, mix, ngrams, tidy

#: Chance of missing, in all bands, a pair that is exactly as similar as the threshold.
MISS = 1e-7
MOST_HASHES = 144
#: Documents of one bucket that a task compares at a time, and shingles of theirs; a document of more is on its own.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
#: Words of 64 bits in the bitmap of documents that have a bucket in common with another.
BITMAP_WORDS = 1 << 20
#: Standard deviations by which the share of equal minima may fall short of the threshold.
SLACK = 6.0


def bands_for(threshold: float) -> tuple[int, int]:
    """(bands, rows): as many rows a band as MOST_HASHES allow at the chance MISS."""
    best = (1, MOST_HASHES)
    for rows in range(1, 16):
        bands = math.ceil(math.log(MISS) / math.log1p(-(threshold**rows)))
        if bands * rows <= MOST_HASHES:
            best = (bands, rows)
    return best


@lru_cache(1)
def _hasher() -> WordHasher:
    return WordHasher()


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; of the whole sequence if the text has fewer words.

    A-Z are lower-cased, which is all that bytes.lower() changes.
    """
    h = _hasher().hash((text or "").encode("utf-8").lower().split())
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(ngrams(h, min(k, len(h))) ^ np.uint64(min(k, len(h))))


@lru_cache(4)
def _universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(s: np.ndarray, n: int) -> np.ndarray:
    """Minima of n multiply-add hashes modulo 2**32 of a non-empty set."""
    a, b = _universal(n)
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(out, (x[i : i + 512, None] * a + b).min(0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, different bands never sharing one on purpose."""
    h = sig[: bands * rows].reshape(bands, rows).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(rows):
        out = mix(out ^ h[:, j] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def verify(ids: np.ndarray, sets: list[np.ndarray], sigs: np.ndarray, left: int, threshold: tuple[int, int], known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between rows, enough to join all that are linked: a pair already joined isn't compared.

    left: rows before it are compared among themselves and with the rest; 0: all with all. A pair
    is compared on full sets if sizes and equal minima allow the threshold, a fraction (num, den).
    known: rows with the same value are joined from the start.
    """
    num, den = threshold
    n, k = sigs.shape
    t = num / den
    least = k * t - SLACK * math.sqrt(k * t * (1 - t))
    size = np.array([len(s) for s in sets])
    root = np.arange(n)
    if known is not None:
        _, first, of = np.unique(known, return_index=True, return_inverse=True)
        root = first[of]
    out = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        others = np.arange(i + 1 if not left else max(i + 1, left), n)
        if left and i >= left:
            break
        if not len(others):
            continue
        small, large = np.minimum(size[i], size[others]), np.maximum(size[i], size[others])
        others = others[small * den >= large * num]
        if not len(others):
            continue
        equal = (sigs[others] == sigs[i]).sum(1)
        others = others[equal >= least]
        for j in others[np.argsort(-equal[equal >= least], kind="stable")]:
            a, b = find(i), find(int(j))
            if a == b:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both * den >= num * (size[i] + size[j] - both):
                root[b] = a
                out.append((int(ids[i]), int(ids[j])))
    return out


def components(edges: DataFrame, ws: Workspace, name: str = "") -> DataFrame:
    """(node, component) of every node of edges (u, v), by alternating large-star and small-star.

    Each round writes its edges to the shared folder. The rounds go on until every component is a star,
    so there is no limit to them; their number grows with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = ws.save(edges, f"{name}edges0")
    mark = None
    for i in itertools.count(1):
        # Large-star: every neighbour that is larger than a node moves to the node's least neighbour.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The minima are tables of their own, so that a join can split the rows of a node of many edges.
        least = ws.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}large{i}")
        edges = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = ws.save(edges, f"{name}half{i}")
        # Small-star: a node's smaller neighbours and itself move to the least of them.
        least = ws.save(edges.groupBy("u").agg(F.min("v").alias("m")), f"{name}small{i}")
        moved = edges.join(least, "u")
        edges = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = ws.save(edges, f"{name}edges{i}")
        ws.drop(f"{name}edges{i - 1}", f"{name}large{i}", f"{name}half{i}", f"{name}small{i}")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.countDistinct("u")).first()
        # Stars: every node has one edge, to a node that has none; then nothing moves any more.
        if now[0] == now[2] and tuple(now) == mark:
            break
        mark = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _likely(texts: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of texts without most of those whose rep isn't among members, and without a shuffle.

    A bitmap of hashes tells which; its rows are words of 64 bits, BITMAP_WORDS at most whatever the
    input, so it can be broadcast. The fuller it is the more rows pass, which the join drops then.
    """
    h = F.xxhash64(F.lit(11), "rep")
    word, bit = F.pmod(F.shiftright(h, 6), F.lit(BITMAP_WORDS)).cast("int"), F.pmod(h, F.lit(64)).cast("int")
    marks = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    bitmap = members.select(word.alias("word"), marks.alias("mark")).groupBy("word").agg(F.bit_or("mark").alias("marks"))
    return texts.withColumn("word", word).join(F.broadcast(bitmap), "word").where(F.col("marks").bitwiseAND(marks) != 0).select("rep", "t")


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", k: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per input row: key as doc_id, n_shingles, component_id and kept.

    Words are cut at space and U+0009 to U+000D, A-Z lower-cased; a text's set is its distinct k-word
    shingles, or its whole sequence if it has fewer words. Texts are linked if den * intersection >=
    num * union; component_id is the least key reachable, kept tells whether it is the row's own.

    Null, empty and blank texts have an empty set and are linked with nothing. Repeated rows stay, and
    rows that share a key are linked by their own texts. Rows without a key take part in no link: they keep
    a null component and are kept, unless an equal set has a key. Other columns are ignored; an empty
    table gives an empty result.

    Equal sets count once, as their least key. Buckets that hold the same documents as another are
    compared once. One of more than BLOCK documents, or BLOCK_SHINGLES shingles, isn't compared in
    pairs: its documents meet its pivot, in blocks, which joins those of a family of copies. Only what
    is left outside the bucket's largest component then meets the whole bucket, block by block, so no
    link is lost; it is quadratic only in documents that share a bucket without being alike.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    bands, rows = bands_for(threshold[0] / threshold[1])

    def sketch(batches):
        claim(_hasher())
        for batch in tidy(batches):
            out = []
            for t in batch.column(1):
                s = shingles(t.as_py(), k)
                if len(s):
                    fp = xxhash.xxh3_128_digest(s.tobytes())
                    out.append((len(s), fp, _signed(band_keys(signature(s, bands * rows), bands, rows)).tolist()))
                else:
                    out.append((0, None, None))
            n, fp, keys = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "fp", "bands"])

    source = docs.select(docs[key].alias("doc_id"), docs[text].alias("t"))
    kind = source.schema["doc_id"].dataType.simpleString()
    sketches = ws.save(source.mapInArrow(sketch, f"doc_id {kind}, n bigint, fp binary, bands array<bigint>"), "sketches")

    # Equal sets: one representative each.
    classes = sketches.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.min_by("bands", "doc_id").alias("bands")).where("rep is not null")
    classes = ws.save(classes, "classes")
    banded = classes.select("rep", F.explode("bands").alias("band"))
    # Most keys have one document: they go before anything else is known of a bucket.
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = ws.save(banded.join(shared, "band"), "shared")
    buckets = shared.groupBy("band", "size").agg(F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "rep")).alias("y"))
    buckets = buckets.groupBy("size", "x", "y").agg(F.min("band").alias("band"))
    members = shared.select("rep", "band").join(buckets.select("band"), "band").join(classes.groupBy("rep").agg(F.max("n").alias("n")), "rep")
    members = ws.save(members, "members")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    big = ws.save(members.groupBy("band").agg(blocks.alias("blocks"), F.min("rep").alias("pivot")).where("blocks > 1"), "big")

    def compared(units: DataFrame, name: str) -> DataFrame:
        """Links of (rep, unit, second, c): texts travel to their units, as they are smaller than their sets."""
        texts = _likely(source.select(F.col("doc_id").alias("rep"), "t"), units)
        return ws.save(units.join(texts, "rep").groupBy("unit").applyInArrow(compare, f"u {kind}, v {kind}"), name)

    def compare(table: pa.Table) -> pa.Table:
        claim(_hasher())
        rep, second = table["rep"].to_numpy(), table["second"].to_numpy()
        by = np.lexsort((rep, second))
        left = int((~second).sum()) if second.any() else 0
        sets = [shingles(t.as_py(), k) for t in table["t"].take(by)]
        # A byte of each minimum is enough to refuse a pair; what it lets pass is compared in full.
        sigs = np.stack([signature(x, bands * rows).astype(np.uint8) if len(x) else np.zeros(bands * rows, np.uint8) for x in sets])
        found = verify(rep[by], sets, sigs, left, threshold, table["c"].to_numpy()[by])
        ends = pa.schema([(name, table.schema.field("rep").type) for name in ("u", "v")])
        return pa.table([[u for u, _ in found], [v for _, v in found]], schema=ends)

    # A small bucket is one unit. Those of a big one meet its pivot, in blocks.
    own = F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("blocks")).cast("int")
    unit = lambda *by: F.xxhash64(*by).alias("unit")
    small = members.join(big.select("band"), "band", "left_anti").select("rep", unit("band"), F.lit(False).alias("second"), F.col("rep").alias("c"))
    large = members.join(big, "band").withColumn("own", own)
    pivots = big.select(F.col("pivot").alias("rep"), "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    to_pivot = large.where("rep <> pivot").select("rep", unit("band", "own"), F.lit(True).alias("second"), F.col("rep").alias("c"))
    to_pivot = to_pivot.unionByName(pivots.select("rep", unit("band", "own"), F.lit(False).alias("second"), F.col("rep").alias("c")))
    links = compared(ws.save(small.unionByName(to_pivot), "units"), "links")
    found = components(links, ws)
    # Big buckets that are still of several components: all that aren't in the largest one meet all.
    at = ws.save(large.select("rep", "band", "blocks", "own", "n").join(found, F.col("rep") == F.col("node"), "left").select("rep", "band", "blocks", "own", "n", F.coalesce("component", "rep").alias("c")), "at") if not big.isEmpty() else None
    if at is not None:
        parts = at.groupBy("band", "c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
        rest = F.greatest(F.ceil((F.sum("m") - F.max("m")) / BLOCK), F.ceil((F.sum("n") - F.max_by("n", "m")) / BLOCK_SHINGLES)).cast("int")
        mixed = ws.save(parts.groupBy("band").agg(F.max_by("c", "m").alias("main"), F.count(F.lit(1)).alias("cs"), rest.alias("rests")).where("cs > 1").drop("cs"), "mixed")
        if not mixed.isEmpty():
            both = at.join(mixed, "band")
            outer = both.where("c <> main").withColumn("part", F.pmod(F.xxhash64(F.lit(5), "rep"), F.col("rests")).cast("int")).select("rep", "band", "part", "c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
            every = both.select("rep", "band", "own", "c", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("part"))
            units = outer.select("rep", unit("band", "part", "own"), F.lit(False).alias("second"), "c").unionByName(every.select("rep", unit("band", "part", "own"), F.lit(True).alias("second"), "c"))
            more = compared(ws.save(units, "more_units"), "more_links")
            found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more), ws, "more_")
    of_class = classes.select("fp", "rep").join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("c"))
    # Rows without a set get keys of their own, as nulls would all meet in one task.
    salted = F.coalesce(F.col("fp"), F.concat(F.lit(b"\0"), F.coalesce(F.col("doc_id").cast("string"), F.uuid()).cast("binary")))
    out = sketches.select("doc_id", "n", salted.alias("fp")).join(of_class, "fp", "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
