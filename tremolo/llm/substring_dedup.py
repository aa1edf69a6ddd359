"""Substring deduplication by relative Lempel-Ziv parsing against an index of reference blocks.

The references of a document are all documents with smaller keys. They are indexed in blocks: each
window of ``length`` words picks the least hash among its short runs of words, its anchor, so equal
windows pick equal anchors wherever they stand; a block is the text of all consecutive windows that
share an anchor, and the index has the first document and position of each. A document is parsed
greedily from left to right into factors (start, words, reference, position): a factor begins at a
block that the index has, and goes on while the next block stands right behind in the same reference.
Where factors end, the windows across the boundary are looked up one by one, as they may start in yet
another reference. Factors and such windows have ``length`` words at least; their words are the
duplicate spans. Blocks and windows are equal if two independent 64-bit hashes are.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm.base import WordHasher, Workspace, claim, mix, ngrams, words, tidy

#: Words of a window, and of the runs among which it picks its anchor.
LENGTH, RUN = 50, 10


@lru_cache(1)
def _hasher() -> WordHasher:
    return WordHasher()


def blocks(h: np.ndarray, length: int = LENGTH, run: int = RUN) -> tuple[np.ndarray, ...]:
    """(anchor hash, two block hashes, first window, end of windows) of each block of a document's word hashes."""
    n = len(h) - length + 1
    if n <= 0:
        e = np.empty(0, np.uint64)
        return e, e, e, e.astype(np.int64), e.astype(np.int64)
    g = ngrams(h, run)
    at = np.empty(n, np.int64)
    for i in range(0, n, 4096):
        view = np.lib.stride_tricks.sliding_window_view(g[i : min(n, i + 4096) + length - run], length - run + 1)
        at[i : i + len(view)] = view.argmin(1) + np.arange(i, i + len(view))
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    end = np.r_[first[1:], n]
    size = mix((end - first).astype(np.uint64))
    whole = [mix(_stretches(x, which, first, end + length - 1) ^ size) for which, x in enumerate((h, mix(h)))]
    return g[at[first]], *whole, first, end


#: Odd bases of the two polynomial hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _stretches(h: np.ndarray, which: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash modulo 2**64 of each stretch [start, end): a difference of two prefix sums."""
    if which not in _POWERS or len(_POWERS[which][0]) < len(h):
        size, both = max(4096, 2 * len(h)), []
        for base in (pow(_BASES[which], -1, 1 << 64), _BASES[which]):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[which] = both[0], both[1]
    inverse, power = _POWERS[which]
    sums = np.r_[np.uint64(0), np.cumsum(h * power[: len(h)], dtype=np.uint64)]
    return (sums[ends] - sums[starts]) * inverse[starts]


def window_hashes(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window of a document's word hashes."""
    return ngrams(h, length), mix(_stretches(mix(h), 1, np.arange(max(0, len(h) - length + 1)), np.arange(length, max(length, len(h) + 1))))


def parse(found: list[dict], first: np.ndarray, end: np.ndarray, hashes: np.ndarray, length: int) -> list[dict]:
    """The factors of a document: found has, for blocks that the index knows, hash, window, reference and position."""
    out: list[dict] = []
    ordinal = {int(s): i for i, s in enumerate(first)}
    stop = -1  # the window behind the last factor
    for x in sorted(found, key=lambda x: x["p"]):
        i = ordinal.get(x["p"])
        if i is None or int(hashes[i]) != x["b"] & (1 << 64) - 1:  # of another row with this key
            continue
        p = x["p"]
        if out and p == stop and x["ref"] == out[-1]["reference"] and x["at"] - out[-1]["position"] == p - out[-1]["start"]:
            out[-1]["n_words"] += int(end[i]) - p
        elif p >= stop:
            out.append({"start": p, "n_words": int(end[i]) - p + length - 1, "reference": x["ref"], "position": x["at"]})
        stop = max(stop, int(end[i]))
    return out


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n words lie in a span [start, end)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:n]) > 0


def _sha(ws: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(ws)).hexdigest()


def _u64(values: list[int] | None) -> np.ndarray:
    return np.array(values or [], np.int64).view(np.uint64)


def remove_repeats(docs: DataFrame, *, text: str = "text", key: str = "doc_id", length: int = LENGTH, with_text: bool = False, with_factors: bool = False) -> DataFrame:
    """One row per input row: key as doc_id, n_words, n_removed, kept_sha256, and kept_text and factors if asked.

    A word is removed if a window of ``length`` words covers it whose word sequence also starts in a
    document with a smaller key. Words are cut at space and U+0009 to U+000D and otherwise unchanged;
    kept words are joined by one space. factors are (start, n_words, reference, position), in words:
    the text's words from start on stand in the reference from position on.

    Null, empty and blank texts have no words. Rows that share a key are one document: none is a
    reference for another. Rows without a key lose nothing and are no reference. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    source = docs.select(docs[key].alias("doc_id"), docs[text].alias("t"))
    kind = source.schema["doc_id"].dataType.simpleString()
    signed = lambda x: x.view(np.int64).tolist()

    def split(batches):
        claim(_hasher())
        for batch in tidy(batches):
            out = []
            for t in batch.column(1):
                w = words(t.as_py())
                a, b, c, p, _ = blocks(_hasher().hash(w), length)
                out.append((len(w), _sha(w), [{"a": x, "b": y, "c": z, "p": i} for x, y, z, i in zip(signed(a), signed(b), signed(c), p.tolist(), strict=True)]))
            n, sha, own = zip(*out, strict=True) if out else ((), (), ())
            entry = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("p", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(own, entry)], ["doc_id", "n_words", "sha", "blocks"])

    parsed = ws.save(source.mapInArrow(split, f"doc_id {kind}, n_words bigint, sha string, blocks array<struct<a: bigint, b: bigint, c: bigint, p: int>>"), "parsed")
    index = parsed.where("doc_id is not null").select("doc_id", F.explode("blocks").alias("x")).select("doc_id", "x.a", "x.b", "x.c", "x.p")

    # The index of blocks: the first document of each that several have, and where it has it.
    first = index.groupBy("b", "c").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("last"), F.min_by("p", "doc_id").alias("at")).where("ref < last").select("b", "c", "ref", "at")
    first = ws.save(first, "references")
    known = F.coalesce(F.col("ref") < F.col("doc_id"), F.lit(False)).alias("found")
    factored = ws.save(index.join(first, ["b", "c"], "left").select("doc_id", "a", "b", "p", "ref", "at", known), "factored")
    # Boundaries: blocks that aren't found but have an anchor that such blocks of other documents have too.
    edge = factored.where("not found").groupBy("a").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("a")
    edge = ws.save(edge, "boundaries")
    inside = factored.where("found").groupBy("doc_id").agg(F.collect_list(F.struct("b", "p", "ref", "at")).alias("found"))
    across = factored.where("not found").join(edge, "a", "left_semi").groupBy("doc_id").agg(F.collect_set("a").alias("across"))
    chosen = inside.join(across, "doc_id", "full")
    touched = ws.save(source.join(chosen, "doc_id"), "touched")
    ws.release()

    def windows(batches):
        claim(_hasher())
        for batch in tidy(batches):
            ids, out = [], []
            for i, t, across in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                h = _hasher().hash(words(t.as_py()))
                a, _, _, s, e = blocks(h, length)
                here = np.isin(a, _u64(across))
                if here.any():
                    at = np.concatenate([np.arange(x, y) for x, y in zip(s[here], e[here], strict=True)])
                    got = np.unique(np.stack([x[at] for x in window_hashes(h, length)], 1), axis=0).view(np.int64)
                    out.append(got)
                    ids += [i] * len(got)
            flat = np.concatenate(out) if out else np.empty((0, 2), np.int64)
            for i in range(0, len(flat), 50_000):
                part = np.ascontiguousarray(flat[i : i + 50_000].T)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 50_000], batch.schema.field(0).type), pa.array(part[0]), pa.array(part[1])], ["doc_id", "w", "v"])

    tried = touched.where("across is not null").select("doc_id", "t", "across").mapInArrow(windows, f"doc_id {kind}, w bigint, v bigint")
    tried = ws.save(tried, "windows")
    repeated = tried.groupBy("w", "v").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w", "v", "first")
    repeated = ws.save(repeated, "repeated")
    singles = tried.join(repeated, ["w", "v"]).where("first < doc_id").groupBy("doc_id").agg(F.collect_set("w").alias("singles"))

    def cut(batches):
        claim(_hasher())
        for batch in tidy(batches):
            out = []
            for t, found, singles in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                w = words(t.as_py())
                h = _hasher().hash(w)
                _, b, _, s, e = blocks(h, length)
                factors = parse(found or [], s, e, b, length)
                starts = np.array([x["start"] for x in factors], np.int64)
                ends = starts + np.array([x["n_words"] for x in factors], np.int64)
                if singles:
                    more = np.flatnonzero(np.isin(ngrams(h, length), _u64(singles)))
                    starts, ends = np.r_[starts, more], np.r_[ends, more + length]
                gone = covered(len(w), starts, ends)
                kept = [x for x, g in zip(w, gone.tolist(), strict=True) if not g]
                out.append((len(w), len(w) - len(kept), _sha(kept), b" ".join(kept).decode() if with_text else None, factors if with_factors else None))
            cols = list(zip(*out, strict=True)) or [()] * 5
            id_kind = batch.schema.field(0).type
            factor = pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("reference", id_kind), ("position", pa.int32())]))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), factor)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, x) for c, x in zip(cols, kinds, strict=True))], [*names, "kept_text", "factors"])

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    factors_kind = f"array<struct<start: int, n_words: int, reference: {kind}, position: int>>"
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string, factors {factors_kind}"
    changed = touched.join(singles, "doc_id", "left").select("doc_id", "t", "found", "singles").mapInArrow(cut, schema)
    none = F.lit(0).cast("bigint").alias("n_removed")
    factors = F.array().cast(factors_kind).alias("factors")
    if with_text:
        kept = F.array_remove(F.split(F.coalesce("t", F.lit("")), r"[\x20\x09-\x0D]+"), "")
        plain = F.array_join(kept, " ")
        same = source.join(touched.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.size(kept).cast("bigint").alias("n_words"), none, F.sha2(plain, 256).alias("kept_sha256"), plain.alias("kept_text"), factors)
    else:
        same = parsed.join(touched.select("doc_id"), "doc_id", "left_anti").select("doc_id", "n_words", none, F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"), factors)
    return changed.unionByName(same).select(*names, *(["kept_text"] if with_text else []), *(["factors"] if with_factors else []))
