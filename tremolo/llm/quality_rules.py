"""Quality rules by cross-document line frequency, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo.llm.base import SPACES, WORD_SPLIT, Workspace, let

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_SPLIT), "")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _covered(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs at least twice; hashes are in text order."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    twice = let(pairs, lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
    at = F.array_sort(F.transform(twice, lambda x: x["p"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(at, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])


def _repeat_words(ws: Column) -> Column:
    hashes = F.when(F.size(ws) >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))


def line_hashes(text: Column) -> Column:
    """Normalised lines with a word: array of (hash, words). Case, digits and spacing don't count."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    lines = F.transform(F.split(flat, "\n"), lambda x: F.trim(x))
    return F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("w")))


def quality_rules(docs: DataFrame, *, text: str = "text", key: str = "doc_id", host: str = "source", max_docs: int = 20, least_kept: float = 0.3, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """One row per input row: key, statistics, n_removed_words, base_failed and kept.

    A normalised line found in more than ``max_docs`` documents of one host is removed from every
    document of that host; a document that keeps less than ``least_kept`` of its words is rejected.
    Rows with one key and one text are one document, however often they repeat; copies of a text
    under different keys are different documents, and rows without a key count each.

    Null and empty texts have no words and fail the base rules. Null hosts form one host. Null keys
    and repeated rows are judged like any others, each giving a row. Other columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), t.alias("t")).select(
        "doc_id", "host", "t", word_array(F.col("t")).alias("ws")
    )
    stats = base.select(
        "doc_id",
        "host",
        F.xxhash64("t").alias("th"),
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", WORD_SPLIT, "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _dup_lines(F.col("t")).cast("long").alias("n_dup_lines"),
        let(F.col("ws"), _repeat_words).cast("long").alias("n_repeat_words"),
        line_hashes(F.col("t")).alias("lines"),
    )
    stats = ws.save(stats, "stats")
    # Copies of a text within a host collapse before their lines are counted; their number goes along.
    texts = stats.groupBy("host", "th").agg(F.first("lines").alias("lines"))
    keys = stats.groupBy("host", "th", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    copies = keys.groupBy("host", "th").agg(F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(1)).alias("docs"))
    lines = texts.join(copies, ["host", "th"]).select("host", "docs", F.explode(F.array_distinct(F.col("lines.h"))).alias("h"))
    per_line = lines.groupBy("host", "h").agg(F.sum("docs").alias("n")).where(F.col("n") > max_docs).select("host", "h")
    # Tables of their own, so that the joins can split the rows of a line or text that many have.
    per_line = ws.save(per_line, "frequent")
    found = texts.select("host", "th", F.explode("lines").alias("x")).select("host", "th", F.col("x.h").alias("h"), F.col("x.w").alias("w"))
    lost = found.join(per_line, ["host", "h"]).groupBy("host", "th").agg(F.sum("w").alias("lost"))
    lost = ws.save(lost, "lost")
    out = stats.drop("lines").join(lost, ["host", "th"], "left")
    n, gone = F.col("n_words"), F.coalesce(F.col("lost"), F.lit(0)).cast("long")
    failed = (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat * n)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (n - gone >= F.lit(float(least_kept)) * n)).alias("kept"), gone.alias("n_removed_words"))
