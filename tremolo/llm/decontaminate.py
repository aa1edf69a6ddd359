"""Benchmark decontamination by template windows, in SQL functions only.

Numbers, units after numbers and names become typed placeholders; windows of the resulting tokens are
joined by hash, and a match counts if the values in the slots fit one substitution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo.llm.base import Workspace, let

#: Tokens of a window, and tokens of a run that is found wherever it stands in a document.
WINDOW, RUN = 8, 13
#: A window says something if so many of its tokens aren't placeholders.
LEAST_LITERAL = 4
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
UNITS = "km|cm|mm|m|kg|mg|g|lb|lbs|oz|ml|l|s|ms|min|mins|h|hr|hrs|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|ft|inch|inches|metres?|meters?|mph|kmh|usd|eur|gbp|dollars?|euros?|pounds?|cents?|percent|degrees?|volts?|watts?|kw|kwh|mb|gb|tb|hz|khz|mhz"
_NUMBER = r"(?<![\p{L}\p{N}])[+-]?[0-9]+(?:[.,:/][0-9]+)*"
_NAME = r"(?<=[\p{L}\p{N},;] )\p{Lu}[\p{L}\p{M}\p{N}]*"
_AFTER = r"(?![\p{L}\p{N}])"
#: Marks between tokens. Signs and separators of a value stay: a blank is put before each number, so
#: no others stand after its placeholder or between two digits.
_BETWEEN = r"[^\p{L}\p{M}\p{N}\x{E000}-\x{E002}.,:/+-]+|(?<![0-9])[.,:/]|[.,:/](?![0-9])|(?<!\x{E000})[+-]"


def _marked(text: Column, values: bool) -> Column:
    """Tokens in lower case, slots being placeholders with or without their values: the cuts are the same."""
    kept = "$0" if values else ""
    value, number, unit = (r"([^ ]+)", "$1", "$2") if values else ("()", "", "")
    t = F.regexp_replace(F.coalesce(text, F.lit("")), _NAME, NAME + kept)
    t = F.regexp_replace(t, _NUMBER, f" {NUMBER}{kept} ")
    t = F.regexp_replace(t, f"{NUMBER}{value}  ?({UNITS}){_AFTER}", f"{NUMBER}{number} {UNIT}{unit} ")
    return F.array_remove(F.split(F.lower(t), _BETWEEN), "")


def tokens(text: Column) -> Column:
    """Tokens in lower case; a slot is its placeholder followed by the whole value, as 3.75, 1,200, 12:30 or -5.

    A name is a capitalised word after a word, a comma or a semicolon and one blank.
    """
    return _marked(text, True)


def template(text: Column) -> Column:
    """As tokens(), a slot being its placeholder alone."""
    return _marked(text, False)


def _slot(x: Column) -> Column:
    return F.substring(x, 1, 1).isin(NUMBER, UNIT, NAME)


def _canonical(x: Column) -> Column:
    return F.transform(x, lambda t: F.when(_slot(t), F.substring(t, 1, 1)).otherwise(t))


def _windows(tok: Column, size: int, stride: int = 1) -> Column:
    """(hash, position) of windows of size tokens; the last one is always among them."""
    last = F.size(tok) - size
    at = F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)), F.array(F.greatest(last, F.lit(0))))
    found = F.transform(at, lambda i: F.struct(F.xxhash64(F.slice(tok, i + 1, size), F.lit(size)).alias("h"), i.alias("p")))
    return F.when(last >= 0, F.array_distinct(found) if stride > 1 else F.slice(found, 1, last + 1)).otherwise(F.slice(found, 1, 0))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (document row, item) that it contains: see the columns below.

    doc_id, item_id, row_key (hash of key and text), n_windows that match on the best diagonal, of
    item_windows; position of the first matching token; n_slots compared and n_changed that differ.

    A match is at least min(RUN - WINDOW + 1, item_windows) windows on one diagonal, in which equal
    values of the item stand for equal values of the document. A diagonal is looked at if one of its
    windows has LEAST_LITERAL literal tokens; then all of its windows count, whatever they hold.
    Items of fewer than WINDOW tokens match as a whole; items with fewer than LEAST_LITERAL literal
    tokens in every window match nothing. Null, empty and blank texts match nothing; null keys are
    reported as they are; repeated rows give repeated matches, and repeated items a row each. Other
    columns are ignored, and an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    # A document may have text before the item, which makes a capital at the item's start a name.
    within = tokens(F.concat(F.lit("x "), F.col(item_text)))
    forms = F.array_distinct(F.array(tokens(F.col(item_text)), F.slice(within, 2, F.greatest(F.size(within) - 1, F.lit(0)))))
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).alias("item_id"), F.explode(forms).alias("it")).where(F.size("it") > 0)
    items = items.withColumn("form", F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("-")), "it")).withColumn("ic", _canonical(F.col("it"))).withColumn("n", F.size("ic"))
    items = items.withColumn("size", F.least(F.lit(WINDOW), "n"))
    literal = F.transform("ic", lambda x: F.when(_slot(x), 0).otherwise(1))
    said = let(literal, lambda x: F.transform(F.sequence(F.lit(0), F.col("n") - F.col("size")), lambda p: F.aggregate(F.slice(x, p + 1, F.col("size")), F.lit(0), lambda a, b: a + b) >= LEAST_LITERAL))
    items = ws.save(items.withColumn("said", said).where(F.array_contains("said", True)), "items")
    # How densely documents must be probed: a few numbers, whatever the sizes. Any run that has a
    # window to look for has so many of them in a row at least.
    short = sorted(r.n for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())
    run = F.least(F.size("said"), F.lit(RUN - WINDOW + 1))
    row = lambda x: F.aggregate(x, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, b: let(F.when(b, a["now"] + 1).otherwise(0), lambda c: F.struct(c.alias("now"), F.greatest(a["most"], c).alias("most"))), lambda a: a["most"])
    rows_of = F.transform(F.sequence(F.lit(1), F.size("said") - run + 1), lambda p: row(F.slice("said", p, run)))
    stride = items.where(F.col("n") >= WINDOW).select(F.array_min(F.filter(rows_of, lambda x: x > 0)).alias("row")).agg(F.min("row")).first()[0] or 1
    sizes = {WINDOW: stride} | {n: 1 for n in short}

    parts = [items.where(F.col("size") == size).select("form", "said", F.explode(_windows(F.col("ic"), size)).alias("w")) for size in sizes]
    index = parts[0]
    for p in parts[1:]:
        index = index.unionByName(p)
    index = ws.save(index.where(F.get("said", F.col("w.p"))).select("form", F.col("w.h").alias("h"), F.col("w.p").alias("ip")), "index")

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t"))
    row_key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "t").alias("row_key")
    probes = rows.select(row_key, template(F.col("t")).alias("tok"))
    probed = F.concat(*(F.transform(_windows(F.col("tok"), size, step), lambda x: x["h"]) for size, step in sizes.items()))
    hit = probes.select("row_key", F.explode(probed).alias("h")).join(index.select("h").distinct(), "h", "left_semi").select("row_key").distinct()
    hit = ws.save(hit, "hit")

    full = ws.save(rows.withColumn("row_key", row_key).join(hit, "row_key").select("doc_id", "row_key", tokens(F.col("t")).alias("dt")), "full")
    # let(): a lambda would make the canonical tokens anew for each window.
    placed_in = let(_canonical(F.col("dt")), lambda dc: F.flatten(F.array(*(_windows(dc, size) for size in sizes))))
    placed = full.select("row_key", F.explode(placed_in).alias("w")).select("row_key", F.col("w.h").alias("h"), F.col("w.p").alias("dp"))
    met = ws.save(placed.join(index, "h").select("row_key", "form", (F.col("dp") - F.col("ip")).alias("shift")).distinct(), "met")
    # Both sides of a whole diagonal, token by token, and the windows that are equal but for values.
    both = F.transform("it", lambda x, i: F.struct(x.alias("iv"), F.get("dt", i + F.col("shift")).alias("dv")))
    sides = met.join(items.select("form", "item_id", "it", "size", "said"), "form").join(full, "row_key").select("doc_id", "row_key", "item_id", "shift", "size", "said", both.alias("both"))
    alike = F.transform("both", lambda x: F.coalesce(F.when(_slot(x["iv"]), F.substring(x["iv"], 1, 1) == F.substring(x["dv"], 1, 1)).otherwise(x["iv"] == x["dv"]), F.lit(False)))
    equal = let(alike, lambda e: F.filter(F.sequence(F.lit(0), F.size("said") - 1), lambda p: F.forall(F.slice(e, p + 1, F.col("size")), lambda x: x)))
    # Values of all equal windows must fit, or at least those of the windows that say something.
    every = sides.withColumn("equal", equal).withColumn("at", F.explode(F.array(F.col("equal"), F.filter("equal", lambda p: F.get("said", p)))))
    pairs = F.array_distinct(F.flatten(F.transform("at", lambda p: F.filter(F.slice("both", p + 1, F.col("size")), lambda x: _slot(x["iv"])))))
    diagonals = every.select("doc_id", "row_key", "item_id", F.size("said").alias("item_windows"), F.size("at").alias("n_windows"), (F.col("at")[0] + F.col("shift")).alias("position"), pairs.alias("pairs"))
    values = F.array_distinct(F.transform("pairs", lambda x: x["iv"]))
    fits = (F.size(values) == F.size("pairs")) & (F.col("n_windows") >= F.least(F.lit(RUN - WINDOW + 1), F.col("item_windows")))
    changed = F.size(F.filter("pairs", lambda x: x["iv"] != x["dv"]))
    best = F.struct(F.col("n_windows"), (-F.col("position")).alias("before"), F.size("pairs").alias("n_slots"), changed.alias("n_changed"), "item_windows")
    return (
        diagonals.where(fits)
        .groupBy("doc_id", "row_key", "item_id")
        .agg(F.max(best).alias("x"))
        .select("doc_id", "item_id", "row_key", F.col("x.n_windows").alias("n_windows"), F.col("x.item_windows").alias("item_windows"), (-F.col("x.before")).alias("position"), F.col("x.n_slots").alias("n_slots"), F.col("x.n_changed").alias("n_changed"), F.lit(True).alias("contaminated"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """The rows of docs, with all their columns, in which find_leaks finds no item."""
    key, text = names.get("key", "doc_id"), names.get("text", "text")
    leaks = Workspace(docs.sparkSession).save(find_leaks(docs, benchmark, **names).select(F.col("row_key").alias("_leak")).distinct(), "leaks")
    row_key = F.xxhash64(F.coalesce(docs[key].cast("string"), F.lit("-")), docs[text])
    return docs.join(leaks, row_key == leaks["_leak"], "left_anti")
