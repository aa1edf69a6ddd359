"""Toxicity by compression distance between two zstandard dictionaries."""

from __future__ import annotations

import hashlib
import math
import pickle
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm.base import MEMO, claim, tidy, train_fold, words
from tremolo.llm.fit import lasso_logistic, sigmoid

#: Labelled rows of each class to fit on, at most; neither they nor what is scored is cut by length.
SAMPLE_ROWS = 4_000
#: Texts of each class that the dictionaries need at least, else the score is a constant.
LEAST_TEXTS = 5
#: Bytes of a dictionary of up to so many marked words, and bytes for each further one.
DICT_BYTES, DICT_WORDS, WORD_BYTES = 1024, 40, 96
LEVEL = 9
#: A window is one word, written this often: then a match in the dictionary shows in the length.
REPEATS = 6
#: Bytes that don't belong to a word when they stand at its ends.
TRIM = b".,;:!?\"'()[]{}*#$%&|"
#: Windows in a training sample, and bytes of a segment of the dictionary.
PER_SAMPLE, SEGMENT = 16, 48


def window(word: bytes) -> bytes:
    return b" ".join([b"", *[word] * REPEATS, b""])


def windows(text: str | None) -> list[bytes]:
    """The words of a text in lower case (A-Z), without marks at their ends."""
    return [w for x in words(text) if (w := x.lower().strip(TRIM))]


@dataclass
class ToxicityModel:
    """Two dictionaries, the log odds of (word length, window length, gain), and a logistic on their sums."""

    toxic: bytes
    ordinary: bytes
    odds: dict[tuple[int, int, int], float]
    least: float
    intercept: float
    weights: tuple[float, ...]

    def __post_init__(self):
        self.memo: dict[bytes, float] = {}
        if self.toxic:
            make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False)
            self.compressors = make(self.toxic), make(self.ordinary)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "compressors")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def cell(self, word: bytes) -> tuple[int, int, int]:
        """Length class of a word, its window's length under the toxic dictionary, and the gain in bytes."""
        data = window(word)
        toxic, ordinary = (len(c.compress(data)) for c in self.compressors)
        return min(len(word), 16), toxic, ordinary - toxic

    def evidence(self, word: bytes) -> float:
        """Log odds of a window if they reach the calibrated threshold, else 0."""
        if len(self.memo) >= MEMO:
            self.memo.clear()
        odds = self.odds.get(self.cell(word), 0.0)
        out = self.memo[word] = odds if odds >= self.least else 0.0
        return out

    def features(self, text: str | None) -> list[float]:
        if not self.toxic:
            return [0.0] * 4
        ws, memo = windows(text), self.memo
        found = [memo[w] if w in memo else self.evidence(w) for w in ws]
        hits = [x for x in found if x]
        total = sum(hits)
        return [float(total > 0), math.log1p(total), math.log1p(len(hits)), 100 * total / (len(ws) + 20)]

    def score(self, text: str | None) -> float:
        return float(sigmoid(np.array(self.intercept + np.dot(self.weights, self.features(text)))))


def _contrast(a: int, of_a: int, b: int, of_b: int) -> float:
    """Log likelihood ratio of a rate above the common one, signed."""
    p, q, both = (a + 0.5) / (of_a + 1), (b + 0.5) / (of_b + 1), (a + b + 0.5) / (of_a + of_b + 1)
    return a * math.log(p / both) + b * math.log(q / both) if p > q else 0.0


def fit_texts(texts: list[str | None], labels: list[int], *, least_contrast: float = 12.0) -> ToxicityModel:
    """Trains both dictionaries and calibrates on the given texts; equal texts count once.

    The toxic dictionary is trained on the windows that toxic texts have much more often than
    ordinary ones, each as often as texts have it; the ordinary one on the windows of the others.
    Both grow with the number of marked windows, and the toxic one has every one of them.
    Half of the texts give the dictionaries, and the other half the log odds and the logistic, so
    that what the dictionaries know by heart doesn't count. With fewer than LEAST_TEXTS texts of a
    class in the first half, or too few windows to train on, the score is a constant, the share of
    toxic texts; small samples mark only the windows that are significant all the same.
    """
    seen: dict[str, int] = {}
    for t, y in zip(texts, labels, strict=True):
        seen[t or ""] = max(seen.get(t or "", 0), int(y))
    rows = sorted(seen.items(), key=lambda x: hashlib.blake2b(x[0].encode(), digest_size=8).digest())
    share = float(np.clip(np.mean([y for _, y in rows]) if rows else 0.0, 1e-3, 1 - 1e-3))
    nothing = ToxicityModel(b"", b"", {}, 0.0, math.log(share / (1 - share)), (0.0,) * 4)
    dfs = [Counter[bytes](), Counter[bytes]()]
    sizes = [0, 0]
    for t, y in rows[::2]:
        dfs[y].update(set(windows(t)))
        sizes[y] += 1
    if min(sizes) < LEAST_TEXTS:
        return nothing
    marked = {w: c for w, c in dfs[1].items() if c >= 3 and _contrast(c, sizes[1], dfs[0][w], sizes[0]) >= least_contrast}
    usual = {w: min(c, 50) for w, c in dfs[0].items() if c >= 3 and w not in marked}
    order = lambda w: hashlib.blake2b(w, digest_size=8).digest()

    size = DICT_BYTES + WORD_BYTES * max(0, len(marked) - DICT_WORDS)

    def train(of: dict[bytes, int]) -> bytes:
        stream = sorted((w for w, c in of.items() for _ in range(c)), key=order)
        stream = [w for i in range(PER_SAMPLE) for w in stream[i::PER_SAMPLE]]  # copies of a word go to different samples
        samples = [b" " + b"  ".join(stream[i : i + PER_SAMPLE]) + b" " for i in range(0, len(stream), PER_SAMPLE)]
        samples = samples[:: max(1, len(samples) // 20_000)]
        return zstandard.train_dictionary(size, samples * max(1, 200 // max(1, len(samples))), k=SEGMENT, d=6).as_bytes()

    try:
        toxic = train(marked)
        # The trainer leaves words out; what follows a dictionary's tables is content, so they are put at its end.
        left = sorted((w for w in marked if b" " + w + b" " not in toxic), key=order)
        model = ToxicityModel(toxic + (b" " + b"  ".join(left) + b" " if left else b""), train(usual), {}, 0.0, 0.0, (0.0,) * 4)
    except zstandard.ZstdError:  # too few windows to train on
        return nothing
    cells = [Counter[tuple[int, int, int]](), Counter[tuple[int, int, int]]()]
    known: dict[bytes, tuple[int, int, int]] = {}
    held = rows[1::2]
    for t, y in held:
        for w in set(windows(t)):
            if w not in known:
                known[w] = model.cell(w)
            cells[y][known[w]] += 1
    totals = [sum(c.values()) + 1 for c in cells]
    odds = {k: math.log((n + 0.5) / totals[1]) - math.log((cells[0][k] + 0.5) / totals[0]) for k, n in cells[1].items() if k[2] > 0 and n >= 3}
    y = np.array([y for _, y in held], float)
    best = None
    for least in (0.5, 1.0, 1.5, 2.0, 2.5, 3.0):  # the threshold that separates the calibration half best
        model.odds, model.least, model.memo = odds, least, {}
        x = np.array([model.features(t) for t, _ in held])
        b, w = lasso_logistic(x, y, 0.0, 1e-4, 1500)
        p = np.clip(sigmoid(b + x @ w), 1e-6, 1 - 1e-6)
        loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
        if best is None or loss < best[0]:
            best = loss, least, b, tuple(map(float, w))
    model.memo, model.least, model.intercept, model.weights = {}, *best[1:]
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fits on at most sample_rows labelled documents of each class, of the train fold only.

    They are those with the smallest hash of their id, with whole texts; of several rows with one id
    the least text counts. Null texts count as empty ones; null ids and labels don't count.
    """
    known = labels.where(labels[key].isNotNull() & labels[label].isNotNull() & train_fold(labels[key])).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    chosen = [known.where(F.col("y") == c).orderBy(F.xxhash64("k"), "k").limit(sample_rows) for c in (0, 1)]
    rows = docs.select(docs[key].alias("k"), docs[text].alias("t")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "k").groupBy("k", "y").agg(F.min("t").alias("t")).collect()
    return fit_texts([r.t for r in rows], [r.y for r in rows])


@lru_cache(2)
def _load(data: bytes) -> ToxicityModel:
    return pickle.loads(data)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, *, text: str = "text", key: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """One row per input row: key as doc_id, held_out, score and predicted (score >= threshold).

    Each word of the whole text is a window. Null, empty and blank texts have no window and get the
    score of no evidence. Null keys give a null held_out; repeated rows stay; other columns are
    ignored; an empty table gives an empty result. The model grows with the marked
    words of the labelled sample (WORD_BYTES each), not with the input.
    """
    data = pickle.dumps(model)

    def run(batches):
        own = _load(data)
        claim(own.memo, forget=_load.cache_clear)
        for batch in tidy(batches):
            scores = [own.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    source = docs.select(docs[key].alias("doc_id"), docs[text].alias("t"))
    kind = source.schema["doc_id"].dataType.simpleString()
    out = source.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (~train_fold(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: ToxicityModel, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below threshold."""
    data = pickle.dumps(model)

    def run(batches):
        own = _load(data)
        claim(own.memo, forget=_load.cache_clear)
        for batch in tidy(batches):
            at = batch.schema.get_field_index(text)
            keep = pa.array([own.score(t.as_py()) < threshold for t in batch.column(at)], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(run, docs.schema)
