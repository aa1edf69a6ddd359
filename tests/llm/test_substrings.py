import hashlib
import random

from tremolo.llm.substring_dedup import remove_repeats


def _brute(docs, length):
    seen, out = {}, {}
    for i, t in sorted(docs):
        w = t.split()
        gone = set()
        for p in range(len(w) - length + 1):
            first = seen.setdefault(tuple(w[p : p + length]), i)
            if first < i:
                gone.update(range(p, p + length))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out[i] = len(w), len(gone), " ".join(kept)
    return out


def _spliced(r, n):
    pool = [[f"w{r.randint(0, 40)}x{r.randint(0, 40)}" for _ in range(r.randint(40, 160))] for _ in range(25)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(pool)
            a = r.randint(0, len(p) - 1)
            parts += p[a : a + r.randint(1, 120)] + ([f"u{r.randint(0, 10**6)}"] if r.random() < 0.5 else [])
        docs.append((i, " ".join(parts)))
    return docs


def test_factors_and_cuts_equal_brute_force(spark):
    docs = _spliced(random.Random(11), 800)
    want = _brute(docs, 50)
    got = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), with_text=True, with_factors=True).collect()
    texts = {i: t.split() for i, t in docs}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == want
    assert all(r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in got)
    factors = [(r.doc_id, f) for r in got for f in r.factors]
    assert len(factors) > 100 and max(f.n_words for _, f in factors) > 60
    for i, f in factors:  # each factor stands in its reference, word for word
        assert f.reference < i and f.n_words >= 50
        assert texts[i][f.start : f.start + f.n_words] == texts[f.reference][f.position : f.position + f.n_words]


def test_rows_without_a_key_keep_their_text(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, "one two  three four five", "x"), (None, None, "x"), (1, text, "y"), (None, text, "z"), (2, text, "z"), (2, "other words", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(docs, with_text=True).collect()), key=str)
    assert got == sorted([(None, 5, 0, "one two three four five"), (None, 0, 0, ""), (1, 80, 0, text), (None, 80, 0, text), (2, 80, 80, ""), (2, 2, 0, "other words")], key=str)
