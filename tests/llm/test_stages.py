"""Operators and pipeline stages without SQL against brute force."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tremolo.llm import queries

SF = "/root/testdata/sf0.01"


def test_urls_odd_rows(spark):
    from tremolo.llm.url_filter import judge_urls

    long = "http://a.example.org/es/" + "x" * 200_000
    rows = [(1, "http://EXAMPLE.org/es/", "h", "r")] * 3 + [(None, None, None, None), (2, "", "h", ""), (3, long, "h", "r"), (4, "://", "", ""), (5, "http://.org/", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")  # names clash with our own
    got = judge_urls(pages, queries.RULES, queries.BLOCKLIST).collect()
    assert [(r.host, r.rule, r.verdict) for r in got if r.page_id == 1] == [("example.org", "example.org/es/", "block")] * 3
    assert {(r.page_id, r.host, r.verdict) for r in got if r.page_id in (None, 2, 4)} == {(None, "", "allow"), (2, "", "allow"), (4, "", "allow")}
    assert [r.path == long[len("http://a.example.org") :] and r.verdict for r in got if r.page_id == 3] == ["block"] and [r.rule for r in got if r.page_id == 5] == ["org/"]
    assert judge_urls(pages.limit(0), queries.RULES).count() == 0 and judge_urls(pages, []).where("verdict = 'allow'").count() == len(rows)


def test_lists_can_be_tables(spark, tmp_path):
    from tremolo.llm import url_filter

    r = random.Random(8)
    entries = [(f"H{r.randint(0, 300)}.org" + r.choice(["", "/", "/a/", f"/{r.randint(0, 9)}"]), r.choice(["allow", "block"])) for _ in range(2000)]
    table = spark.createDataFrame([*entries, (None, "block")], "entry string, verdict string").repartition(5)
    one, two = (open(f(x, f"{tmp_path}/{f.__name__}"), "rb").read() for f, x in ((url_filter.build_index, entries), (url_filter.write_index, table)))
    assert one == two and len(one) > 5000
    pages = spark.createDataFrame([(i, f"http://h{i % 310}.org/{i % 11}") for i in range(900)], "page_id long, url string")
    want = url_filter.judge_urls(pages, entries, ["h305.org", "h9.org/3"])
    got = url_filter.judge_urls(pages, table, spark.createDataFrame([("h305.org",), ("h9.org/3",)], "entry string"))
    assert sorted(map(str, want.collect())) == sorted(map(str, got.collect()))


def test_values_beside_marks_are_found_at_every_place(spark):
    """Verbatim copies of items with digits behind / : . , - + and of the same with other values."""
    from tremolo.llm.decontaminate import find_leaks

    r, marks, docs, want = random.Random(5), ["/", ":", ".", ",", "-", "+", " ", "", "(", "="], [], set()
    plain = "of all the trains that leave here each day some go north and others go south until they stop again".split()
    items = []
    for i in range(24):
        w = r.sample(plain, 14)
        m = marks[i % len(marks)]
        for p in r.sample(range(1, 13), 3):
            w[p] = f"{w[p]}{m}{r.randint(1, 99)}{r.choice(['', '.5', ',000', ':30', '/2'])}"
        items.append((i, " ".join(w)))
        other = re.sub(r"\d+", lambda x, r=r: str(int(x[0]) + 100 + r.randint(1, 9)), items[-1][1])
        for offset in range(8):
            filler = " ".join(f"q{r.randint(0, 10**6)}" for _ in range(offset))
            for text in (items[-1][1], other) if m else (items[-1][1],):  # digits glued to a word are part of it
                docs.append((len(docs), f"{filler} {text} z{r.randint(0, 10**6)} and on"))
                want.add((len(docs) - 1, i))
    docs += [(10_000 + i, " ".join(r.sample(plain, 14))) for i in range(20)]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert want <= {(x.doc_id, x.item_id) for x in got}
    assert all(x.doc_id < 10_000 for x in got)


def test_compiled_rules_equal_the_model(spark):
    from tremolo.llm.rule_quality import STATISTICS, fit_quality, quality_scores, with_statistics

    docs, labels = (queries.table(spark, SF, n) for n in ("documents", "labels"))
    model = fit_quality(docs, labels)
    rows = with_statistics(docs.select("doc_id", F.col("text").alias("t")), "t").orderBy("doc_id").toPandas()
    want = model.predict(rows[[f"s_{k}" for k in STATISTICS]].to_numpy(float))
    got = quality_scores(docs, model).orderBy("doc_id").toPandas()
    assert model.rules and np.allclose(got["score"], want) and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    again = fit_quality(docs.unionByName(docs).repartition(5), labels)  # repeated rows change nothing
    assert again == model


def test_statistics_by_hand(spark):
    from tremolo.llm.rule_quality import STATISTICS, with_statistics

    texts = ["Ab c1 c1!\nAb c1 c1!\nx#é.", "", None, " \n "]
    got = with_statistics(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t").orderBy("i").collect()
    one = dict(zip(STATISTICS, [got[0][f"s_{k}"] for k in STATISTICS], strict=True))
    assert one["n_words"] == 7 and one["word_length"] == 18 / 7 and one["distinct_words"] == 4 / 7 and one["repeated_lines"] == 1 - 2 / 3
    assert one["capitals"] == 2 / 18 and one["digits"] == 4 / 18 and one["symbols"] == 1 / 18 and one["shouts"] == 2 / 7 and one["stops"] == 1 / 7
    assert all(got[i][f"s_{k}"] == 0 for i in (1, 2, 3) for k in STATISTICS)


def test_many_names_and_a_full_space_of_addresses(spark):
    from tremolo.llm.pii import replace_pii

    names = ["B" + "".join("aeioulnrst"[int(c)] for c in f"{i:04}") for i in range(5000)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    docs = [(i, f"Mrs {x} Miller said") for i, x in enumerate(names)] + [(10_000 + i, f"write {c}@x.org now") for i, c in enumerate(letters)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in replace_pii(table, secret="one").collect()}
    new = [got[i].split(" ")[1] for i in range(5000)]
    assert len(set(new)) == 5000 and not set(new) & set(names) and len({got[i].split(" ")[2] for i in range(5000)}) == 1
    mails = [got[10_000 + i].split(" ")[1] for i in range(26)]
    assert len(set(mails)) == 26 and not {f"{c}@x.org" for c in letters} & set(mails) and all(re.fullmatch(r"[a-z]+@[a-z]\.org", m) for m in mails)
    other = {r.doc_id: r.text for r in replace_pii(table.where("doc_id < 20"), secret="two").collect()}
    assert {r.doc_id: r.text for r in replace_pii(table, secret="one").collect()} == got and all(other[i] != got[i] for i in range(20))


def test_the_key_is_a_setting(spark):
    from tremolo.llm import pii

    docs = spark.createDataFrame([(1, "mail a.person@some.org or +49 30 1234 5678", "n", "m")], "doc_id long, text string, n string, made string")
    drawn = pii.replace_pii(docs).first()
    assert drawn == pii.replace_pii(docs).first() and drawn.n == "n" and drawn.made == "m"  # one key an application
    spark.conf.set(pii.SECRET, "given")
    assert pii.replace_pii(docs).first() == pii.replace_pii(docs, secret="given").first() != drawn
    spark.conf.unset(pii.SECRET)


def _components(texts, k, num, den):
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))} if w else set()
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        common = {}
        for x in s:
            for j in by[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if n * den >= num * (len(s) + len(sets[j]) - n) and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as p
    from tremolo.llm.pii import ANY, PATTERNS
    from tremolo.llm.toxicity import fit_toxicity

    docs = queries.table(spark, SF, "documents")
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    before = texts(docs)
    kept = {}
    for name, stage in p.STAGES[:4]:
        docs = p.Workspace(spark).save(stage(spark, docs, SF), name)
        kept[name] = texts(docs)
    model = fit_toxicity(queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels"))
    assert set(kept["toxicity"]) == {i for i, t in before.items() if model.score(t) < 0.7} and set(kept["toxicity"]) != set(before)
    root = _components(kept["toxicity"], 5, 80, 100)
    assert set(kept["near_dedup"]) == {i for i in root if root[i] == i} and len(kept["near_dedup"]) < len(root)
    flat = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    items = [flat(r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    holds = {i for i, t in kept["near_dedup"].items() if any(x in flat(t) for x in items)}
    gone = set(kept["near_dedup"]) - set(kept["decontamination"])
    windows = {x[k : k + 1] and " ".join(x.split()[k : k + 8]) for x in items for k in range(len(x.split()) - 7)}
    assert holds and holds <= gone and all(any(w in flat(kept["near_dedup"][i]) for w in windows) for i in gone - holds)
    assert set(kept["personal_data"]) == set(kept["decontamination"])
    found = lambda t: re.findall("@[A-Za-z0-9-]+\\.|" + r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", t or "")
    for i, t in kept["decontamination"].items():
        new = kept["personal_data"][i]
        assert len(found(t)) == len(found(new)) and (t != new or not found(t))
    assert len(PATTERNS) == 8 and ANY
    out = {r.doc_id: r for r in p.STAGES[4][1](spark, docs, SF).collect()}
    lib = Tokenizer.from_file(queries.VOCABULARY)
    assert set(out) == set(kept["personal_data"])
    for i, t in kept["personal_data"].items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (out[i].n_tokens, out[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
