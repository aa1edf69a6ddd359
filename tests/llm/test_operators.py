import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import difference
from pyspark.sql import functions as F

from tremolo.llm import queries

SF = "/root/testdata/sf0.001"
VOCABULARY = queries.VOCABULARY


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF) == ""


def rows(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


# Odd rows: each operator gives a row a row and defined values.


def test_odd_rows_minhash(odd, none):
    from tremolo.llm.minhash import near_duplicates

    out = near_duplicates(odd)
    got = rows(out, "doc_id", "component_id", "kept")
    assert got[(1, 1, True)] == 2 and got[(2, 1, False)] == 1 and got[(9, 6, False)] == 1 and got[(8, 7, False)] == 1
    assert all(got[(i, i, True)] == 1 for i in (3, 4, 5)) and sum(got.values()) == 12
    assert near_duplicates(none).count() == 0


def test_odd_rows_substrings(odd, none):
    from tremolo.llm.substring_dedup import remove_repeats

    got = {r.doc_id: r for r in remove_repeats(odd).collect()}
    assert got[9].n_removed == 20_000 and got[6].n_removed == 0 and got[3].n_words == 0
    assert got[9].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert remove_repeats(odd).count() == 12 and remove_repeats(none).count() == 0


def test_odd_rows_quality_rules(odd, none):
    from tremolo.llm.quality_rules import quality_rules

    got = quality_rules(odd).collect()
    assert len(got) == 12 and all(r.base_failed and not r.kept for r in got if r.doc_id in (3, 4, 5, 7))
    assert all(r.kept for r in got if r.doc_id in (1, 2, 6)) and quality_rules(none).count() == 0


def test_frequent_lines_deplete(spark):
    from tremolo.llm.quality_rules import quality_rules

    line = "all rights reserved by the owners of this page and of every other page they have ever made for you"
    docs = [(i, f"{line} \n{line.upper()} 7\nunique {i} word", "h") for i in range(25)] + [(99, f"{line}\n" + " ".join(f"w{j}" for j in range(80)), "h"), (100, line + " and so on to the end of it", "other")]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert not got[0].kept and got[99].kept and got[99].n_removed_words == 20 and got[100].n_removed_words == 0


def test_copies_are_documents(spark):
    from tremolo.llm.quality_rules import quality_rules

    text = "all of this is one and the same text that very many pages of a host have copied word for word again"
    docs = [(i, text, "many") for i in range(21)] + [(i, text, "few") for i in range(100, 120)] + [(200, text, "rows")] * 30 + [(None, text, "none")] * 21
    got = {(r.doc_id, r.kept) for r in quality_rules(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert got == {(i, False) for i in range(21)} | {(i, True) for i in range(100, 120)} | {(200, True), (None, False)}


def test_odd_rows_bpe(odd, none):
    from tremolo.llm.bpe import bpe_decode, bpe_digests, bpe_encode, load

    got = rows(bpe_digests(odd, VOCABULARY), "doc_id", "n_tokens")
    assert got[(3, 0)] == got[(4, 0)] == 1 and got[(1, len(load(VOCABULARY).encode(queries_prose(odd))))] == 2
    back = bpe_decode(bpe_encode(odd, VOCABULARY), VOCABULARY)
    assert back.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0 and back.count() == 12
    assert bpe_digests(none, VOCABULARY).count() == 0


def queries_prose(odd):
    return odd.where("doc_id = 1").first().text


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    from tremolo.llm.bpe import load

    lib, own, r = Tokenizer.from_file(VOCABULARY), load(VOCABULARY), random.Random(5)
    letters = [chr(c) for c in range(0x2100) if not 0xD800 <= c < 0xE000] + ["<|endoftext|>", "  ", "\n\n", "'ll", "'s", "😀", "x" * 40]
    for _ in range(400):
        t = "".join(r.choices(letters, k=r.randint(0, 50)))
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_transducer_streams():
    from tremolo.llm.bpe import load

    own, r = load(VOCABULARY), random.Random(6)
    for n in (1, 5, 300, 2000):
        piece = "".join(r.choices("thean", k=n)).encode()
        assert list(own.transduce(iter([piece[i : i + 7] for i in range(0, n, 7)]))) == [own.ids[t] for t in own.merge(piece)]
    assert own.longest < own.lookahead < 5000


def test_near_duplicates_brute_force(spark):
    from tremolo.llm.minhash import near_duplicates

    r = random.Random(1)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
    docs = []
    for i in range(320):  # one family that doesn't fit a block, edited more and more
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            w[r.randrange(len(w))] = f"n{r.randint(0, 10**9)}"
        docs.append((i, " ".join(w)))
    sets = {i: frozenset(zip(t.split(), t.split()[1:], t.split()[2:])) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            k = len(sets[i] & sets[j])
            if 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=3, threshold=(85, 100))
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: find(i) for i in sets}


def test_toxicity_held_out(spark, odd, none):
    from tremolo.llm.toxicity import fit_toxicity, reject_toxic, toxicity_scores

    docs, labels = (queries.table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    model = fit_toxicity(docs, labels)
    out = toxicity_scores(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out")
    n = {tuple(r)[:2]: r[2] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert n[(1, 1)] / (n[(1, 1)] + n.get((1, 0), 0)) > 0.75 and n.get((0, 1), 0) < 0.01 * n[(0, 0)]
    got = toxicity_scores(odd, model).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert reject_toxic(odd, model).count() == 12 and toxicity_scores(none, model).count() == 0
    assert fit_toxicity(none, labels).score("anything") < 0.7


def test_quality_held_out(spark, odd, none):
    from tremolo.llm.rule_quality import fit_quality, quality_scores

    docs, labels = (queries.table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    model = fit_quality(docs, labels)
    out = quality_scores(docs, model).join(labels.select("doc_id", "quality"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.97
    assert len(quality_scores(odd, model).where("score between 0 and 1").collect()) == 12 and quality_scores(none, model).count() == 0
    x = np.array([[1.0] * 11])
    assert 0 <= model.predict(x)[0] <= 1


def test_url_rules(spark):
    from tremolo.llm.url_filter import judge_urls

    urls = ["http://A.Example.ORG/es/x", "https://example.org/en/12?q", "http://myexample.org", "http://b.com/fr/1#x", "http://b.com/de/", "nothing", None, "http://spam.com/", "http://x.org?p"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.RULES, ["spam.com"]).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block")
    assert got[2] == ("myexample.org", "", None, "allow") and got[3][2:] == ("com/fr/", "allow") and got[4][3] == "block"
    assert got[5] == got[6] == ("", "", None, "allow") and got[7][3] == "block" and got[8][2] is None


def test_digest_collisions(tmp_path):
    from tremolo.llm import url_filter

    path = url_filter.build_index([("a.com/", "block"), ("b.com/", "allow")], str(tmp_path / "i"))
    index = url_filter.DigestArray(path)
    assert index.probe(["a.com/", "b.com/", "c.com/"]) == [True, False, None]
    index.keys = np.full(2, url_filter.xxhash.xxh64_intdigest(b"c.com/"), np.uint64)  # as if both collided with it
    assert index.probe(["c.com/"]) == [None]


def test_warc_round_trip(spark, tmp_path):
    from tremolo.llm.warc import read_warc, write_warc

    big = "x" * 2000
    pages = spark.createDataFrame([(1, "http://a/", big), (2, None, big), (3, "http://c/", "é"), (4, "http://d/", None), (5, "http://e/\r\n", big), (5, "http://e/", big), (None, "http://n/", big)], "page_id long, url string, html string")
    uri = f"file://{tmp_path}/w"
    manifest = write_warc(pages, uri, roll_bytes=200).collect()
    assert sum(m.records for m in manifest) == 7 and len(manifest) > 2
    got = read_warc(spark, uri).collect()
    assert all(r.block_ok for r in got)
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == Counter({(1, "revisit", 5, 2000): 1, (2, "revisit", 5, 2000): 1, (3, "response", None, 2): 1, (4, "response", None, 0): 1, (5, "response", None, 2000): 2, (None, "revisit", 5, 2000): 1})
    again = write_warc(pages.repartition(5), f"file://{tmp_path}/v", roll_bytes=200).collect()
    assert {m.sha256 for m in again} == {m.sha256 for m in manifest}
    assert write_warc(pages.limit(0), f"file://{tmp_path}/e").count() == 0


def test_templates(spark, odd, none):
    from tremolo.llm.decontaminate import decontaminate, find_leaks

    items = spark.createDataFrame([(1, "A train leaves Paris at 60 km per hour and another at 80 km per hour meets it after how many hours when 60 is doubled"), (2, None), (3, "")], "item_id long, text string")
    ask = "Note that A train leaves Berlin at {} km per hour and another at {} km per hour meets it after how many hours when {} is doubled indeed"
    docs = spark.createDataFrame([(1, ask.format(60, 80, 60)), (2, ask.format(25, 95, 25)), (3, ask.format(25, 95, 31)), (4, "a train leaves at noon"), (None, ask.format(1, 2, 1)), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in find_leaks(docs, items).collect()}
    assert set(got) == {1, 2, None} and got[2].n_changed > 0 and {r.doc_id for r in decontaminate(docs, items).collect()} == {3, 4, 5}
    assert find_leaks(odd, items).count() == 0 and find_leaks(none, items).count() == 0 and decontaminate(odd, items.limit(0)).count() == 12


def test_leaks_brute_force(spark):
    docs, items = (queries.table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "benchmark"))
    flat = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    texts = {r.doc_id: flat(r.text) for r in docs.collect()}
    want = {(d, i.item_id) for i in items.collect() for d, t in texts.items() if flat(i.text) in t}
    got = {(r.doc_id, r.item_id) for r in queries.op6_templates(spark, "/root/testdata/sf0.01").collect()}
    assert want and want <= got and all(any(w in texts[d] for w in _runs(flat, items, i)) for d, i in got - want)


def _runs(flat, items, item):
    w = flat(items.where(F.col("item_id") == item).first().text).split()
    return [" ".join(w[k : k + 8]) for k in range(len(w) - 7)]


def test_surrogates(spark, odd, none):
    from tremolo.llm.pii import replace_pii

    text = "Mr. John Smith (a.b@c.org, +1 (212) 555-0188) met Mrs Smith; card 4111111111111111, host 10.1.2.3, key = 'ab12ab12ab12ab12ab12ab12ab12'."
    docs = spark.createDataFrame([(1, text), (2, "write to a.b@c.org or d.e@f.org"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in replace_pii(docs, count="n").collect()}
    assert got[1].n == 7 and got[2].n == 2 and got[3].text is None
    assert not any(x in got[1].text for x in ("John", "Smith", "a.b@", "555-0188", "4111111111111111", "10.1.2.3", "ab12ab12"))
    mail = re.search(r"\((\S+@\S+\.org)", got[1].text)[1]
    assert mail in got[2].text and len(set(re.findall(r"\S+@\S+", got[2].text))) == 2
    surname = re.search(r"Mrs (\w+)", got[1].text)[1]
    assert re.search(rf"Mr\. \w+ {surname} ", got[1].text) and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1].text)
    digits = [int(c) for c in re.search(r"card (\d{16})", got[1].text)[1]]
    assert sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert rows(replace_pii(odd), *odd.columns) == rows(odd, *odd.columns) and replace_pii(none).count() == 0


def test_pipeline_stages(spark, odd, none):
    import corpus_pipeline as p

    docs, seen = queries.table(spark, SF, "documents"), []
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        n = out.count()
        seen.append(n)
        if name != "tokens":
            assert out.columns == docs.columns
            docs = out
    assert seen == sorted(seen, reverse=True) and seen[-1] > 100
    for name, stage in p.STAGES:
        assert stage(spark, odd, SF).count() == {"near_dedup": 8}.get(name, 12)
        assert stage(spark, none, SF).count() == 0


NUMBERS = ["3.75", "1,200", "12:30", "1/2", "-5", "+7", "60 km", "2.5kg", "3rd", "x5", "a1.2", "10-4", ".5", "(7)", "5.", "Apollo11", "é7", "1.2.3,4"]


def test_numbers_are_one_slot(spark):
    from tremolo.llm.decontaminate import _canonical, find_leaks, template, tokens

    r = random.Random(3)
    texts = [" ".join(r.choices([*NUMBERS, "Paris", "the", "sum,", "of", "--"], k=12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(template(F.col("t")) != _canonical(tokens(F.col("t")))).count() == 0
    forms = ["The value {} is added to {} and the sum is halved", "They start at {} and walk {} of the way before it is too late"]
    values = [[("3.75", "1,200"), ("4.20", "2,317.5")], [("12:30", "1/2"), ("9:05", "-3/4")]]
    items = spark.createDataFrame([(i, f.format(*v[0])) for i, (f, v) in enumerate(zip(forms, values, strict=True))], "item_id long, text string")
    docs = [(10 * i + j, f"So it goes. {f.format(*x)} indeed") for i, (f, v) in enumerate(zip(forms, values, strict=True)) for j, x in enumerate(v)]
    got = {(r.doc_id, r.item_id, r.n_changed) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(0, 0, 0), (1, 0, 2), (10, 1, 0), (11, 1, 2)}


def test_windows_of_few_literals_count(spark):
    from tremolo.llm.decontaminate import find_leaks

    ask = "Compute {} + 7 + 9 + {} + 5 and then divide by 3"
    far = "we sum 1 2 3 4 5 6 7 8 over all the given parts in turn 1 2 3 4 5 6 7 8 9"
    items = spark.createDataFrame([(1, ask.format(12, 4)), (2, "1 2 3 4 5 6 7 8 9 and so on"), (3, far)], "item_id long, text string")
    texts = [ask.format(12, 4), "Say " * 3 + ask.format(31, 6), ask.format(12, 4)[:30], "1 2 3 4 5 6 7 8 9 and so on"]
    texts += ["x " * k + "3 4 5 6 7 8 over all the given parts in turn" for k in range(7)]  # a run of 13 tokens at any place
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in find_leaks(docs, items).collect()}
    assert set(got) == {(0, 1), (1, 1)} | {(4 + k, 3) for k in range(7)}
    assert got[1, 1].n_windows == got[1, 1].item_windows == 4 and got[1, 1].n_changed == 2 and got[1, 1].position == 3


def test_surrogates_do_not_run_out(spark):
    from tremolo.llm.pii import replace_pii

    names = ["B" + "".join("aeioulnrst"[int(c)] for c in f"{i:04}") for i in range(1200)]
    docs = [(i, f"Mr {x} Miller") for i, x in enumerate(names)] + [(5000, "mail %@-.- now")] + [(6000 + i, f"call +1 {i:02} 12") for i in range(100)]
    got = {r.doc_id: r.text for r in replace_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    new = [got[i].split(" ")[1] for i in range(len(names))]
    assert len(set(new)) == len(names) and not set(new) & set(names) and len({got[i].split(" ")[2] for i in range(len(names))}) == 1
    assert re.fullmatch(r"mail [a-p]+%@-\.- now", got[5000]) and len({got[6000 + i] for i in range(100)}) == 100


def test_toxicity_of_many_words():
    from tremolo.llm.toxicity import fit_texts

    r = random.Random(8)
    made = sorted({"".join(r.choice("bcdfghklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(2, 5))) for _ in range(3000)})
    r.shuffle(made)
    toxic, usual = made[:400], made[400:2000]
    texts = [" ".join(r.choices(usual, k=30) + (r.choices(toxic, k=8) if i % 2 else [])) for i in range(6000)]
    model = fit_texts(texts, [i % 2 for i in range(6000)])
    hit = lambda ws: sum(model.evidence(w.encode()) > 0 for w in ws) / len(ws)
    assert hit(toxic) > 0.9 and hit(usual) < 0.05, (hit(toxic), hit(usual))
