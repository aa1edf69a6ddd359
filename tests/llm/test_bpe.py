import hashlib
import random
import tracemalloc

from tokenizers import Tokenizer

from tremolo.llm import bpe, queries


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.01"
    lib, want = Tokenizer.from_file(queries.VOCABULARY), {}
    for r in queries.table(spark, sf, "documents").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op9_bpe(spark, sf).collect()}
    assert got == want


def test_pairs_equal_the_merge_loop():
    own, r = bpe.load(queries.VOCABULARY), random.Random(1)
    tokens = list(own.ids)
    short = [t for t in tokens if len(t) < 4]
    for i in range(20_000):
        a, b = r.choice(tokens if i % 2 else short), r.choice(tokens if i % 3 else short)
        assert own.pair(own.ids[a], own.ids[b]) == (own.merge(a + b) == [a, b])


def test_blocks_of_any_script(monkeypatch):
    own, lib, r = bpe.load(queries.VOCABULARY), Tokenizer.from_file(queries.VOCABULARY), random.Random(2)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 40)
    monkeypatch.setattr(bpe, "STREAM_CHARS", 16)
    letters = [chr(c) for c in range(0x2100) if not 0xD800 <= c < 0xE000] + ["<|endoftext|>", "  ", "\n\n", "'ll", "'s", "'", "😀", "x" * 90, " " * 300, "的" * 150, "7" * 200, "é" * 100]
    for _ in range(300):
        t = "".join(r.choices(letters + list("abc12 ") * 200, k=r.randint(0, 2000)))
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids


def test_long_pieces_need_little_memory():
    own, r = bpe.load(queries.VOCABULARY), random.Random(3)
    lib = Tokenizer.from_file(queries.VOCABULARY)
    for text in ("".join(chr(r.randint(0x4E00, 0x9FA0)) for _ in range(200_000)), "".join(r.choices("0123456789", k=400_000))):
        own.pairs.clear()
        tracemalloc.start()
        n = sum(map(len, own.encode_blocks(text)))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        own.pairs.clear()
        assert n == len(lib.encode(text, add_special_tokens=False).ids) and most < 48 << 20, most
