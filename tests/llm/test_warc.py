import random

from tremolo.llm.warc import current, manifest, read_warc, write_warc


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_same_files_however_partitioned(spark, tmp_path):
    r = random.Random(4)
    texts = ["".join(r.choices("abcdefgh ", k=r.choice([10, 1500, 4000]))) for _ in range(900)]
    rows = [(i, f"http://h/{i}", r.choice(texts)) for i in range(2500)]
    r.shuffle(rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    uri = f"file://{tmp_path}/a"
    first = _rows(write_warc(pages, uri, shard_bytes=200_000, roll_bytes=60_000))
    folder = current(uri)
    assert len({m[0] for m in first}) > 5 and len(first) > len({m[0] for m in first}) and sum(m[2] for m in first) == 2500
    # Again to the same place, and from other partitions: equal manifests, the old commit untouched.
    assert _rows(write_warc(pages.repartition(13), uri, shard_bytes=200_000, roll_bytes=60_000)) == first
    assert current(uri) != folder and _rows(manifest(spark, uri)) == first
    assert _rows(write_warc(pages.orderBy("url").coalesce(1), f"file://{tmp_path}/b", shard_bytes=200_000, roll_bytes=60_000)) == first
    got = read_warc(spark, uri).collect()
    assert all(x.block_ok for x in got) and {x.page_id: x.url for x in got} == {i: u for i, u, _ in rows}
    # Files are ranges of keys, in order.
    ends = {}
    for x in got:
        lo, hi = ends.get(x.file, (x.page_id, x.page_id))
        ends[x.file] = min(lo, x.page_id), max(hi, x.page_id)
    spans = [ends[f] for f in sorted(ends)]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_odd_pages(spark, tmp_path):
    rows = [(7, "http://h/", "x" * 3000, "k", "d")] * 40 + [(None, None, None, None, None), (8, "http://h/8", "x" * 3000, "", ""), (-5, "", "", "u", "body")]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, d string, rep string")  # names clash with our own
    uri = f"file://{tmp_path}/odd"
    write_warc(odd, uri, shard_bytes=10_000)
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in read_warc(spark, uri).collect()]
    assert len(got) == 43 and got.count((7, "revisit", 8, 3000)) == 40 and (8, "response", None, 3000) in got and (None, "response", None, 0) in got
    none = f"file://{tmp_path}/none"
    assert write_warc(odd.limit(0), none).count() == 0 and read_warc(spark, none).count() == 0
