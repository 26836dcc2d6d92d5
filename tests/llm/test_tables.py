import base64
import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from itemforge.llm import mixing, topk, warc
from itemforge.llm.shared import fresh_dir, table
from tests.llm.common import DOCS, WORDS, documents, with_clashes


def filled(sizes, weights, cap):
    """Targets by repeated sharing: hand out what is left by weight, stop those at their cap, again."""
    total, fixed = float(sum(sizes)), {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        share = total - sum(fixed.values())
        level = {i: share * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if level[i] > cap * sizes[i]]
        if not over:
            return [fixed.get(i, level.get(i)) for i in range(len(sizes))]
        fixed |= {i: float(cap * sizes[i]) for i in over}


def test_mixing(spark):
    rows = documents(n=300) + [(50_000 + i, "tiny words here", "en", "zz", 1) for i in range(5)]
    got = mixing.systematic_mix(with_clashes(spark.createDataFrame(rows, DOCS).repartition(5))).collect()
    sizes, taken, docs = Counter(), Counter(), defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(names, filled([sizes[s] for s in names], [i % 3 + 1 for i in range(len(names))], 3)))
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.row.source] and abs(r.target - want[r.row.source]) < 1e-6 * max(1, r.target)
        assert r.size == len(WORDS.findall(r.row.text or "")) and 0 <= r.copies <= 3
        taken[r.row.source] += r.copies * r.size
        docs[r.row.source] = max(docs[r.row.source], r.size)
    for s in names:
        assert abs(taken[s] - want[s]) <= 3 * docs[s] + 1
    again = mixing.systematic_mix(spark.createDataFrame(rows[::-1], DOCS).repartition(3)).collect()
    assert Counter((r.row.doc_id, r.size, r.copies) for r in again) == Counter((r.row.doc_id, r.size, r.copies) for r in got)
    emitted = mixing.emit_mix(with_clashes(spark.createDataFrame(rows, DOCS)))
    assert emitted.columns == with_clashes(spark.createDataFrame([], DOCS)).columns and emitted.count() == sum(r.copies for r in got)


def test_mixing_without_words(spark):
    assert mixing.systematic_mix(spark.createDataFrame([], DOCS)).count() == 0
    got = mixing.systematic_mix(spark.createDataFrame([(1, None, None, None, None), (2, " ", None, "s", None)], DOCS)).collect()
    assert {(r.size, r.target, r.copies) for r in got} == {(0, 0.0, 0)}


def pages():
    rng = random.Random(3)
    rows = [(i, f"http://www.h{i % 7}.example.com/p/{i % 40}?b=2&a={i % 3}", f"<p>é {rng.randint(0, 25)}</p>\r\n\r\nWARC/1.0\r\n") for i in range(150)]
    return rows + [(900, None, None), (901, "", ""), (902, "not a url\r\nX: y", None), (903, "http://[bad", "x" * 200_000), (904, "https://a.b:443/", "x" * 200_000), rows[5], (None, "http://z/", "alone"),
                   (None, "http://z/", "")]


@pytest.mark.parametrize("least", [0, 30])
def test_archives(spark, least):
    rows, path = pages(), fresh_dir(spark, "test-archives")
    warc.write_archives(with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)), path, least_bytes=least, records_per_file=40)
    captures = warc.read_captures(spark, path)
    merged = warc.merge_runs(captures)
    response = {}
    for name, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= least and name is not None:
            response[payload] = max(name, response.get(payload, name))
    want = Counter()
    for name, url, html in rows:
        payload = (html or "").encode()
        refers = response.get(payload)
        refers = None if refers == name else refers
        want[name, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if refers is None else "revisit", refers] += 1
    found = merged.collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == want
    keys = [warc.order_key((r.url_key, r.captured, r.page_id)) for r in found]
    assert keys == sorted(keys)


def test_no_pages(spark):
    path = fresh_dir(spark, "test-archives")
    warc.write_archives(spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string").filter("page_id > 1"), path)
    assert warc.merge_runs(warc.read_captures(spark, path)).count() == 0


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/A?b=2&a=1#x") == "com,example)/a?a=1&b=2"
    assert warc.url_key("https://x.org:8443") == "org,x:8443)/"


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(((f"u{rng.randint(0, 5)}", "2020", rng.randint(0, 9)) for _ in range(rng.randint(0, 20))), key=warc.order_key) for _ in range(k)]
    assert list(warc.LoserTree(runs).merged()) == sorted((r for run in runs for r in run), key=warc.order_key)


def search_rows():
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(12) / 3).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(30)]
    return rows + [(1_000, None), (1_020, [1.0, None] * 6), (1_040, [float("nan")] * 12), (1_060, [0.0] * 12), (1_080, [1.0] * 3), (1_081, [2.0] * 3), (None, [1.0] * 12), (1_100, [])]


@pytest.mark.parametrize("block", [8_192, 90])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rows = search_rows()
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()))
    usable = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q, x in usable.items():
        if q % 20 == 0:
            scores = sorted((-int(x @ y), i) for i, y in usable.items() if i != q and len(x) == len(y))[:20]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert got == sorted(want)


def test_no_search_rows(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("name,sql", [("op3_mixing", mixing.SQL), ("op5_warc", warc.SQL), ("op7_topk", topk.SQL)])
def test_sql_twins(spark, name, sql):
    from itemforge.llm.queries import QUERIES
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.sql(sql)
    plain = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    got = QUERIES[name](spark, "/root/testdata/sf0.001").select(*want.columns).collect()
    assert Counter(map(plain, got)) == Counter(map(plain, want.fetchall()))


def test_pipeline_stages(spark):
    docs = spark.createDataFrame(documents(n=90), DOCS)
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_dir(spark, f"test-{name}")
        out = stage(spark, docs, "unused")
        if name != "bpe":
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.filter("not round_trip").count() == 0 and docs.count() > 0


def test_pipeline_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and table(spark, "/root/testdata/sf0.001", "documents").count() == 200
