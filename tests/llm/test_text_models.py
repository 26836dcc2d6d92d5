import random
import zlib

import numpy as np

from itemforge.llm import langid, quality
from tests.llm.common import DOCS, documents, prose, with_clashes


def languages(n=240):
    rng = random.Random(9)
    parts = {"en": ["the", "ing", "wh", "tion", "and"], "fr": ["eau", "oi", "é", "ç", "que"], "de": ["sch", "ung", "ü", "ß", "keit"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 60)))
        rows.append((i, text.upper() if i % 9 == 0 else text, lang, "s", None))
    return rows


def phrases(text, sample):
    """Cross-parsing of one lane, by substring search."""
    count, at = 0, 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at:at + size] in sample:
            size += 1
        at += max(1, size - 1)
        count += 1
    return count


def test_cross_parsing_equals_substring_search():
    rng = random.Random(2)
    samples = {"a": [prose(rng, 200)], "b": ["".join(rng.choice("xyz ") for _ in range(600))]}
    model = langid.build(samples)
    texts = [prose(rng, 12), "xyzzy xxy", "the q re", "ing"]
    raw = [t.encode() for t in texts]
    total, sizes, letters = model.parse(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    cleaned = [" " + " ".join(samples[k][0].split()) + " " for k in ("a", "b")]
    assert total.astype(int).tolist() == [[phrases(t, s) for t in texts] for s in cleaned]
    assert sizes.tolist() == [len(t) for t in texts] and letters.tolist() == [len(t.replace(" ", "")) for t in texts]


def test_language_accuracy_and_held_out_rows(spark):
    rows = languages()
    docs = with_clashes(spark.createDataFrame(rows, DOCS))
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    lies = [(*r[:2], "xx", *r[3:]) if zlib.crc32(str(r[0]).encode()) % 3 == 1 else r for r in rows]
    assert langid.fit(spark.createDataFrame(lies, DOCS)).languages == model.languages


def test_language_cases(spark):
    docs = spark.createDataFrame(documents() + languages(90), DOCS)
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (3_000, 3_001, 3_002)} == {k: ("und", 0.0) for k in (3_000, 3_001, 3_002)}
    empty = spark.createDataFrame([], DOCS)
    assert langid.predict(empty, langid.fit(empty)).count() == 0 and langid.accepted(empty).count() == 0
    unlearnt = langid.predict(docs, langid.fit(empty)).collect()
    assert {r.lang_pred for r in unlearnt} == {"und"}
    kept = langid.accepted(docs)
    assert kept.schema == docs.schema and not {3_000, 3_001, 3_002} & {r.doc_id for r in kept.collect()}


def marked(n=400):
    rng, rows, labels = random.Random(5), [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, rng.randint(8, 60))
        rows.append((i, text if good else (text.upper().replace(" ", "!! ") if i % 2 else " ".join(w + "%%%" for w in text.split())), "en", "s", None))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_accuracy_and_cases(spark):
    rows, labels = marked()
    docs, known = spark.createDataFrame(rows + documents(), DOCS), spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(with_clashes(docs), quality.fit(with_clashes(docs), known)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    scores = {r.doc_id: r.score for r in got}
    truth = {i: q for i, q, _ in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1 and i not in {r[0] for r in documents()}]
    assert np.mean([(scores[i] >= 0.5) == bool(truth[i]) for i in held]) > 0.97
    assert scores[3_000] == scores[3_001]
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, 0) for i, q, _ in labels], known.schema)
    again = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, flipped)).collect()}
    assert all(abs(again[i] - scores[i]) < 1e-9 for i in held)


def test_quality_without_labels(spark):
    docs, none = spark.createDataFrame(documents(n=12), DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    empty = spark.createDataFrame([], DOCS)
    assert quality.score(empty, quality.fit(empty, none)).count() == 0


def test_quality_votes_equal_plain_cosines():
    rng = np.random.default_rng(1)
    x, y = rng.random((200, quality.WIDTH)).astype(np.float32), rng.integers(0, 2, 200).astype(float)
    model = quality.decompose(x, y)
    z = model.latent(x)
    for i in range(0, 200, 17):
        cosine = z[i] @ model.vectors.T
        near = np.argsort(-cosine, kind="stable")[:quality.NEIGHBOURS]
        weight = np.maximum(cosine[near], 1e-6).astype(float)
        assert abs(model.scores(x[i:i + 1])[0] - (weight * y[near]).sum() / weight.sum()) < 1e-5


def test_a_parse_keeps_to_little_memory():
    import tracemalloc

    import numpy as np
    model = langid.build({"en": ["the quick brown fox"], "de": ["der schnelle braune fuchs"]})
    model.symbols()
    data = np.frombuffer(b"the quick brown fox " * (langid.SLICE // 20), np.uint8)
    tracemalloc.start()
    model.parse(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20
