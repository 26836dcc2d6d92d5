import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from itemforge.llm import bpe, token_files
from itemforge.llm.shared import fresh_dir
from tests.llm.common import DOCS, documents, with_clashes

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def awkward_texts():
    rng = random.Random(4)
    alphabet = "aab e  '  stmdrevl.!,\n\t 12é ß漢😀'_-\r<|endoftext|>\x1c\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(800)]
    texts += ["", " ", "'s", "a<|endoftext|>b <|endoftext|>", "<|endoftext", "|>", "don't we'll they're I'm", " 'tis ''s 'x'rev", "a" * 4_000, " " * 3_000 + "x"]
    return texts + ["a" + chr(i) + "b " + chr(i) for i in range(0x3100)]


def test_encoding_equals_the_library(vocabulary, library):
    texts = awkward_texts()
    memory = bpe.WordMemory(vocabulary.encode_words, vocabulary.added)
    ids, before = memory.ids(*packed(texts))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(before[:-1], before[1:])] == want
    assert vocabulary.decode(ids) == library.decode([i for w in want for i in w], skip_special_tokens=False)


def test_word_memory_survives_being_emptied(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 50)
    texts = awkward_texts()[:200]
    memory = bpe.WordMemory(vocabulary.encode_words, vocabulary.added)
    for at in range(0, 200, 20):
        ids, before = memory.ids(*packed(texts[at:at + 20]))
        assert [ids[a:b].tolist() for a, b in zip(before[:-1], before[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts[at:at + 20]]


def test_digests(spark, library):
    rows = documents()
    got = bpe.digests(with_clashes(spark.createDataFrame(rows, DOCS)), bpe.vocabulary(spark, PATH)).collect()
    want = []
    for row in rows:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        want.append((row[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.digests(spark.createDataFrame([], DOCS), bpe.vocabulary(spark, PATH)).count() == 0


def test_encode_table_round_trip(spark):
    rows = documents()
    got = bpe.encode_table(spark.createDataFrame(rows, DOCS), bpe.vocabulary(spark, PATH), ["doc_id", "source"]).collect()
    assert len(got) == len(rows) and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 16_384, 65_536, 65_537, 150_000])
def test_range_coder_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).geometric(0.02, n), 60_000)
    values, counts = np.unique(np.append(ids, 0), return_counts=True)
    coder = token_files.Coder(token_files.scaled(values, counts))
    payload = coder.encode(ids)
    assert np.array_equal(coder.decode(payload), ids)
    if n > 64:
        broken = bytearray(payload)
        broken[-1] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            coder.decode(bytes(broken))


def test_one_symbol_alone():
    coder = token_files.Coder(token_files.scaled(np.array([5]), np.array([9])))
    assert np.array_equal(coder.decode(coder.encode(np.full(500, 5))), np.full(500, 5))


def test_token_files(spark, library):
    rows = documents()
    path = fresh_dir(spark, "test-tokens")
    token_files.write_token_files(with_clashes(spark.createDataFrame(rows, DOCS)), path, PATH)
    got = sorted(token_files.read_checksums(spark, path).collect(), key=lambda r: r.start)
    names = [r.doc_id for r in got]
    assert names == sorted(names, key=lambda x: (x is not None, x or 0)) and len(got) == len(rows)
    texts, at = {}, 0
    for row in rows:
        texts.setdefault(row[0], []).append(row[1] or "")
    for r in got:
        ids = library.encode(texts[r.doc_id][0], add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    lists = {r.doc_id: r.ids for r in token_files.read_documents(spark, path).collect()}
    assert lists[3_004] == library.encode("one", add_special_tokens=False).ids + [0] and lists[3_000] == [0]


def test_empty_token_files(spark):
    path = fresh_dir(spark, "test-tokens")
    token_files.write_token_files(spark.createDataFrame([], DOCS), path, PATH)
    assert token_files.read_checksums(spark, path).count() == 0


def test_every_code_point_is_classed_as_in_the_library(vocabulary, library):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    memory = bpe.WordMemory(vocabulary.encode_words, vocabulary.added)
    for at in range(0, len(points), 4_096):
        texts = ["\n".join("{0}'s {0}1 a{0}!".format(c) for c in points[at + k:at + k + 64]) for k in range(0, 4_096, 64)]
        ids, before = memory.ids(*packed(texts))
        assert [ids[a:b].tolist() for a, b in zip(before[:-1], before[1:])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
