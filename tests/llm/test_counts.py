import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from itemforge.llm import counts
from itemforge.llm.packing import from_planes, places_of, planes, steps_of
from tests.llm.common import DOCS, documents, with_clashes

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(spark, rows):
    library = Tokenizer.from_file(PATH)
    got = counts.token_counts(with_clashes(spark.createDataFrame(rows, DOCS).repartition(3)), PATH).collect()
    want = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_awkward_rows(spark):
    rng = random.Random(9)
    alphabet = "aab e  '  stmdrevl.!,\n\t 12é ß漢😀'_-\r<|endoftext|>\x1c\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endof", "text|>", "<|endoftext|", "x" * 5_000, " " * 3_000, "1" * 300]
    check(spark, documents() + [(9_000 + i, t, "en", "s", 1) for i, t in enumerate(texts)])


def test_texts_longer_than_a_slice(spark, monkeypatch):
    rng = random.Random(2)
    check(spark, [(i, " ".join("w%d" % rng.randint(0, 30_000) for _ in range(n)), None, None, None) for i, n in enumerate([700_000, 10, 0, 200_000])])


def test_empty_table(spark):
    assert counts.token_counts(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_packing():
    n_pairs, places = np.array([0, 3, 0, 2, 0]), np.array([0, 4, 70_000, 2, 3])
    assert np.array_equal(places_of(from_planes(planes(steps_of(places, n_pairs))), n_pairs), places)


def test_other_files_are_refused(spark):
    with pytest.raises(ValueError, match="byte-level"):
        counts.token_counts(spark.createDataFrame([], DOCS), public_tokenizers.path("word_bpe_49k.json"))
