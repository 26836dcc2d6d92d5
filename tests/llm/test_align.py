import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from itemforge.llm import align, bpe
from tests.llm.common import DOCS, documents, with_clashes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BYTE = bpe.byte_alphabet()


def tokens(rows):
    """Per row the tokens of A and B as (id, end), or none."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    out = []
    for row in rows:
        text = row[1] or ""
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(BYTE[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            out.append(([], []))
            continue
        ends = lambda raw: [sum(map(len, raw[:k + 1])) for k in range(len(raw))] if len(raw) < 2_000 else running(raw)
        out.append((list(zip(ids_a, ends(raw_a))), list(zip(ids_b, ends(raw_b)))))
    return out


def running(raw):
    total, out = 0, []
    for r in raw:
        total += len(r)
        out.append(total)
    return out


def truth(rows):
    found, counts, per = tokens(rows), Counter(), []
    for a, b in found:
        by_end = {end: i for i, end in b}
        linked = [(i, by_end[end], end) for i, end in a if end in by_end]
        counts.update((x, y) for x, y, _ in linked)
        per.append(linked)
    most = {}
    for (x, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for row, (a, b), linked in zip(rows, found, per):
        groups, start = [], 0
        for _, _, end in linked:
            groups.append(",".join(str(i) for i, e in a if start < e <= end) + "|" + ",".join(str(i) for i, e in b if start < e <= end))
            start = end
        out.append((row[0], len(a), len(b), len(linked), len(linked), sum(counts[x, y] == most[y] for x, y, _ in linked), sum(counts[x, y] for x, y, _ in linked),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    return out


def awkward():
    rng = random.Random(6)
    alphabet = "aab e  '  stmdrevl.!,\n\t 12é ß漢😀'_-\r▁\x00 "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    return texts + ["<s>", "a </s><unk> b", "<0x41>", "<|endoftext|> x", " ", "  lead", "x" * 5_000, "▁", "漢字" * 700, "aé" * 1_500]


def test_awkward_rows(spark):
    rows = [r if r[0] != 3_003 else (r[0], r[1][:9_000], *r[2:]) for r in documents()] + [(9_000 + i, t, "en", "s", 1) for i, t in enumerate(awkward())]
    got = align.link_counts(with_clashes(spark.createDataFrame(rows, DOCS).repartition(3)), A, B).collect()
    assert sorted(map(tuple, got), key=str) == sorted(truth(rows), key=str)


def test_alignments_hold_links_and_cuts(spark):
    rows = documents(n=12)
    want = {}
    for row, (a, b) in zip(rows, tokens(rows)):
        by_end = {end: j for j, (_, end) in enumerate(b)}
        linked = [(k, by_end[end], end) for k, (_, end) in enumerate(a) if end in by_end]
        want.setdefault(row[0], ([i for i, _ in a], [i for i, _ in b], [x for x, _, _ in linked], [y for _, y, _ in linked], [e for _, _, e in linked]))
    for r in align.alignments(spark.createDataFrame(rows, DOCS), A, B).collect():
        assert (r.ids_a, r.ids_b, r.links_a, r.links_b, r.cuts) == want[r.doc_id]


def test_texts_longer_than_a_slice(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(" ".join("word%d" % rng.randint(0, 999) for _ in range(50)) for _ in range(n)), None, None, None) for i, n in enumerate([12_000, 1, 0, 3_000])]
    got = {r.doc_id: r for r in align.link_counts(spark.createDataFrame(rows, DOCS), A, B).collect()}
    for row, (a, b) in zip(rows, tokens(rows)):
        assert (got[row[0]].n_a, got[row[0]].n_b, got[row[0]].n_links) == (len(a), len(b), len({e for _, e in a} & {e for _, e in b}))


def test_empty_table(spark):
    assert align.link_counts(spark.createDataFrame([], DOCS), A, B).count() == 0
