import hashlib
import random
import zlib

from itemforge.llm import merkle
from tests.llm.common import DOCS, documents, with_clashes


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    """Root, and for every leaf (own place, siblings) level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, j in enumerate(at):
            run = level[j - j % 16:j - j % 16 + 16]
            paths[i].append((j % 16, run[:j % 16] + run[j % 16 + 1:]))
        at, level = [j // 16 for j in at], [digest(*level[k:k + 16]) for k in range(0, len(level), 16)]
    return level[0], paths


def truth(rows):
    lowered, sources, out = str.maketrans(merkle.UPPER, merkle.LOWER), {}, []

    def leaf(row, text):
        return digest(*map(field, (row[0], row[3], row[2], row[4], text)))
    for row in rows:
        sources.setdefault(row[3], []).append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    built = {s: tree([leaf(r, r[1]) for r in sources[s]]) for s in names}
    root, crown = tree([built[s][0] for s in names])
    for s, above in zip(names, crown):
        for row, path in zip(sources[s], built[s][1]):
            text = row[1]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                text = text.translate(lowered)
            now = leaf(row, text)
            for own, others in path + above:
                now = digest(*others[:own], now, *others[own:])
            out.append((row[0], leaf(row, row[1]), built[s][0], root, digest(*[d for _, others in path + above for d in others]), now, now == root))
    return out


def check(spark, rows):
    got = merkle.verified(merkle.manifest(with_clashes(spark.createDataFrame(rows, DOCS).repartition(5)))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(truth(rows), key=str)
    return got


def test_awkward_rows(spark):
    got = check(spark, documents())
    assert {r.verified for r in got} == {True, False}


def test_large_tree_and_many_sources(spark):
    rng = random.Random(3)
    rows = [(i, f"Text {i}", "en", "hot" if i % 2 else rng.choice([None, "é", "z", f"s{i}"]), i) for i in range(1_200)]
    check(spark, rows + [(5_000 + i, None, None, "hot", None) for i in range(4_000)])


def test_lone_leaves(spark):
    assert check(spark, [(1, "A", "en", "s", 1)])[0].proof_sha256 == hashlib.sha256(b"").hexdigest()
    check(spark, [(1, "A", "en", "s", 1), (2, "B", "en", None, 1)])
    check(spark, [(7, "A", "en", "s", 1)] * 40)


def test_empty_table(spark):
    assert merkle.verified(merkle.manifest(spark.createDataFrame([], DOCS))).count() == 0
