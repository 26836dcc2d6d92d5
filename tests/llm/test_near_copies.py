import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from itemforge.llm import bytewords, components, hnsw, jaccard, lines, shared
from tests.llm.common import DOCS, WORDS, documents, groups, prose, shingles, with_clashes


def families(seed=3):
    rng, rows = random.Random(seed), []
    for b in range(25):
        base = prose(rng, rng.randint(1, 140)).split()
        for k in range(rng.randint(1, 30)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = f"z{rng.randint(0, 9)}"
            rows.append((len(rows) * 7919 % 100_003, " ".join(words), "en", "s", None))
    return rows


def jaccard_truth(rows, width, num, den):
    sets = [shingles(r[1], width) for r in rows]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * den >= max(len(a), len(b)) * num:
                both = len(a & b)
                if den * both >= num * (len(a) + len(b) - both):
                    links.append((j, i))
    root, named = groups(len(rows), links), {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            named[r] = min(named.get(r, rows[i][0]), rows[i][0])
    return Counter((rows[i][0], len(sets[i]), named.get(root[i]) if sets[i] else rows[i][0]) for i in range(len(rows)))


@pytest.mark.parametrize("width,num,den", [(3, 9, 10), (5, 8, 10)])
def test_jaccard_equals_brute_force(spark, width, num, den):
    rows = families() + [(200_000 + (r[0] or 0) if r[0] is not None else None, *r[1:]) for r in documents()]
    docs = with_clashes(spark.createDataFrame(rows, DOCS).repartition(5))
    assert Counter(map(tuple, jaccard.jaccard_classes(docs, width, num, den).collect())) == jaccard_truth(rows, width, num, den)


def test_jaccard_tiles_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", 500)
    monkeypatch.setattr(jaccard, "TILE_CLASSES", 5)
    rows = families(8)
    assert Counter(map(tuple, jaccard.jaccard_classes(spark.createDataFrame(rows, DOCS)).collect())) == jaccard_truth(rows, 3, 9, 10)


def test_one_of_each(spark):
    rows = documents()
    kept = jaccard.one_of_each(with_clashes(spark.createDataFrame(rows, DOCS)))
    assert kept.columns == with_clashes(spark.createDataFrame(rows, DOCS)).columns
    ids = [r.doc_id for r in kept.collect()]
    truth = {d for d, _, c in jaccard_truth(rows, 5, 8, 10) if d == c and d is not None}
    assert Counter(ids) == Counter([*truth, None])
    assert jaccard.one_of_each(spark.createDataFrame([], DOCS)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(1_000 + i, 1_001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    root = groups(1_100, real)
    assert got == {x: root[x] for e in real for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vector_rows():
    rng, rows = np.random.default_rng(4), []
    for c in range(20):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 40)):
            rows.append((len(rows), (centre + rng.standard_normal(16) * rng.choice([0.02, 0.05, 0.3])).astype(np.float32).tolist(), int(c % 3)))
    n = len(rows)
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(30)] + [(n + 40 + i, rows[0][1], 0) for i in range(200)]
    return rows + [(9_000, None, 1), (9_001, [0.0] * 16, 1), (9_002, [1.0, None] * 8, 1), (9_003, [float("nan")] * 16, 1), (9_004, rows[0][1], None), (9_005, [1.0, 2.0], 1),
                   (9_006, [], 1), (9_007, [float("inf")] + [1.0] * 15, 1), (None, [3.0, 4.0], 1), rows[3]]


def vector_truth(rows, least):
    usable = [r[1] if r[0] is not None and r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(np.array(r[1])) else None for r in rows]
    links = []
    for i, a in enumerate(usable):
        for j in range(i):
            b = usable[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b):
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links.append((j, i))
    n, root, named = Counter(x for e in links for x in e), groups(len(rows), links), {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            named[r] = min(named.get(r, rows[i][0]), rows[i][0])
    return Counter((rows[i][0], n[i], named.get(root[i])) for i in range(len(rows)))


@pytest.mark.parametrize("shard", [8_192, 60])
def test_vectors_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(hnsw, "SHARD", shard)
    rows = vector_rows()
    got = Counter(map(tuple, hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.98).collect()))
    assert got == vector_truth(rows, 0.98)


def test_no_vectors(spark):
    assert hnsw.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((1_500, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids, _ = hnsw.Graph(v).search(v[:200], 64)
    truth = np.argsort(-(v[:200] @ v.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, truth)]) > 0.9


def teams_truth(forms, opened=()):
    """(form, open positions, those of them that vary) of all forms of a leaf, all of one length."""
    n, length = len(forms), len(forms[0])
    varied = [p for p in range(length) if len({f[p] for f in forms}) > 1]
    if n < lines.MIN_LINES:
        return [(f, opened, len({*opened} & {*varied})) for f in forms]
    tops = {p: Counter(f[p] for f in forms).most_common() for p in range(length) if p not in opened}
    marks = {p: t for p, t in tops.items() if t[0][1] < n}
    even = [p for p, t in marks.items() if t[0][1] * 2 <= n]
    scarce = [p for p in even if len(marks[p]) < lines.MIN_VALUES]
    wider = (*opened, *(p for p in even if p not in scarce))
    fits = len(wider) * 100 <= length * lines.OPEN
    if fits and not scarce:
        opened = wider
    marks = {p: t for p, t in marks.items() if p not in opened}
    closed = [p for p, t in marks.items() if t[0][1] * 2 > n]
    following, out = defaultdict(list), []
    for f in forms:
        shared = [(t[0][1], -p) for p, t in marks.items() if t[0][1] > 1]
        cut = scarce[0] if scarce else next((p for p in closed if f[p] != marks[p][0][0]), None) if closed else -max(shared)[1] if shared and not fits else None
        if cut is not None:
            following[cut, f[cut]].append(f)
        elif not fits and closed:
            following[None, None].append(f)
        else:
            out.append((f, opened, len({*opened} & {*varied})))
    rest = defaultdict(list)
    for (cut, _), found in following.items():
        if len(found) > 1:
            out += teams_truth(found, opened)
        else:
            rest[cut] += found
    return out + [x for found in rest.values() for x in teams_truth(found, opened)]


def lines_truth(rows):
    held, forms, leaves = defaultdict(set), defaultdict(set), defaultdict(list)

    def masked(tokens):
        digits = [any("0" <= c <= "9" for c in t) for t in tokens]
        return tokens if sum(digits) * 100 > len(tokens) * lines.OPEN else tuple("<*>" if d else t for t, d in zip(tokens, digits))
    for doc, text, *_ in rows:
        for line in text.split("\n") if text is not None else []:
            tokens = tuple(WORDS.findall(line))
            if tokens:
                held[tokens].add(doc)
                forms[masked(tokens)].add(tokens)
    for form, found in forms.items():
        exact = any(any("0" <= c <= "9" for c in t) for t in form)
        leaves[(form,) if exact else (len(form), form[:lines.DEPTH])].append(form)
    template, kinds, fields, docs = {}, Counter(), Counter(), defaultdict(set)
    for leaf, found in leaves.items():
        for form, opened, n_fields in teams_truth(found):
            key = (leaf, tuple("?" if p in opened else t for p, t in enumerate(form))) if opened else form
            template[form] = key
            kinds[key] += len(forms[form])
            fields[key] = max(fields[key], n_fields + form.count("<*>"))
            docs[key] |= {d for tokens in forms[form] for d in held[tokens] if d is not None}
    out = Counter()

    def keeper(line):
        tokens = tuple(WORDS.findall(line))
        if not tokens:
            return None
        key, own = template[masked(tokens)], {d for d in held[tokens] if d is not None}
        if fields[key] and kinds[key] >= fields[key] * lines.MIN_LINES and len(docs[key]) > 1:
            return min(docs[key])
        return min(own) if len(own) > 1 else None
    for doc, text, *_ in rows:
        kept = None if text is None else "\n".join(x for x in text.split("\n") if keeper(x) in (None, doc))
        out[doc, kept] += 1
    return out


def test_lines_equal_brute_force(spark):
    rng, rows = random.Random(2), []
    for d in range(250):
        found = []
        for _ in range(rng.randint(0, 7)):
            k = rng.random()
            found.append(f"user {rng.choice('abcde')} logged in from host {rng.choice('pqr')} at noon today with key" if k < 0.3 else
                         f"order {rng.randint(0, 99)} shipped to city now done {rng.choice('xyz')}" if k < 0.5 else prose(rng, rng.randint(0, 9)))
        rows.append((rng.choice([d, d, 7, None]), "\n".join(found), "en", "s", len(found)))
    rows += documents() + [(7_000, "\n\n", "en", "s", 2), (7_001, "a b c d e\na b c d e", "en", "s", 1)]
    df = with_clashes(spark.createDataFrame(rows, DOCS).repartition(4))
    got = lines.without_recurring(df)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == lines_truth(rows)
    assert lines.without_recurring(spark.createDataFrame([], DOCS)).count() == 0


def kept_lines(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS).repartition(3)
    return {r.doc_id: r.text for r in lines.without_recurring(df).collect()}


def letters(k):
    return "".join("abcdefghij"[int(c)] for c in str(k))


def test_lines_of_numbers_are_exact(spark):
    texts = ["12 34 56 78 90", "1 2 3 4 5", "Revenue 2019 1,234 2020 1,456", "Revenue 2021 1,999 2022 2,010", "12 34 56 78 90",
             "ticket 17 was closed by the night shift", "ticket 18 was closed by the night shift"]
    assert kept_lines(spark, texts) == dict(enumerate([*texts[:4], "", *texts[5:]]))
    tickets = [f"ticket {k} was closed by the night shift" for k in range(lines.MIN_LINES)]
    assert kept_lines(spark, tickets) == dict(enumerate([tickets[0], *[""] * (lines.MIN_LINES - 1)]))


def test_sentences_that_differ_in_a_word_stay(spark):
    rng = random.Random(8)
    pairs = ["He was born in London and lived there", "He was born in Leeds and lived there", "The meeting on Monday was moved to room nine", "The meeting on Monday was moved to room four",
             "Chapter 5 of the book begins here", "Chapter 6 of the book begins here"]
    sentences = []
    for _ in range(150):
        words = prose(rng, rng.randint(6, 15)).split(" ")
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(words))
            sentences.append(" ".join([*words[:at], f"{prose(rng, 1)}{letters(len(sentences))}", *words[at + 1:]]))
    texts = pairs + list(dict.fromkeys(sentences))
    assert kept_lines(spark, texts) == dict(enumerate(texts))


def test_a_field_of_two_values_is_none(spark):
    texts = [f"the {day} report on stock {letters(k)} was sent to all" for k in range(20) for day in ("monday", "friday")]
    got = kept_lines(spark, texts)
    assert sorted(t for t in got.values() if t) == sorted(texts[:2])


def test_templates_tell_all_tokens_apart(spark):
    frequent = [f"alpha beta gamma same {word} e f g h" for word in (f"w{'abcdefghij'[k // 100]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k % 10]}" for k in range(999))]
    rare = [f"alpha beta gamma x{''.join('abcdefghij'[int(c)] for c in str(k))} w e f g h" for k in range(900)]
    got = kept_lines(spark, frequent + rare)
    assert [got[i] for i in range(len(frequent))] == [frequent[0]] + [""] * (len(frequent) - 1)
    assert [got[len(frequent) + i] for i in range(len(rare))] == rare


def test_families_in_one_leaf_part(spark):
    one = [f"the job was started by {letters(k)} on the first node" for k in range(100)]
    two = [f"the job was moved to queue after all {letters(k)} retries" for k in range(100)]
    few = [f"a call has ended well with {letters(k)} and nothing else" for k in range(200)] + [f"a call has been cut short again near {letters(k)} today" for k in range(12)]
    odd = ["a call has never met any of those other words"]
    got = kept_lines(spark, one + two + few + odd)
    assert sorted(t for t in got.values() if t) == sorted([one[0], two[0], few[0], few[200], *odd])


def test_every_round_leaves_the_driver_empty(spark, monkeypatch):
    done = []
    monkeypatch.setattr(lines, "forget", lambda session: (done.append("forget"), shared.forget(session)))
    monkeypatch.setattr(lines, "judged_teams", lambda found, judge=lines.judged_teams: (done.append("round"), judge(found))[1])
    # two families in one leaf: the first round parts them, a later one judges each
    texts = [f"the new order {a} {letters(k)} was sent out {a} today at noon" for a in ("red", "blue") for k in range(12)]
    assert kept_lines(spark, texts) == {i: t if i % 12 == 0 else "" for i, t in enumerate(texts)}
    assert done.count("round") > 1 and done[-1] == "forget"
    assert all(done[i + 1] == "forget" for i, what in enumerate(done) if what == "round")


def test_bit_map_holds_no_row_objects(spark):
    shared.bit_map(spark.range(3), "id")  # what is loaded once
    tracemalloc.start()
    found = shared.bit_map(spark.range(1 << 17).selectExpr("id * 32 + id % 32 as id"), "id")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    at = np.arange(1 << 17)
    assert (found == np.uint32(1) << (at % 32).astype(np.uint32)).all()
    assert most < 8 << 20
    odd = spark.createDataFrame([(-1,), (None,), (1 << 62,), ((1 << 62) + 33,)], "id long")
    bits = shared.bit_map(odd, "id")
    assert [int(bits[0]), int(bits[1]), int(bits[-1]), np.count_nonzero(bits)] == [1, 2, 1 << 31, 3]
    assert not shared.bit_map(odd.filter("id is null"), "id").any()


def test_short_lines_recur_exactly(spark):
    texts = ["All rights reserved.\none", "All rights reserved.\n\ntwo", "Read more\nPage 3\nAll rights", "Page 4\nRead more\n \nAll wrongs reserved."]
    assert kept_lines(spark, texts) == dict(enumerate([texts[0], "\ntwo", texts[2], "Page 4\n \nAll wrongs reserved."]))


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    rng = random.Random(6)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a), (1, b), (1, b + " more"), (2, a + " more"), (3, b + " more"), (4, c), (2, c + " more"), (1, a), (6, ""), (6, None), (6, "")]
    df = spark.createDataFrame([(*r, "en", "s", None) for r in rows], DOCS).repartition(3)
    got = Counter((r.doc_id, r.text) for r in jaccard.one_of_each(df).collect())
    whole = [(i, t) for i, t in got if i == 1 and t in (b, b + " more")]
    assert len(whole) == 1 and got == Counter([(1, a), *whole, (2, c + " more"), (6, ""), (6, None)])
    assert Counter(map(tuple, jaccard.jaccard_classes(df).collect())) == jaccard_truth([tuple(r) for r in rows], 3, 9, 10)


def test_long_words_that_meet_under_any_polynomial():
    word = "a"
    for _ in range(11):  # Thue-Morse words of 2,048 letters
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    raw = np.frombuffer((word + other).encode(), np.uint8)
    one, two = bytewords.hash_ranges(raw, np.array([0, len(word)]), np.array([len(word), len(raw)]))
    assert one != two


def test_bitmaps_leave_every_link_possible():
    rng = np.random.default_rng(5)
    for size in (3, 40, 300, 700, 3_000):
        one = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for changed in range(0, size // 8 + 1, max(1, size // 40)):
            two = np.unique(np.concatenate([one[changed:], rng.integers(0, 1 << 63, changed // 2, dtype=np.uint64)]))
            linked = 10 * len(np.intersect1d(one, two)) >= 8 * len(np.union1d(one, two))
            pair = jaccard.signatures(np.concatenate([one, two]), np.array([0, len(one), len(one) + len(two)]))
            found = jaccard.possible_links(pair, np.array([len(one), len(two)]), 8, 10)
            assert found or not linked
    alone = jaccard.signatures(np.unique(rng.integers(0, 1 << 63, 600, dtype=np.uint64)), np.array([0, 300, 600]))
    assert jaccard.possible_links(alone, np.array([300, 300]), 8, 10) == []
