"""Small tables with every awkward case, and plain reference versions."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWERED = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "re", "on", "st", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(seed=1, n=60):
    """Prose, near and exact copies, shared lines, nulls in every column, blank, very long and repeated rows."""
    rng = random.Random(seed)
    rows = [(i, "\n".join(prose(rng, rng.randint(3, 25)) for _ in range(rng.randint(1, 6))), rng.choice(["en", "fr"]), rng.choice(["s1", "s2", "s3", "s4"]), 0) for i in range(n)]
    for i in range(0, n, 6):
        words = rows[i][1].split(" ")
        words[len(words) // 2] = "Changed"
        rows.append((1_000 + i, " ".join(words), "en", "s1", None))
        rows.append((2_000 + i, rows[i][1], None, None, 3))
    rows += [(3_000, None, None, None, None), (3_001, "", "en", "s1", 0), (3_002, " \t\n ", "fr", "s5", 0), (None, "a row without an id but five words", "en", "s2", 1),
             (3_003, prose(rng, 9_000), "en", "s9", 1), (3_004, "one", "en", "s1", 3), (3_005, "One", "en", "s1", 3), (3_006, "\U0001F600 漢字 ß <|endoftext|> don't we'll  \r\n12,5", "de", "s1", 1)]
    return rows + [rows[0], rows[0]]


def with_clashes(df):
    """The table with extra columns named like those that operators make."""
    from pyspark.sql import functions as F
    extra = ["size", "row", "drop", "id", "copies", "target", "bucket", "line", "root", "salt", "_id", "_row", "_text", "n_shingles", "class_id", "component_id", "block", "label", "d", "k"]
    return df.select("*", *[F.lit(i).alias(name) for i, name in enumerate(extra)])


def shingles(text, width):
    words = WORDS.findall((text or "").translate(LOWERED))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < width else [tuple(words[i:i + width]) for i in range(len(words) - width + 1)])


def groups(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
