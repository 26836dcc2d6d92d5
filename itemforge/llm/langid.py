"""Language identification by cross-parsing entropy.

``fit`` builds one suffix automaton per language over a bounded sample of labelled text. ``predict`` parses every whole
text against each automaton from left to right into longest matches; a language's cost is its number of phrases times
log2 of its sample length (the bits that point at a phrase), per symbol. The language with the fewest bits wins, ties
to the smaller name; ``score`` is its share of 2^-bits over the languages.

Symbols are lower-cased letters; everything else is one blank between words, and letters outside the samples match
nothing. A text is cut into lanes of ``LANE`` symbols that are parsed in step by array operations, each lane opening a
new phrase, the same for all languages. The automata are dense tables; their total size is bounded by ``TABLE_MB``,
which shortens the samples when languages or letters are many, so the broadcast does not grow with the data.

Bounds of the sample (documented parameters, the fit alone is sampled): ``SAMPLE_DOCS`` documents per language, those
with the smallest hash of the id, ``DOC_CHARS`` characters each, ``SAMPLE_CHARS`` symbols per language; sentences that several
sampled documents share are left out. Rows held out
(crc32 of the id leaves 1 modulo 3), null languages and texts without letters are never learnt from. Prediction reads
text only. One pass over the documents each to fit and to predict; the fit shuffles the sampled rows only.

Cases: null text, text without a letter, or nothing learnt give ``und`` with score 0; repeated rows each give a row;
long texts are parsed whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemforge.llm.bpe import LETTER, char_classes, code_points
from itemforge.llm.bytewords import text_slices
from itemforge.llm.shared import held_out, lean, table

SAMPLE_DOCS, DOC_CHARS, SAMPLE_CHARS, TABLE_MB, LANE = 300, 2_000, 30_000, 64, 512
# Bytes of text parsed at once: a parse holds some thirty times as much, and no document is cut by it.
SLICE = 1 << 20
BLANK, UNKNOWN = 0, 1
NONE = "und"
SENTENCE = regex.compile(r"[.!?|\n]+\s*")


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions (states, width) of the suffix automaton of a sequence, -1 where there is none; state 0 is the start."""
    steps, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        here = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = here
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[here] = q
            else:
                twin = len(steps)
                steps.append(dict(steps[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[here] = twin
        last = here
    out = np.full((len(steps), width), -1, np.int64)
    for state, edges in enumerate(steps):
        for c, to in edges.items():
            out[state, c] = to
    return out


@dataclass
class Model:
    """``moves`` holds, for state s at offset s * width, the next offset by symbol; ~offset where a new phrase opens."""

    languages: list[str]
    letters: list[str]
    moves: np.ndarray
    roots: np.ndarray
    bits: np.ndarray

    def symbols(self) -> np.ndarray:
        """The symbol of every code point."""
        if not hasattr(self, "_symbols"):
            known = {c: i + 2 for i, c in enumerate(self.letters)}
            classes = char_classes()
            out = np.where(classes == LETTER, UNKNOWN, BLANK).astype(np.int32)
            for point in np.flatnonzero(classes == LETTER):
                out[point] = known.get(chr(point).lower(), UNKNOWN)
            self._symbols = out
        return self._symbols

    def parse(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (languages, documents), symbols and letters of every document."""
        chars, place = code_points(data)
        bounds = np.searchsorted(place, offsets)
        found = self.symbols()[chars]
        letters = np.diff(np.concatenate([[0], np.cumsum(found != BLANK)])[bounds])
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] != BLANK) | (found[:-1] != BLANK)
        opens = bounds[:-1][np.diff(bounds) > 0]
        keep[opens] = True
        found = found[keep]
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        sizes = np.diff(bounds)
        lanes = -(-sizes // LANE)
        owner = np.repeat(np.arange(len(sizes)), lanes)
        first = bounds[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        last = np.minimum(first + LANE, bounds[1:][owner])
        order = np.argsort(first - last, kind="stable")  # full lanes first, so short ones leave the loop early
        first, last, owner = first[order], last[order], owner[order]
        lengths = last - first
        state = np.repeat(self.roots[:, None], len(owner), axis=1)
        phrases = np.zeros_like(state)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -step, side="left"))
            to = self.moves[state[:, :live] + found[first[:live] + step]]
            fresh = to >> 31
            state[:, :live] = to ^ fresh
            phrases[:, :live] -= fresh
        total = np.stack([np.bincount(owner, weights=p, minlength=len(sizes)) for p in phrases]) if len(phrases) else np.zeros((0, len(sizes)))
        return total, sizes, letters


def build(samples: dict[str, list[str]]) -> Model:
    """Automata over the samples of each language, cut to ``SAMPLE_CHARS`` symbols and to the table bound."""
    classes, cleaned, seen = char_classes(), {}, Counter()
    sentences = {language: [list(dict.fromkeys(SENTENCE.split(t.lower()))) for t in dict.fromkeys(texts)] for language, texts in samples.items()}
    for lists in sentences.values():
        seen.update(s for found in lists for s in found)
    for language in sorted(samples):
        # a sentence of several documents is a shared passage, whose language may not be the document's
        text = " ".join(s for found in sentences[language] for s in found if seen[s] == 1)
        words = "".join(c if classes[ord(c)] == LETTER else " " for c in text).split()
        if words:
            cleaned[language] = " " + " ".join(words) + " "
    cut = SAMPLE_CHARS
    counts: dict[str, int] = {}
    for text in cleaned.values():
        for c in text.replace(" ", ""):
            counts[c] = counts.get(c, 0) + 1
    letters = sorted(sorted(counts, key=lambda c: (-counts[c], c))[:4_000])
    width = len(letters) + 2
    if cleaned:
        cut = max(200, min(cut, (TABLE_MB << 20) // (len(cleaned) * 2 * width * 4)))
    known = {c: i + 2 for i, c in enumerate(letters)} | {" ": BLANK}
    tables, roots, bits, base = [], [], [], 0
    for text in cleaned.values():
        symbols = [known.get(c, UNKNOWN) for c in text[:cut]]
        moves = suffix_automaton([s for s in symbols if s != UNKNOWN], width)
        closed = len(moves)  # one more state, where every symbol opens a phrase: at the start and after a symbol never seen
        again = np.where(moves[0] >= 0, moves[0], closed)
        moves = np.concatenate([moves, np.full((1, width), -1)])
        moves = np.where(moves >= 0, (moves + base) * width, ~((again + base) * width)[None, :])
        tables.append(moves.astype(np.int32).ravel())
        roots.append((base + closed) * width)
        bits.append(np.log2(len(symbols) + 1))
        base += closed + 1
    return Model(list(cleaned), letters, np.concatenate(tables) if tables else np.zeros(0, np.int32), np.array(roots, np.int32), np.array(bits))


def fit(docs: DataFrame) -> Model:
    labelled = docs.select("doc_id", "lang", F.substring("text", 1, DOC_CHARS).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    picked = labelled.withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= SAMPLE_DOCS)
    samples: dict[str, list[str]] = {}
    for row in picked.orderBy("lang", "place").collect():  # bounded by the sample parameters
        samples.setdefault(row.lang, []).append(row.text)
    return build(samples)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.languages, NONE], object)
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text", SLICE):
                phrases, sizes, letters = own.parse(data, offsets)
                n = len(sizes)
                best, score = np.full(n, len(own.languages)), np.zeros(n)
                if own.languages:
                    cost = phrases * own.bits[:, None]
                    best = np.where(letters > 0, np.argmin(cost, axis=0), best)
                    score = np.where(letters > 0, 1 / np.exp2(np.maximum(cost.min(axis=0) - cost, -1_000)).sum(axis=0), 0.0)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that have a language: letters, and a score of at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text", SLICE):
                if own.languages:
                    phrases, _, letters = own.parse(data, offsets)
                    cost = phrases * own.bits[:, None]
                    score = 1 / np.exp2(np.maximum(cost.min(axis=0) - cost, -1_000)).sum(axis=0)
                    yield rows.filter(pa.array((letters > 0) & (score >= least)))
    return docs.select(*[docs[c] for c in names]).mapInArrow(lean(run), docs.schema)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
