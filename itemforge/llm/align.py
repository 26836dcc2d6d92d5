"""Alignment of two tokenizers' tokens by lockstep vectorised merging.

A task encodes a slice of texts with tokenizer A (byte-level BPE) and tokenizer B (pieces with byte fallback) and gives
every token the byte it ends at. One state vector then holds an A and a B pointer for every stretch of text; each step
compares the two ends of all stretches at once, emits a link and a cut where they are equal, advances the pointer that
is behind (both where equal), and drops finished stretches from the vector. A stretch is a document, or ``STRETCH``
bytes of a longer one: whether two tokens end together depends on their ends alone, so a long document needs no more
steps than a short one and every step works on a full vector.

The cuts divide a document into groups; links join the A and the B token that end at a cut. Per id pair, links are
counted over the corpus, and every document is told how its links fare.

Scale: texts are encoded once, where they are scanned. A slice (4 MB of text) writes one row to the shared folder: its
documents' figures, its distinct id pairs with their links, and packed per-document frequencies. Pairs are summed with
partial aggregation; a pair reaches the join once per slice, so a pair that every document has is as many rows as there
are slices, which Spark's skew handling splits; the answers meet the slice's own row. Nothing is collected. Broadcasts
are the two tokenizer files.

Cases: a null or empty text, or one whose A or B tokens do not spell a blank and the text, has no tokens: zeros and an
empty digest, and it counts for no pair; strings of special tokens are plain text; repeated rows each count; a null
doc_id stays null; an empty table gives no rows; texts of any length are handled whole; other columns are not read. A
token without bytes exists in neither format.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.llm.bpe import Vocabulary, WordMemory, vocabulary
from itemforge.llm.bytewords import ranges, text_slices
from itemforge.llm.packing import from_planes, places_of, planes, steps_of
from itemforge.llm.shared import fresh_dir, settle, table

SLICE_TEXT, STRETCH = 4 << 20, 1024
_SLICES = ("slice long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_links array<long>, digests array<string>, n_pairs array<long>, steps binary, times binary, "
           "keys array<long>, totals array<long>")
_pieces: dict[bytes, "Pieces"] = {}


class Pieces:
    """A sentencepiece model and the bytes that each id spells."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        spelled = [self._bytes(i) for i in range(self.model.vocab_size())]
        self.lengths = np.array([len(b) for b in spelled], np.int64)
        self.offsets, self.pool = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(spelled), np.uint8)

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    @staticmethod
    def of(model: bytes) -> "Pieces":
        """That of this Python worker, kept from task to task."""
        if model not in _pieces:
            _pieces.clear()
            _pieces[model] = Pieces(model)
        return _pieces[model]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number before each text (one more at the end)."""
        found = self.model.encode(texts, num_threads=1) if texts else []
        before = np.concatenate([[0], np.cumsum([len(f) for f in found], dtype=np.int64)])
        return np.fromiter(chain.from_iterable(found), np.int64, int(before[-1])), before


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of all links in order; ``borders``: stretches between consecutive ones, none across."""
    a, b = np.searchsorted(ends_a, borders, side="right"), np.searchsorted(ends_b, borders, side="right")
    stop_a, stop_b, a, b = a[1:], b[1:], a[:-1], b[:-1]
    links_a, links_b = [], []
    while True:
        open_ = (a < stop_a) & (b < stop_b)
        if not open_.all():
            a, b, stop_a, stop_b = a[open_], b[open_], stop_a[open_], stop_b[open_]
        if not len(a):
            break
        x, y = ends_a[a], ends_b[b]
        together = x == y
        links_a.append(a[together])
        links_b.append(b[together])
        a, b = a + (x <= y), b + (y <= x)
    links_a, links_b = np.concatenate([np.zeros(0, np.int64), *links_a]), np.concatenate([np.zeros(0, np.int64), *links_b])
    order = np.argsort(links_a)
    return links_a[order], links_b[order]


class Aligned:
    """Tokens and links of a slice of documents. ``before_*``: tokens or links before each document, one more at the end."""

    def __init__(self, vocab: Vocabulary, memory: WordMemory, pieces: Pieces, data: np.ndarray, offsets: np.ndarray):
        full = np.diff(offsets) > 0
        spaced, at = np.insert(data, offsets[:-1][full], 32), offsets + np.concatenate([[0], np.cumsum(full)])
        ids_a, before_a = memory.ids(spaced, at)
        raw, cuts = data.tobytes(), offsets.tolist()
        ids_b, before = pieces.ids([raw[cuts[i]:cuts[i + 1]].decode() for i in np.flatnonzero(full).tolist()])
        before_b = before[np.concatenate([[0], np.cumsum(full)])]
        fine = full & self._spells(vocab, ids_a, before_a, spaced, at) & self._spells(pieces, ids_b, before_b, spaced, at)
        self.ids_a, self.before_a = self._kept(ids_a, before_a, fine)
        self.ids_b, self.before_b = self._kept(ids_b, before_b, fine)
        starts = np.concatenate([[0], np.cumsum(np.where(fine, np.diff(at), 0))])
        # Stretches end at every document's end, and inside documents every STRETCH bytes.
        borders = np.unique(np.concatenate([starts, np.arange(0, int(starts[-1]) + 1, STRETCH)]))
        self.ends_a = np.cumsum(vocab.lengths[self.ids_a])
        self.link_a, self.link_b = lockstep(self.ends_a, np.cumsum(pieces.lengths[self.ids_b]), borders)
        self.before_links = np.searchsorted(self.link_a, self.before_a)
        self.starts = starts

    @staticmethod
    def _spells(tokens, ids: np.ndarray, before: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        lengths = tokens.lengths[ids]
        at = np.concatenate([[0], np.cumsum(lengths)])[before]
        made = tokens.pool[ranges(tokens.offsets[ids], lengths)]
        out = np.diff(at) == np.diff(offsets)
        for i in np.flatnonzero(out).tolist():
            out[i] = np.array_equal(made[at[i]:at[i + 1]], data[offsets[i]:offsets[i + 1]])
        return out

    @staticmethod
    def _kept(ids: np.ndarray, before: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.diff(before)
        return ids[np.repeat(fine, counts)], np.concatenate([[0], np.cumsum(np.where(fine, counts, 0))])

    def keys(self) -> np.ndarray:
        return self.ids_a[self.link_a] << 32 | self.ids_b[self.link_b]

    def digests(self) -> list[str]:
        """SHA-256 of every document's groups as text, '' for one without tokens."""
        if not len(self.link_a):
            return [""] * (len(self.before_a) - 1)
        size_a, size_b = np.diff(self.link_a, prepend=-1), np.diff(self.link_b, prepend=-1)
        n = len(self.ids_a) + len(self.ids_b)
        first = np.cumsum(size_a + size_b) - size_a - size_b
        at_a, at_b = ranges(first, size_a), ranges(first + size_a, size_b)
        ids, signs = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.ids_a, self.ids_b
        signs[at_a[self.link_a]], signs[at_b[self.link_b]] = ord("|"), ord(";")
        digits = np.char.str_len(np.arange(int(ids.max()) + 1).astype(str))
        spelled = np.frombuffer("".join(f"{i:<{digits[-1] + 1}}" for i in range(len(digits))).encode(), np.uint8).reshape(len(digits), -1)
        wide, size = spelled[ids], digits[ids]
        wide[np.arange(n), size] = signs
        text = memoryview(wide[np.arange(wide.shape[1]) <= size[:, None]].tobytes())
        ends = np.concatenate([[0], np.cumsum(size + 1)])[self.before_a + self.before_b].tolist()
        return [hashlib.sha256(text[a:b - 1]).hexdigest() if b > a else "" for a, b in zip(ends, ends[1:])]


def tokenizers_of(spark: SparkSession, path_a: str, path_b: str) -> tuple[Broadcast, Broadcast]:
    with open(path_b, "rb") as f:
        return vocabulary(spark, path_a), spark.sparkContext.broadcast(f.read())


def _aligned(batches: Iterator[pa.RecordBatch], words: Broadcast, model: Broadcast) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    vocab, pieces = words.value, Pieces.of(model.value)
    memory = WordMemory(vocab.encode_words, {})
    for batch in batches:
        for rows, data, offsets in text_slices(batch, "text", SLICE_TEXT):
            yield rows, Aligned(vocab, memory, pieces, data, offsets)


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, both id lists, the linked tokens (places in them, one pair a cut) and the cuts (bytes of a blank and the text)."""
    words, model = tokenizers_of(docs.sparkSession, path_a, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _aligned(batches, words, model):
            counts = np.diff(found.before_links)
            own = lambda values, before: pa.array(values - np.repeat(before[:-1], counts), pa.int64())
            lists = lambda before, values: pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([
                rows.column(0), lists(found.before_a, found.ids_a), lists(found.before_b, found.ids_b), lists(found.before_links, own(found.link_a, found.before_a)),
                lists(found.before_links, own(found.link_b, found.before_b)), lists(found.before_links, own(found.ends_a[found.link_a], found.starts))],
                ["doc_id", "ids_a", "ids_b", "links_a", "links_b", "cuts"])
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, ids_a array<long>, ids_b array<long>, links_a array<long>, links_b array<long>, cuts array<long>")


def slices(docs: DataFrame, words: Broadcast, model: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for rows, found in _aligned(batches, words, model):
            keys, place = np.unique(found.keys(), return_inverse=True)
            totals = np.bincount(place, minlength=len(keys))
            n_links = np.diff(found.before_links)
            pairs, times = np.unique(np.repeat(np.arange(rows.num_rows), n_links) << 32 | place, return_counts=True)
            n_pairs = np.bincount(pairs >> 32, minlength=rows.num_rows)
            row = {"slice": number, "doc_ids": rows.column(0).to_pylist(), "n_a": np.diff(found.before_a), "n_b": np.diff(found.before_b), "n_links": n_links, "digests": found.digests(),
                   "n_pairs": n_pairs, "steps": planes(steps_of(pairs & 0xFFFFFFFF, n_pairs)), "times": planes(times), "keys": keys, "totals": totals}
            longs = pa.list_(pa.int64())
            kinds = [pa.int64(), longs, longs, longs, longs, pa.list_(pa.string()), longs, pa.binary(), pa.binary(), longs, longs]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))
            number += 1
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, _SLICES)


def pair_counts(staged: DataFrame) -> DataFrame:
    """key (A id and B id), links over the corpus, and whether no pair of the same B id has more."""
    pairs = staged.select(F.explode(F.arrays_zip("keys", "totals")).alias("pair"))
    counted = settle(pairs.groupBy(F.col("pair.keys").alias("key")).agg(F.sum("pair.totals").alias("links")).withColumn("b", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))))
    most = counted.groupBy("b").agg(F.max("links").alias("most"))
    return counted.join(most, "b").select("key", "links", (F.col("links") == F.col("most")).alias("best"))


def link_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: tokens of both, groups, links, links that are the best of their B id, sum of the links' counts, digest of the groups."""
    spark = docs.sparkSession
    words, model = tokenizers_of(spark, path_a, path_b)
    folder = fresh_dir(spark, "aligned")
    slices(docs, words, model).write.option("compression", "zstd").parquet(folder)
    staged = spark.read.parquet(folder)
    asked = spark.read.parquet(folder).select("slice", F.posexplode("keys").alias("place", "key"))
    told = asked.join(pair_counts(staged), "key").select("slice", "place", "links", "best")

    def run(mine: pa.Table, told: pa.Table) -> pa.Table:
        row = mine.to_pylist()[0]
        order = np.argsort(told.column("place").to_numpy())
        links, best = told.column("links").to_numpy()[order], told.column("best").to_numpy()[order].astype(np.int64)
        if len(links) != row["n_keys"]:
            raise ValueError("answers do not match the slice")
        n_pairs, times = np.array(row["n_pairs"], np.int64), from_planes(row["times"])
        places, ends = places_of(from_planes(row["steps"]), n_pairs), np.cumsum(n_pairs)

        def per_document(values: np.ndarray) -> np.ndarray:
            running = np.concatenate([[0], np.cumsum(values[places] * times)])
            return running[ends] - running[ends - n_pairs]
        n_links = pa.array(row["n_links"], pa.int64())
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_a": pa.array(row["n_a"], pa.int64()), "n_b": pa.array(row["n_b"], pa.int64()), "n_groups": n_links, "n_links": n_links,
                         "n_best": per_document(best), "count_sum": per_document(links), "groups_sha256": pa.array(row["digests"], pa.string())})
    own = staged.select("slice", "doc_ids", "n_a", "n_b", "n_links", "digests", "n_pairs", "steps", "times", F.size("keys").alias("n_keys"))
    return own.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
