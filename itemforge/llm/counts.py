"""Token counts from pre-tokens: pieces are counted once per distinct pre-token and summed over documents.

1. A task cuts slices of texts into pre-tokens and keeps, per slice, the distinct ones and, per document, which of them it
   holds how often. One row a slice is written to the shared folder.
2. The distinct pre-tokens of every slice go to buckets by hash. A bucket holds each pre-token's every copy, counts the
   pieces of each distinct one once with the tokenizer library's own model, and answers each slice with the counts.
3. A slice's document frequencies meet its answers, and each document's count is the sum of frequency times pieces.
   No ids are made.

Exact: byte-level encoding never crosses a pre-token, and pre-tokens are compared by their bytes, not by hashes.

Scale: a pre-token of every document leaves a slice once, so no bucket is hot; the number of buckets follows the measured
bytes, a bucket holding about ``BUCKET_BYTES``. Shuffled are the distinct pre-tokens of slices, their counts, and about two
bytes per (document, distinct pre-token), byte planes apart so that they compress. Memory follows a slice of 4 MB, one
document where that is larger, or a bucket. The only broadcast is the tokenizer file.

Cases: null text is empty, with 0 bytes and 0 tokens; the string of an added token inside a text is that one token, as is
the library's default; repeated rows each give a row; a null doc_id stays null; an empty table gives no rows; texts of any
length are handled whole; other columns are not read. A tokenizer file that is no plain byte-level BPE is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from itemforge.llm.bpe import byte_alphabet, pre_tokens
from itemforge.llm.bytewords import hash_ranges, text_slices
from itemforge.llm.packing import from_planes, places_of, planes, steps_of
from itemforge.llm.shared import fresh_dir, table

SLICE_TEXT, BUCKET_BYTES, LIMIT = 4 << 20, 8 << 20, 512
_SLICES = "slice long, doc_ids array<long>, n_bytes array<long>, n_added array<long>, n_pairs array<long>, steps binary, times binary, words binary, lengths binary, size long"
_models: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """The library's model of a byte-level file, and its added tokens."""

    def __init__(self, text: str):
        model = json.loads(text)
        kind, added = model.get("pre_tokenizer") or {}, model.get("added_tokens", [])
        if kind.get("type") != "ByteLevel" or not kind.get("use_regex", True) or kind.get("add_prefix_space") or model.get("normalizer") is not None:
            raise ValueError("not a plain byte-level tokenizer")
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            raise ValueError("added tokens that take in their surroundings")
        self.model, self.stand_in = Tokenizer.from_str(text).model, {byte: char for char, byte in byte_alphabet().items()}
        self.added = regex.compile(b"|".join(regex.escape(t["content"].encode()) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None

    @staticmethod
    def of(text: str) -> "PieceCounter":
        """That of this Python worker, kept from task to task."""
        if text not in _models:
            _models.clear()
            _models[text] = PieceCounter(text)
        return _models[text]

    def pieces(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((len(self.model.tokenize(w.decode("latin-1").translate(self.stand_in))) for w in words), np.int64, len(words))

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes without added tokens, the ends that no pre-token crosses, the documents' offsets, and the added tokens of each."""
        spans = np.array([m.span() for m in self.added.finditer(data.tobytes())] if self.added else [], np.int64).reshape(-1, 2)
        inside = np.searchsorted(offsets, spans[:, 0], side="right") == np.searchsorted(offsets, spans[:, 1], side="left")
        spans = spans[inside]  # a match over the border of two documents is none
        owner = np.searchsorted(offsets, spans[:, 0], side="right") - 1
        n_added = np.bincount(owner, minlength=len(offsets) - 1)
        if not len(spans):
            return data, offsets, offsets, n_added
        keep = np.ones(len(data), bool)
        for a, b in spans.tolist():
            keep[a:b] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        return data[keep], kept[np.unique(np.concatenate([offsets, spans.ravel()]))], kept[offsets], n_added


def words_of(pool: bytes, lengths: np.ndarray) -> pa.LargeBinaryArray:
    cuts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(cuts), pa.py_buffer(pool)])


def pool_of(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words and the place each starts at (one more at the end)."""
    _, where, data = words.buffers()
    cuts = np.frombuffer(where, np.int64)[words.offset:words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[cuts[0]:cuts[-1]], cuts - cuts[0]


def frequencies(starts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words (bytes, starts) by hash, and per document how many of them it has, their places and times."""
    cuts = np.concatenate([starts, [len(data)]]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    pool, at = pool_of(coded.dictionary)
    order = np.argsort(hash_ranges(pool, at[:-1], at[1:]), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    pool, at = pool_of(coded.dictionary.take(pa.array(order)))
    owner = np.searchsorted(offsets, starts, side="right") - 1
    pairs, times = np.unique(owner << 32 | place[coded.indices.to_numpy(zero_copy_only=False)], return_counts=True)
    return pool, at, np.bincount(pairs >> 32, minlength=len(offsets) - 1), pairs & 0xFFFFFFFF, times


def slices(docs: DataFrame, model: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, number = PieceCounter.of(model.value), TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text", SLICE_TEXT):
                plain, ends, at, n_added = counter.plain(data, offsets)
                pool, cuts, n_pairs, places, times = frequencies(pre_tokens(plain, ends), plain, at)
                row = {"slice": number, "doc_ids": rows.column(0).to_pylist(), "n_bytes": np.diff(offsets), "n_added": n_added, "n_pairs": n_pairs, "steps": planes(steps_of(places, n_pairs)),
                       "times": planes(times), "words": pool.tobytes(), "lengths": planes(np.diff(cuts)), "size": len(pool) + 4 * len(cuts)}
                kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4, *[pa.binary()] * 4, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))
                number += 1
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, _SLICES)


def asked(staged: DataFrame, buckets: int) -> DataFrame:
    """The distinct pre-tokens of every slice, cut into buckets by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                pool, lengths = np.frombuffer(raw, np.uint8), from_planes(lengths)
                cuts = np.concatenate([[0], np.cumsum(lengths)])
                to = (hash_ranges(pool, cuts[:-1], cuts[1:]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                there, first = np.unique(to, return_index=True)
                edge = np.append(first, len(lengths)).tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(there.astype(np.int64)), pa.array([number] * len(there), pa.int64()),
                    pa.array([raw[cuts[a]:cuts[b]] for a, b in zip(edge, edge[1:])], pa.binary()),
                    pa.array([planes(lengths[a:b]) for a, b in zip(edge, edge[1:])], pa.binary())], ["bucket", "slice", "words", "lengths"])
    return staged.select("slice", "words", "lengths").mapInArrow(run, "bucket long, slice long, words binary, lengths binary")


def answered(questions: DataFrame, model: Broadcast) -> DataFrame:
    """Pieces of every pre-token asked for, in the order asked: each distinct one is counted once."""
    def run(group: pa.Table) -> pa.Table:
        counter, lengths = PieceCounter.of(model.value), [from_planes(x) for x in group.column("lengths").to_pylist()]
        coded = words_of(b"".join(group.column("words").to_pylist()), np.concatenate(lengths)).dictionary_encode()
        pieces = counter.pieces(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        counts = [planes(p) for p in np.split(pieces, np.cumsum([len(x) for x in lengths])[:-1])]
        return pa.table({"slice": group.column("slice"), "bucket": group.column("bucket"), "counts": pa.array(counts, pa.binary())})
    return questions.groupBy("bucket").applyInArrow(run, "slice long, bucket long, counts binary")


def summed(staged: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_tokens."""
    def run(mine: pa.Table, told: pa.Table) -> pa.Table:
        order = np.argsort(told.column("bucket").to_numpy()).tolist()
        counts = told.column("counts").to_pylist()
        pieces = np.concatenate([np.zeros(0, np.int64), *[from_planes(counts[i]) for i in order]])
        row = mine.to_pylist()[0]
        if len(pieces) * 4 != row["words_asked"]:
            raise ValueError("answers do not match the slice")
        n_pairs = np.array(row["n_pairs"], np.int64)
        running = np.concatenate([[0], np.cumsum(pieces[places_of(from_planes(row["steps"]), n_pairs)] * from_planes(row["times"]))])
        ends = np.cumsum(n_pairs)
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_bytes": pa.array(row["n_bytes"], pa.int64()),
                         "n_tokens": pa.array(running[ends] - running[ends - n_pairs] + np.array(row["n_added"], np.int64))})
    own = staged.select("slice", "doc_ids", "n_bytes", "n_added", "n_pairs", "steps", "times", F.octet_length("lengths").cast("long").alias("words_asked"))
    return own.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every text, for a byte-level tokenizer file."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        text = f.read()
    PieceCounter.of(text)  # an unfit file fails here
    model, folder = spark.sparkContext.broadcast(text), fresh_dir(spark, "slices")
    slices(docs, model).write.option("compression", "zstd").parquet(folder)
    staged = spark.read.parquet(folder)
    size = staged.agg(F.sum("size")).first()[0] or 0
    return summed(staged, answered(asked(staged, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))), model))


def op13_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
