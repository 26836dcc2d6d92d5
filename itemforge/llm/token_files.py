"""Token ids as entropy-coded files: static range asymmetric numeral systems over one shared frequency table.

``write_token_files`` encodes whole texts with the tokenizers library, appends the end id, and writes, in ascending
order of doc_id, three Parquet tables under one folder:

* ``table``: id, frequency. Scaled counts over all documents, summing to 2^20; fixed size (at most the vocabulary).
* ``parts``: part, start. Ids before each part of the document order; one row per writing task.
* ``chunks``: part, seq, first (ids before the chunk in its part), doc_ids, lengths, payload.

A payload holds independent blocks of 65,536 ids. A block runs 256 interleaved coders (id i belongs to coder i mod 256)
that share one stream of 32-bit words, and stores the coders' states and the stream position every 128 rounds, so each
half of a block decodes alone, and a CRC-32. ``read_documents`` checks the sums and decodes all halves together.

Payload: b"RANS", version 1, ids, blocks (unsigned 32-bit, little-endian), then per block: ids, words, checkpoints,
CRC-32 of what follows; then per checkpoint 256 states (unsigned 64-bit) and a stream position (32-bit), then the words.

The library's model encodes every distinct pre-token of a worker's texts once, which gives the ids of the whole texts,
because byte-level encoding never crosses a pre-token; tokenizers of any other kind get the whole texts.

Scale: one range shuffle of (doc_id, text); the ids are staged once in the shared folder, counted there (one row per
id and task shuffled), and coded with no further shuffle. Files come from Spark's own writer, so lost tasks are redone.

Cases: null or empty text is the end id alone; a null doc_id sorts first; repeated rows each keep an entry; an empty
table writes empty tables; a document of any length is coded whole; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from itemforge.llm.bpe import WordMemory, byte_alphabet
from itemforge.llm.bytewords import text_slices
from itemforge.llm.shared import discard, fresh_dir, table

SCALE_BITS, LANES, BLOCK, INTERVAL = 20, 256, 65_536, 128
_LOW = np.uint64(1 << 32)


_encoders: dict[str, "LibraryEncoder"] = {}


def encoder_of(text: str) -> "LibraryEncoder":
    """The encoder of this Python worker, kept from task to task."""
    if text not in _encoders:
        _encoders.clear()
        _encoders[text] = LibraryEncoder(text)
    return _encoders[text]


class LibraryEncoder:
    """Ids of many texts from the tokenizers library."""

    def __init__(self, text: str):
        model = json.loads(text)
        self.tokenizer = Tokenizer.from_str(text)
        kind = model.get("pre_tokenizer") or {}
        added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in model.get("added_tokens", []))
        split = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and model.get("normalizer") is None and plain
        self.stand_in = {byte: char for char, byte in byte_alphabet().items()}
        self.memory = WordMemory(self._words, added) if split else None

    def _words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spelled = data.tobytes().decode("latin-1").translate(self.stand_in)  # one character for each byte
        found = [[t.id for t in self.tokenizer.model.tokenize(spelled[a:b])] for a, b in zip(starts.tolist(), ends.tolist())]
        return np.array([len(f) for f in found], np.int64), np.fromiter((i for f in found for i in f), np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.array([len(f) for f in found], np.int64), np.concatenate([*found, np.zeros(0, np.int64)])

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.memory:
            return self.memory.ids(data, offsets)
        raw = data.tobytes()
        counts, ids = self._whole([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
        return ids, np.concatenate([[0], np.cumsum(counts)])


def scaled(ids: np.ndarray, counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies by id that sum to 2^bits, at least 1 for every id seen, and at least two ids."""
    size, total = int(max(ids, default=0)) + 2, 1 << bits
    seen = np.zeros(size, np.int64)
    seen[ids] = counts
    if (seen > 0).sum() < 2:
        seen[[0, size - 1]] += 1
    if (seen > 0).sum() > total // 2:
        raise ValueError("too many distinct ids for the scale")
    out = np.where(seen > 0, np.maximum(1, np.round(seen * (total / seen.sum()))), 0).astype(np.int64)
    excess = int(out.sum()) - total
    for i in np.argsort(-out, kind="stable"):  # the commonest ids give or take the rounding
        step = min(excess, int(out[i]) - 1) if excess > 0 else excess
        out[i] -= step
        excess -= step
        if not excess:
            return out
    return out


class Coder:
    def __init__(self, frequencies: np.ndarray):
        self.freq = frequencies.astype(np.uint64)
        self.base = np.cumsum(self.freq) - self.freq
        self.most = self.freq << np.uint64(64 - SCALE_BITS)
        self.symbol = np.repeat(np.arange(len(frequencies)), frequencies)

    def _encode_blocks(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids (blocks, rounds, lanes): per block the states and positions of its checkpoints and its words."""
        blocks, rounds, _ = ids.shape
        x = np.full(blocks * LANES, _LOW, np.uint64)
        words, owners, states = [], [], []
        for t in range(rounds - 1, -1, -1):
            s = ids[:, t, :].ravel()
            out = np.flatnonzero(x >= self.most[s])
            words.append((x[out] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            owners.append(out // LANES)
            x[out] >>= np.uint64(32)
            f = self.freq[s]
            q = x // f
            x = (q << np.uint64(SCALE_BITS)) + (x - q * f) + self.base[s]
            if t % INTERVAL == 0:
                states.append(x.copy())
        words.reverse(), owners.reverse(), states.reverse()
        sent = np.array([np.bincount(o, minlength=blocks) for o in owners])
        before = np.concatenate([np.zeros((1, blocks), np.int64), np.cumsum(sent, axis=0)])[:rounds:INTERVAL]
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        stream, cuts = np.concatenate(words)[order], np.cumsum(np.bincount(owner, minlength=blocks))[:-1]
        held = np.stack(states).reshape(len(states), blocks, LANES)
        return [(held[:, b], before[:, b], part) for b, part in enumerate(np.split(stream, cuts))]

    def encode(self, ids: np.ndarray) -> bytes:
        full = len(ids) // BLOCK * BLOCK
        found = self._encode_blocks(ids[:full].reshape(-1, BLOCK // LANES, LANES)) if full else []
        sizes = [BLOCK] * len(found)
        if full < len(ids):
            tail = ids[full:]
            padded = np.concatenate([tail, np.full(-len(tail) % LANES, tail[-1])])
            found += self._encode_blocks(padded.reshape(1, -1, LANES))
            sizes.append(len(tail))
        out = [b"RANS", np.array([1, len(ids), len(found)], "<u4").tobytes()]
        for size, (states, positions, words) in zip(sizes, found):
            body = states.astype("<u8").tobytes() + positions.astype("<u4").tobytes() + words.astype("<u4").tobytes()
            out += [np.array([size, len(words), len(states), zlib.crc32(body)], "<u4").tobytes(), body]
        return b"".join(out)

    def _decode_rounds(self, x: np.ndarray, at: np.ndarray, words: np.ndarray, rounds: int) -> np.ndarray:
        out, mask, bits = np.empty((len(x), rounds, LANES), np.int64), np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
        for t in range(rounds):
            slot = x & mask
            s = self.symbol[slot.astype(np.int64)]
            out[:, t] = s
            x = self.freq[s] * (x >> bits) + slot - self.base[s]
            need = x < _LOW
            rank = np.cumsum(need, axis=1)
            x[need] = x[need] << np.uint64(32) | words[(at[:, None] + rank - 1)[need]]
            at = at + rank[:, -1]
        return out.reshape(len(out), -1)

    def decode(self, payload: bytes) -> np.ndarray:
        if payload[:4] != b"RANS":
            raise ValueError("not a token payload")
        _, total, blocks = np.frombuffer(payload, "<u4", 3, 4).tolist()
        at, sections, streams, placed, done = 16, {}, [], 0, 0
        for _ in range(blocks):
            size, words, marks, crc = np.frombuffer(payload, "<u4", 4, at).tolist()
            length = marks * (8 * LANES + 4) + 4 * words
            body = payload[at + 16:at + 16 + length]
            if zlib.crc32(body) != crc:
                raise ValueError("a token block fails its checksum")
            states = np.frombuffer(body, "<u8", marks * LANES).reshape(marks, LANES)
            positions = np.frombuffer(body, "<u4", marks, marks * LANES * 8).astype(np.int64)
            streams.append(np.frombuffer(body, "<u4", words, marks * (8 * LANES + 4)).astype(np.uint64))
            for k in range(marks):
                rounds = min(INTERVAL, -(-size // LANES) - k * INTERVAL)
                sections.setdefault(rounds, []).append((done + k * INTERVAL * LANES, states[k], placed + positions[k]))
            at, placed, done = at + 16 + length, placed + words, done + size
        out, stream = np.empty(total + LANES, np.int64), np.concatenate([*streams, np.zeros(1, np.uint64)])
        for rounds, group in sections.items():
            found = self._decode_rounds(np.stack([g[1] for g in group]).astype(np.uint64), np.array([g[2] for g in group]), stream, rounds)
            for (start, _, _), ids in zip(group, found):
                end = min(start + len(ids), total)
                out[start:end] = ids[:end - start]
        return out[:total]


def _stage_ids(docs: DataFrame, tokenizer: Broadcast, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, first = encoder_of(tokenizer.value), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                ids, before = encoder.ids(data, offsets)
                ids = np.insert(ids, before[1:], end_id)
                lengths = np.diff(before) + 1
                one = lambda values, kind: pa.array([values], kind)
                yield pa.RecordBatch.from_arrays([
                    one(part, pa.int32()), one(seq, pa.int32()), one(first, pa.int64()), one(len(ids), pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), rows.column(0)), one(lengths.tolist(), pa.list_(pa.int32())),
                    one(ids.astype("<u4" if ids.max() > 65_535 else "<u2").tobytes(), pa.binary())],
                    ["part", "seq", "first", "n_tokens", "doc_ids", "lengths", "ids"])
                seq, first = seq + 1, first + len(ids)
    ordered = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, "part int, seq int, first long, n_tokens long, doc_ids array<long>, lengths array<int>, ids binary")


def _plain(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if len(packed) == 2 * n else "<u4").astype(np.int64)


def _counts(staged: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for packed, n in zip(batch.column(0), batch.column(1)):
                got = np.bincount(_plain(packed.as_py(), n.as_py()), minlength=len(total))
                got[:len(total)] += total
                total = got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])
    return staged.select("ids", "n_tokens").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 0) -> None:
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())
    staging = fresh_dir(spark, "token-ids")
    _stage_ids(docs, tokenizer, end_id).write.option("compression", "zstd").parquet(staging)
    staged = spark.read.parquet(staging)
    counted = _counts(staged).collect()  # at most one row per vocabulary entry
    frequencies = scaled(np.array([r.id for r in counted], np.int64), np.array([r.n for r in counted], np.int64))
    coder = spark.sparkContext.broadcast(frequencies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Coder(coder.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                payload = own.encode(_plain(row.column(6)[0].as_py(), row.column(3)[0].as_py()))
                yield pa.RecordBatch.from_arrays([*[row.column(k) for k in (0, 1, 2, 4, 5)], pa.array([payload], pa.binary())],
                                                 ["part", "seq", "first", "doc_ids", "lengths", "payload"])
    staged.mapInArrow(run, "part int, seq int, first long, doc_ids array<long>, lengths array<int>, payload binary").write.option("compression", "none").parquet(f"{path}/chunks")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per writing task
    parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")).coalesce(1).write.parquet(f"{path}/parts")
    used = np.flatnonzero(frequencies)
    spark.createDataFrame([(int(i), int(frequencies[i])) for i in used], "id int, frequency int").coalesce(1).write.parquet(f"{path}/table")
    discard(spark, staging)


def _decoded(spark: SparkSession, path: str, make, columns: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ...) of every document; ``make`` turns (ids, bounds) of a chunk into the last column."""
    rows = spark.read.parquet(f"{path}/table").collect()  # the shared table, fixed size
    frequencies = np.zeros(max(r.id for r in rows) + 1, np.int64)
    frequencies[[r.id for r in rows]] = [r.frequency for r in rows]
    coder = spark.sparkContext.broadcast(frequencies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Coder(coder.value)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths = own.decode(batch.column(4)[i].as_py()), np.array(batch.column(3)[i].as_py(), np.int64)
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                n = len(lengths)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, batch.column(0)[i].as_py()), pa.int32()), batch.column(2)[i].values,
                    pa.array(batch.column(1)[i].as_py() + bounds[:-1], pa.int64()), pa.array(lengths, pa.int64()), make(ids, bounds)],
                    ["part", "doc_id", "place", "n_tokens", "made"])
    chunks = spark.read.parquet(f"{path}/chunks").select("part", "first", "doc_ids", "lengths", "payload")
    found = chunks.mapInArrow(run, f"part int, doc_id long, place long, n_tokens long, made {columns}")
    return found.join(spark.read.parquet(f"{path}/parts"), "part").select("doc_id", (F.col("start") + F.col("place")).alias("start"), "n_tokens", "made")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (array of int) of every document in the files."""
    def lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
    return _decoded(spark, path, lists, "array<int>").withColumnRenamed("made", "ids")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    def sums(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        raw, cuts = memoryview(ids.astype("<u4").tobytes()), (bounds * 4).tolist()
        return pa.array([zlib.crc32(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.int64())
    return _decoded(spark, path, sums, "long").withColumnRenamed("made", "ids_crc32")


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_checksums(spark, path)
