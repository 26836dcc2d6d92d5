"""Quality scores by votes of the nearest labelled documents in a latent-semantic space.

A text becomes counts of character-shape trigrams (lower, upper, digit, blank, line end, each sign), of hashed words
and of words that repeat the word before, each group as square roots of shares. A truncated singular value
decomposition of the labelled sample gives ``RANK`` directions. Every document's exact cosines with all labelled
vectors are computed in blocks; the ``NEIGHBOURS`` nearest vote with their label, weighted by similarity.

Bounds (documented parameters; only the fit is sampled): ``SAMPLE_ROWS`` labelled documents, those with the smallest
hash of the id. Their vectors (about 1 MB) and the directions are broadcast, so the broadcast does not grow with the
data. Rows held out (crc32 of the id leaves 1 modulo 3) are never learnt from; a score reads text only. One pass over
the documents to fit, one to score, no shuffle of texts.

Cases: a text without features (null, empty) scores the sample's mean label, a model without labels 0.5; null labels
are skipped, several labels of one document are averaged; repeated rows each give a row; equal similarities go to the
smaller sample id; long texts are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.llm.bytewords import LOWER, edges, hash_ranges, mix, space_words, text_slices
from itemforge.llm.shared import held_out, table

SAMPLE_ROWS, RANK, NEIGHBOURS, BLOCK_ROWS, SHAPES, WORDS = 4_000, 48, 15, 1_024, 1_024, 512
WIDTH = SHAPES + WORDS + 1


def _shape_table() -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[65:91], out[48:58], out[[9, 32]], out[[10, 13]], out[ord(".")], out[ord(",")] = 1, 2, 3, 4, 5, 6
    signs = [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,"]
    out[signs] = 7 + np.arange(len(signs)) % 25
    return out


SHAPE = _shape_table()
SHAPE_BUCKET = (mix(np.arange(32 ** 3, dtype=np.uint64)) % np.uint64(SHAPES)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, WIDTH) square roots of shares; a row of zeros for a text without any."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    shape, first = SHAPE[data], edges(offsets, len(data))
    code = SHAPE_BUCKET[shape[:-2] << 10 | shape[1:-1] << 5 | shape[2:]] if len(data) > 2 else np.zeros(0, np.int64)
    whole = ~(first[1:-1] | first[2:]) if len(data) > 2 else np.zeros(0, bool)
    lowered = LOWER[data]
    starts, ends, bounds = space_words(lowered, offsets)
    words = hash_ranges(lowered, starts, ends)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    again = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    count = lambda rows, cols, size: np.bincount(rows * size + cols, minlength=n * size).reshape(n, size).astype(np.float32)
    shapes = count(doc[:len(code)][whole], code[whole], SHAPES)
    spelled = count(owner, (words % np.uint64(WORDS)).astype(np.int64), WORDS)
    repeats = np.bincount(owner[1:][again], minlength=n)[:, None]
    share = lambda x, total: np.sqrt(x / np.maximum(total, 1))
    total = np.diff(bounds)[:, None]
    return np.concatenate([share(shapes, shapes.sum(axis=1, keepdims=True)), 0.5 * share(spelled, total), share(repeats, total + 30)], axis=1).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.directions
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        some = np.flatnonzero(x.any(axis=1)) if len(self.labels) else np.zeros(0, np.int64)
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(some), BLOCK_ROWS):
            rows = some[at:at + BLOCK_ROWS]
            cosine = self.latent(x[rows]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6).astype(np.float64)
            out[rows] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def decompose(x: np.ndarray, labels: np.ndarray) -> Model:
    """The leading directions of the sample by a randomised range finder with two power steps."""
    some = x.any(axis=1)
    x, labels = x[some], labels[some]
    if not len(x):
        return Model(np.zeros(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    mean = x.mean(axis=0)
    a = x - mean
    rank = min(RANK, *a.shape)
    y = a @ np.random.default_rng(7).standard_normal((a.shape[1], min(rank + 16, a.shape[1]))).astype(np.float32)
    for _ in range(2):
        y = a @ (a.T @ np.linalg.qr(y)[0])
    basis = np.linalg.qr(y)[0]
    directions = np.linalg.svd(basis.T @ a, full_matrices=False)[2][:rank].T
    model = Model(mean, directions, np.zeros((0, rank), np.float32), labels)
    model.vectors = model.latent(x).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.select(labels["doc_id"].cast("long").alias("id"), labels["quality"].cast("double").alias("quality"))
    known = known.filter(F.col("quality").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.avg("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)  # the documented bound of the sample
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    sample = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text", most=2_048):
                packed = [x.tobytes() for x in features(data, offsets).astype(np.float16)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(packed, pa.binary())], ["id", "quality", "x"])
    found = sample.mapInArrow(run, "id long, quality double, x binary").orderBy(F.xxhash64("id"), "id", "x").limit(SAMPLE_ROWS).collect()
    x = np.frombuffer(b"".join(r.x for r in found), np.float16).reshape(len(found), WIDTH).astype(np.float32)
    return decompose(x, np.array([r.quality for r in found], np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text", most=2_048):
                got = shared.value.scores(features(data, offsets))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(got, pa.float64()), pa.array((got >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
