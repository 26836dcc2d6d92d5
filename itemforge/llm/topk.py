"""Exact top-k search over an impact-ordered index, score at a time.

Vectors become integers floor(64 x). A task indexes one block of candidates: for every impact class (the power of two
that a component's size reaches) a segment with the postings of that class. Queries stream past in batches. Segments
are worked by falling class into accumulators; the part of a score still open is at most the product of the query's
norm and the norm of the candidate's postings in the classes left. Work stops only when that bound proves which
candidates can be among the k best, and those are rescored exactly in integers; with no class left the bound is zero.

The blocks' winners are merged by one window per query, k rows from every block at most.

Scale: queries visit every block, as an exact search over all rows must; candidates are dealt into blocks of about
``BLOCK`` by a hash of vec_id, and a task holds one block and one batch of queries.

Cases: vectors that are null or hold null or non-finite components take no part; zero and empty vectors do, with score
0; vectors of different lengths are not compared; ties go to the smaller vec_id; a query has all other rows if there
are fewer than k; rows that repeat a query's vec_id are never its results; repeated candidates are each listed; a
null vec_id is neither query nor candidate; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemforge.llm.shared import settle, table

SCALE, BLOCK, BATCH, FEW = 64.0, 8_192, 256, 8
FOUND = "query_id long, query binary, vec_id long, score long"


class ImpactIndex:
    """Segments of one block by falling impact class, and the norms of what lower classes hold."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        size = np.abs(self.vectors)
        classes = np.where(size > 0, np.floor(np.log2(np.maximum(size, 1))).astype(np.int64) + 1, 0)
        self.segments, left = [], self.vectors.astype(np.float64)
        for c in range(int(classes.max(initial=0)), 0, -1):
            if (classes == c).any():
                segment = np.where(classes == c, self.vectors, 0).astype(np.float64)
                left = left - segment
                self.segments.append((segment, np.sqrt((left * left).sum(axis=1)) * (1 + 1e-9)))
        self.largest = int(size.max(initial=0))

    def best(self, names: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, candidate's id, exact score) of at least every member of each query's k best here."""
        q = queries.astype(np.float64)
        norm = np.sqrt((q * q).sum(axis=1)) * (1 + 1e-9)
        own = names[:, None] == self.ids[None, :]
        score, n = np.zeros((len(q), len(self.ids))), len(self.ids)
        possible = ~own
        slack = 1e-6 * (1 + norm[:, None] * max(1, self.largest))
        for segment, rest in self.segments:
            score += q @ segment.T
            open_ = norm[:, None] * rest[None, :] + slack
            if n > k:
                low = np.where(own, -np.inf, score - open_)
                bar = np.partition(low, n - k, axis=1)[:, n - k]
                possible = (score + open_ >= bar[:, None]) & ~own
            if possible.sum() <= FEW * k * len(q):
                break
        row, at = np.nonzero(possible)
        exact = np.empty(len(row), np.int64)
        for x in range(0, len(row), 65_536):
            exact[x:x + 65_536] = np.einsum("xd,xd->x", queries[row[x:x + 65_536]], self.vectors[at[x:x + 65_536]])
        order = np.lexsort((self.ids[at], -exact, row))
        row, at, exact = row[order], at[order], exact[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        return row[keep], self.ids[at[keep]], exact[keep]


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and the integer components (64-bit, little-endian) of every row that takes part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, packed = [], [], []
            for name, value in zip(batch.column(0), batch.column(1)):
                if name.is_valid and value.is_valid and value.values.null_count == 0:
                    x = np.floor(SCALE * value.values.to_numpy(zero_copy_only=False).astype(np.float64))
                    if np.isfinite(x).all():
                        names.append(name.as_py())
                        sizes.append(len(x))
                        packed.append(x.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], ["vec_id", "dim", "vector"])
    return vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, dim int, vector binary")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``, against all rows."""
    spark, rows = vectors.sparkSession, settle(integer_vectors(vectors))
    blocks = max(1, -(-rows.count() // BLOCK))
    members = rows.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "vector")
    queries = rows.filter(F.col("vec_id") % every == 0).select("dim", "vec_id", "vector").distinct()
    queries = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "vector")
    key = ["dim", "block"]
    sent = members.union(queries).repartition(max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *key).sortWithinPartitions(*key, "kind", "vec_id")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                dim, block, kind = keys[a].tolist()
                packed = batch.column(4).slice(a, b - a).to_pylist()
                names, found = batch.column(3).to_numpy()[a:b], np.frombuffer(b"".join(packed), "<i8").reshape(b - a, dim)
                if (dim, block) != now:
                    now, held, index = (dim, block), [], None
                if kind == 0:
                    held.append((names, found))
                    continue
                if index is None:
                    index = ImpactIndex(*(np.concatenate(x) for x in zip(*held))) if held else ImpactIndex(np.zeros(0, np.int64), np.zeros((0, dim), np.int64))
                for x in range(0, len(names), BATCH):
                    row, ids, score = index.best(names[x:x + BATCH], found[x:x + BATCH], k)
                    yield pa.RecordBatch.from_arrays([pa.array(names[x:x + BATCH][row]), pa.array([packed[x + r] for r in row.tolist()], pa.binary()), pa.array(ids), pa.array(score)],
                                                     ["query_id", "query", "vec_id", "score"])
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (sent.mapInArrow(visit, FOUND).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
