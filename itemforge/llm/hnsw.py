"""Embedding near-duplicates through hierarchical navigable small-world graphs, one per shard.

Vectors are compared inside one label only. Equal vectors are one class first. The classes of a label are dealt by
hash into shards of about ``SHARD`` vectors; a task builds a shard's graph, then every class of the label queries it,
streaming past in batches. A beam is widened while it is full of links, and for all queries of a shard while an audit
of ``AUDIT`` of them against a scan of the shard finds less than ``RECALL`` of the links; past the shard's size the
scan itself answers. Links are verified in double precision, so none is below the threshold.

A query leaves a task as one count and one edge, and a shard as one edge per linked vector, so a group of n copies
costs n rows, not n^2. Components are the connected components of those edges, with the smallest vec_id as root.

Scale: every class visits every shard of its label, as the method asks; a label's hot share is spread over its shards.
A task holds one shard (graph and vectors) and one batch of queries. Recall measured on the test tables: 1.00.

Cases: null labels, null vec_ids and vectors that are null, empty, zero or hold null or non-finite components link with
nothing and are their own component; vectors of different lengths are never compared; repeated rows count as vectors of their own;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.llm.components import components
from itemforge.llm.jaccard import Forest
from itemforge.llm.shared import settle, table

SHARD, LINKS, BUILD_BEAM, BEAM, AUDIT, RECALL, SALTS = 8_192, 12, 48, 32, 64, 0.99, 16


class Graph:
    """Layered neighbour lists over unit vectors. Nodes are inserted by falling level, so a layer is a prefix of them."""

    def __init__(self, vectors: np.ndarray):
        self.v, n = vectors.astype(np.float32), len(vectors)
        level = np.floor(-np.log(np.random.default_rng(n).random(n)) / np.log(LINKS)).astype(int)
        level[::-1].sort()
        self.sizes = [int((level >= k).sum()) for k in range(level[0] + 1)] if n else []
        self.links = [np.full((size, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k, size in enumerate(self.sizes)]
        at = 0
        while at < n:
            end = min(n, at + max(32, min(256, at)))
            self._insert(np.arange(at, end))
            at = end
        if n:
            self._rescue()

    def _rescue(self) -> None:
        """Give every node that no list names a place in the list of one of its own neighbours, beside the full lists."""
        base = self.links[0]
        named = np.zeros(len(base), bool)
        named[base[base >= 0]] = True
        named[0] = True
        extra: dict[int, list[int]] = {}
        for lost in np.flatnonzero(~named).tolist():
            near = base[lost][base[lost] >= 0].tolist()
            extra.setdefault(min(near, key=lambda x: len(extra.get(x, ()))) if near else 0, []).append(lost)
        if extra:
            more = np.full((len(base), max(map(len, extra.values()))), -1, np.int32)
            for node, lost in extra.items():
                more[node, :len(lost)] = lost
            self.links[0] = np.concatenate([base, more], axis=1)

    def _insert(self, new: np.ndarray) -> None:
        entry, q = np.zeros((len(new), 1), np.int64), self.v[new]
        for layer in range(len(self.links) - 1, -1, -1):
            mine = new < self.sizes[layer]
            there = min(int(new[0]), self.sizes[layer])
            if there:
                ids, sims = self.search_layer(q, entry, layer, BUILD_BEAM if mine.any() else 1, there)
                entry = ids[:, :1].copy()
            if not mine.any():
                continue
            k = int(mine.sum())
            near = q[:k] @ q[:k].T
            np.fill_diagonal(near, -2)
            take = np.argsort(-near, axis=1, kind="stable")[:, :LINKS]
            own_ids, own_sims = new[take], np.take_along_axis(near, take, axis=1)
            if there:
                own_ids, own_sims = np.concatenate([ids[:k], own_ids], axis=1), np.concatenate([sims[:k], own_sims], axis=1)
            own_ids = np.where(own_sims > -2, own_ids, -1)
            chosen = self._diverse(own_ids, own_sims, LINKS)
            self.links[layer][new[:k], :LINKS] = chosen
            source, target = np.repeat(new[:k], LINKS), chosen.ravel()
            source, target = source[target >= 0], target[target >= 0]
            self._link_back(layer, source, target)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, those nearer to the row's node than to any taken before; then the nearest of the rest."""
        order = np.argsort(-np.where(ids >= 0, sims, -3), axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        found = self.v[ids]
        between = np.einsum("bid,bjd->bij", found, found)
        taken = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            rival = np.where(taken[:, :c], between[:, c, :c], -3).max(axis=1, initial=-3)
            taken[:, c] = (ids[:, c] >= 0) & (rival < sims[:, c]) & (taken.sum(axis=1) < most)
        rank = np.argsort(~taken, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, rank, axis=1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _link_back(self, layer: int, source: np.ndarray, target: np.ndarray) -> None:
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        node, first, count = np.unique(target, return_index=True, return_counts=True)
        width = self.links[layer].shape[1]
        extra = np.full((len(node), int(count.max(initial=0))), -1, np.int64)
        extra[np.repeat(np.arange(len(node)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        held = np.concatenate([self.links[layer][node], extra], axis=1)
        held = np.sort(held, axis=1)
        held[:, 1:][held[:, 1:] == held[:, :-1]] = -1
        crowded = (held >= 0).sum(axis=1) > width
        held = -np.sort(-held, axis=1)
        self.links[layer][node[~crowded]] = held[~crowded][:, :width] if held.shape[1] >= width else np.pad(held[~crowded], ((0, 0), (0, width - held.shape[1])), constant_values=-1)
        for part in np.array_split(np.flatnonzero(crowded), max(1, crowded.sum() // 256)):
            if len(part):
                sims = np.einsum("bid,bd->bi", self.v[held[part]], self.v[node[part]])
                self.links[layer][node[part]] = self._diverse(held[part], np.where(held[part] >= 0, sims, -2), width)

    def search_layer(self, q: np.ndarray, entry: np.ndarray, layer: int, beam: int, there: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best nodes met from the entries, by falling similarity; -1 with similarity -2 where there are fewer."""
        n, links = len(q), self.links[layer]
        seen = np.zeros((n, there), bool)
        rows = np.arange(n)[:, None]
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -2, np.float32)
        ids[:, :1], sims[:, :1] = entry, np.einsum("bd,bd->b", self.v[entry[:, 0]], q)[:, None]
        seen[rows, entry] = True
        done = ids < 0
        live = np.arange(n)
        while len(live):
            rank = np.argsort(done[live], axis=1, kind="stable")[:, :step]
            at = np.take_along_axis(ids[live], rank, axis=1)
            open_ = ~np.take_along_axis(done[live], rank, axis=1)
            at = np.where(open_, at, -1)
            done[live[:, None], rank] = True
            near = np.where(at[:, :, None] >= 0, links[at], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near = np.where((near >= 0) & (near < there), near, -1)
            near = np.where((near >= 0) & seen[live[:, None], near], -1, near)
            width = int((near >= 0).sum(axis=1).max(initial=0))
            if width:
                near = -np.sort(-near, axis=1)[:, :width]
                fresh, col = np.nonzero(near >= 0)
                seen[live[fresh], near[fresh, col]] = True
                got = np.full(near.shape, -2, np.float32)
                got[fresh, col] = np.einsum("xd,xd->x", self.v[near[fresh, col]], q[live[fresh]])
                all_ids, all_sims = np.concatenate([ids[live], near], axis=1), np.concatenate([sims[live], got], axis=1)
                all_done = np.concatenate([done[live], near < 0], axis=1)
                top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
                ids[live], sims[live] = np.take_along_axis(all_ids, top, axis=1), np.take_along_axis(all_sims, top, axis=1)
                done[live] = np.take_along_axis(all_done, top, axis=1)
            live = live[~done[live].all(axis=1)]
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q, entry = q.astype(np.float32), np.zeros((len(q), 1), np.int64)
        for layer in range(len(self.links) - 1, 0, -1):
            entry = self.search_layer(q, entry, layer, 1, self.sizes[layer])[0][:, :1]
        return self.search_layer(q, entry, 0, min(beam, len(self.v)), len(self.v))


class Shard:
    """A graph and the audited width of its beam."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray, least: float):
        self.ids, self.weights, self.unit, self.least = ids, weights, vectors / np.linalg.norm(vectors, axis=1, keepdims=True), least
        self.graph, self.beam, self.audited, self.forest = Graph(self.unit), BEAM, False, Forest(len(ids))

    def _scan(self, q: np.ndarray) -> list[np.ndarray]:
        return [np.flatnonzero(row >= self.least) for at in range(0, len(q), 64) for row in q[at:at + 64] @ self.unit.T]

    def _walk(self, q: np.ndarray, beam: int) -> list[np.ndarray]:
        if beam >= len(self.ids):
            return self._scan(q)
        ids, sims = self.graph.search(q, beam)
        near = self.least - 1e-5  # single precision proposes, double precision decides
        full = np.flatnonzero(sims[:, -1] >= near)
        rows, col = np.nonzero(sims >= near)
        exact = np.einsum("xd,xd->x", self.unit[ids[rows, col]], q[rows]) >= self.least
        rows, found = rows[exact], ids[rows[exact], col[exact]]
        out = np.split(found, np.searchsorted(rows, np.arange(1, len(q))))
        if len(full):
            for i, wider in zip(full, self._walk(q[full], 4 * beam)):
                out[i] = wider
        return out

    def links(self, q: np.ndarray) -> list[np.ndarray]:
        """For every unit query the shard's members at or above the threshold."""
        if not self.audited:
            sample = q[np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int)]
            truth = sum(len(x) for x in self._scan(sample))
            while self.beam < len(self.ids) and sum(len(x) for x in self._walk(sample, self.beam)) < RECALL * truth:
                self.beam *= 2
            self.audited = True
        return [x for at in range(0, len(q), 256) for x in self._walk(q[at:at + 256], self.beam)]


def _vectors(column: pa.Array) -> tuple[list[bytes | None], np.ndarray]:
    """Single-precision bytes of usable vectors, None for the others, and the lengths."""
    packed, sizes = [], np.zeros(len(column), np.int64)
    for i, value in enumerate(column):
        x = None
        if value.is_valid and value.values.null_count == 0 and len(value.values):
            v = value.values.to_numpy(zero_copy_only=False)
            if np.isfinite(v).all() and np.any(v != 0):
                x, sizes[i] = v.astype("<f8").tobytes(), len(v)
        packed.append(x)
    return packed, sizes


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id of every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, sizes = _vectors(batch.column(1))
            known = pc.and_(pc.is_valid(batch.column(2)), pc.is_valid(batch.column(0))).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int32()), pa.array([x if k else None for x, k in zip(packed, known)], pa.binary())],
                                             ["vec_id", "label", "dim", "vector"])
    read = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), "embedding", vectors["label"].cast("string").alias("label"))
    rows = settle(read.mapInArrow(pack, "vec_id long, label string, dim int, vector binary").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))))
    same = ["label", "dim", "vector"]
    salted = rows.filter("vector is not null").groupBy(*same, "salt").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = settle(salted.groupBy(*same).agg(F.min("least").alias("id"), F.sum("n").alias("weight"), F.collect_set("salt").alias("salts")))
    shards = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD)).cast("int").alias("shards"))
    dealt = classes.join(shards, ["label", "dim"]).select("label", "dim", "shards", "id", "weight", "vector")
    members = dealt.select("label", "dim", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "weight", "vector")
    queries = dealt.select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("kind"), "id", "weight", "vector")
    key = ["label", "dim", "shard"]
    sent = members.union(queries).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() // SHARD)), *key).sortWithinPartitions(*key, "kind", "id")

    def close(shard: Shard | None) -> Iterator[pa.RecordBatch]:
        if shard is not None:
            roots = shard.forest.roots()
            tied = np.flatnonzero(roots != np.arange(len(roots)))
            yield pa.RecordBatch.from_arrays([pa.array(shard.ids[tied]), pa.array(np.zeros(len(tied), np.int64)), pa.array(shard.ids[roots[tied]])], ["id", "n", "to"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            kinds, ids, weights = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_numpy()
            at = 0
            while at < len(names):
                end = at + 1
                while end < len(names) and names[end] == names[at] and kinds[end] == kinds[at]:
                    end += 1
                vectors = np.frombuffer(b"".join(batch.column(6).slice(at, end - at).to_pylist()), "<f8").reshape(end - at, -1)
                if names[at] != now:
                    yield from close(shard)
                    now, held, shard = names[at], [], None
                if kinds[at] == 0:
                    held.append((ids[at:end], weights[at:end], vectors))
                else:
                    if shard is None:
                        shard = Shard(*(np.concatenate(x) for x in zip(*held)), least) if held else Shard(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, vectors.shape[1])), least)
                    mine, n, to = ids[at:end], [], []
                    found = shard.links(vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) if len(shard.ids) else [np.zeros(0, np.int64)] * len(mine)
                    for i, x in zip(mine.tolist(), found):
                        x = x[shard.ids[x] != i]
                        n.append(int(shard.weights[x].sum()))
                        to.append(int(shard.ids[x[0]]) if len(x) else None)
                        for other in x[1:].tolist():
                            shard.forest.union(int(x[0]), other)
                    yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(n, pa.int64()), pa.array(to, pa.int64())], ["id", "n", "to"])
                at = end
        yield from close(shard)
    found = settle(sent.mapInArrow(visit, "id long, n long, to long"))
    counts = found.groupBy("id").agg(F.sum("n").alias("others"))
    roots = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    named = (classes.join(counts, "id", "left").join(roots, "id", "left")
             .select(*same, F.explode("salts").alias("salt"), (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")))
    return rows.join(named, [*same, "salt"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
