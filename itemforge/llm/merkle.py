"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf, every source a 16-ary tree over its leaves in doc_id order, and the subroots, in source order, are
the leaves of one more such tree. Nodes are labelled (tree, block, level, index), children before parents; a block is
the ``FAN ** DEPTH`` consecutive nodes whose ancestors up to ``DEPTH`` levels are its own.

* Forward: a task walks its nodes in label order and sends each digest to the node's parent through a priority queue
  keyed by label; a node is taken from the queue once all labels before it are done, so its children are all there.
  Messages that leave their block are the external part of the queue: a table in the shared folder, which the next
  round reads in label order. A round shrinks the nodes 256 times, so the rounds follow the logarithm of the largest source.
* Reversed: the same order backwards. What a node's proof holds above its block (the suffix) arrives as a message sorted
  before the block's nodes, is lengthened by the siblings inside the block, and is sent on to the blocks below.

Scale: texts are hashed where they are scanned and never shuffled. Leaves (about 100 bytes) are range-sorted once,
numbered from counts per range, and dealt by (tree, block), 256 rows at most each, so a source with a third of all rows
is worked by many tasks. The driver sees one number: the size of the largest source.

Cases: a null field is ``-`` in a leaf; a null source is a tree of its own, first in order; a null doc_id sorts first
and is never tampered with; rows that share source and doc_id are ordered by leaf digest; equal rows are leaves of
their own; a lone leaf is its subroot, a lone subroot the root, and without any sibling the proof is empty; an empty
table gives no rows; texts of any length are hashed whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemforge.llm.shared import fresh_dir, settle, split_count, table

FAN, DEPTH = 16, 2
BLOCK = FAN ** DEPTH
TAMPER_EVERY = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROWS = 4_096
_NODE = "tree long, pos long, n long, digest binary"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(docs: DataFrame, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(field(docs["doc_id"]), field(docs["source"]), field(docs["lang"]), field(docs["n_chars"]), field(text)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """no_source, source, doc_id, leaf, and the leaf of the tampered row where the row is one that is tampered with."""
    chosen = F.crc32(docs["doc_id"].cast("string").cast("binary")) % TAMPER_EVERY == 0
    return docs.select(
        docs["source"].isNull().alias("no_source"), F.coalesce(docs["source"], F.lit("")).alias("source"), docs["doc_id"].cast("long").alias("doc_id"),
        leaf_digest(docs, docs["text"]).alias("leaf"), F.when(chosen, leaf_digest(docs, F.translate(docs["text"], UPPER, LOWER))).alias("tampered"))


def numbered(rows: DataFrame, group: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``pos``, their place in the group from 0 up, and the groups with their size ``n``.

    A range sort is written once; the place is the row's number in its part, less that of the group's first row there,
    plus the group's rows in the parts before.
    """
    path = fresh_dir(rows.sparkSession, "ranges")
    parts = split_count(rows, 256)
    ordered = rows.repartitionByRange(parts, *[F.col(c) for c in group], *order).sortWithinPartitions(*[F.col(c) for c in group], *order)
    ordered.withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    written = rows.sparkSession.read.parquet(path).withColumn("part", F.shiftright("at", 33))
    runs = settle(written.groupBy(*group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here")))
    earlier = Window.partitionBy(*group or [F.lit(0)]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("before", F.coalesce(F.sum("here").over(earlier), F.lit(0)))
    placed = written.join(starts.drop("here"), [*group, "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before"))
    return placed.drop("part", "at", "first", "before"), runs.groupBy(*group).agg(F.sum("here").alias("n"))


def levels_of(n: int) -> int:
    """Levels worked inside a block of a tree with ``n`` nodes: until one node remains, ``DEPTH`` at most."""
    if n > BLOCK:
        return DEPTH
    depth = 0
    while n > 1:
        n, depth = -(-n // FAN), depth + 1
    return depth


def hashed(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _flushed(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    waiting = []
    for row in rows:
        waiting.append(row)
        if len(waiting) == _ROWS:
            yield _batch(waiting, names, kinds)
            waiting = []
    if waiting:
        yield _batch(waiting, names, kinds)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes (tree, pos, n, digest) in label order to the tops of their blocks."""
    def tops() -> Iterator[tuple]:
        queue: list[tuple] = []  # (tree, block, level, index, child, digest, n): at most FAN - 1 messages a level and the open block's nodes

        def done_before(tree: int, block: int) -> Iterator[tuple]:
            while queue and queue[0][:2] < (tree, block):
                label, n = queue[0][:4], queue[0][6]
                children = []
                while queue and queue[0][:4] == label:
                    children.append(heapq.heappop(queue)[5])
                yield from send(*label, hashed(children), n)

        def send(tree: int, block: int, level: int, index: int, digest: bytes, n: int) -> Iterator[tuple]:
            if level == levels_of(n):
                yield tree, block, -(-n // BLOCK), digest
            else:
                heapq.heappush(queue, (tree, block, level + 1, index // FAN, index % FAN, digest, n))

        for tree, pos, n, digest in _rows(batches):
            yield from done_before(tree, pos // BLOCK)
            yield from send(tree, pos // BLOCK, 0, pos % BLOCK, digest, n)
        yield from done_before(1 << 62, 0)
    yield from _flushed(tops(), ["tree", "pos", "n", "digest"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()])


def step(digests: list[bytes], i: int) -> tuple[int, bytes]:
    """Index of node i in its run, and one level of a proof: siblings, own index, siblings' digests."""
    first, own = i - i % FAN, i % FAN
    run = digests[first:first + FAN]
    return i // FAN, bytes([len(run) - 1, own]) + b"".join(run[:own] + run[own + 1:])


def backward(payload: list[tuple[str, pa.DataType]]):
    """Messages (tree, block, pos -1, proof, subroot, root), each before its block's nodes, to the nodes with theirs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[tuple]:
            label, message, nodes = None, None, []

            def block_done() -> Iterator[tuple]:
                if not nodes:
                    return
                suffix, subroot, root = message
                tiers = [[digest for _, _, digest, _ in nodes]]
                for _ in range(levels_of(nodes[0][1])):
                    tiers.append([hashed(tiers[-1][k:k + FAN]) for k in range(0, len(tiers[-1]), FAN)])
                for i, (pos, _, digest, carried) in enumerate(nodes):
                    at, proof = i, []
                    for tier in tiers[:-1]:
                        at, one = step(tier, at)
                        proof.append(one)
                    yield *label, pos, digest, b"".join(proof) + suffix, subroot, root, *carried

            for tree, block, pos, n, digest, proof, subroot, root, *carried in _rows(batches):
                if (tree, block) != label:
                    yield from block_done()
                    label, message, nodes = (tree, block), None, []
                if pos < 0:
                    message = (proof, subroot, root)
                else:
                    nodes.append((pos, n, digest, carried))
            yield from block_done()
        names = ["tree", "block", "pos", "digest", "proof", "subroot", "root", *[name for name, _ in payload]]
        yield from _flushed(told(), names, [pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4, *[kind for _, kind in payload]])
    return run


def raised(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """All rounds' tables (tree, pos, n, digest), from the nodes given to one node a tree."""
    rounds = [nodes]
    while largest > 1:
        now = rounds[-1].select("tree", "pos", "n", "digest").withColumn("block", F.floor(F.col("pos") / BLOCK))
        dealt = now.repartition(split_count(now, 128), "tree", "block").sortWithinPartitions("tree", "pos")
        rounds.append(settle(dealt.drop("block").mapInArrow(forward, _NODE)))
        largest = -(-largest // BLOCK)
    return rounds


def told(nodes: DataFrame, messages: DataFrame, payload: list[tuple[str, str, pa.DataType]] = ()) -> DataFrame:
    """``nodes`` with the proof, subroot and root that ``messages`` (tree, pos, proof, subroot, root) bring to their blocks."""
    carried = [F.col(name) for name, _, _ in payload]
    down = messages.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("digest"),
                           "proof", "subroot", "root", *[F.lit(None).cast(kind).alias(name) for name, kind, _ in payload])
    empty = [F.lit(None).cast("binary").alias(c) for c in ("proof", "subroot", "root")]
    own = nodes.select("tree", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "n", "digest", *empty, *carried)
    dealt = own.union(down).repartition(split_count(own, 256), "tree", "block").sortWithinPartitions("tree", "block", "pos")
    schema = "tree long, block long, pos long, digest binary, proof binary, subroot binary, root binary" + "".join(f", {name} {kind}" for name, kind, _ in payload)
    return dealt.mapInArrow(backward([(name, kind) for name, _, kind in payload]), schema).drop("block")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, tampered, subroot, root and proof of every row, digests as bytes.

    ``proof`` holds, for every level from the leaf to the root, the number of siblings, the node's own place among them
    and their digests.
    """
    spark = docs.sparkSession
    path = fresh_dir(spark, "leaves")
    leaves(docs).write.parquet(path)
    by_source = ["no_source", "source"]
    nodes, groups = numbered(spark.read.parquet(path), by_source, [F.col("doc_id"), F.col("leaf")])
    # Sources in order: null first, then bytewise. Their places are the trees' numbers and the places of their subroots.
    trees, _ = numbered(groups.withColumn("named", ~F.col("no_source")), [], [F.col("named"), F.col("source")])
    trees = settle(trees.select(*by_source, "n", F.col("pos").alias("tree")))
    base = settle(nodes.join(trees, by_source).select("tree", "pos", "n", F.col("leaf").alias("digest"), "doc_id", "tampered"))
    sizes = trees.agg(F.max("n"), F.count(F.lit(1))).first()
    rounds = raised(base, sizes[0] or 0)
    tops = rounds[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(sizes[1]).cast("long").alias("n"), "digest")
    crowns = raised(tops, sizes[1])
    messages = crowns[-1].select("tree", "pos", F.lit(b"").alias("proof"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for crown in reversed(crowns[:-1]):
        messages = settle(told(crown, messages).select("tree", "pos", "proof", F.col("digest").alias("subroot"), "root"))
    messages = messages.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "proof", "subroot", "root")
    for inner in reversed(rounds[1:-1]):
        messages = settle(told(inner, messages))
    payload = [("doc_id", "long", pa.int64()), ("tampered", "binary", pa.binary())]
    if len(rounds) == 1:  # every source is a lone leaf
        found = base.join(messages.drop("pos"), "tree")
    else:
        found = told(base, messages, payload)
    return found.select("doc_id", F.col("digest").alias("leaf"), "tampered", "subroot", "root", "proof")


def siblings(proof: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Own place and siblings' digests, level by level."""
    at = 0
    while at < len(proof):
        count, own = proof[at], proof[at + 1]
        at += 2
        yield own, [proof[at + 32 * k:at + 32 * k + 32] for k in range(count)]
        at += 32 * count


def folded(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    for own, others in siblings(proof):
        leaf = hashed([*others[:own], leaf, *others[own:]])
    return leaf


def verified(proofs: DataFrame) -> DataFrame:
    """The manifest in hex, with the digest of each proof, and the root recomputed from the tampered leaf where there is one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, leaf, tampered, subroot, root, proof = (c.to_pylist() for c in batch.columns)
            found = [folded(t or d, p) for t, d, p in zip(tampered, leaf, proof)]
            path = [hashed([d for _, others in siblings(p) for d in others]) for p in proof]
            text = lambda values: pa.array([v.hex() for v in values], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), text(leaf), text(subroot), text(root), text(path), text(found), pa.array([a == b for a, b in zip(found, root)], pa.bool_())],
                                             ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    return proofs.select("doc_id", "leaf", "tampered", "subroot", "root", "proof").mapInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(manifest(table(spark, sf_dir, "documents")))



# crc32 runs over the digits of the id, eight shifts (-1) after each; a tree step replaces 16 nodes by their hash until one is left.
SQL = """
WITH RECURSIVE rows AS (
  SELECT doc_id, source, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 5 = 0
      THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered
  FROM rows),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
up AS (
  SELECT source, 0 AS tier, pos, leaf AS digest, n FROM placed
  UNION ALL
  SELECT source, tier + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM up WHERE n > 1 GROUP BY source, tier, pos // 16, n),
tops AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
crown AS (
  SELECT 0 AS tier, pos, subroot AS digest, n FROM tops
  UNION ALL
  SELECT tier + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM crown WHERE n > 1 GROUP BY tier, pos // 16, n),
nodes AS (
  SELECT coalesce(source, '') AS source, source IS NULL AS no_source, false AS crowned, tier, pos // 16 AS run, list(digest ORDER BY pos) AS run_digests
  FROM up WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT '', false, true, tier, pos // 16, list(digest ORDER BY pos) FROM crown WHERE n > 1 GROUP BY tier, pos // 16),
fold AS (
  SELECT doc_id, p.source, p.leaf, t.subroot, t.pos AS top, p.pos AS row_pos, p.pos AS pos, p.n, t.n AS tops, false AS crowned, 0 AS tier,
    coalesce(tampered, leaf) AS now, '' AS proof
  FROM placed p JOIN tops t ON p.source IS NOT DISTINCT FROM t.source
  UNION ALL
  SELECT doc_id, f.source, leaf, subroot, top, row_pos,
    CASE WHEN f.n = 1 THEN top ELSE f.pos // 16 END, CASE WHEN f.n = 1 THEN tops ELSE (f.n + 15) // 16 END, CASE WHEN f.n = 1 THEN 1 ELSE tops END,
    f.crowned OR f.n = 1, CASE WHEN f.n = 1 THEN 0 ELSE f.tier + 1 END,
    CASE WHEN f.n = 1 THEN now
      ELSE sha256(array_to_string(run_digests[1:f.pos % 16], '') || now || array_to_string(run_digests[f.pos % 16 + 2:], '')) END,
    CASE WHEN f.n = 1 THEN proof ELSE proof || array_to_string(run_digests[1:f.pos % 16], '') || array_to_string(run_digests[f.pos % 16 + 2:], '') END
  FROM fold f LEFT JOIN nodes ON f.n > 1 AND nodes.crowned = f.crowned AND nodes.tier = f.tier AND nodes.run = f.pos // 16
    AND (f.crowned OR (nodes.source = coalesce(f.source, '') AND nodes.no_source = (f.source IS NULL)))
  WHERE f.n > 1 OR NOT f.crowned)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, now AS folded_root, now = root AS verified
FROM fold, (SELECT digest AS root FROM crown WHERE n = 1) WHERE crowned AND n = 1
"""
