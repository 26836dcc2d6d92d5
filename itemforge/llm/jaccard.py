"""Near-duplicate join on word shingles by signature trees.

``jaccard_classes`` gives every document its number of distinct shingles and the smallest doc_id it reaches over links,
two documents being linked when den * |intersection| >= num * |union|. Exact: nothing is sampled, capped or dropped.

1. Documents with equal sets are one class, named by a 64-bit hash of the set and its size.
2. Routing. Two linked sets of at most A and A * den / num shingles differ in at most H = A * (den - num) / num of
   them. Splitting the hash range into H + 1 + e parts leaves at least e + 1 parts where both sets are the same, so a
   set sends one key per part (hash of its shingles there). A set with at most e empty parts leaves them out: one of
   the equal parts is then not empty. Keys are made per size level, twice where a partner may fall in the next one.
   A key shared by chance needs several equal shingles, so a passage that many documents carry does not make it hot.
3. Classes that share keys form candidate blocks. Copies meet inside the map task first: a key leaves it once, with
   one class, however many documents have it, and star edges tie the others to that class.
4. Refinement. Documents that share passages chain into blocks too large to compare. Those are cut first: every class
   sends a bitmap (a few bits a shingle) to pairs of tiles of its size band, and the components of what sizes and bitmaps
   leave possible become the blocks. Bitmaps never rule out a link, so linked sets stay together.
5. Trees. A block's classes are sorted by size under nodes that hold the OR of their token bitmaps, their size range
   and their least bit count. Pairs of nodes are walked together; a pair is pruned by its size ranges, by the largest
   overlap the bitmaps leave possible, or because one component holds all of both. What is left is checked exactly.
   A block still above ``TILE_SHINGLES`` is cut into tiles, and each pair of tiles is a task of its own.
6. Components of the links, with the smallest doc_id as root.

Scale: shuffles are packed keys (about 0.16 per shingle at 0.9) and the sets of block members, of which a bit map of fixed
size keeps most others out. Texts are read three times and never shuffled.
The number of key buckets follows the row count, so a task holds one bucket, one pack of blocks or one pair of tiles.

Cases: words are runs without ASCII white space, A-Z lower-cased; fewer words than the width make one shingle; null or
blank text has an empty set, size 0, links with nothing and is its own component; rows that repeat share a class; a
null doc_id is never a component's name, and a class that has none but null ids has a null component; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from itemforge.llm.bytewords import mix, ranges, shingle_sets, text_slices
from itemforge.llm.components import components
from itemforge.llm.shared import bit_map, in_bit_map, lean, release, settle, table

RATIO, TILE_SHINGLES, TILE_CLASSES, FAN, SALTS = 0.8, 1_000_000, 8_192, 8, 16
LEAST_BITS, MOST_BITS, BUCKET_TEXT = 512, 1 << 17, 4 << 20


def levels(largest: int, num: int, den: int) -> list[tuple[int, int, int, int]]:
    """(least size, size past the level, parts, empty parts left out) until ``largest``."""
    out, low = [], 1
    while low <= largest:
        past = max(low + 1, math.floor(low / RATIO))
        apart = (past - 1) * (den - num) // num
        spare = 0 if apart == 0 else math.ceil(2 * (apart + 1) * math.exp(-low / (apart + 1))) + 1
        out.append((low, past, apart + 1 + spare, spare))
        low = past
    return out


def class_ids(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A signed 64-bit name of every set; 0 for the empty one."""
    sizes = np.diff(bounds)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes))])
    named = mix(running[bounds[1:]] - running[bounds[:-1]] + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(sizes > 0, named, np.uint64(0)).view(np.int64)


def routing_keys(hashes: np.ndarray, bounds: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of all sets; hashes ascend within a set."""
    sizes = np.diff(bounds)
    sets, keys = [], []
    for at, (low, past, parts, spare) in enumerate(levels(int(sizes.max(initial=0)), num, den)):
        # members are the level's own sizes and the larger ones that a set of the level can be linked to
        member = np.flatnonzero((sizes >= low) & (sizes <= (past - 1) * den // num))
        if not len(member):
            continue
        length = sizes[member]
        h = hashes[ranges(bounds[:-1][member], length)]
        owner = np.repeat(np.arange(len(member)), length)
        part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        cell = owner * parts + part
        opens = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        total = np.add.reduceat(mix(h), opens)
        salt = np.uint64((at + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        found = [(owner[opens], mix(total + mix(part[opens].astype(np.uint64) + salt)))]
        filled = np.bincount(owner[opens], minlength=len(member))
        for m in np.flatnonzero(parts - filled > spare):
            mine = np.ones(parts, bool)
            mine[part[opens][owner[opens] == m]] = False
            empty = np.flatnonzero(mine)
            found.append((np.full(len(empty), m), mix(mix(empty.astype(np.uint64) + salt))))
        sets += [member[o] for o, _ in found]
        keys += [k for _, k in found]
    if not sets:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(sets), np.concatenate(keys)


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[fresh], b[fresh]


def stars(keys: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct key with its smallest class, and the edges from a key's other classes to that one."""
    order = np.lexsort((classes, keys))
    keys, classes = keys[order], classes[order]
    opens = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    hub = classes[opens][np.cumsum(opens) - 1] if len(keys) else classes
    tied = hub != classes
    return keys[opens], classes[opens], *distinct_pairs(classes[tied], hub[tied])


def short_keys(keys: np.ndarray) -> np.ndarray:
    """The upper six bytes of each key, which tell the keys of one bucket apart; a chance match only adds a candidate."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:])


def long_keys(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def set_sizes(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, class_id and the set's bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                hashes, bounds = shingle_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(class_ids(hashes, bounds), pa.int64()),
                                                  pa.array(signatures(hashes, bounds), pa.binary())], ["doc_id", "n_shingles", "class_id", "bits"])
    return docs.mapInArrow(lean(run), "doc_id long, n_shingles long, class_id long, bits binary")


def candidate_edges(docs: DataFrame, width: int, num: int, den: int, buckets: int) -> DataFrame:
    """Edges (a, b) between classes that share a key."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_slices(batch, "text"):
                hashes, bounds = shingle_sets(data, offsets, width)
                sets, keys = routing_keys(hashes, bounds, num, den)
                keys, classes, a, b = stars(keys, class_ids(hashes, bounds)[sets])
                to = (keys % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                there, first = np.unique(to[order], return_index=True)
                packed = lambda values, cuts: [x.tobytes() for x in np.split(values, cuts)]
                edge_cuts = np.linspace(0, len(a), len(there) + 1).astype(int)[1:-1]
                names = [np.unique(c, return_inverse=True) for c in np.split(classes[order], first[1:])] if len(there) else []
                if len(there):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(there, pa.int32()), pa.array(packed(short_keys(keys[order]), first[1:]), pa.binary()), pa.array([n.tobytes() for n, _ in names], pa.binary()),
                        pa.array([i.astype(np.uint16 if len(n) <= 65_536 else np.uint32).tobytes() for n, i in names], pa.binary()),
                        pa.array(packed(a, edge_cuts), pa.binary()), pa.array(packed(b, edge_cuts), pa.binary())], ["bucket", "keys", "names", "places", "a", "b"])

    def meet(group: pa.Table) -> pa.Table:
        joined = lambda name: np.frombuffer(b"".join(group.column(name).to_pylist()), np.int64)
        keys, classes = [], []
        for raw, names, places in zip(*(group.column(c).to_pylist() for c in ("keys", "names", "places"))):
            keys.append(long_keys(raw))
            classes.append(np.frombuffer(names, np.int64)[np.frombuffer(places, np.uint16 if len(places) == 2 * len(keys[-1]) else np.uint32)])
        _, _, a, b = stars(np.concatenate(keys), np.concatenate(classes))
        a, b = distinct_pairs(np.concatenate([joined("a"), a]), np.concatenate([joined("b"), b]))
        del keys, classes
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return docs.mapInArrow(lean(send), "bucket int, keys binary, names binary, places binary, a binary, b binary").groupBy("bucket").applyInArrow(meet, "a long, b long")


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def union(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if np.array_equal(up, self.up):
                return up
            self.up = up


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A bitmap of every set, with two to four bits a shingle between ``LEAST_BITS`` and ``MOST_BITS``."""
    sizes = np.diff(bounds)
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    place = np.cumsum(bits) - bits
    out = np.zeros(int(bits.sum()) // 8, np.uint8)
    at = np.repeat(place, sizes) + (hashes & np.repeat((bits - 1).astype(np.uint64), sizes)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    raw = out.tobytes()
    return [raw[p:p + n] for p, n in zip((place // 8).tolist(), (bits // 8).tolist())]


def folded(found: list[bytes]) -> np.ndarray:
    """Bitmaps of several lengths as rows of the shortest: a longer one's halves are laid over each other."""
    least = min(len(b) for b in found)
    out = np.zeros((len(found), least // 8), np.uint64)
    for n in {len(b) for b in found}:
        at = [i for i, b in enumerate(found) if len(b) == n]
        rows = np.frombuffer(b"".join(found[i] for i in at), np.uint64).reshape(len(at), n // least, -1)
        out[at] = np.bitwise_or.reduce(rows, axis=1)
    return out


def walk_trees(maps: np.ndarray, rank: np.ndarray, num: int, den: int, forest: Forest, check: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Dual traversal over sets in ascending order of size: ``check`` gets the pairs that bitmaps and sizes leave possible."""
    n = len(rank)
    tree = [(maps, np.bitwise_count(maps).sum(axis=1).astype(np.int64), rank, rank)]
    while len(tree[-1][0]) > FAN:
        bits, least, low, high = tree[-1]
        cut = np.arange(0, len(bits), FAN)
        tree.append((np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(least, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def possible(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        bits, least, low, high = tree[level]
        fits = np.flatnonzero((high[i] * den >= low[j] * num) & (high[j] * den >= low[i] * num))
        i, j, out = i[fits], j[fits], np.zeros(len(i), bool)
        common = np.bitwise_count(bits[i] & bits[j]).sum(axis=1).astype(np.int64)
        apart = np.maximum(least[i] - common, 0) + np.maximum(least[j] - common, 0)
        out[fits] = apart * (num + den) <= (high[i] + high[j]) * (den - num)
        return out

    def united(level: int) -> np.ndarray:
        """The component that holds all below a node, or -1."""
        roots = forest.roots()
        cut = np.arange(0, n, FAN ** level)
        low, high = np.minimum.reduceat(roots, cut), np.maximum.reduceat(roots, cut)
        return np.where(low == high, low, -1)

    def walk(level: int, i: np.ndarray, j: np.ndarray) -> None:
        keep = possible(level, i, j)
        if level == 0:
            keep &= i != j
        whole = united(level)
        keep &= (whole[i] < 0) | (whole[i] != whole[j])
        i, j = i[keep], j[keep]
        if level == 0:
            if len(i):
                check(i, j)
            return
        size = len(tree[level - 1][0])
        step = max(1, 65_536 // FAN ** 2)
        for at in range(0, len(i), step):
            a, b = i[at:at + step], j[at:at + step]
            x = (a[:, None, None] * FAN + np.arange(FAN)[None, :, None] + np.zeros(FAN, np.int64)).ravel()
            y = (b[:, None, None] * FAN + np.arange(FAN)[None, None, :] + np.zeros((FAN, 1), np.int64)).ravel()
            real = (x < size) & (y < size) & (x <= y)
            walk(level - 1, x[real], y[real])
    i, j = np.triu_indices(len(tree[-1][0]))
    walk(len(tree) - 1, i, j)


def tree_links(hashes: np.ndarray, bounds: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links between sets that join the same components as all links do. ``hashes`` ascend within a set."""
    sizes = np.diff(bounds)
    order = np.lexsort((hashes[bounds[:-1]], sizes))  # equal sizes: sets with the same smallest shingle side by side
    rank = sizes[order]
    maps = folded(signatures(hashes, bounds))[order]
    vocabulary, local = np.unique(hashes, return_inverse=True)
    local = local[ranges(bounds[:-1][order], rank)]
    starts = np.concatenate([[0], np.cumsum(rank)])
    forest, links, mark = Forest(len(order)), [], np.zeros(len(vocabulary), bool)

    def check(i: np.ndarray, j: np.ndarray) -> None:
        for first in np.unique(i):
            partners = j[i == first]
            roots = forest.roots()
            partners = partners[roots[partners] != roots[first]]
            if not len(partners):
                continue
            mine = local[starts[first]:starts[first + 1]]
            mark[mine] = True
            length = rank[partners]
            hits = np.add.reduceat(mark[local[ranges(starts[partners], length)]].astype(np.int64), np.cumsum(length) - length)
            mark[mine] = False
            for p in partners[hits * den >= (rank[first] + length - hits) * num].tolist():
                if forest.union(int(first), p):
                    links.append((int(order[first]), int(order[p])))
    walk_trees(maps, rank, num, den, forest, check)
    return links


def possible_links(found: list[bytes], sizes: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs that join the same components as all pairs do which bitmaps and sizes leave possible."""
    maps = folded(found)
    order = np.lexsort((maps[:, 0], sizes))
    forest, links = Forest(len(order)), []

    def check(i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist()):
            if forest.union(a, b):
                links.append((int(order[a]), int(order[b])))
    walk_trees(maps[order], sizes[order], num, den, forest, check)
    return links


def in_bands(chosen: DataFrame, num: int, den: int) -> Column:
    """The bands of size of a class: sizes that can be linked are at most one factor den / num apart, so a class joins its own band and the one before."""
    step = F.floor(F.log("n_shingles") / F.lit(math.log(den / num) * (1 + 1e-9))).cast("int")  # the margin covers rounding
    return F.array(step - 1, step)


def refined(classes: DataFrame, blocks: DataFrame, num: int, den: int, rows: int) -> DataFrame:
    """class_id and block, with blocks above ``TILE_SHINGLES`` cut along what bitmaps leave possible.

    Documents that share passages chain into large blocks. There only bitmaps are sent to pairs of tiles, a few bytes for
    every hundred of a set; the components of the pairs they leave possible are the new blocks. Linked sets are never parted.
    """
    chosen = classes.join(blocks, "class_id").select("class_id", "block", "n_shingles", "bits")
    large = settle(chosen.groupBy("block").agg(F.sum("n_shingles").alias("weight")).filter(F.col("weight") > TILE_SHINGLES).select("block"), rows)
    if large.isEmpty():
        return blocks.select("class_id", "block")
    banded = chosen.join(large, "block").withColumn("band", F.explode(in_bands(chosen, num, den)))
    tiles = banded.groupBy("block", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE_CLASSES)).cast("int").alias("tiles"))
    tiled = banded.join(tiles, ["block", "band"]).withColumn("tile", F.pmod(F.xxhash64("class_id"), F.col("tiles")).cast("int"))
    spread = tiled.withColumn("pair", F.explode(tile_pairs())).withColumn("pack", F.xxhash64("block", "band", "pair"))

    def cut(group: pa.Table) -> pa.Table:
        ids, sizes, found = group.column("class_id").to_numpy(), group.column("n_shingles").to_numpy(), group.column("bits").to_pylist()
        links = np.array(possible_links(found, sizes, num, den), np.int64).reshape(-1, 2)
        del found
        release()
        return pa.table({"a": pa.array(ids[links[:, 0]], pa.int64()), "b": pa.array(ids[links[:, 1]], pa.int64())})
    edges = spread.select("pack", "class_id", "n_shingles", "bits").groupBy("pack").applyInArrow(cut, "a long, b long")
    finer = components(edges).select(F.col("id").alias("class_id"), F.col("root").alias("block"))
    return blocks.join(large, "block", "left_anti").select("class_id", "block").union(finer)


def tile_pairs() -> Column:
    """All pairs of tiles that a member of ``tile`` out of ``tiles`` is in."""
    return F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("one"), F.greatest(t, F.col("tile")).alias("two")))


def placed_in_blocks(classes: DataFrame, blocks: DataFrame, num: int, den: int) -> DataFrame:
    """id, class_id, block, band, tiles, tile: where the classes of blocks are worked.

    A block above ``TILE_SHINGLES`` is cut into bands of size first; a band above the bound has several tiles.
    """
    chosen = classes.join(blocks, "class_id").select("id", "class_id", "block", "n_shingles")
    weights = chosen.groupBy("block").agg(F.sum("n_shingles").alias("weight"))
    bands = F.when(F.col("weight") <= TILE_SHINGLES, F.array(F.lit(-2))).otherwise(in_bands(chosen, num, den))
    banded = chosen.join(weights, "block").withColumn("band", F.explode(bands))
    tiles = banded.groupBy("block", "band").agg(F.ceil(F.sum("n_shingles") / F.lit(TILE_SHINGLES)).cast("int").alias("tiles"))
    return banded.join(tiles, ["block", "band"]).select("id", "class_id", "block", "band", "tiles", F.pmod(F.xxhash64("class_id"), F.col("tiles")).cast("int").alias("tile"))


def block_links(members: DataFrame, num: int, den: int, packs: int) -> DataFrame:
    """``members`` (block, band, tiles, tile, id, shingles): links (a, b) by id, that of a class. Several tiles are worked by pairs of tiles."""
    spread = members.withColumn("pair", F.explode(tile_pairs())).withColumn(
        "pack", F.when(F.col("band") == -2, F.pmod(F.xxhash64("block"), F.lit(packs))).otherwise(F.xxhash64("block", "band", "pair").bitwiseOR(F.lit(1 << 40))))

    def verify(group: pa.Table) -> pa.Table:
        block, band, one, two, ids = (np.array(group.column(c).to_pylist(), np.int64) for c in ("block", "band", "one", "two", "id"))
        sets, a, b = group.column("shingles").to_pylist(), [], []
        order = np.lexsort((ids, two, one, band, block))
        cut = np.flatnonzero(np.any(np.diff(np.stack([block, band, one, two])[:, order], axis=1) != 0, axis=0)) + 1
        for rows in np.split(order, cut):
            rows = rows[np.concatenate([[True], ids[rows][1:] != ids[rows][:-1]])]
            if len(rows) > 1:
                found = [np.frombuffer(sets[r], np.uint64) for r in rows]
                bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])])
                for i, j in tree_links(np.concatenate(found), bounds, num, den):
                    a.append(ids[rows[i]])
                    b.append(ids[rows[j]])
        del sets
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return (spread.select("pack", "block", "band", F.col("pair.one").alias("one"), F.col("pair.two").alias("two"), "id", "shingles")
            .groupBy("pack").applyInArrow(verify, "a long, b long"))


def named_classes(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id and root (the component, named by its smallest class) of every row."""
    spark = docs.sparkSession
    read = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    rows = read.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * 4_000 // BUCKET_TEXT))
    sized = settle(set_sizes(read, width))
    blocks = settle(components(candidate_edges(read, width, num, den, buckets)).select(F.col("id").alias("class_id"), F.col("root").alias("block")), rows)
    salted = sized.filter("n_shingles > 0").groupBy("class_id", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("size"), F.max("bits").alias("bits"))
    classes = settle(salted.groupBy("class_id").agg(F.min("least").alias("id"), F.max("size").alias("n_shingles"), F.max("bits").alias("bits"), F.collect_set("salt").alias("salts")), rows)
    chosen = settle(placed_in_blocks(classes, refined(classes, blocks, num, den, rows), num, den), 2 * rows)

    shared = spark.sparkContext.broadcast(bit_map(chosen, "class_id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                hashes, bounds = shingle_sets(data, offsets, width)
                named = class_ids(hashes, bounds)
                passes, cuts = in_bit_map(shared.value, named), bounds.tolist()
                at = np.flatnonzero(passes)
                packed = pa.array([hashes[cuts[i]:cuts[i + 1]].tobytes() for i in at.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at)), pa.array(named[at]), packed], ["id", "class_id", "shingles"])
    found = read.mapInArrow(lean(sets), "id long, class_id long, shingles binary")
    members = found.join(chosen, ["id", "class_id"]).select("block", "band", "tiles", "tile", F.col("class_id").alias("id"), "shingles")
    roots = settle(components(block_links(members, num, den, buckets)).select(F.col("id").alias("class_id"), "root"), rows)
    least = roots.join(classes, "class_id").groupBy("root").agg(F.min("id").alias("least"))
    linked = roots.join(least, "root")
    named = classes.join(linked, "class_id", "left").select("class_id", F.explode("salts").alias("salt"), F.coalesce("least", "id").alias("named"), F.coalesce("root", "class_id").alias("root"))
    joined = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(named, ["class_id", "salt"], "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("named")).otherwise(F.col("doc_id")).alias("component_id"), "class_id", F.coalesce("root", "class_id").alias("root"))


def jaccard_classes(docs: DataFrame, width: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return named_classes(docs, width, num, den).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The documents, with all their columns, that name their component: one of each group of near copies.

    Rows that repeat a doc_id are each judged by their text; those in one component, or of one blank text, leave one,
    that with the smallest hash of its text; rows without a doc_id stay. Only documents that a bit map of the removed
    and repeated ids lets through are shuffled to the exact decision.
    """
    spark = docs.sparkSession
    sets = (named_classes(docs, width, num, den).filter("doc_id is not null").groupBy("doc_id", "class_id")
            .agg(F.count(F.lit(1)).alias("n"), F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("kept"), F.max("root").alias("root")))
    sets = settle(sets)
    repeated = sets.groupBy("doc_id").agg(F.sum("n").alias("rows"), F.min("kept").alias("least"))
    found = settle(repeated.filter("rows > 1 or least = 0").select("doc_id"))
    shared = spark.sparkContext.broadcast(bit_map(found, "doc_id"))
    names, at = docs.columns, docs.columns.index("doc_id") if "doc_id" in docs.columns else 0

    def split(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(at).cast(pa.int64())
                hit = in_bit_map(shared.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(hit == inside))
        return docs.select(*[docs[c] for c in names]).mapInArrow(lean(run), docs.schema)
    doubtful = split(True)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "_words"):
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(class_ids(*shingle_sets(data, offsets, width)), pa.int64())], [*rows.schema.names, "_class"])
    packed = doubtful.select(doubtful["doc_id"].cast("long").alias("_id"), F.xxhash64(doubtful["text"]).alias("_text"), F.struct(*[doubtful[c] for c in names]).alias("_row"), doubtful["text"].alias("_words"))
    packed = packed.mapInArrow(lean(named), StructType([*packed.schema.fields, StructField("_class", LongType())])).drop("_words")
    verdict = sets.select(F.col("doc_id").alias("_id"), F.col("class_id").alias("_class"), "kept", "root")
    judged = packed.join(verdict, ["_id", "_class"]).filter("kept = 1")
    blank = F.when(F.col("_class") == 0, F.col("_text"))  # blank texts link with nothing
    kept = judged.withColumn("_place", F.row_number().over(Window.partitionBy("_id", "root", blank).orderBy("_text"))).filter("_place = 1").select("_row.*")
    return split(False).union(kept)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
