"""Byte-pair encoding and decoding by speculation and check.

A task cuts its texts into pre-tokens with array operations, keeps each distinct pre-token once, and encodes the new
ones together: greedy longest match proposes tokens, every adjacent pair is tested for compatibility (would merging
the two tokens' bytes give back these two tokens), and a pre-token with a failing pair, or with a token that does not
encode to itself, is merged exactly. A proposal whose pairs are all compatible is the encoding, so results equal the
tokenizer library's. Decoding gathers the tokens' bytes.

The vocabulary is read from a tokenizer file given by path; it is a fixed size, so it is broadcast. No shuffle. Memory
follows one slice of text and a word memory of at most ``MEMORY_WORDS`` distinct words, which is emptied when full.

Cases: null text is empty text, with 0 tokens and the hash of no bytes; repeated rows each give a row; an empty table
gives no rows; texts of any length are handled whole; the added token's own string in a text is that token, as in the
library. Truncation and padding are not used. Only the columns named are read, so extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from tokenizers import pre_tokenizers

from itemforge.llm.bytewords import edges, hash_ranges, ranges, text_slices
from itemforge.llm.shared import lean, table

MEMORY_WORDS, TABLE_WORDS = 1_000_000, 200_000  # distinct words a task remembers, and when it also holds lists of ids
VECTOR_BYTES = 64
LETTER, NUMBER, BLANK = 1, 2, 3
_NONE = np.int64(1 << 40)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merge ranks, splits, a byte trie and the tokens' bytes of a byte-level BPE file, as arrays."""

    def __init__(self, text: str):
        model, alphabet = json.loads(text), byte_alphabet()
        ids = model["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.size = max([*ids.values(), *self.added.values()]) + 1
        spelled = {i: bytes(alphabet[c] for c in token) for token, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.spelled = [spelled.get(i, b"") for i in range(self.size)]
        self.pool = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.lengths = np.array([len(b) for b in self.spelled], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.byte_id = np.full(256, -1, np.int64)
        for char, byte in alphabet.items():
            self.byte_id[byte] = ids[char]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        # A token's birth is the rank of the merge that makes it; single bytes are older than all merges.
        self.left, self.right, self.birth = np.arange(self.size), np.arange(self.size), np.full(self.size, -1, np.int64)
        for (a, b), (rank, made) in self.merges.items():
            if self.birth[made] < 0 and made not in set(self.byte_id):
                self.left[made], self.right[made], self.birth[made] = a, b, rank
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        nodes, edge_keys, edge_to, accept = {b"": 0}, [], [], [-1]
        for i in ids.values():
            word = self.spelled[i]
            for k in range(1, len(word) + 1):
                if word[:k] not in nodes:
                    nodes[word[:k]] = len(accept)
                    edge_keys.append(nodes[word[:k - 1]] << 8 | word[k - 1])
                    edge_to.append(len(accept))
                    accept.append(-1)
            accept[nodes[word]] = i
        order = np.argsort(np.array(edge_keys, np.int64))
        self.edge_keys, self.edge_to, self.accept = np.array(edge_keys, np.int64)[order], np.array(edge_to, np.int64)[order], np.array(accept, np.int64)
        self.own = np.array([len(b) > 0 and i in spelled and self.merged(b) == [i] for i, b in enumerate(self.spelled)])

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: always the oldest merge, the leftmost of equals, with a heap over a linked list."""
        token = [int(self.byte_id[b]) for b in word]
        after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        heap = [(found[0], i, pair) for i, pair in enumerate(zip(token, token[1:])) if (found := self.merges.get(pair))]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if token[i] != pair[0] or j >= len(token) or token[j] != pair[1]:
                continue
            token[i], token[j], after[i] = self.merges[pair][1], -1, after[j]
            if after[i] < len(token):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(token) and (found := self.merges.get((token[a], token[b]))):
                    heapq.heappush(heap, (found[0], a, (token[a], token[b])))
        return [t for t in token if t >= 0]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True where the bytes of tokens a and b, merged together, end as a and b again.

        Taking the two tokens apart from the youngest merge back, no pair that meets at the boundary may have a merge
        older than the merges still to come on either side: it would have joined across the boundary first.
        """
        a, b = a.copy(), b.copy()
        limit, fine, open_ = np.full(len(a), _NONE), np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            rank, bound = self.pair_rank(x, y), limit[open_]
            born_x, born_y = self.birth[x], self.birth[y]
            # A merge inside the right token of the same rank as the boundary's comes later, being further right.
            bad = rank < bound
            fine[open_[bad]] = False
            take_x = born_x > born_y
            take_x |= (born_x == born_y) & (born_x >= 0)
            done = bad | ((born_x < 0) & (born_y < 0))
            limit[open_] = np.where(take_x, born_x, born_y + 1)
            a[open_], b[open_] = np.where(take_x, self.right[x], x), np.where(take_x, y, self.left[y])
            open_ = open_[~done]
        return fine

    def proposed(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all ranges in step: (word, token) in order within each word."""
        words, tokens = [], []
        word, at, state = np.arange(len(starts)), starts.copy(), np.zeros(len(starts), np.int64)
        best, best_end = np.full(len(starts), -1, np.int64), starts.copy()
        while len(word):
            inside = at < ends[word]
            keys = state << 8 | data[np.minimum(at, len(data) - 1)]
            edge = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
            go = inside & (self.edge_keys[edge] == keys)
            state = np.where(go, self.edge_to[edge], 0)
            at = np.where(go, at + 1, at)
            taken = np.where(go, self.accept[state], -1)
            best, best_end = np.where(taken >= 0, taken, best), np.where(taken >= 0, at, best_end)
            stop = ~go
            words.append(word[stop])
            tokens.append(best[stop])
            at = np.where(stop, best_end, at)
            keep = ~stop | (at < ends[word])
            word, at, state, best, best_end = word[keep], at[keep], state[keep], best[keep], best_end[keep]
        words, tokens = np.concatenate(words or [np.zeros(0, np.int64)]), np.concatenate(tokens or [np.zeros(0, np.int64)])
        order = np.argsort(words, kind="stable")
        return words[order], tokens[order]

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of the ranges and all tokens in order."""
        short = np.flatnonzero(ends - starts <= VECTOR_BYTES)
        word, token = self.proposed(data, starts[short], ends[short])
        suspect = np.zeros(len(short), bool)
        suspect[word[~self.own[token]]] = True
        inner = word[1:] == word[:-1]
        pairs, back = np.unique((token[:-1] << 32 | token[1:])[inner], return_inverse=True)
        suspect[word[:-1][inner][~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]]] = True
        exact = np.concatenate([short[suspect], np.flatnonzero(ends - starts > VECTOR_BYTES)])
        kept = ~suspect[word]
        raw = data.tobytes() if len(exact) else b""
        redone = [self.merged(raw[starts[i]:ends[i]]) for i in exact]
        owner = np.concatenate([short[word[kept]], np.repeat(exact, [len(r) for r in redone]).astype(np.int64)])
        tokens = np.concatenate([token[kept], np.array([t for r in redone for t in r], np.int64)])
        order = np.argsort(owner, kind="stable")
        return np.bincount(owner, minlength=len(starts)), tokens[order]

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the tokens, and the running byte count (one more than tokens)."""
        lengths = self.lengths[ids]
        return self.pool[ranges(self.offsets[ids], lengths)], np.concatenate([[0], np.cumsum(lengths)])

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes_of(ids)[0].tobytes().decode("utf-8", "replace")


_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Letter, number, white space or other for every code point, as the tokenizer library's own byte-level pattern has them.

    A run of code points that the library keeps together is of one class, and its first character tells which: it joins
    a letter, a number or a sign before it, or none of them. So results follow the library's Unicode version.
    """
    if not _classes:
        cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        kinds = np.zeros(0x110000, np.uint8)
        together = lambda pair: len(cut(pair)) == 1

        def kind(char: str) -> int:
            return next((k for k, before in ((LETTER, "a"), (NUMBER, "1"), (0, "!")) if together(before + char)), BLANK)
        for code in range(0x80):
            kinds[code] = kind(chr(code))
        for start in [0x80, *range(0x400, 0x110000, 0x400)]:
            if not 0xD800 <= start < 0xE000:
                chars = "".join(map(chr, range(start, start // 0x400 * 0x400 + 0x400)))
                for _, (a, b) in cut(chars):
                    kinds[start + a:start + b] = kind(chars[a])
        _classes.append(kinds)
    return _classes[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 bytes and the byte each starts at."""
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    place = np.flatnonzero((data & 0xC0) != 0x80)
    if len(place) != len(chars):
        raise ValueError("text is not UTF-8")
    return chars, place


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte starts of the pre-tokens of the byte-level pattern: contractions, runs of letters, numbers or signs, each
    with one blank before it, and white space, whose last character stays apart before anything else."""
    chars, place = code_points(data)
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64)
    kind, first = char_classes()[chars], edges(np.searchsorted(place, offsets), n)
    opens = first.copy()
    opens[1:] |= kind[1:] != kind[:-1]
    blank_end = np.zeros(n, bool)  # the last of a white space run before something else
    blank_end[:-1] = (kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~first[1:]
    opens |= blank_end
    joined = np.flatnonzero(blank_end & (chars == 32)) + 1
    opens[joined] = False
    quote = np.flatnonzero((chars == 39) & opens)
    follow = lambda k: np.where(quote + k < n, chars[np.minimum(quote + k, n - 1)], 0)
    same = lambda k: (quote + k < n) & ~first[np.minimum(quote + k, n - 1)]
    one, two = follow(1), follow(2)
    short = same(1) & np.isin(one, [ord(c) for c in "stmd"])
    long = same(1) & same(2) & ((two == ord("e")) & np.isin(one, [ord(c) for c in "rv"]) | (one == ord("l")) & (two == ord("l")))
    for at, size in ((quote[short], 2), (quote[long & ~short], 3)):
        opens[at + 1] = False
        rest = at + size
        opens[rest[rest < n]] = True
    return place[opens]


class WordMemory:
    """Ids of texts through the ids of their distinct pre-tokens. ``encode`` gives (counts, ids) for new pre-tokens."""

    def __init__(self, encode, added: dict[str, int], most: int | None = None):
        self.most = most or MEMORY_WORDS
        self.encode, self.added = encode, {k.encode(): v for k, v in added.items()}
        self.pattern = regex.compile(b"|".join(regex.escape(k) for k in sorted(self.added, key=len, reverse=True))) if added else None
        self.clear()

    def clear(self) -> None:
        self.keys, self.starts, self.counts, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == keys, at, -1) if len(self.keys) else np.full(len(keys), -1)

    def _ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = pre_tokens(data, offsets)
        ends = np.concatenate([starts[1:], [len(data)]]).astype(np.int64) if len(starts) else starts
        keys = hash_ranges(data, starts, ends)
        distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.most:
            self.clear()
        fresh = np.flatnonzero(self._look_up(distinct) < 0)
        if len(fresh):
            counts, ids = self.encode(data, starts[where[fresh]], ends[where[fresh]])
            new_starts = np.cumsum(counts) - counts + len(self.pool)
            all_keys = np.concatenate([self.keys, distinct[fresh]])
            order = np.argsort(all_keys, kind="stable")
            self.keys, self.pool = all_keys[order], np.concatenate([self.pool, ids])
            self.starts, self.counts = np.concatenate([self.starts, new_starts])[order], np.concatenate([self.counts, counts])[order]
        at = self._look_up(distinct)[back]
        counts = self.counts[at]
        running = np.concatenate([[0], np.cumsum(counts)])
        return self.pool[ranges(self.starts[at], counts)], running[np.searchsorted(starts, offsets)]

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents and the number of ids before each (one more at the end)."""
        cuts = [m.span() for m in self.pattern.finditer(data.tobytes())] if self.pattern else []
        if cuts:  # a match over the border of two documents is none
            first, last = np.array(cuts, np.int64).T
            cuts = [c for c, apart in zip(cuts, np.searchsorted(offsets, first, side="right") != np.searchsorted(offsets, last, side="left")) if not apart]
        if not cuts:
            return self._ids(data, offsets)
        pieces = np.unique(np.concatenate([offsets, np.array(cuts, np.int64).ravel()]))
        keep = np.ones(len(data), bool)
        for a, b in cuts:
            keep[a:b] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        ids, before = self._ids(data[keep], kept[pieces])
        special = {a: self.added[data[a:b].tobytes()] for a, b in cuts}
        out, counts, at = [], {}, 0
        for k, p in enumerate(pieces[:-1].tolist()):
            counts[p] = at
            part = [special[p]] if p in special else ids[before[k]:before[k + 1]]
            out.append(np.asarray(part, np.int64))
            at += len(part)
        counts[int(pieces[-1])] = at
        return np.concatenate(out), np.array([counts[p] for p in offsets.tolist()], np.int64)


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """A tokenizer file as arrays on every executor: fixed by the file, a few MB."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(Vocabulary(f.read()))


def encode_table(docs: DataFrame, words: Broadcast, keep: list[str]) -> DataFrame:
    """The kept columns, n_tokens, ids, and whether decoding the ids gives the text back."""
    read = docs.select(*[docs[c] for c in keep], docs["text"].alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", n_tokens long, ids array<int>, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = words.value
        memory = WordMemory(vocab.encode_words, vocab.added, TABLE_WORDS)
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "_text"):
                ids, before = memory.ids(data, offsets)
                raw, at = vocab.bytes_of(ids)
                made, same = at[before], np.diff(at[before]) == np.diff(offsets)
                for i in np.flatnonzero(same):
                    same[i] = np.array_equal(raw[made[i]:made[i + 1]], data[offsets[i]:offsets[i + 1]])
                lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[rows.column(i) for i in range(len(keep))], pa.array(np.diff(before), pa.int64()), lists, pa.array(same)],
                                                 [*keep, "n_tokens", "ids", "round_trip"])
    return read.mapInArrow(lean(run), schema)


def digests(docs: DataFrame, words: Broadcast) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (little-endian unsigned 32-bit) and of the decoded text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = words.value
        memory = WordMemory(vocab.encode_words, vocab.added)
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                ids, before = memory.ids(data, offsets)
                raw, at = vocab.bytes_of(ids)
                packed, raw, cut, text_cut = memoryview(ids.astype("<u4").tobytes()), memoryview(raw.tobytes()), before * 4, at[before]
                sha = lambda view, cuts: pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(before), pa.int64()), sha(packed, cut), sha(raw, text_cut)],
                                                 ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json")))
