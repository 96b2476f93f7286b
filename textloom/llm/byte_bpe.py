"""Operator 7, byte-level BPE: encoding with a segment tree over byte positions, and decoding.

A pre-token starts as its bytes. Leaf i of a segment tree holds the rank of the pair that starts at byte i, and every
inner node the smaller (rank, position) of its children, so the root is the leftmost pair of minimum rank. A merge
joins that pair and changes three leaves at most: the merged position, its left neighbour, and the position that died;
each walks up the tree once. Many short pre-tokens are merged side by side, one column each of a tree of arrays; a long
one has a tree of its own. Texts are cut into pieces at white space, and a bounded memo keeps what pieces encode to.

Defined results: a null text encodes and decodes as an empty one (no ids). Repeated rows are encoded each by itself;
pairs of equal rank merge leftmost first. Other columns are passed on unread by `encode` and `decode`; a clash of the
new column's name with one of theirs is the caller's error and raises.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm._common import LONGEST_KEY, PIECES, lean, read, slices
from textloom.llm._public_bpe import pre_tokens

#: Pre-tokens of over so many bytes get a tree of their own.
WIDE = 32
NO_PAIR = np.int64(2**62)


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Merges:
    """A vocabulary's merges as arrays: ids of single bytes, and for each pair of ids that forms a token, its rank."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {(a, b): i for t, i in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None}
        self.pairs = pairs
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.of = keys[order], np.array(list(pairs.values()), dtype=np.int64)[order]
        self.pattern = pre_tokens(pattern)
        lengths = np.zeros(max(self.tokens) + 2, dtype=np.int64)
        for i, t in self.tokens.items():
            lengths[i + 1] = len(t)
        self.starts = np.cumsum(lengths)
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)), dtype=np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, NO_PAIR where they form no token."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.of[at], NO_PAIR)

    def one(self, word: bytes) -> list[int]:
        """The ids of one pre-token of any length, by its own segment tree."""
        n, pairs = len(word), self.pairs
        ids = self.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
        width = 1 << max(0, n - 1).bit_length()
        none = (1 << 62, 0)
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (r := pairs.get((ids[i], ids[i + 1]))) is not None:
                tree[width + i] = (r, i)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, rank: int | None) -> None:
            at = width + i
            tree[at] = none if rank is None else (rank, i)
            while at > 1:
                at >>= 1
                tree[at] = min(tree[2 * at], tree[2 * at + 1])

        while n > 1 and tree[1] is not none and tree[1][0] < none[0]:
            rank, i = tree[1]
            gone = after[i]
            ids[i], ids[gone] = rank, -1
            after[i] = then = after[gone]
            put(gone, None)
            if then < n:
                before[then] = i
                put(i, pairs.get((rank, ids[then])))
            else:
                put(i, None)
            if (left := before[i]) >= 0:
                put(left, pairs.get((ids[left], rank)))
        return [i for i in ids if i >= 0]

    def many(self, words: list[bytes]) -> list[list[int]]:
        """The ids of pre-tokens of WIDE bytes at most, merged side by side: column c of each array belongs to word c."""
        m, lengths = len(words), np.array([len(w) for w in words], dtype=np.int64)
        width = 1 << max(1, int(lengths.max()) - 1).bit_length()
        row = np.arange(width)[:, None]
        held = row < lengths
        ids = np.full((width + 1, m), -1, dtype=np.int64)
        ids[:width].T[held.T] = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after = np.where(row + 1 < lengths, row + 1, width)
        before = np.broadcast_to(row - 1, (width, m)).copy()
        tree = np.full((2 * width, m), NO_PAIR, dtype=np.int64)
        first = self.rank(ids[:-1], ids[1:])
        tree[width:] = np.where(first == NO_PAIR, NO_PAIR, first * width + row)
        for i in range(width - 1, 0, -1):
            np.minimum(tree[2 * i], tree[2 * i + 1], out=tree[i])

        def put(at: np.ndarray, cols: np.ndarray, ranks: np.ndarray) -> None:
            tree[width + at, cols] = np.where(ranks == NO_PAIR, NO_PAIR, ranks * width + at)
            node = (width + at) >> 1
            while len(node) and node[0]:
                tree[node, cols] = np.minimum(tree[2 * node, cols], tree[2 * node + 1, cols])
                node = node >> 1

        live = np.flatnonzero(tree[1] < NO_PAIR)
        while len(live):
            rank, at = np.divmod(tree[1, live], width)
            gone = after[at, live]
            ids[at, live], ids[gone, live] = rank, -1
            after[at, live] = then = after[gone, live]
            put(gone, live, np.full(len(live), NO_PAIR))
            put(at, live, self.rank(rank, ids[then, live]))
            more = then < width
            before[then[more], live[more]] = at[more]
            left = before[at, live]
            more = left >= 0
            put(left[more], live[more], self.rank(ids[left[more], live[more]], rank[more]))
            live = live[tree[1, live] < NO_PAIR]
        kept = ids[:width].T
        alive = kept >= 0
        ends = np.cumsum(alive.sum(axis=1)).tolist()
        flat = kept[alive].tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        starts, lengths = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
        if not len(ids):
            return np.zeros(0, dtype=np.uint8)
        ends = np.cumsum(lengths)
        return self.bytes[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


class Encoder:
    """Encodes texts a batch at a time; remembers what short pieces and pre-tokens encode to, up to `most` of each."""

    def __init__(self, merges: Merges, most: int = 300_000, block: int = 20_000):
        self.merges, self.most, self.block = merges, most, block
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> None:
        """Encodes pieces that aren't in the memo: their pre-tokens by length, many side by side."""
        split = [self.merges.pattern.findall(p) for p in new]
        words = list({w for ws in split for w in ws if w not in self.words})
        raw = sorted(((w.encode("utf-8"), w) for w in words), key=lambda x: len(x[0]))
        at = 0
        while at < len(raw) and len(raw[at][0]) <= WIDE:
            most = 1 << max(1, len(raw[at][0]) - 1).bit_length()
            end = at
            while end < len(raw) and end - at < self.block and len(raw[end][0]) <= most:
                end += 1
            for (_, w), ids in zip(raw[at:end], self.merges.many([b for b, _ in raw[at:end]]), strict=True):
                self.words[w] = array("I", ids).tobytes()
            at = end
        for b, w in raw[at:]:
            self.words[w] = array("I", self.merges.one(b)).tobytes()
        for p, ws in zip(new, split, strict=True):
            self.pieces[p] = b"".join(map(self.words.__getitem__, ws))
        for w in [w for w in words if len(w) > LONGEST_KEY]:
            del self.words[w]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; None counts as empty."""
        cut = [PIECES.findall(t) if t else [] for t in texts]
        if len(self.pieces) > self.most:
            self.pieces.clear()
        if len(self.words) > self.most:
            self.words.clear()
        known = self.pieces
        if new := list({p for ps in cut for p in ps if p not in known}):
            self.learn(new)
        coded = [b"".join(map(known.__getitem__, ps)) for ps in cut]
        for p in [p for p in new if len(p) > LONGEST_KEY]:
            del known[p]
        return coded


@lru_cache(maxsize=4)
def _merges(path: str, pattern: str) -> Merges:
    return Merges(path, pattern)


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(b) // 4 for b in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """df with a column of token ids for a text column. path: a rank file that every executor has."""
    if into in df.columns:
        raise ValueError(f"df has a column {into} already")
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_merges(path, pattern))
        for batch in slices(batches, column=text):
            ids = _lists(encoder.encode(batch.column(text).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, into])

    return df.mapInArrow(lean(run), schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with a column of the bytes that a column of token ids stands for; null ids give no bytes."""
    if into in df.columns:
        raise ValueError(f"df has a column {into} already")
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(path, pattern)
        for batch in slices(batches, chars=8_000_000, column=ids):
            lists = batch.column(ids)
            out = [merges.decode(np.asarray(v.values)).tobytes() if v.is_valid else b"" for v in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=pa.binary())], names=[*batch.schema.names, into])

    return df.mapInArrow(lean(run), schema)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path, pattern = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, path, pattern).drop("text")
    both = decode(coded, path, pattern)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
