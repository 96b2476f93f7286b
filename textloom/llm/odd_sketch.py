"""Operator 13, MinHash near-duplicates: odd sketches that verify banded candidates.

A text stands for its set of word shingles, as 64-bit hashes. Texts meet in the buckets of BANDS groups of BAND_ROWS MinHash values; a pair of the least
similarity, 0.8, misses all of them in (1 - 0.8^6)^50 = 2.5 of ten million cases, while texts that share a few common shingles hardly ever meet (at 0.03,
which is usual for pairs of words, 4 of a hundred million pairs).

The SAMPLE least hashes of a set (all, if it has fewer) are a MinHash sample. Folded into a bitmap of BITS bits, each sample flipping its bit, they are
the set's odd sketch. The exclusive or of two sketches is the sketch of what only one of the samples holds, so its population count is at most the number of
such samples: a pair whose count is over what the least similarity allows is none, for certain if the samples are the whole sets, else but for DEVIATIONS
standard deviations. What passes is confirmed on the full sets.

Equal sets are one node. In each bucket every node is first held against the bucket's least node, which joins groups of copies at once, whatever their size. What
that leaves in different groups is compared by sketches, in cells of bounded size: first, a cell tells only a spanning forest of the pairs that pass;
then, all that are still in different groups and were not asked before, so no link is lost. Pairs of nodes are asked once, and
a node with many partners has its set sent once to each part of them. No pair carries a text.

Defined results: a text without words, empty or null has an empty set and is linked with nothing: it is its own component and is kept. Null doc_ids are
ignored when the smallest is sought; a component of null ids has a null component_id. Repeated rows come back as often as they are there, and of rows that share the
component's id all are kept. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm._common import Memo, cut, lean, read, slices
from textloom.llm._graph import STEP, cells, components, mixed, whole_runs

SEED = 42
BANDS, BAND_ROWS = 50, 6
SAMPLE, BITS = 1024, 2048
DEVIATIONS = 5.0
#: Nodes of a bucket that are compared in one cell, and rows of them at once.
CELL, ROWS = 32_768, 64
#: Partners of a node in one part.
PARTNERS = 64
#: Rows of a table of wanted rows up to which it is broadcast.
BROADCAST = 100_000


@dataclass(frozen=True)
class Likeness:
    """Shingles of so many words, the least Jaccard similarity as a fraction, and how words are told: by ASCII white space and with only A-Z lower-cased, or by
    Unicode's white space and letter cases."""

    words: int = 2
    least: tuple[int, int] = (4, 5)
    ascii_only: bool = True

    def split(self, text: str | None) -> list:
        if not text:
            return []
        return text.encode("utf-8").lower().split() if self.ascii_only else text.lower().split()


#: Odd multipliers: of words by their place in a shingle, and of shingles for each MinHash value.
_PLACES = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(STEP)) | np.uint64(1)
_TURNS = mixed(np.arange(101, 101 + BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(STEP)) | np.uint64(1)


def hasher() -> Callable[[list], np.ndarray]:
    """A function from words to their hashes."""
    known = Memo(lambda w: xxhash.xxh64_intdigest(w, SEED), 200_000)
    return lambda words: np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(words: np.ndarray, length: int) -> np.ndarray:
    """The set (sorted) of hashes of the shingles of a sequence of word hashes; fewer words are one shingle, no words none."""
    k = min(length, len(words))
    if not k:
        return np.zeros(0, dtype=np.uint64)
    found = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        found += words[i : i + len(found)] * _PLACES[i]
    return np.unique(mixed(found))


def set_name(hashes: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit digest as two signed numbers."""
    digest = xxhash.xxh3_128_digest(hashes.tobytes())
    one, two = np.frombuffer(digest, dtype=">i8").tolist()
    return one, two


def odd_sketch(hashes: np.ndarray, sample: int = SAMPLE, bits: int = BITS) -> bytes:
    """The parities of the sample's bits; hashes sorted."""
    at = (hashes[:sample] & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def most_apart(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = (4, 5), sample: int = SAMPLE) -> np.ndarray:
    """How many samples may be in one of two sets' samples only, if the sets of sizes a and b have the least similarity."""
    p, q = least
    both = -(-p * (a + b) // (p + q))
    large = np.maximum(np.maximum(a, b), 1)
    share = np.minimum(1.0, both / large)
    common = np.where(large <= sample, both, sample * share - DEVIATIONS * np.sqrt(sample * share * (1 - share)) - 1)
    return np.minimum(a, sample) + np.minimum(b, sample) - 2 * common


def may_link(one: np.ndarray, two: np.ndarray, a: np.ndarray, b: np.ndarray, least: tuple[int, int] = (4, 5)) -> np.ndarray:
    """Whether sets of sizes a and b with these sketches (rows of unsigned 64-bit words) may have the least similarity."""
    apart = np.bitwise_count(one ^ two).sum(axis=-1, dtype=np.int64)
    p, q = least
    return (q * np.minimum(a, b) >= p * np.maximum(a, b)) & (apart <= most_apart(a, b, least))


def _matrix(column, bits: int = BITS) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint64).reshape(-1, bits // 64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each (not empty) set."""
    sizes = np.array([len(s) for s in sets])
    every, begin = np.concatenate(sets), np.cumsum(sizes) - sizes
    keys = np.zeros((len(sets), BANDS), dtype=np.uint64)
    for i in range(BAND_ROWS):
        least = np.stack([np.minimum.reduceat(every * turn, begin) for turn in _TURNS[i::BAND_ROWS]], axis=1)
        keys = mixed(keys + least)
    return (keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(STEP)).view(np.int64)


SETS = "one long, two long, size long, bands array<long>, odd binary"


def with_sets(docs: DataFrame, like: Likeness, more: Callable[[np.ndarray], list[int]] | None = None) -> DataFrame:
    """docs without their text, with their sets' names, sizes, band keys and odd sketches; more: and `prints`, numbers made of the words' hashes."""
    others = [f.name for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"] + list(T.StructType.fromDDL(SETS + (", prints array<long>" if more else "")).fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = hasher()
        for batch in slices(batches, 1_000_000):
            words = [hashed(like.split(t)) for t in batch.column("text").to_pylist()]
            sets = [shingle_set(w, like.words) for w in words]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            if full:
                for i, row in zip(full, band_keys([sets[i] for i in full]), strict=True):
                    keys[i] = row
            names = [set_name(s) for s in sets]
            made = [pa.array([n[0] for n in names], type=pa.int64()), pa.array([n[1] for n in names], type=pa.int64()), pa.array([len(s) for s in sets], type=pa.int64()), pa.array(keys, type=pa.list_(pa.int64())), pa.array([odd_sketch(s) for s in sets], type=pa.binary())]
            if more:
                made.append(pa.array([more(w) for w in words], type=pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *made], names=schema.names)

    return docs.mapInArrow(lean(run), schema)


def sets_of(rows: DataFrame, nodes: DataFrame, asked: DataFrame, like: Likeness) -> DataFrame:
    """(node, set): the full sets of asked nodes, from the row of rows(id, hash, text) that each node names."""
    wanted = nodes.join(asked, "node", "left_semi").select("node", "one", "two", F.col("least.id").alias("wanted_id"), F.col("least.hash").alias("wanted_hash"))
    wanted = cut(wanted, "wanted")
    small = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted
    found = rows.join(small, (F.col("hash") == F.col("wanted_hash")) & F.col("id").eqNullSafe(F.col("wanted_id"))).select("node", "one", "two", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = hasher()
        for batch in slices(batches, 1_000_000):
            sets = [shingle_set(hashed(like.split(t)), like.words) for t in batch.column("text").to_pylist()]
            right = [set_name(s) == (a, b) for s, a, b in zip(sets, batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True)]
            held = pa.array(right)
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(held), pa.array([s.tobytes() for s, r in zip(sets, right, strict=True) if r], type=pa.binary())], names=["node", "set"])

    return found.mapInArrow(lean(run), "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))


def confirmed(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], like: Likeness) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of nodes that were asked, and those of them whose full sets have the least similarity; both are stored."""
    pairs = cut(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    if pairs.isEmpty():
        return pairs, pairs
    full = cut(sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "sets")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(PARTNERS)).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    seconds = dealt.join(full, F.col("b") == F.col("node")).select("a", "part", "b", "set")
    firsts = dealt.select("a", "part").distinct().join(full, F.col("a") == F.col("node")).select("a", "part", F.lit(None).cast("long").alias("b"), "set")
    p, q = like.least
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(0, dtype=np.uint64)
        for batch in slices(batches, 8_000_000, column="set"):
            holds = []
            for b, other in zip(batch.column("b").to_pylist(), batch.column("set"), strict=True):
                other = np.frombuffer(other.as_buffer(), dtype=np.uint64)
                if b is None:  # the set that those after it are held against
                    mine = other.copy()
                    holds.append(False)
                    continue
                at = np.searchsorted(mine, other)
                at[at == len(mine)] = 0
                both = int((mine[at] == other).sum()) if len(mine) else 0
                holds.append(both * q >= p * (len(mine) + len(other) - both))
            held = pa.array(holds, type=pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(held), batch.column("b").filter(held)], names=["a", "b"])

    rows = firsts.unionByName(seconds).repartition(n, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return pairs, cut(rows.mapInArrow(lean(run), "a long, b long"), "confirmed")


def buckets(nodes: DataFrame) -> DataFrame:
    """key, lead, node: the buckets that hold several nodes, with the least of them."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("most")).where("lead < most").select("key", "lead")
    return cut(keyed.join(shared, "key"), "buckets")


def lead_pairs(nodes: DataFrame, shared: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): each node with the least node of each bucket that it is in, if their sketches allow the least similarity."""
    pairs = shared.where("lead <> node").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    one, two = (nodes.select(F.col("node").alias(c), F.col("odd").alias(f"{c}_odd"), F.col("size").alias(f"{c}_size")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (a, b), (n, m) = ((_matrix(batch.column(f"{c}_odd").to_pylist()) for c in "ab"), (batch.column(f"{c}_size").to_numpy() for c in "ab"))
                held = pa.array(may_link(a, b, n, m, like.least))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(held), batch.column("b").filter(held)], names=["a", "b"])

    return pairs.join(two, "b").join(one, "a").select("a", "b", "a_odd", "b_odd", "a_size", "b_size").mapInArrow(lean(run), "a long, b long")


def _cell_pairs(part: dict[str, np.ndarray], sketch: np.ndarray, low: np.ndarray, high: np.ndarray, like: Likeness, forest: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of low x high that are in different groups and may link; forest: only a spanning forest of them."""
    size, node, out = part["size"], part["node"], []
    rows = np.union1d(low, high)
    tree = np.zeros(len(size), dtype=np.int64)
    tree[rows] = np.unique(part["root"][rows], return_inverse=True)[1].reshape(-1)
    up = np.arange(len(rows))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    p, q = like.least
    for at in range(0, len(low), ROWS):
        some = low[at : at + ROWS]
        trees = up[tree[high]] if forest else tree[high]
        near = (tree[some][:, None] != trees) & (q * np.minimum(size[some][:, None], size[high]) >= p * np.maximum(size[some][:, None], size[high]))
        if high is low:
            near &= node[some][:, None] < node[high]
        i, j = np.nonzero(near)
        for x in range(0, len(i), 65_536):
            a, b = some[i[x : x + 65_536]], high[j[x : x + 65_536]]
            held = may_link(sketch[a], sketch[b], size[a], size[b], like.least)
            a, b = a[held], b[held]
            if not forest or not len(a):
                out.append((a, b))
                continue
            told = np.unique(a * len(rows) + up[tree[b]], return_index=True)[1]  # one link of a row to each group
            kept = []
            for k in told.tolist():
                if (s := find(int(tree[a[k]]))) != (t := find(int(tree[b[k]]))):
                    up[max(s, t)] = min(s, t)
                    kept.append(k)
            out.append((a[kept], b[kept]))
            while not ((higher := up[up]) == up).all():
                up[:] = higher
    return out


def cell_pairs(nodes: DataFrame, shared: DataFrame, roots: DataFrame, like: Likeness, forest: bool, cell: int = CELL) -> DataFrame:
    """(a, b): nodes of different roots that share a bucket and may link by their sketches; forest: of each cell, only a spanning forest."""
    placed = shared.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    several = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key", F.ceil(F.col("n") / F.lit(cell // 2)).cast("int").alias("blocks"))
    dealt = placed.join(several, "key").join(nodes.select("node", "odd", "size"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    by = ("key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cuts in whole_runs(batches, by):
            sketch, found = _matrix(part["odd"]), [(np.zeros(0, dtype=np.int64),) * 2]
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                low = np.flatnonzero(part["block"][x:y] == part["lo"][x]) + x
                high = low if part["lo"][x] == part["hi"][x] else np.flatnonzero(part["block"][x:y] == part["hi"][x]) + x
                found += _cell_pairs(part, sketch, low, high, like, forest)
            a, b = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part["node"][a].astype(np.int64)), pa.array(part["node"][b].astype(np.int64))], names=["a", "b"])

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = cells(dealt.select("key", "node", "root", "odd", "size", "block", "blocks"))
    return told.repartition(n, *by).sortWithinPartitions(*by).mapInArrow(lean(run), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def named_nodes(marked: DataFrame, *more: str) -> DataFrame:
    """A stored row for each different set of marked(id, hash, one, two, size, bands, odd): its node, a number, and the least row that has the set."""
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "hash")).alias("least")
    nodes = marked.groupBy("one", "two").agg(least, *(F.first(c).alias(c) for c in ("size", "bands", "odd", *more)))
    return cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")


def linked(nodes: DataFrame, rows: DataFrame, like: Likeness, more: DataFrame | None = None) -> DataFrame:
    """(node, root) of nodes that are not the least of their group. rows(id, hash, text) has the texts; more: further pairs (a, b) to be confirmed."""
    shared = buckets(nodes)
    full = lambda asked: sets_of(rows, nodes, asked, like)
    first = lead_pairs(nodes, shared, like)
    asked, sure = confirmed(first if more is None else first.unionByName(more), full, like)
    roots = components(sure)
    for forest in (True, False):
        pairs = cell_pairs(nodes, shared, roots, like, forest).join(asked, ["a", "b"], "left_anti")
        then, sure = confirmed(pairs, full, like)
        if not sure.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(sure))
        asked = asked.unionByName(then)
    return roots


def near_duplicates(docs: DataFrame, like: Likeness = Likeness(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).withColumn("hash", F.xxhash64("id", "text"))
    marked = cut(with_sets(rows, like), "sets")
    nodes = named_nodes(marked.where("size > 0"))
    roots = linked(nodes, rows, like)
    placed = cut(nodes.join(roots, "node", "left").select("one", "two", F.col("least.id").alias("id"), F.coalesce("root", "node").alias("root")), "placed")
    ids = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    by_set = placed.join(ids, "root").select("one", "two", "component_id")
    found = marked.where("size > 0").join(by_set, ["one", "two"]).select("id", "size", "component_id")
    alone = marked.where("size = 0").select("id", "size", F.col("id").alias("component_id"))
    return found.unionByName(alone).select(F.col("id").cast(kind).alias("doc_id"), F.col("size").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
