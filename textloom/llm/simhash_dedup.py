"""Operator 3, SimHash near-duplicates: pigeonring filtering of 64-bit fingerprints.

A fingerprint sums the bits of the XXH64 hashes of word shingles. Its bits form a ring of SEGMENTS segments. If two
fingerprints differ in at most `radius` bits, then somewhere on the ring begins a chain of consecutive segments in which
every prefix stays within its share of the budget: the first j segments differ in at most floor(j * radius / SEGMENTS)
bits. With five segments and four bits, the first segment of such a chain is equal and the second differs in one bit at
most, so one half of the second is equal too: segment and half are the bucket in which the two meet. Within a bucket the
prefixes of the chain are checked from the shortest to the longest, which is the whole distance.

Equal fingerprints count once. A bucket gives only a spanning forest of its links, never all pairs, and one with many
fingerprints is dealt to block pairs of bounded size, over as many tasks. Components come from rounds of
large-star and small-star joins over tables in the shared folder; only counts reach the driver.

Four bits are narrow for edited copies: two texts whose five-word shingles agree by 0.8 differ in ten bits or so of a shingle
fingerprint. `keep_one_similar`, the pipeline's stage, therefore takes fingerprints of the set of a text's words, which edits move little,
and takes links within the radius as candidates only. To them it adds the banded candidates of `odd_sketch`, whatever the edit was. Each candidate is
confirmed by the similarity of the two sets of shingles.

Defined results: a null or wordless text has the fingerprint 0, which links like any other. Null doc_ids are ignored when the
smallest is sought; a component of null ids has a null component_id. Repeated rows come back as often as they
are there. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import odd_sketch
from textloom.llm._common import cut, fresh, lean, read, slices
from textloom.llm._graph import STEP, cells, components, mixed, whole_runs

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Seeds of the fingerprints of word sets.
SEEDS = (42, 43)
#: Ring of segments: first bit and width of each, and how the second of a chain is halved.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints of a bucket that are compared in one cell.
CELL = 2048
#: Rows of the table of large buckets up to which it is broadcast.
BROADCAST = 200_000
#: Buckets of at most so many are compared row by row; they hold few pairs.
FEW = 6
#: What the stage calls similar: five-word shingles, a Jaccard similarity of 0.8 or more.
LIKE = odd_sketch.Likeness(5, (4, 5), ascii_only=False)


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n, ones = len(hashes), np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The SimHash of one text's shingles, as an unsigned 64-bit number."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, n = np.concatenate(([0], ends[:-1])).tolist(), max(1, len(words) - shingle + 1)
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    return _majority(np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[:n], stops, strict=True)), dtype=np.uint64, count=n))


def word_fingerprints(hashes: np.ndarray, seeds: tuple[int, ...] = SEEDS) -> list[int]:
    """The SimHashes of a set of word hashes, one per seed, for each of which the hashes are mixed anew; of no word: 0."""
    hashes = np.unique(hashes)
    return [_majority(mixed(hashes + np.uint64(seed * STEP % (1 << 64)))) if len(hashes) else 0 for seed in seeds]


def with_fingerprint(docs: DataFrame, into: str, shingle: int = SHINGLE_WORDS, text: str = "text") -> DataFrame:
    """docs with the fingerprint of a text column as a (signed) long."""
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=text):
            prints = np.array([fingerprint(t, shingle) for t in batch.column(text).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], names=schema.names)

    return docs.mapInArrow(lean(run), schema)


def _chain_keys() -> list[tuple[int, int]]:
    """Of each bucket key: the mask over the fingerprint, and the segment at which its chain begins."""
    keys = []
    for i, (at, width) in enumerate(SEGMENTS):
        then, wide = SEGMENTS[(i + 1) % len(SEGMENTS)]
        first = ((1 << width) - 1) << at
        half = wide // 2
        for a, w in ((then, half), (then + half, wide - half)):
            keys.append((first | ((1 << w) - 1) << a, i))
    return keys


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _prefixes() -> np.ndarray:
    """For the segment at which a chain begins and the number of segments after it, the mask of this prefix of the chain."""
    masks = np.array([((1 << width) - 1) << at for at, width in SEGMENTS], dtype=np.uint64)
    return np.stack([np.bitwise_or.accumulate(np.roll(masks, -i)) for i in range(len(SEGMENTS))])


PREFIXES = _prefixes()


def _within(apart: np.ndarray, start: int | np.ndarray, after: int, radius: int) -> np.ndarray:
    """Whether the chains' prefixes with `after` further segments stay within their share of the budget."""
    return np.bitwise_count(apart & PREFIXES[start, after]) <= (after + 1) * radius // len(SEGMENTS)


def _linked(a: np.ndarray, b: np.ndarray, start: int, radius: int) -> np.ndarray:
    """Which of a x b hold the whole chain from segment `start`, whose last prefix is all bits."""
    apart = a[:, None] ^ b[None, :]
    rows, cols = np.nonzero(_within(apart, start, 0, radius) & _within(apart, start, 1, radius))
    for after in range(2, len(SEGMENTS)):
        holds = _within(apart[rows, cols], start, after, radius)
        rows, cols = rows[holds], cols[holds]
    return np.stack([rows, cols])


def _forest(a: np.ndarray, b: np.ndarray | None, start: int, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between a and b (within a, if b is None), as pairs of fingerprints."""
    nodes = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    root = np.arange(len(nodes))
    edges: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for at in range(0, len(a), 256):
        rows, cols = _linked(a[at : at + 256], other, start, radius)
        ends = np.flatnonzero(np.diff(rows, append=-1)) + 1
        for x, y in zip([0, *ends.tolist()], ends.tolist(), strict=False):
            row, near = int(rows[x]) + at, cols[x:y] + shift
            for i in np.unique(root[near], return_index=True)[1].tolist():  # one link to each tree that it touches
                if (p := find(row)) != (q := find(int(near[i]))):
                    root[max(p, q)] = min(p, q)
                    edges.append((int(nodes[row]), int(nodes[near[i]])))
        while not ((up := root[root]) == root).all():
            root[:] = up
    return edges


def links(prints: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """(seed, a, b) pairs of distinct fingerprints (columns seed and fp) of one seed within the radius, whose components are
    those of all such pairs."""
    if radius >= len(SEGMENTS):
        raise ValueError("the chains here are complete up to a radius of 4 bits")
    masks = _chain_keys()
    starts = np.array([i for _, i in masks])
    keyed = prints.select("fp", "seed", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m, _ in masks))).alias("place", "key"))
    keyed = keyed.select("fp", (F.col("seed") * len(masks) + F.col("place")).alias("kind"), "key")
    large = keyed.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell // 2)
    large = cut(large.select("kind", "key", F.ceil(F.col("n") / F.lit(cell // 2)).cast("int").alias("blocks")), "large-buckets")
    dealt = keyed.join(F.broadcast(large) if large.count() <= BROADCAST else large, ["kind", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    told = cells(dealt.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).select("fp", "kind", "key", "block", "blocks"))
    by = ("kind", "key", "lo", "hi")

    def forest(part: dict[str, np.ndarray], cuts: np.ndarray) -> list[tuple[int, int, int]]:
        edges = []
        sizes = np.diff(cuts)
        run, length = np.repeat(np.arange(len(sizes)), sizes), np.repeat(sizes, sizes)
        for step in range(1, FEW):  # short runs: rows that stand `step` apart in the same run
            x = np.flatnonzero((run[step:] == run[:-step]) & (length[step:] <= FEW) & (part["lo"][step:] == part["hi"][step:]))
            one, two = part["fp"][x].view(np.uint64), part["fp"][x + step].view(np.uint64)
            start, near = starts[part["kind"][x] % len(masks)], np.ones(len(x), dtype=bool)
            for after in range(len(SEGMENTS)):
                near &= _within(one ^ two, start, after, radius)
            edges += zip((part["kind"][x][near] // len(masks)).tolist(), one[near].tolist(), two[near].tolist(), strict=True)
        many_rows = (sizes > FEW) | ((sizes > 1) & (part["lo"][cuts[:-1]] != part["hi"][cuts[:-1]]))
        for x, y in zip(cuts[:-1][many_rows].tolist(), cuts[1:][many_rows].tolist(), strict=True):
            seed, place = divmod(int(part["kind"][x]), len(masks))
            fp, start = part["fp"][x:y].view(np.uint64), masks[place][1]
            low = part["block"][x:y] == part["lo"][x]
            found = _forest(fp, None, start, radius) if part["lo"][x] == part["hi"][x] else _forest(fp[low], fp[~low], start, radius)
            edges += ((seed, p, q) for p, q in found)
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cuts in whole_runs(batches, by):
            three = np.array(forest(part, cuts), dtype=np.uint64).reshape(-1, 3).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(three[:, i]) for i in range(3)], names=["seed", "a", "b"])

    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return told.repartition(n, *by).sortWithinPartitions(*by).mapInArrow(lean(run), "seed long, a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp, component_id for docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType
    marked = cut(with_fingerprint(docs.select("doc_id", "text"), "fp", shingle).select("doc_id", "fp"), "fingerprints")
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp", F.lit(0).alias("seed")), radius))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").cast(kind).alias("component_id"))
    by_print = placed.join(ids, "root").select("fp", "component_id")
    return marked.join(by_print, "fp").select("doc_id", "fp", "component_id")


def _least_of(docs: DataFrame, order: Column, marked: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of docs that are the least of each root of placed(least, root)."""
    kept = placed.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.id").alias("id"), F.col("least.hash").alias("hash"))
    hashed = fresh(docs, "row_hash")
    found = docs.withColumn(hashed, order)
    found = found.join(kept, found["doc_id"].eqNullSafe(kept["id"]) & (found[hashed] == kept["hash"]), "left_semi")
    twice = marked.join(kept, marked["id"].eqNullSafe(kept["id"]) & (marked["hash"] == kept["hash"]), "left_semi").groupBy("id", "hash").count().where("count > 1")
    if not twice.isEmpty():  # equal in every column: any of them is the one
        found = found.dropDuplicates([hashed, "doc_id"])
    return found.drop(hashed)


def keep_one_similar(docs: DataFrame, radius: int = RADIUS, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """The document of the smallest id of each group of near copies, with all its columns. Of rows that share this id, one stays; of a group
    of null ids, one. Groups: texts linked by a similarity of LEAST or more of their five-word shingles, whatever edit made them,
    also through others. Texts of the same words are one node, named by a 128-bit digest of their shingles."""
    order = F.xxhash64(*(F.col(c) for c in docs.columns))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), order.alias("hash"))
    marked = cut(odd_sketch.with_sets(rows, LIKE, lambda words: [_signed(x) for x in word_fingerprints(words, seeds)]), "sets")
    nodes = odd_sketch.named_nodes(marked, "prints")
    several = nodes.where("size > 0").select("node", F.posexplode("prints").alias("seed", "fp"))
    named = cut(several.groupBy("seed", "fp").agg(F.min("node").alias("name")), "named")
    one, two = (named.select("seed", F.col("fp").alias(x), F.col("name").alias(f"{x}_name")) for x in "ab")
    near = links(named.select("seed", "fp"), radius).join(one, ["seed", "a"]).join(two, ["seed", "b"]).select(F.col("a_name").alias("a"), F.col("b_name").alias("b"))
    same = several.join(named, ["seed", "fp"]).where("node <> name").select(F.col("node").alias("a"), F.col("name").alias("b"))
    roots = odd_sketch.linked(nodes, rows, LIKE, near.unionByName(same))
    placed = nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "least")
    return _least_of(docs, order, marked.select("id", "hash"), placed)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
