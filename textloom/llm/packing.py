"""Operator 5, packing: shortest-pack-first over the length histogram.

Documents become token ids, those of added tokens included, with an end id and are cut at multiples of the sequence length; every piece but a document's
last fills a sequence. Only the histogram of piece lengths (at most as many bins as a sequence has tokens) comes to the
driver. There, lengths are placed longest first, each into the shortest pack that has room; equal packs are counted
together as patterns, so the plan's size depends on the sequence length alone. Pieces get their rank within their
length from counts per salted bucket, and the rank names the pattern's sequence and slot: no length's pieces
meet in one task.

Defined results: a null text is an empty document, which is the end id alone. Repeated rows are packed each by itself;
pieces alike in length are ranked by bucket, doc_id, start and checksum, and pieces equal in all are
interchangeable. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from textloom.llm._common import cut, lean, read, slices
from textloom.llm._public_bpe import public_bpe

SEQUENCE = 1024
END_ID = 0


def pieces(docs: DataFrame, path: str, pattern: str, sequence: int = SEQUENCE, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens (with_ids: and ids)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens"))])
    kind = to_arrow_type(schema["doc_id"].dataType)
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType(), False))
    last = int(end_id).to_bytes(4, "little")
    step = 4 * sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = public_bpe(path, pattern)
        for batch in slices(batches):
            rows: list[list] = [[] for _ in schema.names]
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = coder.raw(t, added=True) + last
                for at in range(0, len(raw), step):
                    part = raw[at : at + step]
                    for column, value in zip(rows, (i, at // 4, len(part) // 4, zlib.crc32(part), len(raw) // 4, *([np.frombuffer(part, dtype=np.int32)] if with_ids else [])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], type=kind)] + [pa.array(c, type=pa.int64()) for c in rows[1:5]] + [pa.array(c, type=pa.list_(pa.int32())) for c in rows[5:]], names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), schema)


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how often each occurs, for a histogram of lengths: longest first, into the shortest pack with room."""
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(histogram, reverse=True):
        if not 1 <= length <= sequence:
            raise ValueError(f"a piece of {length} tokens doesn't fit a sequence of {sequence}")
        left, placed = histogram[length], []
        for room in sorted((r for r in open_packs if r >= length), reverse=True):
            packs = open_packs[room]
            while left and packs:
                pattern, count = packs.pop()
                used = min(count, left)
                if count > used:
                    packs.append((pattern, count - used))
                placed.append((room - length, ((*pattern, length), used)))
                left -= used
            if not packs:
                del open_packs[room]
            if not left:
                break
        if left:
            placed.append((sequence - length, ((length,), left)))
        for room, pack in placed:
            open_packs.setdefault(room, []).append(pack)
    return [pack for room in sorted(open_packs) for pack in open_packs[room]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, its slots in order: the first rank of each, the sequence that gets this rank, and the offset there."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            found.setdefault(length, []).append((used.get(length, 0), base, offset))
            used[length] = used.get(length, 0) + count
            offset += length
        base += count
    return {length: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for length, rows in found.items()}


def pack(cut_pieces: DataFrame, sequence: int = SEQUENCE, buckets: int | None = None) -> DataFrame:
    """cut_pieces (a stored table as `pieces` gives it; other columns are passed on) with sequence_id and offset."""
    spark = cut_pieces.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = cut_pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `sequence` rows at most
    where = slots(plan(histogram, sequence))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1).join(before, ["length", "bucket"])
    ranked = ranked.select(*cut_pieces.columns, (F.col("rank") + F.col("before")).alias("rank"))
    schema = T.StructType([*cut_pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for n in np.unique(length):
                firsts, bases, offsets = where[int(n)]
                rows = length == n
                slot = np.searchsorted(firsts, rank[rows], side="right") - 1
                seq[rows], off[rows] = bases[slot] + rank[rows] - firsts[slot], offsets[slot]
            kept = [batch.column(c) for c in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(off)], names=schema.names)

    return ranked.mapInArrow(lean(place), schema)


def sequences(packed: DataFrame, sequence: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: input_ids and segment_ids by sequence_id, for packed pieces with ids. Padded to `sequence`
    unless the tokens are a power of two in number. A group holds one sequence, `sequence` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    got = packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.flatten(F.transform("parts", lambda p, i: F.array_repeat(i + 1, F.size(p["ids"])))).alias("segments"))
    n = F.size("ids")
    room = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(F.lit(sequence) - n).cast("int")
    return got.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), room)).alias("input_ids"), F.concat("segments", F.array_repeat(F.lit(0), room)).alias("segment_ids"), n.alias("used"))


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers as P

    return pack(cut(pieces(docs, P.path("byte_bpe_50k.json"), P.PATTERN), "pieces"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
