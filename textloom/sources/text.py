"""Text sources: grabbing, splitting, sharding, shuffling, repeating, and synthetic texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textloom.functions.hashrand import uniform
from textloom.sources.shared import shared_folder

#: Rows of a range of an order, if there are more of them than the session has shuffle partitions for.
RANGE_ROWS = 4_000_000


def grab(df: DataFrame, text: Column | str = "text", strict: bool = False) -> DataFrame:
    """df with a text column from any expression, such as F.col("entry.text"). strict: a missing text fails the job."""
    column = F.col(text) if isinstance(text, str) else text
    column = column.cast("string")
    return df.withColumn("text", F.coalesce(column, F.raise_error(F.lit("empty_text"))) if strict else F.coalesce(column, F.lit("")))


def split_of(key: Column, train: float = 0.98, validation: float = 0.01, seed: int = 0) -> Column:
    u = uniform(seed, "split", key)
    return F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test")


def shuffled_key(key: Column, seed: int = 0) -> Column:
    """Sorting by this shuffles; the order is a function of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def sorted_ranges(df: DataFrame, order: str, ties: tuple[str, ...] = (), rows: int = RANGE_ROWS) -> DataFrame:
    """df sorted in partitions of about as many rows each, in the order of the partitions. Bounds come from Spark's sample of the sort keys, the last of which is
    a hash of the row, so runs of equal keys are split like others. rows: about the most in a range; fewer for long rows."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    keys = [F.col(order), *map(F.col, ties), F.col("_tie")]
    return df.withColumn("_tie", F.xxhash64(*(F.col(c) for c in df.columns))).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_tie")


def ranged(df: DataFrame, order: str, ties: tuple[str, ...] = (), rows: int = RANGE_ROWS) -> DataFrame:
    """Sorted ranges, stored, with `_id`: the range's number and, in the 33 lowest bits, the place within it."""
    spark = df.sparkSession
    held = sorted_ranges(df, order, ties, rows)
    path = shared_folder(spark, "ranges")
    held.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)  # a sample is drawn once; what follows reads one outcome
    return spark.read.parquet(path)


def positions(df: DataFrame, order: str, into: str = "pos", ties: tuple[str, ...] = (), rows: int = RANGE_ROWS) -> DataFrame:
    """df with each row's place (from 0) in the order of a column: places within ranges, and counts of the ranges before. No window holds rows."""
    found = ranged(df, order, ties, rows)
    counts = found.groupBy(F.shiftright("_id", 33).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # one row per range
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    return found.withColumn("_range", F.shiftright("_id", 33)).join(F.broadcast(before), "_range").withColumn(into, place.cast("long")).drop("_range", "_id", "_before")


def strided(df: DataFrame, shards: int, order: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Row i goes to shard i mod shards."""
    return positions(df, order, rows=rows).withColumn("shard", (F.col("pos") % shards).cast("int"))


def shuffled_within(df: DataFrame, shard: str, key: str, seed: int = 0, into: str = "pos") -> DataFrame:
    """df with each row's place (from 0) in its shard, shuffled by seed and key. Shards are stretches of one order, so none has to fit a task."""
    keyed = df.withColumn("_key", F.concat_ws(":", F.format_string("%012d", F.col(shard).cast("long")), shuffled_key(F.col(key), seed)))
    placed = positions(keyed, "_key", "_pos")
    first = placed.groupBy(F.col(shard).alias("_shard")).agg(F.min("_pos").alias("_first"))
    return placed.join(first, F.col(shard).eqNullSafe(F.col("_shard"))).withColumn(into, F.col("_pos") - F.col("_first")).drop("_key", "_pos", "_shard", "_first")


def contiguous(df: DataFrame, shards: int, order: str) -> DataFrame:
    """Blocks of neighbours; the first (rows mod shards) blocks have one row more."""
    n = df.count()
    small, more = divmod(n, shards)
    at = F.col("pos")
    shard = F.when(at < more * (small + 1), F.floor(at / (small + 1))).otherwise(more + F.floor((at - more * (small + 1)) / max(1, small)))
    return positions(df, order).withColumn("shard", shard.cast("int"))


def addressed(shards_of_task: int, tasks: int, task: int) -> range:
    """The shards that one of several jobs reads, when each reads `shards_of_task` of them: its place times their number, and on."""
    if not 0 <= task < tasks:
        raise ValueError("a job's place lies below the number of jobs")
    return range(shards_of_task * task, shards_of_task * (task + 1))


def load(spark: SparkSession, source: str, path: str, defaults: dict[str, object] | None = None, **overrides: object) -> DataFrame:
    """A source by its format; options are the defaults, of which overrides take precedence."""
    return spark.read.format(source).options(**{**(defaults or {}), **overrides}).load(path)


def hashed_shard(key: Column, shards: int) -> Column:
    """A shard that needs no count or sort."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % shards).cast("int")


def epochs(df: DataFrame, n: int) -> DataFrame:
    """df n times over, with the epoch."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def synthetic_text(key: Column, lengths: tuple[int, ...], base: str = "abcdefghijklmnopqrstuvwxyz ") -> Column:
    """A text whose length a whole number chooses, in turns."""
    size = F.element_at(F.array(*(F.lit(n) for n in lengths)), (F.pmod(key, F.lit(len(lengths))) + 1).cast("int"))
    return F.substring(F.repeat(F.lit(base), (F.ceil(size / len(base))).cast("int")), F.lit(1), size)


def synthetic(spark: SparkSession, rows: int, lengths: tuple[int, ...], base: str = "abcdefghijklmnopqrstuvwxyz ") -> DataFrame:
    """Texts whose lengths take turns."""
    return spark.range(rows).select(F.col("id").alias("doc_id"), synthetic_text(F.col("id"), lengths, base).alias("text"))


def collapse_runs(lines: DataFrame, within: str, order: str, line: str) -> DataFrame:
    """Runs of equal neighbouring lines as one row: first place, line, repeats."""
    w = Window.partitionBy(within).orderBy(order)
    marked = lines.withColumn("_new", F.coalesce((~F.col(line).eqNullSafe(F.lag(line).over(w))).cast("int"), F.lit(1)) * F.lit(1))
    marked = marked.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(F.col("_new"))).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(within, "_run").agg(F.min(order).alias("first"), F.first(line).alias(line), F.count(F.lit(1)).alias("n")).drop("_run")


def _runs_of(batches: Iterator[pa.RecordBatch], line: str) -> Iterator[pa.RecordBatch]:
    """Runs of a sorted partition: each one's first row, with its number (from 1) and length. Only the run that is still open goes from batch to batch."""
    head, held, number = None, 0, 1

    def told(rows: pa.RecordBatch, sizes: np.ndarray) -> pa.RecordBatch:
        places = np.arange(number, number + len(sizes), dtype=np.int64)
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(places), pa.array(sizes.astype(np.int64))], names=[*rows.schema.names, "_run", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(line)
        a, b = column.slice(0, len(column) - 1), column.slice(1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], ~same.astype(bool)]))
        sizes, rows = np.diff(np.append(starts, len(column))), batch.take(pa.array(starts))
        if head is not None:
            if head.column(line)[0].as_py() == rows.column(line)[0].as_py():
                held, rows, sizes = held + int(sizes[0]), rows.slice(1), sizes[1:]
            if not len(sizes):
                continue
            yield told(head, np.array([held]))
            number += 1
        if len(sizes) > 1:
            yield told(rows.slice(0, len(sizes) - 1), sizes[:-1])
            number += len(sizes) - 1
        head, held = rows.slice(len(sizes) - 1), int(sizes[-1])
    if head is not None:
        yield told(head, np.array([held]))


def collapse_stream(lines: DataFrame, order: tuple[str, ...], line: str) -> DataFrame:
    """Runs of equal neighbours in one long order of lines that no key divides: the order columns of a run's first line, the line (null equals null), and n.

    Each sorted range of the order is collapsed by itself. What a range says to others is its first and last run only: a run that ends a range and one that begins the
    next are the same run if their lines are equal, and a range that is all one run hands on what it was given. So runs of any length meet in one row without
    meeting in one task. Lines equal in all order columns lie in no defined order."""
    spark = lines.sparkSession
    found = sorted_ranges(lines.select(*order, line), order[0], order[1:]).withColumn("_range", F.spark_partition_id())
    schema = T.StructType([*found.schema.fields, T.StructField("_run", T.LongType()), T.StructField("n", T.LongType())])
    path = shared_folder(spark, "runs")
    found.mapInArrow(lambda batches: _runs_of(batches, line), schema).write.parquet(path)  # ranges are drawn once; what follows reads one outcome
    runs = spark.read.parquet(path)
    last = runs.groupBy("_range").agg(F.max("_run").alias("_last"))
    edges = runs.join(F.broadcast(last), "_range").where((F.col("_run") == 1) | (F.col("_run") == F.col("_last"))).select("_range", "_run", F.sha2(line, 256).alias("_line"), F.col("n").alias("_n"))
    across = Window.orderBy("_range", "_run")  # two rows per range
    goes_on = F.lag("_line").over(across).eqNullSafe(F.col("_line")) & (F.lag("_range").over(across) != F.col("_range"))
    joined = edges.withColumn("_head", F.coalesce(~goes_on, F.lit(True))).withColumn("_whole", F.sum(F.col("_head").cast("int")).over(across))
    joined = joined.withColumn("_total", F.sum("_n").over(Window.partitionBy("_whole"))).select("_range", "_run", "_head", "_total")
    kept = runs.join(F.broadcast(joined), ["_range", "_run"], "left").where(F.coalesce("_head", F.lit(True)))
    return kept.select(*(F.col(c) for c in order), line, F.coalesce("_total", "n").alias("n"))


def shown_runs(runs: DataFrame, line: str) -> Column:
    """A run as text: the line, and how often it was repeated."""
    return F.when(F.col("n") > 1, F.concat(line, F.lit("\n  [Last line repeated "), (F.col("n") - 1).cast("string"), F.lit(" times...]"))).otherwise(F.col(line))
