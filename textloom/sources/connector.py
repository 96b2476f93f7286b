"""Texts from generators as a Spark source: batches and streams, by worker, that go on where they stopped.

A generator is a function (split, worker_id, num_workers, rng_seed) -> iterable of items; `source` makes a data source of it. Each worker is a partition. A
stream reads so many rows of each worker a micro-batch; its offsets are an epoch and a place within it, the same for all workers, of which the shorter ones have
nothing more to give until the next epoch. Offsets only depend on where the stream is and on the workers' sizes, so a repeated micro-batch reads the
same rows, and a restarted stream neither skips nor repeats any.

`publish` writes a table as shuffled shards, one for each worker, in files of bounded size, and `shards` is a generator over them, which skips to a place by the files' counts.
A batch reads a worker's files by a task each.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from textloom.sources.text import shuffled_key, strided

SCHEMA = "worker int, epoch int, position long, key string, text string"
#: Rows that a worker hands over at once, and rows of each worker a micro-batch, if not given as option `rows`.
HANDED, ROWS = 1024, 10_000
#: Rows of a file of a published shard, about.
FILE_ROWS = 16_384


@dataclass
class Part(InputPartition):
    """A worker's rows of one epoch from a place to another (-1: to its end)."""

    worker: int
    epoch: int
    begin: int
    end: int


@dataclass(frozen=True)
class Contract:
    """What a source reads: the generator, how many items a worker has, and key and text of an item."""

    generator: Callable[[str, int, int, int], Iterable]
    size: Callable[[str, int, int], int]
    grab: Callable[[object], tuple[str | None, str | None]]
    split: str
    workers: int
    seed: int
    epochs: int
    reseed: bool
    rows: int
    cuts: Callable[[str, int, int], list[int]] | None = None

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        items = self.generator(self.split, part.worker, self.workers, self.seed + (part.epoch if self.reseed else 0))
        end = None if part.end < 0 else part.end
        if hasattr(items, "starting_at"):
            items = itertools.islice(items.starting_at(part.begin), None if end is None else end - part.begin)
        else:  # a plain iterable is read over again up to the place
            items = itertools.islice(items, part.begin, end)
        at = part.begin
        while held := [self.grab(i) for i in itertools.islice(items, HANDED)]:
            n = len(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.worker] * n, pa.int32()), pa.array([part.epoch] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), pa.array([h[0] for h in held], pa.string()), pa.array([h[1] for h in held], pa.string())],
                names=["worker", "epoch", "position", "key", "text"],
            )
            at += n


class Batches(DataSourceReader):
    """All epochs of all workers."""

    def __init__(self, contract: Contract):
        self.contract = contract

    def partitions(self) -> list[InputPartition]:
        if self.contract.epochs < 1:
            raise ValueError("a batch needs a number of epochs")
        parts = []
        for w in range(self.contract.workers):
            ends = self.contract.cuts(self.contract.split, w, self.contract.workers) if self.contract.cuts else [-1]
            parts += [Part(w, e, begin, end) for e in range(self.contract.epochs) for begin, end in zip([0, *ends], ends, strict=False)]
        return parts or [Part(0, 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.contract.read(partition)


class Stream(DataSourceStreamReader):
    """Micro-batches of the workers' rows. Spark asks for the next offset without telling where the stream is, so the place that was planned last is kept in
    the file that the option `progress` names."""

    def __init__(self, contract: Contract, progress: str):
        self.contract, self.progress = contract, progress
        self.sizes = [contract.size(contract.split, w, contract.workers) for w in range(contract.workers)]
        self.longest = max(self.sizes, default=0)

    def initialOffset(self) -> dict:
        return {"epoch": 0, "position": 0}

    def _place(self) -> dict:
        fs, path = _filesystem(self.progress)
        if fs.get_file_info(path).type == pa.fs.FileType.NotFound:
            return self.initialOffset()
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def latestOffset(self) -> dict:
        at = self._place()
        if not self.longest or 0 < self.contract.epochs <= at["epoch"]:
            return at
        then = at["position"] + self.contract.rows
        return {"epoch": at["epoch"], "position": then} if then < self.longest else {"epoch": at["epoch"] + 1, "position": 0}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        fs, path = _filesystem(self.progress)
        with fs.open_output_stream(f"{path}.new") as f:
            f.write(json.dumps(end).encode())
        fs.move(f"{path}.new", path)
        parts, epoch, begin = [], start["epoch"], start["position"]
        while (epoch, begin) < (end["epoch"], end["position"]):
            stop = end["position"] if epoch == end["epoch"] else self.longest
            parts += [Part(w, epoch, begin, min(stop, n)) for w, n in enumerate(self.sizes) if begin < n]
            epoch, begin = (epoch, stop) if epoch == end["epoch"] else (epoch + 1, 0)
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.contract.read(partition)


def source(name: str, generator: Callable[[str, int, int, int], Iterable], size: Callable[[str, int, int], int], grab: Callable[[object], tuple[str | None, str | None]] | None = None, cuts: Callable[[str, int, int], list[int]] | None = None) -> type[DataSource]:
    """A data source for spark.dataSource.register, then spark.read.format(name) or spark.readStream.format(name). size(split, worker_id, num_workers): how many
    items the generator has. grab: key and text of an item, which is the text itself if not given. cuts(split, worker_id, num_workers): places where the stretches
    end that tasks of a batch may read apart, the last of them the worker's size, for generators with `starting_at`; a task reads a worker if not given. Options: split, workers, seed, epochs (of a stream: 0 for
    no end), reseed (true: each epoch adds its number to the seed), rows (of each worker, a micro-batch), progress (of a stream: a file of its own)."""
    taken = grab or (lambda item: (None, item))

    class Texts(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def _contract(self) -> Contract:
            o = self.options
            workers, rows = int(o.get("workers", 1)), int(o.get("rows", ROWS))
            if workers < 1 or rows < 1:
                raise ValueError("workers and rows are at least 1")
            return Contract(generator, size, taken, o.get("split", "train"), workers, int(o.get("seed", 0)), int(o.get("epochs", 1)), str(o.get("reseed", "false")).lower() == "true", rows, cuts)

        def reader(self, schema) -> DataSourceReader:
            return Batches(self._contract())

        def streamReader(self, schema) -> DataSourceStreamReader:
            if not self.options.get("progress"):
                raise ValueError("a stream needs the option progress")
            return Stream(self._contract(), self.options["progress"])

    return Texts


def _filesystem(path: str):
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _told(folder: str, name: str):
    fs, path = _filesystem(f"{folder}/{name}")
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def _tell(folder: str, name: str, value: object) -> None:
    fs, path = _filesystem(f"{folder}/{name}")
    with fs.open_output_stream(path) as f:
        f.write(json.dumps(value).encode())


class Shard:
    """The rows of a published shard, from any place on: whole files and row groups before it are passed over by their counts."""

    def __init__(self, folder: str, worker: int):
        self.folder, self.worker = folder, worker

    def starting_at(self, place: int) -> Iterator[dict]:
        import pyarrow.parquet as pq

        fs, path = _filesystem(f"{self.folder}/shard={self.worker}")
        for name, size in _told(self.folder, "_files.json")[self.worker]:
            if place >= size:
                place -= size
                continue
            with pq.ParquetFile(fs.open_input_file(f"{path}/{name}")) as file:
                for group in range(file.num_row_groups):
                    n = file.metadata.row_group(group).num_rows
                    if place >= n:
                        place -= n
                        continue
                    for batch in file.iter_batches(HANDED, [group], columns=["key", "text"]):
                        if place < batch.num_rows:
                            yield from batch.slice(place).to_pylist()
                        place = max(0, place - batch.num_rows)

    def __iter__(self) -> Iterator[dict]:
        return self.starting_at(0)


def publish(df: DataFrame, folder: str, workers: int, key: str, text: str = "text", seed: int = 0) -> list[int]:
    """Writes df as a shard for each worker: row i of the shuffled order goes to worker i mod workers. The shards' sizes, which are stored beside them, as are the files' (a row
    for each file): a shard is a row of files, each written by one task from a range of the shard's places."""
    spark = df.sparkSession
    held = df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")).withColumn("order", shuffled_key(F.col("key"), seed))
    shards = strided(held, workers, "order", FILE_ROWS).select("shard", "pos", "key", "text")
    files = max(workers, -(-shards.count() // FILE_ROWS))
    shards.repartitionByRange(files, "shard", "pos").sortWithinPartitions("shard", "pos").write.mode("overwrite").partitionBy("shard").parquet(folder)
    found = spark.read.parquet(folder).groupBy("shard", F.col("_metadata.file_name").alias("name")).count().collect() if not shards.isEmpty() else []
    told = [sorted(([r["name"], r["count"]] for r in found if r["shard"] == w), key=lambda f: int(f[0].split("-")[1])) for w in range(workers)]  # part-N: the range's number
    sizes = [sum(n for _, n in of) for of in told]
    _tell(folder, "_files.json", told)
    _tell(folder, "_sizes.json", sizes)
    return sizes


def shards(name: str, folder: str) -> type[DataSource]:
    """A source over the shards that `publish` wrote to a folder that driver and executors share."""

    def held(what: str, worker: int, workers: int):
        every = _told(folder, what)
        if workers != len(every):
            raise ValueError(f"there are {len(every)} shards, not {workers}")
        return every[worker]

    def size(split: str, worker: int, workers: int) -> int:
        return held("_sizes.json", worker, workers)

    def cuts(split: str, worker: int, workers: int) -> list[int]:
        return list(itertools.accumulate(n for _, n in held("_files.json", worker, workers)))

    return source(name, lambda split, worker, workers, seed: Shard(folder, worker), size, lambda row: (row["key"], row["text"]), cuts)


def read(spark: SparkSession, name: str, **options: object) -> DataFrame:
    return spark.read.format(name).options(**{k: str(v) for k, v in options.items()}).load()


def read_stream(spark: SparkSession, name: str, **options: object) -> DataFrame:
    return spark.readStream.format(name).options(**{k: str(v) for k, v in options.items()}).load()
