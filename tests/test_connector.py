"""The generator contract as a source: epochs, restarts, and published shards."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import config
from textloom.sources import connector
from textloom.streaming import worker


def generators():
    """Functions that travel by value, as this module isn't where workers look."""

    def words(split, worker_id, num_workers, rng_seed):
        return [f"{split} {rng_seed} {i}" for i in range(23)][worker_id::num_workers]

    def sizes(split, worker_id, num_workers):
        return len(range(23)[worker_id::num_workers])

    return words, sizes


words, sizes = generators()


def rows(frame):
    return sorted((r["worker"], r["epoch"], r["position"], r["key"], r["text"]) for r in frame.collect())


def test_batch(spark):
    spark.dataSource.register(connector.source("some_words", words, sizes))
    got = rows(connector.read(spark, "some_words", workers=3, epochs=2, seed=5, split="validation").fillna("", ["key"]))
    assert got == sorted((w, e, p, "", t) for w in range(3) for e in range(2) for p, t in enumerate(words("validation", w, 3, 5)))
    again = connector.read(spark, "some_words", workers=2, epochs=3, reseed=True)
    assert {(r["epoch"], r["text"].split()[1]) for r in again.collect()} == {(0, "0"), (1, "1"), (2, "2")}
    with pytest.raises(Exception, match="epochs"):
        connector.read(spark, "some_words", epochs=0).collect()


@pytest.mark.parametrize("step", [3, 50])
def test_stream_goes_on_where_it_stopped(spark, tmp_path, step):
    """A run for each micro-batch, each with a new reader: together they read what the batch reads, once."""
    name = f"words_{step}"
    spark.dataSource.register(connector.source(name, words, sizes))
    options = {"workers": 3, "epochs": 2, "rows": step, "progress": str(tmp_path / "place.json")}
    want = rows(connector.read(spark, name, **options).fillna("", ["key"]))
    runs = 0
    while True:
        query = connector.read_stream(spark, name, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        runs += 1
        if len(query.recentProgress) == 0 or not any(p["numInputRows"] for p in query.recentProgress):
            break
        assert runs < 12
    assert runs == 1 + (6 if step == 3 else 2)
    assert rows(spark.read.parquet(str(tmp_path / "out")).fillna("", ["key"])) == want


def test_published_shards(spark, tmp_path):
    frame = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    folder = str(tmp_path / "shards")
    assert connector.publish(frame, folder, 3, "doc_id") == [334, 333, 333]
    spark.dataSource.register(connector.shards("published", folder))
    got = rows(connector.read(spark, "published", workers=3))
    assert len(got) == 1000 and sorted(int(r[3]) for r in got) == list(range(1000)) and all(r[4] == f"text {r[3]}" for r in got)
    assert [r["key"] for r in connector.Shard(folder, 1).starting_at(200)] == [r[3] for r in got if r[0] == 1][200:]
    with pytest.raises(Exception, match="shards"):
        connector.read_stream(spark, "published", workers=2, progress=str(tmp_path / "p")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    assert connector.publish(frame.limit(0), str(tmp_path / "none"), 2, "doc_id") == [0, 0]


def test_shards_into_the_coupled_fold(spark, tmp_path):
    """A stream of published shards, folded as they come, places all texts."""
    frame = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), 30).alias("text"))
    folder = str(tmp_path / "shards")
    connector.publish(frame, folder, 2, "doc_id")
    spark.dataSource.register(connector.shards("folded", folder))
    coming = connector.read_stream(spark, "folded", workers=2, rows=1000, progress=str(tmp_path / "place"))
    run = worker.Run(tuple(config.normalised([config.objective("next_token_prediction"), config.objective("copying")])), 128, 16)
    placed = worker.stream(coming.select(F.col("worker").alias("shard"), F.col("key").cast("long").alias("doc_id"), "text"), run)
    placed.writeStream.format("memory").queryName("folded_rows").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.table("folded_rows").where("status = 'ok'")
    assert {r["doc_id"] for r in got.collect()} == set(range(40)) and {r["shard"] for r in got.collect()} == {0, 1}


def test_shards_are_files_that_tasks_read_apart(spark, tmp_path, monkeypatch):
    """No task of a batch reads, and none writes, more than about so many rows of a shard; the places go on from file to file."""
    monkeypatch.setattr(connector, "FILE_ROWS", 100)
    frame = spark.range(1500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    folder = str(tmp_path / "shards")
    assert connector.publish(frame, folder, 2, "doc_id") == [750, 750]
    spark.dataSource.register(connector.shards("apart", folder))
    read = connector.read(spark, "apart", workers=2, epochs=2)
    per = read.groupBy(F.spark_partition_id(), "worker", "epoch").count().collect()
    assert max(r["count"] for r in per) <= 300 and sum(r["count"] for r in per) == 3000
    got = sorted((r["epoch"], r["worker"], r["position"], int(r["key"])) for r in read.collect())
    want = [r["doc_id"] for r in frame.orderBy(F.md5(F.concat(F.lit("0:"), F.col("doc_id").cast("string")).cast("binary"))).collect()]
    assert got == [(e, w, i, want[2 * i + w]) for e in range(2) for w in range(2) for i in range(750)]
    assert [int(r["key"]) for r in connector.Shard(folder, 1).starting_at(333)] == [k for e, w, i, k in got if e == 0 and w == 1 and i >= 333]
    connector.publish(frame.limit(0), str(tmp_path / "none"), 2, "doc_id")
    spark.dataSource.register(connector.shards("nothing", str(tmp_path / "none")))
    assert connector.read(spark, "nothing", workers=2).count() == 0
