"""Places in a global order, whatever the keys."""

from pyspark.sql import functions as F

from textloom.operators import config, validation
from textloom.sources import text


def test_positions_of_equal_keys_are_dealt(spark):
    frame = spark.range(200_000).select(F.col("id"), F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id") % 100).cast("long").alias("k"))
    parts = text.ranged(frame, "k").groupBy(F.shiftright("_id", 33).alias("p")).count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 0.4 * 200_000
    got = text.positions(frame, "k", ties=("id",)).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(200_000)) and [(r["k"], r["id"]) for r in got] == sorted((r["k"], r["id"]) for r in got)


def test_positions_of_odd_keys(spark):
    rows = [(None, 1), ("b", 2), ("", 3), ("ä", 4), ("b", 2), (None, 5)]
    got = text.positions(spark.createDataFrame(rows, "k string, x int"), "k", ties=("x",)).orderBy("pos").collect()
    assert [(r["k"], r["x"]) for r in got] == [(None, 1), (None, 5), ("", 3), ("b", 2), ("b", 2), ("ä", 4)]
    assert text.positions(spark.createDataFrame([], "k string, x int"), "k").count() == 0


def test_validation_draws_by_objective(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, " ").otherwise(F.concat(F.lit("some text "), F.col("id"))).alias("text"))
    got = validation.drawn(docs, 3, 8).collect()
    by = [{r["key"] for r in got if r["obj_idx"] == i} for i in range(3)]
    assert [len(b) for b in by] == [8, 8, 8] and len(by[0] | by[1] | by[2]) > 16 and not any(k % 4 == 0 for b in by for k in b)
    assert by != [{r["key"] for r in validation.drawn(docs, 3, 8, seed=1).collect() if r["obj_idx"] == i} for i in range(3)]
    made = validation.rows(docs, [config.objective("copying"), config.objective("infilling")], 5, 64)
    assert {r["objective"] for r in made.collect()} == {"copying", "infilling"} and made.count() <= 10
