"""Rows as they are laid out, their rules, and what one pass over a shard places."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import tokens
from textloom.operators import packing, statistics
from textloom.plans import catalogue


# Three examples and the row that they make.
def golden(spark):
    samples = [(0, 1, [1, 2, 3], [4, 5]), (0, 2, [6, 7], [8, 9, 10]), (0, 3, [11], [12])]
    return spark.createDataFrame(samples, "shard int, ord int, input_ids array<int>, label_ids array<int>").withColumn("n", F.size("input_ids") + F.size("label_ids"))


def test_golden_row(spark):
    placed = packing.place(golden(spark), "n", 16, 4)
    row = packing.dense_rows(placed, 16, start_id=99).first()
    assert row["input_ids"] == [1, 2, 3, 99, 4, 6, 7, 99, 8, 9, 11, 99, 0, 0, 0, 0]
    assert row["label_ids"] == [-100] * 3 + [4, 5] + [-100] * 2 + [8, 9, 10, -100, 12] + [-100] * 4
    assert row["segment_ids"] == [1] * 5 + [2] * 5 + [3] * 2 + [0] * 4
    assert row["attention_mask"] == [1, 1, 1, 3, 3, 1, 1, 3, 3, 3, 1, 3, 0, 0, 0, 0]
    assert packing.close_rows(placed, "n", 16, 4).count() == 1  # 4 slots left: closed


def test_most_samples_per_row(spark):
    placed = packing.place(golden(spark), "n", 128, 4, most=1)
    assert [r["pack_id"] for r in placed.orderBy("ord").collect()] == [0, 1, 2]


def test_open_tail_goes_unless_kept(spark):
    placed = packing.place(golden(spark), "n", 128, 4)
    assert packing.close_rows(placed, "n", 128, 4).count() == 0
    assert packing.close_rows(placed, "n", 128, 4, keep_tail=True).count() == 1


@pytest.mark.parametrize("fit", ["next", "best", "worst"])
def test_rows_never_overflow_and_keep_every_item(spark, fit):
    items = spark.range(500).select((F.col("id") % 3).cast("int").alias("shard"), F.col("id").alias("ord"), (F.col("id") * 37 % 90 + 1).cast("int").alias("n"))
    placed = packing.place(items, "n", 100, 10, fit=fit, rows=4).collect()
    assert len(placed) == 500
    rows = {}
    for r in placed:
        rows.setdefault((r["shard"], r["pack_id"]), []).append((r["start_off"], r["n"]))
    for parts in rows.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= 100


def test_too_large_fails(spark):
    with pytest.raises(Exception, match="does not fit"):
        packing.place(golden(spark), "n", 4, 1).collect()


def test_batches(spark):
    rows = spark.range(10).select(F.lit(0).alias("shard"), F.col("id").alias("pack_id"))
    assert [(r["batch_id"], r["row_in_batch"]) for r in packing.batches(rows, 4).orderBy("pack_id").collect()][-1] == (2, 1)


def test_best_and_worst_fit_choose(spark):
    items = spark.createDataFrame([(0, i, n) for i, n in enumerate([50, 70, 25, 40, 90, 90, 90])], "shard int, ord int, n int")
    packs = lambda fit: [r["pack_id"] for r in packing.place(items, "n", 100, 4, fit=fit, rows=3).orderBy("ord").collect()]
    assert packs("best")[:4] == [0, 1, 1, 0]
    assert packs("worst")[:4] == [0, 1, 2, 2]
    assert packs("best")[4:] == [2, 3, 4]  # none of the open rows takes the second 90: all are replaced


def test_separator_rows(spark):
    one = golden(spark).withColumn("n", packing.separator_cost(F.size("input_ids"), F.size("label_ids"), 2).cast("int"))
    row = packing.dense_rows(packing.place(one, "n", 20, packing.separator_room(1, 2)), 20, separator=[77, 78]).first()
    assert row["input_ids"] == [1, 2, 3, 77, 78, 4, 6, 7, 77, 78, 8, 9, 11, 77, 78] + [0] * 5
    assert row["label_ids"] == [-100] * 4 + [4, 5] + [-100] * 3 + [8, 9, 10] + [-100] * 2 + [12] + [-100] * 5
    assert row["attention_mask"] == [1] * 15 + [0] * 5
    bare = golden(spark).limit(1).withColumn("label_ids", F.array().cast("array<int>")).withColumns({"n": F.lit(5), "shard": F.lit(0)})
    assert packing.dense_rows(packing.place(bare, "n", 8, 2), 8, separator=[77, 78]).first()["label_ids"] == [-100] * 8


@pytest.mark.parametrize("causal", [False, True])
def test_attention_pairs_equal_the_condition(spark, causal):
    rows = packing.dense_rows(packing.place(golden(spark), "n", 16, 4), 16)
    at = rows.select(F.posexplode(F.arrays_zip("segment_ids", "attention_mask")).alias("pos", "p")).select("pos", "p.*")
    q, k = at.alias("q"), at.alias("k")
    sees = statistics.attends(*(F.col(f"{x}.{c}") for c in ("pos", "attention_mask", "segment_ids") for x in "qk"), causal=causal)
    assert q.join(k, sees).count() == statistics.attention_pairs(rows, causal).first()["n_pairs"]


def test_rows_of_texts_equal_dense_rows(spark):
    """Rows made in the placing pass are those that an exchange gathers, also where a row spans batches, and shards follow each other in a partition."""
    items = spark.range(3000).select((F.col("id") % 7).cast("int").alias("shard"), F.col("id").alias("ord"), F.lit("Pé").alias("prompt"), F.repeat(F.lit("a\U0001f600b"), (F.col("id") * 37 % 9).cast("int")).alias("input_text"), F.repeat(F.lit("üx"), (F.col("id") * 13 % 6 + 1).cast("int")).alias("label_text"))
    items = items.withColumn("n", F.length("prompt") + F.length("input_text") + F.length("label_text"))
    placed = packing.place(items, "n", 64, 8).withColumns({"input_ids": tokens.encode(F.concat("prompt", "input_text")), "label_ids": tokens.encode(F.col("label_text"))})
    shown = lambda rows: sorted(tuple(map(str, r)) for r in rows.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = shown(packing.rows_of_texts(packing.in_order(items), "n", 64, 8))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == shown(packing.dense_rows(placed, 64))
    with pytest.raises(Exception, match="does not fit"):
        packing.rows_of_texts(packing.in_order(items), "n", 16, 1).collect()


#: Exchanges of the queries over packed rows: documents to their shards, and what a query itself groups.
EXCHANGES = {"segment_starts": 1, "packed_rows_dense": 1, "label_density": 1, "marker_lookup_unknown": 2, "packed_segment_layout": 2, "attention_pairs_count": 1, "attention_pairs_causal": 1, "max_token_ids": 1}


@pytest.mark.parametrize("name", EXCHANGES)
def test_packed_rows_are_made_without_another_exchange(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == EXCHANGES[name]
