"""Character tokens as columns, there and back; layouts that need no exchange."""

import math

import pytest
from pyspark.sql import functions as F

from textloom.functions import tokens
from textloom.operators import packing
from textloom.plans import catalogue


def test_texts_come_back(spark):
    """Byte order marks, the code points about 256, and those beyond the basic plane among them."""
    texts = ["", "plain", "﻿first", "in ﻿ it", "﻿", "a\u0000b", "éÿ", "ÿĀ", "日本", "x\U0001f600y", "\u0080 "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("ids", tokens.encode(F.col("t")))
    got = rows.select("i", "ids", tokens.decode(F.col("ids")).alias("back"), tokens.decode(F.concat(F.array(F.lit(0), F.lit(2)), "ids")).alias("special")).orderBy("i").collect()
    assert [r["back"] for r in got] == texts == [r["special"] for r in got]
    assert [r["ids"] for r in got] == [[ord(c) + tokens.OFFSET for c in t] for t in texts] == [tokens.character_ids(t).tolist() for t in texts]


def test_latent_layout_needs_no_exchange(spark):
    assert "Exchange" not in catalogue.latent_layout(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n,m", [(1, 3), (5, 4), (8, 1), (9, 7), (700, 300)])
def test_latent_positions(spark, n, m):
    laid = packing.latent_arrays(F.array_repeat(F.lit(5), n), F.array_repeat(F.lit(6), m), 8, 98, F.lit(1))
    wide, stretch = max(n, 8), max(float(m), m * (8 / n))
    want = [math.floor(i * wide / n) for i in range(n)] + [math.floor(i * wide / 8) for i in range(8)] + [math.floor(wide + i * stretch / m) for i in range(m)]
    assert spark.range(1).select(laid["position_ids"].alias("p")).first()["p"] == want
