"""Flat names of nested columns."""

import pytest

from textloom.functions.nested import flattened


def test_leaves_are_named_by_their_paths(spark):
    df = spark.createDataFrame([(1, ((2, "x"), [3])), (4, None)], "a int, b struct<c: struct<`d.e`: int, f: string>, g: array<int>>")
    got = flattened(df)
    assert got.columns == ["a", "b.c.d.e", "b.c.f", "b.g"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, "x", [3]), (4, None, None, None)]
    assert flattened(df, "/").columns == ["a", "b/c/d.e", "b/c/f", "b/g"]
    assert flattened(df.limit(0)).count() == 0


def test_clashing_names_raise(spark):
    with pytest.raises(ValueError):
        flattened(spark.createDataFrame([(1, (2,))], "`b.c` int, b struct<c: int>"))
