"""Operator 12 against a plain version, on odd rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from textloom.llm import fill_in_middle as fim

TEXTS = [
    None, "", " ", "a", "abc", "two words", "Tag <P> inside", "<M>", "<S", "a<P", "<<P<S", "\x1f", "\x1a", "\x1a1\x1a2\x1f\x1f", "x\x1f1\x1ay2\x1a1", "é ü 中文 😀😀 ź", "line\nline\r\n\ttab",
    "ab1" * 40, "-" * 50, "same", "same", "$1 \\ $0 \\1", "Ending <", "P> S> M>", "\x00 nul", "word " * 3000,
]


def plain(doc_id, text, seed=1):
    t = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_parts_and_restoring(spark):
    rows = [(i, t, "kept", i) for i, t in enumerate(TEXTS * 8)] + [(None, "no id here", None, 0), (-5, "minus", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim_step string, x int")
    got = fim.transformed(docs, "out").withColumn("back", fim.restored(F.col("out.output"), F.col("out.form"))).collect()
    assert len(got) == len(rows)
    forms = set()
    for r in got:
        o = r["out"]
        want = plain(r["doc_id"], r["text"])
        assert (o["n"], o["form"], None if o["prefix"] is None else len(o["prefix"]), None if o["middle"] is None else len(o["middle"]), o["output"]) == want
        assert r["back"] == (r["text"] or "")
        forms.add(o["form"])
    assert forms == {"plain", "psm", "spm"} and {r["fim_step"] for r in got} == {"kept", None, "x"}


def test_empty_table(spark):
    assert fim.transformed(spark.createDataFrame([], "doc_id string, text string"), "out").count() == 0


@pytest.mark.parametrize("text", ["a" * 3_000_000, "+-" * 1_500_000, "word, " * 500_000])
def test_very_long_text(spark, text):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    for r in fim.transformed(docs, "out").collect():
        want = plain(r["doc_id"], text)
        assert r["out"]["n"] == want[0] and r["out"]["output"] == want[4]


def test_one_expression(spark, capsys):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    fim.transformed(docs, "out").explain("simple")
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan and plan.count("regexp_replace") == 1
