"""Operator 12, fill-in-the-middle: texts are cut at two drawn places and put together anew, by escaped marker injection.

A delimiter and its escape character are escaped in the text, so that each still is one unit; a regular expression puts the delimiter behind every
unit. The units are then counted by their delimiters, and `substring_index` takes the parts by rank: what stands before the k-th delimiter are
the first k units. The parts lose their delimiters, are unescaped and joined by the markers. Column expressions only: no shuffle, no Python.

The places and the form are drawn from a hash of (seed, id), so they don't depend on partitions or repeats. A text that holds a marker stays plain,
so a form can be read back: no marker arises where parts and markers meet, as none begins with what another ends with.

Defined results: a null text is an empty one and stays plain, with no units. A null id is drawn like the empty string. Repeated rows are treated
alike, each by itself; nothing depends on other rows, so there are no ties. An empty table gives no rows. Other columns are kept as they are; the
operator adds one struct whose name they don't have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm._common import fresh, read

#: Markers of prefix, suffix and middle; per cent of texts that are changed at all, and of these per cent that put the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHANGED, SUFFIX_FIRST = 90, 20
SEED = 1
#: The delimiter and the escape character; both may occur in texts.
DELIMITER, ESCAPE = "\x1f", "\x1a"
#: An escaped text's units: a run of letters, an escaped character, or one other character.
UNIT = f"[A-Za-z]+|{ESCAPE}[12]|[^A-Za-z]"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}2")), F.lit(DELIMITER), F.lit(f"{ESCAPE}1"))


def unescaped(text: Column) -> Column:
    """The original of an escaped text, delimiters behind units or not."""
    bare = F.replace(text, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(f"{ESCAPE}1"), F.lit(DELIMITER)), F.lit(f"{ESCAPE}2"), F.lit(ESCAPE))


def _ranked(marked: str, n: str, low: str, high: str) -> dict[str, str]:
    """SQL of the three parts of a text with a delimiter behind each of its n units: units up to low, up to high, and the rest."""
    d = f"'{DELIMITER}'"
    upto = f"substring_index({marked}, {d}, {high})"
    return {"prefix": f"substring_index({marked}, {d}, {low})", "middle": f"substring_index({upto}, {d}, {low} - {high})", "suffix": f"substring_index({marked}, {d}, {high} - {n} - 1)"}


def transformed(docs: DataFrame, into: str, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with a struct of n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain) and output."""
    step = fresh(docs, "fim_step")
    held = docs.withColumn(step, F.struct(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256).alias("h")))
    t = F.col(step)["t"]
    draw = lambda k: F.conv(F.substring(F.col(step)["h"], 8 * k - 7, 8), 16, 10).cast("bigint")
    x = F.regexp_replace(escaped(t), UNIT, "$0" + DELIMITER)
    held = held.withColumn(step, F.struct(t.alias("t"), x.alias("x"), *(draw(k).alias(f"h{k}") for k in (1, 2, 3, 4))))
    s = lambda name: F.col(step)[name]
    # a delimiter is one byte
    n = (F.octet_length(s("x")) - F.octet_length(F.replace(s("x"), F.lit(DELIMITER), F.lit("")))).cast("bigint")
    plain = (s("t") == "") | F.contains(s("t"), F.lit(PREFIX)) | F.contains(s("t"), F.lit(SUFFIX)) | F.contains(s("t"), F.lit(MIDDLE)) | (s("h3") % 100 >= changed)
    form = F.when(plain, "plain").when(s("h4") % 100 < suffix_first, "spm").otherwise("psm")
    held = held.withColumn(step, F.struct(s("t").alias("t"), s("x").alias("x"), n.alias("n"), form.alias("form"), (s("h1") % (n + 1)).alias("one"), (s("h2") % (n + 1)).alias("two")))
    low, high = F.least(s("one"), s("two")).cast("int"), F.greatest(s("one"), s("two")).cast("int")
    held = held.withColumn(step, F.struct(s("t").alias("t"), s("x").alias("x"), s("n").alias("n"), s("form").alias("form"), low.alias("low"), high.alias("high")))
    sql = _ranked(*(f"{step}.{c}" for c in ("x", "n", "low", "high")))
    parts = {c: F.when(s("form") != "plain", unescaped(F.expr(e.replace(f"{step}.n", f"cast({step}.n as int)")))) for c, e in sql.items()}
    held = held.withColumn(step, F.struct(s("t").alias("t"), s("n").alias("n"), s("form").alias("form"), *(e.alias(c) for c, e in parts.items())))
    psm = F.concat(F.lit(PREFIX), s("prefix"), F.lit(SUFFIX), s("suffix"), F.lit(MIDDLE), s("middle"))
    spm = F.concat(F.lit(SUFFIX), s("suffix"), F.lit(PREFIX), s("prefix"), F.lit(MIDDLE), s("middle"))
    output = F.when(s("form") == "psm", psm).when(s("form") == "spm", spm).otherwise(s("t"))
    return held.withColumn(into, F.struct(*(s(c).alias(c) for c in ("n", "form", "prefix", "middle", "suffix")), output.alias("output"))).drop(step)


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form."""
    parts = F.split(output, "<[PSM]>")
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transformed(read(spark, sf_dir, "documents").select("doc_id", "text"), "fim")
    m = lambda c: F.col("fim")[c]
    chars = lambda c: F.length(m(c)).cast("bigint").alias(f"{c}_chars")
    return made.select("doc_id", m("n").alias("n"), m("form").alias("form"), chars("prefix"), chars("middle"), F.sha2(m("output"), 256).alias("output_sha256"), F.sha2(restored(m("output"), m("form")), 256).alias("restored_sha256"))


OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(cast(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, {", ".join(f"cast('0x' || substr(h, {8 * k - 7}, 8) AS BIGINT) AS h{k}" for k in (1, 2, 3, 4))} FROM d),
p AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {CHANGED} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT *, array_to_string(units[1 : low], '') AS prefix, array_to_string(units[low + 1 : high], '') AS middle, array_to_string(units[high + 1 : n], '') AS suffix FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE t END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM s
"""
