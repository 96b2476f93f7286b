"""Operator 2, language-model scoring: prediction by partial matching over bytes.

A text is the byte stream of its lower-cased words, a space behind each, then an end byte. The trie's contexts are the
ORDER bytes before a symbol, and all their suffixes. Counts come from the documents that are to be learned from. A symbol
seen in a context is coded by its count there; else an escape (method C: as many escapes as distinct symbols) leads to
the next shorter context, in which the symbols of the longer one are excluded. Since every symbol of a context is also one
of its suffix, what exclusion takes away is a sum per node, so each level of the trie is a table, and the
code lengths of all (context, symbol) pairs follow from one join per level.

A block is a run of rows of a stored table, so it is the same in every pass. The run's length follows from the mean length of texts; a
run of over twice BLOCK_BYTES is dealt to several blocks by hash of the row, so a block holds little more than that or one text. A
block tells which pairs and words it holds and how often it learns them, in several parts if it holds many; these are summed over the corpus, coded, and go back to the blocks that
hold them: the model grows with the corpus and is never broadcast, and no block needs more of it than it uses. Pairs and words that
are frequent in a bounded sample (the head, HEAD and HEAD_WORDS of fixed number) are told by the task instead of the block and
given to all tasks, which spares their way; which they are changes no result. Long texts are worked on in parts. Words travel as 63-bit hashes.

Defined results: a null text is an empty one (the end alone). A null doc_id counts as the empty string in the fold, which
holds it out. Repeated rows are learned and scored each by itself. Without documents to learn from, every byte costs 8
bits. An empty table gives no rows. Other columns are not read. Documents that don't come from files are stored first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm._common import cut, lean, read, slices

#: Bytes of context.
ORDER = 5
END = b"\n"
ALPHABET = 256
#: Bytes of text and rows of a block, about and at most; runs up to whose number the table of heavy ones is broadcast.
BLOCK_BYTES, BLOCK_ROWS, BROADCAST = 32 << 20, 32_768, 100_000
#: Pairs and words given to all tasks; rows (by hash) and their longest length in bytes, from which these are chosen.
HEAD, HEAD_WORDS, HEAD_ROWS, HEAD_LONGEST = 1 << 18, 1 << 16, 2048, 1 << 16
#: Bytes worked on at once, and pairs and words held before they are told.
CHARS, HELD = 1_000_000, 1_200_000
#: Fixed values of the splitmix64 generator: its step and the multipliers of its output.
STEP, MIX_ONE, MIX_TWO = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Fixed value of the base score: what is added to each count.
ADDED = 0.1


_BREAK = re.compile(rb"[ \t-\r]")


def _segments(text: str | None, most: int = 0) -> Iterator[tuple[list[bytes], bool]]:
    """A text's lower-cased words in parts of about `most` bytes, and whether a part is the last."""
    raw, at = text.encode("utf-8").lower() if text else b"", 0
    while len(raw) - at > (most or CHARS) and (m := _BREAK.search(raw, at + (most or CHARS))):
        yield raw[at : m.start()].split(), False
        at = m.start()
    yield raw[at:].split() if at else raw.split(), True


def _parts(texts: list[str | None]) -> Iterator[tuple[int, bytes, bytes]]:
    """Texts in order, long ones in several parts: row, the context before the part, and its stream."""
    for row, text in enumerate(texts):
        lead = END * ORDER
        for words, last in _segments(text):
            stream = b" ".join([*words, END if last else b""])
            yield row, lead, stream
            lead = (lead + stream)[-ORDER:]


def _grouped(texts: list[str | None]) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """The parts in lists of about CHARS bytes."""
    some, size = [], 0
    for part in _parts(texts):
        some.append(part)
        size += len(part[2])
        if size >= CHARS:
            yield some
            some, size = [], 0
    if some:
        yield some


def _keys(parts: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Context and symbol as one number for every symbol of some parts and, behind them, a negative key for every word (END is one);
    the row of each; and the number of the former."""
    data = np.frombuffer(b"".join(x for _, lead, stream in parts for x in (lead, stream)), dtype=np.uint8)
    code = np.zeros(len(data) - ORDER, dtype=np.int64)
    for k in range(ORDER + 1):
        code <<= 8
        code |= data[k : len(data) - ORDER + k]
    sizes = np.array([len(stream) for *_, stream in parts])
    place = np.repeat(np.arange(len(parts)), sizes)
    # the symbols of a part stand behind its own lead and the leads and streams before it
    code = code[np.arange(len(place)) + ORDER * place]
    owner = np.array([row for row, *_ in parts])[place]
    begin, end = _word_places(code.astype(np.uint8), sizes)
    return np.concatenate([code, _word_keys(code.astype(np.uint8), begin, end)]), np.concatenate([owner, owner[begin]]), len(code)


def _word_places(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of bytes other than blanks, each within one part."""
    inside = np.concatenate([[False], symbols != 32, [False]])
    new = np.zeros(len(symbols) + 1, dtype=bool)
    new[np.cumsum(sizes)[:-1]] = True  # a part begins here
    return np.flatnonzero(inside[1:-1] & (~inside[:-2] | new[:-1])), np.flatnonzero(inside[1:-1] & (~inside[2:] | new[1:]))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_ONE
    x = (x ^ (x >> np.uint64(27))) * MIX_TWO
    return x ^ (x >> np.uint64(31))


#: For the hash of a word: a number for each byte, and an odd base with its inverse modulo 2^64.
BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP))
BASE, INVERSE = np.uint64(STEP), np.uint64(pow(STEP, -1, 1 << 64))


def _word_keys(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Negative keys of words: polynomials of their bytes, as differences of prefix sums, brought to the same power and mixed."""
    n = len(symbols)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTES[symbols] * np.cumprod(np.full(n, BASE)))])
    value = (sums[end + 1] - sums[begin]) * np.cumprod(np.full(n, INVERSE))[begin]
    return -1 - (_mixed(value) >> np.uint64(1)).astype(np.int64)


class _Told:
    """What a block has gathered and not told yet: keys and counts, the first of `parts` summed up, the others to be."""

    def __init__(self, block: int):
        self.block, self.parts, self.size = block, [], 0

    def add(self, found: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((found, n))
        if sum(len(k) for k, _ in self.parts[1:]) > max(200_000, len(self.parts[0][0])):
            self.sum_up()
        self.size = sum(len(k) for k, _ in self.parts)

    def sum_up(self) -> None:
        key, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(key)
        key, n = key[order], n[order]
        first = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if len(key) else 0))
        self.parts = [(key[first], np.add.reduceat(n, first) if len(first) else n)]

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.sum_up()
        return _rows(self.block, *self.parts[0])


def _rows(block: int | None, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(key), 100_000):
        k = key[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(k), type=pa.int64()), pa.array(k), pa.array(n[i : i + 100_000])], names=["block", "key", "n"])


def _gatherer(head: np.ndarray):
    """A function that tells, per block, its (context, symbol) codes and words with how often documents to learn from have them,
    each once or a few times; those of the head (sorted) it tells once per task, with no block."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.zeros(len(head), dtype=np.int64)
        now, open_now = None, {}

        def told() -> Iterator[pa.RecordBatch]:
            for t in open_now.values():
                yield from t.rows()
            open_now.clear()

        for batch in slices(batches, CHARS):
            runs, blocks = batch.column("run").to_numpy(), batch.column("block").to_numpy()
            learned = np.asarray(batch.column("learn").to_pylist(), dtype=np.int64)
            texts = batch.column("text").to_pylist()
            for run, block in dict.fromkeys(zip(runs.tolist(), blocks.tolist(), strict=True)):
                if run != now:
                    yield from told()
                    now = run
                rows = np.flatnonzero(blocks == block)
                learn = learned[rows]
                for parts in _grouped([texts[i] for i in rows]):
                    mine = open_now.setdefault(block, _Told(block))
                    key, owner, _ = _keys(parts)
                    inverse, found = pd.factorize(key)
                    n = np.bincount(inverse, weights=learn[owner], minlength=len(found)).astype(np.int64)
                    if len(head):
                        at = np.minimum(np.searchsorted(head, found), len(head) - 1)
                        known = head[at] == found
                        often[at[known]] += n[known]
                        found, n = found[~known], n[~known]
                    mine.add(found, n)
                    if sum(t.size for t in open_now.values()) > HELD:
                        yield from told()
        yield from told()
        yield from _rows(None, head, often)

    return gather


def _head(dealt: DataFrame) -> np.ndarray:
    """The keys (sorted) that are most frequent among some rows, HEAD pairs and HEAD_WORDS words at most."""
    share = min(1.0, HEAD_ROWS / max(1, dealt.count()))
    some = dealt.where(F.octet_length("text") <= HEAD_LONGEST).where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    nothing = np.zeros(0, dtype=np.int64)
    counts = some.select("text", F.lit(True).alias("learn"), "run", "block").mapInArrow(lean(_gatherer(nothing)), "block long, key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = cut(counts.where("n > 1"), "lm-head")
    best = [counts.where(which).orderBy(F.desc("n"), "key").limit(most).select("key").toPandas()["key"].to_numpy(np.int64) for which, most in (("key >= 0", HEAD), ("key < 0", HEAD_WORDS))]
    return np.sort(np.concatenate(best))


def code_lengths(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, n) of distinct context-and-symbol codes to (code, n, value): the log10 probability of the symbol in its context."""
    mask = lambda k: (1 << 8 * (k + 1)) - 1
    levels = counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("code").bitwiseAND(F.lit(mask(k))).alias("key")) for k in range(order + 1)))).alias("at"), "n")
    levels = levels.groupBy("at.k", "at.key").agg(F.sum("n").alias("n")).withColumn("node", F.shiftright("key", 8))
    node = Window.partitionBy("k", "node")
    seen = F.col("n") > 0
    trie = cut(levels.select("k", "key", "node", "n", F.sum("n").over(node).alias("total"), F.sum(seen.cast("long")).over(node).alias("distinct")), "trie")

    # g: the probability of a symbol that had to escape from this node, in the shorter contexts
    below = trie.where(F.col("k") == 0).withColumn("g", -F.log10(F.greatest(F.lit(ALPHABET) - F.col("distinct"), F.lit(1)).cast("double")))
    for k in range(1, order + 1):
        short = below.select(F.col("key").alias("short"), F.col("n").alias("n0"), F.col("total").alias("total0"), F.col("distinct").alias("distinct0"), F.col("g").alias("g0"))
        own = trie.where(F.col("k") == k).withColumn("short", F.col("key").bitwiseAND(F.lit(mask(k - 1)))).join(short, "short")
        excluded = F.sum(F.when(seen, F.col("n0")).otherwise(0)).over(Window.partitionBy("node"))
        own = own.withColumn("rest", F.col("total0") - excluded).withColumn("novel", F.col("distinct0") - F.col("distinct"))
        room = (F.col("rest") + F.col("novel")).cast("double")
        g = F.when(F.col("n0") > 0, F.log10(F.greatest(F.col("n0"), F.lit(1)) / F.greatest(room, F.lit(1.0)))).otherwise(F.when(F.col("novel") > 0, F.log10(F.col("novel") / room)).otherwise(0.0) + F.col("g0"))
        below = own.select("key", "n", "total", "distinct", g.alias("g"))
    all_of = (F.col("total") + F.col("distinct")).cast("double")
    top = F.when(seen, F.log10(F.greatest(F.col("n"), F.lit(1)) / all_of)).otherwise(F.when(F.col("distinct") > 0, F.log10(F.col("distinct") / all_of)).otherwise(0.0) + F.col("g"))
    return below.select(F.col("key").alias("code"), "n", top.alias("value"))


def score(docs: DataFrame, learn: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores stored docs(doc_id, text, learn boolean): doc_id, learn, n_tokens, n_known, train_tokens, base_score, score."""
    spark, id_kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    text, learned = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(learn), F.lit(False)).alias("learn")
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        stored = docs.select("doc_id", text, learned, *place)
    except AnalysisException:  # not a table of files
        stored = cut(docs.select("doc_id", text, learned), "lm-docs").select("doc_id", "text", "learn", *place)
    mean = stored.agg(F.avg(F.octet_length("text"))).first()[0] or 1
    rows = 1 << int(max(0.0, min(np.log2(BLOCK_ROWS), np.log2(block_bytes / mean))))
    stored = stored.withColumn("run", F.xxhash64("file", F.floor(F.col("row") / rows)))
    heavy = stored.groupBy("run").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).where(F.col("bytes") > 2 * block_bytes)
    heavy = cut(heavy.select("run", F.ceil(F.col("bytes") / block_bytes).alias("pieces")), "lm-heavy")
    piece = F.pmod(F.xxhash64("row"), F.col("pieces"))
    dealt = stored.join(F.broadcast(heavy) if heavy.count() <= BROADCAST else heavy, "run", "left").select("doc_id", "text", "learn", "run", F.when(F.col("pieces").isNull(), F.col("run")).otherwise(F.xxhash64("run", piece)).alias("block"))
    head = _head(dealt)
    held = cut(dealt.select("text", "learn", "run", "block").mapInArrow(lean(_gatherer(head)), "block long, key long, n long"), "lm-gathered")
    pairs, words = held.where("key >= 0"), held.where("key < 0")
    codes = cut(code_lengths(pairs.groupBy(F.col("key").alias("code")).agg(F.sum("n").alias("n"))), "lm-codes")
    given = spark.createDataFrame(pd.DataFrame({"code": head}), "code long")  # HEAD + HEAD_WORDS rows at most
    top = codes.join(F.broadcast(given), "code", "left_semi").select("code", "value").toPandas()
    said = words.where("block is null").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    head_keys, head_values = np.concatenate([top["code"].to_numpy(np.int64), said["key"].to_numpy(np.int64)]), np.concatenate([top["value"].to_numpy(np.float64), said["n"].to_numpy(np.float64)])
    counted = words.where("block is not null").select("block", "key", F.sum("n").over(Window.partitionBy("key")).cast("double").alias("value"))
    book = pairs.where("block is not null").join(codes.select(F.col("code").alias("key"), "value"), "key").select("block", "key", "value").unionByName(counted)

    def rate(mine: pa.Table, has: pa.Table) -> pa.Table:
        keys, values = np.concatenate([head_keys, has.column("key").to_numpy()]), np.concatenate([head_values, has.column("value").to_numpy()])
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]

        out: list[np.ndarray] = []
        for batch in slices(mine.select(["text"]).to_batches(), CHARS):
            rows = np.zeros((4, batch.num_rows))
            for parts in _grouped(batch.column("text").to_pylist()):
                key, owner, n = _keys(parts)
                inverse, found = pd.factorize(key)
                place = np.searchsorted(keys, found)
                if (place == len(keys)).any() or (keys[place] != found).any():
                    raise ValueError("a block holds pairs or words that it did not tell of")
                value = values[place][inverse]
                rows[3] += np.bincount(owner[:n], weights=value[:n], minlength=batch.num_rows)
                owner, c = owner[n:], value[n:]
                for i, each in enumerate((None, c > 0, np.log10(c + ADDED))):
                    rows[i] += np.bincount(owner, weights=each, minlength=batch.num_rows)
            out.append(rows)
        n_tokens, n_known, raw, scores = np.concatenate(out, axis=1) if out else np.zeros((4, 0))
        columns = [mine.column("doc_id"), mine.column("learn"), pa.array(n_tokens.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(raw), pa.array(scores)]
        return pa.Table.from_arrays(columns, names=["doc_id", "learn", "n_tokens", "n_known", "raw", "score"])

    rated = dealt.select("block", "doc_id", "learn", "text").groupBy("block").cogroup(book.groupBy("block")).applyInArrow(rate, f"doc_id {id_kind}, learn boolean, n_tokens long, n_known long, raw double, score double")
    totals = words.groupBy("key").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("train_tokens"), F.count_if(F.col("n") > 0).alias("train_words"))
    base = F.col("raw") - F.col("n_tokens") * F.log10(F.col("train_tokens") + F.lit(ADDED) * (F.col("train_words") + 1))
    return rated.crossJoin(F.broadcast(totals)).select("doc_id", "learn", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("to_learn"))
    return score(docs, "to_learn").select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
