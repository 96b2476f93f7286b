"""Operator 11, spelling variant grouping: words one edit apart, found by rolling-hash deletions.

Words are counted with DataFrame functions. Each distinct word then gives one row for itself and one for each of its code points: the hash of the word
without that one. A word's polynomial hash is a sum over places, so prefix sums give the hash of what stands before a place, differences of
them the hash of what stands behind it, and the inverse of the base moves the latter down by one: all deletion keys of a batch of words come from a few NumPy
operations on integers. Rows are dealt by the leading bits of the keys (radix) and sorted by key and place.

Two words differ by a replaced code point if they are alike without the same place; one has a code point more than the other if it is alike to the other
when it lacks a place (of a run of equal code points, only the first counts). So rows of one key and place, and rows of one key with the row of a whole
word, give for every word the number of its near words and the most frequent of them, without a pair ever being told. Keys that agree by
chance are told apart on the strings themselves, or, in words of over LONGEST code points, whose rows would grow with the square of
their length, by two further hashes (62 bits). At most one word for each letter of the alphabet shares a key and a place, so no group is large.

A word's form is at least twice as frequent as the word; following forms thus ends soon, and is done by doubling: each round joins every word's
pointer with the pointer's own. Rounds are tables in the shared folder.

Defined results: a null text has no words; a null id counts as an empty string in the hash that deletes a code point. Repeated rows count as often as they are there.
Ties of forms go to the smaller word in code-point order. An empty table, or one without words that occur often enough, gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm._common import cut, discard, lean, read, scratch, stored

#: What a run of letters is, the divisor that chooses runs to lose a code point, least length and least count of a word, and how
#: many times as frequent as a word its form is.
RUN, DAMAGED = r"[A-Za-zÀ-ÿ]+", 97
LEAST_CHARS, LEAST_COUNT, FORM_TIMES = 5, 3, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of more code points are told apart by hashes, as their rows don't carry strings.
LONGEST = 64
#: Rows that are made at once, and bits of a key by which rows are dealt.
ROWS, RADIX_BITS = 200_000, 12
#: Odd base of the polynomial modulo 2^64, and primes with their bases.
BASE = 0x9E3779B97F4A7C15
PRIMES = ((2_147_483_647, 1_181_783_497), (2_147_483_629, 1_597_334_677))


def words_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", damaged: int = DAMAGED) -> DataFrame:
    """(word) for every run of letters of docs, after chosen ones have lost a code point."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % damaged == 0, less).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, least_chars: int = LEAST_CHARS, least: int = LEAST_COUNT) -> DataFrame:
    """wid, word, n of the frequent words, stored; wid follows the words' code-point order."""
    n = words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    n = cut(n, "spelling-counts")  # so that sampling for the order doesn't count again
    return cut(n.orderBy("word").select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "spelling-words")


def _powers(base: int, n: int, prime: int | None) -> np.ndarray:
    """base^0 .. base^(n-1), modulo 2^64 or a prime, by doubling."""
    out = np.ones(max(1, n), dtype=np.uint64)
    filled = 1
    while filled < n:
        step = np.uint64(pow(base, filled, prime or 1 << 64))
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * step if prime is None else out[:more] * step % np.uint64(prime)
        filled += more
    return out


def deletion_keys(codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray, base: int = BASE, prime: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of whole words, and of each word without each of its places. codes: the words' code points one after another; word i has sizes[i]
    of them from begins[i]."""
    place = np.arange(len(codes)) - np.repeat(begins, sizes)
    power = _powers(base, int(sizes.max(initial=1)), prime)
    value = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)
    value ^= value >> np.uint64(29)
    back = np.uint64(pow(base, -1, prime or 1 << 64))
    if prime is None:
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(value * power[place], dtype=np.uint64)])  # wraps
        wholes = sums[begins + sizes] - sums[begins]
        at = np.arange(len(codes))
        before = sums[at] - np.repeat(sums[begins], sizes)
        behind = np.repeat(sums[begins + sizes], sizes) - sums[at + 1]
        return wholes, before + behind * back
    p = np.uint64(prime)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(value % p * power[place] % p, dtype=np.uint64)])
    wholes = (sums[begins + sizes] - sums[begins]) % p
    at = np.arange(len(codes))
    before = (sums[at] - np.repeat(sums[begins], sizes)) % p
    behind = (np.repeat(sums[begins + sizes], sizes) - sums[at + 1]) % p
    return wholes, (before + behind * back % p) % p


KEYED = "radix int, key long, place int, check long, wid long, n long, word string, doubled boolean"


def keyed_rows(words: DataFrame) -> DataFrame:
    """A row for each word (place -1) and for each of its places; `doubled` if the code point before is the same."""

    def rows(ids: np.ndarray, ns: np.ndarray, texts: list[str]) -> Iterator[pa.RecordBatch]:
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        wholes, keys = deletion_keys(codes, begins, sizes)
        owner = np.concatenate([np.arange(len(texts)), np.repeat(np.arange(len(texts)), sizes)])
        left = sizes[owner]  # code points of what a key stands for
        left[len(texts) :] -= 1
        check = np.zeros(len(owner), dtype=np.uint64)
        if (left > LONGEST).any():
            (one, ones), (two, twos) = (deletion_keys(codes, begins, sizes, base, prime) for prime, base in PRIMES)
            check = np.where(left > LONGEST, (np.concatenate([one, ones]) << np.uint64(31)) | np.concatenate([two, twos]), check)
        place = np.arange(len(codes)) - np.repeat(begins, sizes)
        doubled = np.zeros(len(codes), dtype=bool)
        doubled[1:] = codes[1:] == codes[:-1]
        doubled[begins] = False
        key = np.concatenate([wholes, keys])
        place, doubled = np.concatenate([np.full(len(texts), -1), place]), np.concatenate([np.zeros(len(texts), dtype=bool), doubled])
        shown = pa.array([t if len(t) <= LONGEST + 1 else None for t in texts], type=pa.string())
        told_by = np.where(left <= LONGEST, owner, -1)
        radix = (key >> np.uint64(64 - RADIX_BITS)).astype(np.int32)
        for at in range(0, len(key), ROWS):
            s = slice(at, at + ROWS)
            columns = [pa.array(radix[s]), pa.array(key[s].view(np.int64)), pa.array(place[s].astype(np.int32)), pa.array(check[s].view(np.int64)), pa.array(ids[owner[s]]), pa.array(ns[owner[s]]), shown.take(pa.array(told_by[s], mask=told_by[s] < 0)), pa.array(doubled[s])]
            yield pa.RecordBatch.from_arrays(columns, names=["radix", "key", "place", "check", "wid", "n", "word", "doubled"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("word").to_pylist()
            ids, ns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("wid", "n"))
            ends = np.cumsum([len(t) for t in texts])
            at = 0
            while at < len(texts):  # words of so many code points together, one at least
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROWS, side="right")))
                yield from rows(ids[at:stop], ns[at:stop], texts[at:stop])
                at = stop

    return words.select("wid", "n", "word").mapInArrow(lean(run), KEYED)


def _without(word: str, place: int) -> str:
    return word if place < 0 else word[:place] + word[place + 1 :]


def _tops(n: np.ndarray, wid: np.ndarray, groups: np.ndarray, count: int) -> np.ndarray:
    """For each of `count` groups, the row of the largest n, and of these of the smallest wid."""
    order = np.lexsort((wid, -n, groups))
    first = np.ones(len(order), dtype=bool)
    first[1:] = groups[order][1:] != groups[order][:-1]
    out = np.zeros(count, dtype=np.int64)
    out[groups[order][first]] = order[first]
    return out


def _near(part: dict[str, np.ndarray]) -> list[np.ndarray]:
    """wid, near words, n and wid of the most frequent of them (0 and -1 if the word itself is more frequent), of rows sorted by key and place; whole keys."""
    key, place, check, wid, n, word, doubled = (part[c] for c in ("key", "place", "check", "wid", "n", "word", "doubled"))
    turn = np.ones(len(key), dtype=bool)
    turn[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    group = np.cumsum(turn) - 1
    begins, many = np.flatnonzero(turn), np.bincount(group)
    shared = np.flatnonzero(many > 1)
    strings = np.zeros(len(key), dtype=np.int64)  # within a group of one key: which string
    for g in shared.tolist():
        x, y = int(begins[g]), int(begins[g] + many[g])
        known: dict = {}
        for i in range(x, y):
            strings[i] = known.setdefault(None if word[i] is None else _without(word[i], int(place[i])), len(known))
    base = wid[place < 0]
    told = [[base, np.zeros(len(base), dtype=np.int64), np.zeros(len(base), dtype=np.int64), np.full(len(base), -1)]]
    rows = np.flatnonzero(many[group] > 1)
    if not len(rows):
        return told[0]
    same = np.unique(group[rows] * (strings.max() + 1) + strings[rows], return_inverse=True)[1].reshape(-1)

    def all_near(at: np.ndarray, groups: np.ndarray) -> None:
        """Rows of a group are near to one another."""
        groups = np.unique(groups, return_inverse=True)[1].reshape(-1)
        size = np.bincount(groups)
        top = _tops(n[at], wid[at], groups, len(size))[groups]
        mine = top == np.arange(len(at))
        hold = size[groups] > 1
        told.append([wid[at][hold], size[groups][hold] - 1, np.where(mine, 0, n[at][top])[hold], np.where(mine, -1, wid[at][top])[hold]])

    inner = place[rows] >= 0
    at = rows[inner]
    all_near(at, same[inner] * (int(place.max()) + 1) + place[at])
    # words that are another one when they lack a place; a whole word stands once in its group
    whole_of = np.full(int(same.max()) + 1, -1)
    whole_of[same[~inner]] = rows[~inner]
    longer = inner & ~doubled[rows] & (whole_of[same] >= 0)
    at, groups = rows[longer], same[longer]
    if len(at):
        shorter = whole_of[groups]
        told.append([wid[at], np.ones(len(at), dtype=np.int64), n[shorter], wid[shorter]])
        dense, groups = np.unique(groups, return_inverse=True)
        groups = groups.reshape(-1)
        top = at[_tops(n[at], wid[at], groups, len(dense))]
        told.append([wid[whole_of[dense]], np.bincount(groups), n[top], wid[top]])
    return [np.concatenate(c) for c in zip(*told, strict=True)]


def near_words(words: DataFrame) -> DataFrame:
    """wid, n_near, top_n, top_wid: of words(wid, word, n), how many others are one edit away, and the most frequent of them (null: none, or none that is
    more frequent than the word)."""
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def made(table: pa.Table) -> pa.RecordBatch:
            part = {c: table.column(c).to_numpy() for c in table.schema.names}
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in _near(part)], names=["wid", "near", "n", "top"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            others = np.flatnonzero(key != key[-1])
            last = int(others[-1]) + 1 if len(others) else 0
            if last:  # the last key may go on in the next batch
                yield made(pa.Table.from_batches([*rest, batch.slice(0, last)]))
                rest = [batch.slice(last)]
            elif rest and rest[0].column("key")[0].as_py() != int(key[0]):
                yield made(pa.Table.from_batches(rest))
                rest = [batch]
            else:
                rest.append(batch)
        if rest:
            yield made(pa.Table.from_batches(rest))

    told = keyed_rows(words).repartition(n, "radix").sortWithinPartitions("key", "check", "place").mapInArrow(lean(run), "wid long, near long, n long, top long")
    best = F.min(F.when(F.col("top") >= 0, F.struct((-F.col("n")).alias("n"), "top")))
    return told.groupBy("wid").agg(F.sum("near").alias("n_near"), best.alias("best")).select("wid", "n_near", (-F.col("best.n")).alias("top_n"), F.col("best.top").alias("top_wid"))


def rooted(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(wid, root): the last word that following forms(wid, form) from each word comes to. Forms don't lead in circles."""
    spark = forms.sparkSession
    path = scratch(spark, "spelling-roots")
    now = stored(forms.select("wid", F.col("form").alias("root")), path)
    for _ in range(max_rounds):
        on = now.select(F.col("wid").alias("at"), F.col("root").alias("next"))
        moved = now.join(on, now["root"] == on["at"], "left").select("wid", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        old, path = path, scratch(spark, "spelling-roots")
        now = stored(moved, path)
        discard(spark, old)
        if now.where("moved").isEmpty():
            return now.select("wid", "root")
    raise RuntimeError("forms lead in a circle")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", damaged: int = DAMAGED, least_chars: int = LEAST_CHARS, least: int = LEAST_COUNT, times: int = FORM_TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root for every frequent word of docs."""
    if times <= 1:
        raise ValueError("a form is more frequent than its word")
    words = counted(words_of(docs, doc_id, text, damaged), least_chars, least)
    near = near_words(words)
    held = words.join(near, "wid")
    form = F.col("top_n") >= times * F.col("n")
    held = cut(held.select("wid", "word", "n", "n_near", F.when(form, F.col("top_wid")).alias("form_wid"), F.when(form, F.col("top_n")).alias("form_n")), "spelling-near")
    roots = rooted(held.where("form_wid is not null").select("wid", F.col("form_wid").alias("form")))
    named = lambda c: words.select(F.col("wid").alias(f"{c}_wid"), F.col("word").alias(c))
    linked = held.where("form_wid is not null").join(roots.withColumnRenamed("root", "root_wid"), "wid").join(named("form"), "form_wid").join(named("root"), "root_wid")
    alone = held.where("form_wid is null").withColumn("form", F.lit(None).cast("string")).withColumn("root", F.col("word"))
    columns = ("word", "form", "root", "n", "n_near", "form_n")
    return linked.select(*columns).unionByName(alone.select(*columns))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP11_SQL = rf"""
WITH RECURSIVE bits AS (SELECT [list_reduce([cast(b AS BIGINT), 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR b IN range(256)] AS t),
runs AS (SELECT coalesce(cast(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '{RUN}')), '{UPPER}', '{LOWER}') AS run FROM documents),
each AS (SELECT id, run, count(*) AS times, hex(encode(id || ':' || run)) AS x FROM runs GROUP BY ALL),
hashed AS (SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, [cast('0x' || x[2 * i - 1 : 2 * i] AS BIGINT) FOR i IN range(1, length(x) // 2 + 1)]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM each, bits),
given AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, times FROM hashed),
words AS MATERIALIZED (SELECT word, cast(sum(times) AS BIGINT) AS n FROM given WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
less AS MATERIALIZED (SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n FROM less a JOIN less b USING (rest, i) WHERE a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS form, max(n) AS form_n FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {FORM_TIMES} * n THEN form END AS form, CASE WHEN form_n >= {FORM_TIMES} * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS last, form AS next FROM forms UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN forms f ON f.word = w.next)
SELECT word, form, last AS root, n, n_near, form_n FROM forms JOIN (SELECT word, last FROM walk WHERE next IS NULL) USING (word)
"""
