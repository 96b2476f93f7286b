"""Operator 13 and the linking that the pipeline shares, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import odd_sketch

LIKE = odd_sketch.Likeness()


def set_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))) if w else frozenset()


def plain(rows):
    """component by place, of (doc_id, text) rows."""
    sets = [set_of(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                p, q = sorted((group[i], group[j]))
                group = [p if g == q else g for g in group]
    least = {}
    for (doc_id, _), g in zip(rows, group, strict=True):
        least[g] = min((x for x in (least.get(g), doc_id) if x is not None), default=None)
    return sorted(((d, len(s), least[g], d == least[g]) for (d, _), s, g in zip(rows, sets, group, strict=True)), key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, size int, node string")
    return sorted((tuple(r) for r in odd_sketch.near_duplicates(docs).collect()), key=str)


def random_words(rng, n, vocabulary=3000):
    return [f"w{i}" for i in rng.integers(0, vocabulary, n)]


def changed(rng, words, share):
    return [w if rng.random() > share else f"new{rng.integers(1 << 30)}" for w in words]


def test_near_copies_of_any_kind(spark):
    rng = np.random.default_rng(1)
    base = [random_words(rng, int(n)) for n in rng.integers(2, 300, 25)]
    texts = [changed(rng, w, share) for w in base for share in (0, 0.03, 0.05, 0.06, 0.1, 0.2)] + [w[: len(w) * 81 // 100] for w in base] + [w + random_words(rng, len(w) // 5) for w in base]
    rows = [(i * 7 % 1009, " ".join(w)) for i, w in enumerate(texts)]
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE "), (5005, "Élan vital"), (5006, "élan vital"), (5007, "a b c"), (None, "one"), (None, "no id"), (5008, "twice"), (5008, "twice"), (5008, "other words"), (4, "only words")]
    assert run(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_a_chain_and_a_large_group(spark):
    rng = np.random.default_rng(2)
    words = random_words(rng, 120)
    chain = [" ".join(words[i * 6 :] + [f"x{j}" for j in range(i * 6)]) for i in range(15)]
    base = random_words(rng, 200)
    copies = [" ".join(changed(rng, base, 0.01)) for _ in range(400)]
    rows = [(900 - i, t) for i, t in enumerate(chain + copies)]
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("words,held", [(150, 115), (2500, 1900)])
def test_texts_of_one_template_are_hardly_asked(spark, words, held):
    """Texts that share a template but are no near copies: few of the pairs that they could make are confirmed."""
    rng = np.random.default_rng(3)
    n = 300
    template = random_words(rng, held, 10**6)
    docs = spark.createDataFrame([(i, " ".join(template + random_words(rng, words - held, 10**6)) + f" {i}") for i in range(n)], "id long, text string").withColumn("hash", F.xxhash64("id", "text"))
    marked = odd_sketch.cut(odd_sketch.with_sets(docs, LIKE), "sets")
    nodes = odd_sketch.named_nodes(marked)
    shared = odd_sketch.buckets(nodes)
    none = spark.createDataFrame([], "node long, root long")
    assert shared.count() > n
    assert odd_sketch.lead_pairs(nodes, shared, LIKE).count() == 0 and odd_sketch.cell_pairs(nodes, shared, none, LIKE, False).count() == 0


def test_cells_and_forests(spark):
    rng = np.random.default_rng(4)
    base = [random_words(rng, 60) for _ in range(3)]
    docs = spark.createDataFrame([(i, " ".join(changed(rng, base[i % 3], 0.02))) for i in range(90)], "id long, text string").withColumn("hash", F.xxhash64("id", "text"))
    marked = odd_sketch.cut(odd_sketch.with_sets(docs, LIKE), "sets")
    nodes = odd_sketch.named_nodes(marked)
    shared = odd_sketch.buckets(nodes)
    roots = spark.createDataFrame([(r["node"], 10**15) for r in nodes.where("node % 4 = 0").collect()], "node long, root long")
    held = {r["node"]: (np.frombuffer(bytes(r["odd"]), dtype=np.uint64), r["size"], 10**15 if r["node"] % 4 == 0 else r["node"]) for r in nodes.collect()}
    pairs = {(a, b) for k in (r["nodes"] for r in shared.groupBy("key").agg(F.collect_list("node").alias("nodes")).collect()) for a in k for b in k if a < b}
    want = {(a, b) for a, b in pairs if held[a][2] != held[b][2] and odd_sketch.may_link(held[a][0], held[b][0], np.array(held[a][1]), np.array(held[b][1]))}
    for cell in (6, 32_768):
        assert {tuple(r) for r in odd_sketch.cell_pairs(nodes, shared, roots, LIKE, False, cell).collect()} == want
        forest = {tuple(r) for r in odd_sketch.cell_pairs(nodes, shared, roots, LIKE, True, cell).collect()}
        assert forest <= want and len(forest) < len(want)


def test_sketches_never_lose_a_similar_pair():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 4000))
        both = rng.integers(0, 1 << 62, int(n * 0.8) + 1).astype(np.uint64)
        extra = rng.integers(0, 1 << 62, max(0, n // 5 - 1)).astype(np.uint64)
        k = int(rng.integers(0, len(extra) + 1))
        one, two = np.unique(np.concatenate([both, extra[:k]])), np.unique(np.concatenate([both, extra[k:]]))
        a, b = (np.frombuffer(odd_sketch.odd_sketch(x), dtype=np.uint64) for x in (one, two))
        assert odd_sketch.may_link(a, b, np.array(len(one)), np.array(len(two)))


def test_bands_meet_as_often_as_the_similarity_says():
    rng = np.random.default_rng(6)
    met = 0
    for _ in range(200):
        every = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        keys = odd_sketch.band_keys([np.unique(every[:270]), np.unique(every[30:])])
        met += (keys[0] == keys[1]).sum()
    assert abs(met / (200 * odd_sketch.BANDS) - 0.8**odd_sketch.BAND_ROWS) < 0.02


def test_a_very_long_text(spark):
    rng = np.random.default_rng(7)
    words = random_words(rng, 400_000, 10**6)
    rows = [(1, " ".join(words)), (2, " ".join(words[:390_000])), (3, " ".join(words[:300_000])), (4, "x" * 5_000_000)]
    assert [(r[0], r[2]) for r in run(spark, rows)] == [(1, 1), (2, 1), (3, 3), (4, 4)]
