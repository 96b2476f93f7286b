"""Operator 11 against a plain version: forms, roots, long words, chance collisions, odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import spelling


def lowered(s):
    return s.translate(str.maketrans(spelling.UPPER, spelling.LOWER))


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, damaged=spelling.DAMAGED):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % damaged == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            if len(w) >= 5:
                counts[w] += 1
    n = {w: c for w, c in counts.items() if c >= 3}
    form, many = {}, {}
    for w in n:
        others = sorted((o for o in n if near(w, o)), key=lambda o: (-n[o], o))
        many[w] = len(others)
        form[w] = others[0] if others and n[others[0]] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], many[w], n.get(form[w])) for w in n}


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = spelling.variants(docs, **options).collect()
    assert len({r["word"] for r in got}) == len(got)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}


def test_variants(spark):
    long = "abcdefghijklmnopqrstuvwxyz" * 3
    texts = ["spelling " * 40 + "speling " * 12 + "spleling " * 4 + "spellings " * 8 + "SPELLING Spelling", "aaaaa " * 30 + "aaaaaa " * 9 + "aaaaaaa " * 4 + "aaaab " * 4 + "baaaa " * 4, "élève éleve ÉLÈVE " * 9 + "élèves " * 3, "tie1x tiger tiger tiger tiger tiger tiger tigex tigex tigex tigey tigey tigey timer timer timer timer timer timer", None, "", "1234 --- 中文", "one two"]
    texts += [" ".join([long[:k]] * (3 * j) + [long[: k - 1]] * 3 + ["x" + long[1:k]] * 3 + [long[: k // 2] + long[k // 2 + 1 : k]] * 4) for j, k in ((4, 63), (5, 64), (6, 65), (7, 66), (8, 78))]
    rows = [(i, t) for i, t in enumerate(texts)] * 2 + [(None, "nothing named nothing named nothing named")]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, damaged=2) == plain(rows, 2)


def test_forms_follow_to_the_last(spark):
    words = ["abcdefgh"[:i] + "zyxwvuts"[i:] for i in range(8)]
    rows = [(1, " ".join(w for i, w in enumerate(words) for _ in range(3 * 2**i)))]
    got = run(spark, rows, damaged=1 << 40)
    assert got == plain(rows, 1 << 40) and {v[1] for v in got.values()} == {words[-1]}


def test_nothing(spark):
    assert run(spark, []) == {} and run(spark, [(1, "rare words")]) == {}


def test_a_very_long_run(spark):
    rows = [(1, " ".join(["q" * 200_000] * 3)), (2, " ".join(["q" * 199_999] * 7)), (3, "w" * 1_000_000)]
    got = run(spark, rows, damaged=1 << 40)
    assert {len(w): (len(v[0] or ""), v[2], v[3]) for w, v in got.items()} == {200_000: (199_999, 3, 1), 199_999: (0, 7, 1)}


def test_equal_keys_of_different_strings():
    """Keys that agree by chance: all rows in one group."""
    words = ["spelt", "spell", "spill", "pell", "other", "others"]
    rows = [(0, -1, 0, i, 10 - i, w, False) for i, w in enumerate(words)] + [(0, p, 0, i, 10 - i, w, p > 0 and w[p] == w[p - 1]) for i, w in enumerate(words) for p in range(len(w))]
    rows.sort(key=lambda r: r[1])
    columns = [np.array(c, dtype=object if isinstance(c[0], str) else None) for c in zip(*rows, strict=True)]
    told = spelling._near(dict(zip(("key", "place", "check", "wid", "n", "word", "doubled"), columns, strict=True)))
    sums = Counter()
    for wid, count in zip(told[0].tolist(), told[1].tolist(), strict=True):
        sums[wid] += count
    assert {words[i]: c for i, c in sums.items()} == {w: sum(near(w, o) for o in words) for w in words}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abÿ", min_size=1, max_size=80), min_size=1, max_size=6))
def test_keys_are_hashes_of_what_is_left(words):
    def keys(ws, **how):
        codes = np.frombuffer("".join(ws).encode("utf-32-le"), dtype=np.uint32)
        sizes = np.array([len(w) for w in ws])
        return spelling.deletion_keys(codes, np.cumsum(sizes) - sizes, sizes, **how)

    for how in ({}, {"base": spelling.PRIMES[0][1], "prime": spelling.PRIMES[0][0]}):
        _, without = keys(words, **how)
        left = [w[:i] + w[i + 1 :] for w in words for i in range(len(w))]
        want, _ = keys([x for x in left if x], **how) if any(left) else (np.zeros(0, dtype=np.uint64), None)
        assert [k for k, x in zip(without.tolist(), left, strict=True) if x] == want.tolist()
