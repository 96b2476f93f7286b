"""Operators of the training-data pipeline against brute force, exact round trips and held-out accuracy, with odd rows."""

import base64
import gzip
import hashlib
import io
import itertools
import re
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import _common, ann, byte_bpe, chat_format, language_id, lm_scoring, packing, quality, simhash_dedup, token_counts, warc
from textloom.llm._public_bpe import public_bpe

SF_DIR = "/root/testdata/sf0.001"
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Null, empty and blank texts, white space of many kinds, controls, repeated rows, and long ones.
ODD = [None, "", " ", "\n\n", "a", "a  b\t\n c ", "x" * 3000, "ab" * 900, "  　é\x1c\x85'll 12 !!", "né漢字😀 " * 40, "one two three\n" * 60, "dup row", "dup row", "### user: </turn> \\ \\\\### <|endoftext|>"]


def docs(spark, texts=ODD, start=0):
    """Texts as documents with clashing extra columns, a repeated id and a null id."""
    rows = [(start + i, t, "en", "x", 1) for i, t in enumerate(texts)] + [(start + 1, "twice", "en", "y", 2), (None, "no id here", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp string, block long")


def stored(spark, tmp_path, frame):
    frame.write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in"))


# ---- tokens ---------------------------------------------------------------------------------------------------------
def test_byte_bpe_is_exact(spark):
    coder = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    frame = docs(spark)
    got = byte_bpe.decode(byte_bpe.encode(frame, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert len(got) == frame.count()
    for r in got:
        assert r["ids"] == coder.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    with pytest.raises(ValueError):
        byte_bpe.encode(frame, RANKS, P.PATTERN, into="fp")
    assert byte_bpe.encode(frame.limit(0), RANKS, P.PATTERN).count() == 0


def test_byte_bpe_random_texts():
    rng = np.random.default_rng(3)
    letters = list("ab 'st\t\n  é漢😀\x1c\x85!?.09ЖTHE")
    coder = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    texts = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(3000)]
    encoder = byte_bpe.Encoder(byte_bpe.Merges(RANKS, P.PATTERN), most=500)
    for at in range(0, 3000, 300):
        for t, raw in zip(texts[at : at + 300], encoder.encode(texts[at : at + 300]), strict=True):
            assert np.frombuffer(raw, dtype=np.uint32).tolist() == coder.encode_ordinary(t)


def test_public_bpe_equals_tokenizers():
    plain, as_text = Tokenizer.from_file(JSON), Tokenizer.from_file(JSON)
    as_text.encode_special_tokens = True
    mine = public_bpe(JSON, P.PATTERN)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    for t in [*ODD, "a <|endoftext|> b<|endoftext|><|endoftext|>  c <|endoftext", *texts]:
        assert mine.ids(t, added=True) == plain.encode(t or "", add_special_tokens=False).ids
        assert mine.ids(t) == as_text.encode(t or "", add_special_tokens=False).ids
    mine.ids("x" * 100_000)
    assert max(map(len, mine.memo)) <= 64


# ---- 1 --------------------------------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### x </turn>\\"), ("assistant", None), ("a:b###", "</turn>" * 3)])] + [(2, None, None, "tie"), (2, None, None, "tie"), (4, 0, "user", "b"), (4, 0, "user", "a"), (4, 0, "user", "###"), (4, 0, "a", "\\"), (4, 0, "user", "A"), (None, 0, "assistant", "lost"), (3, 0, "assistant", "z" * 5000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("input_ids", F.lit(1))
    formatted = chat_format.format_conversations(turns, JSON, P.PATTERN)
    said = {r["conv_id"]: r for r in chat_format.parse_conversations(formatted, JSON, P.PATTERN).collect()}
    assert said[1]["roles"] == ["user", "assistant", "assistant", "a:b###"]
    assert said[1]["texts"] == [rows[0][3], rows[1][3], "", rows[3][3]]
    assert said[1]["loss_text"] == rows[1][3]
    assert said[2]["texts"] == ["tie", "tie"] and said[None]["loss_text"] == "lost" and said[3]["loss_text"] == "z" * 5000
    assert said[4]["texts"] == ["\\", "###", "A", "a", "b"]
    named = turns.where("conv_id = 1").withColumn("conv_id", F.lit("one"))
    assert chat_format.parse_conversations(chat_format.format_conversations(named, JSON, P.PATTERN), JSON, P.PATTERN).first()["conv_id"] == "one"
    body = said[1]["formatted"]
    assert body.count("\n") >= 4 and re.sub(r"\\(\\|###|</turn>|:)", "", body).count("</turn>") == 4
    assert formatted.where("size(input_ids) <> size(loss_mask)").count() == 0
    assert chat_format.format_conversations(turns.limit(0), JSON, P.PATTERN).count() == 0


# ---- 2 --------------------------------------------------------------------------------------------------------------
def brute_ppm(texts, learn, order):
    """Method C with exclusion, one symbol at a time."""
    stream = lambda t: b" ".join([*(t or "").encode().lower().split(), b"\n"])
    table = {}
    for t, is_learned in zip(texts, learn, strict=True):
        s = b"\n" * order + stream(t)
        for i in range(order, len(s)) if is_learned else ():
            for k in range(order + 1):
                table.setdefault(s[i - k : i], Counter())[s[i]] += 1
    out = []
    for t in texts:
        s, total = b"\n" * order + stream(t), 0.0
        for i in range(order, len(s)):
            gone = set()
            for k in range(order, -1, -1):
                seen = {x: c for x, c in table.get(s[i - k : i], {}).items() if x not in gone}
                if not seen:
                    continue
                n, d = sum(seen.values()), len(seen)
                if s[i] in seen:
                    total += np.log10(seen[s[i]] / (n + d))
                    break
                total += np.log10(d / (n + d))
                gone |= set(seen)
            else:
                total -= np.log10(256 - len(gone))
        out.append(total)
    return out


def test_lm_scoring_equals_brute_force(spark, tmp_path):
    frame = docs(spark, [*ODD[:6], *ODD[8:], "The cat sat on the mat", "the cat ran", "A dog sat on THE log"])
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    frame = stored(spark, tmp_path, frame.withColumn("to_learn", ~held))
    for table, block_bytes in ((frame, lm_scoring.BLOCK_BYTES), (frame, 1000), (frame.repartition(3, "text"), lm_scoring.BLOCK_BYTES)):  # of files, in many blocks, and not of files
        got = lm_scoring.score(table, "to_learn", block_bytes).collect()
        rows = frame.collect()
        assert len(got) == len(rows)
        words = [[*(r["text"] or "").encode().lower().split(), b"\n"] for r in rows]
        counts = Counter(w for ws, r in zip(words, rows, strict=True) if r["to_learn"] for w in ws)
        n, v = sum(counts.values()), len(counts)
        want = sorted((round(s, 6), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for s, ws in zip(brute_ppm([r["text"] for r in rows], [r["to_learn"] for r in rows], lm_scoring.ORDER), words, strict=True))
        assert np.allclose(sorted((round(r["score"], 6), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), want, atol=1e-5)
    assert lm_scoring.score(frame.limit(0), "to_learn").count() == 0
    assert {round(r["score"], 3) for r in lm_scoring.score(frame.where("doc_id = 1 and text = ''").withColumn("to_learn", F.lit(False)), "to_learn").collect()} == {round(-np.log10(256), 3)}


def test_lm_long_texts_go_in_parts(monkeypatch):
    texts = ["The Cat  sat\non the mat " * 40, None, "x" * 500, " ".join(f"w{i}" for i in range(300)) + "   ", "a"]
    whole = list(lm_scoring._parts(texts))
    monkeypatch.setattr(lm_scoring, "CHARS", 50)
    groups = list(lm_scoring._grouped(texts))
    assert len(whole) == len(texts) and len(groups) > 20 and max(sum(len(s) for *_, s in g) for g in groups) < 700
    pieces = [(key[:n], key[n:], rows[:n], rows[n:]) for key, rows, n in map(lm_scoring._keys, groups)]
    key, rows, n = lm_scoring._keys(whole)
    for got, want in zip(map(np.concatenate, zip(*pieces, strict=True)), (key[:n], key[n:], rows[:n], rows[n:]), strict=True):
        assert (got == want).all()
    words = [w for t in texts for w in [*(t or "").encode().lower().split(), b"\n"]]
    assert len(key) - n == len(words) and len(set(key[n:].tolist())) == len(set(words)) == len(set(zip(words, key[n:].tolist(), strict=True))) and (key[n:] < 0).all()


# ---- 3 --------------------------------------------------------------------------------------------------------------
def brute_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints):
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_simhash_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocabulary, 120)) for _ in range(20)]
    texts = [*ODD, *(" ".join(w if rng.random() > 0.01 else "new" for w in t.split()) for t in base for _ in range(4)), *base]
    frame = docs(spark, texts)
    got = simhash_dedup.near_duplicates(frame).collect()
    rows = frame.collect()
    prints = [brute_print(r["text"]) for r in rows]
    roots = brute_components(prints)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        if r["doc_id"] is not None:
            least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(((r["doc_id"], p, least.get(root)) for r, p, root in zip(rows, prints, roots, strict=True)), key=key)
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=key) == want
    kept = simhash_dedup.keep_one_similar(frame)
    words = [(r["text"] or "").lower().split() for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                p, q = group[i], group[j]
                group = [min(p, q) if g in (p, q) else g for g in group]
    assert kept.columns == frame.columns and kept.count() == len(set(group))
    assert simhash_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_links_are_complete_and_never_all_pairs(spark):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 1 << 63))
    dense = {centre ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in (0, 1, 2, 3) for _ in range(400)}
    chain = [7]
    for _ in range(40):
        chain.append(chain[-1] ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False)))
    prints = sorted(dense | set(chain) | {int(x) for x in rng.integers(0, 1 << 63, 300)})
    frame = spark.createDataFrame([(0, p - (1 << 64) if p >= 1 << 63 else p) for p in prints], "seed int, fp long")
    for cell in (2048, 64):
        links = simhash_dedup.links(frame, cell=cell)
        assert all(((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 4 for r in links.collect())
        assert links.count() < 60 * len(prints)
        found = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash_dedup.components(links).collect()}
        roots = brute_components(prints)
        groups = Counter(roots)
        mine = Counter(found.get(p, p) for p in prints)
        assert sorted(groups.values()) == sorted(mine.values())


def test_scratch_is_cleared(spark):
    simhash_dedup.components(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")).count()
    at = Path(_common.shared_dir(spark).removeprefix("file:")) / "textloom" / spark.sparkContext.applicationId
    other = at.parent / "another-application"
    other.mkdir(parents=True)
    assert len(list(at.glob("edges-*"))) >= 1
    _common.clear_scratch(spark)
    assert not at.exists() and other.exists()  # tables of other applications stay


# ---- 4 --------------------------------------------------------------------------------------------------------------
def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://e.com/{i}", t) for i, t in enumerate([None, "", "a\r\n\r\nb", "same", "same", "é" * 50000])] + [(3, "u", "same"), (4, "http://e.com/4", "same"), (None, None, "same"), (None, "two", "only null"), (9, 'q"uo\\te\r\nX: y', "z"), (11, "", "e"), (12, "urn:none", "f"), (13, "http://é.de/ a", "g"), (14, None, "h")] + [(None, f"n{i}", "nobody") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(0))
    index = warc.archive(pages, str(tmp_path / "w"))
    got = warc.read_records(index).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[1]["record_type"] == "response" and (by[0]["record_type"], by[0]["refers_to"]) == ("revisit", 1)
    assert bytes(by[5]["payload"]).decode() == "é" * 50000 and by[5]["payload_bytes"] == 100000
    assert sorted(r["record_type"] for r in got if r["page_id"] == 4) == ["response", "revisit"]
    assert {r["refers_to"] for r in got if r["record_type"] == "revisit" and r["page_id"] in (3, 4, None) and (r["url"] or "u")[0] != "n"} == {4}
    assert by[9]["url"] == 'q"uo\\te\r\nX: y' and {r["url"] for r in got if r["page_id"] in (11, 12, 13, 14)} == {"", "urn:none", "http://é.de/ a", None}
    for r in got:
        assert r["record_type"] == "revisit" or r["payload_digest"] == base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest()).decode()
    alone = [r for r in got if r["url"] and r["url"][0] == "n"]
    assert sorted(r["record_type"] for r in alone) == ["response"] + ["revisit"] * 8 and {r["refers_to"] for r in alone} == {None}
    assert warc.read_records(warc.archive(pages.limit(0), str(tmp_path / "none"))).count() == 0


def test_warc_inflates_in_bounded_parts():
    record = warc.record(1, 0, "u", b"a" * 300_000, 300_000, "D", None, False)
    many = gzip.compress(record * 400) + gzip.compress(record)  # 120 MB in 0.2 MB, and a second member
    tracemalloc.start()
    assert sum(r == record for r in warc.records_of(io.BytesIO(many), 4096)) == 401
    assert tracemalloc.get_traced_memory()[1] < 8_000_000
    tracemalloc.stop()
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(many[:-9])))


# ---- 5 --------------------------------------------------------------------------------------------------------------
def test_packing_keeps_every_id_once(spark):
    long_text = "word " * 9000
    frame = docs(spark, [*ODD, long_text, long_text, *(f"text number {i} " * i for i in range(60))])
    cut_pieces = packing.cut(packing.pieces(frame, JSON, P.PATTERN, with_ids=True), "pieces-test")
    packed = packing.pack(cut_pieces, buckets=3)
    rows = packed.collect()
    other = Tokenizer.from_file(JSON)
    want = Counter((r["doc_id"], tuple(other.encode(r["text"] or "", add_special_tokens=False).ids + [0])) for r in frame.collect())
    assert sum(r["length"] for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    single = {k: v for k, v in want.items() if k[0] not in (1, None)}
    for doc, ids in single:
        mine = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        assert [i for r in mine for i in r["ids"]] == list(ids)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and r["doc_tokens"] == len(ids) for r in mine)
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 1024
    made = packing.sequences(packed).collect()
    assert len(made) == len(at) and all(len(r["input_ids"]) in (1024, r["used"]) and (len(r["input_ids"]) == 1024 or r["used"] & (r["used"] - 1) == 0) for r in made)
    named = spark.createDataFrame([("a", "one text"), (None, "two")], "doc_id string, text string")
    assert {r["doc_id"] for r in packing.pack(packing.cut(packing.pieces(named, JSON, P.PATTERN), "named")).collect()} == {"a", None}
    assert packing.pack(packing.cut(packing.pieces(frame.limit(0), JSON, P.PATTERN), "none")).count() == 0


def test_plan_wastes_little():
    rng = np.random.default_rng(0)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(rng.integers(1, 1024, 50_000), return_counts=True), strict=True)}
    patterns = packing.plan(histogram)
    used = sum(sum(p) * n for p, n in patterns)
    assert used == sum(n * c for n, c in histogram.items()) and len(patterns) < 4096
    assert used / (1024 * sum(n for _, n in patterns)) > 0.97


# ---- 6 --------------------------------------------------------------------------------------------------------------
def test_quality_rules(spark):
    menu = "Home | About | Contact | Shop | Help"
    good = "This is a sentence with quite a few different words in it, that go on and on until it ends here somewhere."
    texts = [*ODD, good, f"{menu}\n" * 3 + "a few words here", f"{good}\nAll rights reserved.", "we " * 400, good.upper(), "# $ % " * 40]
    frame = docs(spark, texts)
    got = frame.select("doc_id", "text", quality.measures().alias("m")).select("doc_id", "text", "m.*").collect()
    for r in got:
        t = r["text"] or ""
        words = WORD.findall(t)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        count = Counter(windows)
        repeated = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(repeated) > 30 * len(words))
    kept = {r["text"] for r in got if r["kept"]}
    assert good in kept and f"{good}\nAll rights reserved." in kept and not {texts[15], texts[17], texts[18], texts[19]} & kept
    assert {r["text"] for r in quality.keep_good(frame).collect()} == kept and quality.keep_good(frame).columns == frame.columns
    assert frame.where("doc_id = 16").select(quality.clean_text().alias("t")).first()["t"] == good
    assert quality.keep_good(frame.limit(0)).count() == 0
    assert quality.keep_good(frame.withColumn("measured", F.lit(7)), cleaned=True).where("measured = 7").count() == len([t for t in got if t["kept"]])


# ---- 8 --------------------------------------------------------------------------------------------------------------
def test_token_counts_equal_a_full_count(spark):
    coder = public_bpe(JSON, P.PATTERN)
    rng = np.random.default_rng(4)
    letters = list("ab  \n\t　é.'srlev1中")
    for _ in range(400):
        text = "".join(rng.choice(letters, rng.integers(0, 80)))
        pieces = coder.pre.findall(text)
        tree = token_counts.CountTree([len(p) for p in pieces], [coder.counts[p] for p in pieces])
        for _ in range(6):
            inserted = "".join(rng.choice(letters, rng.integers(0, 200 if rng.random() < 0.1 else 8)))
            text, again = token_counts.edit(coder, text, tree, int(rng.integers(0, len(text) + 2)), int(rng.integers(0, 12)), inserted)
            assert (tree.chars, tree.tokens) == (len(text), len(coder.ids(text)))
    frame = docs(spark)
    edits = spark.createDataFrame([(5, 1, 2, 1, "zz"), (5, 0, 0, 0, "front "), (6, 0, 9999, 5, " end"), (0, 0, None, None, None)], "doc_id long, seq int, start int, removed int, inserted string")
    index = token_counts.build_index(frame, JSON, P.PATTERN)
    got = token_counts.recount(token_counts.attach_edits(index, edits), JSON, P.PATTERN).collect()
    assert len(got) == frame.count() and all(r["n_tokens"] == len(coder.ids(r["text"])) == sum(r["leaf_tokens"]) for r in got)
    assert {r["text"] for r in got if r["doc_id"] == 5} == {"frzznt a  b\t\n c "} and {r["text"] for r in got if r["doc_id"] == 6} == {"x" * 3000 + " end"}


@pytest.mark.parametrize("text", ["人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，" * 340, "a1,b2;c3," * 2000, "word, " * 900_000])
def test_an_edit_encodes_little_again(text):
    coder = public_bpe(JSON, P.PATTERN)
    pieces = coder.pre.findall(text)
    tree = token_counts.CountTree([len(p) for p in pieces], [coder.counts[p] for p in pieces])
    rng = np.random.default_rng(5)
    for _ in range(30):
        text, again = token_counts.edit(coder, text, tree, int(rng.integers(0, len(text))), int(rng.integers(0, 3)), "好,x"[: int(rng.integers(0, 4))])
        assert again < 100
    assert (tree.chars, tree.tokens) == (len(text), len(coder.ids(text)))


def test_token_count_query(spark):
    coder = public_bpe(JSON, P.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in token_counts.op8_token_counts(spark, SF_DIR).collect():
        assert r["tokens_before"] == len(coder.ids(texts[r["doc_id"]])) and r["n_edits"] == 3 and r["encoded_again"] < 600


# ---- 9 --------------------------------------------------------------------------------------------------------------
def test_language_id_held_out(spark):
    got = {r["doc_id"]: r for r in language_id.op9_language_id(spark, "/root/testdata/sf0.01").collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [d for d, r in got.items() if r["held_out"]]
    assert len(got) == len(truth) and np.mean([got[d]["lang_pred"] == truth[d] for d in held]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for d, r in got.items())


def test_language_spans_and_odd_rows(spark):
    model = language_id.train([("en", "the cat and the dog were in the house with that thing " * 20), ("de", "der hund und die katze waren nicht mit dem haus und ich " * 20)])
    mixed = "the dog and the house with that cat der hund und die katze nicht mit dem haus"
    rows = {(r["doc_id"], r["text"]): r for r in language_id.predict(docs(spark, [*ODD, mixed]), model, spans="runs").collect()}
    runs = rows[(len(ODD), mixed)]["runs"]
    assert [(r["lang"], r["words"]) for r in runs] == [("en", 8), ("de", 9)]
    assert rows[(0, None)]["lang_pred"] == rows[(1, "")]["lang_pred"] == rows[(3, "\n\n")]["lang_pred"] == "und" and rows[(0, None)]["score"] == 0
    frame = docs(spark)
    assert language_id.fit(frame.limit(0), F.lit(True)) is None
    assert {r["lang_pred"] for r in language_id.predict(frame, None).collect()} == {"und"}
    with pytest.raises(ValueError):
        language_id.predict(frame, model, into=("fp", "score"))


def test_field_equals_enumeration():
    """Probabilities, messages over parts and the gradient against sums over all label sequences."""
    rng = np.random.default_rng(9)
    m, lengths = 3, np.array([4, 1, 3])
    ids, gold = rng.integers(0, 5, 8), rng.integers(0, m, 8)
    index, belongs = rng.integers(0, 7, 12), np.sort(rng.integers(0, 5, 12))
    weights, trans, start = rng.normal(size=(7, m)), rng.normal(size=(m, m)), rng.normal(size=m)
    field = language_id.Field(index, belongs, ids, gold, lengths, 5, m)

    def log_likelihood(weights, trans, start, chance=None):
        total, at = 0.0, 0
        for n in lengths:
            emit = np.array([[sum(weights[f, j] for f, w in zip(index, belongs, strict=True) if w == ids[t]) for j in range(m)] for t in range(at, at + n)])
            value = lambda ys: start[ys[0]] + sum(emit[t, y] for t, y in enumerate(ys)) + sum(trans[a, b] for a, b in itertools.pairwise(ys))  # noqa: E731, B023
            every = {ys: np.exp(value(ys)) for ys in itertools.product(range(m), repeat=int(n))}
            z = sum(every.values())
            total += value(tuple(gold[at : at + n])) - np.log(z)
            for ys, v in every.items() if chance is not None else ():
                chance[np.arange(at, at + n), list(ys)] += v / z
            at += n
        return total

    want = np.zeros((8, m))
    log_likelihood(weights, trans, start, want)
    emit = language_id._emissions(weights, index, belongs, 5)[ids]
    assert np.allclose(language_id.forward_backward(emit, lengths, trans, start)[0], want)
    assert np.allclose(language_id.marginals(emit, lengths, trans, start), want)
    one, before = emit[:4], None
    ahead = []
    for part in (one[:2], one[2:3], one[3:]):
        ahead.append(language_id.forward(part, trans, start, before))
        before = ahead[-1][-1]
    after, back = None, []
    for part in (one[3:], one[2:3], one[:2]):
        got, after = language_id.backward(part, trans, after)
        back.insert(0, got)
    chance = np.concatenate(ahead) * np.concatenate(back)
    assert np.allclose(chance / chance.sum(axis=1, keepdims=True), want[:4])
    for k, slope in enumerate(field.gradient(weights, trans, start)):
        for place in np.ndindex(slope.shape):
            up, down = ([x.copy() for x in (weights, trans, start)] for _ in range(2))
            up[k][place] += 1e-5
            down[k][place] -= 1e-5
            assert abs((log_likelihood(*up) - log_likelihood(*down)) / 2e-5 - slope[place]) < 1e-6


def test_language_of_long_texts_in_parts(monkeypatch):
    model = language_id.train([("en", "the cat and the dog were in the house with that thing " * 20), ("de", "der hund und die katze waren nicht mit dem haus und ich " * 20)])
    text = ("the dog and the house " * 30 + "12 .. 34 " * 50 + "der hund und die katze " * 40) * 2
    monkeypatch.setattr(language_id, "PART", 333)
    n, total, seen, best = language_id._judge_long(text, language_id._Scorer(model, True), model)
    words = language_id.words_of(text)
    every = language_id._Scorer(model, True).of(words)
    chance = language_id.forward_backward(every[:, :-2], np.array([len(words)]), model.transitions, model.start)[0]
    assert n == len(words) and np.allclose(total, chance.sum(axis=0)) and np.allclose(seen, every[:, -2:].sum(axis=0)) and (np.concatenate(best) == chance.argmax(axis=1)).all()


def test_every_language_is_learned(spark):
    rows = [(i, f"{a}{b} " * 3 + f"w{a}{b} x{a}", a + b) for i, (a, b) in enumerate(itertools.product("abcdefgh", "stuvw"))] + [(100 + i, "copy of one text", "zz") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language_id.fit(docs, F.lit(True), sample=5).labels) == 41


# ---- 10 -------------------------------------------------------------------------------------------------------------
def test_ann_recall(spark):
    got = {}
    for r in ann.op10_ann(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, data = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    hits = []
    for q, found in got.items():
        scores = (data * data[ids == q][0]).sum(axis=1)
        scores[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(scores[ids == v][0] - s) < 1e-12 for _, v, s in found)
        hits.append(len(set(best) & {v for _, v, _ in found}) / 20)
    assert set(got) == set(ids[ids % 20 == 0]) and np.mean(hits) >= 0.9


@pytest.mark.parametrize("scale", [1.0, 1e25, 1e-25, 1e150])
def test_ann_filters_and_finds(scale):
    rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet", columns=["vec_id", "embedding"])
    ids, data = rows["vec_id"].to_numpy(), np.array(rows["embedding"].to_pylist(), dtype=np.float64) * scale
    queries = np.flatnonzero(ids % 20 == 0)
    radius = float(np.sqrt(((data / scale) ** 2).sum(axis=1).max())) * scale
    got, checked = ann._search(ids, data, ids[queries], data[queries], radius, 20)
    hits = []
    for q, (found, scores) in zip(queries, got, strict=True):
        truth = (data * data[q]).sum(axis=1)
        assert len(found) == 20 and (scores == truth[np.searchsorted(ids, found)]).all()
        truth[q] = -np.inf
        hits.append(len(set(ids[np.lexsort((ids, -truth))[:20]]) & set(found)) / 20)
    assert np.mean(hits) >= 0.95 and checked < 0.75 * len(data) * len(queries)


def test_ann_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (1, [1.0, None]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, []), (5, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [0.5, 3.0]), (7, [0.25, 0.0]), (None, [1.0, 1.0]), (60, [0.0, 2.0]), (8, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(frame, F.col("vec_id") % 20 == 0, k=4).collect()]
    assert sorted(got) == [(0, 1, 5, 1.0), (0, 2, 6, 1.0), (0, 3, 7, 0.5), (0, 4, 7, 0.25), (60, 1, 7, 6.0), (60, 2, 0, 0.0), (60, 3, 5, 0.0), (60, 4, 6, 0.0)]
    assert ann.search(frame.limit(0), F.lit(True)).count() == 0


def test_few_verified_vectors_need_exact_products():
    """The k best of a block are those of all exact products, ties included, though most verified vectors are ruled out by their estimates."""

    class Counted(np.ndarray):
        rows = 0

        def __getitem__(self, i):
            if self.ndim == 2 and isinstance(i, np.ndarray):
                Counted.rows += len(i)
            return super().__getitem__(i)

    data = np.random.default_rng(3).standard_normal((2000, 32))
    data[1000:1100] = data[:100]
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    for scale in (1.0, 1e-40, 1e40):
        Counted.rows = 0
        ids, asks = np.arange(2000), np.arange(0, 2000, 50)
        got, checked = ann._search(ids, (data * scale).view(Counted), asks, data[asks] * scale, scale * 1.0000001, 20)
        assert Counted.rows < checked / 2
        hits = 0
        for (found, scores), own in zip(got, asks, strict=True):
            exact = ((data * scale) * (data[own] * scale)).sum(axis=1)
            assert [float(s) for s in scores] == [float(exact[i]) for i in found]
            order = np.lexsort((ids, -exact))
            hits += len(set(found.tolist()) & set(order[order != own][:20].tolist()))
        assert hits >= 0.9 * 20 * len(asks)
