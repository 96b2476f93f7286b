"""The pipeline's stages do their whole job: near copies of any edit pattern, foreign and random texts."""

import time

import numpy as np

import corpus_pipeline
from textloom.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def test_near_duplicates_of_any_edit_pattern(spark):
    rng = np.random.default_rng(5)
    some = lambda n: [f"w{i}" for i in rng.integers(0, 3000, n)]
    base = [some(int(n)) for n in rng.integers(100, 400, 40)]
    cut = [w[: -(len(w) * 15 // 100)] for w in base]
    longer = [w + some(len(w) * 15 // 100) for w in base]
    spliced = [w[: len(w) // 2] + some(len(w) * 15 // 100) + w[len(w) // 2 :] for w in base]
    far = [w[: len(w) * 60 // 100] for w in base]
    texts = [" ".join(w) for part in (base, cut, longer, spliced, far) for w in part] + ["", None, "one two", "One  two"]
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                p, q = sorted((group[i], group[j]))
                group = [p if g == q else g for g in group]
    docs = frame_of(spark, texts)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == set(group)
    assert len({*range(40)} & set(group)) == 40 and len(set(group)) < 90


def test_unrelated_long_texts_over_few_words_stay(spark):
    rng = np.random.default_rng(8)
    long = [" ".join(f"w{i}" for i in rng.integers(0, 3000, n)) for n in (20_000, 20_000, 10_000, 10_000, 5_000)]
    copy = long[0].replace("w17 ", "w18 ")
    docs = frame_of(spark, [*long, copy, "", None, " \n"])
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {0, 1, 2, 3, 4, 6}


FOREIGN = {
    "pl": "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem " * 3,
    "fi": "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto " * 3,
    "ru": "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью " * 3,
}


def test_language_stage_rejects_foreign_and_random_letters(spark):
    rng = np.random.default_rng(6)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = [r["text"] for r in docs.where("text is not null").orderBy("doc_id").limit(60).collect()]
    mixed = [" ".join(a.split()[:50] + b.split()[:50]) for a, b in zip(clean[:20], clean[20:40], strict=True)]
    junk = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(120)) for _ in range(5)]
    more = [(10**9 + i, t, None, "s", len(t)) for i, t in enumerate([*FOREIGN.values(), *junk, *mixed])]
    both = docs.unionByName(spark.createDataFrame(more, SCHEMA).select(docs.columns))
    for known in (both, both.where("lang is null or lang in ('en', 'fr')")):  # the number of labels doesn't matter
        ids = {r["doc_id"] for r in corpus_pipeline.language(spark, known, "").collect()}
        assert not {10**9 + i for i in range(8)} & ids
    ids = {r["doc_id"] for r in corpus_pipeline.language(spark, both, "").collect()}
    assert {10**9 + i for i in range(8, 28)} <= ids and len(ids) >= 0.99 * docs.count()


HINDI = "सभी मनुष्य जन्म से स्वतंत्र तथा मर्यादा और अधिकारों में समान होते हैं वे तर्क और विवेक से संपन्न हैं तथा उन्हें भ्रातृत्व की भावना से परस्पर के प्रति कार्य करना चाहिए।"
PROSE = "This is a sentence with quite a few different words in it, that go on and on until it ends here somewhere."


CHINESE = "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。"
ARABIC = "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء ولكل إنسان حق التمتع بكافة الحقوق والحريات"


def kept(spark, texts):
    return {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, frame_of(spark, texts), "").collect()}


def test_quality_rules_know_scripts_without_case_and_punctuation(spark):
    words = " ".join(f"word{i}a" for i in range(30))
    measured = frame_of(spark, [HINDI, CHINESE, ARABIC]).select("doc_id", quality.measures().alias("m")).select("doc_id", "m.*").orderBy("doc_id").collect()
    assert [r["lost_share"] for r in measured] == [0, 0, 0] and measured[2]["kept"] and measured[0]["kept"]
    texts = [HINDI, PROSE, PROSE.upper(), words, " ".join(f"w{i} ?!?!?!" for i in range(30)), f"{words}.", CHINESE, ARABIC, "Et. In. Un."]
    assert kept(spark, texts) == {0, 1, 3, 5, 6, 7, 8}
    prose = "\n".join([PROSE] * 3)
    assert kept(spark, [f"{prose}\n{words}\n{words}\n{words}", words.replace("word", "Verse ")]) == {1}  # marks are missed only where the text has them


def test_quality_rules_are_relative_to_the_line(spark):
    long = " ".join(f"word{i}a" for i in range(200))
    quotes = ["« un mot »", "»Wort«", "«palabra»", "col·lecció paral·lel il·lusió", "» Wort «"]
    fine = [f"{long} {q} and then, {q} {q} and so on." for q in quotes] + [f"{long} read more in these few words."]
    menu = "\n".join(f"Home {s} About us {s} Contact {s} Shop number {i} {s} Help" for i, s in enumerate("|»›·•|"))
    assert kept(spark, [*fine, menu, "\n".join(f"Click here to read more number {i}." for i in range(9))]) == set(range(6))


def test_quality_stage_removes_failed_lines(spark):
    text = f"{PROSE}\nHome | About | Shop | Help\nAnother one follows, with other things to say.\nAll rights reserved."
    more = ["Tous droits réservés. 2020", "Datenschutzerklärung und Impressum", "https://e.com/a www.e.com/b", "Leer  más aquí"]
    got = corpus_pipeline.quality_rules(spark, frame_of(spark, ["\n".join([text, *more])]), "").first()
    assert got["text"] == f"{PROSE}\nAnother one follows, with other things to say." and got["n_chars"] == len(got["text"])


def test_quality_rules_know_tables_and_forms(spark):
    table = "| Name | Size | Price |\n|------|:-----|-------|\n" + "\n".join(f"| thing {i} | {i} cm | {i} Euro |" for i in range(9))
    claims = "\n".join(f"Copyright {2000 + i} Example GmbH number {i}" for i in range(12))
    pages = "\n".join(f"Seite {i} von 20" for i in range(1, 13))
    law = "The copyright act of 1976 changed a great many things for authors, and so did the treaties that followed it over the years."
    assert kept(spark, [table, claims, pages, law, f"{PROSE}\n© 2020 Example", "| Home | About | Shop | Help |"]) == {0, 3, 4}


def test_quality_rules_are_linear_in_a_line(spark):
    for unit in ("+", "=", "😀", "| ", "a ", "[ ] "):
        text = unit * (1_000_000 // len(unit))
        began = time.time()
        kept(spark, [text])
        assert time.time() - began < 20
    assert kept(spark, ["+" * 30_000, "😀" * 500]) == set()
