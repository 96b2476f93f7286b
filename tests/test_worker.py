"""The coupled fold: leftovers, strict failures, and streams."""

import time

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from textloom.functions import tokens
from textloom.operators import config, packing, spans
from textloom.streaming import worker

PLAIN = tuple(config.normalised([config.objective("next_token_prediction", 0.7, paradigm="A"), config.objective("copying", 0.3, paradigm="B")]))


def texts(spark, values):
    return spark.createDataFrame([(0, i, i, t) for i, t in enumerate(values)], "shard int, doc_id long, ord long, text string")


def test_leftovers_are_used_up(spark):
    got = worker.fold(texts(spark, ["x" * 1000, "y" * 300]), worker.Run(PLAIN, 128, 16)).collect()
    for doc, n in ((0, 1000), (1, 300)):
        assert sum(r["n_label"] for r in got if r["doc_id"] == doc) == n
    assert max(r["start_off"] + r["n_input"] + r["n_label"] for r in got) <= 128


@pytest.mark.parametrize("text", ["", "  \n", None])
def test_blank_texts_fail_strict_runs(spark, text):
    with pytest.raises(Exception, match="empty_text"):
        worker.fold(texts(spark, ["fine text", text]), worker.Run(PLAIN, 64, 8)).collect()
    kept = worker.fold(texts(spark, ["fine text", text]), worker.Run(PLAIN, 64, 8, strict=False)).collect()
    assert [r["status"] for r in kept] == ["ok", "empty_text"]


def test_one_failing_objective_fails_the_run(spark):
    entries = tuple(config.normalised([config.objective("next_token_prediction", 0.1), config.objective("selective_copying", 0.9, min_delimiter_prefix_length=64, min_delimiter_suffix_length=64)]))
    with pytest.raises(Exception, match="fail"):
        worker.fold(texts(spark, ["abcdefgh"] * 20), worker.Run(entries, 96, 12)).collect()


def test_unknown_objective_and_bad_run():
    with pytest.raises(ValueError, match="unknown objective"):
        config.objective("nothing")
    with pytest.raises(ValueError):
        worker.Run(PLAIN, 64, 64)


def test_mixture_is_near_the_commanded_rates(spark):
    got = worker.fold(texts(spark, ["abcdefghijklmnopqrstuvwxyz " * k for k in (1, 2, 4, 10, 40)] * 12), worker.Run(PLAIN, 128, 16)).groupBy("objective").count().collect()
    total = sum(r["count"] for r in got)
    rate = {r["objective"]: r["count"] / total for r in got}
    assert abs(rate["next_token_prediction"] - 0.7) < 0.12


def rows_of(frame):
    return sorted(tuple(r) for r in frame.where("status = 'ok'").select("shard", "doc_id", "ex_seq", "objective", "pack_id", "segment", "start_off", "n_input", "n_label", "input_ids").collect())


def in_order_written(spark, frame, folder, cuts):
    """The texts as files of a stream, one a micro-batch, rows within a file in reverse order."""
    n = frame.count()
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, n], strict=True)):
        frame.where((F.col("doc_id") >= a) & (F.col("doc_id") < b)).orderBy(F.desc("doc_id")).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1 if k < len(cuts) else 0)  # files are read by age, in seconds
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("cuts", [[11], [5, 17]])
def test_stream_equals_fold_however_it_is_cut(spark, tmp_path, cuts):
    frame = texts(spark, [f"{i} " * (i + 5) for i in range(30)])
    run = worker.Run(PLAIN, 128, 16)
    coming = in_order_written(spark, frame, str(tmp_path / "in"), cuts)
    name = f"placed{len(cuts)}"
    query = worker.stream(coming, run).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows_of(spark.table(name)) == rows_of(worker.fold(frame, run))


def test_mixtures_change_between_micro_batches(spark, tmp_path):
    frame = texts(spark, [f"{i} " * 40 for i in range(40)])
    run, folder = worker.Run(PLAIN, 128, 16), str(tmp_path / "out")
    with pytest.raises(Exception):
        worker.mixture_at(spark, folder, 0)
    worker.publish_mixture(spark, folder, list(PLAIN), 1, 0)
    coming = in_order_written(spark, frame, str(tmp_path / "in"), [20])
    worker.publish_mixture(spark, folder, [config.objective("copying", 0.9, paradigm="B"), config.objective("next_token_prediction", 0.1, paradigm="A")], 2, 1)
    query = worker.stream_with_mixtures(coming, run, folder).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = spark.read.option("basePath", f"{folder}/placed").parquet(f"{folder}/placed")
    ok = got.where("status = 'ok'")
    share = {r["mixture"]: r["share"] for r in ok.groupBy("mixture").agg(F.avg((F.col("objective") == "copying").cast("double")).alias("share")).collect()}
    assert abs(share[1] - 0.3) < 0.12 and abs(share[2] - 0.9) < 0.12
    assert {(r["batch"], r["mixture"]) for r in got.select("batch", "mixture").distinct().collect()} == {(0, 1), (1, 2)}
    assert ok.select("ex_seq").distinct().count() == ok.count()  # the second goes on where the first stopped
    assert {r["doc_id"] for r in ok.collect()} == set(range(40)) and ok.groupBy("pack_id").agg(F.sum(F.col("n_input") + F.col("n_label")).alias("n")).where("n > 128").count() == 0


TOK = tokens.BytePairs(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_any_tokenizer(spark):
    text = "The quick brown fox jumps over the lazy dog. 你好 " * 60
    for entry in config.normalised(config.uniform_mixture()):
        got = spans.one_example(text, entry, "k", tok=TOK)
        assert got["status"] == "ok" and len(got["input_ids"]) + len(got["label_ids"]) <= 1024
        assert TOK.decode(got["input_ids"]).startswith(entry.prompt) and got["unused_text"] == TOK.decode(TOK.encode(text)[got["original_length"] :])
    made = worker.fold(texts(spark, [text, "short"]), worker.Run(PLAIN, 256, 16, tok=TOK)).collect()
    assert sum(r["n_label"] for r in made if r["doc_id"] == 0) == len(TOK.encode(text))
    assert "".join(TOK.decode(r["label_ids"]) for r in sorted(made, key=lambda r: r["ex_seq"]) if r["doc_id"] == 0) == text


def test_objectives_of_the_user(spark):
    config.register("reversing", lambda ids, options, prompt, tok, rng: ([*prompt, *ids[: options["most"]]], ids[: options["most"]][::-1], options["most"]) if ids else None, paradigm="<", most=5)
    entries = tuple(config.normalised([config.objective("reversing", 1.0, most=7), config.objective("reversing", 1.0)]))
    got = worker.fold(texts(spark, ["abcdefghijkl" * 3]), worker.Run(entries, 64, 4)).orderBy("ex_seq").collect()
    assert {r["n_label"] for r in got} >= {5, 7} and sum(r["n_label"] for r in got) == 36
    assert tokens.Characters().decode(got[0]["label_ids"]) == "abcdefghijkl"[: got[0]["n_label"]][::-1]
    with pytest.raises(ValueError):
        config.register("infilling", print)
    assert entries[0].nickname != entries[1].nickname


def test_batches_of_rows(spark):
    rows = spark.range(10).select(F.lit(0).alias("shard"), F.col("id").alias("pack_id"), *(F.array(F.col("id").cast("int"), F.lit(1)).alias(c) for c in ("input_ids", "label_ids", "segment_ids", "attention_mask")))
    found = list(worker.batches_of(packing.batches(rows, 4)))
    assert [len(b["input_ids"]) for b in found] == [4, 4, 2] and found[1]["input_ids"][0].tolist() == [4, 1]
    assert len(list(worker.batches_of(packing.batches(rows, 4), 2))) == 2


def test_walks_keep_their_promises():
    text = "The quick brown fox jumps over the lazy dog. 你好 नमस्ते " * 30
    for name in ("infilling", "autoencoding", "autoencoding_with_deshuffling", "deshuffling", "selective_copying"):
        for exact in (False, True):
            for seed in range(4):
                got = spans.one_example(text, config.objective(name, rng_seed=seed), "k", exact)
                assert got["status"] == "ok"
                assert got == spans.one_example(text, config.objective(name, rng_seed=seed), "k", exact)
                assert len(got["input_ids"]) + len(got["label_ids"]) <= 1024
                if name == "autoencoding":
                    assert got["label_ids"] == tokens.Characters().encode(text[: got["original_length"]])
                if name == "deshuffling":
                    assert sorted(got["label_ids"]) == sorted(got["input_ids"][len("<|DESHUFFLE|>") :])
    assert spans.one_example("short", config.objective("selective_copying"), "k")["status"] == "fail"
    assert spans.one_example("", config.objective("infilling"), "k")["status"] == "fail"


def test_presets():
    assert [len(m()) for m in (config.uniform_mixture, config.denoiser_mixture, config.character_denoiser_mixture, config.decoder_mixture, config.light_mixture, config.small_mixture)] == [8, 7, 7, 4, 15, 2]
    assert abs(sum(e.prob for e in config.normalised(config.light_mixture())) - 1) < 1e-9
    assert config.objective("infilling", paradigm_token="[R]").dropped == ["paradigm_token"]


def test_exact_selective_copying_draws_the_rate_first():
    """One round of the walk, drawn by hand: length, rate, chance, and the two lengths around the passage."""
    rng, text = np.random.default_rng(5), "abcdefghij" * 30
    options = config.objective("selective_copying", rng_seed=5, shuffle=False).options
    at, passages = 8, []
    while at <= len(text) - 8 - 2 and len(passages) < 3:
        span = max(2, min(int(np.clip(rng.poisson(8), 2, 24)), len(text) - 8 - at))
        rate = rng.uniform(0.25, 0.95)
        if rng.uniform() >= rate:
            at += int(rng.integers(1, 3))
            continue
        rng.integers(8, max(8, min(at, 64)) + 1)
        rng.integers(8, max(8, min(len(text) - at - span, 64)) + 1)
        passages.append(text[at : at + span])
        at += span
        break
    got = spans.one_example(text, config.objective("selective_copying", rng_seed=5, shuffle=False), "k", exact=True)
    answers = tokens.Characters().decode(got["label_ids"])
    assert options["tokens_per_mask"] == 8
    if got["attempts"] == 1:
        behind = answers.removeprefix("[res 0]\n")
        assert behind.startswith(passages[0])


def test_fold_is_linear_in_a_text():
    entries = tuple(config.normalised([config.objective("next_token_prediction", 3), config.objective("infilling", 2), config.objective("autoencoding", 1)]))
    text = "abcdefgh " * 50_000
    began = time.time()
    rows = list(worker.ShardFold(worker.Run(entries, 1024, strict=False), 0).feed(1, text))
    assert time.time() - began < 10
    assert rows[-1][-2] == 0 and {r[-1] for r in rows} == {"ok"}


def test_characters_that_a_walk_cuts_are_kept():
    """With byte-level tokens, what one example leaves of a character goes on to the next."""
    text = "中文字符𝄞 और 😀" * 200
    run = worker.Run(tuple(config.normalised([config.objective("autoencoding", tokens_per_mask=2)])), 256, 16, strict=False, tok=TOK)
    rows = list(worker.ShardFold(run, 0).feed(1, text))
    labels = [i for r in rows for i in r[10]]
    assert {r[-1] for r in rows} == {"ok"} and TOK.decode(labels) == text


def test_failed_examples_keep_their_own_number():
    """A failure has the number that its objective was drawn by; the next example has the next."""
    run = worker.Run((config.objective("prefix_language_modeling"),), 1024, strict=False)
    at = worker.ShardFold(run, 0)
    rows = [r for doc, text in enumerate(["ab", "c", "de"]) for r in at.feed(doc, text)]
    assert [(r[1], r[2], r[-1]) for r in rows] == [(0, 0, "ok"), (1, 1, "fail"), (2, 2, "ok")]
