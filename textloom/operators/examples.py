"""Examples from texts, for the objectives that column expressions cover: one example a text, bounded by a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import tokens
from textloom.functions.hashrand import uniform
from textloom.operators.config import Objective


def _parts(entry: Objective, text: Column, room: int) -> tuple[Column, Column, Column, Column]:
    """Input text behind the prompt, label text, rest, and status, of one objective."""
    options, p = entry.options, len(entry.prompt)
    n = F.length(text)
    if entry.name in ("next_token_prediction", "copying"):
        used, rest = tokens.split_at(text, F.lit((room - p) // 2))
        too_long = F.lit(entry.name == "copying") & (p + 2 * F.length(used) > room)
        return used, used, rest, F.when(too_long, "error").otherwise("ok")
    if entry.name == "prefix_language_modeling":
        used, rest = tokens.split_at(text, F.lit(room - p))
        m = F.length(used)
        k = F.greatest(F.lit(1), F.least(F.floor(m * F.lit(float(options["prefix_fraction"]))), m - 1)).cast("int")
        few = (F.lit(room - p) < 2) | (m < 2)
        return F.substring(used, F.lit(1), k), F.substring(used, k + 1, F.greatest(m - k, F.lit(0))), rest, F.when(few, "fail").otherwise("ok")
    if entry.name == "deshuffling":
        used, rest = tokens.split_at(text, F.lit(int((room // 2) * 0.90 - p)))
        mixed = _deshuffled(used, float(options["percentage_to_shuffle"]), options["rng_seed"])
        too_long = p + 2 * F.length(used) > room
        return mixed, used, rest, F.when(too_long, "error").otherwise("ok")
    raise ValueError(f"{entry.name} is not a plain expression; see textloom.operators.spans")


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once a row, also if the body uses it for every element of an array."""
    return F.get(F.transform(F.array(value), body), 0)


def _deshuffled(text: Column, share: float, seed: object) -> Column:
    """Permutes a share of the characters among their places; places and order follow from hashes of the text and the place."""
    ordered = lambda places, salt, key: F.transform(F.array_sort(F.transform(places, lambda i: F.struct(F.md5(F.concat(F.lit(salt), key, F.lit(":"), i.cast("string")).cast("binary")).alias("h"), i.alias("i")))), lambda s: s["i"])

    def mix(chars: Column, key: Column) -> Column:
        every = F.sequence(F.lit(1), F.size(chars))
        k = F.floor(F.size(chars) * F.lit(share)).cast("int")

        def move(chosen: Column) -> Column:
            # the j-th chosen place takes the character of the j-th in another order; the others keep theirs
            moved = F.arrays_zip(F.array_sort(chosen).alias("i"), ordered(chosen, "b", key).alias("of"))
            kept = F.transform(F.array_except(every, chosen), lambda i: F.struct(i.alias("i"), i.alias("of")))
            return F.array_join(F.transform(F.array_sort(F.concat(F.transform(moved, lambda m: F.struct(m["i"].alias("i"), m["of"].alias("of"))), kept)), lambda m: F.get(chars, m["of"] - 1)), "")

        return _let(F.slice(ordered(every, "a", key), F.lit(1), k), move)

    mixed = _let(F.md5(F.concat(F.lit(f"{seed}:"), text).cast("binary")), lambda key: _let(F.split(text, ""), lambda chars: mix(chars, key)))
    return F.when(F.length(text) > 0, mixed).otherwise(text)


def build(df: DataFrame, entry: Objective, text: str = "text") -> DataFrame:
    """df with status, input_text, label_text, unused_text and prompt for one objective. A failed check leaves the texts null."""
    options = entry.options
    room = int(options["remaining_space"])
    given = F.col(text)
    state = tokens.check(given, room, int(options["minimum_remaining_space"]), int(options["minimum_sequence_length"]), int(options["maximum_sequence_length"]))
    inputs, labels, rest, status = _parts(entry, given, room)
    fine = state == "ok"
    return df.withColumns({"objective": F.lit(entry.name), "prompt": F.lit(entry.prompt), "status": F.when(fine, status).otherwise(state), "input_text": F.when(fine, inputs), "label_text": F.when(fine, labels), "unused_text": F.when(fine, rest)})


def with_ids(examples: DataFrame) -> DataFrame:
    """Examples with input_ids (prompt first) and label_ids."""
    return examples.withColumns({"input_ids": tokens.encode(F.concat("prompt", "input_text")), "label_ids": tokens.encode(F.col("label_text"))})


def chunks(df: DataFrame, entry: Objective, text: str = "text") -> DataFrame:
    """All examples of each text: what one example leaves over is the next one's text. One row per chunk of equal size."""
    size = capacity(entry)
    if size < 1:
        raise ValueError("the budget leaves no room for text")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size).cast("int") - 1, F.lit(0)))
    return df.where(F.length(text) > 0).withColumn("chunk_idx", F.explode(starts)).withColumn("chunk", F.substring(F.col(text), F.col("chunk_idx") * size + 1, F.lit(size)))


def capacity(entry: Objective) -> int:
    """The characters of text that one example of a plain objective takes at most."""
    room, p = int(entry.options["remaining_space"]), len(entry.prompt)
    if entry.name in ("next_token_prediction", "copying"):
        return (room - p) // 2
    return int((room // 2) * 0.90 - p) if entry.name == "deshuffling" else room - p


def used_up(df: DataFrame, entries: list[Objective], *keys: str, text: str = "text", seed: int = 0) -> DataFrame:
    """Every text in pieces that each entry can take whole, so that nothing of it is left over: df with chunk_idx, the piece in the place
    of the text, and obj_idx drawn for each piece by the keys and chunk_idx. A piece that is too short for the prefix objective, which
    needs two characters, goes to the first other entry."""
    size = min(map(capacity, entries))
    if size < 1:
        raise ValueError("the budget leaves no room for text")
    starts = F.sequence(F.lit(0), F.ceil(F.length(text) / size).cast("int") - 1)
    cut = df.where(F.length(text) > 0).withColumn("chunk_idx", F.explode(starts)).withColumn(text, F.substring(F.col(text), F.col("chunk_idx") * size + 1, F.lit(size)))
    drawn = choose(cut, entries, *keys, "chunk_idx", seed=seed)
    pairs = [i for i, e in enumerate(entries) if e.name == "prefix_language_modeling"]
    others = [i for i in range(len(entries)) if i not in pairs]
    if not pairs or not others:
        return drawn
    return drawn.withColumn("obj_idx", F.when((F.length(text) < 2) & F.col("obj_idx").isin(pairs), others[0]).otherwise(F.col("obj_idx")))


def choose(df: DataFrame, entries: list[Objective], *keys: str, seed: int = 0) -> DataFrame:
    """df with obj_idx: the entry that a weighted draw gives each row, a function of the seed and the keys."""
    u, total, pick = uniform(seed, *(F.col(k) for k in keys)), 0.0, F.lit(len(entries) - 1)
    bounds = []
    for e in entries[:-1]:
        total += e.prob
        bounds.append(total)
    for i in range(len(bounds) - 1, -1, -1):
        pick = F.when(u < F.lit(bounds[i]), i).otherwise(pick)
    return df.withColumn("obj_idx", pick.cast("int"))


def mixed(df: DataFrame, entries: list[Objective], text: str = "text") -> DataFrame:
    """Examples of the objective that obj_idx names, by one pass over df: each column is a case over the entries."""
    built = {}
    for name in ("objective", "prompt", "status", "input_text", "label_text", "unused_text"):
        case = None
        for i, e in enumerate(entries):
            column = {"objective": F.lit(e.name), "prompt": F.lit(e.prompt)}.get(name)
            if column is None:
                inputs, labels, rest, status = _parts(e, F.col(text), int(e.options["remaining_space"]))
                column = {"status": status, "input_text": inputs, "label_text": labels, "unused_text": rest}[name]
            case = F.when(F.col("obj_idx") == i, column) if case is None else case.when(F.col("obj_idx") == i, column)
        built[name] = case
    return df.withColumns(built)
