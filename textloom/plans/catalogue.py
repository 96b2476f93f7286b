"""Registered queries over the standard tables, each over its whole table, with the SQL that checks it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import casts, tokens
from textloom.functions.hashrand import pareto, uniform
from textloom.operators import config, examples, feedback, packing, predictor, spans, statistics, validation
from textloom.sources import connector
from textloom.sources import text as sources
from textloom.sources.shared import shared_folder
from textloom.streaming import losses as loss_stream
from textloom.streaming import figures, open_rows, worker

ROOM, BATCH = 1024, 8
#: Shards of the packing queries: one for so many documents, and so many at least; a shard is packed by one task.
SHARD_DOCS, LEAST_SHARDS = 4096, 8
MIXTURE = config.normalised([config.objective("next_token_prediction", 2, paradigm="A"), config.objective("copying", 1, paradigm="B"), config.objective("prefix_language_modeling", 1, paradigm_str="C", prefix_fraction=0.5)])
MARKERS = {ord(c) + tokens.OFFSET: e.name for c, e in zip("ABC", MIXTURE, strict=True)}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def shards(spark: SparkSession, sf_dir: str) -> int:
    return max(LEAST_SHARDS, -(-table(spark, sf_dir, "documents", "doc_id").count() // SHARD_DOCS))


SHARDS_SQL = f"(SELECT greatest({LEAST_SHARDS}, cast(ceil(count(*) / {SHARD_DOCS}.0) AS BIGINT)) FROM documents)"
SHARD_SQL = f"cast('0x' || substr(md5(cast(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % {SHARDS_SQL} AS shard"


def digest(c):
    return F.md5(tokens.joined(c).cast("binary"))


def long(c):
    return F.col(c).cast("long").alias(c) if isinstance(c, str) else c.cast("long")


# ---- SQL pieces -----------------------------------------------------------------------------------------------------
def sql_ids(text: str) -> str:
    return f"list_transform(CASE WHEN length({text}) > 0 THEN string_split({text}, '') ELSE [] END, lambda c: unicode(c) + 3)"


def sql_md5(text: str) -> str:
    return f"md5(coalesce(array_to_string({sql_ids(text)}, ','), ''))"


def sql_uniform(key: str, part: int = 0) -> str:
    return f"(cast('0x' || substr(md5({key}), {1 + 8 * part}, 8) AS BIGINT) / 4294967296.0)"


def sql_example(prompt: str, room: int = ROOM) -> str:
    return f"""SELECT doc_id, 'ok' AS status, cast(least(length(text), {(room - len(prompt)) // 2}) + {len(prompt)} AS BIGINT) AS n_input, cast(least(length(text), {(room - len(prompt)) // 2}) AS BIGINT) AS n_label,
        {sql_md5(f"'{prompt}' || substr(text, 1, {(room - len(prompt)) // 2})")} AS input_md5, {sql_md5(f"substr(text, 1, {(room - len(prompt)) // 2})")} AS label_md5,
        cast(greatest(length(text) - {(room - len(prompt)) // 2}, 0) AS BIGINT) AS unused_chars FROM documents"""


#: All examples of each document by the mixture: pieces of 511 characters, the most that each of its objectives takes.
PIECE = min(map(examples.capacity, MIXTURE))
MIXED_SQL = f"""
    cut AS (SELECT doc_id, text AS whole, unnest(range(cast(ceil(length(text) / {PIECE}.0) AS BIGINT))) AS chunk_idx FROM documents WHERE length(text) > 0),
    drawn AS (SELECT doc_id, chunk_idx, substr(whole, chunk_idx * {PIECE} + 1, {PIECE}) AS text, {sql_uniform("'0:' || doc_id || ':' || chunk_idx")} AS u FROM cut),
    used AS (SELECT *, length(text) AS len, CASE WHEN u < 0.5 THEN 0 WHEN u < 0.75 THEN 1 WHEN length(text) < 2 THEN 0 ELSE 2 END AS obj_idx FROM drawn),
    halved AS (SELECT *, cast(greatest(1, least(floor(len * 0.5), len - 1)) AS BIGINT) AS k FROM used),
    ex AS (SELECT doc_id, chunk_idx, obj_idx, ['A', 'B', 'C'][obj_idx + 1] AS prompt, ['next_token_prediction', 'copying', 'prefix_language_modeling'][obj_idx + 1] AS objective,
        CASE WHEN obj_idx < 2 THEN text ELSE substr(text, 1, k) END AS input_text, CASE WHEN obj_idx < 2 THEN text ELSE substr(text, k + 1) END AS label_text, {SHARD_SQL} FROM halved),
    sized AS (SELECT *, length(input_text) + 1 AS n_input, length(label_text) AS n_label, row_number() OVER (PARTITION BY shard ORDER BY doc_id, chunk_idx) AS rn FROM ex)"""
PLACED_SQL = f"""WITH RECURSIVE {MIXED_SQL.strip()},
    items AS MATERIALIZED (SELECT shard, rn, n_input + n_label AS n FROM sized),
    fit AS (SELECT shard, rn, cast(0 AS BIGINT) AS pack_id, 1 AS segment, cast(0 AS BIGINT) AS start_off, n AS used FROM items WHERE rn = 1
        UNION ALL SELECT shard, rn, CASE WHEN new THEN pack_id + 1 ELSE pack_id END, CASE WHEN new THEN 1 ELSE segment + 1 END, CASE WHEN new THEN 0 ELSE used END, CASE WHEN new THEN 0 ELSE used END + n
        FROM (SELECT s.shard, s.rn, s.n, f.pack_id, f.segment, f.used, f.used + s.n > {ROOM} OR {ROOM} - f.used <= 64 AS new FROM fit f JOIN items s ON s.shard = f.shard AND s.rn = f.rn + 1)),
    placed AS (SELECT s.*, f.pack_id, f.segment, f.start_off FROM sized s JOIN fit f USING (shard, rn)),
    rows_of AS (SELECT shard, pack_id, cast(sum(n_input + n_label) AS BIGINT) AS used, count(*) AS n_segments, max(pack_id) OVER (PARTITION BY shard) AS last FROM placed GROUP BY shard, pack_id),
    closed AS (SELECT shard, pack_id, used, n_segments FROM rows_of WHERE pack_id < last OR {ROOM} - used <= 64),
    parts AS (SELECT shard, pack_id, segment, list_concat(list_concat({sql_ids("prompt || input_text")}, [2]), list_slice({sql_ids("label_text")}, 1, n_label - 1)) AS i,
        list_concat(list_transform(range(n_input), lambda x: -100), {sql_ids("label_text")}) AS l, list_transform(range(n_input + n_label), lambda x: segment) AS s,
        list_concat(list_transform(range(n_input), lambda x: 1), list_transform(range(n_label), lambda x: 3)) AS m FROM placed),
    dense AS (SELECT shard, pack_id, flatten(list(i ORDER BY segment)) AS i, flatten(list(l ORDER BY segment)) AS l, flatten(list(s ORDER BY segment)) AS s, flatten(list(m ORDER BY segment)) AS m FROM parts GROUP BY shard, pack_id)
"""


def pad_sql(column: str, filler: int) -> str:
    return f"list_concat({column}, list_transform(range({ROOM} - len({column})), lambda x: {filler}))"


# ---- examples -------------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, cast(length(text) AS BIGINT) AS n_tokens, cast(coalesce(list_sum({sql_ids('text')}), 0) AS BIGINT) AS id_sum, cast(list_max({sql_ids('text')}) AS BIGINT) AS id_max, {sql_md5('text')} AS ids_md5, true AS decodes FROM documents")
def char_tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = documents(spark, sf_dir).withColumn("ids", tokens.encode(F.col("text")))
    return ids.select("doc_id", long(F.size("ids")).alias("n_tokens"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"), long(F.array_max("ids")).alias("id_max"), digest(F.col("ids")).alias("ids_md5"), (tokens.decode(F.col("ids")) == F.col("text")).alias("decodes"))


def _shown(built: DataFrame) -> DataFrame:
    ids = examples.with_ids(built)
    return ids.select("doc_id", "status", long(F.size("input_ids")).alias("n_input"), long(F.size("label_ids")).alias("n_label"), digest(F.col("input_ids")).alias("input_md5"), digest(F.col("label_ids")).alias("label_md5"), long(F.length("unused_text")).alias("unused_chars"))


@query(sql_example("<|NTP|>"))
def ntp_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(examples.build(documents(spark, sf_dir), config.objective("next_token_prediction")))


@query(sql_example("<|COPY|>"))
def copying_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(examples.build(documents(spark, sf_dir), config.objective("copying")))


@query(
    f"""WITH u AS (SELECT doc_id, substr(text, 1, 1011) AS t, length(text) AS n FROM documents), k AS (SELECT *, length(t) AS m, cast(greatest(1, least(floor(length(t) * 0.75), length(t) - 1)) AS BIGINT) AS k FROM u)
    SELECT doc_id, CASE WHEN m < 2 THEN 'fail' ELSE 'ok' END AS status, 13 + k AS n_input, cast(m - k AS BIGINT) AS n_label, {sql_md5("'<|PREFIX LM|>' || substr(t, 1, k)")} AS input_md5, {sql_md5("substr(t, k + 1)")} AS label_md5, cast(n - m AS BIGINT) AS unused_chars FROM k"""
)
def prefix_lm_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(examples.build(documents(spark, sf_dir), config.objective("prefix_language_modeling")))


@query(
    f"""WITH c AS (SELECT doc_id, text, unnest(range(0, cast(ceil(length(text) / 508.0) AS BIGINT))) AS chunk_idx FROM documents WHERE length(text) > 0)
    SELECT doc_id, chunk_idx, cast(length(substr(text, chunk_idx * 508 + 1, 508)) AS BIGINT) AS n_label, {sql_md5("substr(text, chunk_idx * 508 + 1, 508)")} AS label_md5 FROM c"""
)
def ntp_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = examples.chunks(documents(spark, sf_dir), config.objective("next_token_prediction"))
    return got.select("doc_id", long("chunk_idx"), long(F.length("chunk")).alias("n_label"), digest(tokens.encode(F.col("chunk"))).alias("label_md5"))


@query("SELECT doc_id, CASE WHEN length(text) < 100 OR length(text) > 5000 THEN 'error' ELSE 'ok' END AS status, 'not_enough_space' AS status_small FROM documents")
def run_checks_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", tokens.check(t, ROOM, 16, 100, 5000).alias("status"), tokens.check(t, 10, 16, -1, -1).alias("status_small"))


@query("SELECT doc_id, md5(substr(text, 1, 300)) AS used_md5, md5(substr(text, 301)) AS unused_md5, 0 AS used_without_room, cast(length(text) AS BIGINT) AS unused_without_room FROM documents")
def slice_used_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, rest = tokens.split_at(F.col("text"), F.lit(300))
    none, all_of = tokens.split_at(F.col("text"), F.lit(-5))
    return documents(spark, sf_dir).select("doc_id", F.md5(used.cast("binary")).alias("used_md5"), F.md5(rest.cast("binary")).alias("unused_md5"), F.length(none).alias("used_without_room"), long(F.length(all_of)).alias("unused_without_room"))


@query("SELECT 'documents' AS source, count(*) AS n FROM documents WHERE regexp_matches(text, '\\S') UNION ALL SELECT 'pages', count(*) FROM pages WHERE regexp_matches(html, '\\S') UNION ALL SELECT 'conversations', count(*) FROM conversations WHERE regexp_matches(text, '\\S')")
def blank_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [sources.grab(table(spark, sf_dir, t, c), c).where(tokens.not_blank(F.col("text"))).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("source"), "n") for t, c in (("documents", "text"), ("pages", "html"), ("conversations", "text"))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("SELECT coalesce(source, '') AS source, option, value, option <> 'paradigm_token' AS taken FROM (SELECT source, round(least(1.0, avg(length(text)) / 10000), 6) AS rate, count(*) AS n FROM documents GROUP BY source), LATERAL (VALUES ('corruption_rate', cast(rate AS VARCHAR)), ('mean_tokens_per_span', cast(n AS VARCHAR)), ('paradigm_token', '[R]')) t(option, value)")
def config_override_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An objective for each source of documents, with options told by its documents: which of them the objective takes."""
    told = table(spark, sf_dir, "documents", "source", "text").groupBy("source").agg(F.round(F.least(F.lit(1.0), F.avg(F.length("text")) / 10000), 6).alias("rate"), F.count(F.lit(1)).alias("n"))
    rows = []
    for r in told.collect():  # a row per objective
        entry = config.objective("infilling", corruption_rate=r["rate"], mean_tokens_per_span=r["n"], paradigm_token="[R]")
        rows += [(r["source"] or "", k, str(v), k not in entry.dropped) for k, v in entry.overrides]
    return spark.createDataFrame(rows, "source string, option string, value string, taken boolean")


# ---- mixture --------------------------------------------------------------------------------------------------------
@query("SELECT name, round(p / sum(p) OVER (), 6) AS prob, round(1.0 / count(*) OVER (), 6) AS prob_if_zero FROM (SELECT ['next_token_prediction', 'copying', 'prefix_language_modeling'][CASE WHEN length(lang) IS NULL THEN 1 WHEN lang < 'e' THEN 2 ELSE 3 END] AS name, count(*) AS p FROM documents GROUP BY name)")
def normalize_objective_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture weighted by counts of documents."""
    kind = F.when(F.col("lang").isNull(), "next_token_prediction").when(F.col("lang") < "e", "copying").otherwise("prefix_language_modeling")
    counts = table(spark, sf_dir, "documents", "lang").groupBy(kind.alias("name")).count().orderBy("name").collect()  # a row per objective
    mixture, zero = (config.normalised([config.objective(r["name"], p(r["count"])) for r in counts]) for p in (float, lambda n: 0.0))
    return spark.createDataFrame([(e.name, round(e.prob, 6), round(z.prob, 6)) for e, z in zip(mixture, zero, strict=True)], "name string, prob double, prob_if_zero double")


@query(f"SELECT doc_id, CASE WHEN u < 0.5 THEN 0 WHEN u < 0.75 THEN 1 ELSE 2 END AS obj_idx FROM (SELECT doc_id, {sql_uniform("'0:' || doc_id")} AS u FROM documents)")
def mixture_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples.choose(documents(spark, sf_dir), MIXTURE, "doc_id").select("doc_id", "obj_idx")


@query(
    f"""WITH d AS (SELECT {SHARD_SQL}, {sql_uniform("'0:' || doc_id")} AS u FROM documents), c AS (SELECT shard, CASE WHEN u < 0.5 THEN 0 WHEN u < 0.75 THEN 1 ELSE 2 END AS obj_idx FROM d)
    SELECT cast(shard AS INTEGER) AS shard, obj_idx, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY shard), 6) AS rate FROM c GROUP BY shard, obj_idx"""
)
def mixture_rate_by_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = examples.choose(documents(spark, sf_dir).withColumn("shard", sources.hashed_shard(F.col("doc_id"), shards(spark, sf_dir))), MIXTURE, "doc_id").groupBy("shard", "obj_idx").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("shard")), 6))


# ---- sources --------------------------------------------------------------------------------------------------------
@query("SELECT doc_id, cast(ntile(7) OVER (ORDER BY doc_id) - 1 AS INTEGER) AS shard FROM documents")
def shard_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.contiguous(table(spark, sf_dir, "documents", "doc_id"), 7, "doc_id").select("doc_id", "shard")


@query("SELECT doc_id, cast((row_number() OVER (ORDER BY md5('0:' || doc_id)) - 1) % 7 AS INTEGER) AS shard FROM documents")
def shard_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents", "doc_id").withColumn("h", sources.shuffled_key(F.col("doc_id")))
    return sources.strided(keyed, 7, "h").select("doc_id", "shard")


@query("SELECT doc_id, shard, row_number() OVER (PARTITION BY shard ORDER BY md5('5:' || doc_id)) - 1 AS pos FROM (SELECT doc_id, cast((row_number() OVER (ORDER BY doc_id) - 1) % 7 AS INTEGER) AS shard FROM documents)")
def sharded_then_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document goes to one shard; each shard is shuffled by itself."""
    return sources.shuffled_within(sources.strided(table(spark, sf_dir, "documents", "doc_id"), 7, "doc_id").drop("pos"), "shard", "doc_id", 5).select("doc_id", "shard", "pos")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('5:' || doc_id)) - 1 AS pos FROM documents")
def hash_shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.positions(table(spark, sf_dir, "documents", "doc_id").withColumn("h", sources.shuffled_key(F.col("doc_id"), 5)), "h").select("doc_id", "pos")


@query(f"SELECT doc_id, CASE WHEN u < 0.9 THEN 'train' WHEN u < 0.95 THEN 'validation' ELSE 'test' END AS split, cast(e AS INTEGER) AS epoch FROM (SELECT doc_id, {sql_uniform("'0:split:' || doc_id")} AS u FROM documents), range(2) r(e)")
def split_and_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.epochs(table(spark, sf_dir, "documents", "doc_id").withColumn("split", sources.split_of(F.col("doc_id"), 0.9, 0.05)), 2).select("doc_id", "split", "epoch")


@query("SELECT doc_id, cast([24, 48, 96, 256, 1024][doc_id % 5 + 1] AS BIGINT) AS n, md5(substr(repeat('abcdefghijklmnopqrstuvwxyz ', 40), 1, [24, 48, 96, 256, 1024][doc_id % 5 + 1])) AS text_md5 FROM documents")
def synthetic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of planned length in the place of every document."""
    made = table(spark, sf_dir, "documents", "doc_id").withColumn("text", sources.synthetic_text(F.col("doc_id"), (24, 48, 96, 256, 1024)))
    return made.select("doc_id", long(F.length("text")).alias("n"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("WITH o AS (SELECT doc_id, text, row_number() OVER (ORDER BY md5('0:' || doc_id)) - 1 AS pos FROM documents) SELECT cast(pos % 4 AS INTEGER) AS worker, cast(e AS INTEGER) AS epoch, pos // 4 AS position, cast(doc_id AS VARCHAR) AS key, md5(text) AS text_md5 FROM o, range(2) r(e)")
def connected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as shuffled shards, read through the connector by four workers for two epochs."""
    folder = shared_folder(spark, "shards")
    connector.publish(documents(spark, sf_dir), folder, 4, "doc_id")
    name = f"shards_{folder.rpartition('-')[2]}"
    spark.dataSource.register(connector.shards(name, folder))
    read = connector.read(spark, name, workers=4, epochs=2)
    return read.select("worker", "epoch", "position", "key", F.md5(F.col("text").cast("binary")).alias("text_md5"))


EXPECTED = {"click": 5, "view": 6, "purchase": 4}


@query(
    f"""WITH w AS (SELECT * FROM (VALUES {", ".join(map(str, EXPECTED.items()))}) t(obj_key, wanted)),
    r AS (SELECT date_diff('day', DATE '1970-01-01', cast(ts AS DATE)) AS evaluation, obj_key, wanted, value, row_number() OVER (PARTITION BY cast(ts AS DATE), obj_key ORDER BY event_id) AS rank FROM events JOIN w ON obj_key = event_type WHERE value IS NOT NULL),
    m AS (SELECT evaluation, obj_key, wanted, avg(value) AS mean_loss, count(*) AS n FROM r WHERE rank <= wanted GROUP BY ALL)
    SELECT evaluation, obj_key, round(mean_loss, 6) AS mean_loss, n FROM m WHERE evaluation IN (SELECT evaluation FROM m WHERE n >= wanted GROUP BY evaluation HAVING count(*) = {len(EXPECTED)})"""
)
def completed_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that have all losses that are expected of them, with their means."""
    e = table(spark, sf_dir, "events", loss_stream.evaluation_of(F.col("ts")).alias("evaluation"), F.col("event_id").alias("loss_id"), F.col("event_type").alias("obj_key"), F.col("value").alias("loss"))
    return loss_stream.completed(e, EXPECTED).withColumn("mean_loss", F.round("mean_loss", 6))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
    m AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND line = lag(line) OVER w THEN 0 ELSE 1 END AS fresh FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m)
    SELECT doc_id, min(pos) AS first, count(*) AS n, md5(any_value(line) || CASE WHEN count(*) > 1 THEN chr(10) || '  [Last line repeated ' || (count(*) - 1) || ' times...]' ELSE '' END) AS shown_md5 FROM r GROUP BY doc_id, run"""
)
def run_length_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    runs = sources.collapse_runs(lines, "doc_id", "pos", "line")
    return runs.select("doc_id", long("first"), "n", F.md5(sources.shown_runs(runs, "line").cast("binary")).alias("shown_md5"))


def stream_runs_sql(lines: str, order: str) -> str:
    return f"""WITH l AS ({lines}), m AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND line IS NOT DISTINCT FROM lag(line) OVER w THEN 0 ELSE 1 END AS fresh FROM l WINDOW w AS (ORDER BY {order})),
    r AS (SELECT *, sum(fresh) OVER (ORDER BY {order}) AS run FROM m)"""


@query(
    f"""{stream_runs_sql("SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents", "doc_id, pos")}
    SELECT max(doc_id) FILTER (WHERE fresh = 1) AS doc_id, max(pos) FILTER (WHERE fresh = 1) AS pos, count(*) AS n, md5(any_value(line)) AS line_md5 FROM r GROUP BY run"""
)
def corpus_run_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents as one stream, its runs collapsed."""
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return sources.collapse_stream(lines, ("doc_id", "pos"), "line").select("doc_id", long("pos"), "n", F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query(f"{stream_runs_sql("SELECT ts, event_id, event_type AS line FROM events", "ts, event_id")} SELECT max(event_id) FILTER (WHERE fresh = 1) AS event_id, any_value(line) AS event_type, count(*) AS n FROM r GROUP BY run")
def event_run_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events of one type, in the order of time."""
    return sources.collapse_stream(table(spark, sf_dir, "events", "ts", "event_id", "event_type"), ("ts", "event_id"), "event_type").select("event_id", "event_type", "n")


@query("SELECT conv_id, count(*) AS n_turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS text_md5 FROM conversations GROUP BY conv_id")
def conversation_grabber(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    nested = sources.grab(turns, F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n"))
    return nested.select("conv_id", long(F.size("turns")).alias("n_turns"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


# ---- packing --------------------------------------------------------------------------------------------------------
def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("shard", sources.hashed_shard(F.col("doc_id"), shards(spark, sf_dir)))


def sized(docs: DataFrame) -> DataFrame:
    """All examples of each document by the mixture, with their sizes."""
    made = examples.mixed(examples.used_up(docs, MIXTURE, "doc_id"), MIXTURE).where(F.col("status") == "ok")
    return made.withColumns({"n_input": F.length("input_text") + F.length("prompt"), "n_label": F.length("label_text")}).withColumn("n", F.col("n_input") + F.col("n_label"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows of all examples as arrays. Documents go to their shards once; pieces, examples and rows are made from there on."""
    return packing.rows_of_texts(sized(packing.in_order(sharded(spark, sf_dir), ("doc_id",))), "n", ROOM)


def placed(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """All examples of each document by the mixture, placed in rows."""
    made = sized(sharded(spark, sf_dir))
    kept = ["shard", "doc_id", "chunk_idx", "obj_idx", "objective", "prompt", "n_input", "n_label", "n"]
    return packing.place(made.select(*kept), "n", ROOM, order=("doc_id", "chunk_idx"), **how)


@query("SELECT doc_id, cast(length(text) AS BIGINT) AS n_chars, cast(length(text) AS BIGINT) AS n_used FROM documents WHERE length(text) > 0")
def texts_used_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each document, and those that its examples hold (a text that is input and label counts once)."""
    used = F.col("n_label") + F.when(F.col("objective") == "prefix_language_modeling", F.col("n_input") - F.length("prompt")).otherwise(0)
    got = placed(spark, sf_dir).groupBy("doc_id").agg(F.sum(used).cast("long").alias("n_used"))
    return documents(spark, sf_dir).select("doc_id", long(F.length("text")).alias("n_chars")).join(got, "doc_id")


@query(f"{PLACED_SQL} SELECT doc_id, cast(chunk_idx AS INTEGER) AS chunk_idx, cast(shard AS INTEGER) AS shard, pack_id, segment, cast(start_off AS INTEGER) AS start_off, cast(n_input + n_label AS INTEGER) AS n FROM placed")
def nextfit_pack_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("doc_id", "chunk_idx", "shard", "pack_id", "segment", "start_off", "n")


@query(
    f"""{PLACED_SQL}, flat AS (SELECT shard, pack_id, unnest(range(len(i))) AS pos, unnest(i) AS input_id, unnest(l) AS label_id, unnest(s) AS segment, unnest(m) AS mask FROM dense)
    SELECT cast(shard AS INTEGER) AS shard, pack_id, segment, cast(min(pos) AS INTEGER) AS first, cast(max(pos) AS INTEGER) AS last, cast(sum(input_id * (pos + 1)) AS BIGINT) AS input_sum, cast(sum(label_id * (pos + 1)) AS BIGINT) AS label_sum, cast(sum(mask * (pos + 1)) AS BIGINT) AS mask_sum FROM flat GROUP BY ALL"""
)
def packed_segment_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each segment lies in its row, with its ids, labels and marks as sums weighted by position."""
    at = packing.alignment(dense(spark, sf_dir))
    weighted = lambda c: F.sum(F.col(c).cast("long") * (F.col("pos") + 1))
    return at.groupBy("shard", "pack_id", F.col("segment_ids").alias("segment")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), weighted("input_ids").alias("input_sum"), weighted("label_ids").alias("label_sum"), weighted("attention_mask").alias("mask_sum"))


@query(f"{PLACED_SQL} SELECT cast(shard AS INTEGER) AS shard, pack_id, md5(array_to_string({pad_sql('i', 0)}, ',')) AS input_md5, md5(array_to_string({pad_sql('l', -100)}, ',')) AS label_md5, md5(array_to_string({pad_sql('s', 0)}, ',')) AS segment_md5, md5(array_to_string({pad_sql('m', 0)}, ',')) AS mask_md5 FROM dense")
def packed_rows_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dense(spark, sf_dir)
    return rows.select("shard", "pack_id", *(digest(F.col(c)).alias(n) for c, n in (("input_ids", "input_md5"), ("label_ids", "label_md5"), ("segment_ids", "segment_md5"), ("attention_mask", "mask_md5"))))


@query(f"{PLACED_SQL} SELECT cast(shard AS INTEGER) AS shard, pack_id, used, n_segments, (row_number() OVER (PARTITION BY shard ORDER BY pack_id) - 1) // {BATCH} AS batch_id, cast((row_number() OVER (PARTITION BY shard ORDER BY pack_id) - 1) % {BATCH} AS INTEGER) AS row_in_batch FROM closed")
def batch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.batches(packing.close_rows(placed(spark, sf_dir), "n", ROOM), BATCH)


@query(
    f"""{PLACED_SQL}, g AS (SELECT objective, count(*) AS sample_count, cast(sum(CASE WHEN obj_idx = 0 THEN least(n_input, 1) ELSE n_input END) AS BIGINT) AS context_tokens, cast(sum(n_input) AS BIGINT) AS input_tokens, cast(sum(n_label) AS BIGINT) AS output_tokens FROM placed GROUP BY objective)
    SELECT objective, sample_count, round(sample_count / sum(sample_count) OVER (), 6) AS actual_rate, context_tokens, input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens, round(context_tokens / sample_count, 6) AS avg_context_tokens, round(input_tokens / sample_count, 6) AS avg_input_tokens, round(output_tokens / sample_count, 6) AS avg_output_tokens FROM g"""
)
def objective_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.by_objective(placed(spark, sf_dir))


@query(f"{PLACED_SQL} SELECT count(*) AS n_rows, cast(sum(n_segments) AS BIGINT) AS total_samples, cast(sum(used) AS BIGINT) AS active_slots, count(*) * {ROOM} AS total_slots, round(sum(used) / (count(*) * {ROOM}), 6) AS fill_rate FROM closed")
def fill_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.fill(packing.close_rows(placed(spark, sf_dir), "n", ROOM), ROOM)


@query(f"{PLACED_SQL} SELECT count(*) AS n_rows, cast(ceil(count(*) / {BATCH}.0) AS BIGINT) AS n_batches, cast(sum(n_segments) AS BIGINT) AS total_samples, cast(sum(used) AS BIGINT) AS active_slots, count(*) * {ROOM} AS total_slots, round(sum(used) / (count(*) * {ROOM}), 6) AS fill_rate FROM closed")
def observed_run_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run reports of the packed rows that it writes, without reading them again."""
    seen = Observation()
    figures.observed(packing.close_rows(placed(spark, sf_dir), "n", ROOM), seen).write.parquet(shared_folder(spark, "packed"))
    got = figures.of(seen, ROOM, BATCH)
    return spark.createDataFrame([(got.n_rows, got.batches, got.total_samples, got.active_slots, got.total_slots, got.fill_rate)], "n_rows long, n_batches long, total_samples long, active_slots long, total_slots long, fill_rate double")


@query(f"{PLACED_SQL} SELECT cast(shard AS INTEGER) AS shard, pack_id, segment, cast(start_off AS INTEGER) AS pos, unicode(prompt) + 3 AS token FROM placed")
def segment_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.segment_starts(dense(spark, sf_dir))


@query(f"{PLACED_SQL} SELECT cast(shard AS INTEGER) AS shard, pack_id, cast(sum(n_label) AS INTEGER) AS n_labels FROM placed GROUP BY shard, pack_id")
def label_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.label_density(dense(spark, sf_dir))


@query(f"{PLACED_SQL} SELECT objective, count(*) AS n, CASE WHEN objective IS NULL THEN count(*) ELSE 0 END AS unknown FROM (SELECT CASE WHEN prompt IN ('A', 'B') THEN objective END AS objective FROM placed) GROUP BY objective")
def marker_lookup_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by the objective that their first token marks, with one marker left out so that some are unknown."""
    starts = statistics.segment_starts(dense(spark, sf_dir))
    known = {k: v for k, v in MARKERS.items() if k != ord("C") + tokens.OFFSET}
    return statistics.named(starts, known).groupBy("objective").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("objective").isNull()).alias("unknown"))


@query(f"{PLACED_SQL} SELECT cast(shard AS INTEGER) AS shard, pack_id, cast(len(i) AS INTEGER) AS used, round(len(i) / {ROOM}.0, 6) AS share, list_max(i) AS max_input_id, list_max(l) AS max_label_id FROM dense")
def max_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.efficiency(dense(spark, sf_dir))


@query(f"{PLACED_SQL} SELECT cast(shard AS INTEGER) AS shard, pack_id, cast(sum((n_input + n_label) * (n_input + n_label + 1) // 2 + n_input * (n_input - 1) // 2) AS BIGINT) AS n_pairs FROM placed GROUP BY shard, pack_id")
def attention_pairs_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.attention_pairs(dense(spark, sf_dir))


@query(f"WITH {MIXED_SQL.strip()} SELECT doc_id, cast(chunk_idx AS INTEGER) AS chunk_idx, n_input + 16 + n_label - 1 AS cost, n_input + 16 AS cost_without_labels FROM sized")
def packer_v1_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What examples take when labels follow a separator of 16 tokens."""
    p = placed(spark, sf_dir)
    return p.select("doc_id", "chunk_idx", long(packing.separator_cost(F.col("n_input"), F.col("n_label"), 16)).alias("cost"), long(packing.separator_cost(F.col("n_input"), F.lit(0), 16)).alias("cost_without_labels"))


def fit_sql(best: bool, rows: int = 4) -> str:
    """A set of open rows as lists: the fullest (or emptiest) that takes the item; all are replaced when none does or all are full."""
    key = "u" if best else "-u"
    return f"""WITH RECURSIVE {MIXED_SQL.strip()}, items AS MATERIALIZED (SELECT shard, rn, n_input + n_label AS n FROM sized),
    fit AS (SELECT shard, rn, cast(0 AS BIGINT) AS base, cast(1 AS BIGINT) AS i, cast(0 AS BIGINT) AS start_off, 1 AS segment, list_concat([n], {[0] * (rows - 1)}) AS used, list_concat([1], {[0] * (rows - 1)}) AS held FROM items WHERE rn = 1
        UNION ALL SELECT shard, rn, base, i, used[i], held[i] + 1, list_transform(used, lambda u, j: CASE WHEN j = i THEN u + n ELSE u END), list_transform(held, lambda h, j: CASE WHEN j = i THEN h + 1 ELSE h END)
        FROM (SELECT *, cast(list_position(list_transform(used, lambda u: CASE WHEN u + n <= {ROOM} THEN {key} ELSE -9999 END), list_max(list_transform(used, lambda u: CASE WHEN u + n <= {ROOM} THEN {key} ELSE -9999 END))) AS BIGINT) AS i
        FROM (SELECT shard, rn, n, CASE WHEN fresh THEN base + {rows} ELSE base END AS base, CASE WHEN fresh THEN {[0] * rows} ELSE used END AS used, CASE WHEN fresh THEN {[0] * rows} ELSE held END AS held
        FROM (SELECT s.shard, s.rn, s.n, f.base, f.used, f.held, len(list_filter(f.used, lambda u: u + s.n <= {ROOM})) = 0 OR len(list_filter(f.used, lambda u: {ROOM} - u > 64)) = 0 AS fresh FROM fit f JOIN items s ON s.shard = f.shard AND s.rn = f.rn + 1))))
    SELECT doc_id, cast(chunk_idx AS INTEGER) AS chunk_idx, cast(shard AS INTEGER) AS shard, base + i - 1 AS pack_id, segment, cast(start_off AS INTEGER) AS start_off, cast(n_input + n_label AS INTEGER) AS n FROM sized JOIN fit USING (shard, rn)"""


@query(
    f"""WITH RECURSIVE {MIXED_SQL.strip()}, items AS MATERIALIZED (SELECT shard, rn, n_input + 16 + n_label - 1 AS n FROM sized),
    fit AS (SELECT shard, rn, cast(0 AS BIGINT) AS pack_id, 1 AS segment, cast(0 AS BIGINT) AS start_off, n AS used FROM items WHERE rn = 1
        UNION ALL SELECT shard, rn, CASE WHEN new THEN pack_id + 1 ELSE pack_id END, CASE WHEN new THEN 1 ELSE segment + 1 END, CASE WHEN new THEN 0 ELSE used END, CASE WHEN new THEN 0 ELSE used END + n
        FROM (SELECT s.shard, s.rn, s.n, f.pack_id, f.segment, f.used, f.used + s.n > {ROOM + 64} OR {ROOM + 64} - f.used <= 16 AS new FROM fit f JOIN items s ON s.shard = f.shard AND s.rn = f.rn + 1))
    SELECT doc_id, cast(chunk_idx AS INTEGER) AS chunk_idx, cast(shard AS INTEGER) AS shard, pack_id, segment, cast(start_off AS INTEGER) AS start_off FROM sized JOIN fit USING (shard, rn)"""
)
def packer_v1_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of examples whose labels follow a separator of 16 tokens; a row closes when no separator and token fit."""
    drawn = examples.used_up(documents(spark, sf_dir), MIXTURE, "doc_id").withColumn("shard", sources.hashed_shard(F.col("doc_id"), shards(spark, sf_dir)))
    made = examples.mixed(drawn, MIXTURE).withColumn("n", packing.separator_cost(F.length("input_text") + F.length("prompt"), F.length("label_text"), 16).cast("int"))
    placed_rows = packing.place(made.select("shard", "doc_id", "chunk_idx", "n"), "n", ROOM + 64, packing.separator_room(8, 16), order=("doc_id", "chunk_idx"))
    return placed_rows.select("doc_id", "chunk_idx", "shard", "pack_id", "segment", "start_off")


@query(f"{PLACED_SQL} SELECT cast(shard AS INTEGER) AS shard, pack_id, cast(sum((n_input + n_label) * (n_input + n_label + 1) // 2) AS BIGINT) AS n_pairs FROM placed GROUP BY shard, pack_id")
def attention_pairs_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.attention_pairs(dense(spark, sf_dir), causal=True)


TILE = 128
TILES_SQL = f"""{PLACED_SQL.rstrip()}, spots AS (SELECT shard, pack_id, segment, n_input, start_off, unnest(range(start_off, start_off + n_input + n_label)) AS i FROM placed),
    per AS (SELECT shard, pack_id, segment, i // {TILE} AS block, count(*) AS n, count(*) FILTER (WHERE i < start_off + n_input) AS k FROM spots GROUP BY ALL),
    pairs AS (SELECT q.shard, q.pack_id, q.block AS query_block, k.block AS key_block, sum(CASE WHEN q.block > k.block THEN q.n * k.n WHEN q.block = k.block THEN q.n * (q.n + 1) // 2 + q.k * (q.k - 1) // 2 ELSE q.k * k.k END) AS n
        FROM per q JOIN per k ON q.shard = k.shard AND q.pack_id = k.pack_id AND q.segment = k.segment GROUP BY ALL)"""


@query(f"{TILES_SQL} SELECT cast(shard AS INTEGER) AS shard, pack_id, count(*) FILTER (WHERE n = {TILE * TILE}) AS n_full, count(*) FILTER (WHERE n > 0 AND n < {TILE * TILE}) AS n_partial, {(ROOM // TILE) ** 2} - count(*) FILTER (WHERE n > 0) AS n_empty FROM pairs GROUP BY shard, pack_id")
def attention_tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.tile_counts(placed(spark, sf_dir), TILE, ROOM)


@query(f"{TILES_SQL} SELECT cast(shard AS INTEGER) AS shard, pack_id, query_block, key_block, n = {TILE * TILE} AS full FROM pairs WHERE n > 0")
def attention_tile_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.tile_map(placed(spark, sf_dir), TILE)


@query(fit_sql(True))
def bestfit_pack_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir, fit="best", rows=4).select("doc_id", "chunk_idx", "shard", "pack_id", "segment", "start_off", "n")


OPEN_ROWS = 4
LAST_SETS_SQL = f"""WITH plan AS ({fit_sql(True)}), held AS (SELECT shard, pack_id, cast(sum(n) AS BIGINT) AS used, count(*) AS n_segments, max(pack_id) OVER (PARTITION BY shard) // {OPEN_ROWS} AS last FROM plan GROUP BY shard, pack_id)"""


@query(f"{LAST_SETS_SQL} SELECT shard, CASE WHEN count(*) < {OPEN_ROWS} THEN {ROOM} ELSE {ROOM} - min(used) END AS max_room, {ROOM} - max(used) AS min_room, count(*) = {OPEN_ROWS} AND {ROOM} - min(used) <= 64 AS ready FROM held WHERE pack_id // {OPEN_ROWS} = last GROUP BY shard")
def open_row_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The room in each shard's open rows after its last example, and whether they are ready to go."""
    return packing.readiness(packing.open_rows(placed(spark, sf_dir, fit="best", rows=OPEN_ROWS), "n", OPEN_ROWS), ROOM)


@query(
    f"""{LAST_SETS_SQL}, b AS (SELECT shard, max(last) * {OPEN_ROWS} AS base, count(*) FILTER (WHERE pack_id // {OPEN_ROWS} = last) = {OPEN_ROWS} AND {ROOM} - min(used) FILTER (WHERE pack_id // {OPEN_ROWS} = last) <= 64 AS popped FROM held GROUP BY shard),
    r AS (SELECT shard, base + i AS pack_id, popped FROM b, range({OPEN_ROWS}) t(i))
    SELECT r.shard, r.pack_id, coalesce(used, 0) AS used, coalesce(n_segments, 0) AS n_segments, popped FROM r LEFT JOIN held ON held.shard = r.shard AND held.pack_id = r.pack_id"""
)
def peeked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look at each shard's open rows, and whether they would go now."""
    return packing.popped(packing.open_rows(placed(spark, sf_dir, fit="best", rows=OPEN_ROWS), "n", OPEN_ROWS), ROOM, peek=True)


@query(f"{LAST_SETS_SQL} SELECT shard, pack_id, used, n_segments, pack_id // {OPEN_ROWS} = last AS forced FROM held")
def forced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed rows when the open ones are closed as they are."""
    return packing.forced(placed(spark, sf_dir, fit="best", rows=OPEN_ROWS), "n", OPEN_ROWS)


@query(fit_sql(True))
def streamed_pack_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All examples as a stream whose open rows are state; the stream's table is read when it has taken them all."""
    folder, items = shared_folder(spark, "streamed"), placed(spark, sf_dir).select("shard", "doc_id", "chunk_idx", "n")
    items.write.parquet(f"{folder}/items")
    told = open_rows.rows_of(spark.readStream.schema(items.schema).parquet(f"{folder}/items"), "n", ROOM, order=("doc_id", "chunk_idx"), rows=OPEN_ROWS)
    with open_rows.rocks(spark):
        told.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/told", format="parquet").awaitTermination()
    got = spark.read.schema(told.schema).parquet(f"{folder}/told").where(F.col("event") == open_rows.PLACED)
    return got.select("doc_id", "chunk_idx", "shard", "pack_id", "segment", "start_off", "n")


@query(fit_sql(False))
def worstfit_pack_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir, fit="worst", rows=4).select("doc_id", "chunk_idx", "shard", "pack_id", "segment", "start_off", "n")


@query(
    f"""WITH {MIXED_SQL.strip()}, z AS (SELECT doc_id, cast(chunk_idx AS INTEGER) AS chunk_idx, n_input AS n, n_label AS m, greatest(n_input, 8) AS e, 8.0 / n_input AS ratio, {sql_ids("prompt || input_text")} AS i, {sql_ids("label_text")} AS l FROM sized)
    SELECT doc_id, chunk_idx, n + 8 + m AS slots, md5(array_to_string(list_concat(list_concat(list_concat(i, list_transform(range(8), lambda x: 98)), [2]), list_slice(l, 1, m - 1)), ',')) AS input_md5,
        md5(array_to_string(list_concat(list_concat(list_transform(range(n), lambda x: cast(floor(x * e / n) AS INTEGER)), list_transform(range(8), lambda x: cast(floor(x * e / 8) AS INTEGER))), list_transform(range(m), lambda x: cast(floor(e + x * greatest(cast(m AS DOUBLE), m * (8.0 / n)) / m) AS INTEGER))), ',')) AS position_md5 FROM z"""
)
def latent_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = packing.latent_arrays(F.col("input_ids"), F.col("label_ids"), 8, 98, F.lit(1))
    got = examples.with_ids(sized(documents(spark, sf_dir))).select("doc_id", "chunk_idx", laid["input_ids"].alias("laid_ids"), laid["position_ids"].alias("laid_positions"))
    return got.select("doc_id", "chunk_idx", long(F.size("laid_ids")).alias("slots"), digest(F.col("laid_ids")).alias("input_md5"), digest(F.col("laid_positions")).alias("position_md5"))


# ---- walks ----------------------------------------------------------------------------------------------------------
@query(
    f"""WITH u AS (SELECT doc_id, substr(text, 1, 447) AS t, md5('0:' || substr(text, 1, 447)) AS key FROM documents WHERE length(text) > 0),
    c AS (SELECT doc_id, t, key, unnest(range(1, length(t) + 1)) AS i FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('a' || key || ':' || i), i) AS ra FROM c),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pi, row_number() OVER (PARTITION BY doc_id ORDER BY md5('b' || key || ':' || i), i) AS pb FROM r WHERE ra <= floor(length(t) * 0.75)),
    mv AS (SELECT a.doc_id, a.i, b.i AS src FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.pi = b.pb),
    o AS (SELECT c.doc_id, string_agg(substr(c.t, coalesce(mv.src, c.i), 1), '' ORDER BY c.i) AS x, any_value(c.t) AS t FROM c LEFT JOIN mv USING (doc_id, i) GROUP BY c.doc_id)
    SELECT doc_id, 'ok' AS status, cast(13 + length(x) AS BIGINT) AS n_input, md5(x) AS mixed_md5, md5(t) AS label_md5 FROM o"""
)
def deshuffle_portable(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = examples.build(documents(spark, sf_dir).where(F.length("text") > 0), config.objective("deshuffling"))
    return made.select("doc_id", "status", long(F.length("input_text") + F.length("prompt")).alias("n_input"), F.md5(F.col("input_text").cast("binary")).alias("mixed_md5"), F.md5(F.col("label_text").cast("binary")).alias("label_md5"))


def walk_sql(prompt: int, mean: float, rate: float, shortest: float, longest: float, prefix: bool, most: int, attempts: int = 100) -> str:
    """The walk as recursion: a row per document and hole, attempts one after another. `used` counts what labels take."""
    hole = "(10 + length(cast(spans AS VARCHAR)))"
    added = "span" if prefix else f"{hole} + span"
    one = 1 if prefix else 0
    hazard, chances = spans.skip_tables(mean, shortest, longest, max(0.0, rate * 0.5), min(0.95, 2 * rate))
    top, growth, reach = repr(hazard[-1]), repr(hazard[-1] - hazard[-2]), len(chances)
    hazards, tables = (f"cast({json.dumps(x)} AS {kind})" for x, kind in ((hazard, "DOUBLE[]"), (chances, "DOUBLE[][]")))
    key = "'0:' || doc_id || ':' || attempt || ':' || step"
    going = f"idx < lim AND spans < {most} AND n_in + n_lab < {ROOM} AND NOT stop"
    drawn = f"SELECT *, {going} AS going, CASE WHEN lim - idx > {reach} THEN {top} + (lim - idx - {reach}) * {growth} ELSE {hazards}[lim - idx + 1] END + ln(1 - {sql_uniform(key)}) AS x FROM w WHERE lim > 0 AND (({going}) OR spans = 0 AND attempt + 1 < {attempts})"
    found = f"SELECT *, cast(least(lim - idx, CASE WHEN x > {top} THEN {reach} + ceil((x - {top}) / {growth}) ELSE len(list_filter({hazards}, lambda h: h < x)) END) AS BIGINT) AS lft FROM ({drawn})"
    kept = f"SELECT *, lim - lft - idx AS way, least(lim - lft - idx, ({ROOM} - n_in - n_lab) // {1 + one}) AS n, 1 + len(list_filter({tables}[greatest(1, least(lft, {reach}))], lambda q: q <= {sql_uniform(key, 1)})) AS span FROM ({found})"
    there = f"SELECT * REPLACE (idx + n AS idx, n_in + n AS n_in, n_lab + {one} * n AS n_lab), n < way AS short FROM ({kept})"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, least(length(text), {ROOM - prompt - 16}) AS lim, length(text) AS n_text FROM documents),
    w AS (SELECT doc_id, lim, n_text, 0 AS attempt, 0 AS step, cast(0 AS BIGINT) AS idx, cast(0 AS BIGINT) AS spans, cast({prompt} AS BIGINT) AS n_in, cast(0 AS BIGINT) AS n_lab, cast(0 AS BIGINT) AS masked, false AS stop FROM d
      UNION ALL SELECT doc_id, lim, n_text,
        CASE WHEN going THEN attempt ELSE attempt + 1 END, CASE WHEN going THEN step + 1 ELSE 0 END,
        CASE WHEN NOT going THEN 0 WHEN mask THEN idx + span WHEN lit THEN idx + 1 ELSE idx END, CASE WHEN NOT going THEN 0 WHEN mask THEN spans + 1 ELSE spans END,
        CASE WHEN NOT going THEN {prompt} WHEN mask THEN n_in + {hole} WHEN lit THEN n_in + 1 ELSE n_in END, CASE WHEN NOT going THEN 0 WHEN mask THEN n_lab + {added} WHEN lit THEN n_lab + {one} ELSE n_lab END,
        CASE WHEN NOT going THEN 0 WHEN mask THEN masked + span ELSE masked END, going AND NOT mask AND NOT lit
      FROM (SELECT *, NOT short AND lft > 0 AND n_in + {hole} + n_lab + {added} <= {ROOM} AS mask, NOT short AND lft > 0 AND n_in + 1 + n_lab + {one} <= {ROOM} AS lit FROM ({there}))),
    e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY attempt DESC, step DESC) AS r FROM w)
    SELECT doc_id, CASE WHEN spans > 0 THEN 'ok' ELSE 'fail' END AS status, cast(spans AS INTEGER) AS spans, cast(CASE WHEN spans > 0 THEN n_in ELSE 0 END AS BIGINT) AS n_input, cast(CASE WHEN spans > 0 THEN n_lab ELSE 0 END AS BIGINT) AS n_label,
      cast(CASE WHEN spans > 0 THEN masked ELSE 0 END AS INTEGER) AS masked_count, cast(CASE WHEN spans > 0 THEN n_text - idx ELSE n_text END AS BIGINT) AS unused_chars, CASE WHEN lim <= 0 THEN 0 ELSE attempt + 1 END AS attempts FROM e WHERE r = 1"""


def _walked(made: DataFrame) -> DataFrame:
    return made.select("doc_id", "status", "spans", long(F.size("input_ids")).alias("n_input"), long(F.size("label_ids")).alias("n_label"), "masked_count", long(F.length("unused_text")).alias("unused_chars"), "attempts")


@query(walk_sql(len("<|INFILL|>"), 3.0, 0.15, 1.0, 9.0, False, 20))
def infilling_portable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spans.build(documents(spark, sf_dir), config.objective("infilling"), "doc_id"))


@query(walk_sql(len("<|AUTOENCODE|>"), 3.0, 0.5, 1, 9, True, 1 << 31))
def autoencoding_portable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spans.build(documents(spark, sf_dir), config.objective("autoencoding"), "doc_id"))


@query(walk_sql(len("<|AUTOENCODE + DESHUFFLE|>"), 3.0, 0.5, 1, 9, True, 1 << 31))
def autoencoding_with_deshuffling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spans.build(documents(spark, sf_dir), config.objective("autoencoding_with_deshuffling"), "doc_id"))


@query()
def selective_copying(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spans.build(documents(spark, sf_dir), config.objective("selective_copying"), "doc_id"))


@query()
def deshuffle_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spans.build(documents(spark, sf_dir), config.objective("deshuffling", rng_seed=7), "doc_id", exact=True))


@query(f"SELECT doc_id, spans, spans AS in_input, spans AS in_label FROM ({walk_sql(len("<|INFILL|>"), 3.0, 0.15, 1.0, 9.0, False, 20)}) WHERE status = 'ok'")
def infilling_placeholder_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders in input and label of each infilling example; they are equal in number."""
    made = spans.build(documents(spark, sf_dir), config.objective("infilling"), "doc_id")
    holes = lambda c: F.size(F.split(tokens.decode(F.col(c)), r"\[\[mask_")) - 1
    return made.where(F.col("status") == "ok").select("doc_id", "spans", holes("input_ids").alias("in_input"), holes("label_ids").alias("in_label"))


PLAIN = config.normalised([config.objective("next_token_prediction", 2), config.objective("copying", 1), config.objective("prefix_language_modeling", 1)])


@query(
    f"""WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, text, length(text) AS n, {SHARD_SQL}, row_number() OVER (PARTITION BY {SHARD_SQL.removesuffix(" AS shard")} ORDER BY doc_id) AS rn FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\r]')),
    w AS (SELECT shard, cast(1 AS BIGINT) AS rn, cast(0 AS BIGINT) AS pos, cast(0 AS BIGINT) AS seq, cast(0 AS BIGINT) AS pack, cast(0 AS BIGINT) AS used, 0 AS segment, cast(NULL AS BIGINT) AS doc_id, cast(NULL AS BIGINT) AS ex_seq, cast(NULL AS INTEGER) AS obj, cast(NULL AS BIGINT) AS pack_id, cast(NULL AS INTEGER) AS seg, cast(NULL AS BIGINT) AS start_off, cast(NULL AS BIGINT) AS n_input, cast(NULL AS BIGINT) AS n_label, cast(NULL AS BIGINT) AS unused, cast(NULL AS VARCHAR) AS status
        FROM (SELECT DISTINCT shard FROM t)
      UNION ALL SELECT shard, CASE WHEN ok AND pos + took < n THEN rn ELSE rn + 1 END, CASE WHEN ok AND pos + took < n THEN pos + took ELSE 0 END, seq + 1,
        CASE WHEN ok AND {ROOM} - (start + need) <= 64 THEN start_pack + 1 WHEN ok THEN start_pack ELSE pack END, CASE WHEN ok AND {ROOM} - (start + need) <= 64 THEN 0 WHEN ok THEN start + need ELSE used END,
        CASE WHEN ok AND {ROOM} - (start + need) <= 64 THEN 0 WHEN ok THEN start_segment + 1 ELSE segment END,
        doc_id, seq, obj, CASE WHEN ok THEN start_pack END, CASE WHEN ok THEN start_segment + 1 END, CASE WHEN ok THEN start END, CASE WHEN ok THEN n_in END, CASE WHEN ok THEN n_lab END, CASE WHEN ok THEN n - pos - took END, CASE WHEN ok THEN 'ok' ELSE bad END
      FROM (SELECT *, n_in + n_lab AS need, n_in + n_lab > {ROOM} - used AS fresh, CASE WHEN n_in + n_lab > {ROOM} - used THEN 0 ELSE used END AS start, CASE WHEN n_in + n_lab > {ROOM} - used THEN pack + 1 ELSE pack END AS start_pack, CASE WHEN n_in + n_lab > {ROOM} - used THEN 0 ELSE segment END AS start_segment, bad IS NULL AS ok
        FROM (SELECT *, CASE WHEN obj = 2 THEN p + half ELSE p + took END AS n_in, CASE WHEN obj = 2 THEN took - half ELSE took END AS n_lab, CASE WHEN obj = 2 AND took < 2 THEN 'fail' WHEN obj < 2 AND took = 0 THEN 'empty_label_ids' END AS bad
        FROM (SELECT *, CASE WHEN obj = 2 THEN cast(greatest(1, least(floor(took * 0.75), took - 1)) AS BIGINT) ELSE 0 END AS half
        FROM (SELECT *, greatest(0, least(n - pos, CASE WHEN obj = 2 THEN {ROOM} - used - p ELSE ({ROOM} - used - p) // 2 END)) AS took
        FROM (SELECT *, {[len(e.prompt) for e in PLAIN]}[obj + 1] AS p
        FROM (SELECT w.shard, w.rn, w.pos, w.seq, w.pack, w.used, w.segment, t.doc_id, t.n, CASE WHEN u < 0.5 THEN 0 WHEN u < 0.75 THEN 1 ELSE 2 END AS obj
        FROM (SELECT *, {sql_uniform("'0:' || shard || ':' || seq")} AS u FROM w) w JOIN t ON t.shard = w.shard AND t.rn = w.rn)))))))
    SELECT cast(shard AS INTEGER) AS shard, doc_id, ex_seq, {[e.name for e in PLAIN]}[obj + 1] AS objective, pack_id, seg AS segment, cast(start_off AS INTEGER) AS start_off, n_input, n_label, unused, status FROM w WHERE doc_id IS NOT NULL"""
)
def coupled_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coupled fold with objectives that draw nothing within a text, so that SQL can follow it."""
    texts = documents(spark, sf_dir).where(tokens.not_blank(F.col("text"))).withColumn("shard", sources.hashed_shard(F.col("doc_id"), shards(spark, sf_dir)))
    return worker.fold(texts, worker.Run(tuple(PLAIN), ROOM, strict=False, ids=False), order=("doc_id",)).drop("input_ids", "label_ids")


SQUEEZE = 900


@query(f"SELECT doc_id, cast(piece AS BIGINT) AS ex_seq, cast(length(part) AS BIGINT) AS n_text, cast(length(part) - length(replace(part, ' ', '')) AS BIGINT) AS blanks FROM (SELECT doc_id, piece, substr(text, {SQUEEZE} * piece + 1, {SQUEEZE}) AS part FROM (SELECT doc_id, text, unnest(range((length(text) + {SQUEEZE - 1}) // {SQUEEZE})) AS piece FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\r]')))")
def user_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An objective that a user registers: parts of a text without their blanks, to be spelled out again. All of each text is used up by the fold."""

    def squeeze(ids, options, prompt, tok, rng):
        part, blank = ids[: options["most"]], tok.encode(" ")[0]
        return [*prompt, *(i for i in part if i != blank)], part, len(part)

    if "squeezing" not in config.REGISTERED:
        config.register("squeezing", squeeze, paradigm="<|SQUEEZE|>", most=SQUEEZE)
    texts = documents(spark, sf_dir).where(tokens.not_blank(F.col("text"))).withColumn("shard", sources.hashed_shard(F.col("doc_id"), shards(spark, sf_dir)))
    made = worker.fold(texts, worker.Run(tuple(config.normalised([config.objective("squeezing", minimum_remaining_space=2 * SQUEEZE + 16)])), 2048, ids=False), order=("doc_id",))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ex_seq")) - 1
    return made.select("doc_id", long(n).alias("ex_seq"), long("n_label").alias("n_text"), long(F.col("n_label") + len("<|SQUEEZE|>") - F.col("n_input")).alias("blanks"))


@query()
def coupled_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, objectives and rows in one fold per shard, leftovers included; failures are kept as rows."""
    entries = tuple(config.normalised([config.objective("next_token_prediction", 3), config.objective("copying", 2), config.objective("prefix_language_modeling", 2), config.objective("infilling", 2), config.objective("autoencoding", 1)]))
    texts = documents(spark, sf_dir).withColumn("shard", sources.hashed_shard(F.col("doc_id"), shards(spark, sf_dir)))
    return worker.fold(texts, worker.Run(entries, ROOM, strict=False, ids=False), order=("doc_id",)).drop("input_ids", "label_ids")


# ---- validation and feedback ----------------------------------------------------------------------------------------
@query(
    f"""WITH f AS (SELECT obj_idx, doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY obj_idx ORDER BY u, doc_id) AS r FROM (SELECT o.obj_idx, doc_id, text, {sql_uniform("'0:validation:' || o.obj_idx || ':' || doc_id")} AS u FROM documents, range(2) o(obj_idx) WHERE regexp_matches(text, '\\S'))) WHERE r <= 4),
    a AS (SELECT doc_id, 'next_token_prediction' AS objective, {sql_ids("'<|NTP|>' || substr(text, 1, 508)")} AS i, {sql_ids("substr(text, 1, 508)")} AS l FROM f WHERE obj_idx = 0 UNION ALL SELECT doc_id, 'copying', {sql_ids("'<|COPY|>' || substr(text, 1, 508)")}, {sql_ids("substr(text, 1, 508)")} FROM f WHERE obj_idx = 1)
    SELECT objective, doc_id AS item, md5(array_to_string({pad_sql('i', 0)}, ',')) AS input_md5, md5(array_to_string({pad_sql('l', -100)}, ',')) AS label_md5, cast({ROOM} AS BIGINT) AS mask_sum FROM a"""
)
def validation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validation.rows(documents(spark, sf_dir), [config.objective("next_token_prediction"), config.objective("copying")], 4, ROOM)
    return rows.select("objective", "item", digest(F.col("input_ids")).alias("input_md5"), digest(F.col("label_ids")).alias("label_md5"), F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("mask_sum"))


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "ts", F.col("event_type").alias("obj_key"), F.col("value").alias("loss"))


OBJECTIVES = ("click", "purchase", "view", "absent")
KEYS_SQL = "(VALUES (0, 'click'), (1, 'purchase'), (2, 'view'), (3, 'absent')) o(obj_idx, obj_key)"


def keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(OBJECTIVES)), "obj_idx int, obj_key string")


@query("SELECT event_type AS obj_key, round(avg(value), 6) AS mean_loss, count(value) AS n FROM events GROUP BY event_type")
def mean_validation_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.mean_losses(losses(spark, sf_dir)).select("obj_key", F.round("mean_loss", 6).alias("mean_loss"), "n")


@query(f"SELECT obj_idx, obj_key, round(coalesce(m, 0.0), 6) AS loss FROM {KEYS_SQL} LEFT JOIN (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type) e ON e.event_type = o.obj_key")
def loss_vector_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.loss_vector(keys(spark), feedback.mean_losses(losses(spark, sf_dir))).withColumn("loss", F.round("loss", 6))


@query(f"SELECT obj_key, cast(CASE WHEN obj_key = 'absent' THEN 0 ELSE 1000 * (obj_idx + 1) END AS BIGINT) AS n_expected, coalesce(n, 0) AS n, coalesce(n, 0) >= CASE WHEN obj_key = 'absent' THEN 0 ELSE 1000 * (obj_idx + 1) END AS fulfilled FROM {KEYS_SQL} LEFT JOIN (SELECT event_type, count(value) AS n FROM events GROUP BY event_type) e ON e.event_type = o.obj_key")
def fulfilled_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = keys(spark).select("obj_key", F.when(F.col("obj_key") == "absent", 0).otherwise(1000 * (F.col("obj_idx") + 1)).cast("long").alias("n_expected"))
    return feedback.fulfilled(feedback.mean_losses(losses(spark, sf_dir)), expected)


DAILY_SQL = "d AS (SELECT event_type AS obj_key, cast(ts AS DATE) AS day, avg(value) AS loss FROM events GROUP BY ALL), l AS (SELECT *, lag(loss) OVER (PARTITION BY obj_key ORDER BY day) AS old FROM d)"


@query(f"WITH {DAILY_SQL} SELECT obj_key, cast(day AS VARCHAR) AS day, round(loss, 6) AS loss, round(greatest(-1, least(1, coalesce(CASE WHEN isnan(r) THEN 0 ELSE r END, 0))), 5) + 0.0 AS reward FROM (SELECT *, -100 * tanh(sqrt(loss * old) * pow((loss - old) / (old + 1e-8), 3) * exp(1)) * exp(1) AS r FROM l WHERE old IS NOT NULL)")
def reward_from_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = losses(spark, sf_dir).groupBy("obj_key", F.to_date("ts").alias("day")).agg(F.avg("loss").alias("loss"))
    return feedback.rewards(daily, step="day").select("obj_key", F.col("day").cast("string").alias("day"), F.round("loss", 6).alias("loss"), (F.round("reward", 5) + F.lit(0.0)).alias("reward"))


RATE_SQL = "CASE WHEN event_id < 50 THEN 0.9 ELSE greatest(0.05, least(0.8, 0.425 + 0.375 * cos(pi() * least(greatest(event_id - 100, 0), 1899) / 1899.0))) END"


@query(f"SELECT event_id AS step, round({RATE_SQL}, 6) AS rate, {sql_uniform("'0:' || event_id % 128000")} < {RATE_SQL} AS explore, {sql_uniform("'0:' || event_id % 128000")} < 0.4 AND event_id <= 2000 AS fading FROM events")
def explore_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of every step, whether it explores, and whether it does by a schedule that ends."""
    step = F.col("event_id")
    rate = feedback.cosine_decay(step, 2000, 0.05, 0.8, warmup=100, cook=50, cook_value=0.9)
    return table(spark, sf_dir, "events", "event_id").select(step.alias("step"), F.round(rate, 6).alias("rate"), feedback.explores(step, rate, 2000, 0.05, 0.8).alias("explore"), feedback.explores(step, F.lit(0.4), 2000, 0.0, 0.4).alias("fading"))


@query("WITH o AS (SELECT cast(row_number() OVER (ORDER BY event_type, hour) AS INTEGER) AS obj_idx, event_type AS name FROM (SELECT DISTINCT event_type, hour(ts) AS hour FROM events WHERE hour(ts) < 3 * length(event_type))), c AS (SELECT name, min(obj_idx) AS f, count(*) AS n FROM o GROUP BY name), k AS (SELECT *, row_number() OVER (ORDER BY f) - 1 AS class_id, count(*) OVER () AS nc FROM c) SELECT obj_idx, name, cast(class_id AS INTEGER) AS class_id, round(nc / n, 6) AS weight FROM o JOIN k USING (name)")
def explore_class_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objectives are the kinds of events of each hour, classes the kinds; the longer a kind's name, the more hours count."""
    hour = F.hour("ts")
    found = table(spark, sf_dir, "events", "event_type", "ts").where(hour < 3 * F.length("event_type")).select(F.col("event_type").alias("name"), hour.alias("hour")).distinct()
    entries = found.select(F.row_number().over(Window.orderBy("name", "hour")).alias("obj_idx"), "name")  # 24 rows a kind at most
    return feedback.class_scaling(entries).withColumn("weight", F.round("weight", 6))


CANDIDATES_SQL = f"""v AS (SELECT obj_idx, coalesce(m, 0.0) AS loss FROM {KEYS_SQL} LEFT JOIN (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type) e ON e.event_type = o.obj_key),
    r AS (SELECT cand, obj_idx, loss, {sql_uniform("'0:' || cand || ':' || obj_idx")} AS u FROM range(16384) c(cand), v),
    w AS (SELECT cand, obj_idx, loss, loss * CASE WHEN cand < 4096 THEN u WHEN cand < 8192 THEN 5.0 / pow(1 - u, 1 / 3.0) WHEN cand < 12288 THEN 3.0 / pow(1 - u, 0.5) ELSE 2.0 / (1 - u) END AS x FROM r),
    s AS (SELECT *, CASE WHEN min(x) OVER (PARTITION BY cand) < 0 THEN x - min(x) OVER (PARTITION BY cand) ELSE x END AS y FROM w), a AS (SELECT cand, obj_idx, loss, y / sum(y) OVER (PARTITION BY cand) AS action FROM s)"""


def _losses_and_actions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vector = feedback.loss_vector(keys(spark), feedback.mean_losses(losses(spark, sf_dir))).select("obj_idx", "loss")
    return vector, feedback.candidates(spark, vector)


@query(f"WITH {CANDIDATES_SQL} SELECT cast(cand AS BIGINT) AS cand, obj_idx, round(action, 6) AS action FROM a")
def pareto_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _losses_and_actions(spark, sf_dir)[1].withColumn("action", F.round("action", 6))


@query(f"WITH {CANDIDATES_SQL}, t AS (SELECT cand, sum(action * (obj_idx + 1) * loss) AS total FROM a GROUP BY cand ORDER BY round(total, 9) DESC, cand LIMIT 8) SELECT obj_idx, round(avg(action), 6) AS action FROM a JOIN t USING (cand) GROUP BY obj_idx")
def topk_action_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector, actions = _losses_and_actions(spark, sf_dir)
    predicted = actions.join(F.broadcast(vector), "obj_idx").select("cand", "obj_idx", (F.col("action") * (F.col("obj_idx") + 1) * F.col("loss")).alias("reward"))
    totals = predicted.groupBy("cand").agg(F.round(F.sum("reward"), 9).alias("reward")).withColumn("obj_idx", F.lit(0))
    return feedback.best_mean(totals, actions).select("obj_idx", F.round("action", 6).alias("action"))


@query("SELECT event_type AS obj_key, round(sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END) / greatest(1, sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END)), 6) AS mean_loss FROM events GROUP BY event_type")
def masked_mean_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean losses over the events that have a label."""
    label = F.when(F.col("event_id") % 3 == 0, tokens.IGNORE).otherwise(1)
    return losses(spark, sf_dir).groupBy("obj_key").agg(F.round(statistics.masked_mean(F.col("loss"), label), 6).alias("mean_loss"))


@query("SELECT event_id AS step, event_id % 250 = 0 AND event_id <> 500 AS due FROM events")
def evaluation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id").select(F.col("event_id").alias("step"), feedback.due(F.col("event_id"), 250, F.lit(500)).alias("due"))


@query("SELECT l_orderkey, l_linenumber, round(-1 + (l_quantity - 1) / (49 + 1e-8) * 2, 6) + 0.0 AS remapped, round(CASE WHEN true THEN 2 + (l_discount - min(l_discount) OVER w) / (max(l_discount) OVER w - min(l_discount) OVER w + 1e-8) * 3 END, 6) AS stretched FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def remapped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d"))
    return lines.select("l_orderkey", "l_linenumber", (F.round(feedback.remap(F.col("q"), F.lit(1.0), F.lit(50.0), -1.0, 1.0), 6) + F.lit(0.0)).alias("remapped"), F.round(feedback.stretched(F.col("d"), 2.0, 5.0, "l_orderkey"), 6).alias("stretched"))


@query("SELECT event_type AS obj_key, '{\"obj_key\":\"' || event_type || '\",\"n\":' || count(value) || '}' AS status FROM events GROUP BY event_type")
def objective_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = feedback.mean_losses(losses(spark, sf_dir))
    return feedback.status_json(means, "obj_key", "n").select("obj_key", "status")


#: Objectives of the loop's queries, of two classes.
LOOP = ((0, "click", "deed"), (1, "purchase", "deed"), (2, "view", "look"), (3, "error", "look"), (4, "signup", "deed"))
REWARD_SQL = "greatest(-1, least(1, coalesce(CASE WHEN isnan(r) THEN 0 ELSE r END, 0)))"


def loop_sql(step: int, rate: float, seed: int = 0, strength: float = 0.1, objectives: tuple = LOOP, overall: bool = False) -> str:
    """A turn of the loop over daily losses: rewards, a ridge regression by moments, candidates, the best of them. overall: for the losses of all
    days, and with them, not for those of the last one."""
    from textloom.functions.hashrand import draw

    explored = draw(f"{seed}:explore:{step}") < rate
    first = "e.action" if explored else "u"
    kinds = {k: i for i, k in enumerate(dict.fromkeys(o[2] for o in objectives))}
    day = "cast(DATE '1970-01-01' + cast(step AS INTEGER) AS VARCHAR)" if overall else "step"  # what the hashed mixtures are keyed by
    number = " ".join(f"WHEN '{k}' THEN {i}" for k, i in kinds.items())
    return f"""WITH o AS (SELECT * FROM (VALUES {", ".join(map(str, objectives))}) t(obj_idx, obj_key, kind)),
    k AS (SELECT obj_idx, CASE kind {number} END AS class_id, count(*) OVER (PARTITION BY kind) AS size, {len(kinds)}.0 / count(*) OVER (PARTITION BY kind) AS weight FROM o),
    d AS (SELECT obj_idx, date_diff('day', DATE '1970-01-01', cast(ts AS DATE)) AS step, avg(value) AS loss FROM events JOIN o ON event_type = obj_key GROUP BY ALL),
    h AS (SELECT *, lag(loss) OVER (PARTITION BY obj_idx ORDER BY step) AS old FROM d),
    y AS (SELECT *, -100 * tanh(sqrt(loss * old) * pow((loss - old) / (old + 1e-8), 3) * exp(1)) * exp(1) AS r, {sql_uniform(f"'1:' || {day} || ':' || obj_idx")} AS action FROM h WHERE old IS NOT NULL),
    m AS (SELECT obj_idx, avg(old) AS mx, avg(action) AS ma, avg({REWARD_SQL}) AS my, covar_pop(old, old) + {strength} AS p, covar_pop(action, action) + {strength} AS q, covar_pop(old, action) AS xa, covar_pop(old, {REWARD_SQL}) AS xy, covar_pop(action, {REWARD_SQL}) AS ay FROM y GROUP BY obj_idx),
    b AS (SELECT obj_idx, mx, ma, my, (q * xy - xa * ay) / (p * q - xa * xa) AS by_loss, (p * ay - xa * xy) / (p * q - xa * xa) AS by_action FROM m),
    v AS ({'SELECT obj_idx, avg(value) AS loss FROM events JOIN o ON event_type = obj_key GROUP BY obj_idx' if overall else 'SELECT obj_idx, loss FROM d WHERE step = (SELECT max(step) FROM d)'}),
    ck AS (SELECT class_id, row_number() OVER (ORDER BY {sql_uniform(f"'{seed}:{step}:pick:' || class_id")}, class_id) AS r FROM (SELECT DISTINCT class_id FROM k)),
    ec AS (SELECT k.*, r, CASE WHEN {sql_uniform(f"'{seed}:count:{step}'")} < 0.5 THEN 1 ELSE 2 END AS n_pick, {sql_uniform(f"'{seed}:{step}:weight:' || obj_idx")} AS drawn FROM k JOIN ck USING (class_id)),
    e AS (SELECT obj_idx, CASE WHEN r <= n_pick THEN drawn / sum(drawn) OVER (PARTITION BY class_id) ELSE {len(objectives)}.0 / greatest(1, {len(objectives)} - n_pick) * 0.005 * n_pick / size END AS action FROM ec),
    g AS (SELECT cand, obj_idx, loss, {sql_uniform(f"'{seed}:' || cand || ':' || obj_idx")} AS u FROM range(16384) c(cand), v),
    w AS (SELECT cand, obj_idx, loss, loss * CASE WHEN cand < 4096 THEN {first} WHEN cand < 8192 THEN 5.0 / pow(1 - u, 1 / 3.0) WHEN cand < 12288 THEN 3.0 / pow(1 - u, 0.5) ELSE 2.0 / (1 - u) END AS x FROM g JOIN e USING (obj_idx)),
    a AS (SELECT cand, obj_idx, loss, (x - least(0, min(x) OVER (PARTITION BY cand))) / sum(x - 0) OVER (PARTITION BY cand) AS action FROM w),
    t AS (SELECT cand, round(sum(weight * tanh(by_loss * loss + by_action * action + my - by_loss * mx - by_action * ma)), 9) AS total FROM a JOIN b USING (obj_idx) JOIN k USING (obj_idx) GROUP BY cand ORDER BY total DESC, cand LIMIT 8),
    f AS (SELECT obj_idx, loss, loss * avg(action) AS x FROM a JOIN t USING (cand) GROUP BY obj_idx, loss)
    SELECT cast(obj_idx AS INTEGER) AS obj_idx, round(x / sum(x) OVER (), 4) AS prob, {'round(loss, 4) AS loss' if overall else f'{str(explored).lower()} AS explored'} FROM f"""


def daily_turns(spark: SparkSession, sf_dir: str, days: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Daily losses as the evaluations, hashes as the mixtures that led to them, and the objectives."""
    objectives = spark.createDataFrame(LOOP, "obj_idx int, obj_key string, kind string")
    daily = losses(spark, sf_dir).join(F.broadcast(objectives), "obj_key").groupBy("obj_idx", F.datediff("ts", F.lit("1970-01-01")).cast("long").alias("step")).agg(F.avg("loss").alias("loss"))
    if days is not None:
        daily = daily.join(F.broadcast(daily.select("step").distinct().orderBy("step").limit(days)), "step", "left_semi")
    tried = daily.select("step", "obj_idx", uniform(1, F.col("step"), F.col("obj_idx")).alias("action"))
    return daily, tried, objectives


def _turn(spark: SparkSession, sf_dir: str, step: int, rate: float, days: int | None = None, model=None) -> DataFrame:
    daily, tried, objectives = daily_turns(spark, sf_dir, days)
    return feedback.update_and_sample(spark, daily, tried, feedback.class_scaling(objectives, "kind"), step, rate, model)


@query(loop_sql(7, 0.0))
def learned_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn that learns and doesn't explore."""
    return _turn(spark, sf_dir, 7, 0.0)


@query(loop_sql(5, 1.0))
def explored_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn that explores: the drawn action is the base of the candidates."""
    return _turn(spark, sf_dir, 5, 1.0)


@query(f"SELECT obj_idx, round({sql_uniform("'1:' || date_diff('day', DATE '1970-01-01', (SELECT min(cast(ts AS DATE)) FROM events)) || ':' || obj_idx")}, 4) AS prob, false AS explored FROM (VALUES {", ".join(map(str, LOOP))}) t(obj_idx, obj_key, kind)")
def first_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn after the first evaluation, which leaves the mixture as it is."""
    return _turn(spark, sf_dir, 5, 1.0, days=1)


@query(
    f"""WITH o AS (SELECT * FROM (VALUES {", ".join(map(str, LOOP))}) t(obj_idx, obj_key, kind)),
    d AS (SELECT obj_idx, date_diff('day', DATE '1970-01-01', cast(ts AS DATE)) AS step, avg(value) AS loss FROM events JOIN o ON event_type = obj_key GROUP BY ALL),
    n AS (SELECT *, {sql_uniform("'1:' || step || ':' || obj_idx")} AS action FROM d WHERE step = (SELECT max(step) FROM d)),
    s AS (SELECT o.obj_idx, CASE WHEN o.obj_idx < 4 THEN obj_key ELSE 'objective_' || o.obj_idx END AS obj_key, CASE WHEN (SELECT count(*) FROM n) = {len(LOOP)} THEN action ELSE {1 / len(LOOP)} END AS prob, CASE WHEN (SELECT count(loss) FROM n) = {len(LOOP)} THEN loss END AS loss FROM o LEFT JOIN n USING (obj_idx))
    SELECT cast(obj_idx AS INTEGER) AS obj_idx, obj_key, round(prob, 6) AS prob, round(loss, 6) AS loss, obj_key || ': ' || printf('%.3f', prob) || CASE WHEN loss IS NULL THEN '' ELSE ' loss ' || printf('%.3f', loss) END AS told FROM s"""
)
def verbose_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture in force and the last losses, for people; the last objective has no name."""
    daily, tried, objectives = daily_turns(spark, sf_dir)
    named = objectives.withColumn("name", F.when(F.col("obj_idx") < 4, F.col("obj_key"))).select("obj_idx", "name")
    return feedback.verbose_action(named, tried, daily, "name").select("obj_idx", "obj_key", F.round("prob", 6).alias("prob"), F.round("loss", 6).alias("loss"), "told")


@query("SELECT event_id, try_cast(raw AS DOUBLE) AS number, CASE WHEN try_cast(raw AS DOUBLE) IS NULL THEN raw END AS kept, cast(length(event_type) AS INTEGER) AS n_letters, CASE WHEN value IS NULL THEN 0 ELSE 1 END AS n_values FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN regexp_extract(props, '([0-9]+)', 1) ELSE props END AS raw FROM events)")
def tolerant_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings that may be numbers, and columns as lists."""
    events = table(spark, sf_dir, "events", "event_id", "event_type", "value", "props")
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, F.col("event_type")).when(kind == 1, F.regexp_extract("props", "([0-9]+)", 1)).otherwise(F.col("props"))
    number, kept = casts.number_or_kept(raw)
    return events.select("event_id", number.alias("number"), kept.alias("kept"), F.size(casts.as_list(events, "event_type")).alias("n_letters"), F.size(casts.as_list(events, "value")).alias("n_values"))


@query()
def history_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn that learns from the losses of all objectives, the present ones and those of two evaluations before."""
    return _turn(spark, sf_dir, 7, 0.0, model=predictor.NetPredictor())


NAMED_SQL = "SELECT user_id % 10 AS obj_idx, CASE WHEN user_id % 10 < 3 THEN ['click', 'view', 'none'][user_id % 10 + 1] END AS nickname, CASE WHEN user_id % 10 < 6 THEN 'purchase' END AS hash, CASE WHEN user_id % 10 < 9 THEN 'signup' ELSE 'none' END AS name FROM events GROUP BY ALL"


@query(f"SELECT obj_idx, coalesce(nickname, hash, name) AS obj_key, round(coalesce(m, 0.0), 6) AS loss FROM ({NAMED_SQL}) LEFT JOIN (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type) ON event_type = coalesce(nickname, hash, name)")
def losses_by_nickname(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objectives look for their loss under their nickname, else their hash, else their name."""
    i = F.col("obj_idx")
    named = table(spark, sf_dir, "events", (F.col("user_id") % 10).alias("obj_idx")).distinct()
    named = named.select("obj_idx", F.when(i == 0, "click").when(i == 1, "view").when(i == 2, "none").alias("nickname"), F.when(i < 6, "purchase").alias("hash"), F.when(i < 9, "signup").otherwise("none").alias("name"))
    found = feedback.losses_by_name(named, feedback.mean_losses(losses(spark, sf_dir)), "nickname", "hash", "name")
    return found.select("obj_idx", F.coalesce("nickname", "hash", "name").alias("obj_key"), F.round("loss", 6).alias("loss"))


@query(loop_sql(0, 0.0, objectives=tuple((i, k, k) for i, k in enumerate(OBJECTIVES)), overall=True))
def next_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole round: daily losses become rewards, a predictor is fitted on them, and the best candidates give the next mixture."""
    daily = losses(spark, sf_dir).join(F.broadcast(keys(spark)), "obj_key").groupBy("obj_idx", F.to_date("ts").alias("day")).agg(F.avg("loss").alias("loss"))
    action = uniform(1, F.col("day"), F.col("obj_idx"))
    history = feedback.rewards(daily, "obj_idx", "day").select(F.datediff("day", F.lit("1970-01-01")).cast("long").alias("step"), "obj_idx", "old_loss", action.alias("action"), "reward")
    vector, actions = _losses_and_actions(spark, sf_dir)
    seen = vector.join(history.select("obj_idx").distinct(), "obj_idx", "left_semi")
    classes = feedback.class_scaling(keys(spark), "obj_key")
    return feedback.next_mixture(seen, feedback.RidgePredictor().fit(history), actions.join(F.broadcast(seen.select("obj_idx")), "obj_idx"), classes)


@query(f"SELECT cast(l_orderkey AS BIGINT) AS l_orderkey, l_linenumber, round(2.0 / pow(1 - {sql_uniform("'3:' || l_orderkey || ':' || l_linenumber")}, 1 / 2.0), 6) AS draw FROM lineitem")
def pareto_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    return lines.select("l_orderkey", "l_linenumber", F.round(pareto(uniform(3, F.col("l_orderkey"), F.col("l_linenumber")), 2.0, 2.0), 6).alias("draw"))
