"""Operator 9, language identification: a linear-chain conditional random field over the words of a text.

Words are runs of letters. A word's features are its affixes (n-grams that touch its ends), its inner n-grams and itself
(lexicon), hashed to one table of weights; with learned transitions between labels, forward-backward gives every word the
probability of each language, also where a text switches. A document's language is the one of the largest mean probability, and
the score is that mean.

The field is fitted on a bounded sample of labelled rows: about SAMPLE documents per language, SAMPLE_CHARS characters of each, from
a place that a hash chooses; segments of different documents are put in one sequence, so that switches are learned. Prediction
covers every word of every whole text; it is one pass without shuffles. A text of over LONG characters is read in parts, twice: forward,
keeping the message at each border, and from the last part to the first, so that only one part's words are held.

The score compares learned labels with each other, so it can't tell that a text is in none of them. `keep_known` therefore judges
by evidence: the mean log-likelihood of a letter under the byte trigrams of the language that suits each word best. Each word
has its own language, so switching costs little, and the bound comes from texts held out of the sample, not from the number of labels.

Defined results: `und` with score 0 for a null text, one without a letter, and if there was nothing to learn from. Equal
probabilities go to the language that sorts first. Rows are judged each by itself, so repeated rows agree. Rows with a null
language are not learned from. All other languages are learned, so the model grows with their number. Other columns are passed on
unread; clashing names of new columns raise.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textloom.llm._common import fresh, lean, read, slices

SAMPLE = 250
SAMPLE_CHARS = 3000
#: Characters of a text that is read in parts, and of a part.
LONG, PART = 2_000_000, 500_000
#: Bits of the table of weights, and the n-grams (in bytes, ends of words included).
BITS = 17
GRAMS = (2, 3, 4, 5)
EPOCHS = 40
RATE = 0.3
DECAY = 1e-4
UNKNOWN = "und"
#: Evidence: weight of an unseen trigram; how far below the median of held-out texts a text may lie (natural logarithms a letter),
#: and how much farther if it is short (over the root of its length).
UNSEEN = 0.05
MARGIN, SHORT = 1.0, 4.0
LETTERS = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    weights: np.ndarray  # 2**BITS x labels
    transitions: np.ndarray  # labels x labels, logarithms
    start: np.ndarray
    trigrams: np.ndarray | None = None  # 2**BITS x labels, logarithms of counts
    pairs: np.ndarray | None = None  # 2**16 x labels, of the bytes before
    usual: float = 0.0  # median evidence of held-out texts


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    found = LETTERS.findall(text.lower())
    return found if any(c.isalpha() for w in found for c in w) else []


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words, and the word that each belongs to."""
    raw = [b"\x02" + w.encode("utf-8") + b"\x03" for w in words]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    index = [(np.array([zlib.crc32(r) for r in raw], dtype=np.uint64) + np.uint64(1 << 60)) * _MIX >> np.uint64(64 - BITS)]
    belongs = [np.arange(len(raw))]
    for n in GRAMS:
        if len(data) < n:
            continue
        code = np.full(len(data) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            code = code << np.uint64(8) | data[k : len(data) - n + 1 + k]
        inside = owner[: len(code)] == owner[n - 1 :]
        index.append(code[inside] * _MIX >> np.uint64(64 - BITS))
        belongs.append(owner[: len(code)][inside])
    return np.concatenate(index).astype(np.int64), np.concatenate(belongs)


def _emissions(weights: np.ndarray, index: np.ndarray, belongs: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(belongs, weights=weights[index, j], minlength=n) for j in range(weights.shape[1])], axis=1)


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words' byte trigrams and of the pairs that begin them, and the word of each."""
    raw = [b"\x02" + w.encode("utf-8") + b"\x03" for w in words]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    code = data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]
    inside = owner[:-2] == owner[2:]
    code = code[inside]
    return (code * _MIX >> np.uint64(64 - BITS)).astype(np.int64), (code >> np.uint64(8)).astype(np.int64), owner[:-2][inside]


def _tables(rows: list[tuple[int, list[str]]], m: int) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of smoothed trigram and pair counts of (label, words) rows."""
    three, two = np.zeros((1 << BITS, m)), np.zeros((1 << 16, m))
    for label, words in rows:
        if words:
            t, p, _ = _trigrams(words)
            three[:, label] += np.bincount(t, minlength=1 << BITS)
            two[:, label] += np.bincount(p, minlength=1 << 16)
    return np.log(three + UNSEEN).astype(np.float32), np.log(two + UNSEEN * 256).astype(np.float32)


def _evidence(tables: tuple[np.ndarray, np.ndarray], words: list[str]) -> np.ndarray:
    """Of each word: the log-likelihood under the label that suits it best, and the number of its trigrams."""
    t, p, owner = _trigrams(words)
    each = np.stack([np.bincount(owner, weights=tables[0][t, j] - tables[1][p, j], minlength=len(words)) for j in range(tables[0].shape[1])], axis=1)
    return np.stack([each.max(axis=1), np.bincount(owner, minlength=len(words))], axis=1)


def _usual(rows: list[tuple[int, list[str]]], m: int) -> float:
    """The median evidence of texts under tables of other texts; of the same ones if there is but one."""
    rows = list({tuple(ws): (label, ws) for label, ws in rows if ws}.values())
    halves = [rows[0::2], rows[1::2]] if len(rows) > 1 else [rows, rows]
    means = []
    for mine, other in (halves, halves[::-1]):
        tables = _tables(other, m)
        means += [e[0] / e[1] for e in (_evidence(tables, ws).sum(axis=0) for _, ws in mine)]
    return float(np.median(means))


def forward_backward(emit: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities of all words of many sequences laid end to end; also the scaled forward and backward messages.
    All sequences go forward in step, the longest first, so a step costs little however many there are."""
    pull = np.exp(emit - emit.max(axis=1, keepdims=True))
    step = np.exp(transitions)
    begins = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
    ahead, back = np.empty_like(pull), np.ones_like(pull)
    for t, k in enumerate(active.tolist()):
        rows = begins[:k] + t
        now = pull[rows] * (np.exp(start) if t == 0 else ahead[rows - 1] @ step)
        ahead[rows] = now / now.sum(axis=1, keepdims=True)
    for t in range(len(active) - 2, -1, -1):
        rows = begins[: active[t + 1]] + t
        now = (pull[rows + 1] * back[rows + 1]) @ step.T
        back[rows] = now / now.sum(axis=1, keepdims=True)
    both = ahead * back
    return both / both.sum(axis=1, keepdims=True), ahead, pull * back


def marginals(emit: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The label probabilities alone, with one array beside the emissions: the backward messages are kept for one step only."""
    pull = np.exp(emit - emit.max(axis=1, keepdims=True))
    step, first = np.exp(transitions), np.exp(start)
    begins = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
    chance = np.empty_like(pull)
    for t, k in enumerate(active.tolist()):
        rows = begins[:k] + t
        now = pull[rows] * (first if t == 0 else chance[rows - 1] @ step)
        chance[rows] = now / now.sum(axis=1, keepdims=True)
    back = np.ones((len(lengths), pull.shape[1]))  # of each sequence, at its current place
    for t in range(len(active) - 2, -1, -1):
        k = active[t + 1]
        rows = begins[:k] + t
        now = (pull[rows + 1] * back[:k]) @ step.T
        back[:k] = now / now.sum(axis=1, keepdims=True)
        both = chance[rows] * back[:k]
        chance[rows] = both / both.sum(axis=1, keepdims=True)
    return chance


@dataclass(frozen=True)
class Field:
    """Labelled sequences: features of distinct words, the words (ids) and labels (gold) of all sequences end to end, and their lengths."""

    index: np.ndarray
    belongs: np.ndarray
    ids: np.ndarray
    gold: np.ndarray
    lengths: np.ndarray
    n: int
    m: int

    @cached_property
    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where sequences begin, the words behind the first, and how often each pair of labels is seen."""
        first = np.cumsum(self.lengths) - self.lengths
        later = np.setdiff1d(np.arange(len(self.ids)), first)
        seen = np.zeros((self.m, self.m))
        np.add.at(seen, (self.gold[later - 1], self.gold[later]), 1)
        return first, later, seen

    def gradient(self, weights: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The gradient of the log-likelihood of the labels by weights, transitions and start: what is seen less what is expected."""
        first, later, seen = self.places
        emit = _emissions(weights, self.index, self.belongs, self.n)[self.ids]
        chance, ahead, pulled = forward_backward(emit, self.lengths, trans, start)
        off = -chance
        off[np.arange(len(self.ids)), self.gold] += 1
        by_word = np.stack([np.bincount(self.ids, weights=off[:, j], minlength=self.n) for j in range(self.m)], axis=1)
        step = np.exp(trans)
        z = ((ahead[later - 1] @ step) * pulled[later]).sum(axis=1, keepdims=True)
        expected = step * (ahead[later - 1].T @ (pulled[later] / z))
        by_feature = np.stack([np.bincount(self.index, weights=by_word[self.belongs, j], minlength=len(weights)) for j in range(self.m)], axis=1)
        return by_feature, seen - expected, off[first].sum(axis=0)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum()


def forward(emit: np.ndarray, transitions: np.ndarray, start: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """The forward messages of one part of a sequence, given the last one before it (None at the beginning)."""
    pull, step, out = np.exp(emit - emit.max(axis=1, keepdims=True)), np.exp(transitions), np.empty_like(emit)
    for t in range(len(pull)):
        out[t] = before = _scaled(pull[t] * (np.exp(start) if before is None else before @ step))
    return out


def backward(emit: np.ndarray, transitions: np.ndarray, after: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The backward messages of one part, given that of the word behind it with its pull (None at the end); and the part's own for the part before."""
    pull, step, out = np.exp(emit - emit.max(axis=1, keepdims=True)), np.exp(transitions), np.ones_like(emit)
    for t in range(len(pull) - 1, -1, -1):
        if after is not None:
            out[t] = _scaled(step @ after)
        after = pull[t] * out[t]
    return out, after


def train(rows: list[tuple[str, str]]) -> Model | None:
    """Fits the field to (language, text) rows by its gradient (AdaGrad)."""
    labels = tuple(sorted({lang for lang, _ in rows}))
    rng = np.random.default_rng(0)
    segments = []
    for lang, text in rows:
        ws, at = words_of(text), 0
        while at < len(ws):
            n = int(rng.integers(6, 40))
            segments.append((labels.index(lang), ws[at : at + n]))
            at += n
    if not segments:
        return None
    segments = [segments[i] for i in rng.permutation(len(segments))]
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for _, ws in segments for w in ws])
    gold = np.repeat([lab for lab, _ in segments], [len(ws) for _, ws in segments])
    sizes = [len(ws) for _, ws in segments]
    lengths = np.add.reduceat(sizes, np.arange(0, len(sizes), 4))
    index, belongs = _features(list(known))
    m, n = len(labels), len(known)
    field = Field(index, belongs, ids, gold, lengths, n, m)
    weights, trans, start = np.zeros((1 << BITS, m)), np.zeros((m, m)), np.zeros(m)
    sums = [np.full_like(x, 1e-6) for x in (weights, trans, start)]
    for _ in range(EPOCHS):
        pull = field.gradient(weights, trans, start)
        scales = (1 / len(ids), 1 / len(ids), 1 / len(lengths))
        for value, total, slope, scale in zip((weights, trans, start), sums, pull, scales, strict=True):
            slope = slope * scale - DECAY * value
            total += slope * slope
            value += RATE * slope / np.sqrt(total)
    texts = [(labels.index(lang), words_of(text)) for lang, text in rows]
    return Model(labels, weights.astype(np.float32), trans, start, *_tables(texts, m), _usual(texts, m))


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model from a bounded sample of the rows for which `learn` holds; None if they have no labelled word."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), learn.alias("learn")).where("learn and text is not null and lang is not null").drop("learn")
    langs = rows.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).orderBy("lang").collect()
    if not langs:
        return None
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_003))
    share = F.create_map(*(F.lit(x) for r in langs for x in (r["lang"], min(1.0, 1.5 * sample / max(1, r["n"])))))[F.col("lang")]
    start = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    chosen = rows.where(place < share * 1_000_003).select("lang", F.substring("text", start.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"), F.xxhash64("text").alias("place"))
    chosen = chosen.groupBy("lang", "place").agg(F.min("text").alias("text"))  # copies count once
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    chosen = chosen.withColumn("rank", rank).where(F.col("rank") <= 2 * sample)
    return train([(r["lang"], r["text"]) for r in chosen.orderBy("place", "lang").collect()])


class _Scorer:
    """Words' emissions, and behind them their evidence if asked, remembered for at most `most` words."""

    def __init__(self, model: Model, evidence: bool = False, most: int = 300_000):
        self.model, self.evidence, self.most = model, evidence, most
        self.known: dict[str, int] = {}
        self.emit = np.zeros((0, len(model.labels) + 2 * evidence))

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
            self.emit = self.emit[:0]
        new = list({w for w in words if w not in known})
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            parts = [self.emit]
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                found = _emissions(self.model.weights, *_features(part), len(part))
                parts.append(np.hstack([found, _evidence((self.model.trigrams, self.model.pairs), part)]) if self.evidence else found)
            self.emit = np.concatenate(parts)
        return self.emit[np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))]


def _borders(text: str) -> Iterator[tuple[int, int]]:
    """Where the parts of a long text that hold words begin and end; none is cut within a run of letters."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PART)
        while end < len(text) and text[end - 1].isalpha() and text[end].isalpha():
            end += 1
        if words_of(text[at:end]):
            yield at, end
        at = end


def _judge_long(text: str, scorer: _Scorer, model: Model) -> tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a long text: the number of words, the sum of their label probabilities and of their evidence, and the best label of each word by part."""
    m, cuts, borders, evidence = len(model.labels), list(_borders(text)), [None], np.zeros(2)
    for x, y in cuts:
        got = scorer.of(words_of(text[x:y]))
        borders.append(forward(got[:, :m], model.transitions, model.start, borders[-1])[-1])
        evidence = evidence + (got[:, m:].sum(axis=0) if scorer.evidence else 0)
    total, best, n, after = np.zeros(m), [], 0, None
    for before, (x, y) in zip(borders[-2::-1], cuts[::-1], strict=True):
        emit = scorer.of(words_of(text[x:y]))[:, :m]
        back, after = backward(emit, model.transitions, after)
        chance = forward(emit, model.transitions, model.start, before) * back
        chance /= chance.sum(axis=1, keepdims=True)
        total, n = total + chance.sum(axis=0), n + len(chance)
        best.append(chance.argmax(axis=1).astype(np.int32))
    return n, total, evidence, best[::-1]


def predict(docs: DataFrame, model: Model | None, text: str = "text", into: tuple[str, str] = ("lang_pred", "score"), spans: str | None = None, evidence: str | None = None) -> DataFrame:
    """docs with the predicted language and its score; spans: also a column of runs of words (first word, words, language);
    evidence: also how far a text's evidence lies above the bound (below it: negative; without words: null)."""
    if {*into, spans, evidence} & set(docs.columns):
        raise ValueError("docs has one of the new columns already")
    fields = [*docs.schema.fields, T.StructField(into[0], T.StringType(), False), T.StructField(into[1], T.DoubleType(), False)]
    kind = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("lang", T.StringType())]))
    schema = T.StructType([*fields, *([T.StructField(spans, kind)] if spans else []), *([T.StructField(evidence, T.DoubleType())] if evidence else [])])

    def runs(best: np.ndarray) -> list[dict]:
        at = np.flatnonzero(np.diff(best, prepend=-1))
        return [{"first": int(a), "words": int(b - a), "lang": model.labels[best[a]]} for a, b in zip(at, [*at[1:], len(best)], strict=True)]

    def lies_above(e: np.ndarray) -> float:
        return float(e[0] / e[1] - model.usual + MARGIN + SHORT / np.sqrt(e[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model, bool(evidence)) if model else None
        for batch in slices(batches, chars=4_000_000, column=text):
            texts = batch.column(text).to_pylist()
            lists = [words_of(t) if model and len(t or "") <= LONG else [] for t in texts]
            lengths = np.array([len(ws) for ws in lists])
            some = np.flatnonzero(lengths)
            lang, score = [UNKNOWN] * len(lists), np.zeros(len(lists))
            switched: list[list[dict]] = [[] for _ in lists]
            above: list[float | None] = [None] * len(lists)
            if len(some):
                n = lengths[some]
                words = scorer.of([w for ws in lists for w in ws])
                if evidence:
                    for i, e in zip(some.tolist(), np.add.reduceat(words[:, -2:], np.cumsum(n) - n, axis=0), strict=True):
                        above[i] = lies_above(e)
                    words = words[:, :-2]
                chance = marginals(words, n, model.transitions, model.start)
                mean = np.add.reduceat(chance, np.cumsum(n) - n, axis=0) / n[:, None]
                best = mean.argmax(axis=1)
                score[some] = np.minimum(mean[np.arange(len(some)), best], 1)
                for i, b in zip(some.tolist(), best.tolist(), strict=True):
                    lang[i] = model.labels[b]
                if spans:
                    for i, part in zip(some.tolist(), np.split(chance.argmax(axis=1), np.cumsum(n)[:-1]), strict=True):
                        switched[i] = runs(part)
            for i, t in enumerate(texts) if model else ():
                if len(t or "") > LONG:
                    n, total, seen, best = _judge_long(t, scorer, model)
                    if n:
                        lang[i], score[i] = model.labels[total.argmax()], min(1.0, total.max() / n)
                        above[i] = lies_above(seen) if evidence else None
                        switched[i] = runs(np.concatenate(best)) if spans else []
            columns = [*batch.columns, pa.array(lang), pa.array(score)]
            if spans:
                columns.append(pa.array(switched, type=pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))))
            if evidence:
                columns.append(pa.array(above, type=pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(lean(run), schema)


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """The fold of a document: a checksum of its id as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents in learned languages, with all their columns. Switching between them is no reason to go; a text whose words
    look like none of them is, whatever the number of languages."""
    model = fit(docs, F.lit(True))
    lang, score, above = fresh(docs, "lang_pred"), fresh(docs, "lang_score"), fresh(docs, "lang_evidence")
    return predict(docs, model, into=(lang, score), evidence=above).where((F.col(lang) != UNKNOWN) & (F.col(above) >= 0)).drop(lang, score, above)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold() == 0
    model = fit(docs, ~held_out)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
