"""Operator 8, token counts under edits: a segment tree over the pre-tokens of each document.

Leaf i holds the characters and tokens of pre-token i, an inner node the sums of its children. An edit finds its place by the characters and goes back
to a leaf before which no pre-token can depend on what changed: a match of the public pattern looks LOOK characters past its end at most, or past the white
space there. From that leaf on, pre-tokens are matched in the new text until one ends where an old leaf ended behind the edit; the
changed leaves walk up to the root, and the rest of the document isn't read again. If there are more pre-tokens than leaves, the last leaf holds several, up to
MAX_RUN; beyond that the leaves are laid out anew, but only the touched text is encoded.

The index is a table (text and leaves by document), so counts can be kept and updated as edits come.

Defined results: a null text is empty and has no tokens. Edits are applied in order, each to the text that the ones before have
left; null edits, and null fields within one (0, 0 and empty), change nothing; places beyond the end mean the end. Repeated rows are
documents of their own. Ties among edits of equal order go by place, then length, then text. An empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm._common import PIECES, WHITE_SPACE, Memo, lean, read, slices
from textloom.llm._public_bpe import PublicBpe, public_bpe

#: Characters that the end of a pre-token may depend on: those of the longest contraction.
LOOK = 3
#: Pre-tokens that one leaf may hold before the leaves are laid out anew.
MAX_RUN = 64
#: Edits of each document in the registered query, and their longest deletion and insertion in characters.
EDITS, REMOVED, INSERTED = 3, 40, 60

BLANKS = re.compile(f"[{WHITE_SPACE}]*")
EDIT = "array<struct<start:int,removed:int,inserted:string>>"


class CountTree:
    """Sums of characters and tokens over the leaves of one document."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.layout(np.asarray(chars, dtype=np.int64), np.asarray(tokens, dtype=np.int64))

    def layout(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        if not len(chars):  # an empty text is one empty leaf
            chars, tokens = np.zeros((2, 1), dtype=np.int64)
        self.n = len(chars)
        self.width = 1 << max(0, self.n - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), dtype=np.int64)
        self.sums[self.width : self.width + self.n, 0], self.sums[self.width : self.width + self.n, 1] = chars, tokens
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before that leaf."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            left = int(self.sums[node, 0])
            if char - before >= left:
                before += left
                node += 1
        return node - self.width, before

    def replace(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """Puts new pieces in the place of leaves first..last."""
        room = last - first + 1
        if len(chars) > room - 1 + MAX_RUN:
            held = self.sums[self.width : self.width + self.n]
            new = np.array([chars, tokens], dtype=np.int64).T
            whole = np.concatenate([held[:first], new, held[last + 1 :]])
            whole = whole[whole[:, 0] > 0]
            self.layout(whole[:, 0], whole[:, 1])
            return
        spread = np.zeros((room, 2), dtype=np.int64)
        k = min(room, len(chars))
        spread[:k, 0], spread[:k, 1] = chars[:k], tokens[:k]
        if len(chars) > room:
            spread[-1] += (sum(chars[room:]), sum(tokens[room:]))
        self.sums[self.width + first : self.width + last + 1] = spread
        low, high = (self.width + first) >> 1, (self.width + last) >> 1
        while low:
            self.sums[low : high + 1] = self.sums[2 * low : 2 * high + 2 : 2] + self.sums[2 * low + 1 : 2 * high + 2 : 2]
            low, high = low >> 1, high >> 1


def edit(coder: PublicBpe, text: str, tree: CountTree, start: int, removed: int, inserted: str) -> tuple[str, int]:
    """Applies one edit to a text and its tree; the new text and how many characters were encoded again."""
    start = min(max(0, start), len(text))
    stop = min(len(text), start + max(0, removed))
    if start == stop and not inserted:
        return text, 0
    first, begin = tree.find(start - 1) if start else (0, 0)
    while begin and BLANKS.match(text, begin, start).end() + LOOK > start:
        first, begin = tree.find(begin - 1)
    at, edge = tree.find(stop) if stop < len(text) else (tree.n, len(text))
    size = lambda leaf: int(tree.sums[tree.width + leaf, 0])
    new, moved = text[:start] + inserted + text[stop:], len(inserted) - (stop - start)
    chars, tokens, end = [], [], begin
    for match in coder.pre.finditer(new, begin):
        chars.append(len(match[0]))
        tokens.append(coder.counts[match[0]])
        end = match.end()
        while edge < end - moved and at < tree.n:
            edge += size(at)
            at += 1
        if end - moved >= stop and edge == end - moved and at > first:
            break
    else:
        at = tree.n
    tree.replace(first, at - 1, chars, tokens)
    return new, end - begin


def leaves(coder: PublicBpe) -> Memo:
    """Characters and tokens of the pre-tokens of a piece (white space and the text behind it), remembered."""

    def of(piece: str) -> tuple[list[int], list[int]]:
        parts = coder.pre.findall(piece)
        return list(map(len, parts)), list(map(coder.counts.__getitem__, parts))

    return Memo(of, 200_000)


def build_index(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", edits: Column | None = None) -> DataFrame:
    """doc_id, text, chars and tokens of the leaves; edits: a column of edits to carry along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = public_bpe(path, pattern)
        known = leaves(coder)
        for batch in slices(batches):
            cut = [list(map(known.__getitem__, PIECES.findall(t))) for t in batch.column("text").to_pylist()]
            chars, tokens = ([[n for piece in pieces for n in piece[i]] for pieces in cut] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(chars, type=pa.list_(pa.int32())), pa.array(tokens, type=pa.list_(pa.int32())), batch.column("edits")], names=["doc_id", "text", "leaf_chars", "leaf_tokens", "edits"])

    edits = F.lit(None) if edits is None else edits
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), edits.cast(EDIT).alias("edits")).mapInArrow(lean(run), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, text string, leaf_chars array<int>, leaf_tokens array<int>, edits {EDIT}")


def attach_edits(index: DataFrame, edits: DataFrame) -> DataFrame:
    """An index with its edits (doc_id, seq, start, removed, inserted) in order, for `recount`."""
    order = F.array_sort(F.collect_list(F.struct("seq", F.col("start").cast("int").alias("start"), F.col("removed").cast("int").alias("removed"), "inserted")))
    by_doc = edits.groupBy("doc_id").agg(F.transform(order, lambda e: F.struct(e["start"].alias("start"), e["removed"].alias("removed"), e["inserted"].alias("inserted"))).alias("edits"))
    return index.drop("edits").join(by_doc, "doc_id", "left")


def recount(index: DataFrame, path: str, pattern: str) -> DataFrame:
    """The index after its edits, with token counts before and after and the characters that were encoded again."""
    schema = f"doc_id {index.schema['doc_id'].dataType.simpleString()}, text string, leaf_chars array<int>, leaf_tokens array<int>, n_edits long, tokens_before long, n_tokens long, encoded_again long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = public_bpe(path, pattern)
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(7)]
            for text, chars, tokens, edits in zip(batch.column("text").to_pylist(), batch.column("leaf_chars"), batch.column("leaf_tokens"), batch.column("edits").to_pylist(), strict=True):
                tree = CountTree(np.asarray(chars.values), np.asarray(tokens.values))
                before, again, edits = tree.tokens, 0, [e for e in edits or [] if e]
                for e in edits:
                    text, n = edit(coder, text, tree, e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
                    again += n
                leaves = tree.sums[tree.width : tree.width + tree.n]
                for column, value in zip(out, (text, leaves[:, 0], leaves[:, 1], len(edits), before, tree.tokens, again), strict=True):
                    column.append(value)
            types = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, type=t) for c, t in zip(out, types, strict=True))], names=["doc_id", "text", "leaf_chars", "leaf_tokens", "n_edits", "tokens_before", "n_tokens", "encoded_again"])

    return index.mapInArrow(lean(run), schema)


def planned_edits(doc_id: str = "doc_id", text: str = "text", n: int = EDITS) -> Column:
    """Edits that a hash of the document's id chooses: place, length, and a passage of the text itself to insert."""
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    draw = lambda k, what, below: F.pmod(F.xxhash64(F.col(doc_id), F.lit(3 * k + what)), below).cast("int")
    one = lambda k: F.struct(draw(k, 0, size + 1).alias("start"), draw(k, 1, F.lit(REMOVED + 1)).alias("removed"), F.substring(F.coalesce(F.col(text), F.lit("")), draw(k, 2, size + 1) + 1, F.lit(INSERTED // (k + 1))).alias("inserted"))
    return F.array(*(one(k) for k in range(n)))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after EDITS edits each, and the edited text's digest."""
    import public_tokenizers as P

    path, pattern = P.path("byte_bpe_50k.json"), P.PATTERN
    index = build_index(read(spark, sf_dir, "documents"), path, pattern, edits=planned_edits())
    return recount(index, path, pattern).select("doc_id", "n_edits", "tokens_before", "n_tokens", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "encoded_again")
