"""Tokens. Characters are column expressions: a token is a code point plus OFFSET; ids below OFFSET are special. Other vocabularies are
objects with `encode` and `decode`, which tasks use in Arrow batches."""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids reserved before the characters, and the label that no loss is taken at.
OFFSET = 3
IGNORE = -100


def encode(text: Column) -> Column:
    """A text's token ids; an empty text has none."""
    return F.when(F.length(text) > 0, F.transform(F.split(text, ""), lambda c: F.ascii(c) + OFFSET)).otherwise(F.array().cast("array<int>"))


def character_ids(text: str) -> np.ndarray:
    """The same in Python."""
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int32) + OFFSET


def decode(ids: Column) -> Column:
    """The text of token ids; special ids are dropped. Texts of code points below 256 go character by character; others at once, behind a byte order mark, so
    that one in the text stays."""
    kept = F.filter(ids, lambda i: i >= OFFSET)
    short = F.array_join(F.transform(kept, lambda i: F.char(i - OFFSET)), "")
    wide = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.array_join(F.transform(kept, lambda i: F.lpad(F.hex(i - OFFSET), 8, "0")), ""))), "UTF-32")
    return F.when(F.array_max(ids) < OFFSET + 256, short).otherwise(wide)


def prompt_ids(prompt: str) -> Column:
    """A fixed prompt as a literal array."""
    return F.array(*(F.lit(ord(c) + OFFSET) for c in prompt)).cast("array<int>")


def split_at(text: Column, room: Column) -> tuple[Column, Column]:
    """What fits in `room` tokens, and the rest. No room: nothing fits and all is rest."""
    room = F.greatest(room, F.lit(0)).cast("int")
    return F.substring(text, F.lit(1), room), F.substring(text, room + 1, F.greatest(F.length(text) - room, F.lit(0)))


def joined(ids: Column) -> Column:
    """An array of ids as one string."""
    return F.array_join(ids.cast("array<string>"), ",")


def check(text: Column, room: int, min_room: int, min_length: int, max_length: int) -> Column:
    """The status that a text has before it is transformed; a negative bound (or a bound of 0 for the room) is off."""
    n = F.length(text)
    status = F.lit("ok")
    if max_length >= 0:
        status = F.when(n > max_length, "error").otherwise(status)
    if min_length >= 0:
        status = F.when(n < min_length, "error").otherwise(status)
    if min_room > 0 and 0 <= room < min_room:
        status = F.lit("not_enough_space")
    return F.when(text.isNull(), "error").otherwise(status)


def not_blank(text: Column) -> Column:
    """Whether a text has a character that isn't white space."""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


@dataclass(frozen=True)
class Characters:
    """The character tokens, for tasks."""

    def encode(self, text: str) -> list[int]:
        return [ord(c) + OFFSET for c in text]

    def decode(self, ids: list[int]) -> str:
        return "".join(chr(i - OFFSET) for i in ids if i >= OFFSET)

    def whole(self, ids: list[int], at: int) -> int:
        """The last place up to `at` where no character is cut."""
        return at


@lru_cache(maxsize=4)
def _ranked(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass(frozen=True)
class BytePairs:
    """A byte-level vocabulary from a rank file that every executor has; OFFSET ids stay free for special ones. A task reads it once."""

    path: str
    pattern: str

    def encode(self, text: str) -> list[int]:
        return [i + OFFSET for i in _ranked(self.path, self.pattern).encode_ordinary(text)]

    def decode(self, ids: list[int]) -> str:
        return _ranked(self.path, self.pattern).decode([i - OFFSET for i in ids if i >= OFFSET])

    def whole(self, ids: list[int], at: int) -> int:
        """The last place up to `at` where no character is cut: no token from there on begins within one."""
        coder = _ranked(self.path, self.pattern)
        while 0 < at < len(ids) and coder.decode_single_token_bytes(ids[at] - OFFSET)[0] & 0xC0 == 0x80:
            at -= 1
        return at
