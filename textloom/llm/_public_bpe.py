"""A public byte-level BPE vocabulary, read from a `tokenizers` file, encoded piece by piece with a bounded memo."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import regex
import tiktoken

from textloom.llm._common import PIECES, WHITE_SPACE, Memo


def pre_tokens(pattern: str) -> regex.Pattern:
    """The pattern of pre-tokens, in which white space is what the tokenizers take for it."""
    return regex.compile(pattern.replace(r"[^\s\p", rf"[^{WHITE_SPACE}\p").replace(r"(?!\S)", rf"(?![^{WHITE_SPACE}])").replace(r"\s", f"[{WHITE_SPACE}]"))


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PublicBpe:
    """Ids as the tokenizers library gives them for a byte-level BPE file without normaliser: merges in order of their place, which for
    these files is that of the ids. The strings of added tokens are ordinary text unless `added` asks for their ids."""

    def __init__(self, path: str, pattern: str, most: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec["added_tokens"]}
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in spec["added_tokens"]}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special}
        self.size = max([*special, *ranks.values()]) + 1
        self.coder = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pre = pre_tokens(pattern)
        self.memo = Memo(lambda piece: array("I", self.coder.encode_ordinary(piece)).tobytes(), most)
        self.counts = Memo(lambda piece: len(self.memo[piece]) // 4, most)

    def raw(self, text: str | None, added: bool = False) -> bytes:
        """A text's ids as unsigned 32-bit integers; None counts as empty."""
        if added and text and self.parts and self.parts.search(text):
            return b"".join(self.added.get(part) or self.raw(part) for part in self.parts.split(text))
        return b"".join(map(self.memo.__getitem__, PIECES.findall(text))) if text else b""

    def ids(self, text: str | None, added: bool = False) -> list[int]:
        return array("I", self.raw(text, added)).tolist()

    def text(self, ids: list[int]) -> str:
        return self.coder.decode(ids)


@lru_cache(maxsize=2)
def public_bpe(path: str, pattern: str) -> PublicBpe:
    return PublicBpe(path, pattern)
