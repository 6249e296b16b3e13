"""WordPiece: clean, fold, split at punctuation, greedy longest match."""

from __future__ import annotations


import re
import unicodedata
from functools import lru_cache
from pathlib import Path

from .base import Tokenizer

LONGEST_WORD = 100
#: What counts as white space, and the CJK ranges whose characters are words.
_SPACES = frozenset(" \t\n\r\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
_CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


@lru_cache(maxsize=1 << 16)
def _clean(ch: str) -> str:
    if ch in _SPACES:
        return " "
    if ch in "\0\ufffd" or unicodedata.category(ch) in ("Cc", "Cf", "Co"):
        return ""
    return f" {ch} " if any(lo <= ord(ch) <= hi for lo, hi in _CJK) else ch


@lru_cache(maxsize=1 << 16)
def _fold(ch: str) -> str:
    """One character in lower case without marks; Greek final sigma is not special."""
    return "".join(c for c in unicodedata.normalize("NFD", ch.lower()) if unicodedata.category(c) != "Mn")


@lru_cache(maxsize=1 << 16)
def _is_punct(ch: str) -> bool:
    return not ch.isalnum() and ch > " " if ch < "\x7f" else unicodedata.category(ch)[0] == "P"


class WordPiece(Tokenizer):
    """Vocabulary lines are ids; of equal lines the last one counts."""

    def __init__(self, tokens: list[str], lower: bool = True) -> None:
        self.tokens, self.lower = tokens, lower
        self.ids = {t: i for i, t in enumerate(tokens)}
        if "[UNK]" not in self.ids:
            raise ValueError("the vocabulary has no [UNK]")
        self.unknown = self.ids["[UNK]"]
        super().__init__([self.ids.get("[CLS]", -1)], [self.ids.get("[SEP]", -1)])
        self._word = lru_cache(maxsize=1 << 17)(self._match)

    @classmethod
    def load(cls, directory: Path) -> WordPiece:
        lines = (directory / "vocab.txt").read_text(encoding="utf-8", newline="").split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        config = directory / "tokenizer_config.json"
        lower = not (config.exists() and re.search(r'"do_lower_case"\s*:\s*false', config.read_text(encoding="utf-8")))
        return cls([x.removesuffix("\r") for x in lines], lower)

    def _match(self, word: str) -> tuple[int, ...]:
        if len(word) > LONGEST_WORD:
            return (self.unknown,)
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                i = self.ids.get(word[at:end] if at == 0 else "##" + word[at:end])
                if i is not None:
                    out.append(i)
                    at = end
                    break
            else:
                return (self.unknown,)
        return tuple(out)

    def core(self, text: str) -> list[int]:
        out: list[int] = []
        for word in "".join(map(_clean, text)).split(" "):
            word = "".join(map(_fold, word)) if self.lower else word
            start = 0
            for i, ch in enumerate(word):
                if _is_punct(ch):
                    if start < i:
                        out += self._word(word[start:i])
                    out += self._word(ch)
                    start = i + 1
            if start < len(word):
                out += self._word(word[start:])
        return out

    def token_id(self, token: str) -> int:
        return self.ids.get(token, -1)

    def token(self, i: int) -> str:
        return self.tokens[i] if 0 <= i < len(self.tokens) else ""

    def vocabulary(self) -> list[tuple[str, int]]:
        return [(t, i) for i, t in enumerate(self.tokens)]


