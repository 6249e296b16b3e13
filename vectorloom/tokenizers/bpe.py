"""Byte-level BPE with the family's own character classes, splitting rules and restricted composition."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from functools import lru_cache
from pathlib import Path

import numpy as np

from .base import ASCII_PUNCTUATION, FALLBACK_IDS, Tokenizer

#: Which ASCII letters a combining mark joins; other pairs stay apart.
COMPOSED = {
    "\u0300": "AEIOUaeiou", "\u0301": "ACEILNORSUYZaceilnorsuyz", "\u0302": "AEIOUaeiou", "\u0303": "ANOano",
    "\u0308": "AEIOUYaeiouy", "\u030a": "Aa", "\u0327": "Cc",
}
#: The character classes. Whatever beyond ASCII is in none of them is a letter.
NUMBERS = ("0-9", "٠-٩", "۰-۹", "०-९", "０-９")
SPACES = ("\t-\r", " ", "\x85", "\xa0", "\u1680", "\u2000-\u200a", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
SYMBOLS = (
    "\u0300-\u036f", "¡-\u00a9", "«-´", "¶-¹", "»-¿", "×", "÷", "\u064b-\u065f", "\u0900-\u0903",
    "\u093a-\u094f", "\u0951-\u0957", "\u0962\u0963", "\u2000-\u206f", "←-\u27bf", "⸀-\u2e7f", "\u3000-\u303f", "\U0001f000-\U0001faff",
)


def _others(*classes: tuple[str, ...]) -> str:
    """Ranges beyond ASCII that none of the classes covers."""
    parts = [p for c in classes for p in c]
    taken = sorted((ord(x[0]), ord(x[-1])) for p in parts for x in ([p] if p[1:2] == "-" else p))
    out, at = [], 0x80
    for lo, hi in taken:
        if lo > at:
            out.append(f"{chr(at)}-{chr(lo - 1)}")
        at = max(at, hi + 1)
    return "".join([*out, f"{chr(at)}-\U0010ffff"])


_S, _N = "".join(SPACES), "".join(NUMBERS)
_L = "A-Za-z" + _others(SPACES, NUMBERS, SYMBOLS)
_LETTER = f"[{_L}]"
_SIGN = f"[^{_L}{_S}{_N}]"
_SPLIT = re.compile(
    "|".join((
        "'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])",
        f"[^\r\n{_N}{_L}]{_LETTER}+",
        f"{_LETTER}+",
        f"[{_N}]",
        f"(?:(?![\r\n])[{_S}])*[\r\n]+",
        f" {_SIGN}+[\r\n]*",
        f"[{_S}]+(?=[{_S}][^{_S}])|[{_S}]+",
        f"{_SIGN}+[\r\n]*",
    ))
)
_PAIR = re.compile("|".join(f"[{bases}]{mark}" for mark, bases in COMPOSED.items()))


def compose(text: str) -> str:
    """Latin letters with one following mark, composed; no other normalisation."""
    return _PAIR.sub(lambda m: unicodedata.normalize("NFC", m[0]), text) if any(mark in text for mark in COMPOSED) else text


def split(text: str) -> list[str]:
    return _SPLIT.findall(text)


def byte_signs() -> list[str]:
    """The printable sign of each byte: itself where Latin-1 has a visible one, else the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


_SIGNS = byte_signs()
_BYTES = {s: b for b, s in enumerate(_SIGNS)}


class ByteBPE(Tokenizer):
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], append_terminal: bool = False) -> None:
        self.ids = vocab
        self.tokens = {i: t for t, i in vocab.items()}
        self.ranks: dict[tuple[str, str], int] = {}
        for r, pair in enumerate(merges):
            self.ranks.setdefault(pair, r)
        special = {t: vocab.get(t, i) for t, i in FALLBACK_IDS.items()}
        self.terminal = special["<|endoftext|>"]
        super().__init__([], [self.terminal] if append_terminal else [], self.terminal, {True: special["[Q]"], False: special["[D]"]}, special["[MASK]"])
        self._piece = lru_cache(maxsize=1 << 17)(self._merged)
        self._packed = lru_cache(maxsize=1 << 17)(lambda piece: array("i", self._merged(piece)).tobytes())
        alone = (self.core(p) for p in ASCII_PUNCTUATION)
        self.skip = frozenset(ids[0] for ids in alone if len(ids) == 1)

    @classmethod
    def load(cls, directory: Path, append_terminal: bool = False) -> ByteBPE:
        vocab = json.loads((directory / "vocab.json").read_text(encoding="utf-8"))
        merges: list[tuple[str, str]] = []
        if (path := directory / "merges.txt").exists():
            for line in path.read_text(encoding="utf-8").split("\n"):
                if line and not line.startswith("#") and len(pair := line.rstrip("\r").split(" ")) == 2 and all(pair):
                    merges.append((pair[0], pair[1]))
        return cls(vocab, merges, append_terminal)

    def _merged(self, piece: str) -> tuple[int, ...]:
        """Lowest rank first, leftmost on ties: a heap of candidate pairs over a linked list of parts."""
        parts: list[str | None] = [_SIGNS[b] for b in piece.encode("utf-8", "surrogateescape")]
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list[tuple[int, int, str, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0 and (r := self.ranks.get((parts[i], parts[j]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            after[j] = -1
            offer(before[i])
            offer(i)
        return tuple(self.ids[p] for p in parts if p is not None and p in self.ids)

    def core(self, text: str) -> list[int]:
        return [i for p in split(compose(text)) for i in self._piece(p)]

    def core_array(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._packed, split(compose(text)))), np.int32)

    def decode(self, ids: list[int]) -> str:
        """Text of ordinary tokens; ids out of range give nothing."""
        signs = "".join(self.token(i) for i in ids)
        return bytes(_BYTES[s] for s in signs if s in _BYTES).decode("utf-8", "surrogateescape")

    def token_id(self, token: str) -> int:
        return self.ids.get(token, -1)

    def token(self, i: int) -> str:
        return self.tokens.get(i, "")

    def vocabulary(self) -> list[tuple[str, int]]:
        return list(self.ids.items())
