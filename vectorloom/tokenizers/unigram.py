"""SentencePiece Unigram: model files, normalisation, best segmentation, XLM-R ids."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from .base import Tokenizer

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM = 1
#: Names of model files, the first that exists counts.
FILES = ("sentencepiece.bpe.model", "tokenizer.model", "spiece.model")
_XLM_R = re.compile("XLMRobertaTokenizer|XLMRobertaModel|xlm-roberta")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind in (1, 5) else varint() if kind == 2 else -1
        if size < 0 or at + size > len(data):
            raise ValueError("malformed protobuf")
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class ModelProto:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    has_trainer: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def read_model(data: bytes) -> ModelProto:
    """Pieces (1), trainer (2) and normalizer (3) of a SentencePiece model."""
    m = ModelProto()
    for n, v in fields(data):
        if n == 1 and isinstance(v, bytes):
            f = dict(fields(v))
            m.pieces.append((f.get(1, b"").decode("utf-8", "surrogateescape"), struct.unpack("<f", f.get(2, b"\0" * 4))[0], f.get(3, NORMAL)))
        elif n == 2 and isinstance(v, bytes):
            m.has_trainer, m.model_type = True, dict(fields(v)).get(3, UNIGRAM)
        elif n == 3 and isinstance(v, bytes):
            f = dict(fields(v))
            m.charsmap = f.get(2, b"")
            m.add_dummy_prefix, m.remove_extra_whitespaces, m.escape_whitespaces = (bool(f.get(k, 1)) for k in (3, 4, 5))
    return m


class CharsMap:
    """Longest-prefix replacements in a compiled double-array trie."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.texts = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << (8 if unit & 0x200 else 0)

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key at a place."""
        found, node = None, self._offset(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[i]:
                break
            unit = self.units[node]
            node ^= self._offset(unit)
            if unit & 0x100 and node < len(self.units):
                start = self.units[node] & 0x7FFFFFFF
                found = (self.texts[start : self.texts.find(b"\0", start)], i - at + 1)
        return found


class Unigram(Tokenizer):
    def __init__(self, model: ModelProto, xlm_r: bool = False) -> None:
        if not model.has_trainer or model.model_type != UNIGRAM:
            raise ValueError("not a Unigram model")
        self.model, self.xlm_r = model, xlm_r
        self.charsmap = CharsMap(model.charsmap) if model.charsmap else None
        self.raw = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        self.usable = {p: (i, 0.0 if kind == USER_DEFINED else score) for p, (i, score, kind) in ((p, (i, s, k)) for i, (p, s, k) in enumerate(model.pieces)) if kind in (NORMAL, USER_DEFINED)}
        self.longest = max((len(p) for p in self.usable), default=0)
        n = len(model.pieces)
        self.unk, self.bos, self.eos = (self._id(self.raw.get(t, -1)) for t in ("<unk>", "<s>", "</s>"))
        self.pad = 1 if xlm_r else self.raw.get("<pad>", -1)
        self.vocab_size = n + 2 if xlm_r else n
        if self.unk < 0 or not self.longest:
            raise ValueError("the model lacks <unk> or normal pieces")
        self.unknown_score = min((s for _, s, k in model.pieces if k == NORMAL), default=-10.0) - 10.0
        super().__init__([self.bos], [self.eos], mask=n + 1 if xlm_r else self.raw.get("<mask>", -1))

    @classmethod
    def load(cls, directory: Path) -> Unigram:
        name = next(f for f in FILES if (directory / f).exists())
        hints = (directory / f for f in ("tokenizer_config.json", "config.json"))
        return cls(read_model((directory / name).read_bytes()), any(p.exists() and _XLM_R.search(p.read_text(encoding="utf-8")) for p in hints))

    def _id(self, raw: int) -> int:
        if not self.xlm_r or raw < 0:
            return raw
        return {0: 3, 1: 0, 2: 2}.get(raw, raw + 1)

    def normalize(self, text: str) -> str:
        out: list[str] = []
        mark = MARK if self.model.escape_whitespaces else " "
        inside = prefixed = False
        for ch in self._mapped(text):
            if ch != " ":
                if not inside:
                    inside = True
                    if self.model.remove_extra_whitespaces or self.model.add_dummy_prefix and not prefixed:
                        out.append(mark)
                        prefixed = True
                out.append(ch)
            else:
                inside = False
                if not self.model.remove_extra_whitespaces:
                    out.append(mark)
        return "".join(out)

    def _mapped(self, text: str) -> str:
        if self.charsmap is None:
            return text
        data, at, out = text.encode("utf-8", "surrogateescape"), 0, []
        while at < len(data):
            if hit := self.charsmap.longest(data, at):
                out.append(hit[0])
                at += hit[1]
                continue
            end = at + 1
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            out.append(data[at:end])
            at = end
        return b"".join(out).decode("utf-8", "replace")

    def core(self, text: str) -> list[int]:
        """Ids of the segmentation with the best total score; the first found on ties, unknown runs as one."""
        s = self.normalize(text)
        n = len(s)
        best: list[tuple[float, int, int]] = [(float("-inf"), -1, -1)] * (n + 1)
        best[0] = (0.0, 0, self.unk)
        for at in range(n):
            score = best[at][0]
            single = False
            for end in range(at + 1, min(n, at + self.longest) + 1):
                if (hit := self.usable.get(s[at:end])) is not None:
                    single |= end == at + 1
                    if score + hit[1] > best[end][0]:
                        best[end] = (score + hit[1], at, self._id(hit[0]))
            if not single and score + self.unknown_score > best[at + 1][0]:
                best[at + 1] = (score + self.unknown_score, at, self.unk)
        out: list[int] = []
        at = n
        while at > 0:
            _, start, i = best[at]
            if not (out and i == self.unk == out[-1]):
                out.append(i)
            at = start
        return out[::-1]

    def token_id(self, token: str) -> int:
        return self._id(self.raw.get(token, -1))

    def token(self, i: int) -> str:
        back = {0: 1, 2: 2, 3: 0}.get(i, i - 1 if i >= 4 else -1) if self.xlm_r else i
        return self.model.pieces[back][0] if 0 <= back < len(self.model.pieces) else ""

    def vocabulary(self) -> list[tuple[str, int]]:
        return [(p, self._id(i)) for i, (p, _, _) in enumerate(self.model.pieces)]
