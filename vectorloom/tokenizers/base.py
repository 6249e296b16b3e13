"""What the three tokenizer families share: special layouts and late-interaction layouts."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Ids of special tokens where a byte-level vocabulary lacks them, and the late query length.
FALLBACK_IDS = {"<|endoftext|>": 151643, "[MASK]": 151642, "[Q]": 151669, "[D]": 151670}
LATE_QUERY_TOKENS = 32
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class TokenizerError(ValueError):
    """A text that a model cannot take, such as an empty one where no special token surrounds it."""


@dataclass
class Tokenizer:
    """A family's core encoder with its layout: ``prefix`` core ``suffix``."""

    prefix: list[int] = field(default_factory=list)
    suffix: list[int] = field(default_factory=list)
    separator: int = 0
    late_marks: dict[bool, int] | None = None
    mask: int = -1
    skip: frozenset[int] = frozenset()

    def core(self, text: str) -> list[int]:
        raise NotImplementedError

    def token_id(self, token: str) -> int:
        """-1 if the vocabulary lacks it."""
        raise NotImplementedError

    def token(self, i: int) -> str:
        """Empty if out of range."""
        raise NotImplementedError

    def vocabulary(self) -> list[tuple[str, int]]:
        raise NotImplementedError

    def core_array(self, text: str) -> np.ndarray:
        """``core`` in 32-bit integers."""
        return np.array(self.core(text), np.int32)

    def encode(self, text: str, instruct: str | None = None) -> list[int]:
        """Ids of instruction and text, tokenised in one pass, in the family's layout. A NUL ends the text."""
        return self.encode_array(text, instruct).tolist()

    def encode_array(self, text: str, instruct: str | None = None) -> np.ndarray:
        """``encode`` in 32-bit integers, without an object for each token."""
        core = self.core_array(((instruct or "") + text).split("\0", 1)[0])
        ids = np.concatenate([self.prefix, core, self.suffix], dtype=np.int32, casting="unsafe")
        if not len(ids):
            raise TokenizerError("the text has no tokens")
        return ids

    def encode_late(self, text: str, is_query: bool) -> tuple[list[int], list[int]]:
        """Ids and the positions that are scored. Queries are padded with masks up to 32 and scored everywhere;
        documents are scored where the id is no punctuation sign's."""
        if self.late_marks is None:
            raise TokenizerError("this tokenizer has no late-interaction layout")
        ids = self.encode(text)
        ids = [ids[0], self.late_marks[is_query], *ids[1:]]
        if is_query:
            ids += [self.mask] * (LATE_QUERY_TOKENS - len(ids))
            return ids, list(range(len(ids)))
        keep = [i for i, t in enumerate(ids) if t not in self.skip]
        if not keep:
            raise TokenizerError("no token of the document is scored")
        return ids, keep


def truncate[T: (list[int], np.ndarray)](ids: T, cap: int, keep_tail: bool) -> T:
    """The first ``cap`` ids; with ``keep_tail`` the last one of all takes the last place."""
    if len(ids) <= cap:
        return ids
    if isinstance(ids, np.ndarray):
        return np.append(ids[: cap - 1], ids[-1]) if keep_tail else ids[:cap].copy()
    return [*ids[: cap - 1], ids[-1]] if keep_tail else ids[:cap]


def item_token_cap(max_positions: int = 0, offset: int = 0, max_batch_tokens: int = 0) -> int:
    """Most tokens of one item: 32,768, what positions the model has after its offset, and the batch budget."""
    cap = 32768
    if max_positions - offset > 0:
        cap = min(cap, max_positions - offset)
    return min(cap, max_batch_tokens) if max_batch_tokens > 0 else cap
