"""Tokenizers of model directories, chosen by the files that are there."""

from __future__ import annotations

from pathlib import Path

from .base import Tokenizer, TokenizerError, item_token_cap, truncate
from .bpe import ByteBPE
from .unigram import FILES, Unigram
from .wordpiece import WordPiece


def open_tokenizer(directory: str | Path, append_terminal: bool = False) -> Tokenizer:
    """vocab.txt: WordPiece; else a SentencePiece model; else vocab.json: byte-level BPE."""
    at = Path(directory)
    if (at / "vocab.txt").exists():
        return WordPiece.load(at)
    if any((at / f).exists() for f in FILES):
        return Unigram.load(at)
    if (at / "vocab.json").exists():
        return ByteBPE.load(at, append_terminal)
    raise FileNotFoundError(f"no tokenizer files in {at}")


__all__ = ["ByteBPE", "Tokenizer", "TokenizerError", "Unigram", "WordPiece", "item_token_cap", "open_tokenizer", "truncate"]
