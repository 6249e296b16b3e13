"""Small deterministic models and vocabularies: meaningless weights, exact arithmetic."""

from __future__ import annotations

import json
import struct
import zlib
from pathlib import Path

import numpy as np

from ..sources.safetensors import write_safetensors
from ..tokenizers.bpe import byte_signs

#: The merges of the small byte-level vocabulary, the small WordPiece vocabulary and Unigram pieces.
BPE_MERGES = ("h e", "l l", "he ll", "hell o", "Ġ w", "o r", "l d", "Ġw or")
BPE_SPECIALS = ("<|endoftext|>", "[MASK]", "[Q]", "[D]")
WORDPIECE = ("[PAD] [UNK] [CLS] [SEP] [MASK] the capital of france is paris , . un ##aff ##able cafe hello world ! 2023 token ##ization 中").split()
PIECES = (("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), (",", -3.0, 1), (".", -3.0, 1), ("▁", -4.0, 1), ("!", -3.0, 1), ("▁Hello", -1.0, 1), ("▁world", -1.0, 1), ("南", -1.0, 1), ("瓜", -1.0, 1), ("▁Hi", -1.0, 1))


def values(name: str, shape: tuple[int, ...]) -> np.ndarray:
    """A tensor's values before they are stored: normal numbers seeded by its name, about 1 for the weights of norms."""
    x = np.random.default_rng(zlib.crc32(name.encode())).normal(0, 0.1, shape)
    return (x + 1 if name.endswith("orm.weight") else x * 4 if "embed" in name else x).astype(np.float32)


def stored(x: np.ndarray, dtype: str) -> tuple[str, tuple[int, ...], bytes]:
    """Values cut to BF16, stored as ``dtype``."""
    cut = np.ascontiguousarray(x).view(np.uint32) >> 16
    if dtype == "BF16":
        return "BF16", x.shape, cut.astype("<u2").tobytes()
    return dtype, x.shape, (cut.astype(np.uint32) << 16).view(np.float32).astype({"F32": "<f4", "F16": "<f2"}[dtype]).tobytes()


def write_bpe(at: Path) -> None:
    tokens = [*byte_signs(), *("".join(m.split()) for m in BPE_MERGES), *BPE_SPECIALS]
    (at / "vocab.json").write_text(json.dumps({t: i for i, t in enumerate(tokens)}), encoding="utf-8")
    (at / "merges.txt").write_text("#version: 0.2\n" + "\n".join(BPE_MERGES) + "\n", encoding="utf-8")


def write_unigram(at: Path, xlm_r: bool = True) -> None:
    def number(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    def message(tag: int, body: bytes) -> bytes:
        return number(tag << 3 | 2) + number(len(body)) + body

    data = b"".join(message(1, message(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + number(k)) for p, s, k in PIECES)
    data += message(2, b"\x18\x01") + message(3, b"\x18\x01\x20\x01\x28\x01")
    (at / "sentencepiece.bpe.model").write_bytes(data)
    (at / "tokenizer_config.json").write_text(json.dumps({"tokenizer_class": "XLMRobertaTokenizer" if xlm_r else "T5Tokenizer"}))


def write_model(at: str | Path, kind: str = "qwen3", tokenizer: str = "bpe", dtype: str = "BF16", late_dim: int = 0, hidden: int = 4, heads: int = 2, layers: int = 1, intermediate: int = 8, vocab: int = 16, prefix: str = "", config: dict | None = None) -> Path:
    """A model directory. ``kind``: base, qwen3, qwen2, bert or xlm-roberta."""
    from .config import read_config
    from .model import Model

    at = Path(at)
    at.mkdir(parents=True, exist_ok=True)
    if tokenizer == "bpe":
        write_bpe(at)
        vocab = max(vocab, 268)
    elif tokenizer == "wordpiece":
        (at / "vocab.txt").write_text("\n".join(WORDPIECE) + "\n", encoding="utf-8")
        vocab = max(vocab, len(WORDPIECE))
    elif tokenizer == "unigram":
        write_unigram(at)
        vocab = max(vocab, len(PIECES) + 2)
    encoder = kind in ("bert", "xlm-roberta")
    c = {"hidden_size": hidden, "num_hidden_layers": layers, "num_attention_heads": heads, "intermediate_size": intermediate, "vocab_size": vocab, "rope_theta": 10000.0}
    c |= {"max_position_embeddings": 514, "type_vocab_size": 1 if kind == "xlm-roberta" else 2, "pad_token_id": 1} if encoder else {"num_key_value_heads": max(1, heads // 2), "head_dim": hidden // heads}
    c |= ({} if kind == "base" else {"model_type": kind}) | (config or {})
    (at / "config.json").write_text(json.dumps(c))
    shape_of = Model.__new__(Model)
    shape_of.config = read_config(at)
    shapes = shape_of.shapes()
    if encoder:
        shapes["embeddings.position_embeddings.weight"] = (c["max_position_embeddings"], hidden)
    write_safetensors(at / "model.safetensors", {prefix + n: stored(values(n, s), dtype) for n, s in shapes.items()})
    if late_dim:
        (at / "1_Dense").mkdir(exist_ok=True)
        write_safetensors(at / "1_Dense" / "model.safetensors", {"linear.weight": stored(values("linear.weight", (late_dim, hidden)), dtype)})
    return at


