"""What a model directory says about its model."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

ENCODERS = ("bert", "roberta", "xlm-roberta")
MAX_LAYERS = 64
_POOLING = {"pooling_mode_mean_tokens": "mean", "pooling_mode_lasttoken": "last", "pooling_mode_cls_token": "cls"}
_NO_POOLING = ("pooling_mode_max_tokens", "pooling_mode_mean_sqrt_len_tokens", "pooling_mode_weightedmean_tokens")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class ModelConfig:
    hidden: int
    layers: int
    heads: int
    kv_heads: int
    intermediate: int
    head_dim: int = 128
    vocab: int = 151936
    rms_eps: float = 1e-6
    ln_eps: float = 1e-12
    rope_theta: float = 1e6
    max_positions: int = 0
    type_vocab: int = 2
    encoder: bool = False
    causal: bool = False
    pooling: str = "mean"
    normalize: bool = False
    append_terminal: bool = False
    qk_norm: bool = True
    qkv_bias: bool = False
    gelu_tanh: bool = False
    position_offset: int = 0

    def __post_init__(self) -> None:
        if min(self.hidden, self.layers, self.heads, self.kv_heads, self.intermediate, self.head_dim, self.vocab) <= 0:
            raise ConfigError("dimensions must be positive")
        if self.layers > MAX_LAYERS or self.heads % self.kv_heads or self.head_dim % 2:
            raise ConfigError("too many layers, heads that don't divide, or an odd head size")


def _optional(path: Path) -> dict | list | None:
    """None if the file is absent; unreadable or malformed files raise."""
    return json.loads(path.read_text(encoding="utf-8")) if path.exists() else None


def read_config(directory: str | Path) -> ModelConfig:
    at = Path(directory)
    c = json.loads((at / "config.json").read_text(encoding="utf-8"))
    kind = c.get("model_type")
    encoder = kind in ENCODERS
    try:
        got = {"hidden": int(c["hidden_size"]), "layers": int(c["num_hidden_layers"]), "heads": int(c["num_attention_heads"]), "intermediate": int(c["intermediate_size"])}
    except KeyError as e:
        raise ConfigError(f"config.json lacks {e}") from e
    got["kv_heads"] = got["heads"] if encoder else int(c.get("num_key_value_heads", got["heads"]))
    if encoder:
        if got["heads"] <= 0:
            raise ConfigError("dimensions must be positive")
        got |= {"head_dim": got["hidden"] // got["heads"], "encoder": True, "qkv_bias": True, "qk_norm": False}
        if kind != "bert":
            got["position_offset"] = int(c.get("pad_token_id", 1)) + 1
    elif kind == "qwen3":
        got |= {"causal": True, "pooling": "last", "normalize": True, "append_terminal": True}
    elif kind == "qwen2":
        got |= {"causal": True, "qk_norm": False, "qkv_bias": True}
    for ours, theirs, kind_of in (("head_dim", "head_dim", int), ("vocab", "vocab_size", int), ("rms_eps", "rms_norm_eps", float), ("ln_eps", "layer_norm_eps", float), ("rope_theta", "rope_theta", float), ("max_positions", "max_position_embeddings", int), ("type_vocab", "type_vocab_size", int)):
        if theirs in c and not (encoder and ours == "head_dim"):
            got[ours] = kind_of(c[theirs])
    got["gelu_tanh"] = c.get("hidden_act") in ("gelu_new", "gelu_pytorch_tanh")
    if isinstance(c.get("is_causal"), bool):
        got["causal"] = c["is_causal"]
    got |= _side_files(at)
    return ModelConfig(**got)


def _side_files(at: Path) -> dict:
    got: dict = {}
    if (pooling := _optional(at / "1_Pooling" / "config.json")) is not None:
        chosen = [mode for key, mode in _POOLING.items() if pooling.get(key) is True]
        if any(pooling.get(k) is True for k in _NO_POOLING) or len(chosen) != 1:
            raise ConfigError("pooling must be exactly one of mean, last token and cls")
        got["pooling"] = chosen[0]
    if (modules := _optional(at / "modules.json")) is not None:
        got["normalize"] = any(m.get("type") == "sentence_transformers.models.Normalize" for m in modules)
    if (tokens := _optional(at / "tokenizer_config.json")) is not None and "add_eos_token" in tokens:
        if not isinstance(tokens["add_eos_token"], bool):
            raise ConfigError("add_eos_token must be a boolean")
        got["append_terminal"] = tokens["add_eos_token"]
    return got


def query_prompt(directory: str | Path) -> str | None:
    """The published query instruction, if there is one."""
    found = _optional(Path(directory) / "config_sentence_transformers.json")
    prompt = (found or {}).get("prompts", {}).get("query")
    if prompt is not None and not isinstance(prompt, str):
        raise ConfigError("prompts.query must be a string")
    return prompt
