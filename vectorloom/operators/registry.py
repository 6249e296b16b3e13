"""Served models: specifications, checks, and a catalog."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..nn.config import ModelConfig, query_prompt, read_config
from ..sources import safetensors as st
from ..tokenizers import Tokenizer, item_token_cap, open_tokenizer

KINDS = ("standard", "contextual", "late")
APIS = ("openai", "perplexity")
#: Limits of one request.
MAX_INPUTS, MAX_CONTEXT_DOCS, MAX_CONTEXT_CHUNKS, MAX_RERANK_DOCS = 512, 512, 16000, 1000
MAX_REQUEST_TOKENS, MAX_BATCH_TOKENS = 120_000, 16_384
_ESCAPES = {"\\n": "\n", "\\t": "\t", "\\r": "\r", "\\\\": "\\"}


class SpecError(ValueError):
    pass


@dataclass(frozen=True)
class Served:
    label: str
    directory: str
    kind: str = "standard"
    api: str = "openai"
    min_dim: int = 0
    query: str | None = None
    config: ModelConfig = field(default=None, compare=False)  # type: ignore[assignment]

    def tokenizer(self) -> Tokenizer:
        return open_tokenizer(self.directory, self.config.append_terminal)

    @property
    def keep_tail(self) -> bool:
        """Whether truncation keeps the last token: where it is a special one."""
        return self.config.encoder or self.config.append_terminal

    @property
    def dim(self) -> int:
        return self.config.hidden

    @property
    def token_cap(self) -> int:
        return item_token_cap(self.config.max_positions, self.config.position_offset, MAX_BATCH_TOKENS)


def parse_spec(spec: str) -> dict:
    """``LABEL=DIR:api=...:kind=...:min_dim=...:query=...``. ``query`` (or ``query_instruct``) comes last and may
    hold colons; in it ``\\n``, ``\\t`` and ``\\r`` are escapes."""
    label, eq, rest = spec.partition("=")
    if not eq or not label or not rest:
        raise SpecError("a specification is LABEL=DIR with options")
    out: dict = {"label": label}
    if m := re.search(r":query(?:_instruct)?=", rest):
        out["query"] = re.sub(r"\\[ntr\\]", lambda e: _ESCAPES[e[0]], rest[m.end() :])
        rest = rest[: m.start()]
    out["directory"], *options = rest.split(":")
    if not out["directory"]:
        raise SpecError("the directory is empty")
    for option in options:
        key, eq, value = option.partition("=")
        if key == "api" and value in APIS or key == "kind" and value in KINDS:
            out[key] = value
        elif key == "min_dim" and value.isdecimal():
            out[key] = int(value)
        else:
            raise SpecError(f"bad option {option!r}")
    return out


class ModelRegistry:
    """Labels and their models. Weights are opened by the workers that need them."""

    def __init__(self) -> None:
        self.models: dict[str, Served] = {}

    def register(self, label: str, directory: str | Path, kind: str = "standard", api: str = "openai", min_dim: int = 0, query: str | None = None) -> Served:
        if not label or label in self.models:
            raise SpecError("labels are unique and not empty")
        if kind not in KINDS or api not in APIS:
            raise SpecError("unknown kind or api")
        config = read_config(directory)
        if not 0 <= min_dim <= config.hidden:
            raise SpecError("min_dim must be between 0 and the model's size")
        served = Served(label, str(directory), kind, api, min_dim, query if query is not None else query_prompt(directory), config)
        self.models[label] = served
        return served

    def register_spec(self, spec: str) -> Served:
        return self.register(**parse_spec(spec))

    def get(self, label: str) -> Served | None:
        return self.models.get(label)

    def describe(self, spark: SparkSession) -> DataFrame:
        """One row a model: what is served, how, and how large it is."""
        rows = [(m.label, m.directory, m.kind, m.api, m.dim, m.min_dim, m.config.layers, "encoder" if m.config.encoder else "decoder", m.config.pooling, m.config.normalize, m.token_cap, type(m.tokenizer()).__name__, st.payload_bytes(m.directory)) for m in self.models.values()]
        return spark.createDataFrame(rows, "label string, directory string, kind string, api string, dim int, min_dim int, layers int, family string, pooling string, normalize boolean, token_cap int, tokenizer string, bytes bigint")


def inspect(directory: str | Path) -> dict[str, str]:
    """What a snapshot's files say: tokenizer family, weight layout, kind of serving, pipeline."""
    at = Path(directory)
    files = [p.name for p in st.shards(at)]
    tokenizer = "wordpiece" if (at / "vocab.txt").exists() else "unigram" if any(at.glob("*.model")) else "bpe" if (at / "vocab.json").exists() else "none"
    kind = "late" if (at / "1_Dense").is_dir() else "standard"
    modules = "sentence-transformers" if (at / "modules.json").exists() else "plain"
    return {"tokenizer": tokenizer, "weights": "single" if len(files) == 1 else f"{len(files)} shards", "kind": kind, "pipeline": modules}
