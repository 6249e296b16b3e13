"""Tensors of safetensors files: directory, payloads, a Spark data source, and a converter to BF16."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MAX_TENSORS, MAX_DIMS, MAX_SHARDS = 1024, 8, 8
WIDTH = {"F32": 4, "F16": 2, "BF16": 2, "I32": 4, "I64": 8, "BOOL": 1}
_SHARD = re.compile(r"model-(\d+)-of-(\d+)\.safetensors")


class SafetensorsError(ValueError):
    pass


@dataclass(frozen=True)
class Tensor:
    file: str
    name: str
    dtype: str
    shape: tuple[int, ...]
    start: int
    end: int
    payload: int

    def read(self) -> np.ndarray:
        """Values as 32-bit floats; memory-mapped where they are stored so."""
        n = int(np.prod(self.shape, dtype=np.int64))
        kind = {"F32": "<f4", "F16": "<f2", "BF16": "<u2"}.get(self.dtype)
        if kind is None or n * WIDTH[self.dtype] != self.end - self.start:
            raise SafetensorsError(f"{self.name} is no tensor of floats of its size")
        raw = np.memmap(self.file, dtype=kind, mode="r", offset=self.payload + self.start, shape=(n,)) if n else np.empty(0, kind)
        return widen(raw, self.dtype).reshape(self.shape)


def widen(raw: np.ndarray, dtype: str) -> np.ndarray:
    """32-bit floats of stored BF16 (bits), F16 or F32."""
    if dtype == "BF16":
        return (raw.astype(np.uint32) << 16).view(np.float32)
    return raw.astype(np.float32) if dtype == "F16" else raw


def narrow(values: np.ndarray) -> np.ndarray:
    """Bits of the nearest BF16, ties to even; NaN stays NaN."""
    bits = np.ascontiguousarray(values, np.float32).view(np.uint32).astype(np.uint64)
    out = ((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype(np.uint16)
    return np.where(np.isnan(values), ((bits >> 16) | 0x40).astype(np.uint16), out)


def read_directory(path: str | Path) -> list[Tensor]:
    """Tensors of one file, in the header's order."""
    path = Path(path)
    size = path.stat().st_size
    if size < 8:
        raise SafetensorsError("file too short")
    with path.open("rb") as f:
        length = int.from_bytes(f.read(8), "little")
        if length > size - 8:
            raise SafetensorsError("header longer than the file")
        try:
            header = json.loads(f.read(length))
        except ValueError as e:
            raise SafetensorsError("header is no JSON") from e
    out = []
    for name, t in header.items():
        if name == "__metadata__":
            continue
        shape, (start, end) = tuple(t.get("shape", ())), t.get("data_offsets", (0, 0))
        if len(shape) > MAX_DIMS or start < 0 or end < start or 8 + length + end > size:
            raise SafetensorsError(f"bad entry {name}")
        out.append(Tensor(str(path), name, t["dtype"] if t.get("dtype") in WIDTH else "UNKNOWN", shape, start, end, 8 + length))
    if len(out) > MAX_TENSORS:
        raise SafetensorsError("too many tensors")
    return out


def shards(directory: str | Path) -> list[Path]:
    """model.safetensors, or the complete set of its shards in order."""
    at = Path(directory)
    if (one := at / "model.safetensors").exists():
        return [one]
    found = sorted(p for p in at.iterdir() if p.name.startswith("model-") and ".safetensors" in p.name)
    parsed = [_SHARD.fullmatch(p.name) for p in found]
    if not found or not all(parsed):
        raise SafetensorsError("no safetensors files, or a bad shard name")
    totals, numbers = {int(m[2]) for m in parsed}, [int(m[1]) for m in parsed]
    total = totals.pop()
    if totals or total > MAX_SHARDS or sorted(numbers) != list(range(1, total + 1)):
        raise SafetensorsError("shards are inconsistent, missing, doubled or too many")
    return found


def tensors(directory: str | Path) -> dict[str, Tensor]:
    """All tensors of a model directory; of equal names the first shard's counts."""
    out: dict[str, Tensor] = {}
    for path in shards(directory):
        for t in read_directory(path):
            out.setdefault(t.name, t)
    return out


def payload_bytes(directory: str | Path) -> int:
    return sum(t.end - t.start for t in tensors(directory).values())


class SafetensorsSource(DataSource):
    """``spark.read.format("safetensors").load(path)``: one row a tensor; a file, or a model directory with a partition a shard."""

    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return "file string, name string, dtype string, shape array<bigint>, start bigint, end bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        at = Path(self.path)
        return [InputPartition(str(p)) for p in (shards(at) if at.is_dir() else [at])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for t in read_directory(partition.value):
            yield t.file, t.name, t.dtype, list(t.shape), t.start, t.end


def write_safetensors(path: str | Path, arrays: dict[str, tuple[str, tuple[int, ...], bytes]]) -> None:
    """Write name -> dtype, shape, payload."""
    header, at = {}, 0
    for name, (dtype, shape, data) in arrays.items():
        header[name] = {"dtype": dtype, "shape": list(shape), "data_offsets": [at, at + len(data)]}
        at += len(data)
    text = json.dumps(header, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 8)
    with Path(path).open("wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for _, _, data in arrays.values():
            f.write(data)


def convert_bf16(source: str | Path, target: str | Path) -> None:
    """A copy of a model directory with its F32 tensors as BF16; other files are linked."""
    source, target = Path(source).resolve(), Path(target)
    target.mkdir(parents=True)
    weights = {p.name: p for p in shards(source)}
    for p in source.iterdir():
        if p.name not in weights:
            (target / p.name).symlink_to(p)
            continue
        out = {}
        for t in read_directory(p):
            raw = p.read_bytes()[t.payload + t.start : t.payload + t.end] if t.dtype != "F32" else narrow(t.read()).astype("<u2").tobytes()
            out[t.name] = ("BF16" if t.dtype == "F32" else t.dtype, t.shape, raw)
        write_safetensors(target / p.name, out)


__all__ = ["SafetensorsError", "SafetensorsSource", "Tensor", "convert_bf16", "narrow", "payload_bytes", "read_directory", "shards", "tensors", "widen", "write_safetensors"]
