"""Token counts through a digest cache.

A text's count depends on its bytes and the tokenizer alone, so counts are stored under (SHA-256 of the text, SHA-256
of the tokenizer's file). A run joins its digests to the cache, picks one row for each digest that is missing,
encodes those texts only, appends their counts to the cache and joins again. Digests and counts are shuffled; texts
only once, hashed against the small ids of the misses, and not at all where few are missing.

Cache: a Parquet folder that only grows, each run adding files of its own; equal digests from
runs that overlapped agree, and reads drop the repetition.

Encoding: where no piece holds a word mark after another character, none can span the start of a
word, so the words of a text are encoded independently; a worker keeps the counts of words it has met (bounded). Any other
model encodes whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, Spool, map_arrow, quoted, raw_texts, salted_join, text_or_empty

#: As many ids of misses are sent to every task; more are joined.
BROADCAST_IDS = 10_000
WORDS_KEPT = 400_000


class Counter:
    """Counts of one sentencepiece model as its library gives them, without added tokens."""

    def __init__(self, model: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        probe = "a  b\tÀé fi 　x \n"
        plain = self.model.normalize(probe) == "▁" + probe.replace(" ", "▁")
        self.by_word = plain and not any("▁" in p.lstrip("▁") for p in pieces) and self._agrees()
        self.known: dict[str, int] = {}

    def _agrees(self) -> bool:
        """That words by themselves give what whole texts give, tried on awkward texts before it is relied on."""
        self.known = {}
        tries = ["", " ", "  a", "a   b ", "x▁y ▁", "\n\n a\r\n", "<s> </s> <unk>", "日本 語", "é́ ö", "\x00 \x01", "a" * 50 + " " * 20 + "b", "1 000 000.00", "﷽ ﬁ №"]
        return all(self._count_words(t) == len(self.model.encode(t)) for t in tries)

    def _count_words(self, text: str) -> int:
        """Words with the spaces before them but one, which the encoder's own mark stands for; a text's first word keeps all."""
        if not (words := text.split(" "))[-1]:
            if not (body := text.rstrip(" ")):
                return len(self.model.encode(text))
            tail = "a" + text[len(body) :]
            return self._count_words(body) + len(self.model.encode(tail)) - len(self.model.encode("a"))
        if "" in words:
            words = _with_spaces(words)
        known, total = self.known, 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = len(self.model.encode(w))
                if len(w) <= 40:
                    if len(known) >= WORDS_KEPT:
                        known.clear()
                    known[w] = n
            total += n
        return total

    def count(self, text: str) -> int:
        return self._count_words(text) if self.by_word and "▁" not in text else len(self.model.encode(text))


def _with_spaces(words: list[str]) -> list[str]:
    """Empty words, which runs of spaces make, become spaces before the next word."""
    out, run = [], 0
    for w in words:
        if w:
            out.append(" " * run + w)
            run = 0
        else:
            run += 1
    return out


def cached_counts(cache: DataFrame, version: str) -> DataFrame:
    """digest, n_tokens of one tokenizer version."""
    return cache.where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, model_path: str, cache_path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; the cache at ``cache_path`` grows by what it lacked.

    Without ``cache_path`` an empty cache of this call's own is used. Null text: empty text, 0 tokens. Repeated rows
    are rows of the result; of rows with one id the digests decide which are encoded.
    Empty table: empty result. Extra columns are not read."""
    spark = docs.sparkSession
    model = Path(model_path).read_bytes()
    version = hashlib.sha256(model).hexdigest()
    spool = Spool(spark, "token-counts")
    cache_path = cache_path or spool.path()
    schema = "version string, digest binary, n_tokens long"
    spark.createDataFrame([], schema).write.mode("append").parquet(cache_path)
    text = text_or_empty(text_col)
    digest = F.unhex(F.sha2(text, 256))
    rows = spool.table(docs.select(F.col(quoted(id_col)).alias("id"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")))
    before = cached_counts(spark.read.schema(schema).parquet(cache_path), version)
    first = rows.groupBy("digest").agg(F.min("id").alias("miss"))
    misses = spool.table(first.join(before, "digest", "left_anti").select("miss", F.col("digest").alias("wanted")))
    n = misses.count()
    if n:
        shared = Shared(spark, model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.made(Counter)
            for b in batches:
                done = [(w, c.count(t.decode("utf-8", "replace"))) for w, t in zip(b.column(0).to_pylist(), raw_texts(b.column(1)), strict=True) if hashlib.sha256(t).digest() == w]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in done], pa.binary()), pa.array([k for _, k in done], pa.int64())], names=["digest", "n_tokens"])

        ids = F.broadcast(misses) if n <= BROADCAST_IDS else misses.hint("shuffle_hash")
        wanted = docs.select(F.col(quoted(id_col)).alias("id"), text.alias("text")).join(ids, F.col("id").eqNullSafe(F.col("miss"))).select("wanted", "text")
        new = map_arrow(wanted, run, "digest binary, n_tokens long")
        new.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    counts = cached_counts(spark.read.schema(schema).parquet(cache_path), version)
    return salted_join(rows, counts, "digest", F.col("id")).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
