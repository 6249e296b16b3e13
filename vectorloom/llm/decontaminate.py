"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows.

Texts are normalised to lower-cased words joined by single spaces; each window of ``width`` consecutive
words of a benchmark item is a pattern between spaces. A document's normalised text goes
through the automaton once; each match's end is a word boundary, from which the words it covers follow and,
where asked for, their places in the original text.

Windows are made and grouped by Spark. If all of them fit ``BLOCK_BYTES`` (the usual case) they are one block, one automaton and one
pass over the documents, which are never shuffled. A larger benchmark is split by a hash of the windows into blocks of about that size,
each collected, sent and scanned for in a pass of its own, so that neither the driver nor a worker ever holds more than one block;
what the passes find is written, keyed by the text's digest, and merged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, Spool, fresh, map_arrow, per_text, quoted, raw_texts, salted_join, text_or_empty, words_of

WIDTH = 10
#: Bytes of windows and item ids in one automaton, some forty times that in memory.
BLOCK_BYTES = 8 << 20
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def windows(text: bytes | None, width: int = WIDTH) -> set[bytes]:
    """Every run of ``width`` words, space-joined; a shorter text is one window, a text without words none."""
    w = words_of(text)
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


Block = dict[bytes, list[str]]


def window_table(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """window, items, block of all items, and the number of blocks. Null and wordless texts have no windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, i if i is not None else "") for i, t in zip(b.column(0).to_pylist(), raw_texts(b.column(1)), strict=True) for w in windows(t, width)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.string()))], names=["win", "item"])

    read = benchmark.select(F.col(quoted(id_col)).cast("string").alias("i"), F.col(quoted(text_col)).cast("string").alias("t"))
    spool = Spool(benchmark.sparkSession, "windows")
    made = spool.table(map_arrow(read, run, "win binary, item string").groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items")))
    size = F.octet_length("win") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 8)
    n = max(1, -(-int(made.agg(F.sum(size.cast("long"))).first()[0] or 0) // block_bytes))
    return made.withColumn("block", F.pmod(F.xxhash64("win"), F.lit(n)).cast("int")), n


def collected(table: DataFrame, k: int) -> Block:
    """One block; its size is bounded by ``window_table``."""
    return {bytes(r.win): list(r["items"]) for r in table.where(F.col("block") == k).select("win", "items").collect()}


class Scanner:
    """The automaton of one block, made once in each worker."""

    def __init__(self, block: Block) -> None:
        self.automaton = ahocorasick.Automaton()
        for w, items in block.items():
            self.automaton.add_word(f" {(s := w.decode('utf-8', 'replace'))} ", (len(s) + 2, s.count(" ") + 1, items))
        self.automaton.make_automaton()
        self.empty = not block

    def scan(self, texts: list[bytes]) -> list[tuple[int, np.ndarray | None, list[str]]]:
        """For each text: number of words, indexes of hit words (None if none), items with occurring windows."""
        out = []
        for t in texts:
            w = words_of(t)
            line = f" {b' '.join(w).decode('utf-8', 'replace')} " if w else ""
            found = [(end - length + 1, n, who) for end, (length, n, who) in self.automaton.iter(line)] if not self.empty else []
            if not found:
                out.append((len(w), None, []))
                continue
            spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), "<u4") == 32)
            starts = np.searchsorted(spaces, [s for s, _, _ in found])
            change = np.zeros(len(w) + 1, np.int64)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + [n for _, n, _ in found], -1)
            out.append((len(w), np.flatnonzero(np.cumsum(change[:-1])), sorted({x for _, _, who in found for x in who})))
        return out


def _places(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Hit words: number, and place (code points, end exclusive) in the original text."""
    places = [m.span() for m in _WORD.finditer(text.lower().decode("utf-8", "replace"))]  # bytes.lower: A-Z only
    return [{"word": int(k), "start": places[k][0], "end": places[k][1]} for k in hit]


def _spans(words: Column) -> Column:
    """Runs of hit words (word, start, end; by word) as places in the original text."""
    none = F.array().cast("array<struct<last:int,start:long,end:long>>")
    runs = F.aggregate(words, none, lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, -1)["last"] + 1 == x["word"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(x["word"].cast("int").alias("last"), F.element_at(a, -1)["start"].alias("start"), x["end"].alias("end"))))).otherwise(F.concat(a, F.array(F.struct(x["word"].cast("int").alias("last"), x["start"].alias("start"), x["end"].alias("end"))))))
    return F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))


def _joined_runs(places: list[dict[str, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    last = -2
    for p in places:
        if out and p["word"] == last + 1:
            out[-1]["end"] = p["end"]
        else:
            out.append({"start": p["start"], "end": p["end"]})
        last = p["word"]
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_WORDS = pa.list_(pa.struct([("word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def _found_of(docs: DataFrame, text_col: str, block: Block) -> DataFrame:
    """digest, words, items of the texts in which windows of one block occur."""
    shared = Shared(docs.sparkSession, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = raw_texts(b.column(0))
            hits = [(hashlib.sha256(t).digest(), _places(t, h), who) for t, (_, h, who) in zip(texts, shared.made(Scanner).scan(texts), strict=True) if h is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in hits], t) for k, t in enumerate((pa.binary(), _WORDS, pa.list_(pa.string())))], names=["digest", "words", "items"])

    return map_arrow(docs.select(text_or_empty(text_col).alias("text")), run, "digest binary, words array<struct<word:long,start:long,end:long>>, items array<string>").dropDuplicates(["digest"])


def found_in_passes(docs: DataFrame, table: DataFrame, blocks: int, text_col: str) -> DataFrame:
    """digest, words (sorted), items (sorted) of the texts with hits, from a pass for each block."""
    spool = Spool(docs.sparkSession, "decontaminate")
    parts = [spool.table(_found_of(docs, text_col, collected(table, k))) for k in range(blocks)]
    each = docs.sparkSession.read.schema(parts[0].schema).parquet(*(p._spooled_at for p in parts))
    merged = each.groupBy("digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return spool.table(merged)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as strings, sorted), spans (start, end in the original) of every row.

    Null text: no words. Items that repeat, or share windows, are each reported. Empty benchmark: no hits. Empty table: empty result.
    Repeated rows are rows of the result; extra columns are not read."""
    table, n = window_table(benchmark, item_col, "text", width, block_bytes)
    if n > 1:
        def count(texts: list[bytes]) -> dict[str, list]:
            return {"n_words": [len(words_of(t)) for t in texts], "digest": [hashlib.sha256(t).digest() for t in texts]}

        rows = per_text(docs, id_col, text_col, count, "n_words long, digest binary", pa.schema([("n_words", pa.int64()), ("digest", pa.binary())]))
        found = found_in_passes(docs, table, n, text_col)
        every = rows.select("digest").distinct().join(found, "digest", "left")
        out = salted_join(rows, every, "digest", F.col(quoted(id_col)))
        return out.select(F.col(quoted(id_col)), "n_words", F.when(F.col("words").isNull(), 0).otherwise(F.size("words")).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce(_spans(F.col("words")), F.array().cast("array<struct<start:long,end:long>>")).alias("spans"))
    shared = Shared(docs.sparkSession, collected(table, 0))

    def score(texts: list[bytes]) -> dict[str, list]:
        found = shared.made(Scanner).scan(texts)
        return {
            "n_words": [n for n, _, _ in found], "n_hit": [0 if h is None else len(h) for _, h, _ in found], "items": [x for _, _, x in found],
            "spans": [[] if h is None else _joined_runs(_places(t, h)) for t, (_, h, _) in zip(texts, found, strict=True)],
        }

    arrow = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", _SPANS)])
    return per_text(docs, id_col, text_col, score, "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>", arrow)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs`` without any hit, columns as they came; with one block rows pass through and nothing is shuffled.

    Null and empty texts have no words and stay; each of repeated rows is judged by its text; empty tables: nothing goes, or nothing is there."""
    table, n = window_table(benchmark, item_col, "text", width, block_bytes)
    if n > 1:
        digest, key = fresh(docs, "digest", "found_digest")
        found = found_in_passes(docs, table, n, text_col).select(F.col("digest").alias(key)).hint("shuffle_hash")
        marked = docs.withColumn(digest, F.unhex(F.sha2(text_or_empty(text_col), 256)))
        return marked.join(found, F.col(digest) == F.col(key), "left_anti").drop(digest)
    shared = Shared(docs.sparkSession, collected(table, 0))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [h is None for _, h, _ in shared.made(Scanner).scan(raw_texts(b.column(at)))]
            yield b.filter(pa.array(clean, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
