"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification, components.

Fingerprints that differ in at most ``radius`` bits agree on at least two of four 16-bit blocks (radius 2),
so each pair of blocks makes a 32-bit join key and close pairs meet on one of the six. Equal
fingerprints are one node from the start, so exact copies make no pairs. In a bucket of up to ``pair_limit``
fingerprints the join emits the pairs, which Hamming distance verifies. A larger bucket is linked exactly without
pairs: two fingerprints are within distance 2 if and only if their balls of radius 1 share a point, and
agreeing on the key they share one that differs from them outside the key only. So each member goes to its 33
points there, and all at a point are linked to the smallest: 33 rows a member, whatever the size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Spool, components, fresh, keep_ids, map_arrow, per_text, quoted, raw_texts, salted_join

SHINGLE = 3
PAIR_LIMIT = 48
BLOCKS = tuple(0xFFFF << s for s in (0, 16, 32, 48))
#: For each of the six keys: the mask of its two blocks, as Spark's signed long.
MASKS = tuple(((a | b) ^ (1 << 63)) - (1 << 63) for a, b in combinations(BLOCKS, 2))
SLICE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if it is set in over half the shingles' XXH64 (seed 42)."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    ones, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, SLICE):  # so that a very long text needs no 64 times its shingles
        part = words[at : at + SLICE + shingle - 1]
        h = np.array([xxhash.xxh64_intdigest(b" ".join(w), 42) for w in zip(*(part[i:] for i in range(shingle)))], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _signed(texts: list[bytes]) -> dict[str, list]:
    return {"fp": [f - (1 << 64) if f >> 63 else f for f in map(fingerprint, texts)]}


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, a signed long with the fingerprint's bits. Null text: empty, fingerprint zero."""
    return per_text(docs, id_col, text_col, _signed, "fp long", pa.schema([("fp", pa.int64())]))


def links(prints: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges a, b over distinct fingerprints (column fp) that join every two within 2 bits, directly or by way of others."""
    keyed = prints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in MASKS))).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(sizes, ["t", "key"])
    few, many = met.where(F.col("n") <= pair_limit), met.where(F.col("n") > pair_limit)
    pairs = (
        few.select("t", "key", F.col("fp").alias("a")).join(few.select("t", "key", F.col("fp").alias("b")), ["t", "key"])
        .where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    )
    flips = F.array(F.lit(0), *(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(64)))
    masks = F.array(*map(F.lit, MASKS))
    points = many.select("fp", "t", F.explode(flips).alias("flip"), F.element_at(masks, F.col("t") + 1).alias("mask")).where(F.col("flip").bitwiseAND(F.col("mask")) == 0).select("fp", "t", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    least = points.groupBy("t", "point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = points.join(least, ["t", "point"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.union(stars).distinct()


def grouped(docs: DataFrame, id_col: str, text_col: str, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """id_col, fp, root (smallest fingerprint of the component), component_id (its smallest id) of every row."""
    spool = Spool(docs.sparkSession, "simhash")
    prints = spool.table(fingerprints(docs, id_col, text_col))
    nodes = spool.table(prints.groupBy("fp").agg(F.min(quoted(id_col)).alias("least")))
    roots = components(spool, links(nodes.select("fp"), pair_limit)).select(F.col("node").alias("fp"), "root")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = salted_join(named, smallest, "root", F.col("fp")).select("fp", "root", "component_id")
    return salted_join(prints, classes, "fp", F.col(quoted(id_col)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest id reachable) of every row.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows are rows of the
    result; null ids are ignored in the choice of the smallest. Empty table: empty result. Extra columns are not read."""
    return grouped(docs, id_col, text_col, pair_limit).select(F.col(quoted(id_col)), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group stays: the one whose id is the smallest. Columns as they came.

    Where ids repeat (or are null) one row of each group stays: of the rows with its smallest id those of the smallest fingerprint, and of
    these one, whichever. A group of null ids only keeps one row too. Null and empty texts are a group. Empty table: empty result."""
    spool = Spool(docs.sparkSession, "simhash-kept")
    key = F.col(quoted(id_col))
    first = spool.table(grouped(docs, id_col, text_col).where(key.eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("fp").alias("keep"), F.min(key).alias("id")).select("id", "keep"))
    if not _repeated(docs, id_col):
        return keep_ids(docs, first.select("id"), id_col)
    fp, other, kept, row = fresh(docs, "fp", "kept_fp", "kept_id", "row")
    one = Window.partitionBy(key, F.col(fp)).orderBy(F.lit(0))
    ids = first.select(F.col("id").alias(kept), F.col("keep").alias(other))
    left = with_prints(docs, text_col, fp).join(ids, key.eqNullSafe(F.col(kept)) & (F.col(fp) == F.col(other)), "left_semi")
    return left.withColumn(row, F.row_number().over(one)).where(F.col(row) == 1).select(*map(quoted, docs.columns))


def _repeated(docs: DataFrame, id_col: str) -> bool:
    """Whether any id stands in more than one row, or there is a null one (ids alone are read and shuffled)."""
    key = F.col(quoted(id_col))
    return not docs.groupBy(key.alias("k")).count().where("count > 1 OR k IS NULL").isEmpty()


def with_prints(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with the fingerprint as a further column."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_signed(raw_texts(b.column(at)))["fp"], pa.int64())], names=[*b.schema.names, name])

    return map_arrow(docs, run, StructType([*docs.schema.fields, StructField(name, LongType())]))
