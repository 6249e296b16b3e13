"""What the operators of this folder share: words, shared storage, Arrow plumbing."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: ASCII letters lower-cased, everything else in ASCII but digits a separator, other bytes kept:
#: after it, ``bytes.split()`` gives the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

#: Rows and bytes that an Arrow function gets at a time.
ROWS_PER_BATCH, BATCH_BYTES = 500, 64 << 20


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text; none for null."""
    return text.translate(WORD_BYTES).split() if text else []


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty. Malformed UTF-8 passes through."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind, safe=False).to_pylist()]


def str_texts(column: pa.Array) -> list[str]:
    """Texts as str; null becomes empty, malformed UTF-8 becomes U+FFFD."""
    return [x.decode("utf-8", "replace") for x in raw_texts(column)]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` has not got, whatever extra columns came along."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches small enough that very long texts stay within a worker's memory."""
    ship(df.sparkSession)
    return df.mapInArrow(_cut(function), schema)


def _cut(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` over slices of at most ``ROWS_PER_BATCH`` rows and ``BATCH_BYTES``, whatever the session's batches are."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = max(1, min(ROWS_PER_BATCH, len(b) * BATCH_BYTES // max(b.nbytes, 1)))
            for at in range(0, max(len(b), 1), rows):
                yield b.slice(at, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(slices(batches))

    return run


def salted_join(rows: DataFrame, named: DataFrame, key: str, by: Column) -> DataFrame:
    """``rows`` joined with ``named`` (one row for each ``key``), where one key may hold a large part of ``rows``: they are dealt by a hash
    of ``by`` to as many salts as there are shuffle partitions; each (salt, key) there is gets its own row of ``named``."""
    (salt,) = fresh(rows, "salt")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))
    own = dealt.groupBy(salt, key).agg(F.lit(1).alias("one")).drop("one").join(named, key)
    return dealt.join(own, [salt, key]).drop(salt)


def per_text(df: DataFrame, id_col: str, text_col: str, score: Callable[[list[bytes]], dict[str, list]], schema: str, arrow: pa.Schema) -> DataFrame:
    """One row for each row of ``df``: its id beside what ``score`` gives for its batch of texts.
    ``schema`` and ``arrow`` describe the added columns. Extra columns of ``df`` are not read."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = score(raw_texts(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(cols[f.name], f.type) for f in arrow)], names=["id", *arrow.names])

    out = map_arrow(df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text")), run, f"id {kind}, {schema}")
    return out.withColumnRenamed("id", id_col)


_made: dict[str, object] = {}


class Shared:
    """A broadcast value of bounded size, and what a worker makes of it, once for all its tasks."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.token, self.sent = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    def made(self, make: Callable[[object], object]) -> object:
        if self.token not in _made:
            _made.clear()  # of one query at a time
            _made[self.token] = make(self.sent.value)
        return _made[self.token]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a folder of our own
    only where that is unset, as in tests on one machine."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if not (known := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vectorloom-"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = known.get()
    return at.rstrip("/")


class Spool:
    """Tables written to the shared folder: they cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self) -> str:
        self.n += 1
        return f"{self.at}/{self.n}"

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it again."""
        df.write.parquet(at := self.path())
        out = self.spark.read.schema(df.schema).parquet(at)
        out._spooled_at = at
        return out

    def release(self) -> None:
        """Let the driver notice which plans are over, so that Spark removes their shuffle files now and not at some later collection."""
        for _ in range(2):  # what the first round frees may have held shuffles
            time.sleep(0.3)  # until the listeners have let go of the last plan
            gc.collect()
            self.spark._jvm.System.gc()
        time.sleep(0.3)

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table of this spool that nothing reads any more."""
        if at := getattr(df, "_spooled_at", None):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keep_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids`` (distinct, column ``id``). The ids are the hashed side:
    rows with texts are shuffled once at most, and never sorted."""
    (key,) = fresh(docs, "keep_id")
    ids = ids.select(F.col("id").alias(key)).hint("shuffle_hash")
    return docs.join(ids, F.col(quoted(id_col)).eqNullSafe(F.col(key)), "left_semi")


def components(spool: Spool, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds; an error if ``max_rounds`` do not settle (components of
    n nodes take some log n rounds).

    ``edges``: columns a, b (comparable, no nulls). Returns node, root (smallest node of its
    component) for every node with an edge to another one. A hub's edges are only ever aggregated
    with partial sums or joined (AQE splits them), never gathered. Each round is a written table."""
    e = spool.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.where("m < a")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", "m"))
        new = spool.table(small.distinct())
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        spool.drop(e)
        e = new
        if now == before or not now[0]:
            return e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").union(e.select("b", "b").distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def sorted_csv(values: Sequence[str]) -> str:
    return ",".join(sorted(set(values)))
