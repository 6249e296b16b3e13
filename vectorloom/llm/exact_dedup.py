"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame operations only.

Documents are dealt into runs by a hash of their id, as many as there are partitions; each run is sorted by digest and equal
digests of it are merged by a sort aggregate. Then come binomial rounds: ``fan_in`` neighbouring runs at a time exchange
slices of their digests, so that in each round there are ``fan_in`` times fewer runs of as many times more slices, and every partition
merges its slice of ``fan_in`` sorted runs into one sorted run; the last run has one slice a partition. At every level the
surviving identifier of each digest stays together with what verifies it: the text's length in bytes and a second,
independent hash are part of the merge key, so two texts meet only if all three agree.

A text that a third of all rows share is split over all runs: no task ever gets more of it than
one run holds, and each later round gets at most ``fan_in`` rows for it. The way down is the same
tree: survivors reach runs (one row for each digest and run), and runs reach documents. Texts are read once: their digests are
a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Spool, fresh, quoted, text_or_empty

FAN_IN = 8
KEY = ("digest", "n_bytes", "check")


def run_count(df: DataFrame, fan_in: int = FAN_IN) -> int:
    """Power of ``fan_in``, at least the session's shuffle partitions: runs grow with the cluster."""
    n, want = fan_in, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while n < want:
        n *= fan_in
    return n


def digests(docs: DataFrame, runs: int, id_col: str = "doc_id", text_col: str = "text", normalise=None) -> DataFrame:
    """doc_id, run and the merge key of each row; null texts count as empty. ``normalise``: Column to Column."""
    text: Column = text_or_empty(text_col)
    text = normalise(text) if normalise else text
    return docs.select(
        F.col(quoted(id_col)).alias("doc_id"),
        F.pmod(F.xxhash64(quoted(id_col)), F.lit(runs)).cast("int").alias("run"),
        F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("check"),
    )


def _chosen(keep: str) -> Column:
    """The surviving id of a group, as a struct: compared by a sort aggregate. Null ids come last."""
    there = F.col("keep_id").isNotNull()
    return F.max(F.struct(there.alias("t"), "keep_id")) if keep == "max" else F.min(F.struct((~there).alias("t"), "keep_id"))


def merged(level: DataFrame, runs: int, slices: int, keep: str) -> DataFrame:
    """One row for each run and digest of rows (run, KEY, keep_id, group_size): each partition sorts its slice of a run and merges equal digests."""
    part = F.pmod(F.xxhash64("digest"), F.lit(slices)).cast("int")
    sorted_runs = level.withColumn("slice", part).repartition(max(runs * slices, 1), "run", "slice").sortWithinPartitions("run", "slice", *KEY)
    return sorted_runs.groupBy("run", "slice", *KEY).agg(_chosen(keep).alias("c"), F.sum("group_size").alias("group_size")).select("run", *KEY, F.col("c.keep_id").alias("keep_id"), "group_size")


def tree_merge(leaves: DataFrame, runs: int, fan_in: int = FAN_IN, keep: str = "max") -> DataFrame:
    """From one row for each run and digest (keep_id, group_size) to one for each digest."""
    level, left = leaves, runs
    while left > 1:
        left = -(-left // fan_in)
        level = merged(level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")), left, -(-runs // left), keep)
    return level.drop("run")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = FAN_IN, runs: int | None = None, normalise=None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Of equal texts the row with the largest (``keep='max'``) or smallest id stays. Null text: empty
    text. Repeated rows with one id: each is a row of the result, one of them is kept. A null id
    survives only where its whole group has null ids. Empty table: empty result. Extra columns are not read."""
    runs = runs or run_count(docs, fan_in)
    rows = Spool(docs.sparkSession, "exact-dedup").table(digests(docs, runs, id_col, text_col, normalise))
    leaves = merged(rows.withColumnRenamed("doc_id", "keep_id").withColumn("group_size", F.lit(1).cast("long")), runs, 1, keep)
    top = tree_merge(leaves, runs, fan_in, keep)
    settled = leaves.select("run", *KEY).join(top, list(KEY)).hint("shuffle_hash")
    one = Window.partitionBy("run", *KEY, "doc_id").orderBy("doc_id")
    return (
        rows.withColumn("turn", F.row_number().over(one)).join(settled, ["run", *KEY])
        .select(F.col("doc_id").alias(id_col), "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"), F.col("digest").alias("text_sha256"))
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they came. Null texts count as empty; of rows with one id and
    text one stays, whichever, also where other columns differ; a null id stays only where its whole group has none. Empty table:
    empty result."""
    spool = Spool(docs.sparkSession, "exact-dedup")
    kept = spool.table(exact_duplicates(docs, id_col, text_col, keep).where("kept").select(F.col(quoted(id_col)).alias("id"), "text_sha256", "group_size"))
    digest, other, key = fresh(docs, "digest", "kept_digest", "kept_id")
    many = kept.groupBy("id").count().where("count > 1").select("id")
    ids = kept.select(F.col("id").alias(key), F.col("text_sha256").alias(other)).hint("shuffle_hash")
    same = F.col(quoted(id_col)).eqNullSafe(F.col(key)) & (F.col(digest) == F.col(other))
    out = docs.withColumn(digest, F.sha2(text_or_empty(text_col), 256)).join(ids, same, "left_semi")
    if not repeated_ids(docs, id_col, spool) and many.isEmpty():
        return out.drop(digest)
    return out.dropDuplicates([id_col, digest]).drop(digest)


def repeated_ids(docs: DataFrame, id_col: str, spool: Spool) -> bool:
    """Whether any id stands in more than one row (ids alone are read and shuffled)."""
    return not docs.groupBy(F.col(quoted(id_col))).count().where("count > 1").isEmpty()
