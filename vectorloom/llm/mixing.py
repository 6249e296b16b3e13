"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Documents hang under the leaves of a tree domain > language > source. The token budget starts at the root.
Each node deals its budget to its children in proportion to their weights; a child never gets more than
its subtree can supply (tokens times ``max_epochs``), and what it can't take goes to its
siblings by weight, level with level (water-filling). So a shortage is made up among siblings
first, and reaches an ancestor's siblings only where the whole subtree is short.

Water-filling is closed-form: with children sorted by capacity over weight, child i is full if and only if
its ratio is at most (budget - capacities before it) / (weights from it on). All sums are of integers, so
results don't depend on the order of rows.

A leaf with budget b and supply s gives b div s whole epochs, then the longest prefix of one more epoch,
shuffled by MD5 of seed, epoch and id, whose tokens fit in the rest. The prefix sum is
in two levels (a leaf's documents fall into 4,096 buckets by hash prefix; whole buckets are summed first), so that a leaf
with a third of all rows is never ordered in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Spool, quoted, text_or_empty

LEVELS = ("domain", "lang", "source")
#: Rules of the documents table: sources with these numbers form a domain; any other source is ``other``.
DOMAINS = {"web": range(0, 8), "forum": range(8, 14), "reference": range(14, 20)}
#: Weights of the production query, in thousandths; children that are not named weigh DEFAULT_WEIGHT.
WEIGHTS: dict[str, Mapping[str, int]] = {"domain": {"web": 500, "forum": 200, "reference": 300}, "lang": {"en": 550, "de": 150, "fr": 150, "es": 150}, "source": {}}
DEFAULT_WEIGHT = 100
SEED = 17
MAX_EPOCHS = 4
#: The budget as a fraction of all tokens there are, in thousandths.
BUDGET_PERMILLE = 600


def token_count(text_col: str = "text") -> Column:
    """Tokens as the budget counts them: maximal runs of characters other than ASCII white space."""
    return F.size(F.filter(F.split(text_or_empty(text_col), r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("long")


def domain_of(source: Column) -> Column:
    number = F.regexp_extract(source, r"^src([0-9]{1,4})$", 1).try_cast("int")  # null for any other source
    out = F.lit("other")
    for name, of in DOMAINS.items():
        out = F.when(number.between(of[0], of[-1]), F.lit(name)).otherwise(out)
    return out


def weigh(column: Column, weights: Mapping[str, int], default: int = DEFAULT_WEIGHT) -> Column:
    out = F.lit(default).cast("long")
    for name, w in weights.items():
        out = F.when(column == name, F.lit(w).cast("long")).otherwise(out)
    return out


def water_fill(children: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Adds ``budget`` (bigint) to children with columns parent..., cap, w, parent_budget.

    A child whose weight is zero gets nothing."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), *[F.col(c) for c in children.columns if c in LEVELS])
    before, from_on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    full = F.col("cap") * F.col("w_on") <= (F.col("parent_budget") - F.col("cap_before")) * F.col("w")
    marked = (
        children.where("w > 0").withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_on", F.sum("w").over(from_on))
        .withColumn("full", full)
    )
    all_of = Window.partitionBy(*parent)
    rest = F.col("parent_budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(all_of)
    weight = F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0)).over(all_of)
    shared = marked.withColumn("rest", rest).withColumn("weight", weight)
    share = F.expr("CASE WHEN weight > 0 THEN rest * w div weight END")  # whole numbers: a double is inexact beyond 2^53
    return shared.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", share))).drop("cap_before", "w_on", "full", "parent_budget", "rest", "weight")


def leaf_budgets(leaves: DataFrame, total: Column | int, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """domain, lang, source, supply, budget from leaves with domain, lang, source, supply; ``total`` may be an aggregate of supply."""
    total = total if isinstance(total, Column) else F.lit(total).cast("long")
    capped = leaves.withColumn("cap", F.col("supply") * max_epochs)
    budget = capped.agg(F.least(total, F.sum("cap")).alias("parent_budget"))
    parents: list[str] = []
    for k, level in enumerate(LEVELS):
        nodes = capped.groupBy(*LEVELS[: k + 1]).agg(F.sum("cap").alias("cap"))
        if parents:
            nodes = nodes.join(budget.withColumnRenamed("budget", "parent_budget").select(*parents, "parent_budget"), parents)
        else:
            nodes = nodes.withColumn("root", F.lit(1)).join(budget.withColumn("root", F.lit(1)), "root")
        nodes = nodes.withColumn("w", weigh(F.col(level), weights.get(level, {})))
        budget = water_fill(nodes, parents or ["root"])
        parents = [*parents, level]
    return leaves.join(budget.select(*LEVELS, "budget"), list(LEVELS))


def running(column: str, *by: str, order: str) -> Column:
    """Sum of ``column`` over the rows before this one."""
    return F.coalesce(F.sum(column).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", weights: Mapping[str, Mapping[str, int]] = WEIGHTS, permille: int = BUDGET_PERMILLE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, n_copies of every document that the mixture takes at least once.

    Null lang or source: the leaf ``unknown``. Null or empty texts have no tokens; they cost nothing and come
    once for each whole epoch, or with a prefix that reaches them. Repeated rows are rows of their own (ties in the
    shuffled order stay together). Empty table: empty result. Extra columns are not read."""
    spool = Spool(docs.sparkSession, "mix")
    source = F.coalesce(F.col(quoted(source_col)).cast("string"), F.lit("unknown"))
    lang = F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("unknown"))
    rows = spool.table(docs.select(F.col(quoted(id_col)).alias("doc_id"), (domain_of(source) if domain is None else domain).alias("domain"), lang.alias("lang"), source.alias("source"), token_count(text_col).alias("n_tokens")))
    leaves = spool.table(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")))
    plan = spool.table(
        leaf_budgets(leaves, F.floor(F.sum("supply") * permille / 1000).cast("long"), weights, max_epochs)
        .withColumn("whole", F.when(F.col("supply") > 0, F.floor(F.col("budget") / F.col("supply"))).otherwise(1).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("supply")).select(*LEVELS, "whole", "rest")
    )
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole") + 1, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    dealt = rows.join(plan, list(LEVELS)).withColumn("place", place).withColumn("bucket", F.substring("place", 1, 3))
    sums = dealt.where("rest > 0").groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    # of a leaf's 4,096 buckets, sums run over 16 groups and over the 256 of each group
    sums = sums.withColumn("group", F.substring("bucket", 1, 1))
    groups = sums.groupBy(*LEVELS, "group").agg(F.sum("bucket_tokens").alias("group_tokens"))
    groups = groups.withColumn("group_start", running("group_tokens", *LEVELS, order="group")).drop("group_tokens")
    inside = sums.withColumn("inside", running("bucket_tokens", *LEVELS, "group", order="bucket"))
    starts = inside.join(groups, [*LEVELS, "group"]).select(*LEVELS, "bucket", (F.col("group_start") + F.col("inside")).alias("start"))
    inner = Window.partitionBy(*LEVELS, "bucket").orderBy("place")
    reach = F.col("start") + F.sum("n_tokens").over(inner)
    out = dealt.join(starts, [*LEVELS, "bucket"], "left").withColumn("n_copies", F.col("whole") + F.when((F.col("rest") > 0) & (reach <= F.col("rest")), 1).otherwise(0))
    return out.where("n_copies > 0").select(F.col("doc_id").alias(id_col), "domain", F.col("lang").alias(lang_col), F.col("source").alias(source_col), "n_tokens", "n_copies")
