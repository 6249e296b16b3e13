"""Statistics of benches and of precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import cosine_similarity, norm


#: Slices that the values of one group are dealt to, and the most groups that are sliced: with more, groups are work enough for all tasks.
SLICES, MOST_GROUPS = 256, 1000


def _cumulated(df: DataFrame, keys: list[str], value: str, *sums: Column) -> DataFrame:
    """keys, value, _t (rows), _before (rows of the group with smaller values), _n (rows of the group) and ``sums`` for each distinct value.

    Equal values are summed first. A group of any size is then cut at approximate quantiles, cumulated within each slice, and the slices' totals
    are cumulated in turn, so no task orders a whole group. The cuts are made once, on the driver (at most ``MOST_GROUPS * SLICES`` values):
    they decide who works, not what comes out. Nulls count as no rows, but keep their group; null keys are a group."""
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("_t"), *sums)
    points = F.array(*(F.lit(i / SLICES) for i in range(1, SLICES)))
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, points, 10 * SLICES).alias("_cuts"))
    known = cuts.limit(MOST_GROUPS + 1).collect()
    if len(known) > MOST_GROUPS:
        whole = Window.partitionBy(*keys)
        return counts.withColumn("_before", F.sum("_t").over(whole.orderBy(value)) - F.col("_t")).withColumn("_n", F.sum("_t").over(whole))
    local = df.sparkSession.createDataFrame(known, cuts.schema)
    slice_ = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0))
    dealt = _joined(counts, local, keys).withColumn("_slice", F.greatest(slice_, F.lit(0))).drop("_cuts")
    totals = dealt.groupBy(*keys, "_slice").agg(F.sum("_t").alias("_all"))
    whole = Window.partitionBy(*keys)
    totals = totals.withColumn("_earlier", F.sum("_all").over(whole.orderBy("_slice")) - F.col("_all")).withColumn("_n", F.sum("_all").over(whole)).drop("_all")
    within = F.sum("_t").over(Window.partitionBy(*keys, "_slice").orderBy(value)) - F.col("_t")
    return _joined(dealt.withColumn("_within", within), totals, [*keys, "_slice"]).withColumn("_before", F.col("_within") + F.col("_earlier")).drop("_within", "_earlier", "_slice")


def _joined(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the columns of a table of bounded size; nulls in ``on`` meet."""
    other = small.select(*(F.col(k).alias(f"_on{i}") for i, k in enumerate(on)), *(c for c in small.columns if c not in on))
    same = [F.col(k).eqNullSafe(F.col(f"_on{i}")) for i, k in enumerate(on)]
    return rows.join(F.broadcast(other), same).drop(*(f"_on{i}" for i in range(len(on))))


def summary(df: DataFrame, keys: list[str], value: str, points: tuple[float, ...] = (0.5, 0.9, 0.95), ranks: tuple[float, ...] = ()) -> DataFrame:
    """n, mean, min, max, percentiles with linear interpolation, and by nearest rank (``ranks``; one of the values), by group."""
    rows = _cumulated(df, keys, value, F.sum(value).alias("_sum"))
    after = F.col("_before") + F.col("_t")

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("_before") <= index) & (index < after), F.col(value)))

    out = [F.max("_n").alias("n"), F.try_divide(F.sum("_sum"), F.max("_n")).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")]
    for p in points:
        exact = F.lit(p) * (F.col("_n") - 1)
        low, share = at(F.floor(exact)), F.max(exact - F.floor(exact))
        out.append((low * (1 - share) + at(F.ceil(exact)) * share).alias(f"p{round(p * 100)}"))
    out += [F.min(F.when((F.col("_t") > 0) & (F.try_divide(after, F.col("_n")) >= p), F.col(value))).alias(f"rank{round(p * 100)}") for p in ranks]
    return rows.groupBy(*keys).agg(*out)


def nearest_rank(df: DataFrame, keys: list[str], value: str, point: float) -> DataFrame:
    """The percentile that is one of the values."""
    return summary(df, keys, value, (), (point,)).select(*keys, F.col(f"rank{round(point * 100)}").alias("value"))


def mann_whitney(df: DataFrame, keys: list[str], sample: str, value: str, first: str) -> DataFrame:
    """keys, n1, n2, u, z, p: two-sided test of the sample ``first`` against the others, normal approximation with ties and continuity.
    Rows without a value don't count."""
    one = F.col(sample).eqNullSafe(F.lit(first))
    rows = _cumulated(df.where(F.col(value).isNotNull()), keys, value, F.count(F.when(one, 1)).alias("_n1"))
    t, rank = F.col("_t"), F.col("_before") + (F.col("_t") + 1) / 2
    sums = rows.groupBy(*keys).agg(F.sum("_n1").alias("n1"), F.sum(t - F.col("_n1")).alias("n2"), F.sum(F.col("_n1") * rank).alias("r1"), F.sum((t * t - 1) * t.cast("double")).alias("ties"))
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    sigma = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0))))
    z = F.when(sigma > 0, F.greatest(F.abs(u - F.col("n1") * F.col("n2") / 2.0) - 0.5, F.lit(0.0)) / sigma).otherwise(0.0)
    return sums.select(*keys, "n1", "n2", u.alias("u"), z.alias("z"), _two_sided(z).alias("p"))


def _two_sided(z):
    """2 (1 - Phi(z)) for z >= 0, to 1.5e-7."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def drift(df: DataFrame, exact: str, other: str, exact_q: str, other_q: str) -> DataFrame:
    """One row: share of int8 bytes that differ, worst cosine, largest relative L2 distance of two columns of vectors."""
    apart = F.zip_with(F.col(exact).cast("array<double>"), F.col(other).cast("array<double>"), lambda a, b: a - b)
    changed = F.size(F.filter(F.zip_with(exact_q, other_q, lambda a, b: a != b), lambda x: x))
    return df.agg((F.sum(changed) / F.sum(F.size(exact_q))).alias("change_rate"), F.min(cosine_similarity(exact, other)).alias("min_cosine"), F.max(F.when(norm(exact) > 0, norm(apart) / norm(exact))).alias("max_rel_l2"))


def compare_results(left: DataFrame, right: DataFrame, id_col: str, vec: str) -> DataFrame:
    """id, cosine of two backends' vectors of the same rows."""
    return left.select(id_col, F.col(vec).alias("_a")).join(right.select(id_col, F.col(vec).alias("_b")), id_col).select(id_col, cosine_similarity("_a", "_b").alias("cosine"))
