"""Indicators the reference declares (survey T1-T3); the definitions are ours.

Every indicator is an aggregate with map-side partial aggregation, so a
person, item or municipality that holds a large share of the rows is
collapsed before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def multi_employment(payroll: DataFrame, person: str, employer: str,
                     period: tuple[str, ...] = ("ano", "mes"), min_employers: int = 2) -> DataFrame:
    """People on the payroll of at least ``min_employers`` distinct
    employers (municipalities) in one period. ``count_distinct`` is planned
    as two aggregates: (person, period, employer) is de-duplicated map side
    first, so the second shuffle carries at most one row per employer."""
    counts = payroll.groupBy(person, *period).agg(F.count_distinct(employer).alias("n_employers"))
    return counts.filter(F.col("n_employers") >= min_employers)


def group_median(items: DataFrame, keys: list[str], value: str, out: str = "median_value",
                 method: str = "ranked") -> DataFrame:
    """Exact median per group; an even count interpolates the two middle
    values with Spark's own percentile arithmetic.

    ``method="aggregate"`` is Spark's ``median``: its buffer is a map of the
    group's distinct values, merged in one task per group and held in
    memory, so one huge group can exhaust an executor.

    ``method="ranked"`` (default) never gathers a group: values are counted
    per (group, value) (map-side combined), then per order-preserving bucket
    of the value, first by its logarithm, then by its place between the
    bucket's ends. Only the buckets that hold a middle rank are ranked
    exactly. Buckets are expressions of the value alone, so the answer does
    not depend on partitions. NULL values are ignored, NaN is largest, and
    NULL group keys form a group."""
    if method == "aggregate":
        return items.groupBy(*keys).agg(F.median(value).alias(out))
    group = F.struct(*[F.col(k) for k in keys])  # structs compare NULL fields as equal
    counted = (items.filter(F.col(value).isNotNull())
               .groupBy(group.alias("__g"), F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
               .withColumn("__b", _log_bucket(F.col("__v"))))
    coarse = _middle(counted.withColumn("__from", F.lit(0)), ["__g"], "__b", None)
    inside = counted.join(coarse, ["__g", "__b"])
    width = F.col("__hi") - F.col("__lo")
    place = F.when(width > 0, F.floor((F.col("__v") - F.col("__lo")) / width * F.lit(FINE))).otherwise(F.lit(0))
    inside = inside.select("__g", "__b", "__v", "__c", "__from", "__n", place.cast("long").alias("__f"))
    fine = _middle(inside, ["__g", "__b"], "__f", "__n").select("__g", "__b", "__f", "__from", "__n")
    last_step = inside.select("__g", "__b", "__f", "__v", "__c").join(fine, ["__g", "__b", "__f"])
    order = Window.partitionBy("__g", "__b", "__f").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = last_step.withColumn("__to", F.col("__from") + F.sum("__c").over(order))
    low, high = _middle_ranks(F.col("__n"))
    holds = lambda r: (F.col("__to") - F.col("__c") <= r) & (r < F.col("__to"))
    mid = ranked.groupBy("__g").agg(F.max(F.when(holds(low), F.col("__v"))).alias("__lo"),
                                    F.max(F.when(holds(high), F.col("__v"))).alias("__hi"), F.max("__n").alias("__n"))
    pos = (F.col("__n") - 1) * F.lit(0.5)
    med = F.when(F.floor(pos) == F.ceil(pos), F.col("__lo")).otherwise(
        (F.ceil(pos) - pos) * F.col("__lo") + (pos - F.floor(pos)) * F.col("__hi"))
    return mid.select("__g.*", med.alias(out))


FINE = 4096  # places between the ends of a logarithmic bucket


def _log_bucket(v):
    """16 buckets for each doubling of the absolute value, in the order of the values."""
    size = F.floor(F.log2(F.abs(v)) * 16) + 20_000
    top = F.lit(90_000)
    return (F.when(F.isnan(v), top + 1).when(F.abs(v) == F.lit(float("inf")), F.when(v > 0, top).otherwise(-top))
            .when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size)).cast("long")


def _middle_ranks(n):
    """0-based ranks of the two middle values (one rank twice for odd ``n``)."""
    return F.floor((n - 1) / 2), F.ceil((n - 1) / 2)


def _middle(rows: DataFrame, group: list[str], bucket: str, total: str | None) -> DataFrame:
    """The buckets that hold a middle rank, with the count of values before
    them, the group's count and the bucket's least and largest value."""
    agg = [F.sum("__c").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.max("__from").alias("__from")]
    sums = rows.groupBy(*group, bucket).agg(*agg, *([F.max(total).alias("__n")] if total else []))
    if not total:
        sums = sums.withColumn("__n", F.sum("__c").over(Window.partitionBy(*group)))
    order = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("__to", F.col("__from") + F.sum("__c").over(order))
    low, high = _middle_ranks(F.col("__n"))
    before = F.col("__to") - F.col("__c")
    held = ((before <= low) & (low < F.col("__to"))) | ((before <= high) & (high < F.col("__to")))
    return sums.filter(held).select(*group, bucket, before.alias("__from"), "__n", "__lo", "__hi")


def price_outliers(items: DataFrame, item: str, period: list[str], price: str,
                   k: float = 2.0, out: str = "median_price", method: str = "ranked") -> DataFrame:
    """Rows whose ``price`` is above ``k`` times the median price of the
    same item and period. The per-group medians are joined back by key
    (one row per group); AQE broadcasts them when measured small, or
    splits a skewed key of the large side."""
    med = group_median(items, [item, *period], price, out, method)
    return items.join(med, [item, *period], "inner").filter(F.col(price) > F.lit(k) * F.col(out))


def portal_coverage(plan: DataFrame, loaded: DataFrame, cell_keys: list[str],
                    by: list[str], catalog: DataFrame | None = None) -> DataFrame:
    """Filled cells / planned cells per ``by`` group. Loaded rows are
    reduced to distinct cells (map-side) before the join. Entries of
    ``catalog`` without a planned cell (their vendor has no topics, D14) come
    with zero cells; ``by`` columns the catalog lacks are NULL there."""
    hits = loaded.select(*cell_keys).distinct().withColumn("__hit", F.lit(1))
    joined = plan.join(hits, cell_keys, "left")
    agg = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("planned_cells"),
                                  F.count("__hit").alias("filled_cells"))
    agg = agg.withColumn("coverage", F.round(F.col("filled_cells") / F.col("planned_cells"), 4))
    if catalog is None:
        return agg
    known = [c for c in by if c in catalog.columns]
    bare = catalog.select(*known).distinct().join(plan.select(*known).distinct(), known, "left_anti")
    zero = F.lit(0).cast("long")
    return agg.unionByName(bare.select("*", zero.alias("planned_cells"), zero.alias("filled_cells"), F.lit(0.0).alias("coverage")),
                           allowMissingColumns=True)


def robust_outliers(items: DataFrame, item: str, period: list[str], price: str, k: float = 5.2,
                    out: str = "median_price", spread: str = "mad_price") -> DataFrame:
    """T2, robust: rows whose ``price`` lies more than ``k`` median absolute
    deviations from the median of the same item and period (5.2 deviations
    are about 3.5 standard deviations of a normal sample). The deviations are
    values of a second distributed selection, over the first one's result;
    both are exact and gather no group. A group whose deviation is 0 (half of
    it has one price) gives no verdict."""
    keys = [item, *period]
    placed = items.join(group_median(items, keys, price, out), keys).withColumn("deviation", F.abs(F.col(price) - F.col(out)))
    spreads = group_median(placed, keys, "deviation", spread)
    return placed.join(spreads, keys).filter((F.col(spread) > 0) & (F.col("deviation") > F.lit(k) * F.col(spread)))


def coverage_timeline(plan: DataFrame, loaded: DataFrame, group: tuple[str, ...] = ("topic", "municipio", "prefeitura"),
                      ano: str = "ano", mes: str = "mes") -> DataFrame:
    """T3 over time, per ``group`` of the plan: loaded months and the runs
    they form, the longest gap (before the first and after the last loaded
    month too), staleness (months of the plan after the last loaded one) and
    the first calendar year with all twelve months. Loaded rows become
    distinct months map side; one sorted pass over a group's months follows.
    Months outside the group's plan do not count; a group without a loaded
    month is one gap."""
    number = (F.col(ano) * 12 + F.col(mes) - 1).alias("__i")
    bounds = plan.groupBy(*group).agg(F.min(number).alias("__a"), F.max(number).alias("__b"))
    months = loaded.select(*group, number).distinct().join(bounds, list(group)).filter((F.col("__i") >= F.col("__a")) & (F.col("__i") <= F.col("__b")))
    w = Window.partitionBy(*group).orderBy("__i")
    seen = months.select(*group, "__i", "__a", F.lag("__i").over(w).alias("__prev"), F.lag("__i", 11).over(w).alias("__back"))
    gap = F.col("__i") - F.coalesce("__prev", F.col("__a") - 1) - 1
    full = (F.col("__i") % 12 == 11) & (F.col("__i") - F.col("__back") == 11)
    stats = seen.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_months"), F.count_if(F.col("__prev").isNull() | (gap > 0)).alias("n_runs"), F.max(gap).alias("__gap"),
        F.max("__i").alias("__last"), F.min(F.when(full, F.floor(F.col("__i") / 12))).cast("int").alias("first_full_year"))
    out = bounds.join(stats, list(group), "left")
    tail = F.col("__b") - F.coalesce("__last", F.col("__a") - 1)
    return out.select(*group, F.coalesce("n_months", F.lit(0)).alias("n_months"), F.coalesce("n_runs", F.lit(0)).alias("n_runs"),
                      F.greatest(F.coalesce("__gap", F.lit(0)), tail).alias("longest_gap"), tail.alias("staleness"), "first_full_year")
