"""Exact order statistics for groups of any size.

``percentile`` and a ranking window both hold a whole group in one task. These versions first count distinct
values (combined map-side), then place values into monotone buckets: the per-group histogram has a bounded number
of rows, and only (group, bucket) pairs are ever ordered together. Results equal the plain definitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import join_on

SCALE = 1024.0


def value_bucket(v: Column, scale: float = SCALE) -> Column:
    """Non-decreasing bucket number of a double: about 0.1 % wide, at most ~1.5 million buckets over all doubles."""
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * F.lit(scale))).cast("bigint")


def _value_counts(df: DataFrame, keys: list[str], value: str, scale: float) -> tuple[DataFrame, DataFrame]:
    counts = (df.where(F.col(value).isNotNull())
              .groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
              .withColumn("__b", value_bucket(F.col("__v"), scale)))
    hist = counts.groupBy(*keys, "__b").agg(F.sum("__c").alias("__bc"))
    order = Window.partitionBy(*keys).orderBy("__b")
    hist = (hist.withColumn("__cum", F.sum("__bc").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("__n", F.sum("__bc").over(Window.partitionBy(*keys)))
            .withColumn("__before", F.col("__cum") - F.col("__bc")))
    return counts, hist


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str = "avg_rank", scale: float = SCALE) -> DataFrame:
    """One row per (keys, distinct value): average rank among ties, and the number of ties."""
    counts, hist = _value_counts(df, keys, value, scale)
    inside = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("__in", F.sum("__c").over(inside) - F.col("__c"))
    joined = join_on(ranked, hist, [*keys, "__b"])
    return joined.select(
        *keys, F.col("__v").alias(value),
        (F.col("__before") + F.col("__in") + (F.col("__c") + 1) / 2.0).alias(out),
        F.col("__c").alias("ties"), F.col("__n").alias("group_n"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], scale: float = SCALE) -> DataFrame:
    """Linear-interpolation quantiles per group, one column per entry of ``probs`` (name -> probability).

    Groups without a non-null value do not appear; left-join the result where they must.
    """
    counts, hist = _value_counts(df, keys, value, scale)
    specs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probs.items()])

    def ranks_of(q: Column) -> Column:
        pos = q["p"] * (F.col("__n") - 1)
        return F.struct(q["name"].alias("name"), F.floor(pos).alias("lo"), F.ceil(pos).alias("hi"), (pos - F.floor(pos)).alias("f"))

    # every histogram row keeps the target ranks that fall into it; buckets without one are dropped before the join
    touched = hist.withColumn("__t", F.filter(F.transform(specs, ranks_of), lambda t: (t["hi"] >= F.col("__before")) & (t["lo"] < F.col("__cum"))))
    touched = touched.where(F.size("__t") > 0).select(*keys, "__b", "__before", "__t")
    inside = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    x = join_on(counts, touched, [*keys, "__b"]).withColumn("__end", F.col("__before") + F.sum("__c").over(inside))
    x = x.withColumn("__start", F.col("__end") - F.col("__c")).withColumn("__q", F.explode("__t"))

    def at(rank: str) -> Column:
        return F.max(F.when((F.col(rank) >= F.col("__start")) & (F.col(rank) < F.col("__end")), F.col("__v")))

    per = x.groupBy(*keys, F.col("__q.name").alias("__name")).agg(
        at("__q.lo").alias("__vlo"), at("__q.hi").alias("__vhi"), F.max("__q.f").alias("__f"))
    val = F.col("__vlo") + (F.col("__vhi") - F.col("__vlo")) * F.col("__f")
    return per.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == n, val)).alias(n) for n in probs])


def exact_medians(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Medians of several columns (output name -> input column) in one pass over an unpivoted stream."""
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(o).alias("m"), F.col(c).cast("double").alias("v")) for o, c in columns.items()])).alias("__e")).select(
        *keys, F.col("__e.m").alias("__m"), F.col("__e.v").alias("__val"))
    q = exact_quantiles(long, [*keys, "__m"], "__val", {"__med": 0.5})
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("__m") == o, F.col("__med"))).alias(o) for o in columns])


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Spearman correlation per group from tie-averaged ranks: (keys, n, rho).

    Rows are first counted per (x, y); each side's ranks join on (keys, value), which adaptive skew handling can
    split when one value dominates.
    """
    pairs = (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
             .groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("__w")))
    base = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx = average_ranks(base, keys, x, "__rx").drop("ties")
    ry = average_ranks(base, keys, y, "__ry").drop("ties", "group_n")
    j2 = join_on(join_on(pairs, rx, [*keys, x]), ry, [*keys, y])
    # ranks have mean (n+1)/2; centring first keeps the sums small
    mid = (F.col("group_n") + 1) / 2.0
    dx, dy, w = F.col("__rx") - mid, F.col("__ry") - mid, F.col("__w")
    out = j2.groupBy(*keys).agg(
        F.sum("__w").alias("n"), F.sum(w * dx * dy).alias("__sxy"),
        F.sum(w * dx * dx).alias("__sxx"), F.sum(w * dy * dy).alias("__syy"))
    return out.select(*keys, "n", F.try_divide(F.col("__sxy"), F.sqrt("__sxx") * F.sqrt("__syy")).alias("rho"))


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str, out: str = "q_value") -> DataFrame:
    """q-values within each family of any size: the least ``p' n / rank(p')`` over all ``p' >= p``, at most 1.

    Rows of equal p share a q-value, that of the last rank among them. Distinct p-values are counted (combined map-side) and placed in
    monotone buckets; ranks and suffix minima run over a family's few thousand buckets and, inside one, over its p-values only. Null
    p-values aren't part of the family and get none.
    """
    v = F.col("__v")
    # equal widths above 1/16, equal ratios below: no bucket holds more than a few thousandths of evenly spread p-values
    bucket = F.when(v >= 0.0625, F.floor(v * 4096)).when(v > 0, F.floor(F.ln(v) * 16)).otherwise(-20_000).cast("bigint")
    counts = df.where(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("__v")).agg(F.count(F.lit(1)).alias("__c")).withColumn("__b", bucket)
    family, inside = Window.partitionBy(*keys).orderBy("__b"), Window.partitionBy(*keys, "__b").orderBy("__v")
    before, after = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    hist = counts.groupBy(*keys, "__b").agg(F.sum("__c").alias("__bc"))
    hist = hist.withColumns({"__n": F.sum("__bc").over(Window.partitionBy(*keys)), "__before": F.coalesce(F.sum("__bc").over(family.rowsBetween(*before)), F.lit(0))})
    placed = join_on(counts, hist, [*keys, "__b"])
    rank = F.col("__before") + F.sum("__c").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    raw = placed.withColumn("__raw", v * F.col("__n") / rank)
    later = raw.groupBy(*keys, "__b").agg(F.min("__raw").alias("__least")).withColumn("__later", F.min("__least").over(family.rowsBetween(*after))).drop("__least")
    own = F.min("__raw").over(inside.rowsBetween(0, Window.unboundedFollowing))
    q = join_on(raw, later, [*keys, "__b"]).select(*keys, F.col("__v").alias(p), F.least(F.lit(1.0), own, F.col("__later")).alias(out))
    return join_on(df, q, [*keys, p], "left")
