"""Grouped summaries, shares, profiles, histograms, quantiles, correlation."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.operators.hotgroups import with_group_stats
from statloom.operators.selection import quantiles


def conversion_rates(
    df: DataFrame,
    gained: str,
    needed: str,
    groupings: Sequence[Sequence[str]],
) -> DataFrame:
    """Average needed, average gained and the percentage of rows with ``gained > needed``.

    All groupings come from one scan; ``grouping`` names the columns a row is grouped by, and the
    other key columns are NULL.
    """
    keys = list(dict.fromkeys(c for g in groupings for c in g))
    grouped = df.groupingSets([[F.col(c) for c in g] for g in groupings], *keys).agg(
        F.grouping_id().alias("_id"),
        F.avg(needed).alias("avg_needed"),
        F.avg(gained).alias("avg_gained"),
        (100 * F.avg(F.when(F.col(gained) > F.col(needed), 1.0).otherwise(0.0))).alias(
            "conversion_pct"
        ),
    )
    label = F.lit(None).cast("string")
    for g in groupings:
        bits = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in g)
        label = F.when(F.col("_id") == bits, F.lit("+".join(g))).otherwise(label)
    return grouped.select(label.alias("grouping"), *keys, "avg_needed", "avg_gained", "conversion_pct")


def share_of_total(df: DataFrame, by: Sequence[str], within: Sequence[str] = (), percent: bool = True) -> DataFrame:
    """Rows per group and their share of all rows, or of the rows of the ``within`` keys."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    scale = 100.0 if percent else 1.0
    if within:
        out = with_group_stats(counts, within, {"_total": F.sum("n")})
        return out.withColumn("share", F.col("n") * scale / F.col("_total")).drop("_total")
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.col("n") * scale / total)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def to_wide(df: DataFrame, by: Sequence[str], column: str, values: Sequence, value: str) -> DataFrame:
    return df.groupBy(*by).pivot(column, list(values)).agg(F.first(value, ignorenulls=True))


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def correlation_matrix(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pairwise Pearson correlation, long form, every ordered pair; missing values drop pairwise."""
    pairs = list(combinations_with_replacement(columns, 2))

    def one(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)).cast("double"), F.when(both, F.col(b)).cast("double")
        covariance = F.covar_samp(x, y)
        return F.when(F.count(x) > 1, F.try_divide(covariance, F.stddev_samp(x) * F.stddev_samp(y)))

    wide = df.groupBy(*by).agg(*[one(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for u, v in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(u).alias("var1"), F.lit(v).alias("var2"), F.col(f"r{i}").alias("r")))
    return wide.select(*by, F.inline(F.array(*cells)))


def _long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "variable", "value"
    )


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, missing, mean, std, min, quartiles, max and adjusted skewness per numeric column."""
    long = _long_values(df, columns)
    n = F.count("value")
    adjust = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    stats = long.groupBy("variable").agg(
        n.alias("n"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (F.skewness("value") * adjust).alias("skew"),
    )
    quartiles = (
        quantiles(long, ["variable"], "value", [0.25, 0.5, 0.75])
        .groupBy("variable")
        .pivot("point", [0.25, 0.5, 0.75])
        .agg(F.first("value"))
        .toDF("variable", "q25", "q50", "q75")
    )
    return stats.join(quartiles, "variable", "left").select(
        "variable", "n", "missing", "mean", "std", "min", "q25", "q50", "q75", "max", "skew"
    )


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last bin is closed.

    Every non-empty bin is returned with its edges, count and density.
    """
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    ends = {"_lo": F.min("_x"), "_hi": F.max("_x"), "_n": F.count(F.lit(1))}
    if by:
        rows = with_group_stats(rows, by, ends)
    else:
        rows = rows.withColumns({k: rows.agg(v).scalar() for k, v in ends.items()})
    # a single repeated value gets a unit-wide range around it
    flat = F.col("_lo") == F.col("_hi")
    lo = F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo")) / bins
    placed = rows.withColumns({"_lo": lo, "_w": width}).withColumn(
        "bin", F.least(F.floor((F.col("_x") - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int")
    )
    return (
        placed.groupBy(*by, "bin", "_lo", "_w", "_n")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            *by,
            "bin",
            (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"),
            (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"),
            "n",
            (F.col("n") / (F.col("_n") * F.col("_w"))).alias("density"),
        )
    )


def risk_percentiles(df: DataFrame, value: str, by: Sequence[str] = (), tail: float = 0.95) -> DataFrame:
    """Mean, median and upper tail percentile (value at risk) of a loss column."""
    by = list(by)
    mean = df.groupBy(*by).agg(F.avg(value).alias("mean"))
    points = quantiles(df, by, value, [0.5, tail])
    pick = lambda p: F.max(F.when(F.col("point") == p, F.col("value")))
    wide = points.groupBy(*by).agg(pick(0.5).alias("median"), pick(tail).alias("tail"))
    if by:
        return mean.join(wide, by, "left")
    return wide.select(df.agg(F.avg(value)).scalar().alias("mean"), "median", "tail")


def return_stats(df: DataFrame, value: str, periods: float, by: Sequence[str] = ()) -> DataFrame:
    """Annualised mean, volatility and Sharpe ratio, and the compounded total return."""
    mean, std = F.avg(value), F.stddev_samp(value)
    root = F.sqrt(F.lit(float(periods)))
    return df.groupBy(*by).agg(
        (F.try_divide(mean, std) * root).alias("sharpe"),
        (mean * periods).alias("annual_return"),
        (std * root).alias("annual_volatility"),
        compounded(value).alias("total_return"),
    )


def compounded(value: Column | str) -> Column:
    """Aggregate: product of (1 + r) minus 1."""
    col = F.col(value) if isinstance(value, str) else value
    return F.product(1 + col) - 1


def any_true(flag: Column | str) -> Column:
    """Aggregate: is the flag set on any row of the group; missing counts as unset."""
    col = F.col(flag) if isinstance(flag, str) else flag
    return F.bool_or(F.coalesce(col.cast("boolean"), F.lit(False)))


def standardise(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], weights: dict[str, float] | None = None, suffix: str = "_z"
) -> DataFrame:
    """``(x - mean) / population std`` within a segment, times an optional weight.

    A column without spread is only centred.
    """
    stats = {f"_m_{c}": F.avg(c) for c in columns} | {f"_s_{c}": F.stddev_pop(c) for c in columns}
    out = with_group_stats(df, by, stats)
    scaled = {
        c + suffix: (F.col(c) - F.col(f"_m_{c}"))
        / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
        * float((weights or {}).get(c, 1.0))
        for c in columns
    }
    return out.withColumns(scaled).drop(*stats)
