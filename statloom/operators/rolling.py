"""Rolling mean, deviation, correlation and beta along each entity's own order.

A window of w rows is the tail of one block of w rows and the head of the next. Heads and tails are
growing frames, so the work per row does not depend on w, and their counts, means and sums of squared
deviations are merged without subtracting totals: rows outside the window never touch its result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.operators.hotgroups import AUTO, HotGroups, with_lookback

CHUNK = "_chunk"


def rolling(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    window: int,
    means: Mapping[str, str] | None = None,
    stds: Mapping[str, str] | None = None,
    betas: Mapping[str, tuple[str, str]] | None = None,
    correlations: Mapping[str, tuple[str, str]] | None = None,
    min_periods: int | None = None,
    hot: HotGroups | None | str = AUTO,
) -> DataFrame:
    """Statistics of the last ``window`` rows; NULL until ``min_periods`` of them have values.

    ``means`` and ``stds`` map new column to source column; ``betas`` and ``correlations`` map new
    column to ``(y, x)``, where beta is the slope of y on x and rows missing either are left out.
    """
    need = window if min_periods is None else min_periods
    means, stds = dict(means or {}), dict(stds or {})
    pairs = {name: (y, x, "beta") for name, (y, x) in (betas or {}).items()}
    pairs |= {name: (y, x, "corr") for name, (y, x) in (correlations or {}).items()}
    return with_lookback(
        df, by, order, window, lambda d, w: _merged(d, w, by, order, window, need, means, stds, pairs), hot
    )


def _merged(d, window, by, order, size, need, means, stds, pairs):
    keys = [*by, CHUNK] if CHUNK in d.columns else [*by]
    d = d.withColumn("_block", F.floor((F.row_number().over(window) - 1) / size))
    head = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tail = Window.partitionBy(*keys, "_block").orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    # what a window is made of: pairs (y, x) over the rows that have both, single columns as (c, c)
    series = {(c, c): bool(c in stds.values()) for c in dict.fromkeys([*means.values(), *stds.values()])}
    series |= {(y, x): True for y, x, _ in pairs.values()}
    names = {p: f"_{i}" for i, p in enumerate(series)}

    def pieces(frame, prefix: str) -> dict[str, Column]:
        out = {}
        for (y, x), spread in series.items():
            yv, xv, n = _valid(y, x, F.col(y)), _valid(y, x, F.col(x)), names[y, x]
            count = F.count(yv).over(frame)
            out |= {f"{prefix}n{n}": count, f"{prefix}y{n}": F.avg(yv).over(frame)}
            if y != x:
                out |= {f"{prefix}x{n}": F.avg(xv).over(frame), f"{prefix}xx{n}": F.var_pop(xv).over(frame) * count}
                out[f"{prefix}xy{n}"] = F.covar_pop(yv, xv).over(frame) * count
            if spread:
                out[f"{prefix}yy{n}"] = F.var_pop(yv).over(frame) * count
        return out

    tails = pieces(tail, "_t")
    d = d.withColumns(tails)
    heads = pieces(head, "_h")
    # the tail starts size - 1 rows back; there is none where the head is a whole block
    earlier = {f"_e{t[2:]}": F.lag(t, size - 1).over(window) for t in tails} if size > 1 else {f"_e{t[2:]}": F.lit(None) for t in tails}
    whole = {"_whole": F.row_number().over(window) % size == 0}
    d = d.withColumns(heads | earlier | whole)

    def part(key: str, n: str) -> tuple[Column, Column]:
        old = F.when(F.col("_whole"), F.lit(0.0)).otherwise(F.coalesce(F.col(f"_e{key}{n}"), F.lit(0.0)))
        return old, F.coalesce(F.col(f"_h{key}{n}"), F.lit(0.0))

    def total(n: str) -> Column:
        a, b = part("n", n)
        return a + b

    def mean(key: str, n: str) -> Column:
        (a, b), (ma, mb) = part("n", n), part(key, n)
        return F.when(a == 0, mb).otherwise(ma + F.try_divide((mb - ma) * b, a + b))

    def moment(key: str, first: str, second: str, n: str) -> Column:
        """The merged sum of (first - mean) * (second - mean)."""
        (a, b), (ca, cb) = part("n", n), part(key, n)
        (pa, pb), (qa, qb) = part(first, n), part(second, n)
        between = F.when((a > 0) & (b > 0), (pb - pa) * (qb - qa) * a * F.try_divide(b, a + b)).otherwise(0.0)
        return ca + cb + between

    out = {}
    for name, c in means.items():
        n = names[c, c]
        out[name] = F.when((total(n) >= need) & (total(n) > 0), mean("y", n))
    for name, c in stds.items():
        n = names[c, c]
        out[name] = F.when(total(n) >= max(need, 2), F.sqrt(F.try_divide(moment("yy", "y", "y", n), total(n) - 1)))
    for name, (y, x, kind) in pairs.items():
        n = names[y, x]
        xx = moment("yy", "y", "y", n) if x == y else moment("xx", "x", "x", n)
        xy = xx if x == y else moment("xy", "y", "x", n)
        below = xx if kind == "beta" else F.sqrt(xx * moment("yy", "y", "y", n))
        out[name] = F.when(total(n) >= max(need, 2), F.try_divide(xy, below))
    return d.withColumns(out).drop("_block", *tails, *heads, *earlier, *whole)


def _valid(y: str, x: str, value: Column) -> Column:
    return F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), value)


def rolling_z(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, window: int, name: str = "z", hot: HotGroups | None | str = AUTO
) -> DataFrame:
    """Distance from the rolling mean in rolling standard deviations; NULL when there is no spread."""
    out = rolling(df, by, order, window, means={"_mean": value}, stds={"_std": value}, hot=hot)
    return out.withColumn(name, F.try_divide(F.col(value) - F.col("_mean"), F.col("_std"))).drop("_mean", "_std")


def rolling_means(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, sizes: Sequence[int], min_periods: int | None = None, hot: HotGroups | None | str = AUTO
) -> DataFrame:
    """Rolling means for several window sizes, ``{value}_{size}``, from one set of chunks."""
    def add(d, w):
        for size in sizes:
            d = _merged(d, w, by, order, size, min_periods or size, {f"{value}_{size}": value}, {}, {})
        return d

    return with_lookback(df, by, order, max(sizes), add, hot)


def rolling_zs(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, sizes: Sequence[int], hot: HotGroups | None | str = AUTO
) -> DataFrame:
    """Rolling z-scores for several window sizes, ``z_{size}``, from one set of chunks."""
    def add(d, w):
        for size in sizes:
            d = _merged(d, w, by, order, size, size, {"_mean": value}, {"_std": value}, {})
            d = d.withColumn(f"z_{size}", F.try_divide(F.col(value) - F.col("_mean"), F.col("_std")))
        return d.drop("_mean", "_std")

    return with_lookback(df, by, order, max(sizes), add, hot)
