"""Default simulation of a loan pool."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from statloom.functions.scalar import MIX_A, MIX_B, MIX_MODULUS, absorb, stirred, uniform_of, with_lanes, with_mixed

#: Loans x trials drawn at a time, and groups whose totals a task holds at most.
CELLS, GROUPS = 1 << 14, 64


def default_year(draws: Sequence, probabilities: Sequence[str]):
    """First year whose draw is at or below that year's default probability; NULL if none."""
    out = F.lit(None).cast("int")
    for year in range(len(draws), 0, -1):
        out = F.when(draws[year - 1] <= F.col(probabilities[year - 1]), year).otherwise(out)
    return out


def draw_defaults(
    loans: DataFrame, loan: str, probabilities: Sequence[str], seed: int, trials: int = 1
) -> DataFrame:
    """One row per loan and trial with the year of default.

    Each draw depends only on (seed, loan, trial, year), by all bits of an integer loan or by the md5
    of a text one, so results do not change with partitioning
    or retries. Trials are generated inside the scan stage; nothing is joined or shuffled.
    """
    rows = with_lanes(loans, "_a", "_b", seed, loan)
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    rows = stirred(rows, "_a", "_b", F.col("trial").cast("bigint"))
    names = [f"_draw{y}" for y in range(1, len(probabilities) + 1)]
    mixed = {}
    for year, n in enumerate(names, start=1):
        mixed[f"{n}a"], mixed[f"{n}b"] = absorb(F.col("_a"), F.col("_b"), F.lit(year).cast("bigint"))
    rows = with_mixed(rows, **mixed)
    draws = [uniform_of(F.col(f"{n}a"), F.col(f"{n}b")) for n in names]
    return rows.withColumn("default_year", default_year(draws, probabilities)).drop("_a", "_b", *mixed)


def with_losses(defaults: DataFrame, exposures: Sequence[str]) -> DataFrame:
    """Loss is the exposure of the default year, 0 without default."""
    loss = F.lit(0.0)
    for year, exposure in enumerate(exposures, start=1):
        loss = F.when(F.col("default_year") == year, F.col(exposure)).otherwise(loss)
    return defaults.withColumn("loss", loss)


def simulate_losses(
    loans: DataFrame,
    loan: str,
    probabilities: Sequence[str],
    exposures: Sequence[str],
    trials: int,
    seed: int,
    by: Sequence[str] = (),
) -> DataFrame:
    """Total loss per trial (and per ``by`` group). Every trial of every group is present, because
    loans that do not default contribute 0. The draws are those of ``draw_defaults``; a task adds up its
    loans trial by trial and only these sums are shuffled."""
    n = len(probabilities)
    slim = loans.select(*dict.fromkeys([loan, *probabilities, *exposures, *by]))
    if trials > 1:
        # every row becomes `trials` draws: spread the short pool over all tasks before that. The
        # explicit number keeps adaptive execution from merging the still small partitions again.
        slim = slim.repartition(int(loans.sparkSession.conf.get("spark.sql.shuffle.partitions")), loan)
    lost = [F.col(c).cast("double") for c in exposures[:n]] + [F.lit(0.0)] * (n - len(exposures))
    chances = F.array(*[F.col(c).cast("double") for c in probabilities])
    rows = with_lanes(slim, "_a", "_b", seed, loan).select("_a", "_b", chances.alias("_p"), F.array(*lost).alias("_e"), *by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[pa.Array], np.ndarray, np.ndarray]] = {}  # group: values, losses, loans whose loss is known
        for batch in batches:
            keys = [repr(k) for k in zip(*[batch.column(c).to_pylist() for c in by])] if by else [""] * batch.num_rows
            places: dict[str, list[int]] = {}
            for i, key in enumerate(keys):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                some = batch.take(pa.array(at))
                if key not in held:
                    if len(held) == GROUPS:
                        yield from _sums(held, by)
                        held = {}
                    held[key] = ([some.column(c).slice(0, 1) for c in by], np.zeros(trials), np.zeros(trials, np.int64))
                _add_losses(some, trials, *held[key][1:])
        yield from _sums(held, by)

    schema = StructType(
        [StructField("trial", IntegerType(), False), *[StructField(c, slim.schema[c].dataType) for c in by], StructField("loss", DoubleType())]
    )
    return rows.mapInArrow(run, schema).groupBy("trial", *by).agg(F.sum("loss").alias("loss"))


def _sums(held: dict, by: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """``trial``, the group, and ``loss`` (null where no loan's loss is known) of the groups that a task holds."""
    for values, losses, known in held.values():
        columns = {"trial": pa.array(np.arange(1, len(losses) + 1), pa.int32())}
        columns |= {c: v.take(pa.array(np.zeros(len(losses), np.int64))) for c, v in zip(by, values)}
        yield pa.record_batch(columns | {"loss": pa.array(losses, pa.float64(), mask=known == 0)})


def _scrambled(x: np.ndarray) -> np.ndarray:
    """The steps of ``with_mixed`` on unsigned 32-bit numbers, in place."""
    low, other = np.uint32(MIX_MODULUS - 1), np.empty_like(x)
    x &= low
    for shift, factor in ((16, MIX_A), (15, MIX_B)):
        x ^= np.right_shift(x, np.uint32(shift), out=other)
        x *= np.uint32(factor & 0xFFFFFFFF)
        x &= low
    x ^= np.right_shift(x, np.uint32(16), out=other)
    return x


def _add_losses(loans: pa.RecordBatch, trials: int, losses: np.ndarray, known: np.ndarray) -> None:
    """Add the loss of every loan to the ``losses`` of all trials, and 1 to ``known`` where it is not null.

    The second lane and the exact comparison are needed only where the first lane leaves a default possible.
    """
    n, drawn = len(loans), loans.column("_a").is_valid().to_numpy(zero_copy_only=False)
    first, second = (loans.column(c).fill_null(0).to_numpy().astype(np.uint32) for c in ("_a", "_b"))
    p, e = (loans.column(c).flatten() for c in ("_p", "_e"))
    never = p.is_null().to_numpy(zero_copy_only=False).reshape(n, -1) | ~drawn[:, None]
    p = p.fill_null(0.0).to_numpy().reshape(n, -1)
    p = np.where(never, -1.0, np.where(np.isnan(p), np.inf, p))  # NaN is above every draw
    missing = e.is_null().to_numpy(zero_copy_only=False).reshape(n, -1)
    e = e.fill_null(0.0).to_numpy().reshape(n, -1)
    most = np.clip(np.floor(p * MIX_MODULUS), 0, MIX_MODULUS).astype(np.uint32)
    known += n
    trial = np.arange(1, trials + 1, dtype=np.uint32)
    step, width = max(1, CELLS // trials), min(trials, CELLS)
    for i in range(0, n, step):
        for t in range(0, trials, width):
            some, numbers = slice(i, min(i + step, n)), trial[t : t + width]
            a = _scrambled((first[some, None] + numbers).ravel())
            done = np.zeros(len(a), dtype=bool)
            for year in range(1, p.shape[1] + 1):
                if (p[some, year - 1] < 0).all():
                    continue
                lane = _scrambled(a + np.uint32(year))
                cell = np.flatnonzero(lane.reshape(-1, len(numbers)) <= most[some, year - 1, None])
                cell = cell[~done[cell]]
                row, at = cell // len(numbers), cell % len(numbers)
                other = _scrambled(second[i + row] ^ numbers[at])
                other = _scrambled(other ^ np.uint32(year))
                draw = (lane[cell].astype(np.int64) * 4_194_304 + (other >> np.uint32(9))) / float(2**53)
                hit = draw <= p[i + row, year - 1]
                row, at = i + row[hit], t + at[hit]
                done[cell[hit]] = True
                if missing[some].any():
                    unknown = missing[row, year - 1]
                    np.subtract.at(known, at[unknown], 1)
                    row, at = row[~unknown], at[~unknown]
                np.add.at(losses, at, e[row, year - 1])


def expected_loss(loans: DataFrame, probabilities: Sequence[str], exposures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Closed-form mean of the simulated loss."""
    alive, total = F.lit(1.0), F.lit(0.0)
    for p, e in zip(probabilities, exposures):
        total = total + alive * F.col(p) * F.col(e)
        alive = alive * (1 - F.col(p))
    return loans.groupBy(*by).agg(F.sum(total).alias("expected_loss"))


