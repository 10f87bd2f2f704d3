"""Loan pool: clean the amounts, value the exposures, simulate defaults, read off the loss tail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.scalar import parse_amount, remaining_exposure
from statloom.operators.aggregate import histogram, risk_percentiles, value_counts
from statloom.operators.simulate import draw_defaults, simulate_losses, with_losses
from statloom.session import cut_lineage

PROBABILITIES = ["Default_Prob_1Y", "Default_Prob_2Y", "Default_Prob_3Y"]
AMOUNTS = ["Loan_Amount_1Y", "Loan_Amount_2Y", "Loan_Amount_3Y"]
EXPOSURES = ["exposure_1", "exposure_2", "exposure_3"]


def prepare_pool(pool: DataFrame, rate: float = 0.08, digits: int | None = 2) -> DataFrame:
    clean = pool.withColumns({c: parse_amount(c) for c in AMOUNTS})
    steps = clean
    for name, value in remaining_exposure("Loan_Amount_1Y", rate, digits=digits).items():
        steps = steps.withColumn(name, value)
    return steps


def single_draw(pool: DataFrame, seed: int) -> DataFrame:
    """Cumulative default flags of one draw and the loss at the undiscounted yearly amounts."""
    drawn = with_losses(draw_defaults(pool, "loan_id", PROBABILITIES, seed), AMOUNTS)
    flags = {
        f"Defaults_{y}Y": F.when(F.col("default_year") <= y, 1).otherwise(0) for y in (1, 2, 3)
    }
    return drawn.withColumns(flags)


def default_patterns(drawn: DataFrame) -> DataFrame:
    return value_counts(drawn, ["Defaults_1Y", "Defaults_2Y", "Defaults_3Y"])


def loss_distribution(pool: DataFrame, trials: int, seed: int, by_rating: bool = False) -> DataFrame:
    by = ["Rating"] if by_rating else []
    return simulate_losses(pool, "loan_id", PROBABILITIES, EXPOSURES, trials, seed, by)


def loss_report(losses: DataFrame, by_rating: bool = False, tail: float = 0.95) -> DataFrame:
    # written once: the totals are read several times, and the draws need not be made again
    return risk_percentiles(cut_lineage(losses), "loss", ["Rating"] if by_rating else [], tail)


def loss_histogram(losses: DataFrame, bins: int = 50, by_rating: bool = False) -> DataFrame:
    return histogram(cut_lineage(losses), "loss", bins, ["Rating"] if by_rating else [])
