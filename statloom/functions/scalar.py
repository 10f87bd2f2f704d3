"""Scalar column expressions: clocks, dates, seasons, money, rounding, buckets, keyed draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clock_minutes(clock: Column | str) -> Column:
    """``mm:ss`` text to minutes."""
    parts = F.split(_c(clock), ":")
    return F.get(parts, F.lit(0)).try_cast("double") + F.get(parts, F.lit(1)).try_cast("double") / 60


def game_minutes(period: Column | str, minutes: Column | str, period_minutes: int = 15) -> Column:
    return (_c(period) - 1) * period_minutes + _c(minutes)


def half_even(x: Column | str, digits: int = 0) -> Column:
    """Round half to even, as numpy and R do."""
    return F.bround(_c(x), digits)


def scaled_rint(x: Column | str, digits: int = 2) -> Column:
    """Round half to even after scaling, where ``half_even`` judges the decimal digits of the number: the
    two differ where scaling itself ends half-way."""
    return F.rint(_c(x) * float(10**digits)) / float(10**digits)


def percent(x: Column | str, digits: int = 2) -> Column:
    """A share as a rounded percentage."""
    return scaled_rint(_c(x) * 100, digits)


def minutes(seconds: Column | str, digits: int = 2) -> Column:
    """Seconds as rounded minutes."""
    return scaled_rint(_c(seconds) / 60, digits)


def age_in_years(on: Column | str, born: Column | str) -> Column:
    return F.floor(F.datediff(_c(on), _c(born)) / 365.25).cast("int")


def text(x: Column | str, missing: str = "NA") -> Column:
    """Cast to string with missing values spelled out, for building composite labels."""
    return F.coalesce(_c(x).cast("string"), F.lit(missing))


def _number(v: float) -> str:
    return str(int(v)) if float(v).is_integer() else str(v)


def bucket_label(x: Column | str, breaks: Sequence[float]) -> Column:
    """Right-closed interval label ``(a,b]``; NULL outside the breaks."""
    col = _c(x)
    label = F.lit(None).cast("string")
    for low, high in reversed(list(zip(breaks, breaks[1:]))):
        label = F.when(
            (col > low) & (col <= high), F.lit(f"({_number(low)},{_number(high)}]")
        ).otherwise(label)
    return label


def parse_amount(x: Column | str) -> Column:
    """Number kept as text with thousands separators."""
    return F.regexp_replace(_c(x).cast("string"), ",", "").try_cast("double")


def epoch_ms(x: Column | str) -> Column:
    """Epoch milliseconds to a UTC timestamp without zone."""
    micros = _c(x).cast("bigint") * 1000
    seconds = F.make_dt_interval(secs=(micros / 1_000_000).cast("decimal(18,6)"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + seconds


def season_code(start_year: Column | str) -> Column:
    """2024 -> 20242025."""
    year = _c(start_year).cast("int")
    return year * 10001 + 1


def shift_season(code: Column | str, seasons: int) -> Column:
    return _c(code) + seasons * 10001


def season_text(code: Column | str) -> Column:
    """20242025 -> '2024-25'."""
    s = _c(code).cast("string")
    return F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 7, 2))


def season_start(text_or_code: Column | str) -> Column:
    """First year of '2024-25', '2024-2025' or 20242025."""
    return F.substring(_c(text_or_code).cast("string"), 1, 4).cast("int")


def july_first(code: Column | str) -> Column:
    return F.make_date(season_start(code), F.lit(7), F.lit(1))


def signing_season(contract_end: Column | str, years: Column | str) -> Column:
    """Season in which a contract ending '2027-2028' with a term of ``years`` was signed."""
    return season_code(season_start(contract_end) - _c(years).cast("int"))


def remaining_exposure(
    amount: Column | str, rate: float = 0.08, share: float = 0.3333, digits: int | None = 2
) -> dict[str, Column]:
    """Exposure at default in years 1..3 after discounted level repayments of ``share``."""
    def rounded(x: Column) -> Column:
        return x if digits is None else half_even(x, digits)

    balance = rounded(_c(amount))
    out = {"exposure_1": balance}
    for year in (1, 2):
        paid = rounded(_c(amount) * share / F.pow(F.lit(1 + rate), F.lit(year)))
        balance = rounded(balance - paid)
        out[f"exposure_{year + 1}"] = balance
    return out


def payment_value(
    amount: Column | str, year: int, rate: float = 0.08, share: float = 0.3333, digits: int | None = 2
) -> Column:
    """Present value of the level repayment made after ``year`` years."""
    value = _c(amount) * share / F.pow(F.lit(1 + rate), F.lit(year))
    return value if digits is None else half_even(value, digits)


# Odd 31-bit multipliers of the mixing steps below.
MIX_A = 1_540_483_477
MIX_B = 1_103_515_245
MIX_MODULUS = 2_147_483_648


def _mix_steps():
    """The scramble as small steps, each reading the one before it more than once."""
    low31 = lambda h: h.bitwiseAND(F.lit(MIX_MODULUS - 1))
    return (
        lambda x: low31(x.cast("bigint")),
        lambda h: low31(h.bitwiseXOR(F.shiftright(h, 16)) * MIX_A),
        lambda h: low31(h.bitwiseXOR(F.shiftright(h, 15)) * MIX_B),
        lambda h: h.bitwiseXOR(F.shiftright(h, 16)),
    )


def with_mixed(df: DataFrame, **values: Column) -> DataFrame:
    """Add scrambled columns one step at a time. As a single expression every step would be written
    out, and computed, as often as it is read."""
    names = dict(values)
    first, *rest = _mix_steps()
    df = df.withColumns({n: first(x) for n, x in names.items()})
    for step in rest:
        df = df.withColumns({n: step(F.col(n)) for n in names})
    return df


def limbs(key: Column) -> list[Column]:
    """All 64 bits of an integer key as three numbers below 2**31."""
    k = key.cast("bigint")
    low = F.lit(MIX_MODULUS - 1)
    return [k.bitwiseAND(low), F.shiftrightunsigned(k, 31).bitwiseAND(low), F.shiftrightunsigned(k, 62)]


def integer_key(key: Column | str, kind: str = "bigint") -> Column:
    """A key column as an integer: strings by 60 bits of their md5."""
    key = _c(key)
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint") if kind == "string" else key.cast("bigint")


def absorb(a: Column, b: Column, limb: Column) -> tuple[Column, Column]:
    """What the two lanes of a keyed draw scramble next. One lane adds, the other combines bitwise, so
    that streams of different keys cannot run alongside each other in both."""
    return a + limb, b.bitwiseXOR(limb)


def start_lanes(seed: int) -> tuple[int, int]:
    """The lanes after a seed, as plain numbers."""
    def mix(h: int) -> int:
        for shift, factor in ((16, MIX_A), (15, MIX_B)):
            h = ((h ^ (h >> shift)) * factor) & (MIX_MODULUS - 1)
        return h ^ (h >> 16)

    a, b, seed = 0, 1, seed & (2**64 - 1)
    for limb in (seed & (MIX_MODULUS - 1), (seed >> 31) & (MIX_MODULUS - 1), seed >> 62):
        a, b = mix((a + limb) & (MIX_MODULUS - 1)), mix(b ^ limb)
    return a, b


def stirred(df: DataFrame, a: str, b: str, *parts: Column) -> DataFrame:
    """Let the lanes in columns ``a`` and ``b`` absorb numbers below 2**31, one after the other."""
    for part in parts:
        x, y = absorb(F.col(a), F.col(b), part)
        df = with_mixed(df, **{a: x, b: y})
    return df


def with_lanes(df: DataFrame, a: str, b: str, seed: int, *keys: str) -> DataFrame:
    """Add two 31-bit lanes that are a pure function of the seed and of all bits of the keys."""
    first, second = start_lanes(seed)
    df = df.withColumns({a: F.lit(first).cast("bigint"), b: F.lit(second).cast("bigint")})
    for key in keys:
        kind = df.schema[key].dataType.typeName()
        df = stirred(df, a, b, *limbs(integer_key(key, kind)))
    return df


def uniform_of(a: Column, b: Column) -> Column:
    """A number in [0, 1) with 53 random bits: 31 of the first lane, 22 of the second."""
    return (a * 4_194_304 + F.shiftright(b, 9)) / float(2**53)


def with_uniform(df: DataFrame, name: str, seed: int, *keys: str) -> DataFrame:
    """Add a uniform draw in [0, 1) that is a pure function of the seed and the keys."""
    df = with_lanes(df, "_lane_a", "_lane_b", seed, *keys)
    return df.withColumn(name, uniform_of(F.col("_lane_a"), F.col("_lane_b"))).drop("_lane_a", "_lane_b")


def keyed_uniform(*keys: Column | int) -> Column:
    """The draw of ``with_uniform`` as one expression, for short tables: the first key is the seed."""
    def once(x: Column, step) -> Column:
        # binds x to a name, so that a step may read it more than once
        return F.get(F.transform(F.array(x), step), F.lit(0))

    a, b = (F.lit(h).cast("bigint") for h in start_lanes(keys[0]))
    for key in keys[1:]:
        for limb in limbs(F.lit(key) if isinstance(key, int) else key):
            a, b = absorb(a, b, limb)
            for step in _mix_steps():
                a, b = once(a, step), once(b, step)
    return uniform_of(a, b)


def is_home(team: Column | str, home: Column | str) -> Column:
    return F.when(_c(team) == _c(home), 1).otherwise(0)


def is_leading(team, home, away, home_score, away_score) -> Column:
    """1 when ``team`` is ahead on the scoreboard."""
    return (
        F.when((_c(team) == _c(home)) & (_c(home_score) > _c(away_score)), 1)
        .when((_c(team) == _c(away)) & (_c(home_score) < _c(away_score)), 1)
        .otherwise(0)
    )


def yards_to_goal(team, side, yard) -> Column:
    """``yard + 50`` when the ball is on the team's own side, else ``yard``."""
    return F.when(_c(team) == _c(side), _c(yard) + 50).otherwise(_c(yard))
