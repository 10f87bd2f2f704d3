"""Declared input schemas."""

from pyspark.sql import types as T

S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


LOAN_POOL = _schema(
    loan_id=L, Rating=S, Loan_Amount_1Y=S, Loan_Amount_2Y=S, Loan_Amount_3Y=S, Default_Prob_1Y=D, Default_Prob_2Y=D, Default_Prob_3Y=D
)
PLAY_BY_PLAY = T.StructType(
    [T.StructField("Play call", S)]
    + [T.StructField(n, t) for n, t in dict(
        play_type=S, pass_length=S, pass_location=S, run_gap=S, run_location=S, qtr=I, down=I, distance=I, yds_gained=I, Formation=S
    ).items()]
)
SKATER_SEASONS = _schema(
    playerId=L, seasonId=I, skaterFullName=S, positionCode=S, gamesPlayed=I, points=I, goals=I, assists=I, evPoints=I, evGoals=I,
    pointsPerGame=D, timeOnIcePerGame=D, shots=I, shootingPct=D, faceoffWinPct=D,
)
SKATER_BIOS = _schema(playerId=L, birthDate=T.DateType(), birthCountryCode=S, currentTeamName=S)
CONTRACT = _schema(contract_id=L, contract_end=S, length=S, value=S, signing_status=S, expiry_status=S)
CONTRACTS = _schema(
    player_id=L, nhl_id=L, position=S, last_name=S, current=T.ArrayType(CONTRACT), future=T.ArrayType(CONTRACT)
)
SEASON_STATS = _schema(
    player_name=S, player_id=L, team=S, season_yr=S, gp=I, mean_toi_minutes=D, goals=I, points=I, points_primary=I, ixg=D, icf_per60=D
)
SKATER_AGES = _schema(player=S, season=S, age=D, position=S)
