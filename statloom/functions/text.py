"""Name folding and Jaro similarity."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accented Latin letters and the plain letter each folds to, position by position.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿčďěňřšťůžćłńśźżÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝČĎĚŇŘŠŤŮŽĆŁŃŚŹŻ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyycdenrstuzclnszzAAAAAACEEEEIIIINOOOOOOUUUUYCDENRSTUZCLNSZZ"


def dotted_name(name: Column | str) -> Column:
    """Spaces and hyphens to dots, common Latin accents removed; stays in the JVM."""
    col = F.col(name) if isinstance(name, str) else name
    return F.translate(F.regexp_replace(col, "[ -]", "."), ACCENTED, PLAIN)


@F.pandas_udf(T.StringType())
def fold_unicode(names: pd.Series) -> pd.Series:
    """Compatibility-decompose and keep ASCII, for names beyond the Latin table above."""
    special = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss"})

    def fold(s: str | None) -> str | None:
        if s is None:
            return None
        return unicodedata.normalize("NFKD", s.translate(special)).encode("ascii", "ignore").decode()

    return names.map(fold, na_action="ignore")


def jaro(a: str, b: str) -> float:
    """Jaro similarity of two strings."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = bytearray(len(b))
    left = []
    for i, ch in enumerate(a):
        j = b.find(ch, max(0, i - reach), i + reach + 1)
        while j >= 0 and taken[j]:
            j = b.find(ch, j + 1, i + reach + 1)
        if j >= 0:
            taken[j] = 1
            left.append(ch)
    if not left:
        return 0.0
    right = [ch for ch, used in zip(b, taken) if used]
    half_swaps = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - half_swaps) / m) / 3


@F.pandas_udf(T.DoubleType())
def jaro_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro(x, y) for x, y in zip(a, b)], dtype="float64")
