"""How alike two names are, from 0 to 1."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def edit_similarity(a: Column, b: Column) -> Column:
    """(longer length - edit distance) / longer length; two empty texts are alike."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise((longer - F.levenshtein(a, b)) / longer)


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[j] and b[j] == c), None)
        if j is not None:
            taken[j] = True
            left.append(c)
    if not left:
        return 0.0
    m, right = len(left), [c for c, t in zip(b, taken) if t]
    swapped = sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro similarity in lower case, a tenth of what is missing added for each of up to four equal first characters."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        x, y = x.lower(), y.lower()
        same = next((i for i, (p, q) in enumerate(zip(x[:4], y[:4])) if p != q), min(4, len(x), len(y)))
        j = jaro(x, y)
        return j + same * 0.1 * (1 - j)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")
