"""Vectors and decay. Vectors are arrays of floats; arithmetic is in double."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

COARSE_SHARE, COARSE_LEAST = 0.25, 8
HALF_LIFE_DAYS, ACCESS_WEIGHT = 30.0, 0.2


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-12)


def coarse_dim(dim: int) -> int:
    return min(dim, max(COARSE_LEAST, int(dim * COARSE_SHARE)))


def prefix(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def l2_score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance * distance / 4)


def sign_words(a: Column, dim: int) -> Column:
    """Signs (1 for 0 or more) of up to 64 numbers a word, the first one in the highest bit."""

    def word(begin: int) -> Column:
        return F.aggregate(
            F.sequence(F.lit(begin), F.lit(min(dim, begin + 64) - 1)),
            F.lit(0).cast("bigint"),
            lambda s, i: s.bitwiseOR(F.when(F.get(a, i.cast("int")) >= 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(63) - (i - begin)).cast("int"))).otherwise(F.lit(0).cast("bigint"))),
        )

    return F.array(*(word(b) for b in range(0, dim, 64)))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def strength(importance: Column, age_days: Column, access_count: Column) -> Column:
    """Importance that decays by half in HALF_LIFE_DAYS and grows with use."""
    return importance * F.exp(F.lit(-math.log(2) / HALF_LIFE_DAYS) * F.greatest(F.lit(0.0), age_days)) * (1 + ACCESS_WEIGHT * access_count)


def days_between(late: Column, early: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", early, late) / 86_400_000_000.0
