"""Doubles that do not depend on the order of summation, for results that are compared by value."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int = 6) -> Column:
    """value to so many decimals, ties up; the same expression in another engine gives the same double.

    A hair more than a half is added, so that values whose last bit differs do not part at a tie.
    """
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5001)) / F.lit(scale)


def known(value: Column) -> Column:
    """value, or null where it is -1, which stands for unknown in stored tables."""
    return F.nullif(value, F.lit(-1))
