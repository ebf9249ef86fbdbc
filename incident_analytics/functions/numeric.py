"""Numeric Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exact sums: a DECIMAL sum does not depend on how rows were split into
# partitions or merged, so means are the same on every run and cluster size.
COORD_SUM_TYPE = "decimal(28,18)"


def percent(part: Column, total: Column) -> Column:
    """100 · part / total, 0 when the total is 0."""
    return F.coalesce(F.try_divide(part, total) * F.lit(100.0), F.lit(0.0))


def exact_mean(col: Column, sum_type: str = COORD_SUM_TYPE) -> Column:
    """Mean of the non-null values via an exact DECIMAL sum (an aggregate)."""
    return F.try_divide(F.sum(col.cast(sum_type)).cast("double"), F.count(col).cast("double"))


# Exact sums of doubles of any size. A double is cut into units of its bin: for
# 2**(8b) <= |x| < 2**(8b + 8) the value x * 2**(54 - 8b) is an integer below
# 2**63, so a bin's units add up as integers, in any order and split, and are
# mergeable (a summary keeps one row per bin). Zero lies in bin 0; an infinity
# counts one unit of a bin of its own.
BIN_BITS, UNIT_BITS = 8, 54
INFINITE_BIN = 1000
UNIT_SUM_TYPE = "decimal(38,0)"


def _scaled(x: Column, exponent: Column) -> Column:
    """x * 2**exponent, in three factors: none leaves the range of a double before the product does."""
    third = F.floor(exponent / 3)
    return x * F.pow(F.lit(2.0), third) * F.pow(F.lit(2.0), third) * F.pow(F.lit(2.0), exponent - 2 * third)


def unit_bin(x: Column) -> Column:
    """The bin of a double that is neither null nor NaN."""
    size = F.abs(x)
    infinite = size == F.lit(float("inf"))
    return (F.when(infinite, F.signum(x) * INFINITE_BIN).when(size == 0, F.lit(0))
            .otherwise(F.floor(F.log2(size) / BIN_BITS)).cast("int"))


def units(x: Column, bin_: Column) -> Column:
    """x as whole units of its bin."""
    whole = _scaled(x, F.lit(UNIT_BITS) - BIN_BITS * bin_)
    return F.when(F.abs(bin_) == INFINITE_BIN, F.lit(1)).otherwise(whole.cast("bigint")).cast(UNIT_SUM_TYPE)


def from_units(bins: Column) -> Column:
    """The double that an array of (bin, summed units) stands for, one entry per
    bin: each entry rounded once, added from the largest bin down. Both
    infinities together give NaN; a sum beyond the range of a double is infinite."""
    def value(e: Column) -> Column:
        whole = e["units"].cast("double")
        infinite = F.signum(e["bin"]) * F.lit(float("inf"))
        return (F.when(whole == 0, F.lit(0.0)).when(F.abs(e["bin"]) == INFINITE_BIN, infinite)
                .otherwise(_scaled(whole, BIN_BITS * e["bin"] - UNIT_BITS)))
    return F.aggregate(F.array_sort(bins, lambda a, b: b["bin"] - a["bin"]), F.lit(0.0),
                       lambda total, e: total + value(e))
