"""A fixed-range histogram with fractional insertion, as built-in expressions.

A value falls between two bins and is shared by them in proportion to its distance.
Histograms are arrays of weights; they merge by adding, and give interpolated
quantiles. `fill` needs one aggregation by (key, bin), so it combines map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 40
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def fill(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int = BINS, weight: str | None = None) -> DataFrame:
    """(keys, hist): the histogram of each group, an array of `bins` weights."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - low) / (high - low))) * (bins - 1)
    lo = F.floor(at).cast("int")
    up = F.least(lo + 1, F.lit(bins - 1))
    part = at - lo
    w = F.col(weight) if weight else F.lit(1.0)
    halves = F.explode(F.array(F.struct(lo.alias("bin"), (w * (1 - part)).alias("n")), F.struct(up.alias("bin"), (w * part).alias("n"))))
    counted = df.select(*keys, halves.alias("h")).groupBy(*keys, "h.bin").agg(F.sum("h.n").alias("n"))
    entries = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    return entries.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.col("m")[b], F.lit(0.0))).alias("hist"))


def merge(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def total(hist: Column) -> Column:
    return F.aggregate(hist, F.lit(0.0), lambda s, x: s + x)


def normalize(hist: Column) -> Column:
    """Weights divided by their sum."""
    return F.transform(hist, lambda x: x / total(hist))


def quantile(hist: Column, q: float, low: float, high: float, bins: int = BINS) -> Column:
    """Interpolated quantile: the first bin whose cumulated weight reaches q of the sum."""
    width = (high - low) / bins
    goal = total(hist) * q
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("out"), F.lit(0).alias("b"))

    def step(s: Column, n: Column) -> Column:
        cum, b = s["sum"], s["b"]
        left = b - 1 + width / 2
        at = F.when(b == 0, F.lit(float(low))).otherwise(low + (high - low) * (left + (goal - cum) / n) / (bins - 1))
        found = s["out"].isNull() & (n > 0) & (cum <= goal) & (cum + n >= goal)
        return F.struct((cum + n).alias("sum"), F.when(found, at).otherwise(s["out"]).alias("out"), (b + 1).alias("b"))

    return F.aggregate(hist, start, step)["out"]
