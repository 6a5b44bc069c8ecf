"""Time series of measured values: every series at once, one shuffle by series key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaloom.functions import scalars

DAY = 86400.0


def days(ts: Column, origin: str = "2024-01-01") -> Column:
    """Days since a fixed origin; a slope does not depend on it, and small numbers keep its digits."""
    # whole microseconds up to the difference: seconds since 1970 as a double would lose them
    return (F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.lit(origin).cast("timestamp"))) / 1e6 / DAY


def statistics(df: DataFrame, keys: Sequence[str], ts: str, value: str, upright: float = 0.0, bare: bool = False) -> DataFrame:
    """n, mean, sd (sample, 0 for one point), slope a day (0 where undefined); rows without a value do not count.

    ``upright`` is the slope of points that all have one time, a single point among them; with ``bare`` series without any value are kept, with n = 0.
    """
    x, y = days(F.col(ts)), F.col(value).cast("double")
    return (df if bare else df.where(y.isNotNull())).groupBy(*keys).agg(
        F.count(y).alias("n"),
        F.avg(y).alias("mean"),
        F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("sd"),
        F.coalesce(F.regr_slope(y, x), F.when(F.regr_count(y, x) > 0, F.lit(upright)), F.lit(0.0)).alias("slope"),
    )


def direction(slope: Column, sd: Column, mean: Column) -> Column:
    base = F.when(mean == 0, 1.0).otherwise(F.abs(mean))
    steep, spread = F.abs(slope) / base, sd / base
    return (
        F.when((mean == 0) & (sd == 0), "stable")
        .when((spread > 0.3) & (steep < 0.01), "fluctuating")
        .when(steep < 0.005, "stable")
        .when(slope > 0, "rising")
        .otherwise("falling")
    )


def anomalies(df: DataFrame, keys: Sequence[str], ts: str, value: str, ties: str, above: float = 2.0) -> DataFrame:
    """Points more than ``above`` sample deviations from their series' mean, with their place in time order from 0."""
    series = Window.partitionBy(*keys)
    y = F.col(value).cast("double")
    out = df.where(y.isNotNull()).withColumns({"_m": F.avg(y).over(series), "_s": F.stddev_samp(y).over(series), "index": F.row_number().over(series.orderBy(ts, ties)) - 1})
    return out.withColumn("deviation", F.abs(y - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).where(F.col("deviation") > above).drop("_m", "_s")


def against_range(df: DataFrame, keys: Sequence[str], ts: str, value: str, range_text: str) -> DataFrame:
    """Counts below and above the newest non-empty range of the series; series without a numeric range are left out.

    The newest range comes from one grouped maximum, and counts from a join on the series key.
    """
    newest = df.where(F.col(range_text) != "").groupBy(*keys).agg(F.max_by(range_text, ts).alias("_r"))
    bounds = newest.withColumn("_b", scalars.reference_range(F.col("_r"))).where("_b.min IS NOT NULL OR _b.max IS NOT NULL")
    low, high, y = F.col("_b.min"), F.col("_b.max"), F.col(value)
    below = F.coalesce(y < low, F.lit(False))
    above = ~below & F.coalesce(y > high, F.lit(False))
    joined = df.where(y.isNotNull()).join(bounds, list(keys))
    return joined.groupBy(*keys).agg(
        F.first(low).alias("range_min"), F.first(high).alias("range_max"), F.count_if(below).alias("below"), F.count_if(above).alias("above"),
    ).withColumn("within", (F.col("below") == 0) & (F.col("above") == 0))


def picker(df: DataFrame, canonical: str, verbatim: str, unit: str, ts: str) -> DataFrame:
    """Series to choose from: counts by (canonical, verbatim, unit), then merged by canonical or lower-cased verbatim name.

    Name and unit come from the largest subgroup; it also sets the order, so it is kept as ``largest``.
    """
    first = df.groupBy(canonical, verbatim, unit).agg(F.count("*").alias("c"), F.max(ts).alias("last"))
    key = F.coalesce(F.col(canonical), F.lower(F.trim(F.col(verbatim))))
    # equal counts: the name and unit that come first
    size = F.struct(F.col("c"), F.col(verbatim), F.col(unit))
    return first.groupBy(key.alias("series")).agg(
        F.sum("c").alias("points"), F.max("last").alias("last_at"), F.max_by(verbatim, size).alias("display"), F.max_by(unit, size).alias("unit"), F.max("c").alias("largest"),
    )


def domain(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Least and greatest value of each series: what its axis must span."""
    return df.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("greatest"))


def points(df: DataFrame, keys: Sequence[str], ts: str, ties: str) -> DataFrame:
    """All points of each series in order of time, numbered from 1."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(ts, ties)))
