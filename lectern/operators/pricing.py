"""Dated prices: an as-of lookup that falls back to the oldest rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import patterns as P


def price_table(spark: SparkSession) -> DataFrame:
    """(model, valid_from, usd_per_minute): a dimension of fixed size."""
    return spark.createDataFrame(list(P.PRICES), "model string, valid_from string, usd_per_minute double").withColumn("valid_from", F.to_date("valid_from"))


def rate_on(model: str, day: Column) -> Column:
    """The model's rate on a day as an expression over the fixed price list; 0 for an unknown model."""
    entries = sorted((d, r) for m, d, r in P.PRICES if m == model)
    if not entries:
        return F.lit(0.0)
    out = F.lit(entries[0][1])
    for start, rate in entries[1:]:
        out = F.when(day >= F.to_date(F.lit(start)), F.lit(rate)).otherwise(out)
    return out


def priced(rows: DataFrame, prices: DataFrame, key: str) -> DataFrame:
    """`rows` (key, model, day) with the rate of the last entry not after the day, else the oldest, else 0."""
    joined = rows.join(prices, "model", "left")
    past = F.when(F.col("valid_from") <= F.col("day"), F.col("valid_from"))
    rate = F.coalesce(F.max_by("usd_per_minute", past), F.min_by("usd_per_minute", "valid_from"), F.lit(0.0))
    return joined.groupBy(key, "model", "day").agg(rate.alias("rate"))


def cost(rate: Column, seconds: Column) -> Column:
    """US dollars for seconds of audio; negative time is free."""
    return rate * F.greatest(F.lit(0.0), seconds) / 60
