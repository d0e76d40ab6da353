"""Layered settings and build comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolved(layers: DataFrame) -> DataFrame:
    """(key, value, origin) from layers (layer, key, value): env before file before default."""
    rank = F.when(F.col("layer") == "env", 0).when(F.col("layer") == "file", 1).otherwise(2)
    best = F.min_by(F.struct("value", F.col("layer").alias("origin")), F.when(F.col("value").isNotNull(), rank))
    return layers.groupBy("key").agg(best.alias("b")).select("key", "b.value", "b.origin")


def version_parts(version: Column) -> Column:
    """A version's numbers, or null where a part does not begin with one."""
    parts = F.transform(F.split(F.trim(version), r"\."), lambda p: F.regexp_extract(F.trim(p), r"^(\d+)", 1))
    return F.when(~F.exists(parts, lambda p: p == ""), F.transform(parts, lambda p: p.try_cast("int")))


def compared(local: Column, remote: Column, local_commit: Column, remote_commit: Column) -> Column:
    """How a remote build stands to the local one."""
    mine, other = version_parts(local), version_parts(remote)
    return (
        F.when(F.coalesce(remote, F.lit("")) == "", "remote_unknown")
        .when((F.coalesce(local, F.lit("")) == "") | mine.isNull() | other.isNull(), "differ")
        .when(mine > other, "remote_older").when(mine < other, "local_older")
        .when((F.coalesce(local_commit, F.lit("")) != "") & (F.coalesce(remote_commit, F.lit("")) != "") & (local_commit != remote_commit), "differ")
        .otherwise("same")
    )
