"""Histories of states: chains of changes, current values, values as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A state ends this long before the next begins.
GAP = "INTERVAL 1 MILLISECOND"


def chain(observations: DataFrame, keys: list[str], value: str = "value", t: str = "t", tie: str = "id") -> DataFrame:
    """One row per change of value: valid_from, valid_to (null while current), and the value before."""
    w = Window.partitionBy(*keys).orderBy(t, tie)
    changed = observations.withColumn("_before", F.lag(value).over(w)).filter(~F.col(value).eqNullSafe(F.col("_before")) | F.col("_before").isNull())
    after = F.lead(t).over(w)
    return changed.select(*keys, F.col(value).alias("value"), F.col(t).alias("valid_from"), (after - F.expr(GAP)).alias("valid_to"), F.col("_before").alias("value_before"), F.col(tie).alias("source_event_id"))


def current(states: DataFrame, keys: list[str]) -> DataFrame:
    """The latest state of each key, by a partial aggregate."""
    rest = [c for c in states.columns if c not in keys]
    return states.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("valid_from", "source_event_id")).alias("s")).select(*keys, "s.*")


def as_of(states: DataFrame, keys: list[str], t: Column, gap: bool = False) -> DataFrame:
    """The state of each key at a time. With gap, a state doesn't hold between its end and the next one's beginning."""
    begun = states.filter(F.col("valid_from") <= t)
    if gap:
        begun = begun.filter(F.col("valid_to").isNull() | (F.col("valid_to") > t))
    return current(begun, keys)


def changes(states: DataFrame, start: Column, end: Column) -> DataFrame:
    return states.filter((F.col("valid_from") >= start) & (F.col("valid_from") <= end))


def late(observations: DataFrame, keys: list[str], arrival: str, t: str = "t") -> DataFrame:
    """Observations that arrive after a later one of their key did: these wait for approval instead of rewriting history."""
    w = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return observations.withColumn("_seen", F.max(t).over(w)).filter(F.col(t) < F.col("_seen")).drop("_seen").withColumn("pending_reason", F.lit("out_of_order"))
