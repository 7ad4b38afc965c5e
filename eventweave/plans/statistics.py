"""Statistics of an event stream: arrival rates of the types and selectivities of conditions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import Condition


def arrival_rates(events: DataFrame, every: str | None = None) -> DataFrame:
    """event_type, n, rate (events in a second of the stream's span); with every (an interval) also for each window_start."""
    if every:
        w = F.window(F.timestamp_micros("us"), every)
        seconds = F.unix_micros("w.end") - F.unix_micros("w.start")
        return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n", (F.col("n") * 1e6 / seconds).alias("rate"))
    per = events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi"))
    span = events.agg((F.max("us") - F.min("us")).alias("span"))
    return per.join(F.broadcast(span)).select("event_type", "n", (F.col("n") * 1e6 / F.greatest("span", F.lit(1))).alias("rate"))


def selectivity(events: DataFrame, left: tuple[str, str], right: tuple[str, str], condition: Condition, width: timedelta = timedelta(hours=1), sample: float = 1.0) -> DataFrame:
    """One row: pairs and selectivity of a condition over pairs of (type, name) events that fall into one slice of that width.

    Slices bound the pairs, as a pattern's window does; sample keeps a share of the events of both types, by a hash of their place.
    """
    us = width // timedelta(microseconds=1)
    sides = []
    for k, (kind, name) in enumerate((left, right)):
        own = events.where(F.col("event_type") == kind)
        if sample < 1:
            own = own.where(F.pmod(F.xxhash64("seq"), F.lit(1_000_000)) < int(sample * 1_000_000))
        cols = [F.col(x).alias(f"{name}__{x}") for x in own.columns if x != "event_type"]
        sides.append(own.select(*cols, F.call_function("div", F.col("us") - F.pmod("us", F.lit(us)), F.lit(us)).alias(f"_d{k}")))
    pairs = sides[0].join(sides[1], F.col("_d0") == F.col("_d1"))
    ok = F.coalesce(condition.column(), F.lit(False)).cast("double")
    return pairs.agg(F.count("*").alias("pairs"), F.avg(ok).alias("selectivity"))


def own_selectivity(events: DataFrame, kind: str, name: str, condition: Condition) -> DataFrame:
    """One row: events and selectivity of a condition on single events."""
    own = events.where(F.col("event_type") == kind)
    own = own.select(*[F.col(x).alias(f"{name}__{x}") for x in own.columns])
    return own.agg(F.count("*").alias("events"), F.avg(F.coalesce(condition.column(), F.lit(False)).cast("double")).alias("selectivity"))
