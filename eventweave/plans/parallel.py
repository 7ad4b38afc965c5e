"""Explicit ways to deal a stream to units of work. All give the matches of the plain engine."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from .pattern import Pattern, events_of


def by_key(events: DataFrame, pattern: Pattern, key: str, units: int) -> DataFrame:
    """Deal events by a key on which all events of a match agree; events whose key is not a number are dropped, as in the original."""
    k = F.expr(f"try_cast({key} as bigint)")
    own = events.withColumn("unit", F.pmod(k, F.lit(units))).where("unit is not null").repartition(units, "unit")
    engine = Engine(pattern)
    engine.options = replace(engine.options, part="unit")
    return _without(engine.run(own), "unit")


def by_time(events: DataFrame, pattern: Pattern, width: timedelta) -> DataFrame:
    """Slices of the stream that overlap by the window; a match belongs to the slice of its first event."""
    w = width // timedelta(microseconds=1)
    back = -(-pattern.window_us // w)
    number = F.call_function("div", F.col("us") - F.pmod("us", F.lit(w)), F.lit(w))
    own = events.withColumn("slice", F.explode(F.sequence(number - back, number)))
    engine = Engine(pattern)
    engine.options = replace(engine.options, part="slice")
    out = engine.run(own)
    name = events_of(pattern.structure)[0].name
    first = F.call_function("div", F.col("first_us") - F.pmod("first_us", F.lit(w)), F.lit(w))
    return _without(out.where(F.col(f"{name}__slice") == first), "slice")


def hypercube(events: DataFrame, pattern: Pattern, attributes: dict[str, str], shares: list[int]) -> DataFrame:
    """Cells of a cube with one dimension for each type in attributes (type -> attribute), of the given shares.

    An event of such a type has a fixed place on its own dimension and is in all cells along the others; other types are
    in all cells. A match belongs to the smallest cell that all its events share.
    """
    kinds = list(attributes)
    total = 1
    for s in shares:
        total *= s
    cells = F.sequence(F.lit(0), F.lit(total - 1))
    step, mine = 1, cells
    for kind, share in zip(kinds, shares, strict=True):
        at = F.pmod(F.xxhash64(F.col(attributes[kind])), F.lit(share)).cast("int")
        own = _along(cells, step, share, at)
        mine = F.when(F.col("event_type") == kind, own).otherwise(mine)
        step *= share
    dealt = events.withColumn("cells", mine).withColumn("cell", F.explode("cells"))
    engine = Engine(pattern)
    engine.options = replace(engine.options, part="cell")
    out = engine.run(dealt)
    names = [e.name for e in events_of(pattern.structure) if f"{e.name}__cell" in out.columns]
    common = F.col(f"{names[0]}__cells")
    for n in names[1:]:
        common = F.array_intersect(common, F.col(f"{n}__cells"))
    return _without(out.where(F.col(f"{names[0]}__cell") == F.array_min(common)), "cell", "cells")


def _along(cells, step: int, share: int, at):
    return F.filter(cells, lambda x: (F.floor(x / F.lit(step)) % share).cast("int") == at)


def _without(df: DataFrame, *attributes: str) -> DataFrame:
    return df.drop(*[x for x in df.columns if any(x.endswith(f"__{a}") for a in attributes)])
