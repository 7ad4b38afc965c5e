"""Patterns over streams: event-time joins whose state the watermark bounds, and planning between micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..operators.storage import cut
from ..plans.pattern import And, Event, Not, Pattern, Seq
from ..plans.planner import ReplanTrigger, Statistics, invariants_of


def _interval(us: int) -> Column:
    return F.expr(f"interval {us // 1_000_000} seconds {us % 1_000_000} microseconds")


def stream_matches(events: DataFrame, pattern: Pattern, delay: str = "1 minute") -> DataFrame:
    """Matches of a flat Seq or And of events over a streaming DataFrame with seq, event_type, ts (timestamp) and attributes.

    Each slot is a filtered copy of the stream with a watermark; slots are joined one after the other with conditions on
    their times, so that Spark drops state that no later event can reach. A Not at the end of a Seq is an outer join
    on the time that the window leaves, from which rows without a partner come out when the watermark has passed.
    """
    args = pattern.structure.args
    if not isinstance(pattern.structure, (Seq, And)) or not all(isinstance(a.arg if isinstance(a, Not) else a, Event) for a in args):
        raise ValueError("a streaming pattern is a flat Seq or And of events")
    if any(isinstance(a, Not) for a in args[:-1]) or (isinstance(args[-1], Not) and isinstance(pattern.structure, And)):
        raise ValueError("a streaming Not is the last argument of a Seq")
    ordered, w = isinstance(pattern.structure, Seq), pattern.window_us
    stream = events.withWatermark("ts", delay)
    conditions, done = pattern.condition.conjuncts(), set()

    def slot(e: Event) -> DataFrame:
        df = stream.where(F.col("event_type") == e.type)
        return df.select(*[F.col(x).alias(f"{e.name}__{x}") for x in df.columns])

    def take(names: set[str]) -> list[Column]:
        out = []
        for i, x in enumerate(conditions):
            if i not in done and x.names() <= names:
                done.add(i)
                out.append(x.column())
        return out

    def ts(name: str) -> Column:
        return F.col(f"{name}__ts")

    def cell(name: str) -> Column:
        us, width = F.col(f"{name}__us"), F.lit(max(w, 1))
        return F.call_function("div", us - F.pmod(us, width), width)

    names: list[str] = []
    out: DataFrame | None = None
    for a in args:
        negative = isinstance(a, Not)
        e = a.arg if negative else a
        right = slot(e)
        if out is None:
            for x in take({e.name}):
                right = right.where(x)
            out, names = right, [e.name]
            continue
        on = take({*names, e.name})
        if ordered:
            on += [ts(e.name) >= ts(names[-1]), ts(e.name) <= ts(names[0]) + _interval(w)]
        else:
            for n in names:
                on += [ts(e.name) >= ts(n) - _interval(w), ts(e.name) <= ts(n) + _interval(w)]
        on += [F.col(f"{e.name}__seq") != F.col(f"{n}__seq") for n in names]
        # Stream joins need an equality: windows of the first event's time, to which the new event is dealt as often as they can meet.
        mine, theirs = f"_w{len(names)}", f"_v{len(names)}"
        first, own = cell(names[0]), cell(e.name)
        out = out.withColumn(mine, first)
        right = right.withColumn(theirs, F.explode(F.array(own - 1, own) if ordered else F.array(own - 1, own, own + 1)))
        on.append(F.col(mine) == F.col(theirs))
        cond = on[0]
        for x in on[1:]:
            cond = cond & x
        if negative:
            out = out.join(right, cond, "left_outer").where(F.col(f"{e.name}__seq").isNull()).drop(*right.columns)
        else:
            # The first event's time stays the one event-time column; the joins that follow allow no second.
            out = out.join(right, cond, "inner").withColumn(f"{e.name}__ts", F.timestamp_micros(f"{e.name}__us"))
            names.append(e.name)
    return out.drop(*[x for x in out.columns if x.startswith("_")])


class AdaptiveRun:
    """Evaluates a pattern on micro-batches and plans the join order anew when the trigger says so; for writeStream.foreachBatch.

    Every batch is evaluated together with the events of the last window, and reports the matches that end in it, so
    plans may change between batches without a match lost or repeated.
    """

    def __init__(self, pattern: Pattern, sink: Callable[[DataFrame, int], None], planner: str = "greedy", trigger: ReplanTrigger | None = None) -> None:
        self.pattern, self.sink, self.planner, self.trigger = pattern, sink, planner, trigger or ReplanTrigger("deviation")
        self.rates: dict[str, float] = {}
        self.kept: DataFrame | None = None
        self.replans = 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            span = batch.agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.min("seq").alias("first")).first()
            if span.lo is None:
                return
            counts = {r.event_type: r["count"] for r in batch.groupBy("event_type").count().collect()}  # a row for each type
            seconds = max((span.hi - span.lo) / 1e6, 1e-6)
            types = sorted(set(counts) | set(self.rates))
            s = Statistics([counts.get(t, 0) / seconds for t in types])
            same = self.trigger.base is not None and len(self.trigger.base.rates) == len(types)
            if not same or self.trigger.should_replan(s):
                self.rates = dict(zip(types, s.rates, strict=True))
                self.trigger.planned(s, invariants_of(self.planner, s))
                self.replans += 1
            known = batch if self.kept is None else self.kept.unionByName(batch)
            engine = Engine(self.pattern, planner=self.planner, rates=self.rates)
            found = engine.run(known)
            ends = F.greatest(*[F.col(x) for x in found.columns if x.endswith("__seq")], F.lit(-1))
            self.sink(found.where(ends >= span.first), batch_id)
            self.kept = cut(known.where(F.col("us") >= span.hi - self.pattern.window_us))
        finally:
            batch.unpersist()

