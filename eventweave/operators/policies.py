"""Consumption policies that depend on the order in which matches are complete: single matches and freezing."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.pattern import Pattern, Policy, flat_sequences
from .match import Rel
from .storage import cut

#: Matches that one task decides on.
SMALL = 100_000


def apply_single(rel: Rel, types: tuple[str, ...]) -> Rel:
    """Every event of those types is in at most one match; matches are accepted in the order of their completion.

    With one such slot in the pattern every event decides for itself, and that is a row number. With several slots an
    accepted match takes several events. Then matches are accepted in rounds: one that comes first at each of its events is
    accepted, and those that share an event with it are gone. That gives what going through all matches in their order
    gives, in a few rounds of grouped minima; as soon as no more than SMALL matches are left, one task decides the rest.
    """
    own = [s for s in rel.slots if s.type in types or s.type == "*"]
    if not own:
        return rel
    order = [rel.arrival, *[s.seq for s in rel.slots if not s.many]]
    if len(own) == 1 and not own[0].many:
        rel.df = rel.df.withColumn("_n", F.row_number().over(Window.partitionBy(own[0].seq).orderBy(*order))).where("_n = 1").drop("_n")
        return rel
    taken = F.concat(*[s.seq if s.many else F.array(s.seq) for s in own])
    df = rel.df.withColumn("_taken", taken).withColumn("_order", F.array(*[x.cast("long") for x in order]))
    key = F.struct(*[F.col(f"`{x}`") for x in rel.df.columns])
    live = cut(df.select(F.xxhash64(key).alias("_id"), "_taken", "_order"))
    kept = None
    while live.limit(SMALL + 1).count() > SMALL:
        each = live.select("_id", "_order", F.explode("_taken").alias("event"))
        first = each.groupBy("event").agg(F.min(F.struct("_order", "_id")).alias("first"))
        ahead = each.join(first, "event").groupBy("_id").agg(F.bool_and(F.col("first._id") == F.col("_id")).alias("ok")).where("ok").select("_id")
        won = cut(live.join(ahead, "_id", "left_semi"))
        gone = each.join(won.select(F.explode("_taken").alias("event")).distinct(), "event", "left_semi").select("_id").distinct()
        live = cut(live.join(gone, "_id", "left_anti"))
        won = won.select(F.col("_id").alias("_kept"))
        kept = won if kept is None else kept.union(won)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(k=rows["_order"].map(tuple)).sort_values(["k", "_id"], kind="stable")
        seen: set[int] = set()
        keep = []
        for i, own in zip(rows["_id"], rows["_taken"], strict=True):
            if not seen.intersection(own):
                seen.update(own)
                keep.append(i)
        return pd.DataFrame({"_kept": keep}, dtype="int64")

    rest = live.groupBy(F.lit(0).alias("g")).applyInPandas(choose, "_kept long")
    kept = rest if kept is None else kept.union(rest)
    rel.df = df.withColumn("_id", F.xxhash64(key)).join(kept, F.col("_id") == F.col("_kept"), "left_semi").drop("_id", "_taken", "_order")
    return rel


def freeze_matches(rel: Rel, events: DataFrame, structure, pattern: Pattern, policy: Policy) -> Rel:
    """Keep the matches that freezing leaves: a state machine over the stream in its order.

    While an event of a freezer's name is in no match and not older than the window, the names at and before its place in
    its sequence take no further event. A match with the freezer, or its age as an event of such a name comes, ends that; the
    age of events without a time is never told. The machine needs the stream in order, so one sorted partition passes through
    it, a batch after the other. That holds only what can change its state: places and times of the events of those names, and
    of all matches with the same such events the place where the first is complete. What it takes decides the matches in a
    join. It remembers a window's ignored events where freezing concerns several names, and nothing but the freezers where it
    concerns one.
    """
    types = {s.name: s.type for s in rel.slots if not s.many}
    frozen = {f: set(seq[: seq.index(f) + 1]) & set(types) for seq in flat_sequences(structure) for f in policy.freeze if f in seq and f in types}
    if not frozen:
        return rel
    names = [n for n in types if any(n in x for x in frozen.values())]
    kinds = sorted({types[n] for n in names})
    takes = [[i for i, n in enumerate(names) if types[n] == k] for k in kinds]
    stops = {names.index(f): {names.index(n) for n in x} for f, x in frozen.items()}
    several = len(names) > 1
    never = 2**63 - 1
    ends = F.coalesce(F.col("us") + pattern.window_us, F.lit(never))
    kind = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("event_type")).cast("int") - 1
    stream = events.where(F.col("event_type").isin(kinds) & F.col("seq").isNotNull())
    stream = stream.select("seq", kind.alias("kind"), F.coalesce("us", F.lit(-(2**63))).alias("us"), ends.alias("ends"), *[F.lit(-1).cast("long").alias(f"n{i}") for i in range(len(names))])
    whole = F.lit(True)
    for s in rel.slots:
        whole = whole & s.seq.isNotNull()
    own = [F.col(f"`{n}__seq`").alias(f"n{i}") for i, n in enumerate(names)]
    first = rel.df.where(whole).groupBy(*own).agg(F.min(rel.arrival).alias("seq"))
    first = first.select("seq", F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("us"), F.lit(0).cast("long").alias("ends"), *[f"n{i}" for i in range(len(names))])

    def now(active: list) -> tuple[frozenset, int]:
        """The names that the freezers stop, and the first time beyond which one of them has its age."""
        return frozenset().union(*[stops[f[0]] for f in active]), min((f[2] for f in active), default=never)

    def machine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        active: list[tuple[int, int, int]] = []  # name, place, last time; no more than one place of a name
        stopped, soonest = frozenset(), never
        ignored: list[set[int]] = [set() for _ in names]
        aging: list[deque[tuple[int, int]]] = [deque() for _ in names]  # last time and place of the ignored
        last: list[int | None] = [None] * len(names)
        for rows in batches:
            out: list[tuple[int, int]] = []
            for seq, k, us, end, *m in zip(*[rows[x].tolist() for x in rows.columns], strict=True):
                before = active
                if k < 0:
                    for n, place, _ in active:
                        if m[n] == place and not (several and any(s in x for s, x in zip(m, ignored, strict=True))):
                            active = [f for f in active if m[f[0]] != f[1]]
                            break
                elif us > soonest:
                    active = [f for f in active if us <= f[2]]
                if active is not before:
                    stopped, soonest = now(active)
                if k < 0:
                    continue
                before = active
                for n in takes[k]:
                    if n not in stopped or last[n] == seq:  # a repeated row goes the way of the first
                        out.append((n, seq))
                        last[n] = seq
                        if n in stops:
                            active = [*active, (n, seq, end)]
                    elif several:
                        ignored[n].add(seq)
                        aging[n].append((end, seq))
                    while aging[n] and us > aging[n][0][0]:
                        ignored[n].discard(aging[n].popleft()[1])
                if active is not before:
                    stopped, soonest = now(active)
            yield pd.DataFrame(out, columns=["_name", "_place"])

    both = stream.unionByName(first).repartition(1).sortWithinPartitions("seq", F.desc("kind"), "us")
    taken = both.mapInPandas(machine, "_name int, _place long")
    taken = cut(taken) if several else taken
    for i, n in enumerate(names):
        rel.df = rel.df.join(taken.where(F.col("_name") == i).select("_place"), F.col(f"`{n}__seq`") == F.col("_place"), "left_semi")
    return rel
