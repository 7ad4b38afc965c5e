"""Compilation of a pattern's operator tree to DataFrame joins.

A partial match is a row. An event slot n has the columns n__seq (place in the stream), n__us (time in microseconds) and
n__<attribute>; a closure has its list as an array of structs in the column of its name, with n__first, n__last and n__seq.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.conditions import Condition, KCCondition, KCCrossCondition, KCIndexCondition, KCValueCondition, Var
from ..plans.pattern import NEXT, And, Event, Kleene, Not, Or, Seq, bound_names, events_of


@dataclass
class Options:
    #: Bucket joins by time windows even where an equality joins them, which bounds the rows of a busy key.
    bucket_keyed: bool = True
    #: Longest list of candidates that a closure without a largest size may enumerate; beyond it the query fails.
    kleene_limit: int = 20
    #: Follow the reference behaviour in places where it departs from the documented one: events of a nested And in a Seq
    #: are in order, and only the first pair of the second and further contiguous lists counts.
    compat: bool = False
    #: A further column of the events on which all joins agree (execution in slices or cells).
    part: str | None = None
    #: Join order of each operator: a function from (node, arguments) to an order of the positive arguments.
    order: object = None
    #: Arrival rates by event type, by which negations are put in order; without them they are taken as written.
    rates: dict[str, float] | None = None


@dataclass
class Slot:
    name: str
    type: str
    seq: Column  # of an event, or the array of those of a list
    many: bool = False


@dataclass
class Rel:
    """A DataFrame of partial matches. first and last are its time span, arrival the place of its latest event."""

    df: DataFrame
    slots: list[Slot]
    first: Column
    last: Column
    arrival: Column
    positions: list[tuple[int, Column, Column]] = field(default_factory=list)  # position in the parent, first, last
    names: set[str] = field(default_factory=set)
    probs: list[Column] = field(default_factory=list)


_serial = count()


def c(name: str, attribute: str | None = None) -> Column:
    return F.col(f"`{name}__{attribute}`" if attribute else f"`{name}`")


def _least(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


def _greatest(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def distinct_events(a: list[Slot], b: list[Slot]) -> list[Column]:
    """Predicates that no event is in a slot of a and in one of b; slots of different types never share one."""
    out = []
    for x in a:
        for y in b:
            if x.type != y.type and x.type != "*" and y.type != "*":
                continue
            if x.many and y.many:
                out.append(~F.arrays_overlap(x.seq, y.seq))
            elif x.many or y.many:
                out.append(~F.array_contains(x.seq, y.seq) if x.many else ~F.array_contains(y.seq, x.seq))
            else:
                out.append(x.seq != y.seq)
    return out


def shared_arguments(node, names: frozenset) -> list[int]:
    """The places of an operator's arguments that hold just those names between them, or none."""
    own = {i: {e.name for e in events_of(a)} for i, a in enumerate(node.args) if not isinstance(a, Not)}
    inside = [i for i, n in own.items() if n <= names]
    return inside if set().union(*[own[i] for i in inside]) == names else []


def without(tree, leaves: set[int]):
    """A join order without those leaves; None where nothing is left."""
    if isinstance(tree, int):
        return None if tree in leaves else tree
    a, b = without(tree[0], leaves), without(tree[1], leaves)
    return a if b is None else b if a is None else (a, b)


class Compiler:
    def __init__(self, events: DataFrame, window_us: int, conditions: list[Condition], options: Options, policy=None, confidence: float | None = None, parts: dict[frozenset, Rel] | None = None) -> None:
        self.events, self.window, self.conditions, self.options = events, window_us, list(conditions), options
        self.attributes = [x for x in events.columns if x not in ("seq", "event_type", "us")]
        self.has_prob = "prob" in events.columns
        self.policy, self.confidence = policy, confidence
        self.parts = parts or {}  # names -> partial matches of those events that several patterns share
        self.used: set[int] = set()
        self.next_types = set()
        if policy is not None:
            self.next_types = set(policy.single) if policy.secondary == NEXT else set()

    # Conditions are taken by the lowest node that binds all their names.
    def take(self, names: set[str]) -> list[Condition]:
        out = []
        for i, x in enumerate(self.conditions):
            if i not in self.used and x.names() <= names and x.names():
                self.used.add(i)
                out.append(x)
        return out

    def compile(self, node) -> Rel:
        if isinstance(node, Event):
            return self.leaf(node)
        if isinstance(node, Kleene):
            return self.kleene(node)
        if isinstance(node, (Seq, And)):
            return self.operator(node)
        if isinstance(node, Or):
            raise ValueError("rewrite Or into several patterns first")
        raise ValueError("a Not needs a positive event beside it")

    def leaf(self, node: Event) -> Rel:
        own = self.take({node.name})
        df = self.events.where(F.col("event_type") == node.type)
        df = df.select(*[F.col(x).alias(f"{node.name}__{x}") for x in ["seq", "us", *self.attributes]])
        for x in own:
            df = df.where(x.column())
        us, seq = c(node.name, "us"), c(node.name, "seq")
        probs = [F.coalesce(c(node.name, "prob"), F.lit(1.0))] if self.has_prob else []
        rel = Rel(df, [Slot(node.name, node.type, seq)], us, us, seq, names={node.name}, probs=probs)
        return self.confident(rel)

    def confident(self, rel: Rel) -> Rel:
        if self.confidence is not None and rel.probs:
            p = rel.probs[0]
            for x in rel.probs[1:]:
                p = p * x
            rel.df = rel.df.where(p >= self.confidence)
        return rel

    def operator(self, node) -> Rel:
        args = list(node.args)
        positive = [i for i, a in enumerate(args) if not isinstance(a, Not)]
        negative = [i for i, a in enumerate(args) if isinstance(a, Not)]
        if rates := self.options.rates:  # the most frequent negative first: it ends most matches
            negative.sort(key=lambda i: -min(rates.get(e.type, 1.0) for e in events_of(args[i].arg)))
        if not positive:
            raise ValueError("a Not needs a positive event beside it")
        self.refuse_between_negatives(args, negative)
        tree = self.options.order(node, [args[i] for i in positive]) if self.options.order else None
        if tree is None:
            tree = 0
            for k in range(1, len(positive)):
                tree = (tree, k)
        rels = {}
        for names in self.parts:
            if len(inside := shared_arguments(node, names)) > 1:
                key = len(positive) + len(rels)
                rels[key] = self.shared_part(names, args, inside)
                rest = without(tree, {k for k, i in enumerate(positive) if i in inside})
                tree = key if rest is None else (key, rest)
                positive = [None if i in inside else i for i in positive]
        for k, i in enumerate(positive):
            if i is not None:
                r = self.compile(args[i])
                r.positions = [(i, r.first, r.last)]
                rels[k] = r
        rel = self.join_tree(tree, rels, ordered=isinstance(node, Seq))
        for i in negative:
            rel = self.negate(rel, args[i].arg, i, isinstance(node, Seq))
        rel.positions = []
        return rel

    def shared_part(self, names: frozenset, args: list, inside: list[int]) -> Rel:
        """A shared part as the join of those arguments: its conditions are done, its window and confidence may be wider than here."""
        self.take(set(names))
        part = self.parts[names]
        df = part.df if self.window >= 2**62 else part.df.where(part.last - part.first <= self.window)
        positions = []
        for i in inside:
            us = [c(e.name, "us") for e in events_of(args[i])]
            positions.append((i, _least(us), _greatest(us)))
        return self.confident(Rel(df, list(part.slots), part.first, part.last, part.arrival, positions, set(names), list(part.probs)))

    def refuse_between_negatives(self, args: list, negative: list[int]) -> None:
        inner = [set(e.name for e in events_of(args[i].arg)) for i in negative]
        for x in self.conditions:
            if sum(bool(x.names() & n) for n in inner) > 1:
                raise ValueError(f"a condition joins two different negated events: {sorted(x.names())}")

    def join_tree(self, tree, rels: dict[int, Rel], ordered: bool) -> Rel:
        if isinstance(tree, int):
            return rels[tree]
        return self.join(self.join_tree(tree[0], rels, ordered), self.join_tree(tree[1], rels, ordered), ordered)

    def join(self, a: Rel, b: Rel, ordered: bool) -> Rel:
        w = self.window
        first, last = F.least(a.first, b.first), F.greatest(a.last, b.last)
        on = [last - first <= w] if w < 2**62 else []
        positions = sorted(a.positions + b.positions, key=lambda x: x[0])
        low_side = None
        if ordered:
            mine = {x[0] for x in a.positions}
            for (i, _, end), (j, start, _) in zip(positions, positions[1:], strict=False):
                if (i in mine) != (j in mine):
                    on.append(end <= start)
            if max(mine) < min(x[0] for x in b.positions):
                low_side = "a"
            elif min(mine) > max(x[0] for x in b.positions):
                low_side = "b"
        on += distinct_events(a.slots, b.slots)
        names = a.names | b.names
        own = self.take(names)
        keyed = any(x.key()[0] == "=" and all(isinstance(t, Var) for t in x.terms) and len(x.names()) == 2 for x in own)
        on += [x.column() for x in own]
        on += [k for x in own if isinstance(x, KCCrossCondition) and (k := x.join_key()) is not None]
        da, db = a.df, b.df
        if self.options.part and not a.slots[0].many and not b.slots[0].many:
            on.append(c(a.slots[0].name, self.options.part) == c(b.slots[0].name, self.options.part))
        drop = []
        if w < 2**62 and (self.options.bucket_keyed or not keyed):
            x, y = f"_b{next(_serial)}", f"_b{next(_serial)}"
            cell_a, cell_b = self.cell(a.first), self.cell(b.first)
            if low_side == "a":
                da, db = da.withColumn(x, F.explode(F.array(cell_a, cell_a + 1))), db.withColumn(y, cell_b)
            elif low_side == "b":
                da, db = da.withColumn(x, cell_a), db.withColumn(y, F.explode(F.array(cell_b, cell_b + 1)))
            else:
                da, db = da.withColumn(x, cell_a), db.withColumn(y, F.explode(F.array(cell_b - 1, cell_b, cell_b + 1)))
            on.append(F.col(x) == F.col(y))
            drop = [x, y]
        cond = on[0] if on else F.lit(True)
        for x in on[1:]:
            cond = cond & x
        df = da.join(db, cond).drop(*drop)
        out = Rel(df, a.slots + b.slots, first, last, F.greatest(a.arrival, b.arrival), positions, names, a.probs + b.probs)
        return self.confident(self.next_filter(out))

    def cell(self, us: Column) -> Column:
        """The number of the window that holds a time, also before 1970."""
        width = F.lit(max(self.window, 1))
        return F.call_function("div", us - F.pmod(us, width), width)

    def next_filter(self, rel: Rel) -> Rel:
        """Strategy next: an event of such a type is in one partial match from here on, the one that was complete first."""
        for s in rel.slots:
            if s.type in self.next_types and not s.many:
                order = [rel.arrival, *[x.seq for x in rel.slots if not x.many]]
                n = f"_n{next(_serial)}"
                rel.df = rel.df.withColumn(n, F.row_number().over(Window.partitionBy(s.seq).orderBy(*order))).where(F.col(n) == 1).drop(n)
        return rel

    def negate(self, rel: Rel, inner, place: int, ordered: bool) -> Rel:
        neg = self.compile(inner)
        w = self.window
        own = self.take(rel.names | neg.names)
        on = [x.column() for x in own]
        if w < 2**62:
            on.append(F.greatest(rel.last, neg.last) - F.least(rel.first, neg.first) <= w)
        if ordered:
            before = [x for x in rel.positions if x[0] < place]
            after = [x for x in rel.positions if x[0] > place]
            if before:
                on.append(neg.first >= max(before, key=lambda x: x[0])[2])
            if after:
                on.append(neg.last <= min(after, key=lambda x: x[0])[1])
                on.append(neg.arrival < rel.arrival)
        on += distinct_events(rel.slots, neg.slots)
        if self.options.part and not rel.slots[0].many and not neg.slots[0].many:
            on.append(c(rel.slots[0].name, self.options.part) == c(neg.slots[0].name, self.options.part))
        dp, dn, drop = rel.df, neg.df, []
        if w < 2**62:
            x, y = f"_b{next(_serial)}", f"_b{next(_serial)}"
            cell = self.cell(neg.first)
            dp, dn = dp.withColumn(x, self.cell(rel.first)), dn.withColumn(y, F.explode(F.array(cell - 1, cell, cell + 1)))
            on.append(F.col(x) == F.col(y))
            drop = [x, y]
        cond = F.lit(True)
        for x in on:
            cond = cond & x
        if not neg.probs:
            rel.df = dp.join(dn, cond, "left_anti").drop(*drop)
            return rel
        # Uncertain negatives: the match stays with its probability times (1 - p) for each that fits.
        p = neg.probs[0]
        for x in neg.probs[1:]:
            p = p * x
        own_id, q = f"_m{next(_serial)}", f"_q{next(_serial)}"
        key = F.struct(*[s.seq.alias(s.name) for s in rel.slots])
        dp = dp.withColumn(own_id, key)
        fits = dp.join(dn, cond).groupBy(F.col(own_id).alias(own_id + "k")).agg(F.product(1 - p).alias(q))
        rel.df = dp.join(fits, F.col(own_id) == F.col(own_id + "k"), "left").withColumn(q, F.coalesce(q, F.lit(1.0))).drop(own_id, own_id + "k", *drop)
        rel.df = rel.df.where(F.col(q) > 0)
        rel.probs = [*rel.probs, F.col(q)]
        return self.confident(rel)

    def kleene(self, node: Kleene) -> Rel:
        name = node.list_name
        own = [x for i, x in enumerate(self.conditions) if i not in self.used and x.names() == {name} and isinstance(x, (KCCondition, KCCrossCondition))]
        self.used |= {i for i, x in enumerate(self.conditions) if x in own}
        child = self.compile(node.arg)
        element = isinstance(node.arg, Event)
        each = [x for x in own if isinstance(x, KCValueCondition) and x.index is None]
        steps = [x for x in own if element and isinstance(x, KCIndexCondition) and x.offset in (1, -1)]
        # The list of a closure holds single events: those of a composite argument one after the other.
        parts = []
        for s in child.slots:
            one = F.struct(*[c(s.name, x).alias(x) for x in ["seq", "us", *self.attributes]]) if not s.many else None
            parts.append(F.array(one) if one is not None else F.col(f"`{s.name}`"))
        seqs = F.array(*[s.seq for s in child.slots if not s.many])
        for s in child.slots:
            if s.many:
                seqs = F.concat(seqs, s.seq)
        # The order in which the argument's matches come: by arrival, then by the slot of the event that completes them.
        places = [s.seq for s in child.slots if not s.many]
        order = F.array(child.arrival, *([F.array_position(F.array(*places), child.arrival), *places] if not element and places else []))
        loose = self.options.compat and not element  # there only the first and the last event of the list are held to the window
        df = child.df.select(F.struct(order.alias("o"), child.first.alias("f"), child.last.alias("l"), F.concat(*parts).alias("e"), seqs.alias("s")).alias("x"))
        for v in each:
            df = df.where(F.forall("x.e", v.element))
        # An equality of neighbours on an attribute makes it the closure's key.
        keys = [v.get(F.col("x.e")[0]) for v in steps if _is_equality(v)]
        most = node.max_size or self.options.kleene_limit
        dealt = self.window < 2**62 and not loose
        cell = self.cell(F.col("x.l")) if dealt else F.lit(0)
        keyed = df.select("x", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("z")).alias("k"), cell.alias("b"))
        if self.options.part and element:
            keyed = keyed.withColumn("k", F.struct("k", F.col("x.e")[0][self.options.part].alias("p")))
        before = keyed.select(F.col("x").alias("y"), F.col("k").alias("k2"), F.explode(F.array("b", F.col("b") + 1) if dealt else F.array("b")).alias("b2"))
        on = (F.col("k") == F.col("k2")) & (F.col("b") == F.col("b2")) & (F.col("y.o") < F.col("x.o"))
        if element:
            on = on & (F.abs(F.col("x.l") - F.col("y.f")) <= self.window)
        elif dealt:
            on = on & (F.greatest("x.l", "y.l") - F.least("x.f", "y.f") <= self.window)
        pairs = keyed.join(before, on, "left")
        groups = pairs.groupBy("x").agg(F.array_sort(F.collect_list("y")).alias("ys"))
        if node.max_size is None:
            message = F.concat(F.lit("a closure would enumerate subsets of "), F.size("ys").cast("string"), F.lit(" events; give it a largest size"))
            groups = groups.withColumn("ys", F.when(F.size("ys") < self.options.kleene_limit, F.col("ys")).otherwise(F.raise_error(message)))

        def grows(sub: Column, y: Column) -> Column:
            """Whether a subset may be followed by y: what neighbours have to satisfy."""
            ok = F.size(sub) < most - 1
            for v in steps:
                a, b = (v.get(F.get(sub, F.size(sub) - 1)["e"][0]), v.get(y["e"][0]))
                ok = ok & F.when(F.size(sub) == 0, True).otherwise(v.relation_op(a, b) if v.offset == 1 else v.relation_op(b, a))
            return ok

        empty = F.array(F.slice("ys", 1, 0))
        subsets = F.aggregate(
            "ys", empty, lambda acc, y: F.concat(acc, F.transform(F.filter(acc, lambda s: grows(s, y)), lambda s: F.array_append(s, y)))
        )
        whole = groups.select("x", F.explode(subsets).alias("sub"))
        full = whole.select(F.array_append("sub", F.col("x")).alias("a")).where((F.size("a") >= node.min_size) & (F.size("a") <= most if node.max_size else F.lit(True)))
        out = full.select(
            F.flatten(F.transform("a", lambda x: x["e"])).alias(name),
            F.array_min(F.transform("a", lambda x: x["f"])).alias(f"{name}__first"),
            F.array_max(F.transform("a", lambda x: x["l"])).alias(f"{name}__last"),
            F.array_max(F.transform("a", lambda x: x["o"][0])).alias(f"{name}__seq"),
            F.flatten(F.transform("a", lambda x: x["s"])).alias(f"{name}__seqs"),
        )
        first, last = c(name, "first"), c(name, "last")
        if loose and self.window < 2**62:
            e = c(name)
            out = out.where(F.abs(F.element_at(e, -1)["us"] - F.element_at(e, 1)["us"]) <= self.window)
        elif self.window < 2**62:
            out = out.where(last - first <= self.window)
        for v in own:
            if v not in each:
                out = out.where(v.column())
        probs = []
        if self.has_prob:
            probs = [F.aggregate(c(name), F.lit(1.0), lambda acc, e: acc * F.coalesce(e["prob"], F.lit(1.0)))]
        types = {s.type for s in child.slots}
        slot = Slot(name, types.pop() if len(types) == 1 else "*", c(name, "seqs"), many=True)
        return self.confident(Rel(out, [slot], first, last, c(name, "seq"), names={name}, probs=probs))


def _is_equality(v: KCIndexCondition) -> bool:
    from ..functions import conditions

    return v.relation_op is conditions._OPS["="] or getattr(v.relation_op, "__name__", "") == "eq"


__all__ = ["Compiler", "Options", "Rel", "Slot", "bound_names", "distinct_events"]
