"""The engine: patterns in, a DataFrame of matches out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.match import Compiler, Options, Rel, c
from .operators.policies import apply_single, freeze_matches
from .operators.storage import cut
from .plans.pattern import SINGLE, NEXT, ANY, And, Event, Kleene, Not, Pattern, Policy, Seq, events_of, flat_sequences
from .plans.planner import PLANNERS, Statistics
from .plans.rewrite import ALL, rewrite
from .plans.sharing import parts_to_share, share_key
from .functions.conditions import AndCondition, SimpleCondition, Var


def standard_events(df: DataFrame, seq: str = "seq", event_type: str = "event_type", ts: str = "ts", prob: str | None = None) -> DataFrame:
    """The engine's event schema: seq (place in the whole stream), event_type, us (microseconds), the other columns as attributes."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    out = df.withColumn("us", us).withColumn("seq", F.col(seq).cast("long")).withColumn("event_type", F.col(event_type))
    if prob:
        out = out.withColumn("prob", F.col(prob).cast("double"))
    return out


def contiguity(pattern: Pattern, compat: bool) -> list[SimpleCondition]:
    out = []
    for k, names in enumerate(pattern.policy.contiguous):
        pairs = list(zip(names, names[1:], strict=False))
        if compat and len(pattern.policy.contiguous) > 1:  # the first pair of the first list again and again
            pairs = list(zip(pattern.policy.contiguous[0], pattern.policy.contiguous[0][1:], strict=False))[:1] if k else pairs[:1]
        for a, b in pairs:
            out.append(SimpleCondition(Var(a, "seq"), Var(b, "seq"), relation_op=lambda x, y: x == y - 1))
    return out


def normalised_policy(pattern: Pattern) -> Policy:
    """A primary strategy other than any means that strategy for all types."""
    p = pattern.policy
    if p.primary != ANY:
        types = tuple(dict.fromkeys(e.type for e in events_of(pattern.structure)))
        return Policy(single=types, secondary=p.primary, contiguous=p.contiguous, freeze=p.freeze)
    return p


class Engine:
    """Evaluates one or several patterns over a DataFrame of events (see standard_events).

    planner orders the joins of each operator from statistics (event type -> rate); without statistics arguments are
    joined in their own order. share: patterns that are equal but for window and confidence are evaluated once, with
    the widest window, and told apart afterwards. With subtrees, tabu or annealing, parts that several patterns have in
    common (see plans.sharing) are also evaluated once: run computes and writes them, and each pattern joins the rest to them.
    """

    def __init__(
        self, patterns: Pattern | Sequence[Pattern], options: Options | None = None, planner: str = "trivial", rates: dict[str, float] | None = None,
        selectivity: dict[tuple[str, str], float] | None = None, rules: Sequence[str] = ALL, share: bool | str = True,
    ) -> None:
        self.patterns = [patterns] if isinstance(patterns, Pattern) else list(patterns)
        if not self.patterns:
            raise ValueError("give a pattern")
        self.options, self.planner, self.rates, self.selectivity, self.rules, self.share = options or Options(), planner, rates, selectivity or {}, rules, share

    def _order(self, window_us: int):
        if not self.rates or self.planner == "trivial":
            return None

        def order(node, args):
            types, names = [], []
            for a in args:
                inner = events_of(a)
                types.append(inner[0].type)
                names.append(inner[0].name)
            rates = [min((self.rates.get(e.type, 1.0) for e in events_of(a)), default=1.0) for a in args]
            sel = [[self.selectivity.get((x, y), self.selectivity.get((y, x), 1.0)) for y in names] for x in names]
            s = Statistics(rates, sel, window_us / 1e6 if window_us < 2**62 else 1.0)
            for i, a in enumerate(args):
                if isinstance(a, Kleene):
                    s = s.kleene(i)
            return PLANNERS[self.planner](s)

        return order

    def compile(self, events: DataFrame, pattern: Pattern, parts: dict[frozenset, Rel] | None = None) -> Rel:
        policy = normalised_policy(pattern)
        if "prob" in events.columns and pattern.confidence is None:
            raise ValueError("a stream with probabilities needs patterns with a confidence")
        options = replace(self.options, order=self._order(pattern.window_us), rates=self.rates if self.planner != "trivial" else None)
        conditions = [*pattern.condition.conjuncts(), *contiguity(pattern, options.compat)]
        if options.compat:
            conditions += nested_orders(pattern.structure)
        types = sorted({e.type for e in events_of(pattern.structure)})
        own = events.where(F.col("event_type").isin(types))
        structure = pattern.structure
        if isinstance(structure, (Event, Kleene)):
            structure = Seq(structure)
        compiler = Compiler(own, pattern.window_us, conditions, options, policy, pattern.confidence, parts)
        rel = compiler.compile(structure)
        if left := [x for i, x in enumerate(compiler.conditions) if i not in compiler.used and x.names()]:
            raise ValueError(f"no operator binds all events of a condition on {[sorted(x.names()) for x in left]}")
        if policy.freeze:
            rel = freeze_matches(rel, own, structure, pattern, policy)
        if policy.single and policy.secondary == SINGLE:
            rel = apply_single(rel, policy.single)
        elif policy.single and policy.secondary == NEXT:
            rel = compiler.next_filter(rel) if len(rel.slots) == 1 else rel
        return rel

    def shared_parts(self, events: DataFrame, patterns: list[Pattern]) -> list[dict[frozenset, Rel]]:
        """For each pattern the parts that it shares with others, each made once with the widest window and the lowest confidence."""
        out: list[dict[frozenset, Rel]] = [{} for _ in patterns]
        if not isinstance(self.share, str) or self.options.compat:  # there the order of an And's events depends on what is around it
            return out
        for sub, users in parts_to_share(patterns, self.share):
            confidence = None if sub.confidence is None else min(patterns[i].confidence for i in users)
            rel = self.compile(events, replace(sub, window=max(patterns[i].window for i in users), confidence=confidence))
            rel.df = cut(rel.df)
            for i in users:
                out[i][frozenset(rel.names)] = rel
        return out

    def run_one(self, events: DataFrame, pattern: Pattern, parts: dict[frozenset, Rel] | None = None) -> DataFrame:
        """Matches of one pattern that needs no rewriting: slot columns, first_us, last_us, and prob where events have one."""
        rel = self.compile(events, pattern, parts)
        extra = [rel.first.alias("first_us"), rel.last.alias("last_us")]
        if rel.probs:
            p = rel.probs[0]
            for x in rel.probs[1:]:
                p = p * x
            extra.append(p.alias("match_prob"))
        names = [x for x in rel.df.columns if not x.startswith("_")]
        return rel.df.select(*[F.col(f"`{x}`") for x in names], *extra)

    def run(self, events: DataFrame) -> DataFrame:
        """Matches of all patterns. Several patterns have a pattern_id, 1 for the first; slots that a pattern lacks are null."""
        many = len(self.patterns) > 1
        parts, shared = [], {}
        if isinstance(self.share, str) and self.share not in ("subtrees", "tabu", "annealing"):
            raise ValueError("share is False, True, subtrees, tabu or annealing")
        for i, p in enumerate(self.patterns, 1):
            for q in rewrite(p, self.rules):
                key = share_key(q) if self.share and many else None
                if key is not None:
                    shared.setdefault(key, []).append((i, q))
                    continue
                df = self.run_one(events, q)
                parts.append(df.withColumn("pattern_id", F.lit(i)) if many else df)
        groups, widest = list(shared.values()), []
        for group in groups:
            confidences = [q.confidence for _, q in group]
            widest.append(replace(group[0][1], window=max(q.window for _, q in group), confidence=None if confidences[0] is None else min(confidences)))
        for group, wide, own in zip(groups, widest, self.shared_parts(events, widest), strict=True):
            df = self.run_one(events, wide, own)
            ids = F.array_compact(F.array(*[F.when(self._fits(df, q), F.lit(i)) for i, q in group])) if len(group) > 1 else F.array(F.lit(group[0][0]))
            parts.append(df.withColumn("pattern_id", F.explode(ids)))
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x, allowMissingColumns=True)
        return out

    @staticmethod
    def _fits(df: DataFrame, q: Pattern) -> Column:
        ok = F.col("last_us") - F.col("first_us") <= q.window_us
        return ok & (F.col("match_prob") >= q.confidence) if q.confidence is not None and "match_prob" in df.columns else ok

    def explain(self, events: DataFrame) -> None:
        self.run(events).explain("formatted")

    def summary(self) -> list[tuple]:
        """Each pattern's operator tree as nested tuples."""
        return [structure_summary(q.structure) for p in self.patterns for q in rewrite(p, self.rules)]


def nested_orders(node) -> list[SimpleCondition]:
    """In compat mode: the events of an And inside a Seq are in order too."""
    out = []
    if isinstance(node, Seq):
        for a in node.args:
            if isinstance(a, And):
                names = [e.name for x in a.args if not isinstance(x, Not) for e in events_of(x)]
                out += [SimpleCondition(Var(x, "us"), Var(y, "us"), relation_op=lambda p, q: p <= q) for x, y in zip(names, names[1:], strict=False)]
    for a in getattr(node, "args", ()):
        out += nested_orders(a)
    return out


def structure_summary(node):
    if isinstance(node, Event):
        return node.name
    if isinstance(node, Kleene):
        return ("KC", structure_summary(node.arg))
    if isinstance(node, Not):
        return ("Not", structure_summary(node.arg))
    return (type(node).__name__, *(structure_summary(a) for a in node.args))


def match_lines(df: DataFrame, names: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """One text per match, an event a line: what the text sinks write."""
    parts = []
    for n in names:
        one = lambda get: F.concat(*[x for a in attributes for x in (F.lit(f"{a}="), F.coalesce(get(a).cast("string"), F.lit("null")), F.lit(" "))])
        if f"{n}__us" in df.columns:
            parts.append(F.rtrim(one(lambda a, n=n: c(n, a))))
        else:
            parts.append(F.array_join(F.transform(c(n), lambda e: F.rtrim(one(lambda a: e[a]))), "\n"))
    text = F.concat_ws("\n", *parts)
    if "pattern_id" in df.columns:
        text = F.concat(F.col("pattern_id").cast("string"), F.lit(": "), text)
    return df.select(text.alias("value"))


__all__ = ["AndCondition", "Engine", "Pattern", "flat_sequences", "standard_events"]
