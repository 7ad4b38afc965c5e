"""Patterns: an operator tree over typed events, a condition, a time window, and optional policies."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from datetime import timedelta

from ..functions.conditions import AndCondition, Condition, TrueCondition


@dataclass(frozen=True)
class Event:
    """One event of a type, under a name."""

    type: str
    name: str


@dataclass(frozen=True)
class Operator:
    args: tuple

    def __init__(self, *args) -> None:
        object.__setattr__(self, "args", tuple(args))


class Seq(Operator):
    """All arguments, in the order of time; equal times are in order."""


class And(Operator):
    """All arguments, in any order."""


class Or(Operator):
    """Any one argument. Evaluated through rewriting into several patterns."""


@dataclass(frozen=True)
class Not:
    """No match of the argument at its place in a Seq, or anywhere in the window in an And."""

    arg: object


@dataclass(frozen=True)
class Kleene:
    """min_size to max_size (None: any number of) matches of the argument. The list of a
    composite argument's closure is called kc_ and the names of its events."""

    arg: object
    min_size: int = 1
    max_size: int | None = None
    name: str | None = None

    def __post_init__(self) -> None:
        if self.min_size < 1 or (self.max_size is not None and self.max_size < self.min_size):
            raise ValueError("a closure has at least one element, and max_size is not below min_size")

    @property
    def list_name(self) -> str:
        if self.name:
            return self.name
        return self.arg.name if isinstance(self.arg, Event) else "kc_" + "_".join(sorted(names_of(self.arg)))


def children(node) -> tuple:
    if isinstance(node, Operator):
        return node.args
    return (node.arg,) if isinstance(node, (Not, Kleene)) else ()


def events_of(node) -> list[Event]:
    return [node] if isinstance(node, Event) else [e for c in children(node) for e in events_of(c)]


def names_of(node) -> list[str]:
    return [e.name for e in events_of(node)]


def bound_names(node) -> set[str]:
    """Names that a condition may use once this node is matched: events outside closures, and the closures' lists."""
    if isinstance(node, Event):
        return {node.name}
    if isinstance(node, Kleene):
        return {node.list_name}
    return set().union(*(bound_names(c) for c in children(node))) if children(node) else set()


def structure_key(node) -> tuple:
    """Identity of a structure; the order of And's and Or's arguments does not count."""
    if isinstance(node, Event):
        return ("event", node.type, node.name)
    parts = tuple(structure_key(c) for c in children(node))
    if isinstance(node, (And, Or)):
        parts = tuple(sorted(parts, key=repr))
    own = (node.min_size, node.max_size, node.list_name) if isinstance(node, Kleene) else ()
    return (type(node).__name__.lower(), *own, *parts)


def project_structure(node, names: set[str]):
    """The structure over those events only, or None."""
    if isinstance(node, Event):
        return node if node.name in names else None
    if isinstance(node, (Not, Kleene)):
        inner = project_structure(node.arg, names)
        return None if inner is None else replace(node, arg=inner)
    kept = [k for k in (project_structure(c, names) for c in node.args) if k is not None]
    if not kept:
        return None
    return kept[0] if len(kept) == 1 and not isinstance(kept[0], Not) else type(node)(*kept)


def flat_sequences(node) -> list[list[str]]:
    """The names of each sequence whose arguments are events (also inside Not and Kleene), for freezing."""
    if isinstance(node, (Not, Kleene)):
        return flat_sequences(node.arg)
    if isinstance(node, Event):
        return []
    own = []
    if isinstance(node, Seq):
        plain = [c.arg if isinstance(c, (Not, Kleene)) and isinstance(c.arg, Event) else c for c in node.args]
        own = [[c.name for c in plain if isinstance(c, Event)]]
    return [x for x in own if x] + [x for c in node.args if not isinstance(c, Event) for x in flat_sequences(c)]


ANY, SINGLE, NEXT = "any", "single", "next"


@dataclass(frozen=True)
class Policy:
    """Consumption. primary: the strategy of all types; single: types whose events take part in one match, under strategy secondary.

    contiguous: names that have to follow each other in the stream, one list or several. freeze: names of events that
    stop earlier events of their sequence from starting while they are unmatched and not expired.
    """

    primary: str = ANY
    single: tuple[str, ...] = ()
    secondary: str = SINGLE
    contiguous: tuple = ()
    freeze: tuple[str, ...] = ()

    def __init__(self, primary: str = ANY, single: Iterable[str] | str = (), secondary: str = SINGLE, contiguous: Iterable = (), freeze: Iterable[str] | str = ()) -> None:
        tup = lambda x: (x,) if isinstance(x, str) else tuple(x)
        lists = tup(contiguous)
        lists = (lists,) if lists and isinstance(lists[0], str) else tuple(tuple(x) for x in lists)
        for name, value in (("primary", primary), ("single", tup(single)), ("secondary", secondary), ("contiguous", lists), ("freeze", tup(freeze))):
            object.__setattr__(self, name, value)
        if primary not in (ANY, SINGLE, NEXT) or secondary not in (SINGLE, NEXT):
            raise ValueError("a strategy is any, single or next")


@dataclass(frozen=True)
class Pattern:
    structure: object
    condition: Condition = field(default_factory=TrueCondition)
    window: timedelta = timedelta.max
    policy: Policy = field(default_factory=Policy)
    confidence: float | None = None
    id: int | None = None

    def __post_init__(self) -> None:
        if self.confidence is not None and not 0 <= self.confidence <= 1:
            raise ValueError("a confidence lies between 0 and 1")
        names = names_of(self.structure)
        if len(set(names)) != len(names):
            raise ValueError("every event of a pattern has its own name")
        known = set(names) | bound_names(self.structure)
        if extra := self.condition.names() - known:
            raise ValueError(f"the condition speaks of unknown events: {sorted(extra)}")

    @property
    def window_us(self) -> int:
        return 2**62 if self.window == timedelta.max else self.window // timedelta(microseconds=1)

    def sub_pattern(self, names: set[str]) -> Pattern | None:
        s = project_structure(self.structure, names)
        return None if s is None else replace(self, structure=s, condition=AndCondition(*[c for c in self.condition.conjuncts() if c.names() <= names]))

    def is_sub_pattern(self, other: Pattern) -> bool:
        """Whether other, over this pattern's events, is this pattern."""
        sub = other.sub_pattern(set(names_of(self.structure)))
        return sub is not None and structure_key(sub.structure) == structure_key(self.structure) and {c.key() for c in sub.condition.conjuncts()} == {c.key() for c in self.condition.conjuncts()}
