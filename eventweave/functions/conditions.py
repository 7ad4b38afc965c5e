"""Conditions over the events of a match, as column expressions.

A term is a constant or Var(name, attribute). The attribute is a column name or a function from an event to a Column;
an event gives its attributes by item or by name. A comparison with a NULL or a missing attribute is no match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class EventRef:
    """One event of a match: its attributes as columns. prefix is None for the element of a list."""

    def __init__(self, name: str, element: Column | None = None) -> None:
        self._name, self._element = name, element

    def __getitem__(self, attribute: str) -> Column:
        if self._element is not None:
            return self._element[attribute]
        return F.col(f"`{self._name}__{attribute}`")

    def __getattr__(self, attribute: str) -> Column:
        if attribute.startswith("_"):
            raise AttributeError(attribute)
        return self[attribute]


class Var:
    def __init__(self, name: str, attribute: str | Callable[[EventRef], Any]) -> None:
        self.name, self.attribute = name, attribute

    def column(self, element: Column | None = None) -> Any:
        ref = EventRef(self.name, element)
        return ref[self.attribute] if isinstance(self.attribute, str) else self.attribute(ref)

    def key(self) -> tuple:
        return ("var", self.name, self.attribute)


class Condition:
    """A boolean tree. names() are the events it speaks of, conjuncts() its parts that must all hold."""

    def names(self) -> set[str]:
        raise NotImplementedError

    def column(self) -> Column:
        raise NotImplementedError

    def conjuncts(self) -> list[Condition]:
        return [self]

    def key(self) -> tuple:
        """Structural identity: equal keys mean equal conditions (a < b and b > a have one key)."""
        raise NotImplementedError

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Condition) and self.key() == other.key()

    def __hash__(self) -> int:
        return hash(self.key())


class TrueCondition(Condition):
    def names(self) -> set[str]:
        return set()

    def column(self) -> Column:
        return F.lit(True)

    def conjuncts(self) -> list[Condition]:
        return []

    def key(self) -> tuple:
        return ("true",)


def _apply(op: Callable, values: list[Any]) -> Column:
    """op over columns, or where its Python logic needs plain values (and, chained comparison, int()), a vectorised UDF."""
    try:
        out = op(*values)
        if isinstance(out, Column):
            return out
        if isinstance(out, bool) and not any(isinstance(v, Column) for v in values):
            return F.lit(out)
    except (PySparkException, TypeError, ValueError):
        pass
    import pandas as pd

    def rows(*series):
        out = []
        for row in zip(*series, strict=True):
            out.append(None if any(pd.isna(x) for x in row) else bool(op(*row)))
        return pd.Series(out, dtype="boolean")

    return F.pandas_udf(rows, T.BooleanType(), functionType=F.PandasUDFType.SCALAR)(*[v if isinstance(v, Column) else F.lit(v) for v in values])


class SimpleCondition(Condition):
    """relation_op over any number of terms."""

    def __init__(self, *terms: Any, relation_op: Callable[..., Any]) -> None:
        self.terms, self.relation_op = terms, relation_op

    def names(self) -> set[str]:
        return {t.name for t in self.terms if isinstance(t, Var)}

    def column(self) -> Column:
        return _apply(self.relation_op, [t.column() if isinstance(t, Var) else t for t in self.terms])

    def key(self) -> tuple:
        return ("simple", self.relation_op, *(t.key() if isinstance(t, Var) else ("lit", t) for t in self.terms))


class BinaryCondition(SimpleCondition):
    def __init__(self, left: Any, right: Any, relation_op: Callable[[Any, Any], Any]) -> None:
        super().__init__(left, right, relation_op=relation_op)


class _Relation(BinaryCondition):
    symbol, mirror = "", ""

    def __init__(self, left: Any, right: Any) -> None:
        super().__init__(left, right, _OPS[self.symbol])

    def key(self) -> tuple:
        a, b = (t.key() if isinstance(t, Var) else ("lit", t) for t in self.terms)
        return min((self.symbol, a, b), (self.mirror, b, a), key=repr)


_OPS = {
    "=": lambda x, y: x == y,
    "!=": lambda x, y: x != y,
    "<": lambda x, y: x < y,
    ">": lambda x, y: x > y,
    "<=": lambda x, y: x <= y,
    ">=": lambda x, y: x >= y,
}


class EqCondition(_Relation):
    symbol = mirror = "="


class NotEqCondition(_Relation):
    symbol = mirror = "!="


class GreaterThanCondition(_Relation):
    symbol, mirror = ">", "<"


class SmallerThanCondition(_Relation):
    symbol, mirror = "<", ">"


class GreaterThanEqCondition(_Relation):
    symbol, mirror = ">=", "<="


class SmallerThanEqCondition(_Relation):
    symbol, mirror = "<=", ">="


class _Composite(Condition):
    word = ""

    def __init__(self, *conditions: Condition) -> None:
        self.conditions = list(conditions)

    def names(self) -> set[str]:
        return set().union(*(c.names() for c in self.conditions))

    def key(self) -> tuple:
        return (self.word, *sorted((c.key() for c in self.conditions), key=repr))


class AndCondition(_Composite):
    """All of the conditions; of none, true."""

    word = "and"

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def conjuncts(self) -> list[Condition]:
        return [x for c in self.conditions for x in c.conjuncts()]


class OrCondition(_Composite):
    """Any of the conditions, evaluated where all its events are bound; of none, true."""

    word = "or"

    def column(self) -> Column:
        if not self.conditions:
            return F.lit(True)
        out = F.lit(False)
        for c in self.conditions:
            out = out | F.coalesce(c.column(), F.lit(False))
        return out


class KCCondition(Condition):
    """A condition on the elements of the Kleene closure over exactly these events."""

    def __init__(self, names: Iterable[str] | str, attribute: str | Callable[[EventRef], Any], relation_op: Callable[[Any, Any], Any]) -> None:
        own = [names] if isinstance(names, str) else sorted(set(names))
        if not own:
            raise ValueError("a Kleene condition names the events of a closure")
        self.name = own[0] if len(own) == 1 else "kc_" + "_".join(own)
        self.attribute, self.relation_op = attribute, relation_op

    def names(self) -> set[str]:
        return {self.name}

    def get(self, element: Column) -> Any:
        return Var(self.name, self.attribute).column(element)

    def list(self) -> Column:
        return F.col(f"`{self.name}`")


class KCIndexCondition(KCCondition):
    """Compare elements with each other: two indexes (an index out of bounds is no match), or each element with the one at an offset.

    With an offset of the list's length or more there is no match; a negative offset compares with elements before, and
    holds for a list of one element.
    """

    def __init__(self, names, attribute, relation_op, first_index: int | None = None, second_index: int | None = None, offset: int | None = None) -> None:
        super().__init__(names, attribute, relation_op)
        by_index = first_index is not None and second_index is not None
        if by_index == (offset is not None) or (first_index is None) != (second_index is None):
            raise ValueError("give either both indexes or an offset")
        if by_index and (first_index < 0 or second_index < 0):
            raise ValueError("indexes begin at 0")
        self.first_index, self.second_index, self.offset = first_index, second_index, offset

    def column(self) -> Column:
        a = self.list()
        if self.offset is None:
            i, j = self.first_index, self.second_index
            op = _apply(self.relation_op, [self.get(F.get(a, i)), self.get(F.get(a, j))])
            return F.when(F.size(a) > max(i, j), op).otherwise(False)
        k = self.offset
        low, high = max(0, -k), F.size(a) - 1 - max(0, k)
        places = F.when(high >= low, F.sequence(F.lit(low), high)).otherwise(F.array().cast("array<int>"))
        holds = F.forall(places, lambda i: _apply(self.relation_op, [self.get(F.get(a, i)), self.get(F.get(a, i + k))]))
        return holds if k < 0 else F.when(F.size(a) > k, holds).otherwise(False)

    def key(self) -> tuple:
        return ("kc-index", self.name, self.attribute, self.relation_op, self.first_index, self.second_index, self.offset)


class KCValueCondition(KCCondition):
    """Compare all elements, or the one at an index, with a value."""

    def __init__(self, names, attribute, relation_op, value: Any, index: int | None = None) -> None:
        super().__init__(names, attribute, relation_op)
        self.value, self.index = value, index

    def element(self, element: Column) -> Column:
        return _apply(self.relation_op, [self.get(element), F.lit(self.value)])

    def column(self) -> Column:
        a = self.list()
        if self.index is None:
            return F.forall(a, self.element)
        return F.when(F.size(a) > self.index, self.element(F.get(a, self.index))).otherwise(False)

    def key(self) -> tuple:
        return ("kc-value", self.name, self.attribute, self.relation_op, self.value, self.index)


class KCCrossCondition(Condition):
    """relation_op(element's attribute, other term) for all (or any) elements of a closure; the other term may be an event or a constant."""

    def __init__(self, name: str, attribute: str | Callable[[EventRef], Any], relation_op: Callable[[Any, Any], Any], other: Any, any_element: bool = False) -> None:
        self.name, self.attribute, self.relation_op, self.other, self.any_element = name, attribute, relation_op, other, any_element

    def names(self) -> set[str]:
        return {self.name} | ({self.other.name} if isinstance(self.other, Var) else set())

    def column(self) -> Column:
        other = self.other.column() if isinstance(self.other, Var) else F.lit(self.other)
        one = lambda e: _apply(self.relation_op, [Var(self.name, self.attribute).column(e), other])
        return (F.exists if self.any_element else F.forall)(F.col(f"`{self.name}`"), one)

    def join_key(self) -> Column | None:
        """What follows from an equality of all elements with another event: that of the first one, by which a join can meet."""
        if self.any_element or not isinstance(self.other, Var) or not (self.relation_op is _OPS["="] or getattr(self.relation_op, "__name__", "") == "eq"):
            return None
        return Var(self.name, self.attribute).column(F.get(F.col(f"`{self.name}`"), F.lit(0))) == self.other.column()

    def key(self) -> tuple:
        other = self.other.key() if isinstance(self.other, Var) else ("lit", self.other)
        return ("kc-cross", self.name, self.attribute, self.relation_op, other, self.any_element)


def project(condition: Condition, names: set[str]) -> Condition:
    """The conjuncts that speak of those events only."""
    return AndCondition(*[c for c in condition.conjuncts() if c.names() <= names])


def intersection(a: Condition, b: Condition) -> list[Condition]:
    """Conjuncts that both have."""
    keys = {c.key() for c in b.conjuncts()}
    return [c for c in a.conjuncts() if c.key() in keys]
