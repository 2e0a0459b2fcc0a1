"""Predicates: ``field("x") > 5``, combined by ``& | ~``, or tuples and lists of tuples."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from ..errors import SchemaError

OPERATORS = ("==", "<", "<=", ">", ">=", "in", "null", "valid")
MAX_TERMS = 1024


class Expression:
    """A predicate on rows. It has no truth value of its own: combine with ``& | ~``."""

    def __and__(self, other: Expression) -> Expression:
        return And((self, _expression(other)))

    def __or__(self, other: Expression) -> Expression:
        return Or((self, _expression(other)))

    def __invert__(self) -> Expression:
        return Not(self)

    def __bool__(self) -> bool:
        raise SchemaError("a predicate is neither true nor false; combine predicates with & | ~")


def _expression(x: Any) -> Expression:
    if not isinstance(x, Expression):
        raise SchemaError(f"{x!r} is not a predicate")
    return x


@dataclass(frozen=True, repr=False)
class Leaf(Expression):
    name: str
    op: str
    value: Any = None

    def __repr__(self) -> str:
        words = {"null": "is null", "valid": "is valid"}
        return f"{self.name} {words[self.op]}" if self.op in words else f"{self.name} {self.op} {list(self.value) if self.op == 'in' else self.value!r}"


@dataclass(frozen=True, repr=False)
class And(Expression):
    parts: tuple[Expression, ...]

    def __repr__(self) -> str:
        return "(" + " & ".join(map(repr, self.parts)) + ")"


@dataclass(frozen=True, repr=False)
class Or(Expression):
    parts: tuple[Expression, ...]

    def __repr__(self) -> str:
        return "(" + " | ".join(map(repr, self.parts)) + ")"


@dataclass(frozen=True, repr=False)
class Not(Expression):
    part: Expression

    def __repr__(self) -> str:
        return f"~{self.part!r}"


class Field:
    """A column by name, not looked up before the predicate meets a table."""

    __hash__ = None  # type: ignore[assignment]

    def __init__(self, name: str):
        self.name = name

    def __repr__(self) -> str:
        return f"field({self.name!r})"

    def __eq__(self, value: Any) -> Expression:  # type: ignore[override]
        return Leaf(self.name, "==", value)

    def __ne__(self, value: Any) -> Expression:  # type: ignore[override]
        return Not(Leaf(self.name, "==", value))

    def __lt__(self, value: Any) -> Expression:
        return Leaf(self.name, "<", value)

    def __le__(self, value: Any) -> Expression:
        return Leaf(self.name, "<=", value)

    def __gt__(self, value: Any) -> Expression:
        return Leaf(self.name, ">", value)

    def __ge__(self, value: Any) -> Expression:
        return Leaf(self.name, ">=", value)

    def isin(self, values: Iterable[Any]) -> Expression:
        return Leaf(self.name, "in", _collection(values))

    def is_null(self) -> Expression:
        return Leaf(self.name, "null")

    def is_valid(self) -> Expression:
        return Leaf(self.name, "valid")

    def __bool__(self) -> bool:
        raise SchemaError("a column is neither true nor false; compare it with a value")


def field(name: str) -> Field:
    return Field(name)


def _collection(values: Any) -> tuple[Any, ...]:
    if isinstance(values, str | bytes | dict) or not isinstance(values, Iterable):
        raise SchemaError(f"membership needs a collection of values, not {values!r}")
    return tuple(values)


def _from_tuple(t: Any) -> Expression:
    if isinstance(t, Expression):
        return t
    if not isinstance(t, tuple) or len(t) != 3 or not isinstance(t[0], str):
        raise SchemaError(f"a filter is (column, operator, value), not {t!r}")
    name, op, value = t
    if op in ("=", "=="):
        return Leaf(name, "==", value)
    if op == "!=":
        return Not(Leaf(name, "==", value))
    if op in ("<", "<=", ">", ">="):
        return Leaf(name, op, value)
    if op in ("in", "not in"):
        leaf = Leaf(name, "in", _collection(value))
        return Not(leaf) if op == "not in" else leaf
    raise SchemaError(f"no operator {op!r}")


def normalised(where: Any) -> Expression | None:
    """One expression of what ``where=`` takes: an expression, a tuple, a list of tuples (all must hold), or
    a list of such lists (one must hold). None or an empty list is every row."""
    if where is None or isinstance(where, list) and not where:
        return None
    if isinstance(where, Expression):
        return where
    if isinstance(where, tuple):
        return _from_tuple(where)
    if not isinstance(where, list):
        raise SchemaError(f"{where!r} is not a predicate; compare a field with a value")
    if all(isinstance(x, list) for x in where):
        if not all(where):
            raise SchemaError("an alternative has no filters")
        terms = [And(tuple(map(_from_tuple, x))) if len(x) > 1 else _from_tuple(x[0]) for x in where]
        return Or(tuple(terms)) if len(terms) > 1 else terms[0]
    if any(isinstance(x, list) for x in where):
        raise SchemaError("filters and lists of filters do not mix")
    parts = tuple(map(_from_tuple, where))
    return And(parts) if len(parts) > 1 else parts[0]


def leaves(e: Expression, negated: bool = False) -> Iterator[tuple[Leaf, bool]]:
    if isinstance(e, Leaf):
        yield e, negated
    elif isinstance(e, Not):
        yield from leaves(e.part, not negated)
    else:
        for x in e.parts:
            yield from leaves(x, negated)


def terms(e: Expression, negated: bool = False) -> int:
    """How many conjunctions the disjunctive form of a predicate has, which is never built. An expansion to
    more than MAX_TERMS is refused; alternatives that stand side by side already are not one."""
    if isinstance(e, Leaf):
        return 1
    if isinstance(e, Not):
        return terms(e.part, not negated)
    counts = [terms(x, negated) for x in e.parts]
    if isinstance(e, Or) != negated:
        return sum(counts)
    total = 1
    for n in counts:
        total *= n
        if total > MAX_TERMS:
            raise SchemaError(f"the predicate expands to more than {MAX_TERMS} terms")
    return total
