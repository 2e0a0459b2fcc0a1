"""How a query will be answered, in words."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class LeafPlan:
    predicate: str
    negated: bool
    access: str  # CHUNK_MINMAX, SORTED_ROWS, BITMAP, scan, or that there is no such label
    index: str | None = None

    def __str__(self) -> str:
        return f"{'not ' * self.negated}{self.predicate}: {self.access}" + (f" ({self.index})" if self.index else "")


@dataclass(frozen=True)
class QueryPlan:
    """One leaf plan for each comparison; terms: conjunctions of the disjunctive form; candidates: rows that
    indexes leave to be read, if any was used."""

    leaves: tuple[LeafPlan, ...] = ()
    terms: int = 0
    rows: int | None = None
    candidates: int | None = None
    spark: str = field(default="", repr=False)

    def __str__(self) -> str:
        lines = [f"{self.rows if self.rows is not None else '?'} rows match, by {self.terms} terms"]
        if self.candidates is not None:
            lines.append(f"indexes leave {self.candidates} rows to be read")
        return "\n".join([*lines, *(f"  {x}" for x in self.leaves)])
