"""Least fixpoints by semi-naive evaluation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import counted, drop, written

State = dict[str, DataFrame]
#: A rule body: reads the relations it names from a state and gives new rows of its head.
Body = Callable[[State], DataFrame]

#: Rounds allowed before a recursion counts as endless.
MAX_ROUNDS = 65_535


#: While a round's new rows are at most so many, a round takes several steps before it is compared with the known rows.
FEW_ROWS = 100_000
STEPS = 4


class Reads(dict):
    """A state that a body reads for its ``at``-th use of a recursive relation: that use gives the new rows, others all rows."""

    def __init__(self, state: State, fresh: State, names: set[str], at: int) -> None:
        super().__init__(state)
        self.fresh, self.names, self.at = fresh, names, at
        self.uses: list[str] = []

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            return super().__getitem__(name)
        self.uses.append(name)
        return self.fresh[name] if len(self.uses) == self.at else super().__getitem__(name)


def missing(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows that are not known."""
    held = known.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(rows.columns)])
    return rows.join(held, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(rows.columns)], "left_anti")


def _step(rules: list[tuple[str, list[str], Body]], state: State, fresh: State, columns: dict[str, list[str]]) -> dict[str, list[DataFrame]]:
    """What the rules give for each use of a recursive relation that has new rows."""
    found: dict[str, list[DataFrame]] = {}
    for head, reads, body in rules:
        probe = Reads(state, fresh, set(reads), 0)
        body(probe)
        for at, name in enumerate(probe.uses, 1):
            if name in fresh:
                found.setdefault(head, []).append(body(Reads(state, fresh, set(reads), at)).select(*columns[head]))
    return found


def fixpoint(bases: State, rules: list[tuple[str, list[str], Body]], context: State | None = None, max_rounds: int = MAX_ROUNDS) -> State:
    """The least relations that hold ``bases`` and are closed under ``rules``.

    rules: (head, recursive relations that the body reads, body). A body asks the state for each use of a relation. In each
    round it is evaluated once for each use of a recursive relation, with the last round's new rows in that place, so that
    only changes circulate. While they are few, a round takes ``STEPS`` steps: rows that the first ones give are new rows
    of the next, and the round's rows are compared with the known ones once. New rows are written to the shared folder,
    which cuts the lineage every round; known rows are the union of those tables.
    """
    first = {name: base.distinct() for name, base in bases.items()}
    return closure({name: [] for name in bases}, first, rules, context or {}, max_rounds)[0]


def closure(known: dict[str, list[DataFrame]], first: State, rules: list[tuple[str, list[str], Body]], context: State, max_rounds: int = MAX_ROUNDS) -> tuple[State, State]:
    """Known relations that are closed under rules, extended by the rows of ``first`` (distinct, none of them known) and all that
    follows. Returns the relations and the rows that are new (only of relations that have any)."""
    columns = {name: rows.columns for name, rows in first.items()}
    old = {name: list(parts) for name, parts in known.items()}
    new: dict[str, list[DataFrame]] = {name: [] for name in first}
    deltas, rows_in = {}, {}
    for name, rows in first.items():
        deltas[name], rows_in[name] = counted(rows)
        new[name].append(deltas[name])
    for _ in range(max_rounds):
        state = context | {name: reduce(DataFrame.unionByName, [*old[name], *new[name]]) for name in first}
        fresh = {name: d for name, d in deltas.items() if rows_in[name]}
        if not fresh:
            gained = {name: reduce(DataFrame.unionByName, parts) for name, parts in new.items()}
            return {name: state[name] for name in first}, gained
        made: dict[str, list[DataFrame]] = {}
        for _ in range(STEPS if sum(rows_in.values()) <= FEW_ROWS else 1):
            found = {head: reduce(DataFrame.unionByName, parts).distinct() for head, parts in _step(rules, state, fresh, columns).items()}
            for head, rows in found.items():
                made.setdefault(head, []).append(rows)
            fresh = found
        deltas, rows_in = {}, dict.fromkeys(first, 0)
        for head, parts in made.items():
            deltas[head], rows_in[head] = counted(missing(reduce(DataFrame.unionByName, parts).distinct(), state[head]))
            if not rows_in[head]:
                drop(deltas[head])
                continue
            new[head].append(deltas[head])
            if len(new[head]) >= 20:  # many small tables are slow to read
                whole = written(reduce(DataFrame.unionByName, new[head]))
                for part in new[head][:-1]:
                    drop(part)
                new[head] = [whole]
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def reachable(edges: DataFrame, start: str = "src", end: str = "dst") -> DataFrame:
    """Transitive closure of an edge relation."""
    step = edges.select(F.col(start).alias("__a"), F.col(end).alias("__b"))

    def body(state: State) -> DataFrame:
        return state["path"].join(step, F.col(end) == F.col("__a")).select(start, F.col("__b").alias(end))

    return fixpoint({"path": edges.select(start, end)}, [("path", ["path"], body)])["path"]
