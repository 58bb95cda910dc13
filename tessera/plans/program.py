"""Relations, rules, and their evaluation in topological order."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators import union
from ..storage import counted, drop, written
from .fixpoint import Reads, State, closure, fixpoint, missing

SET, MULTISET, STREAM = "set", "multiset", "stream"
INPUT, OUTPUT, INTERNAL = "input", "output", "internal"


_DELAYED = re.compile(r"(.+)-([1-9][0-9]*)")


def delayed_name(name: str) -> tuple[str, int] | None:
    """``R-2`` is relation R as it was two epochs ago; rules may read it, and it is no part of a recursion."""
    found = _DELAYED.fullmatch(name)
    return (found[1], int(found[2])) if found else None


@dataclass(frozen=True)
class Relation:
    """key: columns (paths allowed) that identify a row of an input relation. distinct: whether equal rows count once."""

    name: str
    schema: T.StructType
    kind: str = INTERNAL
    key: tuple[str, ...] = ()
    caching: str = SET
    distinct: bool = True


@dataclass(frozen=True)
class Rule:
    """head :- body(reads). ``negated`` are the relations that the body reads through an antijoin or an aggregate. ``unique``:
    the body gives no row twice, whatever it reads."""

    head: str
    reads: tuple[str, ...]
    body: Callable[[State], DataFrame]
    negated: tuple[str, ...] = ()
    unique: bool = False


@dataclass(frozen=True)
class Index:
    """Look-up of rows of a relation by key columns."""

    name: str
    relation: str
    key: tuple[str, ...]


@dataclass(frozen=True)
class Transformer:
    """Any function from relations to relations; not inside a recursion, since it may not be monotone."""

    reads: tuple[str, ...]
    heads: tuple[str, ...]
    function: Callable[[State], State]


@dataclass
class Program:
    relations: dict[str, Relation] = field(default_factory=dict)
    rules: list[Rule] = field(default_factory=list)
    facts: dict[str, list[tuple]] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)
    transformers: list[Transformer] = field(default_factory=list)

    def relation(self, name: str, schema: T.StructType, **options) -> Relation:
        if name in self.relations:
            raise ValueError(f"relation {name} is declared twice")
        self.relations[name] = Relation(name, schema, **options)
        return self.relations[name]

    def rule(self, head: str, reads: list[str], body: Callable[[State], DataFrame], negated: list[str] = (), unique: bool = False) -> None:
        if self.relations[head].kind == INPUT:
            raise ValueError(f"input relation {head} can't have rules")
        self.rules.append(Rule(head, tuple(reads), body, tuple(negated), unique))

    def index(self, name: str, relation: str, *key: str) -> None:
        self.indexes[name] = Index(name, relation, key)

    def order(self) -> list[list[str]]:
        """Groups of mutually recursive relations, each after what it reads (Tarjan's algorithm, without recursion)."""
        reads: dict[str, set[str]] = {name: set() for name in self.relations}
        for r in self.rules:
            reads[r.head] |= {n for n in r.reads + r.negated if not delayed_name(n)}
        for t in self.transformers:
            for head in t.heads:
                reads[head] |= set(t.reads)
        number: dict[str, int] = {}
        low: dict[str, int] = {}
        held: list[str] = []
        groups: list[list[str]] = []
        for root in sorted(reads):
            if root in number:
                continue
            work = [(root, iter(sorted(reads[root])))]
            number[root] = low[root] = len(number)
            held.append(root)
            while work:
                name, rest = work[-1]
                for other in rest:
                    if other not in number:
                        number[other] = low[other] = len(number)
                        held.append(other)
                        work.append((other, iter(sorted(reads[other]))))
                        break
                    if other in held:
                        low[name] = min(low[name], number[other])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[name])
                    if low[name] == number[name]:
                        at = held.index(name)
                        groups.append(sorted(held[at:]))
                        del held[at:]
        return groups

    def recursive(self, group: list[str]) -> bool:
        return len(group) > 1 or any(r.head == group[0] and group[0] in r.reads + r.negated for r in self.rules)

    def check(self) -> None:
        for group in self.order():
            if not self.recursive(group):
                continue
            for name in group:
                if self.relations[name].kind == INPUT:
                    raise ValueError(f"input relation ({name}) in Scc")
            for r in self.rules:
                if r.head in group and set(r.negated) & set(group):
                    raise ValueError(f"relation {r.head} depends on its own negation")
            if any(set(t.heads) & set(group) for t in self.transformers):
                raise ValueError(f"transformer inside the recursion of {', '.join(group)}")

    def needed(self, outputs: Iterable[str]) -> set[str]:
        """The relations that some relations are made of, themselves included."""
        found, open_ = set(), list(outputs)
        while open_:
            name = open_.pop()
            if name in found or name not in self.relations:
                continue
            found.add(name)
            open_ += [n for r in self.rules if r.head == name for n in r.reads + r.negated]
            open_ += [n for t in self.transformers if name in t.heads for n in t.reads]
        return found

    def evaluate(self, spark: SparkSession, inputs: State, past: State | None = None, only: Iterable[str] | None = None) -> State:
        """All relations (or those that ``only`` needs) from the input relations, and from those of earlier epochs by their
        delayed names. Recursive groups run at once, the rest stays lazy."""
        self.check()
        past = past or {}
        state = dict(inputs) | past
        wanted = set(self.relations) if only is None else self.needed(only)
        for group in self.order():
            if not wanted & set(group):
                continue
            if self.recursive(group):
                state |= self._solve(spark, group, state)
                continue
            name = group[0]
            if name in state and name in inputs:
                state[name] = self._with_facts(spark, name, state[name])
                continue
            made = [t.function({k: state[k] for k in t.reads})[name] for t in self.transformers if name in t.heads]
            parts = [r.body(state).select(*self.relations[name].schema.names) for r in self.rules if r.head == name] + made
            rows = union(*parts) if parts else spark.createDataFrame([], self.relations[name].schema)
            rows = self._with_facts(spark, name, rows)
            alone = len(parts) == 1 and name not in self.facts and all(r.unique for r in self.rules if r.head == name) and not made
            state[name] = rows.distinct() if self.relations[name].distinct and not alone else rows
        return {name: df for name, df in state.items() if name not in past}

    def advance(self, state: State, added: State) -> tuple[State, State] | None:
        """All relations after rows were added to input relations, and the rows that each relation gained, found from these
        alone: every rule is evaluated once for each use of a relation that gained rows, with those rows in its place.

        None if the new rows reach a negation, an aggregate or a transformer, which may take rows back, or are used twice by
        a relation that keeps repeated rows.
        """
        gained = {name: missing(rows, state[name]) if name in self.facts else rows for name, rows in added.items()}
        now = state | {name: state[name].unionByName(rows) for name, rows in gained.items()}
        for group in self.order():
            rules = [r for r in self.rules if r.head in group]
            if any(set(r.negated) & set(gained) for r in rules) or any(set(t.heads) & set(group) and set(t.reads) & set(gained) for t in self.transformers):
                return None
            found: dict[str, list[DataFrame]] = {}
            for r in rules:
                changed = set(r.reads) & set(gained)
                probe = Reads(now, gained, changed, 0)
                if changed:
                    r.body(probe)
                if len(probe.uses) > 1 and not self.relations[r.head].distinct:
                    return None
                for at in range(1, len(probe.uses) + 1):
                    found.setdefault(r.head, []).append(r.body(Reads(now, gained, changed, at)).select(*self.relations[r.head].schema.names))
            if not found:
                continue
            if self.recursive(group):
                first = {n: missing(union(*found[n]).distinct(), state[n]) if n in found else state[n].limit(0) for n in group}
                steps = [(r.head, [x for x in r.reads if x in group], r.body) for r in rules if set(r.reads) & set(group)]
                made, new = closure({n: [state[n]] for n in group}, first, steps, {k: v for k, v in now.items() if k not in group})
                now |= made
                gained |= new
                continue
            name = group[0]
            rows = union(*found[name])
            rows, n = counted(missing(rows.distinct(), state[name]) if self.relations[name].distinct else rows)
            if n:
                now[name], gained[name] = state[name].unionByName(rows), rows
            else:
                drop(rows)
        return now, gained

    def _with_facts(self, spark: SparkSession, name: str, rows: DataFrame) -> DataFrame:
        facts = self.facts.get(name)
        if not facts:
            return rows
        both = rows.unionByName(spark.createDataFrame(facts, self.relations[name].schema))
        return both.distinct() if self.relations[name].distinct else both

    def _solve(self, spark: SparkSession, group: list[str], state: State) -> State:
        bases, steps = {}, []
        # what every round reads is evaluated once
        outside = {x for r in self.rules if r.head in group and set(r.reads) & set(group) for x in r.reads + r.negated} - set(group)
        state = state | {x: written(state[x]) for x in sorted(outside) if x in self.relations and self.relations[x].kind != INPUT}
        for name in group:
            base = [r.body(state).select(*self.relations[name].schema.names) for r in self.rules if r.head == name and not set(r.reads) & set(group)]
            rows = union(*base) if base else spark.createDataFrame([], self.relations[name].schema)
            bases[name] = self._with_facts(spark, name, rows)
            steps += [(name, [x for x in r.reads if x in group], r.body) for r in self.rules if r.head == name and set(r.reads) & set(group)]
        return fixpoint(bases, steps, state)
