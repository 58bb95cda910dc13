"""Transactions over a program's input relations, commits with their changes, indexes and epochs.

Updates are DataFrames or rows; each call is checked as a whole before it takes effect (a failing batch leaves the staged
state as it was). ``commit`` writes the new inputs to the shared folder, evaluates the program and returns the changes of
the output relations as weighted DataFrames; outputs and changes are written as well, so nothing is evaluated twice. A commit
that only adds rows, which no rule negates or aggregates, evaluates the rules on these rows alone. An epoch passes with every commit that changes anything.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import maps, sets
from ..operators.relational import W, consolidate, delta, negate, weighted
from ..storage import counted, drop, written
from .program import INPUT, MULTISET, OUTPUT, STREAM, Program, Relation, delayed_name


#: Commits of new rows only that follow each other as changes; then relations are evaluated and written as a whole again.
MOST_STEPS = 16


def mutated(field: T.StructField, value: Column) -> Column:
    """A column after a mutator."""
    kind = field.dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and kind.elementType.names == ["key", "value"]:
        return maps.mutate(F.col(field.name), value)
    if isinstance(kind, T.ArrayType) and field.metadata.get("kind") == "set":
        return sets.symmetric_difference(F.col(field.name), value)
    return value


def literal(value, kind: T.DataType) -> Column:
    """A value as a constant, which Spark compares where the rows are made."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.array(*[literal(x, kind.elementType) for x in value]).cast(kind)
    if isinstance(kind, T.StructType):
        named = value.asDict() if isinstance(value, Row) and hasattr(value, "__fields__") else value
        values = [named.get(f.name) for f in kind] if isinstance(named, dict) else named
        return F.struct(*[literal(x, f.dataType).alias(f.name) for x, f in zip(values, kind, strict=True)])
    return F.lit(value).cast(kind)


class UpdateError(ValueError):
    """An update that the relation's kind, key or content forbids, or one outside a transaction."""


class Session:
    def __init__(self, spark: SparkSession, program: Program, keep_epochs: int = 8) -> None:
        self.spark, self.program, self.keep_epochs = spark, program, keep_epochs
        program.check()
        self.inputs = {n: self._empty(r) for n, r in program.relations.items() if r.kind == INPUT}
        self.staged: dict[str, DataFrame] | None = None
        self.touched: set[str] = set()
        self.epoch = 1
        self.stopped = False
        self.advanced = 0  # commits since the program was last evaluated as a whole
        self.history: dict[int, dict[str, DataFrame]] = {}
        self.state = self._evaluate(self.inputs, ())

    # --- transactions

    def start(self) -> None:
        if self.staged is not None:
            raise UpdateError("transaction already in progress")
        self.staged, self.touched = dict(self.inputs), set()

    def rollback(self) -> None:
        self._open()
        self.staged = None

    def commit(self, changes: bool = True) -> dict[str, DataFrame]:
        """Makes the staged updates effective. Returns the weighted changes of the output relations that changed."""
        staged = self._open()
        before = self.state
        now, effective = dict(self.inputs), False
        added: dict[str, DataFrame] | None = {}  # new rows by relation; None if there is more than new rows
        for name in self.touched:
            kind = self.program.relations[name].caching
            rows, n = counted(staged[name])
            if kind == STREAM:
                now[name], effective, added = rows, effective or n > 0, None
                continue
            change, n = counted(self._change(name, self.inputs[name], rows))
            if n:
                now[name], effective = rows, True
            plain = n and added is not None and kind == "set" and change.where(F.col(W) < 0).isEmpty()
            if plain:
                added[name] = change.drop(W)
            elif n:
                added = None
        self.staged = None
        streams = [n for n, r in self.program.relations.items() if r.kind == INPUT and r.caching == STREAM]
        if not effective:
            return {}
        for name in streams:
            if name not in self.touched:
                now[name] = self._empty(self.program.relations[name])
        self.inputs = now
        self.epoch += 1
        outputs = [n for n, r in self.program.relations.items() if r.kind == OUTPUT]
        late = any(delayed_name(n) for r in self.program.rules for n in r.reads + r.negated)
        step = None
        if changes and added and self.epoch > 2 and not streams and not late and self.advanced < MOST_STEPS:
            step = self.program.advance(before, added)
        if step:
            self.advanced += 1
            self.state, gained = step
            self.history[self.epoch] = dict(self.state)
        else:
            self.advanced = 0
            self.state = self._evaluate(now, outputs if changes else ())
        for old in [e for e in self.history if e <= self.epoch - self.keep_epochs]:
            del self.history[old]
        if not changes:
            return {}
        if step:
            return {n: weighted(gained[n]) for n in outputs if n in gained and not gained[n].isEmpty()}
        found = {}
        for name in outputs:
            difference, n = counted(delta(before[name], self.state[name]))
            if n:
                found[name] = difference
            else:
                drop(difference)
        return found

    def _evaluate(self, inputs: dict[str, DataFrame], keep: tuple | list) -> dict[str, DataFrame]:
        """The program's relations. Those of ``keep`` and those that rules read with a delay are written, once."""
        late = {delayed_name(n) for r in self.program.rules for n in r.reads + r.negated if delayed_name(n)}
        past = {f"{name}-{by}": self._past(name, by) for name, by in late}
        state = self.program.evaluate(self.spark, self._values(inputs), past)
        wanted = {n for n in (*keep, *(name for name, _ in late)) if self.program.relations[n].kind != INPUT}
        state |= {n: written(state[n]) for n in sorted(wanted)}
        self.history[self.epoch] = dict(state)
        return state

    def _past(self, name: str, by: int) -> DataFrame:
        if by >= self.keep_epochs:
            raise ValueError(f"only {self.keep_epochs} epochs are kept")
        held = self.history.get(self.epoch - by)
        return held[name] if held else self.spark.createDataFrame([], self.program.relations[name].schema)

    def stop(self) -> None:
        self.staged, self.stopped = None, True

    # --- updates

    def insert(self, name: str, rows) -> None:
        relation, now, rows = self._update(name, rows)
        if relation.caching != "set":
            self._stage(name, now.unionByName(weighted(rows)))
        elif relation.key:
            keys = self._key(rows, relation)
            if rows.count() != keys.distinct().count() or not self._matching(now, rows, relation).isEmpty():
                raise UpdateError(f"insert: duplicate key in {name}")
            self._stage(name, now.unionByName(rows))
        else:
            self._stage(name, now.unionByName(rows).distinct())

    def insert_or_update(self, name: str, rows) -> None:
        relation, now, rows = self._update(name, rows)
        self._keyed(relation, "insert_or_update")
        if rows.count() != self._key(rows, relation).distinct().count():
            raise UpdateError(f"insert_or_update: a key occurs twice in one batch for {name}")
        self._stage(name, self._without(now, rows, relation).unionByName(rows))

    def delete(self, name: str, rows) -> None:
        relation, now, rows = self._update(name, rows)
        if relation.caching != "set":
            self._stage(name, now.unionByName(negate(weighted(rows))))
            return
        same = reduce(Column.__and__, [now[c].eqNullSafe(rows[c]) for c in now.columns])
        if relation.key and rows.distinct().join(now, same, "left_semi").count() != rows.distinct().count():
            raise UpdateError(f"delete: key not found or another value in {name}")
        self._stage(name, now.join(rows, same, "left_anti"))

    def delete_key(self, name: str, keys) -> None:
        """keys: rows of the key columns."""
        relation = self._input(name)
        self._keyed(relation, "delete_key")
        now, wanted = self._staged(name), self._keys(relation, keys)
        if self._by_key(now, wanted, relation, "left_semi").count() != wanted.count():
            raise UpdateError(f"delete_key: key not found in {name}")
        self._stage(name, self._by_key(now, wanted, relation, "left_anti"))

    def modify(self, name: str, keys, changes: dict[str, Column]) -> None:
        """Sets columns (or fields, by dotted path) of the rows with the given keys. A row stays under its key only if the
        change leaves the key alone; a change that would give two rows one key is an error."""
        relation = self._input(name)
        self._keyed(relation, "modify")
        now, wanted = self._staged(name), self._keys(relation, keys)
        hit = self._by_key(now, wanted, relation, "left_semi")
        if hit.count() != wanted.count():
            raise UpdateError(f"modify: key not found in {name}")
        changed = hit
        for path, value in changes.items():
            top, _, inner = path.partition(".")
            changed = changed.withColumn(top, F.col(top).withField(inner, value) if inner else value)
        whole = self._by_key(now, wanted, relation, "left_anti").unionByName(changed)
        if whole.count() != self._key(whole, relation).distinct().count():
            raise UpdateError(f"modify: duplicate key in {name}")
        self._stage(name, whole)

    def mutate(self, name: str, keys, changes: dict[str, Column]) -> None:
        """``modify`` as commands mean it: of a map column the given entries are set, or deleted where the value is null; of a
        set column (metadata ``kind`` = ``set``) the given members are toggled; any other column takes the new value."""
        schema = self._input(name).schema
        self.modify(name, keys, {path: value if "." in path else mutated(schema[path], value) for path, value in changes.items()})

    def clear(self, name: str) -> None:
        relation = self._input(name)
        if relation.caching == STREAM:
            raise UpdateError(f"clear: {name} is a stream")
        self._open()
        self._stage(name, self._empty(relation))

    # --- reading

    def relation(self, name: str, delay: int = 0) -> DataFrame:
        """The content of a relation, or of ``delay`` epochs ago (empty before the first)."""
        if name not in self.program.relations:
            raise UpdateError(f"unknown relation {name}")
        if delay == 0:
            return self.state[name]
        return self._past(name, delay)

    def input_data(self, name: str) -> DataFrame:
        """The content of an input relation with the updates of an open transaction."""
        self._input(name)
        return (self.staged or self.inputs)[name]

    def dump_table(self, name: str, callback: Callable[[Row, int], bool]) -> None:
        """Calls back with each row of a relation and its weight until the callback returns False."""
        rows = self.relation(name)
        for row in rows.toLocalIterator():
            if not callback(row, 1):
                return

    def query_index(self, name: str, *key) -> DataFrame:
        index = self._index(name)
        rows = self.state[index.relation]
        match = reduce(Column.__and__, [F.col(c).eqNullSafe(literal(value, rows.select(c).schema[0].dataType)) for c, value in zip(index.key, key, strict=True)])
        return rows.where(match).distinct()

    def dump_index(self, name: str) -> DataFrame:
        return self.state[self._index(name).relation].distinct()

    # --- inside

    def _empty(self, relation: Relation) -> DataFrame:
        df = self.spark.createDataFrame([], relation.schema)
        return df if relation.caching == "set" else weighted(df)

    def _values(self, inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Input relations as rules read them: multisets and streams by their distinct values of non-zero weight."""
        return {n: df if W not in df.columns else consolidate(df).drop(W) for n, df in inputs.items()}

    def _change(self, name: str, old: DataFrame, new: DataFrame) -> DataFrame:
        if self.program.relations[name].caching == MULTISET:
            return consolidate(new.unionByName(negate(old)))
        return delta(old, new)

    def _open(self) -> dict[str, DataFrame]:
        if self.stopped:
            raise UpdateError("the session is stopped")
        if self.staged is None:
            raise UpdateError("no transaction in progress")
        return self.staged

    def _input(self, name: str) -> Relation:
        relation = self.program.relations.get(name)
        if relation is None or relation.kind != INPUT:
            raise UpdateError(f"apply_update: unknown input relation {name}")
        return relation

    def _index(self, name: str):
        if name not in self.program.indexes:
            raise UpdateError(f"unknown index {name}")
        return self.program.indexes[name]

    def _staged(self, name: str) -> DataFrame:
        staged = self._open()
        if self.program.relations[name].caching == STREAM and name not in self.touched:
            return self._empty(self.program.relations[name])  # a stream holds only this transaction's rows
        return staged[name]

    def _update(self, name: str, rows) -> tuple[Relation, DataFrame, DataFrame]:
        relation = self._input(name)
        now = self._staged(name)
        rows = rows.select(*relation.schema.names) if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, relation.schema)
        return relation, now, rows

    def _stage(self, name: str, rows: DataFrame) -> None:
        self._open()[name] = rows
        self.touched.add(name)

    def _keyed(self, relation: Relation, what: str) -> None:
        self._open()
        if not relation.key or relation.caching != "set":
            raise UpdateError(f"{what}: relation {relation.name} has no key")

    def _key(self, rows: DataFrame, relation: Relation) -> DataFrame:
        return rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(relation.key)])

    def _keys(self, relation: Relation, keys) -> DataFrame:
        if isinstance(keys, DataFrame):
            return keys.toDF(*[f"k{i}" for i in range(len(relation.key))]).distinct()
        kinds = self._key(self._empty(relation), relation).schema
        return self.spark.createDataFrame([k if isinstance(k, tuple) else (k,) for k in keys], kinds).distinct()

    def _by_key(self, now: DataFrame, keys: DataFrame, relation: Relation, how: str) -> DataFrame:
        match = reduce(Column.__and__, [F.col(c).eqNullSafe(keys[f"k{i}"]) for i, c in enumerate(relation.key)])
        return now.join(keys, match, how)

    def _matching(self, now: DataFrame, rows: DataFrame, relation: Relation) -> DataFrame:
        return self._by_key(now, self._key(rows, relation), relation, "left_semi")

    def _without(self, now: DataFrame, rows: DataFrame, relation: Relation) -> DataFrame:
        return self._by_key(now, self._key(rows, relation), relation, "left_anti")
