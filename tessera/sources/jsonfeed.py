"""JSON change feeds of tables, in and out.

In: ``{"table": {"<uuid>": {"insert"|"initial"|"modify"|"delete": row}}}``, or the older ``{"old": row, "new": row}``. The
relation is prefix + table name with its first letter in upper case. Cells: text, unsigned 64-bit numbers, booleans,
``["uuid", x]``, ``["named-uuid", x]``, ``["set", [..]]``, ``["map", [[k, v], ..]]``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import literal
from ..plans.session import Session
from ..types import default_of

MAX_CELL = (1 << 64) - 1


class FeedError(ValueError):
    pass


@dataclass(frozen=True)
class Update:
    """op: insert, delete_key or modify. key: the row's uuid; row: its cells."""

    op: str
    relation: str
    key: str
    row: dict


def updates_from_json(prefix: str, text: str) -> Iterator[Update]:
    tables = json.loads(text)
    if not isinstance(tables, dict):
        raise FeedError("table updates are an object")
    for table, rows in tables.items():
        relation = prefix + table[:1].upper() + table[1:]
        if not isinstance(rows, dict):
            raise FeedError(f"updates of {table} are an object")
        for uuid, change in rows.items():
            if not isinstance(change, dict):
                raise FeedError(f"update of {uuid} is an object")
            yield from _row(relation, uuid, change)


def _row(relation: str, uuid: str, change: dict) -> Iterator[Update]:
    if {"old", "new"} & set(change):
        if "old" in change:
            yield Update("delete_key", relation, uuid, {})
        if "new" in change:
            yield Update("insert", relation, uuid, {"_uuid": uuid} | _cells(change["new"]))
        return
    known = [k for k in ("insert", "initial", "modify", "delete") if k in change]
    if len(known) != 1:
        raise FeedError(f"unknown row update {sorted(change)}")
    if known[0] == "delete":
        yield Update("delete_key", relation, uuid, {})
    elif known[0] == "modify":
        yield Update("modify", relation, uuid, _cells(change["modify"]))
    else:
        yield Update("insert", relation, uuid, {"_uuid": uuid} | _cells(change[known[0]]))


def _cells(row: object) -> dict:
    if not isinstance(row, dict):
        raise FeedError("a row is an object")
    return {name: cell(value) for name, value in row.items()}


def cell(value: object) -> object:
    if isinstance(value, (bool, str)):
        return value
    if isinstance(value, int):
        if 0 <= value <= MAX_CELL:
            return value
        raise FeedError(f"{value} is no unsigned 64-bit number")
    if isinstance(value, list) and len(value) == 2:
        kind, inner = value
        if kind in ("uuid", "named-uuid"):
            return inner
        if kind == "set":
            return [cell(v) for v in inner]
        if kind == "map":
            return sorted((cell(k), cell(v)) for k, v in inner)
    raise FeedError(f"unexpected cell {value!r}")


def apply(session: Session, updates: Iterable[Update]) -> None:
    """Updates as calls on a session with an open transaction. Relations have the row's uuid as key; cells that a row leaves
    out have their type's default, and cells without a column are left out. Updates of one kind and relation that follow
    each other are one call."""
    for (op, relation), group in groupby(updates, lambda u: (u.op, u.relation)):
        schema = session._input(relation).schema
        found = list(group)
        if op == "delete_key":
            session.delete_key(relation, [u.key for u in found])
        elif op == "insert":
            session.insert(relation, [tuple(u.row.get(f.name, default_of(f.dataType)) for f in schema) for u in found])
        else:
            cells = lambda u: {f.name: u.row[f.name] for f in schema if f.name in u.row}
            for _, alike in groupby(sorted(found, key=lambda u: json.dumps(cells(u), sort_keys=True)), lambda u: json.dumps(cells(u), sort_keys=True)):
                rows = list(alike)
                session.modify(relation, [u.key for u in rows], {n: literal(v, schema[n].dataType) for n, v in cells(rows[0]).items()})


def changes_to_json(table: str, changes: DataFrame, weight: str = "__w", key: str = "_uuid") -> DataFrame:
    """One JSON statement (column ``statement``) for each changed row: insert, delete, or update where a key has both."""
    columns = [c for c in changes.columns if c not in (weight, key, "uuid_name")]
    row = F.to_json(F.struct(*[F.col(c).alias(c[2:] if c.startswith("__") else c) for c in columns]))
    sides = changes.select(F.col(key).alias("k"), row.alias("row"), F.col(weight).alias("w")).groupBy("k").agg(
        F.max(F.when(F.col("w") > 0, F.col("row"))).alias("new"), F.max(F.when(F.col("w") < 0, F.col("row"))).alias("old")
    )
    quoted = F.to_json(F.struct(F.lit(table).alias("t"), F.col("k").alias("k")))
    name, uuid = F.get_json_object(quoted, "$.t"), F.get_json_object(quoted, "$.k")
    where = F.concat(F.lit('[["_uuid","==",["uuid","'), uuid, F.lit('"]]]'))
    head = lambda op: F.concat(F.lit(f'{{"op":"{op}","table":"'), name, F.lit('"'))
    insert = F.concat(head("insert"), F.lit(',"row":'), F.col("new"), F.lit("}"))
    delete = F.concat(head("delete"), F.lit(',"where":'), where, F.lit("}"))
    update = F.concat(head("update"), F.lit(',"where":'), where, F.lit(',"row":'), F.col("new"), F.lit("}"))
    return sides.select(F.when(F.col("old").isNull(), insert).when(F.col("new").isNull(), delete).otherwise(update).alias("statement"))

