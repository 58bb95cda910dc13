"""Stream operators over an epoch column, and a driver that makes each micro-batch an epoch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.session import Session


def epoch_rows(history: DataFrame, epoch: int | Column, column: str = "epoch") -> DataFrame:
    """What a stream relation holds in one epoch."""
    return history.where(F.col(column) == epoch).drop(column)


def delayed(history: DataFrame, by: int, column: str = "epoch") -> DataFrame:
    """What each epoch sees of the relation as it was ``by`` epochs before."""
    if by <= 0:
        raise ValueError("a delay is positive")
    return history.withColumn(column, F.col(column) + by)


def differentiate(history: DataFrame, column: str = "epoch") -> DataFrame:
    """Weighted changes of a relation given by its content in each epoch: + what is new in an epoch, - what has gone."""
    from ..operators.relational import W, consolidate, negate, weighted

    last = history.agg(F.max(column).alias("__last"))
    gone = negate(weighted(delayed(history, 1, column))).join(F.broadcast(last), F.col(column) <= F.col("__last")).drop("__last")
    return consolidate(weighted(history).unionByName(gone.select(*history.columns, W)))


def stream_transform(history: DataFrame, transform: Callable[[DataFrame], DataFrame], epochs: list, column: str = "epoch") -> DataFrame:
    """A transform (an aggregate, say) of each epoch's rows alone; its results are not taken back later. Epochs that can be
    grouped by should be: this is for transforms that must see one epoch as a DataFrame."""
    out = None
    for epoch in epochs:
        part = transform(epoch_rows(history, epoch, column)).withColumn(column, F.lit(epoch))
        out = part if out is None else out.unionByName(part)
    return out


def run_epochs(source: DataFrame, session: Session, relation: str, checkpoint: str, on_changes: Callable[[int, dict[str, DataFrame]], None] | None = None) -> StreamingQuery:
    """Starts a streaming query that commits each micro-batch of ``source`` to an input relation as one transaction."""

    def commit(batch: DataFrame, number: int) -> None:
        session.start()
        session.insert(relation, batch)
        changes = session.commit()
        if on_changes:
            on_changes(number, changes)

    return source.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
