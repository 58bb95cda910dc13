"""Handlers of changes: called with a relation's name, a row and its weight for each change of a commit.

Rows come a partition at a time; a handler that returns False ends the commit's changes.
"""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, Row

from ..operators.relational import W

Handler = Callable[[str, Row, int], object]


def null(name: str, row: Row, weight: int) -> None:
    """Ignores changes."""


def chained(*handlers: Handler) -> Handler:
    """Each handler in turn; the first that returns False ends the rest."""

    def handle(name: str, row: Row, weight: int) -> object:
        return not any(h(name, row, weight) is False for h in handlers)

    return handle


def only(relations: set[str], handler: Handler) -> Handler:
    """A handler for some relations."""
    return lambda name, row, weight: handler(name, row, weight) if name in relations else True


class Threaded:
    """Passes changes to a handler on a thread of its own, through a queue of bounded length. Use it as a context."""

    def __init__(self, handler: Handler, most: int = 10_000) -> None:
        self.handler, self.waiting = handler, queue.Queue(most)
        self.error: BaseException | None = None
        self.thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while (change := self.waiting.get()) is not None:
            try:
                if self.error is None:
                    self.handler(*change)
            except Exception as e:  # noqa: BLE001  (raised again where the changes come from)
                self.error = e

    def __call__(self, name: str, row: Row, weight: int) -> bool:
        self.waiting.put((name, row, weight))
        return self.error is None

    def __enter__(self) -> Threaded:
        self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.waiting.put(None)
        self.thread.join()
        if self.error:
            raise self.error


def dispatch(changes: dict[str, DataFrame], handler: Handler) -> None:
    """Calls a handler with all changes that a commit returned."""
    for name in sorted(changes):
        columns = [c for c in changes[name].columns if c != W]
        for row in changes[name].select(*columns, W).toLocalIterator():
            if handler(name, Row(*columns)(*row[:-1]), row[-1]) is False:
                return
