"""Projections: folds of events into state, declared by event type.

    Projection(log).filter(F.col("version") > 3).when({
        "view": {"views": count(), "spent": total(F.col("value"))},
        ANY: {"last": latest(F.col("timestamp"))},
    }).per_stream()

Handlers of this form are algebraic: each becomes one conditional aggregate, so the fold runs with partial aggregation on
all partitions and no order is needed. A handler may also be a Python function (state, event) -> state for folds that
depend on order; `fold_per_stream` then streams each stream's sorted events through it once, holding one state at a time,
and `fold_all` folds position ranges in parallel and merges their states in order. Handlers of `fold_emitting` may also send
copies of events, and links to them, to other streams.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.schema import LINK_TYPE

#: A handler for events of every type.
ANY = "_any"
EVENT = ["stream", "version", "position", "type", "timestamp", "data"]


@dataclass(frozen=True)
class Fold:
    """An aggregate over the events that a handler gets."""

    make: Callable[[Column], Column]


def count() -> Fold:
    return Fold(lambda on: F.count_if(on))


def total(value: Column) -> Fold:
    return Fold(lambda on: F.sum(F.when(on, value)))


def least(value: Column) -> Fold:
    return Fold(lambda on: F.min(F.when(on, value)))


def greatest(value: Column) -> Fold:
    return Fold(lambda on: F.max(F.when(on, value)))


def latest(value: Column, order: str = "position") -> Fold:
    return Fold(lambda on: F.max_by(value, F.when(on, F.col(order))))


def first(value: Column, order: str = "position") -> Fold:
    return Fold(lambda on: F.min_by(value, F.when(on, F.col(order))))


Handlers = dict[str, dict[str, Fold]]


@dataclass(frozen=True)
class Projection:
    """Events and the handlers that fold them. Immutable: every step gives a new one and keeps what was set before."""

    events: DataFrame
    handlers: tuple[tuple[str, str, Fold], ...] = ()

    def filter(self, condition: Column) -> Projection:
        return replace(self, events=self.events.filter(condition))

    def when(self, handlers: Handlers) -> Projection:
        added = tuple((kind, name, fold) for kind, folds in handlers.items() for name, fold in folds.items())
        return replace(self, handlers=self.handlers + added)

    def _columns(self) -> list[Column]:
        if not self.handlers:
            raise ValueError("a projection needs handlers")
        on = lambda kind: F.lit(True) if kind == ANY else F.coalesce(F.col("type") == kind, F.lit(False))
        return [fold.make(on(kind)).alias(name) for kind, name, fold in self.handlers]

    def single(self) -> DataFrame:
        """One state over all events."""
        return self.events.agg(*self._columns())

    def per_stream(self) -> DataFrame:
        """One state per stream, none shared; hot streams are combined before the shuffle."""
        return self.events.groupBy("stream").agg(*self._columns())


Step = Callable[[dict, dict], dict]


def _step(handlers: dict[str, Step], state: dict, event: dict) -> dict:
    for kind in (event["type"], ANY):
        handler = handlers.get(kind)
        if handler is not None:
            state = handler(state, event)
    return state


def fold_per_stream(events: DataFrame, initial: dict, handlers: dict[str, Step]) -> DataFrame:
    """stream, state (JSON): events of each stream in version order through the handlers of their type, then ANY's.

    Partitions are sorted by stream and version and read once as a stream of batches; a worker holds one state. Order
    makes one stream's fold sequential. Rows without a stream are left out; null versions come first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, state = None, None
        for batch in batches:
            out = []
            for event in batch.to_dict("records"):
                if event["stream"] != stream:
                    if stream is not None:
                        out.append((stream, json.dumps(state, sort_keys=True)))
                    stream, state = event["stream"], json.loads(json.dumps(initial))
                state = _step(handlers, state, event)
            if out:
                yield pd.DataFrame(out, columns=["stream", "state"])
        if stream is not None:
            yield pd.DataFrame([(stream, json.dumps(state, sort_keys=True))], columns=["stream", "state"])

    rows = events.filter(F.col("stream").isNotNull()).select(*EVENT)
    return rows.repartition("stream").sortWithinPartitions("stream", "version", "position").mapInPandas(run, "stream string, state string")


class Outbox:
    """What the handlers of a projection send to other streams while they fold."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def emit(self, stream: str, event: dict) -> None:
        """A copy of an event (or any type, data, metadata) for another stream."""
        self.rows.append(("emit", None, None, stream, event["position"], event["type"], event.get("data"), event.get("metadata")))

    def link_to(self, stream: str, event: dict) -> None:
        """A link to an event in another stream; a link to a link points at what that one points at."""
        data = event["data"] if event["type"] == LINK_TYPE else f"{event['stream']}@{event['version']}"
        self.rows.append(("link", None, None, stream, event["position"], LINK_TYPE, data, None))


SENT = "what string, stream string, state string, target string, position long, type string, data string, metadata string"


def fold_emitting(events: DataFrame, initial: dict, handlers: dict[str, Callable[[dict, dict, Outbox], dict]]) -> DataFrame:
    """As fold_per_stream(), with handlers (state, event, outbox) -> state that may send events to other streams.

    what: `state` (stream and its state at the end), `emit` or `link` (an event to append to target: type, data, metadata;
    position is that of the event handled, so it tells their order). What is sent leaves a worker batch by batch.
    """
    names = [f.strip().partition(" ")[0] for f in SENT.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, state, out = None, None, Outbox()
        done = lambda: ("state", stream, json.dumps(state, sort_keys=True), None, None, None, None, None)
        for batch in batches:
            for event in batch.to_dict("records"):
                if event["stream"] != stream:
                    if stream is not None:
                        out.rows.append(done())
                    stream, state = event["stream"], json.loads(json.dumps(initial))
                for kind in (event["type"], ANY):
                    if kind in handlers:
                        state = handlers[kind](state, event, out)
            if out.rows:
                yield _sent(out.rows, names)
                out.rows = []
        if stream is not None:
            yield _sent([*out.rows, done()], names)

    columns = [*EVENT, *(["metadata"] if "metadata" in events.columns else [])]
    rows = events.filter(F.col("stream").isNotNull()).select(*columns)
    return rows.repartition("stream").sortWithinPartitions("stream", "version", "position").mapInPandas(run, SENT)


def _sent(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"position": "Int64"})


def fold_all(events: DataFrame, initial: dict, handlers: dict[str, Step], merge: Callable[[dict, dict], dict]) -> dict:
    """One state over all events in position order. Ranges of positions are folded in parallel, each from `initial`; merge
    puts the state of a later range onto that of the ranges before it. Only the states reach the driver, one per range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, start = json.loads(json.dumps(initial)), None
        for batch in batches:
            for event in batch.to_dict("records"):
                start = event["position"] if start is None else start
                state = _step(handlers, state, event)
        if start is not None:
            yield pd.DataFrame([(start, json.dumps(state))], columns=["start", "state"])

    rows = events.filter(F.col("position").isNotNull()).select(*EVENT)
    parts = rows.repartitionByRange("position").sortWithinPartitions("position").mapInPandas(run, "start long, state string")
    state = json.loads(json.dumps(initial))
    for part in sorted(parts.collect()):
        state = merge(state, json.loads(part["state"]))
    return state


class Registry:
    """Named projections: functions from a log to a result."""

    def __init__(self) -> None:
        self._named: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, name: str, projection: Callable[[DataFrame], DataFrame]) -> None:
        self._named[name] = projection

    def names(self) -> list[str]:
        return sorted(self._named)

    def run(self, name: str, log: DataFrame) -> DataFrame:
        return self._named[name](log)


def persist(state: DataFrame, path: str) -> None:
    """Write a projection's state, replacing what is there."""
    state.write.mode("overwrite").parquet(path)
