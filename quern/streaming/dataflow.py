"""Primitives of a stream of weighted batches: sources, memory, feedback and taps.

Each object stands for one operator of a dataflow: it is called with a batch and gives one back. What it remembers is
written to the shared folder, so plans don't grow with the number of batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession

from quern.operators.zset import ZSet
from quern.sources.scratch import written


def _kept(z: ZSet) -> ZSet:
    return ZSet(written(z.consolidated().df, "batch")[1], z.unsigned)


def _none(z: ZSet) -> ZSet:
    return ZSet(z.df.limit(0), z.unsigned)


def generator(make: Callable[[int], ZSet]) -> Iterator[ZSet]:
    """An endless source: `make` gets the number of the step."""
    n = 0
    while True:
        yield make(n)
        n += 1


@dataclass
class Integrate:
    """The sum of all batches so far."""

    spark: SparkSession
    total: ZSet | None = None

    def __call__(self, batch: ZSet) -> ZSet:
        self.total = _kept(batch if self.total is None else self.total.union(batch))
        return self.total


@dataclass
class Delay:
    """The batch before; none at first."""

    spark: SparkSession
    last: ZSet | None = None

    def __call__(self, batch: ZSet) -> ZSet:
        out, self.last = self.last, _kept(batch)
        return _none(batch) if out is None else out


@dataclass
class Differentiate:
    """This batch less the one before: the inverse of Integrate."""

    spark: SparkSession
    delay: Delay | None = None

    def __call__(self, batch: ZSet) -> ZSet:
        self.delay = self.delay or Delay(self.spark)
        return batch.difference(self.delay(batch))


def feedback(spark: SparkSession, body: Callable[[ZSet, ZSet], ZSet]) -> Callable[[ZSet], ZSet]:
    """A loop: `body` gets a batch and what it gave for the batch before (none at first)."""
    delay: list[ZSet] = []

    def run(batch: ZSet) -> ZSet:
        out = _kept(body(batch, delay[0] if delay else _none(batch)))
        delay[:] = [out]
        return out

    return run


def inspect(batches: Iterable[ZSet], look: Callable[[int, ZSet], None]) -> Iterator[ZSet]:
    """Hand each batch to `look` on its way, unchanged."""
    for n, batch in enumerate(batches):
        look(n, batch)
        yield batch


def until(batches: Iterable[ZSet], done: Callable[[ZSet], bool], most: int = 1000) -> ZSet:
    """The first batch for which `done` holds; an error if none of the first `most` is one."""
    for n, batch in enumerate(batches, 1):
        if done(batch):
            return batch
        if n >= most:
            break
    raise RuntimeError(f"the condition was not met within {most} steps")
