"""Folds over long arrays.

aggregate() copies its state at every step, so that a list in it costs the square of its length. Here items are
folded in runs: a fold without list finds the state at the start of each run, and one in each run lists what it passes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import bound

RUN = 128


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], fields: tuple[str, ...], state: str) -> Column:
    """The states (structs of these fields, of the type state) after each item."""
    copied = lambda s: F.struct(*(s[f].alias(f) for f in fields))

    def listed(run: Column, begin: Column) -> Column:
        start = F.struct(copied(begin).alias("now"), F.array().cast(f"array<{state}>").alias("past"))

        def one(a: Column, x: Column) -> Column:
            return bound(step(a["now"], x), lambda now: F.struct(now.alias("now"), F.array_append(a["past"], now).alias("past")))

        return F.aggregate(run, start, one, lambda a: a["past"])

    def folded(runs: Column) -> Column:
        starts = F.aggregate(F.slice(runs, 1, F.size(runs) - 1), F.array(zero), lambda a, run: F.array_append(a, F.aggregate(run, F.element_at(a, -1), step)))
        return bound(starts, lambda s: F.flatten(F.transform(runs, lambda run, j: listed(run, F.get(s, j)))))

    split = lambda xs: F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(RUN)), lambda at: F.slice(xs, at, RUN))
    return F.when(F.size(items) > 0, bound(items, lambda xs: bound(split(xs), folded))).otherwise(F.array().cast(f"array<{state}>"))
