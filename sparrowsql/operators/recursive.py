"""Recursive queries with UNION (distinct): rounds over the new rows only, until none is new."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

#: The dialect's bound on rounds.
MAX_ROUNDS = 1000


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], str], read: Callable[[list[str]], DataFrame]) -> DataFrame:
    """base and all rows that step makes from rows found before, each once.

    write puts a frame into storage and read takes up some of what was written,
    so that plans don't grow; rows found in earlier rounds are never written again.
    """
    paths = [write(base.distinct())]
    for _ in range(MAX_ROUNDS):
        made = step(read(paths[-1:])).toDF(*base.columns).distinct()
        found = read(paths).toDF(*[f"__{i}" for i in range(len(base.columns))])
        known = reduce(lambda a, b: a & b, [made[c].eqNullSafe(found[f"__{i}"]) for i, c in enumerate(base.columns)])
        paths.append(write(made.join(found, known, "left_anti")))
        if read(paths[-1:]).isEmpty():
            return read(paths)
    raise ValueError(f"a recursive query goes on after {MAX_ROUNDS} rounds")
