"""Recursive queries whose working table is a set."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = 1000, distinct: bool = True) -> DataFrame:
    """Recursive UNION (or UNION ALL): rows of ``seed`` and of ``step`` applied to each round's new rows.

    New rows are those not seen before, by anti-join; each round is checkpointed, so
    the plan doesn't grow with the depth and a lost executor costs one round.
    """
    sc = seed.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(seed.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint"))
    fresh = (seed.distinct() if distinct else seed).checkpoint()
    done = fresh
    for _ in range(rounds):
        if fresh.isEmpty():
            return done
        found = step(fresh).toDF(*seed.columns)
        if distinct:
            found = found.distinct().subtract(done)
        fresh = found.checkpoint()
        done = done.unionAll(fresh)
    raise RuntimeError(f"no fixpoint after {rounds} rounds")
