"""Aggregates in Python whose groups are never whole in one worker: states of parts are merged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD = 10_000  #: groups whose states a task keeps before it gives them on
SALTS = 64  #: parts in which a group's states are merged first


def aggregate_states(
    df: DataFrame, by: list[str], columns: list[str], states: dict[str, str], summarize: Callable[[pd.DataFrame], tuple], merge: Callable[[tuple, tuple], tuple]
) -> DataFrame:
    """by and the state of each group. states: name and type of what a state holds.

    summarize: from some rows of one group to a state; merge: two states to one, in any order and grouping.
    A task merges the states of its batches as they come, at most HELD groups at once; then the states of a
    group meet in SALTS parts and at last in one, as many rows as parts. Null is a group of its own.
    """
    names = [*by, *states]
    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in by), *(f"{c} {t}" for c, t in states.items())])
    kinds = dict(df.select(*by).dtypes)

    def frame(held: dict[tuple, tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*k, *v) for k, v in held.items()], columns=names).astype({c: "Int64" for c in by if kinds[c] in ("int", "bigint")})

    def keys_of(key: object) -> tuple:
        return tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = {}
        for rows in frames:
            for key, own in rows.groupby(by, dropna=False, sort=False):
                k, state = keys_of(key), summarize(own[columns])
                held[k] = merge(held[k], state) if k in held else state
            if len(held) > HELD:
                yield frame(held)
                held = {}
        if held:
            yield frame(held)

    def together(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        given = list(rows[list(states)].itertuples(index=False, name=None))
        state = given[0]
        for more in given[1:]:
            state = merge(state, more)
        return frame({keys_of(tuple(rows[by].iloc[0])): state})

    made = df.select(*by, *[c for c in columns if c not in by]).mapInPandas(parts, schema)
    salted = made.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return salted.groupBy(*by, "_salt").applyInPandas(together, schema).groupBy(*by).applyInPandas(together, schema)


def moments(rows: pd.DataFrame) -> tuple[int, float, float]:
    """Count, mean and sum of squared distances from the mean of a frame's one column; nulls don't count."""
    x = rows.iloc[:, 0].dropna()
    return (len(x), float(x.mean()), float(((x - x.mean()) ** 2).sum())) if len(x) else (0, 0.0, 0.0)


def merge_moments(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    """The moments of both parts together."""
    n = a[0] + b[0]
    if not n:
        return 0, 0.0, 0.0
    apart = b[1] - a[1]
    return n, a[1] + apart * b[0] / n, a[2] + b[2] + apart * apart * a[0] * b[0] / n
