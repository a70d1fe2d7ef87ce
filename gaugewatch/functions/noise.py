"""One-sided noise on the numeric columns of a wide table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugewatch.functions.columns import is_numeric, tick
from gaugewatch.schemas import TS


def _noisy(df: DataFrame, share, rate: float, ts: str, skip: tuple[str, ...]) -> DataFrame:
    columns, position = [], 0
    for field in df.schema.fields:
        column = tick(field.name)
        if field.name != ts and field.name not in skip and is_numeric(field.dataType):
            value = column.cast("double")
            column = (value + share(position, field.name) * rate * value).alias(field.name)
            position += 1
        columns.append(column)
    return df.select(*columns)


def add_noise(df: DataFrame, rate: float = 0.02, seed: int | None = 42, ts: str = TS) -> DataFrame:
    """``x + u * rate * x`` with u drawn per row and column; column i uses ``seed + i``.

    Draws follow the partitioning; ``seed=None`` draws anew each time.
    """
    return _noisy(df, lambda i, _: F.rand() if seed is None else F.rand(seed + i), rate, ts, ())


def unit_hash(seed: int, *parts: Column | str) -> Column:
    """Even spread over [0, 1) that depends on nothing but the arguments."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def add_noise_keyed(df: DataFrame, keys: list[str], rate: float = 0.02, seed: int = 42, ts: str = TS) -> DataFrame:
    """The same noise for the same key and column, however the table is partitioned."""
    return _noisy(
        df, lambda _, name: unit_hash(seed, F.lit(name), *[tick(key) for key in keys]), rate, ts, tuple(keys)
    )
