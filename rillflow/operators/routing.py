"""One input, several outputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.message import call, resolve


def key_value(key: Any) -> Any:
    return key.value if isinstance(key, Enum) else key


def route(df: DataFrame, function: Column | Callable | str, keys: Sequence[Any]) -> dict[Any, DataFrame]:
    """A table per key; each message goes to exactly one, and an unknown key fails the query."""
    if isinstance(function, Column):
        key = function.cast("string")
    else:
        run = resolve(function)
        key = call(lambda m: None if (k := key_value(run(m))) is None else str(k), "string", catch=False)["value"]
    names = [str(key_value(k)) for k in keys]
    known = F.coalesce(F.col("_key").isin(names), F.lit(False))
    checked = F.when(known, F.col("_key")).otherwise(F.raise_error(F.concat(F.lit("no route for key "), F.coalesce(F.col("_key"), F.lit("null")))))
    keyed = df.withColumn("_key", key).withColumn("_route", checked)
    return {k: keyed.where(F.col("_route") == n).drop("_key", "_route") for k, n in zip(keys, names, strict=True)}


def broadcast(df: DataFrame, names: Sequence[str]) -> dict[str, DataFrame]:
    """The same table for every branch; rows are immutable, so nothing is copied."""
    return dict.fromkeys(names, df)
