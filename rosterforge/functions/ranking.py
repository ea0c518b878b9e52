"""First-wins, top-k and ordered-prefix idioms that stay skew-safe.

* ``first_per_key`` is an aggregate, so every task pre-reduces its rows and a
  key that owns a third of the table still reaches the reducer as one row per
  task.
* ``top_k_per_key`` filters ``row_number() <= k`` directly, which Spark turns
  into a window group limit on both sides of the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of every key under an ascending total order."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_first"))
    return picked.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                  rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key, numbered from 1 in ``rank_col``."""
    if k <= 0:
        return df.limit(0).withColumn(rank_col, F.lit(0))
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(window)).where(F.col(rank_col) <= k)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top-k; Spark keeps k rows per task and merges them."""
    return df.orderBy(*order).limit(k)


def ordered_array(order: Sequence[Column], *values: Column) -> Column:
    """Aggregate: structs of ``values`` sorted by ``order``. Bound the group first."""
    packed = F.struct(F.struct(*order).alias("o"), F.struct(*values).alias("v"))
    return F.transform(F.array_sort(F.collect_list(packed)), lambda s: s["v"])


def explode_once(df: DataFrame, array: Column, value: str, pos: str | None = None) -> DataFrame:
    """Explode a computed array without computing it twice.

    A plain ``explode`` makes the optimizer add a ``size(array) > 0`` filter below it, which
    repeats the whole array expression. The outer form adds none; its empty row is dropped here.
    """
    if pos is None:
        rows = df.select("*", F.explode_outer(array).alias(value))
    else:
        rows = df.select("*", F.posexplode_outer(array).alias(pos, value))
    return rows.where(F.col(value).isNotNull())
