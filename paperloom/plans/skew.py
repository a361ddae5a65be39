"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which the side of a join is broadcast.
BROADCAST_ROWS = 200_000
#: A key is hot if it holds more than one in so many rows; so there are never more hot keys than this.
HOT_SHARE = 1000
#: Places to which the rows of hot keys are dealt.
SPREAD = 9973


def small(df: DataFrame) -> DataFrame:
    """``df`` of a written table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that exchanges it, whatever its size is taken for.

    A written table of places packs into a fiftieth of its rows in memory, so Spark would send
    millions of rows to the driver for a broadcast.
    """
    return df.hint("merge")


def free_name(columns: list[str], base: str) -> str:
    """``base``, or it with underscores before it, so that no column has the name in any case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def hot_keys(rows: DataFrame, keys: list[str], share: int = HOT_SHARE) -> DataFrame:
    """The keys that hold more than a ``share``-th of ``rows``; fewer than ``share`` rows, whatever the input."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_held"))
    limit = rows.count() / share
    return counts.where(F.col("_held") > limit).select(*keys)


def join_by_key(rows: DataFrame, found: DataFrame, keys: list[str], spread: list[str], how: str = "left", counted: DataFrame | None = None) -> DataFrame:
    """``rows`` with the columns of ``found``, a written table of one row for each key; ``how``: left or inner.

    A small ``found`` is broadcast. Otherwise hot keys meet a broadcast of at most ``HOT_SHARE`` rows,
    and in the exchange of all rows those of hot keys are dealt by the ``spread`` columns instead, so
    no task gets a hot key. Hot keys are counted in ``counted``, a cheaper table with the same keys,
    if it is given. Null keys find nothing.
    """
    values = [c for c in found.columns if c not in keys]
    if found.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found), keys, how).select(*[F.col(f"`{c}`") for c in rows.columns], *values)
    named = found.select(*keys, F.struct(*values).alias("_value"))
    hot = hot_keys(rows if counted is None else counted, keys).join(named.withColumnRenamed("_value", "_hot_value"), keys, "left")
    dealt = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(SPREAD)).cast("int") + 1).otherwise(0))
    joined = dealt.join(named.withColumn("_salt", F.lit(0)), [*keys, "_salt"], "left").withColumn("_value", F.coalesce("_hot_value", "_value"))
    if how == "inner":
        joined = joined.where(F.col("_value").isNotNull())
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col("_value")[v].alias(v) for v in values])
