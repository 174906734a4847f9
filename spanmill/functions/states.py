"""State names: one key for every way in which a state is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ASCII = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _ASCII)


def state_key(state: Column) -> Column:
    """Letters and digits only, in lower case, full-width forms folded.

    Case, spaces, punctuation, invisible characters and width do not count;
    null stays null.
    """
    return F.regexp_replace(F.lower(F.translate(state, _WIDE, _ASCII)), "[^a-z0-9]", "")


def state_names(state_dim: DataFrame) -> DataFrame:
    """(name_key, state_code): every accepted name of each row of state_dim."""
    names = F.array("ident", "name", "name_cap", "label")
    return (
        state_dim.select(F.col("code").alias("state_code"), F.explode(names).alias("_n"))
        .where(F.col("_n").isNotNull())
        .groupBy(state_key(F.col("_n")).alias("name_key"))
        .agg(F.min("state_code").alias("state_code"))
    )


def with_state_code(df: DataFrame, state_dim: DataFrame, state: str = "state") -> DataFrame:
    """Adds state_code, null where the state is null or denotes no row of state_dim.

    state_dim is a fixed table of a few dozen rows, so Spark's own size check
    lets it be broadcast; were it large, Spark would shuffle instead.
    """
    names = state_names(state_dim).withColumnRenamed("name_key", "_state_key")
    keyed = df.withColumn("_state_key", state_key(F.col(state)))
    return keyed.join(names, "_state_key", "left").drop("_state_key")
