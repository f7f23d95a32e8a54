"""Joins that keep a hot key from landing in one task where a grouping by the same key follows.

Elsewhere a plain join will do: Spark splits the skewed partitions of a join it has measured, without copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """``big.join(small, keys, how)`` for a ``big`` side in which one key may hold most rows.

    Rows of a key are dealt to ``salts`` groups by a hash of ``spread_by``, and ``small`` is copied
    once per group, so every row of ``big`` meets exactly the rows it would meet without salt:
    inner, left, semi and anti joins keep their meaning. Unlike the runtime splitting of skewed
    partitions this also works where a grouping by the same keys follows.
    """
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")
