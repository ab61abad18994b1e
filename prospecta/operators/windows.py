"""Keep-first per key (the only windowed semantics the lead jobs need).

``row_number() over (partition by key order by ...) = 1`` is planned by Spark as a
partial WindowGroupLimit inside every map task, an exchange on the key, then a final
WindowGroupLimit: at most one row per key and map task crosses the shuffle, so a key
holding a third of the input costs one row per map task, not a third of the data in
one reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RN = "__rn"


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """First row per ``keys`` under the total ``order``; other columns unchanged."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RN, F.row_number().over(w)).where(F.col(_RN) == 1).drop(_RN)
