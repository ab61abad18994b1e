"""Join keys that keep the large side of a join splittable for skew.

When one side of an equi-join has just been de-duplicated or aggregated on the join
key (keep-first window, ``distinct``), Spark reuses that side's partitioning, so it
does not come from a shuffle of its own - and AQE only splits a skewed partition when
both sides come straight from shuffles. Joining on a derived key (the key plus a
separator; NULL stays NULL, so matches are unchanged) gives the small side its own
shuffle and lets AQE split a key that holds a third of the large side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_key(c: Column) -> Column:
    return F.concat(c.cast("string"), F.lit("|"))
