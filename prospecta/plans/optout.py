"""The opt-out list as a stored, versioned table.

Layout under a root, as for the published leads: ``versions/<version>/part-*.parquet`` and
``active_version.txt``, which is switched by one overwriting rename. A change reads the
live version, writes the whole new list as another version and moves the pointer; readers
see the old or the new list, never a part. A change that turns out to change nothing
writes nothing. Versions are never modified, so a job that runs on an older one is not
disturbed. If the pointer moved while a change was being written, the change is made anew
on the list that is live by then.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta.functions import normalize as N
from prospecta.operators import gate as G
from prospecta.plans import publish as PB
from prospecta.session import rows_df

SCHEMA = "id_estab string, email string, motivo string, registrado_em string"
COLUMNS = ("id_estab", "email", "motivo", "registrado_em")
ATTEMPTS = 5


def read_list(spark: SparkSession, root: str) -> DataFrame:
    """The live list; a list that was never written is empty."""
    version = PB.active_version(root)
    if version is None:
        return rows_df(spark, [], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(PB.version_dir(root, version))


def load(spark: SparkSession, root: str) -> G.OptOut:
    """SRC8: the keys that the gate takes."""
    return G.load_optout(read_list(spark, root))


def _change(spark: SparkSession, root: str, make: Callable[[DataFrame], tuple[DataFrame, int]]) -> int:
    """``make`` turns the live list into the new one and says how many rows it changes."""
    for _ in range(ATTEMPTS):
        before = PB.active_version(root)
        rows, n = make(read_list(spark, root))
        if not n:
            return 0
        version = PB.new_version_id()
        # one file while the list is small; a long one is not joined and written by one task
        rows.select(*COLUMNS).hint("rebalance").write.parquet(PB.version_dir(root, version))
        if PB.active_version(root) == before:
            PB.activate(root, version)
            return n
    raise RuntimeError(f"the opt-out list under {root} keeps changing")


def add(spark: SparkSession, root: str, new_rows: DataFrame, *, now: datetime | None = None) -> int:
    """Rows of ``id_estab``, ``email`` and optional ``motivo`` join the list unless it
    holds the same pair; rows without either are left out; each is stamped with the time of
    registration. Gives the number of rows added."""
    stamp = (now or datetime.now(UTC)).astimezone(UTC).isoformat()

    def make(old: DataFrame) -> tuple[DataFrame, int]:
        fresh = G.optout_fresh(old, new_rows).withColumn("registrado_em", F.lit(stamp))
        return old.unionByName(fresh.select(*COLUMNS)), fresh.count()

    return _change(spark, root, make)


def add_one(spark: SparkSession, root: str, *, id_estab: str | None = None, email: str | None = None, motivo: str | None = None, now: datetime | None = None) -> bool:
    """G6 for one request: was it added? Neither key given is an error."""
    if not (id_estab or "").strip() and not (email or "").strip():
        raise ValueError("give id_estab and/or email")
    row = rows_df(spark, [(id_estab, email, motivo)], "id_estab string, email string, motivo string")
    return add(spark, root, row, now=now) == 1


def remove(spark: SparkSession, root: str, *, id_estab: str | None = None, email: str | None = None) -> int:
    """Every row with the id or the e-mail leaves the list. Gives the number of rows
    removed; 0 where there is no list."""
    G.optout_match(id_estab, email)  # neither given is an error, list or not
    if PB.active_version(root) is None:
        return 0

    def make(old: DataFrame) -> tuple[DataFrame, int]:
        hit = G.optout_match(id_estab, email)
        return old.where(~hit), old.where(hit).count()

    return _change(spark, root, make)


def remove_many(spark: SparkSession, root: str, keys: DataFrame) -> int:
    """G7 for a batch: every row whose id or e-mail stands in ``keys`` (``id_estab``,
    ``email``; blanks ignored)."""
    if PB.active_version(root) is None:
        return 0
    gone = G.load_optout(keys)

    def make(old: DataFrame) -> tuple[DataFrame, int]:
        key = lambda c: F.nullif(N.strip(c), F.lit(""))
        kept = old.join(gone.ids, key("id_estab") == F.col("__optout_id"), "left_anti")
        kept = kept.join(gone.emails, F.lower(key("email")) == F.col("__optout_email"), "left_anti")
        return kept, old.count() - kept.count()

    return _change(spark, root, make)
