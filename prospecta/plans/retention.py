"""Enrichment-cache retention (RET1) and freshness (RET2) as table jobs over a cache
table ``(key, value, created_at, expires_at)`` with epoch-second doubles."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from prospecta.operators.windows import keep_first
from prospecta.plans import audit as AU


def epoch_seconds(df: DataFrame, c: str) -> F.Column:
    """Seconds since the epoch (double). A wall-clock (NTZ) timestamp is read as UTC
    whatever the session time zone; an instant (LTZ) column is already absolute."""
    from pyspark.sql import types as T

    if isinstance(df.schema[c].dataType, T.TimestampNTZType):
        micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{c}`)")
    else:
        micros = F.unix_micros(F.col(c))
    return micros.cast("double") / F.lit(1_000_000.0)


def cache_from_events(events: DataFrame, ttl_seconds: int) -> DataFrame:
    """The driver's ``events`` seen as cache writes: one entry per event under key
    ``user:<id>`` (users are written many times), value = the props JSON."""
    created = epoch_seconds(events, "ts")
    return events.select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        F.col("props").alias("value"),
        created.alias("created_at"),
        (created + F.lit(float(ttl_seconds))).alias("expires_at"),
    )


@dataclass(frozen=True)
class Purge:
    kept: DataFrame
    cutoff: float


def retention_cutoff(now: datetime, ttl_days: int) -> float:
    return (now - timedelta(days=ttl_days)).timestamp()


def purge(cache: DataFrame, now: datetime, ttl_days: int) -> Purge:
    """RET1: drop entries with ``created_at < now - ttl`` (strict; freshness is not
    considered)."""
    cutoff = retention_cutoff(now, ttl_days)
    return Purge(cache.where(F.col("created_at") >= F.lit(cutoff)), cutoff)


def purge_and_audit(
    spark: SparkSession, cache: DataFrame, dest: str, now: datetime, ttl_days: int, audit_log: str, usuario: str | None = None
) -> int:
    """RET1 job: write the kept entries to ``dest`` (a new table version), count the
    purged ones in the same pass, record an audit event, return the purged count."""
    cutoff = retention_cutoff(now, ttl_days)
    obs = Observation("retention")
    observed = cache.observe(obs, F.sum(F.when(F.col("created_at") < F.lit(cutoff), 1).otherwise(0)).alias("purged"))
    observed.where(F.col("created_at") >= F.lit(cutoff)).write.mode("overwrite").parquet(dest)
    n = int(obs.get.get("purged") or 0)
    AU.record_event(spark, audit_log, "retention_purge", usuario=usuario, filtros={"ttl_dias": ttl_days, "cache_path": dest}, n_registros=n)
    return n


def freshness(cache: DataFrame, now: datetime) -> DataFrame:
    """RET2: the latest entry per key (a re-set refreshes it) and whether it is still
    fresh (``expires_at >= now``; an entry expiring exactly now is a hit)."""
    latest = keep_first(cache, ["key"], [F.col("created_at").desc(), F.col("expires_at").desc(), F.col("value").desc()])
    return latest.withColumn("fresco", F.col("expires_at") >= F.lit(now.timestamp()))
