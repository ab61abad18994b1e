"""Idempotent re-ingest (INC1): a ledger table of processed batches per source.

A source runs only when its newest published batch differs from the last one it
processed; a failure records nothing (so the next round retries); sources are
independent. The ledger also records whether the run's version was activated:
``strict=True`` treats a processed-but-rejected batch as still pending, while
``strict=False`` reproduces the plain "already processed" rule.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospecta.session import rows_df

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("fonte", T.StringType()),
        T.StructField("competencia", T.StringType()),
        T.StructField("run_at", T.TimestampNTZType()),
        T.StructField("activated", T.BooleanType()),
    ]
)


def last_processed(ledger: DataFrame) -> DataFrame:
    """Latest ledger row per source (by run time, then batch id)."""
    latest = F.max_by(F.struct("competencia", "activated", "run_at"), F.struct("run_at", "competencia"))
    return ledger.groupBy("fonte").agg(latest.alias("l")).select(
        "fonte",
        F.col("l.competencia").alias("ultima_competencia"),
        F.col("l.activated").alias("ultima_ativada"),
        F.col("l.run_at").alias("ultima_execucao"),
    )


def pending(available: DataFrame, ledger: DataFrame, *, strict: bool = True) -> DataFrame:
    """Per source: the newest available batch, the last processed one, and whether a
    run is due."""
    last = last_processed(ledger)
    j = available.join(last, "fonte", "left")
    due = F.col("ultima_competencia").isNull() | (F.col("ultima_competencia") != F.col("competencia_disponivel"))
    if strict:
        due = due | ~F.coalesce(F.col("ultima_ativada"), F.lit(False))
    return j.select("fonte", "competencia_disponivel", "ultima_competencia", "ultima_ativada", due.alias("pendente"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return rows_df(spark, [], LEDGER_SCHEMA)
        raise


def mark_processed(spark: SparkSession, path: str, fonte: str, competencia: str, activated: bool, now: datetime | None = None) -> None:
    row = (fonte, competencia, (now or datetime.now(UTC)).replace(tzinfo=None), bool(activated))
    rows_df(spark, [row], LEDGER_SCHEMA).write.mode("append").parquet(path)


@dataclass(frozen=True)
class RunOutcome:
    fonte: str
    competencia: str
    skipped: bool
    success: bool
    error: str | None = None
    activated: bool | None = None


def run_if_new(
    spark: SparkSession,
    path: str,
    fonte: str,
    competencia: str,
    run: Callable[[str], bool],
    *,
    strict: bool = True,
) -> RunOutcome:
    """Run ``run(competencia)`` (returns "activated") unless already processed; never
    raises - a failure is reported and not recorded."""
    avail = rows_df(spark, [(fonte, competencia)], "fonte string, competencia_disponivel string")
    row = pending(avail, read_ledger(spark, path), strict=strict).first()
    if not row["pendente"]:
        return RunOutcome(fonte, competencia, skipped=True, success=True)
    try:
        activated = bool(run(competencia))
    except Exception as e:  # noqa: BLE001 - the scheduler must keep going
        return RunOutcome(fonte, competencia, skipped=False, success=False, error=str(e))
    mark_processed(spark, path, fonte, competencia, activated)
    return RunOutcome(fonte, competencia, skipped=False, success=True, activated=activated)


def ledger_from_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The driver's ``events`` seen as source runs: event type -> source, day of
    ``ts`` -> batch id. Every event publishes a batch (``available`` = newest day per
    source); events with value >= 5 are completed runs, activated when value >= 20."""
    fonte = (
        F.when(F.col("event_type") == "view", F.lit("BR_RECEITA"))
        .when(F.col("event_type") == "click", F.lit("FR_SIRENE"))
        .otherwise(F.concat(F.lit("OUTRA_"), F.upper("event_type")))
    )
    e = events.select(
        fonte.alias("fonte"),
        F.date_format("ts", "yyyy-MM-dd").alias("competencia"),
        F.col("ts").alias("run_at"),
        F.col("value"),
    )
    available = e.groupBy("fonte").agg(F.max("competencia").alias("competencia_disponivel"))
    ledger = e.where(F.col("value") >= 5).select(
        "fonte", "competencia", "run_at", (F.col("value") >= 20).alias("activated")
    )
    return available, ledger


def publish_if_new(
    spark: SparkSession,
    ledger_path: str,
    warehouse_root: str,
    fonte: str,
    pais: str,
    competencia: str,
    candidates: Callable[[str], DataFrame],
    *,
    strict: bool = True,
    thresholds=None,
) -> RunOutcome:
    """INC1 + V4 for one source: when ``competencia`` is new, build the canonical
    candidates for it (``candidates(competencia)`` returns a lazy DataFrame),
    publish a version for ``pais`` (quality gate, carry-forward, pointer switch only
    if it passed) and record the run with its activation flag. Failures are
    reported, not recorded, so the next round retries."""
    from prospecta.plans import publish as PB

    def run(c: str) -> bool:
        return PB.publish(spark, candidates(c), warehouse_root, pais, thresholds=thresholds).activated

    return run_if_new(spark, ledger_path, fonte, competencia, run, strict=strict)
