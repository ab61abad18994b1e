"""Serving-side aggregates: compliance panel (A6), top-N charts (A7), TAM cube (A8),
scheduler status (J5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta import schema as S
from prospecta.operators import gate as G
from prospecta.operators import segment as SG


def chart_counts(
    leads: DataFrame,
    c: SG.Criteria,
    column: str,
    *,
    demo: bool = False,
    top_n: int = S.DEFAULT_CHART_TOP_N,
) -> DataFrame:
    """Top-N values of ``column`` under the criteria; NULL -> ``(sem valor)``.

    Partial counts per map task, one small shuffle, then a top-N merge."""
    label = F.coalesce(F.col(column), F.lit(S.NO_VALUE_LABEL))
    return (
        SG.segment(leads, c, demo=demo)
        .groupBy(label.alias("valor"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("valor").asc())
        .limit(int(top_n))
    )


def tam_cube(
    leads: DataFrame,
    c: SG.Criteria,
    dims: Sequence[str] = ("cod_atividade", "regiao", "porte"),
    *,
    demo: bool = False,
) -> DataFrame:
    """Counts for every combination of the dimensions (CUBE) with
    ``grouping_id`` telling which dimensions are rolled up."""
    return (
        SG.segment(leads, c, demo=demo)
        .cube(*dims)
        .agg(F.grouping_id().cast("bigint").alias("grouping_id"), F.count(F.lit(1)).alias("n"))
    )


def tam_cube_companies(
    leads: DataFrame,
    c: SG.Criteria,
    dims: Sequence[str] = ("cod_atividade", "regiao", "porte"),
    *,
    demo: bool = False,
) -> DataFrame:
    """A8 by companies: exact distinct (country, ``id_legal``) for every combination of the
    dimensions, with the establishments beside them (``n``).

    A company is a bit. Companies are numbered in the order of (first cell, country, id), so
    a cell's companies stand side by side; the leads are reduced once to a bitmap per
    finest cell and bucket of 32 768 numbers. Every coarser cell is the OR of bitmaps: no
    grouping set looks at leads or ids again, and what the cube expands are bitmaps of 4 KB,
    few of them, since neighbours share a bucket. Numbers have gaps between partitions,
    which cost nothing."""
    cells = SG.segment(leads, c, demo=demo).groupBy("pais", "id_legal", *dims).agg(F.count(F.lit(1)).alias("n"))
    key = ("pais", "id_legal")
    companies = cells.where(F.col("id_legal").isNotNull()).groupBy(*key).agg(F.min(F.struct(*dims)).alias("first"))
    companies = companies.repartitionByRange("first", *key).sortWithinPartitions("first", *key).select(*key, F.monotonically_increasing_id().alias("number"))
    numbered = cells.join(companies, cells["pais"].eqNullSafe(companies["pais"]) & (cells["id_legal"] == companies["id_legal"]), "left").select(*dims, "n", "number")
    finest = numbered.groupBy(*dims, F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"), F.sum("n").alias("n")
    )
    sets = [[d for i, d in enumerate(dims) if not (g >> (len(dims) - 1 - i)) & 1] for g in range(1 << len(dims))]
    marks = F.array(*[F.struct(F.lit(g).alias("g"), *[(F.col(d) if d in kept else F.lit(None).cast("string")).alias(d) for d in dims]) for g, kept in enumerate(sets)])
    cube = finest.select(F.explode(marks).alias("set"), "bucket", "bits", "n").select("set.*", "bucket", "bits", "n")
    merged = cube.groupBy("g", *dims, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("companies"), F.sum("n").alias("n"))
    total = merged.groupBy("g", *dims).agg(F.sum("companies").alias("n_empresas"), F.sum("n").alias("n"))
    return total.select(*dims, F.col("g").cast("bigint").alias("grouping_id"), "n_empresas", "n")


PANEL_COLUMNS: tuple[str, ...] = (
    "total_bruto",
    "n_sinteticos",
    "n_difusao_restrita",
    "n_duplicados",
    "n_opt_out",
    "total_exportavel",
)


def compliance_panel(spark: SparkSession, leads: DataFrame, c: SG.Criteria, optout: G.OptOut) -> DataFrame:
    """ICP criteria only (no exclusions), then the full gate over that raw set.

    All counts are aggregates (exact under task or stage retries): one aggregate of
    the raw set and the gate's per-stage counts, combined without a join."""
    from prospecta.operators.quality import one_row

    raw = leads.where(SG.icp_predicate(c))
    flags = raw.agg(
        F.count(F.lit(1)).alias("total_bruto"),
        F.sum(F.when(F.coalesce(F.col("is_synthetic"), F.lit(False)), 1).otherwise(0)).cast("bigint").alias("n_sinteticos"),
        F.sum(F.when(F.coalesce(F.col("flag_difusao_restrita"), F.lit(False)), 1).otherwise(0)).cast("bigint").alias("n_difusao_restrita"),
    )
    rep = G.gate_report_exact(raw, optout)
    both = one_row(flags, rep)
    return both.select(
        "total_bruto",
        F.coalesce("n_sinteticos", F.lit(0)).cast("bigint").alias("n_sinteticos"),
        F.coalesce("n_difusao_restrita", F.lit(0)).cast("bigint").alias("n_difusao_restrita"),
        (F.col("n_deduped_id_estab") + F.col("n_deduped_email_domain")).alias("n_duplicados"),
        F.col("n_suppressed").alias("n_opt_out"),
        F.col("n_out").alias("total_exportavel"),
    )


def source_status(known: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row per known source with its last processed batch (NULLs if never
    run). ``ledger`` has (fonte, competencia, run_at); the latest run per source wins."""
    last = ledger.groupBy("fonte").agg(
        F.max_by("competencia", "run_at").alias("ultima_competencia"),
        F.max("run_at").alias("ultima_execucao"),
    )
    return known.join(last, "fonte", "left").select("fonte", "ultima_competencia", "ultima_execucao")
