"""Ingest jobs: registry tables -> canonical leads (valid + rejected).

Each function is lazy; nothing is collected. The inputs here are the registry-shaped
tables derived from the driver's test tables; the same operators run unchanged on
tables read by ``prospecta.sources.registry`` from real CSV dumps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from prospecta import schema as S
from prospecta.operators import mapping as M
from prospecta.sources import registry as R
from prospecta.sources import testdata as TD

BR_LAYOUTS = {"EMPRESAS": S.EMPRESAS_COLUMNS, "ESTABELECIMENTOS": S.ESTABELECIMENTOS_COLUMNS, "SIMPLES": S.SIMPLES_COLUMNS}
_REJECT = "malformada"


@dataclass(frozen=True)
class Mapped:
    valid: DataFrame
    rejected: DataFrame


def br_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.br_joined(
        TD.staging_estabelecimentos(spark, sf_dir),
        TD.staging_empresas(spark, sf_dir),
        TD.staging_simples(spark, sf_dir),
        TD.lookup_municipio(spark, sf_dir),
        TD.lookup_natureza_juridica(spark, sf_dir),
    )


def br_mapped(spark: SparkSession, sf_dir: str) -> Mapped:
    valid, rejected = M.enforce_contract(M.br_to_canonical(br_joined(spark, sf_dir)))
    return Mapped(valid, rejected)


def fr_parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Legal units and establishments, typed; only the fields the mapping reads."""
    ul = M.parse_unite_legale(TD.fr_unite_legale(spark, sf_dir), M.UL_MAPPED)
    et = M.parse_etablissement(TD.fr_etablissement(spark, sf_dir), M.ETAB_MAPPED)
    return ul, et


def fr_mapped(spark: SparkSession, sf_dir: str) -> Mapped:
    ul, et = fr_parsed(spark, sf_dir)
    # every FR text value comes from a stripped field or a literal
    valid, rejected = M.enforce_contract(M.fr_to_canonical(M.fr_joined(ul, et)), already_stripped=True)
    return Mapped(valid, rejected)


def leads(spark: SparkSession, sf_dir: str, *, with_demo: bool = True) -> DataFrame:
    """BR + FR (+ demo rows) in one canonical DataFrame."""
    df = br_mapped(spark, sf_dir).valid.unionByName(fr_mapped(spark, sf_dir).valid)
    if with_demo:
        df = df.unionByName(TD.demo_leads_from_part(spark, sf_dir))
    return df


def stage_directory(
    spark: SparkSession,
    landing: str,
    parquet_dir: str,
    *,
    only: list[str] | None = None,
) -> dict[str, dict[str, int]]:
    """SNK1 + SNK2: route the files of a landing folder by entity (SRC9), read each
    entity's files as one positional scan (SRC1/SRC2), write them as Parquet
    (``<parquet_dir>/<entity>``, rejected lines in a partition of their own, see
    ``staged``) and return ``{entity: {rows, malformed}}``.

    Counting is done by Observation on the same job that writes the Parquet."""
    out: dict[str, dict[str, int]] = {}
    for entity, files in sorted(R.route_files(spark, landing, "BR", only).items()):
        cols = BR_LAYOUTS[entity]
        raw = R.positional_rows(spark, files, cols)
        obs = Observation(f"stage_{entity}")
        raw = raw.observe(
            obs,
            F.sum(F.when(F.col(R.CORRUPT).isNull(), 1).otherwise(0)).alias("rows"),
            F.sum(F.when(F.col(R.CORRUPT).isNotNull(), 1).otherwise(0)).alias("malformed"),
        )
        # one pass writes the rows and, in a partition beside them, the rejected lines
        parts = raw.withColumn(_REJECT, F.col(R.CORRUPT).isNotNull().cast("int"))
        parts.write.mode("overwrite").partitionBy(_REJECT).parquet(f"{parquet_dir.rstrip('/')}/{entity}")
        got = obs.get
        out[entity] = {"rows": int(got.get("rows") or 0), "malformed": int(got.get("malformed") or 0)}
    return out


def staged(spark: SparkSession, parquet_dir: str, entity: str) -> R.Scan:
    """An entity staged by ``stage_directory``: its rows, and the lines kept aside."""
    cols = BR_LAYOUTS[entity]
    fields = ", ".join(f"`{c}` string" for c in (*cols, R.CORRUPT))
    df = spark.read.schema(f"{fields}, {_REJECT} int").parquet(f"{parquet_dir.rstrip('/')}/{entity}")
    bad = df.where(F.col(_REJECT) == 1).select(F.col(cols[0]).alias("campo0"), F.col(R.CORRUPT).alias("linha"))
    return R.Scan(df.where(F.col(_REJECT) == 0).select(*cols), bad)


def write_registry_csv(df: DataFrame, dest: str, *, encoding: str = "ISO-8859-1", header: bool = False, sep: str = ";") -> None:
    """Write a DataFrame the way registry dumps look: ``;``-separated, double-quote
    quoting with doubled quotes, empty fields unquoted, latin-1 by default."""
    (
        df.write.mode("overwrite")
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", encoding)
        .option("header", str(header).lower())
        .option("emptyValue", "")
        .option("nullValue", "")
        .csv(dest)
    )
