"""Enrichment as table jobs: landed API responses (one JSON document per row) are
parsed with ``from_json`` against an explicit schema, mapped to canonical update
columns (E1 BR, E2 FR), merged into leads NULL-safely (J6 / E3) and re-validated.
HTTP itself is out of scope; E4/E5 extract ids from landed search results / pages.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospecta import schema as S
from prospecta.functions import normalize as N
from prospecta.operators import mapping as M
from prospecta.operators.keys import split_key
from prospecta.operators.windows import keep_first


BRASILAPI_SCHEMA = T.StructType(
    [
        T.StructField("cnpj", T.StringType()),
        T.StructField("razao_social", T.StringType()),
        T.StructField("nome_fantasia", T.StringType()),
        T.StructField("natureza_juridica", T.StringType()),
        T.StructField("capital_social", T.StringType()),
        T.StructField("porte", T.StringType()),
        T.StructField("uf", T.StringType()),
        T.StructField("cep", T.StringType()),
        T.StructField("municipio", T.StringType()),
        T.StructField("cnae_fiscal", T.StringType()),  # a number or text; leading zeros stay
        T.StructField("data_inicio_atividade", T.StringType()),
        T.StructField("descricao_situacao_cadastral", T.StringType()),
        T.StructField("ddd_telefone_1", T.StringType()),
    ]
)

_SIEGE = T.StructType(
    [
        T.StructField("code_postal", T.StringType()),
        T.StructField("siret", T.StringType()),
        T.StructField("libelle_commune", T.StringType()),
    ]
)
RECHERCHE_SCHEMA = T.StructType(
    [
        T.StructField(
            "results",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("siren", T.StringType()),
                        T.StructField("nom_complet", T.StringType()),
                        T.StructField("nom_raison_sociale", T.StringType()),
                        T.StructField("sigle", T.StringType()),
                        T.StructField("activite_principale", T.StringType()),
                        T.StructField("date_creation", T.StringType()),
                        T.StructField("etat_administratif", T.StringType()),
                        T.StructField("nature_juridique", T.StringType()),
                        T.StructField("statut_diffusion", T.StringType()),
                        T.StructField("siege", _SIEGE),
                    ]
                )
            ),
        )
    ]
)

UPDATE_FIELDS: tuple[str, ...] = (
    "razao_social",
    "nome_fantasia",
    "cod_atividade",
    "situacao",
    "regiao",
    "municipio",
    "cep",
    "telefone",
    "data_inicio_atividade",
    "porte",
    "capital_social",
    "natureza_juridica",
    "flag_difusao_restrita",
    "fonte",
    "enriquecido_em",
)
_UPDATE_TYPES = dict(S.CANONICAL_FIELDS)


def _nz(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _update_frame(key: Column, key_name: str, values: dict[str, Column]) -> list[Column]:
    out = [key.alias(key_name)]
    for f in UPDATE_FIELDS:
        out.append(values.get(f, F.lit(None)).cast(_UPDATE_TYPES[f]).alias(f))
    return out


def brasilapi_updates(responses: DataFrame, enriched_at: datetime, json_col: str = "payload") -> DataFrame:
    """BrasilAPI response -> (cnpj, update columns). Blank text -> NULL; status,
    size and legal form upper-cased; activity code as text; bad decimal/date -> NULL."""
    r = responses.select(F.from_json(F.col(json_col), BRASILAPI_SCHEMA).alias("r"))
    g = lambda n: F.col(f"r.{n}")
    return r.select(
        *_update_frame(
            g("cnpj"),
            "cnpj",
            {
                "razao_social": _nz(g("razao_social")),
                "nome_fantasia": _nz(g("nome_fantasia")),
                "cod_atividade": g("cnae_fiscal").cast("string"),
                "situacao": N.upper_or_null(g("descricao_situacao_cadastral")),
                "regiao": _nz(g("uf")),
                "municipio": _nz(g("municipio")),
                "cep": _nz(g("cep")),
                "telefone": _nz(g("ddd_telefone_1")),
                "data_inicio_atividade": N.parse_iso_date(g("data_inicio_atividade")),
                "porte": N.upper_or_null(g("porte")),
                "capital_social": N.try_decimal(g("capital_social")),
                "natureza_juridica": N.upper_or_null(g("natureza_juridica")),
                "fonte": F.lit(S.FONTE_BRASILAPI),
                "enriquecido_em": F.lit(enriched_at.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz"),
            },
        )
    )


def recherche_updates(responses: DataFrame, enriched_at: datetime, json_col: str = "payload") -> DataFrame:
    """Search response -> (siren, update columns) from the first result; an
    empty ``results`` gives no row (not found is not an error). The restricted flag
    is the exact ``statut_diffusion != 'O'`` (missing counts as restricted)."""
    r = responses.select(F.from_json(F.col(json_col), RECHERCHE_SCHEMA).alias("r"))
    first = r.select(F.try_element_at(F.col("r.results"), F.lit(1)).alias("i")).where(F.col("i").isNotNull())
    i = lambda n: F.col(f"i.{n}")
    etat = i("etat_administratif")
    situacao = F.when(etat == "A", F.lit("ATIVA")).when(etat == "F", F.lit("BAIXADA")).otherwise(N.upper_or_null(etat))
    return first.select(
        *_update_frame(
            i("siren"),
            "siren",
            {
                "razao_social": F.coalesce(_nz(i("nom_raison_sociale")), _nz(i("nom_complet"))),
                "nome_fantasia": _nz(i("sigle")),
                "cod_atividade": _nz(i("activite_principale")),
                "situacao": situacao,
                "regiao": N.departement_from_postcode(i("siege.code_postal")),
                "municipio": _nz(i("siege.libelle_commune")),
                "cep": _nz(i("siege.code_postal")),
                "data_inicio_atividade": N.parse_iso_date(i("date_creation")),
                "natureza_juridica": _nz(i("nature_juridique")),
                "flag_difusao_restrita": N.restricted_flag_exact(i("statut_diffusion")),
                "fonte": F.lit(S.FONTE_RECHERCHE),
                "enriquecido_em": F.lit(enriched_at.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz"),
            },
        )
    )


def merge_updates(leads: DataFrame, updates: DataFrame, lead_key: str, update_key: str) -> tuple[DataFrame, DataFrame]:
    """J6 + E3: LEFT JOIN leads to their update (one per key: duplicates resolved
    deterministically first) and take ``coalesce(update, lead)`` per column - a NULL in
    the update never overwrites. The merged rows are re-validated (M4): returns
    (valid, rejected)."""
    upd = keep_first(updates, [update_key], [F.col(c).asc_nulls_last() for c in UPDATE_FIELDS])
    upd = upd.select(F.col(update_key).alias("__uk"), *[F.col(c).alias(f"__u_{c}") for c in UPDATE_FIELDS])
    upd = upd.withColumn("__uk", split_key(F.col("__uk")))
    j = leads.join(upd, split_key(leads[lead_key]) == upd["__uk"], "left")
    cols = [
        (F.coalesce(F.col(f"__u_{c}"), F.col(c)).cast(t).alias(c) if c in UPDATE_FIELDS else F.col(c))
        for c, t in S.CANONICAL_FIELDS
    ]
    return M.enforce_contract(j.select(*cols))


def enrich_job(
    spark,
    leads: DataFrame,
    updates: DataFrame,
    lead_key: str,
    update_key: str,
    audit_log: str,
    operacao: str = "enrich_leads",
    usuario: str | None = None,
) -> tuple[DataFrame, int]:
    """E3 as a job: merge landed responses into leads, count the identifiers found
    (keys with an update) and record the audit event. Returns (valid merged leads,
    n found)."""
    from prospecta.plans import audit as AU

    found = updates.select(update_key).distinct().join(
        leads.select(F.col(lead_key).alias(update_key)).distinct(), update_key, "left_semi"
    ).count()
    AU.record_event(spark, audit_log, operacao, usuario=usuario, filtros={"chave": lead_key}, n_registros=found)
    valid, _ = merge_updates(leads, updates, lead_key, update_key)
    return valid, found


def extract_sirens(responses: DataFrame, json_col: str = "payload") -> DataFrame:
    """Every non-empty ``results[].siren`` of landed search responses."""
    r = responses.select(F.from_json(F.col(json_col), RECHERCHE_SCHEMA).alias("r"))
    return (
        r.select(F.explode(F.col("r.results")).alias("i"))
        .select(F.col("i.siren").alias("siren"))
        .where(F.col("siren").isNotNull() & (F.col("siren") != ""))
    )


# An index entry (address, date, number of ids) and an id's address.
INDEX_ENTRY = r"<loc>([^<]+)</loc>\s*<lastmod>[^<]+</lastmod>\s*<!--(\d+)-->"
ID_ADDRESS = r"/office/(\d{14})"


def discover_ids(landed: DataFrame, n: int) -> DataFrame:
    """E5 over a table of landed XML files (``url``, ``body``): the index files name the
    sub-maps with their number of ids; the largest one (ties: the smallest address) is
    chosen by that number, and its 14-digit ids are returned in order of appearance, each
    once, the first ``n`` (``pos``, ``id``).

    Index entries are counted with partial aggregation; only the chosen sub-map's ids are
    exploded."""
    entry = F.explode(F.regexp_extract_all("body", F.lit(INDEX_ENTRY), 0)).alias("e")
    entries = landed.where(F.col("body").contains("<!--")).select(entry).select(
        F.regexp_extract("e", INDEX_ENTRY, 1).alias("loc"), F.regexp_extract("e", INDEX_ENTRY, 2).cast("bigint").alias("ids")
    )
    best = entries.groupBy("ids").agg(F.min("loc").alias("loc")).orderBy(F.desc("ids")).limit(1)
    chosen = landed.join(best, landed["url"] == best["loc"], "left_semi")
    ids = chosen.select(F.posexplode(F.regexp_extract_all("body", F.lit(ID_ADDRESS), 1)).alias("pos", "id"))
    first = ids.groupBy("id").agg(F.min("pos").alias("pos"))
    return first.orderBy("pos").limit(int(n)).select(F.col("pos").cast("bigint").alias("pos"), "id")
