"""Joins of registry tables and their mapping to the canonical ``leads`` contract.

* J1  ``br_joined``: establishments LEFT JOIN companies, simples and two lookups.
* M1  ``br_to_canonical``; M2 ``fr_to_canonical``; M3 ``opencnpj_to_canonical``.
* J2  ``fr_joined`` / ``fr_orphans``: legal unit (last record per SIREN) with its
  establishments.
* M4  ``enforce_contract``: strip, validate, split valid rows from rejected rows with
  a reason, never failing the job.
* P20 typed projections of every raw layout column.

Plans: the BR job shuffles the establishment side once, on ``cnpj_basico``, into a
single join with the combined company table (companies FULL OUTER simples, both
keyed by company); the code tables are broadcast after a bounded count. Because the
large side meets one join, AQE's skew-join handling splits a ``cnpj_basico`` holding
a third of the establishments across tasks (checked in ``tests/test_skew.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospecta import schema as S
from prospecta.functions import normalize as N
from prospecta.operators.keys import split_key
from prospecta.operators.windows import keep_first

# -- P20: typed projections of the raw layouts -----------------------------------------


def parse_empresas(raw: DataFrame) -> DataFrame:
    c = F.col
    return raw.select(
        N.strip("cnpj_basico").alias("cnpj_basico"),
        N.blank_to_null("razao_social").alias("razao_social"),
        N.blank_to_null("natureza_juridica").alias("natureza_juridica"),
        N.blank_to_null("qualificacao_responsavel").alias("qualificacao_responsavel"),
        N.parse_comma_decimal(N.strip(c("capital_social"))).alias("capital_social"),
        N.blank_to_null("porte_empresa").alias("porte_empresa"),
        N.blank_to_null("ente_federativo_responsavel").alias("ente_federativo_responsavel"),
    )


_ESTAB_DATES = ("data_situacao_cadastral", "data_inicio_atividade", "data_situacao_especial")


def parse_estabelecimentos(raw: DataFrame) -> DataFrame:
    out: list[Column] = []
    for name in S.ESTABELECIMENTOS_COLUMNS:
        if name in ("cnpj_basico", "cnpj_ordem", "cnpj_dv"):
            out.append(N.strip(name).alias(name))
        elif name in _ESTAB_DATES:
            out.append(N.parse_yyyymmdd(N.strip(name)).alias(name))
        elif name == "cnae_fiscal_secundaria":
            out.append(N.split_list(name).alias(name))
        else:
            out.append(N.blank_to_null(name).alias(name))
    df = raw.select(*out)
    return df.withColumn(
        "cnpj_completo", F.concat("cnpj_basico", "cnpj_ordem", "cnpj_dv")
    )


def parse_simples(raw: DataFrame) -> DataFrame:
    out: list[Column] = []
    for name in S.SIMPLES_COLUMNS:
        if name == "cnpj_basico":
            out.append(N.strip(name).alias(name))
        elif name.startswith("data_"):
            out.append(N.parse_yyyymmdd(N.strip(name)).alias(name))
        else:
            out.append(N.blank_to_null(name).alias(name))
    return raw.select(*out)


# FR header name -> (our column name, rule)
_UL_SPEC: tuple[tuple[str, str, str], ...] = (
    ("siren", "siren", "key"),
    ("statutDiffusionUniteLegale", "statut_diffusion", "text"),
    ("unitePurgeeUniteLegale", "unite_purgee", "bool"),
    ("dateCreationUniteLegale", "data_criacao", "date"),
    ("sigleUniteLegale", "sigla", "text"),
    ("sexeUniteLegale", "sexo", "text"),
    ("prenom1UniteLegale", "prenome_1", "text"),
    ("prenom2UniteLegale", "prenome_2", "text"),
    ("prenom3UniteLegale", "prenome_3", "text"),
    ("prenom4UniteLegale", "prenome_4", "text"),
    ("prenomUsuelUniteLegale", "prenome_usual", "text"),
    ("pseudonymeUniteLegale", "pseudonimo", "text"),
    ("identifiantAssociationUniteLegale", "identificador_associacao", "text"),
    ("trancheEffectifsUniteLegale", "faixa_efetivos", "text"),
    ("anneeEffectifsUniteLegale", "ano_efetivos", "int"),
    ("dateDernierTraitementUniteLegale", "data_ultimo_tratamento", "text"),
    ("nombrePeriodesUniteLegale", "numero_periodos", "int"),
    ("categorieEntreprise", "categoria_empresa", "text"),
    ("anneeCategorieEntreprise", "ano_categoria_empresa", "int"),
    ("dateDebut", "data_inicio_periodo", "date"),
    ("etatAdministratifUniteLegale", "situacao", "text"),
    ("nomUniteLegale", "nome", "text"),
    ("nomUsageUniteLegale", "nome_uso", "text"),
    ("denominationUniteLegale", "razao_social", "text"),
    ("denominationUsuelle1UniteLegale", "nome_fantasia", "text"),
    ("denominationUsuelle2UniteLegale", "nome_fantasia_2", "text"),
    ("denominationUsuelle3UniteLegale", "nome_fantasia_3", "text"),
    ("categorieJuridiqueUniteLegale", "natureza_juridica", "text"),
    ("activitePrincipaleUniteLegale", "cod_atividade", "text"),
    ("nomenclatureActivitePrincipaleUniteLegale", "nomenclatura_atividade", "text"),
    ("nicSiegeUniteLegale", "nic_sede", "text"),
    ("economieSocialeSolidaireUniteLegale", "economia_social_solidaria", "text"),
    ("societeMissionUniteLegale", "sociedade_missao", "text"),
    ("caractereEmployeurUniteLegale", "carater_empregador", "text"),
    ("activitePrincipaleNAF25UniteLegale", "cod_atividade_naf25", "text"),
)
_ETAB_SPEC: tuple[tuple[str, str, str], ...] = (
    ("siren", "siren", "key"),
    ("nic", "nic", "key"),
    ("siret", "siret", "key"),
    ("statutDiffusionEtablissement", "statut_diffusion", "text"),
    ("dateCreationEtablissement", "data_criacao", "date"),
    ("trancheEffectifsEtablissement", "faixa_efetivos", "text"),
    ("anneeEffectifsEtablissement", "ano_efetivos", "int"),
    ("activitePrincipaleRegistreMetiersEtablissement", "cod_atividade_artesao", "text"),
    ("dateDernierTraitementEtablissement", "data_ultimo_tratamento", "text"),
    ("etablissementSiege", "eh_sede", "text"),
    ("nombrePeriodesEtablissement", "numero_periodos", "int"),
    ("complementAdresseEtablissement", "complemento_endereco", "text"),
    ("numeroVoieEtablissement", "numero_via", "text"),
    ("indiceRepetitionEtablissement", "indice_repeticao", "text"),
    ("dernierNumeroVoieEtablissement", "ultimo_numero_via", "text"),
    ("indiceRepetitionDernierNumeroVoieEtablissement", "indice_repeticao_ultimo_numero", "text"),
    ("typeVoieEtablissement", "tipo_via", "text"),
    ("libelleVoieEtablissement", "logradouro", "text"),
    ("codePostalEtablissement", "cep", "text"),
    ("libelleCommuneEtablissement", "municipio", "text"),
    ("libelleCommuneEtrangerEtablissement", "municipio_exterior", "text"),
    ("distributionSpecialeEtablissement", "distribuicao_especial", "text"),
    ("codeCommuneEtablissement", "codigo_municipio", "text"),
    ("codeCedexEtablissement", "codigo_cedex", "text"),
    ("libelleCedexEtablissement", "cedex", "text"),
    ("codePaysEtrangerEtablissement", "codigo_pais_exterior", "text"),
    ("libellePaysEtrangerEtablissement", "pais_exterior", "text"),
    ("identifiantAdresseEtablissement", "identificador_endereco", "text"),
    ("coordonneeLambertAbscisseEtablissement", "coordenada_lambert_x", "text"),
    ("coordonneeLambertOrdonneeEtablissement", "coordenada_lambert_y", "text"),
    ("dateDebut", "data_inicio_periodo", "date"),
    ("etatAdministratifEtablissement", "situacao", "text"),
    ("enseigne1Etablissement", "nome_fantasia", "text"),
    ("enseigne2Etablissement", "nome_fantasia_2", "text"),
    ("enseigne3Etablissement", "nome_fantasia_3", "text"),
    ("denominationUsuelleEtablissement", "denominacao_usual", "text"),
    ("activitePrincipaleEtablissement", "cod_atividade", "text"),
    ("nomenclatureActivitePrincipaleEtablissement", "nomenclatura_atividade", "text"),
    ("caractereEmployeurEtablissement", "carater_empregador", "text"),
    ("activitePrincipaleNAF25Etablissement", "cod_atividade_naf25", "text"),
)


def _apply_spec(raw: DataFrame, spec, status_col: str, only: set[str] | None = None) -> DataFrame:
    out: list[Column] = []
    for header, name, rule in spec:
        if only is not None and name not in only and header != status_col:
            continue
        c = header  # by name: raw fields take the cheap strip path
        if rule == "key":
            e = F.coalesce(N.strip(c), F.lit(""))
        elif rule == "date":
            e = N.parse_iso_date(c)
        elif rule == "int":
            e = N.try_int(c)
        elif rule == "bool":
            e = N.true_or_blank(c)
        else:
            e = N.blank_to_null(c)
        out.append(e.alias(name))
        if header == status_col:
            out.append(N.restricted_flag(F.col(c)).alias("flag_difusao_restrita"))
    return raw.select(*out)


# Fields the canonical mapping (M2) reads; ingest parses only these.
UL_MAPPED = {
    "siren", "statut_diffusion", "data_criacao", "sigla", "prenome_1", "prenome_usual",
    "data_ultimo_tratamento", "categoria_empresa", "situacao", "nome", "razao_social",
    "nome_fantasia", "natureza_juridica", "cod_atividade",
}
ETAB_MAPPED = {
    "siren", "siret", "statut_diffusion", "data_criacao", "cep", "municipio", "situacao",
    "nome_fantasia", "cod_atividade",
}


def parse_unite_legale(raw: DataFrame, only: set[str] | None = None) -> DataFrame:
    """P20 for legal units: every layout field typed (or just ``only``)."""
    return _apply_spec(raw, _UL_SPEC, "statutDiffusionUniteLegale", only)


def parse_etablissement(raw: DataFrame, only: set[str] | None = None) -> DataFrame:
    """P20 for establishments: every layout field typed (or just ``only``)."""
    return _apply_spec(raw, _ETAB_SPEC, "statutDiffusionEtablissement", only)


# -- J1: the Brazil join -----------------------------------------------------------------


def br_joined(
    estab: DataFrame,
    empresas: DataFrame,
    simples: DataFrame | None,
    municipio: DataFrame,
    natureza: DataFrame,
    *,
    company_first: bool = True,
) -> DataFrame:
    """Raw (all-text) staging tables -> one typed row per establishment.

    Same column rules as the registry SQL: ``NULLIF(x, '')`` without trimming,
    ``yyyyMMdd`` dates with 0/00000000/blank -> NULL, comma decimals -> decimal(18,2).
    ``simples`` is optional: it adds two columns the canonical mapping ignores.
    ``company_first=False`` joins the two company-side tables one after the other, for
    inputs that need no shuffle (buckets, broadcasts).
    """
    e = estab.alias("e")
    em = empresas.select(
        F.col("cnpj_basico").alias("em_cnpj_basico"),
        F.col("razao_social").alias("em_razao_social"),
        F.col("natureza_juridica").alias("em_natureza_juridica"),
        F.col("capital_social").alias("em_capital_social"),
        F.col("porte_empresa").alias("em_porte_empresa"),
    )
    if simples is not None:
        # Company-side tables are combined first (FULL OUTER on the company key gives
        # exactly what two chained LEFT joins would, fan-out included), so the large
        # establishment side meets ONE join: AQE can then split a company holding a
        # third of all establishments across tasks, which it cannot do for the
        # second join of a same-key chain.
        s = simples.select(
            F.col("cnpj_basico").alias("s_cnpj_basico"),
            F.col("opcao_pelo_simples").alias("s_opcao_pelo_simples"),
            F.col("opcao_pelo_mei").alias("s_opcao_pelo_mei"),
        )
        if not company_first:
            j = e.join(em, F.col("e.cnpj_basico") == F.col("em_cnpj_basico"), "left").join(s, F.col("e.cnpj_basico") == F.col("s_cnpj_basico"), "left")
        company = em.join(s, em["em_cnpj_basico"] == s["s_cnpj_basico"], "full_outer").select(
            F.coalesce("em_cnpj_basico", "s_cnpj_basico").alias("c_key"), *[c for c in em.columns if c != "em_cnpj_basico"],
            "s_opcao_pelo_simples", "s_opcao_pelo_mei",
        )
    else:
        company = em.select(
            F.col("em_cnpj_basico").alias("c_key"), *[c for c in em.columns if c != "em_cnpj_basico"],
            F.lit(None).cast("string").alias("s_opcao_pelo_simples"), F.lit(None).cast("string").alias("s_opcao_pelo_mei"),
        )
    if company_first or simples is None:
        j = e.join(company, F.col("e.cnpj_basico") == F.col("c_key"), "left")
    # Code tables: Spark broadcasts them by their bytes (file statistics, or AQE's
    # runtime sizes); nothing is counted while the plan is built.
    mun = municipio.select(F.col("codigo").alias("mun_codigo"), F.col("descricao").alias("mun_descricao"))
    nat = natureza.select(F.col("codigo").alias("nat_codigo"), F.col("descricao").alias("nat_descricao"))
    j = j.join(mun, F.col("e.municipio") == F.col("mun_codigo"), "left")
    j = j.join(nat, F.col("em_natureza_juridica") == F.col("nat_codigo"), "left")

    def nn(name: str) -> Column:
        return N.blank_to_null(F.col(name), trim=False)

    return j.select(
        F.col("e.cnpj_basico").alias("cnpj_basico"),
        F.concat("e.cnpj_basico", "e.cnpj_ordem", "e.cnpj_dv").alias("cnpj_completo"),
        nn("e.nome_fantasia").alias("nome_fantasia"),
        nn("e.situacao_cadastral").alias("situacao_cadastral"),
        N.parse_yyyymmdd(F.col("e.data_inicio_atividade")).alias("data_inicio_atividade"),
        nn("e.cnae_fiscal_principal").alias("cnae_fiscal_principal"),
        nn("e.uf").alias("uf"),
        nn("e.municipio").alias("municipio_codigo"),
        F.col("mun_descricao").alias("municipio_descricao"),
        nn("e.cep").alias("cep"),
        nn("e.ddd_1").alias("ddd_1"),
        nn("e.telefone_1").alias("telefone_1"),
        nn("e.correio_eletronico").alias("correio_eletronico"),
        nn("em_razao_social").alias("razao_social"),
        nn("em_natureza_juridica").alias("natureza_juridica_codigo"),
        F.col("nat_descricao").alias("natureza_juridica_descricao"),
        N.parse_comma_decimal(F.col("em_capital_social")).alias("capital_social"),
        nn("em_porte_empresa").alias("porte_empresa"),
        nn("s_opcao_pelo_simples").alias("opcao_pelo_simples"),
        nn("s_opcao_pelo_mei").alias("opcao_pelo_mei"),
    )


def enrich_with_lookups(
    df: DataFrame,
    *,
    cnae: DataFrame | None = None,
    municipio: DataFrame | None = None,
    natureza: DataFrame | None = None,
) -> DataFrame:
    """Add ``<code>_descricao`` columns from ``codigo;descricao`` code tables.

    A description column is added only when its table is given and the input has the
    code column; an unknown code gives NULL. Duplicate codes must be resolved first
    (``sources.registry.read_lookup`` does)."""
    specs = (("cnae_fiscal_principal", cnae), ("municipio", municipio), ("natureza_juridica", natureza))
    for code, table in specs:
        if table is None or code not in df.columns:
            continue
        lk = table.select(F.col("codigo").alias(f"__lk_{code}"), F.col("descricao").alias(f"{code}_descricao"))
        df = df.join(lk, df[code] == lk[f"__lk_{code}"], "left").drop(f"__lk_{code}")
    return df


# -- M1 ---------------------------------------------------------------------------------


def _canonical(values: dict[str, Column]) -> list[Column]:
    null = F.lit(None)
    return [values.get(n, null).cast(t).alias(n) for n, t in S.CANONICAL_FIELDS]


def br_to_canonical(joined: DataFrame) -> DataFrame:
    """M1: joined BR row -> canonical columns (before contract validation)."""
    c = F.col
    return joined.select(
        *_canonical(
            {
                "pais": F.lit("BR"),
                "id_legal": c("cnpj_basico"),
                "id_estab": c("cnpj_completo"),
                "razao_social": F.coalesce(c("razao_social"), F.lit("")),
                "nome_fantasia": c("nome_fantasia"),
                "cod_atividade": c("cnae_fiscal_principal"),
                "situacao": N.map_labels("situacao_cadastral", S.SITUACAO_CADASTRAL_LABELS),
                "regiao": c("uf"),
                "municipio": N.desc_or_code("municipio_descricao", "municipio_codigo"),
                "cep": c("cep"),
                "telefone": N.compose_phone("ddd_1", "telefone_1"),
                "email": c("correio_eletronico"),
                "data_inicio_atividade": c("data_inicio_atividade"),
                "porte": N.map_labels("porte_empresa", S.PORTE_EMPRESA_LABELS),
                "capital_social": c("capital_social"),
                "natureza_juridica": N.desc_or_code(
                    "natureza_juridica_descricao", "natureza_juridica_codigo"
                ),
                "fonte": F.lit(S.FONTE_BR_RECEITA),
                "is_synthetic": F.lit(False),
                "flag_difusao_restrita": F.lit(False),
            }
        )
    )


# -- J2 / M2 -----------------------------------------------------------------------------


def latest_unite_legale(ul: DataFrame) -> DataFrame:
    """One legal unit per SIREN, the last record winning; blank SIRENs dropped.

    "Last" is made explicit and deterministic: latest ``data_ultimo_tratamento``,
    then every other column descending. Keep-first by window + ``rn = 1`` plans as a
    partial WindowGroupLimit before the shuffle, so a hot SIREN sends at most one row
    per map task."""
    ul = ul.where(F.col("siren") != "")
    order = [F.col("data_ultimo_tratamento").desc_nulls_last()] + [
        F.col(c).desc_nulls_last() for c in ul.columns if c not in ("siren", "data_ultimo_tratamento")
    ]
    return keep_first(ul, ["siren"], order)


def fr_joined(ul: DataFrame, etab: DataFrame) -> DataFrame:
    """Establishment INNER JOIN its legal unit (deduped by SIREN).

    Output columns are prefixed ``ul_``/``et_``."""
    u = latest_unite_legale(ul)
    # Join on a derived key (SIREN + separator; NULL stays NULL) rather than on the
    # column the dedupe window is partitioned by: the legal-unit side then gets its
    # own shuffle instead of reusing the window's, and with both sides coming from
    # shuffles AQE can split a SIREN holding a third of the establishments across
    # tasks (checked in tests/test_skew.py). Cost: one shuffle of the deduped legal
    # units, far smaller than the establishment side.
    u = u.select(*[F.col(c).alias(f"ul_{c}") for c in u.columns]).withColumn("__ul_key", split_key(F.col("ul_siren")))
    et = etab.select(*[F.col(c).alias(f"et_{c}") for c in etab.columns]).withColumn("__et_key", split_key(F.col("et_siren")))
    return et.join(u, F.col("__et_key") == F.col("__ul_key"), "inner").drop("__et_key", "__ul_key")


def fr_orphans(ul: DataFrame, etab: DataFrame) -> DataFrame:
    """Establishments whose SIREN has no legal unit (skipped and counted)."""
    keys = ul.where(F.col("siren") != "").select(split_key(F.col("siren")).alias("__k")).distinct()
    return etab.join(keys, split_key(etab["siren"]) == keys["__k"], "left_anti")


def fr_to_canonical(joined: DataFrame) -> DataFrame:
    """M2: (legal unit, establishment) pair -> canonical columns.

    The establishment wins for status, activity, trade name and start date; the
    restricted flag is the OR of both sides."""
    c = F.col
    situacao_code = F.coalesce(c("et_situacao"), c("ul_situacao"))
    name = F.coalesce(
        c("ul_razao_social"),
        N.person_name("ul_prenome_usual", "ul_prenome_1", "ul_nome"),
        F.lit(""),
    )
    return joined.select(
        *_canonical(
            {
                "pais": F.lit("FR"),
                "id_legal": F.coalesce(F.nullif(c("et_siren"), F.lit("")), F.nullif(c("ul_siren"), F.lit("")), F.lit("")),
                "id_estab": c("et_siret"),
                "razao_social": name,
                "nome_fantasia": F.coalesce(c("et_nome_fantasia"), c("ul_sigla"), c("ul_nome_fantasia")),
                "cod_atividade": F.coalesce(c("et_cod_atividade"), c("ul_cod_atividade")),
                "situacao": N.map_labels(situacao_code, S.ETAT_ADMINISTRATIF_LABELS),
                "regiao": N.departement_from_postcode("et_cep"),
                "municipio": c("et_municipio"),
                "cep": c("et_cep"),
                "data_inicio_atividade": F.coalesce(c("et_data_criacao"), c("ul_data_criacao")),
                "porte": c("ul_categoria_empresa"),
                "natureza_juridica": c("ul_natureza_juridica"),
                "fonte": F.lit(S.FONTE_FR_SIRENE),
                "is_synthetic": F.lit(False),
                "flag_difusao_restrita": F.coalesce(c("ul_flag_difusao_restrita"), F.lit(False))
                | F.coalesce(c("et_flag_difusao_restrita"), F.lit(False)),
            }
        )
    )


# -- M3: OpenCNPJ JSON payloads ------------------------------------------------------------

OPENCNPJ_SCHEMA = T.StructType(
    [
        T.StructField("cnpj", T.StringType()),
        T.StructField("situacaoCadastral", T.StringType()),
        T.StructField("razaoSocial", T.StringType()),
        T.StructField("nomeFantasia", T.StringType()),
        T.StructField("dataInicioAtividades", T.StringType()),
        T.StructField("naturezaJuridica", T.StringType()),
        T.StructField("capitalSocial", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("telefone", T.StringType()),
        T.StructField("municipio", T.StringType()),
        T.StructField("uf", T.StringType()),
        T.StructField("cep", T.StringType()),
        T.StructField(
            "cnaes",
            T.ArrayType(
                T.StructType(
                    [T.StructField("cnae", T.StringType()), T.StructField("descricao", T.StringType())]
                )
            ),
        ),
    ]
)


def opencnpj_to_canonical(payloads: DataFrame, json_col: str | None = "payload") -> DataFrame:
    """M3: OpenCNPJ documents -> canonical columns (before validation).

    ``json_col`` names a column of JSON text; ``None`` means the rows already hold
    the parsed fields (e.g. ``spark.read.schema(OPENCNPJ_SCHEMA).json(files)``)."""
    if json_col is None:
        p = payloads.select(F.struct(*[F.col(f.name) for f in OPENCNPJ_SCHEMA.fields]).alias("r"))
    else:
        p = payloads.select(F.from_json(F.col(json_col), OPENCNPJ_SCHEMA).alias("r"))
    cnpj = F.coalesce(N.only_digits("r.cnpj"), F.lit(""))
    first_cnae = F.get(F.col("r.cnaes"), 0).getField("cnae")
    return p.select(
        *_canonical(
            {
                "pais": F.lit("BR"),
                "id_legal": F.substring(cnpj, 1, 8),
                "id_estab": cnpj,
                "razao_social": F.coalesce(F.nullif(F.col("r.razaoSocial"), F.lit("")), F.lit("")),
                "nome_fantasia": F.nullif(F.col("r.nomeFantasia"), F.lit("")),
                "cod_atividade": N.only_digits(first_cnae),
                "situacao": F.nullif(F.upper(F.col("r.situacaoCadastral")), F.lit("")),
                "regiao": F.col("r.uf"),
                "municipio": F.col("r.municipio"),
                "cep": N.only_digits("r.cep"),
                "telefone": N.only_digits("r.telefone"),
                "email": N.lower_or_null("r.email"),
                "data_inicio_atividade": N.parse_ddmmyyyy("r.dataInicioAtividades"),
                "capital_social": N.try_decimal("r.capitalSocial"),
                "natureza_juridica": N.strip_trailing_code(F.coalesce(F.col("r.naturezaJuridica"), F.lit(""))),
                "fonte": F.lit(S.FONTE_OPENCNPJ),
                "is_synthetic": F.lit(False),
                "flag_difusao_restrita": F.lit(False),
            }
        )
    )


# -- M4: contract --------------------------------------------------------------------------


def contract_columns(df: DataFrame, *, already_stripped: bool = False) -> DataFrame:
    """Strip every text column (the contract strips all strings) and compute
    ``reject_reason`` (NULL for a valid row). ``already_stripped`` skips the strip
    for inputs built only from stripped fields and literals."""
    stripped = [
        (N.strip(F.col(n)).alias(n) if t == T.StringType() and not already_stripped else F.col(n))
        for n, t in S.CANONICAL_FIELDS
    ]
    df = df.select(*stripped)
    reason = F.when(~F.coalesce(F.col("pais").isin(*S.ALLOWED_PAIS), F.lit(False)), F.lit("pais"))
    for n in S.REQUIRED_TEXT_COLUMNS:
        reason = reason.when(F.coalesce(F.length(n), F.lit(0)) == 0, F.lit(f"{n} vazio"))
    return df.withColumn("reject_reason", reason)


def enforce_contract(df: DataFrame, *, already_stripped: bool = False) -> tuple[DataFrame, DataFrame]:
    """M4: ``(valid, rejected)``. Valid rows have exactly the canonical columns with
    booleans defaulted to False; rejected rows keep ``reject_reason``. Both are lazy
    filters of one projection, so writing both in one job scans the input once."""
    checked = contract_columns(df, already_stripped=already_stripped)
    valid = checked.where(F.col("reject_reason").isNull()).select(
        *[
            (F.coalesce(F.col(n), F.lit(False)).alias(n) if n in ("is_synthetic", "flag_difusao_restrita") else F.col(n))
            for n in S.CANONICAL_COLUMNS
        ]
    )
    rejected = checked.where(F.col("reject_reason").isNotNull())
    return valid, rejected
