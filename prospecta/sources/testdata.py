"""Registry-shaped raw tables derived from the driver's parquet test tables.

The driver ships order/customer style tables; every job here expects registry dumps.
These functions derive, with plain column expressions, the same
all-text staging tables a registry load produces (blank fields are ``''`` exactly as
a headerless CSV gives them). The DuckDB twins in ``prospecta.oracle`` use the same
rules, so both engines start from identical inputs.

Derivation rules (``P(e, n)`` = ``lpad(cast(e as string), n, '0')``):

* empresas <- customer; estabelecimentos <- orders; simples <- supplier;
  municipio / natureza lookups <- nation;
* FR unite_legale <- supplier; FR etablissement <- lineitem;
* demo leads <- part; suppression list <- leads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta import schema as S
from prospecta.functions.normalize import lpad_code as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _blank() -> Column:
    return F.lit("")


def _case(c: Column, mapping: dict, default: Column | str | None = "") -> Column:
    """``CASE c WHEN k THEN v ... ELSE default END`` from a small literal dict."""
    expr = None
    for k, v in mapping.items():
        cond = c == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    d = default if isinstance(default, Column) else F.lit(default)
    return expr.otherwise(d)


def _fill_layout(df: DataFrame, columns: tuple[str, ...], fill: Column | None = None) -> DataFrame:
    """Project ``columns`` in layout order; missing ones become ``fill`` (``''``)."""
    have = set(df.columns)
    fill = _blank() if fill is None else fill
    return df.select(*[F.col(c) if c in have else fill.alias(c) for c in columns])


# -- Brazil -------------------------------------------------------------------------


def staging_empresas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    capital = (
        F.when(k % 41 == 3, F.lit(""))
        .when(k % 43 == 4, F.lit("N/A"))
        .when(k % 47 == 6, F.concat((F.lit(15_000_000) + k).cast("string"), F.lit(",50")))
        .otherwise(
            F.replace(F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
        )
    )
    out = c.select(
        P(k, 8).alias("cnpj_basico"),
        F.when(k % 37 == 5, F.lit("")).otherwise(F.upper("c_name")).alias("razao_social"),
        P("c_nationkey", 4).alias("natureza_juridica"),
        capital.alias("capital_social"),
        _case(
            F.col("c_mktsegment"),
            {"BUILDING": "01", "MACHINERY": "03", "FURNITURE": "05", "AUTOMOBILE": "00"},
        ).alias("porte_empresa"),
    )
    return _fill_layout(out, S.EMPRESAS_COLUMNS)


def _p(e: str, n: int) -> str:
    return f"lpad(CAST({e} AS STRING), greatest({n}, length(CAST({e} AS STRING))), '0')"


# Establishment columns from ``orders`` as Spark SQL expressions: a 30-column
# layout becomes one ``selectExpr`` call.
_ESTAB_SQL = {
    "cnpj_basico": f"CASE WHEN o_orderkey % 53 = 7 THEN concat('9', {_p('o_custkey', 7)}) ELSE {_p('o_custkey', 8)} END",
    "cnpj_ordem": _p("o_orderkey % 10000", 4),
    "cnpj_dv": _p("o_orderkey % 97", 2),
    "nome_fantasia": "concat('LOJA ', CAST(o_orderkey AS STRING))",
    "situacao_cadastral": "CASE o_orderstatus WHEN 'O' THEN '02' WHEN 'F' THEN '08' ELSE '03' END",
    "data_inicio_atividade": (
        "CASE WHEN o_orderkey % 11 = 0 THEN '00000000' WHEN o_orderkey % 89 = 0 THEN 'INVALIDA' "
        "ELSE date_format(o_orderdate, 'yyyyMMdd') END"
    ),
    "cnae_fiscal_principal": (
        "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN '8630501' WHEN '2' THEN '4721102' "
        "WHEN '3' THEN '6201501' WHEN '4' THEN '5611203' ELSE '' END"
    ),
    "cnae_fiscal_secundaria": (
        "CASE WHEN o_orderkey % 3 = 0 THEN '4722901,4729699' WHEN o_orderkey % 3 = 1 THEN '' ELSE '6201501, ,5611203' END"
    ),
    "uf": "CASE o_orderkey % 6 WHEN 0 THEN 'SP' WHEN 1 THEN 'RJ' WHEN 2 THEN 'MG' WHEN 3 THEN 'BA' WHEN 4 THEN 'PR' ELSE '' END",
    "municipio": _p("o_orderkey % 30", 4),
    "cep": _p("o_orderkey % 100000", 8),
    "ddd_1": "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '11' END",
    "telefone_1": f"CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE {_p('o_orderkey', 8)} END",
    "correio_eletronico": (
        "CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 101 = 1 THEN 'sem-arroba' "
        "ELSE concat('Contato', CAST(o_orderkey AS STRING), '@Empresa', CAST(o_orderkey % 4000 AS STRING), '.com.br') END"
    ),
}


def staging_estabelecimentos(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    blank = "''"
    return o.selectExpr(*[f"{_ESTAB_SQL.get(c, blank)} AS {c}" for c in S.ESTABELECIMENTOS_COLUMNS])


def staging_simples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    out = s.select(
        P(k, 8).alias("cnpj_basico"),
        _case(k % 3, {0: "S", 1: "N"}).alias("opcao_pelo_simples"),
        _case(k % 2, {0: "S"}, "N").alias("opcao_pelo_mei"),
    )
    return _fill_layout(out, S.SIMPLES_COLUMNS)


def lookup_municipio(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(P("n_nationkey", 4).alias("codigo"), F.col("n_name").alias("descricao"))


def lookup_natureza_juridica(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of nations 20+ are shifted out of the customer code range, so some
    companies have a legal-form code with no description (description falls back)."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    code = F.when(k >= 20, k + 1000).otherwise(k)
    return n.select(
        P(code, 4).alias("codigo"), F.concat(F.lit("NATUREZA "), F.col("n_name")).alias("descricao")
    )


# -- France -------------------------------------------------------------------------


def fr_unite_legale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIRENE legal units, all text, header names of the official layout.

    Suppliers with key % 23 = 6 get a SIREN no establishment uses, so their
    establishments become orphans (no row is dropped)."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    null = F.lit(None).cast("string")
    out = s.select(
        F.when(k % 23 == 6, F.concat(F.lit("8"), P(k, 8))).otherwise(P(k, 9)).alias("siren"),
        F.when(k % 17 == 2, F.lit("P")).otherwise(F.lit("O")).alias("statutDiffusionUniteLegale"),
        F.when(k % 13 == 4, null).otherwise(F.upper("s_name")).alias("denominationUniteLegale"),
        F.when(k % 26 == 4, F.lit("DUPONT")).otherwise(null).alias("nomUniteLegale"),
        _case(k % 3, {0: "PME", 1: "ETI"}, null).alias("categorieEntreprise"),
        F.lit("5710").alias("categorieJuridiqueUniteLegale"),
    )
    return _fill_layout(out, S.UNITE_LEGALE_COLUMNS, F.lit(None).cast("string"))


def fr_etablissement(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    null = F.lit(None).cast("string")
    siren = P("l_suppkey", 9)
    pk = F.col("l_partkey")
    out = li.select(
        siren.alias("siren"),
        P((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 100000, 5).alias("nic"),
        F.concat(siren, P((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 100000, 5)).alias("siret"),
        _case(F.col("l_returnflag"), {"N": "O", "R": "P"}, null).alias("statutDiffusionEtablissement"),
        F.col("l_shipdate").cast("date").cast("string").alias("dateCreationEtablissement"),
        F.when(pk % 19 == 0, F.lit("AB123"))
        .otherwise(F.concat(P(pk % 95 + 1, 2), F.lit("001")))
        .alias("codePostalEtablissement"),
        F.concat(F.lit("COMMUNE "), (pk % 50).cast("string")).alias("libelleCommuneEtablissement"),
        F.when(F.col("l_linestatus") == "O", F.lit("A")).otherwise(F.lit("F")).alias("etatAdministratifEtablissement"),
        _case(F.col("l_linenumber") % 3, {0: "62.01Z", 1: "10.71C"}, "47.11D").alias("activitePrincipaleEtablissement"),
    )
    return _fill_layout(out, S.ETABLISSEMENT_COLUMNS, null)


# -- Demo rows and opt-out list --------------------------------------------------------


def demo_leads_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic (``is_synthetic``) canonical rows, one per part."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    null = F.lit(None)
    cols = {
        "pais": F.when(k % 2 == 0, F.lit("BR")).otherwise(F.lit("FR")),
        "id_legal": P(k, 8),
        "id_estab": P(k, 14),
        "razao_social": F.upper("p_name"),
        "cod_atividade": F.lit("8630501"),
        "situacao": F.lit("ATIVA"),
        "regiao": F.lit("SP"),
        "email": F.concat(F.lit("demo"), k.cast("string"), F.lit("@demo.test")),
        "data_inicio_atividade": F.lit("2020-01-01").cast("date"),
        "porte": F.lit("DEMAIS"),
        "capital_social": F.col("p_retailprice"),
        "fonte": F.lit(S.FONTE_DEMO),
        "is_synthetic": F.lit(True),
        "flag_difusao_restrita": F.lit(False),
    }
    return p.select(
        *[cols.get(n, null).cast(t).alias(n) for n, t in S.CANONICAL_FIELDS]
    )


def suppression_list_from_leads(leads: DataFrame) -> DataFrame:
    """Opt-out rows derived from leads: ids whose 8th character is ``3`` and
    e-mails (lower case) starting with ``contato1``; same columns as the CSV."""
    ids = leads.where(F.substring("id_estab", 8, 1) == "3").select(
        F.col("id_estab"), F.lit("").alias("email")
    )
    mails = leads.where(F.lower("email").startswith("contato1")).select(
        F.lit("").alias("id_estab"), F.lower("email").alias("email")
    )
    return ids.unionByName(mails).select(
        "id_estab", "email", F.lit("opt-out").alias("motivo"), F.lit("").alias("registrado_em")
    )


# -- JSON payloads (landed API responses) ---------------------------------------------------


def _estab_id(k: Column, cust: Column) -> Column:
    return F.concat(P(cust, 8), P(k % 10000, 4), P(k % 97, 2))


def opencnpj_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One OpenCNPJ-style JSON document per order (establishment)."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "left")
    k = F.col("o_orderkey")
    digits = _estab_id(k, F.col("o_custkey"))
    fmt = F.concat(
        F.substring(digits, 1, 2), F.lit("."), F.substring(digits, 3, 3), F.lit("."), F.substring(digits, 6, 3),
        F.lit("/"), F.substring(digits, 9, 4), F.lit("-"), F.substring(digits, 13, 2),
    )
    d = F.col("o_orderdate")
    date_txt = (
        F.when(k % 89 == 0, F.lit("31/02/2020"))
        .when(k % 13 == 0, F.lit("1/2/2020"))
        .otherwise(F.date_format(d, "dd/MM/yyyy"))
    )
    code = _case(F.substring("o_orderpriority", 1, 1), {"1": "8630501", "2": "4721102", "3": "6201501", "4": "5611203"}, None)
    cnae_fmt = F.concat(F.substring(code, 1, 4), F.lit("-"), F.substring(code, 5, 1), F.lit("/"), F.substring(code, 6, 2))
    tel = P(k, 8)
    doc = F.struct(
        fmt.alias("cnpj"),
        _case(F.col("o_orderstatus"), {"O": "Ativa", "F": "Baixada"}).alias("situacaoCadastral"),
        F.when(F.col("c_custkey") % 37 == 5, F.lit("")).otherwise(F.col("c_name")).alias("razaoSocial"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("Loja "), k.cast("string"))).alias("nomeFantasia"),
        date_txt.alias("dataInicioAtividades"),
        F.when(F.col("c_custkey") % 15 == 0, F.lit(""))
        .when(F.col("c_custkey") % 2 == 0, F.lit("Sociedade Empresaria Limitada (2062)"))
        .otherwise(F.lit("Empresario Individual (2135)"))
        .alias("naturezaJuridica"),
        F.col("c_acctbal").alias("capitalSocial"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("Contato@Empresa"), (k % 4000).cast("string"), F.lit(".COM.BR"))).alias("email"),
        F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("(11) "), F.substring(tel, 1, 4), F.lit("-"), F.substring(tel, 5, 4))).alias("telefone"),
        F.lit("SAO PAULO").alias("municipio"),
        _case(k % 6, {0: "SP", 1: "RJ", 2: "MG", 3: "BA", 4: "PR"}).alias("uf"),
        F.concat(F.lit("01"), P(k % 1000, 3), F.lit("-000")).alias("cep"),
        F.when(code.isNull(), F.array().cast("array<struct<cnae:string,descricao:string>>"))
        .otherwise(F.array(F.struct(cnae_fmt.alias("cnae"), F.lit("ATIVIDADE").alias("descricao"))))
        .alias("cnaes"),
    )
    return j.select(F.to_json(doc).alias("payload"))


def brasilapi_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One BrasilAPI-style response per order (establishment)."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    code = _case(F.substring("o_orderpriority", 1, 1), {"1": "8630501", "2": "4721102", "3": "6201501", "4": "5611203"}, None)
    doc = F.struct(
        _estab_id(k, F.col("o_custkey")).alias("cnpj"),
        F.when(k % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("EMPRESA "), F.col("o_custkey").cast("string"))).alias("razao_social"),
        F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Loja Nova "), k.cast("string"))).alias("nome_fantasia"),
        F.lit("Sociedade Empresaria Limitada").alias("natureza_juridica"),
        F.when(k % 17 == 0, F.lit("abc")).otherwise(F.col("o_totalprice").cast("string")).alias("capital_social"),
        _case(k % 3, {0: "Micro Empresa", 1: " Demais "}).alias("porte"),
        _case(k % 6, {0: "SP", 1: "RJ", 2: "MG", 3: "BA", 4: "PR"}).alias("uf"),
        P(k % 100000, 8).alias("cep"),
        F.when(k % 2 == 0, F.lit("SAO PAULO")).otherwise(F.lit("")).alias("municipio"),
        code.cast("bigint").alias("cnae_fiscal"),
        F.when(k % 89 == 0, F.lit("invalida")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("data_inicio_atividade"),
        _case(F.col("o_orderstatus"), {"O": "Ativa", "F": "Baixada"}, " suspensa ").alias("descricao_situacao_cadastral"),
        F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("11"), P(k, 8))).alias("ddd_telefone_1"),
    )
    return o.select(F.to_json(doc).alias("payload"))


def recherche_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search response per supplier (SIREN); key % 11 = 0 finds nothing; every
    hit carries a second, unrelated result that must be ignored."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    siren = P(k, 9)
    null = F.lit(None).cast("string")
    first = F.struct(
        siren.alias("siren"),
        F.col("s_name").alias("nom_complet"),
        F.when(k % 5 == 0, null).otherwise(F.upper("s_name")).alias("nom_raison_sociale"),
        F.when(k % 3 == 0, F.concat(F.lit("SGL"), k.cast("string"))).otherwise(null).alias("sigle"),
        F.lit("62.01Z").alias("activite_principale"),
        F.concat(F.lit("2015-03-0"), (k % 9 + 1).cast("string")).alias("date_creation"),
        _case(k % 4, {0: "A", 1: "F", 2: "c"}, null).alias("etat_administratif"),
        F.lit("5710").alias("nature_juridique"),
        _case(k % 6, {0: "P", 1: None}, "O").alias("statut_diffusion"),
        F.struct(
            F.concat(P(k % 95 + 1, 2), F.lit("100")).alias("code_postal"),
            F.concat(siren, F.lit("00011")).alias("siret"),
            F.concat(F.lit("PARIS "), (k % 20).cast("string")).alias("libelle_commune"),
        ).alias("siege"),
    )
    other = first.withField("siren", F.lit("999999999")).withField("nom_raison_sociale", F.lit("OUTRA"))
    none = F.filter(F.array(first), lambda x: F.lit(False))  # empty, same element type
    doc = F.struct(F.when(k % 11 == 0, none).otherwise(F.array(first, other)).alias("results"))
    return s.select(siren.alias("siren"), F.to_json(doc).alias("payload"))


def landed_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed XML files (``url``, ``body``) from ``pages``: a sub-map per page with as many
    ids as its size asks for (some ids twice), and index files of 50 sub-maps each."""
    p = table(spark, sf_dir, "pages").select("page_id", (F.length("html") % 97 + 3).cast("bigint").alias("n"))
    url = F.concat(F.lit("https://maps.example/sub-"), P("page_id", 6), F.lit(".xml"))
    ids = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda j: F.concat(F.lit("<loc>https://site.example/office/"), P(F.col("page_id") * 1000 + j - F.when(j % 5 == 4, 2).otherwise(0), 14), F.lit("</loc>")))
    subs = p.select(url.alias("url"), F.concat(F.lit("<urlset>"), F.array_join(ids, "\n"), F.lit("</urlset>")).alias("body"))
    entry = F.concat(F.lit("<loc>"), url, F.lit("</loc>\n<lastmod>2024-01-01</lastmod>\n<!--"), F.col("n").cast("string"), F.lit("-->"))
    index = p.select((F.col("page_id") / 50).cast("bigint").alias("part"), entry.alias("e")).groupBy("part").agg(F.array_join(F.sort_array(F.collect_list("e")), "\n").alias("body"))
    return subs.unionByName(index.select(F.concat(F.lit("https://maps.example/index-"), F.col("part").cast("string"), F.lit(".xml")).alias("url"), "body"))
