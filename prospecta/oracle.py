"""DuckDB SQL twins of the registered queries (the correctness oracle).

Written independently of the Spark code: plain SQL over the driver's views
(region nation customer supplier part orders lineitem events ...). The registry
adapter is a chain of CTEs mirroring ``prospecta.sources.testdata``.
"""

from __future__ import annotations

from prospecta import params as PR
from prospecta import schema as S


def _p(e: str, n: int) -> str:
    return f"lpad(CAST({e} AS VARCHAR), CAST(greatest({n}, length(CAST({e} AS VARCHAR))) AS INTEGER), '0')"


def _layout(values: dict[str, str], columns: tuple[str, ...], fill: str = "''") -> str:
    return ",\n  ".join(f"{values.get(c, fill)} AS {c}" for c in columns)


_EMPRESAS = {
    "cnpj_basico": _p("c_custkey", 8),
    "razao_social": "CASE WHEN c_custkey % 37 = 5 THEN '' ELSE upper(c_name) END",
    "natureza_juridica": _p("c_nationkey", 4),
    "capital_social": (
        "CASE WHEN c_custkey % 41 = 3 THEN '' WHEN c_custkey % 43 = 4 THEN 'N/A' "
        "WHEN c_custkey % 47 = 6 THEN CAST(15000000 + c_custkey AS VARCHAR) || ',50' "
        "ELSE replace(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), '.', ',') END"
    ),
    "porte_empresa": (
        "CASE c_mktsegment WHEN 'BUILDING' THEN '01' WHEN 'MACHINERY' THEN '03' "
        "WHEN 'FURNITURE' THEN '05' WHEN 'AUTOMOBILE' THEN '00' ELSE '' END"
    ),
}
_ESTAB = {
    "cnpj_basico": f"CASE WHEN o_orderkey % 53 = 7 THEN '9' || {_p('o_custkey', 7)} ELSE {_p('o_custkey', 8)} END",
    "cnpj_ordem": _p("o_orderkey % 10000", 4),
    "cnpj_dv": _p("o_orderkey % 97", 2),
    "nome_fantasia": "'LOJA ' || CAST(o_orderkey AS VARCHAR)",
    "situacao_cadastral": "CASE o_orderstatus WHEN 'O' THEN '02' WHEN 'F' THEN '08' ELSE '03' END",
    "data_inicio_atividade": (
        "CASE WHEN o_orderkey % 11 = 0 THEN '00000000' WHEN o_orderkey % 89 = 0 THEN 'INVALIDA' "
        "ELSE strftime(o_orderdate, '%Y%m%d') END"
    ),
    "cnae_fiscal_principal": (
        "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '8630501' WHEN '2' THEN '4721102' "
        "WHEN '3' THEN '6201501' WHEN '4' THEN '5611203' ELSE '' END"
    ),
    "cnae_fiscal_secundaria": (
        "CASE WHEN o_orderkey % 3 = 0 THEN '4722901,4729699' WHEN o_orderkey % 3 = 1 THEN '' "
        "ELSE '6201501, ,5611203' END"
    ),
    "uf": "CASE o_orderkey % 6 WHEN 0 THEN 'SP' WHEN 1 THEN 'RJ' WHEN 2 THEN 'MG' WHEN 3 THEN 'BA' WHEN 4 THEN 'PR' ELSE '' END",
    "municipio": _p("o_orderkey % 30", 4),
    "cep": _p("o_orderkey % 100000", 8),
    "ddd_1": "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '11' END",
    "telefone_1": f"CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE {_p('o_orderkey', 8)} END",
    "correio_eletronico": (
        "CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 101 = 1 THEN 'sem-arroba' "
        "ELSE 'Contato' || CAST(o_orderkey AS VARCHAR) || '@Empresa' || CAST(o_orderkey % 4000 AS VARCHAR) || '.com.br' END"
    ),
}
_SIMPLES = {
    "cnpj_basico": _p("s_suppkey", 8),
    "opcao_pelo_simples": "CASE s_suppkey % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'N' ELSE '' END",
    "opcao_pelo_mei": "CASE WHEN s_suppkey % 2 = 0 THEN 'S' ELSE 'N' END",
}


def _canon(values: dict[str, str]) -> str:
    types = {
        "data_inicio_atividade": "DATE",
        "capital_social": "DOUBLE",
        "score_icp": "DOUBLE",
        "enriquecido_em": "TIMESTAMP",
        "is_synthetic": "BOOLEAN",
        "flag_difusao_restrita": "BOOLEAN",
    }
    return ",\n  ".join(
        f"CAST({values.get(n, 'NULL')} AS {types.get(n, 'VARCHAR')}) AS {n}" for n in S.CANONICAL_COLUMNS
    )


_SIT = "CASE {c} WHEN '01' THEN 'NULA' WHEN '02' THEN 'ATIVA' WHEN '03' THEN 'SUSPENSA' WHEN '04' THEN 'INAPTA' WHEN '08' THEN 'BAIXADA' ELSE {c} END"
_PORTE = "CASE {c} WHEN '00' THEN 'NAO INFORMADO' WHEN '01' THEN 'MICRO EMPRESA' WHEN '03' THEN 'EMPRESA DE PEQUENO PORTE' WHEN '05' THEN 'DEMAIS' ELSE {c} END"

_VALID = (
    "pais IN ('BR', 'FR') AND length(coalesce(trim(id_legal), '')) > 0 AND length(coalesce(trim(id_estab), '')) > 0 "
    "AND length(coalesce(trim(razao_social), '')) > 0 AND length(coalesce(trim(fonte), '')) > 0"
)
_REASON = (
    "CASE WHEN NOT coalesce(pais IN ('BR', 'FR'), false) THEN 'pais' "
    "WHEN length(coalesce(trim(id_legal), '')) = 0 THEN 'id_legal vazio' "
    "WHEN length(coalesce(trim(id_estab), '')) = 0 THEN 'id_estab vazio' "
    "WHEN length(coalesce(trim(razao_social), '')) = 0 THEN 'razao_social vazio' "
    "WHEN length(coalesce(trim(fonte), '')) = 0 THEN 'fonte vazio' END"
)

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (sql, deps)


cte("staging_empresas", f"SELECT\n  {_layout(_EMPRESAS, S.EMPRESAS_COLUMNS)}\nFROM customer")
cte("staging_estabelecimentos", f"SELECT\n  {_layout(_ESTAB, S.ESTABELECIMENTOS_COLUMNS)}\nFROM orders")
cte("staging_simples", f"SELECT\n  {_layout(_SIMPLES, S.SIMPLES_COLUMNS)}\nFROM supplier")
cte("lookup_municipio", f"SELECT {_p('n_nationkey', 4)} AS codigo, n_name AS descricao FROM nation")
cte(
    "lookup_natureza",
    f"SELECT {_p('CASE WHEN n_nationkey >= 20 THEN n_nationkey + 1000 ELSE n_nationkey END', 4)} AS codigo, "
    "'NATUREZA ' || n_name AS descricao FROM nation",
)
def _txt(c: str) -> str:
    return f"CASE WHEN length({c}) > 0 THEN {c} END"


# Written from the field rules: each table is cleaned by itself, then the cleaned tables meet.
cte(
    "br_unit",
    "SELECT cnpj_basico AS root, concat_ws('', cnpj_basico, cnpj_ordem, cnpj_dv) AS full_id, municipio AS town, "
    + ", ".join(f"{_txt(c)} AS {c}" for c in ("nome_fantasia", "situacao_cadastral", "cnae_fiscal_principal", "uf", "cep", "ddd_1", "telefone_1", "correio_eletronico"))
    + ", CASE WHEN regexp_full_match(data_inicio_atividade, '[0-9]{8}') AND data_inicio_atividade <> '00000000' "
    "THEN TRY_CAST(substr(data_inicio_atividade, 1, 4) || '-' || substr(data_inicio_atividade, 5, 2) || '-' || substr(data_inicio_atividade, 7, 2) AS DATE) END AS opened FROM staging_estabelecimentos",
    "staging_estabelecimentos",
)
cte(
    "br_firm",
    f"SELECT cnpj_basico AS root, natureza_juridica AS form, {_txt('razao_social')} AS legal_name, {_txt('porte_empresa')} AS size_code, "
    "TRY_CAST(replace(capital_social, ',', '.') AS DECIMAL(18, 2)) AS capital FROM staging_empresas",
    "staging_empresas",
)
cte(
    "br_regime",
    f"SELECT cnpj_basico AS root, {_txt('opcao_pelo_simples')} AS simples, {_txt('opcao_pelo_mei')} AS mei FROM staging_simples",
    "staging_simples",
)
cte(
    "br_joined",
    "SELECT u.root AS cnpj_basico, u.full_id AS cnpj_completo, f.legal_name AS razao_social, u.nome_fantasia, "
    "f.capital AS capital_social, f.size_code AS porte_empresa, u.situacao_cadastral, u.opened AS data_inicio_atividade, "
    "u.cnae_fiscal_principal, u.uf, u.cep, u.ddd_1, u.telefone_1, u.correio_eletronico, "
    f"{_txt('u.town')} AS municipio_codigo, towns.descricao AS municipio_descricao, "
    f"{_txt('f.form')} AS natureza_juridica_codigo, forms.descricao AS natureza_juridica_descricao, "
    "g.simples AS opcao_pelo_simples, g.mei AS opcao_pelo_mei "
    "FROM br_unit u LEFT JOIN (br_firm f LEFT JOIN lookup_natureza forms ON forms.codigo = f.form) ON f.root = u.root "
    "LEFT JOIN br_regime g ON g.root = u.root LEFT JOIN lookup_municipio towns ON towns.codigo = u.town",
    "br_unit",
    "br_firm",
    "br_regime",
    "lookup_municipio",
    "lookup_natureza",
)
cte(
    "br_mapped",
    "SELECT\n  "
    + _canon(
        {
            "pais": "'BR'",
            "id_legal": "trim(cnpj_basico)",
            "id_estab": "trim(cnpj_completo)",
            "razao_social": "trim(coalesce(razao_social, ''))",
            "nome_fantasia": "trim(nome_fantasia)",
            "cod_atividade": "trim(cnae_fiscal_principal)",
            "situacao": "trim(" + _SIT.format(c="situacao_cadastral") + ")",
            "regiao": "trim(uf)",
            "municipio": "trim(coalesce(NULLIF(municipio_descricao, ''), municipio_codigo))",
            "cep": "trim(cep)",
            "telefone": "trim(NULLIF(coalesce(ddd_1, '') || coalesce(telefone_1, ''), ''))",
            "email": "trim(correio_eletronico)",
            "data_inicio_atividade": "data_inicio_atividade",
            "porte": "trim(" + _PORTE.format(c="porte_empresa") + ")",
            "capital_social": "capital_social",
            "natureza_juridica": "trim(coalesce(NULLIF(natureza_juridica_descricao, ''), natureza_juridica_codigo))",
            "fonte": "'BR_RECEITA'",
            "is_synthetic": "false",
            "flag_difusao_restrita": "false",
        }
    )
    + "\nFROM br_joined",
    "br_joined",
)
cte("br_valid", f"SELECT * FROM br_mapped WHERE {_VALID}", "br_mapped")
cte(
    "fr_ul",
    f"""SELECT
  CASE WHEN s_suppkey % 23 = 6 THEN '8' || {_p('s_suppkey', 8)} ELSE {_p('s_suppkey', 9)} END AS siren,
  CASE WHEN s_suppkey % 17 = 2 THEN 'P' ELSE 'O' END AS statut,
  CASE WHEN s_suppkey % 13 = 4 THEN NULL ELSE upper(s_name) END AS razao_social,
  CASE WHEN s_suppkey % 26 = 4 THEN 'DUPONT' END AS nome,
  CASE s_suppkey % 3 WHEN 0 THEN 'PME' WHEN 1 THEN 'ETI' END AS categoria,
  '5710' AS natureza,
  upper(trim(coalesce(CASE WHEN s_suppkey % 17 = 2 THEN 'P' ELSE 'O' END, ''))) <> 'O' AS flag
FROM supplier""",
)
cte(
    "fr_et",
    f"""SELECT
  {_p('l_suppkey', 9)} AS siren,
  {_p('l_suppkey', 9)} || {_p('(l_orderkey * 7 + l_linenumber) % 100000', 5)} AS siret,
  CASE l_returnflag WHEN 'N' THEN 'O' WHEN 'R' THEN 'P' END AS statut,
  CAST(l_shipdate AS DATE) AS data_criacao,
  CASE WHEN l_partkey % 19 = 0 THEN 'AB123' ELSE {_p('l_partkey % 95 + 1', 2)} || '001' END AS cep,
  'COMMUNE ' || CAST(l_partkey % 50 AS VARCHAR) AS municipio,
  CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'F' END AS situacao,
  CASE l_linenumber % 3 WHEN 0 THEN '62.01Z' WHEN 1 THEN '10.71C' ELSE '47.11D' END AS cod_atividade,
  upper(trim(coalesce(CASE l_returnflag WHEN 'N' THEN 'O' WHEN 'R' THEN 'P' END, ''))) <> 'O' AS flag
FROM lineitem""",
)
cte(
    "fr_mapped",
    "SELECT\n  "
    + _canon(
        {
            "pais": "'FR'",
            "id_legal": "et.siren",
            "id_estab": "et.siret",
            "razao_social": "trim(coalesce(ul.razao_social, NULLIF(concat_ws(' ', ul.nome), ''), ''))",
            "cod_atividade": "et.cod_atividade",
            "situacao": "CASE et.situacao WHEN 'A' THEN 'ATIVA' WHEN 'F' THEN 'BAIXADA' ELSE et.situacao END",
            "regiao": "CASE WHEN regexp_matches(substr(et.cep, 1, 2), '^[0-9]{2}$') THEN substr(et.cep, 1, 2) END",
            "municipio": "et.municipio",
            "cep": "et.cep",
            "data_inicio_atividade": "et.data_criacao",
            "porte": "ul.categoria",
            "natureza_juridica": "ul.natureza",
            "fonte": "'FR_SIRENE'",
            "is_synthetic": "false",
            "flag_difusao_restrita": "(ul.flag OR et.flag)",
        }
    )
    + "\nFROM fr_et et JOIN fr_ul ul ON et.siren = ul.siren",
    "fr_et",
    "fr_ul",
)
cte("fr_valid", f"SELECT * FROM fr_mapped WHERE {_VALID}", "fr_mapped")
cte(
    "demo",
    "SELECT\n  "
    + _canon(
        {
            "pais": "CASE WHEN p_partkey % 2 = 0 THEN 'BR' ELSE 'FR' END",
            "id_legal": _p("p_partkey", 8),
            "id_estab": _p("p_partkey", 14),
            "razao_social": "upper(p_name)",
            "cod_atividade": "'8630501'",
            "situacao": "'ATIVA'",
            "regiao": "'SP'",
            "email": "'demo' || CAST(p_partkey AS VARCHAR) || '@demo.test'",
            "data_inicio_atividade": "DATE '2020-01-01'",
            "porte": "'DEMAIS'",
            "capital_social": "p_retailprice",
            "fonte": "'DEMO'",
            "is_synthetic": "true",
            "flag_difusao_restrita": "false",
        }
    )
    + "\nFROM part",
)
cte("real_leads", "SELECT * FROM br_valid UNION ALL SELECT * FROM fr_valid", "br_valid", "fr_valid")
cte("leads", "SELECT * FROM real_leads UNION ALL SELECT * FROM demo", "real_leads", "demo")
cte(
    "optout_ids",
    "SELECT DISTINCT id_estab AS k FROM leads WHERE substr(id_estab, 8, 1) = '3'",
    "leads",
)
cte(
    "optout_emails",
    "SELECT DISTINCT lower(email) AS k FROM leads WHERE starts_with(lower(email), 'contato1')",
    "leads",
)



def _as_text(name: str, kind: str) -> str:
    if kind == "double":
        name = f"TRY_CAST(round({name} * 100) AS BIGINT)"
    elif kind.startswith("timestamp"):
        name = f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f')"
    return f"coalesce(CAST({name} AS VARCHAR), chr(1))"


#: Arrival order: the order keys, then the md5 of the row's text.
_ORDER_FIRST = "razao_social NULLS FIRST, id_estab NULLS FIRST, email NULLS FIRST, md5(concat_ws(chr(2), " + ", ".join(
    _as_text(n, t.simpleString()) for n, t in S.CANONICAL_FIELDS
) + "))"
_DOMAIN = "CASE WHEN contains(email, '@') THEN NULLIF(lower(trim(split_part(email, '@', -1))), '') END"

cte("g_hard", "SELECT * FROM leads WHERE NOT (coalesce(is_synthetic, false) OR coalesce(flag_difusao_restrita, false))", "leads")
cte(
    "g_id",
    f"SELECT * FROM g_hard QUALIFY id_estab IS NULL OR row_number() OVER (PARTITION BY id_estab ORDER BY {_ORDER_FIRST}) = 1",
    "g_hard",
)
cte(
    "g_domain",
    f"SELECT * FROM g_id QUALIFY {_DOMAIN} IS NULL OR row_number() OVER (PARTITION BY {_DOMAIN} ORDER BY {_ORDER_FIRST}) = 1",
    "g_id",
)
cte(
    "g_out",
    "SELECT * FROM g_domain g WHERE NOT EXISTS (SELECT 1 FROM optout_ids o WHERE o.k = g.id_estab) "
    "AND NOT EXISTS (SELECT 1 FROM optout_emails o WHERE o.k = lower(g.email))",
    "g_domain",
    "optout_ids",
    "optout_emails",
)


def with_(*names: str) -> str:
    """``WITH`` clause holding ``names`` and everything they depend on, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS (\n{CTES[n][0]}\n)" for n in order) + "\n"


# -- criteria -> SQL ---------------------------------------------------------------------


def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def crit_sql(c, *, demo: bool = False, exclusions: bool = True) -> str:
    parts: list[str] = []
    if exclusions:
        parts.append("flag_difusao_restrita = false")
        if not demo:
            parts.append("is_synthetic = false")

    def eq(col: str, v, upper: bool) -> None:
        if v is None:
            return
        vals = [v] if isinstance(v, str) else list(v)
        if not vals:
            return
        vals = [x.upper() if upper else x for x in vals]
        parts.append(f"{col} IN ({', '.join(_q(x) for x in vals)})")

    eq("pais", c.pais, True)
    eq("cod_atividade", c.cod_atividade, False)
    eq("regiao", c.regiao, True)
    eq("porte", c.porte, True)
    eq("situacao", c.situacao, True)
    if c.aberta_apos is not None:
        parts.append(f"data_inicio_atividade >= DATE '{c.aberta_apos.isoformat()}'")
    if c.com_email:
        parts.append("email IS NOT NULL")
    if c.com_telefone:
        parts.append("telefone IS NOT NULL")
    if c.capital_social_min is not None:
        parts.append(f"capital_social >= {float(c.capital_social_min)}")
    if c.capital_social_max is not None:
        parts.append(f"capital_social <= {float(c.capital_social_max)}")
    return " AND ".join(parts) if parts else "true"


def _order_last(first: list[str]) -> str:
    cols = first + [c for c in S.CANONICAL_COLUMNS if c not in first]
    return ", ".join(f"{c} NULLS LAST" for c in cols)


# -- scoring ------------------------------------------------------------------------------


def _signals_sql() -> dict[str, str]:
    cfg = PR.SCORING
    today = f"DATE '{PR.TODAY.isoformat()}'"
    mx = cfg.recencia_dias_max
    acts = ", ".join(_q(a) for a in sorted(cfg.atividades_alvo))
    regs = ", ".join(_q(r.upper()) for r in sorted(cfg.regioes_alvo))
    pres_e = "coalesce(email, '') <> ''"
    pres_t = "coalesce(telefone, '') <> ''"
    days = f"greatest(date_diff('day', data_inicio_atividade, {today}), 0)"
    return {
        "contato": f"CASE WHEN {pres_e} AND {pres_t} THEN 1.0 WHEN {pres_e} OR {pres_t} THEN 0.5 ELSE 0.0 END",
        "atividade": f"CASE WHEN cod_atividade IN ({acts}) THEN 1.0 ELSE 0.0 END",
        "porte_capital": "0.0",
        "recencia": (
            f"CASE WHEN data_inicio_atividade IS NULL THEN 0.0 WHEN {days} >= {mx} THEN 0.0 "
            f"ELSE 1.0 - CAST({days} AS DOUBLE) / {float(mx)} END"
        ),
        "regiao": f"CASE WHEN upper(regiao) IN ({regs}) THEN 1.0 ELSE 0.0 END",
    }


def _score_sql() -> str:
    cfg = PR.SCORING
    sig = _signals_sql()
    from prospecta.operators.score import SIGNALS

    app = [s for s in SIGNALS if cfg.applicable(s)]
    den = sum(cfg.weight(s) for s in app)
    num = " + ".join(f"{cfg.weight(s)} * CAST({sig[s]} AS DOUBLE)" for s in app)
    return (
        "CASE WHEN coalesce(upper(situacao) = 'ATIVA', false) "
        f"THEN round(({num}) / {den} * 100.0, 2) ELSE 0.0 END"
    )


def _with_score(src: str) -> str:
    cols = ", ".join(c if c != "score_icp" else f"CAST({_score_sql()} AS DOUBLE) AS score_icp" for c in S.CANONICAL_COLUMNS)
    return f"SELECT {cols} FROM {src}"


# -- the oracle queries -------------------------------------------------------------------

_A2_COLS = ", ".join(
    f"CAST(sum(CASE WHEN {c} IS NULL OR {c} = '' THEN 1 ELSE 0 END) AS BIGINT) AS {c}" for c in S.ESTABELECIMENTOS_COLUMNS
)


def _sanity_sql() -> str:
    cols = S.EMPRESAS_COLUMNS
    sums = ", ".join(
        f"CAST(sum(CASE WHEN {c} IS NULL OR {c} = '' THEN 1 ELSE 0 END) AS BIGINT) AS a{i}" for i, c in enumerate(cols)
    )
    unions = " UNION ALL ".join(f"SELECT '{c}' AS coluna, a{i} AS n_ausentes, n_linhas FROM cnt" for i, c in enumerate(cols))
    return (
        with_("staging_empresas")
        + f", cnt AS (SELECT count(*) AS n_linhas, {sums} FROM staging_empresas), "
        "dups AS (SELECT count(*) AS chaves_duplicadas FROM (SELECT cnpj_basico FROM staging_empresas GROUP BY cnpj_basico HAVING count(*) > 1)), "
        f"lng AS ({unions}) "
        "SELECT 'staging_empresas' AS tabela, coluna, n_ausentes, n_linhas, chaves_duplicadas FROM lng, dups"
    )


def _quality_report_sql() -> str:
    cols = S.DEFAULT_NULL_CHECK_COLUMNS
    known = ", ".join(_q(v) for v in S.SITUACAO_CADASTRAL_LABELS.values())
    ratios = ", ".join(f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS r_{c}" for c in cols)
    return (
        with_("real_leads")
        + ", b AS (SELECT count(*) AS n_rows, "
        f"count(DISTINCT CASE WHEN situacao IS NOT NULL AND situacao NOT IN ({known}) THEN situacao END) AS n_situacao_fora_dominio, {ratios} FROM real_leads), "
        "d AS (SELECT count(*) AS duplicate_id_estab FROM (SELECT id_estab FROM real_leads GROUP BY id_estab HAVING count(*) > 1)) "
        f"SELECT n_rows, round(greatest({', '.join('r_' + c for c in cols)}), 6) AS max_null_ratio, n_situacao_fora_dominio, duplicate_id_estab, "
        "CAST((CASE WHEN n_rows < 1 THEN 1 ELSE 0 END) + (CASE WHEN n_rows > 0 AND n_situacao_fora_dominio > 0 THEN 1 ELSE 0 END) "
        "+ (CASE WHEN n_rows > 0 AND duplicate_id_estab > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failures, "
        "((CASE WHEN n_rows < 1 THEN 1 ELSE 0 END) + (CASE WHEN n_rows > 0 AND n_situacao_fora_dominio > 0 THEN 1 ELSE 0 END) "
        "+ (CASE WHEN n_rows > 0 AND duplicate_id_estab > 0 THEN 1 ELSE 0 END)) = 0 AS passed FROM b, d"
    )


def _gate_report_sql() -> str:
    return (
        with_("g_out")
        + "SELECT (SELECT count(*) FROM leads) AS n_in, "
        "(SELECT count(*) FROM leads) - (SELECT count(*) FROM g_hard) AS n_hard_excluded, "
        "(SELECT count(*) FROM g_hard) - (SELECT count(*) FROM g_id) AS n_deduped_id_estab, "
        "(SELECT count(*) FROM g_id) - (SELECT count(*) FROM g_domain) AS n_deduped_email_domain, "
        "(SELECT count(*) FROM g_domain) - (SELECT count(*) FROM g_out) AS n_suppressed, "
        "(SELECT count(*) FROM g_out) AS n_out"
    )


def _panel_sql() -> str:
    # Default criteria: the raw (ICP-only) set is the whole leads table, which is
    # exactly the gate input, so the gate CTEs answer the panel.
    return (
        with_("g_out")
        + "SELECT (SELECT count(*) FROM leads) AS total_bruto, "
        "(SELECT count(*) FROM leads WHERE coalesce(is_synthetic, false)) AS n_sinteticos, "
        "(SELECT count(*) FROM leads WHERE coalesce(flag_difusao_restrita, false)) AS n_difusao_restrita, "
        "(SELECT count(*) FROM g_hard) - (SELECT count(*) FROM g_domain) AS n_duplicados, "
        "(SELECT count(*) FROM g_domain) - (SELECT count(*) FROM g_out) AS n_opt_out, "
        "(SELECT count(*) FROM g_out) AS total_exportavel"
    )


def _signals_query() -> str:
    sig = _signals_sql()
    fr = ", ".join(f"round(CAST({sig[s]} AS DOUBLE), 6) AS f_{s}" for s in ("contato", "atividade", "porte_capital", "recencia", "regiao"))
    return (
        with_("real_leads")
        + f"SELECT pais, id_estab, NOT coalesce(upper(situacao) = 'ATIVA', false) AS vetado, {fr}, "
        f"CAST({_score_sql()} AS DOUBLE) AS score_icp FROM real_leads"
    )


def _point_lookup_sql() -> str:
    k = PR.POINT_ID_ORDERKEY
    pid = f"(SELECT {_p('o_custkey', 8)} || {_p('o_orderkey % 10000', 4)} || {_p('o_orderkey % 97', 2)} FROM orders WHERE o_orderkey = {k})"
    return with_("leads") + f"SELECT * FROM leads WHERE {crit_sql(PR.CRIT_DEFAULT)} AND id_estab IN {pid}"


def queries() -> dict[str, str]:
    L = with_("leads")
    R = with_("real_leads")
    out: dict[str, str] = {
        "br_joined": with_("br_joined") + "SELECT * FROM br_joined",
        "br_joined_bucketed": with_("br_joined") + "SELECT * FROM br_joined",
        "br_canonical": with_("br_valid") + "SELECT * FROM br_valid",
        "br_rejects": with_("br_mapped") + f"SELECT id_legal, id_estab, {_REASON} AS reject_reason FROM br_mapped WHERE NOT ({_VALID})",
        "fr_canonical": with_("fr_valid") + "SELECT * FROM fr_valid",
        "fr_orphans": with_("fr_et", "fr_ul") + "SELECT siren, siret FROM fr_et et WHERE NOT EXISTS (SELECT 1 FROM fr_ul u WHERE u.siren = et.siren)",
        "leads_union": L + "SELECT * FROM leads",
        "secondary_cnae": with_("staging_estabelecimentos")
        + "SELECT cnpj_basico || cnpj_ordem || cnpj_dv AS cnpj_completo, "
        "CAST(len(list_filter(list_transform(string_split(cnae_fiscal_secundaria, ','), lambda x: trim(x)), lambda x: x <> '')) AS BIGINT) AS n_cnae_secundaria, "
        "array_to_string(list_filter(list_transform(string_split(cnae_fiscal_secundaria, ','), lambda x: trim(x)), lambda x: x <> ''), ',') AS cnae_secundaria "
        "FROM staging_estabelecimentos",
        "preview_top": L + f"SELECT * FROM leads WHERE {crit_sql(PR.CRIT_PREVIEW)} ORDER BY {_order_last(['razao_social', 'id_estab'])} LIMIT {PR.PREVIEW_LIMIT}",
        "preview_tam": L + f"SELECT count(*) AS tam FROM leads WHERE {crit_sql(PR.CRIT_PREVIEW)}",
        "export_query": L + f"SELECT * FROM leads WHERE {crit_sql(PR.CRIT_EXPORT)}",
        "lead_point_lookup": _point_lookup_sql(),
        "text_search": L
        + f"SELECT * FROM leads WHERE {crit_sql(PR.CRIT_DEFAULT)} AND (contains(lower(razao_social), {_q(PR.SEARCH_TEXT)}) "
        f"OR contains(lower(coalesce(nome_fantasia, '')), {_q(PR.SEARCH_TEXT)}) OR contains(id_estab, {_q(PR.SEARCH_TEXT)}))",
        "demo_preview": L + f"SELECT * FROM leads WHERE {crit_sql(PR.CRIT_DEMO, demo=True)}",
        "null_counts": with_("staging_estabelecimentos") + f"SELECT {_A2_COLS} FROM staging_estabelecimentos",
        "dup_keys": with_("staging_estabelecimentos")
        + "SELECT count(*) AS duplicate_keys FROM (SELECT cnpj_basico FROM staging_estabelecimentos GROUP BY cnpj_basico HAVING count(*) > 1)",
        "distribution": with_("staging_estabelecimentos")
        + "SELECT coalesce(CAST(situacao_cadastral AS VARCHAR), 'None') AS valor, count(*) AS n FROM staging_estabelecimentos GROUP BY 1",
        "sanity_report": _sanity_sql(),
        "quality_null_ratio": R
        + "SELECT "
        + ", ".join(f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS {c}" for c in S.DEFAULT_NULL_CHECK_COLUMNS)
        + " FROM real_leads",
        "quality_domain": R
        + "SELECT coalesce(situacao, '(nulo)') AS situacao, count(*) AS n, "
        f"coalesce(situacao, '(nulo)') NOT IN ({', '.join(_q(v) for v in S.SITUACAO_CADASTRAL_LABELS.values())}, '(nulo)') AS fora_do_dominio "
        "FROM real_leads GROUP BY 1",
        "quality_dups": R + "SELECT count(*) AS duplicate_id_estab FROM (SELECT id_estab FROM real_leads GROUP BY id_estab HAVING count(*) > 1)",
        "quality_report": _quality_report_sql(),
        "quality_summaries": _quality_report_sql(),
        "chart_regiao": L
        + f"SELECT coalesce(regiao, '(sem valor)') AS valor, count(*) AS n FROM leads WHERE {crit_sql(PR.CRIT_DEFAULT)} GROUP BY 1 ORDER BY n DESC, valor LIMIT 15",
        "chart_atividade": L
        + f"SELECT coalesce(cod_atividade, '(sem valor)') AS valor, count(*) AS n FROM leads WHERE {crit_sql(PR.CRIT_DEFAULT)} GROUP BY 1 ORDER BY n DESC, valor LIMIT 15",
        "tam_cube": L
        + f"SELECT cod_atividade, regiao, porte, CAST(GROUPING(cod_atividade, regiao, porte) AS BIGINT) AS grouping_id, count(*) AS n "
        f"FROM leads WHERE {crit_sql(PR.CRIT_PREVIEW)} GROUP BY CUBE (cod_atividade, regiao, porte)",
        "tam_cube_companies": L
        + "SELECT cod_atividade, regiao, porte, CAST(GROUPING(cod_atividade, regiao, porte) AS BIGINT) AS grouping_id, count(DISTINCT pais || '|' || id_legal) AS n_empresas, count(*) AS n "
        f"FROM leads WHERE {crit_sql(PR.CRIT_PREVIEW)} GROUP BY CUBE (cod_atividade, regiao, porte)",
        "compliance_panel": _panel_sql(),
        "gate_hard": with_("g_hard") + "SELECT * FROM g_hard",
        "gate_id": with_("g_id") + "SELECT * FROM g_id",
        "gate_domain": with_("g_domain") + "SELECT * FROM g_domain",
        "gate_optout": with_("leads", "optout_ids", "optout_emails")
        + "SELECT * FROM leads g WHERE NOT EXISTS (SELECT 1 FROM optout_ids o WHERE o.k = g.id_estab) "
        "AND NOT EXISTS (SELECT 1 FROM optout_emails o WHERE o.k = lower(g.email))",
        "gate_full": with_("g_out") + "SELECT * FROM g_out",
        "gate_report": _gate_report_sql(),
        "email_domains": L + f"SELECT {_DOMAIN} AS dominio, count(*) AS n FROM leads GROUP BY 1",
        "score_signals": _signals_query(),
        "score_icp": R + _with_score("real_leads"),
        "score_topk": L
        + f"SELECT * FROM ({_with_score('leads')}) s WHERE {crit_sql(PR.CRIT_DEFAULT)} "
        f"ORDER BY score_icp DESC NULLS LAST, {_order_last(['razao_social', 'id_estab'])} LIMIT {PR.TOPK}",
    }
    for name, c in (
        ("filter_pais", PR.CRIT_PAIS),
        ("filter_atividade", PR.CRIT_ATIVIDADE),
        ("filter_regiao", PR.CRIT_REGIAO),
        ("filter_porte", PR.CRIT_PORTE),
        ("filter_situacao", PR.CRIT_SITUACAO),
        ("filter_capital", PR.CRIT_CAPITAL),
        ("filter_aberta_apos", PR.CRIT_ABERTA),
        ("filter_contato", PR.CRIT_CONTATO),
        ("filter_composite", PR.CRIT_COMPOSITE),
    ):
        out[name] = L + f"SELECT * FROM leads WHERE {crit_sql(c)}"
    return out


# ===================================================================================
# Second batch: payloads, opt-out maintenance, audit, cache, ledger, CSV round trips
# ===================================================================================

_DIGITS = f"{_p('o_custkey', 8)} || {_p('o_orderkey % 10000', 4)} || {_p('o_orderkey % 97', 2)}"
_CODE = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '8630501' WHEN '2' THEN '4721102' WHEN '3' THEN '6201501' WHEN '4' THEN '5611203' END"
_UF = "CASE o_orderkey % 6 WHEN 0 THEN 'SP' WHEN 1 THEN 'RJ' WHEN 2 THEN 'MG' WHEN 3 THEN 'BA' WHEN 4 THEN 'PR' ELSE '' END"
_ENRICH_AT = f"TIMESTAMP '{PR.ENRICH_AT}'"


def _opencnpj_sql() -> str:
    vals = {
        "pais": "'BR'",
        "id_legal": f"substr({_DIGITS}, 1, 8)",
        "id_estab": _DIGITS,
        "razao_social": "trim(coalesce(CASE WHEN c_custkey % 37 = 5 THEN '' ELSE c_name END, ''))",
        "nome_fantasia": "NULLIF(CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Loja ' || CAST(o_orderkey AS VARCHAR) END, '')",
        "cod_atividade": _CODE,
        "situacao": "NULLIF(upper(CASE o_orderstatus WHEN 'O' THEN 'Ativa' WHEN 'F' THEN 'Baixada' ELSE '' END), '')",
        "regiao": _UF,
        "municipio": "'SAO PAULO'",
        "cep": f"'01' || {_p('o_orderkey % 1000', 3)} || '000'",
        "telefone": f"CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE '11' || {_p('o_orderkey', 8)} END",
        "email": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'contato@empresa' || CAST(o_orderkey % 4000 AS VARCHAR) || '.com.br' END",
        "data_inicio_atividade": "CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN DATE '2020-02-01' ELSE CAST(o_orderdate AS DATE) END",
        "capital_social": "CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS DOUBLE)",
        "natureza_juridica": (
            "CASE WHEN c_custkey % 15 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Sociedade Empresaria Limitada' "
            "ELSE 'Empresario Individual' END"
        ),
        "fonte": "'BR_OPENCNPJ'",
        "is_synthetic": "false",
        "flag_difusao_restrita": "false",
    }
    return (
        f"WITH m AS (SELECT {_canon(vals)} FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey) "
        f"SELECT * FROM m WHERE {_VALID}"
    )


_UPD = ("razao_social", "nome_fantasia", "cod_atividade", "situacao", "regiao", "municipio", "cep", "telefone",
        "data_inicio_atividade", "porte", "capital_social", "natureza_juridica", "flag_difusao_restrita", "fonte", "enriquecido_em")
_UPD_T = {"data_inicio_atividade": "DATE", "capital_social": "DOUBLE", "flag_difusao_restrita": "BOOLEAN", "enriquecido_em": "TIMESTAMP"}


def _upd_cols(vals: dict[str, str]) -> str:
    return ", ".join(f"CAST({vals.get(c, 'NULL')} AS {_UPD_T.get(c, 'VARCHAR')}) AS {c}" for c in _UPD)


def _brasilapi_sql() -> str:
    vals = {
        "razao_social": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'EMPRESA ' || CAST(o_custkey AS VARCHAR) END",
        "nome_fantasia": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Loja Nova ' || CAST(o_orderkey AS VARCHAR) END",
        "cod_atividade": _CODE,
        "situacao": "CASE o_orderstatus WHEN 'O' THEN 'ATIVA' WHEN 'F' THEN 'BAIXADA' ELSE 'SUSPENSA' END",
        "regiao": f"NULLIF({_UF}, '')",
        "municipio": "CASE WHEN o_orderkey % 2 = 0 THEN 'SAO PAULO' END",
        "cep": _p("o_orderkey % 100000", 8),
        "telefone": f"CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE '11' || {_p('o_orderkey', 8)} END",
        "data_inicio_atividade": "CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
        "porte": "CASE o_orderkey % 3 WHEN 0 THEN 'MICRO EMPRESA' WHEN 1 THEN 'DEMAIS' END",
        "capital_social": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(18, 2)) AS DOUBLE) END",
        "natureza_juridica": "'SOCIEDADE EMPRESARIA LIMITADA'",
        "fonte": "'BRASILAPI'",
        "enriquecido_em": _ENRICH_AT,
    }
    return f"SELECT {_DIGITS} AS cnpj, {_upd_cols(vals)} FROM orders"


_RECH_VALS = {
    "razao_social": "CASE WHEN s_suppkey % 5 = 0 THEN s_name ELSE upper(s_name) END",
    "nome_fantasia": "CASE WHEN s_suppkey % 3 = 0 THEN 'SGL' || CAST(s_suppkey AS VARCHAR) END",
    "cod_atividade": "'62.01Z'",
    "situacao": "CASE s_suppkey % 4 WHEN 0 THEN 'ATIVA' WHEN 1 THEN 'BAIXADA' WHEN 2 THEN 'C' END",
    "regiao": _p("s_suppkey % 95 + 1", 2),
    "municipio": "'PARIS ' || CAST(s_suppkey % 20 AS VARCHAR)",
    "cep": f"{_p('s_suppkey % 95 + 1', 2)} || '100'",
    "data_inicio_atividade": "CAST('2015-03-0' || CAST(s_suppkey % 9 + 1 AS VARCHAR) AS DATE)",
    "natureza_juridica": "'5710'",
    "flag_difusao_restrita": "s_suppkey % 6 IN (0, 1)",
    "fonte": "'RECHERCHE_ENTREPRISES'",
    "enriquecido_em": _ENRICH_AT,
}


def _recherche_sql() -> str:
    return f"SELECT {_p('s_suppkey', 9)} AS siren, {_upd_cols(_RECH_VALS)} FROM supplier WHERE s_suppkey % 11 <> 0"


def _merge_sql() -> str:
    cols = ", ".join(
        (f"CAST(coalesce(u.{c}, l.{c}) AS {_UPD_T.get(c, 'VARCHAR')}) AS {c}" if c in _UPD else f"l.{c}")
        for c in S.CANONICAL_COLUMNS
    )
    return (
        with_("fr_valid")
        + f", u AS ({_recherche_sql()}), m AS (SELECT {cols} FROM fr_valid l LEFT JOIN u ON l.id_legal = u.siren) "
        f"SELECT * FROM m WHERE {_VALID}"
    )


def _sitemap_sql() -> str:
    page = _p("page_id", 6)
    one = _p("page_id * 1000 + j - CASE WHEN j % 5 = 4 THEN 2 ELSE 0 END", 14)
    return (
        "WITH p AS (SELECT page_id, length(html) % 97 + 3 AS n FROM pages), "
        f"best AS (SELECT page_id, n FROM p ORDER BY n DESC, {page} LIMIT 1), "
        "j AS (SELECT page_id, unnest(range(n)) AS j FROM best), "
        f"l AS (SELECT {one} AS id, j FROM j) "
        f"SELECT CAST(min(j) AS BIGINT) AS pos, id FROM l GROUP BY id ORDER BY pos LIMIT {PR.SITEMAP_N}"
    )


def _once(rel: str) -> str:
    return f"(SELECT * FROM {rel} QUALIFY id_estab IS NULL OR row_number() OVER (PARTITION BY id_estab ORDER BY {_ORDER_FIRST}) = 1)"


def _size_capital_sql() -> str:
    """Weights 20 contact, 20 size and capital, 15 recency; no target activity or region."""
    contact = "CASE WHEN coalesce(email, '') <> '' AND coalesce(telefone, '') <> '' THEN 1.0 WHEN coalesce(email, '') <> '' OR coalesce(telefone, '') <> '' THEN 0.5 ELSE 0.0 END"
    both = "((CASE WHEN upper(porte) IN ('DEMAIS', 'PME') THEN 1.0 ELSE 0.0 END) + (CASE WHEN capital_social >= 1000 AND capital_social <= 20000000 THEN 1.0 ELSE 0.0 END)) / 2.0"
    days = "greatest(date_diff('day', data_inicio_atividade, DATE '2001-08-01'), 0)"
    recent = f"CASE WHEN data_inicio_atividade IS NULL OR {days} >= 730 THEN 0.0 ELSE 1.0 - CAST({days} AS DOUBLE) / 730.0 END"
    total = f"(20.0 * CAST({contact} AS DOUBLE) + 20.0 * CAST({both} AS DOUBLE) + 15.0 * CAST({recent} AS DOUBLE)) / 55.0"
    return (
        with_("real_leads")
        + f"SELECT id_estab, round(CAST({both} AS DOUBLE), 6) AS f_porte_capital, "
        f"CASE WHEN coalesce(upper(situacao) = 'ATIVA', false) THEN round({total} * 100.0, 2) ELSE 0.0 END AS score_icp FROM real_leads"
    )


def _panel_criteria_sql() -> str:
    """The gate over the leads that meet the criteria, written from its rules."""
    return (
        with_("leads", "optout_ids", "optout_emails").rstrip()
        + ", raw AS (SELECT * FROM leads WHERE situacao = 'ATIVA' AND regiao IN ('SP', '75')), "
        "h AS (SELECT * FROM raw WHERE coalesce(is_synthetic, false) = false AND coalesce(flag_difusao_restrita, false) = false), "
        f"i AS (SELECT * FROM h QUALIFY id_estab IS NULL OR row_number() OVER (PARTITION BY id_estab ORDER BY {_ORDER_FIRST}) = 1), "
        f"d AS (SELECT * FROM i QUALIFY {_DOMAIN} IS NULL OR row_number() OVER (PARTITION BY {_DOMAIN} ORDER BY {_ORDER_FIRST}) = 1), "
        "o AS (SELECT * FROM d WHERE NOT coalesce(id_estab IN (SELECT * FROM optout_ids), false) AND NOT coalesce(lower(email) IN (SELECT * FROM optout_emails), false)) "
        "SELECT (SELECT count(*) FROM raw) AS total_bruto, (SELECT count(*) FROM raw WHERE is_synthetic) AS n_sinteticos, "
        "(SELECT count(*) FROM raw WHERE flag_difusao_restrita) AS n_difusao_restrita, "
        "(SELECT count(*) FROM h) - (SELECT count(*) FROM d) AS n_duplicados, (SELECT count(*) FROM d) - (SELECT count(*) FROM o) AS n_opt_out, "
        "(SELECT count(*) FROM o) AS total_exportavel"
    )


def _supp_existing() -> str:
    return (
        "existing AS (SELECT id_estab, '' AS email, 'opt-out' AS motivo, '' AS registrado_em FROM leads WHERE substr(id_estab, 8, 1) = '3' "
        "UNION ALL SELECT '' AS id_estab, lower(email) AS email, 'opt-out' AS motivo, '' AS registrado_em FROM leads "
        "WHERE starts_with(lower(email), 'contato1'))"
    )


def _optout_add_sql() -> str:
    return (
        with_("leads")
        + f", {_supp_existing()}, fresh AS (SELECT DISTINCT '' AS id_estab, lower(trim(email)) AS email, 'opt-out novo' AS motivo, '' AS registrado_em "
        f"FROM leads WHERE starts_with(lower(email), '{PR.OPTOUT_ADD_EMAIL_PREFIX}')) "
        "SELECT * FROM existing UNION ALL SELECT * FROM fresh f WHERE NOT EXISTS "
        "(SELECT 1 FROM existing e WHERE e.id_estab = f.id_estab AND e.email = f.email)"
    )


def _optout_remove_sql() -> str:
    return (
        with_("leads")
        + f", {_supp_existing()} SELECT * FROM existing WHERE NOT (coalesce(lower(trim(email)), '') = 'contato16@empresa16.com.br')"
    )


def _iso(at: str) -> str:
    return "'" + at.replace(" ", "T") + "+00:00'"


def _stored() -> str:
    """The list as registered at the first time: each pair once."""
    return f"stored AS (SELECT DISTINCT id_estab, email, motivo, {_iso(PR.OPTOUT_AT[0])} AS registrado_em FROM existing)"


def _optout_add_stored_sql() -> str:
    return (
        with_("leads")
        + f", {_supp_existing()}, {_stored()}, fresh AS (SELECT DISTINCT '' AS id_estab, lower(trim(email)) AS email, 'opt-out novo' AS motivo, {_iso(PR.OPTOUT_AT[1])} AS registrado_em "
        f"FROM leads l WHERE starts_with(lower(email), '{PR.OPTOUT_ADD_EMAIL_PREFIX}') "
        "AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.id_estab = '' AND s.email = lower(trim(l.email)))) "
        "SELECT *, (SELECT count(*) FROM fresh) AS n_novos FROM (SELECT * FROM stored UNION ALL SELECT * FROM fresh)"
    )


def _optout_remove_stored_sql() -> str:
    gone = f"starts_with(email, '{PR.OPTOUT_REMOVE_EMAIL_PREFIX}')"
    return (
        with_("leads")
        + f", {_supp_existing()}, {_stored()}, again AS (SELECT '' AS id_estab, min(lower(email)) AS email, 'de novo' AS motivo, {_iso(PR.OPTOUT_AT[1])} AS registrado_em "
        f"FROM leads WHERE starts_with(lower(email), '{PR.OPTOUT_REMOVE_EMAIL_PREFIX}')) "
        f"SELECT *, (SELECT count(*) FROM stored WHERE {gone}) AS n_removidos, CAST(0 AS BIGINT) AS n_de_novo, CAST(0 AS BIGINT) AS n_sem_lista "
        f"FROM (SELECT * FROM stored WHERE NOT {gone} UNION ALL SELECT * FROM again WHERE email IS NOT NULL)"
    )


def _epoch(c: str) -> str:
    return f"(CAST(epoch_us({c}) AS DOUBLE) / 1000000.0)"


def _cache_cte() -> str:
    return (
        f"cache AS (SELECT 'user:' || CAST(user_id AS VARCHAR) AS key, props AS value, {_epoch('ts')} AS created_at, "
        f"{_epoch('ts')} + {float(PR.CACHE_TTL_SECONDS)} AS expires_at FROM events)"
    )


def _cutoff() -> float:
    from datetime import UTC, datetime, timedelta

    return (datetime.fromisoformat(PR.RETENTION_NOW).replace(tzinfo=UTC) - timedelta(days=PR.RETENTION_DAYS)).timestamp()


def _retention_sql() -> str:
    return f"WITH {_cache_cte()} SELECT * FROM cache WHERE created_at >= {_cutoff()!r}"


def _freshness_sql() -> str:
    from datetime import UTC, datetime

    now = datetime.fromisoformat(PR.CACHE_NOW).replace(tzinfo=UTC).timestamp()
    return (
        f"WITH {_cache_cte()}, latest AS (SELECT * FROM cache QUALIFY row_number() OVER "
        "(PARTITION BY key ORDER BY created_at DESC, expires_at DESC, value DESC) = 1) "
        f"SELECT *, expires_at >= {now!r} AS fresco FROM latest"
    )


_LEDGER_CTES = (
    "e AS (SELECT CASE event_type WHEN 'view' THEN 'BR_RECEITA' WHEN 'click' THEN 'FR_SIRENE' ELSE 'OUTRA_' || upper(event_type) END AS fonte, "
    "strftime(ts, '%Y-%m-%d') AS competencia, ts AS run_at, value FROM events), "
    "avail AS (SELECT fonte, max(competencia) AS competencia_disponivel FROM e GROUP BY fonte), "
    "lg AS (SELECT fonte, competencia, run_at, value >= 20 AS activated FROM e WHERE value >= 5), "
    "last AS (SELECT fonte, arg_max(competencia, run_at) AS ultima_competencia, arg_max(activated, run_at) AS ultima_ativada, "
    "max(run_at) AS ultima_execucao FROM lg GROUP BY fonte)"
)


def _source_status_sql() -> str:
    known = " UNION ALL ".join(f"SELECT '{f}' AS fonte" for f in S.KNOWN_FONTES)
    return (
        f"WITH {_LEDGER_CTES}, known AS ({known}) "
        "SELECT k.fonte, l.ultima_competencia, l.ultima_execucao FROM known k LEFT JOIN last l ON k.fonte = l.fonte"
    )


def _ledger_pending_sql() -> str:
    return (
        f"WITH {_LEDGER_CTES} SELECT a.fonte, a.competencia_disponivel, l.ultima_competencia, l.ultima_ativada, "
        "(l.ultima_competencia IS NULL OR l.ultima_competencia <> a.competencia_disponivel OR NOT coalesce(l.ultima_ativada, false)) AS pendente "
        "FROM avail a LEFT JOIN last l ON a.fonte = l.fonte"
    )


def _csv_latin1_sql() -> str:
    return (
        with_("staging_empresas")
        + "SELECT trim(cnpj_basico) AS cnpj_basico, NULLIF(trim(razao_social), '') || CASE WHEN CAST(cnpj_basico AS INTEGER) % 29 = 7 "
        "THEN chr(10) || 'FILIAL;' || chr(1) || 'A' || chr(0) || 'B' ELSE '' END AS razao_social, "
        "NULLIF(trim(natureza_juridica), '') AS natureza_juridica, NULLIF(trim(qualificacao_responsavel), '') AS qualificacao_responsavel, "
        "TRY_CAST(replace(NULLIF(trim(capital_social), ''), ',', '.') AS DECIMAL(18, 2)) AS capital_social, "
        "NULLIF(trim(porte_empresa), '') AS porte_empresa, NULLIF(trim(ente_federativo_responsavel), '') AS ente_federativo_responsavel "
        "FROM staging_empresas"
    )


def _csv_malformed_sql() -> str:
    bad = "(o_orderkey % 50 = 3 OR o_orderkey % 71 = 5)"
    return (
        f"SELECT count(*) FILTER (WHERE NOT {bad}) AS n_ok, "
        f"CAST(count(*) FILTER (WHERE NOT {bad} AND o_orderkey % 13 = 2 AND o_orderkey % 11 <> 3) AS BIGINT) AS n_quoted, "
        f"CAST(count(*) FILTER (WHERE NOT {bad} AND o_orderkey % 19 = 1 AND o_orderkey % 17 <> 4) AS BIGINT) AS n_blank_first, "
        f"CAST(count(*) FILTER (WHERE NOT {bad} AND o_orderkey % 11 = 3) AS BIGINT) AS n_breaks, "
        f"CAST(count(*) FILTER (WHERE NOT {bad} AND o_orderkey % 17 = 4) AS BIGINT) AS n_control, "
        f"count(*) FILTER (WHERE {bad}) AS n_malformed FROM orders"
    )


def _fr_csv_sql() -> str:
    st = "CASE WHEN s_suppkey % 17 = 2 THEN 'P' ELSE 'O' END"
    return (
        f"SELECT CASE WHEN s_suppkey % 23 = 6 THEN '8' || {_p('s_suppkey', 8)} ELSE {_p('s_suppkey', 9)} END AS siren, "
        f"{st} AS statut_diffusion, upper({st}) <> 'O' AS flag_difusao_restrita, "
        "CASE WHEN s_suppkey % 13 = 4 THEN NULL ELSE upper(s_name) END AS razao_social, "
        "CASE WHEN s_suppkey % 26 = 4 THEN 'DUPONT' END AS nome, "
        "CASE s_suppkey % 3 WHEN 0 THEN 'PME' WHEN 1 THEN 'ETI' END AS categoria_empresa, '5710' AS natureza_juridica, "
        "false AS unite_purgee, CAST(NULL AS DATE) AS data_criacao, CAST(NULL AS INTEGER) AS ano_efetivos FROM supplier"
    )


def _csv_probe_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT 'column{i:02d}' AS coluna, count(*) FILTER (WHERE {c} <> '') AS n_nao_nulos, count(*) AS n_linhas FROM staging_estabelecimentos"
        for i, c in enumerate(S.ESTABELECIMENTOS_COLUMNS)
    )
    return with_("staging_estabelecimentos") + parts


def _export_csv_sql() -> str:
    return with_("g_out") + "SELECT " + ", ".join(S.EXPORT_COLUMNS) + " FROM g_out"


def _export_lines_sql() -> str:
    def cell(c: str) -> str:
        v = f"CAST({c} AS VARCHAR)"
        quoted = f"'\"' || replace({v}, '\"', '\"\"') || '\"'"
        return f"coalesce(CASE WHEN contains({v}, ',') OR contains({v}, '\"') THEN {quoted} ELSE {v} END, '')"

    line = " || ',' || ".join(cell(c) for c in S.EXPORT_COLUMNS)
    return with_("g_out") + f"SELECT {line} AS value FROM g_out UNION ALL SELECT '{','.join(S.EXPORT_COLUMNS)}'"


def _export_txt_sql() -> str:
    width = max(len(S.TXT_FIELD_LABELS[c]) for c in S.EXPORT_COLUMNS) + 1
    rule = "'" + "=" * 80 + "'"
    rows = [rule, "coalesce(nullif(razao_social, ''), '(sem razão social)')", rule]
    rows += [f"rpad('{S.TXT_FIELD_LABELS[c]}:', {width}, ' ') || ' ' || coalesce(nullif(CAST({c} AS VARCHAR), ''), '—')" for c in S.EXPORT_COLUMNS]
    return with_("g_out") + f"SELECT unnest([{', '.join(rows)}, '']) AS value FROM g_out UNION ALL SELECT 'Total de leads: ' || count(*) FROM g_out"


def _demo_sql(ids: str, key: str, pais: str, weighted: bool = False) -> str:
    """Demo rows by the same rules: md5 of seed|id|field, fixed shares, check digits."""
    seed, today = PR.DEMO_SEED, PR.TODAY

    def h(field: str) -> str:
        return f"CAST('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR) || '|{field}'), 1, 15) AS BIGINT)"

    def shares(field: str, pool: dict[str, int]) -> str:
        low, out = 0, "CASE"
        for v, w in pool.items():
            low += w
            out += f" WHEN {h(field)} % 1000 < {low} THEN '{v}'"
        return out + " END"

    pad = lambda field, m, n: f"lpad(CAST({h(field)} % {m} AS VARCHAR), {n}, '0')"

    def mod11(digits: str, weights: list[int]) -> str:
        total = " + ".join(f"{w} * CAST(substr({digits}, {i + 1}, 1) AS INTEGER)" for i, w in enumerate(weights))
        return f"CAST(CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END AS VARCHAR)"

    def luhn(digits: str, n: int) -> str:
        d = lambda i: f"CAST(substr({digits}, {i}, 1) AS INTEGER)"
        total = " + ".join(f"(CASE WHEN 2 * {d(i)} > 9 THEN 2 * {d(i)} - 9 ELSE 2 * {d(i)} END)" if (n - i) % 2 == 0 else d(i) for i in range(1, n + 1))
        return f"CAST((10 - ({total}) % 10) % 10 AS VARCHAR)"

    if pais == "BR":
        ufs = "['AC','AL','AP','AM','BA','CE','DF','ES','GO','MA','MT','MS','MG','PA','PB','PR','PE','PI','RJ','RN','RS','RO','RR','SC','SP','SE','TO']"
        steps = (
            f"a AS (SELECT *, {pad('raiz', 10**8, 8)} || '0001' AS d0 FROM {ids}), "
            f"b AS (SELECT *, d0 || {mod11('d0', [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])} AS d1 FROM a), "
            f"c AS (SELECT *, d1 || {mod11('d1', [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])} AS est, substr(d1, 1, 8) AS legal FROM b)"
        )
        region, cep = f"{ufs}[{h('regiao')} % {1 << 30} % 27 + 1]", pad("cep", 10**8, 8)
    else:
        steps = (
            f"a AS (SELECT *, {pad('raiz', 10**8, 8)} AS d0 FROM {ids}), b AS (SELECT *, d0 || {luhn('d0', 8)} AS legal FROM a), "
            f"b2 AS (SELECT *, legal || {pad('nic', 10**4, 4)} AS d1 FROM b), c AS (SELECT *, d1 || {luhn('d1', 13)} AS est FROM b2)"
        )
        region = f"lpad(CAST({h('regiao')} % 95 + 1 AS VARCHAR), 2, '0')"
        cep = f"{region} || {pad('cep', 1000, 3)}"
    act = shares("atividade", S.DEMO_ATIVIDADES[pais])
    if weighted:
        def drawn(dim: str, col: str, otherwise: str) -> str:
            u = f"(CAST({h('w_' + dim)} AS DOUBLE) / 1152921504606846976.0)"
            return f"coalesce((SELECT valor FROM w_{dim} w WHERE {u} * w.total >= w.high - w.peso AND {u} * w.total < w.high), {otherwise})"

        act, region = drawn("atividade", "cod_atividade", act), drawn("regiao", "regiao", region)
    return steps + f""", demo AS (SELECT '{pais}' AS pais, legal AS id_legal, est AS id_estab, 'EMPRESA DEMO ' || CAST({key} AS VARCHAR) AS razao_social,
  'FANTASIA DEMO ' || CAST({key} AS VARCHAR) AS nome_fantasia, {act} AS cod_atividade, {shares('situacao', S.DEMO_SITUACOES)} AS situacao,
  {region} AS regiao, 'CIDADE ' || CAST({h('municipio')} % 1000 AS VARCHAR) AS municipio, {cep} AS cep, {pad('telefone', 10**10, 10)} AS telefone,
  'contato' || CAST({key} AS VARCHAR) || '@demo' || CAST({h('dominio')} % 500 AS VARCHAR) || '.example' AS email,
  CAST(DATE '{today.isoformat()}' - CAST({h('abertura')} % {15 * 365} AS INTEGER) AS DATE) AS data_inicio_atividade, {shares('porte', S.DEMO_PORTES)} AS porte,
  1000.0 + CAST({h('capital')} % 49900000 AS DOUBLE) / 100.0 AS capital_social, {shares('natureza', S.DEMO_NATUREZA_JURIDICA[pais])} AS natureza_juridica,
  CAST(NULL AS DOUBLE) AS score_icp, 'DEMO' AS fonte, CAST(NULL AS TIMESTAMP) AS enriquecido_em, true AS is_synthetic, false AS flag_difusao_restrita FROM c)"""


def _demo_leads_sql() -> str:
    br, fr = _demo_sql("part", "p_partkey", "BR"), _demo_sql("supplier", "s_suppkey", "FR")
    return f"SELECT * FROM (WITH {br} SELECT * FROM demo) UNION ALL SELECT * FROM (WITH {fr} SELECT * FROM demo)"


def _weighted_sample_sql() -> str:
    w = lambda dim, col: (
        f"w_{dim} AS (SELECT valor, peso, sum(peso) OVER (ORDER BY valor) AS high, sum(peso) OVER () AS total FROM "
        f"(SELECT {col} AS valor, CAST(count(*) AS DOUBLE) AS peso FROM real_leads WHERE pais = 'BR' AND {col} <> '' GROUP BY 1))"
    )
    return with_("real_leads").rstrip() + f", {w('atividade', 'cod_atividade')}, {w('regiao', 'regiao')}, " + _demo_sql("part", "p_partkey", "BR", weighted=True) + " SELECT * FROM demo"


def _layout_sql(columns: tuple[str, ...], spec, status: str) -> str:
    """Typed fields of layout rows (seven text forms by (k + i) % 7)."""

    def raw(i: int) -> str:
        year = "lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0')"
        return (
            f"CASE (o_orderkey + {i}) % 7 WHEN 0 THEN '' WHEN 1 THEN '20' || {year} || '-03-09T10:00:00' WHEN 2 THEN CAST(o_orderkey % 1000 AS VARCHAR) "
            "WHEN 3 THEN '  t' || CAST(o_orderkey AS VARCHAR) || ' ' WHEN 4 THEN 'true' WHEN 5 THEN 'false' ELSE 'O' END"
        )

    rules = {
        "key": "trim({c})",
        "text": "nullif(trim({c}), '')",
        "date": "CASE WHEN regexp_matches({c}, '^[0-9]{{4}}-') THEN CAST(substr({c}, 1, 10) AS DATE) END",
        "int": "CASE WHEN regexp_matches({c}, '^[0-9]+$') THEN CAST({c} AS INTEGER) END",
        "bool": "{c} = 'true'",
    }
    at = {c: i for i, c in enumerate(columns)}
    cols = [f"{rules[rule].format(c='(' + raw(at[header]) + ')')} AS {name}" for header, name, rule in spec]
    return f"SELECT {', '.join(cols)}, upper(trim({raw(at[status])})) <> 'O' AS flag_difusao_restrita FROM orders"


def _parsed_sql() -> dict[str, str]:
    from prospecta.operators.mapping import _ETAB_SPEC, _UL_SPEC  # output names of the layouts

    day = lambda c: f"CASE WHEN length({c}) = 8 AND {c} <> '00000000' THEN CAST(TRY_STRPTIME({c}, '%Y%m%d') AS DATE) END AS {c}"
    simples = [f"trim({c}) AS {c}" if c == "cnpj_basico" else day(c) if c.startswith("data_") else f"nullif(trim({c}), '') AS {c}" for c in S.SIMPLES_COLUMNS]
    return {
        "unite_legale_parsed": _layout_sql(S.UNITE_LEGALE_COLUMNS, _UL_SPEC, "statutDiffusionUniteLegale"),
        "etablissement_parsed": _layout_sql(S.ETABLISSEMENT_COLUMNS, _ETAB_SPEC, "statutDiffusionEtablissement"),
        "simples_parsed": with_("staging_simples") + f"SELECT {', '.join(simples)} FROM staging_simples",
    }


def _breakdown_sql() -> str:
    from prospecta.operators.score import SIGNALS

    cfg = PR.SCORING
    sig = _signals_sql()
    active = "coalesce(upper(situacao) = 'ATIVA', false)"
    parts = []
    for s_ in SIGNALS:
        parts.append(f"CASE WHEN {active} THEN round(CAST({sig[s_]} AS DOUBLE), 6) END AS f_{s_}")
        parts.append(f"CASE WHEN {active} THEN {str(cfg.applicable(s_)).lower()} END AS a_{s_}")
    return (
        with_("real_leads")
        + f"SELECT id_estab, CAST({_score_sql()} AS DOUBLE) AS score_icp, NOT {active} AS vetado, "
        f"CAST(CASE WHEN {active} THEN {len(SIGNALS)} ELSE 0 END AS BIGINT) AS n_sinais, " + ", ".join(parts) + " FROM real_leads"
    )


def queries_batch2() -> dict[str, str]:
    return {
        "opencnpj_canonical": _opencnpj_sql(),
        "opencnpj_json_files": _opencnpj_sql(),
        "enrich_brasilapi": _brasilapi_sql(),
        "enrich_recherche": _recherche_sql(),
        "enrich_merge": _merge_sql(),
        "siren_extract": f"SELECT {_p('s_suppkey', 9)} AS siren FROM supplier WHERE s_suppkey % 11 <> 0 "
        "UNION ALL SELECT '999999999' AS siren FROM supplier WHERE s_suppkey % 11 <> 0",
        "sitemap_ids": _sitemap_sql(),
        "optout_add": _optout_add_sql(),
        "optout_remove": _optout_remove_sql(),
        "optout_add_stored": _optout_add_stored_sql(),
        "optout_remove_stored": _optout_remove_stored_sql(),
        "audit_query": "SELECT event_type AS operacao, CAST(user_id AS VARCHAR) AS usuario, ts AS quando, props AS filtros, "
        "CAST(floor(value) AS BIGINT) AS n_registros, CAST(NULL AS VARCHAR) AS destino FROM events "
        f"WHERE event_type = '{PR.AUDIT_OPERACAO}' AND ts >= TIMESTAMP '{PR.AUDIT_DESDE}' AND ts <= TIMESTAMP '{PR.AUDIT_ATE}'",
        "audit_export": "SELECT event_type AS operacao, CAST(user_id AS VARCHAR) AS usuario, ts AS quando, props AS filtros, "
        "CAST(floor(value) AS BIGINT) AS n_registros, CAST(NULL AS VARCHAR) AS destino FROM events "
        f"WHERE event_type = '{PR.AUDIT_OPERACAO}' AND ts >= TIMESTAMP '{PR.AUDIT_DESDE}' AND ts <= TIMESTAMP '{PR.AUDIT_ATE}'",
        "retention_purge": _retention_sql(),
        "cache_freshness": _freshness_sql(),
        "source_status": _source_status_sql(),
        "ledger_pending": _ledger_pending_sql(),
        "csv_latin1_scan": _csv_latin1_sql(),
        "csv_malformed": _csv_malformed_sql(),
        "fr_csv_scan": _fr_csv_sql(),
        "csv_probe": _csv_probe_sql(),
        "fr_routing": with_("fr_et") + "SELECT siren, siret, 'ETABLISSEMENT,UNITE_LEGALE' AS entidades FROM fr_et",
        "publish_version": with_("br_valid") + "SELECT * FROM br_valid",
        "carry_forward": with_("br_valid", "fr_valid") + f"SELECT * FROM {_once('br_valid')} UNION ALL SELECT * FROM {_once('fr_valid')}",
        "publish_rejected": with_("fr_valid") + f"SELECT 'FR' AS pais, count(*) AS n, true AS v1_ativa, false AS v2_ativa, 'v1' AS versao FROM {_once('fr_valid')}",
        "publish_counts": with_("br_valid", "br_joined", "fr_valid")
        + "SELECT 'BR' AS pais, (SELECT count(*) FROM br_valid) AS n_gravados, (SELECT count(*) FROM br_joined) - (SELECT count(*) FROM br_valid) AS n_rejeitados "
        "UNION ALL SELECT 'FR', (SELECT count(*) FROM fr_valid), (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM fr_valid)",
        "score_size_capital": _size_capital_sql(),
        "panel_criteria": _panel_criteria_sql(),
        "optout_csv": with_("leads", "optout_ids", "optout_emails")
        + "SELECT * FROM leads WHERE NOT coalesce(id_estab IN (SELECT * FROM optout_ids), false) AND NOT coalesce(lower(email) IN (SELECT * FROM optout_emails), false)",
        "retention_job": f"WITH {_cache_cte()} SELECT count(*) FILTER (WHERE created_at >= {_cutoff()!r}) AS n_mantidos, count(*) FILTER (WHERE created_at < {_cutoff()!r}) AS n_removidos, "
        f"'retention_purge' AS operacao, count(*) FILTER (WHERE created_at < {_cutoff()!r}) AS n_registros FROM cache",
        "audit_old_schema": "SELECT event_type AS operacao, CAST(user_id AS VARCHAR) AS usuario, ts AS quando, CASE WHEN event_type = 'view' THEN NULL ELSE props END AS filtros, "
        "CAST(floor(value) AS BIGINT) AS n_registros, CAST(NULL AS VARCHAR) AS destino FROM events",
        "enrich_job": with_("br_valid").rstrip()
        + f", upd AS (SELECT DISTINCT {_DIGITS} AS cnpj FROM orders) SELECT (SELECT count(*) FROM br_valid) AS n_leads, "
        "(SELECT count(*) FROM br_valid WHERE id_estab IN (SELECT cnpj FROM upd)) AS n_enriquecidos, "
        "(SELECT count(*) FROM upd WHERE cnpj IN (SELECT id_estab FROM br_valid)) AS n_encontrados, "
        "(SELECT count(*) FROM upd WHERE cnpj IN (SELECT id_estab FROM br_valid)) AS n_registros",
        "stream_intake": with_("br_valid") + "SELECT * FROM br_valid",
        **_parsed_sql(),
        "demo_leads": _demo_leads_sql(),
        "weighted_sample": _weighted_sample_sql(),
        "export_csv": _export_csv_sql(),
        "export_csv_lines": _export_lines_sql(),
        "export_txt": _export_txt_sql(),
        "export_audit": with_("g_out") + "SELECT 'export_' || f AS operacao, 'bench' AS usuario, (SELECT count(*) FROM g_out) AS n_registros FROM (SELECT unnest(['csv', 'txt']) AS f)",
        # the lead is exported unless an opt-out names it: alone, it has no rival for its id or domain
        "export_one": with_("g_out", "leads")
        + f", one AS (SELECT min(id_estab) AS i FROM leads WHERE {crit_sql(PR.CRIT_DEFAULT)}) "
        "SELECT i AS id_estab, CAST(CASE WHEN substr(i, 8, 1) = '3' OR EXISTS (SELECT 1 FROM leads, one o WHERE id_estab = o.i AND starts_with(lower(email), 'contato1')) THEN 0 ELSE 1 END AS BIGINT) AS n_exportados FROM one",
        "score_breakdown": _breakdown_sql(),
        "audit_append": "SELECT event_type AS operacao, CAST(user_id AS VARCHAR) AS usuario, ts AS quando, props AS filtros, "
        "CAST(floor(value) AS BIGINT) AS n_registros, CAST(NULL AS VARCHAR) AS destino FROM events",
        "audit_compacted": "SELECT event_type AS operacao, CAST(user_id AS VARCHAR) AS usuario, ts AS quando, props AS filtros, "
        "CAST(floor(value) AS BIGINT) AS n_registros, CAST(NULL AS VARCHAR) AS destino FROM events",
        "lookup_scan": f"SELECT {_p('n_nationkey', 4)} AS codigo, CASE WHEN n_nationkey = 7 THEN n_name ELSE 'ZZ ' || n_name END "
        "|| CASE WHEN n_nationkey % 5 = 2 AND n_nationkey <> 7 THEN chr(10) || chr(1) || ';' || chr(0) || '.' ELSE '' END AS descricao FROM nation "
        "UNION ALL SELECT '' AS codigo, 'ZZ ' || n_name || chr(10) || chr(1) || ';' || chr(0) || '.' AS descricao FROM nation WHERE n_nationkey = 7",
        "stage_counts": "SELECT 'EMPRESAS' AS entidade, count(*) AS n_linhas, CAST(0 AS BIGINT) AS n_malformadas, CAST(0 AS BIGINT) AS n_guardadas FROM customer "
        "UNION ALL SELECT 'ESTABELECIMENTOS', count(*), count(*) FILTER (WHERE o_orderkey % 50 = 3), count(*) FILTER (WHERE o_orderkey % 50 = 3) FROM orders "
        "UNION ALL SELECT 'SIMPLES', count(*), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM supplier",
        "lookup_resolve": with_("staging_estabelecimentos", "lookup_municipio")
        + ", cn AS (SELECT DISTINCT cnae_fiscal_principal AS codigo, 'ATIVIDADE ' || cnae_fiscal_principal AS descricao "
        "FROM staging_estabelecimentos WHERE cnae_fiscal_principal <> '') "
        "SELECT e.cnpj_basico || e.cnpj_ordem || e.cnpj_dv AS cnpj_completo, NULLIF(e.municipio, '') AS municipio, "
        "m.descricao AS municipio_descricao, NULLIF(e.cnae_fiscal_principal, '') AS cnae_fiscal_principal, "
        "c.descricao AS cnae_fiscal_principal_descricao FROM staging_estabelecimentos e "
        "LEFT JOIN lookup_municipio m ON NULLIF(e.municipio, '') = m.codigo "
        "LEFT JOIN cn c ON NULLIF(e.cnae_fiscal_principal, '') = c.codigo",
    }


_queries_batch1 = queries


def queries() -> dict[str, str]:  # noqa: F811
    return {**_queries_batch1(), **queries_batch2()}
