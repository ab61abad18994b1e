"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator of
the inventory. Each reads the whole driver tables (through the registry adapter) and
returns a lazily planned DataFrame. Jobs whose operator writes files (staging,
publish, export, streaming intake, demo sink) run those writes and return the
written data read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta import params as PR
from prospecta import schema as S
from prospecta.functions import normalize as N
from prospecta.operators import analytics as A
from prospecta.operators import gate as G
from prospecta.operators import mapping as M
from prospecta.operators import quality as Q
from prospecta.operators import score as SC
from prospecta.operators import segment as SG
from prospecta.plans import buckets as BK
from prospecta.plans import ingest as I
from prospecta.plans import search as SE
from prospecta.plans import warehouse as W
from prospecta.session import scratch_path, stored_while
from prospecta.sources import testdata as TD

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


def _leads(spark, sf) -> DataFrame:
    """Published leads (real + demo tree), see ``plans.warehouse``."""
    return W.leads(spark, sf)


def _real_leads(spark, sf) -> DataFrame:
    return W.real_leads(spark, sf)


def _optout(spark, sf, leads: DataFrame | None = None) -> G.OptOut:
    base = leads if leads is not None else _leads(spark, sf)
    return G.load_optout(TD.suppression_list_from_leads(base))


# -- ingest / mapping ------------------------------------------------------------------


@register("br_joined")
def q_br_joined(spark, sf):
    return I.br_joined(spark, sf)


@register("br_joined_bucketed")
def q_br_joined_bucketed(spark, sf):
    """J1 from tables staged in buckets by company; companies with more than a few
    establishments are told as heavy here, so that both ways are taken."""
    tables = {"ESTABELECIMENTOS": TD.staging_estabelecimentos(spark, sf), "EMPRESAS": TD.staging_empresas(spark, sf), "SIMPLES": TD.staging_simples(spark, sf)}
    staged = BK.stage_buckets(spark, tables, scratch_path(spark, "buckets"), buckets=8, heavy=PR.HEAVY_COMPANY)
    return BK.br_joined(spark, staged.root, TD.lookup_municipio(spark, sf), TD.lookup_natureza_juridica(spark, sf))


@register("br_canonical")
def q_br_canonical(spark, sf):
    return I.br_mapped(spark, sf).valid


@register("br_rejects")
def q_br_rejects(spark, sf):
    return I.br_mapped(spark, sf).rejected.select("id_legal", "id_estab", "reject_reason")


@register("fr_canonical")
def q_fr_canonical(spark, sf):
    return I.fr_mapped(spark, sf).valid


@register("fr_orphans")
def q_fr_orphans(spark, sf):
    ul, et = I.fr_parsed(spark, sf)
    return M.fr_orphans(ul, et).select("siren", "siret")


@register("leads_union")
def q_leads_union(spark, sf):
    return _leads(spark, sf)


@register("secondary_cnae")
def q_secondary_cnae(spark, sf):
    e = M.parse_estabelecimentos(TD.staging_estabelecimentos(spark, sf))
    return e.select(
        "cnpj_completo",
        F.size("cnae_fiscal_secundaria").cast("bigint").alias("n_cnae_secundaria"),
        F.array_join("cnae_fiscal_secundaria", ",").alias("cnae_secundaria"),
    )


# -- segmentation --------------------------------------------------------------------


def _filter_query(crit: SG.Criteria, demo: bool = False) -> Query:
    def q(spark, sf):
        return SG.segment(_leads(spark, sf), crit, demo=demo)

    return q


for _name, _crit in (
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
    register(_name)(_filter_query(_crit))

register("demo_preview")(_filter_query(PR.CRIT_DEMO, demo=True))


@register("preview_top")
def q_preview_top(spark, sf):
    return SG.preview(_leads(spark, sf), PR.CRIT_PREVIEW, limit=PR.PREVIEW_LIMIT)


@register("preview_tam")
def q_preview_tam(spark, sf):
    return SG.tam(_leads(spark, sf), PR.CRIT_PREVIEW)


@register("export_query")
def q_export_query(spark, sf):
    return SG.export_query(_leads(spark, sf), PR.CRIT_EXPORT, order_by=None)


@register("lead_point_lookup")
def q_lead_point_lookup(spark, sf):
    leads = _leads(spark, sf)
    o = TD.table(spark, sf, "orders").where(F.col("o_orderkey") == PR.POINT_ID_ORDERKEY)
    k = F.col("o_orderkey")
    ids = o.select(
        F.concat(
            N.lpad_code("o_custkey", 8), N.lpad_code(k % 10000, 4), N.lpad_code(k % 97, 2)
        ).alias("pid")
    )
    # The id is looked up through the (tiny) order row so the query stays correct at
    # every scale; the lead side is filtered by the export criteria first.
    cand = SG.export_query(leads, SG.Criteria(), order_by=None)
    return cand.join(ids, cand["id_estab"] == ids["pid"], "left_semi")


@register("text_search")
def q_text_search(spark, sf):
    return SE.text_search(SG.export_query(_leads(spark, sf), PR.CRIT_DEFAULT, order_by=None), W.search_index(spark, sf), PR.SEARCH_TEXT)


# -- staging sanity (A1-A5) -------------------------------------------------------------


@register("null_counts")
def q_null_counts(spark, sf):
    return Q.null_counts(TD.staging_estabelecimentos(spark, sf))


@register("dup_keys")
def q_dup_keys(spark, sf):
    return Q.duplicate_key_count(TD.staging_estabelecimentos(spark, sf), ["cnpj_basico"])


@register("distribution")
def q_distribution(spark, sf):
    return Q.distribution(TD.staging_estabelecimentos(spark, sf), "situacao_cadastral")


@register("sanity_report")
def q_sanity_report(spark, sf):
    return Q.sanity_report(TD.staging_empresas(spark, sf), "staging_empresas", ["cnpj_basico"])


# -- quality gate (Q1-Q5) --------------------------------------------------------------------


@register("quality_null_ratio")
def q_quality_null_ratio(spark, sf):
    return Q.null_ratios(_real_leads(spark, sf), S.DEFAULT_NULL_CHECK_COLUMNS)


@register("quality_domain")
def q_quality_domain(spark, sf):
    return Q.situacao_domain(_real_leads(spark, sf))


@register("quality_dups")
def q_quality_dups(spark, sf):
    return Q.duplicate_ids(_real_leads(spark, sf))


@register("quality_report")
def q_quality_report(spark, sf):
    return Q.quality_report(_real_leads(spark, sf))


# -- charts, TAM, panel ----------------------------------------------------------------------


@register("chart_regiao")
def q_chart_regiao(spark, sf):
    return A.chart_counts(_leads(spark, sf), PR.CRIT_DEFAULT, "regiao")


@register("chart_atividade")
def q_chart_atividade(spark, sf):
    return A.chart_counts(_leads(spark, sf), PR.CRIT_DEFAULT, "cod_atividade")


@register("tam_cube")
def q_tam_cube(spark, sf):
    return A.tam_cube(_leads(spark, sf), PR.CRIT_PREVIEW)


@register("tam_cube_companies")
def q_tam_cube_companies(spark, sf):
    """Companies, not establishments, for every combination of the dimensions."""
    return A.tam_cube_companies(_leads(spark, sf), PR.CRIT_PREVIEW)


@register("compliance_panel")
def q_compliance_panel(spark, sf):
    leads = _leads(spark, sf)
    return A.compliance_panel(spark, leads, PR.CRIT_DEFAULT, _optout(spark, sf, leads))


# -- gate (G1-G5, P17) -----------------------------------------------------------------------


@register("gate_hard")
def q_gate_hard(spark, sf):
    return G.gate_hard(_leads(spark, sf))


@register("gate_id")
def q_gate_id(spark, sf):
    return G.dedupe_id(G.gate_hard(_leads(spark, sf)), stored=True)


@register("gate_domain")
def q_gate_domain(spark, sf):
    return G.dedupe_domain(G.dedupe_id(G.gate_hard(_leads(spark, sf))))


@register("gate_optout")
def q_gate_optout(spark, sf):
    leads = _leads(spark, sf)
    return G.is_suppressed_join(leads, _optout(spark, sf, leads))


@register("gate_full")
def q_gate_full(spark, sf):
    leads = _leads(spark, sf)
    return G.apply_gate(leads, _optout(spark, sf, leads)).df


@register("gate_report")
def q_gate_report(spark, sf):
    leads = _leads(spark, sf)
    return G.gate_report_exact(leads, _optout(spark, sf, leads))


@register("email_domains")
def q_email_domains(spark, sf):
    return (
        _leads(spark, sf)
        .select(N.email_domain("email").alias("dominio"))
        .groupBy("dominio")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# -- scoring (S0-S8) -------------------------------------------------------------------------


@register("score_signals")
def q_score_signals(spark, sf):
    leads = _real_leads(spark, sf)
    sig = SC.signal_columns(PR.SCORING, PR.TODAY)
    return leads.select(
        "pais",
        "id_estab",
        (~SC.is_active()).alias("vetado"),
        *[F.round(sig[s], 6).alias(f"f_{s}") for s in SC.SIGNALS],
        SC.score_column(PR.SCORING, PR.TODAY).alias("score_icp"),
    )


@register("score_icp")
def q_score_icp(spark, sf):
    return SC.apply_score(_real_leads(spark, sf), PR.SCORING, PR.TODAY)


@register("score_topk")
def q_score_topk(spark, sf):
    cand = SG.export_query(_leads(spark, sf), PR.CRIT_DEFAULT, order_by=None)
    return SC.top_k(SC.apply_score(cand, PR.SCORING, PR.TODAY), PR.TOPK)


# ===================================================================================
# Sources, sinks, publish, export, audit, retention, enrichment, demo, ledger, stream
# ===================================================================================

from datetime import UTC, datetime  # noqa: E402

from prospecta.operators import demo as D  # noqa: E402
from prospecta.operators import enrich as E  # noqa: E402
from prospecta.plans import audit as AU  # noqa: E402
from prospecta.plans import export as X  # noqa: E402
from prospecta.plans import ledger as LG  # noqa: E402
from prospecta.plans import optout as OO  # noqa: E402
from prospecta.plans import publish as PB  # noqa: E402
from prospecta.plans import retention as RT  # noqa: E402
from prospecta.session import rows_df  # noqa: E402, stored_while
from prospecta.sources import registry as RG  # noqa: E402
from prospecta.streaming import intake as ST  # noqa: E402


def _ts(s: str) -> datetime:
    return datetime.fromisoformat(s)


def _utc(s: str) -> datetime:
    return _ts(s).replace(tzinfo=UTC)


@register("opencnpj_canonical")
def q_opencnpj_canonical(spark, sf):
    valid, _ = M.enforce_contract(M.opencnpj_to_canonical(TD.opencnpj_payloads(spark, sf)))
    return valid


@register("enrich_brasilapi")
def q_enrich_brasilapi(spark, sf):
    return E.brasilapi_updates(TD.brasilapi_payloads(spark, sf), _ts(PR.ENRICH_AT))


@register("enrich_recherche")
def q_enrich_recherche(spark, sf):
    return E.recherche_updates(TD.recherche_payloads(spark, sf), _ts(PR.ENRICH_AT))


@register("enrich_merge")
def q_enrich_merge(spark, sf):
    upd = E.recherche_updates(TD.recherche_payloads(spark, sf), _ts(PR.ENRICH_AT))
    valid, _ = E.merge_updates(I.fr_mapped(spark, sf).valid, upd, "id_legal", "siren")
    return valid


@register("siren_extract")
def q_siren_extract(spark, sf):
    return E.extract_sirens(TD.recherche_payloads(spark, sf))


@register("sitemap_ids")
def q_sitemap_ids(spark, sf):
    return E.discover_ids(TD.landed_sitemaps(spark, sf), PR.SITEMAP_N)


def _optout_table(spark, sf):
    return TD.suppression_list_from_leads(_leads(spark, sf))


@register("optout_add")
def q_optout_add(spark, sf):
    leads = _leads(spark, sf)
    existing = TD.suppression_list_from_leads(leads)
    fresh = leads.where(F.lower("email").startswith(PR.OPTOUT_ADD_EMAIL_PREFIX)).select(
        F.lit("").alias("id_estab"), F.col("email"), F.lit("opt-out novo").alias("motivo")
    )
    again = existing.select("id_estab", "email", F.lit("repetido").alias("motivo"))  # already present
    return G.optout_add(existing, fresh.unionByName(again))


@register("optout_remove")
def q_optout_remove(spark, sf):
    return G.optout_remove(_optout_table(spark, sf), email="contato16@empresa16.com.br")


def _stored_optout(spark, sf) -> str:
    """The opt-out list derived from leads, registered into a stored list."""
    root = scratch_path(spark, "optout-list")
    OO.add(spark, root, _optout_table(spark, sf), now=_utc(PR.OPTOUT_AT[0]))
    return root


@register("optout_add_stored")
def q_optout_add_stored(spark, sf):
    """Rows registered into the stored list at a later time, some of them there already."""
    root = _stored_optout(spark, sf)
    fresh = _leads(spark, sf).where(F.lower("email").startswith(PR.OPTOUT_ADD_EMAIL_PREFIX)).select(F.lit(None).cast("string").alias("id_estab"), "email", F.lit(" opt-out novo ").alias("motivo"))
    again = OO.read_list(spark, root).select("id_estab", F.upper("email").alias("email"), F.lit("repetido").alias("motivo"))
    n = OO.add(spark, root, fresh.unionByName(again), now=_utc(PR.OPTOUT_AT[1]))
    return OO.read_list(spark, root).withColumn("n_novos", F.lit(n).cast("bigint"))


@register("optout_remove_stored")
def q_optout_remove_stored(spark, sf):
    """Every row with one of the e-mails leaves the stored list, one of them is
    registered again; with the counts of the removal, of the same once more, and of one
    from a list that was never written."""
    root = _stored_optout(spark, sf)
    gone = _leads(spark, sf).where(F.lower("email").startswith(PR.OPTOUT_REMOVE_EMAIL_PREFIX)).select(F.lit("").alias("id_estab"), "email")
    n = [OO.remove_many(spark, root, gone), OO.remove_many(spark, root, gone), OO.remove(spark, scratch_path(spark, "no-list"), id_estab="1")]
    back = gone.agg(F.min(F.lower("email")).alias("email")).where("email IS NOT NULL").withColumn("motivo", F.lit("de novo"))
    OO.add(spark, root, back, now=_utc(PR.OPTOUT_AT[1]))
    names = ("n_removidos", "n_de_novo", "n_sem_lista")
    return OO.read_list(spark, root).select("*", *[F.lit(v).cast("bigint").alias(c) for v, c in zip(n, names)])


@register("audit_query")
def q_audit_query(spark, sf):
    log = AU.events_as_log(TD.table(spark, sf, "events"))
    return AU.query_log(log, operacao=PR.AUDIT_OPERACAO, desde=_ts(PR.AUDIT_DESDE), ate=_ts(PR.AUDIT_ATE))


def _cache(spark, sf):
    return RT.cache_from_events(TD.table(spark, sf, "events"), PR.CACHE_TTL_SECONDS)


@register("retention_purge")
def q_retention_purge(spark, sf):
    from datetime import UTC

    return RT.purge(_cache(spark, sf), _ts(PR.RETENTION_NOW).replace(tzinfo=UTC), PR.RETENTION_DAYS).kept


@register("cache_freshness")
def q_cache_freshness(spark, sf):
    from datetime import UTC

    return RT.freshness(_cache(spark, sf), _ts(PR.CACHE_NOW).replace(tzinfo=UTC))


@register("source_status")
def q_source_status(spark, sf):
    _, ledger = LG.ledger_from_events(TD.table(spark, sf, "events"))
    known = rows_df(spark, [(f,) for f in S.KNOWN_FONTES], "fonte string")
    return A.source_status(known, ledger)


@register("ledger_pending")
def q_ledger_pending(spark, sf):
    available, ledger = LG.ledger_from_events(TD.table(spark, sf, "events"))
    return LG.pending(available, ledger, strict=True)


@register("demo_leads")
def q_demo_leads(spark, sf):
    br = D.generate(TD.table(spark, sf, "part"), "p_partkey", "BR", PR.DEMO_SEED, PR.TODAY)
    fr = D.generate(TD.table(spark, sf, "supplier"), "s_suppkey", "FR", PR.DEMO_SEED, PR.TODAY)
    root = scratch_path(spark, "demo")
    X.write_demo(br, root, "BR")
    X.write_demo(fr, root, "FR")
    return spark.read.parquet(root)


@register("weighted_sample")
def q_weighted_sample(spark, sf):
    real = _real_leads(spark, sf).where(F.col("pais") == "BR")
    props = D.proportions_from(real, "atividade", "cod_atividade").unionByName(D.proportions_from(real, "regiao", "regiao"))
    cum = D.cumulative_table(props)
    return D.generate(TD.table(spark, sf, "part"), "p_partkey", "BR", PR.DEMO_SEED, PR.TODAY, cumulative=cum)


@register("csv_latin1_scan")
def q_csv_latin1_scan(spark, sf):
    """SRC1, SNK1: names with quoted line breaks and control characters (every 29th)."""
    landing = scratch_path(spark, "landing")
    odd = F.concat("razao_social", F.lit("\nFILIAL;\u0001A\u0000B"))
    emp = TD.staging_empresas(spark, sf).withColumn("razao_social", F.when((F.col("cnpj_basico").cast("int") % 29 == 7) & (F.col("razao_social") != ""), odd).otherwise(F.col("razao_social")))
    I.write_registry_csv(emp, f"{landing}/K3241.K03200Y0.D50812.EMPRECSV")
    I.write_registry_csv(TD.staging_simples(spark, sf), f"{landing}/F.K03200$W.SIMPLES.CSV.D50812")
    I.write_registry_csv(TD.staging_empresas(spark, sf), f"{landing}/K3241.K03200Y0.D50812.SOCIOCSV")  # ignored
    staged = scratch_path(spark, "staged")
    I.stage_directory(spark, landing, staged)
    return M.parse_empresas(I.staged(spark, staged, "EMPRESAS").rows)


MALFORMED_SHORT_MOD, MALFORMED_SHORT_REM = 50, 3
MALFORMED_LONG_MOD, MALFORMED_LONG_REM = 71, 5
QUOTED_MOD, QUOTED_REM = 13, 2
BLANK_MOD, BLANK_REM = 19, 1
BREAK_MOD, BREAK_REM = 11, 3
CONTROL_MOD, CONTROL_REM = 17, 4


@register("csv_malformed")
def q_csv_malformed(spark, sf):
    """Raw lines built from orders: some short, some long, some with a quoted name
    holding ``;`` and doubled quotes, some with a quoted line break, some with control
    characters at a field's and a line's start; scanned with the malformed split."""
    # the order key is recovered from the trade name ("LOJA <key>")
    rows = TD.staging_estabelecimentos(spark, sf).withColumn(
        "__k", F.regexp_extract("nome_fantasia", r"(\d+)$", 1).cast("bigint")
    )
    quoted = F.concat(F.lit('"LOJA ""'), F.col("__k").cast("string"), F.lit('""; FILIAL"'))
    fields = [quoted if c == "nome_fantasia" else F.col(c) for c in S.ESTABELECIMENTOS_COLUMNS]
    # an unquoted blank first field is still a row
    fields[0] = F.when(F.col("__k") % BLANK_MOD == BLANK_REM, F.lit("")).otherwise(fields[0])
    fields = [F.when(F.col("__k") % QUOTED_MOD == QUOTED_REM, fields[i]).otherwise(F.col(c)) if c == "nome_fantasia" else fields[i] for i, c in enumerate(S.ESTABELECIMENTOS_COLUMNS)]
    name = S.ESTABELECIMENTOS_COLUMNS.index("nome_fantasia")
    broken = F.concat(F.lit('"LOJA\n'), F.col("__k").cast("string"), F.lit(';\r\n"'))
    fields[name] = F.when(F.col("__k") % BREAK_MOD == BREAK_REM, broken).otherwise(fields[name])
    control = F.col("__k") % CONTROL_MOD == CONTROL_REM
    fields[0] = F.when(control, F.concat(F.lit("\u0000\u0001"), fields[0])).otherwise(fields[0])
    fields[1] = F.when(control, F.lit("\u0000")).otherwise(fields[1])
    line = (
        F.when(F.col("__k") % MALFORMED_SHORT_MOD == MALFORMED_SHORT_REM, F.concat_ws(";", *fields[:-3]))
        .when(F.col("__k") % MALFORMED_LONG_MOD == MALFORMED_LONG_REM, F.concat_ws(";", *fields, F.lit("X"), F.lit("Y")))
        .otherwise(F.concat_ws(";", *fields))
    )
    path = scratch_path(spark, "malformed")
    rows.select(line.alias("value")).write.mode("overwrite").text(path)
    scan = RG.read_positional_csv(spark, path, S.ESTABELECIMENTOS_COLUMNS, encoding="UTF-8")
    ok = scan.rows.agg(
        F.count(F.lit(1)).alias("n_ok"),
        F.sum(F.when(F.col("nome_fantasia").contains('"') & F.col("nome_fantasia").contains(";"), 1).otherwise(0)).cast("bigint").alias("n_quoted"),
        F.sum(F.when(F.col(S.ESTABELECIMENTOS_COLUMNS[0]) == "", 1).otherwise(0)).cast("bigint").alias("n_blank_first"),
        F.sum(F.when(F.col("nome_fantasia").rlike("\\ALOJA\n[0-9]+;\r\n\\z"), 1).otherwise(0)).cast("bigint").alias("n_breaks"),
        F.sum(F.when(F.col(S.ESTABELECIMENTOS_COLUMNS[0]).startswith("\u0000\u0001") & (F.col(S.ESTABELECIMENTOS_COLUMNS[1]) == "\u0000"), 1).otherwise(0)).cast("bigint").alias("n_control"),
    )
    bad = scan.malformed.agg(F.count(F.lit(1)).alias("n_malformed"))
    return Q.one_row(ok, bad)


@register("fr_csv_scan")
def q_fr_csv_scan(spark, sf):
    raw = TD.fr_unite_legale(spark, sf)
    cols = list(reversed(raw.columns))  # header order differs from the layout
    renamed = [F.col(c).alias(c + " " if c in ("siren", "nomUniteLegale") else c) for c in cols]
    path = scratch_path(spark, "StockUniteLegale_utf8")
    I.write_registry_csv(raw.select(*renamed), path, encoding="UTF-8", header=True, sep=",")
    ul = M.parse_unite_legale(RG.read_named_csv(spark, path, S.UNITE_LEGALE_COLUMNS))
    return ul.select(
        "siren", "statut_diffusion", "flag_difusao_restrita", "razao_social", "nome", "categoria_empresa",
        "natureza_juridica", "unite_purgee", "data_criacao", "ano_efetivos",
    )


@register("fr_routing")
def q_fr_routing(spark, sf):
    """SRC9, SRC3: a landing folder with two establishment files of different header
    order, a legal-unit file, a history file and an unknown one: routed by name and read by
    header name."""
    et, landing = TD.fr_etablissement(spark, sf), scratch_path(spark, "landing-fr")
    early = F.substring("siret", 14, 1) < "5"
    cols = et.columns
    I.write_registry_csv(et.where(early), f"{landing}/StockEtablissement_utf8.csv", encoding="UTF-8", header=True, sep=",")
    I.write_registry_csv(et.where(~early).select(*reversed(cols)), f"{landing}/stocketablissement_2.csv", encoding="UTF-8", header=True, sep=",")
    I.write_registry_csv(et.where(early), f"{landing}/StockEtablissementHistorique_utf8.csv", encoding="UTF-8", header=True, sep=",")
    I.write_registry_csv(TD.fr_unite_legale(spark, sf), f"{landing}/StockUniteLegale_utf8.csv", encoding="UTF-8", header=True, sep=",")
    I.write_registry_csv(et.where(early), f"{landing}/outro.csv", encoding="UTF-8", header=True, sep=",")
    routed = RG.route_files(spark, landing, "FR")
    read = RG.read_named_csv(spark, routed["ETABLISSEMENT"], S.ETABLISSEMENT_COLUMNS)
    return read.select("siren", "siret").withColumn("entidades", F.lit(",".join(sorted(routed))))


@register("csv_probe")
def q_csv_probe(spark, sf):
    path = scratch_path(spark, "probe")
    I.write_registry_csv(TD.staging_estabelecimentos(spark, sf), path)
    stats, _sample = RG.probe_csv(spark, path)
    return stats


def _publish_root(spark) -> str:
    return scratch_path(spark, "warehouse")


@register("publish_version")
def q_publish_version(spark, sf):
    root = _publish_root(spark)
    res = PB.publish(spark, I.br_mapped(spark, sf).valid, root, "BR")
    return PB.read_version(spark, root, res.version)


def _candidates(spark, sf, pais: str) -> tuple[DataFrame, int]:
    """Unchecked canonical rows of a country, and the rows left out before the mapping."""
    if pais == "BR":
        return M.br_to_canonical(I.br_joined(spark, sf)), 0
    ul, et = I.fr_parsed(spark, sf)
    return M.fr_to_canonical(M.fr_joined(ul, et)), M.fr_orphans(ul, et).count()


@register("publish_counts")
def q_publish_counts(spark, sf):
    """SNK3: rows written and rejected (contract rejects and FR orphans) per country."""
    root = _publish_root(spark)
    done = []
    for pais in ("BR", "FR"):
        rows, skipped = _candidates(spark, sf, pais)
        m = PB.publish(spark, rows, root, pais, n_skipped=skipped).materialized
        done.append((pais, m.n_written, m.n_rejected))
    return rows_df(spark, done, "pais string, n_gravados bigint, n_rejeitados bigint")


def _once(df: DataFrame) -> DataFrame:
    """One row per id: passes the quality gate."""
    return G.dedupe_id(df)


@register("carry_forward")
def q_carry_forward(spark, sf):
    """V2-V4, SRC6: two countries published in turn, both pass, and the live table, read
    through the pointer, holds both. Ids are unique in each country; two registries may give
    the same number, which no check of this job counts as a duplicate."""
    root, thr = _publish_root(spark), Q.QualityThresholds(ids_per_country=True)
    for pais, mapped in (("FR", I.fr_mapped), ("BR", I.br_mapped)):
        # mapped rows are stored until they are published: few ids repeat, the others aren't moved for that
        with stored_while(spark, mapped(spark, sf).valid, f"mapped-{pais}") as rows:
            done = PB.publish(spark, G.dedupe_id(rows, stored=True), root, pais, thresholds=thr)
        if not done.activated:
            raise RuntimeError(f"quality rejected {pais}")
    return PB.read_active(spark, root)


@register("publish_rejected")
def q_publish_rejected(spark, sf):
    """V4: a version with duplicate ids is rejected and the live table stays as it was."""
    root = _publish_root(spark)
    good = PB.publish(spark, _once(I.fr_mapped(spark, sf).valid), root, "FR", version="v1")
    twice = I.br_mapped(spark, sf).valid
    bad = PB.publish(spark, twice.unionByName(twice), root, "BR", version="v2")
    live = PB.read_active(spark, root)
    counts = live.groupBy("pais").agg(F.count("*").alias("n"))
    return counts.select("pais", "n", F.lit(good.activated).alias("v1_ativa"), F.lit(bad.activated).alias("v2_ativa"), F.lit(PB.active_version(root)).alias("versao"))


@register("stream_intake")
def q_stream_intake(spark, sf):
    """INC2: establishments land as daily registry CSV files (two days, some street names
    with quoted line breaks, malformed lines beside them); the stream maps each micro-batch
    against the static company tables; the first day's files that land again under another
    name add nothing, nor does a run with nothing new."""
    from prospecta.schema import ESTABELECIMENTOS_COLUMNS

    landing = scratch_path(spark, "stream-landing")
    ckpt = scratch_path(spark, "stream-ckpt")
    out = scratch_path(spark, "stream-out")
    orders = TD.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    est = TD.staging_estabelecimentos(spark, sf).withColumn(
        "__k", F.regexp_extract("nome_fantasia", r"(\d+)$", 1).cast("bigint")
    )
    est = est.join(orders, est["__k"] == orders["o_orderkey"])
    emp = TD.staging_empresas(spark, sf)
    sim = TD.staging_simples(spark, sf)
    mun = TD.lookup_municipio(spark, sf)
    nat = TD.lookup_natureza_juridica(spark, sf)

    def transform(batch):
        valid, _ = M.enforce_contract(M.br_to_canonical(M.br_joined(batch, emp, sim, mun, nat)))
        return valid

    early = F.coalesce(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), F.lit(False))
    est = est.withColumn("complemento", F.when(F.col("__k") % 9 == 4, F.lit("SALA 1\nBLOCO; B")).otherwise(F.col("complemento")))
    days = scratch_path(spark, "stream-days")  # joined once for the three landings
    est.withColumn("__early", early).select(*ESTABELECIMENTOS_COLUMNS, "__early").write.parquet(days)
    est = spark.read.parquet(days)
    short = TD.table(spark, sf, "orders").where("o_orderkey % 50 = 3").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(";x")).alias("value"))
    short.write.text(f"{landing}/D0")
    for day, cond in (("D1", F.col("__early")), ("D2", ~F.col("__early")), ("D3", F.col("__early"))):
        I.write_registry_csv(est.where(cond).select(*ESTABELECIMENTOS_COLUMNS), f"{landing}/{day}")
        ST.run_available_registry_csv(spark, f"{landing}/*", ESTABELECIMENTOS_COLUMNS, ckpt, out, transform)
    ST.run_available_registry_csv(spark, f"{landing}/*", ESTABELECIMENTOS_COLUMNS, ckpt, out, transform)  # nothing new
    return ST.read_output(spark, out).select(*S.CANONICAL_COLUMNS)


@register("opencnpj_json_files")
def q_opencnpj_json_files(spark, sf):
    """SRC7 + M3: landed JSON-lines payload files read with an explicit schema."""
    path = scratch_path(spark, "opencnpj-json")
    TD.opencnpj_payloads(spark, sf).write.mode("overwrite").text(path)
    docs = spark.read.schema(M.OPENCNPJ_SCHEMA).json(path)
    valid, _ = M.enforce_contract(M.opencnpj_to_canonical(docs, json_col=None))
    return valid


def _export(spark, sf, formato: str) -> tuple[str, X.ExportResult]:
    leads = _leads(spark, sf)
    dest = scratch_path(spark, f"export-{formato}")
    log = scratch_path(spark, "audit")
    res = X.export_leads(spark, leads, _optout(spark, sf, leads), X.ExportRequest(PR.CRIT_DEFAULT, dest, formato, usuario="bench"), log)
    return dest, res


@register("export_csv")
def q_export_csv(spark, sf):
    dest, _ = _export(spark, sf, "csv")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(c, dict(S.CANONICAL_FIELDS)[c]) for c in S.EXPORT_COLUMNS])
    return spark.read.schema(schema).option("header", "true").option("escape", '"').csv(dest)


@register("export_csv_lines")
def q_export_csv_lines(spark, sf):
    """SNK4: the raw lines of the written files, one header line for all of them."""
    dest, _ = _export(spark, sf, "csv")
    lines = spark.read.text(dest)
    header = ",".join(S.EXPORT_COLUMNS)
    return lines.where(F.col("value") != header).unionByName(lines.where(F.col("value") == header).distinct())


@register("export_txt")
def q_export_txt(spark, sf):
    """SNK5: the raw lines of the written files, the count line included."""
    dest, _ = _export(spark, sf, "txt")
    return spark.read.text(dest)


@register("export_audit")
def q_export_audit(spark, sf):
    """AUD1/AUD4: the audit row that an export leaves, its count taken after the gate."""
    leads = _leads(spark, sf)
    log = scratch_path(spark, "audit")
    for formato in ("csv", "txt"):
        req = X.ExportRequest(PR.CRIT_DEFAULT, scratch_path(spark, f"export-{formato}"), formato, usuario="bench")
        X.export_leads(spark, leads, _optout(spark, sf, leads), req, log)
    return AU.read_log(spark, log).select("operacao", "usuario", "n_registros")


@register("export_one")
def q_export_one(spark, sf):
    """F16: one establishment, chosen as the smallest id among the exportable ones,
    exported by its id under the criteria, through the gate."""
    leads = _leads(spark, sf)
    optout = _optout(spark, sf, leads)
    one = SG.export_query(leads, PR.CRIT_DEFAULT, order_by=None).agg(F.min("id_estab").alias("i")).first()["i"]
    dest = scratch_path(spark, "export-one")
    res = X.export_one(spark, leads, optout, X.ExportRequest(PR.CRIT_DEFAULT, dest, "csv"), one, scratch_path(spark, "audit"))
    return rows_df(spark, [(one, res.n_exported)], "id_estab string, n_exportados bigint")


@register("lookup_resolve")
def q_lookup_resolve(spark, sf):
    """Parsed establishments with municipality / activity descriptions."""
    e = M.parse_estabelecimentos(TD.staging_estabelecimentos(spark, sf))
    cnae = TD.staging_estabelecimentos(spark, sf).select(
        F.col("cnae_fiscal_principal").alias("codigo"), F.concat(F.lit("ATIVIDADE "), F.col("cnae_fiscal_principal")).alias("descricao")
    ).where(F.col("codigo") != "").distinct()
    out = M.enrich_with_lookups(e, cnae=cnae, municipio=TD.lookup_municipio(spark, sf))
    return out.select("cnpj_completo", "municipio", "municipio_descricao", "cnae_fiscal_principal", "cnae_fiscal_principal_descricao")


@register("audit_export")
def q_audit_export(spark, sf):
    """SNK6: the filtered audit log exported as CSV and read back."""
    log = AU.events_as_log(TD.table(spark, sf, "events"))
    q = AU.query_log(log, operacao=PR.AUDIT_OPERACAO, desde=_ts(PR.AUDIT_DESDE), ate=_ts(PR.AUDIT_ATE))
    dest = scratch_path(spark, "audit-export")
    AU.export_log_csv(q, dest)
    return AU.read_log_csv(spark, dest, q.schema)


@register("lookup_scan")
def q_lookup_scan(spark, sf):
    """SRC4: a ``codigo;descricao`` code table landed twice (a second, later file repeats
    every code, some descriptions with line breaks and control characters); one row per
    code, greatest description."""
    n = TD.table(spark, sf, "nation")
    base = scratch_path(spark, "lookup")
    first = n.select(N.lpad_code("n_nationkey", 4).alias("codigo"), F.col("n_name").alias("descricao"))
    odd = F.when(F.col("n_nationkey") % 5 == 2, F.lit("\n\u0001;\u0000.")).otherwise(F.lit(""))
    second = n.select(F.when(F.col("n_nationkey") == 7, "").otherwise(N.lpad_code("n_nationkey", 4)).alias("codigo"), F.concat(F.lit("ZZ "), F.col("n_name"), odd).alias("descricao"))
    I.write_registry_csv(first, f"{base}/a")
    I.write_registry_csv(second, f"{base}/b")
    return RG.read_lookup(spark, [f"{base}/a", f"{base}/b"])


def _odd_name(name):
    """The trade name with a line break and control characters after it, for odd keys."""
    return F.when(name.rlike("[13579]$"), F.concat(name, F.lit("\n\u0001;\u0000."))).otherwise(name)


@register("stage_counts")
def q_stage_counts(spark, sf):
    """SNK2: per-entity row and malformed counts of a staged landing folder."""
    landing = scratch_path(spark, "stage-landing")
    I.write_registry_csv(TD.staging_empresas(spark, sf), f"{landing}/K3241.K03200Y0.D50812.EMPRECSV")
    est = TD.staging_estabelecimentos(spark, sf)
    I.write_registry_csv(est.withColumn("nome_fantasia", _odd_name(F.col("nome_fantasia"))), f"{landing}/K3241.K03200Y1.D50812.ESTABELE")
    I.write_registry_csv(TD.staging_simples(spark, sf), f"{landing}/F.K03200$W.SIMPLES.CSV.D50812")
    # a second, damaged part of the establishments: short lines
    short = TD.table(spark, sf, "orders").where("o_orderkey % 50 = 3").select(F.concat(F.lit(";"), F.col("o_orderkey").cast("string"), F.lit(";x")).alias("value"))
    short.write.text(f"{landing}/K3241.K03200Y2.D50812.ESTABELE")
    staged = scratch_path(spark, "stage-parquet")
    counts = I.stage_directory(spark, landing, staged)
    kept = {e: I.staged(spark, staged, e).malformed.count() for e in counts}
    return rows_df(
        spark,
        [(e, c["rows"], c["malformed"], kept[e]) for e, c in sorted(counts.items())],
        "entidade string, n_linhas bigint, n_malformadas bigint, n_guardadas bigint",
    )


@register("score_breakdown")
def q_score_breakdown(spark, sf):
    """The breakdown struct, flattened (a vetoed lead has no signals)."""
    b = SC.breakdown_column(PR.SCORING, PR.TODAY)
    df = _real_leads(spark, sf).select("id_estab", b.alias("b"))
    cols = [F.col("id_estab"), F.col("b.score_icp").alias("score_icp"), F.col("b.vetado").alias("vetado"),
            F.size("b.sinais").cast("bigint").alias("n_sinais")]
    for s_ in SC.SIGNALS:
        e = F.col("b.sinais").getItem(s_)
        cols += [F.round(e["fraction"], 6).alias(f"f_{s_}"), e["applicable"].alias(f"a_{s_}")]
    return df.select(*cols)


@register("audit_append")
def q_audit_append(spark, sf):
    """AUD1/AUD2: events appended to an audit log in two batches (append mode, earlier
    files untouched) and read back."""
    log = scratch_path(spark, "audit-log")
    ev = AU.events_as_log(TD.table(spark, sf, "events"))
    first = F.coalesce(F.col("operacao") == "view", F.lit(False))
    ev.where(first).write.mode("append").parquet(log)
    ev.where(~first).write.mode("append").parquet(log)  # everything else, NULLs included
    return AU.read_log(spark, log, schema=ev.schema)


@register("audit_compacted")
def q_audit_compacted(spark, sf):
    """AUD1, U2: events appended in seven batches, the first ones without two of the columns,
    compacted in between and again after more were appended, then vacuumed."""
    log = scratch_path(spark, "audit-log")
    ev = AU.events_as_log(TD.table(spark, sf, "events"))
    batch = F.pmod(F.coalesce(F.col("n_registros"), F.lit(0)), F.lit(7))
    for i in range(7):
        rows = ev.where(batch == i)
        (rows.drop("destino") if i < 2 else rows).write.mode("append").parquet(log)
        if i in (3, 5):
            AU.compact_log(spark, log)
    AU.vacuum_log(spark, log)
    return AU.read_log(spark, log, schema=ev.schema)


@register("quality_summaries")
def q_quality_summaries(spark, sf):
    """Q5, V3: two countries published in turn; the report of the version, from the stored
    summaries alone."""
    root = _publish_root(spark)
    for pais, mapped in (("FR", I.fr_mapped), ("BR", I.br_mapped)):
        version = PB.publish(spark, mapped(spark, sf).valid, root, pais).version
        if PB.active_version(root) is None:
            PB.activate(root, version)  # the first is kept live whatever its quality, so it is carried forward
    return Q.report_of(PB.version_summary(spark, root, PB.read_manifest(root, version)))


@register("score_size_capital")
def q_score_size_capital(spark, sf):
    """S3: target sizes and a capital range configured."""
    leads = _real_leads(spark, sf)
    return leads.select("id_estab", F.round(SC.signal_columns(PR.SCORING_SIZE, PR.TODAY)["porte_capital"], 6).alias("f_porte_capital"), SC.score_column(PR.SCORING_SIZE, PR.TODAY).alias("score_icp"))


@register("panel_criteria")
def q_panel_criteria(spark, sf):
    """The panel over a filtered raw set."""
    leads = _leads(spark, sf)
    return A.compliance_panel(spark, leads, PR.CRIT_PANEL, _optout(spark, sf, leads))


@register("optout_csv")
def q_optout_csv(spark, sf):
    """SRC8, G4: the opt-out list landed as CSV, read back and applied."""
    leads = _leads(spark, sf)
    path = scratch_path(spark, "optout")
    TD.suppression_list_from_leads(leads).write.option("header", "true").csv(path)
    return G.is_suppressed_join(leads, RG.read_optout_csv(spark, path))


@register("retention_job")
def q_retention_job(spark, sf):
    """RET1: the purge as a job: rows kept, number purged, and its audit row."""
    from datetime import UTC

    dest, log = scratch_path(spark, "cache"), scratch_path(spark, "audit")
    n = RT.purge_and_audit(spark, _cache(spark, sf), dest, _ts(PR.RETENTION_NOW).replace(tzinfo=UTC), PR.RETENTION_DAYS, log, usuario="bench")
    audit = AU.read_log(spark, log).first()
    return rows_df(spark, [(spark.read.parquet(dest).count(), n, audit.operacao, audit.n_registros)], "n_mantidos bigint, n_removidos bigint, operacao string, n_registros bigint")


@register("audit_old_schema")
def q_audit_old_schema(spark, sf):
    """An older log without two of the columns, united with a newer one."""
    log = scratch_path(spark, "audit-log")
    ev = AU.events_as_log(TD.table(spark, sf, "events"))
    first = F.coalesce(F.col("operacao") == "view", F.lit(False))
    ev.where(first).drop("filtros", "destino").write.mode("append").parquet(log)
    ev.where(~first).write.mode("append").parquet(log)
    return AU.read_log(spark, log, schema=ev.schema)


@register("enrich_job")
def q_enrich_job(spark, sf):
    """The responses merged as a job, with the ids found and the audit row."""
    log = scratch_path(spark, "audit")
    upd = E.brasilapi_updates(TD.brasilapi_payloads(spark, sf), _ts(PR.ENRICH_AT))
    leads = I.br_mapped(spark, sf).valid
    merged, found = E.enrich_job(spark, leads, upd, "id_estab", "cnpj", log, usuario="bench")
    audit = AU.read_log(spark, log).first()
    return merged.agg(F.count("*").alias("n_leads"), F.sum(F.col("enriquecido_em").isNotNull().cast("bigint")).alias("n_enriquecidos")).select(
        "n_leads", "n_enriquecidos", F.lit(found).cast("bigint").alias("n_encontrados"), F.lit(audit.n_registros).cast("bigint").alias("n_registros")
    )


def _layout_rows(spark, sf, columns) -> DataFrame:
    """Raw text rows of a layout from ``orders``: column i of order k holds one of seven
    forms (blank, date, number, padded text, true, false, a word), chosen by (k + i) % 7."""
    k = F.col("o_orderkey")
    forms = [F.lit(""), F.concat(F.lit("20"), N.lpad_code(k % 30, 2), F.lit("-03-09T10:00:00")), (k % 1000).cast("string"), F.concat(F.lit("  t"), k.cast("string"), F.lit(" ")), F.lit("true"), F.lit("false"), F.lit("O")]
    o = TD.table(spark, sf, "orders").select("o_orderkey")
    return o.select(*[F.element_at(F.array(*forms), ((k + i) % 7 + 1).cast("int")).alias(c) for i, c in enumerate(columns)])


@register("unite_legale_parsed")
def q_unite_legale_parsed(spark, sf):
    """P20: every legal-unit field."""
    return M.parse_unite_legale(_layout_rows(spark, sf, S.UNITE_LEGALE_COLUMNS))


@register("etablissement_parsed")
def q_etablissement_parsed(spark, sf):
    """P20: every French establishment field."""
    return M.parse_etablissement(_layout_rows(spark, sf, S.ETABLISSEMENT_COLUMNS))


@register("simples_parsed")
def q_simples_parsed(spark, sf):
    """P20: every field of the tax-regime table."""
    return M.parse_simples(TD.staging_simples(spark, sf))
