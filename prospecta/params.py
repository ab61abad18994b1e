"""Parameters of the registered queries, shared by the Spark jobs and their SQL twins
so both sides run the same question."""

from __future__ import annotations

from datetime import date

from prospecta.operators.score import ScoringConfig
from prospecta.operators.segment import Criteria

TODAY = date(2001, 8, 1)  # pinned "today" (last order date of the test data)

CRIT_DEFAULT = Criteria()
CRIT_PAIS = Criteria(pais="br")
CRIT_ATIVIDADE = Criteria(cod_atividade=["8630501", "62.01Z"])
CRIT_REGIAO = Criteria(regiao=["sp", "75"])
CRIT_PORTE = Criteria(porte=["micro empresa", "PME"])
CRIT_SITUACAO = Criteria(situacao="ativa")
CRIT_CAPITAL = Criteria(capital_social_min=1000, capital_social_max=5000)
CRIT_ABERTA = Criteria(aberta_apos=date(1998, 1, 1))
CRIT_CONTATO = Criteria(com_email=True, com_telefone=True)
CRIT_COMPOSITE = Criteria(
    situacao="ativa", regiao=["sp", "mg", "75", "13"], aberta_apos=date(1996, 1, 1), porte=["demais", "pme", "eti"]
)
CRIT_PREVIEW = Criteria(situacao="ATIVA")
CRIT_EXPORT = Criteria(regiao="SP", com_email=True)
CRIT_DEMO = Criteria(regiao="SP")
PREVIEW_LIMIT = 100
TOPK = 100
SEARCH_TEXT = "loja 12"
POINT_ID_ORDERKEY = 2  # point lookup of the establishment built from this order

SCORING = ScoringConfig(atividades_alvo=frozenset({"8630501", "62.01Z"}), regioes_alvo=frozenset({"SP", "75"}))
SCORING_SIZE = ScoringConfig(portes_alvo=frozenset({"demais", "PME"}), capital_social_min=1000.0, capital_social_max=20_000_000.0)
CRIT_PANEL = Criteria(situacao="ativa", regiao=["sp", "75"])

# Retention / cache (seconds since epoch, derived from events.ts).
RETENTION_NOW = "2024-02-01 00:00:00"
RETENTION_DAYS = 14
CACHE_TTL_SECONDS = 3 * 24 * 60 * 60
CACHE_NOW = "2024-01-25 00:00:00"
AUDIT_OPERACAO = "click"
AUDIT_DESDE = "2024-01-05 00:00:00"
AUDIT_ATE = "2024-01-20 00:00:00"
ENRICH_AT = "2024-02-01 12:00:00"
SITEMAP_N = 50
DEMO_SEED = 42
OPTOUT_ADD_EMAIL_PREFIX = "contato2"

# Stored opt-out list: when its rows are registered, and those that are removed again.
OPTOUT_AT = ("2026-01-05 08:00:00", "2026-02-06 09:30:00")
OPTOUT_REMOVE_EMAIL_PREFIX = "contato16"

# Staging in buckets: companies with more establishments are kept out of them.
HEAVY_COMPANY = 14
