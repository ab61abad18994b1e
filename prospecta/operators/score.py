"""ICP fit score 0-100 as one Column expression.

Which signals apply depends only on the configuration, so the denominator is a
literal and the whole score (veto, five signals, weighted mean, rounding) compiles to
a single projection inside whole-stage codegen - no per-row Python.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.schema import DEFAULT_RECENCY_DAYS

SIGNALS: tuple[str, ...] = ("contato", "atividade", "porte_capital", "recencia", "regiao")


@dataclass(frozen=True)
class ScoringConfig:
    peso_contato: float = 20.0
    peso_atividade: float = 25.0
    peso_porte_capital: float = 20.0
    peso_recencia: float = 15.0
    peso_regiao: float = 20.0
    atividades_alvo: Collection[str] | None = None
    regioes_alvo: Collection[str] | None = None
    portes_alvo: Collection[str] | None = None
    capital_social_min: float | None = None
    capital_social_max: float | None = None
    recencia_dias_max: int | None = DEFAULT_RECENCY_DAYS

    def weight(self, signal: str) -> float:
        return float(getattr(self, f"peso_{signal}"))

    def applicable(self, signal: str) -> bool:
        if signal == "contato":
            return True
        if signal == "atividade":
            return bool(self.atividades_alvo)
        if signal == "porte_capital":
            return bool(self.portes_alvo) or self.capital_social_min is not None or self.capital_social_max is not None
        if signal == "recencia":
            return self.recencia_dias_max is not None
        if signal == "regiao":
            return bool(self.regioes_alvo)
        raise KeyError(signal)


def _present(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != F.lit("")


def is_active() -> Column:
    """Veto unless ``upper(situacao) = 'ATIVA'`` (NULL vetoes)."""
    return F.coalesce(F.upper(F.col("situacao")) == F.lit("ATIVA"), F.lit(False))


def signal_contato() -> Column:
    """Both e-mail and phone -> 1, one -> 0.5, none -> 0 ('' is absent)."""
    e, t = _present("email"), _present("telefone")
    return F.when(e & t, F.lit(1.0)).when(e | t, F.lit(0.5)).otherwise(F.lit(0.0))


def signal_atividade(cfg: ScoringConfig) -> Column:
    """Activity code in the target set (exact case)."""
    if not cfg.atividades_alvo:
        return F.lit(0.0)
    return F.when(F.col("cod_atividade").isin(list(cfg.atividades_alvo)), F.lit(1.0)).otherwise(F.lit(0.0))


def signal_porte_capital(cfg: ScoringConfig) -> Column:
    """S3: mean of the configured checks (size in targets, capital within bounds)."""
    checks: list[Column] = []
    if cfg.portes_alvo:
        alvo = [p.upper() for p in cfg.portes_alvo]
        checks.append(F.when(F.upper(F.col("porte")).isin(alvo), F.lit(1.0)).otherwise(F.lit(0.0)))
    if cfg.capital_social_min is not None or cfg.capital_social_max is not None:
        cap = F.col("capital_social")
        inside = cap.isNotNull()
        if cfg.capital_social_min is not None:
            inside = inside & (cap >= F.lit(float(cfg.capital_social_min)))
        if cfg.capital_social_max is not None:
            inside = inside & (cap <= F.lit(float(cfg.capital_social_max)))
        checks.append(F.when(inside, F.lit(1.0)).otherwise(F.lit(0.0)))
    if not checks:
        return F.lit(0.0)
    total = checks[0]
    for c in checks[1:]:
        total = total + c
    return total / F.lit(float(len(checks)))


def signal_recencia(cfg: ScoringConfig, today: date) -> Column:
    """Linear decay from 1 (opened today or later) to 0 at ``recencia_dias_max``
    days; no date -> 0."""
    if cfg.recencia_dias_max is None:
        return F.lit(0.0)
    mx = int(cfg.recencia_dias_max)
    days = F.greatest(F.datediff(F.lit(today), F.col("data_inicio_atividade")), F.lit(0))
    return (
        F.when(F.col("data_inicio_atividade").isNull(), F.lit(0.0))
        .when(days >= F.lit(mx), F.lit(0.0))
        .otherwise(F.lit(1.0) - days.cast("double") / F.lit(float(mx)))
    )


def signal_regiao(cfg: ScoringConfig) -> Column:
    """upper(region) in the upper-cased targets."""
    if not cfg.regioes_alvo:
        return F.lit(0.0)
    alvo = [r.upper() for r in cfg.regioes_alvo]
    return F.when(F.upper(F.col("regiao")).isin(alvo), F.lit(1.0)).otherwise(F.lit(0.0))


def signal_columns(cfg: ScoringConfig, today: date) -> dict[str, Column]:
    return {
        "contato": signal_contato(),
        "atividade": signal_atividade(cfg),
        "porte_capital": signal_porte_capital(cfg),
        "recencia": signal_recencia(cfg, today),
        "regiao": signal_regiao(cfg),
    }


def score_column(cfg: ScoringConfig, today: date) -> Column:
    """``round(sum(w*f) / sum(w applicable) * 100, 2)``; vetoed -> 0.0; a
    non-positive denominator -> 0.0."""
    sig = signal_columns(cfg, today)
    applicable = [s for s in SIGNALS if cfg.applicable(s)]
    den = sum(cfg.weight(s) for s in applicable)
    if den <= 0:
        return F.lit(0.0)
    num = None
    for s in applicable:
        term = F.lit(cfg.weight(s)) * sig[s]
        num = term if num is None else num + term
    raw = F.round(num / F.lit(den) * F.lit(100.0), 2)
    return F.when(is_active(), raw).otherwise(F.lit(0.0))


def breakdown_column(cfg: ScoringConfig, today: date) -> Column:
    """``struct(score_icp, vetado, sinais map<signal, struct<fraction, applicable>>)``;
    a vetoed lead has an empty signal map."""
    sig = signal_columns(cfg, today)
    entries = []
    for s in SIGNALS:
        entries += [F.lit(s), F.struct(sig[s].alias("fraction"), F.lit(cfg.applicable(s)).alias("applicable"))]
    sinais = F.when(is_active(), F.create_map(*entries)).otherwise(
        F.map_from_arrays(
            F.array().cast("array<string>"),
            F.array().cast("array<struct<fraction:double,applicable:boolean>>"),
        )
    )
    return F.struct(
        score_column(cfg, today).alias("score_icp"),
        (~is_active()).alias("vetado"),
        sinais.alias("sinais"),
    )


def apply_score(df: DataFrame, cfg: ScoringConfig, today: date) -> DataFrame:
    """Fill ``score_icp``."""
    return df.withColumn("score_icp", score_column(cfg, today))


def top_k(df: DataFrame, k: int, tie_break: tuple[str, ...] = ("razao_social", "id_estab")) -> DataFrame:
    """Best ``k`` by score (ties by name, id, then the rest) - a per-task top-k and a
    k-row merge, no global sort."""
    rest = [c for c in df.columns if c not in ("score_icp",) + tie_break]
    order = [F.col("score_icp").desc_nulls_last()] + [F.col(c).asc_nulls_last() for c in tie_break + tuple(rest)]
    return df.orderBy(*order).limit(int(k))
