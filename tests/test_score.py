from datetime import date, timedelta


from prospecta.operators import score as SC
from tests.conftest import make_leads

TODAY = date(2024, 1, 1)


def score(spark, cfg, **lead):
    df = SC.apply_score(make_leads(spark, [lead]), cfg, TODAY)
    return df.first().score_icp


def test_veto(spark):
    assert score(spark, SC.ScoringConfig(), situacao="BAIXADA", email="a@b") == 0.0
    assert score(spark, SC.ScoringConfig(), situacao=None, email="a@b") == 0.0
    assert score(spark, SC.ScoringConfig(recencia_dias_max=None), situacao="ativa", email="a@b", telefone="1") == 100.0


def test_contact_weights_alone(spark):
    cfg = SC.ScoringConfig(recencia_dias_max=None)
    assert score(spark, cfg, email="a@b", telefone="1") == 100.0
    assert score(spark, cfg, email="a@b") == 50.0
    assert score(spark, cfg, email="", telefone="") == 0.0


def test_recency_linear_decay(spark):
    cfg = SC.ScoringConfig(peso_contato=0.0, recencia_dias_max=730)
    assert score(spark, cfg, data_inicio_atividade=TODAY) == 100.0
    assert score(spark, cfg, data_inicio_atividade=TODAY - timedelta(days=365)) == 50.0
    assert score(spark, cfg, data_inicio_atividade=TODAY - timedelta(days=730)) == 0.0
    assert score(spark, cfg, data_inicio_atividade=TODAY + timedelta(days=30)) == 100.0
    assert score(spark, cfg, data_inicio_atividade=None) == 0.0


def test_porte_capital_mean_of_checks(spark):
    cfg = SC.ScoringConfig(peso_contato=0.0, recencia_dias_max=None, portes_alvo={"micro empresa"}, capital_social_min=1000)
    assert score(spark, cfg, porte="MICRO EMPRESA", capital_social=5000.0) == 100.0
    assert score(spark, cfg, porte="MICRO EMPRESA", capital_social=None) == 50.0
    assert score(spark, cfg, porte="DEMAIS", capital_social=10.0) == 0.0


def test_weighted_mean_over_applicable_signals(spark):
    cfg = SC.ScoringConfig(atividades_alvo={"8630501"}, regioes_alvo={"sp"}, recencia_dias_max=None)
    # contato 20*0.5 + atividade 25*1 + regiao 20*1 = 55 over 65
    assert score(spark, cfg, email="a@b", cod_atividade="8630501", regiao="SP") == round(55 / 65 * 100, 2)


def test_no_applicable_signal_scores_zero(spark):
    cfg = SC.ScoringConfig(peso_contato=0.0, recencia_dias_max=None)
    assert score(spark, cfg, email="a@b") == 0.0


def test_breakdown_struct(spark):
    cfg = SC.ScoringConfig(atividades_alvo={"1"})
    r = make_leads(spark, [dict(cod_atividade="1")]).select(SC.breakdown_column(cfg, TODAY).alias("b")).first().b
    assert r.vetado is False and r.sinais["atividade"].fraction == 1.0 and r.sinais["regiao"].applicable is False
    r = make_leads(spark, [dict(situacao="BAIXADA")]).select(SC.breakdown_column(cfg, TODAY).alias("b")).first().b
    assert r.vetado is True and r.sinais == {} and r.score_icp == 0.0


def test_scores_bounded_and_topk(spark):
    rows = [dict(id_estab=str(i), email="a@b" if i % 2 else None, telefone="1" if i % 3 else None) for i in range(20)]
    df = SC.apply_score(make_leads(spark, rows), SC.ScoringConfig(recencia_dias_max=None), TODAY)
    vals = [r.score_icp for r in df.collect()]
    assert all(0.0 <= v <= 100.0 for v in vals)
    top = SC.top_k(df, 3).collect()
    assert [r.score_icp for r in top] == sorted(vals, reverse=True)[:3]
