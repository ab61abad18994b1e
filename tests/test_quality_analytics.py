
from pyspark.sql import functions as F

from prospecta.operators import analytics as A
from prospecta.operators import gate as G
from prospecta.operators import quality as Q
from prospecta.operators import segment as SG
from tests.conftest import make_leads


def test_staging_sanity(spark):
    df = spark.createDataFrame([("1", ""), ("1", "x"), ("2", None), (None, "y"), (None, "z")], "k string, v string")
    assert Q.null_counts(df).first().asDict() == {"k": 2, "v": 2}
    assert Q.duplicate_key_count(df, ["k"]).first().duplicate_keys == 2  # "1" and NULL
    assert [(r.valor, r.n) for r in Q.distribution(df, "k").collect()] == [("1", 2), ("None", 2), ("2", 1)]
    rep = {r.coluna: (r.n_ausentes, r.n_linhas, r.chaves_duplicadas) for r in Q.sanity_report(df, "t", ["k"]).collect()}
    assert rep == {"k": (2, 5, 2), "v": (2, 5, 2)}


def test_quality_report_checks(spark):
    good = make_leads(spark, [dict(id_estab="1", municipio="X", cod_atividade="1"), dict(id_estab="2", municipio="Y", cod_atividade="1")])
    r = Q.quality_report(good).first()
    assert r.passed and r.n_rows == 2 and r.duplicate_id_estab == 0 and r.max_null_ratio == 0.0
    bad = good.unionByName(make_leads(spark, [dict(id_estab="1", situacao="ESTRANHA")]))
    r = Q.quality_report(bad).first()
    assert not r.passed and r.n_failures == 2 and r.n_situacao_fora_dominio == 1
    strict = Q.QualityThresholds(max_null_ratio={"municipio": 0.1})
    assert Q.quality_report(bad, strict).first().n_failures == 3
    empty = Q.quality_report(good.where("false")).first()
    assert empty.n_rows == 0 and empty.n_failures == 1 and not empty.passed  # only the row-count check


def test_situacao_domain_labels_null(spark):
    df = make_leads(spark, [dict(situacao=None), dict(situacao="ATIVA"), dict(situacao="X")])
    got = {r.situacao: r.fora_do_dominio for r in Q.situacao_domain(df).collect()}
    assert got == {"(nulo)": False, "ATIVA": False, "X": True}


def test_chart_top_n_and_null_label(spark):
    rows = [dict(id_estab=str(i), regiao=["SP", "RJ", None][i % 3]) for i in range(9)] + [dict(id_estab="x", regiao="SP")]
    got = [(r.valor, r.n) for r in A.chart_counts(make_leads(spark, rows), SG.Criteria(), "regiao", top_n=2).collect()]
    assert got == [("SP", 4), ("(sem valor)", 3)]


def test_tam_cube_grouping(spark):
    df = make_leads(spark, [dict(cod_atividade="1", regiao="SP", porte="A"), dict(cod_atividade="1", regiao="RJ", porte="A")])
    cube = {(r.cod_atividade, r.regiao, r.porte, r.grouping_id): r.n for r in A.tam_cube(df, SG.Criteria()).collect()}
    assert cube[(None, None, None, 7)] == 2 and cube[("1", None, None, 3)] == 2 and cube[("1", "SP", "A", 0)] == 1
    assert len(cube) == 12  # 2 full rows + rollups


def test_compliance_panel(spark):
    rows = [dict(id_estab="1", email="a@d.com"), dict(id_estab="1", email="a@d.com"), dict(id_estab="2", email="b@d.com"),
            dict(id_estab="3", is_synthetic=True), dict(id_estab="4", flag_difusao_restrita=True, is_synthetic=True),
            dict(id_estab="5")]
    opt = G.load_optout(spark.createDataFrame([("5", "")], "id_estab string, email string"))
    p = A.compliance_panel(spark, make_leads(spark, rows), SG.Criteria(), opt).first()
    assert (p.total_bruto, p.n_sinteticos, p.n_difusao_restrita, p.n_duplicados, p.n_opt_out, p.total_exportavel) == (6, 2, 1, 2, 1, 1)


def test_source_status_keeps_never_run_sources(spark):
    known = spark.createDataFrame([("A",), ("B",)], "fonte string")
    ledger = spark.createDataFrame(
        [("A", "2024-01", "2024-02-01 00:00:00"), ("A", "2024-02", "2024-03-01 00:00:00")], "fonte string, competencia string, run_at string"
    ).withColumn("run_at", F.col("run_at").cast("timestamp_ntz"))
    got = {r.fonte: r.ultima_competencia for r in A.source_status(known, ledger).collect()}
    assert got == {"A": "2024-02", "B": None}


def test_ids_of_the_largest_sub_map_by_its_index_count(spark):
    from prospecta.operators.enrich import discover_ids

    entry = "<loc>{}</loc>\n  <lastmod>2024-01-01</lastmod> <!--{}-->".format
    one = "<loc>https://x.example/office/{:014d}</loc>".format
    rows = [
        ("i1", entry("a.xml", 9) + entry("b.xml", 12)),
        ("i2", entry("c.xml", 12) + "<loc>d.xml</loc><!--99-->"),  # no date: not an entry
        ("a.xml", "".join(map(one, range(40)))),
        ("b.xml", "".join(map(one, [5, 3, 5, 7, 3, 1])) + "/office/123"),
        ("c.xml", one(8)),
    ]
    landed = spark.createDataFrame(rows, "url string, body string")
    got = [(r.pos, r.id) for r in discover_ids(landed, 3).collect()]
    assert got == [(0, f"{5:014d}"), (1, f"{3:014d}"), (3, f"{7:014d}")]
    assert discover_ids(landed.where("url like '%.xml'"), 3).count() == 0


def test_text_activity_codes_keep_their_zeros(spark):
    from datetime import datetime

    from prospecta.operators.enrich import brasilapi_updates

    docs = spark.createDataFrame([('{"cnpj": "1", "cnae_fiscal": "0111301"}',), ('{"cnpj": "2", "cnae_fiscal": 6201501}',)], "payload string")
    got = {r.cnpj: r.cod_atividade for r in brasilapi_updates(docs, datetime(2024, 1, 1)).collect()}
    assert got == {"1": "0111301", "2": "6201501"}
