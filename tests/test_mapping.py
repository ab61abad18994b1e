"""Registry files -> canonical leads (BR join, FR pair, OpenCNPJ JSON, contract)."""

import json
import os
from datetime import date

from prospecta import schema as S
from prospecta.operators import mapping as M
from prospecta.plans import ingest as I
from prospecta.sources import registry as R

EMPRESAS = [
    '11111111;"PADARIA SÃO JOÃO LTDA";2062;49;150000,00;01;',
    '22222222;"COMÉRCIO DE CONFECÇÕES LTDA";2062;49;5000,50;03;',
    '33333333;"MUNICIPIO DE TESTE - SP";1244;49;0,00;05;SP',
]


def estab(basico, ordem, dv, sit, inicio, cnae2, uf, mun, email, numero="10"):
    f = [basico, ordem, dv, "1", "LOJA", sit, "20200101", "0", "", "", inicio, "4721102", cnae2, "RUA", "X",
         numero, "", "CENTRO", "01001000", uf, mun, "11", "12345678", "", "", "", "", email, "", ""]
    return ";".join(f)


ESTAB = [
    estab("11111111", "0001", "91", "02", "20200101", "4722901,4729699", "SP", "7107", "contato@padaria.com.br", "S/N"),
    estab("22222222", "0001", "06", "08", "00000000", "", "RJ", "6001", ""),
    estab("33333333", "0001", "50", "03", "20190315", "", "SP", "9999", ""),
    estab("44444444", "0001", "00", "02", "20200101", "", "SP", "7107", "orfa@x.com"),  # no company
]
SIMPLES = ["11111111;S;20180101;;N;;", "22222222;N;;;S;20190601;", "33333333;;;;;;"]
MUNICIPIO = ["7107;SAO PAULO", "6001;RIO DE JANEIRO"]
NATUREZA = ["2062;SOCIEDADE EMPRESARIA LIMITADA", "1244;ADMINISTRACAO PUBLICA MUNICIPAL"]


def write(path, lines, encoding="latin-1"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write("\n".join(lines) + "\n")
    return path


def local(p):
    return p[5:] if p.startswith("file:") else p


def br_tables(spark, root):
    d = local(root)
    rd = lambda name, lines, cols: R.read_positional_csv(spark, write(f"{d}/{name}", lines), cols).rows
    return (
        rd("K.ESTABELE", ESTAB, S.ESTABELECIMENTOS_COLUMNS),
        rd("K.EMPRECSV", EMPRESAS, S.EMPRESAS_COLUMNS),
        rd("F.SIMPLES.CSV", SIMPLES, S.SIMPLES_COLUMNS),
        R.read_lookup(spark, write(f"{d}/MUNIC.csv", MUNICIPIO)),
        R.read_lookup(spark, write(f"{d}/NATJU.csv", NATUREZA)),
    )


def test_br_join_and_mapping(spark, scratch):
    e, em, s, mun, nat = br_tables(spark, scratch("br"))
    joined = M.br_joined(e, em, s, mun, nat)
    assert joined.count() == 4  # LEFT joins never drop establishments
    valid, rejected = M.enforce_contract(M.br_to_canonical(joined))
    rows = {r.id_estab: r for r in valid.collect()}
    assert sorted(rows) == ["11111111000191", "22222222000106", "33333333000150"]
    r1 = rows["11111111000191"]
    assert r1.razao_social == "PADARIA SÃO JOÃO LTDA" and r1.situacao == "ATIVA" and r1.porte == "MICRO EMPRESA"
    assert r1.municipio == "SAO PAULO" and r1.natureza_juridica == "SOCIEDADE EMPRESARIA LIMITADA"
    assert r1.capital_social == 150000.0 and r1.data_inicio_atividade == date(2020, 1, 1)
    assert r1.telefone == "1112345678" and r1.fonte == "BR_RECEITA" and r1.flag_difusao_restrita is False
    r2, r3 = rows["22222222000106"], rows["33333333000150"]
    assert r2.situacao == "BAIXADA" and r2.data_inicio_atividade is None and r2.email is None and r2.capital_social == 5000.5
    assert r3.situacao == "SUSPENSA" and r3.municipio == "9999" and r3.porte == "DEMAIS"  # code kept when no label
    rej = rejected.collect()
    assert [(r.id_estab, r.reject_reason) for r in rej] == [("44444444000100", "razao_social vazio")]


def test_parse_estabelecimentos_typed(spark, scratch):
    e, *_ = br_tables(spark, scratch("br2"))
    p = {r.cnpj_basico: r for r in M.parse_estabelecimentos(e).collect()}
    assert p["11111111"].cnae_fiscal_secundaria == ["4722901", "4729699"]
    assert p["22222222"].cnae_fiscal_secundaria == []
    assert p["11111111"].numero == "S/N" and p["22222222"].data_inicio_atividade is None


UL_HEADER = list(S.UNITE_LEGALE_COLUMNS)
ET_HEADER = list(S.ETABLISSEMENT_COLUMNS)


def csv_rows(header, rows, spaced=()):
    import csv
    import io

    buf = io.StringIO()
    w = csv.writer(buf, lineterminator="\n")
    w.writerow([h + " " if h in spaced else h for h in header])
    for r in rows:
        w.writerow([r.get(h, "") for h in header])
    return buf.getvalue().splitlines()


def fr_files(spark, root, extra_orphan=False):
    d = local(root)
    ul = [
        dict(siren="123456789", statutDiffusionUniteLegale="O", denominationUniteLegale="ACME SAS", categorieEntreprise="PME",
             categorieJuridiqueUniteLegale="5710", sigleUniteLegale="ACM", etatAdministratifUniteLegale="A"),
        dict(siren="987654321", statutDiffusionUniteLegale="P", prenom1UniteLegale="MARIE", nomUniteLegale="DUPONT",
             categorieJuridiqueUniteLegale="1000", etatAdministratifUniteLegale="A"),
        dict(siren="111222333", statutDiffusionUniteLegale="", denominationUniteLegale="FERMEE SARL", etatAdministratifUniteLegale="C"),
    ]
    et = [
        dict(siren="123456789", nic="00015", siret="12345678900015", statutDiffusionEtablissement="O", etatAdministratifEtablissement="A",
             codePostalEtablissement="75001", libelleCommuneEtablissement="PARIS", activitePrincipaleEtablissement="62.01Z",
             dateCreationEtablissement="2015-06-01"),
        dict(siren="987654321", nic="00012", siret="98765432100012", statutDiffusionEtablissement="P", etatAdministratifEtablissement="A",
             codePostalEtablissement="75002", enseigne1Etablissement="CHEZ MARIE"),
        dict(siren="111222333", nic="00021", siret="11122233300021", statutDiffusionEtablissement="", etatAdministratifEtablissement="F",
             codePostalEtablissement="69001"),
    ]
    if extra_orphan:
        et.append(dict(siren="555555555", nic="00001", siret="55555555500001", statutDiffusionEtablissement="O"))
    u = write(f"{d}/StockUniteLegale_utf8.csv", csv_rows(UL_HEADER, ul), "utf-8")
    # establishments: different column order and trailing spaces in two header names
    e = write(f"{d}/StockEtablissement_utf8.csv", csv_rows(list(reversed(ET_HEADER)), et, spaced={"siret", "nic"}), "utf-8")
    return u, e


def test_fr_pair_mapping_flags_or(spark, scratch):
    u, e = fr_files(spark, scratch("fr"), extra_orphan=True)
    ul = M.parse_unite_legale(R.read_named_csv(spark, u, S.UNITE_LEGALE_COLUMNS))
    et = M.parse_etablissement(R.read_named_csv(spark, e, S.ETABLISSEMENT_COLUMNS))
    valid, rejected = M.enforce_contract(M.fr_to_canonical(M.fr_joined(ul, et)))
    rows = {r.id_estab: r for r in valid.collect()}
    assert [rows[k].flag_difusao_restrita for k in sorted(rows)] == [True, False, True]  # 111.., 123.., 987..
    acme = rows["12345678900015"]
    assert acme.razao_social == "ACME SAS" and acme.regiao == "75" and acme.situacao == "ATIVA" and acme.nome_fantasia == "ACM"
    assert acme.porte == "PME" and acme.cod_atividade == "62.01Z" and acme.data_inicio_atividade == date(2015, 6, 1)
    marie = rows["98765432100012"]
    assert marie.razao_social == "MARIE DUPONT" and marie.nome_fantasia == "CHEZ MARIE"
    assert rows["11122233300021"].situacao == "BAIXADA"
    assert [r.siret for r in M.fr_orphans(ul, et).collect()] == ["55555555500001"]


def test_named_csv_missing_column_raises(spark, scratch):
    import pytest

    d = local(scratch("frbad"))
    p = write(f"{d}/StockUniteLegale.csv", ["siren,foo", "1,2"], "utf-8")
    with pytest.raises(ValueError):
        R.read_named_csv(spark, p, S.UNITE_LEGALE_COLUMNS)


def test_latest_legal_unit_wins(spark):
    ul = spark.createDataFrame(
        [("1", "2020-01-01", "OLD"), ("1", "2024-01-01", "NEW"), ("", "2025-01-01", "BLANK")],
        "siren string, data_ultimo_tratamento string, razao_social string",
    )
    assert [(r.siren, r.razao_social) for r in M.latest_unite_legale(ul).collect()] == [("1", "NEW")]


def test_opencnpj_payload(spark):
    doc = {
        "cnpj": "12.345.678/0001-90", "situacaoCadastral": "Ativa", "razaoSocial": "Empresa X", "nomeFantasia": "",
        "dataInicioAtividades": "01/02/2020", "naturezaJuridica": "Sociedade Empresária Limitada (2062)",
        "capitalSocial": 1000.5, "email": "A@B.COM", "telefone": "(11) 1234-5678", "municipio": "SAO PAULO", "uf": "SP",
        "cep": "01001-000", "cnaes": [{"cnae": "4721-1/02", "descricao": "x"}, {"cnae": "1", "descricao": "y"}],
    }
    df = spark.createDataFrame([(json.dumps(doc),), (json.dumps({"cnpj": "1", "razaoSocial": ""}),)], "payload string")
    valid, rejected = M.enforce_contract(M.opencnpj_to_canonical(df))
    r = valid.first()
    assert (r.id_legal, r.id_estab, r.cod_atividade, r.situacao, r.email) == ("12345678", "12345678000190", "4721102", "ATIVA", "a@b.com")
    assert r.natureza_juridica == "Sociedade Empresária Limitada" and r.nome_fantasia is None and r.porte is None
    assert r.data_inicio_atividade == date(2020, 2, 1) and r.capital_social == 1000.5 and r.telefone == "1112345678"
    assert rejected.count() == 1


def test_stage_directory_routes_by_name(spark, scratch):
    d = scratch("landing")
    ld = local(d)
    write(f"{ld}/K3241.K03200Y0.D50812.EMPRECSV", EMPRESAS + ["99999999;short"])
    write(f"{ld}/K3241.K03200Y0.D50812.ESTABELE", ESTAB)
    write(f"{ld}/K3241.K03200Y0.D50812.SOCIOCSV", ["ignored;row"])
    counts = I.stage_directory(spark, d, scratch("staged"))
    assert counts == {"EMPRESAS": {"rows": 3, "malformed": 1}, "ESTABELECIMENTOS": {"rows": 4, "malformed": 0}}
    counts = I.stage_directory(spark, d, scratch("staged2"), only=["EMPRESAS"])
    assert list(counts) == ["EMPRESAS"]


def _joined_row(spark, **over):
    base = dict(cnpj_basico="11111111", cnpj_completo="11111111000191", nome_fantasia=None, situacao_cadastral="02",
                data_inicio_atividade=None, cnae_fiscal_principal="4721102", uf="SP", municipio_codigo="7107",
                municipio_descricao=None, cep="01001000", ddd_1=None, telefone_1=None, correio_eletronico=None,
                razao_social="EMPRESA", natureza_juridica_codigo="2062", natureza_juridica_descricao=None,
                capital_social=None, porte_empresa="01", opcao_pelo_simples=None, opcao_pelo_mei=None)
    base.update(over)
    schema = ("cnpj_basico string, cnpj_completo string, nome_fantasia string, situacao_cadastral string, "
              "data_inicio_atividade date, cnae_fiscal_principal string, uf string, municipio_codigo string, "
              "municipio_descricao string, cep string, ddd_1 string, telefone_1 string, correio_eletronico string, "
              "razao_social string, natureza_juridica_codigo string, natureza_juridica_descricao string, "
              "capital_social decimal(18,2), porte_empresa string, opcao_pelo_simples string, opcao_pelo_mei string")
    return spark.createDataFrame([tuple(base.values())], schema)


def test_br_mapping_fallbacks(spark):
    def one(**over):
        valid, rejected = M.enforce_contract(M.br_to_canonical(_joined_row(spark, **over)))
        rows = valid.collect()
        return rows[0] if rows else None

    assert one(ddd_1="11", telefone_1=None).telefone == "11"
    assert one(ddd_1=None, telefone_1=None).telefone is None
    r = one(municipio_descricao="SAO PAULO", natureza_juridica_descricao="LTDA")
    assert (r.municipio, r.natureza_juridica) == ("SAO PAULO", "LTDA")
    r = one()
    assert (r.municipio, r.natureza_juridica, r.situacao, r.porte) == ("7107", "2062", "ATIVA", "MICRO EMPRESA")
    assert one(situacao_cadastral="99").situacao == "99"
    assert (r.fonte, r.is_synthetic, r.flag_difusao_restrita, r.score_icp) == ("BR_RECEITA", False, False, None)
    assert one(razao_social=None) is None


def _fr_pair(spark, ul=None, et=None):
    u = dict(siren="1", flag_difusao_restrita=False, razao_social="UL", prenome_usual=None, prenome_1=None, nome=None,
             sigla=None, nome_fantasia=None, cod_atividade="UL.A", situacao="A", data_criacao=None, categoria_empresa=None,
             natureza_juridica=None)
    e = dict(siren="1", siret="100001", flag_difusao_restrita=False, nome_fantasia=None, cod_atividade=None, situacao=None,
             cep=None, municipio=None, data_criacao=None)
    u.update(ul or {})
    e.update(et or {})
    j = {**{f"ul_{k}": v for k, v in u.items()}, **{f"et_{k}": v for k, v in e.items()}}
    schema = ", ".join(f"{k} {'boolean' if k.endswith('flag_difusao_restrita') else 'date' if k.endswith('data_criacao') else 'string'}" for k in j)
    valid, _ = M.enforce_contract(M.fr_to_canonical(spark.createDataFrame([tuple(j.values())], schema)))
    rows = valid.collect()
    return rows[0] if rows else None


def test_fr_mapping_precedence_and_flags(spark):
    r = _fr_pair(spark)
    assert (r.cod_atividade, r.situacao, r.regiao, r.capital_social, r.fonte) == ("UL.A", "ATIVA", None, None, "FR_SIRENE")
    assert _fr_pair(spark, et=dict(nome_fantasia="ENSEIGNE"), ul=dict(sigla="SIG")).nome_fantasia == "ENSEIGNE"
    assert _fr_pair(spark, ul=dict(sigla="SIG", nome_fantasia="DENOM")).nome_fantasia == "SIG"
    assert _fr_pair(spark, ul=dict(nome_fantasia="DENOM")).nome_fantasia == "DENOM"
    assert _fr_pair(spark, et=dict(cod_atividade="ET.B", situacao="F")).cod_atividade == "ET.B"
    assert _fr_pair(spark, et=dict(situacao="F")).situacao == "BAIXADA"
    assert _fr_pair(spark, ul=dict(razao_social=None, prenome_usual="JEAN", prenome_1="J", nome="MARTIN")).razao_social == "JEAN MARTIN"
    assert _fr_pair(spark, ul=dict(razao_social=None)) is None
    assert _fr_pair(spark, et=dict(cep="13001")).regiao == "13"
    assert _fr_pair(spark, ul=dict(flag_difusao_restrita=True)).flag_difusao_restrita is True
    assert _fr_pair(spark, et=dict(flag_difusao_restrita=True)).flag_difusao_restrita is True


def test_opencnpj_without_activities(spark):
    df = spark.createDataFrame([(json.dumps({"cnpj": "12345678000190", "razaoSocial": "X", "cnaes": []}),)], "payload string")
    valid, _ = M.enforce_contract(M.opencnpj_to_canonical(df))
    r = valid.first()
    assert r.cod_atividade is None and r.natureza_juridica is None and r.situacao is None and r.fonte == "BR_OPENCNPJ"


def test_br_join_without_simples(spark, scratch):
    e, em, s, mun, nat = br_tables(spark, scratch("br3"))
    j = M.br_joined(e, em, None, mun, nat)
    assert j.count() == 4 and j.where("opcao_pelo_simples is not null").count() == 0
