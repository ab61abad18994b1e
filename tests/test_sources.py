import os

from pyspark.sql import functions as F
from prospecta import schema as S
from prospecta.sources import registry as R
from tests.test_mapping import local, write


def test_quotes_blank_lines_and_malformed_rows(spark, scratch):
    d = local(scratch("csv"))
    lines = ['11111111;"PADARIA SÃO JOÃO LTDA";2062;49;150000,00;01;',
             '22222222;"CONFEITARIA ""AÇÚCAR""; CAFÉ E CIA";2062;49;5000,50;03;',
             "", "33333333;short;row", "44444444;A;B;C;D;E;F;G;H", "55555555;;;;;;"]
    p = write(f"{d}/x.EMPRECSV", lines)
    scan = R.read_positional_csv(spark, p, S.EMPRESAS_COLUMNS)
    rows = {r.cnpj_basico: r for r in scan.rows.collect()}
    assert rows["22222222"].razao_social == 'CONFEITARIA "AÇÚCAR"; CAFÉ E CIA'
    assert rows["55555555"].razao_social == ""  # empty field stays '' as in the raw file
    # counts do not depend on which columns a query reads
    assert scan.rows.count() == 3 == len(rows)
    assert scan.malformed.count() == 2
    assert sorted(r.campo0 for r in scan.malformed.collect()) == ["33333333", "44444444"]


def test_lookup_duplicates_do_not_fan_out(spark, scratch):
    d = local(scratch("lk"))
    p = write(f"{d}/lk.csv", ["1;A", "1;B", "2;C", "onlyone"])
    assert sorted((r.codigo, r.descricao) for r in R.read_lookup(spark, p).collect()) == [("1", "B"), ("2", "C")]


def test_probe(spark, scratch):
    d = local(scratch("probe"))
    p = write(f"{d}/s.csv", ['a;"CONFEITARIA ""AÇÚCAR""; CAFÉ";;x', "b;c;;y", "c;d;;", "d;e;;z"])
    stats, sample = R.probe_csv(spark, p, sample_size=2)
    got = {r.coluna: (r.n_nao_nulos, r.n_linhas) for r in stats.collect()}
    assert got == {"column00": (4, 4), "column01": (4, 4), "column02": (0, 4), "column03": (3, 4)}
    s = sample.collect()
    assert len(s) == 2 and 'CONFEITARIA "AÇÚCAR"; CAFÉ' in [r.column01 for r in s]


def test_entity_detection():
    assert R.detect_br_entity("K3241.K03200Y0.D50812.ESTABELE") == "ESTABELECIMENTOS"
    assert R.detect_br_entity("k.emprecsv") == "EMPRESAS"
    assert R.detect_br_entity("F.K03200$W.SIMPLES.CSV.D50812") == "SIMPLES"
    assert R.detect_br_entity("SOCIOCSV") is None
    assert R.detect_fr_entity("StockEtablissement_utf8.zip") == "ETABLISSEMENT"
    assert R.detect_fr_entity("StockEtablissementHistorique_utf8.zip") is None
    assert R.detect_fr_entity("StockUniteLegale_utf8.csv") == "UNITE_LEGALE"
    assert R.detect_fr_entity("StockDoublons.csv") is None


def test_optout_csv_missing_file_is_empty(spark, scratch):
    o = R.read_optout_csv(spark, scratch("nope") + "/suppression.csv")
    assert o.ids.count() == 0 and o.emails.count() == 0
    d = local(scratch("supp"))
    p = write(f"{d}/s.csv", ["id_estab,email,motivo", " 1 ,,x", ", A@B.com ,y", ",,z"], "utf-8")
    o = R.read_optout_csv(spark, p)
    assert [r[0] for r in o.ids.collect()] == ["1"] and [r[0] for r in o.emails.collect()] == ["a@b.com"]


def test_rows_and_malformed_lines_are_all_lines(spark, scratch):
    """Blank first fields, quoted or not, are rows; short and long lines are kept aside."""
    from prospecta.sources import registry as R

    path = scratch("lines")
    lines = [";sem codigo", '"";vazio', " ;espaco", "1;A", '2;"B ""C""; D"', "3", "4;a;b", ";;"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    scan = R.read_positional_csv(spark, path, ("codigo", "descricao"), encoding="UTF-8")
    assert scan.rows.count() == 5 and scan.malformed.count() == 3
    assert sorted(r.linha for r in scan.malformed.select("linha").collect()) == ["3", "4;a;b", ";;"]
    assert {r.descricao for r in scan.rows.select("descricao").collect()} == {"sem codigo", "vazio", "espaco", "A", 'B "C"; D'}
    assert R.read_lookup(spark, path, encoding="UTF-8").where("codigo = ''").first().descricao == "vazio"


def test_long_codes_are_not_cut(spark):
    from prospecta.functions.normalize import lpad_code

    got = spark.range(1).select(lpad_code(F.lit(1234567890), 8).alias("a"), lpad_code(F.lit(12), 8).alias("b")).first()
    assert tuple(got) == ("1234567890", "00000012")


def expected_records(text):
    import csv
    import io

    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=";", quotechar='"') if r]
    return sorted(tuple(r) for r in rows if len(r) == 2), sum(len(r) != 2 for r in rows)


def random_text(rng, mode):
    picks = {
        1: ["x", "", '"q"', '"a;b"', '"m\nn"', '"c""d"', '"\r\n"', 'u"v', '"z"z'],
        2: ["x", "", '"q"', "a\x01b", "\x00z", "\x00", "\x01"],
        3: ['"x"', '""', '"q"""', '"\n"', '"' + "long " * 10 + '"'],
    }
    out = ""
    for _ in range(rng.randint(0, 60)):
        if mode == 0:
            line = "".join(rng.choice('ab;"\x00\x01é') for _ in range(rng.randint(0, 12)))
        else:
            line = ";".join(rng.choice(picks[mode]) for _ in range(rng.choice([2, 2, 2, 3])))
        out += line + rng.choice(["\n", "\r\n"])
    return out


def test_records_over_lines_equal_the_csv_reader_across_splits(spark, scratch):
    """Files cut into splits of some 100 bytes: the records are those of a reader that
    goes through the file from its start."""
    import random

    rng = random.Random(11)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for t in range(8):
            d, text = local(scratch("records")), random_text(rng, t % 4)
            os.makedirs(d, exist_ok=True)
            with open(f"{d}/f.csv", "w", encoding="latin-1", newline="") as f:
                f.write(text)
            scan = R.read_positional_csv(spark, f"{d}/f.csv", ("a", "b"))
            good, bad = expected_records(text)
            assert sorted(tuple(r) for r in scan.rows.collect()) == good, text
            assert scan.malformed.count() == bad, text
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_control_characters_and_quoted_breaks_stay(spark, scratch):
    d = local(scratch("ctl"))
    p = write(f"{d}/x.csv", ["1;ab\x01cd", "\x014;kept", "\x00lead;\x00", '5;"x', 'y"', '"6";"a""', '"";;b"', "7;u\"v", '"8"z;w', " ", ""])
    scan = R.read_positional_csv(spark, p, ("a", "b"))
    assert {tuple(r) for r in scan.rows.collect()} == {("1", "ab\x01cd"), ("\x014", "kept"), ("\x00lead", "\x00"), ("5", "x\ny"), ("6", 'a"\n";;b'), ("7", 'u"v'), ("8z", "w")}
    assert [r.linha for r in scan.malformed.collect()] == [" "]


def test_a_quote_that_is_never_closed_rejects_its_lines_only(spark, scratch, monkeypatch):
    from prospecta.sources import records

    monkeypatch.setattr(records, "LONGEST", 200)
    d = local(scratch("open"))
    lines = ["1;a", '2;"b', 'c"', '3;"never closed'] + [f"{k};d" for k in range(100)]
    p = write(f"{d}/x.csv", lines)
    write(f"{d}/y.csv", ["8;fine"])
    scan = R.read_positional_csv(spark, [p, f"{d}/y.csv"], ("a", "b"))
    assert sorted(tuple(r) for r in scan.rows.collect()) == [("1", "a"), ("2", "b\nc"), ("8", "fine")]
    assert scan.malformed.count() == 101


def test_lines_without_a_quote_stay_out_of_the_windows(spark, scratch, monkeypatch):
    """Records over several lines, some of them without a quote and over several splits: only
    lines with a quote are stored with their states, and every record is whole."""
    from prospecta.sources import records

    stored = {}
    path = records.scratch_path
    monkeypatch.setattr(records, "scratch_path", lambda s, name: stored.setdefault(name, path(s, name)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    d = local(scratch("inner"))
    long = "\n".join(f"inner line {k}" for k in range(40))
    lines = [f"{k};x" for k in range(60)] + [f'60;"{long}"'] + [f"{k};y" for k in range(61, 90)] + ['90;"open', "inside", 'end"', "91;z"]
    p = write(f"{d}/x.csv", lines)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = {r.a: r.b for r in R.read_positional_csv(spark, p, ("a", "b")).rows.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == 92 and got["60"] == long and got["90"] == "open\ninside\nend" and got["91"] == "z"
    assert spark.read.parquet(stored["stated-lines"]).count() == 4  # of 133 lines
