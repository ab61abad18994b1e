from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from prospecta.functions import normalize as N


def one(spark, expr, value, t="string"):
    return spark.createDataFrame([(value,)], f"v {t}").select(expr(F.col("v")).alias("r")).first().r


def one_named(spark, fn, value, t="string"):
    return spark.createDataFrame([(value,)], f"v {t}").select(fn("v").alias("r")).first().r


def test_strip_matches_python_whitespace(spark):
    for v in ["  a b  ", "\tx\n", "\xa0nbsp\xa0", "　wide　", "", "plain"]:
        assert one_named(spark, N.strip, v) == v.strip()
        assert one(spark, N.strip, v) == v.strip()


def test_blank_to_null(spark):
    assert one_named(spark, N.blank_to_null, "   ") is None
    assert one_named(spark, N.blank_to_null, " x ") == "x"
    # SQL NULLIF form keeps whitespace
    assert one(spark, lambda c: N.blank_to_null(c, trim=False), "  ") == "  "
    assert one(spark, lambda c: N.blank_to_null(c, trim=False), "") is None


def test_dates(spark):
    assert one(spark, N.parse_yyyymmdd, "20200101") == date(2020, 1, 1)
    for bad in ["00000000", "0", "", "INVALIDA", "20201301"]:
        assert one(spark, N.parse_yyyymmdd, bad) is None
    assert one(spark, N.parse_iso_date, "2021-03-04T10:00:00") == date(2021, 3, 4)
    assert one(spark, N.parse_iso_date, "not a date") is None
    assert one(spark, N.parse_ddmmyyyy, "1/2/2020") == date(2020, 2, 1)
    assert one(spark, N.parse_ddmmyyyy, "31/02/2020") is None


def test_comma_decimal(spark):
    assert one(spark, N.parse_comma_decimal, "150000,00") == Decimal("150000.00")
    assert one(spark, N.parse_comma_decimal, "1500,005") == Decimal("1500.01")  # HALF_UP
    assert one(spark, N.parse_comma_decimal, "N/A") is None
    assert one(spark, N.parse_comma_decimal, "") is None


def test_split_list_never_null(spark):
    assert one(spark, N.split_list, "4722901, 4729699,,") == ["4722901", "4729699"]
    assert one(spark, N.split_list, "") == []
    assert one(spark, N.split_list, None) == []


def test_phone_labels_and_fallbacks(spark):
    df = spark.createDataFrame([("11", "1234"), (None, None), ("", "99")], "d string, n string")
    assert [r.t for r in df.select(N.compose_phone("d", "n").alias("t")).collect()] == ["111234", None, "99"]
    labels = {"02": "ATIVA"}
    assert one(spark, lambda c: N.map_labels(c, labels), "02") == "ATIVA"
    assert one(spark, lambda c: N.map_labels(c, labels), "77") == "77"  # unknown kept raw
    assert one(spark, lambda c: N.map_labels(c, labels), "") is None


def test_postcode_person_digits_email(spark):
    assert one(spark, N.departement_from_postcode, "75001") == "75"
    assert one(spark, N.departement_from_postcode, "AB123") is None
    assert one(spark, N.departement_from_postcode, "7") is None
    df = spark.createDataFrame([(None, "MARIE", "DUPONT"), (None, None, None)], "u string, p string, n string")
    assert [r.x for r in df.select(N.person_name("u", "p", "n").alias("x")).collect()] == ["MARIE DUPONT", None]
    assert one(spark, N.only_digits, "12.345.678/0001-90") == "12345678000190"
    assert one(spark, N.only_digits, "abc") is None
    assert one(spark, N.strip_trailing_code, "Sociedade Limitada (2062)") == "Sociedade Limitada"
    assert one(spark, N.email_domain, "A@b@Empresa.COM.br ") == "empresa.com.br"
    assert one(spark, N.email_domain, "sem-arroba") is None
    assert one(spark, N.email_domain, "x@") is None


def test_restricted_flag_is_conservative(spark):
    assert one(spark, N.restricted_flag, " o ") is False
    assert one(spark, N.restricted_flag, "P") is True
    assert one(spark, N.restricted_flag, None) is True
    assert one(spark, N.restricted_flag_exact, "o") is True  # API form: exact "O"
    assert one(spark, N.restricted_flag_exact, None) is True


def test_split_csv_field():
    assert N.split_csv_field(" a, ,b ,") == ["a", "b"]
    assert N.split_csv_field(" , ") is None


def test_clean_texts_are_not_held_against_the_list_of_blanks(spark):
    odd = ["", " ", "\t a ", "a", "!", "~x", " 2020-01-02 ", "2020-01-02T10", "2020-1-2", "　x", "é", "\x7f", "x\x85", " ", None, "2020-02-30"]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    got = df.select(N.strip("x").alias("s"), N.blank_to_null("x").alias("b"), N.parse_iso_date("x").cast("string").alias("d")).collect()
    assert [r.s for r in got] == [None if x is None else x.strip() for x in odd]
    assert [r.b for r in got] == [None if x is None else x.strip() or None for x in odd]
    assert [r.d for r in got] == [{" 2020-01-02 ": "2020-01-02", "2020-01-02T10": "2020-01-02"}.get(x) for x in odd]
    for rule in (N.strip, N.blank_to_null, N.parse_iso_date):
        plan = df.select(rule("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert "instr(" not in plan  # the list of blanks isn't searched for clean texts
