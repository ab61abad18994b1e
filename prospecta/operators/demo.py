"""Demo (synthetic) leads as a Spark job (SD1) with weighted picks (SD2).

Every field is a pure function of (seed, row id, field name) through md5, a hash that
SQL engines share, so the same seed gives the same rows on any cluster layout and a lost task recomputes
identical rows. Identifiers carry valid check digits (CNPJ mod-11, SIREN/SIRET Luhn),
all computed with built-in array functions. Person/company names from a faker
library are not reproduced.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospecta import schema as S

# Public identifier rules: CNPJ check-digit weights (mod 11).
CNPJ_W1 = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
CNPJ_W2 = [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
# Brazilian state codes (27 federative units).
BR_UFS = (
    "AC AL AP AM BA CE DF ES GO MA MT MS MG PA PB PR PE PI RJ RN RS RO RR SC SP SE TO"
).split()


def hash60(seed: int, id_col: Column, field: str) -> Column:
    """60 bits of md5 over ``seed|id|field`` as a non-negative bigint."""
    text = F.concat_ws("|", F.lit(str(seed)), id_col.cast("string"), F.lit(field))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _num(seed: int, id_col: Column, field: str, modulo: int) -> Column:
    return hash60(seed, id_col, field) % F.lit(modulo)


def _digits(s: Column) -> Column:
    return F.transform(F.split(s, ""), lambda x: x.cast("int"))


def _mod11_digit(digits: Column, weights: list[int]) -> Column:
    w = F.array(*[F.lit(x) for x in weights])
    s = F.aggregate(F.zip_with(digits, w, lambda a, b: a * b), F.lit(0), lambda acc, x: acc + x)
    r = s % 11
    return F.when(r < 2, F.lit(0)).otherwise(F.lit(11) - r)


def cnpj_from_base(base12: Column) -> Column:
    """12 digits -> 14-digit CNPJ with its two check digits."""
    d1 = _mod11_digit(_digits(base12), CNPJ_W1)
    with1 = F.concat(base12, d1.cast("string"))
    d2 = _mod11_digit(_digits(with1), CNPJ_W2)
    return F.concat(with1, d2.cast("string"))


def luhn_complete(payload: Column) -> Column:
    """Append the Luhn check digit to a digit string."""
    rev = F.reverse(_digits(payload))
    doubled = F.transform(
        rev, lambda d, i: F.when(i % 2 == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    )
    s = F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x)
    return F.concat(payload, ((F.lit(10) - s % 10) % 10).cast("string"))


def _pick(pool: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in pool]), (n % len(pool)).cast("int") + 1)


def _weighted(pool: dict[str, int], n: Column) -> Column:
    """The value whose share of the fixed, short ``pool`` holds ``n`` (0 to 999)."""
    assert sum(pool.values()) == 1000, pool
    out, low = None, 0
    for value, weight in pool.items():
        low += weight
        out = F.when(n < low, F.lit(value)) if out is None else out.when(n < low, F.lit(value))
    return out


def proportions_from(df: DataFrame, dimension: str, column: str) -> DataFrame:
    """A ``dimensao, valor, peso`` table mirroring the distribution of ``column``."""
    return (
        df.where(F.col(column).isNotNull() & (F.col(column) != ""))
        .groupBy(F.col(column).alias("valor"))
        .agg(F.count(F.lit(1)).cast("double").alias("peso"))
        .select(F.lit(dimension).alias("dimensao"), "valor", "peso")
    )


def cumulative_table(proportions: DataFrame) -> DataFrame:
    """SD2 prep: per dimension, values with their interval [low, high) of the total weight
    (blank rows ignored; weights relative within a dimension). One row per (dimension,
    value): as many as there are codes."""
    p = proportions.where(
        F.col("dimensao").isNotNull() & (F.trim("dimensao") != "") & F.col("valor").isNotNull()
        & (F.trim("valor") != "") & F.col("peso").isNotNull()
    ).select(F.trim("dimensao").alias("dimensao"), F.trim("valor").alias("valor"), F.col("peso").cast("double").alias("peso"))
    order = Window.partitionBy("dimensao").orderBy("valor")
    p = p.withColumn("high", F.sum("peso").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # an interval begins where the one before ends, and the total is the end of the last: by
    # other sums, rounding could leave gaps
    p = p.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0))).withColumn("total", F.max("high").over(Window.partitionBy("dimensao")))
    return p.select("dimensao", "valor", "low", "high", "total")


BUCKETS = 1024  #: equal parts of a dimension's total weight that picks are joined on


def weighted_pick(df: DataFrame, cumulative: DataFrame, dimension: str, u: Column, name: str) -> DataFrame:
    """SD2: ``df`` plus ``name``, the value whose interval holds ``u`` (uniform in [0, 1))
    times the total. An equi-join on the bucket that ``u`` falls in: each interval stands in
    all buckets it overlaps, so values of any number and any small weight can be drawn and
    nothing is collected."""
    c = cumulative.where(F.col("dimensao") == dimension)
    bucket = lambda x: F.least(F.floor(x * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    spans = F.sequence(bucket(F.col("low") / F.col("total")), bucket(F.col("high") / F.col("total")))
    c = c.select(F.explode(spans).alias("__b"), F.col("valor").alias(name), "low", "high", "total")
    df = df.withColumn("__u", u).withColumn("__ub", bucket(F.col("__u")))
    at = F.col("__u") * F.col("total")
    below = (at < F.col("high")) | (F.col("high") == F.col("total"))  # the last interval is closed
    joined = df.join(c, (F.col("__ub") == F.col("__b")) & (at >= F.col("low")) & below, "left")
    return joined.drop("__u", "__ub", "__b", "low", "high", "total")


def generate(
    ids: DataFrame,
    id_col: str,
    pais: str,
    seed: int,
    today: date,
    cumulative: DataFrame | None = None,
) -> DataFrame:
    """SD1: one synthetic canonical lead per row of ``ids``; ``is_synthetic`` true,
    ``fonte`` DEMO; ``id_legal`` is the prefix of ``id_estab``."""
    if pais not in ("BR", "FR"):
        raise ValueError(f"unsupported country {pais!r}")
    i = F.col(id_col)
    n = lambda f, m: _num(seed, i, f, m)
    if pais == "BR":
        base = F.concat(F.lpad(n("raiz", 10**8).cast("string"), 8, "0"), F.lit("0001"))
        id_estab = cnpj_from_base(base)
        id_legal = F.substring(id_estab, 1, 8)
        regiao = _pick(BR_UFS, n("regiao", 1 << 30))
        cep = F.lpad(n("cep", 10**8).cast("string"), 8, "0")
    else:
        siren = luhn_complete(F.lpad(n("raiz", 10**8).cast("string"), 8, "0"))
        id_estab = luhn_complete(F.concat(siren, F.lpad(n("nic", 10**4).cast("string"), 4, "0")))
        id_legal = siren
        regiao = F.lpad((n("regiao", 95) + 1).cast("string"), 2, "0")
        cep = F.concat(regiao, F.lpad(n("cep", 1000).cast("string"), 3, "0"))
    values = {
        "pais": F.lit(pais),
        "id_legal": id_legal,
        "id_estab": id_estab,
        "razao_social": F.concat(F.lit("EMPRESA DEMO "), i.cast("string")),
        "nome_fantasia": F.concat(F.lit("FANTASIA DEMO "), i.cast("string")),
        "cod_atividade": _weighted(S.DEMO_ATIVIDADES[pais], n("atividade", 1000)),
        "situacao": _weighted(S.DEMO_SITUACOES, n("situacao", 1000)),
        "regiao": regiao,
        "municipio": F.concat(F.lit("CIDADE "), n("municipio", 1000).cast("string")),
        "cep": cep,
        "telefone": F.lpad(n("telefone", 10**10).cast("string"), 10, "0"),
        "email": F.concat(F.lit("contato"), i.cast("string"), F.lit("@demo"), n("dominio", 500).cast("string"), F.lit(".example")),
        "data_inicio_atividade": F.date_sub(F.lit(today), n("abertura", 15 * 365).cast("int")),
        "porte": _weighted(S.DEMO_PORTES, n("porte", 1000)),
        "capital_social": (F.lit(1000.0) + n("capital", 49_900_000).cast("double") / F.lit(100.0)),
        "natureza_juridica": _weighted(S.DEMO_NATUREZA_JURIDICA[pais], n("natureza", 1000)),
        "fonte": F.lit(S.FONTE_DEMO),
        "is_synthetic": F.lit(True),
        "flag_difusao_restrita": F.lit(False),
    }
    df = ids.select(i.alias("__id"), *[v.alias(k) for k, v in values.items()])
    if cumulative is not None:
        for dim, col in (("atividade", "cod_atividade"), ("regiao", "regiao")):
            u = hash60(seed, F.col("__id"), f"w_{dim}").cast("double") / F.lit(float(1 << 60))
            df = weighted_pick(df, cumulative, dim, u, "__picked").withColumn(col, F.coalesce("__picked", col)).drop("__picked")
    return df.select(*[F.col(c).cast(t).alias(c) if c in values else F.lit(None).cast(t).alias(c) for c, t in S.CANONICAL_FIELDS])
