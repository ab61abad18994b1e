"""Scalar normalisation rules as Column -> Column functions.

All of them are built-in Catalyst expressions (no Python UDF), so they stay inside
whole-stage codegen and are evaluated column-at-a-time on executors.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's ``str.strip()`` removes (``str.isspace``), used so that
# whitespace handling matches the registry tools on tabs, NBSP and friends.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ws() -> Column:
    return F.lit(PY_WHITESPACE)


def _sql_text(value: str) -> str:
    """A SQL string literal with every character escaped as ``\\uXXXX``."""
    return "'" + "".join(f"\\u{ord(ch):04x}" for ch in value) + "'"


_WS_SQL = _sql_text(PY_WHITESPACE)


def _clean_sql(q: str) -> str:
    """SQL test: first and last character are printable ASCII, so there is nothing to strip
    (and the text isn't empty). Any other text takes the trim."""
    return f"substring({q}, 1, 1) BETWEEN '!' AND '~' AND substring({q}, -1, 1) BETWEEN '!' AND '~'"


def strip_sql(ident: str) -> str:
    """SQL text of :func:`strip` for a column name (built as one expression, so a
    wide projection costs one JVM call per column)."""
    q = f"`{ident}`"
    return f"CASE WHEN {_clean_sql(q)} THEN {q} ELSE btrim({q}, {_WS_SQL}) END"


def strip(c: str | Column) -> Column:
    """Unicode-aware strip of both ends (same set as Python ``str.strip``).

    For a plain column (given by name) the multi-character trim only runs when the
    first or last character may be whitespace, two comparisons on clean raw
    fields. A computed expression gets a single trim: Catalyst inlines projections,
    and an edge test would evaluate the expression three times."""
    if not isinstance(c, str):
        return F.btrim(c, _ws())
    return F.expr(strip_sql(c))


def blank_to_null(c: str | Column, *, trim: bool = True) -> Column:
    """Blank -> NULL. ``trim=False`` is the SQL ``NULLIF(x, '')`` form."""
    if trim and isinstance(c, str):
        q = f"`{c}`"  # clean text isn't blank: it is neither trimmed nor compared
        return F.expr(f"CASE WHEN {_clean_sql(q)} THEN {q} ELSE nullif(btrim({q}, {_WS_SQL}), '') END")
    x = strip(c) if trim else col_(c)
    return F.nullif(x, F.lit(""))


def parse_yyyymmdd(c: str | Column) -> Column:
    """``AAAAMMDD`` text -> date; ``0``/``00000000``/blank/invalid -> NULL."""
    x = col_(c)
    return F.when(x.isNull() | x.isin("0", "00000000", ""), F.lit(None).cast("date")).otherwise(
        F.try_to_date(x, "yyyyMMdd")
    )


def parse_iso_date(c: str | Column) -> Column:
    """ISO date from the first 10 characters; blank/invalid -> NULL."""
    return F.try_to_date(F.substring(blank_to_null(c), 1, 10), "yyyy-MM-dd")


def parse_ddmmyyyy(c: str | Column) -> Column:
    """``dd/mm/yyyy`` (one or two digit day/month accepted) -> date."""
    x = col_(c)
    return F.when((x.isNull()) | (x == ""), F.lit(None).cast("date")).otherwise(
        F.try_to_date(x, "d/M/yyyy")
    )


def parse_comma_decimal(c: str | Column, precision: int = 18, scale: int = 2) -> Column:
    """P5: ``1500,50`` -> decimal(18,2); blank/invalid -> NULL (HALF_UP rounding)."""
    x = F.replace(F.nullif(col_(c), F.lit("")), F.lit(","), F.lit("."))
    return x.try_cast(f"decimal({precision},{scale})")


def try_decimal(c: str | Column, precision: int = 18, scale: int = 2) -> Column:
    """Generic decimal parse; invalid -> NULL."""
    return col_(c).cast("string").try_cast(f"decimal({precision},{scale})")


def try_int(c: str | Column) -> Column:
    """Int parse after strip; blank/invalid -> NULL."""
    return F.nullif(strip(c), F.lit("")).try_cast("int")


def true_or_blank(c: str | Column) -> Column:
    """``"true"`` (any case, trimmed) -> True, everything else -> False."""
    return F.coalesce(F.lower(strip(c)) == F.lit("true"), F.lit(False))


def split_list(c: str | Column, sep: str = ",") -> Column:
    """``"a, b,,c"`` -> ``[a, b, c]``; blank/NULL -> empty array (never NULL)."""
    parts = F.transform(F.split(F.coalesce(col_(c), F.lit("")), sep), lambda x: strip(x))
    return F.filter(parts, lambda x: x != F.lit(""))


def compose_phone(ddd: str | Column, number: str | Column) -> Column:
    """Area code + number; NULL when both are absent."""
    return F.nullif(
        F.concat(F.coalesce(col_(ddd), F.lit("")), F.coalesce(col_(number), F.lit(""))),
        F.lit(""),
    )


def map_labels(c: str | Column, labels: Mapping[str, str]) -> Column:
    """P10: code -> label with pass-through of unknown codes; NULL/blank -> NULL.

    The table is a fixed literal CASE chain: no join, no per-row map.
    """
    x = col_(c)
    expr = F.when(x.isNull() | (x == ""), F.lit(None).cast("string"))
    for code, label in labels.items():
        expr = expr.when(x == F.lit(code), F.lit(label))
    return expr.otherwise(x)


def desc_or_code(desc: str | Column, code: str | Column) -> Column:
    """Description when present and non-empty, else the raw code."""
    return F.coalesce(F.nullif(col_(desc), F.lit("")), F.nullif(col_(code), F.lit("")))


def departement_from_postcode(c: str | Column) -> Column:
    """First two characters when both are digits, else NULL."""
    x = col_(c)
    head = F.substring(x, 1, 2)
    return F.when(head.rlike("^[0-9]{2}$"), head)


def person_name(usual_first: str | Column, first: str | Column, last: str | Column) -> Column:
    """``"<first> <last>"`` skipping missing parts; NULL when both absent."""
    prenom = F.coalesce(F.nullif(col_(usual_first), F.lit("")), F.nullif(col_(first), F.lit("")))
    return F.nullif(F.concat_ws(" ", prenom, F.nullif(col_(last), F.lit(""))), F.lit(""))


def only_digits(c: str | Column) -> Column:
    """Keep digits only; NULL when nothing is left."""
    return F.nullif(F.regexp_replace(col_(c), r"[^0-9]", ""), F.lit(""))


def strip_trailing_code(c: str | Column) -> Column:
    """``"Sociedade Limitada (2062)"`` -> ``"Sociedade Limitada"``; blank -> NULL."""
    return F.nullif(strip(F.regexp_replace(col_(c), r"\s*\(\d+\)\s*$", "")), F.lit(""))


def upper_or_null(c: str | Column) -> Column:
    """Trimmed upper case, blank -> NULL."""
    return F.nullif(F.upper(strip(c)), F.lit(""))


def lower_or_null(c: str | Column) -> Column:
    return F.nullif(F.lower(col_(c)), F.lit(""))


def email_domain(c: str | Column) -> Column:
    """Lower-cased text after the last ``@``; NULL when absent/empty/no ``@``."""
    x = col_(c)
    dom = F.lower(strip(F.substring_index(x, "@", -1)))
    return F.when(x.contains("@"), F.nullif(dom, F.lit("")))


def restricted_flag(c: str | Column) -> Column:
    """P18 (file form): anything but ``O`` after trim/upper is restricted, NULL included."""
    return F.upper(strip(F.coalesce(col_(c), F.lit("")))) != F.lit("O")


def restricted_flag_exact(c: str | Column) -> Column:
    """P18 (API form): exact ``!= "O"``, NULL counts as restricted."""
    return F.coalesce(col_(c) != F.lit("O"), F.lit(True))


def lpad_code(c: str | Column, n: int) -> Column:
    """Zero-left-padded text of a numeric code; a longer code is never cut."""
    text = col_(c).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(n)), F.lit("0"))


def split_csv_field(raw: str | None) -> list[str] | None:
    """P19 (driver helper for filter forms): comma list -> trimmed values, or None."""
    if raw is None:
        return None
    values = [v.strip() for v in raw.split(",")]
    values = [v for v in values if v]
    return values or None
