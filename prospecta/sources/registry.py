"""Readers for registry dumps.

* SRC1/SRC2 headerless latin-1 ``;`` files bound by position, malformed records kept
  apart; quoted line breaks and control characters stay (``sources.records``).
* SRC3 headered UTF-8 files bound by header *name*, one scan per different header.
* SRC4 ``codigo;descricao`` lookups, SRC5 staged parquet, SRC6 active version,
  SRC8 opt-out CSV, SRC9 file -> entity routing, SRC10 probe of an unknown CSV.

All readers are splittable file scans (no ``multiLine``), so a 40 GB dump becomes
hundreds of input splits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospecta import schema as S
from prospecta.functions import normalize as N
from prospecta.operators.windows import keep_first
from prospecta.session import rows_df
from prospecta.sources.records import read_records

CORRUPT = "_corrupt_record"
BR_CSV_OPTIONS = {
    "sep": ";",
    "quote": '"',
    "escape": '"',
    "encoding": "ISO-8859-1",
    "header": "false",
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT,
}


def text_schema(columns: Sequence[str], corrupt: bool = True) -> T.StructType:
    fields = [T.StructField(c, T.StringType()) for c in columns]
    if corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType()))
    return T.StructType(fields)


@dataclass(frozen=True)
class Scan:
    """Rows that fit the layout, and the raw text of those that did not."""

    rows: DataFrame
    malformed: DataFrame


def read_positional_csv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], **options) -> Scan:
    """SRC1 + SRC2: headerless ``;`` CSV, all columns text, bound by position.

    Doubled quotes decode to one quote; quoted ``;`` and line breaks stay in the field;
    empty lines are skipped; records with too few or too many fields go to ``malformed``
    (and are counted, never fatal). Empty fields become ``''`` as in the raw files; rows
    and malformed records together are all records."""
    rows = positional_rows(spark, paths, columns, **options)
    ok = rows.where(F.col(CORRUPT).isNull()).select(*columns)
    bad = rows.where(F.col(CORRUPT).isNotNull()).select(F.col(columns[0]).alias("campo0"), F.col(CORRUPT).alias("linha"))
    return Scan(ok, bad)


def positional_rows(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], *, file_column: str | None = None, **options) -> DataFrame:
    """Every record that is not empty: the layout's columns (blank fields are ``''``) and the
    raw text of one that does not fit (``CORRUPT``, else NULL). Quoted line breaks and
    control characters stay in their fields, see ``sources.records``; all fields are cut
    before any is selected, so what a query reads cannot hide a malformed record.
    ``file_column`` names a further column for the file that a record stands in."""
    opts = {**BR_CSV_OPTIONS, **options}
    records = read_records(spark, paths, opts["encoding"], opts["sep"])
    fits = ~F.col("reject") & (F.size("fields") == len(columns))
    fields = [F.coalesce(F.get("fields", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)]
    origin = [F.col("file").alias(file_column)] if file_column else []
    return records.select(*fields, F.when(~fits, F.col("value")).alias(CORRUPT), *origin)


def read_lookup(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    """SRC4: ``codigo;descricao`` code table; short rows ignored; duplicate codes
    keep one row (the greatest description), so a later join never fans out."""
    scan = read_positional_csv(spark, paths, S.LOOKUP_COLUMNS, **options)
    df = scan.rows.select(N.strip("codigo").alias("codigo"), N.strip("descricao").alias("descricao"))
    return keep_first(df, ["codigo"], [F.col("descricao").desc()])


def read_named_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    expected: Sequence[str],
    **options,
) -> DataFrame:
    """SRC3: headered UTF-8 CSV matched by header *name*.

    Spark binds a header by position within one read, so files are grouped by their
    header line (read through the file system, one line each) and every group is one
    scan: as many union branches as there are different headers. Names are stripped of
    the trailing spaces official headers carry; a missing expected column raises."""
    given = [paths] if isinstance(paths, str) else list(paths)
    if not given:
        raise ValueError("no input files")
    opts = {"header": "true", "escape": '"', "encoding": "UTF-8", "sep": ",", "quote": '"', **options}
    groups: dict[str, list[str]] = {}
    for f in data_files(spark, given):
        groups.setdefault(first_line(spark, f, opts["encoding"]), []).append(f)
    out = None
    for files in groups.values():
        df = spark.read.options(**opts).csv(files)
        df = df.toDF(*[c.strip() for c in df.columns])
        missing = set(expected) - set(df.columns)
        if missing:
            raise ValueError(f"expected columns missing in {files[0]}: {sorted(missing)}")
        df = df.select(*[F.col(f"`{c}`") for c in expected])
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no input files")
    return out


def data_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The files of the given files and folders (hidden ones are left out)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out: list[str] = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        for x in fs.globStatus(p) or ():
            listed = fs.listStatus(x.getPath()) if x.isDirectory() else [x]
            out += [y.getPath().toString() for y in listed if y.isFile() and y.getPath().getName()[0] not in "_."]
    return sorted(out)


def first_line(spark: SparkSession, path: str, encoding: str) -> str:
    """The first line of a file; nothing else of it is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).open(p)
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, encoding)).readLine() or ""
    finally:
        stream.close()


def read_staged_parquet(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """SRC5: many staged slices = one table (bag union); empty list is an error."""
    if not paths:
        raise ValueError("no parquet files given")
    return spark.read.parquet(*paths)


def read_optout_csv(spark: SparkSession, path: str):
    """SRC8: opt-out CSV (``id_estab,email[,motivo,registrado_em]``, header). A
    missing file means an empty list."""
    from prospecta.operators.gate import load_optout

    try:
        raw = spark.read.options(header="true", escape='"').csv(path)
    except Exception as e:  # noqa: BLE001 - AnalysisException: path does not exist
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raw = rows_df(spark, [], "id_estab string, email string")
        else:
            raise
    return load_optout(raw)


# -- SRC9: file -> entity ---------------------------------------------------------------


def detect_br_entity(name: str) -> str | None:
    up = name.upper()
    for marker, entity in S.BR_ENTITY_MARKERS:
        if marker in up:
            return entity
    return None


def detect_fr_entity(name: str) -> str | None:
    up = name.upper()
    if any(m in up for m in S.FR_EXCLUDED_MARKERS):
        return None
    for marker, entity in S.FR_ENTITY_MARKERS:
        if marker in up:
            return entity
    return None


def list_files(spark: SparkSession, directory: str, *, recursive: bool = True) -> list[str]:
    """Paths of the data files under ``directory``, listed by Spark itself so any
    Hadoop filesystem works (hidden ``_``/``.`` files are skipped). Only paths reach
    the driver; file contents are not read."""
    df = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(directory)
        .select("path")
    )
    return sorted(r.path for r in df.collect())


def _entry_name(path: str, directory: str) -> str:
    """First component below the landing folder: the file name for a flat landing,
    or the folder name for a folder of part files written by Spark."""
    root = directory.rstrip("/").split("://", 1)[-1].lstrip("/")
    rel = path.split("://", 1)[-1].lstrip("/")
    rel = rel[len(root):].lstrip("/") if rel.startswith(root) else rel.rsplit("/", 1)[-1]
    return rel.split("/", 1)[0]


def route_files(spark: SparkSession, directory: str, country: str, only: Sequence[str] | None = None) -> dict[str, list[str]]:
    """SRC9: group the files of a landing folder by entity (case-insensitive name
    markers); unknown entries are ignored, ``only`` restricts the entities."""
    detect = detect_br_entity if country == "BR" else detect_fr_entity
    out: dict[str, list[str]] = {}
    for p in list_files(spark, directory):
        ent = detect(_entry_name(p, directory))
        if ent is None or (only is not None and ent not in only):
            continue
        out.setdefault(ent, []).append(p)
    return out


# -- SRC10: probe ---------------------------------------------------------------------------


def probe_csv(spark: SparkSession, path: str, sample_size: int = 5, **options) -> tuple[DataFrame, DataFrame]:
    """Rows, columns and non-null count per column of an unknown headerless file in
    one aggregate pass, plus a ``limit(sample_size)`` sample. Columns are named
    ``column00``, ``column01`` ...; empty fields count as NULL."""
    opts = {k: v for k, v in BR_CSV_OPTIONS.items() if k not in ("mode", "columnNameOfCorruptRecord")}
    df = spark.read.options(**{**opts, **options}).csv(path)
    names = [f"column{i:02d}" for i in range(len(df.columns))]
    df = df.toDF(*names)
    stats = df.agg(F.count(F.lit(1)).alias("n_linhas"), *[F.count(c).alias(c) for c in names])
    stack = "stack({n}, {pairs}) as (coluna, n_nao_nulos)".format(
        n=len(names), pairs=", ".join(f"'{c}', `{c}`" for c in names)
    )
    long = stats.selectExpr("n_linhas", stack).select("coluna", "n_nao_nulos", "n_linhas")
    return long, df.limit(int(sample_size))
