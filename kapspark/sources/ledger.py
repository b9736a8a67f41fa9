"""Ledger scan (CSV export) and mapping onto the canonical ledger schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool
from urllib.parse import unquote

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kapspark import config as C
from kapspark import constants as K
from kapspark.functions import normalize_amount, parse_ledger_ts

# Headers read at the same time while planning.
HEADER_READERS = 16
# Rows of one bucket of a stored ledger, and Spark's own limit on their number.
BUCKET_ROWS = 250_000
MOST_BUCKETS = 100_000

# Canonical names that must be present in the input (after mapping).
REQUIRED = (C.TS, C.TYPE, C.CURRENCY, C.NET)


class MissingColumnsError(ValueError):
    """Raised when required ledger columns are absent (driver-side schema check)."""


def missing_columns(df: DataFrame, columns: Mapping[str, str] | None = None) -> list[str]:
    """Input names of required columns that the frame lacks (no job is run)."""
    cols = dict(K.DEFAULT_INPUT_COLUMNS, **(columns or {}))
    present = set(df.columns)
    return [cols[c] for c in REQUIRED if cols[c] not in present]


def canonical_ledger(
    raw: DataFrame,
    columns: Mapping[str, str] | None = None,
    account_id: str | None = None,
    account_literal=None,
) -> DataFrame:
    """Map an all-string ledger frame onto the canonical schema.

    ``columns`` maps canonical names to input names (defaults: the export's
    German header). The account comes from an input column, a literal, or
    the source file name, in that order. Input columns that are not mapped
    pass through unchanged (prefixed ``src_`` on a name clash).
    """
    cols = dict(K.DEFAULT_INPUT_COLUMNS, **(columns or {}))
    missing = missing_columns(raw, columns)
    if missing:
        raise MissingColumnsError(f"missing ledger columns: {missing}")
    present = set(raw.columns)

    def src(name: str):
        return F.col(f"`{cols[name]}`") if cols.get(name) in present else None

    if account_id is not None:
        account = F.col(f"`{account_id}`")
    elif account_literal is not None:
        account = F.lit(account_literal)
    else:
        # Spark gives the name as in a URI, where a plus sign stands for itself
        name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
        account = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1)

    out = [
        account.alias(C.ACCOUNT),
        parse_ledger_ts(src(C.TS)).alias(C.TS),
        src(C.TYPE).cast("string").alias(C.TYPE),
        (src(C.ISIN) if src(C.ISIN) is not None else F.lit(None)).cast("string").alias(C.ISIN),
        (src(C.NAME) if src(C.NAME) is not None else F.lit(None)).cast("string").alias(C.NAME),
        src(C.CURRENCY).cast("string").alias(C.CURRENCY),
        (
            F.replace(src(C.QUANTITY).cast("string"), F.lit(","), F.lit(".")).try_cast(C.QUANTITY_TYPE)
            if src(C.QUANTITY) is not None
            else F.lit(None).cast(C.QUANTITY_TYPE)
        ).alias(C.QUANTITY),
        normalize_amount(src(C.NET)).alias(C.NET),
        # Raw text kept for the issue report (bad dates, bad amounts).
        src(C.TS).cast("string").alias("ts_text"),
        src(C.NET).cast("string").alias("net_text"),
    ]
    if src(C.TAX) is not None:
        out.append(normalize_amount(src(C.TAX)).alias(C.TAX))
        out.append(src(C.TAX).cast("string").alias("tax_text"))
    if src("order_no") is not None:
        out.append(src("order_no").cast("string").alias("order_no"))
    mapped = {cols[c] for c in (C.TS, C.TYPE, C.ISIN, C.NAME, C.CURRENCY, C.QUANTITY, C.NET, C.TAX, "order_no")}
    taken = {c.lower() for c in C.LEDGER_COLUMNS} | {"ts_text", "net_text", "tax_text", "order_no"}
    for name in raw.columns:
        if name in mapped or name == account_id:
            continue
        alias = f"src_{name}" if name.lower() in taken else name
        out.append(F.col(f"`{name}`").alias(alias))
    return raw.select(*out)


def _reader(spark: SparkSession, sep: str, encoding: str) -> DataFrameReader:
    return (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("inferSchema", False)
        .option("mode", "PERMISSIVE")
    )


def _literal_path(uri: str) -> str:
    """A listed file's URI as a path that no pattern of the reader applies to."""
    return "".join(f"\\{c}" if c in "\\{}[]*?" else c for c in unquote(uri))


def files_by_header(
    spark: SparkSession, path: str | list[str], sep: str = K.DEFAULT_SEPARATOR, encoding: str = K.DEFAULT_ENCODING
) -> dict[tuple[str, ...], list[str]]:
    """Column names -> the files that begin with them, in a fixed order.

    Files are listed once; of each only the first line is read (one short job a file,
    several at a time). Empty files have no header and no rows.
    """
    listed = spark.read.schema("line string").csv(path).inputFiles()
    files = sorted(_literal_path(f) for f in listed)
    with ThreadPool(min(HEADER_READERS, max(1, len(files)))) as pool:
        headers = pool.map(lambda f: tuple(_reader(spark, sep, encoding).csv(f).columns), files)
    groups: dict[tuple[str, ...], list[str]] = {}
    for header, file in zip(headers, files):
        if header:
            groups.setdefault(header, []).append(file)
    return dict(sorted(groups.items()))


def _scan(reader: DataFrameReader, path: str | Sequence[str], header: Sequence[str]) -> DataFrame:
    """All columns as text, and the text of rows with more or fewer fields than the header."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*header, C.MALFORMED)])
    # without pruning the parser sees every field, so it notices each malformed row
    return (
        reader.schema(schema)
        .option("columnNameOfCorruptRecord", C.MALFORMED)
        .option("columnPruning", False)
        .csv(path if isinstance(path, str) else list(path))
    )


def read_ledger_csv(
    spark: SparkSession,
    path: str | list[str],
    columns: Mapping[str, str] | None = None,
    sep: str = K.DEFAULT_SEPARATOR,
    encoding: str = K.DEFAULT_ENCODING,
    account_id: str | None = None,
    account_literal=None,
    mixed_headers: bool = True,
) -> DataFrame:
    """Scan one file, a directory or a list of ledger CSV exports.

    Every file is read by its own header: files with the same header are one scan, the
    scans are united by column name, and a column that some files lack is NULL there.
    With ``mixed_headers=False`` only one header is read (for very many files that are
    known to be alike); a file with another one then fails the query.

    Every column is read as text (no inference) and cast by its declared target type. A
    row with more or fewer fields than its header keeps its text in ``malformed_text``:
    it is an issue and takes part in no figure. A directory of per-account files yields
    one ledger whose ``account_id`` is the file name unless a column or literal is given.
    """
    if mixed_headers:
        groups = files_by_header(spark, path, sep, encoding)
    else:
        groups = {tuple(_reader(spark, sep, encoding).csv(path).columns): []}
    if not groups:
        raise MissingColumnsError(f"missing ledger columns: no header in {path}")
    cols = dict(K.DEFAULT_INPUT_COLUMNS, **(columns or {}))
    lacking = {h: [cols[c] for c in REQUIRED if cols[c] not in h] for h in groups}
    if any(lacking.values()):
        missing = sorted({c for names in lacking.values() for c in names})
        files = [f for h, names in lacking.items() if names for f in groups[h]]
        raise MissingColumnsError(f"missing ledger columns: {missing} in {len(files) or 1} files: {files[:5] or path}")
    out = None
    for header, files in groups.items():
        reader = _reader(spark, sep, encoding)
        if len(groups) == 1:
            raw = _scan(reader.option("enforceSchema", mixed_headers), path, header)
        else:
            folder = [path] if isinstance(path, str) else path
            inside = len(folder) == 1 and any("=" in f for f in files)
            raw = _scan(reader.option("basePath", folder[0]) if inside else reader, files, header)
        ledger = canonical_ledger(raw, columns, account_id=account_id, account_literal=account_literal)
        out = ledger if out is None else out.unionByName(ledger, allowMissingColumns=True)
    return out


def buckets_for(ledger: DataFrame, least: int = 16) -> int:
    """Buckets for ``write_bucketed``: one for every BUCKET_ROWS rows, so that a task's memory
    stays the same at any size of the ledger."""
    return min(MOST_BUCKETS, max(least, -(-ledger.count() // BUCKET_ROWS)))


def write_bucketed(ledger: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Store a canonical ledger as a table bucketed by (account_id, isin), and read it back.

    FIFO over such a ledger needs no exchange: a bucket's files hold whole keys. The rows are
    gathered by key before the write, so each bucket is one file. Choose so many buckets that
    one fits a task (``buckets_for``); a key beyond ``fifo_hot_key_rows`` is matched in chunks all the same.
    """
    keys = (C.ACCOUNT, C.ISIN)
    rows = ledger.repartition(buckets, *keys)
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("overwrite").saveAsTable(table)
    return ledger.sparkSession.table(table)
