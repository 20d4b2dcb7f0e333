"""Delimited files in and out. Types are those that every row of the file has."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.operators.profile import quoted
from ledgerlight.sources.dialect import HEAD, Dialect, DialectError, sniff

_BAD = "__bad_record"
#: What a text of each type looks like, and the type it gets; the first that all rows fit. Whole numbers that
#: 64 bits don't hold are decimals of up to 38 digits, and text beyond; `double` takes whole numbers that it holds exactly.
_TYPES = (
    ("boolean", r"(?i)true|false"), ("long", r"[+-]?\d{1,19}"), ("decimal(38,0)", r"[+-]?\d{1,38}"), ("double", r"[+-]?(\d{1,15}|\d+\.\d*|\.\d+|(\d+\.?\d*|\.\d+)[eE][+-]?\d+)"),
    ("date", r"\d{4}-\d{2}-\d{2}"), ("timestamp_ntz", r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?"),
)


def head_of(spark: SparkSession, path: str) -> tuple[bytes, bool]:
    """The first bytes of a file, wherever it lies, and whether they are all of it."""
    row = spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").limit(1).collect()
    if not row:
        raise DialectError("there is no file")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(row[0].path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        size = min(HEAD, row[0].length)
        return bytes(stream.readNBytes(size)), row[0].length <= HEAD
    finally:
        stream.close()


def _clean(encoding: str, c: Column) -> Column:
    """Readers know Latin-1 but not cp1252, which writes printable characters as the bytes 0x80 to 0x9F."""
    if encoding != "cp1252":
        return c
    pairs = [(chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
    return F.translate(c, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def texts(spark: SparkSession, path: str, dialect: Dialect, whole: bool = True) -> DataFrame:
    """All columns as text, empty fields null, and the column of records that don't fit. With `whole`, records may
    hold line breaks, so each file is one split; without, files are split wherever lines end."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*dialect.names, _BAD)])
    charset = {"cp1252": "ISO-8859-1", "utf-8-sig": "UTF-8", "utf-16": "UTF-16"}.get(dialect.encoding, "UTF-8")
    # a header is dropped file by file
    df = spark.read.schema(schema).option("columnNameOfCorruptRecord", _BAD).csv(path, sep=dialect.delimiter, quote=dialect.quotechar, escape=dialect.quotechar, header=dialect.has_header, enforceSchema=True, multiLine=whole, encoding=charset, mode="PERMISSIVE", nullValue="", emptyValue="")
    return df.select(*[F.nullif(_clean(dialect.encoding, quoted(n)), F.lit("")).alias(n) for n in dialect.names], quoted(_BAD))


def inferred(df: DataFrame) -> tuple[dict[str, str], int]:
    """The type of each column and the number of records that don't fit; one pass over all rows."""
    names = [c for c in df.columns if c != _BAD]
    parts = [F.count(quoted(_BAD)).alias("bad")]
    for k, c in enumerate(names):
        v = F.trim(quoted(c))
        parts.append(F.count(quoted(c)).alias(f"n{k}"))
        for t, pattern in _TYPES:
            parts.append(F.count_if(v.rlike(rf"\A(?:{pattern})\z") & v.try_cast(t).isNotNull()).alias(f"{t}{k}"))
    r = df.agg(*parts).collect()[0]
    out = {}
    for k, c in enumerate(names):
        n = r[f"n{k}"]
        fits = [t for t, _ in _TYPES if n and r[f"{t}{k}"] == n]
        mixed = n and r[f"date{k}"] + r[f"timestamp_ntz{k}"] == n
        out[c] = fits[0] if fits else "timestamp_ntz" if mixed else "string"
    return out, r["bad"]


def lines_of(spark: SparkSession, path: str, dialect: Dialect) -> tuple[bool, bool]:
    """Whether all bytes are UTF-8, and whether a quoted field may hold a line break; one pass over the lines as they stand.

    No character of several bytes holds a line break. Where a line break is quoted, an odd number of quotes stands
    before it, and so some line holds an odd number. UTF-16 isn't looked at: it may be anything.
    """
    if dialect.encoding == "utf-16":
        return True, True
    # a quote is one byte of its own in UTF-8 and in cp1252
    odd = (F.length("value") - F.length(F.replace("value", F.lit(dialect.quotechar), F.lit("")))) % 2 == 1 if dialect.quotechar else F.lit(False)
    r = spark.read.text(path).agg(F.count_if(~F.is_valid_utf8("value")).alias("other"), F.count_if(odd).alias("odd")).collect()[0]
    return r.other == 0, r.odd > 0


def load(spark: SparkSession, path: str, dialect: Dialect | None = None) -> DataFrame:
    """A delimited file, or a folder of them, as a typed table; any record of another width than the first is an error.

    All bytes are tested: what isn't UTF-8 behind its head is read, wholly, as cp1252. Files without a quoted line
    break are read in splits.
    """
    dialect = dialect or sniff(*head_of(spark, path))
    sound, whole = lines_of(spark, path, dialect)
    marked = dialect.encoding == "utf-8-sig"
    if not sound and dialect.encoding in ("utf-8", "utf-8-sig"):
        dialect = replace(dialect, encoding="cp1252")
    df = texts(spark, path, dialect, whole)
    if marked and not sound and not dialect.has_header:
        first = dialect.names[0]
        df = df.withColumn(first, F.nullif(F.regexp_replace(quoted(first), r"\A\x{EF}\x{BB}\x{BF}", ""), F.lit("")))
    types, bad = inferred(df)
    if bad:
        raise DialectError(f"{bad} records don't have {len(dialect.names)} fields")
    return df.select(*[(F.trim(quoted(c)).try_cast(t) if t != "string" else quoted(c)).alias(c) for c, t in types.items()])


def save(df: DataFrame, path: str, without: str | None = None, anonymous: bool = False) -> None:
    """A table as delimited files with headers, without a column or with all named col_0, col_1, ..., if asked for."""
    if without is not None:
        df = df.drop(quoted(without))
    if anonymous:
        df = df.toDF(*[f"col_{k}" for k in range(len(df.columns))])
    df.write.mode("overwrite").csv(path, header=True, escape='"')
