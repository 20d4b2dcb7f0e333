"""The registered queries over loaded files and loads: rejected records, column profiles."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.operators import quality, rejects
from ledgerlight.sources.tables import scratch, table

#: What a whole value of these columns looks like.
FORMATS = {"invoice_no": "C?[0-9]{8}", "stock_code": "P[0-9]{5}|POST|FEE|MAN|ADJ|CAR|DISC"}
#: Columns of a line that tell about the load, not about the sale.
LOAD_COLUMNS = ("line_id", "feed_id", "dataset_id", "load_no", "loaded_at")
SIGNED, MEASURED = ["quantity", "unit_price"], ["quantity", "unit_price", "line_revenue"]
VARIED = ["stock_code", "description", "line_type", "country", "customer_id", "quantity", "unit_price"]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    loaded = rejects.load(table(spark, folder, "raw_records"), table(spark, folder, "dialects"))
    return loaded.filter(F.col("reason").isin(*rejects.REASONS)).select("record_id", "reason")


def p3_typed(spark: SparkSession, folder: str) -> DataFrame:
    dialects = table(spark, folder, "dialects")
    return rejects.valued(rejects.load(table(spark, folder, "raw_records"), dialects), dialects)


def p3_columns(spark: SparkSession, folder: str) -> DataFrame:
    """What the typed columns of each file's valid records hold."""
    each = p3_typed(spark, folder).select("dataset_id", F.inline("values"))
    total = F.sum(F.col("fraction").cast("decimal(38,6)")).cast("double")
    return each.groupBy("dataset_id", "column_name", "kind").agg(F.count("text").alias("present"), F.sum("number").alias("whole"), total.alias("fractions"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def _counts(spark: SparkSession, keys: list[str]) -> quality.ValueCounts:
    """New value-count tables in the shared folder."""
    return quality.ValueCounts(spark, f"{scratch(spark)}/counts-{uuid.uuid4().hex}", keys)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "retail_lines")
    counts = _counts(spark, ["dataset_id"])
    # all loads there are arrive as one delta, in which each has counts of its own; medians are taken of decimal columns
    counts.add(lines.withColumn("quantity", F.col("quantity").cast("double")), [c for c in lines.columns if c not in LOAD_COLUMNS], "arrived")
    profiles = quality.profile(counts.tables(), ["dataset_id"], FORMATS, f"{counts.folder}/ranges")
    # a load belongs to one feed; should it name several, the last of them counts
    feeds = lines.select("dataset_id", "feed_id").distinct().groupBy("dataset_id").agg(F.max("feed_id").alias("feed_id"))
    profiles.join(feeds, "dataset_id").write.parquet(f"{counts.folder}/profiles")
    written = spark.read.parquet(f"{counts.folder}/profiles")
    return quality.departures(written, "feed_id", "dataset_id", SIGNED, MEASURED, VARIED, FORMATS, stated=table(spark, folder, "column_profiles"))


def p4_withdrawn(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles of whole feeds, from counts to which all loads were added and from which each feed's last load was withdrawn again."""
    lines = table(spark, folder, "retail_lines")
    columns = [c for c in lines.columns if c not in LOAD_COLUMNS]
    counts = _counts(spark, ["feed_id"])
    counts.add(lines, columns, "arrived")
    last = lines.groupBy("feed_id").agg(F.max("load_no").alias("load_no"))
    counts.add(lines.join(last, ["feed_id", "load_no"]), columns, "withdrawn", sign=-1)
    return quality.profile(counts.tables(), ["feed_id"]).select("feed_id", "column_name", "row_count", "null_count", "distinct_count", F.round("entropy", 6).alias("entropy"))


QUERIES = {"p3_found": p3_found, "p3_typed": p3_typed, "p3_columns": p3_columns, "p4_found": p4_found, "p4_withdrawn": p4_withdrawn}

_TEXT = "invoice_no invoice_type invoice_quarter invoice_month stock_code description line_type country operator_note".split()
_NUMBERS = "invoice_year invoice_dow invoice_hour is_complete_quarter is_product_line is_revenue_line quantity unit_price line_revenue is_return customer_id is_identified_customer is_country_known has_negative_price is_extreme_quantity".split()


def _profile_sql(c: str) -> str:
    text, number = c in _TEXT, c in _NUMBERS
    ends = [f"{f}({c})" if t else f"CAST(NULL AS {k})" for t, k in ((text, "VARCHAR"), (number, "DOUBLE"), (not text and not number, "TIMESTAMP")) for f in ("MIN", "MAX")]
    broken = f"COUNT(*) FILTER (WHERE NOT regexp_full_match({c}, '{FORMATS[c]}'))" if c in FORMATS else "0"
    return (
        f"SELECT dataset_id, MAX(feed_id) AS feed_id, '{c}' AS column_name, COUNT(*) AS n, COUNT({c}) AS v, COUNT(DISTINCT {c}) AS d,"
        f" {ends[0]} AS lt, {ends[1]} AS ht, {ends[2]} AS ln, {ends[3]} AS hn, {ends[4]} AS lm, {ends[5]} AS hm,"
        f" {f'COUNT(*) FILTER (WHERE {c} < 0)' if number else 'CAST(NULL AS BIGINT)'} AS neg, {f'MEDIAN(CAST({c} AS DOUBLE))' if c in MEASURED else 'CAST(NULL AS DOUBLE)'} AS med, {broken} AS bad"
        " FROM retail_lines GROUP BY dataset_id"
    )


def _in(names: list[str]) -> str:
    return "a.column_name IN (" + ", ".join(f"'{n}'" for n in names) + ")"


#: Records as their fields, with the first reason against them.
_RECORDS = r"""
WITH r AS (SELECT record_id, dataset_id, raw_line, delimiter AS d, quotechar AS q, column_types AS t, column_names AS names,
  '(?:' || q || '(?:[^' || q || ']|' || q || q || ')*' || q || '|[^' || q || '\' || d || '\r\n]*)' AS f
  FROM raw_records JOIN dialects USING (dataset_id)
  WHERE length(trim(raw_line, ' ')) > 0 AND NOT (has_header AND line_no = 1)),
s AS (SELECT record_id, dataset_id, d, q, t, names, regexp_full_match(raw_line, '(?s)' || f || '(?:\' || d || f || ')*') AS sound,
  regexp_extract_all(d || raw_line, '\' || d || '(' || f || ')', 1) AS x FROM r),
v AS (SELECT record_id, dataset_id, sound, t, names, list_transform(x, lambda y: CASE WHEN starts_with(y, q) THEN replace(substr(y, 2, length(y) - 2), q || q, q) ELSE y END) AS fields FROM s),
u AS (SELECT *, list_transform(fields, lambda y: trim(y, ' ')) AS x FROM v),
w AS (SELECT record_id, dataset_id, t, names, fields, CASE WHEN NOT sound THEN 'quoting' WHEN len(x) <> len(t) THEN 'column_count'
  WHEN len(list_filter(range(1, len(t) + 1), lambda i: x[i] <> '' AND NOT CASE t[i]
    WHEN 'integer' THEN regexp_full_match(x[i], '[+-]?[0-9]+')
    WHEN 'decimal' THEN regexp_full_match(x[i], '[+-]?[0-9]+(\.[0-9]+)?')
    WHEN 'date_iso' THEN regexp_full_match(x[i], '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_strptime(x[i], '%Y-%m-%d') IS NOT NULL
    WHEN 'date_dmy' THEN regexp_full_match(x[i], '[0-9]{2}/[0-9]{2}/[0-9]{4}') AND try_strptime(x[i], '%d/%m/%Y') IS NOT NULL
    ELSE true END)) > 0 THEN 'value' END AS reason FROM u)
"""

SQL = {
    "p3_found": f"{_RECORDS} SELECT record_id, reason FROM w WHERE reason IS NOT NULL",
    "p3_columns": f"""{_RECORDS},
e AS (SELECT dataset_id, unnest(names) AS column_name, unnest(t) AS kind, unnest(fields) AS v FROM w WHERE reason IS NULL)
SELECT dataset_id, column_name, kind, COUNT(*) FILTER (WHERE v <> '') AS present, CAST(SUM(CASE WHEN kind = 'integer' THEN TRY_CAST(trim(v, ' ') AS BIGINT) END) AS BIGINT) AS whole,
 CAST(SUM(CASE WHEN kind = 'decimal' THEN TRY_CAST(trim(v, ' ') AS DECIMAL(38,6)) END) AS DOUBLE) AS fractions,
 CAST(MIN(CASE kind WHEN 'date_iso' THEN try_strptime(trim(v, ' '), '%Y-%m-%d') WHEN 'date_dmy' THEN try_strptime(trim(v, ' '), '%d/%m/%Y') END) AS DATE) AS first_day,
 CAST(MAX(CASE kind WHEN 'date_iso' THEN try_strptime(trim(v, ' '), '%Y-%m-%d') WHEN 'date_dmy' THEN try_strptime(trim(v, ' '), '%d/%m/%Y') END) AS DATE) AS last_day
FROM e GROUP BY ALL
""",
    "p4_withdrawn": " UNION ALL ".join(
        f"SELECT feed_id, '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count, COUNT(DISTINCT {c}) AS distinct_count, ROUND(COALESCE(ENTROPY({c}), 0), 6) AS entropy"
        " FROM retail_lines JOIN (SELECT feed_id, MAX(load_no) AS last FROM retail_lines GROUP BY 1) USING (feed_id) WHERE load_no <> last GROUP BY 1"
        for c in [*_TEXT, *_NUMBERS, "invoice_date"]
    ),
    "p4_found": f"""
WITH p AS ({" UNION ALL ".join(map(_profile_sql, [*_TEXT, *_NUMBERS, "invoice_date"]))}),
o AS (SELECT a.dataset_id, a.column_name, MEDIAN(1 - b.v / b.n) AS nulls, MEDIAN(b.neg / b.v) FILTER (WHERE b.v > 0) AS neg, MEDIAN(b.med) FILTER (WHERE b.v > 0) AS med, MEDIAN(b.d) FILTER (WHERE b.v > 0) AS d
  FROM p a JOIN p b ON a.feed_id = b.feed_id AND a.column_name = b.column_name AND a.dataset_id <> b.dataset_id GROUP BY ALL)
SELECT dataset_id, column_name, 'null_rate' AS kind FROM p a JOIN o USING (dataset_id, column_name) WHERE ABS(1 - v / n - nulls) > 0.15
UNION ALL SELECT dataset_id, column_name, 'negatives' FROM p a JOIN o USING (dataset_id, column_name) WHERE {_in(SIGNED)} AND v > 0 AND ABS(a.neg / v - o.neg) > 0.10
UNION ALL SELECT dataset_id, column_name, 'shift' FROM p a JOIN o USING (dataset_id, column_name) WHERE {_in(MEASURED)} AND (a.med > 3 * o.med OR 3 * a.med < o.med)
UNION ALL SELECT dataset_id, column_name, 'constant' FROM p a JOIN o USING (dataset_id, column_name) WHERE {_in(VARIED)} AND a.d = 1 AND o.d >= 5
UNION ALL SELECT dataset_id, column_name, 'pattern' FROM p a WHERE {_in(list(FORMATS))} AND v > 0 AND bad >= 0.02 * v
UNION ALL SELECT DISTINCT a.dataset_id, a.column_name, 'stated' FROM p a JOIN column_profiles s ON a.dataset_id = s.dataset_id AND a.column_name = s.column_name
WHERE s.null_count IS DISTINCT FROM n - v OR s.distinct_count IS DISTINCT FROM d OR s.negatives IS DISTINCT FROM neg
 OR CASE WHEN ln IS NOT NULL THEN TRY_CAST(min_value AS DOUBLE) IS DISTINCT FROM ln OR TRY_CAST(max_value AS DOUBLE) IS DISTINCT FROM hn
         WHEN lm IS NOT NULL THEN TRY_CAST(min_value AS TIMESTAMP) IS DISTINCT FROM lm OR TRY_CAST(max_value AS TIMESTAMP) IS DISTINCT FROM hm
         ELSE min_value IS DISTINCT FROM lt OR max_value IS DISTINCT FROM ht END
""",
}
