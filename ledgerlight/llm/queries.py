"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import distinct, frequent, garbled, leaks, tokens, toxic
from ledgerlight.sources.tables import scratch, state, table


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    """src, row_id, pos, text of all texts that may have been decoded wrongly."""
    samples = table(spark, folder, "column_profiles").select("profile_id", F.posexplode("samples").alias("pos", "text"))
    parts = [(F.lit("column_profiles"), "profile_id", "pos", "text", samples), (F.lit("raw_records"), "record_id", None, "raw_line", table(spark, folder, "raw_records")), (F.lit("documents"), "doc_id", None, "text", table(spark, folder, "documents"))]
    out = [df.select(src.alias("src"), F.col(key).alias("row_id"), (F.col(pos) if pos else F.lit(0)).cast("long").alias("pos"), F.col(text).alias("text")) for src, key, pos, text, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled.restored(_entries(spark, folder)).select("src", "row_id", "pos")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "retail_lines")
    rollups = distinct.wrong_rollups(lines, table(spark, folder, "rollup_profiles"))
    dependencies = distinct.wrong_dependencies(lines, table(spark, folder, "functional_dependencies"))
    out = rollups.select(F.lit("rollup_profiles").alias("src"), F.col("rollup_id").alias("row_id"))
    return out.unionByName(dependencies.select(F.lit("functional_dependencies").alias("src"), F.col("fd_id").alias("row_id")))


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The estimated count of each roll-up and its bound."""
    return distinct.rollup_counts(table(spark, folder, "retail_lines"), table(spark, folder, "rollup_profiles"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return frequent.frequent(table(spark, folder, "value_counts"), 0.01).select("column_name", "item_value")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, folder, "documents"), "text", ("doc_id",))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items").filter(F.col("split_name").isin("test", "validation"))
    return leaks.leaked(table(spark, folder, "documents"), items).select("doc_id", "item_id").distinct()


def _field(spark: SparkSession, folder: str) -> toxic.Field:
    """The field fitted on a folder's ratings, once for all queries while these files stay as they are."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "doc_labels")
    return toxic.saved(spark, f"{scratch(spark)}/field-{state(spark, folder, 'documents', 'doc_labels')}.npz", lambda: toxic.fit(toxic.labelled(documents, labels)))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return toxic.kinds(toxic.scored(table(spark, folder, "documents"), _field(spark, folder))).distinct()


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return toxic.rates(toxic.scored(table(spark, folder, "documents"), _field(spark, folder)))


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    return toxic.offending(table(spark, folder, "documents"), _field(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p2_found": p2_found, "p2_counts": p2_counts, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found, "p8_rates": p8_rates, "p8_spans": p8_spans}

SQL: dict[str, str] = {
    "p2_found": """
WITH l AS (SELECT feed_id, CAST(invoice_date AS DATE) AS day, country, line_type, CAST(customer_id AS VARCHAR) AS customer_id, invoice_no, stock_code, description FROM retail_lines),
v AS (UNPIVOT (SELECT feed_id, day, country, line_type, customer_id, invoice_no, stock_code FROM l) ON customer_id, invoice_no, stock_code INTO NAME column_name VALUE x),
r AS (SELECT rollup_id, distinct_count, uniqueness_ratio, COUNT(DISTINCT x) AS t, COUNT(*) AS n
  FROM rollup_profiles p JOIN v ON v.feed_id = p.feed_id AND v.column_name = p.column_name
   AND (p.sale_date IS NULL OR v.day = p.sale_date) AND (p.country IS NULL OR v.country = p.country) AND (p.line_type IS NULL OR v.line_type = p.line_type)
  GROUP BY ALL),
d AS (UNPIVOT (SELECT feed_id, customer_id, invoice_no, stock_code, description FROM l) ON customer_id, invoice_no, stock_code, description INTO NAME determinant VALUE x),
s AS (SELECT feed_id, determinant, COUNT(*) AS t FROM (SELECT feed_id, determinant, x FROM d GROUP BY ALL HAVING COUNT(*) > 1) GROUP BY ALL)
SELECT 'rollup_profiles' AS src, rollup_id AS row_id FROM r
WHERE 10 * ABS(distinct_count - t) > t OR 10 * ABS(uniqueness_ratio - CAST(t AS DOUBLE) / n) > CAST(t AS DOUBLE) / n
UNION ALL SELECT 'functional_dependencies', fd_id FROM functional_dependencies f LEFT JOIN s USING (feed_id, determinant)
WHERE 10 * ABS(support - COALESCE(t, 0)) > COALESCE(t, 0)
""",
    "p5_found": """
SELECT column_name, item_value FROM (
 SELECT column_name, item_value, SUM(item_count) AS n, SUM(SUM(item_count)) OVER (PARTITION BY column_name) AS total
 FROM value_counts WHERE item_value IS NOT NULL GROUP BY column_name, item_value)
WHERE n * 100 >= total
""",
}
