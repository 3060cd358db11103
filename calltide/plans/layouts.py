"""Queries over layouts: files by their headers, new templates, and the structure of tables in lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from calltide.operators import templates as T
from calltide.plans.adapter import view, with_views
from calltide.plans.registry import query, table

#: Header lists that the files below have, in the spelling of their writers.
HEADERS = [
    ["Date", "Phone Number", "Duration", "Call Type"], ["Call Date", "Phone Number", "Duration (sec)", "Call Type"], ["Timestamp", "MSISDN", "Seconds", "Service"], ["Timestamp", "MSISDN", "Secs", "Service", "Cell"],
    ["Date/Time", "Caller", "Minutes", "Direction"], ["DateTime", "Caller ID", "Minutes", "Direction"], ["Name", "Amount", "Balance"],
]
TEMPLATES = [("known-1", "carrier0", "csv", HEADERS[0]), ("known-2", "carrier1", "csv", HEADERS[2]), ("known-3", "carrier2", "csv", HEADERS[6])]


def files(spark, sf_dir):
    """A file for each order: whose carrier and headers it has follow from the order; some headers are in capitals or have a column more."""
    k = F.col("o_orderkey")
    lists = F.array(*(F.array(*map(F.lit, h)) for h in HEADERS))
    own = F.get(lists, F.pmod(k, F.lit(len(HEADERS))).cast("int"))
    spelled = F.when(k % 5 == 0, F.transform(own, lambda h: F.upper(h))).when(k % 11 == 0, F.concat(own, F.array(F.concat(F.lit("Note "), F.col("o_orderstatus"))))).otherwise(own)
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("carrier"), (F.col("o_custkey") % 4).cast("string")).alias("carrier"), F.lit("csv").alias("format"), spelled.alias("headers"), F.lit(",").alias("delimiter"))


def known(spark):
    return spark.createDataFrame(TEMPLATES, "template_id string, carrier string, format string, headers array<string>")


@query()
def e09_matched_templates(spark, sf_dir):
    """How many files' headers match which template, and how well."""
    lists = T.header_lists(files(spark, sf_dir))
    found = T.match_lists(lists, known(spark))
    return lists.join(found, "key", "left").groupBy("carrier", "template_id").agg(F.sum("files").alias("files"), F.round(F.min("similarity"), 6).alias("least"), F.round(F.max("similarity"), 6).alias("most"))


@query()
def e09_discovered_templates(spark, sf_dir):
    new, _ = T.discover_templates(files(spark, sf_dir), known(spark))
    return new.select("template_id", "carrier", F.array_join("headers", ",").alias("headers"), F.array_join(F.array_sort(F.map_keys("mapping")), ",").alias("fields"), "confidence", "files", "lists")


def report_lines(spark, sf_dir):
    """A report for each owner: a title, a header, a line for each event, one for each page, and a total; delimiters and columns differ."""
    c, k = view(spark, sf_dir, "comm"), F.col("owner_id") % 4
    d = F.element_at(F.array(*map(F.lit, T.DELIMITERS)), (k + 1).cast("int"))
    body = F.call_function("concat_ws", d, F.date_format("ts", "yyyy-MM-dd"), "number", F.coalesce(F.col("duration").cast("string"), F.lit("")), "type", F.when(k >= 2, F.col("source")))
    rows = c.select("owner_id", F.col("id").alias("line"), F.when(F.col("id") % 97 == 0, F.concat(F.lit("-- page "), F.col("id").cast("string"))).otherwise(body).alias("value"))
    head = F.call_function("concat_ws", d, F.lit("Day"), F.lit("Number"), F.lit("Seconds"), F.lit("Kind"), F.when(k >= 2, F.lit("Source")))
    around = c.select("owner_id").distinct().select("owner_id", F.explode(F.array(F.struct(F.lit(-9).cast("long").alias("line"), F.lit("Report of all events").alias("value")), F.struct(F.lit(-1).cast("long").alias("line"), head.alias("value")), F.struct(F.lit(10**12).alias("line"), F.concat(F.lit("Total"), d, F.lit("7")).alias("value")))).alias("r"))
    return rows.unionByName(around.select("owner_id", "r.*")).withColumnRenamed("owner_id", "file_id")


REPORTS = """, o AS (SELECT DISTINCT owner_id, owner_id % 4 AS k FROM comm),
b AS (SELECT owner_id, id, owner_id % 4 AS k, id % 97 = 0 AS page, duration FROM comm)"""


@query(with_views(REPORTS + """ SELECT owner_id AS file_id, CASE k WHEN 0 THEN ',' WHEN 1 THEN '|' WHEN 2 THEN chr(9) ELSE ';' END AS delimiter, CASE WHEN k >= 2 THEN 5 ELSE 4 END AS columns, CAST(-1 AS BIGINT) AS header_line, min(id) FILTER (NOT page) AS first_line, max(id) FILTER (NOT page) AS last_line,
 count(*) FILTER (NOT page) AS body, CAST(1 AS BIGINT) AS totals, count(*) FILTER (page AND id > (SELECT min(id) FROM b x WHERE x.owner_id = b.owner_id AND NOT x.page) AND id < (SELECT max(id) FROM b x WHERE x.owner_id = b.owner_id AND NOT x.page)) AS others FROM b GROUP BY 1, 2, 3""", "comm"))
def e08_table_structure(spark, sf_dir):
    tables, _ = T.table_structure(report_lines(spark, sf_dir))
    return tables


@query(with_views(REPORTS + """, c AS (SELECT * FROM (VALUES (0, 'Day', 'date'), (1, 'Number', 'number'), (2, 'Seconds', 'number'), (3, 'Kind', 'string'), (4, 'Source', 'string')) c(place, name, type))
SELECT owner_id AS file_id, place, name, type, count(*) FILTER (place <> 2 OR duration IS NOT NULL) AS filled, count(*) FILTER (place = 2 AND duration IS NULL) AS empty FROM b JOIN c ON place < 4 OR k >= 2 WHERE NOT page GROUP BY 1, 2, 3, 4""", "comm"))
def e08_table_columns(spark, sf_dir):
    _, columns = T.table_structure(report_lines(spark, sf_dir))
    return columns
