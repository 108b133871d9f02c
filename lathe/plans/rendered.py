"""Documents rendered from relational rows, as inputs of the queries, and the same rows for their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HEADER = "| TT | Hàng | 20' | 40' HC | Giá VND |"
DASHES = "| --- | --- | --- | --- | --- |"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_id(key: str):
    return F.concat(F.lit("doc_"), F.col(key).cast("string")).alias("document_id")


def items(spark: SparkSession, sf_dir: str, by: str = "l_orderkey") -> DataFrame:
    """k, tt, item, q, price, flag, line: the table rows of orders. by="document_id": with that column, which the rows are dealt by."""
    li = table(spark, sf_dir, "lineitem").select("*", order_id("l_orderkey"))
    tt = F.row_number().over(W.partitionBy(by).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = li.select(*(["document_id"] if by == "document_id" else []), F.col("l_orderkey").alias("k"), tt.alias("tt"), F.concat(F.when(F.col("l_returnflag") == "R", "Phụ thu P").otherwise("P"), F.col("l_partkey").cast("string")).alias("item"), F.col("l_quantity").cast("int").alias("q"), F.floor("l_extendedprice").cast("long").alias("price"), F.col("l_returnflag").alias("flag"))
    cells = F.concat_ws(" | ", F.col("tt").cast("string"), "item", F.col("q").cast("string"), (F.col("q") + 1).cast("string"), F.col("price").cast("string"))
    return rows.withColumn("line", F.concat(F.lit("| "), cells, F.lit(" |")))


ITEMS_SQL = """i AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS tt,
  CASE WHEN l_returnflag = 'R' THEN 'Phụ thu P' ELSE 'P' END || l_partkey AS item, trunc(l_quantity)::INT AS q, floor(l_extendedprice)::BIGINT AS price, l_returnflag AS flag FROM lineitem),
r AS (SELECT *, '| ' || tt || ' | ' || item || ' | ' || q || ' | ' || (q + 1) || ' | ' || price || ' |' AS line, count(*) OVER (PARTITION BY k) AS n FROM i),
o AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus AS status, o_orderpriority AS priority, o_orderdate FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""


def order_tables(spark: SparkSession, sf_dir: str, by: str = "k") -> DataFrame:
    """k, status, priority, o_custkey, o_orderdate, body (the markdown table) of orders with rows. by="document_id": with that column, which the rows are dealt by, so that windows over a document need no exchange."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("tt", "line"))), lambda s: s["line"])
    body = items(spark, sf_dir, "document_id" if by == "document_id" else "l_orderkey").groupBy(by).agg(F.concat_ws("\n", F.lit(HEADER), F.lit(DASHES), lines).alias("body"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_orderdate", order_id("o_orderkey"))
    return (orders if by == "document_id" else orders.drop("document_id")).join(body, by)


def rendered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, text: headings, a unit line, the table of the order's rows, a note."""
    t = order_tables(spark, sf_dir, "document_id")
    k = F.col("k").cast("string")
    text = F.concat_ws("\n", F.concat(F.lit("### I. Trạng thái "), "status"), F.concat(F.lit("### 1. Ưu tiên "), "priority"), F.lit("Đơn vị: VND/container"), F.concat(F.lit("### Bảng "), k), "body", F.concat(F.lit("Ghi chú: phụ thu theo Bảng "), k))
    return t.select("document_id", text.alias("text"))


def rendered_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, text: a customer's orders one after another; every third order's table is missing."""
    t = order_tables(spark, sf_dir)
    part = F.concat(F.lit("### Bảng "), F.col("k").cast("string"), F.when(F.col("k") % 3 == 0, F.lit("\nKhông có bảng")).otherwise(F.concat(F.lit("\n"), "body")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("k", part.alias("part")))), lambda s: s["part"])
    return t.groupBy("o_custkey").agg(F.array_join(parts, "\n").alias("text")).select(F.concat(F.lit("doc_c"), F.col("o_custkey").cast("string")).alias("document_id"), "text")


def rendered_articles(spark: SparkSession, sf_dir: str, preamble: bool = False) -> DataFrame:
    """document_id, text: an article a part, a document a brand."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    one = F.concat(F.lit("Điều "), k, F.lit("\nHàng cỡ "), F.col("p_size").cast("string"), F.lit("\nXem Bảng "), F.col("p_size").cast("string"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("t")))), lambda s: s["t"])
    text = F.array_join(parts, "\n")
    return p.groupBy("p_brand").agg((F.concat(F.lit("Lời mở đầu\n"), text) if preamble else text).alias("text")).select(F.concat(F.lit("doc_"), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("document_id"), "text")


def rendered_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, text: one article a part, with numbered clauses and a condition."""
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(F.lit("Điều "), k, F.lit("\n1. Mức "), size, F.lit("\n2. Xem Bảng "), size, F.lit("\nNgoài trừ hàng "), k)
    return p.select(F.concat(F.lit("doc_"), k).alias("document_id"), text.alias("text"))
