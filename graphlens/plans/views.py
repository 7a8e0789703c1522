"""Graph views over the driver's tables: documents as nodes, and the star schema as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions.text import first_line


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for each document; its kind is by language, exported where it has a positive quality label."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    kind = F.when(F.col("lang") == "en", "function").when(F.col("lang") == "de", "class").when(F.col("lang") == "fr", "module").otherwise("method")
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("d"), "doc_id").alias("id"),
        kind.alias("kind"),
        F.col("source").alias("name"),
        F.concat_ws(".", "source", F.col("doc_id").cast("string")).alias("qualname"),
        F.col("text").alias("docstring"),
        first_line(F.col("text")).alias("summary"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("is_exported"),
        F.col("source").alias("file"),
        F.col("doc_id").cast("int").alias("start_line"),
        F.lit("public").alias("visibility"),
        "source",
        "doc_id",
    )


def document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tests and examples between documents, from the star schema's numbers."""
    lines = table(spark, sf_dir, "lineitem")
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_docs"))
    lines = lines.crossJoin(F.broadcast(n))  # one row
    node = lambda c: F.concat(F.lit("d"), (F.col(c) % F.col("n_docs")).cast("string"))
    kind = F.when(F.col("l_linenumber") == 6, "exemplifies").when(F.col("l_linenumber") == 7, "tests").otherwise("calls")
    provenance = F.when(F.col("l_returnflag") == "N", "resolved").otherwise("heuristic")
    return lines.select(node("l_orderkey").alias("source"), node("l_partkey").alias("target"), kind.alias("kind"), provenance.alias("provenance"), F.lit(None).cast("string").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text: each benchmark passage."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, orders, parts, suppliers, nations and regions as nodes."""
    t = lambda name: table(spark, sf_dir, name)
    node = lambda df, p, key, kind, name, file, line: df.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), F.col(name).cast("string").alias("name"), file.cast("string").alias("file"), F.col(line).cast("int").alias("start_line"))
    part_kind = F.when(F.col("p_size") % 3 == 0, "class").when(F.col("p_size") % 3 == 1, "function").otherwise("method")
    rows = [
        node(t("customer"), "c", "c_custkey", "class", "c_name", F.col("c_nationkey"), "c_custkey"),
        node(t("orders"), "o", "o_orderkey", "function", "o_orderkey", F.col("o_custkey"), "o_orderkey"),
        node(t("part"), "p", "p_partkey", part_kind, "p_name", F.col("p_brand"), "p_partkey"),
        node(t("supplier"), "s", "s_suppkey", "class", "s_name", F.col("s_nationkey"), "s_suppkey"),
        node(t("nation"), "n", "n_nationkey", "module", "n_name", F.col("n_regionkey"), "n_nationkey"),
        node(t("region"), "r", "r_regionkey", "package", "r_name", F.col("r_regionkey"), "r_regionkey"),
    ]
    whole = rows[0]
    for more in rows[1:]:
        whole = whole.union(more)
    return whole.withColumn("qualname", F.col("name"))


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contains: nation to customer, customer to order; calls: customer to order, order to part; extends: supplier to nation."""
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda df, a, b, kind, provenance, seq: df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("kind"), provenance.alias("provenance"), seq.cast("long").alias("seq"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    how = F.when(F.col("l_returnflag") == "N", "resolved").otherwise("heuristic")
    rows = [
        edge(t("customer"), key("n", "c_nationkey"), key("c", "c_custkey"), "contains", F.lit("declared"), F.col("c_custkey")),
        edge(t("orders"), key("c", "o_custkey"), key("o", "o_orderkey"), "contains", F.lit("declared"), F.col("o_orderkey")),
        edge(t("orders"), key("c", "o_custkey"), key("o", "o_orderkey"), "calls", F.lit("resolved"), F.col("o_orderkey")),
        edge(t("lineitem"), key("o", "l_orderkey"), key("p", "l_partkey"), "calls", how, F.col("l_orderkey") * 10 + F.col("l_linenumber")),
        edge(t("supplier"), key("s", "s_suppkey"), key("n", "s_nationkey"), "extends", F.lit("resolved"), F.col("s_suppkey")),
    ]
    whole = rows[0]
    for more in rows[1:]:
        whole = whole.union(more)
    return whole


# The same views in SQL.
SQL_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
SQL_DOCUMENT_NODES = r"""
dn AS (
  SELECT 'd' || d.doc_id AS id, CASE lang WHEN 'en' THEN 'function' WHEN 'de' THEN 'class' WHEN 'fr' THEN 'module' ELSE 'method' END AS kind,
         source AS name, source || '.' || d.doc_id AS qualname, text AS docstring,
         list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1] AS summary,
         coalesce(q.quality, 0) = 1 AS is_exported, source AS file, d.doc_id::INT AS start_line, source, d.doc_id
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) q USING (doc_id)),
de AS (
  SELECT 'd' || (l_orderkey % (SELECT count(*) FROM documents)) AS source, 'd' || (l_partkey % (SELECT count(*) FROM documents)) AS target,
         CASE l_linenumber WHEN 6 THEN 'exemplifies' WHEN 7 THEN 'tests' ELSE 'calls' END AS kind,
         CASE WHEN l_returnflag = 'N' THEN 'resolved' ELSE 'heuristic' END AS provenance, l_orderkey * 10 + l_linenumber AS seq
  FROM lineitem)"""
SQL_STAR = r"""
sn AS (
  SELECT 'c' || c_custkey AS id, 'class' AS kind, c_name AS name, c_nationkey::VARCHAR AS file, c_custkey::INT AS start_line FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'function', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderkey::INT FROM orders
  UNION ALL SELECT 'p' || p_partkey, CASE p_size % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'method' END, p_name, p_brand, p_partkey::INT FROM part
  UNION ALL SELECT 's' || s_suppkey, 'class', s_name, s_nationkey::VARCHAR, s_suppkey::INT FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'module', n_name, n_regionkey::VARCHAR, n_nationkey::INT FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'package', r_name, r_regionkey::VARCHAR, r_regionkey::INT FROM region),
se AS (
  SELECT 'n' || c_nationkey AS source, 'c' || c_custkey AS target, 'contains' AS kind, 'declared' AS provenance, c_custkey::BIGINT AS seq FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'contains', 'declared', o_orderkey FROM orders
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'calls', 'resolved', o_orderkey FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'calls', CASE WHEN l_returnflag = 'N' THEN 'resolved' ELSE 'heuristic' END, l_orderkey * 10 + l_linenumber FROM lineitem
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'extends', 'resolved', s_suppkey FROM supplier)"""
