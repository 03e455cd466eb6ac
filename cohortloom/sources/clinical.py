"""The clinical tables that the operators work on, and their view over the star-schema tables.

visits(patient_id, visit_id, visit_ts, discharge_ts, discharge_status), codes(patient_id, visit_id, kind, code, seq)
and visit_lists(…, conditions, procedures, drugs): a row for every visit with its code lists in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"conditions": "p_type", "procedures": "p_brand", "drugs": "p_size"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as parquet."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as visits; the last shipment is the discharge, status F is 1, O is 0, others unknown."""
    o = read(spark, sf_dir, "orders")
    out = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("discharge_ts"))
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    return o.join(out, o.o_orderkey == out.l_orderkey, "left").select(
        F.col("o_custkey").cast("string").alias("patient_id"), F.col("o_orderkey").cast("string").alias("visit_id"),
        F.col("o_custkey").alias("patient_key"), F.col("o_orderkey").alias("visit_key"),
        F.col("o_orderdate").alias("visit_ts"), "discharge_ts", status.alias("discharge_status"))


def code_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(visit_key, conditions, procedures, drugs): lists by line number; one shuffle by visit."""
    li, p = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), read(spark, sf_dir, "part").select("p_partkey", *KINDS.values())
    rows = li.join(p, li.l_partkey == p.p_partkey)
    item = F.struct("l_linenumber", *[F.col(c).cast("string").alias(k) for k, c in KINDS.items()])
    got = rows.groupBy(F.col("l_orderkey").alias("visit_key")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return got.select("visit_key", *[F.col(f"items.{k}").alias(k) for k in KINDS])


def visit_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits with their code lists; visits without codes have empty lists."""
    v, c = visits(spark, sf_dir), code_lists(spark, sf_dir)
    none = F.array().cast("array<string>")
    return v.join(c, "visit_key", "left").withColumns({k: F.coalesce(k, none) for k in KINDS})


#: The same views in SQL, for oracles: CTEs v (visits) and x (visits with lists).
SQL_VIEWS = """
v AS (SELECT CAST(o_custkey AS VARCHAR) AS patient_id, CAST(o_orderkey AS VARCHAR) AS visit_id, o_custkey AS patient_key, o_orderkey AS visit_key,
  o_orderdate AS visit_ts, d AS discharge_ts, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS discharge_status
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS d FROM lineitem GROUP BY 1) s ON o_orderkey = l_orderkey),
cl AS (SELECT l_orderkey AS visit_key, list(p_type ORDER BY l_linenumber, p_type, p_brand, CAST(p_size AS VARCHAR)) AS conditions, list(p_brand ORDER BY l_linenumber, p_type, p_brand, CAST(p_size AS VARCHAR)) AS procedures,
  list(CAST(p_size AS VARCHAR) ORDER BY l_linenumber, p_type, p_brand, CAST(p_size AS VARCHAR)) AS drugs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
x AS (SELECT v.*, coalesce(conditions, []) AS conditions, coalesce(procedures, []) AS procedures, coalesce(drugs, []) AS drugs FROM v LEFT JOIN cl USING (visit_key))
"""
