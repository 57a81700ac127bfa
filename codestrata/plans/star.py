"""Relational queries at volume, and a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codestrata.plans.registry import query
from codestrata.sources.adapters import DELETIONS, deletions, table
from codestrata.sources.files import export_dataset, verify_export, work_folder
from codestrata.streaming.events import windowed_counts


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def star_pricing(spark, d):
    own = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return own.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY revenue DESC, o_orderkey LIMIT 20")
def star_top_orders(spark, d):
    joined = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(20)


@query("SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def star_region_rollup(spark, d):
    own = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return own.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT p_brand, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 10 GROUP BY 1")
def star_brand_quantity(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part").filter("p_size <= 10"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, d):
    return windowed_counts(spark, f"{d}/events.parquet", f"{work_folder(spark)}/stream-{uuid.uuid4().hex}")


@query("SELECT repo, count(*) AS n, true AS same FROM deletions GROUP BY 1", (DELETIONS,))
def export_verify(spark, d):
    """Write the dataset as Parquet and JSON lines, read both back and compare."""
    folder = f"{work_folder(spark)}/export-{uuid.uuid4().hex}"
    export_dataset(deletions(spark, d), folder)
    return verify_export(spark, folder)
