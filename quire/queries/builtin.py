"""Plain Spark capabilities on the relational tables: not operators of outlines, kept as smoke queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.queries.registry import query
from quire.sources.views import table


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def price_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Grouped sums and means behind a pushed-down filter."""
    li = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE r_name = 'ASIA' GROUP BY n_name""")
def revenue_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    """Joins along foreign keys; Spark picks the strategy."""
    t = lambda n: table(spark, sf, n)
    c = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region").where("r_name = 'ASIA'"), F.col("r_regionkey") == F.col("n_regionkey"))
    o = t("orders").join(c, F.col("c_custkey") == F.col("o_custkey"))
    li = t("lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    return li.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def customers_without_urgent_orders(spark: SparkSession, sf: str) -> DataFrame:
    """An anti join."""
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT c_mktsegment, o_orderpriority, count(*) AS n, cast(grouping_id(c_mktsegment, o_orderpriority) AS BIGINT) AS g FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY CUBE (c_mktsegment, o_orderpriority)")
def order_cube(spark: SparkSession, sf: str) -> DataFrame:
    """A cube with grouping ids."""
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return j.cube("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("g"))


@query("""SELECT o_custkey, o_orderkey, cast(rk AS INTEGER) AS rk, round(running, 2) AS running FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk,
 sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS running FROM orders) WHERE rk <= 3""")
def top_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks and running sums."""
    over = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING)"
    o = table(spark, sf, "orders").selectExpr("o_custkey", "o_orderkey", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk", f"sum(o_totalprice) {over} AS running")
    return o.where("rk <= 3").select("o_custkey", "o_orderkey", "rk", F.round("running", 2).alias("running"))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly windows (the batch form of the stream in quire.streaming)."""
    w = table(spark, sf, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that end after 30 quiet minutes."""
    s = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
