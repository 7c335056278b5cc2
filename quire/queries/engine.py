"""More plain Spark capabilities on the relational tables: set operations, SQL text, functions of one's own, formats."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.plans.build import cut
from quire.queries.registry import query
from quire.sources.shared import shared_folder
from quire.sources.views import table


@query("""SELECT 'union' AS op, k, 1::BIGINT AS n FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer)
UNION ALL SELECT 'intersect all', k, count(*) FROM (SELECT o_custkey AS k FROM orders INTERSECT ALL SELECT user_id FROM events) GROUP BY k
UNION ALL SELECT 'except all', k, count(*) FROM (SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT user_id FROM events) GROUP BY k
UNION ALL SELECT 'except', k, 1 FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """UNION DISTINCT, INTERSECT ALL, EXCEPT ALL and EXCEPT with SQL semantics."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("k"))
    parts = {"union": o.union(c).distinct(), "intersect all": o.intersectAll(e), "except all": o.exceptAll(e), "except": c.subtract(o)}
    out = None
    for op, rows in parts.items():
        counted = rows.groupBy("k").agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "k", "n")
        out = counted if out is None else out.union(counted)
    return out


_TEXT = """WITH big AS (SELECT o_custkey, o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {orders})),
 per AS (SELECT o_custkey, count(*) AS n, round(max(o_totalprice), 2) AS top FROM big GROUP BY o_custkey)
SELECT c.c_custkey, c.c_name, p.n, p.top FROM {customer} c JOIN per p ON p.o_custkey = c.c_custkey
WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT') AND c.c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey <> 0)"""


@query(_TEXT.format(orders="orders", customer="customer", nation="nation"))
def sql_text(spark: SparkSession, sf: str) -> DataFrame:
    """SQL text over views with common table expressions, scalar, correlated and IN subqueries."""
    for name in ("orders", "customer", "nation"):
        table(spark, sf, name).createOrReplaceTempView(f"quire_{name}")
    return spark.sql(_TEXT.format(orders="quire_orders", customer="quire_customer", nation="quire_nation"))


@query("""WITH s AS (SELECT p_partkey, upper(p_brand) || '/' || p_size AS label, unnest(string_split(p_type, ' ')) AS part, unnest(generate_series(1, len(string_split(p_type, ' ')))) AS place FROM part),
 m AS (SELECT p_brand, max(p_retailprice) - min(p_retailprice) AS spread FROM part GROUP BY p_brand)
SELECT s.p_partkey, label, part, cast(place AS INTEGER) AS place, round(spread, 2) AS spread FROM s JOIN part USING (p_partkey) JOIN m USING (p_brand)""")
def own_functions(spark: SparkSession, sf: str) -> DataFrame:
    """A scalar, an aggregate and a table function of one's own, registered for SQL text; vectorised or row generators."""

    @F.pandas_udf("string")
    def quire_label(brand: pd.Series, size: pd.Series) -> pd.Series:
        return brand.str.upper() + "/" + size.astype(str)

    @F.pandas_udf("double")
    def quire_spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    class Parts:
        def eval(self, text: str) -> Iterator[tuple]:
            for i, part in enumerate((text or "").split(" "), 1):
                yield part, i

    spark.udf.register("quire_label", quire_label)
    spark.udf.register("quire_spread", quire_spread)
    spark.udtf.register("quire_parts", F.udtf(Parts, returnType="part string, place int"))
    table(spark, sf, "part").createOrReplaceTempView("quire_part")
    return spark.sql("""WITH m AS (SELECT p_brand, quire_spread(p_retailprice) AS spread FROM quire_part GROUP BY p_brand)
        SELECT p.p_partkey, quire_label(p.p_brand, p.p_size) AS label, t.part, t.place, round(m.spread, 2) AS spread
        FROM quire_part p JOIN m ON m.p_brand = p.p_brand, LATERAL quire_parts(p.p_type) t""")


@query("""SELECT event_id, md5(props) AS md5, sha256(event_type) AS sha, event_id & 12 AS both, event_id | 5 AS either, xor(event_id, 9) AS one, (event_id << 3) AS shifted, cast(bit_count(event_id) AS INTEGER) AS ones,
 round(sin(value), 6) AS sine, round(degrees(atan2(value, 2)), 6) AS angle, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS hour_s, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') AS next_day,
 event_type AS only_key, k + 1 AS raised FROM (SELECT *, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE value IS NOT NULL)""")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes, bits, trigonometry, date arithmetic, maps and a JSON path."""
    e = table(spark, sf, "events").where("value IS NOT NULL")
    m = F.transform_values(F.create_map("event_type", F.get_json_object("props", "$.k").cast("long")), lambda k, x: x + 1)
    return e.select(
        "event_id", F.md5("props").alias("md5"), F.sha2("event_type", 256).alias("sha"), F.col("event_id").bitwiseAND(12).alias("both"), F.col("event_id").bitwiseOR(5).alias("either"),
        F.col("event_id").bitwiseXOR(9).alias("one"), F.shiftleft("event_id", 3).alias("shifted"), F.bit_count("event_id").alias("ones"), F.round(F.sin("value"), 6).alias("sine"),
        F.round(F.degrees(F.atan2("value", F.lit(2.0))), 6).alias("angle"), F.expr("timestampdiff(SECOND, TIMESTAMP '2024-01-01', date_trunc('HOUR', ts))").alias("hour_s"),
        F.date_format(F.col("ts") + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd").alias("next_day"), F.map_keys(m)[0].alias("only_key"), F.map_values(m)[0].alias("raised"),
    )


@query("""SELECT event_id, cast(json_extract_string(props, '$.k') AS INTEGER) AS parsed, cast(json_extract_string(props, '$.k') AS INTEGER) AS varied, cast(list_sum(list_transform(list_filter([1, 2, 3, event_id % 7], lambda x: x % 2 = 1), lambda x: x * x)) AS BIGINT) AS odd_squares FROM events""")
def semi_structured(spark: SparkSession, sf: str) -> DataFrame:
    """JSON by schema and as a variant; higher-order array functions."""
    xs = F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), F.lit(3).cast("long"), F.col("event_id") % 7)
    odd = F.aggregate(F.transform(F.filter(xs, lambda x: x % 2 == 1), lambda x: x * x), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, sf, "events").select(
        "event_id", F.from_json("props", "k int")["k"].alias("parsed"), F.variant_get(F.parse_json("props"), "$.k", "int").alias("varied"), odd.alias("odd_squares")
    )


_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(f"""SELECT o_orderkey, cast(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS rk, cast(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS dr, cast(ntile(4) {_W} AS INTEGER) AS quarter,
 round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 6) AS pr, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 6) AS cd,
 nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second,
 count(*) OVER (PARTITION BY o_custkey ORDER BY epoch(o_orderdate) RANGE BETWEEN 7776000 PRECEDING AND CURRENT ROW) AS in_90_days FROM orders""")
def window_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Rank, dense_rank, ntile, percent_rank, cume_dist, nth_value and a RANGE frame."""
    by = Window.partitionBy("o_custkey")
    kind, time = by.orderBy("o_orderpriority"), by.orderBy("o_orderdate", "o_orderkey")
    days = by.orderBy(F.unix_timestamp("o_orderdate")).rangeBetween(-7776000, 0)
    return table(spark, sf, "orders").select(
        "o_orderkey", F.rank().over(kind).alias("rk"), F.dense_rank().over(kind).alias("dr"), F.ntile(4).over(time).alias("quarter"), F.round(F.percent_rank().over(kind), 6).alias("pr"),
        F.round(F.cume_dist().over(kind), 6).alias("cd"), F.nth_value("o_orderkey", 2).over(time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("second"), F.count("*").over(days).alias("in_90_days"),
    )


@query("""SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, cast(sum(l_linenumber) AS BIGINT) AS s, cast(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS g, true AS close
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def distinct_and_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Several distinct counts over grouping sets; ``close`` says that the sketches are within a tenth."""
    table(spark, sf, "lineitem").createOrReplaceTempView("quire_lineitem")
    # Distinct rows and sums first, so the grouping sets expand a few rows for each part and supplier and not every line.
    rows = spark.sql("""SELECT l_returnflag, l_linestatus, count(DISTINCT part) AS parts, count(DISTINCT supplier) AS suppliers, sum(n) AS s, grouping_id(l_returnflag, l_linestatus) AS g
        FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_partkey AS part, NULL AS supplier, NULL AS n FROM quire_lineitem
          UNION ALL SELECT DISTINCT l_returnflag, l_linestatus, NULL, l_suppkey, NULL FROM quire_lineitem
          UNION ALL SELECT l_returnflag, l_linestatus, NULL, NULL, sum(l_linenumber) FROM quire_lineitem GROUP BY l_returnflag, l_linestatus)
        GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
    lines = table(spark, sf, "lineitem")
    # Apart, as beside a distinct count a sketch is kept for every part.
    about, exact = lines.agg(F.approx_count_distinct("l_partkey", 0.02).alias("a")), lines.agg(F.count_distinct("l_partkey").alias("b"))
    sketch = about.crossJoin(F.broadcast(exact)).select((F.abs(F.col("a") - F.col("b")) <= F.col("b") / 10).alias("close"))  # one row each
    return rows.crossJoin(F.broadcast(sketch)).withColumn("g", F.col("g").cast("long"))  # one row


@query("""SELECT e.event_id, (SELECT max_by(p.event_id, (p.ts, p.event_id)) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND (p.ts < e.ts OR p.ts = e.ts AND p.event_id < e.event_id)) AS last_purchase FROM events e WHERE e.event_type = 'error'""")
def as_of_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each error with the user's last purchase before it, as a running value and no join."""
    e = table(spark, sf, "events").where("event_type IN ('error', 'purchase')")
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return e.withColumn("last_purchase", F.last(bought, ignorenulls=True).over(before)).where("event_type = 'error'").select("event_id", "last_purchase")


@query("""SELECT o_orderkey, count(l_orderkey) AS n, coalesce(sum(l_linenumber), 0)::BIGINT AS s FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY GROUP BY o_orderkey""")
def interval_join(spark: SparkSession, sf: str) -> DataFrame:
    """An outer join with an interval condition beside the key, so it stays an equi-join."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    near = (F.col("l_orderkey") == F.col("o_orderkey")) & F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 30 DAY"))
    return o.join(li, near, "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n"), F.coalesce(F.sum("l_linenumber"), F.lit(0)).cast("long").alias("s"))


@query("""SELECT coalesce(c_custkey, k) AS id, c_custkey IS NOT NULL AS customer, k IS NOT NULL AS "user", coalesce(n, 0) AS n FROM customer FULL JOIN (SELECT user_id + 100 AS k, count(*) AS n FROM events GROUP BY 1) ON k = c_custkey""")
def full_outer_join(spark: SparkSession, sf: str) -> DataFrame:
    """A full outer join by sort and merge."""
    e = table(spark, sf, "events").groupBy((F.col("user_id") + 100).alias("k")).agg(F.count("*").alias("n"))
    j = table(spark, sf, "customer").hint("merge").join(e, F.col("k") == F.col("c_custkey"), "full")
    return j.select(F.coalesce("c_custkey", "k").alias("id"), F.col("c_custkey").isNotNull().alias("customer"), F.col("k").isNotNull().alias("user"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def global_order(spark: SparkSession, sf: str) -> DataFrame:
    """Every row's place in a global order, by range partitions that spill and merge; no task sees all rows."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    parts = cut(o.repartitionByRange(F.desc("o_totalprice"), F.asc("o_orderkey")).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))  # one row for each partition
    starts = sizes.selectExpr("part", "coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("o_totalprice"), F.asc("o_orderkey")))
    return parts.withColumn("inside", inside).join(F.broadcast(starts), "part").select("o_orderkey", (F.col("start") + F.col("inside")).alias("place"))


@query("SELECT f.format, n_nationkey, n_name, n_regionkey FROM nation, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) f(format)")
def formats(spark: SparkSession, sf: str) -> DataFrame:
    """A table written to and read from CSV, JSON, ORC and Parquet."""
    nation, folder, out = table(spark, sf, "nation"), f"{shared_folder(spark)}/formats-{uuid.uuid4().hex}", None
    for kind in ("csv", "json", "orc", "parquet"):
        nation.write.format(kind).save(f"{folder}/{kind}")
        back = spark.read.format(kind).schema(nation.schema).load(f"{folder}/{kind}").select(F.lit(kind).alias("format"), *nation.columns)
        out = back if out is None else out.union(back)
    return out


@query("SELECT l_orderkey, l_linenumber, cast(ceil(l_quantity / 7) AS BIGINT) AS up, least(l_tax, l_discount) AS low, greatest(l_tax, l_discount) AS high, round(sqrt(l_quantity + 1), 6) AS root, strftime(l_shipdate, '%Y%m%d_%H%M%S') AS stamp, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM lineitem")
def math_and_dates(spark: SparkSession, sf: str) -> DataFrame:
    """ceil, min, max, sqrt; run stamps and ISO time."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.ceil(F.col("l_quantity") / 7).alias("up"), F.least("l_tax", "l_discount").alias("low"), F.greatest("l_tax", "l_discount").alias("high"),
        F.round(F.sqrt(F.col("l_quantity") + 1), 6).alias("root"), F.date_format("l_shipdate", "yyyyMMdd_HHmmss").alias("stamp"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"),
    )
