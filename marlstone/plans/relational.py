"""Plain relational queries (group 2.Z of the survey): joins, rollups, pivots, set operations and top-k, in one table's worth of forms each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query
from .tables import table


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp'2001-06-01'")
    return i.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY revenue DESC, o_orderkey LIMIT 10""")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    j = c.join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    g = j.groupBy("o_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return g.orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("""SELECT r_name, n_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def supplier_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)""")
def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(*) FILTER (hour(ts) < 8) AS night, count(*) FILTER (hour(ts) BETWEEN 8 AND 15) AS day, count(*) FILTER (hour(ts) > 15) AS evening FROM events GROUP BY 1""")
def event_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.hour("ts") < 8, "night").when(F.hour("ts") <= 15, "day").otherwise("evening")
    e = table(spark, sf_dir, "events").groupBy("event_type", part.alias("part")).count().groupBy("event_type").pivot("part", ["night", "day", "evening"]).agg(F.sum("count"))
    return e.na.fill(0)


@query("""SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error' EXCEPT SELECT user_id FROM events WHERE event_type = 'signup' AND value > 150""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ids = lambda c: e.where(c).select("user_id")
    return ids("event_type = 'purchase'").intersect(ids("event_type = 'error'")).subtract(ids("event_type = 'signup' AND value > 150"))


@query("""WITH l AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events), s AS (SELECT *, sum(CASE WHEN was IS NULL OR ts - was > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM l)
SELECT user_id, session::BIGINT AS session, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM s GROUP BY 1, 2""")
def sessionised(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    e = table(spark, sf_dir, "events").withColumn("new", F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) > 6 * 3600 * 10**6).cast("int"), F.lit(1)))
    s = e.withColumn("session", F.sum("new").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("""SELECT p_brand, p_type, p_partkey, n::INTEGER AS n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 3""")
def top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return table(spark, sf_dir, "part").withColumn("n", n).where("n <= 3").select("p_brand", "p_type", "p_partkey", "n")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) AND c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12)""")
def scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    mean = c.agg(F.avg("c_acctbal").alias("mean"))
    busy = o.groupBy("o_custkey").count().where("count > 12").select(F.col("o_custkey").alias("c_custkey"))
    return c.crossJoin(F.broadcast(mean)).where("c_acctbal > mean").join(busy, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""SELECT conv_id, count(*) AS turns, sum(len(text))::BIGINT AS chars, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1""")
def conversation_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.char_length("text")).alias("chars"), roles.alias("roles"))


@query("""SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, round(sum(o_totalprice), 2) AS total, round(sum(sum(o_totalprice)) OVER (PARTITION BY year(o_orderdate) ORDER BY month(o_orderdate)), 2) AS running FROM orders GROUP BY 1, 2""")
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month")).agg(F.sum("o_totalprice").alias("t"))
    return m.select("year", "month", F.round("t", 2).alias("total"), F.round(F.sum("t").over(Window.partitionBy("year").orderBy("month")), 2).alias("running"))
