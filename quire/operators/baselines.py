"""Capabilities of Spark itself over the star-schema tables; the reference has none of these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.catalog import query
from quire.sources.tables import table


@query("base_filter_lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def base_filter_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity")


@query("base_join_orders_customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def base_join_orders_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("base_left_join_labels", "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def base_left_join_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@query("base_semi", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def base_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_semi")


@query("base_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def base_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("base_agg_lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY ALL")
def base_agg_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))


@query("base_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def base_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("base_rollup", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def base_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("base_cube", "SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def base_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("base_rank", "SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events")
def base_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.rank().over(w).cast("long").alias("r"))


@query("base_frame_sum", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM events")
def base_frame_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count(F.lit(1)).over(w).alias("n"))


@query("base_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def base_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("base_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def base_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id"))


@query("base_date_trunc", "SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1")
def base_date_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "base_range_join",
    "SELECT a.event_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 1 DAY WHERE a.event_type = 'purchase' GROUP BY a.event_id",
)
def base_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in the day before a purchase. Times are dealt to days, so a join key holds one day of one user.

    An event of a day can precede purchases of that day or the next, so it is sent to both; the exact range is tested after.
    """
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.unix_date(F.to_date("ts")).alias("day"))
    a = e.filter("event_type = 'purchase'").select("event_id", "user_id", "day", F.col("ts").alias("at"))
    b = e.select("user_id", "ts", F.explode(F.array("day", F.col("day") + 1)).alias("day"))
    met = a.join(b, ["user_id", "day"]).filter((F.col("ts") < F.col("at")) & (F.col("ts") >= F.col("at") - F.expr("INTERVAL 1 DAY")))
    return met.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
