"""Reading tables: Parquet, JSON lines, CSV; and the driver tables as a typed graph.

Everything selects the columns it needs, so pruning reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import literals

#: Rows of a partition, about.
ROWS = 500_000


def parquet(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a table dealt by keys, in partitions whose number goes by their count, which the files have. Adaptive execution would put
    them together by bytes, and rows that are small in files aren't in memory."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS)), *keys)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; lines that don't parse have null in every column, and are dropped."""
    return spark.read.schema(f"{schema}, _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt").json(path).filter("_corrupt IS NULL").drop("_corrupt")


def vocabulary(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """A small rule table given as Python values (topic rules, synonyms)."""
    return spark.createDataFrame(rules) if rules else spark.createDataFrame([], "id STRING")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events of users: id, t, user_id, topic (the type's path), action, value, k."""
    e = parquet(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("t"), "user_id", F.concat(F.lit("activity/"), "event_type").alias("topic_path"), F.col("event_type").alias("action"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def order_events(spark: SparkSession, d: str) -> DataFrame:
    """Orders as events: id, t, actor, status, importance."""
    o = parquet(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("t"), F.col("o_custkey").alias("actor_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("importance"), F.col("o_orderpriority").alias("priority"))


def involves(spark: SparkSession, d: str) -> DataFrame:
    """Which parts an order has: event_id, entity_id, each once."""
    return dealt(parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("entity_id")), "event_id").distinct()


def occurs_at(spark: SparkSession, d: str) -> DataFrame:
    """Where an order happens: event_id, place_id (its customer's nation)."""
    o = parquet(spark, d, "orders", "o_orderkey", "o_custkey")
    c = parquet(spark, d, "customer", "c_custkey", "c_nationkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("event_id"), F.col("c_nationkey").cast("long").alias("place_id"))


def places(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("parent_id"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Documents as memory entries: id, text, tenant_id, memory_domain, published (null where unlabelled), importance, created_at, user_id."""
    doc = parquet(spark, d, "documents", "doc_id", "text", "lang", "source")
    label = parquet(spark, d, "labels")
    return doc.join(label, "doc_id", "left").select(
        F.col("doc_id").alias("id"), "text", F.col("source").alias("tenant_id"), F.col("lang").alias("memory_domain"), (F.col("quality") == 1).alias("published"),
        F.when(F.col("toxic") == 1, 0.1).when(F.col("quality") == 1, 0.8).otherwise(0.5).alias("importance"),
        (literals.timestamp("2024-01-01") + F.make_dt_interval(F.col("doc_id") % 60)).alias("created_at"),
        F.array(F.concat(F.lit("u"), (F.col("doc_id") % 7).cast("string")), F.concat(F.lit("u"), (F.col("doc_id") % 11).cast("string"))).alias("user_id"),
    )


def turns(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"), F.col("role").alias("speaker"), "text")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Weighted edges between parts and suppliers (by lines), and of suppliers and customers to nations. Ids have a letter for the table."""
    lines = dealt(parquet(spark, d, "lineitem", "l_partkey", "l_suppkey"), "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    supply = lines.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst_id"), F.lit("SUPPLIED_BY").alias("rel_type"), "weight")
    based = parquet(spark, d, "supplier", "s_suppkey", "s_nationkey").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst_id"), F.lit("BASED_IN").alias("rel_type"), F.lit(2.0).alias("weight"))
    lives = parquet(spark, d, "customer", "c_custkey", "c_nationkey").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst_id"), F.lit("LIVES_IN").alias("rel_type"), F.lit(1.0).alias("weight"))
    return supply.unionByName(based).unionByName(lives)
