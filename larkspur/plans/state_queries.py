"""State and storage over the driver's tables: stores merged in part, ranges for many requests, exports, changed files and leases as streams; each with its DuckDB counterpart."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import merge, ports, stores
from larkspur.plans.registry import ORACLES, query
from larkspur.session import shared_dir
from larkspur.sources import files
from larkspur.sources.datasources import register_sources
from larkspur.sources.files import tables
from larkspur.streaming import ingest, leases


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


@query("store_upsert", ORACLES["upsert_latest_wins"])
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a stored table, into which each user's latest event is merged: only their buckets are written."""
    c, e = tables(spark, d, "customer", "events")
    store = stores.create_store(c.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value")), ["user_id"])
    store.upsert(e.select("user_id", "value", "ts", "event_id"), F.struct("ts", "event_id"))
    return store.rows


@query("range_allocation", "SELECT host, seq, (start)::INT AS range_start, (start + size - 1)::INT AS range_end FROM (SELECT host, seq, size, 3005 + sum(size) OVER (PARTITION BY host ORDER BY seq, size ROWS UNBOUNDED PRECEDING) - size AS start FROM (SELECT 'h' || l_suppkey AS host, l_orderkey * 10 + l_linenumber AS seq, l_quantity::INT AS size FROM lineitem))")
def range_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Every line asks its supplier's host for as many numbers as its quantity, one line after the other, past a range that is held."""
    lines, s = tables(spark, d, "lineitem", "supplier")
    host = lambda c: F.concat(F.lit("h"), c).alias("host")
    occupied = s.select(host("s_suppkey"), F.lit(3000).alias("range_start"), F.lit(3004).alias("range_end"))
    asked = lines.select(host("l_suppkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.lit(3000).alias("base"), F.col("l_quantity").cast("int").alias("size"))
    return ports.allocate(occupied, asked, cap=2**31 - 1)


@query("export_order", "SELECT o_orderkey AS id, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS created_at, true AS in_order FROM orders")
def export_order(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as an export and read back; in_order: no row of an earlier file comes after one of a later file."""
    (o,) = tables(spark, d, "orders")
    path, schema = _folder(spark, "export"), "id long, status string, created_at string"
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))
    files.write_export(path, "1", part_rows=max(1, o.count() // 4), orders=rows)
    back = files.read_export(spark, path, {"orders": schema}, "1")["orders"].withColumn("file", F.col("_metadata.file_name"))
    spans = back.groupBy("file").agg(F.min(F.struct("created_at", "id")).alias("least"), F.max(F.struct("created_at", "id")).alias("most"))  # a row a file
    later = spans.select(F.col("file").alias("after"), F.col("least").alias("begins"))
    wrong = spans.join(later, F.col("after") > F.col("file")).filter("begins < most").select("file").distinct().withColumn("in_order", F.lit(False))
    return back.join(wrong, "file", "left").select("id", "status", "created_at", F.coalesce("in_order", F.lit(True)).alias("in_order"))


@query("changed_files_stream", "SELECT page_id, length(html) AS n FROM pages")
def changed_files_stream(spark: SparkSession, d: str) -> DataFrame:
    """Pages as lines of files, which come in two steps, read by the stream of changed files; each line once."""
    (p,) = tables(spark, d, "pages")
    register_sources(spark)
    base = _folder(spark, "changed")
    lines = p.select(F.to_json(F.struct("page_id", F.length("html").alias("n"))).alias("value"), (F.col("page_id") % 2).alias("half"))

    def taken(batch: DataFrame, _: int) -> None:
        batch.select(F.explode(F.split("value", "\n")).alias("line")).filter("line <> ''").write.mode("append").parquet(f"{base}/out")

    for half in (0, 1):
        lines.filter(F.col("half") == half).select("value").write.mode("append").text(f"{base}/in")
        stream = spark.readStream.format("changed_files").option("pattern", "*.txt").option("listings", f"{base}/listings").load(f"{base}/in")
        ingest.ingest(stream, taken, f"{base}/checkpoint").awaitTermination()
    told = F.from_json("line", "page_id long, n int")
    return spark.read.schema("line string").parquet(f"{base}/out").select(told.alias("t")).select("t.page_id", "t.n")


@query("lease_events", "SELECT 'p' || o_custkey AS project_id, o_orderkey AS job_id, CASE n WHEN 1 THEN 'granted' ELSE 'refused' END AS event, CASE WHEN n > 1 THEN first ELSE -1 END AS owner_job_id FROM (SELECT *, row_number() OVER w AS n, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderdate) AS first FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey))")
def lease_events(spark: SparkSession, d: str) -> DataFrame:
    """Orders ask for their customer's file on their day: the first of a day gets it, for two hours, so each day begins anew."""
    (o,) = tables(spark, d, "orders")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    base = _folder(spark, "leases")
    asked = o.select(F.concat(F.lit("p"), "o_custkey").alias("project_id"), F.col("o_orderkey").alias("job_id"), F.lit("acquire").alias("kind"), F.array(F.lit("file")).alias("paths"), F.col("o_orderdate").cast("timestamp").alias("at"))
    asked.write.parquet(f"{base}/in")
    stream = leases.leases(spark.readStream.schema(asked.schema).parquet(f"{base}/in"))
    ingest.ingest(stream, lambda batch, _: batch.write.mode("append").parquet(f"{base}/out"), f"{base}/checkpoint").awaitTermination()
    told = spark.read.schema(leases.EVENTS).parquet(f"{base}/out").filter("event <> 'expired'")
    return told.select("project_id", "job_id", "event", F.coalesce("owner_job_id", F.lit(-1)).alias("owner_job_id"))


@query("flags_set_and_cleared", "SELECT event_type AS key, CASE event_type WHEN 'click' THEN 'new,again' ELSE 'r' END AS reasons FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'view' UNION SELECT 'click')")
def flags_set_and_cleared(spark: SparkSession, d: str) -> DataFrame:
    (e,) = tables(spark, d, "events")
    now = F.lit("2024-01-01").cast("timestamp")
    flags = e.select(F.col("event_type").alias("key")).distinct().select("key", F.array(F.lit("r")).alias("reasons"), now.alias("updated_at"))
    done = merge.clear_flag(merge.set_flag(flags, "click", ["new", "again"], now), "view")
    return done.select("key", F.array_join("reasons", ",").alias("reasons"))


@query("nul_and_length", "SELECT doc_id, substr(text, 1, 200) AS text FROM documents")
def nul_and_length(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = tables(spark, d, "documents")
    spoiled = F.concat(F.lit("\0"), F.substring("text", 1, 50), F.lit("\0\0"), F.substr("text", F.lit(51)))
    return docs.select("doc_id", text.without_nul(spoiled, 200).alias("text"))
