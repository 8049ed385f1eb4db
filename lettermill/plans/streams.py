"""Queries that run as streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lettermill.plans.registry import query, table
from lettermill.sources.sessions import register
from lettermill.sources.shared import shared_dir
from lettermill.streaming.state import last_events


@query("""
WITH e AS (SELECT concat('u', user_id) AS email, CASE event_type WHEN 'purchase' THEN 'sent' ELSE 'received' END AS direction, event_id AS seq, epoch_us(ts) // 1000 AS ms FROM events),
 l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY email, direction ORDER BY seq DESC) <= 20)
SELECT email, direction, count(*) AS events, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(ms) AS BIGINT) AS total_ms FROM l GROUP BY 1, 2""")
def streamed_last_events(spark, sf_dir):
    """The last 20 events of each correspondent and direction, kept as state of a stream over the events table."""
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    rows = rows.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("email"), F.when(F.col("event_type") == "purchase", "sent").otherwise("received").alias("direction"), F.lit(1).cast("long").alias("epoch"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    path = f"{shared_dir(spark)}/streamed-{uuid.uuid4().hex}"
    sink = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{path}/rows")
    last_events(rows, 20).writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.parquet(f"{path}/rows").groupBy("email", "direction").agg(F.max_by(F.struct("events", "seqs", "times"), "batch").alias("k"))
    total = F.aggregate("k.times", F.lit(0).cast("long"), lambda a, x: a + x)
    return kept.select("email", "direction", F.col("k.events").alias("events"), F.array_min("k.seqs").alias("first_seq"), F.array_max("k.seqs").alias("last_seq"), total.alias("total_ms"))


@query("""
SELECT doc_id AS uid, length(text) AS chars, sha256(concat('Subject: ', lang, chr(13), chr(10), chr(13), chr(10), text)) AS raw_sha256, CASE WHEN doc_id % 3 > 0 THEN '\\Seen' ELSE '' END AS flags, epoch(TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id * 7 % 43200 AS INT)))::BIGINT AS received
FROM documents WHERE doc_id > 10 AND doc_id * 7 % 43200 >= 1440""")
def session_rows(spark, sf_dir):
    """Documents as the responses of captured sessions, written by Spark and read by the data source: later than a day and above a uid, which the source tells by itself."""
    raw = F.concat(F.lit("Subject: "), "lang", F.lit("\r\n\r\n"), "text")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.col("doc_id") * 7, F.lit(43200)) * 60)
    size = F.octet_length(raw).cast("string")
    value = F.concat(
        F.lit("* 1 FETCH (UID "), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 > 0, " FLAGS (\\Seen)").otherwise(" FLAGS ()"), F.lit(' INTERNALDATE "'), F.date_format(at, "dd-MMM-yyyy HH:mm:ss"), F.lit(' +0000" RFC822.SIZE '), size,
        F.lit(" BODY[] {"), size, F.lit("}\r\n"), raw, F.lit(")"),
    )
    path = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").select(value.alias("value")).write.option("lineSep", "\r\n").text(path)
    register(spark)
    rows = spark.read.format("mail_sessions").load(path).where((F.col("uid") > 10) & (F.col("internalDate") >= F.lit("2024-01-02 00:00:00").cast("timestamp")))
    data = F.encode("raw", "ISO-8859-1")
    return rows.select("uid", (F.char_length(F.decode(data, "UTF-8")) - 15).cast("long").alias("chars"), F.sha2(data, 256).alias("raw_sha256"), F.array_join("flags", ",").alias("flags"), F.unix_seconds("internalDate").alias("received"))
