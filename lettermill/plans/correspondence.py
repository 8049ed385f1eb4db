"""Queries: point-in-time statistics, latencies, threads, rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lettermill.functions.numbers import half_up
from lettermill.operators.asof import latest_before, running_before
from lettermill.operators.correspondents import capped, median_latency, people, replied_threads, thread_index, with_rules
from lettermill.plans.adapters import EVENTS_SQL, MAIL_SQL, correspondence, mail
from lettermill.plans.registry import query, table
from lettermill.sources.files import read_people_lines, write_people
from lettermill.sources.shared import shared_dir


@query(f"""WITH {EVENTS_SQL} SELECT a.event_id, a.email,
 count(*) FILTER (b.is_sent) AS sent_to, count(*) FILTER (b.is_received) AS received_from, coalesce(max(b.us) FILTER (b.is_sent), 0) AS last_sent_us
 FROM ev a LEFT JOIN ev b ON b.email = a.email AND b.us < a.us WHERE a.is_received GROUP BY 1, 2""")
def pit_correspondent_stats(spark, sf_dir):
    e = correspondence(spark, sf_dir)
    got = running_before(e, e.where("is_received").select("event_id", "email", "us"), ["email"], "us", {"sent_to": "is_sent", "received_from": "is_received"}, {"last_sent_us": "is_sent"})
    return got.select("event_id", "email", "sent_to", "received_from", F.coalesce("last_sent_us", F.lit(0)).alias("last_sent_us"))


@query(f"""WITH {EVENTS_SQL} SELECT a.event_id, a.domain, (SELECT count(*) FROM ev b WHERE b.is_sent AND b.domain = a.domain AND b.us < a.us) AS domain_sent_to
 FROM ev a WHERE a.is_received""")
def pit_domain_stats(spark, sf_dir):
    e = correspondence(spark, sf_dir)
    return running_before(e, e.where("is_received").select("event_id", "domain", "us"), ["domain"], "us", {"domain_sent_to": "is_sent"}).select("event_id", "domain", "domain_sent_to")


_LATENCY = f"""{EVENTS_SQL}, lat AS (SELECT s.event_id, s.email, s.us - max(r.us) AS latency_us FROM ev s JOIN ev r ON r.email = s.email AND r.us < s.us
 WHERE s.is_sent AND r.is_received GROUP BY 1, 2, s.us)"""


def _latencies(spark, sf_dir):
    e = correspondence(spark, sf_dir)
    sent = e.where("is_sent").select("event_id", "email", "us")
    hit = latest_before(sent, e.where("is_received").select("email", "us", "event_id"), ["email"], "us", "event_id", "hit")
    return hit.where("hit is not null").select("event_id", "email", (F.col("us") - F.col("hit_at")).alias("latency_us"))


@query(f"WITH {_LATENCY} SELECT * FROM lat")
def reply_latency_asof(spark, sf_dir):
    return _latencies(spark, sf_dir)


@query(f"WITH {_LATENCY} SELECT email, CAST(floor(median(latency_us // 1000) + 0.5) AS BIGINT) AS median_latency_ms FROM lat GROUP BY 1")
def reply_latency_median(spark, sf_dir):
    return median_latency(_latencies(spark, sf_dir).select("email", F.expr("latency_us div 1000").alias("latency_ms")))


@query(f"""WITH {EVENTS_SQL}, d AS (SELECT *, CASE WHEN is_sent THEN 'sent' ELSE 'received' END AS direction FROM ev WHERE is_sent OR is_received),
 r AS (SELECT *, row_number() OVER (PARTITION BY email, direction ORDER BY event_id DESC) AS k FROM d)
 SELECT email, direction, count(*) AS n, min(event_id) AS oldest FROM r WHERE k <= 20 GROUP BY 1, 2""")
def event_cap_last_n(spark, sf_dir):
    e = correspondence(spark, sf_dir).where("is_sent or is_received").withColumn("direction", F.when(F.col("is_sent"), "sent").otherwise("received")).withColumn("seq", F.col("event_id"))
    return capped(e, 20).groupBy("email", "direction").agg(F.count("*").alias("n"), F.min("event_id").alias("oldest"))


@query(f"""WITH {EVENTS_SQL}, d AS (SELECT *, CASE WHEN is_sent THEN 'sent' ELSE 'received' END AS direction, row_number() OVER (PARTITION BY email, is_sent ORDER BY event_id DESC) AS k FROM ev WHERE is_sent OR is_received),
 p AS (SELECT email, string_agg(us // 1000, ',' ORDER BY event_id) FILTER (is_sent) AS sent, string_agg(us // 1000, ',' ORDER BY event_id) FILTER (NOT is_sent) AS received FROM d WHERE k <= 20 GROUP BY 1),
 l AS (SELECT email, string_agg(ms, ',' ORDER BY event_id) AS waits FROM (SELECT email, us // 1000 % 86400000 AS ms, event_id, row_number() OVER (PARTITION BY email ORDER BY event_id DESC) AS k FROM ev WHERE event_type = 'signup') WHERE k <= 20 GROUP BY 1)
SELECT p.email, upper(p.email) AS name, coalesce(sent, '') AS sent, coalesce(received, '') AS received, coalesce(waits, '') AS latencies FROM p LEFT JOIN l ON l.email = p.email""")
def saved_people(spark, sf_dir):
    """Correspondents as they are saved, written to the shared folder and read back."""
    e = correspondence(spark, sf_dir)
    ms = F.expr("us div 1000")
    graph = e.where("is_sent or is_received").select("email", F.when(F.col("is_sent"), "sent").otherwise("received").alias("direction"), ms.alias("ts_ms"), F.upper("email").alias("name"), F.col("event_id").alias("seq"))
    waits = e.where("event_type = 'signup'").select("email", (ms % 86_400_000).alias("latency_ms"), F.col("event_id").alias("seq"))
    path = f"{shared_dir(spark)}/people-{uuid.uuid4().hex}"
    write_people(people(graph, waits, 20), path)
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return read_people_lines(spark, path).select("email", "name", listed("sent_ms").alias("sent"), listed("received_ms").alias("received"), listed("latencies").alias("latencies"))


def _sent(spark, sf_dir):
    m = mail(spark, sf_dir).where("answered")
    return m.select(F.col("thread").alias("threadId"), F.timestamp_seconds(F.col("minutes") * 60).alias("date"), "uid", "minutes")


@query(f"WITH {MAIL_SQL} SELECT thread AS \"threadId\", count(*) AS user_messages, max(minutes) AS last_minutes FROM mail WHERE answered GROUP BY 1")
def thread_index_query(spark, sf_dir):
    return thread_index(_sent(spark, sf_dir)).select("threadId", "user_messages", (F.unix_seconds("user_last_at") / 60).cast("long").alias("last_minutes"))


@query(f"WITH {MAIL_SQL} SELECT thread AS \"threadId\", array_to_string(list(minutes ORDER BY minutes), ',') AS minutes FROM mail WHERE answered GROUP BY 1")
def replied_threads_query(spark, sf_dir):
    return replied_threads(_sent(spark, sf_dir)).select("threadId", F.array_join(F.transform("replied_at", lambda t: (F.unix_seconds(t) / 60).cast("long").cast("string")), ",").alias("minutes"))


@query(f"WITH {MAIL_SQL} SELECT a.uid, (SELECT count(*) FROM mail b WHERE b.answered AND b.thread = a.thread AND b.minutes < a.minutes) AS prior FROM mail a")
def prior_replies(spark, sf_dir):
    m = mail(spark, sf_dir).select("uid", "thread", "minutes", "answered")
    return running_before(m.where("answered"), m.select("uid", "thread", "minutes"), ["thread"], "minutes", {"prior": "answered"}, width=5000).select("uid", "prior")


@query("""SELECT c_name AS email, lower(c_mktsegment) = 'building' AND c_acctbal > 0 AS is_vip, c_acctbal < -500 AND lower(c_mktsegment) <> 'x' AS is_muted FROM customer""")
def vip_muted_rules(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rules = c.where("(lower(c_mktsegment) = 'building' and c_acctbal > 0) or c_acctbal < -500").select(F.upper("c_name").alias("email"), ((F.lower("c_mktsegment") == "building") & (F.col("c_acctbal") > 0)).alias("is_vip"), (F.col("c_acctbal") < -500).alias("is_muted"))
    people = c.select(F.lower("c_name").alias("email"), "c_name")
    return with_rules(people, rules).select(F.col("c_name").alias("email"), "is_vip", "is_muted")


@query(f"WITH {EVENTS_SQL} SELECT email, count(*) FILTER (is_sent) AS sent_to, count(*) FILTER (is_received) AS received_from, CAST(floor(avg(us // 1000000) + 0.5) AS BIGINT) AS mean_second FROM ev GROUP BY 1")
def correspondent_totals(spark, sf_dir):
    e = correspondence(spark, sf_dir)
    return e.groupBy("email").agg(F.count_if("is_sent").alias("sent_to"), F.count_if("is_received").alias("received_from"), half_up(F.avg(F.expr("us div 1000000"))).alias("mean_second"))
