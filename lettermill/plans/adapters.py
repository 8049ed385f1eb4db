"""The given tables as mail: expressions that Spark and the SQL oracle share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.plans.registry import table

OWN = ("me@home.example",)

#: A document as a message; scalars only, so that both engines read the same text.
MAIL = {
    "uid": "doc_id",
    "email": "concat(case when source = 'src3' then 'no-reply' else source end, '@', lang, '.example')",
    "domain": "concat(lang, '.example')",
    "thread": "concat('t', doc_id % 97)",
    "addr": "case doc_id % 4 when 0 then 'direct' when 1 then 'group' when 2 then 'cc' else 'bcc' end",
    "auth": "case doc_id % 9 when 0 then 'fail' when 1 then 'pass' else 'none' end",
    "bulk": "doc_id % 13 = 0",
    "auto": "doc_id % 29 = 0",
    "answered": "doc_id % 6 = 5",
    "seen": "doc_id % 3 > 0",
    "flagged": "doc_id % 10 = 7",
    "files": "doc_id % 5",
    "minutes": "doc_id * 7 % 43200",
    "subject": "concat(case doc_id % 8 when 1 then 'Re: ' when 2 then 'Fwd: ' else '' end, substring(text, 1, 40), case when doc_id % 7 = 3 then '?' else '' end)",
    "body": "concat(text, case doc_id % 11 when 0 then ' could you answer asap?' when 1 then ' limited time webinar' when 2 then ' is that so?' else '' end)",
}

MAIL_SQL = "mail AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in MAIL.items()) + " FROM documents)"

#: Some customers are important or muted.
EVENTS_SQL = "ev AS (SELECT event_id, concat('u', user_id) AS email, concat('d', user_id % 7) AS domain, epoch_us(ts) AS us, event_type, event_type IN ('view', 'click') AS is_received, event_type = 'purchase' AS is_sent FROM events)"


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*(f"{e} AS {c}" for c, e in MAIL.items()))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full message rows of ``mail``."""
    m = mail(spark, sf_dir)
    person = lambda e: F.struct(F.lit("").alias("name"), F.lit(e).alias("email"), F.lit("x.example").alias("domain"))
    me, other = person(OWN[0]), person("you@x.example")
    none = F.filter(F.array(me), lambda a: F.lit(False))
    is_ = lambda *x: F.col("addr").isin(*x)
    auth = F.when(F.col("auth") == "fail", "spf=fail dkim=fail").when(F.col("auth") == "pass", "dkim=pass").otherwise("")
    flag = lambda c, f: F.when(F.col(c), F.lit(f))
    return m.select(
        "uid", F.lit("INBOX").alias("folder"), F.concat(F.lit("<"), F.col("uid").cast("string"), F.lit("@x>")).alias("messageId"), F.col("thread").alias("threadId"),
        F.struct(F.lit("").alias("name"), F.col("email").alias("email"), F.col("domain").alias("domain")).alias("from"),
        F.when(is_("direct"), F.array(me)).when(is_("group"), F.array(me, other)).otherwise(F.array(other)).alias("to"), F.when(is_("cc"), F.array(me)).otherwise(none).alias("cc"),
        "subject", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("minutes") * 60).alias("date"), F.array_compact(F.array(flag("answered", "\\Answered"), flag("seen", "\\Seen"), flag("flagged", "\\Flagged"))).alias("flags"),
        F.map_filter(F.create_map(F.lit("list-id"), F.when(F.col("bulk"), "l").otherwise(""), F.lit("auto-submitted"), F.when(F.col("auto"), "auto-replied").otherwise(""), F.lit("authentication-results"), auth), lambda k, v: v != "").alias("headers"),
        F.col("body").alias("bodyText"), F.transform(F.slice(F.sequence(F.lit(0), F.lit(4)), 1, F.col("files").cast("int")), lambda i: F.struct(F.concat(F.lit("f"), i.cast("string")).alias("filename"), F.lit("text/plain").alias("contentType"), F.lit(1).cast("long").alias("size"))).alias("attachments"),
        F.col("uid").alias("seq"),
    )


def correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as correspondence: what was seen is received, what was bought is sent."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("email"), F.concat(F.lit("d"), (F.col("user_id") % 7).cast("string")).alias("domain"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", F.col("event_type").isin("view", "click").alias("is_received"), (F.col("event_type") == "purchase").alias("is_sent"))
