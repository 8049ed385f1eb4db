"""A whole run: statistics, rules, bodies of what stays unsure, batches, answers, and what is shown of it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.config import LABELS, Config
from lettermill.operators.batches import asked, batches, digest, projections
from lettermill.operators.cascade import classify, merge_model
from lettermill.operators.correspondents import capped, domain_stats, edges, median_latency, person_stats, reply_latencies, thread_index, with_rules
from lettermill.sources.shared import settled

#: Labels in the order in which they are shown, and how many messages of each at most.
SHOWN, SHOWN_EACH = ("now", "later", "brief", "noise"), 20


@dataclass
class Run:
    """Decisions for each message, one row for each batch that was (or would be) sent, answers and warnings."""

    decisions: DataFrame
    batches: DataFrame | None
    said: DataFrame | None
    warnings: DataFrame


def with_statistics(messages: DataFrame, sent: DataFrame, as_of: Column | None = None, rules: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """Messages with what is known of their sender, domain and thread before ``as_of``; without it, all there is, and how fast senders are answered."""
    graph = capped(edges(messages, sent), config.history_cap)
    graph = graph if as_of is None else graph.where(F.col("ts_ms") < F.unix_millis(as_of))
    people = person_stats(graph).drop("name")
    if rules is not None:
        people = with_rules(people, rules)
    else:
        people = people.withColumns({"is_vip": F.lit(False), "is_muted": F.lit(False)})
    people, domains = people.withColumnRenamed("email", "__who"), domain_stats(graph).withColumnRenamed("domain", "__where")
    threads = thread_index(sent if as_of is None else sent.where(F.col("date") < as_of)).select(F.col("threadId").alias("__thread"), "user_messages")
    full = messages.join(people, F.lower("from.email") == F.col("__who"), "left").join(domains, F.col("from.domain") == F.col("__where"), "left")
    full = full.join(threads, F.col("threadId") == F.col("__thread"), "left").drop("__who", "__where", "__thread")
    if as_of is None:
        known = median_latency(reply_latencies(messages, sent)).select(F.col("email").alias("__who"), F.col("median_latency_ms").cast("double"))
        full = full.join(known, F.lower("from.email") == F.col("__who"), "left").drop("__who")
    else:  # latencies don't tell when they were known
        full = full.withColumn("median_latency_ms", F.lit(None).cast("double"))
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("sent_to", "received_from", "domain_sent_to", "user_messages")}
    return full.withColumns(counts | {c: F.coalesce(c, F.lit(False)) for c in ("is_vip", "is_muted")})


def triage(statistics: DataFrame, own: Sequence[str], as_of: Column | None, provider: Callable[[list[dict]], list[dict]] | None = None, bodies: DataFrame | None = None, config: Config = Config(), explain: bool = False) -> Run:
    """Judge messages by rules; what stays unsure goes to a provider in batches, with the bodies (uid, bodyText, attachments) fetched for it only.

    Without a provider, or with ``explain``, nothing is sent: ``batches`` has what would be. A
    message without a body row goes with what it has. Failures are warnings; the messages concerned
    keep the rules' decision.
    """
    spark = statistics.sparkSession
    judged = classify(statistics, own, config, as_of)
    unsure = judged.where("escalate")
    if bodies is not None:
        fetched = bodies.select(F.col("uid").alias("__uid"), F.col("bodyText").alias("__text"), F.col("attachments").alias("__files"))
        unsure = unsure.join(fetched, F.col("uid") == F.col("__uid"), "left").withColumns({"bodyText": F.coalesce("__text", "bodyText"), "attachments": F.coalesce("__files", "attachments")}).drop("__uid", "__text", "__files")
    if provider is None:
        text = F.concat(F.count("*").cast("string"), F.lit(" message(s) were ambiguous but no model is configured; they keep the rules' label"))
        return Run(judged, None, None, unsure.agg(F.when(F.count("*") > 0, text).alias("warning")).where("warning is not null"))
    sent = batches(projections(unsure, own, config), config)
    if explain:
        return Run(judged, sent, None, spark.createDataFrame([], "warning string"))
    said = settled(asked(sent, provider), "answers")
    return Run(merge_model(judged, said.where("uid is not null").drop("warning")), sent, said, said.where("warning is not null").select("warning"))


def reason_rows(decisions: DataFrame) -> DataFrame:
    """Each reason of each decision: position, code, detail, decisive and its weight for each label."""
    rows = decisions.select("uid", "label", "confidence", "tier", F.posexplode("reasons").alias("position", "r"))
    weight = lambda x: F.coalesce(F.col("r.weight")[x], F.lit(0.0)).alias(f"weight_{x}")
    return rows.select("uid", "label", "confidence", "tier", "position", "r.code", "r.detail", "r.decisive", *(weight(x) for x in LABELS))


def why(decisions: DataFrame, uid: int) -> DataFrame:
    """The reasons of one message's decision."""
    return reason_rows(decisions.where(F.col("uid") == uid))


def shown(decisions: DataFrame, most: int = SHOWN_EACH) -> DataFrame:
    """The first messages of each label, in the order of input, and how many more there are; an unknown label is shown as later."""
    decisions = decisions.withColumn("label", F.when(F.col("label").isin(*SHOWN), F.col("label")).otherwise("later"))
    place = F.row_number().over(Window.partitionBy("label", "__cut").orderBy("seq"))
    total = decisions.groupBy("label").agg(F.count("*").alias("n"))
    # the first of each stretch, then the first of those: no task gets a whole label
    firsts = decisions.withColumn("__cut", F.floor(F.col("seq") / 100_000)).withColumn("__k", place).where(F.col("__k") <= most).withColumn("__cut", F.lit(0))
    firsts = firsts.withColumn("place", place).where(F.col("place") <= most)
    order = F.array_position(F.array(*(F.lit(x) for x in SHOWN)), F.col("label")).cast("int")
    return firsts.join(total, "label").select(order.alias("bucket"), "label", "place", "uid", "tier", F.substring("subject", 1, 52).alias("subject"), (F.col("n") - most).alias("beyond")).withColumn("beyond", F.greatest("beyond", F.lit(0).cast("long")))


def brief(decisions: DataFrame, label: str = "brief", most: int = 5) -> DataFrame:
    """What was put away under a label, by sender: its first subjects and how many more."""
    rows = decisions.where(F.col("label") == label).select(F.col("from.email").alias("sender"), "subject", "seq")
    return digest(rows, "sender", "subject", "seq", most)
