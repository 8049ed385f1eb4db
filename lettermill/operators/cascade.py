"""Classification by rules: decisive ones in order, then weighted ones by score, as one projection."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.config import LABELS, Config
from lettermill.functions.headers import addressing, authentication
from lettermill.functions.numbers import age_days, half_up
from lettermill.functions.text import local_part

_A, _Z = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
# What the wording rules look for.
NO_REPLY = r"(?i)\A(no-?reply|do-?not-?reply|notifications?|automated|mailer-daemon|bounce)"
MARKETING = rf"(?i)(?<=\A|[^0-9A-Za-z_])(unsubscribe|view (this )?in browser|limited time|webinar|free trial|act now|don't miss){_Z}|(?i)(?<=[0-9A-Za-z_])% off{_Z}"
DEADLINE = rf"(?i){_A}(by (eod|today|tomorrow|monday|tuesday|wednesday|thursday|friday)|urgent|asap|deadline|time[- ]sensitive|need(s)? (an )?answer|before the call){_Z}"
ASKS_YOU = rf"(?i){_A}((can|could|would|will|do|did|are|is|should) you|what do you think){_Z}"
REPLY, FORWARD = r"(?i)\A\s*(re|aw|antw|sv|vs)\s*:", r"(?i)\A\s*(fwd?|wg)\s*:"
BODY_READ = 4000


@dataclass(frozen=True)
class Decisive:
    code: str
    when: Column
    detail: Column
    label: str
    confidence: float


@dataclass(frozen=True)
class Weighted:
    code: Column
    when: Column
    detail: Column
    #: The weight of each label, a number or a column.
    weights: dict[str, float | Column] = field(default_factory=dict)


def _has(header: str) -> Column:
    return F.coalesce(F.map_contains_key("headers", header), F.lit(False))


def _header(name: str) -> Column:
    return F.col("headers")[name]


def _days(x: Column) -> Column:
    return half_up(x).cast("string")


def _summed(label: str) -> Column:
    return F.aggregate("__fired", F.lit(0.0), lambda s, r: s + r[label])


def decisive_rules(config: Config, as_of: Column) -> list[Decisive]:
    auth, sent, got = F.col("auth"), F.col("sent_to"), F.col("received_from")
    auto, precedence = _header("auto-submitted"), F.trim(_header("precedence"))
    bulk = precedence.rlike(r"(?i)\A(bulk|list|junk)\z")
    why = F.array_compact(F.array(F.when(_has("list-unsubscribe"), F.lit("List-Unsubscribe")), F.when(_has("list-id"), F.lit("List-Id")), F.when(bulk, F.concat(F.lit("Precedence: "), precedence))))
    since = age_days(as_of, F.timestamp_millis("last_sent_ms"))
    email = F.col("from.email")
    return [
        Decisive("vip", F.col("is_vip"), F.concat(email, F.lit(" is on the list of important senders")), "now", 1.0),
        Decisive("muted", F.col("is_muted"), F.concat(email, F.lit(" is muted")), "noise", 1.0),
        Decisive("auto-submitted", (auto != "") & ~F.trim(auto).rlike(r"(?i)\Ano\z"), F.concat(F.lit("Auto-Submitted: "), auto), "noise", 0.95),
        Decisive("bulk", F.size(why) > 0, F.concat(F.lit("bulk mail headers present ("), F.array_join(why, ", "), F.lit(")")), "brief", 0.92),
        Decisive("impersonation", (auth == "fail") & ((sent > 0) | (got > 2)), F.concat(F.lit("fails sender authentication in the name of "), email), "later", 0.88),
        Decisive("thread-participant", F.coalesce(F.col("user_messages"), F.lit(0)) > 0, F.concat(F.lit("you wrote "), F.col("user_messages").cast("string"), F.lit(" message(s) in this thread")), "now", 0.93),
        Decisive("known-correspondent", (sent >= config.known_min_sent) & (F.col("last_sent_ms") > 0) & (auth != "fail") & (since <= config.known_max_age_days), F.concat(F.lit("you have written to them "), sent.cast("string"), F.lit(" time(s), last "), _days(since), F.lit(" day(s) ago")), "now", 0.9),
        Decisive("never-answered", (sent == 0) & (got >= config.never_answered_min), F.concat(got.cast("string"), F.lit(" messages received, none answered")), "brief", 0.85),
    ]


def weighted_rules(own: Sequence[str], as_of: Column) -> list[Weighted]:
    auth, sent, got, subject = F.col("auth"), F.col("sent_to"), F.col("received_from"), F.coalesce(F.col("subject"), F.lit(""))
    body = F.left(F.coalesce("bodyText", F.lit("")), F.lit(BODY_READ))
    both = F.concat(subject, F.lit("\n"), body)
    how, age = F.col("addressed"), age_days(as_of, F.col("date"))
    is_ = lambda *x: F.when(how.isin(*x), 1.0).otherwise(0.0)
    asks = F.contains(body, F.lit("?")) | F.contains(subject, F.lit("?"))
    direct = body.rlike(ASKS_YOU) | subject.rlike(r"\?\s*\z")
    hours = F.col("median_latency_ms") / 3_600_000.0
    lit = F.lit
    return [
        Weighted(F.concat(lit("addressing:"), how), lit(True), F.concat(lit("how you are addressed: "), how), {"now": is_("direct") * 1.5 + is_("group"), "later": is_("cc") * 1.5, "brief": is_("bcc") * 1.5}),
        Weighted(lit("known-domain"), (F.col("domain_sent_to") >= 5) & (auth != "fail"), F.concat(lit("you have written to "), F.col("from.domain"), lit(" "), F.col("domain_sent_to").cast("string"), lit(" time(s)")), {"now": 1.5}),
        Weighted(lit("failed-authentication"), (auth == "fail") & ~((sent > 0) | (got > 2)), lit("fails sender authentication"), {"brief": 2.0}),
        Weighted(lit("no-reply-sender"), local_part(F.col("from.email")).rlike(NO_REPLY), F.concat(lit("no replies to "), local_part(F.col("from.email"))), {"brief": 2.0}),
        Weighted(lit("marketing-language"), both.rlike(MARKETING), F.concat(lit("promotional phrasing: "), F.regexp_extract(both, MARKETING, 0)), {"brief": 1.5}),
        Weighted(lit("urgency-cue"), both.rlike(DEADLINE), F.concat(lit("time pressure: "), F.regexp_extract(both, DEADLINE, 0)), {"now": 1.5}),
        Weighted(F.when(direct, "direct-question").otherwise("question-mark"), asks, F.when(direct, "asks you a direct question").otherwise("contains a question"), {"now": F.when(direct, 1.5).otherwise(0.5)}),
        Weighted(lit("reply-subject"), subject.rlike(REPLY), lit("subject marks a reply"), {"now": 0.75}),
        Weighted(lit("forward-subject"), subject.rlike(FORWARD), lit("subject marks a forward"), {"later": 0.5}),
        Weighted(lit("fast-responder"), hours <= 8, F.concat(lit("you normally reply within "), F.format_number(hours + F.when(F.pmod(hours, lit(0.5)) == 0.25, 0.01).otherwise(0.0), 1), lit("h")), {"now": 1.0}),
        Weighted(lit("first-contact"), (sent == 0) & (got <= 1), lit("no earlier correspondence with this sender"), {"later": 1.0}),
        Weighted(F.when(age <= 1, "fresh").otherwise("stale"), (age <= 1) | (age >= 14), F.when(age <= 1, lit("arrived in the last day")).otherwise(F.concat(_days(age), lit(" days old"))), {"now": F.when(age <= 1, 0.5).otherwise(0.0), "later": F.when(age >= 14, 1.0).otherwise(0.0)}),
        Weighted(lit("has-attachment"), F.size("attachments") > 0, F.concat(lit("carries "), F.size("attachments").cast("string"), lit(" attachment(s)")), {"now": 0.5}),
        Weighted(lit("already-answered"), F.array_contains("flags", "\\Answered"), lit("you have already replied"), {"later": 2.0, "brief": 1.0}),
    ]


@contextmanager
def lenient(spark: SparkSession):
    """Expressions that are built inside give null where they would fail (a division by zero, a cast, an index)."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", False)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def classify(messages: DataFrame, own: Sequence[str], config: Config = Config(), as_of: Column | None = None, decisive: list[Decisive] | None = None, weighted: list[Weighted] | None = None) -> DataFrame:
    """Add label, confidence, tier, reasons, escalate and a score_<label> each.

    ``messages`` carry statistics (sent_to, received_from, last_sent_ms, median_latency_ms, is_vip,
    is_muted, domain_sent_to, user_messages). ``as_of`` is the moment of judgement; given one, the
    median latency says nothing, since it knows what came later. A rule whose input is null, or that fails on a
    message, doesn't fire there; the others are judged as if it weren't there.
    """
    with lenient(messages.sparkSession):
        return _classified(messages, own, config, as_of, decisive, weighted)


def _classified(messages: DataFrame, own: Sequence[str], config: Config, as_of: Column | None, decisive: list[Decisive] | None, weighted: list[Weighted] | None) -> DataFrame:
    if as_of is not None:
        messages = messages.withColumn("median_latency_ms", F.lit(None).cast("double"))
    moment = F.current_timestamp() if as_of is None else as_of
    base = messages.withColumns({"auth": authentication(F.col("headers")), "addressed": addressing(F.col("to"), F.col("cc"), own)})
    first = decisive_rules(config, moment) if decisive is None else decisive
    then = weighted_rules(own, moment) if weighted is None else weighted
    sure = lambda c: F.coalesce(c, F.lit(False))
    found = F.coalesce(*(F.when(sure(r.when), F.struct(F.lit(r.code).alias("code"), F.coalesce(r.detail, F.lit("")).alias("detail"), F.lit(r.label).alias("label"), F.lit(r.confidence).alias("confidence"))) for r in first))
    num = lambda w: w.cast("double") if isinstance(w, Column) else F.lit(float(w))
    weights = [F.struct(F.coalesce(r.code, F.lit("")).alias("code"), F.coalesce(r.detail, F.lit("")).alias("detail"), *(F.coalesce(num(r.weights.get(x, 0.0)), F.lit(0.0)).alias(x) for x in LABELS)) for r in then]
    base = base.withColumn("__sure", found)
    base = base.withColumn("__fired", F.when(F.col("__sure").isNull(), F.array_compact(F.array(*(F.when(sure(r.when), w) for r, w in zip(then, weights, strict=True))))))
    base = base.withColumns({f"score_{x}": _summed(x) for x in LABELS})
    # ties go to the earlier label: position counts against
    ranked = F.array_sort(F.array(*(F.struct((-F.col(f"score_{x}")).alias("s"), F.lit(i).alias("i"), F.lit(x).alias("label")) for i, x in enumerate(LABELS))))
    base = base.withColumn("__rank", ranked)
    top, second = -F.col("__rank")[0]["s"], -F.col("__rank")[1]["s"]
    margin = (top - second) / F.nullif(top + second, F.lit(0.0))
    confidence = F.when(F.col("__sure").isNotNull(), F.col("__sure.confidence")).when(top <= 0, 0.2).otherwise(F.least(F.lit(config.ceiling), F.round(0.4 + 0.5 * F.coalesce(margin, F.lit(0.0)), 3)))
    label = F.when(F.col("__sure").isNotNull(), F.col("__sure.label")).when(top <= 0, "later").otherwise(F.col("__rank")[0]["label"])
    none = F.array(F.struct(F.lit("no-signal").alias("code"), F.lit("no rule fired").alias("detail"), F.create_map().cast("map<string, double>").alias("weight"), F.lit(False).alias("decisive")))
    light = F.transform("__fired", lambda r: F.struct(r["code"].alias("code"), r["detail"].alias("detail"), F.map_filter(F.create_map(*(p for x in LABELS for p in (F.lit(x), r[x]))), lambda k, v: v != 0).alias("weight"), F.lit(False).alias("decisive")))
    heavy = F.array(F.struct(F.col("__sure.code").alias("code"), F.col("__sure.detail").alias("detail"), F.create_map().cast("map<string, double>").alias("weight"), F.lit(True).alias("decisive")))
    reasons = F.when(F.col("__sure").isNotNull(), heavy).when(top <= 0, none).otherwise(light)
    out = base.withColumns({"label": label, "confidence": confidence, "tier": F.lit(0), "reasons": reasons})
    escalate = F.col("__sure").isNull() & (F.col("confidence") < config.escalate_below)
    return out.withColumn("escalate", escalate).drop("__sure", "__fired", "__rank")


def escalation(decisions: DataFrame) -> DataFrame:
    """total, escalated, rate (0 of nothing)."""
    return decisions.agg(F.count("*").alias("total"), F.count_if("escalate").alias("escalated")).withColumn("rate", F.coalesce(F.try_divide(F.col("escalated").cast("double"), "total"), F.lit(0.0)))


def merge_model(decisions: DataFrame, answers: DataFrame) -> DataFrame:
    """Overwrite what a model answered (uid, label, confidence, rationale, seq); of several answers the last counts.

    Unknown labels become later; rows without an answer stay as they are.
    """
    last = answers.groupBy("uid").agg(F.max_by(F.struct("label", "confidence", "rationale"), "seq").alias("__m"))
    joined = decisions.join(last, "uid", "left")
    said = F.col("__m").isNotNull()
    label = F.when(F.col("__m.label").isin(*LABELS), F.col("__m.label")).otherwise("later")
    reason = F.struct(F.lit("model").alias("code"), F.coalesce(F.col("__m.rationale"), F.lit("")).alias("detail"), F.create_map().cast("map<string, double>").alias("weight"), F.lit(False).alias("decisive"))
    return joined.withColumns({
        "label": F.when(said, label).otherwise(F.col("label")),
        "confidence": F.when(said, F.col("__m.confidence")).otherwise(F.col("confidence")),
        "tier": F.when(said, 1).otherwise(F.col("tier")),
        "reasons": F.when(said, F.array_append("reasons", reason)).otherwise(F.col("reasons")),
        "escalate": ~said & F.col("escalate"),
    }).drop("__m")
