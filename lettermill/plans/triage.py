"""Queries: the cascade, the model's answers, backtests and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from lettermill.config import LABELS
from lettermill.operators.backtest import backtest, confusion_matrix, error_classes, ground_truth, per_label, projected_cost, summary, totals, usage_cost
from lettermill.operators.cascade import classify, escalation, merge_model
from lettermill.operators.correspondents import median_latency
from lettermill.operators.mailbox import usage_totals
from lettermill.operators.triage import brief, reason_rows, shown, triage, why
from lettermill.plans.adapters import MAIL_SQL, OWN, messages
from lettermill.plans.registry import query, table


def _as_of():
    return F.timestamp_seconds(F.lit(1_704_067_200 + 43_200 * 60))


#: Prices of a list kept by hand: dollars for a million tokens.
PRICES = [("base", 1.0, 5.0), ("base-2", 3.0, 15.0), ("base-2-mini", 0.5, 2.0), ("large", 10.0, 50.0)]

_B, _E = "(?:^|[^0-9A-Za-z_])", "(?:[^0-9A-Za-z_]|$)"
_HAY = "subject || chr(10) || body4"
_SCORES = f"""{MAIL_SQL},
 st AS (SELECT email AS e, count(*) FILTER (answered) AS sent_to, count(*) AS received_from, max(minutes) FILTER (answered) AS last_sent FROM mail GROUP BY 1),
 ds AS (SELECT domain AS d, count(*) FILTER (answered) AS domain_sent FROM mail GROUP BY 1),
 x AS (SELECT *, left(body, 4000) AS body4, (43200 - minutes) / 1440.0 AS age FROM mail JOIN st ON email = e JOIN ds ON domain = d),
 q AS (SELECT *, contains(body4, '?') OR contains(subject, '?') AS asks,
   regexp_matches(body4, '(?i){_B}(?:(?:can|could|would|will|do|did|are|is|should) you|what do you think){_E}') OR regexp_matches(subject, '\\?\\s*$') AS direct,
   auth = 'fail' AS failed FROM x),
 s AS (SELECT *,
   CASE addr WHEN 'direct' THEN 1.5 WHEN 'group' THEN 1.0 ELSE 0 END + CASE WHEN domain_sent >= 5 AND NOT failed THEN 1.5 ELSE 0 END
   + CASE WHEN regexp_matches({_HAY}, '(?i){_B}(?:by (?:eod|today|tomorrow|monday|tuesday|wednesday|thursday|friday)|urgent|asap|deadline|time[- ]sensitive|needs? (?:an )?answer|before the call){_E}') THEN 1.5 ELSE 0 END
   + CASE WHEN asks AND direct THEN 1.5 WHEN asks THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(subject, '^\\s*(?i:re|aw|antw|sv|vs)\\s*:') THEN 0.75 ELSE 0 END
   + CASE WHEN age <= 1 THEN 0.5 ELSE 0 END + CASE WHEN files > 0 THEN 0.5 ELSE 0 END AS s_now,
   CASE WHEN addr = 'cc' THEN 1.5 ELSE 0 END + CASE WHEN regexp_matches(subject, '^\\s*(?i:fwd?|wg)\\s*:') THEN 0.5 ELSE 0 END + CASE WHEN sent_to = 0 AND received_from <= 1 THEN 1 ELSE 0 END
   + CASE WHEN age >= 14 THEN 1 ELSE 0 END + CASE WHEN answered THEN 2 ELSE 0 END AS s_later,
   CASE WHEN addr = 'bcc' THEN 1.5 ELSE 0 END + CASE WHEN failed AND NOT (sent_to > 0 OR received_from > 2) THEN 2 ELSE 0 END + CASE WHEN email LIKE 'no-reply@%' THEN 2 ELSE 0 END
   + CASE WHEN regexp_matches({_HAY}, '(?i){_B}(?:unsubscribe|view (?:this )?in browser|limited time|webinar|free trial|act now|don''t miss){_E}') THEN 1.5 ELSE 0 END + CASE WHEN answered THEN 1 ELSE 0 END AS s_brief
   FROM q),
 c AS (SELECT *, CASE WHEN auto THEN 'auto-submitted' WHEN bulk THEN 'bulk' WHEN failed AND (sent_to > 0 OR received_from > 2) THEN 'impersonation'
   WHEN sent_to >= 3 AND NOT failed AND (43200 - last_sent) / 1440.0 <= 180 THEN 'known-correspondent' WHEN sent_to = 0 AND received_from >= 5 THEN 'never-answered' END AS code FROM s),
 r AS (SELECT *, greatest(s_now, s_later, s_brief) AS top, s_now + s_later + s_brief - greatest(s_now, s_later, s_brief) - least(s_now, s_later, s_brief) AS sec FROM c),
 dec AS (SELECT uid, answered, seen, flagged, minutes, age, thread, code,
   CASE code WHEN 'auto-submitted' THEN 'noise' WHEN 'bulk' THEN 'brief' WHEN 'impersonation' THEN 'later' WHEN 'known-correspondent' THEN 'now' WHEN 'never-answered' THEN 'brief'
     ELSE CASE WHEN top = s_now THEN 'now' WHEN top = s_later THEN 'later' ELSE 'brief' END END AS label,
   CAST(CASE code WHEN 'auto-submitted' THEN 0.95 WHEN 'bulk' THEN 0.92 WHEN 'impersonation' THEN 0.88 WHEN 'known-correspondent' THEN 0.9 WHEN 'never-answered' THEN 0.85
     ELSE least(0.9, round(0.4 + 0.5 * CAST((top - sec) AS DOUBLE) / CAST((top + sec) AS DOUBLE), 3)) END AS DOUBLE) AS confidence, s_now, s_later, s_brief FROM r)"""


def decisions(spark, sf_dir):
    """All messages judged at one moment; who was answered counts as written to."""
    return classify(_with_people(spark, sf_dir), OWN, as_of=_as_of())


def _with_people(spark, sf_dir):
    m = messages(spark, sf_dir)
    answered = F.array_contains("flags", "\\Answered")
    people = m.groupBy(F.col("from.email").alias("e")).agg(F.count_if(answered).alias("sent_to"), F.count("*").alias("received_from"), F.max(F.when(answered, F.unix_millis("date"))).alias("last_sent_ms"))
    domains = m.groupBy(F.col("from.domain").alias("d")).agg(F.count_if(answered).alias("domain_sent_to"))
    full = m.join(people, F.col("from.email") == F.col("e")).join(domains, F.col("from.domain") == F.col("d"))
    nothing = {"is_vip": F.lit(False), "is_muted": F.lit(False), "user_messages": F.lit(0), "median_latency_ms": F.lit(None).cast("double")}
    return full.withColumns(nothing)


_ESC = "code IS NULL AND confidence < 0.75"


@query(f"WITH {_SCORES} SELECT uid, CAST(s_now AS DOUBLE) AS score_now, CAST(s_later AS DOUBLE) AS score_later, CAST(s_brief AS DOUBLE) AS score_brief FROM dec WHERE code IS NULL")
def cascade_scores(spark, sf_dir):
    d = decisions(spark, sf_dir)
    return d.where("score_now is not null").select("uid", "score_now", "score_later", "score_brief")


@query(f"WITH {_SCORES} SELECT uid, label, confidence, coalesce(code, 'weighted') AS rule, {_ESC} AS escalate FROM dec")
def cascade_decisions(spark, sf_dir):
    d = decisions(spark, sf_dir)
    return d.select("uid", "label", "confidence", F.when(F.col("reasons")[0]["decisive"], F.col("reasons")[0]["code"]).otherwise("weighted").alias("rule"), "escalate")


@query(f"WITH {_SCORES} SELECT count(*) AS total, count(*) FILTER ({_ESC}) AS escalated, round(count(*) FILTER ({_ESC}) / count(*), 6) AS rate FROM dec")
def escalation_rate(spark, sf_dir):
    return escalation(decisions(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {_SCORES}, a AS (SELECT doc_id AS uid, CASE WHEN quality = 1 THEN 'brief' ELSE 'unheard-of' END AS m FROM labels)
 SELECT d.uid, CASE WHEN a.m IS NULL THEN label WHEN a.m = 'brief' THEN 'brief' ELSE 'later' END AS label, CASE WHEN a.m IS NULL THEN confidence ELSE CAST(0.5 AS DOUBLE) END AS confidence, CASE WHEN a.m IS NULL THEN 0 ELSE 1 END AS tier,
 a.m IS NULL AND {_ESC} AS escalate FROM dec d LEFT JOIN a ON a.uid = d.uid""")
def model_merge(spark, sf_dir):
    answer = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("uid"), F.when(F.col("quality") == 1, "brief").otherwise("unheard-of").alias("label"), F.lit(0.5).alias("confidence"), F.lit("").alias("rationale"), F.lit(1).alias("seq"))
    early = answer.withColumns({"seq": F.lit(0), "label": F.lit("noise")})
    return merge_model(decisions(spark, sf_dir), answer.unionByName(early)).select("uid", "label", "confidence", "tier", "escalate")


@query(f"""WITH {MAIL_SQL}, m AS (SELECT *, CASE WHEN uid % 3 = 0 THEN concat('once', uid) ELSE concat('p', uid % 50) END AS who FROM mail),
 st AS (SELECT who AS e, count(*) FILTER (answered) AS sent_to, count(*) AS received_from, floor(median(CASE WHEN answered THEN minutes % 1200 * 60000 END) + 0.5) / 3600000 AS hours FROM m GROUP BY 1),
 x AS (SELECT *, auth = 'fail' AS failed FROM m JOIN st ON who = e)
SELECT uid, CASE WHEN hours <= 8 THEN concat('you normally reply within ', printf('%.1f', hours + CASE WHEN hours % 0.5 = 0.25 THEN 0.01 ELSE 0 END), 'h') END AS fast, sent_to = 0 AND received_from <= 1 AS first_contact, failed AND NOT (sent_to > 0 OR received_from > 2) AS failed_authentication
FROM x WHERE NOT auto AND NOT bulk AND NOT (failed AND (sent_to > 0 OR received_from > 2)) AND NOT (sent_to = 0 AND received_from >= 5)""")
def rules_of_people(spark, sf_dir):
    """Where the rules for fast replies, first contacts and failed authentication fire, judged now: senders write once or often, and are answered within hours."""
    who = F.when(F.col("uid") % 3 == 0, F.concat(F.lit("once"), F.col("uid").cast("string"))).otherwise(F.concat(F.lit("p"), (F.col("uid") % 50).cast("string")))
    m = messages(spark, sf_dir).withColumn("from", F.struct(F.lit("").alias("name"), who.alias("email"), F.lit("x.example").alias("domain")))
    answered = F.array_contains("flags", "\\Answered")
    people = m.groupBy(F.col("from.email").alias("e")).agg(F.count_if(answered).alias("sent_to"), F.count("*").alias("received_from"), F.max(F.when(answered, F.unix_millis("date"))).alias("last_sent_ms"))
    waits = m.where(answered).select(F.col("from.email").alias("email"), (F.pmod(F.col("uid") * 7, F.lit(43200)) % 1200 * 60_000).alias("latency_ms"))
    # what is known of people is put together first: texts are shuffled once
    people = people.join(median_latency(waits).withColumnRenamed("email", "w"), F.col("e") == F.col("w"), "left").drop("w")
    known = m.join(people, F.col("from.email") == F.col("e"))
    known = known.withColumns({"is_vip": F.lit(False), "is_muted": F.lit(False), "user_messages": F.lit(0), "domain_sent_to": F.lit(0), "median_latency_ms": F.col("median_latency_ms").cast("double")})
    d = classify(known, OWN)
    code = lambda c: F.filter("reasons", lambda r: r["code"] == c)
    # a generated column: else the filter would judge all rules once more
    d = d.select("uid", F.explode(F.array("reasons")).alias("reasons"))
    return d.where("not reasons[0].decisive").select("uid", F.get(code("fast-responder"), F.lit(0))["detail"].alias("fast"), (F.size(code("first-contact")) > 0).alias("first_contact"), (F.size(code("failed-authentication")) > 0).alias("failed_authentication"))


_TRUTH = f"""{_SCORES}, rt AS (SELECT DISTINCT thread AS t FROM mail WHERE answered AND uid % 5 = 0),
 sc AS (SELECT uid, label AS predicted, {_ESC} AS escalated, CASE WHEN answered OR t IS NOT NULL OR flagged THEN 'now' WHEN seen AND age >= 3 THEN 'later' WHEN NOT seen AND age >= 7 THEN 'brief' END AS actual FROM dec LEFT JOIN rt ON t = thread)"""


def scored(spark, sf_dir):
    """Decisions against what became of the messages."""
    d = decisions(spark, sf_dir)
    replied = d.where(F.array_contains("flags", "\\Answered") & (F.col("uid") % 5 == 0)).select("threadId").distinct().withColumn("replied", F.lit(True))
    d = d.join(replied, "threadId", "left")
    age = (F.unix_seconds(_as_of()) - F.unix_seconds("date")) / 86400.0
    truth = ground_truth(F.col("flags"), F.coalesce("replied", F.lit(False)), age)
    return d.select("uid", F.col("label").alias("predicted"), F.col("escalate").alias("escalated"), truth.alias("actual")).withColumns({"settled": F.col("actual").isNotNull(), "agree": F.col("predicted") == F.col("actual")})


@query(f"WITH {_TRUTH} SELECT uid, actual FROM sc")
def ground_truth_query(spark, sf_dir):
    return scored(spark, sf_dir).select("uid", "actual")


@query(f"WITH {_TRUTH}, l(x) AS (VALUES ('now'), ('later'), ('brief'), ('noise')) SELECT a.x AS actual, p.x AS predicted, (SELECT count(*) FROM sc WHERE sc.actual = a.x AND sc.predicted = p.x) AS n FROM l a, l p")
def confusion_matrix_query(spark, sf_dir):
    return confusion_matrix(scored(spark, sf_dir))


@query(f"""WITH {_TRUTH}, l(x) AS (VALUES ('now'), ('later'), ('brief'), ('noise')),
 k AS (SELECT x AS label, (SELECT count(*) FROM sc WHERE actual IS NOT NULL AND predicted = x) AS predicted, (SELECT count(*) FROM sc WHERE actual = x) AS actual, (SELECT count(*) FROM sc WHERE actual = x AND predicted = x) AS correct FROM l)
 SELECT *, round(correct / nullif(predicted, 0), 6) AS "precision", round(correct / nullif(actual, 0), 6) AS recall FROM k""")
def per_label_metrics(spark, sf_dir):
    return per_label(scored(spark, sf_dir)).withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query(f"""WITH {_TRUTH} SELECT uid, CASE WHEN actual = 'now' THEN 'buried' ELSE 'cluttered' END AS error FROM sc
 WHERE (actual = 'now' AND predicted IN ('brief', 'noise')) OR (actual IN ('brief', 'noise') AND predicted = 'now')""")
def error_classes_query(spark, sf_dir):
    return error_classes(scored(spark, sf_dir)).select("uid", "error")


@query(f"""WITH {_TRUTH} SELECT count(actual) AS total, count(*) - count(actual) AS skipped, count(*) FILTER (actual = predicted) AS agreed, count(*) FILTER (actual IS NOT NULL AND escalated) AS escalated,
 round(count(*) FILTER (actual = predicted) / count(actual), 6) AS agreement_rate, round(count(*) FILTER (actual IS NOT NULL AND escalated) / count(actual), 6) AS escalation_rate FROM sc""")
def backtest_totals(spark, sf_dir):
    return totals(scored(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("agreement_rate", "escalation_rate")})


@query(f"""WITH {_SCORES}, n AS (SELECT count(*) AS total, count(*) FILTER ({_ESC}) AS escalated FROM dec), k AS (SELECT *, CAST(ceil(escalated / 10.0) AS BIGINT) AS batches FROM n)
 SELECT total, escalated, batches, escalated * 560 + batches * 400 AS input_tokens, escalated * 40 AS output_tokens,
 round(((escalated * 560 + batches * 400) * 3.0 + escalated * 40 * 15.0) / 1e6, 6) AS usd_window, round(((escalated * 560 + batches * 400) * 3.0 + escalated * 40 * 15.0) / 1e6 / 7 * 30, 6) AS usd_month FROM k""")
def projected_cost_query(spark, sf_dir):
    counts = escalation(decisions(spark, sf_dir)).drop("rate")
    prices = spark.createDataFrame(PRICES, "model string, input double, output double")
    return projected_cost(counts, prices, "unlisted", "base-2").withColumns({c: F.round(c, 6) for c in ("usd_window", "usd_month")})


@query("""WITH p(prefix, i, o) AS (VALUES ('base', 1.0, 5.0), ('base-2', 3.0, 15.0), ('base-2-mini', 0.5, 2.0), ('large', 10.0, 50.0)),
 u AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'base-1' WHEN 1 THEN 'base-2-x' WHEN 2 THEN 'base-2-mini-3' WHEN 3 THEN 'large' ELSE 'other' END AS model, o_custkey AS a, o_orderkey % 1000 AS b FROM orders),
 j AS (SELECT u.*, i, o, row_number() OVER (PARTITION BY o_orderkey ORDER BY length(prefix) DESC NULLS LAST) AS k FROM u LEFT JOIN p ON starts_with(model, prefix))
 SELECT o_orderkey, model, round(CAST(coalesce((a * i + b * o + 100 * i * 0.1 + 10 * i * 1.25) / 1e6, 0) AS DOUBLE), 9) AS usd FROM j WHERE k = 1""")
def price_prefix_join(spark, sf_dir):
    return _costs(spark, sf_dir).select("o_orderkey", "model", F.round("usd", 9).alias("usd"))


def _costs(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    model = F.when(k == 0, "base-1").when(k == 1, "base-2-x").when(k == 2, "base-2-mini-3").when(k == 3, "large").otherwise("other")
    usage = table(spark, sf_dir, "orders").select("o_orderkey", model.alias("model"), F.col("o_custkey").alias("input_tokens"), (F.col("o_orderkey") % 1000).alias("output_tokens"), F.lit(100).alias("cache_read"), F.lit(10).alias("cache_write"))
    return usage_cost(usage, spark.createDataFrame(PRICES, "model string, input double, output double"))


@query("""WITH p(prefix, i, o) AS (VALUES ('base', 1.0, 5.0), ('base-2', 3.0, 15.0), ('base-2-mini', 0.5, 2.0), ('large', 10.0, 50.0)),
 u AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'base-1' WHEN 1 THEN 'base-2-x' WHEN 2 THEN 'base-2-mini-3' WHEN 3 THEN 'large' ELSE 'other' END AS model, o_custkey AS a, o_orderkey % 1000 AS b FROM orders),
 j AS (SELECT u.*, i, o, row_number() OVER (PARTITION BY o_orderkey ORDER BY length(prefix) DESC NULLS LAST) AS k FROM u LEFT JOIN p ON starts_with(model, prefix))
 SELECT model, CAST(sum(a) AS BIGINT) AS input, CAST(sum(b) AS BIGINT) AS output, count(*) AS calls, round(CAST(sum(coalesce((a * i + b * o + 100 * i * 0.1 + 10 * i * 1.25) / 1e6, 0)) AS DOUBLE), 6) AS usd FROM j WHERE k = 1 GROUP BY 1""")
def usage_cost_totals(spark, sf_dir):
    return usage_totals(_costs(spark, sf_dir)).withColumn("usd", F.round("usd", 6))


#: The same judged by headers alone: no body was fetched.
_HEADERS_ONLY = _SCORES.replace("left(body, 4000) AS body4", "'' AS body4")


def _by_first_letter(items):
    """A provider whose answer depends on the body that was fetched."""
    return [{"id": x["id"], "label": "now" if x["preview"][:1].lower() < "m" else "brief", "confidence": 0.88, "rationale": "first letter"} for x in items]


@query(f"""WITH {_HEADERS_ONLY} SELECT uid, CASE WHEN NOT ({_ESC}) THEN label WHEN lower(left(trim(body), 1)) < 'm' THEN 'now' ELSE 'brief' END AS label, CASE WHEN {_ESC} THEN CAST(0.88 AS DOUBLE) ELSE confidence END AS confidence, CASE WHEN {_ESC} THEN 1 ELSE 0 END AS tier, false AS escalate
 FROM dec JOIN (SELECT uid AS u, body FROM mail) ON u = uid""")
def triage_run(spark, sf_dir):
    """Messages of which only headers were fetched; the bodies of those that stay unsure come from another table."""
    full = _with_people(spark, sf_dir)
    bodies = full.select("uid", "bodyText", "attachments")
    return triage(full.withColumn("bodyText", F.lit("")), OWN, _as_of(), _by_first_letter, bodies).decisions.select("uid", "label", "confidence", "tier", "escalate")


@query(f"""WITH {_SCORES}, d AS (SELECT dec.uid, label, row_number() OVER (PARTITION BY label ORDER BY dec.uid) AS place, count(*) OVER (PARTITION BY label) AS n, subject FROM dec JOIN (SELECT uid AS u, subject FROM mail) ON u = dec.uid)
 SELECT uid, label, CAST(place AS INT) AS place, substring(subject, 1, 52) AS subject, greatest(n - 20, 0) AS beyond FROM d WHERE place <= 20""")
def triage_shown(spark, sf_dir):
    return shown(decisions(spark, sf_dir)).select("uid", "label", "place", "subject", "beyond")


@query(f"""WITH {_SCORES}, d AS (SELECT email AS sender, uid, subject, row_number() OVER (PARTITION BY email ORDER BY uid) AS k FROM dec JOIN (SELECT uid AS u, email, subject FROM mail) ON u = uid WHERE label = 'brief')
 SELECT sender, min(uid) AS first_seq, count(*) AS n, string_agg(subject, '|' ORDER BY uid) FILTER (k <= 5) AS subjects, greatest(count(*) - 5, 0) AS more FROM d GROUP BY 1""")
def brief_by_sender(spark, sf_dir):
    return brief(decisions(spark, sf_dir)).withColumn("subjects", F.array_join("subjects", "|"))


@query(f"""WITH {_SCORES} SELECT uid, concat_ws(',', concat('addressing:', addr), CASE WHEN domain_sent >= 5 AND NOT failed THEN 'known-domain' END, CASE WHEN failed AND NOT (sent_to > 0 OR received_from > 2) THEN 'failed-authentication' END,
 CASE WHEN email LIKE 'no-reply@%' THEN 'no-reply-sender' END, CASE WHEN regexp_matches({_HAY}, '(?i){_B}(?:unsubscribe|view (?:this )?in browser|limited time|webinar|free trial|act now|don''t miss){_E}') THEN 'marketing-language' END,
 CASE WHEN regexp_matches({_HAY}, '(?i){_B}(?:by (?:eod|today|tomorrow|monday|tuesday|wednesday|thursday|friday)|urgent|asap|deadline|time[- ]sensitive|needs? (?:an )?answer|before the call){_E}') THEN 'urgency-cue' END,
 CASE WHEN asks AND direct THEN 'direct-question' WHEN asks THEN 'question-mark' END, CASE WHEN regexp_matches(subject, '^\\s*(?i:re|aw|antw|sv|vs)\\s*:') THEN 'reply-subject' END, CASE WHEN regexp_matches(subject, '^\\s*(?i:fwd?|wg)\\s*:') THEN 'forward-subject' END,
 CASE WHEN sent_to = 0 AND received_from <= 1 THEN 'first-contact' END, CASE WHEN age <= 1 THEN 'fresh' WHEN age >= 14 THEN 'stale' END, CASE WHEN files > 0 THEN 'has-attachment' END, CASE WHEN answered THEN 'already-answered' END) AS codes,
 CAST(s_now AS DOUBLE) AS weight_now, CAST(s_later AS DOUBLE) AS weight_later, CAST(s_brief AS DOUBLE) AS weight_brief FROM r WHERE code IS NULL""")
def reasons_of_all(spark, sf_dir):
    """Why each message that no single rule decides got its scores: the rules that fired, in order, and what they add up to."""
    d = decisions(spark, sf_dir).where("not reasons[0].decisive")
    total = lambda x: F.aggregate("reasons", F.lit(0.0), lambda s, r: s + F.coalesce(r["weight"][x], F.lit(0.0))).alias(f"weight_{x}")
    return d.select("uid", F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("codes"), total("now"), total("later"), total("brief"))


def _reason(when: str, code: str, detail: str, now: str = "0", later: str = "0", brief: str = "0", decisive: bool = False) -> str:
    weights = ", ".join(f"'{name}': CAST({w} AS DOUBLE)" for name, w in (("now", now), ("later", later), ("brief", brief)))
    return f"CASE WHEN {when} THEN {{'code': {code}, 'detail': {detail}, 'decisive': {str(decisive).lower()}, {weights}}} END"


def _sure(code: str, detail: str) -> str:
    return _reason(f"code = '{code}'", "code", detail, decisive=True)


def _light(when: str, code: str, detail: str, **weights: str) -> str:
    return _reason(f"code IS NULL AND ({when})", code, detail, **weights)


_MARKET, _PRESS = (f"(?i){_B}({words}){_E}" for words in ("unsubscribe|view (?:this )?in browser|limited time|webinar|free trial|act now|don''t miss", "by (?:eod|today|tomorrow|monday|tuesday|wednesday|thursday|friday)|urgent|asap|deadline|time[- ]sensitive|needs? (?:an )?answer|before the call"))
_DAYS = "CAST(floor({} + 0.5) AS BIGINT)"
#: What each rule says, in the order of the rules.
_SAID = ",\n  ".join((
    _sure("auto-submitted", "'Auto-Submitted: auto-replied'"),
    _sure("bulk", "'bulk mail headers present (List-Id)'"),
    _sure("impersonation", "concat('fails sender authentication in the name of ', email)"),
    _sure("known-correspondent", f"concat('you have written to them ', sent_to, ' time(s), last ', {_DAYS.format('(43200 - last_sent) / 1440.0')}, ' day(s) ago')"),
    _sure("never-answered", "concat(received_from, ' messages received, none answered')"),
    _light("true", "concat('addressing:', addr)", "concat('how you are addressed: ', addr)", now="CASE addr WHEN 'direct' THEN 1.5 WHEN 'group' THEN 1 ELSE 0 END", later="CASE addr WHEN 'cc' THEN 1.5 ELSE 0 END", brief="CASE addr WHEN 'bcc' THEN 1.5 ELSE 0 END"),
    _light("domain_sent >= 5 AND NOT failed", "'known-domain'", "concat('you have written to ', domain, ' ', domain_sent, ' time(s)')", now="1.5"),
    _light("failed AND NOT (sent_to > 0 OR received_from > 2)", "'failed-authentication'", "'fails sender authentication'", brief="2"),
    _light("email LIKE 'no-reply@%'", "'no-reply-sender'", "'no replies to no-reply'", brief="2"),
    _light(f"regexp_matches({_HAY}, '{_MARKET}')", "'marketing-language'", f"concat('promotional phrasing: ', regexp_extract({_HAY}, '{_MARKET}', 1))", brief="1.5"),
    _light(f"regexp_matches({_HAY}, '{_PRESS}')", "'urgency-cue'", f"concat('time pressure: ', regexp_extract({_HAY}, '{_PRESS}', 1))", now="1.5"),
    _light("asks", "CASE WHEN direct THEN 'direct-question' ELSE 'question-mark' END", "CASE WHEN direct THEN 'asks you a direct question' ELSE 'contains a question' END", now="CASE WHEN direct THEN 1.5 ELSE 0.5 END"),
    _light("regexp_matches(subject, '^\\s*(?i:re|aw|antw|sv|vs)\\s*:')", "'reply-subject'", "'subject marks a reply'", now="0.75"),
    _light("regexp_matches(subject, '^\\s*(?i:fwd?|wg)\\s*:')", "'forward-subject'", "'subject marks a forward'", later="0.5"),
    _light("sent_to = 0 AND received_from <= 1", "'first-contact'", "'no earlier correspondence with this sender'", later="1"),
    _light("age <= 1 OR age >= 14", "CASE WHEN age <= 1 THEN 'fresh' ELSE 'stale' END", f"CASE WHEN age <= 1 THEN 'arrived in the last day' ELSE concat({_DAYS.format('age')}, ' days old') END", now="CASE WHEN age <= 1 THEN 0.5 ELSE 0 END", later="CASE WHEN age >= 14 THEN 1 ELSE 0 END"),
    _light("files > 0", "'has-attachment'", "concat('carries ', files, ' attachment(s)')", now="0.5"),
    _light("answered", "'already-answered'", "'you have already replied'", later="2", brief="1"),
))
_WHY = f"""{_SCORES}, told AS (SELECT r.uid AS u, [x FOR x IN [{_SAID}] IF x IS NOT NULL] AS reasons FROM r),
 why AS (SELECT dec.uid, label, confidence, reasons FROM dec JOIN told ON u = dec.uid)"""
_WHY_ROWS = f"""WITH {_WHY}, flat AS (SELECT uid, label, confidence, generate_subscripts(reasons, 1) - 1 AS position, unnest(reasons) AS r FROM why)
SELECT uid, label, confidence, CAST(0 AS INT) AS tier, CAST(position AS INT) AS position, r.code AS code, r.detail AS detail, r.decisive AS decisive, r.now AS weight_now, r.later AS weight_later, r.brief AS weight_brief, CAST(0 AS DOUBLE) AS weight_noise FROM flat"""


@query(_WHY_ROWS)
def reasons_in_rows(spark, sf_dir):
    """Every reason of every message, with what the rule found and its weights."""
    return reason_rows(decisions(spark, sf_dir))


def _spoken(spark, sf_dir):
    """The message asked about: the first on which most rules speak."""
    d = decisions(spark, sf_dir).select("uid", F.size("reasons").alias("n"))
    return d.agg(F.max(F.struct("n", (-F.col("uid")).alias("u")))).first()[0]


@query(f"{_WHY_ROWS} WHERE uid = (SELECT uid FROM why ORDER BY len(reasons) DESC, uid LIMIT 1)", name="why")
def why_query(spark, sf_dir):
    """Reasons of one message: the first of those that most rules speak on."""
    found = _spoken(spark, sf_dir)
    return why(decisions(spark, sf_dir), -1 if found is None else -found.u)


#: Statistics as of each message's own date, of the last 500 events of an address and direction; answers are sent half an hour after the message.
_THEN = f"""{MAIL_SQL},
 ev AS (SELECT email AS e, domain AS d, 'received' AS dir, minutes AS m, uid AS s FROM mail UNION ALL SELECT email, domain, 'sent', minutes + 30, uid FROM mail WHERE answered),
 kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY e, dir ORDER BY s DESC) AS k FROM ev) WHERE k <= 500),
 st AS (SELECT uid AS u1, count(*) FILTER (dir = 'sent') AS sent_to, count(*) FILTER (dir = 'received') AS received_from, max(m) FILTER (dir = 'sent') AS last_sent FROM mail LEFT JOIN kept ON e = email AND m < minutes GROUP BY 1),
 ds AS (SELECT uid AS u2, count(*) FILTER (dir = 'sent') AS domain_sent FROM mail LEFT JOIN kept ON d = domain AND m < minutes GROUP BY 1),
 th AS (SELECT a.uid AS u3, count(b.uid) AS user_messages FROM mail a LEFT JOIN mail b ON b.thread = a.thread AND b.answered AND b.uid % 5 = 0 AND b.minutes + 30 < a.minutes GROUP BY 1),
 x AS (SELECT *, left(body, 4000) AS body4, 0.0 AS age FROM mail JOIN st ON u1 = uid JOIN ds ON u2 = uid JOIN th ON u3 = uid),
 """ + _SCORES[_SCORES.index("q AS (") :].replace("43200 - last_sent", "minutes - last_sent").replace("WHEN sent_to >= 3", "WHEN user_messages > 0 THEN 'thread-participant' WHEN sent_to >= 3").replace(
    "WHEN 'known-correspondent' THEN 'now'", "WHEN 'thread-participant' THEN 'now' WHEN 'known-correspondent' THEN 'now'").replace("WHEN 'known-correspondent' THEN 0.9", "WHEN 'thread-participant' THEN 0.93 WHEN 'known-correspondent' THEN 0.9")
_REPLAY = f"""{_THEN}, rt AS (SELECT DISTINCT thread AS t FROM mail WHERE answered AND uid % 5 = 0),
 old AS (SELECT *, (43200 - minutes) / 1440.0 AS days FROM dec LEFT JOIN rt ON t = thread),
 rp AS (SELECT uid, label AS predicted, CASE WHEN answered OR t IS NOT NULL OR flagged THEN 'now' WHEN seen AND days >= 3 THEN 'later' WHEN NOT seen AND days >= 7 THEN 'brief' END AS actual, confidence, {_ESC} AS escalated FROM old),
 ev1 AS (SELECT uid AS u, left(subject, 80) AS subject, email, CASE code WHEN 'auto-submitted' THEN 'Auto-Submitted: auto-replied' WHEN 'bulk' THEN 'bulk mail headers present (List-Id)' WHEN 'impersonation' THEN concat('fails sender authentication in the name of ', email)
   WHEN 'thread-participant' THEN concat('you wrote ', user_messages, ' message(s) in this thread') WHEN 'known-correspondent' THEN concat('you have written to them ', sent_to, ' time(s), last ', {_DAYS.format('(minutes - last_sent) / 1440.0')}, ' day(s) ago')
   WHEN 'never-answered' THEN concat(received_from, ' messages received, none answered') ELSE concat('how you are addressed: ', addr) END AS evidence FROM r)"""


def replayed(spark, sf_dir):
    """The backtest of all mail: what is answered was sent half an hour later, one in five of these in the thread."""
    got = messages(spark, sf_dir)
    sent = got.where(F.array_contains("flags", "\\Answered")).select("uid", F.array("from").alias("to"), F.array_except(F.array("from"), F.array("from")).alias("cc"), (F.col("date") + F.expr("INTERVAL 30 MINUTES")).alias("date"), F.when(F.col("uid") % 5 == 0, F.col("threadId")).otherwise("").alias("threadId"), "seq")
    return backtest(got, sent, OWN, _as_of())


@query(f"WITH {_REPLAY} SELECT uid, subject, email, predicted, actual, evidence, confidence, escalated, actual IS NOT NULL AS settled, predicted = actual AS agree FROM rp JOIN ev1 ON u = uid")
def backtest_rows(spark, sf_dir):
    """Each message judged by what was known before its own date, against what became of it."""
    return replayed(spark, sf_dir).drop("date")


_PAIR = "count(*) FILTER (WHERE rp.actual = '{}' AND rp.predicted = '{}')"
_SHARE = "round(CAST({} AS DOUBLE) / nullif({}, 0), 6)"


def _measures(x: str) -> str:
    said, true, right = f"count(*) FILTER (WHERE rp.actual IS NOT NULL AND rp.predicted = '{x}')", f"count(*) FILTER (WHERE rp.actual = '{x}')", _PAIR.format(x, x)
    return f"{{'label': '{x}', 'predicted': {said}, 'actual': {true}, 'correct': {right}, 'precision': {_SHARE.format(right, said)}, 'recall': {_SHARE.format(right, true)}}}"


_MATRIX = ", ".join("{" + f"'actual': '{a}', " + ", ".join(f"'{p}': {_PAIR.format(a, p)}" for p in LABELS) + "}" for a in LABELS)


@query(f"""WITH {_REPLAY} SELECT CAST(to_json({{'total': count(rp.actual), 'skipped': count(*) - count(rp.actual), 'agreed': count(*) FILTER (WHERE rp.actual = rp.predicted), 'escalated': count(*) FILTER (WHERE rp.actual IS NOT NULL AND escalated),
 'agreementRate': coalesce({_SHARE.format("count(*) FILTER (WHERE rp.actual = rp.predicted)", "count(rp.actual)")}, 0.0::DOUBLE), 'escalationRate': coalesce({_SHARE.format("count(*) FILTER (WHERE rp.actual IS NOT NULL AND escalated)", "count(rp.actual)")}, 0.0::DOUBLE),
 'labels': [{", ".join(_measures(x) for x in LABELS)}], 'matrix': [{_MATRIX}]}}) AS VARCHAR) AS json FROM rp""")
def backtest_summary(spark, sf_dir):
    """What the backtest of all mail adds up to, as one JSON text without its rows."""
    return summary(replayed(spark, sf_dir))
