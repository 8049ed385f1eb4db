"""Replay of past decisions: ground truth from behaviour, agreement, errors, projected cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.config import LABELS, Config
from lettermill.functions.numbers import age_days
from lettermill.operators.asof import running_before
from lettermill.operators.cascade import classify
from lettermill.operators.correspondents import capped, edges


def ground_truth(flags: Column, replied: Column, age: Column) -> Column:
    """What became of a message; null while that is open."""
    has = lambda f: F.array_contains(flags, f)
    return F.when(has("\\Answered") | replied | has("\\Flagged"), "now").when(has("\\Seen") & (age >= 3), "later").when(~has("\\Seen") & (age >= 7), "brief")


def as_of_own_date(messages: DataFrame, received: DataFrame, sent: DataFrame, cap: int = 500) -> DataFrame:
    """Statistics of each message's sender, domain and thread strictly before the message's own date."""
    graph = capped(edges(received, sent), cap).withColumns({"is_sent": F.col("direction") == "sent", "is_received": F.col("direction") == "received", "ms": F.col("ts_ms")})
    rows = messages.withColumns({"email": F.lower("from.email"), "ms": F.unix_millis("date"), "domain": F.col("from.domain")})
    width = 86_400_000
    people = running_before(graph, rows.select("email", "ms", "uid"), ["email"], "ms", {"sent_to": "is_sent", "received_from": "is_received"}, {"last_sent_ms": "is_sent"}, width)
    domains = running_before(graph, rows.select("domain", "ms", "uid"), ["domain"], "ms", {"domain_sent_to": "is_sent"}, width=width)
    wrote = sent.where("threadId <> ''").select("threadId", F.unix_millis("date").alias("ms"), F.lit(True).alias("wrote"))
    threads = running_before(wrote, rows.select("threadId", "ms", "uid"), ["threadId"], "ms", {"user_messages": "wrote"}, width=width)
    return rows.drop("ms", "email", "domain").join(people.drop("ms", "email"), "uid", "left").join(domains.drop("ms", "domain"), "uid", "left").join(threads.drop("ms", "threadId"), "uid", "left")


def backtest(received: DataFrame, sent: DataFrame, own: Sequence[str], as_of: Column, rules: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """Each settled message with predicted and actual label; ``settled`` is false (actual null) for open ones.

    Predictions know only what was before the message; the outcome may be later. uid is unique.
    """
    stats = as_of_own_date(received, received, sent, config.history_cap)
    if rules is None:
        stats = stats.withColumns({"is_vip": F.lit(False), "is_muted": F.lit(False)})
    else:
        marks = rules.groupBy(F.lower("email").alias("__who")).agg(F.bool_or("is_vip").alias("is_vip"), F.bool_or("is_muted").alias("is_muted"))
        stats = stats.join(marks, F.lower("from.email") == F.col("__who"), "left").drop("__who")
    stats = stats.withColumn("median_latency_ms", F.lit(None).cast("double"))
    judged = classify(stats, own, config, F.col("date"))
    replied = sent.where("threadId <> ''").select("threadId").distinct().withColumn("__replied", F.lit(True))
    judged = judged.join(replied, "threadId", "left")
    truth = ground_truth(F.col("flags"), F.coalesce("__replied", F.lit(False)), age_days(as_of, F.col("date")))
    return judged.select("uid", F.substring("subject", 1, 80).alias("subject"), F.col("from.email").alias("email"), "date", F.col("label").alias("predicted"), truth.alias("actual"), F.col("reasons")[0]["detail"].alias("evidence"), "confidence", F.col("escalate").alias("escalated")).withColumns({"settled": F.col("actual").isNotNull(), "agree": F.col("predicted") == F.col("actual")})


def totals(scored: DataFrame) -> DataFrame:
    r = scored.agg(F.count_if("settled").alias("total"), F.count_if(~F.col("settled")).alias("skipped"), F.count_if(F.col("settled") & F.col("agree")).alias("agreed"), F.count_if(F.col("settled") & F.col("escalated")).alias("escalated"))
    rate = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), "total"), F.lit(0.0))
    return r.withColumns({"agreement_rate": rate("agreed"), "escalation_rate": rate("escalated")})


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """(actual, predicted, n) for all pairs of labels, 0 where there is none."""
    spark = scored.sparkSession
    pairs = spark.createDataFrame([(a, p) for a in LABELS for p in LABELS], "actual string, predicted string")
    counts = scored.where("actual is not null").groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    return pairs.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def per_label(scored: DataFrame) -> DataFrame:
    """predicted, actual, correct, precision and recall of each label; null where nothing was predicted or true. One pass."""
    n = F.count_if
    row = scored.where("actual is not null").agg(*(n(F.col(c) == x).alias(f"{c}_{x}") for c in ("predicted", "actual") for x in LABELS), *(n((F.col("predicted") == x) & (F.col("actual") == x)).alias(f"correct_{x}") for x in LABELS))
    each = row.select(F.explode(F.array(*(F.struct(F.lit(x).alias("label"), *(F.col(f"{c}_{x}").alias(c) for c in ("predicted", "actual", "correct"))) for x in LABELS))).alias("r")).select("r.*")
    return each.withColumns({"precision": F.try_divide(F.col("correct").cast("double"), "predicted"), "recall": F.try_divide(F.col("correct").cast("double"), "actual")})


def summary(scored: DataFrame) -> DataFrame:
    """(json): one row with totals, rates, each label's measures and the matrix, without the scored rows. One pass; measures of nothing are null."""
    n, double = F.count_if, lambda c: c.cast("double")
    settled, pairs = F.col("actual").isNotNull(), [(a, p) for a in LABELS for p in LABELS]
    row = scored.agg(n(settled).alias("total"), n(~settled).alias("skipped"), n(settled & F.col("escalated")).alias("escalated"), *(n((F.col("actual") == a) & (F.col("predicted") == p)).alias(f"{a}_{p}") for a, p in pairs))
    add = lambda names: sum((F.col(x) for x in names), F.lit(0)).cast("long")
    row = row.withColumn("agreed", add(f"{x}_{x}" for x in LABELS))
    share = lambda part, whole: F.round(F.try_divide(double(part), whole), 6)

    def of(label: str) -> Column:
        said, true, right = add(f"{a}_{label}" for a in LABELS), add(f"{label}_{p}" for p in LABELS), F.col(f"{label}_{label}")
        return F.struct(F.lit(label).alias("label"), said.alias("predicted"), true.alias("actual"), right.alias("correct"), share(right, said).alias("precision"), share(right, true).alias("recall"))

    rates = [F.coalesce(share(F.col(c), F.col("total")), F.lit(0.0)).alias(f"{name}Rate") for c, name in (("agreed", "agreement"), ("escalated", "escalation"))]
    matrix = F.array(*(F.struct(F.lit(a).alias("actual"), *(F.col(f"{a}_{p}").alias(p) for p in LABELS)) for a in LABELS))
    return row.select(F.to_json(F.struct("total", "skipped", "agreed", "escalated", *rates, F.array(*(of(x) for x in LABELS)).alias("labels"), matrix.alias("matrix")), {"ignoreNullFields": "false"}).alias("json"))


def error_classes(scored: DataFrame) -> DataFrame:
    """buried: should have been now and was put away; cluttered: the other way round."""
    away = lambda c: F.col(c).isin("brief", "noise")
    kind = F.when((F.col("actual") == "now") & away("predicted"), "buried").when(away("actual") & (F.col("predicted") == "now"), "cluttered")
    return scored.withColumn("error", kind).where("error is not null")


def projected_cost(counts: DataFrame, prices: DataFrame, model: str, default: str, config: Config = Config()) -> DataFrame:
    """Tokens and cost of a window of ``escalated`` messages, and of a month; one row for each row of counts (total, escalated).

    ``prices`` (model, input, output; dollars for a million tokens) is a list kept by hand.
    """
    price = prices.where(F.col("model").isin(model, default)).orderBy((F.col("model") != model)).limit(1).select("input", "output")
    per = -(-config.body_chars // 4) + 60
    days = max(1, config.lookback_days or 7)
    sums = counts.withColumn("batches", F.ceil(F.col("escalated") / config.batch_size)).withColumns({"input_tokens": F.col("escalated") * per + F.col("batches") * 400, "output_tokens": F.col("escalated") * 40})
    usd = (F.col("input_tokens") * F.col("input") + F.col("output_tokens") * F.col("output")) / 1e6
    return sums.crossJoin(F.broadcast(price)).withColumn("usd_window", usd).withColumn("usd_month", F.col("usd_window") / days * 30).drop("input", "output")


def usage_cost(usage: DataFrame, prices: DataFrame, read: float = 0.1, write: float = 1.25) -> DataFrame:
    """Add usd to calls (model, input_tokens, output_tokens, cache_read, cache_write): the price with the longest name that the model's begins with; 0 without any."""
    models = usage.select("model").distinct()
    table = prices.select(F.col("model").alias("prefix"), F.col("input").alias("p"), F.col("output").alias("q"))
    best = models.join(F.broadcast(table), F.startswith(models["model"], table["prefix"])).groupBy("model").agg(F.max_by(F.struct("p", "q"), F.length("prefix")).alias("best"))
    cost = F.col("input_tokens") * F.col("best.p") + F.col("output_tokens") * F.col("best.q") + F.col("cache_read") * F.col("best.p") * read + F.col("cache_write") * F.col("best.p") * write
    return usage.join(best, "model", "left").withColumn("usd", F.coalesce(cost / 1e6, F.lit(0.0))).drop("best")
