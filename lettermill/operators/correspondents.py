"""The graph of correspondents: edges, statistics as of a moment, reply latencies, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions.headers import recipients
from lettermill.functions.numbers import half_up
from lettermill.operators.asof import latest_before
from lettermill.sources.shared import settled


#: A key's rows are first ranked in so many parts.
PARTS = 64


def edges(received: DataFrame, sent: DataFrame) -> DataFrame:
    """Correspondence in long form: one row for a received message, one for each recipient of a sent one.

    Received rows come first in seq, so that names are learned from them before sent ones; a recipient
    in both To and Cc counts twice. Both inputs carry ``seq``, the order of input.
    """
    got = received.where(F.col("from.email") != "").select(F.lower("from.email").alias("email"), F.col("from.domain").alias("domain"), F.lit("received").alias("direction"), F.unix_millis("date").alias("ts_ms"), F.col("from.name").alias("name"), "seq")
    out = sent.select(F.explode(recipients(F.col("to"), F.col("cc"))).alias("r"), "date", "seq")
    out = out.select(F.lower("r.email").alias("email"), F.col("r.domain").alias("domain"), F.lit("sent").alias("direction"), F.unix_millis("date").alias("ts_ms"), F.col("r.name").alias("name"), (F.col("seq") + (1 << 40)).alias("seq"))
    return got.unionByName(out)


def capped(graph: DataFrame, cap: int = 500) -> DataFrame:
    """The last ``cap`` events of each address and direction, in the order of input.

    The last of each part of an address first, then the last of those: no task gets all events of one address.
    """
    w = lambda *part: Window.partitionBy("email", "direction", *part).orderBy(F.col("seq").desc())
    some = graph.withColumn("__part", F.pmod(F.xxhash64("seq"), F.lit(PARTS)).cast("int")).withColumn("__rank", F.row_number().over(w("__part"))).where(F.col("__rank") <= cap)
    return some.withColumn("__rank", F.row_number().over(w())).where(F.col("__rank") <= cap).drop("__rank", "__part")


def person_stats(graph: DataFrame, as_of_ms: int | None = None) -> DataFrame:
    """sent_to, received_from, last_sent_ms and name of each address, of events before ``as_of_ms`` if given."""
    seen = graph if as_of_ms is None else graph.where(F.col("ts_ms") < as_of_ms)
    stats = seen.groupBy("email").agg(F.count_if(F.col("direction") == "sent").alias("sent_to"), F.count_if(F.col("direction") == "received").alias("received_from"), F.max(F.when(F.col("direction") == "sent", F.col("ts_ms"))).alias("last_sent_ms"))
    names = graph.where("name <> ''").groupBy("email").agg(F.min_by("name", "seq").alias("name"))
    return stats.join(names, "email", "left")


def domain_stats(graph: DataFrame, as_of_ms: int | None = None) -> DataFrame:
    """How many messages were sent to each domain, events capped by person as given."""
    seen = graph if as_of_ms is None else graph.where(F.col("ts_ms") < as_of_ms)
    return seen.where("direction = 'sent'").groupBy("domain").agg(F.count("*").alias("domain_sent_to"))


def reply_latencies(received: DataFrame, sent: DataFrame) -> DataFrame:
    """(email, latency_ms): each sent message with the latest earlier received one of its thread, counted for that one's sender."""
    ours = sent.where("threadId <> ''").select("threadId", F.unix_millis("date").alias("ms"))
    theirs = received.where("threadId <> ''").select("threadId", F.unix_millis("date").alias("ms"), F.struct("seq", F.lower("from.email").alias("email")).alias("who"))
    hit = latest_before(ours, theirs, ["threadId"], "ms", "who", "hit", 86_400_000)
    return hit.where(F.col("hit").isNotNull()).select(F.col("hit.email").alias("email"), (F.col("ms") - F.col("hit_at")).alias("latency_ms")).where("latency_ms >= 0")


def people(graph: DataFrame, latencies: DataFrame, cap: int = 500) -> DataFrame:
    """(email, name, sent_ms, received_ms, latencies): what is saved of each correspondent.

    Times of the last ``cap`` events of each direction in the order of input, and as many latencies in the order of
    ``seq``; the name is the first that was given. A list never has more than ``cap`` entries.
    """
    kept = capped(graph, cap)
    none = F.array().cast("array<bigint>")
    times = lambda d: F.transform(F.sort_array(F.collect_list(F.when(F.col("direction") == d, F.struct("seq", "ts_ms")))), lambda x: x["ts_ms"])
    events = kept.groupBy("email").agg(times("sent").alias("sent_ms"), times("received").alias("received_ms"))
    names = graph.where("name <> ''").groupBy("email").agg(F.min_by("name", "seq").alias("name"))
    last = capped(latencies.withColumn("direction", F.lit("")), cap).groupBy("email").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "latency_ms"))), lambda x: x["latency_ms"]).alias("latencies"))
    found = events.join(names, "email", "left").join(last, "email", "left")
    return found.select("email", F.coalesce("name", F.lit("")).alias("name"), "sent_ms", "received_ms", F.coalesce("latencies", none).alias("latencies"))


#: Bits of a value that are told apart on each level of a selection: no window holds more than 2^16 counts of lower levels.
SHIFTS = (32, 16, 0)


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): the middle of each key's whole numbers, or the mean of the two in the middle.

    Exact, by selection on counts: values are counted by their highest bits first, then only those that share these with
    a middle one, by the next. No task gets a key's values, however many they are. Null values don't count.
    """
    counts = settled(rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n")), "value-counts")
    places = F.array_distinct(F.array(F.floor((F.col("t") - 1) / 2), F.floor(F.col("t") / 2)))
    want = counts.groupBy("k").agg(F.sum("n").alias("t")).select("k", F.explode(places).alias("place"), F.lit(0).cast("long").alias("prefix")).withColumn("which", F.col("place"))
    above = None
    for shift in SHIFTS:
        own = counts.withColumn("prefix", F.lit(0).cast("long") if above is None else F.shiftright("v", above))
        if above is not None:
            own = own.join(want.select("k", "prefix").distinct(), ["k", "prefix"], "left_semi")
        sums = own.groupBy("k", "prefix", F.shiftright("v", shift).alias("next")).agg(F.sum("n").alias("n"))
        earlier = Window.partitionBy("k", "prefix").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        inside = (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n"))
        want = want.join(sums, ["k", "prefix"]).where(inside).select("k", "which", (F.col("place") - F.col("before")).alias("place"), F.col("next").alias("prefix"))
        above = shift
    return want.groupBy(F.col("k").alias(key)).agg(F.avg("prefix").alias("median"))


def median_latency(latencies: DataFrame) -> DataFrame:
    """(email, median_latency_ms), halves rounded upwards."""
    return medians(latencies, "email", "latency_ms").select("email", half_up(F.col("median")).alias("median_latency_ms"))


def with_rules(people: DataFrame, rules: DataFrame) -> DataFrame:
    """Mark addresses that are important or muted; rules are keyed by address in any case, and few (they are configured by hand)."""
    keyed = rules.groupBy(F.lower("email").alias("email")).agg(F.bool_or("is_vip").alias("is_vip"), F.bool_or("is_muted").alias("is_muted"))
    marked = people.join(keyed, "email", "left")
    return marked.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_vip", "is_muted")})


def thread_index(sent: DataFrame) -> DataFrame:
    """How often, and when last, one wrote in each thread."""
    return sent.where("threadId <> ''").groupBy("threadId").agg(F.count("*").alias("user_messages"), F.max("date").alias("user_last_at"))


def replied_threads(sent: DataFrame) -> DataFrame:
    """The times at which one wrote in each thread, ascending."""
    return sent.where("threadId <> ''").groupBy("threadId").agg(F.sort_array(F.collect_list("date")).alias("replied_at"))
