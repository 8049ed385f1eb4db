"""Folders and scans of a mailbox, lookups, replies and results as text, actions written down before they are done."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.numbers import iso
from lettermill.functions.text import display_from
from lettermill.operators.batches import FIELDS, numbered
from lettermill.sources.files import append_lines
from lettermill.sources.mail import since

#: Kinds of folders with the name used where none is configured; None: what the server tells.
FOLDERS = {"inbox": "INBOX", "sent": None, "drafts": None, "later": "Later", "brief": "Brief", "noise": "Noise"}
#: Characters of a voice profile that go with a request for a draft.
VOICE_CHARS = 4000


def resolve_folders(configured: DataFrame, detected: DataFrame, defaults: Mapping[str, str | None] = FOLDERS) -> DataFrame:
    """(kind, name) of each kind: the configured name, else the default, else what the server tells; an empty name is none."""
    kinds = configured.sparkSession.createDataFrame(list(defaults.items()), "kind string, fallback string")
    named = lambda df, out: df.select("kind", F.nullif("name", F.lit("")).alias(out))
    both = kinds.join(named(configured, "own"), "kind", "left").join(named(detected, "told"), "kind", "left")
    return both.select("kind", F.coalesce("own", "fallback", "told").alias("name"))


def scan(messages: DataFrame, folders: DataFrame, kind: str, as_of: Column, days: int, limit: int = 2000) -> DataFrame:
    """The newest ``limit`` messages (by uid) of a kind's folder in the last days; nothing if there is no such folder."""
    name = folders.where((F.col("kind") == kind) & F.col("name").isNotNull()).select(F.col("name").alias("folder"))
    return since(messages.join(name, "folder", "left_semi"), as_of, days).orderBy(F.col("uid").desc()).limit(limit)


def with_uids(messages: DataFrame, uids: DataFrame) -> DataFrame:
    """The messages whose uid is listed."""
    return messages.join(uids.select("uid"), "uid", "left_semi")


def cached_message(cache: DataFrame, uid: int, seq: str = "seq") -> DataFrame:
    """The first cached row of a uid that isn't one's own."""
    return cache.where((F.col("uid") == uid) & (F.col("folder") != "Sent")).orderBy(seq).limit(1)


def own_messages(cache: DataFrame) -> DataFrame:
    """Cached rows that count as sent: all that aren't in the inbox."""
    return cache.where(F.col("folder") != "INBOX")


def reply(sender: str, body: Column) -> Column:
    """A reply to a message row as text: headers, an empty line, the body; to the first Reply-To, else to the sender."""
    to = F.when(F.size("replyTo") > 0, F.get("replyTo", F.lit(0))).otherwise(F.col("from"))
    subject = F.when(F.col("subject").rlike(r"(?i)\Are:"), F.col("subject")).otherwise(F.concat(F.lit("Re: "), F.coalesce("subject", F.lit(""))))
    known = F.nullif("messageId", F.lit(""))
    lines = (F.lit(f"From: {sender}"), F.concat(F.lit("To: "), display_from(to)), F.concat(F.lit("Subject: "), subject), F.concat(F.lit("In-Reply-To: "), known), F.concat(F.lit("References: "), known))
    return F.concat_ws("\n", *lines, F.lit("Content-Type: text/plain; charset=utf-8"), F.lit(""), body)


def drafted(projected: DataFrame, provider: Callable[[dict, str], str] | None, voice: str = "") -> DataFrame:
    """(uid, body, warning): what a provider writes in answer to each projection; a failure is a warning. Without a provider, an error."""
    import pandas as pd

    if provider is None:
        raise ValueError("drafts need a provider")
    style = voice[:VOICE_CHARS]

    def one(uid: int, item: str) -> tuple:
        try:
            return uid, str(provider(json.loads(item), style)), None
        except Exception as error:  # whatever a provider raises concerns this draft alone
            return uid, None, f"no draft: {error}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([one(u, t) for u, t in zip(frame["uid"], frame["item"], strict=True)], columns=["uid", "body", "warning"])

    item = F.to_json(F.struct(F.lit(0).alias("id"), *(F.col(f).alias(f) for f in FIELDS if f != "id")), {"ignoreNullFields": "false"})
    return projected.select("uid", item.alias("item")).mapInPandas(run, "uid long, body string, warning string")


def chosen(settings: Mapping, known: Mapping[str, Callable[[Mapping], Callable]]) -> Callable | None:
    """The provider that ``settings['provider']`` names, made of the settings; None for "none"; an unknown name is an error."""
    kind = str(settings.get("provider") or "none").lower()
    if kind == "none":
        return None
    if kind not in known:
        raise ValueError(f"unknown provider {kind!r} (expected one of {', '.join([*known, 'none'])})")
    return known[kind](settings)


def decisions_json(decisions: DataFrame) -> DataFrame:
    """(uid, json): each decision without weights, as results are handed on."""
    reasons = F.transform("reasons", lambda r: F.struct(r["code"].alias("code"), r["detail"].alias("detail")))
    return decisions.select("uid", F.to_json(F.struct("uid", "messageId", "label", "confidence", "tier", reasons.alias("reasons"))).alias("json"))


def cost_notes(journal: DataFrame) -> DataFrame:
    """usd, input, output, calls and runs of all notes on cost; zeros if there are none."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return journal.where("phase = 'note' AND type = 'cost'").agg(*(total(c) for c in ("usd", "input", "output", "calls")), F.count("*").alias("runs"))


def normalized(a: Column) -> Column:
    """An action with empty texts and lists for what it lacks."""
    text = lambda f: F.coalesce(a[f], F.lit("")).alias(f)
    return F.struct(a["action"].alias("action"), a["uid"].alias("uid"), text("messageId"), text("from"), text("to"), F.coalesce(a["flags"], F.array().cast("array<string>")).alias("flags"), text("label"))


def run_id(ts: Column, salt: Column) -> Column:
    """The moment, with - for colons and points, and six digits of the salt's hash."""
    return F.concat(F.regexp_replace(iso(ts), "[:.]", "-"), F.lit("-"), F.left(F.md5(salt.cast("string")), F.lit(6)))


def carry_out(actions: DataFrame, do: Callable[[DataFrame], DataFrame], run: str, journal: str, ts: Column, size: int = 1000) -> None:
    """Write all intents to the journal; when they are stored, do the actions and append what came of them.

    ``do`` gets the actions and returns them with applied and error. Intents are written ``size`` to
    a line. If ``do`` fails, the intents stand without results: an orphaned run. A null error is none,
    a long one is cut to 500 characters.
    """
    action = normalized(F.struct(*(F.col(c) for c in ("action", "uid", "messageId", "from", "to", "flags", "label"))))
    line = [F.lit(run).alias("runId"), iso(ts).alias("ts")]
    grouped = numbered(actions, "uid", size).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("id", action.alias("a")))).alias("l"))
    append_lines(grouped.select(*line, F.lit("intent").alias("phase"), F.transform("l", lambda x: x["a"]).alias("actions")), journal)
    append_lines(do(actions).select(*line, F.lit("result").alias("phase"), action.alias("action"), "applied", F.left("error", F.lit(500)).alias("error")), journal)


def usage_totals(priced: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """input, output, calls and usd of calls with their price."""
    return priced.groupBy(*by).agg(F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"), F.count("*").alias("calls"), F.sum("usd").alias("usd"))


def valid_cache(cache: DataFrame, epochs: DataFrame) -> DataFrame:
    """The cache, or none of it if any folder's epoch changed: its uids may stand for other messages."""
    return cache.join(epochs.where("changed").select(F.lit(1).alias("__changed")).limit(1), F.lit(True), "left_anti")
