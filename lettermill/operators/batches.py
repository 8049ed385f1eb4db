"""Bounded, redacted projections of messages, in batches with an audit, and what a provider makes of them."""

from __future__ import annotations

import hashlib
import json
import math
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.config import Config
from lettermill.functions.headers import addressing
from lettermill.functions.numbers import iso
from lettermill.functions.redact import RULES, Rule, redacted
from lettermill.functions.text import collapse, display_from
from lettermill.operators.correspondents import PARTS

#: Keys of a projection in the order in which they are hashed.
FIELDS = ("id", "from", "domain", "subject", "date", "addressedAs", "recipientCount", "attachments", "preview", "truncated")


def projections(messages: DataFrame, own: Sequence[str], config: Config = Config(), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """uid, seq and the fields that may leave: cut first, masked by ``rules`` then; redactions has the counts of all rules (0 of those left out)."""
    body = F.coalesce("bodyText", F.lit(""))
    df = messages.select(
        "uid", "seq", display_from(F.col("from")).alias("who"), F.coalesce("from.domain", F.lit("")).alias("domain"),
        F.substring(F.coalesce("subject", F.lit("")), 1, config.subject_chars).alias("subject"), iso(F.col("date")).alias("date"),
        addressing(F.col("to"), F.col("cc"), own).alias("addressedAs"), (F.size("to") + F.size("cc")).alias("recipientCount"),
        F.slice(F.transform("attachments", lambda a: a["filename"]), 1, 10).alias("attachments"),
        F.substring(collapse(body), 1, config.body_chars).alias("preview"), (F.char_length(body) > config.body_chars).alias("truncated"),
    )
    for column, counts in (("who", "__w"), ("subject", "__s"), ("preview", "__b")):
        df = redacted(df, column, f"__{column}", counts, rules).withColumn(column, F.col(f"__{column}")).drop(f"__{column}")
    counted = {r.name for r in rules}
    total = F.struct(*((F.col("__s")[r.name] + F.col("__b")[r.name] if r.name in counted else F.lit(0)).alias(r.name) for r in RULES))
    return df.withColumn("redactions", total).withColumnRenamed("who", "from").drop("__w", "__s", "__b")


def numbered(df: DataFrame, order: str = "seq", size: int = 10, stretch: int = 100_000) -> DataFrame:
    """Add batch and id (place in the batch), from 0, in the order of a whole-number column.

    Rows are numbered in stretches of that column, and each stretch begins where the ones before end:
    only the stretches' counts meet in one task.
    """
    cut = df.withColumn("__cut", F.floor(F.col(order) / stretch))
    counts = cut.groupBy("__cut").agg(F.count("*").alias("__n"))
    ahead = counts.select("__cut", (F.sum("__n").over(Window.orderBy("__cut")) - F.col("__n")).alias("__ahead"))
    at = cut.withColumn("__i", F.row_number().over(Window.partitionBy("__cut").orderBy(order)) - 1).join(ahead, "__cut")
    place = F.col("__i") + F.col("__ahead")
    return at.withColumns({"batch": F.floor(place / size).cast("long"), "id": (place % size).cast("int")}).drop("__cut", "__i", "__ahead")


def batches(projected: DataFrame, config: Config = Config()) -> DataFrame:
    """One row for each batch: uids, serialized, messages, bytes, sha256 and the sums of redactions."""
    rows = numbered(projected, "seq", config.batch_size)
    item = F.struct(*(F.col(f).alias(f) for f in FIELDS))
    counts = [F.sum(F.col("redactions")[r.name]).alias(r.name) for r in RULES]
    grouped = rows.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("id", "uid", item.alias("item")))).alias("rows"), F.count("*").alias("messages"), *counts)
    text = F.to_json(F.transform("rows", lambda r: r["item"]), {"ignoreNullFields": "false"})
    return grouped.select("batch", F.transform("rows", lambda r: r["uid"]).alias("uids"), text.alias("serialized"), "messages", F.struct(*(F.col(r.name) for r in RULES)).alias("redactions")).withColumns({"bytes": F.octet_length("serialized"), "sha256": F.sha2("serialized", 256)})


def halved(rows: DataFrame, size: str = "messages") -> DataFrame:
    """Rows of batches (batch, id) dealt to the two halves of their batch: part 0 has the larger half."""
    n = rows.groupBy("batch").agg(F.count("*").alias(size))
    half = F.ceil(F.col(size) / 2)
    return rows.join(n, "batch").withColumns({"part": (F.col("id") >= half).cast("int"), "id": F.when(F.col("id") >= half, F.col("id") - half).otherwise(F.col("id")).cast("int")})


def audit_totals(batch_rows: DataFrame) -> DataFrame:
    """calls, bytes_sent and how many different hashes; the hashes themselves stay rows of the batches."""
    return batch_rows.agg(F.count("*").alias("calls"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_sent"), F.count_distinct("sha256").alias("hashes"))


class TooLarge(Exception):
    """A provider can't take so many items at once: they are asked again in halves."""


class Refused(Exception):
    """A provider won't answer."""


class Unavailable(Exception):
    """A provider can't answer now (overload, a rate limit, no connection): the batch is asked again, after ``after`` seconds if given."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


#: Seconds before the second, third, .. attempt, and the most that a provider may ask for.
PAUSES, LONGEST_PAUSE = (0.5, 1.0, 2.0, 4.0, 8.0), 60.0


def patient(provider: Callable[[list[dict]], list[dict]], retries: int, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[dict]], list[dict]]:
    """A provider that is asked up to ``retries`` times again when it is unavailable or can't be reached; other errors pass."""

    def ask(items: list[dict]) -> list[dict]:
        for attempt in range(retries + 1):
            try:
                return provider(items)
            except (Unavailable, ConnectionError, TimeoutError) as error:
                if attempt == retries:
                    raise
                after = getattr(error, "after", None)
                sleep(min(after, LONGEST_PAUSE) if after and after > 0 else PAUSES[min(attempt, len(PAUSES) - 1)])
        raise AssertionError

    return ask


class Ledger:
    """What a provider has said to batches, in a shared folder: a file for each, named by the hash of what was sent.

    A task that runs again finds what an earlier attempt was told. Answers, refusals and "too large" are kept, failures aren't.
    """

    def __init__(self, path: str):
        self.path = path

    def around(self, provider: Callable[[list[dict]], list[dict]]) -> Callable[[list[dict]], list[dict]]:
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(self.path)
        files.create_dir(folder, recursive=True)

        def ask(items: list[dict]) -> list[dict]:
            name = f"{folder}/{hashlib.sha256(json.dumps(items, ensure_ascii=False, sort_keys=True).encode('utf-8', 'surrogatepass')).hexdigest()}.json"
            if files.get_file_info(name).type == fs.FileType.File:
                with files.open_input_stream(name) as f:
                    said = json.loads(f.read())
            else:
                try:
                    said = {"answers": provider(items)}
                except TooLarge as error:
                    said = {"too large": str(error)}
                except Refused as error:
                    said = {"refused": str(error)}
                aside = f"{name}.{uuid.uuid4().hex}"
                with files.open_output_stream(aside) as f:
                    f.write(json.dumps(said).encode())
                files.move(aside, name)  # whole or not at all
            if "too large" in said:
                raise TooLarge(said["too large"])
            if "refused" in said:
                raise Refused(said["refused"])
            return said["answers"]

        return ask


def confidence(answer: dict) -> float:
    """An answer's confidence by the rule of ``clamp01``: between 0 and 1, 0.5 if it is missing or no finite number; null and blank text are 0."""
    value = answer.get("confidence", "none")
    if value is None or isinstance(value, str) and not value.strip():
        return 0.0
    try:
        number = float(value) if isinstance(value, (int, float, str)) else math.nan
    except (ValueError, OverflowError):
        return 0.5
    return min(1.0, max(0.0, number)) if math.isfinite(number) else 0.5


def _answers(items: list[dict], uids: list[int], provider: Callable[[list[dict]], list[dict]], split: bool = True) -> list[tuple]:
    """Rows (uid, label, confidence, rationale, seq, warning) of one batch; a warning is a row of its own."""
    try:
        said = provider(items)
    except TooLarge as error:
        if not split or len(items) < 2:
            return [(None, None, None, None, None, f"batch failed after split: {error}")]
        half = -(-len(items) // 2)
        out = []
        for some, own in ((items[:half], uids[:half]), (items[half:], uids[half:])):
            out += _answers([{**x, "id": i} for i, x in enumerate(some)], own, provider, False)
        return out
    except Refused:
        return [(None, None, None, None, None, f"model declined a batch of {len(items)}; left as judged by rules")]
    except Exception as error:  # whatever else a provider raises degrades to the rules' decision
        return [(None, None, None, None, None, f"model unavailable ({error}); {len(items)} message(s) left as judged by rules")]
    out = []
    for seq, a in enumerate(said if isinstance(said, list) else []):
        at = a.get("id") if isinstance(a, dict) else None
        if not isinstance(at, int) or isinstance(at, bool) or not 0 <= at < len(uids):
            continue
        out.append((int(uids[at]), str(a.get("label", "")), confidence(a), str(a.get("rationale", "")), seq, None))
    return out


def asked(batch_rows: DataFrame, provider: Callable[[list[dict]], list[dict]], retries: int = 2, ledger: str | None = None) -> DataFrame:
    """What an injected provider says: answers (uid, label, confidence, rationale, seq) and warnings (warning).

    ``provider`` gets the items of one batch and returns answers with id, label, confidence and
    rationale. If it raises ``Unavailable`` or can't be reached, it is asked again, ``retries`` times at most. If it raises ``TooLarge``, the batch is asked again in halves; whatever else it
    raises is a warning, and the batch's messages keep the rules' decision. Answers for ids that
    aren't in the batch are dropped, confidences are brought to 0 to 1 (see ``confidence``).
    Each evaluation asks again, and so does a task that is run again, unless ``ledger`` names a shared folder
    where answers are kept by the hash of their batch.
    """
    import pandas as pd

    columns = ["uid", "label", "confidence", "rationale", "seq", "warning"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = patient(provider, retries)
        ask = Ledger(ledger).around(ask) if ledger else ask
        for frame in frames:
            out = [row for uids, text in zip(frame["uids"], frame["serialized"], strict=True) for row in _answers(json.loads(text), list(uids), ask)]
            yield pd.DataFrame(out, columns=columns).astype({"uid": "Int64", "seq": "Int64"})

    return batch_rows.select("uids", "serialized").mapInPandas(run, "uid long, label string, confidence double, rationale string, seq long, warning string")


def ask(batch_rows: DataFrame, provider: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """The answers of ``asked`` alone."""
    return asked(batch_rows, provider).where("uid is not null").drop("warning")


def stub_provider(items: list[dict]) -> list[dict]:
    """A deterministic provider for runs without a model."""
    return [{"id": x["id"], "label": "later", "confidence": 0.88, "rationale": "stub"} for x in items]


def digest(messages: DataFrame, sender: str = "from", subject: str = "subject", seq: str = "seq", most: int = 5) -> DataFrame:
    """Each sender's first subjects and how many more there are; senders by their first message (``first_seq``).

    Each part of a sender's messages gives its first ones and their number: no task gets all messages of one sender.
    """
    parted = messages.withColumn("__part", F.pmod(F.xxhash64(seq), F.lit(PARTS)).cast("int"))
    ranked = parted.withColumn("__r", F.row_number().over(Window.partitionBy(sender, "__part").orderBy(seq)))
    listed = F.collect_list(F.when(F.col("__r") <= most, F.struct(F.col(seq).alias("s"), F.col(subject).alias("t"))))
    parts = ranked.groupBy(sender, "__part").agg(F.min(seq).alias("first_seq"), F.count("*").alias("n"), listed.alias("__l"))
    out = parts.groupBy(sender).agg(F.min("first_seq").alias("first_seq"), F.sum("n").alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list("__l"))), 1, most).alias("__l"))
    return out.select(sender, "first_seq", "n", F.transform("__l", lambda x: x["t"]).alias("subjects"), F.greatest(F.col("n") - most, F.lit(0)).alias("more"))
