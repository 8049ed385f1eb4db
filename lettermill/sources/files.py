"""Files of JSON lines: the message cache, the journal, configuration."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lettermill.functions.numbers import iso

#: Characters of a body that the cache keeps.
CACHED_BODY = 4000


def read_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines with ``seq``, their place: (file, block, line). Blank and broken lines are skipped."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    text = spark.read.text(path).select("value", place.alias("seq")).where(F.trim("value") != "")
    strict = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    full = StructType.fromDDL("__bad string")
    parsed = text.select(F.from_json("value", StructType([*schema.fields, *full.fields]), strict).alias("v"), "seq")
    return parsed.where("v is not null and v.__bad is null").select(*(F.col("v")[f].alias(f) for f in schema.fieldNames()), "seq")


def to_cached(messages: DataFrame) -> DataFrame:
    """Messages as the cache holds them: dates as text, bodies cut."""
    return messages.drop("replyTo").withColumns({"date": iso(F.col("date")), "bodyText": F.left("bodyText", F.lit(CACHED_BODY))})


def from_cached(rows: DataFrame) -> DataFrame:
    """Back to messages; absent lists are empty."""
    empty = {c: F.coalesce(c, F.array().cast(t)) for c, t in rows.dtypes if t.startswith("array")}
    return rows.withColumns({**empty, "date": F.to_timestamp("date")})


#: Correspondents kept as one JSON object, by address.
PEOPLE = "people map<string, struct<name: string, sentAt: array<bigint>, receivedAt: array<bigint>, latencies: array<bigint>>>"


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """(email, name, sent_ms, received_ms, latencies) of saved correspondents; what a record lacks is empty."""
    each = spark.read.schema(PEOPLE).json(path, multiLine=True).select(F.explode("people").alias("email", "p"))
    times = lambda f, out: F.coalesce(F.col("p")[f], F.array().cast("array<bigint>")).alias(out)
    return each.select("email", F.coalesce("p.name", F.lit("")).alias("name"), times("sentAt", "sent_ms"), times("receivedAt", "received_ms"), times("latencies", "latencies"))


def write_people(people: DataFrame, path: str) -> None:
    """Save correspondents as ``people`` gives them: a line of JSON for each, the earlier ones replaced."""
    people.select("email", "name", F.col("sent_ms").alias("sentAt"), F.col("received_ms").alias("receivedAt"), "latencies").write.mode("overwrite").json(path)


def read_people_lines(spark: SparkSession, path: str) -> DataFrame:
    """(email, name, sent_ms, received_ms, latencies) of correspondents saved by ``write_people``; what a record lacks is empty, broken lines are skipped."""
    rows = read_lines(spark, path, "email string, name string, sentAt array<bigint>, receivedAt array<bigint>, latencies array<bigint>").where("email is not null")
    times = lambda f, out: F.coalesce(F.col(f), F.array().cast("array<bigint>")).alias(out)
    return rows.select("email", F.coalesce("name", F.lit("")).alias("name"), times("sentAt", "sent_ms"), times("receivedAt", "received_ms"), times("latencies", "latencies"))


def write_voice(voices: DataFrame, path: str) -> None:
    """Save texts (voice) that describe how someone writes, a file for each partition; the earlier ones are replaced."""
    voices.select("voice").write.mode("overwrite").text(path)


def read_voice(spark: SparkSession, path: str) -> DataFrame:
    """(voice): each file's whole text."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("voice"))


def append_lines(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    rows.write.mode("overwrite" if overwrite else "append").json(path)


def merged(base: Mapping, over: Mapping) -> dict:
    """Configuration over defaults: mappings merge, anything else replaces, None is as if absent."""
    out = dict(base)
    for key, value in over.items():
        if isinstance(value, Mapping) and isinstance(out.get(key), Mapping):
            out[key] = merged(out[key], value)
        elif value is not None:
            out[key] = value
    return out
