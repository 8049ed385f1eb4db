"""Raw mail to message rows: headers, encoded words, addresses, structure; and captured server transcripts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions.headers import KEPT_HEADERS
from lettermill.functions.mime import ADDRESS, address_list, decode_words, empty_line, field, head_and_body, named, with_structure
from lettermill.functions.numbers import header_date
from lettermill.functions.text import best_text, message_id, thread_key, trimmed
from lettermill.sources.shared import small_batches

# Bounds of what is read of one response.
MAX_LITERAL, MAX_LINE, MAX_NESTING = 8 << 20, 128 << 10, 32


def normalize(rows: DataFrame, folder: str = "INBOX") -> DataFrame:
    """Message rows of server rows (uid, raw, flags, internalDate, size).

    Rows without a uid go. The server's date counts before the header's; without either it is 1970.
    Null raw is a message without headers and body.
    """
    small_batches(rows.sparkSession)
    raw = F.coalesce("raw", F.lit(""))
    fields = ("message-id", "references", "in-reply-to", "date", "subject")
    people = {"from": "from", "to": "to", "cc": "cc", "replyTo": "reply-to"}
    head = F.col("__head")  # its lines with their names
    value = lambda n: F.col("__h")[n]
    p = rows.where("uid is not null").withColumn("__head", head_and_body(raw)["head"]).withColumn("__head", named(F.col("__head")))
    p = p.withColumn("__h", F.struct(*(field(head, n).alias(n) for n in (*fields, *people.values())), F.map_from_arrays(F.array(*map(F.lit, KEPT_HEADERS)), F.array(*(field(head, n) for n in KEPT_HEADERS))).alias("kept")))
    p = p.withColumn("__split", empty_line(raw))
    split = F.col("__split")
    has_body = (split > 0) & (F.char_length(raw) > split + 1)
    p = with_structure(p, F.when(has_body, raw).otherwise(""), "__s")
    own = message_id(value("message-id"))
    nobody = F.struct(F.lit("").alias("name"), F.lit("").alias("email"), F.lit("").alias("domain")).cast(ADDRESS)
    who = {k: address_list(value(n)) for k, n in people.items()}
    return p.select(
        F.col("uid").cast("long").alias("uid"), F.lit(folder).alias("folder"), own.alias("messageId"), thread_key(value("references"), value("in-reply-to"), own).alias("threadId"),
        F.coalesce(F.get(who["from"], F.lit(0)), nobody).alias("from"), *(who[k].alias(k) for k in ("to", "cc", "replyTo")), trimmed(decode_words(value("subject"))).alias("subject"),
        F.coalesce(F.col("internalDate"), header_date(value("date")), F.timestamp_seconds(F.lit(0))).alias("date"), F.coalesce("flags", F.array().cast("array<string>")).alias("flags"),
        F.coalesce(F.nullif(F.col("size"), F.lit(0)), F.char_length(raw)).cast("long").alias("size"), F.map_filter(value("kept"), lambda k, v: v != "").alias("headers"),
        F.when(has_body, best_text(F.col("__s.text"), F.col("__s.html"))).otherwise("").alias("bodyText"), F.col("__s.attachments").alias("attachments"), has_body.alias("hasBody"),
    )


def since(messages: DataFrame, as_of, days: int) -> DataFrame:
    """Messages of the last days before ``as_of`` (a timestamp column), by whole days as servers count."""
    return messages.where(F.col("date") >= F.to_date(as_of - F.make_dt_interval(F.lit(days))))


# --- captured transcripts -----------------------------------------------------

_TOKEN = re.compile(rb'\s*(?:(\()|(\))|"((?:[^"\\]|\\.)*)"|\{(\d+)\+?\}\r\n|([^\s()"{}\[]+(?:\[[^\]]*\][^\s()]*)?|[^\s()"]+))', re.S)


def responses(data: bytes) -> Iterator[bytes]:
    """Server responses: lines, with literals of announced length in them."""
    at = 0
    while at < len(data):
        begin = at
        while True:
            end = data.find(b"\r\n", at)
            if end < 0:
                return
            if end - at > MAX_LINE:
                raise ValueError("a line is too long")
            literal = re.search(rb"\{(\d+)\+?\}\Z", data[at:end])
            if not literal:
                break
            if int(literal[1]) > MAX_LITERAL:
                raise ValueError("a literal is too long")
            at = end + 2 + int(literal[1])
            if at > len(data):
                return
        yield data[begin:end]
        at = end + 2


def streamed(read: Callable[[int], bytes], size: int = 1 << 20) -> Iterator[bytes]:
    """The responses of a stream; no more is held than one response and ``size`` bytes."""
    held = b""
    while True:
        more = read(size)
        held += more
        at = 0
        for response in responses(held):
            yield response
            at += len(response) + 2
        held = held[at:]
        if not more:
            return


def tokens(data: bytes) -> list:
    """Atoms and strings as bytes, NIL as None, lists nested."""
    out: list[list] = [[]]
    at = 0
    while m := _TOKEN.match(data, at):
        at = m.end()
        if m[1]:
            if len(out) > MAX_NESTING:
                raise ValueError("a response is nested too deep")
            out.append([])
        elif m[2]:
            if len(out) > 1:
                last = out.pop()
                out[-1].append(last)
        elif m[3] is not None:
            out[-1].append(re.sub(rb"\\(.)", rb"\1", m[3], flags=re.S))
        elif m[4]:
            out[-1].append(data[at : at + int(m[4])])
            at += int(m[4])
        else:
            out[-1].append(None if m[5].upper() == b"NIL" else m[5])
    while len(out) > 1:
        last = out.pop()
        out[-1].append(last)
    return out[0]


def classify_response(data: bytes) -> str:
    """continuation, untagged, OK, NO, BAD or unknown."""
    if data.startswith(b"+"):
        return "continuation"
    if data.startswith(b"* "):
        return "untagged"
    m = re.match(rb"\S+ (OK|NO|BAD)\b", data, re.I)
    return m[1].decode().upper() if m else "unknown"


def fetched(data: bytes, wanted=None) -> dict | None:
    """seq, uid, flags, internalDate, size and raw of a FETCH response; of repeated items the last counts.

    ``wanted`` (uid, date as text) may turn a response down before its flags and text are decoded.
    """
    parts = tokens(data)
    if len(parts) < 4 or parts[0] != b"*" or (parts[2] or b"").upper() != b"FETCH" or not isinstance(parts[3], list):
        return None
    items = {k.decode("latin-1").lower(): v for k, v in zip(parts[3][::2], parts[3][1::2], strict=False) if isinstance(k, bytes)}
    text = lambda v: v.decode("latin-1") if isinstance(v, bytes) else None
    number = lambda v: int(v) if isinstance(v, bytes) and v.isdigit() else None
    if wanted is not None and not wanted(number(items.get("uid")), text(items.get("internaldate"))):
        return None
    body = next((v for k, v in items.items() if k.startswith("body[") or k.startswith("rfc822") and k != "rfc822.size"), None)
    flags = [text(f) for f in items.get("flags") or [] if isinstance(f, bytes)]
    return {"seq": number(parts[1]), "uid": number(items.get("uid")), "flags": flags, "received": text(items.get("internaldate")), "size": number(items.get("rfc822.size")), "raw": text(body)}


def told(data: bytes) -> list[dict]:
    """What a response says of folders: kind list (name, flags, delimiter), found (number: a uid), exists or epoch (number)."""
    if epoch := re.match(rb"(?i)\S+ OK .*?\[UIDVALIDITY (\d+)\]", data):
        return [{"kind": "epoch", "number": int(epoch[1])}]
    parts = tokens(data)
    if len(parts) < 2 or parts[0] != b"*":
        return []
    text = lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else ""
    verb = text(parts[1]).upper()
    if verb == "LIST" and len(parts) > 4 and text(parts[4]):
        flags = [text(f) for f in parts[2]] if isinstance(parts[2], list) else []
        return [{"kind": "list", "name": text(parts[4]), "flags": flags, "delimiter": text(parts[3]) or "/"}]
    if verb == "SEARCH":
        return [{"kind": "found", "number": int(p)} for p in parts[2:] if isinstance(p, bytes) and p.isdigit() and int(p) > 0]
    if len(parts) > 2 and text(parts[2]).upper() == "EXISTS" and verb.isdigit():
        return [{"kind": "exists", "number": int(verb)}]
    return []


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    """What captured sessions say of folders, a row for each fact: file, position, kind, name, flags, delimiter, number."""
    columns = ["file", "position", "kind", "name", "flags", "delimiter", "number"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{**row, "file": file, "position": at} for file, data in zip(frame["path"], frame["content"], strict=True) for at, r in enumerate(responses(bytes(data))) for row in told(r)]
            yield pd.DataFrame(rows, columns=columns).astype({"number": "Int64", "position": "Int64"}).astype({c: object for c in ("name", "flags", "delimiter")}).where(lambda x: x.notna(), None)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, position long, kind string, name string, flags array<string>, delimiter string, number long")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Server rows of captured sessions, a file for each: what ``normalize`` takes, and file and seq."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{**row, "file": file} for file, data in zip(frame["path"], frame["content"], strict=True) for r in responses(bytes(data)) if (row := fetched(r))]
            yield pd.DataFrame(rows, columns=["file", "seq", "uid", "flags", "received", "size", "raw"]).astype({"seq": "Int64", "uid": "Int64", "size": "Int64"})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, seq long, uid long, flags array<string>, received string, size long, raw string")
    return rows.withColumn("internalDate", F.try_to_timestamp(F.trim("received"), F.lit("d-MMM-yyyy HH:mm:ss Z"))).drop("received")
